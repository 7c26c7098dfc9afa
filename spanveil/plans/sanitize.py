"""The whole path from text to masked text: the order of its steps is part of what it means."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_placeholders, with_normalised
from ..operators import combine, encoded, filters, urls, vault, windows
from ..operators.detect import detect
from ..operators.pack import PACK, Recognizer
from ..sources.tables import written

SPAN = ["doc_id", "label", "start", "end", "score", "value"]


def find(docs: DataFrame, recognizers: Iterable[Recognizer] = PACK, model_spans: DataFrame | None = None, cuts: dict[str, float] = filters.CUTS,
         disabled: list[str] = filters.DISABLED, hosts: dict[str, str] | None = None, normalise: bool = True) -> DataFrame:
    """(doc_id, label, start, end, score, value): the spans to mask in (doc_id, text).

    Model spans are shaped (places, quads, UUIDs, product names) and cut before anything is deduplicated; patterns run
    on the text and, where normalising changes it, on the normalised text too; digests, log stamps and clean URLs are
    released before spans of different labels are merged, so that no released part takes a secret with it.
    """
    recognizers = list(recognizers)
    texts = docs.select("doc_id", escape_placeholders(F.col("text")).alias("text"))
    # Longer texts go by overlapping segments, each of which is normalised too.
    parts = windows.segments(texts).select(F.struct(F.col("doc_id").alias("id"), F.col("start").alias("at")).alias("doc_id"), "text", F.col("end").alias("upto"))
    model = None
    if model_spans is not None:
        # Shaped and cut before any pattern defers to them: what is dropped later must not silence another span.
        shaped = filters.drop_product_names(filters.resolve_uuids(filters.drop_quads(filters.geo(model_spans)), texts))
        model_spans = combine.dedupe(filters.above_cut(filters.enabled(shaped, disabled), cuts))
        inside = parts.select(F.col("doc_id").alias("part"), F.col("doc_id.id").alias("doc_id"), F.col("doc_id.at").alias("at"), "upto").join(model_spans, "doc_id")
        inside = inside.where((F.col("end") > F.col("at")) & (F.col("start") < F.col("upto")))
        model = inside.select(F.col("part").alias("doc_id"), (F.col("start") - F.col("at")).alias("start"), (F.col("end") - F.col("at")).alias("end"))
    parts = parts.drop("upto")
    found = detect(parts, recognizers, model).select(*SPAN).unionByName(encoded.base64_spans(parts).select(*SPAN))
    if normalise:
        changed = with_normalised(parts).where("origin IS NOT NULL").select("doc_id", F.col("normalised").alias("text"), "origin", F.col("text").alias("before"))
        again = detect(changed, recognizers, changed=True)
        found = found.unionByName(again.select("doc_id", "label", *[F.col(f"before_{x}").alias(x) for x in ("start", "end")], "score", F.col("before_value").alias("value")))
    at = F.col("doc_id.at")
    found = found.select(F.col("doc_id.id").alias("doc_id"), "label", (F.col("start") + at).alias("start"), (F.col("end") + at).alias("end"), "score", "value")
    if model_spans is not None:
        found = found.unionByName(model_spans.join(texts, "doc_id").withColumn("value", F.expr("substring(text, start + 1, end - start)")).select(*SPAN))
    found = filters.above_cut(filters.enabled(found, disabled), cuts)
    found = filters.drop_log_stamps(filters.drop_in_digests(found, texts), texts)
    # Spans are few beside their texts and read by several branches from here on: held, spilling to disk, until the
    # result is written, instead of being detected again for each. A lost part is computed anew from the texts.
    found = found.persist(StorageLevel.MEMORY_AND_DISK)
    found = urls.release_clean(found, urls.policy(hosts))
    merged = combine.dedupe(found, across_labels=True)
    merged = combine.join_addresses(combine.refine(merged, texts), texts)
    # Written, so that the plans of what reads the spans don't hold the whole pack over and over; only their places are, and
    # the values come from the texts again.
    merged = written(combine.merge(merged), "spans")
    found.unpersist()
    return merged.join(texts, "doc_id").withColumn("value", F.expr("substring(text, start + 1, end - start)")).select(*SPAN)


def sanitize(docs: DataFrame, spans: DataFrame, salt: str = "") -> tuple[DataFrame, DataFrame]:
    """Masked texts (session_id, seq, text, masked) and the vault. ``docs``: session_id, seq, doc_id, text.

    Spans are found with literal double braces escaped. An escape keeps the length, so the texts themselves are cut at the
    places: braces and the escape's own characters stand as they were in what comes out, values too.
    Values that an earlier text of the session masked are masked wherever they stand as whole words.
    """
    texts = docs.withColumn("text", escape_placeholders(F.col("text")))
    rows = docs.select("session_id", "seq", "doc_id")
    found = spans.join(rows, "doc_id").persist(StorageLevel.MEMORY_AND_DISK)
    earlier = found.groupBy("session_id", "label", "value").agg(F.min("seq").alias("first_seq"))
    # Sessions of one text have nothing earlier.
    later = texts.join(earlier.groupBy("session_id").agg(F.min("first_seq").alias("_least")), "session_id").where(F.col("seq") > F.col("_least")).drop("_least")
    known = vault.known_values(later, earlier).join(rows, ["session_id", "seq"])
    both = combine.merge(spans.select(*SPAN).drop("value").unionByName(known.select(*SPAN).drop("value")))
    value = F.expr("substring(text, start + 1, end - start)")
    placed = both.join(docs.select("session_id", "seq", "doc_id", "text"), "doc_id").withColumn("value", value).drop("text").persist(StorageLevel.MEMORY_AND_DISK)
    entries = vault.allocate(placed, salt=salt)
    return vault.mask(docs, placed, entries), entries


def round_trip(masked: DataFrame, entries: DataFrame, salt: str = "") -> DataFrame:
    """Texts that restoring doesn't give back, lost ones too: none."""
    back = vault.restore(masked, entries, salt=salt)
    return masked.join(back, ["session_id", "seq"], "left").where(~F.col("restored").eqNullSafe(F.col("text")))
