"""Pseudonymisation: placeholders by session, masking, and restoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MIN_KNOWN = 3
PLACEHOLDER = r"\{\{PII_[A-Z_]+_\d+_[0-9a-f]{16}\}\}"


def session_prefix(session_key: Column, salt: str = "") -> Column:
    """16 hex digits that name a session; derived, so that a retried task gives the same."""
    return F.substring(F.sha2(F.concat(session_key.cast("string"), F.lit(salt)), 256), 1, 16)


def placeholder(label: Column, index: Column, prefix: Column) -> Column:
    return F.concat(F.lit("{{PII_"), F.upper(label), F.lit("_"), index.cast("string"), F.lit("_"), prefix, F.lit("}}"))


def allocate(spans: DataFrame, session: str = "session_id", seq: str = "seq", salt: str = "") -> DataFrame:
    """The vault (session, label, value, idx, placeholder): one entry per distinct value, numbered by first place.

    Values meet by (session, label, value); only distinct ones are ranked per (session, label).
    """
    first = spans.groupBy(session, "label", "value").agg(F.min(F.struct(seq, "start")).alias("first"))
    order = W.partitionBy(session, "label").orderBy("first", "value")
    numbered = first.withColumn("idx", F.row_number().over(order) - 1)
    return numbered.select(session, "label", "value", "idx", placeholder(F.col("label"), F.col("idx"), session_prefix(F.col(session), salt)).alias("placeholder"))


def mask(texts: DataFrame, spans: DataFrame, vault: DataFrame, session: str = "session_id", seq: str = "seq") -> DataFrame:
    """(session, seq, text, masked): disjoint spans replaced by their placeholders. ``spans``: session, seq, label, start, end, value."""
    named = spans.join(vault, [session, "label", "value"])
    per_text = named.groupBy(session, seq).agg(F.array_sort(F.collect_list(F.struct("start", "end", "placeholder"))).alias("cuts"))
    joined = texts.join(per_text, [session, seq], "left")
    pieces = F.aggregate(
        "cuts",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("done")),
        lambda a, c: F.struct(
            c["end"].cast("int").alias("at"),
            F.concat(a["done"], F.substring(F.col("text"), a["at"] + 1, c["start"].cast("int") - a["at"]), c["placeholder"]).alias("done"),
        ),
        lambda a: F.concat(a["done"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))),
    )
    return joined.select(session, seq, "text", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(pieces).alias("masked"))


def classify(replies: DataFrame, vault: DataFrame, session: str = "session_id", seq: str = "seq", text_col: str = "masked", salt: str = "") -> DataFrame:
    """Each placeholder of a reply: known, unknown (this session's prefix, no entry) or foreign (another's)."""
    found = replies.select(session, seq, F.posexplode(F.regexp_extract_all(text_col, F.lit(PLACEHOLDER), F.lit(0))).alias("place", "placeholder"))
    own = F.regexp_extract("placeholder", "([0-9a-f]{16})", 1) == session_prefix(F.col(session), salt)
    kind = F.when(F.col("value").isNotNull(), "known").when(own, "unknown").otherwise("foreign")
    return found.join(vault.select(session, "placeholder", "label", "value"), [session, "placeholder"], "left").withColumn("kind", kind)


def restore(replies: DataFrame, vault: DataFrame, session: str = "session_id", seq: str = "seq", text_col: str = "masked", salt: str = "", strict: bool = False) -> DataFrame:
    """(session, seq, restored, replacements, replacements_by_label, unknown, foreign).

    Placeholders are looked up by a join, then spliced back; with ``strict`` the first anomaly fails the query.
    """
    found = classify(replies, vault, session, seq, text_col, salt)
    if strict:
        bad = F.col("kind") != "known"
        found = found.withColumn("kind", F.when(bad, F.raise_error(F.concat(F.lit("placeholder not of this session: "), F.col("placeholder")))).otherwise(F.col("kind")))
    known = F.col("kind") == "known"
    per = found.groupBy(session, seq).agg(
        F.array_sort(F.collect_list(F.struct("place", F.coalesce("value", "placeholder").alias("put")))).alias("puts"),
        F.count(F.when(known, 1)).alias("replacements"),
        F.collect_list(F.when(known, F.col("label"))).alias("labels"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "unknown", F.col("placeholder")))).alias("unknown"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "foreign", F.col("placeholder")))).alias("foreign"),
    )
    joined = replies.join(per, [session, seq], "left").withColumn("_gaps", F.split(text_col, PLACEHOLDER, -1))
    spliced = F.concat(F.get("_gaps", F.lit(0)), F.array_join(F.transform("puts", lambda p, i: F.concat(p["put"], F.get(F.col("_gaps"), i + 1))), ""))
    names = F.array_distinct("labels")
    counts = F.map_from_arrays(names, F.transform(names, lambda n: F.size(F.filter("labels", lambda x: x == n))))
    return joined.select(
        session, seq, F.when(F.col("puts").isNull(), F.col(text_col)).otherwise(spliced).alias("restored"),
        F.coalesce("replacements", F.lit(0).cast("long")).alias("replacements"), counts.alias("replacements_by_label"), "unknown", "foreign",
    )


def known_values(texts: DataFrame, vault_of_earlier: DataFrame, session: str = "session_id", seq: str = "seq") -> DataFrame:
    """Whole-word occurrences, overlapping ones too, of values that an earlier text of the session masked.

    An edge of the value that is a letter, digit or underscore must not touch another one; any other edge may touch anything.
    ``vault_of_earlier``: session, first_seq, label, value. Joined by session, and only where the text holds the value.
    """
    v = vault_of_earlier.where(F.length("value") >= MIN_KNOWN)
    joined = texts.join(v, session).where((F.col("first_seq") < F.col(seq)) & F.col("text").contains(F.col("value")))
    places = F.expr(r"""filter(transform(sequence(1, length(text) - length(value) + 1), p -> IF(substring(text, p, length(value)) = value
        AND NOT (value RLIKE '^[\\p{L}\\p{N}_]' AND substring(text, p - 1, IF(p > 1, 1, 0)) RLIKE '^[\\p{L}\\p{N}_]$')
        AND NOT (value RLIKE '[\\p{L}\\p{N}_]\\z' AND substring(text, p + length(value), 1) RLIKE '^[\\p{L}\\p{N}_]$'), p, NULL)), p -> p IS NOT NULL)""")
    rows = joined.select(session, seq, "label", "value", F.explode(places).alias("p"))
    return rows.select(session, seq, "label", "value", (F.col("p") - 1).alias("start"), (F.col("p") - 1 + F.length("value")).alias("end"), F.lit(1.0).alias("score"))


def wrap(text: Column, hint: str, task: Column | None = None) -> Column:
    """A hint, a trimmed task if there is one, and the body, with blank lines between."""
    given = F.trim(task) if task is not None else F.lit(None).cast("string")
    return F.concat_ws("\n\n", F.lit(hint), F.when(given != "", given), text)
