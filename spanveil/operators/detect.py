"""Span generation by the recognizer pack, with Column expressions only."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import validators
from ..functions.dialect import ahead, java, needs_digit, quick
from ..functions.text import remap
from .pack import PACK, Recognizer

#: What a span that passed its check scores, and at which confidence a recognizer no longer defers to the model.
VALIDATED_SCORE, OVERRIDES_AT = 0.99998, 0.9
#: The recognizer whose matches are walked from a mark over the lines of a key.
PARTIAL = "core:pem-private-key-partial"


#: Set around each match by one pass over the text. A noncharacter, which no text should hold.
MARK = "\uFDD0"
#: Stands for a mark that a text holds itself: outside every class of characters that the mark is outside of.
STAND_IN = "\uFDD1"
#: Lengths are summed by blocks, so that a text with very many matches isn't summed anew from its beginning for each.
BLOCK = 256


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: an expression that a lambda names is evaluated wherever it stands.

    By index, since F.get is rewritten to a test of the size and the item, which computes the array twice.
    """
    return F.transform(F.array(value), use)[0]


def _placed(parts: Column) -> Column:
    """Matches with their places from the text cut at them: gap, match, gap, ..., match, gap."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def by_lengths(lengths: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(lengths, b * BLOCK + 1, BLOCK)))

        def by_sums(sums: Column) -> Column:
            def by_starts(starts: Column) -> Column:
                def at(k: Column) -> Column:
                    i = 2 * k + 1
                    block = F.floor(i / BLOCK).cast("int")
                    start = starts[block] + total(F.slice(lengths, block * BLOCK + 1, i % BLOCK))
                    return F.struct(start.alias("start"), (start + lengths[i]).alias("end"), parts[i].alias("value"))

                return F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / 2).cast("int") - 1), at)

            return _let(F.transform(sums, lambda _, b: total(F.slice(sums, 1, b))), by_starts)

        return _let(sums, by_sums)

    return _let(F.transform(parts, F.length), by_lengths)


def _marked(text: Column, pattern: str) -> Column:
    """The text with marks around the pattern's matches: one pass, and only a match leaves a mark."""
    return F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}"))


def matches(text: Column, pattern: str) -> Column:
    """All matches of a Java pattern as array<struct<start, end, value>> in code points. No match may be empty."""
    found = _let(_marked(F.translate(text, MARK, STAND_IN), pattern), lambda m: F.when(m.contains(MARK), _let(F.split(m, MARK, -1), _placed)))
    whole = F.transform(found, lambda m: m.withField("value", F.substring(text, m["start"] + 1, m["end"] - m["start"])))
    return F.coalesce(F.when(text.contains(MARK), whole).otherwise(found), F.array().cast("array<struct<start:int,end:int,value:string>>"))


def gate(text: Column, low: Column, recognizer: Recognizer, digit: Column | None = None) -> Column:
    """A cheap test that every text with a match passes. ``digit``: whether the text holds one, if that is known."""
    digit = text.rlike("[0-9]") if digit is None else digit
    where = low if recognizer.ignore_case and recognizer.id != "core:clojars" else text
    parts = [where.contains(g.lower() if where is low else g) for g in recognizer.gate]
    passed = parts[0] if parts else digit
    for part in parts[1:]:
        passed = passed | part
    if parts and (needs_digit(recognizer.pattern) or all(re.search("[0-9]", g) for g in recognizer.gate)):
        passed = digit & passed
    # Looking back for a context from each place costs far more than looking for the context and what follows it.
    forward = ahead(recognizer.pattern)
    return passed & text.rlike(java(quick(forward), recognizer.ignore_case)) if forward else passed


#: What spans of a changed text have besides: their places and their value in the text as it was.
BEFORE = ("before_start", "before_end", "before_value")


def _before(start: Column, end: Column) -> list[Column]:
    """``BEFORE`` by the columns ``origin`` and ``before`` of a changed text."""
    a, b = (remap(x, F.col("origin")).cast("int") for x in (start, end))
    return [c.alias(n) for c, n in zip((a, b, F.substring(F.col("before"), a + 1, b - a)), BEFORE)]


def raw_spans(docs: DataFrame, recognizers: Iterable[Recognizer] = PACK, id_col: str = "doc_id", text_col: str = "text", changed: bool = False) -> DataFrame:
    """(doc_id, recognizer, label, confidence, start, end, value): every match, before checks and filters.

    The pack is one projection and two generators over the scan: no shuffle, and only gated patterns run. The first
    generator gives the text marked by each pattern, the second the places; so a pattern adds little to the plan.
    Of ``changed`` texts, which have the columns ``origin`` and ``before``, spans have ``BEFORE`` too: computed with the
    places, so that neither column is joined or copied for each span.
    """
    kept, more = (("origin", "before"), BEFORE) if changed else ((), ())
    recognizers = list(recognizers)
    text, low = F.col("text"), F.col("low")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *kept).where("text IS NOT NULL")
    own = text.contains(MARK)
    base = base.withColumns({"low": F.lower("text"), "clean": F.when(own, F.translate(text, MARK, STAND_IN)).otherwise(text), "own": F.when(own, text), "digit": text.rlike("[0-9]")})
    found = []
    for k, r in enumerate(recognizers):
        # No struct is null: a filter on the label is pushed to the rows that no gate passed and reads their k too.
        pattern = r.java or java(quick(r.pattern), r.ignore_case)
        found.append(F.struct(F.lit(k).alias("k"), F.when(gate(text, low, r, F.col("digit")), _marked(F.col("clean"), pattern)).alias("marked")))
    # Only what holds a match leaves the array: a row for each of the pack's patterns would copy the text as often. An outer
    # generator, since from another one the optimizer makes a filter that computes the array a second time.
    hits = F.filter(F.array(*found), lambda m: F.coalesce(m["marked"].contains(MARK), F.lit(False)))
    cuts = base.select("doc_id", "own", *kept, F.explode_outer(hits).alias("m")).where(F.col("m.marked").contains(MARK))
    cuts = cuts.select("doc_id", "own", *kept, "m.k", F.split("m.marked", MARK, -1).alias("parts"))
    kinds = F.array(*[F.struct(F.lit(r.id).alias("recognizer"), F.lit(r.label).alias("label"), F.lit(r.confidence).alias("confidence")) for r in recognizers])
    places = _placed(F.col("parts"))
    if changed:
        places = F.transform(places, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), *_before(m["start"], m["end"])))
    # A filter on the label is pushed to the outer generator's empty rows, which have no k, and reads it there.
    placed = cuts.select("doc_id", "own", kinds[F.greatest(F.col("k"), F.lit(0))].alias("kind"), F.explode(places).alias("m"))
    value = F.when(F.col("own").isNull(), F.col("m.value")).otherwise(F.substring("own", F.col("m.start") + 1, F.col("m.end") - F.col("m.start")))
    return placed.select("doc_id", "kind.*", "m.start", "m.end", value.alias("value"), *[f"m.{x}" for x in more])


def checked(spans: DataFrame, recognizers: Iterable[Recognizer] = PACK) -> DataFrame:
    """Spans whose value passes its recognizer's check, with the score: fixed where there is a check, else the confidence."""
    names = {r.id: r.validate for r in recognizers if r.validate}
    passed = F.lit(True)
    for name, check in validators.CHECKS.items():
        ids = [i for i, v in names.items() if v == name]
        if ids:
            passed = F.when(F.col("recognizer").isin(ids), check(F.col("value"))).otherwise(passed)
    coins = [i for i, v in names.items() if v == "base58"]
    score = F.when(F.col("recognizer").isin(list(names)), F.lit(VALIDATED_SCORE)).otherwise(F.col("confidence")) if names else F.col("confidence")
    kept = spans.where(passed)
    if coins:
        # One branch, so that nothing is matched twice; only coins' values are anything but null in Python.
        coin = F.col("recognizer").isin(coins)
        kept = kept.withColumn("_coin", validators.base58(F.when(coin, F.col("value")))).where(~coin | F.col("_coin")).drop("_coin")
    return kept.withColumn("score", score)


# Shapes that are never personal, by label.
NEVER_PII: dict[str, str] = {
    "fictional_phone": r"^\+?1?[\s\-.()]*[2-9]\d{2}[\s\-.()]*555[\s\-.]*0[01]\d{2}$",
    "private_ipv4": r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.)",
    "loopback_ipv4": r"^127\.",
    "link_local_ipv4": r"^169\.254\.",
    "multicast_ipv4": r"^(?:22[4-9]|23\d)\.",
    "documentation_ipv4": r"^(?:192\.0\.2\.|198\.51\.100\.|203\.0\.113\.)",
    "unspecified_ipv4": r"^0\.0\.0\.0$",
    "documentation_ipv6": r"(?i)^2001:0?db8:",
    "loopback_ipv6": r"^(?:::1|0{1,4}(?::0{1,4}){0,6}:0{0,3}1)$",
    "link_local_ipv6": r"(?i)^fe[89ab][0-9a-f]?:",
    "zero_mac": r"^(?:[0:]{17}|(?:00[:-]){5}00)$",
    "reserved_domain": r"(?i)(?:^|[@.])(?:example\.(?:com|net|org)|test|invalid|localhost|local)$",
}


def never_rule(label: Column, value: Column) -> Column:
    """The first rule by which a value is never personal, or null."""
    of = {
        "private_phone": ["fictional_phone"],
        "private_ip": [r for r in NEVER_PII if r.endswith(("ipv4", "ipv6"))],
        "private_mac": ["zero_mac"],
        "private_url": ["reserved_domain"],
        "private_email": ["reserved_domain"],
    }
    rule = F.lit(None).cast("string")
    for name, names in of.items():
        for r in reversed(names):
            rule = F.when((label == name) & value.rlike(java(NEVER_PII[r])), F.lit(r)).otherwise(rule)
    return rule


def detect(docs: DataFrame, recognizers: Iterable[Recognizer] = PACK, model_spans: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", changed: bool = False) -> DataFrame:
    """(doc_id, recognizer, label, score, start, end, value): matches that pass their checks and aren't never-personal.

    With ``model_spans`` (doc_id, start, end), recognizers below the overriding confidence defer to a model span
    that covers their whole match. Spans of ``changed`` texts have ``BEFORE`` as well.
    """
    kept, more = (("origin", "before"), BEFORE) if changed else ((), ())
    recognizers = list(recognizers)
    marks = [r for r in recognizers if r.id == PARTIAL]
    spans = checked(raw_spans(docs, [r for r in recognizers if r.id != PARTIAL], id_col, text_col, changed), recognizers)
    if marks:
        from .encoded import partial_keys

        # A mark alone says nothing; with the key's lines on its open side it is a key.
        texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *kept)
        keys = partial_keys(texts, "text", *kept).select(
            "doc_id", F.lit(PARTIAL).alias("recognizer"), F.lit(marks[0].label).alias("label"), F.lit(marks[0].confidence).alias("confidence"),
            "start", "end", F.expr("substring(text, start + 1, end - start)").alias("value"), F.lit(marks[0].confidence).alias("score"),
            *(_before(F.col("start"), F.col("end")) if changed else ()),
        )
        spans = spans.unionByName(keys)
    spans = spans.where(never_rule(F.col("label"), F.col("value")).isNull())
    if model_spans is not None:
        m = model_spans.select(F.col("doc_id").alias("m_id"), F.col("start").alias("m_start"), F.col("end").alias("m_end"))
        covered = (F.col("doc_id") == F.col("m_id")) & (F.col("m_start") <= F.col("start")) & (F.col("m_end") >= F.col("end")) & (F.col("confidence") < OVERRIDES_AT)
        spans = spans.join(m, covered, "left_anti")
    return spans.select("doc_id", "recognizer", "label", "score", "start", "end", "value", *more)
