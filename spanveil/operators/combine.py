"""Interval algebra over a spans relation (doc_id, label, start, end, score): half-open ranges of code points."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEDUPE_IOU, NMS_IOU = 0.5, 0.4
# What is trimmed from a span's ends, and what may lie between joined address parts.
TRIM = " \t\n\r,.;:!?\"'()[]{}<>"
ADDRESS_GAP = r"^[ \t,/\-–—]{1,3}$"


def iou(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    shared = F.greatest(F.least(end_a, end_b) - F.greatest(start_a, start_b), F.lit(0))
    return shared / ((end_a - start_a) + (end_b - start_b) - shared)


def drop_contained(spans: DataFrame) -> DataFrame:
    """Without spans strictly inside a larger one of the same document, whatever the labels; equal ones all stay."""
    before = W.partitionBy("doc_id").orderBy("start").rangeBetween(W.unboundedPreceding, -1)
    same = W.partitionBy("doc_id", "start")
    marked = spans.withColumn("_b", F.max("end").over(before)).withColumn("_s", F.max("end").over(same))
    return marked.where((F.coalesce(F.col("_b"), F.lit(-1)) < F.col("end")) & (F.col("_s") <= F.col("end"))).drop("_b", "_s")


def islands(spans: DataFrame, touching: bool = False, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``island``: spans of one island share characters in a chain (or also touch, if so asked)."""
    w = W.partitionBy(*keys).orderBy("start", F.col("end").desc())
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    apart = (F.col("start") > reach) if touching else (F.col("start") >= reach)
    fresh = spans.withColumn("_new", F.when(reach.isNull() | apart, 1).otherwise(0))
    return fresh.withColumn("island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def merge(spans: DataFrame) -> DataFrame:
    """Unions of spans that share a character; label and score of the highest score, the earlier (then longer) on ties."""
    best = F.max_by("label", F.struct("score", -F.col("start"), F.col("end"), F.col("label")))
    return (
        islands(spans.where("end > start")).groupBy("doc_id", "island")
        .agg(best.alias("label"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score")).drop("island")
    )


def covered(spans: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Disjoint, non-touching ranges that cover what the spans cover."""
    return islands(spans.where("end > start"), True, keys).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def shared_chars(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per key the characters that both covers have. Equi-join on the keys with an overlap condition."""
    two = b.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("start").alias("_start"), F.col("end").alias("_end"))
    on = (F.col("start") < F.col("_end")) & (F.col("_start") < F.col("end"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return a.join(two, on).groupBy(*keys).agg(F.sum(F.least("end", "_end") - F.greatest("start", "_start")).alias("chars"))


def refine(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Spans without punctuation and space at their ends (for secrets: without space); empty ones go."""
    joined = spans.join(texts.select("doc_id", "text"), "doc_id").withColumn("_v", F.expr("substring(text, start + 1, end - start)"))
    chars = F.when(F.col("label") == "secret", F.lit(" \t\n\r")).otherwise(F.lit(TRIM))
    left = F.length("_v") - F.length(F.ltrim("_v", chars))
    right = F.length("_v") - F.length(F.rtrim("_v", chars))
    return joined.withColumn("start", F.col("start") + left).withColumn("end", F.col("end") - right).where("end > start").select(*spans.columns)


def join_addresses(spans: DataFrame, texts: DataFrame, label: str = "private_address") -> DataFrame:
    """Neighbouring address spans with at most three separators between them become one; the score is the highest."""
    w = W.partitionBy("doc_id").orderBy("start", "end")
    # The windows see spans alone; a text stands beside them only while the gap is cut out of it.
    rows = spans.withColumn("_end", F.lag("end").over(w)).withColumn("_label", F.lag("label").over(w))
    near = (F.col("label") == label) & (F.col("_label") == label) & (F.col("start") >= F.col("_end"))
    gap = F.when(near, F.expr("substring(text, _end + 1, start - _end)")).rlike(ADDRESS_GAP)
    rows = rows.join(texts.select("doc_id", "text"), "doc_id").withColumn("_new", F.when(near & gap, 0).otherwise(1)).drop("text", "_end", "_label")
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", "_run").agg(F.first("label").alias("label"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score")).drop("_run")


def merge_adjacent(spans: DataFrame, gap: int = 1) -> DataFrame:
    """Spans of one label at most ``gap`` characters apart become one."""
    w = W.partitionBy("doc_id").orderBy("start", "end", "label")
    near = (F.lag("label").over(w) == F.col("label")) & (F.col("start") - F.lag("end").over(w) <= gap)
    rows = spans.withColumn("_new", F.when(near, 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", "_run").agg(F.first("label").alias("label"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score")).drop("_run")


def _overlap(a: tuple, b: tuple) -> float:
    shared = min(a[1], b[1]) - max(a[0], b[0])
    return shared / ((a[1] - a[0]) + (b[1] - b[0]) - shared) if shared > 0 else 0.0


def greedy(spans: Iterable[tuple], limit: float, across_labels: bool, grow: bool = True) -> list[tuple]:
    """(start, end, label, score): by score, place and label; a kept span that overlaps enough takes the next one in and grows."""
    kept: list[list] = []
    for start, end, label, score in sorted(spans, key=lambda s: (-s[3], s[0], s[1], s[2])):
        for k in kept:
            if (across_labels or k[2] == label) and _overlap((k[0], k[1]), (start, end)) >= limit:
                if grow:
                    k[0], k[1] = min(k[0], start), max(k[1], end)
                break
        else:
            kept.append([start, end, label, score])
    return [tuple(k) for k in kept]


def stitch(spans: Iterable[tuple], limit: float = DEDUPE_IOU) -> list[tuple]:
    """Of spans of one label that overlap enough the longest stays."""
    kept: list[tuple] = []
    for s in sorted(spans, key=lambda s: (s[0] - s[1], s[0], s[2])):
        if not any(k[2] == s[2] and _overlap(k, s) >= limit for k in kept):
            kept.append(s)
    return kept


def per_document(spans: DataFrame, fold) -> DataFrame:
    """Applies an order-dependent fold to each document's spans: they are gathered per document, never per corpus.

    The fold sees one document's spans at a time, in Arrow batches of documents.
    """

    kind = "array<struct<start:int,end:int,label:string,score:double>>"

    @F.pandas_udf(kind)
    def run(groups: pd.Series) -> pd.Series:
        return groups.map(lambda g: [dict(zip(("start", "end", "label", "score"), s)) for s in fold([(int(x["start"]), int(x["end"]), x["label"], float(x["score"])) for x in g])])

    gathered = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "label", "score")).alias("g"))
    return gathered.select("doc_id", F.explode(run("g")).alias("s")).select("doc_id", "s.label", "s.start", "s.end", "s.score")


def dedupe(spans: DataFrame, limit: float = DEDUPE_IOU, across_labels: bool = False) -> DataFrame:
    return per_document(drop_contained(spans) if across_labels else spans, lambda g: greedy(g, limit, across_labels))


def suppress(spans: DataFrame, limit: float = NMS_IOU) -> DataFrame:
    return per_document(spans, lambda g: greedy(g, limit, True))
