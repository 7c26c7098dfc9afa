"""Line deduplication over levelled sorted runs of line hashes. DataFrame functions only."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, id_and_text, shared_dir, written

#: What is stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_DOCS = 40, 5
BATCHES, FANOUT = 4, 2


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column, min_chars: int = MIN_CHARS) -> Column:
    """The 16-byte hash of a normalised line; null for a line that is too short to count."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.char_length(bare) >= min_chars, F.unhex(F.md5(F.translate(bare, UPPER, LOWER))))


@contextmanager
def _unions_dealt_anew(spark: SparkSession) -> Iterator[None]:
    """Spark 4.1 takes a union of bucketed columnar scans to be still dealt by the bucket key, though it only appends
    their partitions, and so leaves out the shuffle that merging runs needs. Off while a run is written, then as before."""
    name = "spark.sql.unionOutputPartitioning"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@dataclass
class LineRuns:
    """Immutable runs of line keys, each bucketed by key and sorted within its buckets.

    ``levels`` hold runs of (key, n, top): each key lies in one run alone, that of the batch which brought it first, for
    a batch adds only what a merge-anti-join with the runs leaves. What a batch says about keys that a run holds goes to
    ``changes``. ``n`` counts documents, ``top`` is the largest id. Level 0 takes the batches; ``fanout`` runs of a level
    are compacted into one of the next, and so are changes. Runs lie in the shared folder, so a lost executor costs no
    more than a reread. Since they share their bucketing, a batch is joined with a run without moving the run.
    """

    spark: SparkSession
    fanout: int = FANOUT
    levels: list[list[str]] = field(default_factory=list)
    changes: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        with _unions_dealt_anew(self.spark):
            (
                rows.repartition(self.buckets, "key")
                .write.bucketBy(self.buckets, "key")
                .sortBy("key")
                .option("path", f"{shared_dir(self.spark)}/{name}")
                .saveAsTable(name)
            )
        return name

    def _discard(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard(self.spark, f"{shared_dir(self.spark)}/{name}")

    def _union(self, names: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.table(name) for name in names])

    def _names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch whose key no run holds: a merge-anti-join with each run in turn."""
        for name in self._names():
            batch = batch.join(self.spark.table(name).select("key").hint("merge"), "key", "left_anti")
        return batch

    def add(self, postings: DataFrame) -> None:
        """Take in a batch of (key, doc_id). No document may come in two batches: it would count twice."""
        batch = self._write(postings.groupBy("key").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("top")))
        if not self.levels:
            self.levels = [[batch]]
            return
        new = self._write(self.unseen(self.spark.table(batch)))
        self.changes.append(self._write(self.spark.table(batch).join(self.spark.table(new).select("key").hint("merge"), "key", "left_anti")))
        self._discard([batch])
        self.levels[0].append(new)
        self.compact()

    def compact(self) -> None:
        """Put the runs of each full level into one of the next, and full changes into one. Keys of runs differ, so nothing is summed there."""
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                old = self.levels[level]
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level], fresh = [], self._write(self._union(old))
                self.levels[level + 1].append(fresh)
                self._discard(old)
        if len(self.changes) > self.fanout:
            old = self.changes
            self.changes = [self._write(self._union(old).groupBy("key").agg(F.sum("n").alias("n"), F.max("top").alias("top")))]
            self._discard(old)

    def totals(self) -> DataFrame:
        """(key, n, top) over all batches, in a table of the shared folder: what the runs hold, moved on by the changes."""
        rows = self._union(self._names())
        with _unions_dealt_anew(self.spark):
            if self.changes:
                more = self._union(self.changes).groupBy("key").agg(F.sum("n").alias("more"), F.max("top").alias("later"))
                rows = rows.join(more, "key", "left").select("key", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("top", "later").alias("top"))
            return written(rows, "line-totals")

    def close(self) -> None:
        """Remove the runs; what ``totals`` gave stays."""
        self._discard(self._names() + self.changes)
        self.levels, self.changes = [], []


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept (text).

    A null or empty text is one empty line. A key of at least ``min_chars`` code points found in at least
    ``min_docs`` documents loses its lines except in the document with the largest id. Rows that repeat an id are
    one document in these counts and each get a result. A null id is no document: it isn't counted and never the
    one that keeps. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    # A row is found again by its id and text; rows that repeat both lose the same lines.
    base = id_and_text(docs, id_col, text_col).withColumn("row", F.unhex(F.md5("text")))
    keys = F.transform(lines_of(F.col("text")), lambda x: line_key(x, min_chars))
    postings = base.select("doc_id", "row", F.posexplode(keys).alias("at", "key")).where(F.col("key").isNotNull())
    postings = written(postings.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))), "line-postings")
    index = LineRuns(spark)
    for k in range(batches):
        index.add(postings.where(F.col("batch") == k))
    # Out of the buckets, so that the join deals both sides itself and adaptive execution can split a hot key.
    drop = index.totals().where(F.col("n") >= min_docs).select("key", "top")
    index.close()
    # Per row, the places of lines it loses: no more than it has lines.
    lost = (
        postings.join(drop, "key")
        .where(~F.col("doc_id").eqNullSafe(F.col("top")))
        .groupBy(F.col("doc_id").alias("lost_id"), F.col("row").alias("lost_row"))
        .agg(F.collect_set("at").alias("lost"))
    )
    lines = lines_of(F.col("text"))
    joined = base.join(lost, F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("row") == F.col("lost_row")), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "lost")
    return joined.select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("lost").cast("long"), F.lit(0).cast("long")).alias("n_dropped"),
        F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda k: F.get(lines, k)), "\n")).alias("kept"),
    )
