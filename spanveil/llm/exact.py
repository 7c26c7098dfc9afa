"""Exact deduplication through cuckoo-filter indexes of SHA-256 digests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text
from .cuckoo import CuckooIndex

#: Live digests that a map task holds before it passes them on; they meet again after the shuffle.
FLUSH_AT = 400_000
#: Rows that one partition's index holds, about: the number of partitions follows the rows.
INDEX_ROWS = 1_000_000


def _indexed(flush_at: int | None):
    """Merge rows (digest, content, keep_id, n, gone) in a cuckoo index: a verified hit widens the stored entry, a miss is inserted.

    ``content`` is what the bucket tells the text itself by, its length and a digest of another kind; a hit on a
    digest whose content differs is an error, for then SHA-256 is broken. ``n`` counts documents, ``gone`` those that were withdrawn. The last index of a digest, which nothing flushes,
    deletes digests of which all documents are gone: they are live no more.
    """

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = CuckooIndex()

        def rows() -> pd.DataFrame:
            found = list(index.items())
            return pd.DataFrame({
                "digest": pd.Series([k for k, _ in found], dtype=object),
                "keep_id": pd.Series([v[0] for _, v in found], dtype=object),
                "n": pd.Series([v[1] for _, v in found], dtype="int64"),
                "gone": pd.Series([v[2] for _, v in found], dtype="int64"),
                "content": pd.Series([v[3] for _, v in found], dtype=object),
            })

        for batch in batches:
            cells = (batch["digest"].map(bytes), batch["keep_id"].astype(object), batch["n"].tolist(), batch["gone"].tolist(), batch["content"].map(bytes))
            for digest, doc, n, gone, content in zip(*cells):
                doc = None if pd.isna(doc) else doc
                at = index.find(digest)
                if at < 0:
                    index.insert(digest, (doc, n, gone, content))
                    continue
                held, count, left, known = index.values[at]
                if known != content:
                    raise ValueError("different texts share a SHA-256 digest")
                index.values[at] = (doc if held is None or (doc is not None and doc > held) else held, count + n, left + gone, known)
            if flush_at and len(index) >= flush_at:
                yield rows()
                index = CuckooIndex()
        if not flush_at:
            for digest, (_, n, gone, _) in list(index.items()):
                if gone == n:
                    index.delete(digest)
        if len(index):
            yield rows()

    return merge


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", withdrawn: DataFrame | None = None) -> DataFrame:
    """One row per distinct live text: ``digest`` (SHA-256), ``keep_id`` (largest id) and ``n`` (rows).

    Every task first merges its own rows in a cuckoo index, so a text that a third of all rows share reaches the
    shuffle once per task; the digests are then dealt by hash, over partitions whose number follows the rows, and
    merged in one index per partition. A hit is verified by the stored key and by what the bucket holds of the content.
    """
    base = id_and_text(docs, id_col, text_col)
    kind = base.schema["doc_id"].dataType
    shape = T.StructType([
        T.StructField("digest", T.BinaryType()), T.StructField("keep_id", kind), T.StructField("n", T.LongType()), T.StructField("gone", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ])
    gone = F.lit(False)
    if withdrawn is not None:
        ids = withdrawn.toDF("withdrawn").where("withdrawn IS NOT NULL").distinct()
        base = base.join(ids.hint("merge"), F.col("doc_id") == F.col("withdrawn"), "left")
        gone = F.col("withdrawn").isNotNull()
    digests = base.select(
        F.unhex(F.sha2("text", 256)).alias("digest"), F.when(~gone, F.col("doc_id")).alias("keep_id"), F.lit(1).cast("long").alias("n"), gone.cast("long").alias("gone"),
        F.concat(F.unhex(F.md5("text")), F.octet_length("text").cast("string").cast("binary")).alias("content"),
    )
    local = digests.mapInPandas(_indexed(FLUSH_AT), shape)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), base.count() // INDEX_ROWS + 1)
    groups = local.repartition(parts, "digest").mapInPandas(_indexed(None), shape)
    return groups.select("digest", "keep_id", (F.col("n") - F.col("gone")).alias("n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", withdrawn: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty. Of equal texts the row with the largest id stays.
    A null id is smaller than any other; if all ids of a group are null, keep_id is null and every row is kept.
    Rows that repeat both id and text are the same document: each counts in group_size, each has the same ``kept``.
    An empty table gives no rows; other columns are ignored, whatever their names. Documents whose id is in
    ``withdrawn`` (one column) leave the index: they have no rows, aren't counted, and another of their group stays.
    """
    base = id_and_text(docs, id_col, text_col)
    if withdrawn is not None:
        ids = withdrawn.toDF("withdrawn").where("withdrawn IS NOT NULL").distinct()
        base = base.join(ids.hint("merge"), F.col("doc_id") == F.col("withdrawn"), "left_anti")
    rows = base.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    groups = duplicate_groups(docs, id_col, text_col, withdrawn)
    # A plain equi-join on both sides' own exchanges: adaptive execution splits the partition of a hot digest.
    return rows.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, by the rules of ``exact_dedup``.

    Rows that repeat both id and text stay together; where all ids of a group are null, all its rows stay.
    """
    repeated = duplicate_groups(docs, id_col, text_col).where("n > 1").select(F.struct("digest", "keep_id").alias("g"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    digest = F.unhex(F.sha2(F.coalesce(F.col("d")[text_col], F.lit("")), 256))
    joined = packed.join(repeated, digest == F.col("g")["digest"], "left")
    return joined.where(F.col("g").isNull() | F.col("d")[id_col].eqNullSafe(F.col("g")["keep_id"])).select("d.*")
