"""Fixity audit of WARC replicas by Merkle trees over records and their offset ranges. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Records of an archive file, at most, for ids without gaps; and children of a tree node.
SHARD_RECORDS, FANOUT = 256, 16


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC response record: header, blank line, payload, two line ends. Nulls are empty."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def leaves(pages: DataFrame) -> DataFrame:
    """(page_id, shard, place, offset, length, sha256, hash): a file's records in order, each with its offset range.

    A leaf's hash covers where the record begins and ends as well as what it holds. Records of equal id are ordered
    by content; records without id lie in files dealt by content, so that no file grows with their number alone.
    """
    rec = record(F.col("page_id"), F.col("url"), F.col("html"))
    shard = F.coalesce(F.floor(F.col("page_id") / SHARD_RECORDS), -1 - F.pmod(F.xxhash64("url", "html"), F.lit(1 << 20)))
    rows = pages.select("page_id", shard.cast("long").alias("shard"), F.octet_length(rec).cast("long").alias("length"), F.sha2(rec, 256).alias("sha256"))
    order = W.partitionBy("shard").orderBy("page_id", "sha256")
    rows = rows.withColumn("place", (F.row_number().over(order) - 1).cast("long")).withColumn(
        "offset", F.sum("length").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("length")
    )
    span = F.concat_ws(":", "offset", F.col("offset") + F.col("length"), "sha256")
    return rows.withColumn("hash", F.sha2(F.concat(F.lit("leaf:"), span), 256))


def level_above(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Parents (keys, place, hash) of nodes: a parent hashes the ordered hashes of at most FANOUT children."""
    children = F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda c: c["hash"])
    return (
        nodes.groupBy(*keys, F.floor(F.col("place") / FANOUT).cast("long").alias("parent"))
        .agg(F.sha2(F.concat(F.lit("node:"), F.array_join(children, "")), 256).alias("hash"))
        .withColumnRenamed("parent", "place")
    )


def _depth(top: int) -> int:
    """Levels above places 0..top until one node is left; one at least."""
    depth = 1
    while top >= FANOUT:
        top, depth = top // FANOUT, depth + 1
    return depth


def tree(rows: DataFrame, in_file: int, over_files: int, base: int, label: str) -> list[DataFrame]:
    """A replica's nodes (shard, place, hash) by level: leaves, file levels up to file roots, then levels over files.

    Over files, nodes lie under shard 0 at the place of their file less ``base``. Every level is written to the
    shared folder, so that comparing reads what it needs and hashes nothing anew.
    """
    levels = [rows.select("shard", "place", "hash")]
    for _ in range(in_file):
        levels.append(written(level_above(levels[-1], ["shard"]), f"{label}-level"))
    nodes = levels[-1].select(F.lit(0).cast("long").alias("shard"), (F.col("shard") - base).alias("place"), "hash")
    for _ in range(over_files):
        nodes = written(level_above(nodes, ["shard"]), f"{label}-level")
        levels.append(nodes)
    return levels


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """(shard, place) of nodes that only one tree has or whose hashes differ."""
    two = b.select("shard", "place", F.col("hash").alias("hash_b"))
    return a.join(two, ["shard", "place"], "full").where(~F.col("hash").eqNullSafe(F.col("hash_b"))).select("shard", "place")


def _below(nodes: DataFrame, suspects: DataFrame) -> DataFrame:
    up = suspects.select(F.col("shard").alias("s"), F.col("place").alias("p"))
    return nodes.join(up, (F.col("shard") == F.col("s")) & (F.floor(F.col("place") / FANOUT) == F.col("p")), "left_semi")


def differing_leaves(one: list[DataFrame], two: list[DataFrame], in_file: int, base: int) -> DataFrame:
    """(shard, place) of leaves that differ: roots first, then only the children of nodes that differ."""
    suspects = written(_differ(one[-1], two[-1]), "fixity-differ")
    for level in range(len(one) - 2, -1, -1):
        if suspects.isEmpty():
            return suspects
        if level == in_file:  # from the levels over files to the files' roots
            a, b = (t[level].select(F.lit(0).cast("long").alias("shard"), (F.col("shard") - base).alias("place"), "hash") for t in (one, two))
            found = _differ(_below(a, suspects), _below(b, suspects))
            suspects = written(found.select((F.col("place") + base).alias("shard"), F.lit(0).cast("long").alias("place")), "fixity-differ")
        else:
            suspects = written(_differ(_below(one[level], suspects), _below(two[level], suspects)), "fixity-differ")
    return suspects


def audit(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """One row per record of either replica: page_id, shard, record_offset, record_length, record_sha256, status.

    ``status`` is ok, changed (other content at that place of the file), moved (same content, other offset), missing
    or extra (no record at that place in one replica). For a record that only the replica has, the columns are the
    replica's. Nulls in any column are empty; rows without an id lie in files dealt by content; repeated rows are
    records of their own; two empty tables give no rows. Other columns are ignored, whatever their names.
    """
    first, second = (written(leaves(t.select("page_id", "url", "html")), "fixity-leaves") for t in (pages, replica))
    shape = first.unionByName(second).agg(F.max("place"), F.min("shard"), F.max("shard")).first()
    top, base, last = (int(x or 0) for x in shape)
    in_file, over_files = _depth(top), _depth(last - base)
    one, two = (tree(t, in_file, over_files, base, "fixity") for t in (first, second))
    suspects = differing_leaves(one, two, in_file, base).withColumn("suspect", F.lit(True))
    mine = first.join(suspects, ["shard", "place"], "left").select("shard", "place", "page_id", "offset", "length", "sha256", "suspect")
    other = second.join(suspects, ["shard", "place"], "left_semi").select(
        F.col("shard").alias("s"), F.col("place").alias("p"), F.col("page_id").alias("page_b"),
        F.col("offset").alias("offset_b"), F.col("length").alias("length_b"), F.col("sha256").alias("sha_b"),
    )
    both = mine.join(other, (F.col("shard") == F.col("s")) & (F.col("place") == F.col("p")), "full")
    status = (
        F.when(F.col("sha256").isNull(), "extra")
        .when(F.col("suspect").isNull(), "ok")
        .when(F.col("sha_b").isNull(), "missing")
        .when(F.col("sha256") != F.col("sha_b"), "changed")
        .otherwise("moved")
    )
    return both.select(
        F.when(F.col("sha256").isNull(), F.col("page_b")).otherwise(F.col("page_id")).alias("page_id"),
        F.coalesce("shard", "s").alias("shard"),
        F.coalesce("offset", "offset_b").alias("record_offset"),
        F.coalesce("length", "length_b").alias("record_length"),
        F.coalesce("sha256", "sha_b").alias("record_sha256"),
        status.alias("status"),
    )


def damaged(pages: DataFrame, every: int) -> DataFrame:
    """A replica for drills: the first character of the page of each ``every``-th id is overwritten by '#'."""
    hit = (F.col("page_id") % every == every // 2) & (F.length("html") > 0)
    return pages.withColumn("html", F.when(hit, F.concat(F.lit("#"), F.expr("substr(html, 2)"))).otherwise(F.col("html")))
