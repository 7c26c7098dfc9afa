"""Packing documents into training sequences by non-negative least squares over the length histogram."""

from __future__ import annotations

import base64
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_and_text, written
from .nnls import plan

WINDOW = 2048
END_ID = 1
#: Tokens per size class of the histogram: classes round up, so a sequence of k pieces wastes under k * UNIT tokens by it.
UNIT = 4
#: Pieces of one size class are ranked in this many groups at least, and in groups of about this many rows.
GROUPS, GROUP_ROWS = 256, 100_000

#: Splits text as the vocabulary's own pattern does, with possessive repeats.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
SPECIAL = {"<|endoftext|>": 50256}


def encoder(path: str):
    """The byte-level BPE of a ranks file; kept for later tasks of the same Python worker."""
    import tiktoken

    kept = sys.modules.setdefault("_spanveil_kept", types.ModuleType("_spanveil_kept"))
    if getattr(kept, "path", None) != path:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        kept.path, kept.encoder = path, tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return kept.encoder


def _cut(path: str, window: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            rows, start, length, crc, total = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = encode(text.as_py(), allowed_special="all")
                ids.append(end_id)
                data, n = memoryview(np.array(ids, "<u4").tobytes()), len(ids)
                for at in range(0, n, window):
                    size = min(window, n - at)
                    rows.append(row)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(data[4 * at : 4 * (at + size)]))
                    total.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return cut


def pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids cut into whole windows and a remainder."""
    base = id_and_text(docs, id_col, text_col)
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(_cut(vocabulary, window, end_id), f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def pack(cut: DataFrame, window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """Adds sequence_id and offset to pieces: no sequence holds more than ``window`` tokens, offsets have no gaps.

    Only the histogram of size classes comes to the driver, and only the patterns' rank ranges are broadcast; both
    are bounded by the window, whatever the number of pieces.
    """
    spark = cut.sparkSession
    sized = cut.withColumn("class", F.ceil(F.col("length") / unit).cast("int"))
    counts = sized.groupBy("class").count().collect()
    histogram = np.zeros(-(-window // unit) + 1, np.int64)
    for row in counts:
        histogram[row["class"]] = row["count"]
    groups = max(GROUPS, int(histogram.sum()) // GROUP_ROWS)
    taken, ranges, base = [0] * len(histogram), [], 0
    for sizes, n in plan(histogram):
        for slot, size in enumerate(sizes):
            ranges.append((size, taken[size], taken[size] + n, base, slot))
            taken[size] += n
        base += n
    table = spark.createDataFrame(ranges, "of int, low bigint, high bigint, base bigint, slot int")
    # Ranks within (class, group) and the group's first rank: no class is ever sorted in one task.
    salted = sized.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("int"))
    before = (
        salted.groupBy(F.col("class").alias("c"), F.col("group").alias("g")).count()
        .select("c", "g", (F.sum("count").over(W.partitionBy("c").orderBy("g")) - F.col("count")).alias("before"))
    )
    within = F.row_number().over(W.partitionBy("class", "group").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("within", within).join(before, (F.col("class") == F.col("c")) & (F.col("group") == F.col("g")))
    ranked = ranked.withColumn("rank", F.col("before") + F.col("within"))
    placed = ranked.join(F.broadcast(table), (F.col("class") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    placed = placed.withColumn("sequence_id", F.col("base") + F.col("rank") - F.col("low"))
    earlier = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    return placed.select(*cut.columns, "sequence_id", F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty and packs as its end id alone. Null ids and repeated rows are packed like any other row.
    An empty table gives no rows; other columns are ignored, whatever their names. Pieces are written to the shared
    folder once, so no text is tokenised twice.
    """
    return pack(written(pieces(docs, vocabulary, window, id_col=id_col, text_col=text_col), "pieces"), window)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")
