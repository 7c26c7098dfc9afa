"""Benchmark decontamination: FM-indexes of training shards are searched for every window of the test items."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text
from .fmindex import FMIndex

WINDOW = 10
#: Words of documents that one index covers (a longer document has an index of its own).
SHARD_WORDS = 400_000
#: Bytes of benchmark text broadcast as one block; a larger benchmark is searched block after block. Its windows take
#: some hundred bytes for each of its words, in the driver and in every Python worker that has the block in hand.
BLOCK_BYTES = 2 << 20
#: Shards that a task holds while blocks take turns.
SHARDS_HELD = 4

#: Lower-cases A-Z and turns every byte that can't be in a word into a space.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def windows_of(items: list[tuple[str, bytes]]) -> dict:
    """A block: word ids from 1, windows by length as rows of word ids, and the items of each window."""
    ids: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        coded = [ids.setdefault(w, len(ids) + 1) for w in words_of(text)]
        size = min(WINDOW, len(coded))
        for i in range(len(coded) - size + 1 if size else 0):
            found.setdefault(tuple(coded[i : i + size]), set()).add(item)
    by_length: dict[int, list[tuple[int, ...]]] = {}
    for window in found:
        by_length.setdefault(len(window), []).append(window)
    return {
        "ids": ids,
        "windows": {n: np.array(w, np.int64) for n, w in by_length.items()},
        "items": {n: [sorted(found[x]) for x in w] for n, w in by_length.items()},
    }


def search_shard(shard: list[list[bytes]], block: dict) -> tuple[list[np.ndarray], list[set[str]]]:
    """For each document of the shard its hit words (places, ascending) and the items that occur.

    Only runs of words that all occur in the block, and are no shorter than its shortest window, can hold a
    window; the index covers exactly these runs.
    """
    hits: list[np.ndarray] = [np.empty(0, np.int64)] * len(shard)
    items: list[set[str]] = [set() for _ in shard]
    if not block["windows"]:
        return hits, items
    shortest, get = min(block["windows"]), block["ids"].get
    parts, owner, place = [], [], []
    for doc, words in enumerate(shard):
        if len(words) < shortest:
            continue
        coded = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate([[0], coded > 0, [0]])))
        for start, end in zip(known[::2], known[1::2]):
            if end - start >= shortest:
                parts += [coded[start:end], np.zeros(1, np.int64)]
                owner.append(np.full(end - start + 1, doc))
                place.append(np.arange(start, end + 1))
    if not parts:
        return hits, items
    text, owner, place = np.concatenate(parts), np.concatenate(owner), np.concatenate(place)
    index = FMIndex(text, len(block["ids"]))
    cover = np.zeros(len(text) + 1, np.int64)
    for length, windows in block["windows"].items():
        low, high = index.search(windows)
        which = np.flatnonzero(high > low)
        if not len(which):
            continue
        size = (high - low)[which]
        rows = np.repeat(low[which] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        at = index.locate(rows)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + length, -1)
        pairs = np.unique(np.stack([owner[at], np.repeat(which, size)], 1), axis=0)
        for doc, window in pairs.tolist():
            items[doc].update(block["items"][length][window])
    covered = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    if len(covered):
        docs, starts = np.unique(owner[covered], return_index=True)
        for doc, places in zip(docs.tolist(), np.split(place[covered], starts[1:])):
            hits[doc] = places
    return hits, items


def merged(places: np.ndarray) -> list[tuple[int, int]]:
    """Runs of neighbouring word places as half-open ranges."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.concatenate([[0], cut + 1])].tolist(), (places[np.concatenate([cut, [-1]])] + 1).tolist()))


def _scan(blocks: list):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(first: int, shards: list[list[list[bytes]]], batch: pa.RecordBatch) -> pa.RecordBatch:
            hits = [[np.empty(0, np.int64)] * len(shard) for shard in shards]
            items: list[list[set[str]]] = [[set() for _ in shard] for shard in shards]
            for block in blocks:
                value = block.value
                for k, shard in enumerate(shards):
                    more, also = search_shard(shard, value)
                    for i in range(len(shard)):
                        if len(more[i]):
                            hits[k][i] = np.union1d(hits[k][i], more[i])
                            items[k][i] |= also[i]
                if len(blocks) > 1:
                    block._value = None  # one block at a time in memory
                    del block._value
            words, found = [w for shard in shards for w in shard], [h for held in hits for h in held]
            spans = []
            texts = batch.column(1).slice(first, len(words))
            for row, places in enumerate(found):
                at = [m.span() for m in WORD.finditer(texts[row].as_py())] if len(places) else []
                spans.append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in merged(places)])
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, len(words)),
                    texts,
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([len(h) for h in found], pa.int64()),
                    pa.array([sorted(i) for held in items for i in held], pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                ["doc", "text", "n_words", "n_hit", "items", "spans"],
            )

        for batch in batches:
            first, shards, held = 0, [[]], 0
            for row, text in enumerate(batch.column(1).cast(pa.binary())):
                words = words_of(text.as_py())
                shards[-1].append(words)
                held += len(words)
                if held >= SHARD_WORDS:
                    if len(shards) >= SHARDS_HELD or len(blocks) == 1:
                        yield finish(first, shards, batch)
                        first, shards = row + 1, []
                    shards.append([])
                    held = 0
            if first < len(batch):
                yield finish(first, shards, batch)

    return scan


def benchmark_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> list:
    """The benchmark's windows as broadcast blocks of checked size; the driver holds one block at a time.

    A null text has no words; a null id counts as the empty string; rows of one id are one item.
    """
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // block_bytes))
    context = benchmark.sparkSession.sparkContext
    made = []
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        made.append(context.broadcast(windows_of([(r["item"], bytes(r["text"])) for r in part.toLocalIterator()])))
    return made


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, text, n_words, n_hit, items (ids, sorted as strings), spans.

    ``spans`` are the merged ranges of hit words in code points, for removal. A null or empty text has no words.
    An empty benchmark hits nothing, an empty table gives no rows; an item of fewer words than a window is one
    window, an item without words none. Repeated rows each get their own result.
    """
    base = id_and_text(docs, id_col, text_col)
    kind = base.schema["doc_id"].dataType.simpleString()
    found = base.mapInArrow(
        _scan(benchmark_blocks(benchmark, block_bytes=block_bytes)),
        f"doc {kind}, text string, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>",
    )
    return found.withColumnRenamed("doc", "doc_id")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The decisions alone, with a digest of the items."""
    return decontaminate(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "spans",
    )


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with hit words and all between neighbouring ones cut from the text; clean rows are unchanged.

    A length column, where there is one, follows the text. A document of which nothing but space is left goes.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    found = decontaminate(packed.select("d", F.col("d")[text_col].alias("t")), benchmark, "d", "t")
    left = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("upto")),
        lambda done, s: F.struct(
            F.concat(done["kept"], F.substring(F.col("text"), (done["upto"] + 1).cast("int"), (s["start"] - done["upto"]).cast("int"))).alias("kept"),
            s["end"].alias("upto"),
        ),
        lambda done: F.concat(done["kept"], F.substring(F.col("text"), (done["upto"] + 1).cast("int"), F.length("text"))),
    )
    cleaned = found.withColumn("left", F.when(F.col("n_hit") > 0, left)).where(F.col("left").isNull() | (F.trim("left") != ""))
    columns = []
    for c in docs.columns:
        value = F.col("doc_id")[c]
        if c == text_col:
            value = F.coalesce(F.col("left"), value)
        elif c == length_col:
            value = F.coalesce(F.length("left").cast(docs.schema[c].dataType), value)
        columns.append(value.alias(c))
    return cleaned.select(*columns)
