"""Removal of passages that repeat across a corpus, by hashing its units: lines, paragraphs, or anchored pieces of them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_and_text, written

#: What makes a unit, besides "anchored": a passage inside a longer line shares pieces of it, never the line.
UNITS = {"line": r"[^\n]+", "paragraph": r"[^\n]+(?:\n[^\n]+)*"}
#: Words that a run of neighbouring repeats must have to be removed.
MIN_WORDS = 30
#: Places on either side that an anchored cut is the first of, so that pieces have more words than that.
REACH = 4
#: Words that a Python worker keeps hashes of.
WORDS_KEPT = 1_000_000
_SPACE = np.array([chr(c).isspace() for c in range(0x3001)])
_ENDS = np.array([ord(c) for c in ".!?"], np.uint32)
#: Odd multipliers of the two polynomial hashes of a sequence of words, and what tells their word hashes apart.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SALT = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(max(n, 1), np.uint64(base % 2**64))
    out[0] = 1
    return np.multiply.accumulate(out)


def _anchors(hashes: np.ndarray, closed: np.ndarray, reach: int) -> np.ndarray:
    """Words before which a cut lies: places that come first among the ``reach`` places on either side.

    Places after a sentence or line come before others, then hashes of the two words beside a place decide. So long
    sentences are cut inside, at the same words wherever these stand, and a passage need not begin or end with one.
    """
    n = len(hashes)
    mixed = _mix(hashes[:-1] * np.uint64(_BASES[0]) + hashes[1:])
    rank = (mixed >> np.uint64(1)) | np.where(closed, np.uint64(0), np.uint64(1 << 63))
    held = np.full(n - 1 + 2 * reach, 2**64 - 1, np.uint64)
    held[reach : reach + n - 1] = rank
    held[[reach - 1, reach + n - 1]] = np.uint64(1 << 63)  # the text's own ends come before places inside sentences
    cut = np.ones(n - 1, bool)
    for k in range(1, reach + 1):
        cut &= (rank < held[reach - k : reach - k + n - 1]) & (rank <= held[reach + k : reach + k + n - 1])
    return np.flatnonzero(cut) + 1


def splitter(unit: str, reach: int = REACH) -> Callable[[str], tuple[np.ndarray, ...]]:
    """From a text to its units in order: two digests each, start and end in code points, and words.

    A unit's digests are those of its lower-cased words, so runs of white space don't matter. The space that stands
    before it in its line belongs to it.
    """
    hashes = _WordHash()
    pattern = re.compile(UNITS[unit]) if unit != "anchored" else None
    powers: list[tuple[np.ndarray, np.ndarray]] = [(_powers(b, 1), _powers(pow(b, -1, 2**64), 1)) for b in _BASES]

    def split(text: str) -> tuple[np.ndarray, ...]:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.concatenate([[False], ~_SPACE[np.minimum(points, 0x3000)] | (points > 0x3000), [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        n = len(starts)
        if not n:
            return tuple(np.empty(0, np.int64) for _ in range(5))
        words = np.fromiter(map(hashes.__getitem__, text.lower().split()), np.uint64, n)
        breaks = np.flatnonzero(points == 10)
        if pattern is not None:
            at = np.searchsorted(starts, [m.start() for m in pattern.finditer(text)])
            at = np.unique(at[at < n])
            at = at if len(at) and at[0] == 0 else np.concatenate([[0], at])
        elif n > 1:
            line = np.searchsorted(breaks, starts)
            closed = np.isin(points[ends[:-1] - 1], _ENDS) | (line[1:] > line[:-1])
            at = np.concatenate([[0], _anchors(words, closed, reach)])
        else:
            at = np.zeros(1, np.int64)
        upto = np.append(at[1:], n)
        digests = []
        for k, held in enumerate((_mix(words), _mix(words ^ _SALT))):
            if len(powers[k][0]) < n:
                powers[k] = (_powers(_BASES[k], 2 * n), _powers(pow(_BASES[k], -1, 2**64), 2 * n))
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(held * powers[k][0][:n], out=total[1:])
            # The words' polynomial from the unit's first word on: a difference of prefixes, shifted back to power 0.
            whole = (total[upto] - total[at]) * powers[k][1][at]
            digests.append(_mix(whole ^ (upto - at).astype(np.uint64)).view(np.int64))
        before = np.concatenate([[0], ends])[at]
        row = np.concatenate([[0], breaks + 1])[np.searchsorted(breaks, starts[at])]
        return (*digests, np.maximum(before, row), ends[upto - 1], upto - at)

    return split


def _split(unit: str, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(unit, reach)
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())

        def batch_of(batch: pa.RecordBatch, rows: list[int], found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            sizes = [len(x[0]) for x in found]
            back = pa.array(np.repeat(np.array(rows, np.int64), sizes))
            place = np.concatenate([np.arange(n) for n in sizes])
            cells = [pa.array(np.concatenate(x), t, safe=False) for x, t in zip(zip(*found), types)]
            names = ["doc_id", "row_hash", "unit", "digest", "check", "start", "end", "words"]
            return pa.RecordBatch.from_arrays([batch.column(0).take(back), batch.column(1).take(back), pa.array(place, pa.int32(), safe=False), *cells], names)

        for batch in batches:
            rows, found, held = [], [], 0
            for row, text in enumerate(batch.column(2)):
                rows.append(row)
                found.append(split(text.as_py()))
                held += len(found[-1][0])
                if held > 200_000:
                    yield batch_of(batch, rows, found)
                    rows, found, held = [], [], 0
            if held:
                yield batch_of(batch, rows, found)

    return run


def units(docs: DataFrame, unit: str = "anchored", reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_hash, unit, digest, check, start, end, words): the units of each text with their code-point offsets.

    ``row_hash`` tells rows apart that share an id.
    """
    base = id_and_text(docs, id_col, text_col).select("doc_id", F.hash("text").alias("row_hash"), "text")
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(_split(unit, reach), f"doc_id {kind}, row_hash int, unit int, digest bigint, check bigint, start int, end int, words int")


def repeated_passages(
    docs: DataFrame, unit: str = "anchored", min_words: int = MIN_WORDS, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Passages to remove: doc_id, start, end (code points), n_units, n_words, keep_id (least id that keeps a unit of it).

    Of each unit's places the earliest stays, by id, then by place in the text; every other is a repeat. Repeats
    that follow one another in a document are one passage, and one of at least ``min_words`` words is given with its
    original offsets; with ``min_words`` = 1 every repeated unit is. Units are told apart by 128 bits. A null or blank
    text has no units; a null id ranks before all others. Rows that repeat id and text are one document. An empty table
    gives no rows; other columns are ignored.
    """
    found = written(units(docs, unit, reach, id_col, text_col), "units")
    place = F.struct("doc_id", "row_hash", "unit")
    first = written(
        found.groupBy("digest", "check").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "check", "first"),
        "first-places",
    )
    # Both sides come from tables, so that the join deals them itself: adaptive execution then splits the partition
    # of a digest that a third of all documents hold.
    repeats = found.join(first, ["digest", "check"]).where(place > F.col("first")).select("doc_id", "row_hash", "unit", "start", "end", "words", F.col("first.doc_id").alias("keep_id"))
    by_doc = W.partitionBy("doc_id", "row_hash").orderBy("unit")
    runs = repeats.distinct().withColumn("run", F.col("unit") - F.row_number().over(by_doc))
    return (
        runs.groupBy("doc_id", "row_hash", "run")
        .agg(
            F.min("start").cast("long").alias("start"),
            F.max("end").cast("long").alias("end"),
            F.count("*").alias("n_units"),
            F.sum("words").alias("n_words"),
            F.min("keep_id").alias("keep_id"),
        )
        .where(F.col("n_words") >= min_words)
        .select("doc_id", "start", "end", "n_units", "n_words", "keep_id")
    )


def remove_repeats(docs: DataFrame, unit: str = "anchored", min_words: int = MIN_WORDS, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated passages cut from the text; rows without any are unchanged, other columns too.

    A row is found again by its id and text, so rows that repeat both lose the same passages. A null id is looked up
    like any other; a text that is a repeat as a whole becomes empty.
    """
    gone = repeated_passages(docs.select(F.struct(F.col(f"`{id_col}`").alias("id"), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("md5")).alias("row"), F.col(f"`{text_col}`").alias("text")), unit, min_words, reach, "row", "text")
    spans = gone.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")).select(F.col("doc_id.id").alias("gone_id"), F.col("doc_id.md5").alias("gone_md5"), "spans")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    text = F.coalesce(F.col("d")[text_col], F.lit(""))
    joined = packed.join(spans, F.col("d")[id_col].eqNullSafe(F.col("gone_id")) & (F.md5(text) == F.col("gone_md5")), "left")
    left = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("upto")),
        lambda done, s: F.struct(
            F.concat(done["kept"], F.substring(text, (done["upto"] + 1).cast("int"), (s["start"] - done["upto"]).cast("int"))).alias("kept"), s["end"].alias("upto")
        ),
        lambda done: F.concat(done["kept"], F.substring(text, (done["upto"] + 1).cast("int"), F.length(text))),
    )
    return joined.select(*[F.coalesce(left, F.col("d")[c]).alias(c) if c == text_col else F.col("d")[c].alias(c) for c in docs.columns])
