"""Cross-entropy difference: every document under a target and a background model of the same vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

#: Tokens are the bytes of UTF-8 and an end mark, so the vocabulary is complete for every text. Two start marks precede.
END, START, SYMBOLS = 0xFE, 0xFF, 255
#: Bytes of text that are turned into trigrams at a time.
CHUNK = 2 << 20


def _chunks(texts: Iterator[bytes]) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Trigram codes of some texts after one another, and how many each has (its bytes and the end mark)."""
    held, sizes, total = [], [], 0

    def codes() -> np.ndarray:
        symbols = np.frombuffer(b"".join(held), np.uint8).astype(np.uint32)
        found = (symbols[:-2] << 16) | (symbols[1:-1] << 8) | symbols[2:]
        return found[symbols[2:] != START]

    for text in texts:
        held.append(b"\xff\xff" + text + b"\xfe")
        sizes.append(len(text) + 1)
        total += len(text)
        if total >= CHUNK:
            yield codes(), sizes
            held, sizes, total = [], [], 0
    if held:
        yield codes(), sizes


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of a task's documents: of all, and of those of the target."""
    parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

    def merge(part: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        if not part:
            return []
        codes, back = np.unique(np.concatenate([c for c, _ in part]), return_inverse=True)
        return [(codes, np.bincount(back, np.concatenate([n for _, n in part])).astype(np.int64))]

    for batch in batches:
        flags = batch.column(1).to_pylist()
        texts = batch.column(0).cast(pa.binary())
        for which, wanted in enumerate((None, True)):
            chosen = (t.as_py() for t, flag in zip(texts, flags) if wanted is None or flag)
            for codes, _ in _chunks(chosen):
                parts[which].append(np.unique(codes, return_counts=True))
                if len(parts[which]) > 16:
                    parts[which] = merge(parts[which])
    everything, target = (merge(p) for p in parts)
    if everything:
        codes, background = everything[0]
        wanted = np.zeros(len(codes), np.int64)
        if target:
            wanted[np.searchsorted(codes, target[0][0])] = target[0][1]
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(background), pa.array(wanted)], ["code", "background", "target"])


def losses(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """-log2 of each trigram's last symbol given the first two: Witten-Bell down to add-one over the vocabulary."""
    counts = counts.astype(float)
    last, pair, history = codes & 0xFF, codes & 0xFFFF, codes >> 8
    middle = (codes >> 8) & 0xFF
    unigram = np.bincount(last, counts, 256)
    one = (unigram + 1) / (unigram.sum() + SYMBOLS)
    bigram = np.bincount(pair, counts, 1 << 16)
    seen = (bigram > 0).reshape(256, 256)
    total, kinds = bigram.reshape(256, 256).sum(1), seen.sum(1)
    two = np.where(total[middle] > 0, (bigram[pair] + kinds[middle] * one[last]) / np.maximum(total[middle] + kinds[middle], 1), one[last])
    total3, kinds3 = np.bincount(history, counts, 1 << 16), np.bincount(history, counts > 0, 1 << 16)
    known = total3[history] > 0
    three = np.where(known, (counts + kinds3[history] * two) / np.maximum(total3[history] + kinds3[history], 1), two)
    return -np.log2(three)


def _score(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, target, background = model.value
        at = np.zeros(1 << 24, np.int32)
        at[codes] = np.arange(len(codes))
        for batch in batches:
            sizes, sums = [], ([], [])
            for found, counted in _chunks(t.as_py() for t in batch.column(1).cast(pa.binary())):
                where = at[found]
                starts = np.cumsum([0, *counted[:-1]])
                sizes += counted
                for held, loss in zip(sums, (target, background)):
                    held.append(np.add.reduceat(loss[where], starts))
            n = np.array(sizes, np.int64)
            wanted, general = (np.concatenate(held) / n for held in sums)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(wanted), pa.array(general), pa.array(general - wanted)],
                ["doc_id", "n_tokens", "target_loss", "background_loss", "score"],
            )

    return score


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, target_loss, background_loss, score (bits per token).

    The background model counts every document, the target model those whose id is in ``target_ids`` (one column).
    Both share vocabulary, order and smoothing; ``score`` is the mean over tokens of background loss less target
    loss, so a higher one is more like the target. A null text is empty: its one token is the end mark. A null id
    isn't in the target. Without target documents the target model is uniform. Repeated rows count as often as they
    occur. There are fewer than 2^24 trigrams, whatever the corpus: the counts that meet on the driver and the
    losses that are broadcast are bounded by that.
    """
    base = id_and_text(docs, id_col, text_col)
    wanted = target_ids.toDF("wanted").where("wanted IS NOT NULL").distinct().withColumn("chosen", F.lit(True))
    # A merge join at every size: the ids of the target grow with the corpus.
    flagged = base.join(wanted.hint("merge"), F.col("doc_id") == F.col("wanted"), "left").select("text", F.coalesce("chosen", F.lit(False)).alias("chosen"))
    counts = flagged.mapInArrow(_count, "code int, background bigint, target bigint").groupBy("code").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))
    held = counts.toArrow().sort_by("code")
    codes, background, target = (held.column(k).to_numpy() for k in range(3))
    model = docs.sparkSession.sparkContext.broadcast((codes, losses(codes, target), losses(codes, background)))
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(_score(model), f"doc_id {kind}, n_tokens bigint, target_loss double, background_loss double, score double")
