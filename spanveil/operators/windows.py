"""Windows over words and segments over characters."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MAX_CHARS, WORD_SPEC

# Words of a window, words shared by neighbours, widest span, characters shared by segments.
WINDOW, OVERLAP, MAX_WIDTH, SEGMENT_OVERLAP = 140, 30, 12, 32_768


def word_windows(docs: DataFrame, size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, window, start, end, n_words): windows of words by stride; each reaches up to its last word's end.

    Places are found in one pass over a text in Arrow batches; a text without words has no window.
    """

    word = re.compile(WORD_SPEC.replace(r"\S", r"[^\s\ufeff]"), re.ASCII)
    stride = size - overlap

    @F.pandas_udf("array<struct<window:int,start:int,end:int,n_words:int>>")
    def cut(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[dict]:
            at = [m.span() for m in word.finditer(text or "") if not m.group().isspace()]
            found = []
            for k in range(max(0, -(-(len(at) - size) // stride)) + 1 if at else 0):
                part = at[k * stride : k * stride + size]
                found.append({"window": k, "start": part[0][0], "end": part[-1][1], "n_words": len(part)})
            return found

        return texts.map(one)

    return docs.select("doc_id", F.explode(cut("text")).alias("w")).select("doc_id", "w.*")


def candidates(n_words: Column, width: int = MAX_WIDTH) -> Column:
    """All (first, last) word spans up to a width."""
    return F.flatten(F.transform(F.sequence(F.lit(0), n_words - 1), lambda i: F.transform(F.sequence(i, F.least(i + width - 1, n_words - 1)), lambda j: F.struct(i.alias("first"), j.alias("last")))))


def segment(text: str, most: int = MAX_CHARS, overlap: int = SEGMENT_OVERLAP) -> list[tuple[int, int]]:
    """Segments of at most ``most`` characters that cover a text and overlap.

    A cut falls after the last line end of a segment's last quarter, else after its last white space, else where the
    segment ends. The next one starts ``overlap`` before, at the start of the run of characters that stands there.
    """
    out, start, n = [], 0, len(text)
    while True:
        end = min(start + most, n)
        if end == n:
            return [*out, (start, n)]
        floor = end - most // 4
        cut = text.rfind("\n", floor, end) + 1
        if not cut:
            cut = next((k + 1 for k in range(end - 1, floor - 1, -1) if text[k].isspace()), 0)
        end = cut or end
        out.append((start, end))
        again = max(start + 1, end - overlap)
        while again > start + 1 and not text[again - 1].isspace() and end - again < 2 * overlap:
            again -= 1
        start = again


def segments(docs: DataFrame, most: int = MAX_CHARS, overlap: int = SEGMENT_OVERLAP) -> DataFrame:
    """(doc_id, start, end, text) of segments; only texts over the limit reach Python."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"start": a, "end": b} for a, b in segment(t, most, overlap)])

    long = cut(F.when(F.length("text") > most, F.col("text")))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end")))
    rows = docs.where("text IS NOT NULL").withColumn("_s", long)
    return rows.select("doc_id", "text", F.explode(F.coalesce("_s", whole)).alias("s")).select("doc_id", "s.start", "s.end", F.expr("substring(text, s.start + 1, s.end - s.start)").alias("text"))
