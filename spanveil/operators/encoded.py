"""Personal data inside base64, and keys of which only one mark is left."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import with_normalised
from .detect import matches

SCORE = 0.99999
# An encoded run, and what its text must hold to be masked.
RUN = r"[A-Za-z0-9+/]{24,}={0,2}"
KEY = r"\b(?:sk-[A-Za-z0-9_\-]{16,}|ghp_[A-Za-z0-9]{20,}|gho_[A-Za-z0-9]{20,}|AKIA[A-Z0-9]{16}|xox[abp]-[A-Za-z0-9-]{10,}|ya29\.[A-Za-z0-9_\-]{20,})"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def base64_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, label, score, start, end, value): encoded runs whose text, normalised, holds an e-mail, a key or a long number.

    Bytes that aren't UTF-8 are replaced; a text with control characters is none.
    """
    gated = docs.where(F.col("text").rlike(r"[A-Za-z0-9+/]{24}"))
    runs = gated.select("doc_id", F.explode(matches(F.col("text"), RUN)).alias("m")).where(F.length("m.value") % 4 == 0)
    plain = runs.withColumn("plain", F.make_valid_utf8(F.try_to_binary(F.col("m.value"), F.lit("base64")).cast("string")))
    plain = plain.where((F.length("plain") >= 6) & ~F.col("plain").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"))
    plain = with_normalised(plain, "plain")
    inner = F.col("normalised")
    label = F.when(inner.rlike(EMAIL), "private_email").when(inner.rlike(KEY), "secret").when(inner.rlike(r"\d{13,19}"), "account_number")
    return plain.withColumn("label", label).where("label IS NOT NULL").select("doc_id", "label", F.lit(SCORE).alias("score"), "m.start", "m.end", "m.value")


MARK = re.compile(r"-----(BEGIN|END) ((?:(?:RSA|DSA|EC|OPENSSH|ENCRYPTED|TSS2|PGP) )?PRIVATE KEY(?: BLOCK)?)-----")
BREAK = re.compile(r"[ \t]*(?:\r?\n|\\n|[ \t])[ \t]*")
BODY = re.compile(r"[A-Za-z0-9+/=]{16,}")
HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*: [^\n]*")


def partial_key(text: str, mark: re.Match) -> tuple[int, int] | None:
    """A mark and the base64 lines on its open side; nothing if there are none or the other mark completes the key."""
    opening, lines = mark[1] == "BEGIN", 0
    at = mark.end() if opening else mark.start()
    edge = at
    while True:
        if opening:
            gap = BREAK.match(text, at)
            if not gap:
                break
            body = BODY.match(text, gap.end()) or (HEADER.match(text, gap.end()) if not lines else None)
            if not body:
                break
            lines += body.re is BODY
            at = edge = body.end()
        else:
            head = text[max(0, at - 400) : at]
            found = re.search(r"(?:^|[ \t\n]|\\n)([A-Za-z0-9+/=]{4,})[ \t]*(?:\r?\n|\\n|[ \t])[ \t]*$", head)
            if not found or (lines and len(found[1]) < 16):
                break
            lines += 1
            at = edge = at - len(head) + found.start(1)
    if not lines:
        return None
    if opening and re.match(r"[ \t]*(?:\r?\n|\\n|[ \t])?[ \t]*-----END ", text[edge : edge + 20]):
        return None
    return (mark.start(), edge) if opening else (edge, mark.end())


def partial_keys(docs: DataFrame, *kept: str) -> DataFrame:
    """(doc_id, start, end) of keys with one mark, and the columns ``kept``; only texts with a mark reach Python."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def walk(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": s[0], "end": s[1]} for m in MARK.finditer(t) if (s := partial_key(t, m))])

    marked = docs.where(F.col("text").contains("PRIVATE KEY"))
    return marked.select("doc_id", *kept, F.explode(walk("text")).alias("s")).select("doc_id", *kept, "s.start", "s.end")
