"""Text functions: placeholder escapes, words, normalisation with offset maps, offset conversion."""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dialect import java

MAX_CHARS = 1_000_000
MARK_OPEN = "\ue000\ue001"
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff\u2060\u00ad\ue000\ue001"


def escape_placeholders(text: Column) -> Column:
    return F.replace(text, F.lit("{{"), F.lit(MARK_OPEN))


def unescape_placeholders(text: Column) -> Column:
    return F.replace(text, F.lit(MARK_OPEN), F.lit("{{"))


def strip_zero_width(text: Column) -> Column:
    return F.translate(text, ZERO_WIDTH, "")


#: ASCII words with inner hyphens, and every other visible character by itself.
WORD_SPEC = r"\w+(?:[-_]\w+)*|\S"
WORD = java(WORD_SPEC)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def needs_normalising(text: Column) -> Column:
    """False where normalising is the identity: ASCII without escapes or spaced-out runs. Longer texts pass as they are."""
    plain = ~text.rlike(r"[^\x00-\x7F]|%[0-9A-Fa-f]{2}|&#") & ~text.rlike(r"(?<![A-Za-z0-9_])[A-Za-z0-9_@.+\-:/]\s+[A-Za-z0-9_@.+\-:/]\s+[A-Za-z0-9_@.+\-:/]\s")
    return ~plain & (F.length(text) <= MAX_CHARS)


SPACED = re.compile(r"(?<![A-Za-z0-9_])(?:[A-Za-z0-9_@.+\-:/]\s+){3,}[A-Za-z0-9_@.+\-:/](?![A-Za-z0-9_])")
PERCENT = re.compile(r"%([0-9A-Fa-f]{2})")
ENTITY = re.compile(r"&#(?:[xX]([0-9A-Fa-f]{1,6})|([0-9]{1,7}));")
#: Look-alikes of other scripts; accents of Latin letters go by decomposition. Only these scripts are covered.
LOOKALIKES = dict(zip("авсԁеһіјкмнорԛѕтихуАВСЕНІЈКМОРЅТХΑΒΕΖΗΙΚΜΝΟΡΤΥΧαιορν", "abcdehijkmhopqstuxyABCEHIJKMOPSTXABEZHIKMNOPTYXaiopv"))
LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "þ": "th", "Æ": "AE", "Œ": "OE", "Ø": "O", "Đ": "D", "Ł": "L", "Þ": "Th", "ı": "i"}


def _decode(text: str, at: int, pattern: re.Pattern, value) -> tuple[str, int] | None:
    """One escape at a place, decoded up to twice: the character and where it ends."""
    match = pattern.match(text, at)
    if not match:
        return None
    char, end = value(match), match.end()
    if char is None:
        return None
    again = pattern.match(char + text[end : end + 12])
    if again and again.end() > 1 and (inner := value(again)) is not None:
        return inner, end + again.end() - 1
    return char, end


def _percent(m: re.Match) -> str:
    return chr(int(m[1], 16))


def _entity(m: re.Match) -> str | None:
    code = int(m[1], 16) if m[1] else int(m[2])
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else None


#: Where anything but a copy of the character may happen, outside spaced-out runs.
SPECIAL = re.compile(r"[^\x00-\x7F]|%(?=[0-9A-Fa-f]{2})|&#")


@lru_cache(maxsize=1 << 16)
def _plain(c: str) -> str:
    """What a character beyond ASCII becomes by itself."""
    if c in ZERO_WIDTH:
        return ""
    # A character of the compatibility form may itself become several.
    whole = c if c > "\uffff" else unicodedata.normalize("NFKC", c)
    fold = lambda p: LOOKALIKES.get(p) or LETTERS.get(p) or "".join(x for x in unicodedata.normalize("NFD", p) if not unicodedata.combining(x)) or p
    return "".join(p if p < "\x80" else fold(p) for p in whole)


def _normalised(text: str) -> tuple[str, array]:
    """``normalise`` with the places in four bytes each; what stays as it is is copied in runs."""
    out: list[str] = []
    origin = array("i")
    runs = [m.span() for m in SPACED.finditer(text) if sum(c.isdigit() for c in m.group()) >= 4 or ("@" in m.group() and any(c.isalpha() for c in m.group()))]
    at, n, k = 0, len(text), 0
    while at < n:
        # An escape may reach into a run, which then isn't closed up.
        while k < len(runs) and runs[k][0] < at:
            k += 1
        run = runs[k][0] if k < len(runs) else n
        special = SPECIAL.search(text, at, min(run + 2, n))
        stop = min(run, special.start()) if special else run
        if stop > at:
            out.append(text[at:stop])
            origin.extend(range(at, stop))
            at = stop
            continue
        if at == run:
            end = runs[k][1]
            for i in range(at, end):
                if not text[i].isspace():
                    out.append(text[i])
                    origin.append(i)
            at = end
            continue
        found = _decode(text, at, PERCENT, _percent) or _decode(text, at, ENTITY, _entity)
        if found:
            out.append(found[0])
            origin.append(at)
            at = found[1]
            continue
        c = text[at]
        plain = c if c < "\x80" else _plain(c)
        out.append(plain)
        origin.extend([at] * len(plain))
        at += 1
    origin.append(n)
    return "".join(out), origin


def normalise(text: str) -> tuple[str, list[int]]:
    """The normalised text and, for each of its characters and its end, where it comes from.

    At each place the first that applies: a spaced-out run closes up, a percent escape or numeric entity decodes (up
    to twice), otherwise the character is compatibility-normalised by itself and transliterated; zero-width
    characters go. Astral characters stay as they are.
    """
    plain, origin = _normalised(text)
    return plain, origin.tolist()


#: Characters of texts that a Python worker holds with their places before it hands them over.
AT_ONCE = 1 << 20


def normalised_arrays(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Structs (normalised, origin) of texts, in pieces of about ``AT_ONCE`` characters whatever the batches hold."""

    def piece(texts: list[str | None], origins: list[array | None]) -> pa.Array:
        ends = np.cumsum([0, *(0 if o is None else len(o) for o in origins)], dtype=np.int32)
        values = np.concatenate([np.empty(0, np.int32), *(np.frombuffer(o, np.int32) for o in origins if o is not None)])
        none = pa.array([o is None for o in origins], pa.bool_())
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=none)], ["normalised", "origin"])

    for batch in batches:
        texts, origins, held = [], [], 0
        for t in batch:
            text, origin = (None, None) if not t.is_valid else _normalised(t.as_py())
            texts.append(text)
            origins.append(origin)
            held += len(origin or ())
            if held >= AT_ONCE:
                yield piece(texts, origins)
                texts, origins, held = [], [], 0
        if texts:
            yield piece(texts, origins)


def with_normalised(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``normalised`` and ``origin``: computed in Python only where the gate says that it differs."""

    @F.arrow_udf("normalised string, origin array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from normalised_arrays(batches)

    gate = F.coalesce(needs_normalising(F.col(text_col)), F.lit(False))
    todo = df.withColumn("_n", run(F.when(gate, F.col(text_col))))
    return todo.select(*df.columns, F.coalesce("_n.normalised", F.col(text_col)).alias("normalised"), F.col("_n.origin").alias("origin"))


def remap(place: Column, origin: Column) -> Column:
    """An offset in the normalised text as one in the original; clamped to its end."""
    return F.when(origin.isNull(), place).otherwise(F.coalesce(F.get(origin, place.cast("int")), F.element_at(origin, -1)))


def utf16_to_codepoint(text: str, places: list[int]) -> list[int]:
    """Offsets in UTF-16 units as offsets in code points; one inside a pair goes to its character."""
    units, at = {0: 0}, 0
    for k, c in enumerate(text):
        for step in range(1 + (c > "￿")):
            units[at + step] = k
        at += 1 + (c > "￿")
    units[at] = len(text)
    return [units[min(max(p, 0), at)] for p in places]


def codepoint_offsets(text: Column, places: Column) -> Column:
    """Arrays of UTF-16 offsets as code-point offsets; texts without astral characters never reach Python."""

    @F.pandas_udf("array<int>")
    def convert(texts: pd.Series, offsets: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else utf16_to_codepoint(t, list(p)) for t, p in zip(texts, offsets)])

    astral = text.rlike(r"[\x{10000}-\x{10FFFF}]")
    return F.coalesce(convert(F.when(astral, text), places), places.cast("array<int>"))
