import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanveil.functions import text as T
from spanveil.functions.dialect import java, re2, re2_able
from spanveil.operators import windows


def test_dialect_spells_out_what_engines_lack():
    assert java(r"\d\s[\s:]$").endswith(r"\z") and "\\u00A0" in java(r"\s")
    assert re2(r"a\/b") == "a/b" and not re2_able(r"(?<=a)b") and not re2_able("a{1,2048}") and re2_able("a{1,255}")
    assert java("[^\\s[]") .count("\\[") == 1


def test_boundary_is_ascii(spark):
    rows = spark.createDataFrame([("éabc@x.com",), ("a abc@x.com",)], "t string")
    found = rows.select(F.regexp_extract("t", java(r"\b[a-z]+@x\.com"), 0).alias("m")).collect()
    assert [r.m for r in found] == ["abc@x.com", "abc@x.com"]


def test_normalise_cases():
    for given_text, wanted in [
        ("a%40b", "a@b"), ("a%2540b", "a@b"), ("x&#64;y", "x@y"), ("x&#x40;y", "x@y"), ("4 1 1 1 1", "41111"), ("a b c d", "a b c d"),
        ("j @ m . c o m", "j@m.com"), ("se​cret", "secret"), ("ｆｕｌｌ", "full"), ("раsswоrd", "password"), ("café", "cafe"), ("😀a", "😀a"),
    ]:
        assert T.normalise(given_text)[0] == wanted, given_text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_normalise_offsets_ascend_and_end_at_the_end(t):
    done, origin = T.normalise(t)
    assert len(origin) == len(done) + 1 and origin == sorted(origin) and origin[-1] == len(t)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_utf16_offsets(t):
    units, at = [], 0
    for c in t:
        units.append(at)
        at += 2 if ord(c) > 0xFFFF else 1
    assert T.utf16_to_codepoint(t, units + [at]) == list(range(len(t) + 1))


def test_normalising_leaves_plain_ascii_alone(spark):
    rows = spark.createDataFrame([(1, "plain text"), (2, "a%40b.org"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.normalised, r.origin) for r in T.with_normalised(rows).collect()}
    assert got[1] == ("plain text", None) and got[2] == ("a@b.org", [0, 1, 4, 5, 6, 7, 8, 9][: len("a@b.org") + 1]) and got[3][0] is None


def test_escape_round_trip_keeps_length(spark):
    r = spark.createDataFrame([("a{{b}} {{{",)], "t string").select(
        F.length(T.escape_placeholders(F.col("t"))).alias("n"), T.unescape_placeholders(T.escape_placeholders(F.col("t"))).alias("b")
    ).first()
    assert r.n == 10 and r.b == "a{{b}} {{{"


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(20, 60))
def test_segments_cover_and_stay_small(t, most):
    got = windows.segment(t, most, 8)
    assert got[0][0] == 0 and got[-1][1] == len(t)
    assert all(b - a <= most for a, b in got) and all(n[0] <= p[1] and n[0] > p[0] for p, n in zip(got, got[1:]))


def test_word_windows(spark):
    rows = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(300))), (2, ""), (3, None), (4, "one")], "doc_id long, text string")
    got = [(r.doc_id, r.window, r.n_words) for r in windows.word_windows(rows).orderBy("doc_id", "window").collect()]
    assert got == [(1, 0, 140), (1, 1, 140), (1, 2, 80), (4, 0, 1)]
    assert unicodedata.normalize("NFKC", "ﬁ") == "fi"


def test_normalised_texts_are_handed_over_in_small_pieces():
    import pyarrow as pa

    texts = ["é" * 700_000, None, "%41nna", "", "ﬁ" * 600_000, "x1 2"]
    pieces = list(T.normalised_arrays(iter([pa.array(texts)])))
    assert [len(p) for p in pieces] == [5, 1]
    rows = [r for p in pieces for r in p.to_pylist()]
    want = [{"normalised": None, "origin": None} if t is None else dict(zip(("normalised", "origin"), T.normalise(t))) for t in texts]
    assert rows == want
    # Four bytes a place, not a Python number.
    assert sum(p.nbytes for p in pieces) < 6 * sum(len(r["origin"] or ()) for r in rows)
