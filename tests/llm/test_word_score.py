import math
import re
from collections import Counter

import pytest

from spanveil.llm import lm_score, queries, word_score

ROWS = [(1, "The red fox ran."), (2, "the red Fox sat"), (3, "a blue whale sang, sang"), (4, None), (5, ""), (None, "the red fox")]


def brute(rows, chosen, prior=word_score.PRIOR):
    cut = lambda t: [*re.findall(r"\w+|[^\w\s]", (t or "").lower()), "END"]
    vocabulary = {w for _, t in rows for w in cut(t)}

    def losses(kept):
        one, two = Counter(w for t in kept for w in cut(t)), Counter(p for t in kept for p in zip(["START", *cut(t)], cut(t)))
        heads = one + Counter({"START": len(kept)})
        p = lambda h, w: (two[h, w] + prior * (one[w] + 1) / (sum(one.values()) + len(vocabulary))) / (heads[h] + prior)
        return [-sum(math.log2(p(h, w)) for h, w in zip(["START", *cut(t)], cut(t))) / len(cut(t)) for _, t in rows]

    target, general = losses([t for d, t in rows if d in chosen]), losses([t for _, t in rows])
    return {d: (len(cut(t)), a, b) for (d, t), a, b in zip(rows, target, general)}


@pytest.mark.parametrize("block", [4, 1 << 22])
@pytest.mark.parametrize("chosen", [{1, 3}, set()])
def test_word_models_equal_brute_force(spark, monkeypatch, block, chosen):
    monkeypatch.setattr(word_score, "BLOCK", block)
    docs, target = spark.createDataFrame(ROWS, "doc_id long, text string"), spark.createDataFrame([(i,) for i in [*chosen, None]], "x long")
    got = {r.doc_id: r for r in word_score.word_cross_entropy_difference(docs, target).collect()}
    for d, (n, a, b) in brute(ROWS, chosen).items():
        assert got[d].n_tokens == n and got[d].target_loss == pytest.approx(a) and got[d].background_loss == pytest.approx(b) and got[d].score == pytest.approx(b - a)
    assert word_score.word_cross_entropy_difference(docs.limit(0), target).count() == 0


def test_registered_query_learns_word_order(spark, tmp_path):
    """The same byte trigrams in both groups, since all words begin and end alike: only whole words tell them apart."""
    rows = [(i, "xyabxy xycdxy " * 20 + "xyefxy xyghxy " * 20) for i in range(4)] + [(i, "xyabxy xyghxy " * 20 + "xyefxy xycdxy " * 20) for i in range(4, 8)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 3)) for i in range(7)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r.score for r in queries.op10_cross_entropy_difference(spark, str(tmp_path)).collect()}
    assert got[3] > got[7] + 0.5
    docs, target = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i,) for i in range(3)], "x long")
    letters = {r.doc_id: r.score for r in lm_score.cross_entropy_difference(docs, target).collect()}
    assert abs(letters[3] - letters[7]) < 0.1


def test_blocks_of_tokens_never_move(spark, monkeypatch):
    """Marks of the target and whole counts go to the blocks; no shuffle holds the blocks' tokens."""
    plans, write = [], word_score.written

    def explained(df):
        return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")

    def spy(df, label):
        plans.append(explained(df))
        return write(df, label)

    monkeypatch.setattr(word_score, "written", spy)
    docs, target = spark.createDataFrame(ROWS, "doc_id long, text string"), spark.createDataFrame([(1,)], "x long")
    result = word_score.word_cross_entropy_difference(docs, target)
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", "\n".join([*plans, explained(result)]))
    assert moved and not [columns for columns in moved if "tokens#" in columns]
    assert result.count() == len(ROWS) and not [t for t in spark.catalog.listTables() if t.name.startswith("word_blocks")]
