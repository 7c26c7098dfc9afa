from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from spanveil.operators import combine as C
from spanveil.operators import evaluate as E

SPANS = st.lists(st.tuples(st.integers(1, 3), st.sampled_from(["a", "b"]), st.integers(0, 40), st.integers(1, 12), st.sampled_from([0.3, 0.5, 0.9])), max_size=25)
ONCE = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
SCHEMA = "doc_id int, label string, start int, end int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(d, lab, s, s + n, sc) for d, lab, s, n, sc in rows], SCHEMA)


@ONCE
@given(SPANS)
def test_containment_and_cover_match_brute_force(spark, rows):
    df, plain = frame(spark, rows), [(d, lab, s, s + n, sc) for d, lab, s, n, sc in rows]
    kept = sorted(tuple(r) for r in C.drop_contained(df).collect())
    assert kept == sorted(x for x in plain if not any(y[0] == x[0] and y[2] <= x[2] and y[3] >= x[3] and y[3] - y[2] > x[3] - x[2] for y in plain))
    chars = {(d, c) for d, _, s, e, _ in plain for c in range(s, e)}
    cover = [(r.doc_id, c) for r in C.covered(df).collect() for c in range(r.start, r.end)]
    assert sorted(cover) == sorted(chars)


@ONCE
@given(SPANS)
def test_merge_unites_chains_and_keeps_the_best_label(spark, rows):
    got = C.merge(frame(spark, rows)).collect()
    for r in got:
        inside = [x for x in rows if x[0] == r.doc_id and x[2] < r.end and r.start < x[2] + x[3]]
        best = max(inside, key=lambda x: (x[4], -x[2], x[2] + x[3], x[1]))
        assert r.score == max(x[4] for x in inside) and r.label == best[1]
    assert all(a.doc_id != b.doc_id or a is b or a.end <= b.start or b.end <= a.start for a in got for b in got)


def test_greedy_grows():
    assert C.greedy([(0, 10, "a", 0.9), (2, 12, "a", 0.5), (3, 13, "a", 0.4), (50, 60, "b", 0.1)], 0.5, False) == [(0, 13, "a", 0.9), (50, 60, "b", 0.1)]
    assert C.greedy([(0, 10, "a", 0.9), (1, 11, "b", 0.5)], 0.5, False) == [(0, 10, "a", 0.9), (1, 11, "b", 0.5)]


def test_refine_and_addresses(spark):
    texts = spark.createDataFrame([(1, " (Bob), 1 Main St, Rome")], "doc_id int, text string")
    spans = spark.createDataFrame([(1, "private_person", 0, 7, 0.9), (1, "private_address", 8, 17, 0.5), (1, "private_address", 19, 23, 0.7), (1, "x", 6, 7, 0.1)], SCHEMA)
    refined = C.refine(spans, texts)
    assert (1, "private_person", 2, 5, 0.9) in [tuple(r) for r in refined.collect()] and refined.count() == 3
    joined = [(r.label, r.start, r.end, r.score) for r in C.join_addresses(refined, texts).collect()]
    assert ("private_address", 8, 23, 0.7) in joined


def test_scores(spark):
    gold = spark.createDataFrame([(1, "a", 0, 10), (1, "a", 20, 30)], "doc_id int, label string, start int, end int")
    pred = spark.createDataFrame([(1, "a", 0, 10, 0.9), (1, "a", 21, 31, 0.4), (2, "a", 0, 5, 0.2)], SCHEMA)
    exact = E.precision_recall(E.exact_counts(gold, pred)).first()
    assert (exact.tp, exact.fp, exact.fn) == (1, 2, 1)
    partial = E.partial_counts(gold, pred).first()
    assert (partial.tp, partial.fp, partial.fn) == (2, 1, 0)
    chars = {r.doc_id: (r.gold_chars, r.pred_chars, r.hit_chars) for r in E.char_counts(gold, pred).collect()}
    assert chars == {1: (20, 20, 19), 2: (0, 5, 0)}
    sweep = {r.threshold: (r.gold_chars, r.masked_chars, r.hit_chars) for r in E.sweep(gold, pred, [0.1, 0.3, 0.5]).collect()}
    assert sweep == {0.1: (20, 25, 19), 0.3: (20, 20, 19), 0.5: (20, 10, 10)}
    ci = E.bootstrap(E.char_counts(gold, pred), 50).first()
    assert 0 <= ci.low <= ci.mean <= ci.high <= 1


def test_reports(spark):
    texts = spark.createDataFrame([(1, "call bob now"), (2, "nothing"), (3, "plain")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "b", "MUST_MASK", "name", 5, 8), (1, "n", "MUST_KEEP", "word", 9, 12)], "doc_id int, item string, class string, kind string, start int, end int")
    pred = spark.createDataFrame([(1, "x", 5, 7, 0.9), (3, "x", 0, 2, 0.9)], SCHEMA)
    cover = E.item_cover(items, pred, texts)
    row = E.summary(cover, texts, pred).first()
    assert (row.leaked, row.kept, row.leaking_docs, row.clean_docs, row.clean_docs_masked, row.masked) == (1, 1, 1, 2, 1, 4)
    assert {r.of_kind: r.leaked for r in E.kind_split(cover, "name").collect()} == {True: 1, False: 0}
    scores = spark.createDataFrame([("a", 0.5), ("a", 0.7), ("b", 0.6), ("c", 0.1)], "tool string, value double")
    assert {r.tool: r.place for r in E.places(scores).collect()} == {"a": 1, "b": 1, "c": 3}
    calls = spark.createDataFrame([("a", 1, r, float(ms)) for r in (0, 1, 2) for ms in (r, r + 1, r + 2)], "tool string, size int, round int, ms double")
    assert E.latency(calls).first().median_ms == 2.0
    good = "@@ -1,2 +1,2 @@\n a\n-b\n+c\n"
    assert E.hunks_consistent(good) and not E.hunks_consistent(good.replace("-b\n", ""))
