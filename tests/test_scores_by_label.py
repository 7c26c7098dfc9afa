"""Character counts, recall by label, matching order and resampling against plain Python."""

import random

from spanveil.operators import combine, evaluate

SPAN = "doc_id long, label string, start int, end int"


def made(seed, n):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        start = rng.randrange(60)
        rows.append((rng.randrange(6), rng.choice("ab"), start, start + rng.randrange(9)))
    return rows


def chars(rows, doc):
    return {c for d, _, s, e in rows for c in range(s, e) if d == doc}


def test_ignored_characters_cost_nothing(spark):
    gold, pred, ignore = made(1, 25), made(2, 25), made(3, 12)
    frames = [spark.createDataFrame(x, SPAN) for x in (gold, pred, ignore)]
    got = {r.doc_id: (r.gold_chars, r.pred_chars, r.hit_chars) for r in evaluate.char_counts(frames[0], frames[1], ignore=frames[2]).collect()}
    for doc in range(6):
        g, p, i = (chars(x, doc) for x in (gold, pred, ignore))
        assert got.get(doc, (0, 0, 0)) == (len(g), len(p - (i - g)), len(g & p))


def test_label_recall(spark):
    gold, pred = made(4, 25), made(5, 10)
    got = {r.label: (r.gold_chars, r.hit_chars) for r in evaluate.label_recall(spark.createDataFrame(gold, SPAN), spark.createDataFrame(pred, SPAN)).collect()}
    for label in "ab":
        own = [r for r in gold if r[1] == label]
        assert got[label] == (sum(len(chars(own, d)) for d in range(6)), sum(len(chars(own, d) & chars(pred, d)) for d in range(6)))


def test_label_recall_without_predictions(spark):
    got = evaluate.label_recall(spark.createDataFrame([(1, "a", 0, 4)], SPAN), spark.createDataFrame([], SPAN)).collect()
    assert [tuple(r) for r in got] == [("a", 4, 0, 0.0)]


def test_order_decides_who_matches(spark):
    gold = spark.createDataFrame([(1, "a", 0, 10, 0), (1, "a", 4, 14, 1)], SPAN + ", given int")
    # The wide span overlaps both enough; taken first it takes the later one on the tie, the narrow one fits only that.
    pred = spark.createDataFrame([(1, "a", 5, 14, 1), (1, "a", 0, 14, 0)], SPAN + ", given int")
    by_place = evaluate.partial_counts(gold, pred).collect()[0]
    given = evaluate.partial_counts(gold, pred, order="given").collect()[0]
    late = evaluate.partial_counts(gold, pred.withColumn("given", 1 - pred.given), order="given").collect()[0]
    assert (by_place.tp, given.tp, late.tp) == (1, 1, 2)


def test_difference_of_equal_tools_is_none_and_clusters_are_drawn_whole(spark):
    rows = [(d, d % 3, 10, 8 + d % 3, 5 + d % 4) for d in range(30)]
    counts = spark.createDataFrame(rows, "doc_id long, source int, gold_chars long, pred_chars long, hit_chars long")
    same = evaluate.paired_difference(counts, counts, resamples=50, unit="source").collect()[0]
    assert (same.low, same.mean, same.high, same.a_better) == (0.0, 0.0, 0.0, 0.0)
    worse = counts.withColumn("hit_chars", counts.hit_chars - 4)
    assert evaluate.paired_difference(counts, worse, resamples=50).collect()[0].low > 0
    # Clusters of one document each are that document.
    alone = evaluate.bootstrap(counts.withColumn("one", counts.doc_id), resamples=50, unit="one").collect()
    assert alone == evaluate.bootstrap(counts, resamples=50).collect()


def test_adjacent_spans_of_one_label(spark):
    rows = [(1, "a", 0, 4, 0.5), (1, "a", 5, 9, 0.9), (1, "b", 9, 12, 0.4), (1, "a", 13, 15, 0.3), (2, "a", 5, 6, 0.1)]
    got = combine.merge_adjacent(spark.createDataFrame(rows, SPAN + ", score double"))
    assert sorted((r.doc_id, r.label, r.start, r.end, r.score) for r in got.collect()) == [
        (1, "a", 0, 9, 0.9), (1, "a", 13, 15, 0.3), (1, "b", 9, 12, 0.4), (2, "a", 5, 6, 0.1)]
