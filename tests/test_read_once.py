from pyspark.sql import functions as F

from spanveil.operators import combine, evaluate

SPAN = "doc_id long, label string, start int, end int, value string"


def test_failures_read_the_predictions_once(spark):
    gold = spark.createDataFrame([(1, "a", 0, 2, "x"), (1, "a", 0, 2, "x"), (1, "a", 5, 7, "y"), (None, "a", 1, 2, "n")], SPAN)
    texts = spark.createDataFrame([(1, "a", 0, 2, "z"), (2, "b", 3, 4, "w"), (None, "a", 1, 2, "n")], SPAN)
    found = evaluate.failures(gold, texts)
    assert {(r.kind, r.value, r.n) for r in found.collect()} == {("missed", "y", 1), ("missed", "n", 1), ("wrong", "w", 1), ("wrong", "n", 1)}
    once = texts.where(F.col("value").rlike("[a-z]")).withColumn("value", F.regexp_replace("value", "onlyonce", ""))
    assert evaluate.failures(gold, once)._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_windows_over_addresses_hold_no_texts(spark):
    spans = spark.createDataFrame([(1, "private_address", 0, 4, 0.9), (1, "private_address", 6, 9, 0.8), (1, "secret", 10, 12, 0.7)], "doc_id long, label string, start int, end int, score double")
    texts = spark.createDataFrame([(1, "Road, Ulm xy")], "doc_id long, text string")
    joined = combine.join_addresses(spans, texts)
    assert {(r.label, r.start, r.end) for r in joined.collect()} == {("private_address", 0, 9), ("secret", 10, 12)}
    windows = []

    def walk(node):
        if node.nodeName() == "Window":
            windows.append(node.output().toString())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(joined._jdf.queryExecution().optimizedPlan())
    assert windows and not any("text#" in w for w in windows)
