import glob

from spanveil.operators.pack import chosen
from spanveil.plans.sanitize import find, round_trip, sanitize

FEW = chosen("email", "ipv4")


def test_lost_texts_are_mismatches(spark):
    masked = spark.createDataFrame([("s", 0, "kept", "kept"), ("s", 1, "lost", None), ("s", 2, None, None)], "session_id string, seq int, text string, masked string")
    entries = spark.createDataFrame([], "session_id string, label string, value string, idx int, placeholder string")
    assert [r.seq for r in round_trip(masked, entries).collect()] == [1]


def test_texts_that_hold_the_escape_come_out_as_they_were(spark):
    texts = ["\ue000\ue001 anna@corp.io {{x}}", "{{no}}", None, ""]
    docs = spark.createDataFrame([(i, str(i), 0, t) for i, t in enumerate(texts)], "doc_id long, session_id string, seq int, text string")
    spans = find(docs.select("doc_id", "text"), FEW).select("doc_id", "label", "start", "end", "score", "value")
    # One that begins inside an escape.
    spans = spans.unionByName(spark.createDataFrame([(1, "secret", 1, 4, 0.9, "")], spans.schema))
    masked, entries = sanitize(docs, spans)
    names = {r.session_id: r for r in entries.collect()}
    rows = {r.session_id: r for r in masked.collect()}
    assert [rows[str(i)].text for i in range(4)] == texts and names["1"].value == "{no"
    assert rows["0"].masked == texts[0].replace("anna@corp.io", names["0"].placeholder) and rows["1"].masked == "{" + names["1"].placeholder + "}}"
    assert round_trip(masked, entries).count() == 0


def test_what_reads_the_spans_does_not_plan_the_pack_again(spark):
    docs = spark.createDataFrame([(1, "mail anna@corp.io at 81.2.69.142")], "doc_id long, text string")
    masked, entries = sanitize(docs.selectExpr("doc_id AS session_id", "0 AS seq", "doc_id", "text"), find(docs, FEW))
    lost = round_trip(masked, entries)
    assert "regexp_replace" not in lost._jdf.queryExecution().executedPlan().toString() and lost.count() == 0
    # No raw value goes to the shared folder.
    folders = glob.glob(spark.conf.get("spark.checkpoint.dir") + "/spans-*")
    assert folders and all("value" not in spark.read.parquet(f).columns for f in folders)
