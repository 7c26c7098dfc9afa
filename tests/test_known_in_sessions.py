from spanveil.plans.sanitize import round_trip, sanitize


def test_values_of_earlier_turns_are_masked_in_later_ones(spark):
    docs = spark.createDataFrame(
        [(1, "s", 0, "my pin is blue-Horse7"), (2, "s", 1, "so blue-Horse7 again, not xblue-Horse7"), (3, "t", 1, "blue-Horse7 here")], "doc_id long, session_id string, seq int, text string"
    )
    spans = spark.createDataFrame([(1, "secret", 10, 21, 0.9, "blue-Horse7")], "doc_id long, label string, start int, end int, score double, value string")
    masked, entries = sanitize(docs, spans)
    got = {(r.session_id, r.seq): r.masked for r in masked.collect()}
    name = entries.first().placeholder
    assert entries.count() == 1 and got["s", 0] == f"my pin is {name}"
    assert got["s", 1] == f"so {name} again, not xblue-Horse7" and got["t", 1] == "blue-Horse7 here"
    assert round_trip(masked, entries).count() == 0
