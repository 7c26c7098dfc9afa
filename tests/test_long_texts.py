from spanveil.functions.text import MAX_CHARS
from spanveil.operators.pack import chosen
from spanveil.plans.sanitize import find


def test_texts_over_the_limit_are_normalised_by_segments(spark):
    hidden = "bob%40corp.org"
    text = f"{hidden} " + "some words \n" * (MAX_CHARS // 12) + f" {hidden} end"
    assert len(text) > MAX_CHARS
    docs = spark.createDataFrame([(1, text), (2, f"short {hidden} text")], "doc_id long, text string")
    got = {(r.doc_id, r.start, r.value) for r in find(docs, chosen("email")).collect()}
    assert got == {(1, 0, hidden), (1, text.rindex(hidden), hidden), (2, 6, hidden)}
