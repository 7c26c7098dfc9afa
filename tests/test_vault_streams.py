import json

from hypothesis import given, settings
from hypothesis import strategies as st

from spanveil.operators import chat, encoded, vault
from spanveil.operators.detect import raw_spans
from spanveil.operators.pack import chosen
from spanveil.plans.sanitize import find, round_trip, sanitize
from spanveil.sources import tables
from spanveil.streaming.restore import EventSplitter, Restorer, idle_sessions, restore_stream

NAME = "{{PII_PRIVATE_EMAIL_0_0123456789abcdef}}"


def test_sessions_share_placeholders_and_restore(spark):
    rows = spark.createDataFrame([("s", 0, "a@corp.org b@corp.org"), ("s", 1, "b@corp.org"), ("t", 0, "a@corp.org none"), ("t", 1, "nothing")], "session_id string, seq int, text string")
    keyed = rows.selectExpr("*", "concat(session_id, seq) AS k")
    spans = raw_spans(keyed, chosen("email"), "k").withColumnRenamed("doc_id", "k").join(keyed.drop("text"), "k")
    entries = vault.allocate(spans)
    assert sorted((r.session_id, r.value, r.idx) for r in entries.collect()) == [("s", "a@corp.org", 0), ("s", "b@corp.org", 1), ("t", "a@corp.org", 0)]
    masked = vault.mask(rows, spans, entries)
    back = {(r.session_id, r.seq): r for r in vault.restore(masked, entries).collect()}
    assert {k: r.restored for k, r in back.items()} == {(r.session_id, r.seq): r.text for r in rows.collect()}
    assert back["s", 0].replacements == 2 and back["s", 0].replacements_by_label == {"private_email": 2} and back["t", 1].replacements == 0


def test_known_values(spark):
    texts = spark.createDataFrame([("s", 1, "Bob met bob, Bobby and Bob")], "session_id string, seq int, text string")
    earlier = spark.createDataFrame([("s", 0, "private_person", "Bob"), ("s", 5, "x", "met")], "session_id string, first_seq int, label string, value string")
    assert sorted(r.start for r in vault.known_values(texts, earlier).collect()) == [0, 23]


def test_whole_path_round_trip(spark):
    docs = spark.createDataFrame([(1, "mail bob@corp.org {{x}} at 81.2.69.142"), (2, ""), (3, "hidden bob%40corp.org here"), (4, "see https://github.com/a/b ok")], "doc_id long, text string")
    spans = find(docs, chosen("email", "ipv4", "url"))
    got = sorted((r.doc_id, r.label, r.value) for r in spans.collect())
    assert got == [(1, "private_email", "bob@corp.org"), (1, "private_ip", "81.2.69.142"), (3, "private_email", "bob%40corp.org")]
    masked, entries = sanitize(docs.selectExpr("doc_id AS session_id", "0 AS seq", "doc_id", "text"), spans)
    assert round_trip(masked, entries).count() == 0 and not masked.where("masked LIKE '%corp.org%'").count()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([NAME, "{", "{{", "}}", "text ", "{{PII_X"]), max_size=8), st.lists(st.integers(0, 200), max_size=6))
def test_any_cut_restores_the_same(parts, cuts):
    text = "".join(parts)
    whole = Restorer.pattern.sub("bob@corp.org", text)
    places = sorted({min(c, len(text)) for c in cuts})
    r = Restorer({NAME: "bob@corp.org"})
    out = "".join(r.feed(text[a:b]) for a, b in zip([0, *places], [*places, len(text)])) + r.end()
    assert out == whole


def test_events_from_any_chunks():
    raw = "event: a\r\ndata: 1\r\n\r\ndata: 2\ndata: 3\n\n: note\n\nevent: b\rdata: x\r\r"
    for step in range(1, 9):
        s = EventSplitter()
        got = [e for i in range(0, len(raw), step) for e in s.feed(raw[i : i + step])]
        assert got == [("a", "1"), ("message", "2\n3"), ("b", "x")], step


def test_streaming_restore(spark, tmp_path):
    rows = [("s", 0, i, c, i == 3) for i, c in enumerate(["to {{PII_PRIVATE_", "EMAIL_0_0123456789ab", "cdef}} an", "d on"])]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "stream_id string, block int, seq long, chunk string, last boolean").write.parquet(src)
    stream = spark.readStream.schema("stream_id string, block int, seq long, chunk string, last boolean").parquet(src)
    q = restore_stream(stream, {NAME: "bob@corp.org"}).writeStream.format("memory").queryName("restored").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("restored").orderBy("seq").collect()
    assert "".join(r.restored for r in got) == "to bob@corp.org and on" and got[-1].replacements == 1


def test_idle_sessions(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP'2024-01-01 00:00:00'), (1, TIMESTAMP'2024-01-01 00:29:00'), (1, TIMESTAMP'2024-01-01 01:30:00') AS t(user_id, ts)")
    assert sorted(r.n for r in idle_sessions(rows).collect()) == [1, 2]


def test_chat_bodies(spark):
    body = {"model": "m", "messages": [{"role": "user", "content": [{"type": "text", "text": "hi bob"}, {"type": "thinking", "thinking": "bob"}, {"type": "image", "source": "bob"}]}], "n": 3, "extra": "bob"}
    done, tally = chat.rewrite_body(body, lambda s: s.replace("bob", "X"))
    assert done["messages"][0]["content"][0]["text"] == "hi X" and done["messages"][0]["content"][1]["thinking"] == "bob" and done["extra"] == "bob" and tally == {"unscanned": 1}
    assert json.loads(chat.rewrite_json_text('{"a": "bob", "n": 1}', lambda s: s.replace("bob", "X"))) == {"a": "X", "n": 1} and chat.gate("Bash") == "never" and chat.gate("Other") == "hold"
    rows = spark.createDataFrame([(1, '{"a": ["x", {"b": "y"}], "n": 1}'), (2, "not json"), (3, None)], "id int, body string")
    assert sorted((r.id, r.path, r.value) for r in chat.body_strings(rows).collect()) == [(1, "$.a[0]", "x"), (1, "$.a[1].b", "y"), (2, "$", "not json")]


def test_encoded_and_partial_keys(spark):
    import base64

    hidden = base64.b64encode(b"write to bob@corp.org now").decode()
    got = encoded.base64_spans(spark.createDataFrame([(1, f"x {hidden} y"), (2, "AAAA")], "doc_id long, text string")).collect()
    assert [(r.label, r.start, r.end) for r in got] == [("private_email", 2, 2 + len(hidden))]
    text = "-----BEGIN PRIVATE KEY-----\n" + "A" * 40 + "\n" + "B" * 40 + "\n(cut)"
    assert [(r.start, r.end) for r in encoded.partial_keys(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")).collect()] == [(0, text.index("\n(cut)"))]


def test_ndjson_and_policy(spark, tmp_path):
    p = tmp_path / "in.ndjson"
    p.write_bytes('{"text": "a b"}\r\n{"txt": 1}\nnope\n\n{"text": 5}\n'.encode())
    got = [(r.text, r.error) for r in tables.read_ndjson(spark, str(p)).collect()]
    assert got == [("a b", None), (None, "missing text"), (None, "invalid JSON"), (None, "missing text")]
    f = tmp_path / "policy.json"
    f.write_text('{"threshold": 0.2, "disabledCategories": ["private_date"]}')
    policy = tables.load_policy(str(f), tables.Policy(), {"private_date"})
    assert policy.threshold == 0.2 and policy.disabled == ("private_date",) and len(policy.version) == 16
