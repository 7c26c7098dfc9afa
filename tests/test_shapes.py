"""Shapes by which spans are kept, relabelled or dropped: values on both sides of each rule."""

import base64

import pytest
from pyspark.sql import functions as F

from spanveil.functions import validators
from spanveil.operators import chat, encoded, filters, vault
from spanveil.operators.pack import PACK
from spanveil.plans.sanitize import find, round_trip, sanitize

FEW = [r for r in PACK if r.id in ("core:email", "core:ipv4")]

SPANS = "doc_id long, label string, start int, end int, score double, value string"


def spans_of(spark, label, values):
    return spark.createDataFrame([(i, label, 0, len(v), 0.9, v) for i, v in enumerate(values)], SPANS)


def left(frame):
    return sorted(r.doc_id for r in frame.collect())


def test_product_names(spark):
    gone = ["Claude", "claude code", "CLAUDE-Opus 5.5", "'Claude',", "Claude Agent SDK"]
    stay = ["Alexa", "Siri", "Cortana", "Claude Dupont", "Claudette", "Gemini"]
    assert left(filters.drop_product_names(spans_of(spark, "private_person", gone + stay))) == list(range(len(gone), len(gone + stay)))
    assert left(filters.drop_product_names(spans_of(spark, "private_title", gone))) == list(range(len(gone)))


def test_places(spark):
    values = ["40.7128, -74.0060", "(40.7128; 74)", "12° 30′ 10″ N", "12°30'", "40, 74", "91.5, 10", "Main Street 3", "81.2.69.142", "[81.2.69.142]"]
    got = {r.doc_id: r.label for r in filters.geo(spans_of(spark, "private_geolocation", values)).collect()}
    place, address = "private_geolocation", "private_address"
    assert got == {0: place, 1: place, 2: place, 3: place, 4: address, 5: address, 6: address}


def test_uuids(spark):
    value = "123e4567-E89b-12d3-a456-426614174000"
    texts = [f"token: {value}", f"id {value}", f"token: x\n{value}", f"api_key=({value})"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [(i, "account_number", a := t.index(value) - (i == 3), t.index(value) + len(value) + (i == 3), 0.9, t[a : t.index(value) + len(value) + (i == 3)]) for i, t in enumerate(texts)]
    got = {r.doc_id: r.label for r in filters.resolve_uuids(spark.createDataFrame(rows, SPANS), docs).collect()}
    assert got == {0: "secret", 3: "secret"}


@pytest.mark.parametrize("line,gone", [
    ("2024-05-01 10:00:00,123 NOTICE started", True), ("  [2024-05-01T10:00] WARNING x", True), ("2024-05-01T10:00:01 | ERR x", True), ("2024-05-01 | ERR x", False), ("2024-05-01T10:00:00.5+02:00 app CRITICAL", True),
    ("2024-05-01 10:00 INFO", False), ("2024-05-01 born", False), ("on 2024-05-01 ERROR", False), ("2024-05-01 INFORMATION", False), ("2024-05-01\nERROR", False),
])
def test_log_stamps(spark, line, gone):
    at = line.index("2024")
    docs = spark.createDataFrame([(1, line)], "doc_id long, text string")
    found = filters.drop_log_stamps(spark.createDataFrame([(1, "private_date", at, at + 10, 0.9, "2024-05-01")], SPANS), docs)
    assert (found.count() == 0) == gone


def test_digests(spark):
    texts = ["sha256-" + "a" * 20, "sha512-" + "b" * 88 + "==", "sha256-" + "a" * 19, "xsha256-" + "a" * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [(i, "secret", t.index("-") + 1, len(t.rstrip("=")), 0.9, "v") for i, t in enumerate(texts)]
    assert left(filters.drop_in_digests(spark.createDataFrame(rows, SPANS), docs)) == [2, 3]


def test_stand_ins(spark):
    yes = ["string?", "Bool!", "xxxx", "****", "your_password", "my-token", "the_secret", "put_key_here", "changeme", "datetime", "some_key"]
    no = ["admin", "root", "hunter2", "test", "foo", "yoursTruly7!", "p4ssword"]
    got = spark.createDataFrame([(v,) for v in yes + no], "v string").select(validators.stand_in(F.col("v")).alias("s")).collect()
    assert [r.s for r in got] == [True] * len(yes) + [False] * len(no)


def test_shells_get_no_values(spark):
    assert all(chat.gate(t) == "never" for t in ("Bash", "bash", "shell", "PowerShell", "exec_command", "shell_command", "write_stdin")) and chat.gate("another") == "hold"


def test_encoded_values(spark):
    texts = ["write to anna@corp.io please", "ghp_" + "a1" * 12, "card 4111111111111111 ok", "аnna@corp.io is the one", "nothing to see here at all", "bell \x07 anna@corp.io here"]
    docs = spark.createDataFrame([(i, "x " + base64.b64encode(t.encode()).decode() + " y") for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.label for r in encoded.base64_spans(docs).collect()}
    assert got == {0: "private_email", 1: "secret", 2: "account_number", 3: "private_email"}


def test_edges_of_known_values(spark):
    texts = spark.createDataFrame([("s", 1, "x+39 055 1y +39 055 1, Annas Anna_ Anna9 (Anna)")], "session_id string, seq int, text string")
    earlier = spark.createDataFrame([("s", 0, "private_phone", "+39 055 1"), ("s", 0, "private_person", "Anna")], "session_id string, first_seq int, label string, value string")
    got = sorted((r.value, r.start) for r in vault.known_values(texts, earlier).collect())
    assert got == [("+39 055 1", 12), ("Anna", 42)]


def test_patterns_do_not_defer_to_spans_that_are_dropped(spark):
    """A weak date, a person that is a product, and a disabled category over an address: the address is found all the same."""
    text = "ip 81.2.69.142 here"
    docs = spark.createDataFrame([(i, text) for i in range(4)], "doc_id long, text string")
    rows = [(0, "private_date", 0, 19, 0.06), (1, "private_mac", 3, 14, 0.2), (2, "private_organization", 0, 19, 0.9), (3, "private_person", 0, 19, 0.9)]
    model = spark.createDataFrame([(*r, text[r[2] : r[3]]) for r in rows], SPANS)
    got = {(r.doc_id, r.label, r.value) for r in find(docs, FEW, model).collect()}
    assert got == {(0, "private_ip", "81.2.69.142"), (1, "private_ip", "81.2.69.142"), (2, "private_ip", "81.2.69.142"), (3, "private_person", text)}


def test_literal_braces_come_out_as_they_were(spark):
    text = "{{no}} mail anna@corp.io, user is {{x}}"
    docs = spark.createDataFrame([(1, "s", 0, text)], "doc_id long, session_id string, seq int, text string")
    masked, entries = sanitize(docs, find(docs.select("doc_id", "text"), FEW))
    row, name = masked.first(), entries.first()
    assert name.value == "anna@corp.io" and row.text == text and row.masked == text.replace("anna@corp.io", name.placeholder)
    assert round_trip(masked, entries).count() == 0
    held = spark.createDataFrame([(1, "secret", 0, 6, 0.9, "")], SPANS)
    masked, entries = sanitize(docs, held)
    assert entries.first().value in text and "\ue000" not in entries.first().value + masked.first().masked
