import hashlib

from spanveil.llm import secrets

CASES = [
    ("login password: Tr0ub4dor&3 works", "Tr0ub4dor&3"),
    ("set password=hunter2hunter now", "hunter2hunter"),
    ("use token=abcdefghijklmnopqrstuvwxyzABCDEF here", "abcdefghijklmnopqrstuvwxyzABCDEF"),
    ("AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI7K7MDENGbPxRfiCYzT2aQ9kLm3x", "wJalrXUtnFEMI7K7MDENGbPxRfiCYzT2aQ9kLm3x"),
    ("stripe_secret_key_live = 0a1b2c3d4e5f60718293a4b5c6d7e8f9", "0a1b2c3d4e5f60718293a4b5c6d7e8f9"),
]


def test_short_symbol_letter_and_long_named_values(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)] + [(9, "The password: please ask the internationalisation team.")], "doc_id long, text string")
    found = {(r.doc_id, r.value): r for r in secrets.features(secrets.candidates(docs)).collect()}
    for i, (text, value) in enumerate(CASES):
        r = found[i, value]
        assert text[r.start : r.end] == value and r.f_secret_word >= 1 and r.f_assigned == 1
    secret = {(r.doc_id, r.value_sha256) for r in secrets.secret_scan(docs).where("secret").collect()}
    assert {(i, hashlib.sha256(v.encode()).hexdigest()) for i, (_, v) in enumerate(CASES)} <= secret
    assert not [d for d, _ in secret if d == 9]
