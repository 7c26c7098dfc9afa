"""The pipeline's stages on a small corpus with one case of each kind, and the contract of its steps."""

import numpy as np

import corpus_pipeline as P
from spanveil.llm import queries
from spanveil.llm.packing import default_vocabulary, encoder


def corpus(spark, where):
    rng = np.random.default_rng(9)
    words = [f"{a}{b}" for a in ("ba", "ko", "li", "mu", "ne", "po") for b in ("ran", "tel", "vis", "dom", "gar")]
    text = lambda n=80: " ".join(rng.choice(words, n))
    rows = {i: text() for i in range(90)}
    for i in range(0, 90, 3):
        rows[i] += " you horrid scumbag"
    leak = " ".join(f"leak{i}" for i in range(14))
    clean, copy, base = text(), text(), text(200).split()
    near = [*base]
    near[100] = "other"
    rows |= {200: clean, 201: copy, 202: copy, 203: " ".join(base), 204: " ".join(near), 205: f"{clean[:60]} {leak} {text(30)}", 206: None}
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return rows, leak


def test_stages(spark, tmp_path):
    where = str(tmp_path)
    rows, leak = corpus(spark, where)
    docs, columns, seen = P.table(spark, where, "documents"), None, {}
    for name, stage in P.STAGES:
        columns = columns or docs.columns
        docs = stage(spark, docs, where)
        if name != "packing":
            assert docs.columns == columns
            docs = P.written(docs, "test")
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(seen["toxicity"]) == {i for i in rows if i >= 200 or i % 3}
    assert set(seen["toxicity"]) - set(seen["exact_dedup"]) == {201}
    assert set(seen["exact_dedup"]) - set(seen["near_dedup"]) == {204}
    cut = {i for i, t in seen["near_dedup"].items() if seen["decontamination"].get(i) != t}
    assert cut == {205} and leak not in seen["decontamination"][205] and set(seen["decontamination"]) == set(seen["near_dedup"])
    encode = encoder(default_vocabulary()).encode
    tokens = {}
    for r in docs.collect():
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens == {i: len(encode(t or "")) + 1 for i, t in seen["decontamination"].items()}
    assert P.run(spark, where).count() == docs.count()


def test_every_operator_is_registered():
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"] and P.ORACLE_SQL is None
    assert sorted({int(n[2:].split("_")[0]) for n in queries.QUERIES}) == list(range(1, 11)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
