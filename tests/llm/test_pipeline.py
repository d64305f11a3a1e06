"""The pipeline against its stages done by hand."""

from __future__ import annotations

import hashlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as P
from tracklens.llm import bpe, secret_scan, simhash, toxicity
from tracklens.llm.queries import QUERIES, oracle_sql

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash_dedup", "secret_scan", "source_mixing", "bpe"]
    assert P.ORACLE_SQL is None
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(oracle_sql()) <= set(QUERIES)


def test_run_equals_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scorer = toxicity.Scorer(toxicity.fit(docs, labels))
    rows = [r for r in docs.collect() if scorer(r.text)[0] < 0.5]
    fps = [simhash.fingerprint((r.text or "").encode()) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= simhash.MAX_BITS:
                up[root(i)] = root(j)
    best = {}
    for i, r in enumerate(rows):
        k = root(i)
        if k not in best or r.doc_id < best[k].doc_id:
            best[k] = r
    texts = {r.doc_id: secret_scan.masked(r.text, secret_scan.scan(r.text)[1]) for r in best.values()}

    stages = {}
    out = docs
    for name, f in P.STAGES:
        out = f(spark, out, SF)
        stages[name] = out = P.stage(out, f"test-{name}")
        if name != "bpe":
            assert out.columns == docs.columns
    assert sorted(r.doc_id for r in stages["simhash_dedup"].collect()) == sorted(texts)
    masked = {r.doc_id: (r.text, r.n_chars) for r in stages["secret_scan"].collect()}
    assert masked == {i: (t, len(t)) for i, t in texts.items()}
    mixed = stages["source_mixing"].groupBy("doc_id").count().collect()
    assert all(r["count"] <= 3 and r.doc_id in texts for r in mixed)

    final = P.run(spark, SF)
    assert sorted(map(repr, final.collect())) == sorted(map(repr, out.collect()))
    tool = Tokenizer.from_file(bpe.tokenizer_path())
    for r in final.collect():
        ids = tool.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert bytes(r.ids) == np.array(ids, dtype="<u4").tobytes()


def test_clashing_and_missing_columns(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, _row int, copies int, fp string, score double"
    rows = [(i, f"some words number {i} of a short text {i * i}", "en", "a", 5, 1, 2, "f", 0.5) for i in range(30)]
    rows += [(None, None, None, None, None, None, None, None, None)] * 2 + [(3, "", "en", None, 0, 1, 1, "x", 0.1)] + [rows[0]] * 3
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, f in P.STAGES:
        docs = P.stage(f(spark, docs, str(tmp_path)), f"clash-{name}")
        if name != "bpe":
            assert docs.columns == [c.split()[0] for c in kinds.split(", ")], name
    assert docs.count() > 0
    spark.createDataFrame([], kinds).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert P.run(spark, str(tmp_path / "none")).count() == 0
