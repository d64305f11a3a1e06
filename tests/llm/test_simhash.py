"""SimHash: fingerprints, Golay keys, links and components against brute force."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracklens.llm import simhash as S
from tracklens.llm.common import bitmaps, components, given_out, numbered, stage

KINDS = "fingerprint string, text string, root long, doc_id long, fp string"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one two", "A b C d", "É é  x \x1c y", "a b c " * 40_000])
def test_fingerprint(text):
    assert S.fingerprint(text.encode() if text is not None else None) == plain_fingerprint(text)


def test_golay_code_corrects_three_errors():
    single, errors = S.golay_tables()
    assert len(set(errors.tolist())) == 2048 and max(int(e).bit_count() for e in errors) == 3
    rng = random.Random(3)
    for _ in range(300):
        x = rng.getrandbits(22)
        near = x ^ sum(1 << b for b in rng.sample(range(22), rng.randint(0, 2)))
        a, b = (set(S.codewords(np.array([v], dtype=np.int64), 22)[0].tolist()) for v in (x, near))
        assert a & b and len(a) in (1, 2, 3, 4, 5, 6)


def near_fingerprints(rng, n, spread):
    base = [rng.getrandbits(64) for _ in range(n)]
    out = set(base) | {0, (1 << 64) - 1}
    for b in base:
        for _ in range(spread):
            out.add(b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 4))))
    return sorted(out)


@pytest.mark.parametrize("max_bits", [0, 1, 2])
def test_links(spark, max_bits):
    fps = near_fingerprints(random.Random(max_bits), 40, 8)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = S.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), max_bits).collect()
    true = [(a, b) for a, b in itertools.combinations(signed, 2) if (a ^ b & 0xFFFFFFFFFFFFFFFF).bit_count() <= 2 or ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= max_bits]
    true = [(a, b) for a, b in true if ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= max_bits]
    assert all(((r.a ^ r.b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= max(max_bits, 0) for r in got)
    assert brute_components([(r.a, r.b) for r in got], signed) == brute_components(true, signed)


def test_large_bucket_paths_agree(spark, monkeypatch):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << i for i in rng.sample(range(30), rng.randint(0, 5))) for _ in range(900)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    true = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= 2]
    want = brute_components(true, signed)
    a, b = S._halfway(np.array(signed, dtype=np.int64))
    assert brute_components(list(zip(a.tolist(), b.tolist(), strict=True)), signed) == want
    links = S.near_links(df).collect()
    assert brute_components([(r.a, r.b) for r in links], signed) == want
    run = S._bucket_links
    monkeypatch.setattr(S, "IN_TASK", 20)  # every larger bucket goes over the distributed path
    monkeypatch.setattr(S, "PAIRWISE", 10)

    def small(max_bits):
        inner = run(max_bits)

        def go(batches):
            S.IN_TASK, S.PAIRWISE = 20, 10
            yield from inner(batches)

        return go

    monkeypatch.setattr(S, "_bucket_links", small)
    links = S.near_links(df).collect()
    assert brute_components([(r.a, r.b) for r in links], signed) == want


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for i in range(150):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([1, 2, 5, 60, 300]))]
        out.append((f"f{i}", " ".join(words), 1, i, "x"))
        if i % 3 == 0:
            k = rng.randrange(len(words))
            out.append(("g", " ".join(words[:k] + ["changed"] + words[k + 1 :]), 1, 1000 + i, "x"))
        if i % 10 == 0:
            out += [("h", " ".join(words).upper(), 1, 2000 + i + j, "x") for j in range(5)]
    out += [("n", None, 1, 3000, "x"), ("n", "", 1, 3001, "x"), ("n", "a b c", 1, None, "x"), ("n", "a b c", 1, None, "x")]
    return out + [out[0], out[0], ("z", out[5][1], 1, out[5][3], "other")]


def groups(rows):
    fps = {}
    for _, t, _, i, _ in rows:
        fps.setdefault(plain_fingerprint(t), []).append(i)
    pairs = [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 2]
    root = brute_components(pairs, fps)
    low = {}
    for f, ids in fps.items():
        low[root[f]] = min([i for i in ids + [low.get(root[f])] if i is not None], default=None)
    return {f: low[root[f]] for f in fps}, root


def test_groups(spark, rows):
    got = S.simhash_groups(spark.createDataFrame(rows, KINDS)).collect()
    low, _ = groups(rows)
    want = [(i, f"{plain_fingerprint(t):016x}", low[plain_fingerprint(t)]) for _, t, _, i, _ in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_one_row_per_group_stays(spark, rows):
    df = spark.createDataFrame(rows, KINDS)
    kept = S.keep_one_per_group(df)
    assert kept.columns == df.columns
    out = kept.collect()
    _, root = groups(rows)
    by = {}
    for r in rows:
        by.setdefault(root[plain_fingerprint(r[1])], []).append(r)
    assert len(out) == len(by)
    for r in out:
        group = by.pop(root[plain_fingerprint(r.text)])
        assert tuple(r) in group
        ids = [x[3] for x in group if x[3] is not None]
        assert r.doc_id == (min(ids) if ids else None)


def test_texts_cross_no_network(spark, tmp_path):
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(4)) for _ in range(6000)]
    rows = [("f", t, 1, i, "x") for i, t in enumerate(texts)] + [("g", texts[0], 2, 6000, "y")]
    spark.createDataFrame(rows, KINDS).repartition(2).write.parquet(str(tmp_path / "docs"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "40000")  # 6,000 row numbers are more, their bits less
    try:
        kept = S.keep_one_per_group(spark.read.parquet(str(tmp_path / "docs")))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert "BroadcastHashJoin" in plan
        assert sorted(r.doc_id for r in kept.collect()) == list(range(6000))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_rows_given_out_by_bitmaps(spark, tmp_path, threshold):
    n = 70_000  # three blocks of one file, and a second file
    spark.range(n).coalesce(1).write.parquet(str(tmp_path / "t"))
    spark.range(n, n + 100).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    held = numbered(spark.read.parquet(str(tmp_path / "t")), "given-held")
    copies = F.col("_row.id") * 7 % 5 % 4  # 0 to 3
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        marks = stage(bitmaps(held.select("_rid", copies.alias("copies"))), "given-marks")
        assert marks.select("_file", "_block").distinct().count() == 4
        got = given_out(held, marks).groupBy("id").count()
        want = spark.range(n + 100).select("id", (F.col("id") * 7 % 5 % 4).alias("count")).filter("count > 0")
        assert got.count() == want.count() and got.exceptAll(want).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_file_read_twice_and_a_text_table(spark, rows, tmp_path):
    some = [r for r in rows if r[3] is not None]
    path = str(tmp_path / "docs")
    spark.createDataFrame(some, KINDS).repartition(2).write.parquet(path)
    once = S.keep_one_per_group(spark.read.parquet(path))
    assert once.exceptAll(S.keep_one_per_group(spark.read.parquet(path, path))).count() == 0
    assert S.keep_one_per_group(spark.read.parquet(path, path)).count() == once.count() > 0
    spark.createDataFrame(some, KINDS).write.json(str(tmp_path / "json"))
    assert S.keep_one_per_group(spark.read.schema(KINDS).json(str(tmp_path / "json"))).count() == once.count()


def test_empty(spark):
    none = spark.createDataFrame([], KINDS)
    assert S.simhash_groups(none).count() == S.keep_one_per_group(none).count() == 0


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(1000, x) for x in range(900, 1000)] + [(rng.randint(2000, 2300), rng.randint(2000, 2300)) for _ in range(200)]
    pairs = [p for p in pairs if p[0] != p[1]]
    nodes = {x for p in pairs for x in p}
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), "t").collect()}
    assert got == brute_components(pairs, nodes)
    assert components(spark.createDataFrame(pairs, "a long, b long").filter(F.lit(False)), "t").count() == 0
