"""Vector operators against brute force: near-duplicates and nearest neighbours."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklens.llm import hnsw, lsh_search

KINDS = "label int, n_links string, vec_id long, embedding array<float>, kept string"
NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 16)).astype(np.float32)
    out = [(i % 3, "x", i, v.tolist(), "k") for i, v in enumerate(x)]
    n = 300
    for i in range(0, 60, 2):  # near copies, chains of them, and exact copies in hot groups
        v = x[i].copy()
        for _ in range(3):
            v = v + rng.standard_normal(16).astype(np.float32) * 0.04
            out.append((i % 3, "x", n, v.tolist(), "k"))
            n += 1
    out += [(0, "x", n + j, x[0].tolist(), "k") for j in range(40)]
    n += 40
    odd = [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [NAN] * 16, [INF] + [0.0] * 15, [1.0, 2.0]]
    out += [(0, "x", n + j, v, "k") for j, v in enumerate(odd)]
    n += len(odd)
    return out + [(None, "x", n, x[0].tolist(), "k"), (0, "x", None, x[0].tolist(), "k"), (1, "x", n + 1, x[0].tolist(), "k")]


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v)


def cosine(a, b):
    a, b = np.asarray(a, dtype=np.float64), np.asarray(b, dtype=np.float64)
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def brute_links(rows):
    part = [r for r in rows if r[0] is not None and r[2] is not None and usable(r[3])]
    links = {r[2]: set() for r in rows if r[2] is not None}
    for i, a in enumerate(part):
        for b in part[:i]:
            if a[0] == b[0] and len(a[3]) == len(b[3]) and cosine(a[3], b[3]) >= hnsw.MIN_COSINE:
                links[a[2]].add(b[2])
                links[b[2]].add(a[2])
    out = {}
    for v in links:
        seen, todo = {v}, [v]
        while todo:
            fresh = links[todo.pop()] - seen
            seen |= fresh
            todo += fresh
        out[v] = (len(links[v]), min(seen))
    return out


def test_near_duplicates(spark, rows):
    got = hnsw.near_duplicates(spark.createDataFrame(rows, KINDS)).collect()
    want = brute_links(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            assert (r.n_links, r.component_id) == want[r.vec_id]
            assert r.kept == (r.vec_id == r.component_id)


def test_small_shards_find_the_same(spark, rows):
    got = hnsw.near_duplicates(spark.createDataFrame(rows, KINDS), shard=20).collect()
    want = brute_links(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None} == want


def test_audit_widens_the_beam():
    x = np.random.default_rng(1).standard_normal((900, 64))
    g = hnsw.Graph(x / np.linalg.norm(x, axis=1, keepdims=True))
    g.beam = 1
    assert g.audit(0.98, recall=1.0) == 1.0 and g.beam > 1


def test_dense_group_links_everyone():
    rng = np.random.default_rng(2)
    x = rng.standard_normal(32) + rng.standard_normal((500, 32)) * 0.01
    g = hnsw.Graph(x / np.linalg.norm(x, axis=1, keepdims=True))
    assert len(g.within(g.x[7], 0.98)) == 500


def test_nearest(spark, rows):
    got = lsh_search.nearest_vectors(spark.createDataFrame(rows, KINDS), F.col("vec_id") % 10 == 0).collect()
    part = [r for r in rows if r[2] is not None and usable(r[3])]
    asked = [r for r in part if r[2] % 10 == 0]
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in asked:
        near = sorted(((-cosine(q[3], r[3]), r[2]) for r in part if r[2] != q[2] and len(r[3]) == len(q[3])))[:5]
        mine = sorted(by.get(q[2], []))
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1))
        assert all(abs(cosine(q[3], next(r[3] for r in part if r[2] == v)) - s) < 1e-12 for _, v, s in mine)
        assert [(-round(s, 9), v) for _, v, s in mine] == sorted((-round(s, 9), v) for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & {v for _, v in near})
        total += len(near)
    assert set(by) == {q[2] for q in asked if any(r[2] != q[2] and len(r[3]) == len(q[3]) for r in part)}
    assert hits >= 0.9 * total


def recall_in_buckets(spark, x, asked, bucket):
    """Share of the true five nearest that the query finds in small buckets; per asked vector."""
    rows = [(0, "", i, v.tolist(), "") for i, v in enumerate(x.astype(np.float32))]
    assert lsh_search.hashes_for(len(rows), bucket) >= 4
    table = spark.createDataFrame(rows, KINDS).repartition(8)
    got = lsh_search.nearest_vectors(table, F.col("vec_id").isin(asked), bucket=bucket).collect()
    mine = {q: {r.vec_id for r in got if r.query_id == q} for q in asked}
    assert all(len(m) == 5 for m in mine.values())
    u = np.array([r[3] for r in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u[asked] @ u.T
    near[np.arange(len(asked)), asked] = -2
    return np.array([len(mine[q] & set(n)) / 5 for q, n in zip(asked, np.argsort(-near, axis=1)[:, :5].tolist(), strict=True)])


def test_near_copies_of_others_hide_no_neighbours(spark):
    rng = np.random.default_rng(6)
    lone = rng.standard_normal((1200, 32))
    pairs = np.repeat(rng.standard_normal((100, 32)), 3, axis=0)  # groups of fewer than six
    groups = np.repeat(rng.standard_normal((120, 32)), 20, axis=0)
    x = np.concatenate([lone, pairs + rng.standard_normal(pairs.shape) * 0.02, groups + rng.standard_normal(groups.shape) * 0.02])
    asked = [*range(0, 1200, 15), *range(1200, 1500, 10), *range(1500, 3900, 40)]
    found = recall_in_buckets(spark, x, asked, 128)
    assert found[:80].mean() >= 0.9 and found[80:110].mean() >= 0.9 and found[110:].mean() >= 0.9


def test_probes_come_in_order_and_reach_the_success():
    q = np.random.default_rng(3).standard_normal(24)
    q /= np.linalg.norm(q)
    slots, p = lsh_search.probes(q, 0, 6, 0.5)
    assert (np.diff(p) <= 1e-12).all() and p.sum() >= lsh_search.SUCCESS
    assert len({tuple(s) for s in slots.tolist()}) == len(slots)


def test_ties_and_repeated_rows(spark):
    rows = [(0, "", i, [1.0, 0.0], "") for i in range(0, 100)] + [(0, "", 50, [1.0, 0.0], "")] * 5
    got = lsh_search.nearest_vectors(spark.createDataFrame(rows, KINDS), F.col("vec_id") % 50 == 0).collect()
    by = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 50)}
    assert by == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4]}


def test_empty(spark):
    none = spark.createDataFrame([], KINDS)
    assert hnsw.near_duplicates(none).count() == 0
    assert lsh_search.nearest_vectors(none, F.col("vec_id") % 50 == 0).count() == 0
