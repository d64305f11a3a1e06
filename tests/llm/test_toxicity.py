"""Nearest labelled examples: exactness of the index, held-out accuracy, odd rows."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tracklens.llm import toxicity as X

SF = "/root/testdata/sf0.01"
DOCS = "score string, doc_id long, text string, predicted string, source string"


def test_index_is_exact():
    rng = np.random.default_rng(4)
    vectors = []
    for _ in range(700):
        t = np.sort(rng.choice(60, rng.integers(1, 8), replace=False))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / np.sqrt((w * w).sum())))
    index = X.BlockMaxIndex(vectors, 60)
    dense = np.zeros((700, 60))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for t, w in vectors[:80]:
        ids, sims = index.nearest(t, w, 9)
        q = np.zeros(60)
        q[t] = w
        full = np.round(dense @ q, 12)
        order = np.lexsort((np.arange(700), -full))[:9]
        order = order[full[order] > 0]
        assert ids.tolist() == order.tolist() and np.allclose(sims, full[order])


def test_index_with_rare_terms_is_exact():
    """Terms of very different frequency, and texts in groups, so that most blocks are never visited."""
    rng = np.random.default_rng(5)
    n_terms, vectors = 4000, []
    for i in range(1500):
        own = (i // 30) * 40 + rng.choice(40, 12, replace=False) + 100
        t = np.unique(np.concatenate([rng.choice(100, 20, replace=False), own, rng.choice(n_terms, 5)]))
        w = rng.random(len(t)) * np.where(t < 100, 0.1, 1.0) + 0.01
        vectors.append((t, w / np.sqrt((w * w).sum())))
    dense = np.zeros((1500, n_terms))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for common in (1, 32, 10**9):  # no matrix but for terms of all, some of each, matrix only
        index = X.BlockMaxIndex(vectors, n_terms, common)
        for i, (ids, sims) in zip(range(0, 1500, 17), index.nearest_of(vectors[::17], 16), strict=True):
            full = np.round(dense @ dense[i], 12)
            order = np.lexsort((np.arange(1500), -full))[:16]
            assert np.allclose(sims, full[order], atol=1e-11)
            assert set(ids[sims > sims[-1] + 1e-9].tolist()) == set(order[full[order] > full[order[-1]] + 1e-9].tolist())


def plain_scores(docs, labels):
    """The same scores by dictionaries: every example's cosine, no index."""
    toxic = {}
    for r in labels:
        if r.doc_id is not None and r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            toxic[r.doc_id] = max(toxic.get(r.doc_id, 0), r.toxic)
    words = lambda text: Counter(re.findall(r"\w+", (text or "").lower()))
    texts = {}
    for r in docs:
        if r.doc_id in toxic and r.text is not None:
            texts[r.doc_id] = min(texts.get(r.doc_id, r.text), r.text)
    held = {i: words(t) for i, t in texts.items()}
    pos, neg = (sum(toxic[i] == y for i in held) for y in (1, 0))
    df = Counter(w for r in docs for w in words(r.text))
    known = {w for c in held.values() for w in c}
    a, b = (Counter(w for i, c in held.items() if toxic[i] == y for w in c) for y in (1, 0))
    weigh = {w: X.apart(a[w], b[w], pos, neg) * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w in known}

    def vector(counts):
        v = {w: (1 + math.log(n)) * weigh[w] for w, n in counts.items() if weigh.get(w, 0) > 0}
        length = math.sqrt(math.fsum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()}

    vectors = {i: vector(c) for i, c in held.items()}
    share = sum(toxic.values()) / len(toxic)
    per = {y: sum(v == y for v in toxic.values()) / n for y, n in ((1, pos), (0, neg))}
    out = {}
    for r in docs:
        q = vector(words(r.text))
        near = sorted(((round(math.fsum(x * v.get(w, 0.0) for w, x in q.items()), 12), i) for i, v in vectors.items()), key=lambda p: -p[0])
        near = [p for p in near if p[0] > 0]
        out[r.doc_id] = None
        if near and (len(near) <= X.NEAREST or near[X.NEAREST - 1][0] - near[X.NEAREST][0] > 1e-9):  # no tie at the border
            votes = [((s / near[0][0]) ** X.SHARPNESS * per[toxic[i]], toxic[i]) for s, i in near[: X.NEAREST]]
            out[r.doc_id] = (sum(v for v, y in votes if y) + X.PRIOR * share) / (sum(v for v, _ in votes) + X.PRIOR)
    return out


@pytest.mark.parametrize("part", ["sf0.001"])
def test_scores_are_those_of_plain_nearest_neighbours(spark, part):
    docs, labels = (spark.read.parquet(f"/root/testdata/{part}/{t}.parquet") for t in ("documents", "labels"))
    want = plain_scores(docs.select("doc_id", "text").collect(), labels.collect())
    got = {r.doc_id: r.score for r in X.score_documents(docs, X.fit(docs, labels)).collect()}
    compared = [(got[i], s) for i, s in want.items() if s is not None]
    assert len(got) == len(want) and len(compared) >= 0.5 * len(want)
    assert all(abs(x - y) < 1e-6 for x, y in compared)


def made_up(spark, n=900):
    rng = np.random.default_rng(8)
    bad = ["idiot", "moron", "trash"]
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.integers(200)}" for _ in range(rng.integers(3, 40))]
        toxic = i % 4 == 0
        if toxic:
            words.insert(int(rng.integers(len(words))), bad[i % 3] + ("s" if i % 5 == 0 else ""))
        rows.append(("s", i, " ".join(words), "p", "a"))
        if i % 7:
            labels.append((i, int(toxic), 1))
    rows += [("s", n, None, "p", "a"), ("s", None, "idiot", "p", "a"), ("s", n + 1, "", None, None), ("s", n + 2, "idiot " * 30_000, "p", "a"), rows[0], rows[0]]
    labels += [(None, 1, 1), (3, None, 1), (4, 1, 0), (4, 1, 0), (10**9, 1, 1)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_scores(spark):
    docs, labels = made_up(spark)
    model = X.fit(docs, labels)
    got = X.score_documents(docs, model).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [(r.predicted, r.doc_id % 4 == 0) for r in got if r.held_out and r.doc_id < 900]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in got}
    assert by[902].predicted == 1 and by[900].predicted == by[901].predicted == 0
    kept = X.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert sorted(map(repr, kept.select("doc_id").collect())) == sorted(f"Row(doc_id={r.doc_id})" for r in got if r.score < 0.5)


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs, labels = made_up(spark, 300)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id as string)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = (X.score_documents(docs, X.fit(docs, x)).select("doc_id", "score").collect() for x in (labels, flipped))
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_nothing_to_learn_from(spark):
    docs, labels = made_up(spark, 50)
    for some in (labels.limit(0), labels.filter("toxic = 1")):
        assert X.score_documents(docs, X.fit(docs, some)).count() == docs.count()
    none = docs.limit(0)
    assert X.score_documents(none, X.fit(none, labels)).count() == 0


@pytest.mark.parametrize("part", ["sf0.01"])
def test_held_out_rows_of_the_tables(spark, part):
    docs, labels = (spark.read.parquet(f"/root/testdata/{part}/{t}.parquet") for t in ("documents", "labels"))
    scored = X.score_documents(docs, X.fit(docs, labels)).filter("held_out")
    rows = scored.join(labels.filter("toxic is not null"), "doc_id").select("predicted", "toxic").collect()
    assert rows and sum(r.predicted == r.toxic for r in rows) >= 0.9 * len(rows)


def test_held_out_toxic_rows_are_found(spark):
    """Accuracy alone would pass with every toxic row missed."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = X.score_documents(docs, X.fit(docs, labels)).filter("held_out")
    rows = scored.join(labels.filter("toxic is not null"), "doc_id").select("predicted", "toxic").collect()
    found = sum(r.predicted for r in rows if r.toxic)
    marked = sum(r.predicted for r in rows if not r.toxic)
    assert found >= 0.85 * sum(r.toxic for r in rows) and marked <= 0.01 * len(rows)
