"""Merkle manifest: trees, proofs and tampering against a plain computation and DuckDB."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest

from tracklens.llm import merkle, queries

SF = "/root/testdata/sf0.001"
KINDS = "doc_id long, source string, lang string, n_chars long, text string, tree string, level int, leaf long"
NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    values = [row[0], row[1], row[2], row[3], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain(rows):
    sources = defaultdict(list)
    for r in rows:
        sources[r[1]].append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r, r[4])))
        trees.append(plain_tree([plain_leaf(r, r[4]) for r in sources[s]]))
    top = plain_tree([t[-1][0] for t in trees])
    out = []
    for j, s in enumerate(names):
        for i, r in enumerate(sources[s]):
            text, proof = r[4], ""
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            fold = plain_leaf(r, text)
            for levels, at in ((trees[j], i), (top, j)):
                for level in levels[:-1]:
                    a = at // 3 * 3
                    before, after = "".join(level[a:at]), "".join(level[at + 1 : a + 3])
                    fold, proof, at = sha(before + fold + after), proof + before + after, at // 3
            root = top[-1][0]
            out.append((r[0], trees[j][0][i], trees[j][-1][0], root, sha(proof), fold, fold == root))
    return out


def key(row):
    return tuple(map(str, row))


def rows_of(sizes):
    """Documents of sources with the given sizes; every third text has a line break."""
    out, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            out.append((i, s, "en", i * 7, f"text {i} é" + "\nline" * (i % 3 == 0), "clash", 5, 9))
            i += 1
    return out


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 1},
        {None: 1, "": 1},
        {"a": 2, "b": 3, "c": 4, "d": 9},
        {"a": 27, "b": 28, None: 81, "é": 82, "z": 10},
        {"hot": 800, "a": 1, "b": 30},
        {f"s{i}": 1 + i % 3 for i in range(40)},
    ],
)
def test_shapes(spark, sizes):
    rows = rows_of(sizes)
    got = merkle.verified(spark.createDataFrame(rows, KINDS).repartition(3))
    assert got.columns == NAMES
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows), key=key)


def test_odd_rows(spark):
    rows = [
        (None, "a", None, None, None, "x", 1, 1),
        (None, "a", "en", 3, "a\nb", "x", 1, 1),
        (2, None, "en", 3, "\n", "x", 1, 1),
        (2, None, "en", 3, "\n", "x", 1, 1),
        (2, None, "en", 3, "other", "x", 1, 1),
        (-4, "-", "en", 0, "", "x", 1, 1),
        (5, "-", "en", 400_000, "long\n" * 80_000, "x", 1, 1),
    ]
    got = merkle.verified(spark.createDataFrame(rows, KINDS)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows), key=key)
    assert merkle.verified(spark.createDataFrame([], KINDS)).collect() == []


def test_any_other_claim_is_found(spark):
    rows = rows_of({"a": 100, "b": 5})
    docs = spark.createDataFrame(rows, KINDS)
    honest = merkle.proofs(merkle.build(docs)).collect()
    assert len(honest) == 105 and all(r.verified for r in honest)
    assert {r.source for r in honest} == {"a", "b"}
    other = merkle.proofs(merkle.build(docs, merkle.digest_of(merkle.F.array(merkle.F.lit("x"))))).collect()
    assert not any(r.verified for r in other) and {r.root for r in other} == {r.root for r in honest}


def test_recursion_is_not_limited(spark):
    old = spark.conf.get(merkle.ROW_LIMIT)
    spark.conf.set(merkle.ROW_LIMIT, "10")
    try:
        assert merkle.verified(spark.createDataFrame(rows_of({"a": 500, "b": 500}), KINDS)).count() == 1000
        assert spark.conf.get(merkle.ROW_LIMIT) == "10"
    finally:
        spark.conf.set(merkle.ROW_LIMIT, old)


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.sql(queries.oracle_sql()["op13_merkle_manifest"])
    assert want.columns == NAMES
    got = queries.merkle_manifest(spark, SF).collect()
    assert sorted(map(tuple, got), key=key) == sorted(want.fetchall(), key=key)
