"""Mixing: targets by hand, words near the targets, repeatable, odd rows."""

from __future__ import annotations

import math
import os
import re

import pytest

from tracklens.llm import mixing

KINDS = "target string, doc_id long, text string, source string, size string"


def sizes_of(rows):
    return [(r[1], r[3], len(re.findall(r"[^\x20\x09-\x0D]+", r[2] or ""))) for r in rows]


def targets(rows):
    total = {}
    for _, s, n in sizes_of(rows):
        total[s] = total.get(s, 0) + n
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full: set = set()
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and left * weight[s] > 3 * total[s] * free}
        if not more:
            return total, {s: 3 * total[s] if s in full else left * weight[s] / free for s in names}
        full |= more


@pytest.fixture(scope="module")
def rows():
    out = [("t", i, "w " * (i * 37 % 91), f"s{i % 7}", "z") for i in range(700)]
    out += [("t", 10_000 + i, "hot words here", "s3", "z") for i in range(900)]  # a hot source of equal texts
    out += [("t", 7, "again and again", "s1", "z")] * 20  # repeated rows
    out += [("t", None, "no id", None, "z"), ("t", 5, None, "s2", "z"), ("t", 6, "", None, "z"), ("t", 8, "  x", "tiny", "z")]
    return out + [("t", 9, "word " * 50_000, "s5", "z"), ("t", 11, None, "none", "z")]


def test_mix(spark, rows):
    got = mixing.mix(spark.createDataFrame(rows, KINDS)).collect()
    total, goal = targets(rows)
    assert len(got) == len(rows)
    taken, source = {}, {}
    for i, s, n in sizes_of(rows):
        source.setdefault((i, n), []).append(s)
    for r in got:
        assert r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0 and 0 <= r.copies <= 3
        fits = [s for s in source[r.doc_id, r.size] if total[s] == r.source_size]
        assert fits and math.isclose(r.target, goal[fits[0]], rel_tol=1e-12)
        taken[r.source_size, r.target] = taken.get((r.source_size, r.target), 0) + r.taken
    for (size, target), words in taken.items():
        alike = sum(total[s] == size and math.isclose(goal[s], target) for s in total)  # sources of equal size and target
        assert abs(words - alike * target) <= 0.02 * target + 3, (size, target, words)


def test_rates_are_tilted_by_size(spark, rows):
    got = mixing.mix(spark.createDataFrame(rows, KINDS)).filter("size > 0 and rate < 3").collect()
    by = {}
    for r in got:
        if r.size <= mixing.LARGE * r.target:  # larger ones are taken whole or not at all
            by.setdefault((r.source_size, r.target), {}).setdefault(r.size, set()).add(r.rate)
    assert by
    for cells in by.values():
        assert all(len(x) == 1 for x in cells.values())
        logs = [(n, math.log(next(iter(x)))) for n, x in sorted(cells.items()) if next(iter(x)) > 1e-4]
        slopes = [(b[1] - a[1]) / (b[0] - a[0]) for a, b in zip(logs, logs[1:], strict=False)]
        assert all(math.isclose(s, slopes[0], rel_tol=1e-2, abs_tol=1e-6) for s in slopes)


def test_reruns_agree(spark, rows):
    df = spark.createDataFrame(rows, KINDS)
    a, b = (sorted(map(tuple, mixing.mix(d).collect()), key=repr) for d in (df, df.repartition(7)))
    assert a == b


def test_mixed_rows(spark, rows):
    df = spark.createDataFrame(rows, KINDS)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    plan = mixing.mix(df).groupBy().sum("copies").first()[0]
    assert out.count() == plan
    assert out.exceptAll(df.union(df).union(df)).count() == 0


def test_empty_tables(spark):
    assert mixing.mix(spark.createDataFrame([], KINDS)).count() == 0
    assert mixing.mixed(spark.createDataFrame([], KINDS)).count() == 0
    blank = mixing.mix(spark.createDataFrame([("t", 1, None, "a", "z"), ("t", 2, "", None, "z")], KINDS)).collect()
    assert [(r.size, r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 2


def test_steps_that_do_not_suffice_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_STEPS", 0)
    docs = spark.createDataFrame([(i, s, "w " * (i + 1)) for i in range(20) for s in ("a", "b")], "doc_id long, source string, text string")
    with pytest.raises(ArithmeticError, match="not balanced"):
        mixing.mix(docs)


def test_mixed_leaves_only_what_it_reads(spark, tmp_path):
    path = f"{spark.conf.get('spark.checkpoint.dir')}"
    rows = [(i // 2, s, "w " * (i % 7 + 1)) for i in range(60) for s in ("a", "b", None)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    before = set(os.listdir(path))
    out = mixing.mixed(spark.read.parquet(str(tmp_path / "docs")))
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(path)) - before}
    assert left == {"mix-takes"}  # a plain scan is not written again, and the solution's tables are gone
    copies = mixing.mix(spark.read.parquet(str(tmp_path / "docs"))).agg({"copies": "sum"}).first()[0]
    assert out.count() == copies and set(out.columns) == {"doc_id", "source", "text"}
