"""Importance resampling: hashes, interning, gains, draw and ranks against a plain computation."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tracklens.llm import queries
from tracklens.llm import resample as R

SF = "/root/testdata/sf0.001"
KINDS = "score string, text string, rank string, doc_id long, bucket int, weight double"


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_features(text):
    w = plain_words(text)
    return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def plain(docs, target):
    own, aim = (Counter(bucket(f) for t in texts for f in plain_features(t)) for texts in ([t for _, t in docs], target))
    s, t = sum(own.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s + 10_000) / ((own[b] + 1) * (t + 10_000)))) for b in range(10_000)]
    rows = []
    for doc_id, text in docs:
        f = plain_features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(f), weight, score, None, len(plain_words(text))])
    ranked = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(ranked[: 5 * len(ranked) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in rows]


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    words = ["the", "Of", "naïve", "漢字", "x9", "A" * 40, "sun", "moon", "a", "42", "É"]
    out = ["".join(rng.choice(words) + rng.choice([" ", ", ", "\n\n", "-", "_", " \x00"]) for _ in range(rng.randint(0, 80))) for _ in range(200)]
    return [None, "", "  ", "...", "one", "two words", "no-space" * 3, *out, out[0], out[0]]


def test_hashes_and_checksums():
    rng = random.Random(1)
    raw = bytes(rng.randrange(256) for _ in range(5000))
    buffer = np.concatenate((np.frombuffer(raw, dtype=np.uint8), np.zeros(40, dtype=np.uint8)))
    size = np.array([rng.randrange(0, 150) for _ in range(2000)])
    at = np.array([rng.randrange(0, 4800) for _ in range(2000)])
    for seed in (0, 42):
        want = [xxhash.xxh64_intdigest(raw[a : a + n], seed) for a, n in zip(at, size, strict=True)]
        assert R.slice_hashes(buffer, at, size, seed).tolist() == want
    assert R.slice_checksums(buffer, at, size).tolist() == [zlib.crc32(raw[a : a + n]) for a, n in zip(at, size, strict=True)]


@pytest.mark.parametrize("limit", [R.PIECE, 64, 7, 1])
def test_words_and_grams_in_any_pieces(texts, limit):
    got = [Counter() for _ in texts]
    n = [0] * len(texts)
    for words, fresh in R.pieces(pa.array([t or "" for t in texts]).slice(0), limit):
        raw = words.buffer.tobytes()
        for d in words.doc if fresh is None else words.doc[fresh]:
            n[d] += 1
        for a, size, d in zip(*words.grams(3, fresh), strict=True):
            got[d][raw[a : a + size].decode()] += 1
    assert got == [Counter(plain_features(t)) for t in texts]
    assert n == [len(plain_words(t)) for t in texts]


def test_a_slice_of_an_arrow_array(texts):
    column = pa.array([t or "" for t in texts])
    words, _ = next(R.pieces(column.slice(20, 30)))
    assert Counter(words.doc.tolist()) == Counter(i for i, t in enumerate(texts[20:50]) for _ in plain_words(t))


@pytest.mark.parametrize("keys", ["own", "one", "few"])
def test_equal_keys_are_told_apart_by_their_bytes(texts, keys):
    words, _ = next(R.pieces(pa.array(["\n".join(t or "" for t in texts)])))
    at, size, _ = words.grams(3)
    at, size = at[-1500:], size[-1500:]
    forced = {"own": None, "one": np.zeros(len(at), dtype=np.uint64), "few": (size % 3).astype(np.uint64)}[keys]
    table = R.Interned(words.buffer, at, size, 10_000, forced)
    raw = words.buffer.tobytes()
    grams = [raw[a : a + n] for a, n in zip(at, size, strict=True)]
    assert len(set(zip(grams, table.slot.tolist(), strict=True))) == len(set(grams)) == len(set(table.slot.tolist()))
    count = Counter(grams)
    assert all(table.count[s] == count[g] and table.bucket[s] == zlib.crc32(g) % 10_000 for g, s in zip(grams, table.slot, strict=True))


def test_resample(spark, texts):
    rows = [("clash", t, "clash", i // 2 if i % 7 else None, 1, 0.5) for i, t in enumerate(texts)]
    rows += [("clash", "sun moon " * 200_000, "clash", 10**9, 1, 0.5)]  # one very long text
    target = ["the sun, the moon", None, "", "Naïve naïve naïve sun"]
    docs = spark.createDataFrame(rows, KINDS).repartition(4)
    got = R.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = plain([(r[3], r[1]) for r in rows], target)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_empty(spark):
    none, some = spark.createDataFrame([], KINDS), spark.createDataFrame([("a", "b c", "d", 1, 1, 0.0)], KINDS)
    assert R.resample(none, some).collect() == []
    (row,) = R.resample(some, none).collect()
    assert tuple(row)[:3] == (1, 3, 3 * math.floor(1000 * math.log(10_003 / 20_000))) and row.rank is None


def test_query(spark):
    docs, target = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([tuple(r) for r in docs.select("doc_id", "text").collect()], [r.text for r in target.select("text").collect()])
    got = queries.target_resampling(spark, SF)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
