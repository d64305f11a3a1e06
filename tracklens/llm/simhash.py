"""SimHash near-duplicates found through Golay-code fuzzy hashing.

A fingerprint has 64 bits, cut into segments of 22, 21 and 21 bits. Each
segment, padded to 23 bits, is decoded with the perfect (23, 12) Golay code
together with all its one-bit neighbours. This yields one or six codeword
numbers, and two segments that differ in at most two bits always share one:
the word half-way between them is a neighbour of both. Two fingerprints at a
distance of two bits or less agree exactly in one segment (pigeonhole over
three) and are within two bits in the next one, so they meet under the key
(segment, its exact value, codeword number of the next segment).

Fingerprints are made unique first, so copies cost nothing. Buckets are
verified by bit distance. Within large buckets, instead of all pairs, every
fingerprint is listed under its 65 one-bit neighbours; those listed under
the same word are exactly the ones at most two bits apart, so the links kept
(each to the smallest there) connect the same components in linear work.

Defined results: a NULL or blank text has fingerprint 0 and links like any
other; fewer words than a shingle form one shingle; repeated rows appear
once each with the same component; a component's id is its smallest doc_id
that is not NULL (NULL if it has none).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tracklens.llm.common import bitmaps, components, given_out, numbered, row_hashes, scratch, stage

WORDS = 3
MAX_BITS = 2
SEED = 42
#: (lowest bit, width) of the segments
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: generator polynomial of the (23, 12) Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
GENERATOR = 0b101011100011
#: buckets up to this size are compared pair by pair
PAIRWISE = 32
#: buckets beyond this size leave the task and are linked by a distributed grouping
IN_TASK = 50_000
SLICE = 512  # rows turned into Python objects at a time
CHUNK = 1 << 16  # shingles hashed at a time


# ---- fingerprints -------------------------------------------------------


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The 64-bit fingerprint of one UTF-8 text: a bit is 1 if set in over half the shingles' hashes."""
    w = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not w:
        return 0
    if len(w) < words:
        return xxh64_intdigest(b" ".join(w), SEED)
    total, n = np.zeros(64, dtype=np.int64), len(w) - words + 1
    for at in range(0, n, CHUNK):
        part = w[at : at + CHUNK + words - 1]
        grams = zip(*(part[i:] for i in range(words)), strict=False)
        hashes = np.fromiter(map(xxh64_intdigest, map(b" ".join, grams), repeat(SEED)), dtype=np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: list[Column], words: int = WORDS) -> DataFrame:
    """``keep`` and ``fp`` (the fingerprint as a signed long) for every row of ``docs`` with its ``text``."""
    rows = docs.select(*keep, F.encode("text", "UTF-8").alias("_text"))
    out = rows.drop("_text").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                fps = [fingerprint(t, words) for t in part.column(part.num_columns - 1).to_pylist()]
                fp = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], fp], names=[*part.schema.names[:-1], "fp"])

    return rows.mapInArrow(run, out)


# ---- Golay keys ---------------------------------------------------------


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each single bit, and the error word of at most three bits behind each syndrome."""

    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    single = np.array([syndrome(1 << i) for i in range(23)], dtype=np.int64)
    errors = np.zeros(1 << 11, dtype=np.int64)
    for i in range(23):
        errors[single[i]] = 1 << i
        for j in range(i):
            errors[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                errors[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    return single, errors


def codewords(segment: np.ndarray, width: int) -> np.ndarray:
    """(rows, 1 + width): codeword numbers that ``segment`` and its one-bit neighbours decode to."""
    single, errors = golay_tables()
    own = np.zeros_like(segment)
    for i in range(width):
        own ^= (segment >> i & 1) * single[i]
    out = np.empty((len(segment), width + 1), dtype=np.int64)
    out[:, 0] = (segment ^ errors[own]) >> 11
    for i in range(width):
        out[:, i + 1] = (segment ^ (1 << i) ^ errors[own ^ single[i]]) >> 11
    return out


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and bucket keys: (segment number, its exact value, codeword number of the next segment)."""
    words = fps.view(np.uint64)
    segments = [(words >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    rows, keys = [], []
    for i, exact in enumerate(segments):
        j = (i + 1) % len(SEGMENTS)
        code = np.sort(codewords(segments[j], SEGMENTS[j][1]), axis=1)
        fresh = np.ones(code.shape, dtype=bool)
        fresh[:, 1:] = code[:, 1:] != code[:, :-1]
        r, c = np.nonzero(fresh)
        rows.append(r)
        keys.append((i << 40) | (exact[r] << 12) | code[r, c])
    return np.concatenate(rows), np.concatenate(keys)


# ---- links --------------------------------------------------------------


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def _near(key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs at most ``max_bits`` apart in runs of equal ``key``; runs are short."""
    a, b = [], []
    for step in range(1, len(key)):
        same = np.nonzero(key[step:] == key[:-step])[0]
        if not len(same):
            break
        near = same[_bits(fp[same] ^ fp[same + step]) <= max_bits]
        a.append(fp[near])
        b.append(fp[near + step])
    empty = np.empty(0, dtype=np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _halfway(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all fingerprints at most two bits apart: each to the smallest that shares a neighbour word."""
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    words = (fp.view(np.uint64)[:, None] ^ flips[None, :]).ravel()
    owner = np.repeat(fp, 65)
    order = np.lexsort((owner, words))
    words, owner = words[order], owner[order]
    start = np.concatenate([[True], words[1:] != words[:-1]])
    first = owner[np.maximum.accumulate(np.where(start, np.arange(len(words)), 0))]
    link = np.unique(np.stack([first, owner])[:, first != owner], axis=1)
    return link[0], link[1]


def _bucket_links(max_bits: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("left", pa.bool_())])

    def rows(a: np.ndarray, b: np.ndarray, left: bool = False) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), left))], schema=schema)

    def settle(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``key`` is sorted and its runs are whole."""
        start = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]])
        size = np.diff(start)
        short = np.repeat((size > 1) & (size <= PAIRWISE), size)
        yield rows(*_near(key[short], fp[short], max_bits))
        for i in np.nonzero(size > PAIRWISE)[0]:
            group = fp[start[i] : start[i + 1]]
            if max_bits == 2:
                yield rows(*_halfway(group))
            else:
                for at in range(1, len(group)):
                    near = group[at:][_bits(group[at:] ^ group[at - 1]) <= max_bits]
                    yield rows(np.full(len(near), group[at - 1]), near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        large = None  # the key of a bucket whose rows are passed on as they come
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy()])
            if not len(key):
                continue
            if large is not None:
                n = int(np.searchsorted(key, large, side="right"))
                yield rows(fp[:n], key[:n], True)
                key, fp = key[n:], fp[n:]
                if not len(key):
                    continue
                large = None
            last = int(np.searchsorted(key, key[-1], side="left"))
            yield from settle(key[:last], fp[:last])
            key, fp = key[last:], fp[last:]
            if len(key) > IN_TASK and max_bits == 2:
                large = key[-1]
                yield rows(fp, key, True)
                key, fp = key[:0], fp[:0]
        if len(key):
            yield from settle(key, fp)

    return run


def near_links(unique: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``a, b``: links that connect all fingerprints of ``unique(fp)`` at most ``max_bits`` (0 to 2) bits apart."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the three segments and their keys are exact for distances of 0 to 2 bits")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for at in range(0, len(fps), 8192):
                part = fps[at : at + 8192]
                r, key = golay_keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[r])], names=["key", "fp"])

    buckets = unique.select("fp").mapInArrow(keyed, "key long, fp long").repartition("key")
    found = stage(
        buckets.sortWithinPartitions("key", "fp").mapInArrow(_bucket_links(max_bits), "a long, b long, left boolean"),
        "simhash-links",
    )
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) if i < 63 else -(1 << 63)) for i in range(64)])
    spread = (
        found.filter("left")
        .select(F.col("a").alias("fp"))
        .distinct()
        .select("fp", F.explode(flips).alias("flip"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
        .groupBy("word")
        .agg(F.collect_set("fp").alias("fps"))  # 65 at most: the words one bit off
        .filter(F.size("fps") > 1)
        .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
        .filter("a <> b")
    )
    return found.filter("not left").select("a", "b").union(spread).distinct()


def with_roots(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``rows(doc_id, fp, ...)`` with ``root`` (a fingerprint that stands for the row's component) and
    ``component_id`` (the smallest doc_id in it)."""
    unique = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-unique")
    roots = components(near_links(unique, max_bits), "simhash")
    rooted = unique.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    member = rooted.join(smallest, "root").select(F.col("fp").alias("_fp"), "root", "component_id")
    return rows.join(member, F.col("fp") == F.col("_fp")).drop("_fp")


def simhash_groups(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits)``, component_id`` for every row of ``docs(doc_id, text)``."""
    rows = stage(fingerprints(docs, [F.col("doc_id")], words), "simhash-rows")
    return with_roots(rows, max_bits).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_per_group(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest doc_id (NULL last).

    Among rows with that doc_id, two hashes of all columns decide. Rows are
    known by their place in the files, so the texts are read twice, for their
    fingerprints and to be given out, and cross no network as long as the
    bitmaps of the kept rows can be broadcast. Rows of a file that is read
    twice are the only ones taken apart by a grouping, and only if there are any.
    """
    held = numbered(docs, "simhash-held")
    h1, h2 = row_hashes(held)
    texts = held.select(
        "_rid", h1.alias("_h1"), h2.alias("_h2"), F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text")
    )
    keys = [F.col("doc_id"), F.col("_h1"), F.col("_h2"), F.col("_rid")]
    with scratch() as keep:
        rows = stage(fingerprints(texts, keys, words), "simhash-rows")
        alike = rows.groupBy("doc_id", "fp", "_h1", "_h2", "_rid").agg(F.count("*").alias("n"))
        first = F.struct(F.col("doc_id").isNull(), "doc_id", "_h1", "_h2", "_rid", "n")
        best = stage(with_roots(alike, max_bits).groupBy("root").agg(F.min(first).alias("k")).select("k._rid", "k.n"), "simhash-best")
        marks = bitmaps(best.filter("n = 1").select("_rid", F.lit(1).alias("copies")))
        kept = given_out(held, keep(stage(marks, "simhash-kept")))
        equal = best.filter("n > 1")
        if equal.head(1):
            keep(best)
            some = held.join(equal, "_rid", "left_semi").groupBy("_rid").agg(F.first("_row").alias("_row"))
            kept = kept.union(some.select("_row.*"))
    return kept
