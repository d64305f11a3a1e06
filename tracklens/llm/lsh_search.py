"""Nearest vectors by multiprobe p-stable hashing.

Vectors are scaled to length 1, where the order by Euclidean distance is the
order by cosine. A table draws Gaussian (2-stable) directions; a hash is the
number of the slot of width ``WIDTH`` that a projection falls in, and a
table's hashes together name a bucket. The number of hashes follows the
number of vectors, so that buckets hold about ``BUCKET`` of them.

A query visits perturbed buckets in the order of their estimated success: a
neighbour at cosine c projects to ``c * f + sqrt(1 - c^2) * N(0, 1)`` if the
query projects to f, which gives each slot its probability and each bucket
the product. It goes on until the probabilities add up to ``SUCCESS`` per
table, for c and for cosines between c and 1. There are two rounds. In the
first, c is the typical cosine of the nearest vector in a bounded sample
(``SAMPLE``). In the second, each query has its own c, the cosine of the
last of its k answers so far, which is at most that of its true k-th; a
query with fewer than k answers visits all buckets.

All candidates of a bucket are ranked by the exact cosine in double
precision; the best of all tables' buckets are merged. Buckets and the
queries for them travel as packed blocks, so that a very full bucket is
several rows. Equal vectors are one candidate that carries its K + 1
smallest ids, which is all that ties can need: nothing is lost.

Defined results: unusable vectors (NULL, empty, zero, NULL or non-finite
components) and NULL ids neither ask nor answer; vectors of another length
are no candidates; rows with the same id and vector count once; with fewer
candidates than asked for all those found are returned.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracklens.llm.common import stage
from tracklens.llm.vectors import matrix, unit, usable, with_hashes

NEAREST = 5
QUERY_STEP = 50
TABLES = 2
WIDTH = 3.0
BUCKET = 512
SUCCESS = 0.8  # per table
RUNGS = 4  # cosines from c on, each half as far from 1 as the one before
SALTS = 64  # parts that the buckets of a length come in where queries visit all
SAMPLE = 2048  # vectors that the typical neighbour's cosine is taken from, at most
BLOCK = 1024  # vectors of a packed row, at most
QUERY_BLOCK = 256
SEED = 20


@lru_cache(maxsize=64)
def directions(table: int, dim: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """A table's directions and offsets."""
    rng = np.random.default_rng((SEED, table, dim))
    return rng.standard_normal((dim, hashes)), rng.random(hashes) * WIDTH


def hashes_for(n: int, bucket: int = BUCKET) -> int:
    """Each hash tells about two slots apart."""
    return max(0, min(24, round(math.log2(max(1, n) / bucket))))


def bucket_names(slots: np.ndarray) -> np.ndarray:
    """One 64-bit name per row of slot numbers."""
    name = np.zeros(len(slots), dtype=np.uint64)
    for column in slots.T.astype(np.int64).view(np.uint64):
        name = (name ^ column) * np.uint64(0x9E3779B97F4A7C15)
        name ^= name >> np.uint64(29)
    return name.view(np.int64)


def slots_of(x: np.ndarray, table: int, hashes: int) -> np.ndarray:
    a, b = directions(table, x.shape[1], hashes)
    return np.floor((x @ a + b) / WIDTH)


def probes(q: np.ndarray, table: int, hashes: int, cosine: float, success: float = SUCCESS) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the buckets to visit and their estimated success, best first, until ``success`` is reached."""
    a, b = directions(table, len(q), hashes)
    centre, spread = cosine * (q @ a) + b, max(1e-6, math.sqrt(max(0.0, 1 - cosine * cosine)))
    at, p = np.zeros((1, 0)), np.ones(1)
    for i in range(hashes):
        low, high = (math.floor((centre[i] + s * 3.5 * spread) / WIDTH) for s in (-1, 1))
        edge = np.arange(low, high + 2) * WIDTH
        below = np.array([0.5 * (1 + math.erf((e - centre[i]) / spread / math.sqrt(2))) for e in edge])
        below[0], below[-1] = 0.0, 1.0
        slot = np.diff(below)
        p = (p[:, None] * slot[None, :]).ravel()
        at = np.concatenate([np.repeat(at, len(slot), axis=0), np.tile(np.arange(low, high + 1.0), len(at))[:, None]], axis=1)
        order = np.argsort(-p, kind="stable")
        # what is left out here is so improbable that the rest still reaches the success asked for
        enough = np.searchsorted(np.cumsum(p[order]), 1 - (1 - success) * (i + 1) / (4 * hashes)) + 1
        at, p = at[order[:enough]], p[order[:enough]]
    n = int(np.searchsorted(np.cumsum(p), success)) + 1
    return at[:n], p[:n]


def visited(q: np.ndarray, table: int, hashes: int, cosine: float) -> np.ndarray:
    """Names of the buckets to visit for neighbours at ``cosine`` and nearer, equal vectors included."""
    c = min(0.999, max(-0.999, cosine))
    ladder = [*(1 - (1 - c) / 2**i for i in range(RUNGS)), 1.0]
    return np.unique(np.concatenate([bucket_names(probes(q, table, hashes, x)[0]) for x in ladder]))


def typical_cosine(classes: DataFrame, sample: int = SAMPLE) -> float:
    """Median cosine of the nearest other vector within a sample of at most ``sample`` vectors of one length."""
    rows = classes.select("dim", "embedding").orderBy(F.xxhash64(F.lit(3), "h1", "h2"), "h1", "h2").limit(sample).collect()
    if len(rows) < 2:
        return 0.5
    dims = [r["dim"] for r in rows]
    dim = max(set(dims), key=dims.count)
    x = unit(np.array([r["embedding"] for r in rows if r["dim"] == dim], dtype=np.float64))
    if len(x) < 2:
        return 0.5
    near = x[:: max(1, len(x) // 256)] @ x.T
    near[near > 1 - 1e-9] = -1
    return float(np.clip(np.median(near.max(axis=1)), 0.05, 0.999))


def _blocks(by: int, most: int):
    """Packs rows that are sorted by their first ``by`` columns: up to ``most`` rows of equal keys become one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if held:
                blob = pickle.dumps([np.concatenate([h[i] for h in held]) for i in range(len(held[0]))])
                yield pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(key, kinds, strict=True)), pa.array([blob])], names=[*names[:by], "block"])
            held, size = [], 0

        names: list[str] = []
        kinds: list[pa.DataType] = []
        for batch in batches:
            names, kinds = batch.schema.names, batch.schema.types[:by]
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(by)], axis=1)
            cut = np.concatenate([[0], np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1, [len(keys)]]).tolist()
            for lo, hi in zip(cut, cut[1:], strict=False):
                now = tuple(keys[lo].tolist())
                if now != key:
                    yield from flush()
                    key = now
                while lo < hi:
                    part = batch.slice(lo, min(hi - lo, most - size))
                    cid = part.column(by).to_numpy()
                    dim = now[0]
                    ids = part.column(by + 1).to_pylist()
                    held.append((cid, matrix(part.column(by + 2), dim), np.array([x[0] for x in ids])))
                    size += len(cid)
                    lo += len(cid)
                    if size == most:
                        yield from flush()
        yield from flush()

    return run


def _keyed(hashes: int):
    """Every vector under its bucket of every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = unit(matrix(part.column(3), int(dim)))
                for table in range(TABLES):
                    name = bucket_names(slots_of(x, table, hashes))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), dim, dtype=np.int32)), pa.array(np.full(len(x), table, dtype=np.int32)), pa.array(name), *part.columns[1:]],
                        names=["dim", "tbl", "bucket", "cid", "ids", "embedding"],
                    )

    return run


def _probing(hashes: int, cosine: float):
    """Every query under the buckets that it visits first or, with a cosine of its own (5th column), those it visits besides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column(0)[i].as_py()
                q = unit(matrix(batch.column(3).slice(i, 1), dim))[0]
                for table in range(TABLES):
                    name = visited(q, table, hashes, cosine)
                    if batch.num_columns > 4:
                        name = np.setdiff1d(visited(q, table, hashes, batch.column(4)[i].as_py()), name)
                    take = pa.array(np.full(len(name), i))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(name), dim, dtype=np.int32)), pa.array(np.full(len(name), table, dtype=np.int32)), pa.array(name), *(batch.column(c).take(take) for c in (1, 2, 3))],
                        names=["dim", "tbl", "bucket", "cid", "ids", "embedding"],
                    )

    return run


def _ranked(k: int):
    """The k + 1 best candidates of each query in one bucket block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cid, x, low = pickle.loads(batch.column(0)[i].as_py())
                q_id, q, _ = pickle.loads(batch.column(1)[i].as_py())
                score = np.clip(unit(q) @ unit(x).T, -1.0, 1.0)
                take = min(k + 1, len(cid))
                order = np.lexsort((np.broadcast_to(low, score.shape), -score), axis=1)[:, :take]
                rows = np.repeat(np.arange(len(q_id)), take)
                cols = order.ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_id[rows]), pa.array(cid[cols]), pa.array(score[rows, cols]), pa.array(low[cols])], names=["qid", "cid", "score", "low"]
                )

    return run


def nearest_vectors(vectors: DataFrame, is_query: Column, k: int = NEAREST, bucket: int = BUCKET) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest other rows of each row of ``vectors`` that ``is_query`` picks."""
    rows = with_hashes(
        vectors.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("asks")).filter(
            usable(F.col("embedding")) & F.col("vec_id").isNotNull()
        )
    )
    once = rows.groupBy("dim", "h1", "h2", "vec_id").agg(F.max("asks").alias("asks"), F.first("embedding").alias("embedding"))
    by_class = Window.partitionBy("dim", "h1", "h2").orderBy("vec_id")
    asking = once.filter("asks").select("dim", "h1", "h2", F.col("vec_id").alias("query_id"))
    few = once.withColumn("rn", F.row_number().over(by_class)).filter(F.col("rn") <= k + 1)
    grouped = few.groupBy("dim", "h1", "h2").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("embedding").alias("embedding")
    )
    classes = stage(grouped.withColumn("cid", F.monotonically_increasing_id()), "lsh-classes")
    n, cosine = classes.count(), typical_cosine(classes)
    hashes = hashes_for(n, bucket)
    keyed = "dim int, tbl int, bucket long, cid long, ids array<long>, embedding array<double>"
    packed = "dim int, tbl int, bucket long, block binary"
    slim = ["dim", "cid", "ids", F.col("embedding").cast("array<double>").alias("embedding")]
    at = ["dim", "tbl", "bucket"]
    index = classes.select(slim).mapInArrow(_keyed(hashes), keyed)
    asked = classes.join(asking.select("dim", "h1", "h2").distinct(), ["dim", "h1", "h2"], "left_semi")
    blocks = stage(index.repartition(*at).sortWithinPartitions(*at).mapInArrow(_blocks(3, BLOCK), packed), "lsh-index")
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), "low")

    def scored(visits: DataFrame, name: str) -> DataFrame:
        asks = stage(visits.repartition(*at).sortWithinPartitions(*at).mapInArrow(_blocks(3, QUERY_BLOCK), packed), name)
        met = asks.withColumnRenamed("block", "queries").join(blocks, at).select("block", "queries")
        return met.mapInArrow(_ranked(k), "qid long, cid long, score double, low long")

    def top_of(scores: DataFrame) -> DataFrame:
        once = scores.groupBy("qid", "cid", "low").agg(F.max("score").alias("score"))
        return once.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k + 1).drop("rn")

    visits = asked.select(slim).repartition("cid").mapInArrow(_probing(hashes, cosine), keyed)
    first = stage(top_of(scored(visits, "lsh-visits")), "lsh-first")
    so_far = F.sum(F.size("ids")).over(best.rowsBetween(Window.unboundedPreceding, 0))
    reached = (
        first.join(classes.select("cid", "ids"), "cid")
        .withColumn("so_far", so_far)
        .groupBy("qid")
        .agg(F.max(F.when(F.col("so_far") > k, F.col("score"))).alias("cosine"))  # a query's own row is no answer
    )
    own = asked.select(slim).join(reached, F.col("cid") == F.col("qid"), "left").drop("qid")
    besides = own.filter("cosine IS NOT NULL").repartition("cid").mapInArrow(_probing(hashes, cosine), keyed)
    every = blocks.filter("tbl = 0").select(*at).distinct().withColumn("salt", F.pmod(F.xxhash64("bucket"), F.lit(SALTS)))
    short_of = own.filter("cosine IS NULL").drop("cosine").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    everywhere = short_of.join(every, ["dim", "salt"]).select(*at, "cid", "ids", "embedding")
    second = scored(besides.unionByName(everywhere), "lsh-visits-2")
    top = top_of(first.select("qid", "cid", "score", "low").unionByName(second))
    answer = top.join(classes.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "vec_id")
    short = stage(answer.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k + 1), "lsh-best")
    ask = asking.join(classes.select("dim", "h1", "h2", F.col("cid").alias("qid")), ["dim", "h1", "h2"]).select("query_id", "qid")
    final = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        ask.join(short.drop("rn"), "qid")
        .filter("query_id <> vec_id")
        .withColumn("rank", F.row_number().over(final).cast("int"))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
