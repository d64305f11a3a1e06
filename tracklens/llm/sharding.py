"""Weighted rendezvous sharding of stable record keys (DataFrame functions only).

Every shard draws a hash-based uniform number per key; the shard with the
smallest ``-ln(u) / weight`` takes the record. A shard's draw depends on the
key and its own number alone, so one more shard takes records only into
itself, and about ``weight / total`` of them.

Defined results: a NULL key is a key like any other (all NULL keys share a
shard); a NULL text counts no bytes and has checksum 0; repeated rows share
a shard and get slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklens.llm.common import in_order, running_before, stage

SHARDS = 16


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard number of ``key`` over ``len(weights)`` shards; equal draws go to the lower number."""

    def draw(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
        return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(weight))

    draws = [F.struct(draw(j, w).alias("d"), F.lit(j).alias("j")) for j, w in enumerate(weights) if w > 0]
    if not draws:
        raise ValueError("one shard at least needs a weight above 0")
    return F.array_min(F.array(*draws))["j"]


def shard_records(
    docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, grown: Sequence[float] | None = None
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, grown_shard`` for every row of ``docs(doc_id, text)``.

    ``slot`` numbers a shard's rows from 0 without gaps, in the order of the
    key's hash. The text is read once; the ranking runs on the narrow staged
    rows, range-partitioned by (shard, hash, ...), so no shard is one task.
    ``_rid`` tells wholly equal rows apart, which spreads repeated keys too.
    """
    grown = list(weights) + [1.0] if grown is None else grown
    narrow = stage(
        docs.select(
            F.col("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
            rendezvous(F.col("doc_id"), weights).alias("shard"),
            rendezvous(F.col("doc_id"), grown).alias("grown_shard"),
            F.xxhash64("doc_id").alias("_h"),
            F.monotonically_increasing_id().alias("_rid"),
        ),
        "shard-rows",
    )
    ordered = in_order(narrow, ["shard", "_h", "doc_id", "text_crc32", "size", "_rid"], "shard-order")
    placed = running_before(ordered, "shard", F.lit(1).cast("long"))
    return placed.select(
        "doc_id", "size", "text_crc32", "shard", F.col("_before").cast("long").alias("slot"), "grown_shard"
    )
