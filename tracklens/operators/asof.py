"""As-of join: for every asked (key, time) the last observation of that key at or before it.

Both tables are read once and lie side by side in chunks of time per key: a
window over one chunk, in time order with observations before questions of
the same time, gives each question the last observation of its own chunk.
What a chunk without an earlier observation needs comes from an aggregate
with one row per (key, chunk), its last observation, which combines map-side
and is carried over the chunks.  No task holds more than one chunk of one key,
and a key's whole history never meets anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHUNK_US = 3_600_000_000


def asof_join(
    asked: DataFrame, seen: DataFrame, key: str, asked_us: str, seen_us: str, tie: str, values: list[str], chunk_us: int = DEFAULT_CHUNK_US
) -> DataFrame:
    """``asked`` with ``seen_us`` and ``values`` of the last row of ``seen`` with the same ``key`` at or before ``asked_us``.

    Times are microseconds; among observations of one key and time the one
    with the greatest ``tie`` counts.  Without any earlier observation, key or
    time the values are NULL; every asked row comes once.
    """

    def chunk(us: str) -> Column:
        return F.floor(F.col(us) / chunk_us).cast("long")

    told = seen.where(F.col(key).isNotNull() & F.col(seen_us).isNotNull())
    found = F.struct(F.col(seen_us).alias("_at"), *values)
    questions = asked.select(
        F.col(key).alias("_k"), chunk(asked_us).alias("_c"), F.col(asked_us).alias("_t"), F.lit(1).alias("_ask"),
        F.lit(None).alias("_tie"), F.lit(None).alias("_seen"), F.struct(*[F.col(f"`{c}`") for c in asked.columns]).alias("_row"),
    )
    observations = told.select(
        F.col(key).alias("_k"), chunk(seen_us).alias("_c"), F.col(seen_us).alias("_t"), F.lit(0).alias("_ask"), F.col(tie).alias("_tie"),
        found.alias("_seen"), F.lit(None).alias("_row"),
    )
    both = questions.unionByName(observations)

    last = observations.groupBy("_k", "_c").agg(F.max_by("_seen", F.struct("_t", "_tie")).alias("_last"))
    marks = both.select("_k", "_c").distinct().join(last, ["_k", "_c"], "left")
    earlier = Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("_k", "_c", F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))

    upto = Window.partitionBy("_k", "_c").orderBy("_t", "_ask", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("_near", F.last("_seen", ignorenulls=True).over(upto)).where("_ask = 1")
    # a question without a key or a time has no chunk to meet, and stays by the left join
    hit = near.join(carried, ["_k", "_c"], "left").withColumn("_hit", F.coalesce("_near", F.when(F.col("_c").isNotNull(), F.col("_carry"))))
    answered = F.col("_k").isNotNull() & F.col("_t").isNotNull()
    return hit.withColumn("_hit", F.when(answered, F.col("_hit"))).select(
        "_row.*", F.col("_hit._at").alias(seen_us), *[F.col(f"_hit.`{v}`").alias(v) for v in values]
    )
