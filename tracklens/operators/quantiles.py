"""Exact quantiles of unrounded values by refining histograms.

A quantile between two order statistics needs the values of two ranks.  Every
wanted rank starts with the range of all values of its group.  In each round
the values inside a range fall into ``BINS`` equal bins, each with its count,
smallest and largest value; the bin that holds the rank becomes its new
range, from its smallest to its largest value, until the two are equal.  A
round separates at least the ends of a range, so it always comes to an end;
values spread over many orders of magnitude take a few rounds more.

State is at most ``BINS`` rows per wanted rank, however many values there are,
and all values of one group combine map-side into them: neither a large group
nor many equal values meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklens.session import scratch_dir, stage_table, unstage

BINS = 4096


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Number of the equal bin of ``x`` between ``lo`` and ``hi``; never falls while ``x`` grows.

    A width beyond all doubles is taken from halves, which can't overflow.
    """
    wide = (hi - lo) == float("inf")
    share = F.when(wide, F.try_divide(x / 2 - lo / 2, hi / 2 - lo / 2)).otherwise(F.try_divide(x - lo, hi - lo))
    return F.when(lo == hi, F.lit(0)).otherwise(F.least(F.floor(share * bins), F.lit(bins - 1)))


def order_statistics(values: DataFrame, ranks: DataFrame, bins: int = BINS) -> DataFrame:
    """``grp, rank, value``: the value of each ``ranks(grp, rank)``, counted from 0, among ``values(grp, x)`` of its group.

    ``values`` is read once per round: stage what is dear to compute.  NULL
    and NaN must be left out before; a NULL group is a group.
    """
    spark, base = values.sparkSession, scratch_dir(values.sparkSession)
    ends = values.groupBy("grp").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.col("grp").eqNullSafe(F.col("_g"))
    state = stage_table(
        ranks.select("grp", "rank", F.col("rank").alias("left")).join(ends.withColumnRenamed("grp", "_g"), at).drop("_g"), "ranks", base
    )
    while not state.where("lo < hi").isEmpty():
        ranges = state.where("lo < hi").select(F.col("grp").alias("_g"), "lo", "hi").distinct()
        inside = values.join(ranges, at & F.col("x").between(F.col("lo"), F.col("hi")))
        cells = inside.groupBy("grp", "lo", "hi", _bin(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min("x").alias("new_lo"), F.max("x").alias("new_hi")
        )
        upto = Window.partitionBy("grp", "lo", "hi").orderBy("bin")  # one range's bins, BINS at most
        steps = cells.withColumn("upto", F.sum("n").over(upto)).select(
            F.col("grp").alias("_g"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), (F.col("upto") - F.col("n")).alias("before"),
            "upto", "new_lo", "new_hi",
        )
        same = at & (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi"))
        hit = (F.col("left") >= F.col("before")) & (F.col("left") < F.col("upto"))
        found = state.where("lo < hi").join(steps, same & hit).select(
            "grp", "rank", (F.col("left") - F.col("before")).alias("left"), F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi")
        )
        old, state = state, stage_table(state.where("lo = hi").union(found), "ranks", base)
        unstage(old)
    return state.select("grp", "rank", F.col("lo").alias("value"))


def exact_quantiles(df: DataFrame, group: str, value: str, probs: list[float], bins: int = BINS) -> DataFrame:
    """``group, count, min, max, quantiles`` (an array as ``probs``), interpolated linearly between order statistics.

    Values that are NULL or not finite are left out; a group without any
    other has no row.
    """
    x = F.col(value).cast("double")
    kept = df.select(F.col(group).alias("grp"), x.alias("x")).where(F.abs("x") < float("inf"))
    held = stage_table(kept, "values", scratch_dir(df.sparkSession))
    totals = held.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("min"), F.max("x").alias("max"))
    places = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("n") - 1)).alias("pos")) for i, p in enumerate(probs)])
    wanted = totals.select("grp", F.inline(places)).select(
        "grp", "i", "pos", F.floor("pos").cast("long").alias("below"), F.ceil("pos").cast("long").alias("above")
    )
    ranks = wanted.select("grp", F.explode(F.array("below", "above")).alias("rank")).distinct()
    stats = order_statistics(held, ranks, bins)

    def at(rank: str, name: str) -> DataFrame:
        return stats.select(F.col("grp").alias("_g"), F.col("rank").alias(rank), F.col("value").alias(name))

    def match(rank: str, other: str) -> Column:
        return F.col("grp").eqNullSafe(F.col("_g")) & (F.col(rank) == F.col(other))

    both = wanted.join(at("_r", "a"), match("below", "_r")).drop("_g", "_r").join(at("_r", "b"), match("above", "_r")).drop("_g", "_r")
    between = F.col("a") + (F.col("b") - F.col("a")) * (F.col("pos") - F.col("below"))
    per_group = both.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", between.alias("v")))), lambda q: q["v"]).alias("q"))
    joined = totals.join(per_group.withColumnRenamed("grp", "_g"), F.col("grp").eqNullSafe(F.col("_g")))
    return joined.select(F.col("grp").alias(group), F.col("n").alias("count"), "min", "max", F.col("q").alias("quantiles"))
