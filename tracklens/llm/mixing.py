"""Mixing sources to target weights by entropy balancing.

Targets: sources (by code point, NULL last) weigh 1, 2, 3 in turn and share
the size of all texts; no target exceeds ``MAX_COPIES`` times its source's
size, and what is cut off goes to the other sources by weight (water level).

Rates: among all document rates r in [0, MAX_COPIES] whose words add up to
the source's target, the entropy-balanced ones minimise the sum of
``r ln r - r``. Convex duality gives ``r = min(MAX_COPIES, exp(m * x))`` with
one multiplier m per source and x the document's size over its source's mean.
Newton steps solve the dual: one distributed sum per step over the table of
(source, size, count), the multipliers being a table themselves. Rates are
64-bit fixed-point numbers and all sums are whole numbers, so reruns agree.

Copies: documents are put in order of (source, size, hash of doc_id); a
document gets as many copies as whole numbers are passed by the running sum
of its source's rates. Neighbours in that order are of a size, so the words
taken miss the target by little more than one document. A few documents per
source then get one copy more or less, which evens out what is left.

Defined results: NULL texts have size 0; rate and copies of empty documents
follow the same rule, but take no words; a source without words has target 0;
repeated rows are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklens.llm.common import bitmaps, given_out, in_order, numbered, running_before, scratch, stage, unstage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
ONE = 1 << 30  # a rate of 1
HALF = 1 << 29
MAX_STEPS = 100
EVEN_ROUNDS = 3
LARGE = 0.01  # share of a target from which a document is large
#: a source's words are balanced when they miss its target by less than this share
CLOSE = 1e-6


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, docs, source_size, target, full`` per source; ``full``: the target is the most it can give."""
    per = stage(sizes.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("size") * F.col("n")).alias("source_size")), "mix-sources")
    ordered = in_order(per.withColumn("_last", F.col("source").isNull()), ["_last", "source"], "mix-order")
    ranked = running_before(ordered.withColumn("_all", F.lit(0)), "_all", F.lit(1))
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("_before") % len(weights) + 1).cast("int"))
    weighed = stage(ranked.select("source", "docs", "source_size", turn.alias("weight")), "mix-weights")
    cap = F.col("source_size") * MAX_COPIES
    total, shares = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = Fraction(total, shares) if shares else Fraction(0)
    while True:  # the level only rises, and stops at the latest when all sources but one are full
        over = cap * F.lit(level.denominator).cast("decimal(38,0)") < F.col("weight") * F.lit(level.numerator).cast("decimal(38,0)")
        fixed, free = weighed.agg(
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0)), F.coalesce(F.sum(F.when(over, 0).otherwise(F.col("weight"))), F.lit(0))
        ).first()
        new = Fraction(total - fixed, free) if free else level
        if new == level:
            break
        level = new
    share = F.col("weight") * F.lit(level.numerator).cast("double") / F.lit(level.denominator).cast("double")
    full = cap.cast("double") <= share
    return weighed.select(
        "source", "docs", "source_size", F.when(full, cap.cast("double")).otherwise(share).alias("target"), full.alias("full")
    )


def rate(size: Column, source_size: Column, docs: Column, multiplier: Column, full: Column) -> Column:
    """A document's rate as a fixed-point number."""
    tilted = F.exp(F.least(multiplier * size * docs / F.greatest(source_size, F.lit(1)), F.lit(2.0)))
    most = F.lit(float(MAX_COPIES))
    return F.round(F.when(full, most).otherwise(F.least(tilted, most)) * ONE).cast("long")


def solve_rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with each source's ``multiplier``: bracketed Newton steps on the dual.

    A bracket is halved at least, so ``MAX_STEPS`` are more than any source
    takes; a source that is not solved by then is an error.
    """
    start = {"multiplier": F.lit(0.0), "low": F.lit(float("-inf")), "high": F.lit(float("inf")), "done": F.col("full") | (F.col("target") <= 0)}
    state = stage(targets.withColumns(start), "mix-dual")
    cells = sizes.withColumnRenamed("source", "_s")
    for _ in range(MAX_STEPS):
        if not state.filter("not done").head(1):
            break
        x = F.col("size") * F.col("docs") / F.col("source_size")
        r = rate(F.col("size"), F.col("source_size"), F.col("docs"), F.col("multiplier"), F.col("full"))
        words = (F.col("n") * F.col("size")).cast("decimal(19,0)") * r.cast("decimal(19,0)")
        slope = F.when(r < MAX_COPIES * ONE, words * F.round(x * (1 << 20)).cast("decimal(19,0)")).otherwise(0)
        sums = (
            cells.join(state.filter("not done"), F.col("_s").eqNullSafe(F.col("source")))
            .groupBy("_s")
            .agg(F.sum(words).cast("double").alias("words"), F.sum(slope).cast("double").alias("slope"))
        )
        miss = F.col("words") / ONE - F.col("target")
        low = F.when(miss < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(miss >= 0, F.col("multiplier")).otherwise(F.col("high"))
        newton = F.col("multiplier") - miss / (F.col("slope") / ONE / (1 << 20))
        far = (F.col("slope") <= 0) | (newton <= low) | (newton >= high)
        middle = (
            F.when(low == float("-inf"), F.least(high * 2, high - 1.0))
            .when(high == float("inf"), F.greatest(low * 2, low + 1.0))
            .otherwise((low + high) / 2)
        )
        step = F.when(far, middle).otherwise(newton)
        close = (F.abs(miss) <= F.col("target") * CLOSE) | (((high - low) <= 1e-12 * F.abs(high)) & (high < float("inf")))
        live = F.col("words").isNotNull()
        new = state.join(sums, F.col("_s").eqNullSafe(F.col("source")), "left").select(
            "source", "docs", "source_size", "target", "full",
            F.when(live & ~close, step).otherwise(F.col("multiplier")).alias("multiplier"),
            F.when(live, low).otherwise(F.col("low")).alias("low"),
            F.when(live, high).otherwise(F.col("high")).alias("high"),
            F.when(live, close).otherwise(F.lit(True)).alias("done"),
        )
        old, state = state, stage(new, "mix-dual")
        unstage(old)
    if state.filter("not done").head(1):
        raise ArithmeticError(f"a source's rates are not balanced after {MAX_STEPS} steps")
    return state


def balanced(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The solved dual per source, with ``goal``, the words it is solved for, and the copies of large documents.

    A document of more than ``LARGE`` of its source's target can't be evened
    out by others once its rate is rounded. The sources that have such
    documents are solved again without them, for what their whole copies
    leave of the target.
    """
    targets = source_targets(sizes)
    dual = solve_rates(sizes, targets).withColumn("goal", F.col("target"))
    at = F.col("source").eqNullSafe(F.col("_s"))
    cells = sizes.withColumnRenamed("source", "_s").join(dual, at)
    of_size = rate(F.col("size"), F.col("source_size"), F.col("docs"), F.col("multiplier"), F.col("full"))
    large = stage(
        cells.filter(~F.col("full") & (F.col("target") > 0) & (F.col("size") > F.col("target") * LARGE))
        .withColumn("_r", of_size)
        .select("source", "size", "n", F.expr(f"(_r + {HALF}) div {ONE}").alias("whole")),
        "mix-large",
    )
    if not large.head(1):
        return dual, large
    own = large.select(F.col("source").alias("_s"), F.col("size").alias("_n"))
    small = sizes.join(own, at & (F.col("size") == F.col("_n")), "left_anti")
    taken = large.groupBy("source").agg(F.sum(F.col("n") * F.col("whole") * F.col("size")).alias("taken"))
    spare = small.groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("n") * F.col("size")).alias("spare"))
    left = targets.join(taken.withColumnRenamed("source", "_s"), at).drop("_s").join(spare, at, "left").drop("_s")
    goal = F.greatest(F.col("target") - F.col("taken"), F.lit(0.0))
    again = left.select(
        "source", "docs", "source_size", goal.alias("target"), (goal >= F.coalesce("spare", F.lit(0)) * MAX_COPIES).alias("full")
    )
    solved = solve_rates(small, again).withColumnRenamed("target", "goal")
    solved = solved.join(targets.select(F.col("source").alias("_s"), "target"), at).drop("_s")
    rest = dual.join(taken.select(F.col("source").alias("_s")), at, "left_anti")
    columns = ["source", "docs", "source_size", "target", "goal", "full", "multiplier"]
    return stage(rest.select(columns).union(solved.select(columns)), "mix-solved"), large


def mix_rows(rows: DataFrame) -> DataFrame:
    """``rows(doc_id, source, size, _rid, ...)`` with ``source_size, target, rate, copies``; ``rows`` is staged."""
    sizes = stage(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-sizes")
    dual, large = balanced(sizes)
    dual = dual.withColumnRenamed("source", "_s")
    large = large.select(F.col("source").alias("_ls"), F.col("size").alias("_lsize"), "whole")
    of_size = rate(F.col("size"), F.col("source_size"), F.col("docs"), F.col("multiplier"), F.col("full"))
    rated = (
        rows.join(dual, F.col("source").eqNullSafe(F.col("_s")))
        .join(large, F.col("source").eqNullSafe(F.col("_ls")) & (F.col("size") == F.col("_lsize")), "left")
        .select(
            *rows.columns,
            "source_size",
            "target",
            F.coalesce(F.col("whole") * ONE, F.when(F.col("goal") > 0, of_size).otherwise(0)).alias("_rate"),
        )
    )
    ordered = in_order(rated.withColumn("_h", F.xxhash64("doc_id")), ["source", "size", "_h", "doc_id", "_rid"], "mix-rows")
    summed = running_before(ordered, "source", F.col("_rate"))
    passed = lambda c: F.expr(f"({c} + {HALF}) div {ONE}")
    placed = summed.withColumns(
        {"rate": F.col("_rate") / F.lit(float(ONE)), "copies": passed("_before + _rate") - passed("_before")}
    ).drop("_pid", "_idx", "_at", "_before", "_rate")
    return evened(stage(placed, "mix-placed")).drop("_h")


def evened(placed: DataFrame) -> DataFrame:
    """``placed`` with ``copies`` changed by one for a few documents per source, to come nearer the target.

    In each round every source picks the one document whose copy more or
    less takes most off what the source still misses or has too much.
    """
    changes = placed.select("_rid", F.lit(0).cast("long").alias("_delta")).limit(0)
    now = placed
    for _ in range(EVEN_ROUNDS):
        totals = now.groupBy(F.col("source").alias("_s")).agg(
            F.sum(F.col("copies") * F.col("size")).alias("_taken"), F.max("target").alias("_goal")
        )
        miss = F.col("_goal") - F.col("_taken")
        may = F.when(miss > 0, F.col("copies") < MAX_COPIES).otherwise(F.col("copies") > 0)
        gain = F.abs(miss) - F.abs(F.abs(miss) - F.col("size"))
        order = F.struct(gain, "_h", "doc_id", "_rid")
        pick = (
            now.join(totals, F.col("source").eqNullSafe(F.col("_s")))
            .filter(may & (gain > 0))
            .groupBy("_s")
            .agg(F.max_by(F.struct("_rid", F.signum(miss).cast("long").alias("_delta")), order).alias("p"))
            .select("p.*")
        )
        changes = stage(changes.union(pick), "mix-changes")
        sums = changes.groupBy("_rid").agg(F.sum("_delta").alias("_delta"))
        now = placed.join(sums, "_rid", "left").select(
            *[c for c in placed.columns if c != "copies"], (F.col("copies") + F.coalesce("_delta", F.lit(0))).alias("copies")
        )
    return now


def mix(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken, rate, copies`` for every row of ``docs(doc_id, source, text)``."""
    rows = stage(
        docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("_rid")),
        "mix-docs",
    )
    return mix_rows(rows).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies"
    )


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as many times as the mix takes it, possibly not at all.

    The texts are read twice, to be counted and to be given out, and written
    nowhere between: rows meet their copies by their place in the files, which
    keeps rows apart that are equal in every column. Only those narrow rows
    are staged, and removed once the copies are known; the copies are bitmaps,
    and while these can be broadcast the texts cross no network either.
    """
    held = numbered(docs, "mix-held")
    size = n_words(F.col("_row.text")).alias("size")
    with scratch() as keep:
        rows = stage(held.select(F.col("_row.doc_id").alias("doc_id"), F.col("_row.source").alias("source"), size, "_rid"), "mix-docs")
        takes = keep(stage(bitmaps(mix_rows(rows).select("_rid", "copies")), "mix-takes"))
    return given_out(held, takes)
