"""Staging on shared storage, global ordering and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: folders of plain local sessions without a setting, by application
LOCAL_DIRS: dict[str, str] = {}
#: tables staged inside each open ``scratch`` block
STAGED: list[list[DataFrame]] = []
#: monotonically_increasing_id() keeps the partition above this bit and the row number below.
PARTITION_BIT = 33
#: rows of a file whose marks share one bitmap, as many as bitmap_construct_agg holds
BITMAP_ROWS = 1 << 15


def scratch_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.

    A session without one gets a folder of its own only in plain local mode,
    where driver and tasks share one machine.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = LOCAL_DIRS.setdefault(app, LOCAL_DIRS.get(app) or tempfile.mkdtemp(prefix="llm-"))
    return base.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    if STAGED:
        STAGED[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables staged in the block are removed at its end, but for those given to the function it yields."""
    tables: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        tables[:] = [t for t in tables if t is not df]
        return df

    STAGED.append(tables)
    try:
        yield keep
    finally:
        STAGED.remove(tables)
        for df in tables:
            unstage(df)


def unstage(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    path = getattr(df, "_staged_at", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``_row``, a struct of all columns of ``docs``, and ``_rid``, a number of the row that every reading gives again.

    A row of a file is known by the file (as a 64-bit hash of its path) and
    its place in it, so a plain scan of Parquet files is read as it is; any
    other table is staged first.
    """
    plan = docs._jdf.queryExecution().analyzed()
    hidden = plan.metadataOutput()
    placed = any('"row_index"' in hidden.apply(i).dataType().json() for i in range(hidden.size()))
    if plan.nodeName() != "LogicalRelation" or not placed:
        docs = stage(docs, name)
    file = docs.metadataColumn("_metadata")
    rid = F.struct(F.xxhash64(file["file_path"]).alias("file"), file["row_index"].alias("at"))
    return packed(docs, rid.alias("_rid"))


def bitmaps(taken: DataFrame) -> DataFrame:
    """``taken(_rid, copies)`` as ``_file, _block, _nth, _bits``: the rows taken at least ``_nth`` times, a bit for each row.

    ``_rid`` is that of ``numbered`` and comes once. With 4 KB for 32,768 rows
    of a file, the marks stay small enough to be broadcast where a table of
    the rows' numbers has long been too large for it.
    """
    places = taken.filter("copies > 0").select(
        F.col("_rid.file").alias("_file"),
        F.expr(f"_rid.at div {BITMAP_ROWS}").alias("_block"),
        F.expr(f"_rid.at % {BITMAP_ROWS}").alias("_bit"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long"))).alias("_nth"),
    )
    keys = ["_file", "_block", "_nth"]
    # the numbers cross the network, not a bitmap from every task
    return places.repartition(*keys).groupBy(*keys).agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def given_out(held: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of ``held`` (from ``numbered``), each as often as ``marks`` (staged ``bitmaps``) has it."""
    here = F.expr(f"_rid.file = _file and _rid.at div {BITMAP_ROWS} = _block")
    byte = F.conv(F.hex(F.expr(f"substring(_bits, int(_rid.at % {BITMAP_ROWS} div 8) + 1, 1)")), 16, 10).cast("int")
    taken = byte.bitwiseAND(F.expr("shiftleft(1, int(_rid.at % 8))")) != 0
    return held.join(marks, here).filter(taken).select("_row.*")


def in_order(df: DataFrame, keys: list, name: str) -> DataFrame:
    """``df`` staged in the total order of ``keys``, with ``_pid`` (range partition) and ``_idx`` (row in it).

    Rows with equal keys may come in any order. Ranges are even however
    skewed one column is, as long as the keys together tell rows apart.
    """
    sorted_rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    out = stage(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), name)
    return out.withColumns(
        {"_pid": F.shiftright("_at", PARTITION_BIT), "_idx": F.col("_at").bitwiseAND(F.lit((1 << PARTITION_BIT) - 1))}
    )


def running_before(ordered: DataFrame, group: str, value) -> DataFrame:
    """Adds ``_before``: the sum of ``value`` over the rows of the same ``group`` that come earlier.

    Sums inside a range partition use a window per (partition, group); what
    lies in earlier partitions is added from one small row per both.
    """
    part = Window.partitionBy("_pid", group).orderBy("_idx").rowsBetween(Window.unboundedPreceding, -1)
    totals = ordered.groupBy("_pid", group).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_pid").alias("_opid"),
        F.col(group).alias("_ogroup"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"),
    )
    local = ordered.withColumn("_local", F.coalesce(F.sum(value).over(part), F.lit(0)))
    joined = local.join(
        offsets, (F.col("_pid") == F.col("_opid")) & F.col(group).eqNullSafe(F.col("_ogroup")), "left"
    )
    return joined.withColumn("_before", F.col("_local") + F.col("_offset")).drop(
        "_opid", "_ogroup", "_offset", "_local"
    )


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; root is the smallest node reachable.

    Alternates the large-star and the small-star step until the edges stop
    changing. Each step's edges are written to the shared folder; minima are
    map-side combined and joined back, so a node with very many neighbours
    is an ordinary skewed join. Only a count and a checksum reach the driver.
    """
    cur = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    seen = _mark(cur)
    while seen[0]:
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = stage(
            both.join(low, F.col("a") == F.col("u"))
            .filter("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a <> b")
            .distinct(),
            f"{name}-large",
        )
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(low, F.col("a") == F.col("u")).select(
            F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")
        )
        new = stage(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct(), f"{name}-edges")
        mark = _mark(new)
        unstage(cur)
        unstage(large)
        cur = new
        if mark == seen:
            break
        seen = mark
    roots = cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Row count and an order-free checksum of an edge table."""
    return tuple(edges.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(a, b)), 0)"), F.expr("coalesce(bit_xor(hash(b, a)), 0)")).first())


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """One struct column ``_row`` with all columns of ``docs``, whatever they are called, and ``more``."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), *more)


def row_hashes(held: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes over all columns in the ``_row`` of ``held``; NULLs count, maps go by their JSON."""
    fields = held.schema["_row"].dataType.fields
    columns = [F.col(f"_row.`{f.name}`") for f in fields]
    values = [
        F.to_json(F.struct(c.alias(f.name))) if "map<" in f.dataType.simpleString() else c
        for c, f in zip(columns, fields, strict=True)
    ]
    missing = [c.isNull() for c in columns]
    return F.xxhash64(F.lit(1), *values, *missing), F.xxhash64(F.lit(2), *values, *missing)
