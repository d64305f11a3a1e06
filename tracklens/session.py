"""Session helpers: UTC time zone, AQE, and a shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", app: str = "tracklens") -> SparkSession:
    """A local session for tests and benchmarks (cluster jobs use their own)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names shared storage that survives executor
    loss; it is never replaced here, and a session without it is refused:
    one machine's temporary folder would be unreadable to the others.
    """
    path = spark.conf.get(CHECKPOINT_KEY, None)
    if not path:
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
    return path


#: folders of plain local sessions without the setting, by application
LOCAL_DIRS: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a session on one machine (a local master) without one gets a folder of its own."""
    master = spark.sparkContext.master
    if spark.conf.get(CHECKPOINT_KEY, None) or not (master == "local" or master.startswith("local[")):
        return checkpoint_dir(spark).rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in LOCAL_DIRS:
        LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="tracklens-")
    return LOCAL_DIRS[app]


def stage_table(df: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    return a reader of it.

    Used where several plan branches need the same intermediate: they read
    one pruned columnar table instead of recomputing it from the source,
    and a lost executor re-reads the staged files rather than the source.
    """
    spark = df.sparkSession
    path = f"{(base or checkpoint_dir(spark)).rstrip('/')}/tracklens-stage/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def remove_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unstage(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    if getattr(df, "_staged_at", None):
        remove_path(df.sparkSession, df._staged_at)
