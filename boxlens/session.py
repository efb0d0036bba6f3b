"""Session helpers: scratch folder, durable tables and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A dimension table is broadcast only after its row count was seen to be at most this.
BROADCAST_ROW_LIMIT = 100_000
# Raw boxes of one task: each is a prediction in every run, and a task sorts its predictions several times.
TASK_ROWS = 100_000


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and local benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("boxlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-boxlens-"))
        .getOrCreate()
    )


_local_root: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by the cluster in ``spark.checkpoint.dir``.

    Only a single-machine session may do without the setting: its executors
    share the driver's disk, so one temporary folder serves them all.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_root.setdefault(context.applicationId, tempfile.mkdtemp(prefix="spark-boxlens-"))


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage durably: a lost executor re-reads the files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("error").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch_path = path
    return written


def release(*tables: DataFrame | None) -> None:
    """Delete the files of materialized tables that nothing will read again; others are left alone."""
    for table in tables:
        if (path := getattr(table, "scratch_path", None)) is None:
            continue
        context = table.sparkSession.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast hint, given only when the table has at most ``limit`` rows.

    Meant for dimension tables that are already cheap to compute (written
    tables, literals); beyond the limit the join is left to the optimizer.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def key_partitions(df: DataFrame, rows: int = TASK_ROWS) -> int | None:
    """How many tasks of about ``rows`` rows a counted table makes; None where the cores suffice."""
    n = -(-df.count() // rows)
    return n if n > df.sparkSession.sparkContext.defaultParallelism else None


def by_key(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Partitioned by ``key``. A given number is kept; without one small exchanges are merged by their bytes,
    which says little where rows are multiplied afterwards."""
    return df.repartition(key) if partitions is None else df.repartition(partitions, key)


def for_each_run(df: DataFrame, runs: DataFrame, run) -> DataFrame:
    """Repeat each row for each run of a small (counted) run table."""
    return df.crossJoin(small(runs.select(*run)))
