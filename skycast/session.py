"""Session settings, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a side may have before it is no longer broadcast. At the widths used here
# (ids plus a few doubles) this stays around 20 MB.
BROADCAST_ROWS = 200_000


def tune(spark: SparkSession) -> SparkSession:
    """SQL settings every operator relies on. Runtime settings only, so any session can be tuned."""
    for key, value in {
        # All stored times are UTC; local time exists only as calendar numbers.
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Partitions follow the data: many to begin with, joined while they are small. With a fixed number of
        # partitions a task's sorts grow with the input, and 4 MB of shuffled rows can be 140 times that in a task.
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
        # Persisted tables too: otherwise their shuffles keep all of these partitions, and each pass over the table has as many tasks.
        "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Lets a join on (time, station) reuse a partitioning on time alone.
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(name: str = "skycast", cores: str = "8") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and staged tables.

    The cluster names it in ``spark.checkpoint.dir``. A folder of our own is made
    only where nothing is set and the session is local, so executors always see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = os.path.join(tempfile.gettempdir(), "spark-skycast-" + spark.sparkContext.applicationId)
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Truncate lineage through the shared folder; survives lost executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write once to the shared folder and read back, so several consumers share one computation."""
    path = scratch(df.sparkSession, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def broadcast_checked(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only when a bounded count proves the side small; plain shuffle join otherwise."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def broadcast_bounded(df: DataFrame, rows: int, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint when the plan itself bounds the rows (hours of a range, entries of a config list)."""
    return F.broadcast(df) if rows <= max_rows else df
