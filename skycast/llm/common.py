"""What several operators of this subpackage share."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skycast.session import broadcast_checked, staged

ROOT = str(Path(__file__).resolve().parents[2])


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *filter(None, paths)])


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of the input has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, subs: int = 256) -> DataFrame:
    """Gapless numbers from 0 within each key, without sorting a key in one task.

    Rows of a key are dealt into ``subs`` parts by a hash of ``order``; counts of the parts
    (combined before the shuffle) give each part its first number, and rows are ordered only
    inside their part. Keys must not be null; equal ``order`` values are numbered in any order.
    """
    sub, n, first = fresh(df, "sub"), fresh(df, "n"), fresh(df, "first")
    parts = df.withColumn(sub, F.pmod(F.xxhash64(*order), F.lit(subs)).cast("int"))
    counts = parts.groupBy(*keys, sub).agg(F.count(F.lit(1)).alias(n))
    before = W.partitionBy(*keys).orderBy(sub).rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.select(*keys, sub, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    inside = W.partitionBy(*keys, sub).orderBy(*order)
    return (
        parts.join(firsts.hint("shuffle_merge"), [*keys, sub])
        .withColumn(name, (F.col(first) + F.row_number().over(inside) - 1).cast("long"))
        .drop(sub, first)
    )


def field(name: str) -> str:
    """A column name for SQL text."""
    return "`" + re.sub("`", "``", name) + "`"


def ordered(df: DataFrame, keys: list[str], order: list[Column | str], name: str, total: str | None = None) -> DataFrame:
    """Gapless numbers from 0 within each key, in the given order, without sorting a key in one task.

    Rows are dealt into ranges of (keys, order), sorted there and written once to the shared
    folder, each with its range and place; counts per key and range (one row per range and key
    at most) give a range its first number. The written table fixes the places, so a lost executor
    changes nothing. ``total`` names a column for the number of rows of the key. Null keys are a
    key; rows equal in ``order`` are numbered in any order. Keep the rows narrow: they are written.
    """
    part, place, low, n, first = (fresh(df, c) for c in ("part", "place", "low", "n", "first"))
    by = [F.col(c) if isinstance(c, str) else c for c in [*keys, *order]]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = dealt.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id())
    dealt = staged(dealt, "ordered")
    counts = dealt.groupBy(*keys, part).agg(F.min(place).alias(low), F.count(F.lit(1)).alias(n))
    key = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    firsts = counts.select(
        *(F.col(k).alias(_side(k)) for k in keys), F.col(part).alias(_side(part)), low,
        F.coalesce(F.sum(n).over(key.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(first),
        F.sum(n).over(key).alias(total or n),
    )
    same = F.col(part) == F.col(_side(part))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(_side(k)))
    out = dealt.join(broadcast_checked(firsts), same)
    out = out.withColumn(name, (F.col(first) + F.col(place) - F.col(low)).cast("long"))
    return out.select(*df.columns, name, *([total] if total else []))


def _side(name: str) -> str:
    return f"{name} of the side"
