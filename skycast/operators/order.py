"""Numbers in an order without sorting a key, or everything, in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import broadcast_checked, staged


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of the input has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


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
    side = lambda c: f"{c} of the side"
    firsts = counts.select(
        *(F.col(k).alias(side(k)) for k in keys), F.col(part).alias(side(part)), low,
        F.coalesce(F.sum(n).over(key.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(first),
        F.sum(n).over(key).alias(total or n),
    )
    same = F.col(part) == F.col(side(part))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(side(k)))
    out = dealt.join(broadcast_checked(firsts), same)
    out = out.withColumn(name, (F.col(first) + F.col(place) - F.col(low)).cast("long"))
    return out.select(*df.columns, name, *([total] if total else []))
