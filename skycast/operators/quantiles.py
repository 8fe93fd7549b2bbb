"""Exact group quantiles without holding a group in memory."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged


#: Distinct values that a wanted rank's bracket should hold at most, and the brackets of a group in the first pass.
INSIDE, BRACKETS = 10_000, 256
#: Passes that narrow brackets; each divides what a bracket holds by about BRACKETS.
PASSES = 6


#: Distinct values that a wanted rank's bracket should hold at most, and the brackets of a group in the first pass.
INSIDE, BRACKETS = 10_000, 256
#: Passes that narrow brackets; each divides what a bracket holds by about BRACKETS.
PASSES = 6


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], inside: int = INSIDE) -> DataFrame:
    """(keys, p, q, n): linear-interpolated quantiles of the finite values of every group.

    Equal values are counted first, on (keys, value), combined before the shuffle. A mergeable sketch of a group's
    distinct values cuts them into BRACKETS of about equal size, whatever their scale; counts per bracket tell
    which one holds a wanted rank. Only those are looked into: while one holds more than ``inside``
    distinct values, it is cut again in the same way, and what is left is ordered. So a task never orders more than
    ``inside`` values, and a group with a third of all rows costs no more memory than a small one.
    """
    keys = list(keys)
    if not keys:
        return exact_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probs, inside).drop("_all")
    counts = (
        df.where(F.col(value).isNotNull() & ~F.isnan(value))
        .groupBy(*keys, (F.col(value) + 0.0).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    counts = staged(counts, "value-counts")
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("n"), F.count(F.lit(1)).alias("_d"))
    wanted = sizes.select(*keys, "n", "_d", F.explode(F.array(*map(F.lit, map(float, probs)))).alias("p")).withColumn("_pos", F.col("p") * (F.col("n") - 1))
    ranks = F.explode(F.array_distinct(F.array(F.floor("_pos"), F.least(F.floor("_pos") + 1, F.col("n") - 1))))
    # an open rank: the values of its bracket (low, high], how many rows lie below and how many distinct values inside
    targets = wanted.select(*keys, ranks.alias("_k"), F.lit(-math.inf).alias("_low"), F.lit(math.inf).alias("_high"), F.lit(0).cast("long").alias("_below"), "_d").distinct()
    one = lambda k: F.col(k).eqNullSafe(F.col(f"{k} wanted"))
    same = reduce(lambda a, b: a & b, map(one, keys))
    side = lambda t: t.select(*(F.col(k).alias(f"{k} wanted") for k in keys), *(c for c in t.columns if c not in keys))
    within = lambda t: counts.join(side(t), same & (F.col("_v") > F.col("_low")) & (F.col("_v") <= F.col("_high")))

    most = sizes.agg(F.max("_d")).first()[0] or 0
    settled = targets if most <= inside else targets.where(F.col("_d") <= inside)
    for _ in range(PASSES if most > inside else 0):
        large = targets.where(F.col("_d") > inside)
        # ranks that share a bracket share its cuts
        spans = large.select(*keys, "_low", "_high").distinct()
        met = within(spans)
        cuts = met.groupBy(*keys, "_low", "_high").agg(F.percentile_approx("_v", [i / BRACKETS for i in range(1, BRACKETS)], 10 * BRACKETS).alias("_cuts"))
        cuts = staged(cuts.withColumn("_cuts", F.array_distinct("_cuts")), "brackets")
        # the first cut that is not below the value; a value is above as many cuts as it beats
        place = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
        held = within(cuts).groupBy(*keys, "_low", "_high", place.alias("_b")).agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_d"))
        upto = Window.partitionBy(*keys, "_low", "_high").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        held = held.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
        held = held.join(side(cuts).select(*(f"{k} wanted" for k in keys), F.col("_low").alias("_l"), F.col("_high").alias("_h"), "_cuts"), same & (F.col("_low") == F.col("_l")) & (F.col("_high") == F.col("_h")))
        held = held.select(
            *(F.col(k).alias(f"{k} wanted") for k in keys), F.col("_low").alias("_l"), F.col("_high").alias("_h"), "_n", F.col("_d").alias("_in"), "_before",
            F.coalesce(F.get("_cuts", F.col("_b") - 1), F.col("_low")).alias("_from"), F.coalesce(F.get("_cuts", F.col("_b")), F.col("_high")).alias("_to"),
        )
        hit = same & (F.col("_low") == F.col("_l")) & (F.col("_high") == F.col("_h"))
        rank = F.col("_k") - F.col("_below")
        next_ = large.join(held, hit & (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_n")))
        targets = staged(next_.select(*keys, "_k", F.col("_from").alias("_low"), F.col("_to").alias("_high"), (F.col("_below") + F.col("_before")).alias("_below"), F.col("_in").alias("_d")), "ranks")
        settled = settled.unionByName(targets.where(F.col("_d") <= inside))
        targets = targets.where(F.col("_d") > inside)
        if targets.isEmpty():
            break
    else:
        settled = settled.unionByName(targets) if most > inside else settled
    upto = Window.partitionBy(*keys, "_low", "_high", "_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = within(settled).withColumn("_end", F.col("_below") + F.sum("_c").over(upto))
    found = found.where((F.col("_end") > F.col("_k")) & (F.col("_end") - F.col("_c") <= F.col("_k"))).groupBy(*keys, "_k").agg(F.max("_v").alias("_v"))

    def at(rank: Column, name: str) -> DataFrame:
        return side(found).select(*(F.col(f"{k} wanted").alias(f"{k} {name}") for k in keys), F.col("_k").alias(f"_k {name}"), F.col("_v").alias(name))

    out = wanted
    for rank, name in ((F.floor("_pos"), "_a"), (F.least(F.floor("_pos") + 1, F.col("n") - 1), "_b")):
        on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{k} {name}")) for k in keys)) & (rank == F.col(f"_k {name}"))
        out = out.join(at(rank, name), on)
    q = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_pos") - F.floor("_pos"))
    return out.select(*keys, "p", q.alias("q"), "n")


def wide_quantiles(df: DataFrame, keys, value: str, probs: dict[str, float]) -> DataFrame:
    """As ``exact_quantiles`` with one column per named probability and ``n``."""
    long = exact_quantiles(df, keys, value, list(probs.values()))
    cols = [F.max(F.when(F.col("p") == F.lit(float(p)), F.col("q"))).alias(name) for name, p in probs.items()]
    return long.groupBy(*keys).agg(*cols, F.max("n").alias("n"))
