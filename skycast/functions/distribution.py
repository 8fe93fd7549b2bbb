"""Algebra on a predictive distribution held as three columns q10, q50, q90."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from .aqi import stage_bounds
from .numeric import clip


def cdf(x: Column | float, q10: Column, q50: Column, q90: Column) -> Column:
    """P(X <= x): linear between the quantiles, exponential tails outside them."""
    x = x if isinstance(x, Column) else F.lit(float(x))
    left = F.greatest(q50 - q10, F.lit(1e-6))
    right = F.greatest(q90 - q50, F.lit(1e-6))
    p = (
        F.when(x <= q10, 0.1 * F.exp((x - q10) / left))
        .when(x <= q50, 0.1 + 0.4 * (x - q10) / left)
        .when(x <= q90, 0.5 + 0.4 * (x - q50) / right)
        .when(x > q90, 1.0 - 0.1 * F.exp(-(x - q90) / right))
    )
    return F.when(q10.isNotNull() & q50.isNotNull() & q90.isNotNull(), F.greatest(F.lit(0.0), F.least(p, F.lit(1.0))))


def stage_probabilities(df: DataFrame, cfg: Settings, q10="q10", q50="q50", q90="q90") -> DataFrame:
    """Add p_stage_k, p_at_least_k for every stage, p_stage_0 and expected_stage."""
    a, b, c = F.col(q10), F.col(q50), F.col(q90)
    bounds = stage_bounds(cfg)
    edges = sorted({x for _, _, *pair in bounds for x in pair})
    # One body over the distinct bounds instead of one expression for each: small enough to be compiled.
    out = df.withColumn("_cdf", F.transform(F.array(*map(F.lit, edges)), lambda x: cdf(x, a, b, c)))
    below = {x: F.col("_cdf")[k] for k, x in enumerate(edges)}
    inside = {k: F.when(b.isNotNull(), F.greatest(F.lit(0.0), F.least(below[hi] - below[lo], F.lit(1.0)))) for k, _, lo, hi in bounds}
    cols = {f"p_stage_{k}": p for k, p in inside.items()} | {f"p_at_least_{k}": 1.0 - below[lo] for k, _, lo, _ in bounds}
    cols["p_stage_0"] = clip(1.0 - (1.0 - below[bounds[0][2]]), 0.0, 1.0)
    cols["expected_stage"] = sum((F.lit(float(k)) * p for k, p in inside.items()), F.lit(0.0))
    return out.withColumns(cols).drop("_cdf")


def ordered(df: DataFrame, q10="q10", q50="q50", q90="q90") -> DataFrame:
    """Repair crossing quantiles by sorting the triple in each row."""
    triple = F.array_sort(F.array(F.col(q10), F.col(q50), F.col(q90)))
    return (
        df.withColumn("_triple", triple)
        .withColumns({q10: F.col("_triple")[0], q50: F.col("_triple")[1], q90: F.col("_triple")[2]})
        .drop("_triple")
    )


def interval_width(q10="q10", q90="q90") -> Column:
    return F.col(q90) - F.col(q10)


def pinball(y: Column, q: Column, level: float) -> Column:
    d = y - q
    return F.greatest(level * d, (level - 1) * d)
