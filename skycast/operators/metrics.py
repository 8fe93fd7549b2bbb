"""Forecast scores as conditional aggregates over long prediction frames.

A prediction frame has y, q10, q50, q90 and, where a baseline is compared, base_q50.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EPISODE_PM25
from ..functions.distribution import pinball


def finite(*columns: str) -> Column:
    cond = F.lit(True)
    for c in columns:
        v = F.col(c).cast("double")
        cond = cond & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return cond


def rmse(err: Column) -> Column:
    return F.sqrt(F.avg(err * err))


def score_columns(baseline: str | None = None, episode: float = EPISODE_PM25) -> list[Column]:
    """Aggregates of one score row; rows without a finite y and q50 count nowhere."""
    ok = finite("y", "q50")
    err = F.when(ok, F.col("q50") - F.col("y"))
    ep = ok & (F.col("y") >= episode)
    ep_err = F.when(ep, F.col("q50") - F.col("y"))
    inside = ((F.col("y") >= F.col("q10")) & (F.col("y") <= F.col("q90"))).cast("double")
    loss = sum((pinball(F.col("y"), F.col(q), lv) for q, lv in (("q10", 0.1), ("q50", 0.5), ("q90", 0.9))), F.lit(0.0))
    cols = [
        F.count(err).alias("n"), rmse(err).alias("rmse"), F.avg(F.abs(err)).alias("mae"), F.avg(err).alias("bias"),
        F.avg(F.when(ok, inside)).alias("coverage_80"),
        F.avg(F.when(ok, F.col("q90") - F.col("q10"))).alias("interval_width"),
        F.avg(F.when(ok, loss / 3.0)).alias("pinball"),
        F.count(ep_err).alias("episode_n"), rmse(ep_err).alias("episode_rmse"), F.avg(ep_err).alias("episode_bias"),
        F.avg(F.when(ep, (F.col("q50") >= episode).cast("double"))).alias("episode_recall"),
    ]
    if baseline:
        both = ok & finite(baseline)
        cols += [
            rmse(F.when(both, F.col(baseline) - F.col("y"))).alias("baseline_rmse"),
            rmse(F.when(both, F.col("q50") - F.col("y"))).alias("_common_rmse"),
        ]
    return cols


def _with_skill(df: DataFrame, baseline: str | None) -> DataFrame:
    if not baseline:
        return df
    skill = F.when(F.col("baseline_rmse") > 0, 1.0 - F.col("_common_rmse") / F.col("baseline_rmse"))
    return df.withColumn("skill_vs_baseline", skill).drop("_common_rmse")


def score(df: DataFrame, by: Sequence[str] = (), baseline: str | None = None) -> DataFrame:
    return _with_skill(df.groupBy(*by).agg(*score_columns(baseline)), baseline)


def horizon_table(df: DataFrame, by: Sequence[str] = (), baseline: str | None = None) -> DataFrame:
    """Scores per horizon and overall (horizon 0), from one pass with grouping sets."""
    keys = [F.col(c) for c in by]
    h = F.col("horizon_h")
    out = df.groupingSets([[*keys, h], keys], *keys, h).agg(F.grouping("horizon_h").alias("_all"), *score_columns(baseline))
    out = out.withColumn("horizon_h", F.when(F.col("_all") == 1, F.lit(0)).otherwise(F.col("horizon_h"))).drop("_all")
    return _with_skill(out, baseline)


def paired_agreement(df: DataFrame, forecast: str, observed: str, by: Sequence[str] = ()) -> DataFrame:
    """n, bias, RMSE and correlation of pairs where both sides are finite."""
    ok = finite(forecast, observed)
    d = F.when(ok, F.col(forecast) - F.col(observed))
    return df.groupBy(*by).agg(
        F.count(d).alias("n"), F.avg(d).alias("bias"), rmse(d).alias("rmse"),
        F.corr(F.when(ok, F.col(forecast)), F.when(ok, F.col(observed))).alias("r"),
    )
