"""Upwind-corridor transport features, one value per hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.meteo import mean_direction
from ..functions.numeric import at_least, clip
from ..session import broadcast_checked
from .neighbours import FLOOR, WIND_FLOOR, upwind_share
from .windows import BLOCK, own_rows, stretched

CORRIDOR_KM = 200.0
MIN_WIND_KMH = 3.0
MAX_TRANSPORT_H = 96.0
TRANSPORT_LAGS_H = (12, 24, 36)
COLUMNS = (
    "upwind_pm25", "upwind_transport_h", "upwind_alignment", "upwind_distance_km", "upwind_pm25_advected",
    *[f"upwind_pm25_lag_{k}h" for k in TRANSPORT_LAGS_H],
)


def corridor_series(base: DataFrame, corridor: DataFrame, obs: DataFrame, compat: bool = False, circular: bool = False) -> DataFrame:
    """One row per hour with wind and at least one corridor observation.

    ``corridor`` has upwind_id, distance_km, bearing_deg; ``obs`` has upwind_id, time,
    pm25, quality_flag. Null means nothing was upwind; alignment keeps its zero.
    ``compat=True`` advects and lags by rows of this series instead of by hours. ``circular`` averages
    the wind direction of an hour as vectors instead of as numbers.
    """
    wind = base.groupBy("time").agg(
        mean_direction("met_wind_direction_10m", circular).alias("_dir"), F.avg("met_wind_speed_10m").alias("_speed")
    )
    ok = obs.where(F.col("quality_flag") == "ok").groupBy("upwind_id", "time").agg(F.avg("pm25").alias("_v"))
    known = corridor.join(ok.select("upwind_id").distinct(), "upwind_id", "left_semi")
    hours = ok.select("time").distinct().join(wind, "time")
    share = upwind_share(F.col("_dir"), F.col("bearing_deg"))
    weight = share * F.exp(-F.col("distance_km") / CORRIDOR_KM)

    # Weighted sums need the stations that report; the largest alignment needs all of
    # them, and depends on the hour's wind only.
    sums = ok.where(F.col("_v").isNotNull()).join(broadcast_checked(known), "upwind_id").join(wind, "time").groupBy("time").agg(
        F.sum(weight).alias("_w"), F.sum(weight * F.col("_v")).alias("_wv"),
        F.sum(weight * F.col("distance_km")).alias("_wk"),
    )
    # Distinct bearings of the corridor roster, one value in the plan.
    bearings = known.agg(F.collect_set("bearing_deg")).scalar()
    largest = F.array_max(F.transform("_b", lambda b: F.greatest(F.cos(F.radians(F.col("_dir") - b)), F.lit(0.0))))
    out = hours.withColumn("_b", bearings).withColumn(
        "upwind_alignment", F.when(F.col("_dir").isNotNull(), F.least(largest, F.lit(1.0)))
    )
    out = out.join(sums, "time", "left")
    on = F.col("_w") > WIND_FLOOR
    km = F.when(on, F.col("_wk") / F.greatest("_w", F.lit(FLOOR)))
    speed = at_least(F.col("_speed"), MIN_WIND_KMH)
    out = out.select(
        "time", F.when(on, F.col("_wv") / F.greatest("_w", F.lit(FLOOR))).alias("upwind_pm25"),
        clip(km / speed, 0.0, MAX_TRANSPORT_H).alias("upwind_transport_h"),
        "upwind_alignment", km.alias("upwind_distance_km"),
    )
    return _by_rows(out) if compat else _by_hours(out)


def _by_hours(series: DataFrame) -> DataFrame:
    """Advected value and lags by exact hour, in one window pass over at most four days back."""
    wide = stretched(series, int(MAX_TRANSPORT_H)).withColumn("_s", F.unix_timestamp("time"))
    w = Window.partitionBy(BLOCK).orderBy("_s")

    def back(h: int):
        return F.max("upwind_pm25").over(w.rangeBetween(-h * 3600, -h * 3600))

    past = F.collect_list(F.struct("_s", "upwind_pm25")).over(w.rangeBetween(-int(MAX_TRANSPORT_H) * 3600, 0))
    wide = wide.withColumns({**{f"upwind_pm25_lag_{k}h": back(k) for k in TRANSPORT_LAGS_H}, "_past": past})
    left = F.col("_s") - F.bround("upwind_transport_h").cast("long") * 3600
    hit = F.get(F.filter("_past", lambda x: x["_s"] == left), F.lit(0))["upwind_pm25"]
    return own_rows(wide.withColumn("upwind_pm25_advected", hit)).drop("_s", "_past")


def _by_rows(series: DataFrame) -> DataFrame:
    # One row per hour of the record; ordering it is bounded by its length.
    w = Window.orderBy("time")
    out = series.withColumn("_i", F.row_number().over(w))
    src = out.select(F.col("_i").alias("_j"), F.col("upwind_pm25").alias("upwind_pm25_advected"))
    out = out.withColumn("_j", F.col("_i") - F.bround("upwind_transport_h").cast("int")).join(src, "_j", "left").drop("_j")
    lags = {f"upwind_pm25_lag_{k}h": F.lag("upwind_pm25", k).over(Window.orderBy("_i")) for k in TRANSPORT_LAGS_H}
    return out.withColumns(lags).drop("_i")


def upwind_features(
    base: DataFrame, corridor: DataFrame | None, obs: DataFrame | None, compat: bool = False
) -> DataFrame:
    """Join the corridor series on time; no corridor or no data gives null columns."""
    if corridor is None or obs is None:
        return base.withColumns({c: F.lit(None).cast("double") for c in COLUMNS})
    return base.join(corridor_series(base, corridor, obs, compat), "time", "left")
