"""Align every source on a complete (station, hour) index."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CAMS_COLS, MET_COLS, METAR_COLS
from ..session import broadcast_bounded
from ..sources.store import keep_one
from .windows import rolling_sums


def hours_between(start: dt.date | str, end: dt.date | str) -> Column:
    """Array of all UTC hours from the first day's midnight to the last day's 23:00."""
    first = F.to_timestamp(F.lit(str(start)[:10]))
    last = F.to_timestamp(F.lit(str(end)[:10])) + F.expr("INTERVAL 23 HOURS")
    return F.sequence(first, last, F.expr("INTERVAL 1 HOUR"))


def count_hours(start, end) -> int:
    first, last = (dt.date.fromisoformat(str(d)[:10]) for d in (start, end))
    return ((last - first).days + 1) * 24


def in_range(time: str, start, end) -> Column:
    """Hours of the closed date range; plain bounds, so Parquet can skip row groups."""
    stop = dt.date.fromisoformat(str(end)[:10]) + dt.timedelta(days=1)
    lo, hi = (F.lit(str(d)[:10]).cast("timestamp") for d in (start, stop))
    return (F.col(time) >= lo) & (F.col(time) < hi)


def hourly_index(stations: DataFrame, start: dt.date | str, end: dt.date | str) -> DataFrame:
    """Complete (station_id, time); the hours are exploded beside each station and day, so there is no join.

    The days are dealt out to all cores, as a list of stations that fits one task would have it make all hours.
    """
    tasks = stations.sparkSession.sparkContext.defaultParallelism
    midnights = F.sequence(*(F.to_timestamp(F.lit(str(d)[:10])) for d in (start, end)), F.expr("INTERVAL 1 DAY"))
    days = stations.select("station_id", F.explode(midnights).alias("_day")).repartition(tasks, "station_id", "_day")
    hours = F.sequence(F.col("_day"), F.col("_day") + F.expr("INTERVAL 23 HOURS"), F.expr("INTERVAL 1 HOUR"))
    return days.select("station_id", F.explode(hours).alias("time"))


def hours_frame(spark, start, end) -> DataFrame:
    return spark.range(1).select(F.explode(hours_between(start, end)).alias("time"))


def _nulls(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def join_observations(base: DataFrame, obs: DataFrame | None, order: Sequence[str] = ("n_obs",)) -> DataFrame:
    """pm25, pm25_clean, obs_n, quality_flag; an absent source gives the same columns, all null."""
    types = {"pm25": "double", "pm25_clean": "double", "obs_n": "long", "quality_flag": "string"}
    if obs is None:
        return _nulls(base, types)
    one = keep_one(obs.select("station_id", "time", "pm25", "pm25_clean", F.col("n_obs").alias("obs_n"), "quality_flag"),
                   ["station_id", "time"], ["obs_n" if o == "n_obs" else o for o in order], "first")
    # The planner takes the index for as small as the list of stations; unhinted it goes through the driver.
    return base.hint("merge").join(one, ["station_id", "time"], "left")


def join_forecast(
    base: DataFrame, forecast: DataFrame | None, columns: Sequence[str], prefix: str, fill_missing: bool = False,
    source_class: bool = False,
) -> DataFrame:
    """Forecast columns under a prefix; of copies of a (station, hour) the latest issued is kept."""
    if forecast is None:
        out = _nulls(base, {f"{prefix}{c}": _met_type(c) for c in columns})
        return _nulls(out, {f"{prefix}source_class": "string"}) if source_class else out
    have = [c for c in columns if c in forecast.columns]
    extra = ["source_class"] if source_class and "source_class" in forecast.columns else []
    order = ["issue_time"] if "issue_time" in forecast.columns else []
    rows = forecast.select("station_id", "time", *order, *extra, *have)
    one = keep_one(rows, ["station_id", "time"], order or have[:1], "last").drop(*order)
    renamed = one.select("station_id", "time", *[F.col(c).alias(f"{prefix}{c}") for c in [*extra, *have]])
    out = base.join(renamed, ["station_id", "time"], "left")
    return _nulls(out, {f"{prefix}{c}": _met_type(c) for c in columns}) if fill_missing else out


def _met_type(column: str) -> str:
    return "boolean" if column in ("inversion", "blh_available") else "double"


def join_cams(base: DataFrame, cams: DataFrame | None) -> DataFrame:
    return join_forecast(base, cams, CAMS_COLS, "cams_", source_class=True)


def join_meteo(base: DataFrame, meteo: DataFrame | None) -> DataFrame:
    return join_forecast(base, meteo, MET_COLS, "met_")


def join_run(base: DataFrame, run: DataFrame, columns: Sequence[str], prefix: str) -> DataFrame:
    """Columns of one live run; variables the run lacks are null."""
    out = join_forecast(base, run, columns, prefix, fill_missing=True)
    return out.withColumn("cams_source_class", F.lit("live_forecast")) if prefix == "cams_" else out


def primary_airport(metar: DataFrame) -> DataFrame:
    """Reports of the station with the most rows; ties go to the smaller name."""
    counts = metar.groupBy("metar_station").agg(F.count("*").alias("n"))
    top = counts.agg(F.min_by("metar_station", F.struct(-F.col("n"), "metar_station")).alias("metar_station"))
    # One row by construction.
    return metar.join(F.broadcast(top), "metar_station", "left_semi")


def airport_series(metar: DataFrame) -> DataFrame:
    """One row per hour of the primary airport, prefixed."""
    have = [c for c in METAR_COLS if c in metar.columns]
    one = keep_one(primary_airport(metar).select("time", *have), ["time"], [have[0]], "first")
    return one.select("time", *[F.col(c).cast("double").alias(f"metar_{c}") for c in have])


def join_airport(base: DataFrame, metar: DataFrame | None, start=None, end=None) -> DataFrame:
    """Airport series joined on time alone, the same for every station.

    With a range the series has at most one row per hour of it, and that bound decides the broadcast.
    """
    if metar is None:
        return _nulls(base, {f"metar_{c}": "double" for c in METAR_COLS})
    series = airport_series(metar)
    if start is not None:
        series = broadcast_bounded(series.where(in_range("time", start, end)), count_hours(start, end))
    return base.join(series, "time", "left")


def fire_series(fires: DataFrame, start, end, compat: bool = False) -> DataFrame:
    """Hourly detections and their 24/72 h trailing sums over all hours of the range.

    ``fires_available`` marks the hours of days the source covers. ``compat=True``
    marks the whole range as soon as one event lies in it.
    """
    spark = fires.sparkSession
    per_hour = fires.groupBy(F.date_trunc("hour", "time").alias("time")).agg(
        F.count("*").cast("double").alias("fire_count_1h"), F.coalesce(F.sum("frp"), F.lit(0.0)).alias("fire_frp_1h")
    )
    hours = hours_frame(spark, start, end)
    full = hours.join(per_hour, "time", "left").fillna(0.0, ["fire_count_1h", "fire_frp_1h"])
    if compat:
        full = full.withColumn("fires_available", F.lit(True))
    else:
        days = per_hour.select(F.to_date("time").alias("_d")).distinct().withColumn("fires_available", F.lit(True))
        full = (
            full.withColumn("_d", F.to_date("time")).join(days, "_d", "left").drop("_d")
            .fillna(False, ["fires_available"])
        )
    return rolling_sums(
        full,
        {
            "fire_count_24h": ("fire_count_1h", 24),
            "fire_frp_24h": ("fire_frp_1h", 24),
            "fire_count_72h": ("fire_count_1h", 72),
        },
    )


def join_fires(base: DataFrame, fires: DataFrame | None, start, end, compat: bool = False) -> DataFrame:
    """The sums are the same for every station, so they are rolled once per hour, before the join."""
    names = ("fire_count_1h", "fire_frp_1h", "fire_count_24h", "fire_frp_24h", "fire_count_72h")
    if fires is None:
        return base.withColumns({**{c: F.lit(0.0) for c in names}, "fires_available": F.lit(False)})
    series = broadcast_bounded(fire_series(fires, start, end, compat), count_hours(start, end))
    return base.join(series, "time", "left")
