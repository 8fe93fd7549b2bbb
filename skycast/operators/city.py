"""City-wide series: scoping, means with a quorum, AQI, stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Settings
from ..functions.aqi import aqi_to_stage, pm25_to_aqi, stage_name
from ..functions.calendar import calendar_features
from .quality import stable_basket
from .windows import observation_features, rolling_mean, rolling_mean_by_hours

CITY_ID = "CITY"
MIN_STATIONS = 5
AQI_HOURS = 24
AQI_MIN_HOURS = 16


def city_stations(roster: DataFrame, cfg: Settings) -> DataFrame:
    """Stations of the listed cities, ignoring case and blanks; no list means all of them."""
    if not cfg.city_scope:
        return roster
    wanted = [c.strip().lower() for c in cfg.city_scope]
    return roster.where(F.lower(F.trim("city")).isin(wanted))


def scope_to_city(base: DataFrame, roster: DataFrame, cfg: Settings) -> DataFrame:
    if not cfg.city_scope:
        return base
    return base.join(city_stations(roster, cfg).select("station_id"), "station_id", "left_semi")


def station_aqi(
    df: DataFrame, cfg: Settings, value: str = "pm25_clean", key: str = "station_id", compat: bool = False
) -> DataFrame:
    """pm25_24h (16 of 24 hours) and aqi_pm25. ``compat=True`` counts 24 rows instead of 24 hours."""
    if compat:
        # Rows reach back over gaps of any length, so the frame stays within the whole series of a station.
        last = Window.partitionBy(key).orderBy("time").rowsBetween(1 - AQI_HOURS, 0)
        mean = F.when(F.count(value).over(last) >= AQI_MIN_HOURS, F.avg(value).over(last))
        out = df.withColumn("pm25_24h", mean)
    else:
        out = rolling_mean_by_hours(df, value, "pm25_24h", AQI_HOURS, AQI_MIN_HOURS, key)
    return out.withColumn("aqi_pm25", pm25_to_aqi(F.col("pm25_24h"), cfg))


def city_aqi(
    df: DataFrame, cfg: Settings, aqi: str = "aqi_pm25", min_stations: int = MIN_STATIONS, compat: bool = False
) -> DataFrame:
    out = df.groupBy("time").agg(
        F.avg(aqi).alias("city_aqi"), F.max(aqi).alias("worst_station_aqi"), F.count(aqi).alias("n_stations")
    )
    out = out.withColumn("city_aqi", F.when(F.col("n_stations") >= min_stations, F.col("city_aqi")))
    return out.withColumn("grap_stage", aqi_to_stage(F.col("city_aqi"), cfg, compat))


def stage_frequency(city: DataFrame, cfg: Settings) -> DataFrame:
    """Hours and share of every stage that occurs, among hours with a stage."""
    counts = city.where("grap_stage is not null").groupBy("grap_stage").agg(F.count("*").alias("hours"))
    total = counts.agg(F.sum("hours")).scalar()
    return counts.withColumn("pct_of_hours", F.round(F.col("hours") / total * 100, 2)).withColumn(
        "stage_name", stage_name(F.col("grap_stage"), cfg)
    )


def episodes(obs: DataFrame, roster: DataFrame | None, cfg: Settings, compat: bool = False) -> DataFrame:
    """City AQI and stage per hour. ``compat=True`` averages all stations over 24 rows."""
    scoped = obs if compat or roster is None else scope_to_city(obs, roster, cfg)
    return city_aqi(station_aqi(scoped, cfg, compat=compat), cfg, compat=compat)


def city_base(
    base: DataFrame,
    cfg: Settings,
    roster: DataFrame | None = None,
    min_stations: int = MIN_STATIONS,
    min_coverage: float = 0.0,
    stations: Sequence[str] | None = None,
) -> DataFrame:
    """Mean of every numeric column per hour, with a quorum on the target and 24 h means.

    The result has one row per hour whatever the number of stations; lags and calendar
    are then taken on that series.
    """
    if stations is not None:
        base = base.where(F.col("station_id").isin(list(stations)))
    elif roster is not None:
        base = scope_to_city(base, roster, cfg)
    base = stable_basket(base, min_coverage)
    numeric = [
        f.name for f in base.schema
        if isinstance(f.dataType, T.NumericType) and f.name != "obs_n"
    ]
    city = base.groupBy("time").agg(
        *[F.avg(c).alias(c) for c in numeric],
        F.count("pm25_clean").alias("n_stations"),
        F.max("pm25_clean").alias("worst_station_pm25"),
    ).withColumn("station_id", F.lit(CITY_ID))
    city = city.withColumn("pm25_clean", F.when(F.col("n_stations") >= min_stations, F.col("pm25_clean")))
    city = rolling_mean(city, "pm25_clean", "city_pm25_24h", AQI_HOURS, AQI_MIN_HOURS)
    if "cams_pm2_5" in city.columns:
        city = rolling_mean(city, "cams_pm2_5", "cams_pm25_24h", AQI_HOURS, AQI_MIN_HOURS)
    city = city.drop(*[c for c in city.columns if c.startswith(("obs_", "vis_"))])
    return calendar_features(observation_features(city), zone=cfg.local_zone)
