"""Driver tables as domain frames.

Stations grow with the data: fifteen event users or ten suppliers form one station, so
readings per station-hour stay the same at every scale and the number of stations grows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skycast.config import Block, Fold, Settings
from skycast.functions.meteo import derive
from skycast.operators.quality import flag_quality, hourly_stats
from skycast.plans.base import Sources, base_frame, supervised_table
from skycast.session import tune

USERS_PER_STATION = 15
SUPPLIERS_PER_STATION = 10
FORECAST_BLOCK_S = 12 * 3600
SCALE = 5.0

# The events table spans January 2024; its held-out blocks lie inside.
JANUARY = Settings(
    blocks=(Block("val", "2024-01-14", "2024-01-15", "mid-january"), Block("test", "2024-01-21", "2024-01-25", "late-january")),
    embargo_h=24,
    folds=(
        Fold("week-2", "2024-01-12", "2024-01-13", "2024-01-17"),
        Fold("week-3", "2024-01-18", "2024-01-19", "2024-01-23"),
        Fold("week-4", "2024-01-24", "2024-01-25", "2024-01-29"),
    ),
)
TODAY = dt.date(2024, 1, 31)
NOW = dt.datetime(2024, 1, 31, 6, 0)
RUN_TODAY = dt.date(2001, 6, 1)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def station_of(column: str, per: int) -> Column:
    return F.concat(F.lit("S"), F.lpad(F.floor(F.col(column) / per).cast("string"), 5, "0"))


def events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props",
        station_of("user_id", USERS_PER_STATION).alias("station_id"),
    )


def reading_value() -> Column:
    """The measured value; one day in nine each station's sensor is stuck, so that flags of every kind occur."""
    stuck = (F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400) + F.floor(F.col("user_id") / USERS_PER_STATION)) % 9 == 0
    return F.when(stuck, F.lit(30.0)).otherwise(F.col("value"))


_PERIOD: dict[str, tuple[str, str]] = {}


def period(spark, sf) -> tuple[str, str]:
    """First and last day of the events."""
    if sf not in _PERIOD:
        lo, hi = table(spark, sf, "events").agg(F.min("ts"), F.max("ts")).first()
        _PERIOD[sf] = str(lo.date()), str(hi.date())
    return _PERIOD[sf]


def text_readings(spark, sf) -> DataFrame:
    """Readings with text stamps, every second one in local time with an offset."""
    e = events(spark, sf)
    utc = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    local = F.concat(F.date_format(F.col("ts") + F.expr("INTERVAL 330 MINUTES"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30"))
    stamp = F.when(F.col("event_id") % 2 == 0, utc).otherwise(local)
    return e.select("station_id", stamp.alias("datetime"), (reading_value() * SCALE).alias("value"))


def readings(spark, sf) -> DataFrame:
    return events(spark, sf).select("station_id", F.date_trunc("hour", "ts").alias("time"), (reading_value() * SCALE).alias("value"))


def hourly(spark, sf) -> DataFrame:
    return hourly_stats(readings(spark, sf))


def observations(spark, sf) -> DataFrame:
    return flag_quality(hourly(spark, sf))


def stations(spark, sf) -> DataFrame:
    k = F.floor(F.col("s_suppkey") / SUPPLIERS_PER_STATION).cast("int")
    g = table(spark, sf, "supplier").groupBy(k.alias("k")).agg(F.avg("s_acctbal").alias("balance"), F.min("s_suppkey").alias("location_id"))
    city = F.element_at(F.array(*map(F.lit, ("Delhi", "new delhi", "Noida", " DELHI "))), F.col("k") % 4 + 1)
    return g.select(
        F.concat(F.lit("S"), F.lpad(F.col("k").cast("string"), 5, "0")).alias("station_id"), "k",
        F.concat(F.lit("Sector "), F.col("k") + 1, F.lit(" Block "), F.col("k") % 10).alias("name"),
        city.alias("city"), F.lit("DPCC").alias("agency"),
        (F.lit(28.1) + (F.col("k") * 37 % 100) / 100.0).alias("lat"), (F.lit(76.7) + (F.col("k") * 53 % 100) / 100.0).alias("lon"),
        "balance", "location_id",
    )


def _blocks(spark, sf) -> DataFrame:
    e = events(spark, sf)

    def mean(kind: str) -> Column:
        return F.avg(F.when(F.col("event_type") == kind, F.col("value")))

    return e.groupBy("station_id", F.floor(F.unix_timestamp("ts") / FORECAST_BLOCK_S).alias("blk")).agg(
        mean("view").alias("v"), mean("click").alias("c"), mean("purchase").alias("p"), mean("signup").alias("s"), mean("error").alias("e")
    )


def _block_hours(df: DataFrame, shift_days: Column | int = 0) -> DataFrame:
    days = F.lit(shift_days) if isinstance(shift_days, int) else shift_days
    hour = F.explode(F.sequence(F.lit(0), F.lit(FORECAST_BLOCK_S // 3600 - 1)))
    return df.withColumn("_h", hour).withColumn(
        "time", F.timestamp_seconds(F.col("blk") * FORECAST_BLOCK_S + F.col("_h") * 3600 + days * 86400)
    )


def cams(spark, sf) -> DataFrame:
    return _block_hours(_blocks(spark, sf)).select(
        "station_id", "time", (F.col("v") * SCALE).alias("pm2_5"), (F.col("v") * 7.0).alias("pm10"), F.lit("archive").alias("source_class")
    )


def meteo_raw(spark, sf) -> DataFrame:
    return _block_hours(_blocks(spark, sf)).select(
        "station_id", "time", (F.col("v") / 4.0).alias("temperature_2m"), F.col("p").alias("wind_speed_10m"),
        (F.col("c") * 360.0 / 100.0 % 360.0).alias("wind_direction_10m"), (F.col("e") * 10.0).alias("boundary_layer_height"),
        (F.col("s") * 100.0).alias("visibility"), (F.col("s") / 4.0).alias("temperature_925hPa"), (F.col("p") / 4.0).alias("temperature_850hPa"),
    )


def meteo(spark, sf) -> DataFrame:
    return derive(meteo_raw(spark, sf))


def lead(spark, sf) -> DataFrame:
    """The forecast of N days earlier, valid at the same hour, for N = 1, 2, 3."""
    each = _blocks(spark, sf).withColumn("lead_day", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return _block_hours(each, F.col("lead_day")).select(
        "station_id", "time", "lead_day", (F.col("v") / 4.0).alias("temperature_2m"), F.col("p").alias("wind_speed_10m"),
        (F.col("c") * 360.0 / 100.0 % 360.0).alias("wind_direction_10m"),
    )


def metar(spark, sf) -> DataFrame:
    e = events(spark, sf).where("event_type = 'signup'")
    name = F.when(F.col("event_id") % 3 == 0, "VIDD").otherwise("VIDP")
    return e.groupBy(name.alias("metar_station"), F.date_trunc("hour", "ts").alias("time")).agg(
        F.avg(F.col("value") / 20.0).alias("visibility_km"), F.min(F.col("value") / 20.0).alias("visibility_km_min"),
        F.avg(F.col("value") / 3.0).alias("temp_c"), F.avg(F.col("value") / 6.0).alias("dew_point_depression_c"),
        F.avg(F.lit(100.0) - F.col("value") / 6.0).alias("relative_humidity"), F.count("*").alias("n_obs"),
    )


def all_fires(spark, sf) -> DataFrame:
    return events(spark, sf).where("event_type = 'error'").select(F.date_trunc("second", "ts").alias("time"), F.col("value").alias("frp"))


def fires(spark, sf) -> DataFrame:
    """No detections are held for every sixth day of the month."""
    return events(spark, sf).where("event_type = 'error' AND dayofmonth(ts) % 6 <> 0").select(F.date_trunc("second", "ts").alias("time"), F.col("value").alias("frp"))


def corridor(spark, sf) -> DataFrame:
    """Stations in one sector, so the wind comes from it at times and at times not."""
    return table(spark, sf, "nation").select(
        F.concat(F.lit("U"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("upwind_id"),
        (F.col("n_nationkey") * 11.5 + 65.0).alias("distance_km"), (F.col("n_nationkey") * 29.0 % 60.0 + 230.0).alias("bearing_deg"),
    )


def corridor_obs(spark, sf) -> DataFrame:
    e = events(spark, sf)
    uid = F.concat(F.lit("U"), F.lpad((F.col("user_id") % 25).cast("string"), 3, "0"))
    h = hourly_stats(e.select(uid.alias("station_id"), F.date_trunc("hour", "ts").alias("time"), (F.col("value") * SCALE).alias("value")))
    return flag_quality(h).withColumnRenamed("station_id", "upwind_id")


def sources(spark, sf) -> Sources:
    return Sources(
        stations(spark, sf).select("station_id"), observations(spark, sf), cams(spark, sf), meteo(spark, sf), metar(spark, sf),
        fires(spark, sf), corridor(spark, sf), corridor_obs(spark, sf), lead(spark, sf),
    )


def base(spark, sf, use_upwind: bool = True, columns: Sequence[str] | None = None) -> DataFrame:
    """All columns, or the keys, the observed value and ``columns``."""
    out = base_frame(sources(spark, sf), *period(spark, sf), JANUARY, use_upwind, columns=columns)
    return out if columns is None else out.select("station_id", "time", "pm25_clean", *columns)


def supervised(spark, sf, lead_matched: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    return supervised_table(sources(spark, sf), *period(spark, sf), JANUARY, lead_matched, columns=columns)


def _shipped(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


def cams_runs(spark, sf) -> DataFrame:
    """Runs issued on order dates, valid a few days later."""
    s = _shipped(spark, sf).select(
        station_of("l_suppkey", SUPPLIERS_PER_STATION).alias("station_id"), F.col("o_orderdate").cast("timestamp").alias("issue_time"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.col("l_linenumber"))).alias("time"), "l_extendedprice",
    )
    g = s.groupBy("station_id", "issue_time", "time").agg((F.avg("l_extendedprice") / 1000.0).alias("pm2_5"))
    return g.withColumn("lead_h", F.floor((F.unix_timestamp("time") - F.unix_timestamp("issue_time")) / 3600).cast("int"))


def cams_settled(spark, sf) -> DataFrame:
    l = table(spark, sf, "lineitem")
    return l.groupBy(
        station_of("l_suppkey", SUPPLIERS_PER_STATION).alias("station_id"), F.col("l_shipdate").cast("timestamp").alias("time")
    ).agg((F.avg("l_quantity") * 2.0).alias("pm2_5"))


def locations(spark, sf) -> DataFrame:
    """One external location per supplier, near its station."""
    k = F.floor(F.col("s_suppkey") / SUPPLIERS_PER_STATION).cast("int")
    j = F.col("s_suppkey") % SUPPLIERS_PER_STATION
    first = F.to_timestamp(F.lit("2020-01-01")) + F.make_dt_interval((F.col("s_suppkey") % 500).cast("int"))
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("location_id"),
        F.concat(F.lit("Sector "), k + 1, F.lit(" Block "), j, F.lit(", Delhi - DPCC")).alias("loc_name"),
        (F.lit(28.1) + (k * 37 % 100) / 100.0 + j * 0.003).alias("lat"), (F.lit(76.7) + (k * 53 % 100) / 100.0).alias("lon"),
        first.alias("first_seen"), (first + F.make_dt_interval(F.floor(F.abs("s_acctbal") / 5.0).cast("int"))).alias("last_seen"),
    )


def clean(df: DataFrame) -> DataFrame:
    """Comparable output: doubles to six places, whole numbers to bigint, times without zone.

    A billionth is added before rounding so that exact halves fall the same way everywhere.
    """
    cols = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double") + 1e-9, 6) + 0.0
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(f.name))
    return df.select(*cols)
