"""Landed files to typed frames. Every parser is a DataFrame transformation behind a thin read."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.geo import haversine_km, nearest
from ..functions.meteo import derive
from ..operators.order import ordered
from ..operators.quality import flag_quality

# Unit conversions of the airport reports.
MILES_TO_KM = 1.609344
KNOTS_TO_MS = 0.514444
INCH_TO_MM = 25.4

OFFICIAL_PROVIDERS = ("CPCB", "caaqm", "N/A")
LIVE_DAYS = 14
SENSOR_STALE_DAYS = 30
COLOCATED_KM = 0.25
POLLUTANT = "pm25"

LOCATION_SCHEMA = (
    "id long, name string, provider struct<name:string>, coordinates struct<latitude:double,longitude:double>, "
    "sensors array<struct<id:long,parameter:struct<name:string>,datetimeLast:struct<utc:string>>>, "
    "datetimeFirst struct<utc:string>, datetimeLast struct<utc:string>"
)


# -- forecast feeds ---------------------------------------------------------
def read_hourly_json(spark: SparkSession, path: str, variables: Sequence[str], multi_line: bool = True) -> DataFrame:
    """Landed responses: one object or array of objects per file, or one object per line."""
    arrays = ",".join(["time:array<string>", *[f"`{v}`:array<double>" for v in variables]])
    schema = f"cell_key string, latitude double, longitude double, hourly struct<{arrays}>"
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def hourly_rows(df: DataFrame, variables: Sequence[str], key: str = "cell_key") -> DataFrame:
    """Parallel arrays per location to one row per hour, all values double, time UTC."""
    zipped = F.arrays_zip(F.col("hourly.time").alias("time"), *[F.col(f"hourly.`{v}`").alias(v) for v in variables])
    out = df.select(key, F.col("latitude").alias("cell_lat"), F.col("longitude").alias("cell_lon"),
                    F.explode(zipped).alias("h"))
    return out.select(
        key, "cell_lat", "cell_lon",
        F.to_timestamp("h.time", "yyyy-MM-dd'T'HH:mm").alias("time"),
        *[F.col(f"h.`{v}`").cast("double").alias(v) for v in variables],
    )


def cell_fan_out(lookup: DataFrame, cells: DataFrame, key: str = "cell_key") -> DataFrame:
    """One series per cell back to every point of the cell; points of an empty cell stay."""
    return lookup.join(cells, key, "left").drop(key)


def stamp_run(df: DataFrame, source_class: str, issue_time: Column | dt.datetime | None = None) -> DataFrame:
    """Provenance of a forecast: issue time, whole lead hours, class. Archive rows carry nulls."""
    if issue_time is None:
        issue = F.lit(None).cast("timestamp")
    else:
        issue = issue_time if isinstance(issue_time, Column) else F.lit(issue_time).cast("timestamp")
    lead = F.floor((F.unix_timestamp("time") - F.unix_timestamp(issue)) / 3600).cast("int")
    return df.withColumns({"issue_time": issue, "lead_h": lead, "source_class": F.lit(source_class)})


def lead_rows(df: DataFrame, variables: Sequence[str], days: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """``<var>_previous_dayN`` columns to one row per lead day N with plain names, in one pass."""
    keep = [c for c in ("station_id", "time", "cell_lat", "cell_lon") if c in df.columns]
    have = {d: [v for v in variables if f"{v}_previous_day{d}" in df.columns] for d in days}
    seen = [v for v in variables if any(v in vs for vs in have.values())]
    rows = [
        F.struct(
            F.lit(d).alias("lead_day"),
            *[(F.col(f"{v}_previous_day{d}") if v in have[d] else F.lit(None)).cast("double").alias(v) for v in seen],
        )
        for d in days if have[d]
    ]
    out = df.select(*keep, F.explode(F.array(*rows)).alias("r")).select(*keep, "r.*")
    return derive(out.withColumn("source_class", F.lit("previous_run")))


# -- readings ---------------------------------------------------------------
def read_bulk_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bulk archive files as strings; compression follows the file name."""
    return spark.read.option("header", "true").option("inferSchema", "false").csv(path)


def bulk_readings(df: DataFrame, station: str = "station_id") -> DataFrame:
    return df.where(F.col("parameter") == POLLUTANT).select(
        F.col(station).alias("station_id"), "datetime", F.expr("try_cast(value AS double)").alias("value")
    )


def read_airport_csv(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.option("header", "true").option("comment", "#").option("nullValue", "M").csv(path)
    )


def airport_hourly(df: DataFrame, station: str = "station") -> DataFrame:
    """Airport reports to one row per station and hour in metric units."""
    def num(c: str) -> Column:
        if c not in df.columns:
            return F.lit(None).cast("double")
        return F.expr(f"try_cast(nullif(nullif(nullif({c}, 'M'), ''), 'None') AS double)")

    stamp = F.try_to_timestamp(F.col("valid"), F.lit("yyyy-MM-dd HH:mm"))
    obs = df.select(
        F.col(station).alias("metar_station"), F.date_trunc("hour", stamp).alias("time"),
        (num("vsby") * MILES_TO_KM).alias("vis"),
        ((num("tmpf") - 32.0) * 5.0 / 9.0).alias("t"), ((num("dwpf") - 32.0) * 5.0 / 9.0).alias("td"),
        num("relh").alias("rh"), (num("sknt") * KNOTS_TO_MS).alias("ws"), num("drct").alias("wd"),
        (num("p01i") * INCH_TO_MM).alias("rain"), num("mslp").alias("p"),
    ).where(F.col("time").isNotNull())
    return obs.groupBy("metar_station", "time").agg(
        F.avg("vis").alias("visibility_km"), F.min("vis").alias("visibility_km_min"),
        F.avg("t").alias("temp_c"), F.avg("td").alias("dew_point_c"), F.avg("rh").alias("relative_humidity"),
        F.avg("ws").alias("wind_speed_ms"), F.avg("wd").alias("wind_direction_deg"),
        F.max("rain").alias("precip_mm"), F.avg("p").alias("mslp_hpa"), F.count("*").alias("n_obs"),
    ).withColumn("dew_point_depression_c", F.col("temp_c") - F.col("dew_point_c"))


def fire_events(df: DataFrame, product: Column | str) -> DataFrame:
    """Detection CSV rows (strings) to typed events; acq_time is HHMM without padding."""
    hhmm = F.expr("try_cast(acq_time AS int)")
    time = F.to_timestamp("acq_date", "yyyy-MM-dd") + F.make_dt_interval(
        F.lit(0), F.floor(hhmm / 100).cast("int"), (hhmm % 100).cast("int"), F.lit(0)
    )
    return df.select(
        time.alias("time"),
        *[F.expr(f"try_cast({c} AS double)").alias(c) for c in ("latitude", "longitude", "frp")],
        F.col("confidence").cast("string").alias("confidence"), F.col("daynight").cast("string").alias("daynight"),
        (product if isinstance(product, Column) else F.lit(product)).alias("product"),
    )


HISTORY_SOURCE = "historical_hourly_2015_2020"


def history_hourly(
    df: DataFrame, id_map: DataFrame, zone: str = "Asia/Kolkata", cutoff: dt.date | None = dt.date(2021, 1, 1)
) -> DataFrame:
    """Historical hourly CSV (StationId, Datetime, PM2.5) to flagged UTC hours.

    ``id_map`` has station_id, their_id. Rows at or after ``cutoff`` belong to the live feed.
    """
    local = F.try_to_timestamp(F.col("Datetime"), F.lit("yyyy-MM-dd HH:mm:ss"))
    rows = (
        df.select(F.col("StationId").alias("their_id"), local.alias("local"),
                  F.expr("try_cast(`PM2.5` AS double)").alias("pm25"))
        .where("pm25 is not null and local is not null")
        .join(id_map.select("station_id", "their_id"), "their_id")
        .withColumn("time", F.date_trunc("hour", F.to_utc_timestamp("local", zone)))
    )
    hourly = rows.groupBy("station_id", "time").agg(
        F.avg("pm25").alias("pm25"), F.min("pm25").alias("pm25_min"), F.max("pm25").alias("pm25_max"),
        F.count("*").alias("n_obs"),
    )
    out = flag_quality(hourly).withColumn("source", F.lit(HISTORY_SOURCE))
    return out if cutoff is None else out.where(F.to_date("time") < F.lit(cutoff))


# -- location metadata ------------------------------------------------------
def read_locations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOCATION_SCHEMA).option("multiLine", "true").json(path)


def _stamp(c: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.expr("CAST(NULL AS timestamp)"))


def _has_pollutant() -> Column:
    return F.exists("sensors", lambda s: s["parameter"]["name"] == POLLUTANT)


def live_sensors(df: DataFrame, now: dt.datetime, stale_days: int = SENSOR_STALE_DAYS) -> DataFrame:
    """Keep pollutant sensors seen recently; an unknown or unreadable last-seen is no evidence of death."""
    cutoff = F.lit(now - dt.timedelta(days=stale_days)).cast("timestamp")
    kept = F.filter(
        "sensors",
        lambda s: (s["parameter"]["name"] == POLLUTANT)
        & (_stamp(s["datetimeLast"]["utc"]).isNull() | (_stamp(s["datetimeLast"]["utc"]) >= cutoff)),
    )
    return df.withColumn("sensor_ids", F.transform(kept, lambda s: s["id"])).drop("sensors")


def discover(
    locations: DataFrame, roster: DataFrame, now: dt.datetime, centre: tuple[float, float],
    include_configured: bool = False,
) -> DataFrame:
    """Live official pollutant stations not in the roster, with nearest roster station and co-location flag."""
    seen = _stamp(F.col("datetimeLast.utc"))
    live = locations.where(
        _has_pollutant()
        & F.coalesce(F.col("provider.name"), F.lit("")).isin(*OFFICIAL_PROVIDERS)
        & (seen >= F.lit(now - dt.timedelta(days=LIVE_DAYS)).cast("timestamp"))
        & F.col("coordinates.latitude").isNotNull()
    )
    if not include_configured:
        live = live.join(roster.select(F.col("location_id").alias("id")), "id", "left_anti")
    name = F.trim(F.coalesce("name", F.lit("")))
    lat, lon = F.col("coordinates.latitude"), F.col("coordinates.longitude")
    out = live.select(
        F.col("id").alias("location_id"), name.alias("raw_name"), names.clean_name(name).alias("name"),
        names.agency(name).alias("agency"), F.col("provider.name").alias("provider"),
        F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"), lat.alias("l_lat"), lon.alias("l_lon"),
        F.to_date(_stamp(F.col("datetimeFirst.utc"))).alias("first"), F.to_date(seen).alias("last"),
        F.round(haversine_km(F.lit(centre[0]), F.lit(centre[1]), lat, lon), 1).alias("km_from_centre"),
    )
    sites = roster.select(
        F.col("station_id").alias("nearest_configured"), F.col("name").alias("nearest_name"),
        F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"),
    )
    near = nearest(out, sites, "location_id", "nearest_configured")
    return near.withColumn("nearest_km", F.round("km", 2)).withColumn("colocated", F.col("km") < COLOCATED_KM).drop(
        "l_lat", "l_lon", "r_lat", "r_lon", "km"
    )


def allocate_ids(records: DataFrame, roster: DataFrame, order: str = "km_from_centre") -> DataFrame:
    """Continue the id series of every prefix in record order; co-located records are left out.

    Records are numbered by ranges of (prefix, order), so a prefix with all of them is spread over tasks.
    """
    fresh = records.where(~F.coalesce("colocated", F.lit(False)))
    fresh = fresh.withColumn("city", names.city_of(F.col("raw_name"))).withColumn("prefix", names.prefix_of(F.col("city")))
    used = roster.select(
        F.regexp_extract("station_id", r"^([A-Z]+)(\d+)", 1).alias("prefix"),
        F.expr(r"try_cast(regexp_extract(station_id, '^([A-Z]+)(\\d+)', 2) AS int)").alias("n"),
    ).where("n is not null").groupBy("prefix").agg(F.max("n").alias("used"))
    number = F.coalesce("used", F.lit(0)) + F.col("rank") + 1
    return (
        ordered(fresh.drop("rank"), ["prefix"], [order, "location_id"], "rank")
        .join(used, "prefix", "left")
        .withColumn("station_id", F.concat("prefix", F.lpad(number.cast("string"), F.greatest(F.lit(3), F.length(number.cast("string"))), F.lit("0"))))
        .drop("used", "rank")
    )


# -- export -----------------------------------------------------------------
def export(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", "true").csv(path)
    else:
        writer.option("compression", "zstd").parquet(path)
