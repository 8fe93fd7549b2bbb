"""Store, landed files, quality."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from skycast import config
from skycast.functions import names
from skycast.operators.quality import (
    column_coverage, flag_histogram, flag_quality, reconstruction_checks, stable_basket, step_changes, to_hourly,
)
from skycast.session import scratch
from skycast.sources import readers as rd
from skycast.sources import store as st

from . import frames as fr
from .registry import query

HOURLY = "station_id, t:time, d:pm25, d:pm25_min, d:pm25_max, i:n_obs"


def _store(spark) -> st.Store:
    return st.Store(spark, scratch(spark, "store"))


@query("s01_partitioned_write", f"{HOURLY}, quality_flag, d:pm25_clean", "FROM v_obs")
def _(spark, sf):
    store = _store(spark)
    store.write(fr.observations(spark, sf), "cpcb")
    store.write(fr.observations(spark, sf), "cpcb")
    return store.read_range("cpcb", *fr.period(spark, sf))


def _two_sided(spark, sf, prefer):
    """Multi-reading hours arrive twice as high over the hours held; single-reading hours stay."""
    store = _store(spark)
    held = fr.hourly(spark, sf)
    store.write(held, "cpcb")
    fresh = held.where("n_obs > 1").select("station_id", "time", (F.col("pm25") * 2).alias("pm25"), "n_obs", F.lit("api").alias("source"))
    store.write(fresh, "cpcb", merge_on=("station_id", "time"), prefer=prefer)
    return store.read_range("cpcb", *fr.period(spark, sf), columns=["station_id", "time", "pm25", "n_obs", "source"])


@query("s02_merge_write", "station_id, t:time, d:pm25=CASE WHEN n_obs > 1 THEN pm25 * 2 ELSE pm25 END, i:n_obs, source=CASE WHEN n_obs > 1 THEN 'api' END", "FROM v_hourly")
def _(spark, sf):
    return _two_sided(spark, sf, "incoming")


@query("s03_merge_keep_existing", "station_id, t:time, d:pm25, i:n_obs, source=CAST(NULL AS VARCHAR)", "FROM v_hourly")
def _(spark, sf):
    return _two_sided(spark, sf, "existing")


@query("s04_shrink_guard", "date, i:incoming_rows=a, i:stored_rows=b, d:lost_share=1 - a / b",
       "FROM (SELECT CAST(time AS DATE) AS date, count(*) FILTER (WHERE pm25 > 320) AS a, count(*)::DOUBLE AS b FROM v_hourly GROUP BY 1) WHERE a > 0 AND a < 0.5 * b")
def _(spark, sf):
    stored = fr.hourly(spark, sf)
    return st.shrink_findings(stored.where("pm25 > 320"), stored)


@query("s06_read_range", "station_id, t:time, d:pm25", "FROM v_hourly WHERE time >= (SELECT date_trunc('day', min(ts)) + INTERVAL 5 DAY FROM events) AND time < (SELECT date_trunc('day', min(ts)) + INTERVAL 12 DAY FROM events)")
def _(spark, sf):
    store = _store(spark)
    store.write(fr.hourly(spark, sf), "cpcb")
    first = dt.date.fromisoformat(fr.period(spark, sf)[0])
    return store.read_range("cpcb", first + dt.timedelta(days=5), first + dt.timedelta(days=11), ["station_id", "time", "pm25"])


@query("s07_missing_dates", "date",
       "FROM (SELECT DISTINCT CAST(time AS DATE) AS date FROM v_hours) WHERE date NOT IN (SELECT CAST(time AS DATE) FROM v_hourly WHERE day(time) % 4 <> 0)")
def _(spark, sf):
    """A dataset that lacks every fourth day of the month."""
    store = st.Store(spark, scratch(spark, "gaps"))
    store.write(fr.hourly(spark, sf).where(F.dayofmonth("time") % 4 != 0), "cpcb")
    return store.missing_dates("cpcb", *fr.period(spark, sf))


@query("s08_coverage", "dataset, i:days, first, last, i:rows, d:age_hours",
       """FROM (SELECT dataset, count(DISTINCT d) AS days, min(d) AS first, max(d) AS last, count(*) AS rows,
         round(greatest(0.0, (epoch(TIMESTAMP '2024-01-31 06:00:00') - epoch(CAST(max(d) AS TIMESTAMP) + INTERVAL 1439 MINUTE)) / 3600.0), 1) AS age_hours
         FROM (SELECT 'cpcb' AS dataset, CAST(time AS DATE) AS d FROM v_hourly UNION ALL SELECT 'cams_archive', CAST(time AS DATE) FROM v_cams
               UNION ALL SELECT 'meteo_archive', CAST(time AS DATE) FROM v_meteo) GROUP BY 1
         UNION ALL SELECT 'fires', 0, NULL, NULL, 0, NULL)""")
def _(spark, sf):
    return _coverage(spark, sf)


def _coverage(spark, sf):
    def dated(df, name):
        return df.select(F.lit(name).alias("dataset"), F.to_date("time").alias("date"))

    parts = [dated(fr.hourly(spark, sf), "cpcb"), dated(fr.cams(spark, sf), "cams_archive"), dated(fr.meteo(spark, sf), "meteo_archive")]
    return st.coverage_summary(spark, parts, ["cpcb", "cams_archive", "meteo_archive", "fires"], fr.NOW)


@query("s09_latest_run", "station_id, t:issue_time, t:time, d:pm2_5, i:lead_h",
       "FROM v_runs WHERE CAST(issue_time AS DATE) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders JOIN lineitem ON l_orderkey = o_orderkey)")
def _(spark, sf):
    runs = fr.cams_runs(spark, sf).withColumn("date", F.to_date("issue_time"))
    return st.newest_partition(runs).select("station_id", "issue_time", "time", "pm2_5", "lead_h")


def _dated(df):
    return df.withColumn("date", F.to_date("time"))


@query("s11_short_partitions", "date, i:stations=n", "FROM (SELECT CAST(time AS DATE) AS date, count(DISTINCT station_id) AS n FROM v_settled GROUP BY 1) WHERE n < 10")
def _(spark, sf):
    return st.short_partitions(_dated(fr.cams_settled(spark, sf)), 10)


@query("s11_missing_stations", "station_id", "FROM v_stations WHERE station_id NOT IN (SELECT station_id FROM v_settled WHERE time = (SELECT max(l_shipdate) FROM lineitem))")
def _(spark, sf):
    return st.missing_stations(_dated(fr.cams_settled(spark, sf)), fr.stations(spark, sf).select("station_id"))


@query("s11_stations_missing_from", "station_id", "FROM v_stations WHERE station_id NOT IN (SELECT station_id FROM v_settled WHERE time IN (TIMESTAMP '1995-01-02', TIMESTAMP '1995-01-03'))")
def _(spark, sf):
    days = [dt.date(1995, 1, 2), dt.date(1995, 1, 3)]
    return st.stations_missing_from(_dated(fr.cams_settled(spark, sf)), fr.stations(spark, sf).select("station_id"), days)


@query("s12_thin_days", "day, i:hours", "FROM (SELECT CAST(time AS DATE) AS day, count(DISTINCT time) AS hours FROM v_metar WHERE time >= TIMESTAMP '2024-01-24' AND time < TIMESTAMP '2024-01-31' GROUP BY 1) WHERE hours < 24")
def _(spark, sf):
    return st.thin_days(fr.metar(spark, sf), fr.TODAY, min_hours=24)


@query("s13_heal_candidates", "date, i:hours=coalesce(n, 0)", """FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-24', DATE '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS date)
  LEFT JOIN (SELECT CAST(time AS DATE) AS d, count(DISTINCT time) AS n FROM v_metar GROUP BY 1) ON d = date WHERE coalesce(n, 0) < 24""")
def _(spark, sf):
    return st.heal_candidates(fr.metar(spark, sf), dt.date(2024, 2, 3))


EXPANDED = """FROM (SELECT x.new_id AS station_id, c.time, c.pm2_5 FROM (
    SELECT n.station_id AS new_id, k.donor FROM v_stations n CROSS JOIN
      (SELECT station_id AS donor, lat, lon FROM v_stations WHERE k % 2 = 0) k
    WHERE n.k % 2 = 1
    QUALIFY row_number() OVER (PARTITION BY n.station_id ORDER BY pow(n.lat - k.lat, 2) + pow(n.lon - k.lon, 2), k.donor) = 1) x
  JOIN v_cams c ON c.station_id = x.donor)"""


@query("s14_expand_gridded", "station_id, t:time, d:pm2_5", EXPANDED)
def _(spark, sf):
    """Odd-numbered stations joined the roster later; they take the rows of the nearest served cell."""
    roster = fr.stations(spark, sf)
    old = roster.where("k % 2 = 0").select("station_id", F.col("lat").alias("cell_lat"), F.col("lon").alias("cell_lon"), F.col("name").alias("station_name"))
    held = fr.cams(spark, sf).join(old, "station_id")
    out = st.expand_gridded(_dated(held), roster)
    return out.select("station_id", "time", "pm2_5")


def _landed_json(spark, sf):
    """One JSON object per station: parallel arrays of hours and values."""
    rows = fr.cams(spark, sf).groupBy("station_id").agg(
        F.array_sort(F.collect_list(F.struct(F.date_format("time", "yyyy-MM-dd'T'HH:mm").alias("t"), "pm2_5", "pm10"))).alias("r")
    ).join(fr.stations(spark, sf).select("station_id", "lat", "lon"), "station_id")
    return rows.select(
        F.col("station_id").alias("cell_key"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
        F.struct(F.expr("transform(r, x -> x.t)").alias("time"), F.expr("transform(r, x -> x.pm2_5)").alias("pm2_5"),
                 F.expr("transform(r, x -> x.pm10)").alias("pm10")).alias("hourly"),
    )


@query("s15_hourly_json", "cell_key=c.station_id, d:cell_lat=s.lat, d:cell_lon=s.lon, t:time, d:pm2_5, d:pm10", "FROM v_cams c JOIN v_stations s ON c.station_id = s.station_id")
def _(spark, sf):
    path = scratch(spark, "json")
    _landed_json(spark, sf).write.option("ignoreNullFields", "false").json(path)
    return rd.hourly_rows(rd.read_hourly_json(spark, path, ["pm2_5", "pm10"], multi_line=False), ["pm2_5", "pm10"])


@query("s16_cell_fan_out", "i:location_id=s_suppkey, t:time=c.time, d:pm2_5=c.pm2_5", "FROM supplier LEFT JOIN v_cams c ON c.station_id = 'S' || lpad(CAST(s_suppkey // 10 AS VARCHAR), 5, '0')")
def _(spark, sf):
    lookup = fr.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("location_id"), fr.station_of("s_suppkey", 10).alias("cell_key"))
    cells = fr.cams(spark, sf).select(F.col("station_id").alias("cell_key"), "time", "pm2_5")
    return rd.cell_fan_out(lookup, cells)


@query("s17_run_stamp", "i:l_orderkey, i:l_linenumber, t:time=l_shipdate, t:issue_time=o_orderdate, i:lead_h=CAST(floor((epoch(l_shipdate) - epoch(o_orderdate)) / 3600) AS BIGINT), source_class='live_run'", "FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(spark, sf):
    s = fr.table(spark, sf, "lineitem").join(fr.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    df = s.select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("time"), F.col("o_orderdate").cast("timestamp").alias("o"))
    return rd.stamp_run(df, "live_run", F.col("o")).drop("o")


LONG = """FROM (SELECT station_id, blk, n AS lead_day, CASE n WHEN 1 THEN p WHEN 2 THEN v ELSE s END AS wind_speed_10m,
  CASE n WHEN 1 THEN c ELSE NULL END AS wind_direction_10m FROM v_blocks CROSS JOIN (SELECT unnest([1, 2, 3]) AS n))"""


@query("s18_lead_rows", "station_id, t:time=epoch_ms(blk * 43200000), i:lead_day, d:wind_speed_10m, d:u10=-wind_speed_10m * sin(radians(wind_direction_10m))", LONG)
def _(spark, sf):
    wide = fr._blocks(spark, sf).select(
        "station_id", F.timestamp_seconds(F.col("blk") * fr.FORECAST_BLOCK_S).alias("time"), F.col("p").alias("wind_speed_10m_previous_day1"),
        F.col("v").alias("wind_speed_10m_previous_day2"), F.col("s").alias("wind_speed_10m_previous_day3"),
        F.col("c").alias("wind_direction_10m_previous_day1"),
    )
    return rd.lead_rows(wide, ["wind_speed_10m", "wind_direction_10m"]).select("station_id", "time", "lead_day", "wind_speed_10m", "u10")


@query("s19_bulk_csv", "station_id, i:n=count(*), d:total=sum(value * 5.0)", "FROM v_events WHERE event_type <> 'error' GROUP BY 1")
def _(spark, sf):
    path = scratch(spark, "csv")
    kind = F.when(F.col("event_type") == "error", "pm10").otherwise("pm25")
    e = fr.events(spark, sf)
    e.select("station_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"), kind.alias("parameter"),
             (F.col("value") * fr.SCALE).alias("value")).write.option("header", "true").option("compression", "gzip").csv(path)
    return rd.bulk_readings(rd.read_bulk_csv(spark, path)).groupBy("station_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


AIRPORT = """FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'VIDD' ELSE 'VIDP' END AS metar_station, date_trunc('hour', ts) AS time,
  avg(CASE WHEN value >= 5 THEN value * 1.609344 END) AS visibility_km, min(CASE WHEN value >= 5 THEN value * 1.609344 END) AS visibility_km_min,
  avg((value - 32.0) * 5.0 / 9.0) AS temp_c, avg((value / 2.0 - 32.0) * 5.0 / 9.0) AS dew_point_c, avg(value * 0.514444) AS wind_speed_ms,
  max(value * 25.4) AS precip_mm, count(*) AS n_obs FROM v_events WHERE event_type = 'signup' GROUP BY 1, 2)"""


@query("s20_airport_csv", "metar_station, t:time, d:visibility_km, d:visibility_km_min, d:temp_c, d:dew_point_c, d:wind_speed_ms, d:precip_mm, i:n_obs, d:dew_point_depression_c=temp_c - dew_point_c", AIRPORT)
def _(spark, sf):
    v = F.col("value").cast("string")
    raw = fr.events(spark, sf).where("event_type = 'signup'").select(
        F.when(F.col("event_id") % 3 == 0, "VIDD").otherwise("VIDP").alias("station"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("valid"),
        F.when(F.col("value") >= 5, v).otherwise("M").alias("vsby"), v.alias("tmpf"), (F.col("value") / 2).cast("string").alias("dwpf"),
        v.alias("sknt"), v.alias("p01i"),
    )
    return rd.airport_hourly(raw).drop("relative_humidity", "wind_direction_deg", "mslp_hpa")


@query("s21_fire_csv", "t:time=date_trunc('minute', ts), d:latitude=28.0 + user_id / 1000.0, d:frp=value, product='VIIRS_SNPP_SP'", "FROM v_events WHERE event_type = 'error'")
def _(spark, sf):
    e = fr.events(spark, sf).where("event_type = 'error'")
    raw = e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("acq_date"), (F.hour("ts") * 100 + F.minute("ts")).cast("string").alias("acq_time"),
        (28.0 + F.col("user_id") / 1000.0).cast("string").alias("latitude"), F.lit("75").alias("longitude"), F.col("value").cast("string").alias("frp"),
        F.lit("n").alias("confidence"), F.lit("D").alias("daynight"),
    )
    return rd.fire_events(raw, "VIIRS_SNPP_SP").select("time", "latitude", "frp", "product")


@query("s22_product_family", "chunk_start=d, product=p", """FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) CROSS JOIN
  (SELECT unnest(['SP1', 'SP2', 'NRT1', 'NRT2', 'NRT3']) AS p) WHERE (date_diff('day', d, DATE '2001-06-01') > 60) = (p LIKE 'SP%')""")
def _(spark, sf):
    chunks = fr.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("chunk_start")).distinct()
    return st.product_family(chunks, fr.RUN_TODAY, ["NRT1", "NRT2", "NRT3"], ["SP1", "SP2"])


HISTORY = """FROM (SELECT station_id, date_trunc('hour', o_orderdate - INTERVAL 330 MINUTE) AS time, avg(price) AS pm25, count(*) AS n_obs FROM (
    SELECT 'S' || lpad(CAST((o_custkey % 100) // 10 AS VARCHAR), 5, '0') AS station_id, o_orderdate, o_totalprice / 1000.0 AS price FROM orders) GROUP BY 1, 2)
  WHERE CAST(time AS DATE) < DATE '2001-01-01'"""


@query("s23_historical_csv", "station_id, t:time, d:pm25, i:n_obs, source='historical_hourly_2015_2020'", HISTORY)
def _(spark, sf):
    """Order values as an old hourly archive in local time; the id map has ten of its ids per station."""
    o = fr.table(spark, sf, "orders")
    raw = o.select((F.col("o_custkey") % 100).cast("string").alias("StationId"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("Datetime"),
                   (F.col("o_totalprice") / 1000.0).cast("string").alias("PM2.5"))
    ids = spark.range(100).select(fr.station_of("id", 10).alias("station_id"), F.col("id").cast("string").alias("their_id"))
    return rd.history_hourly(raw, ids, cutoff=dt.date(2001, 1, 1)).select("station_id", "time", "pm25", "n_obs", "source")


def _location_docs(spark, sf):
    s = fr.locations(spark, sf)
    stamp = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    utc = F.date_format("last_seen", stamp)
    sensor = F.struct(F.col("location_id").alias("id"), F.struct(F.lit("pm25").alias("name")).alias("parameter"), F.struct(utc.alias("utc")).alias("datetimeLast"))
    other = F.struct((-F.col("location_id")).alias("id"), F.struct(F.lit("no2").alias("name")).alias("parameter"), F.struct(utc.alias("utc")).alias("datetimeLast"))
    return s.select(
        F.col("location_id").alias("id"), F.col("loc_name").alias("name"), F.struct(F.lit("CPCB").alias("name")).alias("provider"),
        F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("coordinates"), F.array(other, sensor).alias("sensors"),
        F.struct(F.date_format("first_seen", stamp).alias("utc")).alias("datetimeFirst"), F.struct(utc.alias("utc")).alias("datetimeLast"),
    )


DISCOVER = """FROM (SELECT l.*, n.station_id AS near, n.km FROM v_locations l JOIN (
    SELECT l.location_id AS lid, s.station_id, 2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin((radians(s.lat) - radians(l.lat)) / 2), 2)
      + cos(radians(l.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - l.lon) / 2), 2))) AS km
    FROM v_locations l CROSS JOIN v_stations s QUALIFY row_number() OVER (PARTITION BY l.location_id ORDER BY km, s.station_id) = 1) n ON n.lid = l.location_id
  WHERE l.last_seen >= TIMESTAMP '2021-12-17' AND l.location_id NOT IN (SELECT location_id FROM v_stations))"""


@query("s24_discover", "i:location_id, name=trim(split_part(loc_name, ',', 1)), agency='DPCC', d:lat=round(lat, 6), d:lon=round(lon, 6), last=CAST(last_seen AS DATE), nearest_configured=near, d:nearest_km=round(km, 2), colocated=km < 0.25", DISCOVER)
def _(spark, sf):
    out = rd.discover(_location_docs(spark, sf), fr.stations(spark, sf), dt.datetime(2021, 12, 31), (28.6, 77.2))
    return out.select("location_id", "name", "agency", "lat", "lon", "last", "nearest_configured", "nearest_km", "colocated")


@query("s25_live_sensors", "i:id=location_id, i:sensors=CASE WHEN last_seen >= TIMESTAMP '2021-12-01' THEN 1 ELSE 0 END", "FROM v_locations")
def _(spark, sf):
    out = rd.live_sensors(_location_docs(spark, sf), dt.datetime(2021, 12, 31))
    return out.select("id", F.size("sensor_ids").alias("sensors"))


@query("s26_export", "station_id, t:time, d:pm25", "FROM v_hourly")
def _(spark, sf):
    a, b = scratch(spark, "export"), scratch(spark, "export")
    df = fr.hourly(spark, sf).select("station_id", "time", "pm25")
    rd.export(df, a)
    rd.export(df, b, "csv")
    back = spark.read.schema("station_id string, time timestamp, pm25 double").option("header", "true").csv(b)
    return spark.read.parquet(a).join(back.select("station_id", "time"), ["station_id", "time"], "left_semi")


@query("s27_mirror", "d:total=sum(pm25), i:rows=count(*)", "FROM v_hourly")
def _(spark, sf):
    store, other = _store(spark), _store(spark)
    obs = fr.hourly(spark, sf)
    store.write(obs, "cpcb")
    other.write(obs.where("n_obs > 1"), "cpcb")
    store.write(obs, "cpcb")
    store.mirror(["cpcb", "absent"], other)
    return other.scan("cpcb").agg(F.sum("pm25").alias("total"), F.count("*").alias("rows"))


GATE = """FROM (SELECT chunk, min(day) AS first, max(day) AS last, sum(e) AS expected, sum(f) AS failed, min(s) AS complete FROM (
    SELECT CAST(floor(date_diff('day', DATE '1995-01-01', day) / 15) AS BIGINT) AS chunk, day, count(*) AS e, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, max(o_orderstatus = 'O') AS s
    FROM (SELECT CAST(o_orderdate AS DATE) AS day, o_orderstatus FROM orders) GROUP BY 1, 2) GROUP BY 1)"""


@query("s28_chunk_gate", "i:chunk, first, last, i:expected, i:failed, complete, d:failure_rate=failed / expected, action=CASE WHEN complete THEN 'skip' WHEN failed / expected > 0.25 THEN 'refuse' ELSE 'write' END", GATE)
def _(spark, sf):
    o = fr.table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "failed").otherwise("ok")
    manifest = o.select(F.col("o_custkey").alias("station_id"), F.to_date("o_orderdate").alias("day"), status.alias("status"), (F.col("o_orderstatus") == "O").alias("stored"))
    return st.chunk_gate(manifest, dt.date(1995, 1, 1))


@query("s29_config_tables", "i:stage, stage_name, i:orders=count(*)", """FROM (SELECT CASE WHEN a <= 300 THEN 1 WHEN a <= 400 THEN 2 WHEN a <= 450 THEN 3 ELSE 4 END AS stage,
  CASE WHEN a <= 300 THEN 'Poor' WHEN a <= 400 THEN 'Very Poor' WHEN a <= 450 THEN 'Severe' ELSE 'Severe Plus' END AS stage_name
  FROM (SELECT floor(o_totalprice / 1000.0) AS a FROM orders) WHERE a BETWEEN 201 AND 1000) GROUP BY 1, 2""")
def _(spark, sf):
    """Configured stage bounds as a table, joined to a whole-number index."""
    a = fr.table(spark, sf, "orders").select(F.floor(F.col("o_totalprice") / 1000.0).alias("a"))
    stages = F.broadcast(config.stages_frame(spark, fr.JANUARY))
    return a.join(stages, F.col("a").between(F.col("aqi_min"), F.col("aqi_max"))).groupBy("stage", "stage_name").agg(F.count("*").alias("orders"))


# -- quality ----------------------------------------------------------------
@query("q1_hourly_readings", HOURLY, "FROM v_hourly")
def _(spark, sf):
    return to_hourly(fr.text_readings(spark, sf))


@query("q2_quality_flags", f"{HOURLY}, quality_flag, d:pm25_clean", "FROM v_obs")
def _(spark, sf):
    return fr.observations(spark, sf)


WRITTEN = """FROM (SELECT station_id, time, CASE WHEN pm25 < 1 THEN 'suspect_low' WHEN pm25 > 1200 THEN 'suspect_high'
    WHEN same AND count(*) OVER (PARTITION BY station_id, run) >= 6 THEN 'stuck' ELSE 'ok' END AS quality_flag
  FROM (SELECT *, sum(CASE WHEN same THEN 1 ELSE 0 END) OVER (PARTITION BY station_id ORDER BY time) AS run
        FROM (SELECT *, coalesce(round(pm25, 2) = lag(round(pm25, 2)) OVER (PARTITION BY station_id ORDER BY time), false) AS same FROM v_hourly)))"""


@query("q2_quality_flags_as_written", "station_id, t:time, quality_flag", WRITTEN)
def _(spark, sf):
    return flag_quality(fr.hourly(spark, sf), compat=True).select("station_id", "time", "quality_flag")


STEPS = """FROM (SELECT station_id, block, median, n, median / lag(median) OVER (PARTITION BY station_id ORDER BY block) AS step_ratio FROM (
    SELECT station_id, epoch_ms(CAST(floor(epoch(time) / 2592000) * 2592000000 AS BIGINT)) AS block, quantile_cont(pm2_5, 0.5) AS median, count(*) AS n FROM v_settled GROUP BY 1, 2))
  WHERE step_ratio > 1.15 OR step_ratio < 1 / 1.15"""


@query("q3_step_changes", "station_id, t:block, d:median, i:n, d:step_ratio", STEPS)
def _(spark, sf):
    df = fr.cams_settled(spark, sf).withColumnRenamed("pm2_5", "pm25").withColumn("quality_flag", F.lit("ok"))
    return step_changes(df, ratio=1.15)


@query("q4_flag_histogram", "quality_flag, i:hours=count(*)", "FROM v_obs GROUP BY 1")
def _(spark, sf):
    return flag_histogram(fr.observations(spark, sf))


@query("q5_column_coverage", "column=c, i:non_null=n, d:share=n / t", """FROM (SELECT count(*)::DOUBLE AS t, count(obs_lag_24h) AS a, count(obs_mean_72h) AS b, count(cams_pm2_5) AS c0 FROM v_base),
  LATERAL (SELECT unnest(['obs_lag_24h', 'obs_mean_72h', 'cams_pm2_5']) AS c, unnest([a, b, c0]) AS n)""")
def _(spark, sf):
    return column_coverage(fr.base(spark, sf, False), ["obs_lag_24h", "obs_mean_72h", "cams_pm2_5"])


@query("q6_stable_basket", "station_id, i:hours=count(*)", """FROM v_obs WHERE station_id IN (SELECT station_id FROM v_obs WHERE pm25_clean IS NOT NULL GROUP BY 1
  HAVING count(*) >= 0.74 * (SELECT count(DISTINCT time) FROM v_obs)) GROUP BY 1""")
def _(spark, sf):
    return stable_basket(fr.observations(spark, sf), 0.74).groupBy("station_id").agg(F.count("*").alias("hours"))


REQUIRED = ["pm25_clean", "obs_lag_24h", "obs_mean_24h", "obs_gap_h", "cams_pm2_5", "met_wind_speed_10m", "metar_visibility_km", "fire_count_24h"]
GATE_ROWS = """FROM (SELECT count(*) AS n, count(DISTINCT station_id || CAST(time AS VARCHAR)) AS k, (SELECT count(*) FROM v_stations) * 720 AS want,
  """ + ", ".join(f"count({c}) AS c{i}" for i, c in enumerate(REQUIRED)) + """ FROM v_base), LATERAL (SELECT
  unnest(['rows', 'duplicate_keys', """ + ", ".join(f"'column:{c}'" for c in REQUIRED) + """]) AS item,
  unnest([n, n - k, """ + ", ".join(f"c{i}" for i in range(len(REQUIRED))) + """]) AS observed,
  unnest([want, 0, """ + ", ".join("1" for _ in REQUIRED) + """]) AS expected)"""


@query("q7_reconstruction_gate", "item, i:observed, i:expected, ok=CASE WHEN item LIKE 'column:%' THEN observed > 0 ELSE observed = expected END", GATE_ROWS)
def _(spark, sf):
    first, last = (dt.date.fromisoformat(d) for d in fr.period(spark, sf))
    return reconstruction_checks(fr.base(spark, sf, False), fr.stations(spark, sf).count(), (last - first).days + 1, REQUIRED).withColumnRenamed("check", "item")


# -- names and ids ----------------------------------------------------------
@query("p7_clean_names", "i:location_id, name=trim(split_part(loc_name, ',', 1)), agency='DPCC', city='Delhi'", "FROM v_locations")
def _(spark, sf):
    n = F.col("loc_name")
    return fr.locations(spark, sf).select("location_id", names.clean_name(n).alias("name"), names.agency(n).alias("agency"), names.city_of(n).alias("city"))


IDS = """FROM (SELECT location_id, row_number() OVER (ORDER BY location_id) AS r FROM v_locations)"""


@query("p8_allocate_ids", "i:location_id, station_id='DL' || lpad(CAST(r + 7 AS VARCHAR), CAST(greatest(3, length(CAST(r + 7 AS VARCHAR))) AS INTEGER), '0')", IDS)
def _(spark, sf):
    """New Delhi records continue the DL series after DL007."""
    rec = fr.locations(spark, sf).select("location_id", F.col("loc_name").alias("raw_name"), F.lit(False).alias("colocated"), F.lit(1.0).alias("km_from_centre"))
    roster = spark.createDataFrame([("DL007",), ("UP003",)], "station_id string")
    return rd.allocate_ids(rec, roster).select("location_id", "station_id")
