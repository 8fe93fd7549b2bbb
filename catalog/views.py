"""The domain frames written as SQL over the driver tables. Names start with v_."""

VIEWS: dict[str, str] = {}

VIEWS["v_events"] = """
SELECT event_id, ts, user_id, event_type, value, props,
       'S' || lpad(CAST(user_id // 15 AS VARCHAR), 5, '0') AS station_id
FROM events"""

# One day in nine a station's sensor is stuck.
VIEWS["v_readings"] = """
SELECT station_id, ts, CASE WHEN (CAST(floor(epoch(ts) / 86400) AS BIGINT) + user_id // 15) % 9 = 0 THEN 30.0 ELSE value END AS value FROM v_events"""

VIEWS["v_hourly"] = """
SELECT station_id, date_trunc('hour', ts) AS time, avg(value * 5.0) AS pm25, min(value * 5.0) AS pm25_min,
       max(value * 5.0) AS pm25_max, count(*) AS n_obs
FROM v_readings GROUP BY 1, 2"""

VIEWS["v_same"] = """
SELECT *, coalesce(round(pm25, 2) = lag(round(pm25, 2)) OVER w AND time - lag(time) OVER w = INTERVAL 1 HOUR, false) AS same
FROM v_hourly WINDOW w AS (PARTITION BY station_id ORDER BY time)"""

VIEWS["v_runs0"] = """
SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY station_id ORDER BY time) AS grp FROM v_same"""

VIEWS["v_obs"] = """
SELECT station_id, time, pm25, pm25_min, pm25_max, n_obs, flag AS quality_flag,
       CASE WHEN flag = 'ok' THEN pm25 END AS pm25_clean
FROM (SELECT *, CASE WHEN pm25 < 1 THEN 'suspect_low' WHEN pm25 > 1200 THEN 'suspect_high'
             WHEN same AND count(*) OVER (PARTITION BY station_id, grp) >= 6 THEN 'stuck' ELSE 'ok' END AS flag
      FROM v_runs0)"""

VIEWS["v_stations"] = """
SELECT 'S' || lpad(CAST(k AS VARCHAR), 5, '0') AS station_id, k,
       'Sector ' || (k + 1) || ' Block ' || (k % 10) AS name,
       CASE k % 4 WHEN 0 THEN 'Delhi' WHEN 1 THEN 'new delhi' WHEN 2 THEN 'Noida' ELSE ' DELHI ' END AS city,
       'DPCC' AS agency, 28.1::DOUBLE + (k * 37 % 100) / 100.0::DOUBLE AS lat, 76.7::DOUBLE + (k * 53 % 100) / 100.0::DOUBLE AS lon,
       balance, location_id
FROM (SELECT s_suppkey // 10 AS k, avg(s_acctbal) AS balance, min(s_suppkey) AS location_id FROM supplier GROUP BY 1)"""

VIEWS["v_hours"] = """
SELECT unnest(generate_series(date_trunc('day', (SELECT min(ts) FROM events)),
       date_trunc('day', (SELECT max(ts) FROM events)) + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS time"""

VIEWS["v_idx"] = "SELECT station_id, time FROM v_stations CROSS JOIN v_hours"

VIEWS["v_blocks"] = """
SELECT station_id, CAST(floor(epoch(ts) / 43200) AS BIGINT) AS blk,
       avg(CASE WHEN event_type = 'view' THEN value END) AS v, avg(CASE WHEN event_type = 'click' THEN value END) AS c,
       avg(CASE WHEN event_type = 'purchase' THEN value END) AS p, avg(CASE WHEN event_type = 'signup' THEN value END) AS s,
       avg(CASE WHEN event_type = 'error' THEN value END) AS e
FROM v_events GROUP BY 1, 2"""

VIEWS["v_block_hours"] = """
SELECT b.*, epoch_ms(CAST(blk * 43200000 + h.h * 3600000 AS BIGINT)) AS time
FROM v_blocks b CROSS JOIN (SELECT unnest(range(0, 12)) AS h) h"""

VIEWS["v_cams"] = "SELECT station_id, time, v * 5.0 AS pm2_5, v * 7.0 AS pm10, 'archive' AS source_class FROM v_block_hours"

VIEWS["v_meteo0"] = """
SELECT station_id, time, v / 4.0 AS temperature_2m, p AS wind_speed_10m, (c * 360.0::DOUBLE / 100.0::DOUBLE) % 360.0::DOUBLE AS wind_direction_10m,
       e * 10.0 AS boundary_layer_height, s * 100.0 AS visibility, s / 4.0 AS "temperature_925hPa", p / 4.0 AS "temperature_850hPa"
FROM v_block_hours"""

VIEWS["v_meteo"] = """
SELECT *, -wind_speed_10m * sin(radians(wind_direction_10m)) AS u10, -wind_speed_10m * cos(radians(wind_direction_10m)) AS v10,
       boundary_layer_height * wind_speed_10m / 3.6 AS ventilation_index,
       temperature_2m - "temperature_925hPa" AS lapse_2m_925, "temperature_925hPa" - "temperature_850hPa" AS lapse_925_850,
       "temperature_925hPa" > temperature_2m AS inversion, boundary_layer_height IS NOT NULL AS blh_available
FROM v_meteo0"""

VIEWS["v_lead"] = """
SELECT station_id, time + n * INTERVAL 1 DAY AS time, n AS lead_day, v / 4.0 AS temperature_2m, p AS wind_speed_10m,
       (c * 360.0::DOUBLE / 100.0::DOUBLE) % 360.0::DOUBLE AS wind_direction_10m
FROM v_block_hours CROSS JOIN (SELECT unnest([1, 2, 3]) AS n)"""

VIEWS["v_metar"] = """
SELECT CASE WHEN event_id % 3 = 0 THEN 'VIDD' ELSE 'VIDP' END AS metar_station, date_trunc('hour', ts) AS time,
       avg(value / 20.0) AS visibility_km, min(value / 20.0) AS visibility_km_min, avg(value / 3.0) AS temp_c,
       avg(value / 6.0) AS dew_point_depression_c, avg(100.0 - value / 6.0) AS relative_humidity, count(*) AS n_obs
FROM v_events WHERE event_type = 'signup' GROUP BY 1, 2"""

VIEWS["v_airport"] = """
SELECT time, visibility_km, visibility_km_min FROM v_metar
WHERE metar_station = (SELECT metar_station FROM v_metar GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""

VIEWS["v_fires"] = "SELECT date_trunc('second', ts) AS time, value AS frp FROM v_events WHERE event_type = 'error' AND day(ts) % 6 <> 0"

VIEWS["v_fire_hours"] = """
SELECT h.time, coalesce(c, 0)::DOUBLE AS fire_count_1h, coalesce(f, 0.0) AS fire_frp_1h,
       date_trunc('day', h.time) IN (SELECT DISTINCT date_trunc('day', time) FROM v_fires) AS fires_available
FROM v_hours h LEFT JOIN (SELECT date_trunc('hour', time) AS time, count(*) AS c, sum(frp) AS f FROM v_fires GROUP BY 1) x
  ON h.time = x.time"""

VIEWS["v_fire_series"] = """
SELECT *, sum(fire_count_1h) OVER (ORDER BY time ROWS 23 PRECEDING) AS fire_count_24h,
       sum(fire_frp_1h) OVER (ORDER BY time ROWS 23 PRECEDING) AS fire_frp_24h,
       sum(fire_count_1h) OVER (ORDER BY time ROWS 71 PRECEDING) AS fire_count_72h
FROM v_fire_hours"""

# The same over every detection.
VIEWS["v_all_fires"] = "SELECT date_trunc('second', ts) AS time, value AS frp FROM v_events WHERE event_type = 'error'"
VIEWS["v_all_fire_hours"] = VIEWS["v_fire_hours"].replace("v_fires", "v_all_fires")
VIEWS["v_all_fire_series"] = VIEWS["v_fire_series"].replace("v_fire_hours", "v_all_fire_hours")

VIEWS["v_corridor"] = """
SELECT 'U' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS upwind_id, n_nationkey * 11.5::DOUBLE + 65.0::DOUBLE AS distance_km,
       (n_nationkey * 29.0::DOUBLE) % 60.0::DOUBLE + 230.0::DOUBLE AS bearing_deg FROM nation"""

# A corridor station with six equal hourly means in a row does not occur; the limits do.
VIEWS["v_corridor_hourly"] = """
SELECT 'U' || lpad(CAST(user_id % 25 AS VARCHAR), 3, '0') AS upwind_id, date_trunc('hour', ts) AS time, avg(value * 5.0) AS pm25
FROM events GROUP BY 1, 2"""

VIEWS["v_corridor_same"] = """
SELECT *, coalesce(round(pm25, 2) = lag(round(pm25, 2)) OVER w AND time - lag(time) OVER w = INTERVAL 1 HOUR, false) AS same
FROM v_corridor_hourly WINDOW w AS (PARTITION BY upwind_id ORDER BY time)"""

VIEWS["v_corridor_runs"] = """
SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY upwind_id ORDER BY time) AS grp FROM v_corridor_same"""

VIEWS["v_corridor_ok"] = """
SELECT upwind_id, time, pm25 FROM (
  SELECT *, count(*) OVER (PARTITION BY upwind_id, grp) AS len FROM v_corridor_runs)
WHERE pm25 >= 1 AND pm25 <= 1200 AND NOT (same AND len >= 6)"""

VIEWS["v_roster_wind"] = """
SELECT time, avg(wind_direction_10m) AS dir, avg(wind_speed_10m) AS speed FROM v_meteo
WHERE station_id IN (SELECT station_id FROM v_stations) GROUP BY 1"""

VIEWS["v_corridor_w"] = """
SELECT o.time, o.pm25, c.distance_km, w.dir, w.speed,
       pow(greatest(cos(radians(w.dir - c.bearing_deg)), 0.0), 2) * exp(-c.distance_km / 200.0) AS w
FROM v_corridor_ok o JOIN v_corridor c USING (upwind_id) JOIN v_roster_wind w ON o.time = w.time"""

VIEWS["v_corridor_sum"] = """
SELECT time, sum(w) AS tw, sum(w * pm25) AS twv, sum(w * distance_km) AS twk, max(dir) AS dir, max(speed) AS speed
FROM v_corridor_w GROUP BY 1"""

VIEWS["v_corridor0"] = """
SELECT s.time, CASE WHEN tw > 1e-6 THEN twv / greatest(tw, 1e-9) END AS upwind_pm25,
       CASE WHEN tw > 1e-6 THEN twk / greatest(tw, 1e-9) END AS upwind_distance_km,
       CASE WHEN tw > 1e-6 AND speed IS NOT NULL
            THEN least(greatest(twk / greatest(tw, 1e-9) / greatest(speed, 3.0), 0.0), 96.0) END AS upwind_transport_h,
       CASE WHEN dir IS NOT NULL THEN (SELECT max(greatest(cos(radians(s.dir - c.bearing_deg)), 0.0)) FROM v_corridor c) END AS upwind_alignment
FROM v_corridor_sum s"""

VIEWS["v_corridor_series"] = """
SELECT a.*, b.upwind_pm25 AS upwind_pm25_advected, l12.upwind_pm25 AS upwind_pm25_lag_12h,
       l24.upwind_pm25 AS upwind_pm25_lag_24h, l36.upwind_pm25 AS upwind_pm25_lag_36h
FROM v_corridor0 a
LEFT JOIN v_corridor0 b ON b.time = a.time - CAST(round_even(a.upwind_transport_h, 0) AS INTEGER) * INTERVAL 1 HOUR
LEFT JOIN v_corridor0 l12 ON l12.time = a.time - INTERVAL 12 HOUR
LEFT JOIN v_corridor0 l24 ON l24.time = a.time - INTERVAL 24 HOUR
LEFT JOIN v_corridor0 l36 ON l36.time = a.time - INTERVAL 36 HOUR"""

VIEWS["v_aligned"] = """
SELECT i.station_id, i.time, o.pm25, o.pm25_clean, o.n_obs AS obs_n, o.quality_flag, a.visibility_km AS metar_visibility_km,
       a.visibility_km_min AS metar_visibility_km_min
FROM v_idx i LEFT JOIN v_obs o USING (station_id, time) LEFT JOIN v_airport a ON a.time = i.time"""


def _lag(col: str, k: int, name: str) -> str:
    return f"lag({col}, {k}) OVER w AS {name}"


def _roll(col: str, width: int, least: int, fn: str, name: str) -> str:
    frame = f"OVER (PARTITION BY station_id ORDER BY time ROWS {width - 1} PRECEDING)"
    return f"CASE WHEN count({col}) {frame} >= {least} THEN {fn}({col}) {frame} END AS {name}"


_FEATURES = ", ".join(
    [_lag("pm25_clean", k, f"obs_lag_{k}h") for k in (1, 2, 3, 6, 12, 24, 48, 72)]
    + [_roll("pm25_clean", w, m, f, f"obs_{n}_{w}h") for w, m in ((3, 1), (24, 14), (72, 43)) for f, n in (("avg", "mean"), ("stddev_samp", "std"))]
    + ["pm25_clean - lag(pm25_clean, 24) OVER w AS obs_delta_24h",
       "CAST(date_diff('hour', last_value(CASE WHEN pm25_clean IS NOT NULL THEN time END IGNORE NULLS) OVER "
       "(PARTITION BY station_id ORDER BY time ROWS UNBOUNDED PRECEDING), time) AS BIGINT) AS obs_gap_h"]
)
_VIS = ", ".join(
    [_lag("metar_visibility_km", k, f"vis_lag_{k}h") for k in (1, 3, 24)]
    + [_roll("metar_visibility_km", 24, 14, "min", "vis_min_24h"), _roll("metar_visibility_km", 24, 14, "avg", "vis_mean_24h")]
)
FEATURES_SQL = _FEATURES
VIEWS["v_features"] = f"SELECT *, {_FEATURES}, {_VIS} FROM v_aligned WINDOW w AS (PARTITION BY station_id ORDER BY time)"

VIEWS["v_base"] = """
SELECT f.*, c.pm2_5 AS cams_pm2_5, m.wind_speed_10m AS met_wind_speed_10m, m.wind_direction_10m AS met_wind_direction_10m,
       m.temperature_2m AS met_temperature_2m, m.boundary_layer_height AS met_boundary_layer_height, m.visibility AS met_visibility,
       fs.fire_count_24h, fs.fire_frp_24h, fs.fire_count_72h, fs.fires_available, u.upwind_pm25, u.upwind_alignment
FROM v_features f LEFT JOIN v_cams c USING (station_id, time) LEFT JOIN v_meteo m USING (station_id, time)
LEFT JOIN v_fire_series fs ON fs.time = f.time LEFT JOIN v_corridor_series u ON u.time = f.time"""

VIEWS["v_sup0"] = """
SELECT b.station_id, b.time AS issue_time, t.time AS target_time, h.h AS horizon_h, t.pm25_clean AS y,
       t.metar_visibility_km AS y_vis, b.obs_lag_1h, b.obs_lag_24h, b.upwind_alignment, b.pm25_clean,
       t.cams_pm2_5 AS cams_pm2_5_tgt, t.met_wind_speed_10m AS met_wind_speed_10m_tgt, t.met_temperature_2m AS met_temperature_2m_tgt,
       t.met_wind_direction_10m AS met_wind_direction_10m_tgt, t.met_visibility AS met_visibility_tgt
FROM v_base b CROSS JOIN (SELECT unnest([24, 48, 72]) AS h) h
JOIN v_base t ON t.station_id = b.station_id AND t.time = b.time + h.h * INTERVAL 1 HOUR
WHERE t.pm25_clean IS NOT NULL"""

_VAL = "TIMESTAMP '2024-01-14 00:00:00' AND TIMESTAMP '2024-01-15 23:59:59'"
_TEST = "TIMESTAMP '2024-01-21 00:00:00' AND TIMESTAMP '2024-01-25 23:59:59'"
_VAL_E = "TIMESTAMP '2024-01-13 00:00:00' AND TIMESTAMP '2024-01-16 23:59:59'"
_TEST_E = "TIMESTAMP '2024-01-20 00:00:00' AND TIMESTAMP '2024-01-26 23:59:59'"


def _touch(r: str) -> str:
    return f"(issue_time BETWEEN {r} OR target_time BETWEEN {r})"


VIEWS["v_sup"] = f"""
SELECT *, CASE WHEN {_touch(_TEST)} THEN 'test' WHEN {_touch(_VAL)} THEN 'val'
               WHEN {_touch(_VAL_E)} OR {_touch(_TEST_E)} THEN 'embargo' ELSE 'train' END AS split,
       CASE WHEN {_touch(_TEST)} THEN 'late-january' WHEN {_touch(_VAL)} THEN 'mid-january' END AS block_label
FROM v_sup0"""

VIEWS["v_scorable"] = """
SELECT * FROM v_sup WHERE y IS NOT NULL AND cams_pm2_5_tgt IS NOT NULL AND obs_lag_1h IS NOT NULL AND obs_lag_24h IS NOT NULL"""

# The four baselines, fitted on train rows.
VIEWS["v_scale"] = """
SELECT avg(y) / avg(cams_pm2_5_tgt) AS scale FROM v_scorable WHERE split = 'train' AND cams_pm2_5_tgt > 0"""

VIEWS["v_centre"] = """
SELECT s.*, m.model, CASE m.model WHEN 'persistence' THEN obs_lag_1h WHEN 'persistence-daily' THEN obs_lag_24h
       WHEN 'raw-cams' THEN cams_pm2_5_tgt ELSE cams_pm2_5_tgt * (SELECT scale FROM v_scale) END AS c
FROM v_scorable s CROSS JOIN (SELECT unnest(['persistence', 'persistence-daily', 'raw-cams', 'scaled-cams']) AS model) m"""

VIEWS["v_resid"] = """
SELECT model, horizon_h, quantile_cont(y - c, 0.1) AS lo, quantile_cont(y - c, 0.9) AS hi
FROM v_centre WHERE split = 'train' GROUP BY 1, 2"""

VIEWS["v_pred"] = """
SELECT x.*, least(greatest(greatest(c, 0) + lo, 0), greatest(c, 0)) AS q10, greatest(c, 0) AS q50,
       greatest(greatest(c, 0) + hi, greatest(c, 0)) AS q90
FROM v_centre x JOIN v_resid r USING (model, horizon_h)"""

VIEWS["v_held"] = """
SELECT p.*, greatest(p.obs_lag_1h, 0) AS base_q50 FROM v_pred p WHERE split = 'test'"""

VIEWS["v_aqi24"] = """
SELECT *, CASE WHEN count(pm25_clean) OVER r >= 16 THEN avg(pm25_clean) OVER r END AS pm25_24h
FROM v_obs WINDOW r AS (PARTITION BY station_id ORDER BY time RANGE INTERVAL 23 HOURS PRECEDING)"""


def aqi(x: str) -> str:
    return (
        f"CASE WHEN {x} <= 30 THEN round(round(greatest(0.0, 50.0 / 30.0 * ({x})), 6)) WHEN {x} <= 60 THEN round(round(49.0 / 30.0 * ({x} - 30.0) + 51.0, 6)) "
        f"WHEN {x} <= 90 THEN round(round(99.0 / 30.0 * ({x} - 60.0) + 101.0, 6)) WHEN {x} <= 120 THEN round(round(99.0 / 30.0 * ({x} - 90.0) + 201.0, 6)) "
        f"WHEN {x} <= 250 THEN round(round(99.0 / 130.0 * ({x} - 120.0) + 301.0, 6)) WHEN {x} <= 380 THEN round(round(99.0 / 130.0 * ({x} - 250.0) + 401.0, 6)) "
        f"WHEN {x} > 380 THEN 500.0 END"
    )


def stage(a: str) -> str:
    return (
        f"CASE WHEN {a} IS NULL THEN NULL WHEN round({a}) >= 451 THEN 4 WHEN round({a}) >= 401 THEN 3 "
        f"WHEN round({a}) >= 301 THEN 2 WHEN round({a}) >= 201 THEN 1 ELSE 0 END"
    )


def cdf(x: str, a: str = "q10", b: str = "q50", c: str = "q90") -> str:
    return (
        f"greatest(0.0, least(1.0, CASE WHEN {x} <= {a} THEN 0.1 * exp(({x} - {a}) / greatest({b} - {a}, 1e-6)) "
        f"WHEN {x} <= {b} THEN 0.1 + 0.4 * ({x} - {a}) / greatest({b} - {a}, 1e-6) "
        f"WHEN {x} <= {c} THEN 0.5 + 0.4 * ({x} - {b}) / greatest({c} - {b}, 1e-6) "
        f"WHEN {x} > {c} THEN 1.0 - 0.1 * exp(-({x} - {c}) / greatest({c} - {b}, 1e-6)) END))"
    )


# Concentrations at the stage bounds: AQI 201, 300, 301, 400, 401, 450, 451 and above the scale.
STAGE_LO = {1: "90.0::DOUBLE", 2: "120.0::DOUBLE", 3: "250.0::DOUBLE", 4: "(250.0::DOUBLE + 50.0 * 130.0 / 99.0)"}
STAGE_HI = {1: "120.0::DOUBLE", 2: "250.0::DOUBLE", 3: "(250.0::DOUBLE + 49.0 * 130.0 / 99.0)", 4: "380.0::DOUBLE"}


def stage_probs() -> str:
    parts = []
    for k in (1, 2, 3, 4):
        parts.append(f"greatest(0.0, least(1.0, {cdf(STAGE_HI[k])} - {cdf(STAGE_LO[k])})) AS p_stage_{k}")
        parts.append(f"1.0 - {cdf(STAGE_LO[k])} AS p_at_least_{k}")
    return ", ".join(parts)


VIEWS["v_station_aqi"] = f"SELECT *, {aqi('pm25_24h')} AS aqi_pm25 FROM v_aqi24"

VIEWS["v_delhi"] = "SELECT station_id FROM v_stations WHERE lower(trim(city)) IN ('delhi', 'new delhi')"

VIEWS["v_city_aqi"] = f"""
SELECT *, {stage('city_aqi')} AS grap_stage FROM (
  SELECT time, CASE WHEN count(aqi_pm25) >= 5 THEN avg(aqi_pm25) END AS city_aqi, max(aqi_pm25) AS worst_station_aqi,
         count(aqi_pm25) AS n_stations
  FROM v_station_aqi WHERE station_id IN (SELECT station_id FROM v_delhi) GROUP BY 1)"""

VIEWS["v_geometry"] = """
SELECT a.station_id AS receptor, b.station_id AS neighbour,
       2 * 6371.0088::DOUBLE * asin(sqrt(least(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2)
         + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 1.0))) AS km,
       (degrees(atan2(sin(radians(b.lon - a.lon)) * cos(radians(b.lat)),
          cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon)))) + 360.0::DOUBLE) % 360.0::DOUBLE AS bearing
FROM v_stations a CROSS JOIN v_stations b"""

VIEWS["v_nbr_wind"] = """
SELECT station_id AS receptor, time, coalesce(met_wind_direction_10m, avg(met_wind_direction_10m) OVER (PARTITION BY time)) AS w, pm25_clean
FROM v_base"""

VIEWS["v_nbr_sums"] = """
SELECT v.time, g.receptor, sum(exp(-km / 15.0)) AS d, sum(exp(-km / 15.0) * v.pm25_clean) AS dv,
       sum(exp(-km / 15.0) * pow(greatest(cos(radians(r.w - bearing)), 0.0), 2)) AS u,
       sum(exp(-km / 15.0) * pow(greatest(cos(radians(r.w - bearing)), 0.0), 2) * v.pm25_clean) AS uv
FROM v_nbr_wind v JOIN v_geometry g ON g.neighbour = v.receptor AND g.receptor <> g.neighbour
JOIN v_nbr_wind r ON r.time = v.time AND r.receptor = g.receptor
WHERE v.pm25_clean IS NOT NULL GROUP BY 1, 2"""

VIEWS["v_runs"] = """
SELECT 'S' || lpad(CAST(l_suppkey // 10 AS VARCHAR), 5, '0') AS station_id, o_orderdate AS issue_time,
       o_orderdate + l_linenumber * INTERVAL 1 DAY AS time, avg(l_extendedprice) / 1000.0 AS pm2_5, max(l_linenumber) * 24 AS lead_h
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3"""

VIEWS["v_settled"] = """
SELECT 'S' || lpad(CAST(l_suppkey // 10 AS VARCHAR), 5, '0') AS station_id, l_shipdate AS time, avg(l_quantity) * 2.0 AS pm2_5
FROM lineitem GROUP BY 1, 2"""

VIEWS["v_overlap"] = """
SELECT r.station_id, r.time, r.issue_time, r.lead_h, r.pm2_5 AS run, a.pm2_5 AS archive, r.lead_h // 24 AS lead_day,
       CAST(r.issue_time AS DATE) AS issue_date, r.pm2_5 - a.pm2_5 AS delta, CAST(r.time AS DATE) <= DATE '2001-05-28' AS settled
FROM v_runs r JOIN v_settled a USING (station_id, time)"""

VIEWS["v_locations"] = """
SELECT s_suppkey AS location_id, 'Sector ' || (s_suppkey // 10 + 1) || ' Block ' || (s_suppkey % 10) || ', Delhi - DPCC' AS loc_name,
       28.1::DOUBLE + ((s_suppkey // 10) * 37 % 100) / 100.0::DOUBLE + (s_suppkey % 10) * 0.003::DOUBLE AS lat,
       76.7::DOUBLE + ((s_suppkey // 10) * 53 % 100) / 100.0::DOUBLE AS lon,
       TIMESTAMP '2020-01-01' + CAST(s_suppkey % 500 AS INTEGER) * INTERVAL 1 DAY AS first_seen,
       TIMESTAMP '2020-01-01' + CAST(s_suppkey % 500 AS INTEGER) * INTERVAL 1 DAY
         + CAST(floor(abs(s_acctbal) / 5.0) AS INTEGER) * INTERVAL 1 DAY AS last_seen
FROM supplier"""
