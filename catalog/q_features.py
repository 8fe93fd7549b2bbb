"""Projections, joins, aggregations, windows, kernels and domain functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from skycast.config import LEAD_MATCHED
from skycast.functions import aqi as aq
from skycast.functions.calendar import calendar_features
from skycast.functions.distribution import cdf, interval_width, ordered, stage_probabilities
from skycast.functions.geo import haversine_km
from skycast.functions import names
from skycast.functions.meteo import mean_direction
from skycast.functions.names import site_score
from skycast.operators import align, city, evaluation, matching, neighbours, supervised, windows
from skycast.operators.attribution import driver_of
from skycast.operators.metrics import paired_agreement
from skycast.operators.quality import runs
from skycast.operators.supervised import time_folds
from skycast.operators.quantiles import exact_quantiles
from skycast.operators.transport import corridor_series
from skycast.plans.base import scorable
from skycast.plans.products import last_observed
from skycast.sources.store import keep_one

from . import frames as fr
from . import views as vw
from .registry import query

KEY = "station_id, t:time"
SUP = "station_id, t:issue_time, t:target_time, i:horizon_h"


# -- derived columns --------------------------------------------------------
@query("p1_derived_meteorology", f"{KEY}, d:u10, d:v10, d:ventilation_index, d:lapse_2m_925, d:lapse_925_850, inversion, blh_available", "FROM v_meteo")
def _(spark, sf):
    return fr.meteo(spark, sf).select("station_id", "time", "u10", "v10", "ventilation_index", "lapse_2m_925", "lapse_925_850", "inversion", "blh_available")


LOCAL = "(ts + INTERVAL 330 MINUTE)"


@query("p2_calendar", f"""i:event_id, i:hour_ist=hour({LOCAL}), i:weekday_ist=isodow({LOCAL}), i:month=month({LOCAL}), i:doy=dayofyear({LOCAL}),
  d:hour_sin=sin(2 * pi() * hour({LOCAL}) / 24), d:hour_cos=cos(2 * pi() * hour({LOCAL}) / 24),
  d:doy_sin=sin(2 * pi() * dayofyear({LOCAL}) / 365.25), d:doy_cos=cos(2 * pi() * dayofyear({LOCAL}) / 365.25)""", "FROM events")
def _(spark, sf):
    return calendar_features(fr.events(spark, sf).select("event_id", "ts"), "ts").drop("ts")


@query("p3_forecast_columns", f"{SUP}, d:cams_pm2_5_tgt, d:met_wind_speed_10m_tgt", "FROM v_sup")
def _(spark, sf):
    base = fr.base(spark, sf)
    cols = supervised.forecast_columns(base)
    sup = supervised.build_supervised(base, fr.JANUARY.horizons, forecast_cols=cols)
    return sup.select("station_id", "issue_time", "target_time", "horizon_h", "cams_pm2_5_tgt", "met_wind_speed_10m_tgt")


@query("p5_distance_bearing", "receptor, neighbour, d:km, d:bearing=CASE WHEN km > 0 THEN bearing END", "FROM v_geometry")
def _(spark, sf):
    g = neighbours.geometry(fr.stations(spark, sf))
    return g.withColumn("bearing", F.when(F.col("km") > 0, F.col("bearing")))


@query("p5_point_pairs", "i:location_id, d:km=2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin((radians(lat) - radians(28.6::DOUBLE)) / 2), 2) + cos(radians(28.6::DOUBLE)) * cos(radians(lat)) * pow(sin(radians(lon - 77.2::DOUBLE) / 2), 2)))", "FROM v_locations")
def _(spark, sf):
    km = haversine_km(F.lit(28.6), F.lit(77.2), F.col("lat"), F.col("lon"))
    return fr.locations(spark, sf).select("location_id", km.alias("km"))


@query("p6_grid", "d:lat=round(28.1::DOUBLE + i * 0.05::DOUBLE, 4), d:lon=round(76.7::DOUBLE + j * 0.05::DOUBLE, 4), nearest_station=n.station_id, d:distance_to_station_km=round(n.km, 2)",
       """FROM (SELECT * FROM (SELECT unnest(range(21)) AS i) CROSS JOIN (SELECT unnest(range(21)) AS j)) g JOIN LATERAL (
         SELECT s.station_id, 2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin((radians(s.lat) - radians(round(28.1::DOUBLE + i * 0.05::DOUBLE, 4))) / 2), 2)
           + cos(radians(round(28.1::DOUBLE + i * 0.05::DOUBLE, 4))) * cos(radians(s.lat)) * pow(sin(radians(s.lon - round(76.7::DOUBLE + j * 0.05::DOUBLE, 4)) / 2), 2))) AS km
         FROM v_stations s ORDER BY round(km, 9), s.station_id LIMIT 1) n ON true""")
def _(spark, sf):
    return neighbours.grid_frame(fr.stations(spark, sf), neighbours.domain_grid(spark, fr.JANUARY))


RULES = """CASE WHEN p_name LIKE 'fire%' THEN 'upwind fires' WHEN f LIKE 'met_wind%' THEN 'wind and transport' WHEN f LIKE 'met_precipitation%' THEN 'rain and clearing'
  WHEN f LIKE 'cams_%' THEN 'regional forecast (CAMS)' WHEN f LIKE 'obs_%' THEN 'recent local levels' WHEN f LIKE 'met_%' THEN 'other weather' ELSE 'other' END"""
FEATURE = "CASE p_size % 6 WHEN 0 THEN 'met_wind_' || p_name WHEN 1 THEN 'met_precipitation' WHEN 2 THEN 'cams_' || p_name WHEN 3 THEN 'obs_' || p_name WHEN 4 THEN 'met_cape' ELSE p_name END"


@query("p9_driver_groups", "driver, i:n=count(*)", f"FROM (SELECT {RULES} AS driver FROM (SELECT p_name, {FEATURE} AS f FROM part)) GROUP BY 1")
def _(spark, sf):
    p = fr.table(spark, sf, "part").select(F.expr(FEATURE.replace("'met_wind_' || p_name", "concat('met_wind_', p_name)")).alias("f"))
    return p.select(driver_of(F.col("f")).alias("driver")).groupBy("driver").agg(F.count("*").alias("n"))


@query("ud1_driver_of_contribution", "driver, d:mean_contribution=avg(v), d:mean_magnitude=avg(abs(v))", f"FROM (SELECT {RULES} AS driver, p_retailprice - 1000.0 AS v FROM (SELECT *, {FEATURE} AS f FROM part)) GROUP BY 1")
def _(spark, sf):
    p = fr.table(spark, sf, "part").select(F.expr(FEATURE).alias("f"), (F.col("p_retailprice") - 1000.0).alias("v"))
    return p.groupBy(driver_of(F.col("f")).alias("driver")).agg(F.avg("v").alias("mean_contribution"), F.avg(F.abs("v")).alias("mean_magnitude"))


# -- filters ----------------------------------------------------------------
@query("f1_city_scope", f"{KEY}, d:pm25", "FROM v_hourly WHERE station_id IN (SELECT station_id FROM v_delhi)")
def _(spark, sf):
    return city.scope_to_city(fr.hourly(spark, sf), fr.stations(spark, sf), fr.JANUARY).select("station_id", "time", "pm25")


@query("f2_scorable_rows", f"{SUP}, d:y", "FROM v_scorable")
def _(spark, sf):
    return scorable(fr.supervised(spark, sf)).select("station_id", "issue_time", "target_time", "horizon_h", "y")


@query("f3_fold_predicates", "fold, side, i:rows=count(*)", """FROM (
  SELECT f.fold, 'train' AS side FROM v_sup0, (VALUES ('week-2', TIMESTAMP '2024-01-12'), ('week-3', TIMESTAMP '2024-01-18'), ('week-4', TIMESTAMP '2024-01-24')) f(fold, e)
    WHERE issue_time < e - INTERVAL 24 HOUR AND target_time < e - INTERVAL 24 HOUR
  UNION ALL SELECT f.fold, 'test' FROM v_sup0, (VALUES ('week-2', TIMESTAMP '2024-01-13', TIMESTAMP '2024-01-17 23:59:59'), ('week-3', TIMESTAMP '2024-01-19', TIMESTAMP '2024-01-23 23:59:59'), ('week-4', TIMESTAMP '2024-01-25', TIMESTAMP '2024-01-29 23:59:59')) f(fold, a, b)
    WHERE target_time BETWEEN a AND b) GROUP BY 1, 2""")
def _(spark, sf):
    return supervised.fold_counts(fr.supervised(spark, sf, columns=()), fr.JANUARY.folds, 24)


@query("f5_minimum_rows", "station_id, i:horizon_h, i:n=count(*)", "FROM v_sup WHERE split = 'train' GROUP BY 1, 2 HAVING count(*) >= 200")
def _(spark, sf):
    sup = fr.supervised(spark, sf).where("split = 'train'")
    return sup.groupBy("station_id", "horizon_h").agg(F.count("*").alias("n")).where("n >= 200")


# -- joins ------------------------------------------------------------------
@query("j1_hourly_index", f"{KEY}", "FROM v_idx")
def _(spark, sf):
    return align.hourly_index(fr.stations(spark, sf), *fr.period(spark, sf))


@query("j2_aligned_sources", f"{KEY}, d:pm25, d:pm25_clean, i:obs_n=n_obs, quality_flag, d:cams_pm2_5=pm2_5, cams_source_class=source_class, d:met_wind_speed_10m=wind_speed_10m, met_inversion=inversion",
       "FROM v_idx LEFT JOIN v_obs USING (station_id, time) LEFT JOIN v_cams USING (station_id, time) LEFT JOIN v_meteo USING (station_id, time)")
def _(spark, sf):
    out = align.join_observations(align.hourly_index(fr.stations(spark, sf), *fr.period(spark, sf)), fr.observations(spark, sf))
    out = align.join_meteo(align.join_cams(out, fr.cams(spark, sf)), fr.meteo(spark, sf))
    return out.select("station_id", "time", "pm25", "pm25_clean", "obs_n", "quality_flag", "cams_pm2_5", "cams_source_class", "met_wind_speed_10m", "met_inversion")


@query("j3_primary_airport", f"{KEY}, d:metar_visibility_km, d:metar_visibility_km_min", "FROM v_aligned")
def _(spark, sf):
    p = fr.period(spark, sf)
    out = align.join_airport(align.hourly_index(fr.stations(spark, sf), *p), fr.metar(spark, sf), *p)
    return out.select("station_id", "time", "metar_visibility_km", "metar_visibility_km_min")


@query("j4_fire_load", f"{KEY}, d:fire_count_1h, d:fire_frp_1h, d:fire_count_24h, d:fire_frp_24h, d:fire_count_72h, fires_available", "FROM v_idx JOIN v_all_fire_series USING (time)")
def _(spark, sf):
    p = fr.period(spark, sf)
    return align.join_fires(align.hourly_index(fr.stations(spark, sf), *p), fr.all_fires(spark, sf), *p)


@query("j5_supervised", f"{SUP}, d:y, d:y_vis, d:obs_lag_1h, d:cams_pm2_5_tgt, d:met_wind_speed_10m_tgt", "FROM v_sup0")
def _(spark, sf):
    return fr.supervised(spark, sf).select("station_id", "issue_time", "target_time", "horizon_h", "y", "y_vis", "obs_lag_1h", "cams_pm2_5_tgt", "met_wind_speed_10m_tgt")


MATCHED = """FROM v_sup0 s LEFT JOIN v_lead l ON l.station_id = s.station_id AND l.time = s.target_time AND l.lead_day = greatest(1, CAST(ceil(s.horizon_h / 24.0) AS INTEGER))"""


@query("j6_lead_match", "station_id=s.station_id, t:issue_time=s.issue_time, i:horizon_h=s.horizon_h, d:met_temperature_2m_tgt=coalesce(l.temperature_2m, s.met_temperature_2m_tgt), d:met_wind_speed_10m_tgt=coalesce(l.wind_speed_10m, s.met_wind_speed_10m_tgt), met_lead_matched=l.temperature_2m IS NOT NULL", MATCHED)
def _(spark, sf):
    sup = fr.supervised(spark, sf, lead_matched=True)
    return sup.select("station_id", "issue_time", "horizon_h", "met_temperature_2m_tgt", "met_wind_speed_10m_tgt", "met_lead_matched")


@query("j7_run_join", f"{KEY}, d:cams_pm2_5=pm2_5, d:cams_dust=CAST(NULL AS DOUBLE), cams_source_class='live_forecast'", "FROM v_idx LEFT JOIN v_cams USING (station_id, time)")
def _(spark, sf):
    idx = align.hourly_index(fr.stations(spark, sf), *fr.period(spark, sf))
    return align.join_run(idx, fr.cams(spark, sf), ["pm2_5", "dust"], "cams_")


def overlap(spark, sf):
    return evaluation.run_overlap(fr.cams_runs(spark, sf), fr.cams_settled(spark, sf), fr.RUN_TODAY)


@query("j8_run_overlap", "station_id, t:time, t:issue_time, i:lead_day, issue_date, d:run, d:archive, d:delta, settled", "FROM v_overlap")
def _(spark, sf):
    return overlap(spark, sf).drop("lead_h")


@query("j9_input_degradation", "i:lead_day=l.lead_day, i:n=count(*), d:temperature_2m=sqrt(avg(pow(l.temperature_2m - m.temperature_2m, 2))), d:wind_speed_10m=sqrt(avg(pow(l.wind_speed_10m - m.wind_speed_10m, 2))), d:wind_direction_10m=sqrt(avg(pow(l.wind_direction_10m - m.wind_direction_10m, 2)))",
       "FROM v_lead l JOIN v_meteo m USING (station_id, time) GROUP BY 1")
def _(spark, sf):
    return evaluation.input_degradation(fr.meteo(spark, sf), fr.lead(spark, sf), list(LEAD_MATCHED))


@query("j10_comparable_rows", f"station_id=s.station_id, t:issue_time=s.issue_time, i:horizon_h=s.horizon_h", MATCHED + " WHERE l.temperature_2m IS NOT NULL")
def _(spark, sf):
    keys = ["station_id", "issue_time", "horizon_h"]
    sup = fr.supervised(spark, sf)
    matched = supervised.lead_match(sup, fr.lead(spark, sf)).where("met_lead_matched").select(*keys)
    return sup.join(matched, keys, "left_semi").select(*keys)


@query("j12_nearest_site", "i:location_id, station_id=near, d:km", """FROM (SELECT l.location_id, s.station_id AS near, 2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin((radians(s.lat) - radians(l.lat)) / 2), 2)
   + cos(radians(l.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - l.lon) / 2), 2))) AS km FROM v_locations l CROSS JOIN v_stations s
   QUALIFY row_number() OVER (PARTITION BY l.location_id ORDER BY km, s.station_id) = 1)""")
def _(spark, sf):
    from skycast.functions.geo import nearest

    pts = fr.locations(spark, sf).select("location_id", F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon"))
    sites = fr.stations(spark, sf).select("station_id", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    return nearest(pts, sites, "location_id", "station_id").select("location_id", "station_id", "km")


SITE_PAIRS = """FROM (SELECT s.station_id, l.location_id, 2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin((radians(l.lat) - radians(s.lat)) / 2), 2)
    + cos(radians(s.lat)) * cos(radians(l.lat)) * pow(sin(radians(l.lon - s.lon) / 2), 2))) AS km,
  l.first_seen <= TIMESTAMP '2022-12-31' AND l.last_seen >= TIMESTAMP '2021-01-01' AS covers, date_diff('day', l.first_seen, l.last_seen) AS span_days
  FROM v_stations s CROSS JOIN v_locations l) WHERE km <= 3.0"""
WINDOW = (dt.datetime(2021, 1, 1), dt.datetime(2022, 12, 31))


@query("j13_location_pairs", "station_id, i:location_id, d:km, covers, i:span_days", SITE_PAIRS)
def _(spark, sf):
    p = matching.location_pairs(fr.stations(spark, sf), fr.locations(spark, sf), *WINDOW)
    return p.select("station_id", "location_id", "km", "covers", "span_days")


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _sql_words(text: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(lower({text}), '[^a-z0-9 ]+', ' ', 'g')), ' +'), lambda w: w <> ''))"


def _sql_jaccard(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b})))"


def _sql_greedy(pairs: str, left: str, right: str, order: str) -> str:
    """Pairs (a FROM clause) taken one by one in order, each unless a side is taken."""
    return f"""FROM (WITH RECURSIVE ranked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {order}) AS i {pairs}),
      pick AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS ls, []::BIGINT[] AS rs, false AS took UNION ALL
        SELECT r.i, CASE WHEN free THEN list_append(ls, r.{left}) ELSE ls END, CASE WHEN free THEN list_append(rs, r.{right}) ELSE rs END, free
        FROM (SELECT p.ls, p.rs, r.*, NOT list_contains(p.ls, r.{left}) AND NOT list_contains(p.rs, r.{right}) AS free FROM pick p JOIN ranked r ON r.i = p.i + 1) r)
      SELECT r.* FROM ranked r JOIN pick p USING (i) WHERE p.took)"""


_OURS, _THEIRS = (f"list_filter({_sql_words(c)}, lambda w: length(w) > 1)" for c in ("name", "loc_name"))
SITE_SCORE = f"""FROM (SELECT *, CASE WHEN len(list_intersect(ka, kb)) = 0 OR (len(na) > 0 AND len(nb) > 0 AND len(list_intersect(na, nb)) = 0) THEN 0.0
    ELSE {_sql_jaccard('ka', 'kb')} + CASE WHEN list_contains(b, lower(agency)) THEN 0.05 ELSE 0.0 END END AS name_score
  FROM (SELECT *, list_filter(a, lambda w: NOT list_contains({_sql_list(names.BOILERPLATE)}, w)) AS ka, list_filter(b, lambda w: NOT list_contains({_sql_list(names.BOILERPLATE)}, w)) AS kb,
      list_filter(a, lambda w: regexp_matches(w, '^[0-9]+$')) AS na, list_filter(b, lambda w: regexp_matches(w, '^[0-9]+$')) AS nb
    FROM (SELECT *, {_OURS} AS a, {_THEIRS} AS b FROM (
      SELECT s.station_id, s.name, s.agency, l.*, 2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin((radians(l.lat) - radians(s.lat)) / 2), 2)
          + cos(radians(s.lat)) * cos(radians(l.lat)) * pow(sin(radians(l.lon - s.lon) / 2), 2))) AS km,
        l.first_seen <= TIMESTAMP '2022-12-31' AND l.last_seen >= TIMESTAMP '2021-01-01' AS covers, date_diff('day', l.first_seen, l.last_seen) AS span_days
      FROM v_stations s CROSS JOIN v_locations l) WHERE km <= 3.0))) WHERE covers AND name_score > 0"""


@query("j13_resolve_locations", "station_id, i:location_id, loc_name, d:lat=round(lat, 6), d:lon=round(lon, 6), d:distance_km=round(km, 3), first=CAST(first_seen AS DATE), last=CAST(last_seen AS DATE)",
       _sql_greedy(SITE_SCORE, "station_id", "location_id", "name_score DESC, span_days DESC, km, station_id, location_id"))
def _(spark, sf):
    return matching.resolve_locations(fr.stations(spark, sf), fr.locations(spark, sf), *WINDOW)


@query("j13_site_score", "i:p_partkey, d:score=CASE WHEN len(list_intersect(a, b)) = 0 THEN 0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END",
       "FROM (SELECT p_partkey, list_filter(list_distinct(string_split(p_name, ' ')), lambda x: x <> 'new') AS a, list_filter(list_distinct(string_split(lower(p_type || ' ' || split_part(p_name, ' ', 1)), ' ')), lambda x: x <> 'new') AS b FROM part)")
def _(spark, sf):
    p = fr.table(spark, sf, "part")
    other = F.concat_ws(" ", "p_type", F.split("p_name", " ")[0])
    return p.select("p_partkey", site_score(F.col("p_name"), F.lit("none"), other).alias("score"))


def _sql_tokens(text: str) -> str:
    return (f"list_filter({_sql_words(text)}, lambda w: NOT list_contains({_sql_list(names.NOISE)}, w) AND (length(w) > 1 OR list_contains({_sql_list(names.ROMAN)}, w)))")


_ORDINAL = f"lambda w: regexp_matches(w, '^[0-9]+$') OR list_contains({_sql_list(names.ROMAN)}, w)"
NAME_SCORE = f"""FROM (SELECT *, CASE WHEN len(list_filter(a, {_ORDINAL})) > 0 AND len(list_filter(b, {_ORDINAL})) > 0 AND len(list_intersect(list_filter(a, {_ORDINAL}), list_filter(b, {_ORDINAL}))) = 0 THEN -1.0
    WHEN len(list_intersect(a, b)) = 0 THEN 0.0
    WHEN len(list_intersect(a, b)) = len(a) AND len(list_filter(a, lambda w: length(w) >= 6 AND NOT list_contains({_sql_list(names.GENERIC)}, w))) > 0 THEN 1.0
    ELSE {_sql_jaccard('a', 'b')} END AS score
  FROM (SELECT s.station_id, s.k AS rank, l.location_id AS candidate_id, l.loc_name AS candidate_name, list_distinct(list_concat({_sql_tokens('s.name')}, {_sql_tokens('s.city')})) AS a,
      {_sql_tokens("regexp_replace(l.loc_name, '^(.*) - .*$', '\\1')")} AS b FROM v_stations s CROSS JOIN v_locations l) WHERE len(a) > 0 AND len(b) > 0) WHERE score >= 0.55"""


@query("j14_match_by_name", "station_id, i:candidate_id, candidate_name, d:score", _sql_greedy(NAME_SCORE, "station_id", "candidate_id", "rank, station_id, score DESC, candidate_id"))
def _(spark, sf):
    """Stations against external names, roster order first."""
    roster = fr.stations(spark, sf).withColumn("rank", F.col("k"))
    cand = fr.locations(spark, sf).select(F.col("location_id").alias("candidate_id"), F.col("loc_name").alias("candidate_name"))
    return matching.match_by_name(roster, cand)


@query("j15_advected", "t:time, d:upwind_pm25, d:upwind_transport_h, d:upwind_pm25_advected", "FROM v_corridor_series")
def _(spark, sf):
    return _corridor(spark, sf).select("time", "upwind_pm25", "upwind_transport_h", "upwind_pm25_advected")


@query("j16_base_frame", f"{KEY}, d:pm25_clean, d:obs_lag_24h, d:obs_mean_24h, i:obs_gap_h, d:cams_pm2_5, d:met_wind_direction_10m, d:metar_visibility_km, d:fire_count_24h, d:upwind_pm25, i:hour_ist=hour(time + INTERVAL 330 MINUTE)", "FROM v_base")
def _(spark, sf):
    b = fr.base(spark, sf)
    return b.select("station_id", "time", "pm25_clean", "obs_lag_24h", "obs_mean_24h", "obs_gap_h", "cams_pm2_5", "met_wind_direction_10m", "metar_visibility_km", "fire_count_24h", "upwind_pm25", "hour_ist")


# -- aggregations -----------------------------------------------------------
@query("a2_city_base", "t:time, d:pm25_clean, i:n_stations, d:worst_station_pm25, d:cams_pm2_5, d:city_pm25_24h, d:obs_lag_24h=lag(pm25_clean, 24) OVER (ORDER BY time)",
       """FROM (SELECT *, CASE WHEN count(pm25_clean) OVER r >= 16 THEN avg(pm25_clean) OVER r END AS city_pm25_24h FROM (
         SELECT time, CASE WHEN count(pm25_clean) >= 5 THEN avg(pm25_clean) END AS pm25_clean, count(pm25_clean) AS n_stations, max(pm25_clean) AS worst_station_pm25, avg(cams_pm2_5) AS cams_pm2_5
         FROM v_base WHERE station_id IN (SELECT station_id FROM v_delhi) GROUP BY 1) WINDOW r AS (ORDER BY time ROWS 23 PRECEDING))""")
def _(spark, sf):
    c = city.city_base(fr.base(spark, sf, False), fr.JANUARY, fr.stations(spark, sf))
    return c.select("time", "pm25_clean", "n_stations", "worst_station_pm25", "cams_pm2_5", "city_pm25_24h", "obs_lag_24h")


CITY = "t:time, d:city_aqi, d:worst_station_aqi, i:n_stations, i:grap_stage"


@query("a3_city_aqi", CITY, "FROM v_city_aqi")
def _(spark, sf):
    return city.city_aqi(city.station_aqi(city.scope_to_city(fr.observations(spark, sf), fr.stations(spark, sf), fr.JANUARY), fr.JANUARY), fr.JANUARY)


FREQ = """FROM (SELECT grap_stage, count(*) AS hours FROM v_city_aqi WHERE grap_stage IS NOT NULL GROUP BY 1)"""


@query("a4_stage_frequency", "i:grap_stage, i:hours, d:pct_of_hours=round(hours * 100.0 / sum(hours) OVER (), 2), stage_name=['None', 'Poor', 'Very Poor', 'Severe', 'Severe Plus'][grap_stage + 1]", FREQ)
def _(spark, sf):
    return city.stage_frequency(city.episodes(fr.observations(spark, sf), fr.stations(spark, sf), fr.JANUARY), fr.JANUARY)


@query("a5_split_summary", "split, block_label, i:rows=count(*), t:from=min(issue_time), t:to=max(issue_time)", "FROM v_sup GROUP BY 1, 2")
def _(spark, sf):
    return supervised.split_summary(fr.supervised(spark, sf))


@query("a6_residual_quantiles", "i:horizon_h, d:lo=quantile_cont(y - obs_lag_1h, 0.1), d:hi=quantile_cont(y - obs_lag_1h, 0.9), i:n=count(*)", "FROM v_scorable WHERE split = 'train' GROUP BY 1")
def _(spark, sf):
    from skycast.operators.quantiles import wide_quantiles

    train = scorable(fr.supervised(spark, sf)).where("split = 'train'").withColumn("r", F.col("y") - F.col("obs_lag_1h"))
    return wide_quantiles(train, ["horizon_h"], "r", {"lo": 0.1, "hi": 0.9})


@query("a6_exact_quantiles", "l_returnflag, d:p, d:q, i:n", """FROM (SELECT l_returnflag, p, q, n FROM (SELECT l_returnflag, unnest([0.1, 0.5, 0.95]) AS p,
    unnest(quantile_cont(l_extendedprice, [0.1, 0.5, 0.95])) AS q, count(*) AS n FROM lineitem GROUP BY 1))""")
def _(spark, sf):
    return exact_quantiles(fr.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.95])


@query("a7_last_observed", "t:issue=max(time)", "FROM v_base WHERE pm25_clean IS NOT NULL")
def _(spark, sf):
    return spark.createDataFrame([(last_observed(fr.base(spark, sf, False)),)], "issue timestamp")


@query("a10_city_series", "t:target_time, d:forecast=avg(q50), d:lower=avg(q10), d:upper=avg(q90), d:observed=avg(y), d:cams=avg(cams_pm2_5_tgt), i:n_stations=count(*)", "FROM v_held WHERE model = 'raw-cams' GROUP BY 1")
def _(spark, sf):
    from .q_models import baseline_predictions

    return evaluation.city_series(baseline_predictions(spark, sf, ["raw-cams"]))


@query("a11_worst_held_out_day", "day, d:mean_pm25, i:stations", """FROM (SELECT CAST(time AS DATE) AS day, avg(pm25_clean) AS mean_pm25, count(DISTINCT station_id) AS stations FROM v_obs
  WHERE pm25_clean IS NOT NULL AND time >= TIMESTAMP '2024-01-21' AND time < TIMESTAMP '2024-01-26' GROUP BY 1 HAVING count(DISTINCT station_id) >= 10 ORDER BY mean_pm25 DESC LIMIT 1)""")
def _(spark, sf):
    return evaluation.worst_held_out_day(fr.observations(spark, sf), fr.JANUARY, dt.date(2024, 1, 1), dt.date(2024, 1, 30), 10)


@query("a12_forecast_agreement", "i:n=count(d), d:bias=avg(d), d:rmse=sqrt(avg(d * d)), d:r=corr(f, o)", """FROM (SELECT avg(cams_pm2_5) AS f, avg(pm25_clean) AS o, avg(cams_pm2_5) - avg(pm25_clean) AS d
  FROM v_base GROUP BY time HAVING avg(cams_pm2_5) IS NOT NULL AND avg(pm25_clean) IS NOT NULL)""")
def _(spark, sf):
    hourly = fr.base(spark, sf, False).groupBy("time").agg(F.avg("cams_pm2_5").alias("f"), F.avg("pm25_clean").alias("o"))
    return paired_agreement(hourly, "f", "o")


# -- windows ----------------------------------------------------------------
OBS = ", ".join([f"d:obs_lag_{k}h" for k in windows.LAGS_H] + [f"d:obs_{s}_{w}h" for w in windows.WINDOWS_H for s in ("mean", "std")])


def _aligned(spark, sf):
    p = fr.period(spark, sf)
    out = align.join_observations(align.hourly_index(fr.stations(spark, sf), *p), fr.observations(spark, sf))
    return align.join_airport(out, fr.metar(spark, sf), *p)


@query("w1_w2_lags_and_rolling", f"{KEY}, {OBS}", "FROM v_features")
def _(spark, sf):
    f = windows.observation_features(_aligned(spark, sf))
    return f.select("station_id", "time", *[c.strip()[2:] for c in OBS.split(",")])


@query("w3_visibility_history", f"{KEY}, d:vis_lag_1h, d:vis_lag_3h, d:vis_lag_24h, d:vis_min_24h, d:vis_mean_24h", "FROM v_features")
def _(spark, sf):
    f = windows.observation_features(_aligned(spark, sf))
    return f.select("station_id", "time", "vis_lag_1h", "vis_lag_3h", "vis_lag_24h", "vis_min_24h", "vis_mean_24h")


@query("w4_trailing_sums", "t:time, d:fire_count_24h, d:fire_frp_24h, d:fire_count_72h", "FROM v_all_fire_series")
def _(spark, sf):
    return align.fire_series(fr.all_fires(spark, sf), *fr.period(spark, sf)).select("time", "fire_count_24h", "fire_frp_24h", "fire_count_72h")


@query("w5_gap_hours", f"{KEY}, i:obs_gap_h, d:obs_delta_24h", "FROM v_features")
def _(spark, sf):
    return windows.observation_features(_aligned(spark, sf), stretch_h=24 * 5).select("station_id", "time", "obs_gap_h", "obs_delta_24h")


@query("w6_rolling_aqi", f"{KEY}, d:pm25_24h, d:aqi_pm25", "FROM v_station_aqi")
def _(spark, sf):
    return city.station_aqi(fr.observations(spark, sf), fr.JANUARY).select("station_id", "time", "pm25_24h", "aqi_pm25")


@query("w7_transport_lags", "t:time, d:upwind_pm25_lag_12h, d:upwind_pm25_lag_24h, d:upwind_pm25_lag_36h", "FROM v_corridor_series")
def _(spark, sf):
    return _corridor(spark, sf).select("time", *[f"upwind_pm25_lag_{k}h" for k in (12, 24, 36)])


@query("w8_run_lengths", "station_id, t:first=min(time), i:hours=count(*), d:value=max(r)", """FROM (SELECT *, sum(CASE WHEN r = p THEN 0 ELSE 1 END) OVER (PARTITION BY station_id ORDER BY time) AS grp
  FROM (SELECT station_id, time, round(pm25 / 200) AS r, lag(round(pm25 / 200)) OVER (PARTITION BY station_id ORDER BY time) AS p FROM v_hourly)) GROUP BY station_id, grp""")
def _(spark, sf):
    """Stretches of a week, so runs cross their borders."""
    return runs(fr.hourly(spark, sf), F.round(F.col("pm25") / 200), stretch_days=7)


@query("w9_block_ratios", "station_id, t:block, d:ratio", """FROM (SELECT station_id, block, m / lag(m) OVER (PARTITION BY station_id ORDER BY block) AS ratio FROM (
    SELECT station_id, epoch_ms(CAST(floor(epoch(time) / 432000) * 432000000 AS BIGINT)) AS block, quantile_cont(pm25, 0.5) AS m FROM v_obs WHERE quality_flag = 'ok' GROUP BY 1, 2)) WHERE ratio > 1.2 OR ratio < 1 / 1.2""")
def _(spark, sf):
    from skycast.operators.quality import step_changes

    return step_changes(fr.observations(spark, sf), 5, 1.2).select("station_id", "block", F.col("step_ratio").alias("ratio"))


# -- kernels ----------------------------------------------------------------
NBR = f"{KEY}, d:nbr_pm25_wind=CASE WHEN u > 1e-6 THEN uv / u END, d:nbr_pm25_dist=CASE WHEN d > 0 THEN dv / greatest(d, 1e-9) END, i:nbr_count=coalesce(n, 0)"


@query("g1_neighbour_features", NBR.replace("station_id,", "station_id=b.station_id,").replace("t:time", "t:time=b.time"),
       "FROM v_base b LEFT JOIN v_nbr_sums s ON s.time = b.time AND s.receptor = b.station_id LEFT JOIN (SELECT time, count(pm25_clean) AS n FROM v_base GROUP BY 1) c ON c.time = b.time")
def _(spark, sf):
    out = neighbours.neighbour_features(fr.base(spark, sf, False), fr.stations(spark, sf))
    return out.select("station_id", "time", "nbr_pm25_wind", "nbr_pm25_dist", F.col("nbr_count").cast("long").alias("nbr_count"))


@query("g2_edge_table", "receptor=a.name, upwind_neighbour=b.name, d:distance_km=round(km, 1), d:bearing_deg=round(bearing, 0), d:weight=w",
       """FROM (SELECT *, round(exp(-km / 15.0) * pow(greatest(cos(radians(315.0 - bearing)), 0.0), 2), 4) AS w FROM v_geometry WHERE receptor <> neighbour
         AND exp(-km / 15.0) * pow(greatest(cos(radians(315.0 - bearing)), 0.0), 2) > 0 ORDER BY w DESC, receptor, neighbour LIMIT 15) e
         JOIN v_stations a ON a.station_id = e.receptor JOIN v_stations b ON b.station_id = e.neighbour""")
def _(spark, sf):
    return neighbours.edge_table(fr.stations(spark, sf))


def _corridor(spark, sf):
    roster = fr.stations(spark, sf).select("station_id")
    wind = fr.meteo(spark, sf).join(roster, "station_id", "left_semi").select(
        "time", F.col("wind_direction_10m").alias("met_wind_direction_10m"), F.col("wind_speed_10m").alias("met_wind_speed_10m"))
    return corridor_series(wind, fr.corridor(spark, sf), fr.corridor_obs(spark, sf))


@query("g3_corridor", "t:time, d:upwind_pm25, d:upwind_distance_km, d:upwind_transport_h, d:upwind_alignment", "FROM v_corridor_series")
def _(spark, sf):
    return _corridor(spark, sf).select("time", "upwind_pm25", "upwind_distance_km", "upwind_transport_h", "upwind_alignment")


@query("g3_mean_wind", "t:time, d:arithmetic=avg(d), d:circular=(degrees(atan2(avg(sin(radians(d))), avg(cos(radians(d))))) + 360.0::DOUBLE) % 360.0::DOUBLE",
       "FROM (SELECT time, wind_direction_10m AS d FROM v_meteo) GROUP BY 1")
def _(spark, sf):
    """Both ways to average an hour's wind direction."""
    d = "wind_direction_10m"
    return fr.meteo(spark, sf).groupBy("time").agg(mean_direction(d).alias("arithmetic"), mean_direction(d, circular=True).alias("circular"))


GRID = "(SELECT round(28.1::DOUBLE + i * 0.05::DOUBLE, 4) AS lat, round(76.7::DOUBLE + j * 0.05::DOUBLE, 4) AS lon FROM (SELECT unnest(range(21)) AS i), (SELECT unnest(range(21)) AS j))"
KM = """2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin((radians(s.lat) - radians(c.lat)) / 2), 2)
        + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - c.lon) / 2), 2)))"""
SURFACE = f"""FROM (SELECT c.lat, c.lon, v.time, max(wd) AS wd, sum(w) AS d, sum(w * p) AS dv, sum(w * a) AS u, sum(w * a * p) AS uv FROM (
    SELECT c.lat, c.lon, s.station_id, exp(-({KM}) / 15.0) AS w0,
      (degrees(atan2(sin(radians(s.lon - c.lon)) * cos(radians(s.lat)), cos(radians(c.lat)) * sin(radians(s.lat)) - sin(radians(c.lat)) * cos(radians(s.lat)) * cos(radians(s.lon - c.lon)))) + 360.0::DOUBLE) % 360.0::DOUBLE AS b
    FROM {GRID} c CROSS JOIN v_stations s) c
  JOIN (SELECT station_id, time, pm25_clean AS p, coalesce(avg(met_wind_direction_10m) OVER (PARTITION BY time), 0.0) AS wd FROM v_base) v ON v.station_id = c.station_id
  CROSS JOIN LATERAL (SELECT w0 AS w, pow(greatest(cos(radians(wd - b)), 0.0), 2) AS a)
  WHERE p IS NOT NULL GROUP BY 1, 2, 3)"""
SURFACE_VALUES = "d:pm25=CASE WHEN u > 1e-6 THEN uv / u ELSE dv / greatest(d, 1e-9) END, d:pm25_idw=dv / greatest(d, 1e-9)"
NEAREST_CELL = f"""(SELECT lat, lon, round(min(km), 2) AS distance_to_station_km, arg_min(station_id, {{order}}) AS nearest_station
  FROM (SELECT c.lat, c.lon, s.station_id, {KM} AS km FROM {GRID} c CROSS JOIN v_stations s) GROUP BY 1, 2)"""


@query("g5_surfaces", "t:time, d:lat, d:lon, " + SURFACE_VALUES, SURFACE)
def _(spark, sf):
    """Every hour of the record on the grid of the domain."""
    cells = neighbours.domain_grid(spark, fr.JANUARY)
    return neighbours.surfaces(fr.base(spark, sf, False), fr.stations(spark, sf), cells).where("pm25_idw is not null").select("time", "lat", "lon", "pm25", "pm25_idw")


# -- domain functions -------------------------------------------------------
@query("x1_x2_aqi_and_stage", f"i:o_orderkey, d:aqi={vw.aqi('(o_totalprice / 1000.0)')}, i:stage={vw.stage(vw.aqi('(o_totalprice / 1000.0)'))}", "FROM orders")
def _(spark, sf):
    a = aq.pm25_to_aqi(F.col("o_totalprice") / 1000.0, fr.JANUARY)
    return fr.table(spark, sf, "orders").select("o_orderkey", a.alias("aqi")).withColumn("stage", aq.aqi_to_stage(F.col("aqi"), fr.JANUARY))


@query("x2_stage_as_written", "i:o_orderkey, i:stage=CASE WHEN a BETWEEN 201 AND 300 THEN 1 WHEN a BETWEEN 301 AND 400 THEN 2 WHEN a BETWEEN 401 AND 450 THEN 3 WHEN a BETWEEN 451 AND 1000 THEN 4 ELSE 0 END", "FROM (SELECT o_orderkey, o_totalprice / 1000.0 AS a FROM orders)")
def _(spark, sf):
    return fr.table(spark, sf, "orders").select("o_orderkey", aq.aqi_to_stage(F.col("o_totalprice") / 1000.0, fr.JANUARY, compat=True).alias("stage"))


INVERSE = """CASE WHEN a BETWEEN 0 AND 50 THEN a * 30.0 / 50.0 WHEN a BETWEEN 51 AND 100 THEN 30.0 + (a - 51) * 30.0 / 49.0 WHEN a BETWEEN 101 AND 200 THEN 60.0 + (a - 101) * 30.0 / 99.0
  WHEN a BETWEEN 201 AND 300 THEN 90.0 + (a - 201) * 30.0 / 99.0 WHEN a BETWEEN 301 AND 400 THEN 120.0 + (a - 301) * 130.0 / 99.0 WHEN a BETWEEN 401 AND 500 THEN 250.0 + (a - 401) * 130.0 / 99.0 ELSE 380.0 END"""


@query("x3_aqi_to_pm25", f"i:o_orderkey, d:pm25={INVERSE}", "FROM (SELECT o_orderkey, floor(o_totalprice / 700.0) AS a FROM orders)")
def _(spark, sf):
    a = F.floor(F.col("o_totalprice") / 700.0).cast("double")
    return fr.table(spark, sf, "orders").select("o_orderkey", aq.aqi_to_pm25(a, fr.JANUARY).alias("pm25"))


TRIPLE = "FROM (SELECT l_orderkey, l_linenumber, l_extendedprice / 1000.0 AS q50, l_extendedprice / 1000.0 - l_quantity AS q10, l_extendedprice / 1000.0 * (1.0 + 10 * l_discount) AS q90 FROM lineitem)"


def _triples(spark, sf):
    m = F.col("l_extendedprice") / 1000.0
    return fr.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", m.alias("q50"), (m - F.col("l_quantity")).alias("q10"), (m * (1.0 + 10 * F.col("l_discount"))).alias("q90"))


@query("x4_distribution_function", f"i:l_orderkey, i:l_linenumber, d:p={vw.cdf('60.0')}", TRIPLE)
def _(spark, sf):
    return _triples(spark, sf).select("l_orderkey", "l_linenumber", cdf(60.0, F.col("q10"), F.col("q50"), F.col("q90")).alias("p"))


PROBS = ", ".join([f"d:p_stage_{k}, d:p_at_least_{k}" for k in (1, 2, 3, 4)])


@query("x5_stage_probabilities", f"i:l_orderkey, i:l_linenumber, {PROBS}, d:p_stage_0=greatest(0.0, least(1.0, 1.0 - p_at_least_1)), d:expected_stage=p_stage_1 + 2 * p_stage_2 + 3 * p_stage_3 + 4 * p_stage_4",
       f"FROM (SELECT *, {vw.stage_probs()} {TRIPLE})")
def _(spark, sf):
    return stage_probabilities(_triples(spark, sf), fr.JANUARY).drop("q10", "q50", "q90")


@query("x6_observed_stage", f"{KEY}, i:stage={vw.stage(vw.aqi('pm25_24h'))}", "FROM v_aqi24")
def _(spark, sf):
    a = city.station_aqi(fr.observations(spark, sf), fr.JANUARY)
    return a.select("station_id", "time", aq.observed_stage(F.col("pm25_24h"), fr.JANUARY).alias("stage"))


@query("x7_x8_ordered_quantiles", "i:l_orderkey, i:l_linenumber, d:q10=s[1], d:q50=s[2], d:q90=s[3], d:width=s[3] - s[1]", "FROM (SELECT l_orderkey, l_linenumber, list_sort([l_tax * 1000, l_quantity, l_discount * 500]) AS s FROM lineitem)")
def _(spark, sf):
    raw = fr.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_tax") * 1000).alias("q10"), F.col("l_quantity").alias("q50"), (F.col("l_discount") * 500).alias("q90"))
    return ordered(raw).withColumn("width", interval_width())


@query("x9_lead_days", "i:l_orderkey, i:l_linenumber, i:lead_day=greatest(1, CAST(ceil(l_quantity / 24.0) AS BIGINT))", "FROM lineitem")
def _(spark, sf):
    return fr.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", supervised.lead_day("l_quantity").alias("lead_day"))


# -- sets and order ---------------------------------------------------------
@query("t2_top_edges", "receptor=a.name, upwind_neighbour=b.name, d:distance_km=round(km, 1), d:bearing_deg=round(bearing, 0), d:weight=w",
       """FROM (SELECT *, round(exp(-km / 40.0) * pow(greatest(cos(radians(90.0 - bearing)), 0.0), 2), 4) AS w FROM v_geometry WHERE receptor <> neighbour
         AND exp(-km / 40.0) * pow(greatest(cos(radians(90.0 - bearing)), 0.0), 2) > 0 ORDER BY w DESC, receptor, neighbour LIMIT 25) e
         JOIN v_stations a ON a.station_id = e.receptor JOIN v_stations b ON b.station_id = e.neighbour""")
def _(spark, sf):
    """The 25 strongest edges under an easterly wind and a longer kernel."""
    return neighbours.edge_table(fr.stations(spark, sf), wind_from=90.0, length_km=40.0, top=25)


@query("u1_union_by_name", f"{KEY}, d:pm25, d:pm10", "FROM (SELECT station_id, time, pm25, NULL AS pm10 FROM v_hourly UNION ALL SELECT station_id, time, NULL, pm10 FROM v_cams)")
def _(spark, sf):
    a = fr.hourly(spark, sf).select("station_id", "time", "pm25")
    return a.unionByName(fr.cams(spark, sf).select("station_id", "time", "pm10"), allowMissingColumns=True)


@query("u2_keep_one", "i:l_partkey, i:l_orderkey, i:l_linenumber, d:l_extendedprice", "FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) = 1)")
def _(spark, sf):
    l = fr.table(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")
    return keep_one(l, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"], "last").drop("l_shipdate")


@query("u3_set_difference", f"{KEY}", "FROM v_idx ANTI JOIN v_hourly USING (station_id, time)")
def _(spark, sf):
    idx = align.hourly_index(fr.stations(spark, sf), *fr.period(spark, sf))
    return idx.join(fr.hourly(spark, sf), ["station_id", "time"], "left_anti")


@query("m1_split_labels", f"{SUP}, split, block_label", "FROM v_sup")
def _(spark, sf):
    return fr.supervised(spark, sf).select("station_id", "issue_time", "target_time", "horizon_h", "split", "block_label")


@query("m1_split_labels_before", f"{SUP}, split=CASE WHEN split = 'train' AND target_time >= TIMESTAMP '2024-01-14' THEN 'later' ELSE split END, block_label", "FROM v_sup")
def _(spark, sf):
    """Training precedes evaluation."""
    sup = supervised.assign_split(fr.supervised(spark, sf).drop("split", "block_label"), fr.JANUARY, before=True)
    return sup.select("station_id", "issue_time", "target_time", "horizon_h", "split", "block_label")


FOLDS = """FROM (SELECT issue_time, c, least(CAST(floor(coalesce(sum(c) OVER (ORDER BY issue_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3 / sum(c) OVER ()) AS BIGINT), 2) AS fold
  FROM (SELECT issue_time, count(*)::DOUBLE AS c FROM v_sup0 GROUP BY 1)) GROUP BY fold"""


@query("m3_time_folds", "i:fold, i:rows=sum(c), t:first=min(issue_time), t:last=max(issue_time)", FOLDS)
def _(spark, sf):
    f = time_folds(fr.supervised(spark, sf).select("issue_time"), 3)
    return f.groupBy("fold").agg(F.count("*").alias("rows"), F.min("issue_time").alias("first"), F.max("issue_time").alias("last"))


