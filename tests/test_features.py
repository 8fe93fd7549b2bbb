import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from skycast.config import Block, Settings
from skycast.functions.calendar import calendar_features
from skycast.functions.geo import nearest, pairs_within
from skycast.operators import align, neighbours, supervised, transport, windows
from skycast.operators.city import city_aqi, city_base, station_aqi
from skycast.operators.quantiles import exact_quantiles
from skycast.plans.base import Sources, base_frame
from skycast.sources.store import keep_one

from .conftest import T0, by, hours


def _base(spark, n=200):
    rows = [(s, t, float(h + 1000 * i), h / 2.0) for i, s in enumerate("AB") for h, t in enumerate(hours(n))]
    return spark.createDataFrame(rows, "station_id string, time timestamp, pm25_clean double, cams_pm2_5 double")


def test_index_is_complete_and_end_inclusive(spark):
    s = spark.createDataFrame([("A",), ("B",)], "station_id string")
    df = align.hourly_index(s, "2024-11-01", "2024-11-03")
    assert df.count() == 2 * 72 and df.agg(F.max("time")).first()[0] == dt.datetime(2024, 11, 3, 23)


@pytest.mark.parametrize("stretch", [24, 48, 24 * 120])
def test_history_features_do_not_depend_on_the_stretch(spark, stretch):
    """Against brute force, with gaps longer than every halo."""
    rng, n = random.Random(1), 400
    values = {s: [None if rng.random() < 0.35 or 120 < i < 260 else rng.uniform(0, 300) for i in range(n)] for s in "AB"}
    rows = [(s, t, values[s][i]) for s in "AB" for i, t in enumerate(hours(n))]
    df = spark.createDataFrame(rows, "station_id string, time timestamp, pm25_clean double")
    got = by(windows.observation_features(df, stretch_h=stretch), "station_id", "time")
    assert len(got) == 2 * n
    for s in "AB":
        for i, t in enumerate(hours(n)):
            r, v = got[s, t], values[s]
            for k in windows.LAGS_H:
                assert r[f"obs_lag_{k}h"] == (v[i - k] if i >= k else None)
            for w in windows.WINDOWS_H:
                seen = [x for x in v[max(0, i - w + 1) : i + 1] if x is not None]
                mean = sum(seen) / len(seen) if len(seen) >= max(1, int(w * 0.6)) else None
                assert (r[f"obs_mean_{w}h"] is None) == (mean is None)
                if mean is not None:
                    assert abs(r[f"obs_mean_{w}h"] - mean) < 1e-9
            past = [j for j in range(i + 1) if v[j] is not None]
            assert r["obs_gap_h"] == (i - past[-1] if past else None)


def test_target_is_read_ahead_and_forecasts_are_suffixed(spark):
    sup = supervised.build_supervised(_base(spark), [24, 48])
    got = by(sup, "station_id", "issue_time", "horizon_h")
    assert len(got) == 2 * (176 + 152)
    r = got["B", T0, 48]
    assert r["y"] == 1048.0 and r["pm25_clean"] == 1000.0 and r["cams_pm2_5_tgt"] == 24.0 and r["target_time"] == T0 + dt.timedelta(hours=48)


def test_missing_target_drops_the_row_but_not_the_second_target(spark):
    base = _base(spark, 60).withColumn("vis", F.when(F.hour("time") == 5, None).otherwise(1.0)).withColumn(
        "pm25_clean", F.when(F.hour("time") == 3, None).otherwise(F.col("pm25_clean")))
    sup = supervised.build_supervised(base, [24], extra_targets={"y_vis": "vis"})
    assert sup.where(F.hour("target_time") == 3).count() == 0 and sup.where("y_vis is null").count() > 0


def test_calendar_is_local(spark):
    r = calendar_features(spark.createDataFrame([(dt.datetime(2024, 12, 31, 19, 0),)], "time timestamp")).first()
    assert (r["hour_ist"], r["weekday_ist"], r["month"], r["doy"]) == (0, 3, 1, 1) and abs(r["hour_cos"] - 1) < 1e-12


def test_lead_matching_swaps_flags_and_keeps_rows(spark):
    rows = [("A", T0, T0 + dt.timedelta(hours=h), h, 20.0, 5.0) for h in (24, 48, 72)]
    sup = spark.createDataFrame(rows, "station_id string, issue_time timestamp, target_time timestamp, horizon_h int, met_temperature_2m_tgt double, met_wind_speed_10m_tgt double")
    lead = spark.createDataFrame([("A", T0 + dt.timedelta(hours=24 * d), d, 20.0 + d) for d in (1, 2)], "station_id string, time timestamp, lead_day int, temperature_2m double")
    got = by(supervised.lead_match(sup, lead), "horizon_h")
    assert [got[h]["met_temperature_2m_tgt"] for h in (24, 48, 72)] == [21.0, 22.0, 20.0]
    assert [got[h]["met_lead_matched"] for h in (24, 48, 72)] == [True, True, False] and got[24]["met_wind_speed_10m_tgt"] == 5.0
    assert [supervised.lead_day_for(h) for h in (1, 24, 25, 48, 72)] == [1, 1, 2, 2, 3]
    assert supervised.lead_match(sup, None).where("met_lead_matched").count() == 0


def test_split_embargo_and_straddling(spark):
    cfg = Settings(blocks=(Block("test", "2024-11-10", "2024-11-12", "t"), Block("val", "2024-11-12", "2024-11-13", "v")), embargo_h=24)
    issue = [dt.datetime(2024, 11, d) for d in (1, 7, 8, 9, 10, 12, 14, 15)]
    df = spark.createDataFrame([(t, t + dt.timedelta(hours=24)) for t in issue], "issue_time timestamp, target_time timestamp")
    got = {r["issue_time"].day: r["split"] for r in supervised.assign_split(df, cfg).collect()}
    assert got == {1: "train", 7: "train", 8: "embargo", 9: "test", 10: "test", 12: "val", 14: "embargo", 15: "train"}


def test_time_folds_are_contiguous_and_even(spark):
    df = spark.createDataFrame([(t, i) for t in hours(90) for i in range(3)], "issue_time timestamp, i int")
    rows = by(supervised.time_folds(df, 3).groupBy("fold").agg(F.count("*").alias("n"), F.min("issue_time").alias("a"), F.max("issue_time").alias("b")), "fold")
    assert [rows[k]["n"] for k in range(3)] == [90, 90, 90] and rows[0]["b"] < rows[1]["a"] < rows[1]["b"] < rows[2]["a"]


def test_exact_quantiles_match_numpy_under_ties_and_one_heavy_group(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    groups = {"hot": np.round(rng.normal(0, 50, 3000), 1), "tied": np.repeat(4.0, 50), "one": np.array([3.5]), "few": rng.normal(0, 1, 7)}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [("few", None), ("few", float("nan"))], "g string, v double")
    got = by(exact_quantiles(df, ["g"], "v", [0.0, 0.1, 0.5, 0.95, 1.0]), "g", "p")
    for g, v in groups.items():
        for p in (0.0, 0.1, 0.5, 0.95, 1.0):
            assert abs(got[g, p]["q"] - np.quantile(v, p)) < 1e-9 and got[g, p]["n"] == len(v)


def test_keep_one_is_explicit(spark):
    df = spark.createDataFrame([("a", 1, 9), ("a", 2, 5), ("b", 1, 1)], "k string, o int, v int")
    assert by(keep_one(df, ["k"], ["o"], "last"), "k")["a"]["v"] == 5 and by(keep_one(df, ["k"], ["o"]), "k")["a"]["v"] == 9


# -- space ------------------------------------------------------------------
CROSS = [("C", "c", 28.60, 77.20), ("N", "n", 28.69, 77.20), ("S", "s", 28.51, 77.20), ("E", "e", 28.60, 77.30)]


def _cross(spark):
    return spark.createDataFrame(CROSS, "station_id string, name string, lat double, lon double")


def _wind(spark, direction):
    rows = [("C", T0, None, direction), ("N", T0, 400.0, direction), ("S", T0, 100.0, direction), ("E", T0, 250.0, direction)]
    return spark.createDataFrame(rows, "station_id string, time timestamp, pm25_clean double, met_wind_direction_10m double")


def test_wind_picks_the_upwind_neighbour(spark):
    north = by(neighbours.neighbour_features(_wind(spark, 0.0), _cross(spark)), "station_id")["C"]
    south = by(neighbours.neighbour_features(_wind(spark, 180.0), _cross(spark)), "station_id")["C"]
    assert north["nbr_pm25_wind"] > 390 and south["nbr_pm25_wind"] < 110 and abs(north["nbr_pm25_dist"] - south["nbr_pm25_dist"]) < 1e-9
    assert north["nbr_count"] == 3


def test_excluded_station_leaves_every_neighbourhood(spark):
    got = by(neighbours.neighbour_features(_wind(spark, 0.0), _cross(spark), exclude=["N"]), "station_id")
    assert got["C"]["nbr_pm25_wind"] is None and got["C"]["nbr_count"] == 2
    ids = spark.createDataFrame([("N",), ("S",)], "held_out string")
    many = by(neighbours.neighbour_features(_wind(spark, 0.0), _cross(spark), held_out=ids), "held_out", "station_id")
    for k in ("nbr_pm25_wind", "nbr_pm25_dist", "nbr_count"):
        a, b = many["N", "C"][k], got["C"][k]
        assert a == b or abs(a - b) < 1e-9


def test_pairs_and_nearest_against_brute_force(spark):
    rng = random.Random(2)
    pts = [(f"p{i}", rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(60)] + [("q", 10.0, 179.999), ("r", 10.0, -179.999)]

    def km(a, b):
        p1, p2 = math.radians(a[1]), math.radians(b[1])
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(h))

    left = spark.createDataFrame(pts, "a string, l_lat double, l_lon double")
    right = spark.createDataFrame(pts, "b string, r_lat double, r_lon double")
    for radius in (50.0, 900.0, 20040.0):
        want = {(x[0], y[0]) for x in pts for y in pts if km(x, y) <= radius}
        assert {(r["a"], r["b"]) for r in pairs_within(left, right, radius).collect()} == want
    sites = pts[:5]
    got = by(nearest(left, spark.createDataFrame(sites, "b string, r_lat double, r_lon double"), "a", "b"), "a")
    assert {p[0]: got[p[0]]["b"] for p in pts} == {p[0]: min(sites, key=lambda s: km(p, s))[0] for p in pts}


def test_surface_falls_back_to_distance_and_unknown_hour_raises(spark):
    cells = spark.createDataFrame([(28.60, 77.20), (28.80, 77.20)], "lat double, lon double")
    got = by(neighbours.surfaces(_wind(spark, 0.0), _cross(spark), cells), "lat")
    assert got[28.80]["pm25"] == got[28.80]["pm25_idw"] and got[28.60]["pm25"] > got[28.60]["pm25_idw"] and got[28.60]["nearest_station"] == "C"
    with pytest.raises(ValueError):
        neighbours.surface_for_hour(_wind(spark, 0.0), "2030-01-01", _cross(spark), cells)


def _corridor(spark):
    return spark.createDataFrame([("NW", 280.0, 330.0), ("SE", 200.0, 150.0)], "upwind_id string, distance_km double, bearing_deg double")


def test_corridor_alignment_transport_and_outage(spark):
    base = spark.createDataFrame([("A", t, 330.0, 20.0) for t in hours(40)], "station_id string, time timestamp, met_wind_direction_10m double, met_wind_speed_10m double")
    keep = [t for i, t in enumerate(hours(40)) if i != 5]
    obs = spark.createDataFrame([(u, t, v + i, "ok") for u, v in (("NW", 500.0), ("SE", 50.0)) for i, t in enumerate(keep)],
                                "upwind_id string, time timestamp, pm25 double, quality_flag string")
    got = by(transport.upwind_features(base, _corridor(spark), obs), "time")
    h = hours(40)
    assert abs(got[h[0]]["upwind_pm25"] - 500) < 1e-6 and abs(got[h[0]]["upwind_transport_h"] - 14) < 1e-9 and abs(got[h[0]]["upwind_alignment"] - 1) < 1e-9
    assert got[h[5]]["upwind_pm25"] is None
    # 14 hours earlier by the clock, not by rows; hour 19 looks back on the outage.
    assert got[h[20]]["upwind_pm25_advected"] == got[h[6]]["upwind_pm25"] and got[h[19]]["upwind_pm25_advected"] is None
    assert got[h[17]]["upwind_pm25_lag_12h"] is None and got[h[18]]["upwind_pm25_lag_12h"] == got[h[6]]["upwind_pm25"]
    rows = by(transport.upwind_features(base, _corridor(spark), obs, compat=True), "time")
    assert rows[h[19]]["upwind_pm25_advected"] == got[h[4]]["upwind_pm25"]
    empty = transport.upwind_features(base, None, None)
    assert set(transport.COLUMNS) <= set(empty.columns) and empty.where("upwind_pm25 is not null").count() == 0


# -- city -------------------------------------------------------------------
def test_sixteen_of_twenty_four_and_quorum(spark):
    cfg = Settings(city_scope=())
    rows = [(s, t, 100.0) for s in "ABCDE" for t in hours(16)] + [("F", t, 100.0) for t in hours(4)]
    df = spark.createDataFrame(rows, "station_id string, time timestamp, pm25_clean double")
    aqi = station_aqi(df, cfg)
    assert aqi.where("station_id = 'F' and aqi_pm25 is not null").count() == 0 and aqi.where("aqi_pm25 is not null").count() == 5
    city = by(city_aqi(aqi, cfg), "time")
    assert city[hours(16)[15]]["n_stations"] == 5 and city[hours(16)[15]]["grap_stage"] == 1 and city[hours(16)[14]]["city_aqi"] is None


def test_aqi_counts_clock_hours_not_rows(spark):
    cfg = Settings(city_scope=())
    sparse = [T0 + dt.timedelta(hours=3 * i) for i in range(24)]
    df = spark.createDataFrame([("A", t, 50.0) for t in sparse], "station_id string, time timestamp, pm25_clean double")
    assert station_aqi(df, cfg).where("aqi_pm25 is not null").count() == 0
    assert station_aqi(df, cfg, compat=True).where("aqi_pm25 is not null").count() == 9


def test_city_base_quorum_and_numeric_means(spark):
    rows = [(s, t, 10.0 * (i + 1), 5.0, 3, True) for i, s in enumerate("ABCDEF") for t in hours(30)]
    df = spark.createDataFrame(rows, "station_id string, time timestamp, pm25_clean double, cams_pm2_5 double, obs_n int, flag boolean")
    out = city_base(df, Settings(city_scope=()))
    r = by(out, "time")[hours(30)[20]]
    assert r["pm25_clean"] == 35.0 and r["n_stations"] == 6 and r["worst_station_pm25"] == 60.0 and r["city_pm25_24h"] == 35.0
    assert "obs_n" not in out.columns and "flag" not in out.columns and r["obs_lag_1h"] == 35.0
    few = city_base(df.where("station_id < 'E'"), Settings(city_scope=()))
    assert few.where("pm25_clean is not null").count() == 0


def test_missing_sources_give_null_columns(spark):
    src = Sources(spark.createDataFrame([("A",)], "station_id string"))
    out = base_frame(src, "2024-11-01", "2024-11-02", Settings())
    r = out.first().asDict()
    assert out.count() == 48 and r["pm25_clean"] is None and r["cams_pm2_5"] is None and r["met_inversion"] is None
    assert r["fire_count_24h"] == 0.0 and r["fires_available"] is False and r["upwind_pm25"] is None and r["obs_gap_h"] is None


def test_base_plan_has_no_python_and_no_cartesian_product(spark):
    src = Sources(spark.createDataFrame([("A",)], "station_id string"), _base(spark).selectExpr("station_id", "time", "pm25_clean pm25", "pm25_clean", "1 n_obs", "'ok' quality_flag"))
    plan = base_frame(src, "2024-11-01", "2024-11-05", Settings())._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_fires_available_separates_no_data_from_no_fires(spark):
    fires = spark.createDataFrame([(dt.datetime(2024, 11, 2, 3, 20), 4.0), (dt.datetime(2024, 11, 2, 3, 50), 6.0)], "time timestamp, frp double")
    got = by(align.fire_series(fires, "2024-11-01", "2024-11-03"), "time")
    assert got[dt.datetime(2024, 11, 2, 3)]["fire_count_1h"] == 2.0 and got[dt.datetime(2024, 11, 3, 2)]["fire_frp_24h"] == 10.0 and got[dt.datetime(2024, 11, 3, 3)]["fire_frp_24h"] == 0.0
    assert got[dt.datetime(2024, 11, 2, 20)]["fires_available"] and not got[dt.datetime(2024, 11, 1, 20)]["fires_available"]
    assert align.fire_series(fires, "2024-11-01", "2024-11-03", compat=True).where("fires_available").count() == 72
