import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skycast.config import Settings
from skycast.functions import aqi as aq
from skycast.functions import names
from skycast.functions.distribution import cdf, ordered, stage_probabilities
from skycast.operators import attribution, evaluation, matching
from skycast.operators.metrics import horizon_table, score
from skycast.operators.models import (
    Calibrated, Corrector, Coupled, Persistence, RawForecast, ScaledForecast, search_trials,
)
from skycast.plans import products
from skycast.plans.products import Registry
from skycast.session import scratch, staged

from .conftest import T0, by

CFG = Settings()


# -- index, stage, distribution ---------------------------------------------
def test_bracket_edges_clamp_and_null(spark):
    vals = [0.0, 30.0, 60.0, 90.0, 120.0, 250.0, 380.0, 900.0, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in vals], "c double").select(aq.pm25_to_aqi(F.col("c"), CFG).alias("a"))
    assert [r["a"] for r in df.collect()] == [0, 50, 100, 200, 300, 400, 500, 500, None, None]


def test_stages_partition_the_index_in_both_modes(spark):
    df = spark.createDataFrame([(v,) for v in (200.0, 201.0, 300.5, 400.5, 450.5, 500.0, None)], "a double")
    got = df.select(aq.aqi_to_stage(F.col("a"), CFG).alias("d"), aq.aqi_to_stage(F.col("a"), CFG, compat=True).alias("w")).collect()
    assert [r["d"] for r in got] == [0, 1, 2, 3, 4, 4, None] and [r["w"] for r in got] == [0, 1, 0, 0, 0, 4, None]


def test_inverse_round_trip(spark):
    df = spark.createDataFrame([(float(a),) for a in range(0, 501)], "a double")
    back = aq.pm25_to_aqi(aq.aqi_to_pm25(F.col("a"), CFG), CFG)
    # Brackets share their concentrations: the lower end of one is the upper end of the one before.
    assert sorted(r["a"] for r in df.where(back != F.col("a")).collect()) == [51, 101, 201, 301, 401]
    assert [round(aq.aqi_to_pm25_value(a, CFG), 6) for a in (201, 300, 401, 1000)] == [90.0, 120.0, 250.0, 380.0]


def test_distribution_is_monotone_matches_quantiles_and_sums_to_one(spark):
    df = spark.createDataFrame([(100.0, 150.0, 260.0), (5.0, 5.0, 5.0), (300.0, 400.0, 420.0), (None, None, None)], "q10 double, q50 double, q90 double")
    q = [F.col(c) for c in ("q10", "q50", "q90")]
    r = df.select(*[cdf(c, *q) for c in q]).first()
    assert np.allclose(list(r), [0.1, 0.5, 0.9])
    grid = df.select(F.array(*[cdf(float(x), *q) for x in range(0, 600, 20)]).alias("p")).limit(3).collect()
    assert all(a <= b + 1e-12 for row in grid for a, b in zip(row["p"], row["p"][1:]))
    rows = stage_probabilities(df, CFG).collect()
    for row in rows[:3]:
        assert row["p_at_least_1"] >= row["p_at_least_2"] >= row["p_at_least_3"] >= row["p_at_least_4"]
        assert abs(row["p_stage_0"] + row["p_at_least_1"] - 1) < 1e-12
    assert rows[3]["p_stage_2"] is None and rows[3]["expected_stage"] is None
    assert tuple(ordered(spark.createDataFrame([(3.0, 1.0, 2.0)], "q10 double, q50 double, q90 double")).first()) == (1.0, 2.0, 3.0)


# -- scores -----------------------------------------------------------------
def _pred(spark):
    rows = [(24, 100.0, 100.0, 110.0, 120.0, 90.0), (24, 200.0, 170.0, 180.0, 190.0, 260.0), (48, 300.0, 290.0, 300.0, 310.0, 300.0), (48, 300.0, None, None, None, 10.0), (48, float("nan"), 1.0, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "horizon_h int, y double, q10 double, q50 double, q90 double, base_q50 double")


def test_scores_by_hand_and_without_missing_pairs(spark):
    r = score(_pred(spark), baseline="base_q50").first()
    assert r["n"] == 3 and abs(r["rmse"] - math.sqrt(500 / 3)) < 1e-9 and abs(r["mae"] - 10) < 1e-9 and abs(r["bias"] + 10 / 3) < 1e-9
    assert abs(r["coverage_80"] - 2 / 3) < 1e-9 and r["interval_width"] == 20.0 and r["episode_n"] == 1 and r["episode_recall"] == 1.0
    assert abs(r["baseline_rmse"] - math.sqrt(3700 / 3)) < 1e-9 and abs(r["skill_vs_baseline"] - (1 - math.sqrt(500 / 3700))) < 1e-9


def test_horizon_rows_and_overall_row(spark):
    got = by(horizon_table(_pred(spark), baseline="base_q50"), "horizon_h")
    assert set(got) == {0, 24, 48} and got[0]["n"] == 3 and got[24]["n"] == 2 and got[48]["rmse"] == 0.0


# -- models -----------------------------------------------------------------
@pytest.fixture(scope="module")
def sup(spark):
    """Truth is 2.5 times the forecast plus noise."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(3000):
        cams = float(rng.uniform(20, 120))
        y = 2.5 * cams + float(rng.normal(0, 10))
        blh = float(rng.uniform(100, 2000))
        t = T0 + dt.timedelta(hours=i // 3)
        h = (24, 48, 72)[i % 3]
        rows.append((f"S{i % 5}", t, t + dt.timedelta(hours=h), h, y, cams, y + float(rng.normal(0, 40)), y, blh, 5.0 + cams / 50, 4000.0))
    df = spark.createDataFrame(rows, "station_id string, issue_time timestamp, target_time timestamp, horizon_h int, y double, cams_pm2_5_tgt double, obs_lag_1h double, obs_lag_24h double, met_boundary_layer_height_tgt double, y_vis double, met_visibility_tgt double")
    return staged(df, "sup")


PARAMS = {"trees": 4, "depth": 5, "min_leaf": 20}


@pytest.fixture(scope="module")
def fitted(sup):
    return Corrector("full", **PARAMS).fit(sup)


def test_raw_stays_raw_and_scale_is_a_ratio_of_means(sup):
    raw = RawForecast().fit(sup).predict(sup)
    assert raw.where("q50 <> cams_pm2_5_tgt").count() == 0 and raw.where("q10 > q50 or q50 > q90 or q10 < 0").count() == 0
    assert abs(ScaledForecast().fit(sup).scale - 2.5) < 0.02
    with pytest.raises(KeyError):
        Persistence().fit(sup.drop("obs_lag_1h"))


def test_corrector_beats_its_anchor_with_ordered_quantiles(sup, fitted):
    pred = staged(fitted.predict(sup), "pred")
    r = pred.agg(F.sqrt(F.avg(F.pow(F.col("q50") - F.col("y"), 2))), F.sqrt(F.avg(F.pow(F.col("cams_pm2_5_tgt") - F.col("y"), 2)))).first()
    assert r[0] < 0.4 * r[1]
    assert pred.count() == 3000 and pred.where("q10 > q50 or q50 > q90 or q10 < 0").count() == 0


def test_keys_targets_and_provenance_never_reach_the_learner(sup):
    wide = sup.withColumn("met_lead_matched", F.lit(True)).withColumn("pm25", F.lit(1.0)).withColumn("split", F.lit("train")).withColumn("fire_count_24h", F.lit(1.0))
    assert Corrector().feature_columns(wide) == ["cams_pm2_5_tgt", "obs_lag_1h", "obs_lag_24h", "met_boundary_layer_height_tgt", "met_visibility_tgt", "fire_count_24h"]
    assert Corrector(use_obs_history=False, use_meteo=False).feature_columns(wide) == ["cams_pm2_5_tgt"]
    assert "fire_count_24h" not in Corrector(drop_prefixes=("fire_",)).feature_columns(wide)


def test_median_only_mirrors_the_median_and_unfitted_horizons_fall_back(sup):
    few = sup.where("horizon_h <> 72").unionByName(sup.where("horizon_h = 72").limit(50))
    m = Corrector("median", quantiles=("q50",), **PARAMS).fit(few)
    assert set(m.forests) == {24, 48}
    pred = m.predict(sup)
    assert pred.where("q10 <> q50 or q90 <> q50").count() == 0
    assert pred.where("horizon_h = 72 and q50 <> cams_pm2_5_tgt").count() == 0
    assert pred.where("horizon_h = 24 and q50 = cams_pm2_5_tgt").count() < 50


def test_calibration_widens_to_coverage_and_keeps_the_median(sup):
    cal = Calibrated(RawForecast()).fit(sup).calibrate(sup)
    both = cal.predict(sup).select("y", "q10", "q50", "q90", "cams_pm2_5_tgt")
    assert both.where("q50 <> cams_pm2_5_tgt").count() == 0
    cover = both.agg(F.avg(((F.col("y") >= F.col("q10")) & (F.col("y") <= F.col("q90"))).cast("double"))).first()[0]
    assert abs(cover - 0.8) < 0.02


def test_contributions_and_base_add_up_to_the_residual(sup, fitted):
    keys = ["station_id", "issue_time"]
    rows = sup.where("horizon_h = 72")
    detail = attribution.contributions(fitted, rows, 72, keys)
    total = detail.groupBy(*keys, "base_value").agg(F.sum("contribution").alias("c"))
    res = fitted.residuals(rows).select(*keys, F.col("_res.q50").alias("r"))
    gap = total.join(res, keys).agg(F.max(F.abs(F.col("c") + F.col("base_value") - F.col("r"))), F.count("*")).first()
    assert gap[0] < 1e-9 and gap[1] == 1000
    assert detail.where("driver = 'other'").count() == 0
    top = attribution.drivers(fitted, rows, 72, keys).collect()
    assert top[0]["mean_magnitude"] >= top[-1]["mean_magnitude"]
    said = attribution.explain(detail, rows.select(*keys, "cams_pm2_5_tgt"), keys)
    assert said.count() == 1000 and said.where("not sentence like 'CAMS puts the regional level at %' and not sentence like 'No single driver%'").count() == 0
    with pytest.raises(KeyError):
        attribution.contributions(fitted, rows, 36, keys)
    assert fitted.importance(72)[0][1] >= fitted.importance(72)[-1][1]


def test_every_driver_rule_and_order(spark):
    want = {"fires_available": "upwind fires", "met_ventilation_index_tgt": "shallow mixing", "met_wind_speed_10m": "wind and transport",
            "nbr_pm25_wind": "wind and transport", "nbr_count": "neighbouring stations", "vis_lag_1h": "humidity and fog", "cams_dust_tgt": "regional forecast (CAMS)",
            "obs_gap_h": "recent local levels", "met_precipitation": "rain and clearing", "doy_sin": "time of day and season", "met_cape": "other weather", "x": "other"}
    df = spark.createDataFrame([(k,) for k in want], "f string").select("f", attribution.driver_of(F.col("f")).alias("d"))
    assert {r["f"]: r["d"] for r in df.collect()} == want


def test_coupled_predicts_both_series(sup):
    m = Coupled(**PARAMS).fit(sup.where("horizon_h = 24"))
    assert m.predict(sup.where("horizon_h = 24")).where("q50 is null or q10 > q90").count() == 0
    vis = m.predict_visibility(sup.where("horizon_h = 24")).agg(F.avg(F.abs(F.col("q50") - F.col("y_vis")))).first()[0]
    assert vis < 0.5
    with pytest.raises(KeyError):
        Coupled().fit(sup.drop("y_vis"))


def test_registry_returns_the_stored_model(spark, sup):
    reg = Registry(spark, scratch(spark, "reg"))
    labelled = sup.where("horizon_h = 24").withColumn("split", F.when(F.col("station_id") == "S0", "val").otherwise("train"))
    a, day = reg.get_or_fit(labelled, dt.date(2024, 12, 31), **PARAMS)
    b, again = reg.get_or_fit(labelled.limit(0), dt.date(2030, 1, 1))
    assert day == again == dt.date(2024, 12, 31) and a.pad == b.pad
    key = ["station_id", "issue_time"]
    x = a.predict(labelled).select(*key, "q50").join(b.predict(labelled).select(*key, F.col("q50").alias("p")), key)
    assert x.where("abs(q50 - p) > 1e-9").count() == 0 and x.count() == 1000


def test_trials_are_distinct_and_reproducible():
    a = search_trials(24)
    assert a == search_trials(24) and len({str(t) for t in a}) == len(a)


# -- evaluation tables ------------------------------------------------------
def _overlap(spark, days, shift=lambda d: (d % 7 - 3) * 1.0):
    rows = [(f"S{s}", T0 + dt.timedelta(days=d, hours=h), T0 + dt.timedelta(days=d), h, 100.0 - 16 + shift(d) + (h % 3 - 1), 100.0)
            for d in range(days) for h in range(24) for s in range(5)]
    df = spark.createDataFrame(rows, "station_id string, time timestamp, issue_time timestamp, lead_h int, run double, archive double")
    runs = df.select("station_id", "time", "issue_time", "lead_h", F.col("run").alias("pm2_5"))
    return evaluation.run_overlap(runs, df.select("station_id", "time", F.col("archive").alias("pm2_5")), dt.date(2025, 12, 1))


def test_bias_interval_and_readiness(spark):
    o = staged(_overlap(spark, 28), "overlap")
    r = evaluation.lead_day_gap(o).first()
    assert abs(r["bias"] + 16) < 0.01 and r["bias_lo"] < -16 < r["bias_hi"] and r["run_days"] == 28
    naive = 1.96 * o.agg(F.stddev("delta")).first()[0] / math.sqrt(o.count())
    assert r["bias_hi"] - r["bias_lo"] > 3 * naive
    assert abs(evaluation.fit_offset(o).first()["offset"] - 16) < 0.01
    few = _overlap(spark, 4)
    r = evaluation.lead_day_gap(few).first()
    assert r["bias_lo"] is None and evaluation.fit_offset(few).first()["offset"] is None


def test_lead_time_needs_an_unbroken_run_unless_as_written(spark):
    rows = [(T0, 24, 3, 0.9), (T0, 48, 3, 0.0), (T0, 72, 3, 0.9), (T0 + dt.timedelta(hours=1), 24, 3, 0.9), (T0 + dt.timedelta(hours=1), 48, 3, 0.9),
            (T0 + dt.timedelta(hours=2), 24, 0, 0.9)]
    df = spark.createDataFrame(rows, "target_time timestamp, horizon_h int, observed_stage int, p double").withColumns({f"p_at_least_{k}": F.col("p") for k in (1, 2, 3, 4)})
    new, old = by(evaluation.lead_times(df, CFG), "stage")[3], by(evaluation.lead_times(df, CFG, compat=True), "stage")[3]
    assert new["n_events"] == 2 and new["mean_lead_h"] == 36.0 and old["mean_lead_h"] == 60.0 and old["caught_at_72h"] == 0.5


def test_paired_gains_and_verdicts(spark):
    rows = [(f"f{i}", m, r + i) for i in range(5) for m, r in (("persistence", 80.0), ("full+upwind", 60.0), ("full", 60.0), ("full (lead-matched)", 61.0))]
    overall = spark.createDataFrame(rows, "fold string, model string, rmse double")
    got = by(evaluation.verdicts(evaluation.paired_gains(overall, evaluation.claims_frame(spark))), "claim")
    assert got["correction vs persistence"]["verdict"] == "holds up" and got["lead-matched meteorology"]["verdict"] == "real cost"
    assert got["upwind corridor"]["verdict"] == "does not hold" and "coupling" not in got and got["correction vs persistence"]["folds_better"] == 5


# -- matching ---------------------------------------------------------------
def test_name_scores(spark):
    cases = [("Sector 11", "Faridabad", "Sector 51, Faridabad - HSPCB", -1.0), ("Bahadurgarh", "", "Arya Nagar, Bahadurgarh - HSPCB", 1.0),
             ("Knowledge Park V", "", "Knowledge Park III, Greater Noida - UPPCB", -1.0), ("Anand Vihar", "", "Lodhi Road, Delhi - IMD", 0.0)]
    df = spark.createDataFrame([(c[0] + " " + c[1], c[2], c[3]) for c in cases], "a string, b string, want double")
    assert df.where(names.match_score(names.tokens(F.col("a")), names.tokens(F.col("b"))) != F.col("want")).count() == 0


def test_matching_serves_the_roster_in_order_like_brute_force(spark):
    import itertools
    import random

    rng = random.Random(5)
    words = ["anand", "rohini", "dwarka", "bawana", "narela", "mundka", "okhla"]
    pool = [" ".join(c) for n in (1, 2) for c in itertools.combinations(words, n)]
    roster = [(f"R{i:02d}", rng.choice(pool), "", i) for i in range(14)]
    cand = [(f"C{i:02d}", rng.choice(pool)) for i in range(14)]

    def score(a, b):
        a, b = set(a.split()), set(b.split())
        if not a & b:
            return 0.0
        return 1.0 if a <= b and any(len(t) >= 6 for t in a & b) else len(a & b) / len(a | b)

    used, want = set(), {}
    for sid, name, _, _ in roster:
        best = None
        for cid, cname in cand:
            if cid not in used and (best is None or score(name, cname) > best[1]):
                best = (cid, score(name, cname))
        if best and best[1] >= 0.55:
            want[sid] = best[0]
            used.add(best[0])
    got = matching.match_by_name(spark.createDataFrame(roster, "station_id string, name string, city string, rank int"), spark.createDataFrame(cand, "candidate_id string, candidate_name string"))
    assert {r["station_id"]: r["candidate_id"] for r in got.collect()} == want


def test_resolution_is_globally_greedy_and_needs_coverage_and_name(spark):
    roster = spark.createDataFrame([("A", "Sector 16A", "HSPCB", 28.40, 77.30), ("B", "New Industrial Town", "HSPCB", 28.40, 77.31)], "station_id string, name string, agency string, lat double, lon double")
    old, new = dt.datetime(2016, 1, 1), dt.datetime(2025, 1, 1)
    locs = spark.createDataFrame(
        [(1, "New Industrial Town, Faridabad - HSPCB", 28.401, 77.301, old, new), (2, "Sector 16A, Faridabad - HSPCB", 28.40, 77.30, old, dt.datetime(2018, 1, 1)), (3, "Sector 11, Faridabad - HSPCB", 28.40, 77.31, old, new)],
        "location_id long, loc_name string, lat double, lon double, first_seen timestamp, last_seen timestamp")
    got = matching.resolve_locations(roster, locs, dt.datetime(2024, 9, 15), dt.datetime(2026, 1, 1)).collect()
    assert [(r["station_id"], r["location_id"]) for r in got] == [("B", 1)]


# -- search ------------------------------------------------------------------
def test_search_ranks_trials_against_the_default_settings(spark, sup):
    from skycast.operators.models import tune

    got = tune(sup.where("issue_time < '2024-12-01'"), sup.where("issue_time >= '2024-12-01'"), trials=2, space={"trees": (2,), "depth": (1, 2)}).collect()
    assert [r["val_rmse"] for r in got] == sorted(r["val_rmse"] for r in got) and 2 <= len(got) <= 3
    base = next(r for r in got if r["params"] == "{}")
    assert base["gain"] == 0.0 and all(abs(r["gain"] - (base["val_rmse"] - r["val_rmse"]) / base["val_rmse"]) < 1e-12 for r in got)


# -- products ---------------------------------------------------------------
def test_availability_reasons_split_and_freshness(spark):
    day = dt.date
    cov = spark.createDataFrame(
        [("cpcb", 10, day(2024, 11, 1), day(2024, 11, 10), 5, 1.0), ("cams_archive", 8, day(2024, 11, 2), day(2024, 11, 9), 5, 40.0), ("meteo_archive", 9, day(2024, 11, 1), day(2024, 11, 10), 5, 1.0)],
        "dataset string, days long, first date, last date, rows long, age_hours double")
    r = products.replay_range(cov).first()
    assert (r["first"], r["last"], r["count"], r["limited_by"]) == (day(2024, 11, 2), day(2024, 11, 9), 8, "cams_archive")
    assert [x[0] for x in products.why_not_replayable(cov, day(2024, 11, 10), 5, 24).collect()] == ["cams_archive only reaches 2024-11-09"]
    assert products.why_not_replayable(cov, day(2024, 11, 5), 0, 24).first()[0].startswith("no observations")
    assert by(products.freshness(cov), "dataset")["cams_archive"]["state"] == "stale"
    assert products.run_due(cov, day(2024, 11, 10)).first()[0] and not products.run_due(cov.where("dataset = 'cpcb'"), day(2024, 11, 10)).first()[0]
    days = spark.createDataFrame([(day(2026, 1, 1),), (day(2025, 12, 5),), (day(2025, 1, 1),), (day(2027, 1, 1),)], "day date")
    got = {r["day"]: r["split"] for r in products.split_of_day(days, CFG, day(2026, 8, 1)).collect()}
    assert list(got.values()) == ["test", "val", "train", "unseen"]
