import datetime as dt
from unittest.mock import MagicMock

import duckdb
import pytest
from pyspark.sql import functions as F

from skycast.operators.quality import hourly_stats
from skycast.session import scratch
from skycast.sources.store import Store
from skycast.streaming import hourly as live

from .conftest import T0, by

SF = "/root/testdata/sf0.001"


def test_stream_over_several_files_equals_batch(spark):
    """Late readings inside the watermark change an hour that an earlier batch already wrote."""
    path = scratch(spark, "landing")
    rows = [("A", T0 + dt.timedelta(minutes=10 * i), float(i)) for i in range(60)]
    parts = [rows[:30] + rows[40:50], rows[30:40], rows[50:]]
    schema = "station_id string, event_time timestamp, value double"
    store, mark = Store(spark, scratch(spark, "store")), scratch(spark, "mark")
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        live.upsert_stream(live.hourly_stream(stream), store, "cpcb", mark).awaitTermination()
    got = by(store.read_range("cpcb", "2024-11-01", "2024-11-01"), "station_id", "time")
    want = by(hourly_stats(spark.createDataFrame(rows, schema).select("station_id", F.date_trunc("hour", "event_time").alias("time"), "value")), "station_id", "time")
    assert {k: (v["pm25"], v["n_obs"]) for k, v in got.items()} == {k: (v["pm25"], v["n_obs"]) for k, v in want.items()}
    assert live.flagged(store, "cpcb", "2024-11-01", "2024-11-01").where("quality_flag is null").count() == 0


def test_late_readings_reach_the_healing_table_and_heal_to_the_batch_result(spark):
    """Batches move the watermark on; what comes after it is kept apart, once, and repaired from the landed readings."""
    path, late = scratch(spark, "landing"), scratch(spark, "late")
    schema = "station_id string, event_time timestamp, value double"
    at = lambda h, m=0: T0 + dt.timedelta(hours=h, minutes=m)
    parts = [
        [("A", at(0, 5), 10.0), ("A", at(1), 20.0), ("B", at(0), 7.0)],
        [("A", at(30), 30.0), ("A", at(29), 5.0), ("B", at(30), 8.0), ("B", at(30), None)],
        [("A", at(0, 40), 50.0), ("A", at(0, 50), 60.0), ("A", at(29, 30), 7.0), ("C", at(2), 9.0), ("A", at(31), 1.0)],
        [("A", at(0, 55), 100.0), ("B", at(31), 2.0)],
    ]
    store, mark = Store(spark, scratch(spark, "store")), scratch(spark, "mark")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        live.upsert_stream(live.hourly_with_late(stream), store, "cpcb", mark, late=late).awaitTermination()
    hours = {(r["station_id"], r["time"]) for r in live.late_hours(spark, late).collect()}
    assert hours == {("A", at(0)), ("C", at(2))}
    before = by(store.read_range("cpcb", "2024-11-01", "2024-11-02"), "station_id", "time")
    assert before["A", at(0)]["n_obs"] == 1 and before["A", at(29)]["n_obs"] == 2 and ("C", at(2)) not in before
    landed = spark.read.schema(schema).parquet(path)
    want = by(hourly_stats(landed.withColumn("time", F.date_trunc("hour", "event_time"))), "station_id", "time")
    for _ in range(2):
        live.heal(store, "cpcb", landed, live.late_hours(spark, late), "event_time")
        got = by(store.read_range("cpcb", "2024-11-01", "2024-11-02"), "station_id", "time")
        assert {k: (v["pm25"], v["pm25_min"], v["pm25_max"], v["n_obs"]) for k, v in got.items()} == {k: (v["pm25"], v["pm25_min"], v["pm25_max"], v["n_obs"]) for k, v in want.items()}
    assert live.late_hours(spark, scratch(spark, "none")).count() == 0
    with pytest.raises(ValueError):
        live.upsert_stream(live.hourly_with_late(stream), store, "cpcb", mark)


def test_domain_data_shows_every_branch():
    import __spark_entry__  # noqa: F401, registers the queries
    from catalog.registry import SQL, compose
    from check import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    kinds = lambda c, v: {r[0] for r in con.execute(compose(f"SELECT DISTINCT {c} FROM {v}")).fetchall()}
    assert kinds("quality_flag", "v_obs") == {"ok", "stuck", "suspect_low", "suspect_high"}
    assert kinds("fires_available", "v_fire_series") == {True, False}
    assert len(con.execute(SQL["e04_wind_strata"]).fetchall()) == 3
    both = [sorted(map(repr, con.execute(SQL[n]).fetchall())) for n in ("q2_quality_flags", "q2_quality_flags_as_written", "e13_spatial_baselines", "e13_spatial_baselines_as_written")]
    assert both[0] != both[1] and both[2] != both[3]
    assert con.execute(SQL["s11_stations_missing_from"]).fetchall() and con.execute(SQL["s07_missing_dates"]).fetchall()


def test_training_can_be_held_to_precede_evaluation(spark):
    from skycast.config import Block, Settings
    from skycast.operators.supervised import assign_split

    cfg = Settings(blocks=(Block("val", "2024-01-14", "2024-01-15", "a"), Block("test", "2024-01-21", "2024-01-25", "b")), embargo_h=24)
    days = [(dt.datetime(2024, 1, d), dt.datetime(2024, 1, d) + dt.timedelta(hours=24)) for d in (2, 12, 14, 17, 22, 28)]
    df = spark.createDataFrame(days, "issue_time timestamp, target_time timestamp")
    split = lambda before: [r["split"] for r in assign_split(df, cfg, before=before).orderBy("issue_time").collect()]
    assert split(False) == ["train", "embargo", "val", "train", "test", "train"] and split(True) == ["train", "embargo", "val", "later", "test", "later"]


def test_directions_average_as_vectors_on_request(spark):
    from skycast.functions.meteo import mean_direction

    df = spark.createDataFrame([(350.0,), (10.0,), (None,)], "d double")
    plain, vectors = df.agg(mean_direction("d"), mean_direction("d", circular=True)).first()
    assert plain == 180.0 and min(vectors, 360 - vectors) < 1e-9


def test_every_query_with_sql_names_existing_views():
    import __spark_entry__ as spec

    assert set(spec.oracle_sql()) <= set(spec.queries()) and len(spec.queries()) > 120


@pytest.mark.parametrize("name", ["q1_hourly_readings", "j5_supervised", "g1_neighbour_features", "e02_persistence_scores", "u2_keep_one", "x5_stage_probabilities"])
def test_queries_agree_with_sql(spark, name):
    import __spark_entry__ as spec
    from check import TABLES, normal

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = normal(spec.queries()[name](spark, SF).toPandas()), normal(con.execute(spec.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and got.equals(want)


def test_configuration_file_becomes_settings_and_rosters(spark, tmp_path):
    from skycast import config

    (tmp_path / "c.toml").write_text("""
[forecast]
horizons_h = [12, 24]
[grap]
city_average_cities = ["Delhi"]
[[grap.stages]]
stage = 1
name = "Poor"
aqi_min = 201
aqi_max = 300
[split]
embargo_h = 48
test_blocks = [{ start = "2025-01-01", end = "2025-01-02", label = "t" }]
[stations_meta]
stations = [{ id = "DL001", name = "A", city = "Delhi", agency = "DPCC", lat = 28.5, lon = 77.1, openaq_id = 5 }]
[upwind]
upwind_stations = [{ id = "UW001", name = "B", city = "C", agency = "D", lat = 29.0, lon = 76.0, distance_km = 65, bearing_deg = 298 }]
""")
    cfg = config.Settings.from_toml(str(tmp_path / "c.toml"))
    assert cfg.horizons == (12, 24) and cfg.embargo_h == 48 and len(cfg.stages) == 1 and cfg.blocks[0].label == "t"
    assert config.stations_frame(spark, cfg).first()["location_id"] == 5 and config.upwind_frame(spark, cfg).first()["bearing_deg"] == 298.0
    assert config.brackets_frame(spark, cfg).count() == 6 and config.blocks_frame(spark, cfg).first()["split"] == "test"


def test_history_files_and_gated_archive(spark, tmp_path):
    from skycast.plans.ingest import load_archive, load_history

    (tmp_path / "stations.csv").write_text("StationId,StationName,City,State,Status\nX1,\"Anand Vihar, Delhi - DPCC\",Delhi,Delhi,Active\n")
    (tmp_path / "station_hour.csv").write_text("StationId,Datetime,PM2.5,PM10\nX1,2018-11-05 01:00:00,80,1\nX1,bad,80,1\nX1,2018-11-05 02:00:00,,1\n")
    roster = spark.createDataFrame([("DL001", "Anand Vihar", "Delhi", 0)], "station_id string, name string, city string, rank int")
    got = load_history(spark, str(tmp_path), roster).collect()
    assert [(r["station_id"], r["time"], r["pm25"]) for r in got] == [("DL001", dt.datetime(2018, 11, 4, 19), 80.0)]
    (tmp_path / "a.csv").write_text("station_id,datetime,parameter,value\nA,2024-11-01T00:10:00Z,pm25,5\nA,2024-11-01T00:20:00Z,pm10,9\nA,2024-11-20T00:10:00Z,pm25,6\nA,2024-11-20T01:10:00Z,pm25,x\n")
    d = dt.date(2024, 11, 1)
    manifest = spark.createDataFrame([("A", d, "ok", False), ("A", dt.date(2024, 11, 20), "failed", False)], "station_id string, day date, status string, stored boolean")
    store = Store(spark, scratch(spark, "gated"))
    assert {r["action"] for r in load_archive(store, str(tmp_path / "a.csv"), manifest, d).collect()} == {"write", "refuse"}
    assert [r["pm25"] for r in store.read_range("cpcb", "2024-11-01", "2024-11-30").collect()] == [5.0]


def test_two_week_gate(spark):
    from catalog import frames as fr
    from skycast.plans.base import reconstruction_gate

    fr.table(spark, SF, "events")
    got = reconstruction_gate(fr.sources(spark, SF), {"first": "2024-01-01", "second": "2024-01-15"}, fr.JANUARY, ["pm25_clean", "obs_lag_24h", "absent"])
    ok = {(r["week"], r["check"]): r["ok"] for r in got.collect()}
    assert ok["first", "rows"] and ok["second", "duplicate_keys"] and ok["first", "column:obs_lag_24h"] and not ok["second", "column:absent"]


def test_entry_runs(spark):
    import __spark_entry__ as spec

    assert spec.entry(spark).count() >= 0


def test_fitted_queries_ask_for_the_whole_studies(spark, monkeypatch):
    from catalog import frames, q_eval, q_models, registry
    from catalog.registry import QUERIES

    studies, tuned = MagicMock(), MagicMock()
    studies.ablation.return_value = (MagicMock(), [])
    for name, value in {"studies": studies, "tune": tuned, "rows": MagicMock(), "fr": MagicMock(), "city_supervised": MagicMock(), "scratch": MagicMock()}.items():
        monkeypatch.setattr(q_models, name, value)
    monkeypatch.setattr(frames, "clean", lambda df: df)
    monkeypatch.setattr(registry, "clean", lambda df: df, raising=False)
    for name in ("e03_ablation", "e12_stage_evaluation", "e13_leave_one_out", "e14_lead_match_comparison", "e17_visibility_coupling", "m12_tune", "e22_rolling_origin"):
        QUERIES[name](None, "")
    # neither models nor parameters nor guards of their own
    shapes = {"ablation": 1, "stage_evaluation": 2, "leave_one_out": 4, "lead_match_comparison": 2, "visibility_evaluation": 1, "rolling_origin": 3}
    for name, n in shapes.items():
        call = getattr(studies, name).call_args
        assert len(call.args) == n and set(call.kwargs) == ({"lead"} if name == "rolling_origin" else set())
    assert len(tuned.call_args.args) == 2 and not tuned.call_args.kwargs
    assert not hasattr(q_models, "SMALL") and not hasattr(q_eval, "SMALL")
