import datetime as dt

import pytest
from pyspark.sql import functions as F

from skycast.operators.quality import flag_quality, reconstruction_checks, stable_basket, step_changes, to_hourly, unread_stamps
from skycast.sources import readers as rd
from skycast.sources import store as st
from skycast.session import scratch

from .conftest import T0, by, hours


def test_offsets_and_z_are_read_before_truncation_and_junk_is_dropped(spark):
    raw = spark.createDataFrame(
        [("A", "2025-11-01T00:45:00+05:30", 10.0), ("A", "2025-10-31T19:50:00Z", 20.0), ("A", "not a time", 5.0),
         ("A", "2025-10-31T19:10:00Z", float("nan")), ("A", "2025-10-31T19:20:00Z", None), ("B", "2026-08-24T03:30:00Z", 7.0)],
        "station_id string, datetime string, value double")
    got = by(to_hourly(raw), "station_id", "time")
    a = got["A", dt.datetime(2025, 10, 31, 19)]
    assert (a["pm25"], a["pm25_min"], a["pm25_max"], a["n_obs"]) == (15.0, 10.0, 20.0, 2)
    assert got["B", dt.datetime(2026, 8, 24, 3)]["n_obs"] == 1 and len(got) == 2


@pytest.mark.parametrize("values, documented, written", [
    ([1] + [5.0] * 10 + [6, 7, 8], 9, 0),
    ([1, 5, 5, 6, 7, 8, 9, 10, 11], 0, 1),
    ([5.0] * 10 + [6, 7, 8, 9, 10, 11], 9, 1),
])
def test_stuck_runs_in_both_modes(spark, values, documented, written):
    rows = [("A", t, float(v)) for t, v in zip(hours(len(values)), values)]
    df = spark.createDataFrame(rows, "station_id string, time timestamp, pm25 double")
    assert flag_quality(df).where("quality_flag = 'stuck'").count() == documented
    assert flag_quality(df, compat=True).where("quality_flag = 'stuck'").count() == written


def test_limits_and_clean_value_and_a_gap_ends_a_run(spark):
    ts = hours(3) + [T0 + dt.timedelta(hours=h) for h in range(10, 14)]
    rows = [("A", t, 5.0) for t in ts] + [("B", T0, 0.5), ("B", T0 + dt.timedelta(hours=1), 1300.0)]
    got = by(flag_quality(spark.createDataFrame(rows, "station_id string, time timestamp, pm25 double")), "station_id", "time")
    assert {r["quality_flag"] for k, r in got.items() if k[0] == "A"} == {"ok"}
    assert got["B", T0]["quality_flag"] == "suspect_low" and got["B", T0]["pm25_clean"] is None and got["B", T0]["pm25"] == 0.5
    assert got["B", T0 + dt.timedelta(hours=1)]["quality_flag"] == "suspect_high"


def test_step_change_and_basket(spark):
    rows = [("A", T0 + dt.timedelta(days=d), 10.0 if d < 40 else 50.0, "ok") for d in range(80)]
    rows += [("B", T0 + dt.timedelta(days=d), 10.0, "ok") for d in range(0, 80, 4)]
    df = spark.createDataFrame(rows, "station_id string, time timestamp, pm25 double, quality_flag string").withColumn("pm25_clean", F.col("pm25"))
    assert {r["station_id"] for r in step_changes(df).collect()} == {"A"}
    assert {r[0] for r in stable_basket(df, 0.5).select("station_id").distinct().collect()} == {"A"}
    assert stable_basket(df, 1.5).count() == 100 and stable_basket(df, 0).count() == 100


def test_gate_counts_rows_duplicates_and_dead_columns(spark):
    rows = [("A", t, 1.0, None) for t in hours(24)] + [("A", T0, 1.0, None)]
    df = spark.createDataFrame(rows, "station_id string, time timestamp, x double, y double")
    ok = {r["check"]: r["ok"] for r in reconstruction_checks(df, 1, 1, ["x", "y", "z"]).collect()}
    assert ok == {"rows": False, "duplicate_keys": False, "column:x": True, "column:y": False, "column:z": False}


def _frame(spark, n, value, start=T0):
    return spark.createDataFrame([("A", t, float(value)) for t in hours(n, start)], "station_id string, time timestamp, value double")


def test_replace_merge_prefer_and_schema_growth(spark):
    store = st.Store(spark, scratch(spark, "t"))
    store.write(_frame(spark, 48, 1), "d")
    store.write(_frame(spark, 24, 2), "d")
    got = store.read_range("d", "2024-11-01", "2024-11-02")
    assert got.count() == 48 and got.where("value = 2").count() == 24
    part = _frame(spark, 6, 9, T0 + dt.timedelta(hours=20)).withColumn("source", F.lit("api"))
    store.write(part, "d", merge_on=("station_id", "time"))
    got = store.read_range("d", "2024-11-01", "2024-11-02")
    assert got.count() == 48 and got.where("value = 9 and source = 'api'").count() == 6
    store.write(_frame(spark, 48, 5), "d", merge_on=("station_id", "time"), prefer="existing")
    assert store.read_range("d", "2024-11-01", "2024-11-02").where("value = 5").count() == 0
    store.write(_frame(spark, 2, 7), "d", merge_on=("station_id", "absent"))
    assert store.read_range("d", "2024-11-01", "2024-11-01").count() == 2
    store.write(_frame(spark, 48, 5).limit(0), "d")
    assert store.read_range("d", "2024-11-02", "2024-11-02", ["value"]).columns == ["value"]
    assert store.read_range("absent", "2024-11-01", "2024-11-02") is None
    assert [str(r[0]) for r in store.missing_dates("d", "2024-11-01", "2024-11-04").orderBy("date").collect()] == ["2024-11-03", "2024-11-04"]


def test_scan_prunes_partitions(spark):
    store = st.Store(spark, scratch(spark, "t"))
    store.write(_frame(spark, 72, 1), "d")
    plan = store.read_range("d", "2024-11-02", "2024-11-02", ["value"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "2024-11-02" in plan and "station_id" not in plan.split("ReadSchema")[1]


def test_zone_less_times_are_rejected(spark):
    store = st.Store(spark, scratch(spark, "t"))
    df = _frame(spark, 2, 1)
    with pytest.raises(TypeError):
        store.write(df.withColumn("time", F.col("time").cast("timestamp_ntz")), "d")
    with pytest.raises(ValueError):
        store.write(df.drop("time"), "d")


def test_run_partition_latest_run_mirror_and_coverage(spark):
    store, other = st.Store(spark, scratch(spark, "t")), st.Store(spark, scratch(spark, "t"))
    run = _frame(spark, 72, 1).withColumn("issue_time", F.lit(T0).cast("timestamp"))
    later = _frame(spark, 72, 2, T0 + dt.timedelta(days=1)).withColumn("issue_time", F.lit(T0 + dt.timedelta(days=1)).cast("timestamp"))
    store.write(run, "cams_runs", partition_col="issue_time")
    store.write(later, "cams_runs", partition_col="issue_time")
    assert store.latest_run("cams_runs").where("value = 2").count() == 72
    assert len(store.mirror(["cams_runs"], other)) == 2 and len(store.mirror(["cams_runs"], other)) == 0
    assert other.scan("cams_runs").count() == 144
    cov = by(store.coverage(["cams_runs", "none"], dt.datetime(2024, 11, 3, 11, 59)), "dataset")
    assert cov["cams_runs"]["days"] == 2 and cov["cams_runs"]["age_hours"] == 12.0 and cov["none"]["days"] == 0 and cov["none"]["last"] is None


def test_shrink_thin_and_heal(spark):
    a, b = _frame(spark, 5, 1), _frame(spark, 24, 1)
    assert st.shrink_findings(a, b).count() == 1 and st.shrink_findings(b, a).count() == 0
    day = dt.date(2024, 11, 3)
    df = _frame(spark, 24, 1, dt.datetime(2024, 11, 1)).unionByName(_frame(spark, 3, 1, dt.datetime(2024, 11, 2)))
    assert [(str(r["day"]), r["hours"]) for r in st.thin_days(df, day).collect()] == [("2024-11-02", 3)]
    assert {str(r["date"]): r["hours"] for r in st.heal_candidates(df, day, days=3).collect()} == {"2024-10-31": 0, "2024-11-02": 3}


def test_expansion_takes_the_nearest_cell(spark):
    held = spark.createDataFrame(
        [(s, T0, v, la, 77.0, n) for s, v, la, n in (("A", 1.0, 28.0, "a"), ("B", 2.0, 29.0, "b"))],
        "station_id string, time timestamp, pm2_5 double, cell_lat double, cell_lon double, station_name string").withColumn("date", F.to_date("time"))
    roster = spark.createDataFrame([("A", "a", 28.0, 77.0), ("B", "b", 29.0, 77.0), ("C", "c", 28.9, 77.3)], "station_id string, name string, lat double, lon double")
    got = st.expand_gridded(held, roster).collect()
    assert [(r["station_id"], r["station_name"], r["pm2_5"]) for r in got] == [("C", "c", 2.0)]


def test_chunk_gate_refuses_failures_but_not_absences(spark):
    d = dt.date(2024, 11, 1)
    rows = [(f"S{i}", d, "failed" if i < 3 else "ok", False) for i in range(10)]
    rows += [(f"S{i}", d + dt.timedelta(days=15), "absent", False) for i in range(10)]
    rows += [("S1", d + dt.timedelta(days=30), "failed", True)]
    df = spark.createDataFrame(rows, "station_id string, day date, status string, stored boolean")
    assert {r["chunk"]: r["action"] for r in st.chunk_gate(df, d).collect()} == {0: "refuse", 1: "write", 2: "skip"}


def test_airport_fire_and_history_parsers(spark):
    air = spark.createDataFrame([("VIDP", "2024-11-01 00:00", "1.0", "50", "M", "10"), ("VIDP", "2024-11-01 00:30", "M", "68", "50", "None"), ("VIDP", "x", "1", "1", "1", "1")],
                                "station string, valid string, vsby string, tmpf string, dwpf string, sknt string")
    r = rd.airport_hourly(air).collect()
    assert len(r) == 1 and r[0]["n_obs"] == 2 and abs(r[0]["visibility_km"] - 1.609344) < 1e-12 and abs(r[0]["temp_c"] - 15.0) < 1e-9
    assert abs(r[0]["dew_point_depression_c"] - 5.0) < 1e-9 and abs(r[0]["wind_speed_ms"] - 5.14444) < 1e-9
    fire = spark.createDataFrame([("30.1", "75.2", "2024-11-01", "42", "3.5", "n", "D")], "latitude string, longitude string, acq_date string, acq_time string, frp string, confidence string, daynight string")
    f = rd.fire_events(fire, "P").first()
    assert f["time"] == dt.datetime(2024, 11, 1, 0, 42) and f["frp"] == 3.5
    hist = spark.createDataFrame([("X1", "2018-11-05 01:00:00", "80"), ("X1", "2021-06-01 01:00:00", "80"), ("X9", "2018-11-05 01:00:00", "80")], "StationId string, Datetime string, `PM2.5` string")
    h = rd.history_hourly(hist, spark.createDataFrame([("DL001", "X1")], "station_id string, their_id string")).collect()
    assert [(r["station_id"], r["time"]) for r in h] == [("DL001", dt.datetime(2018, 11, 4, 19))]


def test_live_sensors_discovery_and_ids(spark):
    now = dt.datetime(2024, 11, 1)

    def loc(i, name, provider, last, lat):
        sensors = [(i * 10, ("pm25",), (last,)), (i * 10 + 1, ("pm25",), ("2020-01-01T00:00:00Z",)), (i * 10 + 2, ("pm25",), (None,)), (i * 10 + 3, ("no2",), (last,))]
        return (i, name, (provider,), (lat, 77.0), sensors, ("2020-01-01T00:00:00Z",), (last,))

    live = "2024-10-31T00:00:00Z"
    df = spark.createDataFrame(
        [loc(1, "Talkatora Garden, Delhi - DPCC", "CPCB", live, 28.5), loc(2, "Dead, Delhi - DPCC", "CPCB", "2024-01-01T00:00:00Z", 28.6),
         loc(3, "Cheap", "AirGradient", live, 28.7), loc(4, "Twin, Noida - UPPCB", "N/A", live, 28.9), loc(5, "Known", "CPCB", live, 29.0)], rd.LOCATION_SCHEMA)
    assert rd.live_sensors(df, now).where("id = 1").first()["sensor_ids"] == [10, 12]
    roster = spark.createDataFrame([("DL007", "x", 28.9, 77.0, 5), ("UP003", "y", 28.2, 77.0, 0)], "station_id string, name string, lat double, lon double, location_id long")
    found = rd.discover(df, roster, now, (28.6, 77.2))
    got = by(found, "location_id")
    assert set(got) == {1, 4} and got[4]["colocated"] and not got[1]["colocated"]
    assert got[1]["name"] == "Talkatora Garden" and got[1]["agency"] == "DPCC"
    ids = rd.allocate_ids(found.withColumn("colocated", F.lit(False)), roster)
    assert {r["location_id"]: r["station_id"] for r in ids.collect()} == {1: "DL008", 4: "UP004"}


def test_replace_warns_of_lost_rows_and_merge_does_not(spark, tmp_path, caplog):
    store = st.Store(spark, str(tmp_path))
    rows = [("a", t, 1.0) for t in hours(20)]
    make = lambda r: spark.createDataFrame(r, "station_id string, time timestamp, v double")
    store.write(make(rows), "d")
    with caplog.at_level("WARNING", logger="skycast.sources.store"):
        store.write(make(rows[:3]), "d", merge_on=("station_id", "time"))
        assert not caplog.records and store.scan("d").count() == 20
        store.write(make(rows[:3]), "d")
    assert len(caplog.records) == 1 and store.scan("d").count() == 3


def test_unreadable_stored_file_is_replaced(spark, tmp_path):
    store = st.Store(spark, str(tmp_path))
    make = lambda r: spark.createDataFrame(r, "station_id string, time timestamp, v double")
    store.write(make([("a", t, 1.0) for t in hours(30)]), "d")
    broken = next(p for p in sorted((tmp_path / "d").glob("date=*/part-*.parquet")))
    broken.write_bytes(broken.read_bytes()[:200] + b"x" * 300)
    for crc in (tmp_path / "d").glob("date=*/.*.crc"):
        crc.unlink()
    day = broken.parent.name.removeprefix("date=")
    store.write(make([("a", t, 2.0) for t in hours(30) if str(t.date()) == day][:5]), "d", merge_on=("station_id", "time"))
    assert spark.read.parquet(str(broken.parent)).count() == 5


def test_both_offset_forms_are_read_and_the_rest_is_counted(spark):
    raw = spark.createDataFrame(
        [("a", "2025-11-01T00:45:00+0530", 1.0), ("a", "2025-11-01T00:50:00+05:30", 3.0), ("a", "2025-10-31T19:30:00Z", 5.0), ("b", "2025-11-01T00:45:00", 1.0), ("b", None, 1.0)],
        "station_id string, datetime string, value double",
    )
    got = to_hourly(raw).collect()
    assert [(r.station_id, r.pm25, r.n_obs) for r in got] == [("a", 3.0, 3)]
    assert [tuple(r) for r in unread_stamps(raw).collect()] == [("b", 1)]
