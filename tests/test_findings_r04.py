"""Small cases of the findings of round 4."""

import datetime as dt
import random

import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from skycast.operators import matching, neighbours
from skycast.operators.models import Corrector
from skycast.session import staged


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_f4_all_pairs_are_dealt_out(spark, no_broadcast):
    n = 1200
    stations = spark.range(n).select(F.format_string("S%04d", "id").alias("station_id"), (28 + F.col("id") % 7 / 100).alias("lat"), F.lit(77.0).alias("lon"))
    met = neighbours.geometry(stations)
    per_task = [r["count"] for r in met.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(per_task) == n * n and max(per_task) < n * n / 3


def test_f5_only_pairs_that_score_are_made(spark, monkeypatch):
    rng = random.Random(5)
    name = lambda: " ".join(["Sector", *rng.sample(["12", "7", "34", "Block", "North", "Mandir", "12"], 2)])
    roster = spark.createDataFrame([(f"S{k}", name(), "DPCC", 28.0 + k % 3 / 50, 77.0) for k in range(40)], "station_id string, name string, agency string, lat double, lon double")
    seen = [dt.datetime(2020, 1, 1), dt.datetime(2023, 1, 1)]
    locs = [(k, f"{name()}, Delhi - DPCC", 28.0 + k % 3 / 50, 77.0, None if k % 5 == 0 else seen[k % 7 == 0], seen[1]) for k in range(60)]
    locs = spark.createDataFrame(locs, "location_id long, loc_name string, lat double, lon double, first_seen timestamp, last_seen timestamp")
    window = dt.datetime(2021, 1, 1), dt.datetime(2022, 1, 1)
    made = []
    monkeypatch.setattr(matching, "_ranked", lambda pairs, *rest, f=matching._ranked: made.append(pairs) or f(pairs, *rest))
    pick = ["station_id", "location_id", "km", "name_score", "span_days"]
    every = matching.location_pairs(roster, locs, *window)
    want = sorted(map(tuple, every.where("covers and name_score > 0").select(*pick).collect()))
    got = sorted(map(tuple, matching.scored_pairs(roster, locs, *window).select(*pick).collect()))
    assert got == want and made[-1].count() == len(want) < every.count() / 2


def test_f2_persisted_rows_have_as_many_partitions_as_they_need(spark, no_broadcast):
    a = spark.range(500).withColumn("v", F.col("id") * 2)
    met = a.join(a.withColumnRenamed("v", "w"), "id").persist()
    try:
        assert met.count() == 500 and met.rdd.getNumPartitions() < 50
    finally:
        met.unpersist()


def test_f3_one_pass_reaches_the_leaves_that_the_forest_says(spark):
    rows = spark.range(3000).select(
        (F.col("id") % 2 * 24 + 24).cast("int").alias("horizon_h"), (F.rand(1) * 100).alias("cams_pm2_5_tgt"), F.rand(2).alias("a"),
        F.when(F.rand(3) > 0.1, F.rand(4)).alias("b"),
    ).withColumn("y", F.col("cams_pm2_5_tgt") + F.when(F.col("a") > 0.5, 20 * F.coalesce("b", F.lit(3))).otherwise(-5))
    rows = staged(rows, "rows")
    m = Corrector("m").fit(rows)
    assert set(m.forests) == {24, 48}
    reached = m.residuals(rows).withColumn("_v", array_to_vector(m._inputs()))
    for h, forest in m.forests.items():
        said = forest.setLeafCol("_leaf").transform(reached.where(F.col("horizon_h") == h))
        assert said.where(vector_to_array("_leaf").cast("array<int>") != F.col("_res.leaf")).count() == 0
        assert said.where("_res is null").count() == 0
    plan = m.predict(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1
    other = m.predict(rows.limit(2).withColumn("horizon_h", F.lit(99))).collect()
    assert len(other) == 2 and all(r["q10"] == r["q50"] == r["q90"] == r["cams_pm2_5_tgt"] for r in other)
