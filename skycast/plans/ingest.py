"""Landed files to the store: the batch side of the archive."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matching import match_by_name
from ..operators.quality import flag_quality, to_hourly
from ..sources.readers import bulk_readings, history_hourly, read_bulk_csv
from ..sources.store import Store, chunk_gate, chunk_of


def load_history(spark: SparkSession, directory: str, roster: DataFrame, cutoff: dt.date | None = dt.date(2021, 1, 1)) -> DataFrame:
    """stations.csv and station_hour.csv of the historical archive to flagged UTC hours of matched stations."""
    catalogue = spark.read.option("header", "true").csv(f"{directory}/stations.csv")
    rows = spark.read.option("header", "true").csv(f"{directory}/station_hour.csv")
    candidates = catalogue.select(F.col("StationId").alias("candidate_id"), F.col("StationName").alias("candidate_name"))
    ids = match_by_name(roster, candidates).select("station_id", F.col("candidate_id").alias("their_id"))
    return history_hourly(rows, ids, cutoff=cutoff)


def load_archive(store: Store, path: str, manifest: DataFrame, start: dt.date, dataset: str = "cpcb", station: str = "station_id") -> DataFrame:
    """Bulk files to flagged hours, written only for chunks whose failure rate allows it. Returns the chunk actions.

    The manifest lists every expected (station, day) object with its outcome.
    """
    actions = chunk_gate(manifest, start)
    hourly = flag_quality(to_hourly(bulk_readings(read_bulk_csv(store.spark, path), station)))
    allowed = actions.where("action = 'write'").select("chunk")
    store.write(hourly.withColumn("chunk", chunk_of(F.to_date("time"), start)).join(allowed, "chunk", "left_semi").drop("chunk"), dataset)
    return actions
