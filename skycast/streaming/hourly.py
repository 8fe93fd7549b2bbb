"""Readings arriving as files to hourly partitions that stay current."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.quality import flag_quality, hourly_stats, stamp_time, to_hourly
from ..session import staged
from ..sources.store import Store

READING_SCHEMA = "station_id string, datetime string, value double"


def read_readings(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = READING_SCHEMA, **options) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def hourly_stream(readings: DataFrame, watermark: str = "12 hours", time: str = "event_time") -> DataFrame:
    """Tumbling one-hour statistics per station. ``time`` must be a timestamp.

    State is one row per open (station, hour), and hours close as the watermark passes.
    """
    good = F.col("value").isNotNull() & ~F.isnan("value")
    return (
        readings.where(good)
        .withWatermark(time, watermark)
        .groupBy("station_id", F.window(time, "1 hour"))
        .agg(
            F.avg("value").alias("pm25"), F.min("value").alias("pm25_min"), F.max("value").alias("pm25_max"),
            F.count("*").alias("n_obs"),
        )
        .select("station_id", F.col("window.start").alias("time"), "pm25", "pm25_min", "pm25_max", "n_obs")
    )


def with_event_time(readings: DataFrame, stamp: str = "datetime") -> DataFrame:
    return readings.withColumn("event_time", stamp_time(stamp))


STATE = "hours array<long>, n array<long>, total array<double>, low array<double>, high array<double>"
HOURLY = "station_id string, time timestamp, pm25 double, pm25_min double, pm25_max double, n_obs long, late boolean"
HOUR_MS = 3_600_000


def hourly_with_late(readings: DataFrame, watermark: str = "12 hours", time: str = "event_time") -> DataFrame:
    """As ``hourly_stream``, but with rows for late readings too: ``late`` marks hours that had closed before a reading came.

    A station's open hours are its state: count, sum, least and largest. The watermark closes hours; a reading of a
    closed hour yields a late row (of the late readings alone) instead of vanishing. State is bounded by
    the hours within the watermark, one station's at a time; a batch of a station is summed by hour before it meets
    the state, so a station with most of the readings adds few rows.
    """
    good = F.col("value").isNotNull() & ~F.isnan("value") & F.col(time).isNotNull()
    rows = readings.where(good).withWatermark(time, watermark).select(
        "station_id", time, (F.floor(F.unix_millis(time) / HOUR_MS) * HOUR_MS).cast("long").alias("hour"), F.col("value").cast("double").alias("value")
    )

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed = state.getCurrentWatermarkMs()
        hours: dict[int, list] = {}
        if state.exists:
            hours = {h: [n, t, lo, hi] for h, n, t, lo, hi in zip(*state.get)}
        changed: dict[tuple[int, bool], list] = {}
        for part in parts:
            sums = part.groupby("hour")["value"].agg(["size", "sum", "min", "max"])
            for h, n, t, lo, hi in zip(sums.index.tolist(), *(sums[c].tolist() for c in sums.columns)):
                late = h + HOUR_MS <= closed
                held = changed.get((h, late)) if late else hours.get(h)
                made = [n, t, lo, hi] if held is None else [held[0] + n, held[1] + t, min(held[2], lo), max(held[3], hi)]
                changed[h, late] = made
                if not late:
                    hours[h] = made
        hours = {h: x for h, x in hours.items() if h + HOUR_MS > closed}
        state.update(([*hours], *([x[k] for x in hours.values()] for k in range(4))))
        if changed:
            yield pd.DataFrame({
                "station_id": [key[0]] * len(changed), "time": pd.to_datetime([h for h, _ in changed], unit="ms", utc=True),
                "pm25": [x[1] / x[0] for x in changed.values()], "pm25_min": [x[2] for x in changed.values()],
                "pm25_max": [x[3] for x in changed.values()], "n_obs": [x[0] for x in changed.values()], "late": [late for _, late in changed],
            })

    return rows.groupBy("station_id").applyInPandasWithState(step, HOURLY, STATE, "update", GroupStateTimeout.NoTimeout)


def upsert_stream(
    hourly: DataFrame, store: Store, dataset: str, checkpoint: str, available_now: bool = True, mode: str = "update", late: str | None = None
) -> StreamingQuery:
    """Merge every changed hour into its date partition, the newer value winning.

    An hour's row carries its full statistics so far, so replaying a batch after a failure
    writes the same values. Quality flags look across hours and are set on read-out by
    ``flagged``, where the whole series is at hand. Late rows (of ``hourly_with_late``) go to the healing table at
    ``late`` instead, one part per batch, which a replay overwrites.
    """
    apart = "late" in hourly.columns
    if apart and late is None:
        raise ValueError("late rows need a healing table")

    def merge(batch: DataFrame, number: int) -> None:
        # Written once, so that the batch and its state are evaluated once.
        landed = staged(batch, "batch")
        if apart:
            landed.where("late").drop("late").withColumn("batch", F.lit(number)).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(late)
            landed = landed.where("not late").drop("late")
        if not landed.isEmpty():
            store.write(landed, dataset, merge_on=("station_id", "time"))

    writer = hourly.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(merge)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 minutes")).start()


def flagged(store: Store, dataset: str, start, end) -> DataFrame | None:
    rows = store.read_range(dataset, start, end)
    return None if rows is None else flag_quality(rows)


def late_hours(spark: SparkSession, late: str) -> DataFrame:
    """station_id, time of the hours in a healing table; each once."""
    try:
        return spark.read.parquet(late).select("station_id", "time").distinct()
    except AnalysisException:  # nothing has been late yet
        return spark.createDataFrame([], "station_id string, time timestamp")


def heal(store: Store, dataset: str, landed: DataFrame, hours: DataFrame | None = None, stamp: str = "datetime") -> None:
    """Batch repair: statistics of landed raw readings, anew and whole, merge over what is held.

    ``hours`` (station_id, time) restricts it to those of a healing table. Each hour is computed from all its landed
    readings, so healing twice changes nothing.
    """
    stats = to_hourly(landed, stamp) if stamp != "event_time" else hourly_stats(landed.withColumn("time", F.date_trunc("hour", "event_time")))
    if hours is not None:
        stats = stats.join(hours, ["station_id", "time"], "left_semi")
    store.write(stats, dataset, merge_on=("station_id", "time"))
