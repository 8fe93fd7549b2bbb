"""Date-partitioned Parquet datasets: replace, merge, scan, inspect and mirror."""

from __future__ import annotations

import datetime as dt
import json
import logging
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import nearest_planar
from ..session import staged

log = logging.getLogger(__name__)

SHRINK_RATIO = 0.5
CHUNK_DAYS = 15
MAX_FAILURE_RATE = 0.25
RECENT_PRODUCT_DAYS = 60


def require_utc(df: DataFrame, column: str) -> None:
    """Reject a missing, non-timestamp or zone-less time column."""
    if column not in df.columns:
        raise ValueError(f"no time column {column!r}")
    if not isinstance(df.schema[column].dataType, T.TimestampType):
        raise TypeError(f"{column} must be a UTC timestamp, got {df.schema[column].dataType.simpleString()}")


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], keep: str = "first") -> DataFrame:
    """One row per key by an explicit order; remaining ties fall to the other columns.

    An aggregate rather than a ranking window: copies of a hot key are reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if keep == "first" else F.max_by
    row = F.struct(*rest)
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order], *[F.col(c) for c in rest])
    return df.groupBy(*keys).agg(pick(row, rank).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def merge_frames(incoming: DataFrame, stored: DataFrame, keys: Sequence[str], prefer: str = "incoming") -> DataFrame:
    """Union by name with one row per key; the preferred side wins a collision."""
    rank = {"incoming": (0, 1), "existing": (1, 0)}[prefer]
    both = incoming.withColumn("_prio", F.lit(rank[0])).unionByName(
        stored.withColumn("_prio", F.lit(rank[1])), allowMissingColumns=True
    )
    return keep_one(both, keys, ["_prio"]).drop("_prio")


class Store:
    """Datasets below ``root``, each partitioned by a UTC ``date``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, dataset: str) -> str:
        return f"{self.root}/{dataset}"

    def schema(self, dataset: str) -> T.StructType | None:
        """The columns of a dataset, kept beside it; None where nothing was written by this class."""
        try:
            row = self.spark.read.text(f"{self.path(dataset)}/_schema").first()
        except AnalysisException:
            return None
        return None if row is None else T.StructType.fromJson(json.loads(row[0]))

    def _remember(self, dataset: str, added: T.StructType) -> None:
        """Adds columns to the kept schema; it is only written when it changes."""
        held = self.scan(dataset)
        known = T.StructType([] if held is None else held.schema.fields)
        new = [f for f in added.fields if f.name not in known.names]
        if new or self.schema(dataset) is None:
            text = T.StructType([*known.fields, *new]).json()
            self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path(dataset)}/_schema")

    def scan(self, dataset: str) -> DataFrame | None:
        """The whole dataset with its ``date`` column; None when absent or unreadable.

        With the kept schema no footer is opened before the dates are pruned.
        """
        known = self.schema(dataset)
        reader = self.spark.read.option("mergeSchema", "true") if known is None else self.spark.read.schema(known)
        try:
            df = reader.parquet(self.path(dataset))
        except AnalysisException:
            return None
        return df if "date" in df.columns else None

    def _readable(self, dataset: str, days: Sequence[dt.date]) -> DataFrame | None:
        """What is stored for the given dates; None, after a warning, where a file of theirs can't be read."""
        df = self.scan(dataset)
        if df is None or not days:
            return None
        df = df.where(F.col("date").isin(list(days)))
        try:
            df.write.format("noop").mode("overwrite").save()
        except (PySparkException, Py4JJavaError) as broken:
            if "FAILED_READ_FILE" not in str(broken):
                raise
            log.warning("%s: stored files of %s can't be read and are replaced", dataset, ", ".join(map(str, sorted(days))))
            return None
        return df

    def write(
        self,
        df: DataFrame,
        dataset: str,
        time_col: str = "time",
        partition_col: str | None = None,
        merge_on: Sequence[str] | None = None,
        prefer: str = "incoming",
    ) -> None:
        """Replace the dates present in ``df``, or merge into them on ``merge_on``.

        The rows are written aside first, so that they are evaluated once, and a failed commit loses
        no stored row. A replace that leaves a date with less than half of its rows warns; a merge
        can't lose any. Dates whose stored files can't be read are replaced, with a warning.

        REBALANCE splits a date holding most of the rows over several files and packs small dates together.
        """
        part = partition_col or time_col
        for c in {time_col, part}:
            require_utc(df, c)
        out = staged(df.withColumn("date", F.to_date(part)), f"write-{dataset}")
        days = [r[0] for r in out.select("date").distinct().collect()]
        stored = self._readable(dataset, days)
        if stored is not None and merge_on and set(merge_on) <= set(out.columns) & set(stored.columns):
            out = staged(merge_frames(out, stored, ["date", *merge_on], prefer), f"merge-{dataset}")
        elif stored is not None:
            for r in shrink_findings(out, stored, "date").orderBy("date").collect():
                log.warning("%s: %s goes from %d to %d rows", dataset, r.date, r.stored_rows, r.incoming_rows)
        self._remember(dataset, out.schema)
        (
            out.hint("rebalance", F.col("date"))
            .sortWithinPartitions("date", time_col)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", "zstd")
            .partitionBy("date")
            .parquet(self.path(dataset))
        )

    def read_range(self, dataset: str, start, end, columns: Sequence[str] | None = None) -> DataFrame | None:
        """Closed date range; absent days are simply not there, absent columns are null."""
        start, end = _day(start), _day(end)
        if end < start:
            raise ValueError(f"end {end} is before start {start}")
        df = self.scan(dataset)
        if df is None:
            return None
        df = df.where(F.col("date").between(F.lit(start), F.lit(end)))
        return df.select(*columns) if columns else df.drop("date")

    def available_dates(self, dataset: str) -> DataFrame:
        df = self.scan(dataset)
        if df is None:
            return self.spark.createDataFrame([], "date date")
        return df.select("date").distinct()

    def missing_dates(self, dataset: str, start, end) -> DataFrame:
        return calendar_days(self.spark, start, end).join(self.available_dates(dataset), "date", "left_anti")

    def latest_run(self, dataset: str) -> DataFrame | None:
        """The newest issue-date partition, whole."""
        df = self.scan(dataset)
        return None if df is None else newest_partition(df).drop("date")

    def coverage(self, datasets: Sequence[str], now: dt.datetime) -> DataFrame:
        frames = []
        for name in datasets:
            df = self.scan(name)
            if df is not None:
                frames.append(df.select(F.lit(name).alias("dataset"), "date"))
        return coverage_summary(self.spark, frames, datasets, now)

    def mirror(self, datasets: Sequence[str], target: Store) -> list[tuple[str, dt.date]]:
        """Copy partitions the target lacks or holds older; never delete."""
        copied = []
        for name in datasets:
            df = self.scan(name)
            if df is None:
                continue
            stamp = F.max("_metadata.file_modification_time")
            mine = df.groupBy("date").agg(stamp.alias("mine"))
            other = target.scan(name)
            if other is None:
                due = mine.select("date")
            else:
                theirs = other.groupBy("date").agg(stamp.alias("theirs"))
                due = mine.join(theirs, "date", "left").where("theirs is null or mine > theirs").select("date")
            days = [r[0] for r in due.collect()]
            if days:
                target._remember(name, df.schema)
                (
                    df.where(F.col("date").isin(days))
                    .hint("rebalance", F.col("date"))
                    .write.mode("overwrite")
                    .option("partitionOverwriteMode", "dynamic")
                    .option("compression", "zstd")
                    .partitionBy("date")
                    .parquet(target.path(name))
                )
                copied += [(name, d) for d in days]
        return copied


def _day(value) -> dt.date:
    if isinstance(value, str):
        return dt.date.fromisoformat(value[:10])
    return value.date() if isinstance(value, dt.datetime) else value


def calendar_days(spark: SparkSession, start, end) -> DataFrame:
    start, end = _day(start), _day(end)
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date"))


def newest_partition(df: DataFrame, date: str = "date") -> DataFrame:
    """Rows of the newest date. The date is read first so that the scan is pruned to one partition."""
    last = df.agg(F.max(date)).first()[0]
    return df.where(F.col(date) == F.lit(last))


def coverage_summary(spark, frames: Sequence[DataFrame], datasets: Sequence[str], now: dt.datetime) -> DataFrame:
    """days, first, last, rows and age in hours of every named dataset, empty ones included.

    Age counts from the end of the newest day: a partition is dated, not stamped.
    """
    names = spark.createDataFrame([(d,) for d in datasets], "dataset string")
    rows = spark.createDataFrame([], "dataset string, date date")
    for f in frames:
        rows = rows.unionByName(f.select("dataset", "date"))
    per_day = rows.groupBy("dataset", "date").agg(F.count("*").alias("n"))
    out = per_day.groupBy("dataset").agg(
        F.count("*").alias("days"), F.min("date").alias("first"), F.max("date").alias("last"), F.sum("n").alias("rows")
    )
    end = F.unix_timestamp(F.col("last").cast("timestamp")) + 24 * 3600 - 60
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - end) / 3600.0
    return (
        names.join(out, "dataset", "left")
        .fillna(0, ["days", "rows"])
        .withColumn("age_hours", F.when(F.col("last").isNotNull(), F.round(F.greatest(age, F.lit(0.0)), 1)))
    )


def shrink_findings(incoming: DataFrame, stored: DataFrame, time_col: str = "time") -> DataFrame:
    """Dates where a replace would leave less than half of the stored rows."""
    a = incoming.groupBy(F.to_date(time_col).alias("date")).agg(F.count("*").alias("incoming_rows"))
    b = stored.groupBy(F.to_date(time_col).alias("date")).agg(F.count("*").alias("stored_rows"))
    return (
        a.join(b, "date")
        .where(F.col("incoming_rows") < SHRINK_RATIO * F.col("stored_rows"))
        .withColumn("lost_share", 1 - F.col("incoming_rows") / F.col("stored_rows"))
    )


def short_partitions(df: DataFrame, min_stations: int, date: str = "date") -> DataFrame:
    """Dates with fewer than ``min_stations`` distinct stations."""
    return (
        df.groupBy(date).agg(F.countDistinct("station_id").alias("stations")).where(F.col("stations") < min_stations)
    )


def missing_stations(df: DataFrame, roster: DataFrame, date: str = "date") -> DataFrame:
    """Roster stations without a row in the newest partition."""
    last = newest_partition(df, date).select("station_id").distinct()
    return roster.join(last, "station_id", "left_anti")


def stations_missing_from(df: DataFrame, roster: DataFrame, days: Sequence[dt.date], date: str = "date") -> DataFrame:
    present = df.where(F.col(date).isin([_day(d) for d in days])).select("station_id").distinct()
    return roster.join(present, "station_id", "left_anti")


def thin_days(df: DataFrame, today, days: int = 7, min_hours: int = 18, time_col: str = "time") -> DataFrame:
    """Full days of the last week that hold too few distinct hours."""
    today = _day(today)
    day = F.to_date(time_col)
    window = df.where((day >= F.lit(today - dt.timedelta(days=days))) & (day < F.lit(today)))
    return (
        window.groupBy(day.alias("day")).agg(F.countDistinct(time_col).alias("hours")).where(F.col("hours") < min_hours)
    )


def heal_candidates(df: DataFrame, today, days: int = 10, min_hours: int = 24, time_col: str = "time") -> DataFrame:
    """Recent days short of hours, wholly absent days included, today excluded."""
    today = _day(today)
    first, last = today - dt.timedelta(days=days), today - dt.timedelta(days=1)
    held = (
        df.where(F.to_date(time_col).between(F.lit(first), F.lit(last)))
        .groupBy(F.to_date(time_col).alias("date"))
        .agg(F.countDistinct(time_col).alias("hours"))
    )
    return (
        calendar_days(df.sparkSession, first, last)
        .join(held, "date", "left")
        .withColumn("hours", F.coalesce("hours", F.lit(0).cast("long")))
        .where(F.col("hours") < min_hours)
    )


def expand_gridded(df: DataFrame, roster: DataFrame, date: str = "date") -> DataFrame:
    """Rows for stations new to the roster, taken from the station with the nearest served cell.

    Returns the additions only, for every partition that lacks the station.
    """
    wanted = missing_stations(df, roster, date).select(
        F.col("station_id").alias("new_id"), F.col("name").alias("new_name"),
        F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon"),
    )
    known = newest_partition(df, date).groupBy(F.col("station_id").alias("donor")).agg(
        F.min(F.struct("cell_lat", "cell_lon")).alias("c")
    ).select("donor", F.col("c.cell_lat").alias("r_lat"), F.col("c.cell_lon").alias("r_lon"))
    donors = nearest_planar(wanted, known, "new_id", "donor").select("new_id", "new_name", "donor")
    held = df.select(F.col(date), F.col("station_id").alias("new_id")).distinct()
    rows = df.join(donors, df.station_id == donors.donor).join(held, [date, "new_id"], "left_anti")
    keep = [F.col("new_id").alias("station_id") if c == "station_id" else
            F.col("new_name").alias("station_name") if c == "station_name" else F.col(c) for c in df.columns]
    return rows.select(*keep)


def product_family(chunks: DataFrame, today, recent: Sequence[str], archive: Sequence[str]) -> DataFrame:
    """Detection products of every chunk: the archive family once the chunk is old enough."""
    age = F.datediff(F.lit(_day(today)), F.col("chunk_start"))
    family = F.when(age > RECENT_PRODUCT_DAYS, F.array(*map(F.lit, archive))).otherwise(F.array(*map(F.lit, recent)))
    return chunks.withColumn("product", F.explode(family))


def chunk_of(day: Column, start, chunk_days: int = CHUNK_DAYS) -> Column:
    """The number of the chunk of days that a date lies in, from 0 at ``start``."""
    return F.floor(F.datediff(day, F.lit(_day(start))) / chunk_days).cast("int")


def chunk_gate(manifest: DataFrame, start, chunk_days: int = CHUNK_DAYS, max_rate: float = MAX_FAILURE_RATE) -> DataFrame:
    """Per chunk of days: may it be written?

    ``manifest`` has station_id, day, status (ok, absent, failed) and stored. An absent
    object is a real gap and no failure. A chunk with every date stored is skipped.
    """
    chunk = chunk_of(F.col("day"), start, chunk_days)
    per_day = manifest.groupBy(chunk.alias("chunk"), "day").agg(
        F.count("*").alias("expected"),
        F.sum((F.col("status") == "failed").cast("long")).alias("failed"),
        F.max("stored").alias("stored"),
    )
    out = per_day.groupBy("chunk").agg(
        F.min("day").alias("first"), F.max("day").alias("last"),
        F.sum("expected").alias("expected"), F.sum("failed").alias("failed"), F.min("stored").alias("complete"),
    )
    rate = F.col("failed") / F.col("expected")
    return out.withColumn("failure_rate", rate).withColumn(
        "action", F.when(F.col("complete"), "skip").when(rate > max_rate, "refuse").otherwise("write")
    )
