"""Raw readings to flagged station hours, and data-quality summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Plausibility limits (ug/m3) and the length of a stuck run (hours).
MIN_PLAUSIBLE = 1.0
MAX_PLAUSIBLE = 1200.0
STUCK_HOURS = 6


def stamp_time(stamp: str) -> Column:
    """A text stamp with an offset (+05:30, +0530 or Z) as a timestamp; null without one, or where it can't be read."""
    text = F.col(stamp)
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f"yyyy-MM-dd'T'HH:mm:ss{offset}")) for offset in ("XXX", "XX")))


def unread_stamps(raw: DataFrame, stamp: str = "datetime") -> DataFrame:
    """How many readings have a stamp that can't be read, per station; stations without such rows have none."""
    lost = raw.where(F.col(stamp).isNotNull() & stamp_time(stamp).isNull())
    return lost.groupBy("station_id").agg(F.count(F.lit(1)).alias("unread"))


def to_hourly(raw: DataFrame, stamp: str = "datetime") -> DataFrame:
    """Readings with text stamps (offset or Z) to UTC station hours; hours without a reading get no row.

    The offset is applied before truncation. Mean, min, max and count are combined map-side,
    so a station holding most of the readings costs no skewed task.
    """
    obs = raw.select("station_id", F.date_trunc("hour", stamp_time(stamp)).alias("time"), F.col("value").cast("double").alias("value"))
    return hourly_stats(obs)


def hourly_stats(obs: DataFrame) -> DataFrame:
    """station_id, time (already an hour), value to the hourly statistics."""
    good = F.col("time").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value")
    return (
        obs.where(good)
        .groupBy("station_id", "time")
        .agg(
            F.avg("value").alias("pm25"), F.min("value").alias("pm25_min"), F.max("value").alias("pm25_max"),
            F.count("*").alias("n_obs"),
        )
    )


#: Days of a record that one task holds at once.
STRETCH_DAYS = 120


def run_lengths(hourly: DataFrame, value: Column, step_s: int | None = 3600, at_repeat: bool = False, stretch_days: int = STRETCH_DAYS) -> DataFrame:
    """Adds to each row of a station's series ``run_repeat``, ``run_first`` (time of its run's first row) and ``run_hours`` (rows of the run).

    A row repeats if it has the value of the row before, ``step_s`` seconds earlier (any time earlier if None). A run
    starts at each row that does not repeat, or with ``at_repeat`` at each that does.

    Series are cut into stretches, and only a stretch is sorted in one task. Each reports its first and last run
    and whether they are one; these few rows are merged along the station, so a run may cross any number
    of stretches, and go back to the rows of outermost runs. Inner runs never leave their stretch.
    """
    names = {"run_repeat", "run_first", "run_hours"}
    # one key: rows are shuffled by it once, and the few rows of ends come to where they lie
    at = F.struct("station_id", F.floor(F.unix_timestamp("time") / (stretch_days * 86400)).alias("part"))
    rows = hourly.drop(*names).withColumns({"_x": value, "_at": at})

    def repeats(x: Column, time: Column, before_x: Column, before: Column) -> Column:
        same = x == before_x
        if step_s is not None:
            same = same & (F.unix_timestamp(time) - F.unix_timestamp(before) == step_s)
        return F.coalesce(same, F.lit(False))

    starts = (lambda repeat: repeat) if at_repeat else (lambda repeat: ~repeat)
    own = Window.partitionBy("_at").orderBy("time")
    rows = rows.withColumn("run_repeat", repeats(F.col("_x"), F.col("time"), F.lag("_x").over(own), F.lag("time").over(own)))
    rows = rows.withColumn("_run", F.sum(starts(F.col("run_repeat")).cast("long")).over(own))
    run = Window.partitionBy("_at", "_run")
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(run), "_first": F.min("time").over(run)})

    end = F.struct("_x", "time", "_run", "_n", "_first")
    ends = rows.groupBy(F.col("_at").alias("_of")).agg(F.min_by(end, "time").alias("_a"), F.max_by(end, "time").alias("_z"))
    ends = ends.withColumn("_station", F.col("_of.station_id"))
    along = Window.partitionBy("_station").orderBy("_of.part")
    before = F.lag("_z").over(along)
    ends = ends.withColumn("_again", repeats(F.col("_a._x"), F.col("_a.time"), before["_x"], before["time"]))
    ends = ends.withColumn("_joins", before.isNotNull() & ~starts(F.col("_again"))).withColumn("_whole", F.col("_a._run") == F.col("_z._run"))
    # a chain: the last run of a stretch with the whole stretches that continue it
    ends = ends.withColumn("_chain", F.sum((~(F.col("_whole") & F.col("_joins"))).cast("long")).over(along))
    tail = F.coalesce(F.lead(F.when(F.col("_joins") & ~F.col("_whole"), F.col("_a._n"))).over(along), F.lit(0))
    ends = ends.withColumn("_tail", tail)
    chain = Window.partitionBy("_station", "_chain")
    ends = ends.withColumns({"_hours": (F.sum("_z._n").over(chain) + F.sum("_tail").over(chain)), "_since": F.min("_z._first").over(chain)})
    total = lambda chained, alone: F.when(F.col("_joins"), F.lag(chained).over(along)).when(F.col("_whole"), F.col(chained)).otherwise(F.col(alone))
    ends = ends.select(
        "_of", "_again", "_hours", "_since", F.col("_a.time").alias("_start"), F.col("_a._run").alias("_head"), F.col("_z._run").alias("_last"),
        total("_hours", "_a._n").alias("_head_hours"), total("_since", "_a._first").alias("_head_since"),
    )
    # hinted, since sizes guessed from compressed files would send all rows through the driver
    out = rows.join(ends.hint("shuffle_hash"), F.col("_at") == F.col("_of"))
    pick = lambda head, last, inner: F.when(F.col("_run") == F.col("_head"), F.col(head)).when(F.col("_run") == F.col("_last"), F.col(last)).otherwise(F.col(inner))
    return out.select(
        *hourly.drop(*names).columns, F.when(F.col("time") == F.col("_start"), F.col("_again")).otherwise(F.col("run_repeat")).alias("run_repeat"),
        pick("_head_since", "_since", "_first").alias("run_first"), pick("_head_hours", "_hours", "_n").alias("run_hours"),
    )


def runs(hourly: DataFrame, value: Column, step_s: int | None = None, stretch_days: int = STRETCH_DAYS) -> DataFrame:
    """station_id, first, hours and value of each run of equal values; a missing value ends a run and is one of its own."""
    marked = run_lengths(hourly.withColumn("_value", value), F.col("_value"), step_s, stretch_days=stretch_days)
    return marked.where(F.col("time") == F.col("run_first")).select("station_id", F.col("time").alias("first"), F.col("run_hours").alias("hours"), F.col("_value").alias("value"))


#: Days of a record that one task holds at once.
STRETCH_DAYS = 120


def run_lengths(hourly: DataFrame, value: Column, step_s: int | None = 3600, at_repeat: bool = False, stretch_days: int = STRETCH_DAYS) -> DataFrame:
    """Adds to each row of a station's series ``run_repeat``, ``run_first`` (time of its run's first row) and ``run_hours`` (rows of the run).

    A row repeats if it has the value of the row before, ``step_s`` seconds earlier (any time earlier if None). A run
    starts at each row that does not repeat, or with ``at_repeat`` at each that does.

    Series are cut into stretches, and only a stretch is sorted in one task. Each reports its first and last run
    and whether they are one; these few rows are merged along the station, so a run may cross any number
    of stretches, and go back to the rows of outermost runs. Inner runs never leave their stretch.
    """
    names = {"run_repeat", "run_first", "run_hours"}
    # one key: rows are shuffled by it once, and the few rows of ends come to where they lie
    at = F.struct("station_id", F.floor(F.unix_timestamp("time") / (stretch_days * 86400)).alias("part"))
    rows = hourly.drop(*names).withColumns({"_x": value, "_at": at})

    def repeats(x: Column, time: Column, before_x: Column, before: Column) -> Column:
        same = x == before_x
        if step_s is not None:
            same = same & (F.unix_timestamp(time) - F.unix_timestamp(before) == step_s)
        return F.coalesce(same, F.lit(False))

    starts = (lambda repeat: repeat) if at_repeat else (lambda repeat: ~repeat)
    own = Window.partitionBy("_at").orderBy("time")
    rows = rows.withColumn("run_repeat", repeats(F.col("_x"), F.col("time"), F.lag("_x").over(own), F.lag("time").over(own)))
    rows = rows.withColumn("_run", F.sum(starts(F.col("run_repeat")).cast("long")).over(own))
    run = Window.partitionBy("_at", "_run")
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(run), "_first": F.min("time").over(run)})

    end = F.struct("_x", "time", "_run", "_n", "_first")
    ends = rows.groupBy(F.col("_at").alias("_of")).agg(F.min_by(end, "time").alias("_a"), F.max_by(end, "time").alias("_z"))
    ends = ends.withColumn("_station", F.col("_of.station_id"))
    along = Window.partitionBy("_station").orderBy("_of.part")
    before = F.lag("_z").over(along)
    ends = ends.withColumn("_again", repeats(F.col("_a._x"), F.col("_a.time"), before["_x"], before["time"]))
    ends = ends.withColumn("_joins", before.isNotNull() & ~starts(F.col("_again"))).withColumn("_whole", F.col("_a._run") == F.col("_z._run"))
    # a chain: the last run of a stretch with the whole stretches that continue it
    ends = ends.withColumn("_chain", F.sum((~(F.col("_whole") & F.col("_joins"))).cast("long")).over(along))
    tail = F.coalesce(F.lead(F.when(F.col("_joins") & ~F.col("_whole"), F.col("_a._n"))).over(along), F.lit(0))
    ends = ends.withColumn("_tail", tail)
    chain = Window.partitionBy("_station", "_chain")
    ends = ends.withColumns({"_hours": (F.sum("_z._n").over(chain) + F.sum("_tail").over(chain)), "_since": F.min("_z._first").over(chain)})
    total = lambda chained, alone: F.when(F.col("_joins"), F.lag(chained).over(along)).when(F.col("_whole"), F.col(chained)).otherwise(F.col(alone))
    ends = ends.select(
        "_of", "_again", "_hours", "_since", F.col("_a.time").alias("_start"), F.col("_a._run").alias("_head"), F.col("_z._run").alias("_last"),
        total("_hours", "_a._n").alias("_head_hours"), total("_since", "_a._first").alias("_head_since"),
    )
    # hinted, since sizes guessed from compressed files would send all rows through the driver
    out = rows.join(ends.hint("shuffle_hash"), F.col("_at") == F.col("_of"))
    pick = lambda head, last, inner: F.when(F.col("_run") == F.col("_head"), F.col(head)).when(F.col("_run") == F.col("_last"), F.col(last)).otherwise(F.col(inner))
    return out.select(
        *hourly.drop(*names).columns, F.when(F.col("time") == F.col("_start"), F.col("_again")).otherwise(F.col("run_repeat")).alias("run_repeat"),
        pick("_head_since", "_since", "_first").alias("run_first"), pick("_head_hours", "_hours", "_n").alias("run_hours"),
    )


def runs(hourly: DataFrame, value: Column, step_s: int | None = None, stretch_days: int = STRETCH_DAYS) -> DataFrame:
    """station_id, first, hours and value of each run of equal values; a missing value ends a run and is one of its own."""
    marked = run_lengths(hourly.withColumn("_value", value), F.col("_value"), step_s, stretch_days=stretch_days)
    return marked.where(F.col("time") == F.col("run_first")).select("station_id", F.col("time").alias("first"), F.col("run_hours").alias("hours"), F.col("_value").alias("value"))


def flag_quality(hourly: DataFrame, compat: bool = False, stretch_days: int = STRETCH_DAYS) -> DataFrame:
    """Add quality_flag and pm25_clean (null unless ok); the raw value stays.

    Runs of equal values are found stretch by stretch. ``compat=True`` groups each repeat with
    the non-repeats that follow it and looks at rows instead of hours.
    """
    shown = F.round("pm25", 2)
    marked = run_lengths(hourly, shown, None if compat else 3600, at_repeat=compat, stretch_days=stretch_days)
    flag = (
        F.when(F.col("pm25") < MIN_PLAUSIBLE, "suspect_low")
        .when(F.col("pm25") > MAX_PLAUSIBLE, "suspect_high")
        .when(F.col("run_repeat") & (F.col("run_hours") >= STUCK_HOURS), "stuck")
        .otherwise("ok")
    )
    return (
        marked.withColumn("quality_flag", flag)
        .withColumn("pm25_clean", F.when(F.col("quality_flag") == "ok", F.col("pm25")))
        .drop("run_repeat", "run_first", "run_hours")
    )


def step_changes(df: DataFrame, window_days: int = 30, ratio: float = 2.0) -> DataFrame:
    """Stations whose median jumps between consecutive blocks present.

    A group holds one station's hours of one block (at most 24 x window_days values).
    """
    block = F.window("time", f"{window_days} days")["start"]
    medians = (
        df.where(F.col("quality_flag") == "ok")
        .groupBy("station_id", block.alias("block"))
        .agg(F.percentile("pm25", F.lit(0.5)).alias("median"), F.count("*").alias("n"))
    )
    previous = F.lag("median").over(Window.partitionBy("station_id").orderBy("block"))
    return medians.withColumn("step_ratio", F.col("median") / previous).where(
        (F.col("step_ratio") > ratio) | (F.col("step_ratio") < 1 / ratio)
    )


def flag_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy("quality_flag").agg(F.count("*").alias("hours")).orderBy(F.desc("hours"), "quality_flag")


def column_coverage(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Non-null share of every column, in one pass."""
    columns = columns or df.columns
    wide = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("non_null")) for c in columns])
    return wide.select("_n", F.explode(pairs).alias("p")).select(
        "p.column", "p.non_null", F.when(F.col("_n") > 0, F.col("p.non_null") / F.col("_n")).alias("share")
    )


def stable_basket(df: DataFrame, min_coverage: float, value: str = "pm25_clean") -> DataFrame:
    """Stations reporting in at least ``min_coverage`` of all hours; everything if none does."""
    if min_coverage <= 0:
        return df
    hours = df.select("time").distinct().agg(F.count("*")).scalar()
    counts = df.where(F.col(value).isNotNull()).groupBy("station_id").agg(F.count("*").alias("_held"))
    kept = counts.where(F.col("_held") >= min_coverage * hours).select("station_id")
    if kept.isEmpty():
        return df
    return df.join(kept, "station_id", "left_semi")


def reconstruction_checks(base: DataFrame, n_stations: int, days: int, required: list[str]) -> DataFrame:
    """Gate over a rebuilt stretch: complete index, no duplicate keys, every required column alive."""
    present = [c for c in required if c in base.columns]
    keys = base.groupBy("station_id", "time").agg(F.count("*").alias("c"), *[F.count(c).alias(c) for c in present])
    total = keys.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("rows"), F.count("*").alias("keys"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in present],
    )
    expected = n_stations * 24 * days
    checks = [
        ("rows", F.col("rows"), F.lit(expected).cast("long"), F.col("rows") == expected),
        ("duplicate_keys", F.col("rows") - F.col("keys"), F.lit(0).cast("long"), F.col("rows") == F.col("keys")),
    ]
    for c in required:
        seen = F.col(c) if c in present else F.lit(None).cast("long")
        checks.append((f"column:{c}", seen, F.lit(1).cast("long"), F.coalesce(seen > 0, F.lit(False))))
    rows = F.array(*[
        F.struct(F.lit(n).alias("check"), o.cast("long").alias("observed"), e.alias("expected"), k.alias("ok"))
        for n, o, e, k in checks
    ])
    return total.select(F.explode(rows).alias("r")).select("r.*")
