"""Evaluation tables over prediction frames and score tables."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EPISODE_PM25, Settings
from ..functions.distribution import cdf
from ..session import broadcast_checked, staged
from ..sources.store import keep_one
from .metrics import finite, rmse
from .quantiles import exact_quantiles, wide_quantiles

MIN_RUN_DAYS = 20
SETTLE_DAYS = 4
DRAWS = 2000
MIN_CLUSTERS = 5
# Odd factors of the hash that fixes the draws.
DRAW_STEP, SEED_STEP, MIX = 2_654_435_761, 40_503, 73_244_475
LOW_VIS_KM = 1.0
# Probabilities at which a fog alarm is given.
FOG_THRESHOLDS = (0.05, 0.10, 0.20, 0.30, 0.50)

# Bands of the stratified tables.
WIND_BANDS = (
    (-0.01, 0.05, "wind not from corridor"),
    (0.05, 0.5, "partly aligned"),
    (0.5, 1.01, "corridor straight upwind"),
)
POLLUTION_BANDS = (
    (0, 60, "clean (<60)"), (60, 120, "moderate (60-120)"), (120, 250, "poor (120-250)"), (250, 1e9, "severe (>250)"),
)
# Paired claims (claim, reference, challenger, kind).
CLAIMS = (
    ("correction vs persistence", "persistence", "full+upwind", "addition"),
    ("correction vs raw CAMS", "raw-cams", "full+upwind", "addition"),
    ("upwind fires", "full (no fires)", "full", "addition"),
    ("upwind corridor", "full", "full+upwind", "addition"),
    ("coupling", "full", "coupled", "addition"),
    ("lead-matched meteorology", "full", "full (lead-matched)", "penalty"),
)
FAMILIES = (
    ("fires", "full (no fires)", "full"), ("corridor", "full", "full+upwind"), ("coupling", "full", "coupled"),
)


# -- regimes and strata -----------------------------------------------------
def regime(df: DataFrame, y: str = "y", split: str = "split") -> DataFrame:
    """mean, 95th percentile and episode share per split."""
    stats = df.where(finite(y)).groupBy(split).agg(
        F.count("*").alias("n"), F.avg(y).alias("mean"), F.avg((F.col(y) >= EPISODE_PM25).cast("double")).alias("episode_frac")
    )
    p95 = exact_quantiles(df, [split], y, [0.95]).select(split, F.col("q").alias("p95"))
    return stats.join(p95, split)


def episode_ratio(stats: DataFrame, train: str = "train", held: str = "test") -> DataFrame:
    def of(name):
        return F.max(F.when(F.col("split") == name, F.col("episode_frac")))

    out = stats.agg(of(train).alias("_t"), of(held).alias("_h"))
    return out.select(F.when(F.col("_t") > 0, F.col("_h") / F.col("_t")).otherwise(float("inf")).alias("episode_ratio"))


def _band(value: Column, bands, left_open: bool) -> Column:
    expr = None
    for lo, hi, label in bands:
        hit = (value > lo) & (value <= hi) if left_open else (value >= lo) & (value < hi)
        expr = F.when(hit, label) if expr is None else expr.when(hit, label)
    return expr


def wind_strata(df: DataFrame, local: str, corridor: str, min_rows: int = 200) -> DataFrame:
    """RMSE without and with the corridor by wind alignment, and the gain."""
    rows = df.where(finite("upwind_alignment")).withColumn("band", _band(F.col("upwind_alignment"), WIND_BANDS, True))

    def err(p: str) -> Column:
        return F.when(finite(p, "y"), F.col(p) - F.col("y"))

    out = rows.where("band is not null").groupBy("band").agg(
        F.count("*").alias("n"), rmse(err(local)).alias("delhi_only"), rmse(err(corridor)).alias("with_upwind")
    )
    gain = F.when(F.col("delhi_only") > 0, (F.col("delhi_only") - F.col("with_upwind")) / F.col("delhi_only"))
    return out.where(F.col("n") >= min_rows).withColumn("gain", gain)


def pollution_strata(df: DataFrame, models: dict[str, str], pm: str = "obs_lag_1h", min_rows: int = 30) -> DataFrame:
    """RMSE of each predicted column by pollution band with the band's median visibility."""
    rows = df.where(finite(pm)).withColumn("pm25_band", _band(F.col(pm), POLLUTION_BANDS, False)).where("pm25_band is not null")
    cols = [rmse(F.when(finite(c, "y"), F.col(c) - F.col("y"))).alias(name) for name, c in models.items()]
    median = wide_quantiles(rows, ["pm25_band"], "y", {"median_visibility_km": 0.5}).drop("n")
    out = rows.groupBy("pm25_band").agg(F.count("*").alias("n"), F.min(pm).alias("_lo"), *cols)
    return out.where(F.col("n") >= min_rows).join(median, "pm25_band", "left")


def mechanism(strata: DataFrame, weather: str = "weather-only", pollution: str = "pollution-informed") -> DataFrame:
    """Does the gain concentrate where the aerosol is?"""
    gain = (F.col(weather) - F.col(pollution)) / F.col(weather)
    rows = strata.where(finite(weather, pollution) & (F.col(weather) != 0)).withColumn("gain", gain)
    out = rows.agg(
        F.count("*").alias("bands"), F.min_by("gain", "_lo").alias("clean_gain"), F.max_by("gain", "_lo").alias("dirty_gain"),
        (F.max("gain") - F.min("gain")).alias("spread"),
    )
    hit = (F.col("dirty_gain") > F.col("clean_gain") * 2) & (F.col("spread") > 0.02)
    return out.where(F.col("bands") >= 2).withColumn("concentrates", hit)


# -- rolling origin ---------------------------------------------------------
def fold_summary(overall: DataFrame) -> DataFrame:
    """Mean, spread and extremes of RMSE over folds, per model."""
    return overall.groupBy("model").agg(
        F.avg("rmse").alias("mean_rmse"), F.stddev_samp("rmse").alias("sd_rmse"), F.min("rmse").alias("best_fold"),
        F.max("rmse").alias("worst_fold"), F.count("*").alias("folds"),
    )


def claims_frame(spark, claims=CLAIMS) -> DataFrame:
    return spark.createDataFrame(list(claims), "claim string, reference string, challenger string, kind string")


def paired_gains(overall: DataFrame, claims: DataFrame) -> DataFrame:
    """Per claim: fold-by-fold relative gains of the challenger and their summary."""
    rows = overall.select("fold", "model", "rmse")
    sides = claims.withColumn("model", F.explode(F.array_distinct(F.array("reference", "challenger"))))
    long = sides.join(rows, "model")
    per = long.groupBy("claim", "kind", "reference", "challenger", "fold").agg(
        F.max(F.when(F.col("model") == F.col("reference"), F.col("rmse"))).alias("_a"),
        F.max(F.when(F.col("model") == F.col("challenger"), F.col("rmse"))).alias("_b"),
    ).withColumn("gain", (F.col("_a") - F.col("_b")) / F.col("_a"))
    return per.where(finite("gain")).groupBy("claim", "kind", "reference", "challenger").agg(
        F.count("*").alias("folds"), F.avg("gain").alias("mean_gain"), F.stddev_samp("gain").alias("sd_gain"),
        F.sum((F.col("gain") > 0).cast("long")).alias("folds_better"),
        F.max_by("fold", "gain").alias("best_fold"), F.max("gain").alias("best_fold_gain"),
    )


def verdicts(paired: DataFrame) -> DataFrame:
    """What the paired gains allow to be said."""
    consistent = F.col("folds_better") == F.col("folds")
    beyond = F.col("sd_gain").isNull() | (F.abs("mean_gain") > F.col("sd_gain"))
    worse = F.col("folds") - F.col("folds_better")
    penalty = (
        F.when((worse == F.col("folds")) & beyond, "real cost")
        .when(worse > F.col("folds") / 2, "cost in the expected direction; within noise")
        .otherwise("no measurable cost")
    )
    addition = (
        F.when(consistent & beyond & (F.col("mean_gain") > 0), "holds up")
        .when((F.col("mean_gain") > 0) & consistent, "positive but within noise")
        .when(F.col("mean_gain") > 0, "inconsistent across folds")
        .otherwise("does not hold")
    )
    return paired.withColumn("verdict", F.when(F.col("kind") == "penalty", penalty).otherwise(addition))


def gate_verdicts(table: DataFrame, model: str = "full") -> DataFrame:
    """Per horizon: does the model beat both baselines?"""
    def of(name: str) -> Column:
        return F.max(F.when(F.col("model") == name, F.col("rmse")))

    out = table.where(F.col("horizon_h") > 0).groupBy("horizon_h").agg(
        of(model).alias("_m"), of("raw-cams").alias("_c"), of("persistence").alias("_p")
    )
    known = F.col("_m").isNotNull() & F.col("_c").isNotNull() & F.col("_p").isNotNull()
    ok = (F.col("_m") < F.col("_c")) & (F.col("_m") < F.col("_p"))
    return out.select(
        "horizon_h", ((F.col("_c") - F.col("_m")) / F.col("_c")).alias("gain_vs_raw_cams"),
        ((F.col("_p") - F.col("_m")) / F.col("_p")).alias("gain_vs_persistence"),
        F.when(~known, "insufficient data").when(ok, "PASS").otherwise("FAIL").alias("verdict"),
    )


def family_gains(table: DataFrame, families=FAMILIES) -> DataFrame:
    """Gain of each feature family per horizon (horizon 0 is overall), with episode recall."""
    spark = table.sparkSession
    fam = spark.createDataFrame(list(families), "family string, without string, with string")
    def of(side: str, column: str) -> Column:
        return F.max(F.when(F.col("model") == F.col(side), F.col(column)))

    long = fam.withColumn("model", F.explode(F.array_distinct(F.array("without", "with")))).join(table, "model")
    out = long.groupBy("family", "without", "with", "horizon_h").agg(
        of("without", "rmse").alias("rmse_without"), of("with", "rmse").alias("rmse_with"),
        of("without", "episode_recall").alias("recall_without"), of("with", "episode_recall").alias("recall_with"),
    )
    return out.withColumn("gain", (F.col("rmse_without") - F.col("rmse_with")) / F.col("rmse_without"))


def family_verdicts(gains: DataFrame) -> DataFrame:
    """Per family: horizons improved, mean gain and the resulting statement."""
    per = gains.where((F.col("horizon_h") > 0) & F.col("gain").isNotNull()).groupBy("family").agg(
        F.count("*").alias("horizons"), F.sum((F.col("gain") > 0).cast("long")).alias("better"), F.avg("gain").alias("mean_gain")
    )
    every = F.col("better") == F.col("horizons")
    said = (
        F.when((F.col("family") == "coupling"), F.when(every, "wins").otherwise("does not pay"))
        .when(every & (F.col("mean_gain") >= 0.01), "pays")
        .when(F.col("mean_gain") > 0, "small gain")
        .otherwise("no improvement")
    )
    return per.withColumn("verdict", said)


# -- stage decisions --------------------------------------------------------
def _stage_calls(df: DataFrame, cfg: Settings, keys: list[str]) -> DataFrame:
    items = [
        F.struct(
            F.lit(k).alias("stage"), F.lit(float(t)).alias("threshold"),
            (F.col("observed_stage") >= k).alias("actual"), (F.col(f"p_at_least_{k}") >= t).alias("called"),
        )
        for k, t in sorted(cfg.thresholds.items())
    ]
    return df.select(*keys, F.explode(F.array(*items)).alias("s")).select(*keys, "s.*")


def stage_table(df: DataFrame, cfg: Settings) -> DataFrame:
    """Recall, precision and false-alarm rate per (horizon, stage). There is no accuracy column."""
    def n(cond: Column) -> Column:
        return F.sum(F.coalesce(cond.cast("long"), F.lit(0)))

    hit, miss = F.col("actual") & F.col("called"), ~F.coalesce("actual", F.lit(False)) & F.col("called")
    out = _stage_calls(df, cfg, ["horizon_h"]).groupBy("horizon_h", "stage", "threshold").agg(
        n(F.col("actual")).alias("n_actual"), n(F.col("called")).alias("n_called"), n(hit).alias("_hits"),
        n(miss).alias("_false"), F.count("*").alias("_n"),
    )
    return out.select(
        "horizon_h", "stage", "threshold", "n_actual", "n_called",
        F.when(F.col("n_actual") > 0, F.col("_hits") / F.col("n_actual")).alias("recall"),
        F.when(F.col("n_called") > 0, F.col("_hits") / F.col("n_called")).alias("precision"),
        (F.col("_false") / F.greatest(F.col("_n") - F.col("n_actual"), F.lit(1))).alias("false_alarm_rate"),
    )


def lead_times(df: DataFrame, cfg: Settings, compat: bool = False, key: str | None = None) -> DataFrame:
    """Warning time per event, summarised per stage.

    The lead of an event is the longest horizon reached by calls unbroken from the
    shortest horizon outwards: a call withdrawn later is no warning. ``compat=True``
    takes the longest calling horizon whatever happened nearer to the event.
    """
    keys = [*([key] if key else []), "stage", "target_time"]
    calls = _stage_calls(df, cfg, [*([key] if key else []), "target_time", "horizon_h"]).where("actual")
    called = F.when(F.col("called"), F.col("horizon_h"))
    if compat:
        lead = F.coalesce(F.max(called), F.lit(0))
        events = calls.groupBy(*keys).agg(lead.alias("lead"))
    else:
        first_miss = F.min(F.when(~F.coalesce("called", F.lit(False)), F.col("horizon_h")))
        hits = F.array_sort(F.collect_set(called))
        events = calls.groupBy(*keys).agg(first_miss.alias("_m"), hits.alias("_h")).withColumn(
            "lead", F.coalesce(F.array_max(F.filter("_h", lambda h: F.col("_m").isNull() | (h < F.col("_m")))), F.lit(0))
        )
    # Leads take one of a few horizons, so the median's value table stays tiny.
    return events.groupBy("stage").agg(
        F.count("*").alias("n_events"), F.avg((F.col("lead") > 0).cast("double")).alias("caught_at_all"),
        F.percentile("lead", F.lit(0.5)).alias("median_lead_h"), F.avg("lead").alias("mean_lead_h"),
        F.avg((F.col("lead") >= 72).cast("double")).alias("caught_at_72h"),
    )


# -- served input against trained input -------------------------------------
def run_overlap(runs: DataFrame, archive: DataFrame, today: dt.date, value: str = "pm2_5") -> DataFrame:
    """Hours held both as an issued run and as an archive value, with lead day and settled flag."""
    arc = keep_one(archive.select("station_id", "time", F.col(value).alias("archive")), ["station_id", "time"], ["archive"], "last")
    both = runs.select("station_id", "time", "issue_time", "lead_h", F.col(value).alias("run")).join(arc, ["station_id", "time"])
    return both.where("run is not null and archive is not null").withColumns({
        "lead_day": F.floor(F.col("lead_h") / 24).cast("int"),
        "issue_date": F.to_date("issue_time"),
        "delta": F.col("run") - F.col("archive"),
        "settled": F.to_date("time") <= F.lit(today - dt.timedelta(days=SETTLE_DAYS)),
    })


def drawn(draw: Column, slot: Column, seed: int, n: Column) -> Column:
    """A number from 0 to n - 1 fixed by draw, slot and seed: a 32-bit mix in whole-number steps that any SQL has."""
    x = (draw * F.lit(DRAW_STEP) + slot + F.lit(seed) * F.lit(SEED_STEP)) % F.lit(2**32)
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(MIX)) % F.lit(2**32)
    return x.bitwiseXOR(F.shiftright(x, 16)) % n


def clustered_ci(
    df: DataFrame, by: list[str], value: str = "delta", cluster: str = "issue_date", draws: int = DRAWS, seed: int = 0
) -> DataFrame:
    """Bootstrap interval of a mean by resampling whole clusters; null below five clusters.

    Only the sum and count of each cluster travel. A draw takes as many clusters as there are, each slot's by a
    hash of (draw, slot, seed); how often a cluster is taken is its weight. All of it is columns: slots are made,
    counted and weighed in one pass, with no generator whose state depends on where a group runs. A cluster is a run day,
    so a group's are bounded by the calendar.
    """
    sums = df.where(finite(value)).groupBy(*by, F.col(cluster).alias("_k")).agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    return interval_of(staged(sums, "clusters"), by, draws, seed)


def interval_of(sums: DataFrame, by: list[str], draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """The interval of ``clustered_ci`` from the sum _s and count _n of each cluster _k; ``sums`` is read several times, so give a stored table."""
    keyed = sums if by else sums.withColumn("_g", F.lit(0))
    keys = by or ["_g"]
    own = Window.partitionBy(*keys)
    ranked = keyed.withColumns({"_i": (F.row_number().over(own.orderBy("_k")) - 1).cast("long"), "_of": F.count(F.lit(1)).over(own)})
    groups = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_of"))
    slots = groups.where(F.col("_of") >= MIN_CLUSTERS).withColumn("_draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    slots = slots.repartition(*keys, "_draw").withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_of") - 1)))
    slots = slots.withColumn("_i", drawn(F.col("_draw"), F.col("_slot"), seed, F.col("_of")))
    side = ranked.select(*(F.col(k).alias(f"{k} of") for k in keys), F.col("_i").alias("_at"), "_s", "_n")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{k} of")) for k in keys)) & (F.col("_i") == F.col("_at"))
    means = slots.join(broadcast_checked(side), same).groupBy(*keys, "_draw").agg((F.sum("_s") / F.sum("_n")).alias("_m"))
    both = F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975)))
    bounds = means.groupBy(*(F.col(k).alias(f"{k} of") for k in keys)).agg(both.alias("_b"))
    of = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{k} of")) for k in keys))
    return groups.join(bounds, of, "left").select(*by, F.get("_b", F.lit(0)).alias("bias_lo"), F.get("_b", F.lit(1)).alias("bias_hi"))


def run_day_sums(overlap: DataFrame) -> DataFrame:
    """Counts and sums per lead day, run day and settled flag: all that the tables below need, bounded by the calendar."""
    d = F.when(finite("delta"), F.col("delta"))
    return overlap.groupBy("lead_day", "issue_date", "settled").agg(
        F.count("*").alias("rows"), F.sum("archive").alias("archive"), F.count("archive").alias("archive_n"), F.sum("run").alias("run"), F.count("run").alias("run_n"),
        F.sum(d).alias("_s"), F.sum(d * d).alias("_s2"), F.count(d).alias("_n"),
    )


def _bias_of(days: DataFrame) -> DataFrame:
    mean = lambda total, n: F.sum(total) / F.nullif(F.sum(n), F.lit(0))
    return days.groupBy("lead_day").agg(
        F.sum("rows").alias("rows"), F.countDistinct("issue_date").alias("run_days"),
        F.countDistinct(F.when(F.col("settled"), F.col("issue_date"))).alias("settled_days"),
        mean("archive", "archive_n").alias("archive_mean"), mean("run", "run_n").alias("run_mean"), mean("_s", "_n").alias("bias"), F.sqrt(mean("_s2", "_n")).alias("rmse"),
    )


def lead_day_bias(overlap: DataFrame) -> DataFrame:
    """Bias and RMSE of the served input per lead day, with run days behind them."""
    return _bias_of(run_day_sums(overlap))


def lead_day_gap(overlap: DataFrame, draws: int = DRAWS) -> DataFrame:
    """``lead_day_bias`` with the interval of the bias; the overlap is read once."""
    days = staged(run_day_sums(overlap), "run_days")
    sums = days.where("_n > 0").groupBy("lead_day", F.col("issue_date").alias("_k")).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    return _bias_of(days).join(interval_of(sums, ["lead_day"], draws), "lead_day", "left")


def sufficiency(overlap: DataFrame, needed: int = MIN_RUN_DAYS) -> DataFrame:
    out = overlap.agg(
        F.countDistinct("issue_date").alias("run_days"),
        F.countDistinct(F.when(F.col("settled"), F.col("issue_date"))).alias("settled_days"),
        F.min("issue_date").alias("first_run"), F.max("issue_date").alias("last_run"),
    )
    return out.withColumn("needed", F.lit(needed)).withColumn("ready", F.col("settled_days") >= needed)


def fit_offset(overlap: DataFrame, needed: int = MIN_RUN_DAYS) -> DataFrame:
    """Additive offset per lead day (minus the settled bias); null until enough settled run days exist."""
    table = lead_day_bias(overlap.where("settled")).select("lead_day", (-F.col("bias")).alias("_o"))
    settled = sufficiency(overlap, needed).select("settled_days").scalar()
    return table.withColumns({"settled_days": settled, "needed": F.lit(needed)}).withColumn(
        "ready", F.col("settled_days") >= needed
    ).select("lead_day", F.when(F.col("ready"), F.col("_o")).alias("offset"), "settled_days", "needed", "ready")


def input_degradation(archive: DataFrame, lead: DataFrame, variables: list[str]) -> DataFrame:
    """RMSE of each variable between the real-lead and the short-lead forecast, per lead day."""
    have = [v for v in variables if v in archive.columns and v in lead.columns]
    arc = keep_one(archive.select("station_id", "time", *[F.col(v).alias(f"_a_{v}") for v in have]), ["station_id", "time"], [], "last")
    both = lead.select("station_id", "time", "lead_day", *have).join(arc, ["station_id", "time"])
    return both.groupBy("lead_day").agg(
        F.count("*").alias("n"), *[rmse(F.col(v) - F.col(f"_a_{v}")).alias(v) for v in have]
    )


def comparable(table: DataFrame, probes: tuple[str, ...] = ("persistence", "raw-cams"), tolerance: float = 0.05) -> DataFrame:
    """Validity check: baselines without weather must not move between the two meteorologies."""
    rows = table.where(F.col("model").isin(list(probes)) & (F.col("horizon_h") == 0))
    out = rows.groupBy("model").agg((F.max("rmse") - F.min("rmse")).alias("moved"))
    return out.withColumn("valid", F.col("moved") <= tolerance)


# -- visibility -------------------------------------------------------------
def visibility_scores(df: DataFrame, models: dict[str, str]) -> DataFrame:
    """n, RMSE, MAE, bias in km and low-visibility recall per predicted column and horizon, plus overall."""
    items = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("p")) for m, c in models.items()])
    long = df.select("horizon_h", "y", F.explode(items).alias("m")).select("horizon_h", "y", "m.*")
    ok = finite("p", "y")
    err = F.when(ok, F.col("p") - F.col("y"))
    low = ok & (F.col("y") < LOW_VIS_KM)
    m, h = F.col("model"), F.col("horizon_h")
    out = long.groupingSets([[m, h], [m]], m, h).agg(
        F.grouping("horizon_h").alias("_all"), F.count(err).alias("n"), rmse(err).alias("rmse_km"),
        F.avg(F.abs(err)).alias("mae_km"), F.avg(err).alias("bias_km"), F.count(F.when(low, 1)).alias("low_vis_n"),
        F.avg(F.when(low, (F.col("p") < LOW_VIS_KM).cast("double"))).alias("low_vis_recall"),
    )
    return out.withColumn("horizon_h", F.when(F.col("_all") == 1, 0).otherwise(F.col("horizon_h"))).drop("_all")


def fog_alarms(df: DataFrame, thresholds=FOG_THRESHOLDS) -> DataFrame:
    """Alarm quality over a sweep of probability thresholds; one prediction row per (model, case)."""
    actual = finite("y") & (F.col("y") < LOW_VIS_KM)
    p = cdf(LOW_VIS_KM, F.col("q10"), F.col("q50"), F.col("q90"))
    rows = df.select("model", actual.alias("a"), p.alias("p")).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    called = F.coalesce(F.col("p") >= F.col("threshold"), F.lit(False))

    def n(c: Column) -> Column:
        return F.sum(c.cast("long"))

    out = rows.groupBy("model", "threshold").agg(
        n(F.col("a") & called).alias("_hit"), n(called).alias("_called"), n(F.col("a")).alias("_actual"),
        n(~F.col("a") & called).alias("_false"), n(~F.col("a")).alias("_quiet"),
    )
    one = F.lit(1)
    return out.select(
        "model", "threshold", (F.col("_hit") / F.greatest("_actual", one)).alias("recall"),
        (F.col("_hit") / F.greatest("_called", one)).alias("precision"),
        (F.col("_false") / F.greatest("_quiet", one)).alias("false_alarm_rate"),
    )


# -- served series ----------------------------------------------------------
def city_series(df: DataFrame) -> DataFrame:
    """City means of forecast, bounds, observation and raw forecast per target hour."""
    return df.groupBy("target_time").agg(
        F.avg("q50").alias("forecast"), F.avg("q10").alias("lower"), F.avg("q90").alias("upper"),
        F.avg("y").alias("observed"), F.avg("cams_pm2_5_tgt").alias("cams"), F.count("*").alias("n_stations"),
    )


def worst_held_out_day(obs: DataFrame, cfg: Settings, first, last, min_stations: int = 40) -> DataFrame:
    """The dirtiest day inside a test block and the served range with enough stations."""
    day = F.to_date("time")
    daily = obs.where(F.col("pm25_clean").isNotNull() & day.between(F.lit(first), F.lit(last))).groupBy(day.alias("day")).agg(
        F.avg("pm25_clean").alias("mean_pm25"), F.countDistinct("station_id").alias("stations")
    )
    held = F.lit(False)
    for b in cfg.blocks:
        if b.split == "test":
            held = held | F.col("day").between(F.lit(b.start).cast("date"), F.lit(b.end).cast("date"))
    inside = daily.where((F.col("stations") >= min_stations) & held)
    best = inside.agg(F.max_by(F.struct("day", "mean_pm25", "stations"), F.struct("mean_pm25", -F.unix_date("day"))).alias("b"))
    return best.where("b is not null").select("b.*")


