"""Served data products as DataFrames: replay, live forecast, surfaces, availability."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CAMS_COLS, MET_COLS, Settings
from ..functions.aqi import observed_stage
from ..functions.calendar import calendar_features
from ..functions.distribution import stage_probabilities
from ..operators.align import count_hours, hourly_index, in_range, join_airport, join_fires, join_observations, join_run
from ..operators.attribution import drivers
from ..operators.city import scope_to_city
from ..operators.evaluation import city_series, lead_day_bias, sufficiency
from ..operators.metrics import finite, rmse
from ..operators.models import Calibrated, Corrector, Model
from ..operators.supervised import build_supervised, forecast_columns, lead_match, shift_hours
from ..operators.transport import COLUMNS as CORRIDOR_COLUMNS
from ..operators.transport import corridor_series
from ..operators.windows import observation_features
from ..session import broadcast_bounded, staged
from .base import Sources, base_frame

REPLAY_SOURCES = ("cpcb", "cams_archive", "meteo_archive")
STALE_RUN_H, STALE_FORECAST_H = 36, 12
PROBS = tuple(f"p_at_least_{k}" for k in (1, 2, 3, 4))


# -- model lifecycle --------------------------------------------------------
class Registry:
    """Fitted models below a folder, listed in a registry table with the last day they saw."""

    def __init__(self, spark, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def entries(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/registry")
        except AnalysisException:
            return None

    def put(self, model: Calibrated, trained_through: dt.date) -> None:
        path = f"{self.root}/{model.inner.name}-{trained_through}"
        model.inner.save(self.spark, path)
        pads = [(h, v) for h, v in model.pad[0].items()] + [(0, model.pad[1])]
        self.spark.createDataFrame(pads, "horizon_h int, pad double").write.mode("overwrite").parquet(f"{path}/pads")
        row = self.spark.createDataFrame([(model.inner.name, trained_through, path)], "name string, trained_through date, path string")
        row.write.mode("append").parquet(f"{self.root}/registry")

    def get(self, name: str) -> tuple[Calibrated, dt.date] | None:
        table = self.entries()
        if table is None:
            return None
        row = table.where(F.col("name") == name).agg(F.max_by(F.struct("trained_through", "path"), "trained_through").alias("r")).first()[0]
        if row is None:
            return None
        model = Calibrated(Corrector.load(self.spark, row["path"]))
        pads = {r["horizon_h"]: r["pad"] for r in self.spark.read.parquet(f"{row['path']}/pads").collect()}
        model.pad = ({h: v for h, v in pads.items() if h}, pads[0])
        return model, row["trained_through"]

    def get_or_fit(self, sup: DataFrame, trained_through: dt.date, name: str = "full", refit: bool = False, **params) -> tuple[Calibrated, dt.date]:
        """The stored model, or one fitted on train rows and calibrated on val rows.

        With ``refit`` a stored model counts only if it has seen the data up to ``trained_through``.
        """
        found = self.get(name)
        if found is not None and not (refit and found[1] < trained_through):
            return found
        rows = staged(sup.dropna(subset=["y", "cams_pm2_5_tgt"]).where(F.col("split").isin("train", "val")), "registry")
        model = Calibrated(Corrector(name, **params))
        model.fit(rows.where("split = 'train'"))
        val = rows.where("split = 'val'")
        if not val.isEmpty():
            model.calibrate(val)
        self.put(model, trained_through)
        return model, trained_through


# -- replay -----------------------------------------------------------------
def replay_rows(src: Sources, day: dt.date, horizon: int, cfg: Settings, margin: tuple[int, int] = (6, 1)) -> DataFrame:
    """Supervised rows landing on ``day``, rebuilt from the days around it with lead-matched weather."""
    start, end = day - dt.timedelta(days=margin[0]), day + dt.timedelta(days=margin[1])
    sup = lead_match(build_supervised(base_frame(src, start, end, cfg), [horizon]), src.lead)
    return sup.where(F.to_date("target_time") == F.lit(day)).dropna(subset=["cams_pm2_5_tgt"])


def of_city(scored: DataFrame, roster: DataFrame | None, cfg: Settings, compat: bool = False) -> DataFrame:
    """The rows that a city answer averages: the stations of the city; ``compat=True`` (or no roster) averages every station."""
    return scored if compat or roster is None else scope_to_city(scored, roster, cfg)


def replay(
    model: Model, window: DataFrame, cfg: Settings, horizon: int, top: int = 5, roster: DataFrame | None = None,
    compat: bool = False, trained_through: dt.date | None = None,
) -> dict[str, DataFrame]:
    """City series, skill, stage probabilities, drivers and split of a replayed day; the city is scoped as in ``of_city``."""
    window = staged(window, "replay")
    scored = model.predict(window)
    series = city_series(of_city(scored, roster, cfg, compat))
    skill = scored.agg(
        F.count(F.when(finite("y", "q50"), 1)).alias("n"),
        F.round(rmse(F.when(finite("y", "q50"), F.col("q50") - F.col("y"))), 1).alias("rmse_model"),
        F.round(rmse(F.when(finite("y", "q50", "cams_pm2_5_tgt"), F.col("cams_pm2_5_tgt") - F.col("y"))), 1).alias("rmse_cams"),
        F.round(F.avg(F.when(finite("y", "q50"), F.col("y"))), 1).alias("observed_mean"),
        F.round(F.avg(F.col("met_lead_matched").cast("double")), 3).alias("lead_matched_share"),
    )
    return {
        "city_series": series, "skill": skill, "grap": day_stage(series, cfg),
        "split": split_of_day(window.select(F.to_date("target_time").alias("day")).distinct(), cfg, trained_through),
        "drivers": drivers(model, window, horizon, ["station_id", "issue_time"], top),
    }


def day_stage(series: DataFrame, cfg: Settings) -> DataFrame:
    """Stage probabilities of a day's mean distribution next to the stage observed."""
    day = series.agg(
        F.avg("lower").alias("q10"), F.avg("forecast").alias("q50"), F.avg("upper").alias("q90"), F.avg("observed").alias("observed")
    )
    out = stage_probabilities(day, cfg)
    return out.select(
        F.round("q50", 1).alias("forecast_24h_mean"), F.round("observed", 1).alias("observed_24h_mean"),
        observed_stage(F.col("observed"), cfg).alias("observed_stage"), *[F.round(p, 3).alias(p) for p in PROBS],
    )


# -- live -------------------------------------------------------------------
def live_base(src: Sources, cams_run: DataFrame, meteo_run: DataFrame, cfg: Settings, history_days: int = 5) -> DataFrame:
    """Hourly frame over the newest run with the observations up to it."""
    issue, last = cams_run.agg(F.max("issue_time"), F.max("time")).first()
    if issue is None or meteo_run.isEmpty():
        raise RuntimeError("no forecast runs stored")
    start, end = (issue - dt.timedelta(days=history_days)).date(), last.date()

    def within(df):
        return None if df is None else df.where(in_range("time", start, end))

    out = join_observations(hourly_index(src.stations, start, end), within(src.observations))
    out = observation_features(join_airport(out, within(src.metar), start, end))
    out = join_run(out, cams_run, CAMS_COLS, "cams_")
    out = join_run(out, meteo_run, MET_COLS, "met_")
    out = join_fires(out, within(src.fires), start, end)
    if src.corridor is not None and src.corridor_obs is not None:
        wind = meteo_run.select("station_id", "time", F.col("wind_direction_10m").alias("met_wind_direction_10m"),
                                F.col("wind_speed_10m").alias("met_wind_speed_10m"))
        series = corridor_series(wind, src.corridor, within(src.corridor_obs))
        out = out.join(broadcast_bounded(series, count_hours(start, end)), "time", "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in CORRIDOR_COLUMNS})
    return calendar_features(out, zone=cfg.local_zone)


def last_observed(base: DataFrame) -> dt.datetime:
    """Latest hour with an observation: the honest issue time."""
    issue = base.where(F.col("pm25_clean").isNotNull()).agg(F.max("time")).first()[0]
    if issue is None:
        raise RuntimeError("no recent observations")
    return issue


def live_supervised(base: DataFrame, horizons, issue: dt.datetime | None = None) -> DataFrame:
    """One row per (station, horizon) issued at the last observed hour; targets are unknown."""
    issue = issue or last_observed(base)
    when = F.lit(issue).cast("timestamp")
    cols = forecast_columns(base)
    hours = F.array(*[F.lit(int(h)) for h in horizons])
    targets = base.select("station_id", F.col("time").alias("target_time"), *[F.col(c).alias(f"{c}_tgt") for c in cols])
    rows = base.where(F.col("time") == when).withColumnRenamed("time", "issue_time").withColumn("horizon_h", F.explode(hours))
    return rows.withColumn("target_time", shift_hours("issue_time", "horizon_h")).join(targets, ["station_id", "target_time"])


def live_forecast(
    model: Model, sup: DataFrame, roster: DataFrame, cfg: Settings, now: dt.datetime, compat: bool = False, overlap: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Station rows, city interval with stage probabilities per horizon, staleness, and with ``overlap`` the gap of the served input."""
    scored = staged(model.predict(sup), "live")
    per = of_city(scored, roster, cfg, compat).groupBy("horizon_h", "target_time").agg(
        F.avg("q10").alias("q10"), F.avg("q50").alias("q50"), F.avg("q90").alias("q90"), F.max("issue_time").alias("issue_time")
    )
    age = F.round((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("issue_time")) / 3600.0, 1)
    city = stage_probabilities(per, cfg).select(
        "horizon_h", "target_time", "issue_time", F.round("q50", 1).alias("city_pm25"), F.round("q10", 1).alias("lower"),
        F.round("q90", 1).alias("upper"), *[F.round(p, 3).alias(p) for p in PROBS],
        age.alias("issued_age_hours"), (age > STALE_FORECAST_H).alias("stale"),
    )
    stations = scored.select(
        "horizon_h", "station_id", F.round("q50", 1).alias("pm25"), F.round("q10", 1).alias("lower"), F.round("q90", 1).alias("upper")
    ).join(roster.select("station_id", "name", "lat", "lon"), "station_id", "left")
    out = {"city": city, "stations": stations}
    if overlap is not None:
        out["input_gap"] = input_gap(overlap)
    forests = getattr(getattr(model, "inner", model), "forests", {})
    if 72 in forests:
        out["drivers"] = drivers(model, sup, 72, ["station_id", "issue_time"], 5)
    return out


# -- availability -----------------------------------------------------------
def replay_range(coverage: DataFrame) -> DataFrame:
    """The days all replay sources share, what limits them and what is missing."""
    rows = coverage.where(F.col("dataset").isin(*REPLAY_SOURCES))
    out = rows.agg(
        F.max("first").alias("first"), F.min("last").alias("last"), F.min_by("dataset", F.struct("last", "dataset")).alias("limited_by"),
        F.array_sort(F.collect_list(F.when(F.col("days") == 0, F.col("dataset")))).alias("missing"),
        F.max(F.when(F.col("dataset") == REPLAY_SOURCES[0], F.col("last"))).alias("observations_to"),
    )
    whole = F.size("missing") == 0
    days = F.greatest(F.datediff("last", "first") + 1, F.lit(0))
    return out.select(
        F.when(whole, F.col("first")).alias("first"), F.when(whole, F.col("last")).alias("last"),
        F.when(whole, days).otherwise(F.lit(0)).alias("count"), F.when(whole, F.col("limited_by")).alias("limited_by"),
        "missing", "observations_to",
    )


def why_not_replayable(coverage: DataFrame, day: dt.date, rows_before_drop: int, horizon: int) -> DataFrame:
    """One row per reason."""
    d = F.lit(day)
    short = coverage.where(F.col("dataset").isin(*REPLAY_SOURCES)).select(
        F.when(F.col("days") == 0, F.concat("dataset", F.lit(" is empty")))
        .when(F.col("last") < d, F.concat("dataset", F.lit(" only reaches "), F.col("last").cast("string"))).alias("reason")
    ).where("reason is not null")
    text = (
        f"no observations for {day}, nothing to score a {horizon} h forecast against" if rows_before_drop == 0
        else f"{day} has observations but no forecast at the target hours"
    )
    none_short = short.agg(F.count("*")).scalar() == 0
    return short.unionByName(coverage.sparkSession.range(1).where(none_short).select(F.lit(text).alias("reason")))


def split_of_day(days: DataFrame, cfg: Settings, trained_through: dt.date | None, day: str = "day") -> DataFrame:
    """unseen after the model's last training day, else test, val or train by block."""
    d = F.col(day)
    expr = F.when(d > F.lit(trained_through), "unseen") if trained_through else F.when(F.lit(False), "unseen")
    for kind in ("test", "val"):
        for b in cfg.blocks:
            if b.split == kind:
                expr = expr.when(d.between(F.lit(b.start).cast("date"), F.lit(b.end).cast("date")), kind)
    return days.withColumn("split", expr.otherwise("train"))


def input_gap(overlap: DataFrame, needed: int = 20) -> DataFrame:
    """The caveat that travels with a forecast: the lead day whose served input is furthest below the trained one."""
    worst = lead_day_bias(overlap).agg(F.min_by(F.struct("lead_day", "bias"), F.struct("bias", "lead_day")).alias("w"))
    ready = sufficiency(overlap, needed)
    return worst.where("w is not null").select(
        F.col("w.lead_day").alias("worst_lead_day"), F.round("w.bias", 1).alias("worst_bias_ugm3"),
        ready.select("run_days").scalar().alias("run_days"), ready.select("settled_days").scalar().alias("settled_days"),
        F.lit(needed).alias("needed"),
    )


# -- freshness --------------------------------------------------------------
def freshness(coverage: DataFrame, stale_h: float = STALE_RUN_H) -> DataFrame:
    """ok, stale or empty with a severity per run dataset."""
    state = F.when(F.col("days") == 0, "empty").when(F.col("age_hours") > stale_h, "stale").otherwise("ok")
    return coverage.withColumn("state", state).withColumn("severity", F.when(F.col("state") == "ok", 0).otherwise(2))


def run_due(coverage: DataFrame, today: dt.date) -> DataFrame:
    """Is today's run missing from any run store? A question about state, not about the clock."""
    late = F.col("last").isNull() | (F.col("last") < F.lit(today))
    return coverage.agg(F.coalesce(F.bool_or(late), F.lit(True)).alias("due"))
