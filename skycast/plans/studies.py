"""End-to-end evaluations: fit, predict and score on shared rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Fold, Settings
from ..functions.aqi import observed_stage
from ..functions.distribution import stage_probabilities
from ..functions.geo import nearest
from ..operators.city import city_base
from ..operators.evaluation import (
    fog_alarms, lead_times, pollution_strata, stage_table, visibility_scores, wind_strata,
)
from ..operators.metrics import finite, horizon_table, rmse
from ..operators.models import (
    Calibrated, Corrector, Model, Persistence, RawForecast, default_models,
)
from ..operators.neighbours import SUMS, Neighbourhoods, places_of
from ..operators.supervised import assign_split, build_supervised, fold_test, fold_train, lead_match
from ..session import scratch, staged
from .base import scorable

MIN_FOLD_TRAIN, MIN_FOLD_TEST = 5000, 500
MIN_LOSO_TRAIN = 1000
MIN_VIS_TRAIN = 500
STABLE_SHARE = 0.5
# Column families that carry pollution.
POLLUTION_PREFIXES = ("cams_", "obs_", "nbr_", "fire_", "pm25")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def fit_models(models: Sequence[Model], train: DataFrame, val: DataFrame | None = None) -> list[Model]:
    done: list[Model] = []
    for m in models:
        # A calibrated wrapper around a model of the list shares its fit.
        if not (isinstance(m, Calibrated) and any(m.inner is d for d in done)):
            m.fit(train)
        done.append(m)
        if isinstance(m, Calibrated) and val is not None and not val.isEmpty():
            m.calibrate(val)
    return list(models)


def predictions(models: Sequence[Model], held: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Long predictions, one row per (model, row), with the first model's median as base_q50."""
    based = models[0].predict(held).withColumnRenamed("q50", "base_q50").drop("q10", "q90")
    cols = ["station_id", "issue_time", "target_time", "horizon_h", "y", "base_q50", *keep]
    parts = [m.predict(based).select(*cols, "q10", "q50", "q90", F.lit(m.name).alias("model")) for m in models]
    return union_all(parts)


def ablation(sup: DataFrame, models: Sequence[Model] | None = None, evaluate_on: str = "test") -> tuple[DataFrame, list[Model]]:
    """All models on identical rows: score table (model, horizon; 0 is overall) and the fitted models."""
    rows = staged(scorable(sup).where(F.col("split").isin("train", "val", evaluate_on)), "ablation")
    train, val, held = (rows.where(F.col("split") == s) for s in ("train", "val", evaluate_on))
    fitted = fit_models(models or default_models(), train, val)
    table = horizon_table(predictions(fitted, held), ["model"], baseline="base_q50")
    return table, fitted


def corridor_strata(held: DataFrame, local: Model, corridor: Model, min_rows: int = 200) -> DataFrame:
    both = local.predict(held).withColumnRenamed("q50", "_local").drop("q10", "q90")
    both = corridor.predict(both).withColumnRenamed("q50", "_corridor")
    return wind_strata(both, "_local", "_corridor", min_rows)


# -- rolling origin ---------------------------------------------------------
def fold_models(**params) -> list[Model]:
    from ..operators.models import Coupled

    return [
        Persistence(), RawForecast(),
        Corrector("full (no fires)", drop_prefixes=("upwind_", "fire_"), **params),
        Corrector("full", drop_prefixes=("upwind_",), **params),
        Corrector("full+upwind", **params), Coupled("coupled", **params),
    ]


def run_fold(
    sup: DataFrame, fold: Fold, models: Sequence[Model], cfg: Settings, suffix: str = "",
    min_train: int = MIN_FOLD_TRAIN, min_test: int = MIN_FOLD_TEST,
) -> DataFrame | None:
    train = fold_train(sup, fold.train_end, cfg.embargo_h)
    test = fold_test(sup, fold.test_start, fold.test_end)
    if train.count() < min_train or test.count() < min_test:
        return None
    pred = predictions(fit_models(models, train), test)
    table = horizon_table(pred, ["model"], baseline="base_q50")
    mean = test.agg(F.avg("y")).scalar()
    return table.withColumn("observed_mean", mean).select(
        F.lit(fold.label).alias("fold"), F.concat("model", F.lit(suffix)).alias("model"), "horizon_h", "n", "rmse", "mae", "bias",
        "episode_recall", "observed_mean",
    )


def rolling_origin(
    sup: DataFrame, cfg: Settings, results: str, models: Callable[[], Sequence[Model]] = fold_models, lead: DataFrame | None = None,
    lead_models: Callable[[], Sequence[Model]] | None = None, resume: bool = True,
    min_train: int = MIN_FOLD_TRAIN, min_test: int = MIN_FOLD_TEST, at_once: int = 3,
) -> DataFrame:
    """Score every fold and write its rows to ``results`` partitioned by fold; finished folds are skipped.

    With ``lead``, a second pass reruns the plain model on the rows the lead matching reached. ``at_once`` folds are
    fitted and scored side by side; each is written as it ends. Without a fold of enough rows the result has no row.
    """
    spark = sup.sparkSession
    rows = staged(scorable(sup), "rolling")
    done = _finished(spark, results) if resume else set()
    passes = [(rows, models, "", "")]
    if lead is not None:
        matched = staged(lead_match(rows, lead).where("met_lead_matched"), "rolling-lead")
        chosen = lead_models or (lambda: [Corrector("full", drop_prefixes=("upwind_",))])
        passes.append((matched, chosen, " (lead-matched)", "-leadmatched"))

    def scored(frame: DataFrame, fold: Fold, make: Callable[[], Sequence[Model]], suffix: str, key: str) -> tuple[str, DataFrame | None]:
        out = run_fold(frame, fold, make(), cfg, suffix, min_train, min_test)
        return key, None if out is None else staged(out, "fold")

    open_ = [(frame, f, make, suffix, f.label + mark) for frame, make, suffix, mark in passes for f in cfg.folds if f.label + mark not in done]
    with ThreadPoolExecutor(at_once) as pool:
        for running in as_completed([pool.submit(scored, *each) for each in open_]):
            key, out = running.result()
            if out is not None:
                out.withColumn("part", F.lit(key)).write.mode("overwrite").option(
                    "partitionOverwriteMode", "dynamic").partitionBy("part").parquet(results)
    try:
        return spark.read.parquet(results).drop("part")
    except AnalysisException as missing:
        if not _absent(missing):
            raise
        return spark.createDataFrame([], FOLD_SCORES)  # no fold has enough rows


#: The columns of a fold's scores.
FOLD_SCORES = """fold string, model string, horizon_h int, n long, rmse double, mae double, bias double,
    episode_recall double, observed_mean double"""


def _absent(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def _finished(spark, path: str) -> set[str]:
    try:
        return {r[0] for r in spark.read.parquet(path).select("part").distinct().collect()}
    except AnalysisException as missing:
        if not _absent(missing):
            raise
        return set()


def lead_coverage(sup: DataFrame, lead: DataFrame, least: float = 0.999) -> DataFrame:
    """Share of rows the lead matching reaches; below ``least`` a paired reading is not row for row."""
    share = F.avg(F.col("met_lead_matched").cast("double"))
    return lead_match(sup, lead).agg(F.count("*").alias("rows"), share.alias("share")).withColumn("row_for_row", F.col("share") >= least)


# -- space ------------------------------------------------------------------
def held_out_rows(base: DataFrame, stations: DataFrame, cfg: Settings, compat: bool = False) -> tuple[Neighbourhoods, DataFrame]:
    """Supervised rows with the neighbours' sums at issue time and ``idw``, the distance-weighted value that a map would show.

    A station is never part of its own neighbourhood, so ``idw`` of its rows is what the others say of it. It is taken at the
    target hour; ``compat=True`` takes that of the issue hour, one to three days older.
    """
    base = staged(base, "base")  # the sums read it several times, and every held-out case again
    hoods = Neighbourhoods(base, stations)
    summed = staged(hoods.frame(), "neighbour-sums")
    sup = assign_split(build_supervised(summed, cfg.horizons), cfg).dropna(subset=["y", "cams_pm2_5_tgt"])
    shown = hoods.features(summed.select("station_id", "time", hoods.value, *SUMS, "nbr_n", "nbr_wind_from"), hoods.counts(hoods.value))
    when = "issue_time" if compat else "target_time"
    return hoods, sup.join(shown.select("station_id", F.col("time").alias(when), F.col("nbr_pm25_dist").alias("idw")), ["station_id", when], "left")


def _known(held_out: Sequence[str] | DataFrame, stations: DataFrame) -> list[str]:
    cases = [r[0] for r in held_out.collect()] if isinstance(held_out, DataFrame) else list(held_out)
    unknown = set(cases) - {r[0] for r in stations.select("station_id").collect()}
    if unknown:
        raise KeyError(f"unknown station ids: {sorted(unknown)}")
    return cases


def _error(c: str):
    return F.when(finite(c, "y"), F.col(c) - F.col("y"))


def spatial_baselines(base: DataFrame, stations: DataFrame, cfg: Settings, held_out: Sequence[str] | DataFrame, compat: bool = False) -> DataFrame:
    """The errors of the two baselines at each held-out station: interpolation from the others, and the forecast."""
    cases = _known(held_out, stations)
    _, sup = held_out_rows(base, stations, cfg, compat)
    test = sup.where((F.col("split") == "test") & F.col("station_id").isin(cases))
    table = test.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("observed_mean"), rmse(_error("idw")).alias("rmse_idw"), rmse(_error("cams_pm2_5_tgt")).alias("rmse_cams"),
    )
    return table.join(nearest_other(stations), "station_id", "left")


#: Held-out stations whose neighbour features are made in one pass.
BLOCK = 32


def leave_one_out(
    base: DataFrame, stations: DataFrame, cfg: Settings, held_out: Sequence[str] | DataFrame, min_train: int = MIN_LOSO_TRAIN,
    compat: bool = False, at_once: int = 4, **params,
) -> DataFrame:
    """Predict each held-out station from the others, its own values removed from every neighbourhood.

    Neighbour sums and supervised rows are made once. ``BLOCK`` cases at a time take the held-out station's term from the sums of the
    training hours, and their training rows are written once with the neighbour features of every case side by side; all other
    columns are the same for all. So what a case reads is a plain scan. ``at_once`` cases are fitted side by side, and each writes what it predicts
    as it ends, so no plan spans the cases. ``compat=True`` scores the interpolation of the issue hour instead of the target hour's.
    """
    cases = _known(held_out, stations)
    hoods, sup = held_out_rows(base, stations, cfg, compat)
    sup = staged(sup.where(F.col("split").isin("train", "test")), "held-out")
    counts = sup.groupBy("station_id", "split").count().collect()
    n_train = sum(r["count"] for r in counts if r["split"] == "train")
    own = {(r["station_id"], r["split"]): r["count"] for r in counts}
    cases = [c for c in cases if n_train - own.get((c, "train"), 0) >= min_train and own.get((c, "test"))]
    if not cases:
        raise RuntimeError("no station produced a usable evaluation")

    hoods.written()
    found = scratch(base.sparkSession, "held-out-predictions")
    sums, hour = [*SUMS, "nbr_n", "nbr_wind_from"], ["station_id", "issue_time"]
    train = sup.where(F.col("split") == "train").drop("idw")
    hours = staged(train.select(*hour, hoods.value, *sums).dropDuplicates(hour), "training-hours")
    # A station's own rows keep their sums, which never held its own value.
    test = staged(hoods.features(sup.where(F.col("split") == "test"), hoods.counts(hoods.value)), "held-out-test")
    nbr = [c for c in test.columns if c not in sup.columns]

    def without(block: Sequence[str]) -> DataFrame:
        """Training rows with ``without``: the neighbour features of the row by held-out station."""
        asked = hours.withColumn("held_out", F.explode(F.array(*map(F.lit, block)))).where(F.col("station_id") != F.col("held_out"))
        made = hoods.features(hoods.less(asked, "issue_time"), hoods.counts(hoods.value))
        made = made.groupBy(*hour).agg(F.map_from_entries(F.collect_list(F.struct("held_out", F.struct(*nbr)))).alias("without"))
        return staged(train.drop(*sums).join(made, hour), "held-out-train")

    def predict(case: str, rows: DataFrame) -> None:
        left = F.col("without")[case]
        rows = rows.where(F.col("station_id") != case).withColumns({c: left[c] for c in nbr}).drop("without")
        model = Corrector("spatial", use_obs_history=False, **params).fit(rows)
        scored = model.predict(test.where(F.col("station_id") == case))
        scored = scored.select(F.lit(case).alias("held_out"), "y", "q50", "idw", "cams_pm2_5_tgt")
        scored.write.mode("overwrite").parquet(f"{found}/case={cases.index(case)}")

    with ThreadPoolExecutor(at_once) as pool:
        for k in range(0, len(cases), BLOCK):
            block = cases[k:k + BLOCK]
            rows = without(block)
            list(pool.map(lambda case, rows=rows: predict(case, rows), block))
    table = base.sparkSession.read.parquet(found).groupBy(F.col("held_out").alias("station_id")).agg(
        F.count("*").alias("n"), F.avg("y").alias("observed_mean"), rmse(_error("q50")).alias("rmse_graph"),
        rmse(_error("idw")).alias("rmse_idw"), rmse(_error("cams_pm2_5_tgt")).alias("rmse_cams"),
        F.avg(F.abs(_error("q50"))).alias("mae_graph"), F.avg(_error("q50")).alias("bias_graph"),
    )
    return table.join(nearest_other(stations), "station_id", "left")


def nearest_other(stations: DataFrame) -> DataFrame:
    """Distance from each station to the closest other one: 0 where several share a position, else that of the closest other position."""
    at = places_of(stations)
    points = at.select("place", "lat", "lon", "stations").distinct()
    a = points.select("place", F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon"))
    b = points.select(F.col("place").alias("other"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    far = nearest(a, b, "place", "other", apart=True).select("place", "km")
    km = F.when(F.col("stations") > 1, 0.0).otherwise(F.round("km", 1))
    return at.join(far, "place", "left").select("station_id", km.alias("nearest_km"))


def spatial_means(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("n_stations"), *[F.avg(f"rmse_{k}").alias(f"mean_rmse_{k}") for k in ("graph", "idw", "cams")])


# -- stages -----------------------------------------------------------------
def stage_evaluation(sup: DataFrame, cfg: Settings, **params) -> dict[str, DataFrame]:
    """City model, its stage decisions and warning times, from city supervised rows."""
    anchor = "cams_pm25_24h_tgt"
    if anchor not in sup.columns:
        raise KeyError(f"{anchor} missing")
    rows = staged(sup.dropna(subset=["y", anchor]), "city")
    train, val, test = (rows.where(F.col("split") == s) for s in ("train", "val", "test"))
    model = Calibrated(Corrector("city-corrector", anchor=anchor, **params))
    fit_models([model], train, val)
    pred = stage_probabilities(model.predict(test), cfg).withColumn("observed_stage", observed_stage(F.col("y"), cfg))
    pred = staged(pred, "city-scored")
    summary = pred.agg(
        F.count("*").alias("test_rows"), rmse(F.col("q50") - F.col("y")).alias("rmse_city"),
        F.avg(((F.col("y") >= F.col("q10")) & (F.col("y") <= F.col("q90"))).cast("double")).alias("coverage"),
    )
    return {"scored": pred, "table": stage_table(pred, cfg), "lead": lead_times(pred, cfg), "summary": summary}


# -- lead match -------------------------------------------------------------
def lead_match_comparison(
    sup: DataFrame, lead: DataFrame, models: Callable[[], Sequence[Model]] | None = None, evaluate_on: str = "test", **params
) -> DataFrame:
    """The same models under two meteorologies, on the rows the lead matching reached."""
    make = models or (lambda: [Persistence(), RawForecast(), Corrector("full", drop_prefixes=("upwind_",), **params)])
    matched = staged(lead_match(sup, lead).where("met_lead_matched"), "lead-matched")
    keys = ["station_id", "issue_time", "horizon_h"]
    short = sup.join(matched.select(*keys), keys, "left_semi")
    parts = []
    for frame, label in ((short, "archive (short-lead)"), (matched, "lead-matched")):
        table, _ = ablation(frame, make(), evaluate_on)
        parts.append(table.withColumn("meteorology", F.lit(label)))
    return union_all(parts)


# -- visibility -------------------------------------------------------------
def visibility_supervised(base: DataFrame, cfg: Settings, roster: DataFrame | None = None) -> DataFrame:
    """City rows with observed visibility as target and the forecast's visibility as anchor."""
    city = staged(city_base(base, cfg, roster, min_coverage=STABLE_SHARE), "city-visibility")
    sup = build_supervised(city, cfg.horizons, target="metar_visibility_km")
    return assign_split(sup.withColumn("vis_anchor_km", F.col("met_visibility_tgt") / 1000.0), cfg)


def visibility_evaluation(sup: DataFrame, min_train: int = MIN_VIS_TRAIN, min_band: int = 30, **params) -> dict[str, DataFrame]:
    """Four visibility predictors: scores, fog alarms and pollution strata."""
    rows = staged(sup.dropna(subset=["y", "vis_anchor_km", "vis_lag_1h"]), "visibility")
    train, val, test = (rows.where(F.col("split") == s) for s in ("train", "val", "test"))
    if train.count() < min_train or test.isEmpty():
        raise RuntimeError("too few visibility rows; check the split blocks")
    weather = Calibrated(Corrector("weather-only", anchor="vis_anchor_km", drop_prefixes=POLLUTION_PREFIXES, **params))
    informed = Calibrated(Corrector("pollution-informed", anchor="vis_anchor_km", **params))
    fit_models([weather, informed], train, val)
    fog, wide = [], test
    for m, col in ((weather, "_weather"), (informed, "_informed")):
        pred = m.predict(wide)
        fog.append(pred.select(F.lit(m.inner.name).alias("model"), "y", "q10", "q50", "q90"))
        wide = pred.withColumnRenamed("q50", col).drop("q10", "q90")
    columns = {
        "model-visibility": "vis_anchor_km", "persistence": "vis_lag_1h", "weather-only": "_weather", "pollution-informed": "_informed",
    }
    return {
        "table": visibility_scores(wide, columns), "fog": fog_alarms(union_all(fog)),
        "strata": pollution_strata(wide, columns, min_rows=min_band),
    }
