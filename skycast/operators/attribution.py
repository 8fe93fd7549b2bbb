"""Signed contributions of features to the correction, grouped into named drivers.

In a forest, the contributions of a row depend only on the leaf it reaches: walking from
the root, each split moves the node value, and the move is credited to the split
feature. Those moves form a table of (tree, leaf, feature), at most trees x 2^depth x
depth rows, which is joined to the leaves of the rows. The sum over features plus the
mean root value is the predicted residual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch
from .models import Calibrated, Corrector, Coupled

# Feature prefixes of each driver; the first match wins.
GROUPS = (
    ("upwind fires", ("fire",)),
    ("shallow mixing", ("met_boundary_layer_height", "met_ventilation_index", "met_lapse", "met_inversion", "met_blh")),
    ("wind and transport", ("met_wind", "met_u10", "met_v10", "met_gusts", "nbr_pm25_wind")),
    ("neighbouring stations", ("nbr_",)),
    ("humidity and fog", ("met_relative_humidity", "met_dew_point", "metar_", "vis_", "pred_visibility")),
    ("regional forecast (CAMS)", ("cams_",)),
    ("recent local levels", ("obs_",)),
    ("rain and clearing", ("met_precipitation", "met_cloud", "met_shortwave")),
    ("time of day and season", ("hour", "doy", "weekday", "month", "season")),
    ("other weather", ("met_",)),
)


def driver_of(feature: Column) -> Column:
    expr = None
    for name, prefixes in GROUPS:
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | feature.startswith(p)
        expr = F.when(hit, name) if expr is None else expr.when(hit, name)
    return expr.otherwise("other")


def _corrector(model) -> Corrector:
    if isinstance(model, Calibrated):
        model = model.inner
    return model.pm if isinstance(model, Coupled) else model


def _steps(model: Corrector, horizon: int, spark, quantile: str):
    """(tree, leaf, feature, step) and the mean root value, read from the saved node table."""
    path = scratch(spark, "forest")
    model.forests[horizon].write().overwrite().save(path)
    nodes = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
        nodes.setdefault(r["treeID"], {})[r["id"]] = r
    q = list(("q10", "q50", "q90")).index(quantile)
    trees = len(nodes)
    rows, roots = [], 0.0
    for tree, table in nodes.items():
        roots += table[0]["prediction"] / trees
        leaf = 0
        stack = [(0, ())]
        while stack:
            node_id, path_steps = stack.pop()
            node = table[node_id]
            if node["leftChild"] < 0:
                # The last move lands on the leaf quantile instead of the leaf mean.
                end = model.leaves[horizon].get((tree, leaf), (0.0, 0.0, 0.0))[q]
                if path_steps:
                    *head, (feature, parent, _) = path_steps
                    moves = [*head, (feature, parent, end)]
                    rows += [(tree, leaf, model.features[f], (b - a) / trees) for f, a, b in moves]
                leaf += 1
                continue
            feature = node["split"]["featureIndex"]
            for child in (node["rightChild"], node["leftChild"]):
                stack.append((child, (*path_steps, (feature, node["prediction"], table[child]["prediction"]))))
    schema = "tree int, leaf int, feature string, step double"
    steps = spark.createDataFrame(rows or [(0, -1, "", 0.0)], schema)
    steps = steps.groupBy("tree", "leaf", "feature").agg(F.sum("step").alias("step"))
    return steps, roots


def contributions(model, df: DataFrame, horizon: int, keys: list[str], quantile: str = "q50") -> DataFrame:
    """(keys, feature, contribution, driver, base_value), long. Only features a row's paths use appear."""
    inner = _corrector(model)
    if horizon not in inner.forests:
        raise KeyError(f"no head fitted for horizon {horizon}")
    spark = df.sparkSession
    steps, base = _steps(inner, horizon, spark, quantile)
    rows = inner.residuals(df.where(F.col("horizon_h") == horizon))
    each = rows.select(*keys, F.posexplode("_res.leaf").alias("tree", "leaf"))
    # Bounded by trees x 2^depth x depth, fixed at fit time.
    out = each.join(F.broadcast(steps), ["tree", "leaf"]).groupBy(*keys, "feature").agg(F.sum("step").alias("contribution"))
    return out.withColumn("driver", driver_of(F.col("feature"))).withColumn("base_value", F.lit(float(base)))


def drivers(model, df: DataFrame, horizon: int, keys: list[str], top: int = 4, detail: DataFrame | None = None) -> DataFrame:
    """Mean contribution and magnitude per driver, over all rows and all features of the driver.

    Absent (row, feature) pairs contribute zero, so the divisor is rows x features.
    """
    spark = df.sparkSession
    features = spark.createDataFrame([(f,) for f in _corrector(model).features], "feature string")
    size = features.groupBy(driver_of(F.col("feature")).alias("driver")).agg(F.count("*").alias("_k"))
    rows = df.where(F.col("horizon_h") == horizon).agg(F.count("*")).scalar()
    detail = contributions(model, df, horizon, keys) if detail is None else detail
    sums = detail.groupBy("driver").agg(F.sum("contribution").alias("_s"), F.sum(F.abs("contribution")).alias("_a"))
    cells = F.col("_k") * rows
    return (
        size.join(sums, "driver", "left").fillna(0.0, ["_s", "_a"])
        .select("driver", (F.col("_s") / cells).alias("mean_contribution"), (F.col("_a") / cells).alias("mean_magnitude"))
        .orderBy(F.desc("mean_magnitude"), "driver").limit(top)
    )


# The wording of an explanation.
REGIONAL = "CAMS puts the regional level at %.0f µg/m³. "
NO_DRIVER = "No single driver dominates; the forecast tracks the regional CAMS signal."
ONE_DRIVER = "Our correction is driven by "
MORE_DRIVERS = "Our correction is driven mainly by "
DRIVER = "%s (%s it by %.0f µg/m³)"


def explain(detail: DataFrame, context: DataFrame, keys: list[str], top: int = 3, anchor: str = "cams_pm2_5_tgt") -> DataFrame:
    """Every forecast in words: its top drivers and a sentence. Groups are the ten drivers of one row."""
    per = detail.groupBy(*keys, "driver").agg(F.sum("contribution").alias("c"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.abs("c")), "driver"))
    best = per.withColumn("_k", rank).where(F.col("_k") <= top)
    text = F.format_string(
        DRIVER, F.col("driver"), F.when(F.col("c") > 0, "raising").otherwise("lowering"), F.abs("c")
    )
    item = F.struct("_k", "driver", F.col("c").alias("contribution"), F.when(F.abs("c") >= 1.0, text).alias("text"))
    packed = best.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_d"))
    parts = F.filter(F.transform("_d", lambda d: d["text"]), lambda t: t.isNotNull())
    lead = F.when(
        F.col(anchor).isNotNull(),
        F.format_string(REGIONAL, F.col(anchor)),
    ).otherwise("")
    said = (
        F.when(F.size(parts) == 0, F.lit(NO_DRIVER))
        .when(F.size(parts) == 1, F.concat(lead, F.lit(ONE_DRIVER), parts[0], F.lit(".")))
        .otherwise(F.concat(lead, F.lit(MORE_DRIVERS), F.array_join(parts, ", then "), F.lit(".")))
    )
    return context.join(packed, keys).withColumn("sentence", said).withColumn(
        "drivers", F.transform("_d", lambda d: F.struct(d["driver"].alias("driver"), d["contribution"].alias("contribution")))
    ).drop("_d")
