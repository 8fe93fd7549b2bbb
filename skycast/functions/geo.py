"""Great-circle geometry and distance-bounded pair joins.

Pairs are found by an equi-join on cells of a grid, never by a cross join: two
points closer than the cell size lie in the same or in adjacent cells. Points on
the sphere use cells of the unit-sphere coordinates, so neither the poles nor the
antimeridian need special cases.
"""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, staged

EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = (F.radians(lat2) - F.radians(lat1)) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    s = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(s, F.lit(1.0))))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from the first point to the second, clockwise from north."""
    dl = F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dl)
    return (F.degrees(F.atan2(y, x)) + 360.0) % 360.0


def _sphere(lat: Column, lon: Column) -> list[Column]:
    return [
        F.cos(F.radians(lat)) * F.cos(F.radians(lon)),
        F.cos(F.radians(lat)) * F.sin(F.radians(lon)),
        F.sin(F.radians(lat)),
    ]


def _chord(radius_km: float) -> float:
    return 2 * math.sin(min(radius_km / EARTH_KM, math.pi) / 2)


def _cells(axes: list[Column], size: float, spread: bool) -> Column:
    """The cell of a point, or that cell with all its neighbours."""
    parts = []
    for axis in axes:
        c = F.floor(axis / F.lit(size)).cast("long")
        parts.append(F.array(c - 1, c, c + 1) if spread else F.array(c))
    out = F.transform(parts[0], lambda a: F.array(a))
    for nxt in parts[1:]:
        out = F.flatten(F.transform(out, lambda prefix: F.transform(nxt, lambda a: F.concat(prefix, F.array(a)))))
    return out


def pairs_within(left: DataFrame, right: DataFrame, radius_km: float, on: Sequence[str] = ()) -> DataFrame:
    """Every (left, right) pair at most ``radius_km`` apart, with ``km``; with ``on`` only those equal in these columns.

    Left carries l_lat, l_lon and right carries r_lat, r_lon.
    """
    size = max(_chord(radius_km) * 1.0000001, 1e-9)
    a = left.withColumn("_cell", F.explode(_cells(_sphere(F.col("l_lat"), F.col("l_lon")), size, True)))
    b = right.withColumn("_cell", _cells(_sphere(F.col("r_lat"), F.col("r_lon")), size, False)[0])
    km = haversine_km(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))
    return a.join(b, ["_cell", *on]).drop("_cell").withColumn("km", km).where(F.col("km") <= radius_km)


#: Rows of a side that meet in one task of ``all_pairs``, about, and the parts a side is dealt into at most.
SIDE, SIDES = 500, 32


def all_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every left row with every right row.

    Both sides are dealt into parts and each pair of parts meets in a task of its own, so what a task holds grows
    with a side and not with the pairs, and no pair is ever shuffled. The number of tasks is given, since the few bytes that go
    into them say nothing of the rows that come out.
    """
    parts = min(SIDES, 1 + left.count() // SIDE)

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64(*df.columns), F.lit(parts)).cast("int")
        return df.withColumn(own, part).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(parts * parts, "_i", "_j")

    return dealt(left, "_i", "_j").join(dealt(right, "_j", "_i"), ["_i", "_j"]).drop("_i", "_j")


def planar_pairs_within(left: DataFrame, right: DataFrame, radius_deg: float) -> DataFrame:
    """As ``pairs_within`` in plain degrees, with ``deg2`` the squared distance."""
    a = left.withColumn("_cell", F.explode(_cells([F.col("l_lat"), F.col("l_lon")], radius_deg, True)))
    b = right.withColumn("_cell", _cells([F.col("r_lat"), F.col("r_lon")], radius_deg, False)[0])
    d2 = F.pow(F.col("l_lat") - F.col("r_lat"), 2) + F.pow(F.col("l_lon") - F.col("r_lon"), 2)
    return a.join(b, "_cell").drop("_cell").withColumn("deg2", d2).where(F.col("deg2") <= radius_deg**2)


#: A cell of the site tree is split while it holds more sites; a search starts from so many cells at most.
LEAF, START = 16, 32
#: Levels of the site tree: cells of about 3 m on the sphere.
DEPTH = 22
#: Rounds of a search between lineage cuts.
ROUNDS = 4


def _spots(axes: list[Column], low: float, width: float) -> list[Column]:
    """Whole coordinates on the finest level of a tree over [low, low + width] on every axis."""
    top = 2**DEPTH
    return [F.greatest(F.lit(0), F.least(F.lit(top - 1), F.floor((x - low) * (top / width)))).cast("int") for x in axes]


def _above(cells: Column, by: Column) -> Column:
    """The coordinates of a cell ``by`` levels higher."""
    return F.transform(cells, lambda c: F.floor(c / F.pow(F.lit(2.0), by)).cast("int"))


def site_tree(sites: DataFrame, axes: list[Column], low: float, width: float, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """(cells, sites with the leaf they are in): a tree that is deep where sites are dense.

    Cells: level, cell (coordinates), n sites, ``spot`` (axes of one of them), ``inner`` (has children). Only
    cells whose parent holds more than ``leaf`` sites exist, so there are at most DEPTH times the sites over
    ``leaf`` of them besides the leaves. Counts are combined before the shuffle, whatever the density.
    """
    x = F.array(*axes)
    placed = sites.withColumn("_x", x).withColumn("_fine", F.array(*_spots(axes, low, width)))
    levels = F.explode(F.sequence(F.lit(0), F.lit(DEPTH)))
    each = placed.select("_x", "_fine", levels.alias("_level")).withColumn("_cell", _above(F.col("_fine"), DEPTH - F.col("_level")))
    counted = each.groupBy("_level", "_cell").agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_spot"))
    full = counted.where(F.col("_n") > leaf).select((F.col("_level") + 1).alias("_level"), F.col("_cell").alias("_parent"))
    child = counted.withColumn("_parent", _above(F.col("_cell"), F.lit(1)))
    kept = child.join(full, ["_level", "_parent"], "left_semi").unionByName(child.where("_level = 0"))
    cells = kept.withColumn("_inner", (F.col("_n") > leaf) & (F.col("_level") < DEPTH))
    leaves = cells.where(~F.col("_inner")).select("_level", "_cell")
    own = placed.withColumn("_level", levels).withColumn("_cell", _above(F.col("_fine"), DEPTH - F.col("_level")))
    return cells, own.join(leaves, ["_level", "_cell"], "left_semi").drop("_x", "_fine")


def candidates(
    points: DataFrame, sites: DataFrame, point_axes: list[Column], site_axes: list[Column], low: float, width: float, key: str,
    leaf: int = LEAF, apart: bool = False,
) -> DataFrame | None:
    """(key, site columns): for each point the sites of all leaves that can hold its nearest one; None without sites.

    With ``apart``, sites at the point's own position do not count: where the one site known of a cell is
    there, the cell's diagonal bounds the distance to others in it, if it holds any.

    Level by level: the distance to one site of each cell in reach bounds the nearest distance from above,
    cells farther than the least such bound go, the others give way to their children. What is left in
    the end are leaves that the ball around the point touches, each with ``leaf`` sites at most.
    """
    cells, placed = site_tree(sites, site_axes, low, width, leaf)
    cells = staged(cells, "tree")
    per_level = {r["_level"]: (r["_n"], r["leaves"]) for r in cells.groupBy("_level").agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("_inner")).alias("leaves")).collect()}
    if not per_level:
        return None
    deepest, start = max(per_level), 0
    while start < deepest and per_level[start + 1][0] + sum(per_level[k][1] for k in range(start + 1)) <= START:
        start += 1
    first = cells.where((F.col("_level") == start) | ((F.col("_level") < start) & ~F.col("_inner"))).collect()  # START at most
    size = lambda level: F.lit(width) / F.pow(F.lit(2.0), level)
    distance = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, d: t + d)

    def gap(x: Column, level: Column, cell: Column) -> Column:
        """Squared distance to the nearest place of a cell."""
        s = size(level)
        beyond = lambda a, c: F.greatest(F.lit(0.0), c * s + low - a, a - (c + 1) * s - low)
        return F.aggregate(F.zip_with(x, cell, beyond), F.lit(0.0), lambda t, d: t + d * d)

    def known(x: Column, level: Column, n: Column, spot: Column) -> Column:
        """Squared distance within which a cell surely has a site."""
        d = distance(x, spot)
        if not apart:
            return d
        return F.when(d > 1e-18, d).when(n > 1, len(site_axes) * size(level) * size(level)).otherwise(F.lit(math.inf))

    slack = lambda ub: ub * (1 + 1e-9) + 1e-15
    entry = lambda r: F.struct(*(F.lit(r[c]).alias(c) for c in ("_level", "_cell", "_inner", "_n", "_spot")))
    front = points.select(key, F.array(*point_axes).alias("_p")).withColumn("_all", F.array(*map(entry, first)))
    front = front.withColumn("_ub", F.array_min(F.transform("_all", lambda c: known(F.col("_p"), c["_level"], c["_n"], c["_spot"]))))
    front = front.withColumn("_c", F.explode(F.filter("_all", lambda c: gap(F.col("_p"), c["_level"], c["_cell"]) <= slack(F.col("_ub")))))
    front = front.select(key, "_p", "_ub", F.col("_c._level").alias("_level"), F.col("_c._cell").alias("_cell"), F.col("_c._inner").alias("_inner"))

    children = cells.select(
        (F.col("_level") - 1).alias("_level"), F.col("_parent").alias("_cell"), F.col("_cell").alias("_child"), F.col("_inner").alias("_deep"), "_n", "_spot"
    )
    own = Window.partitionBy(key)
    for k in range(start, deepest):
        here = F.col("_inner") & (F.col("_level") == k)
        below = front.where(here).join(children.where(F.col("_level") == k), ["_level", "_cell"]).select(
            key, "_p", F.least("_ub", known(F.col("_p"), F.col("_level") + 1, F.col("_n"), F.col("_spot"))).alias("_ub"), (F.col("_level") + 1).alias("_level"),
            F.col("_child").alias("_cell"), F.col("_deep").alias("_inner"),
        )
        front = front.where(~here).unionByName(below).withColumn("_ub", F.min("_ub").over(own))
        front = front.where(gap(F.col("_p"), F.col("_level"), F.col("_cell")) <= slack(F.col("_ub")))
        if (k - start) % ROUNDS == ROUNDS - 1:
            front = cut(front)
    return front.select(key, "_level", "_cell").join(placed, ["_level", "_cell"]).drop("_level", "_cell")


def _nearest(left: DataFrame, right: DataFrame, key: str, tie: str, axes, low: float, width: float, measure: str, by, apart: bool = False) -> DataFrame:
    """Left rows with the columns of their nearest right row; ``key`` is unique in left."""
    # of sites at one position only the first by ``tie`` can be chosen
    right = right.groupBy("r_lat", "r_lon").agg(F.min_by(F.struct(*right.columns), tie).alias("_s")).select("_s.*")
    met = candidates(
        left, right, axes(F.col("l_lat"), F.col("l_lon")), axes(F.col("r_lat"), F.col("r_lon")), low, width, key, apart=apart
    )
    if met is None:
        return left.withColumns({f.name: F.lit(None).cast(f.dataType) for f in right.schema.fields} | {measure: F.lit(None).cast("double")})
    met = met.join(left.select(key, "l_lat", "l_lon"), key)
    met = met.withColumn(measure, by(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon")))
    extra = [*right.columns, measure]
    best = (met.where(F.col(measure) > 0) if apart else met).groupBy(key).agg(F.min_by(F.struct(*extra), F.struct(measure, tie)).alias("_n"))
    return left.join(best, key).select(*left.columns, "_n.*")


def nearest(left: DataFrame, right: DataFrame, key: str, tie: str, apart: bool = False) -> DataFrame:
    """Left rows with the columns of their nearest right row and ``km``; ties by ``tie``.

    ``apart``: right rows at the left row's own position do not count (positions in right are distinct then).
    """
    return _nearest(left, right, key, tie, _sphere, -1.0, 2.0, "km", haversine_km, apart)


def nearest_planar(left: DataFrame, right: DataFrame, key: str, tie: str) -> DataFrame:
    """As ``nearest`` in plain degrees, with ``deg2`` the squared distance."""
    deg2 = lambda a, b, c, d: F.pow(a - c, 2) + F.pow(b - d, 2)
    return _nearest(left, right, key, tie, lambda a, b: [a, b], -512.0, 1024.0, "deg2", deg2)


def grid(spark, lat_min: float, lon_min: float, lat_max: float, lon_max: float, step: float) -> DataFrame:
    """Regular lat/lon grid, both ends included."""
    n_lat = int(math.floor((lat_max - lat_min + 1e-9) / step)) + 1
    n_lon = int(math.floor((lon_max - lon_min + 1e-9) / step)) + 1
    i, j = F.floor(F.col("id") / n_lon), F.col("id") % n_lon
    return spark.range(n_lat * n_lon).select(
        F.round(lat_min + i * F.lit(step), 4).alias("lat"), F.round(lon_min + j * F.lit(step), 4).alias("lon")
    )
