"""Wind- and distance-weighted neighbour kernels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import all_pairs, bearing_deg, grid, haversine_km, nearest, pairs_within
from ..functions.meteo import mean_direction
from ..session import broadcast_bounded, broadcast_checked, staged

LENGTH_KM = 15.0
WIND_POWER = 2.0
FLOOR = 1e-9
WIND_FLOOR = 1e-6
WIND_COL = "met_wind_direction_10m"


#: Largest value, the error allowed in a weighted mean, and how much of a receptor's decay may lie upwind before its hour needs a second look.
LARGEST, ERROR, UPWIND_SLACK = 1200.0, 1e-9, 1e-2


def negligible_beyond(n_sites: int, length_km: float, largest: float = LARGEST, error: float = ERROR) -> float:
    """Distance past which all sites together change a weighted mean by less than ``error``.

    Denominators are floored at 1e-9, so dropping sites farther than r moves a result by
    at most n * exp(-r / L) * largest / 1e-9.
    """
    return length_km * math.log(max(n_sites, 1) * largest / (FLOOR * error))


def in_reach(densest: int, n_sites: int, share: float) -> float:
    """Lengths past which the decays of all sites sum to less than ``share``, if a cell one length wide holds ``densest`` at most.

    Rings one length wide at k lengths hold at most 3 pi (2 k + 2) cells, so the sum depends on the density, not on the
    number of sites; with few sites their number is the better bound.
    """
    k = math.log(n_sites / share)
    for _ in range(4):
        k = math.log(min(n_sites, densest * 3 * math.pi * ((2 * k + 2) * 1.582 + 1.842)) / share)
    return k


def geometry(stations: DataFrame, radius_km: float = math.inf) -> DataFrame:
    """Directed pairs (receptor, neighbour, km, bearing) up to ``radius_km``, self included.

    A radius round the globe means all pairs, whose number is the square of the stations': cells would bring them into a few tasks.
    """
    a = stations.select(F.col("station_id").alias("receptor"), F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon"))
    b = stations.select(F.col("station_id").alias("neighbour"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    if radius_km >= math.pi * 6372.0:
        km = haversine_km(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))
        met = all_pairs(a, b).withColumn("km", km)
    else:
        met = pairs_within(a, b, radius_km)
    return met.select(
        "receptor", "neighbour", "km", bearing_deg(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon")).alias("bearing")
    )


def upwind_share(wind_from: Column, bearing: Column, power: float = WIND_POWER) -> Column:
    return F.pow(F.greatest(F.cos(F.radians(wind_from - bearing)), F.lit(0.0)), power)


def edges(stations: DataFrame, length_km: float = LENGTH_KM, radius_km: float | None = None) -> DataFrame:
    """Neighbour edges with distance decay; a station is never its own neighbour.

    Without a radius, pairs are cut where the kernel provably no longer matters.
    """
    if radius_km is None:
        radius_km = negligible_beyond(stations.count(), length_km)
    return (
        geometry(stations, radius_km)
        .where(F.col("receptor") != F.col("neighbour"))
        .withColumn("decay", F.exp(-F.col("km") / length_km))
    )


def places_of(stations: DataFrame) -> DataFrame:
    """station_id, place (the smallest id at the same position), lat, lon, and the stations there."""
    here = stations.groupBy("lat", "lon").agg(F.min("station_id").alias("place"), F.count(F.lit(1)).alias("stations"))
    return stations.select("station_id", "lat", "lon").join(here, ["lat", "lon"])


def links(receptors: DataFrame, places: DataFrame, length_km: float = LENGTH_KM) -> tuple[DataFrame, DataFrame | None]:
    """(near, far) links, far None if there are none, of receptors (receptor, l_lat, l_lon) to places (place, r_lat, r_lon, stations), at other positions.

    Near links reach a fixed number of lengths beyond the receptor's nearest place, as many as the density
    of places needs for all farther ones to weigh nothing against it; so their number per receptor does not
    grow with the area. Far links go on to where even the floored denominators notice nothing. Both carry ``beyond``, the
    sum of the decays of all the receptor's far links, which bounds what leaving them out can change.
    """
    cell = F.array(*(F.floor(x * (111.0 / length_km)) for x in (F.col("r_lat"), F.col("r_lon") * F.cos(F.radians("r_lat")))))
    densest, total = places.groupBy(cell.alias("cell")).agg(F.sum("stations").alias("n")).agg(F.max("n"), F.sum("n")).first()
    densest, total = densest or 1, total or 1
    lengths = in_reach(densest, total, ERROR / LARGEST * UPWIND_SLACK)
    met = pairs_within(receptors, places, min(negligible_beyond(total, length_km), math.pi * 6372.0)).where("km > 0")
    met = met.select(
        "receptor", "place", "stations", "km", F.exp(-F.col("km") / length_km).alias("decay"),
        bearing_deg(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon")).alias("bearing"),
    )
    nearest_km = F.min("km").over(Window.partitionBy("receptor"))
    met = met.withColumn("near", F.col("km") <= nearest_km + length_km * lengths)
    beyond = F.coalesce(F.sum(F.when(~F.col("near"), F.col("decay") * F.col("stations"))).over(Window.partitionBy("receptor")), F.lit(0.0))
    met = staged(met.withColumn("beyond", beyond).drop("km", "stations"), "links")
    counts = {r["near"]: r["count"] for r in met.groupBy("near").count().collect()}
    near, far = (broadcast_bounded(met.where(F.col("near") == x).drop("near"), counts.get(x, 0)) for x in (True, False))
    return near, far if counts.get(False) else None


def kernel_sums(
    values: DataFrame, winds: DataFrame, near: DataFrame, far: DataFrame | None, power: float = WIND_POWER, keys: Sequence[str] = ()
) -> DataFrame:
    """(time, receptor, point and the four sums) of the kernel over the values of other places.

    ``values``: time, place, keys, n, total (usable stations of a place in an hour, and their sum). ``winds``: time, point, receptor,
    wind, keys: one row for each sum wanted. Both are dealt by time, link rows are made after that shuffle
    and summed in place. Sums whose far links could still matter (the nearest stations have no value that
    hour, or nearly all lies across the wind) are made up with those links; all others never see them.
    """
    share = upwind_share(F.col("wind"), F.col("bearing"), power)
    of = ["time", "receptor", "point"]

    def sums(winds: DataFrame, over: DataFrame) -> DataFrame:
        met = values.join(over, "place").join(winds.hint("shuffle_hash"), ["time", "receptor", *keys])
        return met.withColumn("w", F.col("decay") * share).groupBy(*of).agg(
            F.sum(F.col("decay") * F.col("n")).alias("d"), F.sum(F.col("decay") * F.col("total")).alias("dv"),
            F.sum(F.col("w") * F.col("n")).alias("u"), F.sum(F.col("w") * F.col("total")).alias("uv"),
        )

    first = sums(winds, near)
    if far is None:
        return first
    first = staged(first, "near-sums")
    # receptors without any near value that hour have no row yet
    bounds = broadcast_checked(far.groupBy("receptor").agg(F.max("beyond").alias("bound")))
    open_ = winds.join(bounds, "receptor").join(first.select(*of, "d", "u"), of, "left")
    d, u, off = F.coalesce("d", F.lit(0.0)), F.coalesce("u", F.lit(0.0)), F.col("bound") * (LARGEST / ERROR)
    settled = (off <= F.greatest(d, F.lit(FLOOR))) & ((u + F.col("bound") <= WIND_FLOOR) | (off <= u))
    open_ = open_.where(~settled).select(*winds.columns)
    return first.unionByName(sums(open_, far)).groupBy(*of).agg(*(F.sum(c).alias(c) for c in ("d", "dv", "u", "uv")))


def _usable(value: str) -> Column:
    return F.col(value).isNotNull() & ~F.isnan(value)


def kernel_means(d: Column, dv: Column, u: Column, uv: Column, others: Column) -> tuple[Column, Column]:
    """(wind-weighted, distance-weighted) mean; sites beyond all links weigh nothing against the floored denominator."""
    wind = F.when(u > WIND_FLOOR, uv / F.greatest(u, F.lit(FLOOR)))
    return wind, F.when(d > 0, dv / F.greatest(d, F.lit(FLOOR))).when(others > 0, F.lit(0.0))


SUMS = ("nbr_d", "nbr_dv", "nbr_u", "nbr_uv")
#: A sum that keeps less than this share after a term is taken out is summed anew.
CANCELLED = 1e-4


class Neighbourhoods:
    """The kernel sums of every station and hour over the other stations, and the same with one station more left out.

    Stations at one position are summed first, hour by hour, so links join positions. Those at a
    receptor's own position count at distance 0; the receptor itself is taken out there, where no far
    term is in the sum yet, so nothing is lost to rounding.
    """

    def __init__(
        self, base: DataFrame, stations: DataFrame, exclude: Sequence[str] = (), length_km: float = LENGTH_KM, power: float = WIND_POWER,
        value: str = "pm25_clean",
    ):
        self.base, self.value, self.exclude, self.power = base, value, list(exclude), power
        self.at = places_of(stations)
        points = self.at.select("place", "lat", "lon", "stations").distinct()
        self.near, self.far = links(
            points.select(F.col("place").alias("receptor"), F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon")),
            points.select("place", "stations", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon")), length_km,
        )
        wind = F.col(WIND_COL) if WIND_COL in base.columns else F.lit(None).cast("double")
        rows = base.select("station_id", "time", F.col(value).alias("_v"), wind.alias("_w"))
        rows = rows.join(broadcast_checked(self.at.select("station_id", "place")), "station_id", "left").repartition("time")
        rows = rows.withColumn("_in", self.counts("_v"))
        per_hour = rows.groupBy("time").agg(F.avg("_w").alias("_mean_w"), F.count_if("_in").alias("nbr_n"))
        self.rows = rows.join(per_hour, "time").withColumn("wind", F.coalesce("_w", "_mean_w"))

    def written(self) -> Neighbourhoods:
        """The same with places, links and rows written once, for callers that leave out many stations in turn."""
        self.at, self.near, self.rows = staged(self.at, "places"), staged(self.near, "links"), staged(self.rows, "neighbour-rows")
        self.far = None if self.far is None else staged(self.far, "far-links")
        return self

    def counts(self, value: str) -> Column:
        """Whether a row's value is part of its neighbours' sums."""
        usable = _usable(value)
        return usable & ~F.col("station_id").isin(self.exclude) if self.exclude else usable

    def sums(self, asked: DataFrame, keys: Sequence[str] = (), values: DataFrame | None = None) -> DataFrame:
        """The four sums for each (time, station_id, keys) of ``asked``, which also has place, wind, _in and _v.

        ``values``: with ``keys`` too, the values to sum for each of them; all usable ones if none.
        """
        of = ["time", "place", *keys]
        if values is None:
            held = self.rows.where(F.col("_in") & F.col("place").isNotNull())
            values = held.groupBy(*of).agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("total"))
        point = F.struct("station_id", *keys)
        winds = asked.where(F.col("place").isNotNull()).select("time", point.alias("point"), F.col("place").alias("receptor"), "wind", *keys)
        away = kernel_sums(values, winds, self.near, self.far, self.power, keys).select("time", "point.*", "d", "dv", "u", "uv")
        here_n = F.coalesce("n", F.lit(0)) - F.col("_in").cast("int")
        here_v = F.col("total") - F.when(F.col("_in"), F.col("_v")).otherwise(0.0)
        share = upwind_share(F.col("wind"), F.lit(0.0), self.power)
        some = (here_n > 0) | F.col("d").isNotNull()
        own = lambda c, here: F.when(some, F.coalesce(c, F.lit(0.0)) + F.when(here_n > 0, here).otherwise(0.0)).alias(f"nbr_{c}")
        rest = [c for c in asked.columns if c not in {*of, "station_id"}]
        return asked.join(values, of, "left").join(away, ["time", "station_id", *keys], "left").select(
            "time", "station_id", *keys, *(c for c in rest if not c.startswith("_") and c != "wind"), F.col("wind").alias("nbr_wind_from"), "place",
            own("d", here_n), own("dv", here_v), own("u", here_n * share), own("uv", here_v * share),
        )

    def frame(self) -> DataFrame:
        """Base with the sums, the wind they were taken under (nbr_wind_from) and the hour's usable count (nbr_n)."""
        made = self.sums(self.rows).drop("place")
        return self.base.join(made, ["time", "station_id"], "left").withColumn("nbr_n", F.coalesce("nbr_n", F.lit(0)))

    def less(self, df: DataFrame, time: str = "time") -> DataFrame:
        """The rows of ``df`` (station_id, ``time``, held_out and the columns of ``frame``) without the held-out station's part.

        Its term is taken from each sum, so nothing is copied for a case but the rows asked for. Where the term
        was nearly the whole sum the rest is summed anew from the links. A row of the held-out
        station itself keeps its sums, which never held its own value.
        """
        ids = df.select("held_out").distinct()
        usable = self.rows.where(F.col("_in")).select(F.col("time").alias(time), F.col("station_id").alias("held_out"), F.col("_v").alias("_held"))
        usable = broadcast_checked(usable.join(ids, "held_out", "left_semi"))
        other = self.at.select(F.col("station_id").alias("held_out"), F.col("place").alias("_to"))
        mine = self.at.select("station_id", F.col("place").alias("_from"))
        met = (self.near if self.far is None else self.near.unionByName(self.far)).select(F.col("receptor").alias("_from"), F.col("place").alias("_to"), "decay", "bearing")
        same = mine.join(other, F.col("_from") == F.col("_to")).where("station_id <> held_out")
        toward = mine.join(met, "_from").join(other, "_to").select("station_id", "held_out", "decay", "bearing")
        toward = toward.unionByName(same.select("station_id", "held_out", F.lit(1.0).alias("decay"), F.lit(0.0).alias("bearing")))
        toward = broadcast_checked(toward.join(ids, "held_out", "left_semi"))
        out = df.join(usable, [time, "held_out"], "left").join(toward, ["station_id", "held_out"], "left")
        there = F.col("_held").isNotNull() & F.col("decay").isNotNull() & (F.col("station_id") != F.col("held_out"))
        w = F.col("decay") * upwind_share(F.col("nbr_wind_from"), F.col("bearing"), self.power)
        terms = {"nbr_d": F.col("decay"), "nbr_dv": F.col("decay") * F.col("_held"), "nbr_u": w, "nbr_uv": w * F.col("_held")}
        left = {c: F.when(there, F.col(c) - t).otherwise(F.col(c)) for c, t in terms.items()}
        thin = lambda c: F.col(f"{c} left") < CANCELLED * F.col(c)
        out = out.withColumns({f"{c} left": x for c, x in left.items()}).withColumn("_thin", F.coalesce(there & (thin("nbr_d") | (thin("nbr_u") & (F.col("nbr_u") > 0))), F.lit(False)))
        keys = ["station_id", time, "held_out"]
        anew = out.where("_thin").select("station_id", F.col(time).alias("time"), "held_out").distinct()
        anew = staged(anew, "thin-sums")
        if not anew.isEmpty():
            asked = anew.join(self.rows.drop("nbr_n"), ["time", "station_id"])
            held_rows = self.rows.where(F.col("_in")).select("time", "place", "station_id", "_v")
            every_ = held_rows.join(anew.select("time", "held_out").distinct(), "time").where("station_id <> held_out")
            values = every_.groupBy("time", "place", "held_out").agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("total"))
            fresh = self.sums(asked, ["held_out"], values).select(F.col("time").alias(time), "station_id", "held_out", *(F.col(c).alias(f"{c} anew") for c in SUMS))
            out = out.join(fresh, keys, "left")
            out = out.withColumns({c: F.when(F.col("_thin"), F.col(f"{c} anew")).otherwise(F.col(f"{c} left")) for c in SUMS}).drop(*(f"{c} anew" for c in SUMS))
        else:
            out = out.withColumns({c: F.col(f"{c} left") for c in SUMS})
        return out.withColumn("nbr_n", F.col("nbr_n") - F.col("_held").isNotNull().cast("int")).drop("_held", "decay", "bearing", "_thin", *(f"{c} left" for c in SUMS))

    def features(self, df: DataFrame, mine: Column) -> DataFrame:
        """nbr_pm25_wind, nbr_pm25_dist and nbr_count in place of the sums; ``mine``: whether the row's own value is counted in nbr_n."""
        wind, dist = kernel_means(*map(F.col, SUMS), F.col("nbr_n") - mine.cast("int"))
        made = {"nbr_count": F.col("nbr_n").cast("double"), "nbr_pm25_wind": wind, "nbr_pm25_dist": dist}
        return df.withColumns(made).drop(*SUMS, "nbr_n", "nbr_wind_from")


def neighbour_features(
    base: DataFrame,
    stations: DataFrame,
    exclude: Sequence[str] = (),
    length_km: float = LENGTH_KM,
    power: float = WIND_POWER,
    value: str = "pm25_clean",
    held_out: DataFrame | None = None,
) -> DataFrame:
    """Add nbr_pm25_wind, nbr_pm25_dist and nbr_count from the values of the same hour.

    ``held_out`` (one column of that name) gives every row once for each of these stations, which then
    has no part in the row's neighbourhood; the sums are made once for all.
    """
    hoods = Neighbourhoods(base, stations, exclude, length_km, power, value)
    out, mine = hoods.frame(), hoods.counts(value)
    if held_out is not None:
        out = staged(out, "neighbour-sums")
        cases = held_out.select("held_out").distinct()
        out = hoods.less(every(out, cases))
        mine = mine & (F.col("station_id") != F.col("held_out"))
    return hoods.features(out, mine)


def edge_table(
    stations: DataFrame, wind_from: float = 315.0, length_km: float = LENGTH_KM, power: float = WIND_POWER, top: int = 15
) -> DataFrame:
    """Strongest edges under one wind direction, for inspection.

    An edge weighs at most its decay, so once ``top`` edges outweigh the decay at a radius, no longer edge can be among
    them; the radius doubles until that holds.
    """
    names = stations.select("station_id", "name")
    weight = F.col("decay") * upwind_share(F.lit(wind_from), F.col("bearing"), power)
    radius, whole = length_km, math.pi * 6372.0
    while True:
        met = edges(stations, length_km, min(radius, whole)).withColumn("w", weight)
        if radius >= whole or met.where(F.col("w") > math.exp(-radius / length_km) + 1e-4).limit(top).count() == top:
            break
        radius *= 2
    best = met.where(F.col("w") > 0).orderBy(F.desc(F.round("w", 4)), "receptor", "neighbour").limit(top)
    return (
        best.join(names.select(F.col("station_id").alias("receptor"), F.col("name").alias("receptor_name")), "receptor")
        .join(names.select(F.col("station_id").alias("neighbour"), F.col("name").alias("neighbour_name")), "neighbour")
        .select(
            F.col("receptor_name").alias("receptor"), F.col("neighbour_name").alias("upwind_neighbour"),
            F.round("km", 1).alias("distance_km"), F.round("bearing", 0).alias("bearing_deg"), F.round("w", 4).alias("weight"),
        )
    )


def grid_frame(stations: DataFrame, cells: DataFrame) -> DataFrame:
    """Grid cells with the distance to, and the id of, the nearest station."""
    points = cells.select("lat", "lon", F.concat_ws("/", "lat", "lon").alias("cell"),
                          F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon"))
    sites = stations.select(F.col("station_id").alias("nearest_station"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    return nearest(points, sites, "cell", "nearest_station").select(
        "lat", "lon", F.round("km", 2).alias("distance_to_station_km"), "nearest_station"
    )


def surface(
    values: DataFrame, stations: DataFrame, cells: DataFrame, value: str = "pm25", wind: str = "wind_from_deg",
    length_km: float = LENGTH_KM, power: float = WIND_POWER,
) -> DataFrame:
    """Spread station values over grid cells, for any number of hours at once.

    ``values`` has station_id, time, value and the hour's wind. Where no station lies
    upwind the distance weighting is used. Every hour of ``values`` yields every cell.
    """
    at = places_of(stations)
    points = at.select("place", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), "stations").distinct()
    grid_ = cells.select(F.struct("lat", "lon").alias("receptor"), F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon"))
    near, far = links(grid_, points, length_km)
    good = values.where(_usable(value)).join(broadcast_checked(at.select("station_id", "place")), "station_id")
    good = good.repartition("time")
    per = good.groupBy("time", "place").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    winds = every(good.groupBy("time").agg(F.max(wind).alias("wind")), grid_.select("receptor")).withColumn("point", F.lit(0))
    # a station on a grid point itself weighs 1, from the north
    here = points.select(F.struct(F.col("r_lat").alias("lat"), F.col("r_lon").alias("lon")).alias("receptor"), "place")
    here = per.join(here, "place").select("time", "receptor", F.col("n").alias("_n"), F.col("total").alias("_t"))
    sums = winds.join(kernel_sums(per, winds, near, far, power), ["time", "receptor", "point"], "left").join(here, ["time", "receptor"], "left")
    share = upwind_share(F.col("wind"), F.lit(0.0), power)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    d, dv = zero("d") + zero("_n"), zero("dv") + zero("_t")
    u, uv = zero("u") + zero("_n") * share, zero("uv") + zero("_t") * share
    idw = F.when(F.col("d").isNotNull() | F.col("_n").isNotNull(), dv / F.greatest(d, F.lit(FLOOR)))
    out = sums.select(
        "time", "receptor.lat", "receptor.lon", F.col("wind").alias("wind_from_deg"), idw.alias("pm25_idw"),
        F.when(u > WIND_FLOOR, uv / F.greatest(u, F.lit(FLOOR))).otherwise(idw).alias("pm25"),
    ).where(F.col("pm25_idw").isNotNull())
    return every(values.select("time").distinct(), cells.select("lat", "lon")).join(out, ["time", "lat", "lon"], "left")


#: Parts that the second table of ``every`` is dealt into.
PARTS = 16


def every(hours: DataFrame, points: DataFrame) -> DataFrame:
    """All rows of ``hours`` with all rows of ``points``, the stated output of a surface, part by part of the points."""
    part = F.pmod(F.xxhash64(*points.columns), F.lit(PARTS))
    return hours.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))).join(
        points.withColumn("_part", part), "_part"
    ).drop("_part")


def surface_for_hour(base: DataFrame, when, stations: DataFrame, cells: DataFrame, value: str = "pm25_clean") -> DataFrame:
    """Surface from the observations of one hour under its mean wind (0 when unknown)."""
    hour = base.where(F.col("time") == F.lit(when).cast("timestamp"))
    if hour.isEmpty():
        raise ValueError(f"no rows at {when}")
    return surfaces(hour, stations, cells, value)


def surfaces(base: DataFrame, stations: DataFrame, cells: DataFrame, value: str = "pm25_clean", circular: bool = False) -> DataFrame:
    """Surfaces for every hour of ``base``, under its mean wind (of vectors with ``circular``)."""
    wind = base.groupBy("time").agg(F.coalesce(mean_direction(WIND_COL, circular), F.lit(0.0)).alias("wind_from_deg"))
    rows = base.select("station_id", "time", F.col(value).alias("pm25")).join(wind, "time")
    return surface(staged(rows, "surface-values"), stations, cells).join(grid_frame(stations, cells), ["lat", "lon"])


def domain_grid(spark, cfg) -> DataFrame:
    return grid(spark, *cfg.bbox, cfg.grid_step)


__all__ = [
    "domain_grid", "edge_table", "edges", "every", "geometry", "grid_frame", "haversine_km", "in_reach", "kernel_means", "kernel_sums", "links", "Neighbourhoods",
    "negligible_beyond", "neighbour_features", "places_of", "surface", "surface_for_hour", "surfaces", "upwind_share",
]
