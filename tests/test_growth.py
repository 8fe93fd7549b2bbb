"""Operators whose work must not grow with one group, one task or the square of the input, against brute force."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skycast.functions import geo
from skycast.operators import matching, neighbours, quality
from skycast.operators.quantiles import exact_quantiles

from .conftest import T0, by, hours


def km(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * geo.EARTH_KM * math.asin(math.sqrt(min(1.0, h)))


def bearing(a, b):
    dl, la, lb = math.radians(b[1] - a[1]), math.radians(a[0]), math.radians(b[0])
    y, x = math.sin(dl) * math.cos(lb), math.cos(la) * math.sin(lb) - math.sin(la) * math.cos(lb) * math.cos(dl)
    return (math.degrees(math.atan2(y, x)) + 360) % 360


# -- nearest site -------------------------------------------------------------
def sites_of(n, seed, dense=0):
    rng = random.Random(seed)
    spread = [(f"s{k:05d}", rng.uniform(-60, 60), rng.uniform(-179, 179)) for k in range(n)]
    return spread + [(f"t{k:05d}", 28.6 + rng.uniform(-0.05, 0.05), 77.2 + rng.uniform(-0.05, 0.05)) for k in range(dense)]


def test_nearest_site_in_a_tree_that_follows_the_sites(spark):
    sites = sites_of(120, 1, dense=300) + [("u1", 28.6, 77.2), ("u0", 28.6, 77.2)]
    rng = random.Random(2)
    points = [(f"p{k}", rng.uniform(-89, 89), rng.uniform(-180, 180)) for k in range(60)]
    points += [(f"q{k}", 28.6 + rng.uniform(-0.2, 0.2), 77.2 + rng.uniform(-0.2, 0.2)) for k in range(60)] + [("r", 28.6, 77.2), ("pole", 90.0, 0.0)]
    left = spark.createDataFrame(points, "id string, l_lat double, l_lon double")
    right = spark.createDataFrame(sites, "site string, r_lat double, r_lon double")
    got = by(geo.nearest(left, right, "id", "site"), "id")
    for p, lat, lon in points:
        best = min((round(km((lat, lon), s[1:]), 9), s[0]) for s in sites)
        assert abs(got[p]["km"] - best[0]) < 1e-6 and got[p]["site"] == best[1], p
    met = geo.candidates(left, right, geo._sphere(F.col("l_lat"), F.col("l_lon")), geo._sphere(F.col("r_lat"), F.col("r_lon")), -1.0, 2.0, "id")
    most = max(r["count"] for r in met.groupBy("id").count().collect())
    assert most <= 8 * geo.LEAF < len(sites) / 3


def test_nearest_other_position_and_no_sites(spark):
    sites = sites_of(60, 3, dense=60)
    right = spark.createDataFrame(sites, "site string, r_lat double, r_lon double")
    left = right.toDF("id", "l_lat", "l_lon")
    got = by(geo.nearest(left, right, "id", "site", apart=True), "id")
    for s in sites:
        assert abs(got[s[0]]["km"] - min(km(s[1:], t[1:]) for t in sites if t is not s)) < 1e-6
    assert {r["km"] for r in geo.nearest(left, right.limit(0), "id", "site").collect()} == {None}
    assert geo.nearest(left.limit(1), right.limit(1).withColumn("r_lat", F.lit(5.0)), "id", "site").count() == 1


# -- kernel sums --------------------------------------------------------------
def plain_kernel(base, at, exclude=()):
    """(station, hour) -> (wind, dist, count) over all pairs."""
    out = {}
    for t in {r[1] for r in base}:
        rows = [r for r in base if r[1] == t]
        winds = [r[3] for r in rows if r[3] is not None]
        mean = sum(winds) / len(winds) if winds else None
        used = [r for r in rows if r[2] is not None and r[0] not in exclude]
        for s, _, _, w in rows:
            w = mean if w is None else w
            d = dv = u = uv = 0.0
            others = [r for r in used if r[0] != s]
            for r in others:
                k = math.exp(-km(at[s], at[r[0]]) / 15)
                b = bearing(at[s], at[r[0]]) if at[s] != at[r[0]] else 0.0
                x = k * max(math.cos(math.radians(w - b)), 0) ** 2 if w is not None else 0.0
                d, dv, u, uv = d + k, dv + k * r[2], u + x, uv + x * r[2]
            out[s, t] = (uv / max(u, 1e-9) if u > 1e-6 else None, dv / max(d, 1e-9) if others else None, len(used))
    return out


def network(n, seed, side=3.0):
    rng = random.Random(seed)
    at = {f"S{k:03d}": (28 + rng.uniform(0, side), 77 + rng.uniform(0, side)) for k in range(n)}
    at |= {"TWIN": at["S000"], "FAR": (22.0, 77.0)}
    rows = [(s, t, None if rng.random() < 0.3 else rng.uniform(5, 900), None if rng.random() < 0.2 else rng.uniform(0, 360)) for s in at for t in hours(4)]
    rows += [("FAR", hours(5)[4], 50.0, 10.0), ("S001", hours(5)[4], 400.0, 200.0)]
    return at, rows


def frames(spark, at, rows):
    return (
        spark.createDataFrame(rows, "station_id string, time timestamp, pm25_clean double, met_wind_direction_10m double"),
        spark.createDataFrame([(s, s, *p) for s, p in at.items()], "station_id string, name string, lat double, lon double"),
    )


def close(a, b):
    return a is b is None or (a is not None and b is not None and abs(a - b) <= 1e-6 + 1e-9 * abs(b))


@pytest.mark.parametrize("exclude", [(), ("S002", "TWIN")])
def test_kernel_equals_all_pairs_also_where_the_nearest_are_silent(spark, exclude):
    at, rows = network(25, 4)
    base, stations = frames(spark, at, rows)
    got = by(neighbours.neighbour_features(base, stations, exclude), "station_id", "time")
    want = plain_kernel(rows, at, exclude)
    for k, (wind, dist, n) in want.items():
        assert close(got[k]["nbr_pm25_wind"], wind) and close(got[k]["nbr_pm25_dist"], dist) and got[k]["nbr_count"] == n, k


def test_far_links_are_used_only_where_they_matter(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "in_reach", lambda *a: 3.0)  # near: 45 km beyond the nearest
    at, rows = network(25, 5)
    base, stations = frames(spark, at, rows)
    got = by(neighbours.neighbour_features(base, stations), "station_id", "time")
    for k, (wind, dist, _) in plain_kernel(rows, at).items():
        assert close(got[k]["nbr_pm25_wind"], wind) and close(got[k]["nbr_pm25_dist"], dist), k


def test_a_held_out_station_is_taken_from_the_sums(spark):
    at, rows = network(12, 6)
    base, stations = frames(spark, at, rows)
    cases = ["S000", "S003", "FAR"]
    got = by(neighbours.neighbour_features(base, stations, held_out=spark.createDataFrame([(c,) for c in cases], "held_out string")), "held_out", "station_id", "time")
    for c in cases:
        for (s, t), (wind, dist, n) in plain_kernel(rows, at, (c,)).items():
            r = got[c, s, t]
            assert close(r["nbr_pm25_wind"], wind) and close(r["nbr_pm25_dist"], dist) and r["nbr_count"] == n, (c, s, t)
    assert len(got) == len(cases) * len(rows)


def test_links_grow_linearly_at_fixed_density(spark):
    def near(n_lat, n_lon):
        points = [(f"{i}/{j}", 40.0 + 1.5 * i, 2.0 * j - 100, 1) for i in range(n_lat) for j in range(n_lon)]
        places = spark.createDataFrame(points, "place string, r_lat double, r_lon double, stations long")
        links, far = neighbours.links(places.toDF("receptor", "l_lat", "l_lon", "s").drop("s"), places)
        return links.count() / len(points), far

    few, _ = near(3, 40)
    many, far = near(3, 80)  # one band; ten times the sites of a band of eight
    alone, _ = near(3, 8)
    assert many < 1.1 * few < 2.5 * alone and far is not None


def test_surface_equals_all_pairs(spark):
    at, rows = network(15, 7, side=0.8)
    base, stations = frames(spark, at, rows)
    cells = [(28.0, 77.0), (28.4, 77.4), at["S004"], (31.0, 80.0)]
    got = by(neighbours.surfaces(base, stations, spark.createDataFrame(cells, "lat double, lon double")), "time", "lat", "lon")
    assert len(got) == 5 * len(cells)
    for t in hours(5):
        now = [r for r in rows if r[1] == t]
        winds = [r[3] for r in now if r[3] is not None]
        w = sum(winds) / len(winds) if winds else 0.0
        for c in cells:
            k = [(math.exp(-km(c, at[r[0]]) / 15), bearing(c, at[r[0]]) if c != at[r[0]] else 0.0, r[2]) for r in now if r[2] is not None]
            d, dv = sum(x for x, _, _ in k), sum(x * v for x, _, v in k)
            u = [(x * max(math.cos(math.radians(w - b)), 0) ** 2, v) for x, b, v in k]
            idw = dv / max(d, 1e-9)
            wind = sum(x * v for x, v in u) / sum(x for x, _ in u) if sum(x for x, _ in u) > 1e-6 else idw
            assert close(got[t, *c]["pm25_idw"], idw) and close(got[t, *c]["pm25"], wind)


# -- runs ---------------------------------------------------------------------
def plain_runs(rows, step=True, at_repeat=False):
    out, last, run = {}, None, []

    def close_run():
        for t, rep in run:
            out[t] = (rep, run[0][0], len(run))

    for t, v in rows:
        rep = last is not None and v is not None and v == last[1] and (not step or t - last[0] == dt.timedelta(hours=1))
        if run and (rep if at_repeat else not rep):
            close_run()
            run = []
        run.append((t, rep))
        last = (t, v)
    close_run()
    return out


@pytest.mark.parametrize("step,at_repeat", [(True, False), (False, False), (False, True)])
def test_runs_cross_any_number_of_stretches(spark, step, at_repeat):
    rng = random.Random(8)
    series = {}
    for s in ("a", "b", "c"):
        rows, t = [], T0 + dt.timedelta(hours=rng.randint(0, 40))
        for _ in range(40):
            v = rng.choice([1.0, 2.0, None])
            for _ in range(rng.choice([1, 1, 2, 7, 30, 80])):
                rows.append((t, v))
                t += dt.timedelta(hours=1 if rng.random() < 0.97 else 3)
        series[s] = rows
    series["d"] = [(T0, 5.0)]
    df = spark.createDataFrame([(s, t, v, "x") for s, rows in series.items() for t, v in rows], "station_id string, time timestamp, v double, run_first string")
    got = quality.run_lengths(df, F.col("v"), 3600 if step else None, at_repeat, stretch_days=1)
    got = {(r["station_id"], r["time"]): (r["run_repeat"], r["run_first"], r["run_hours"]) for r in got.collect()}
    want = {(s, t): x for s, rows in series.items() for t, x in plain_runs(rows, step, at_repeat).items()}
    assert got == want
    assert any(n > 48 for _, _, n in want.values())


def test_a_stuck_run_is_found_across_a_border(spark):
    rows = [("a", t, 30.0 if 21 <= i < 28 else 100.0 + i, 1) for i, t in enumerate(hours(48))]
    df = spark.createDataFrame(rows, "station_id string, time timestamp, pm25 double, n_obs int")
    for days in (1, 120):
        flags = [r["quality_flag"] for r in quality.flag_quality(df, stretch_days=days).orderBy("time").collect()]
        assert [i for i, f in enumerate(flags) if f == "stuck"] == list(range(22, 28))
    assert quality.flag_quality(df.limit(0)).count() == 0


# -- quantiles ------------------------------------------------------------------
def test_quantiles_of_wide_values_without_large_brackets(spark):
    rng = np.random.default_rng(9)
    groups = {"wide": rng.normal(0, 1e9, 20_000), "tiny": rng.normal(0, 1e-9, 3_000), "tied": np.repeat([1.0, 1e12], [2_000, 1]), None: rng.exponential(5, 500)}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v], "g string, v double").repartition(4)
    probs = [0.0, 0.01, 0.5, 0.999, 1.0]
    for inside in (50, 3_000):
        got = by(exact_quantiles(df, ["g"], "v", probs, inside=inside), "g", "p")
        assert len(got) == len(groups) * len(probs)
        for g, v in groups.items():
            for p in probs:
                q = np.quantile(v, p)
                assert abs(got[g, p]["q"] - q) <= 1e-9 * max(1e-9, abs(q)) + 1e-18 and got[g, p]["n"] == len(v)


# -- matching -------------------------------------------------------------------
def plain_greedy(pairs):
    a, b, out = set(), set(), set()
    for _, x, y in sorted(pairs):
        if x not in a and y not in b:
            a.add(x)
            b.add(y)
            out.add((x, y))
    return out


def jobs(spark, make):
    before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    out = {(r[0], r[1]) for r in make().collect()}
    return out, spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - before


def test_chains_of_choices_take_no_more_jobs_when_longer(spark):
    counts = []
    for n in (10, 600):
        # every pair blocks the next: rounds would settle one pair each
        pairs = [(float(k), f"l{(k + 1) // 2}", f"r{k // 2}") for k in range(n)]
        df = spark.createDataFrame([(x, y, o) for o, x, y in pairs], "a string, b string, o double")
        got, took = jobs(spark, lambda: matching.greedy(df, "a", "b", [F.col("o")]).select("a", "b"))
        assert got == plain_greedy(pairs)
        counts.append(took)
    assert counts[0] == counts[1]


@pytest.mark.parametrize("at_once", [5, 40, 100_000])
def test_greedy_by_components_and_by_rounds_is_the_same(spark, at_once):
    rng = random.Random(10)
    pairs = list({(x, y): (rng.randint(0, 50), x, y) for x, y in ((f"l{rng.randint(0, 60)}", f"r{rng.randint(0, 60)}") for _ in range(90))}.values())
    df = spark.createDataFrame([(x, y, o) for o, x, y in pairs], "a string, b string, o int")
    got = {(r["a"], r["b"]) for r in matching.greedy(df, "a", "b", [F.col("o"), F.col("a"), F.col("b")], at_once).collect()}
    assert got == plain_greedy(pairs)
    assert matching.greedy(df.limit(0), "a", "b", [F.col("o")]).count() == 0


@pytest.mark.parametrize("at_once", [7, 1000])
def test_components_of_chains_and_stars(spark, at_once):
    rng = random.Random(11)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(500 + rng.randint(0, 9), 600 + rng.randint(0, 9)) for _ in range(12)]
    rng.shuffle(edges)
    up = {x: x for e in edges for x in e}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = matching.components(spark.createDataFrame(edges, "a long, b long"), at_once).collect()
    assert {r["node"]: r["component"] for r in got} == {x: root(x) for x in up}


def test_a_common_word_meets_no_one_who_has_a_rarer_one(spark):
    rng = random.Random(12)
    words = [f"word{k:03d}" for k in range(200)]
    cand = [(k, " ".join(["Common"] * (k % 3 == 0) + rng.sample(words, 3))) for k in range(300)]
    roster = [(f"S{k}", " ".join(["Common", *rng.sample(words, 2)]), "", k) for k in range(40)]
    roster += [(f"T{k}", cand[5 * k][1], "", 40 + k) for k in range(20)]
    df = spark.createDataFrame(roster, "station_id string, name string, city string, rank int")
    sets = spark.createDataFrame(cand, "candidate_id int, candidate_name string")
    from skycast.functions import names

    worded = sets.select(F.array_sort(names.tokens(F.col("candidate_name"))).alias("words"))
    got = {(r["station_id"], tuple(r["words"])) for r in matching.name_pairs(df, worded).collect()}
    clean = lambda t: frozenset(w for w in t.lower().split())
    want = {(s, tuple(sorted(clean(c)))) for s, n, _, _ in roster for _, c in cand if len(clean(n) & clean(c)) >= 0.55 * len(clean(n) | clean(c)) or clean(n) <= clean(c)}
    assert got == want
    out = matching.match_by_name(df, sets).collect()
    assert len({r["station_id"] for r in out}) == len(out) == len({r["candidate_id"] for r in out}) and len(out) >= 15
