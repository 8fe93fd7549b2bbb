"""The manifest against a tree built one node at a time, at sizes around runs and windows, and on odd rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from skycast.llm import common, merkle

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """(root, siblings as (left, right) per level of every node)."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(place):
            run = p - p % 8
            paths[i].append(("".join(nodes[run:p]), "".join(nodes[p + 1 : run + 8])))
        place = [p // 8 for p in place]
        nodes = [h("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows, lower=lambda i: False):
    """doc_id, leaf -> what the manifest must hold; ids are distinct here."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    parts = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0])) for x in langs}
    made = {x: tree([leaf(r) for r in parts[x]]) for x in langs}
    root, tops = tree([made[x][0] for x in langs])
    out = {}
    for x, top in zip(langs, tops):
        for r, path in zip(parts[x], made[x][1]):
            path = path + top
            text = None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
            folded = leaf((*r[:4], text)) if lower(r[0]) else leaf(r)
            for a, b in path:
                folded = h(a + folded + b)
            out[r[0]] = (leaf(r), made[x][0], root, h("".join(a + b for a, b in path)), folded, folded == root)
    return out


def rows_of(n, langs, seed=0):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", "Some Text", "lower only", "ÄÖ Ünïçode 日本 ABC", "x" * 3000])
    ids = rng.sample(range(10 * n), n)
    return [(i, rng.choice([None, "src"]), rng.choice(langs), rng.choice([None, 7]), text()) for i in ids]


@pytest.mark.parametrize("n,langs", [(1, ["en"]), (8, ["en"]), (9, [None]), (700, ["en"] * 8 + [None, "de", "ß", ""]), (1200, [f"l{k}" for k in range(11)] + ["en"] * 30)])
def test_manifest_is_the_tree_built_node_by_node(spark, tmp_path, n, langs):
    rows = rows_of(n, langs)
    spark.createDataFrame(rows, COLUMNS).withColumn("at", F.lit(1)).withColumn("Path", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    got = merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()
    want = brute(rows, lambda i: zlib.crc32(str(i).encode()) % 3 == 0)
    assert len(got) == n
    assert {r.doc_id: tuple(r)[1:] for r in got} == want
    assert all(r.verified for r in got if zlib.crc32(str(r.doc_id).encode()) % 3)
    if n > 100:
        assert not all(r.verified for r in got)


def test_small_windows_climb_many_passes(spark):
    rows = rows_of(600, ["en", "en", "en", "de"], 3)
    docs = spark.createDataFrame(rows, COLUMNS)
    leaves = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("g"), merkle.leaf([F.col(c) for c in merkle.FIELDS]).alias("v"))
    done, tops = merkle.trees(common.ordered(leaves, ["g"], ["doc_id"], "i", "n"), "g", "i", "n", "v", levels=1)
    got = {r.doc_id: ([tuple(p) for p in r.path], r.top) for r in done.collect()}
    for g in ("en", "de"):
        own = sorted(r for r in rows if r[2] == g)
        root, paths = tree([leaf(r) for r in own])
        assert {r[0]: (p, root) for r, p in zip(own, paths)} == {r[0]: got[r[0]] for r in own}
        assert [r.v for r in tops.where(F.col("g") == g).collect()] == [root]


def test_repeats_nulls_and_nothing(spark):
    rows = [(None, None, None, None, None)] * 3 + [(5, "s", "en", 1, "T")] * 20 + [(5, "s", "en", 1, "u"), (None, "s", "en", 1, "v")]
    got = merkle.manifest(spark.createDataFrame(rows, COLUMNS)).collect()
    assert len(got) == 25 and all(r.verified for r in got)
    none = [r for r in got if r.leaf == leaf((None,) * 5)]
    assert len(none) == 3 and {r.subroot for r in none} == {h(leaf((None,) * 5) * 3)}
    en = sorted([leaf(rows[3])] * 20 + [leaf(rows[23])])
    assert {r.subroot for r in got if r.leaf in en} == {tree([leaf(rows[24]), *en])[0]}
    empty = merkle.manifest(spark.createDataFrame([], COLUMNS))
    assert empty.count() == 0 and len(empty.columns) == 7


def test_one_changed_row_is_the_only_one_found(spark):
    rows = rows_of(80, ["en", "de"], 5)
    victim = next(r[0] for r in rows if r[4] == "Some Text")
    docs = spark.createDataFrame(rows, COLUMNS)
    changed = F.when(F.col("doc_id") == victim, F.lit("Some text")).otherwise(F.col("text"))
    assert [r.doc_id for r in merkle.manifest(docs, tampered=changed).where(~F.col("verified")).collect()] == [victim]


def test_order_is_numbered_over_many_ranges(spark):
    rows = [(k % 3 if k % 7 else None, k * 37 % 1000, "a") for k in range(1000)]
    df = spark.createDataFrame(rows, "k long, v long, part string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = common.ordered(df, ["k"], [F.desc("v")], "i", "n").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    for k in (None, 0, 1, 2):
        own = sorted((r for r in got if r.k == k), key=lambda r: r.i)
        assert [r.i for r in own] == list(range(len(own))) and {r.n for r in own} == {len(own)}
        assert [r.v for r in own] == sorted((r.v for r in own), reverse=True)
