"""Near duplicates by SimHash: meet-in-the-middle ball hashing, and groups of linked documents."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skycast.session import cut, staged

from .common import fresh, on_workers, read

SHINGLE, SEED, RADIUS = 4, 42, 4
BITS = 64
#: Variants are dealt out by their first bits: a fingerprint goes once to each prefix in its reach.
PREFIXES = (8, 12, 16, 20, 24)
#: Fingerprints that one prefix should get at most, on average.
PER_PREFIX = 60_000
#: Variants that one step of a task holds at once, about (16 bytes each).
AT_ONCE = 4_000_000


def fingerprint(text: str, size: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the whole text: A-Z lower-cased, words between ASCII white space, shingles of
    ``size`` words joined by a space, each as often as it occurs; a bit is set if it is set in more than
    half the shingles' XXH64. Fewer words are one shingle, no words give 0."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    total, n = np.zeros(BITS, np.int64), len(words) - size + 1
    for at in range(0, n, 65_536):  # bounded memory for the longest text
        some = slice(at, min(n, at + 65_536))
        pairs = zip(begins[some].tolist(), ends[some.start + size - 1 : some.stop + size - 1].tolist())
        h = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in pairs], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * total > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, name: str = "simhash", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Adds the fingerprint as a signed long; a null text counts as empty, a column of that name is replaced."""
    on_workers(docs.sparkSession)
    docs = docs.drop(name)
    at = docs.columns.index("text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(t or "", size, seed) for t in b.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made)], [*b.schema.names, name])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def _masks(bits: range, most: int) -> np.ndarray:
    """All masks of up to ``most`` of the given bits."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(bits, k)], np.uint64)


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def prefix_bits(n: int, radius: int = RADIUS) -> int:
    """The first bits to deal ``n`` fingerprints out by. Only the size of the groups depends on it."""
    load = lambda bits: n * len(_masks(range(bits), radius // 2)) / 2**bits
    return next((b for b in PREFIXES if load(b) <= PER_PREFIX), PREFIXES[-1])


def reached(fingerprints: DataFrame, bits: int, radius: int = RADIUS) -> DataFrame:
    """From fp (distinct longs) to (prefix, fp): each fingerprint with the prefixes of its variants within half the radius."""
    moves = [int(m) for m in _masks(range(bits), radius // 2)]
    own = F.shiftrightunsigned("fp", BITS - bits)
    return fingerprints.select(F.explode(F.transform(F.array(*map(F.lit, moves)), lambda m: own.bitwiseXOR(m))).alias("prefix"), "fp")


def collide(fps: np.ndarray, prefix: int, bits: int, radius: int = RADIUS) -> np.ndarray:
    """Links (k x 2) between fingerprints that share a variant with this prefix: a forest with the groups of all
    that collide here.

    Every fingerprint makes its variants of this prefix; equal variants stand together after a sort, and
    each is linked to the one before it, after a check of their distance. Two fingerprints with a
    common variant within half the radius differ in at most ``radius`` bits, and any two that differ
    in so few have one.
    """
    half, low = radius // 2, BITS - bits
    fps = np.unique(fps.astype(np.uint64))
    away = _ones((fps >> np.uint64(low)) ^ np.uint64(prefix))
    base = (fps & np.uint64((1 << low) - 1)) | np.uint64(prefix << low)
    links = [np.empty((0, 2), np.uint64)]
    masks = [_masks(range(low), half - k) for k in range(half + 1)]
    # The masks in rounds by the variants' next bits would part equal variants, so rounds go by a hash of the variant.
    expected = sum(int((away == k).sum()) * len(masks[k]) for k in range(half + 1))
    rounds = max(1, -(-expected // AT_ONCE))
    for r in range(rounds):
        variants, sources = [], []
        for k in range(half + 1):
            who = np.flatnonzero(away == k)
            for some in np.array_split(who, max(1, len(who) * len(masks[k]) // AT_ONCE)):
                v = (base[some][:, None] ^ masks[k][None, :]).ravel()
                s = np.repeat(some.astype(np.uint32), len(masks[k]))
                if rounds > 1:
                    own = ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(rounds) == r
                    v, s = v[own], s[own]
                variants.append(v)
                sources.append(s)
        v, s = np.concatenate(variants), np.concatenate(sources)
        order = np.argsort(v)
        v, s = v[order], s[order]
        same = np.flatnonzero(v[1:] == v[:-1])
        if len(same):
            code = np.unique(np.sort(np.stack([s[same], s[same + 1]], 1), axis=1).astype(np.uint64) @ np.array([1 << 32, 1], np.uint64))
            pair = np.stack([fps[(code >> np.uint64(32)).astype(np.int64)], fps[(code & np.uint64(0xFFFFFFFF)).astype(np.int64)]], 1)
            pair = pair[_ones(pair[:, 0] ^ pair[:, 1]) <= radius]
            links.append(pair)
    return forest(np.concatenate(links))


def forest(links: np.ndarray) -> np.ndarray:
    """One link from each fingerprint to the smallest of its group, for the groups that the links join."""
    if not len(links):
        return links
    nodes, at = np.unique(links, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = np.minimum(new, new[new])[label]
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([nodes[moved], nodes[label[moved]]], 1)


def linked(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that join all fingerprints within ``radius`` of each other, directly or through others.

    Input: distinct longs ``fp``, read twice. What is shuffled is each fingerprint once per prefix in reach
    (37 with 8 bits and a radius of 4), not its 2,081 variants; those are made, sorted and dropped in
    the task that holds their prefix. Fingerprints are hashes and each stands once, so no prefix is hot.
    """
    on_workers(fingerprints.sparkSession)
    bits = prefix_bits(fingerprints.count(), radius)

    def solve(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        fps = np.asarray(table["fp"].combine_chunks()).view(np.uint64)
        got = collide(fps, int(key[0].as_py()), bits, radius).view(np.int64)
        return pa.table({"a": pa.array(got[:, 0]), "b": pa.array(got[:, 1])})

    return reached(fingerprints, bits, radius).groupBy("prefix").applyInArrow(solve, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root: every node of the links (a, b) with the smallest node it reaches.

    Large-star and small-star steps in turn, until nothing moves: the rounds grow with the logarithm of
    the longest path. Smallest neighbours are combined before the shuffle, and a node with very
    many neighbours is split by the skew join. Each round is written to the shared folder.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # large star: each node's larger neighbours move to the smallest of it and its neighbours
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: each node and its smaller neighbours move to the smallest of these
        large = large.where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_least, "u")
        new = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = cut(new)
        if new.count() == edges.count() and new.exceptAll(edges).isEmpty():
            return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = new


def near_groups(docs: DataFrame, size: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that is reached, itself included) for every row.

    Equal fingerprints are one node, so copies cost one row each. Empty and null texts have
    fingerprint 0 and are linked like any other. A null doc_id belongs to its group but never names it,
    unless all ids of the group are null; repeated rows give repeated rows, an empty table none.
    """
    return _grouped(docs, size, seed, radius).select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame, size: int, seed: int, radius: int) -> DataFrame:
    """``near_groups`` with ``root``, the fingerprint that names the group: two groups may have one component_id if ids repeat."""
    own = staged(with_fingerprint(docs.select("doc_id", "text"), "fp", size, seed).drop("text"), "simhash")
    nodes = staged(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = components(linked(nodes.select("fp"), radius))
    # one row per fingerprint, then per group of fingerprints, then back: documents meet only their fingerprint's row
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = staged(named, "simhash-roots")
    group = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = named.join(group, "root").select("fp", "root", "component_id")
    return own.join(by_fp.hint("shuffle_merge"), "fp").select("doc_id", "fp", "root", "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents with the smallest id of their group, all columns as they were; of a group's rows that repeat that id, one.

    Rows with a null doc_id stay only if no row of their group has one, and then all of them do. An id
    whose rows have different fingerprints is looked up by its fingerprints, any other by itself.
    """
    groups = _grouped(docs, size, SEED, radius)
    name, many, print_, root, tie = (fresh(docs, n) for n in ("first", "many", "fp", "root", "tie"))
    names_it = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = groups.groupBy(F.col("doc_id").alias(name)).agg((F.min("fp") < F.max("fp")).alias(many), F.bool_or(names_it).alias(tie)).where(F.col(tie)).drop(tie)
    one = docs.join(ids.where(~F.col(many)), F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")
    null = one.where(F.col("doc_id").isNull())
    one = one.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]).unionByName(null)
    # ids with different texts
    odd = with_fingerprint(docs.join(ids.where(many), F.col("doc_id").eqNullSafe(F.col(name)), "left_semi"), print_, size, SEED)
    first = groups.where(names_it).select(F.col("doc_id").alias(name), F.col("fp").alias(many), F.col("root").alias(root)).distinct()
    odd = odd.join(first, F.col("doc_id").eqNullSafe(F.col(name)) & (F.col(print_) == F.col(many)))
    odd = odd.withColumn(tie, F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    return one.unionByName(odd.dropDuplicates([root, "doc_id", tie]).select(*docs.columns))


def op5_simhash_groups(spark: SparkSession, sf: str) -> DataFrame:
    groups = near_groups(read(spark, sf, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
