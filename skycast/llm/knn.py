"""Exact top-k search by inner product: a Voronoi join of query groups and data groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skycast.session import staged

from .common import on_workers, read

#: Pivots of the data, chosen from at most PIVOT_SAMPLE vectors; query groups around the first QUERY_PIVOTS of them.
PIVOTS, QUERY_PIVOTS, PIVOT_SAMPLE = 64, 16, 2_000
#: Queries and data vectors that one task compares at once, about.
QUERY_BLOCK, DATA_BLOCK = 512, 4_096
#: Relative slack for rounding in the bounds, which only prune; scores are exact.
SLACK = 1e-9
SCALE = 1024


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and ``v``, the components as floor(scale * x) in doubles; rows that are null or hold null or non-finite components go."""
    good = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    return vectors.where(good).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, width) if len(column) else np.empty((0, width))


def pick_pivots(vectors: DataFrame, n: int = PIVOTS, most: int = PIVOT_SAMPLE) -> np.ndarray:
    """Pivots from a bounded sample, each the vector farthest from the pivots before it (ties: smaller id). Only speed depends on them."""
    total = vectors.count()
    few = vectors
    if total > most:
        few = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit("pivot")), F.lit(2**31)) < int(most / total * 2**31))
    x = np.array([r.v for r in few.orderBy("vec_id").limit(2 * most).collect()], float)
    if not len(x):
        return x
    out, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(out) < n and far.max() > 0:
        out.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[out[-1]]) ** 2).sum(1))
    return x[out]


def _grouped(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds the nearest pivot's number (ties: the first), the distance to it and the norm."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (pivots**2).sum(1) / 2
        for b in batches:
            x = _matrix(b.column(1), pivots.shape[1])
            g = (x @ pivots.T - half).argmax(1)
            d = np.sqrt(((x - pivots[g]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(g, pa.int32()), pa.array(d), pa.array(np.sqrt((x**2).sum(1)))], ["vec_id", "v", "g", "d", "norm"])

    return vectors.select("vec_id", "v").mapInArrow(near, "vec_id long, v array<double>, g int, d double, norm double")


def join_plan(data: DataFrame, queries: DataFrame, pivots: np.ndarray, centres: np.ndarray, k: int) -> dict[int, list[tuple[int, float]]]:
    """Which data each query group needs: data group -> (query group, least distance from the pivot).

    Summaries are a few numbers per group: the k + 1 smallest and the largest distance of the
    data (one more than k, as a query is not its own neighbour), the radius and count of the queries.
    For a query q = c + e with |e| <= r and a vector x = p + f with |f| = d:
    q.x = c.p + e.p + c.f + e.f lies within r|p| + |c|d + rd of c.p. A group's threshold is the
    k-th largest of the lower bounds that the summaries prove for k other vectors.
    """
    first = W.partitionBy("g").orderBy("d", "vec_id")
    nearest = data.select("g", "d", "vec_id").withColumn("i", F.row_number().over(first)).where(F.col("i") <= k + 1).select("g", "d").collect()
    size = {r.g: r.far for r in data.groupBy("g").agg(F.max("d").alias("far")).collect()}
    radius = {r.g: r.far for r in queries.groupBy("g").agg(F.max("d").alias("far")).collect()}
    norm_p, out = np.sqrt((pivots**2).sum(1)), {}
    gs, ds = np.array([r.g for r in nearest], int), np.array([r.d for r in nearest], float)
    for q, r in radius.items():
        c = centres[q]
        dot, norm_c = pivots @ c, float(np.sqrt(c @ c))
        low = dot[gs] - r * norm_p[gs] - (norm_c + r) * ds
        bound = np.sort(low)[::-1][k] if len(low) > k else -np.inf  # the query itself may be one of them
        bound -= SLACK * (1 + abs(bound)) if np.isfinite(bound) else 0
        for g, far in size.items():
            spare = bound - dot[g] - r * norm_p[g]
            least = spare / (norm_c + r) if norm_c + r > 0 else (np.inf if spare > 0 else -np.inf)
            if least * (1 - SLACK) - SLACK <= far:
                out.setdefault(g, []).append((q, float(max(-1.0, least * (1 - SLACK) - SLACK)) if np.isfinite(least) else -1.0))
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` largest inner products, ties to the smaller vec_id.

    Both inputs: vec_id and ``v``, arrays of whole numbers as doubles, all of one length (see
    ``whole_vectors``; products must stay below 2 ** 53). A row is not compared with the row of the query's own id. Ids
    should be unique: rows that repeat an id with equal vectors appear as often. An empty side gives an empty result.

    Data goes only to the query groups whose threshold it can reach, split into blocks by a
    hash of its id, so that neither a hot vector nor a hot cell fills a task; each block keeps
    the best k per query, and the blocks' results are ranked with the limit applied before the shuffle.
    """
    spark = vectors.sparkSession
    on_workers(spark)
    schema = "query_id long, rank int, vec_id long, score long"
    picked = pick_pivots(vectors, pivots)
    if not len(picked):
        return spark.createDataFrame([], schema)
    centres, width = picked[:QUERY_PIVOTS], picked.shape[1]
    data, asked = staged(_grouped(vectors, picked), "knn-data"), staged(_grouped(queries, centres), "knn-queries")
    plan = join_plan(data, asked, picked, centres, k)
    wanted = F.create_map(*[c for g, to in sorted(plan.items()) for c in (F.lit(g), F.array(*(F.struct(F.lit(q).alias("q"), F.lit(x).alias("least")) for q, x in to)))]) if plan else None
    if wanted is None:
        return spark.createDataFrame([], schema)
    counts = {r.g: r["count"] for r in asked.groupBy("g").count().collect()}
    blocks = max(1, -(-data.count() // DATA_BLOCK))
    splits = max(1, -(-max(counts.values()) // QUERY_BLOCK))
    # data: once per query group that needs it; the splits of a query group read the same blocks
    sent = (
        data.withColumn("to", F.explode(F.filter(wanted[F.col("g")], lambda t: t["least"] <= F.col("d"))))
        .withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
        .select(F.col("to.q").alias("q"), "split", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v")
    )
    asking = asked.select(
        F.col("g").alias("q"), F.pmod(F.xxhash64("vec_id", F.lit("split")), F.lit(splits)).cast("int").alias("split"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v",
    )

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        made: list[list[np.ndarray]] = [[], [], []]
        if left.num_rows and right.num_rows:
            ids = np.asarray(right["vec_id"].combine_chunks())
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], _matrix(right["v"].combine_chunks(), width)[order]
            q_ids, q = np.asarray(left["vec_id"].combine_chunks()), _matrix(left["v"].combine_chunks(), width)
            for at in range(0, len(q_ids), QUERY_BLOCK):
                scores = q[at : at + QUERY_BLOCK] @ x.T
                for own, s in zip(q_ids[at : at + QUERY_BLOCK], scores):
                    s[ids == own] = -np.inf
                    # ids ascend, so a stable sort gives ties to the smaller id
                    floor = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf
                    best = np.flatnonzero((s >= floor) & np.isfinite(s))
                    best = best[np.argsort(-s[best], kind="stable")][:k]
                    for c, v in zip(made, (np.full(len(best), own), ids[best], s[best].astype(np.int64))):
                        c.append(v)
        cols = [np.concatenate(c).astype(np.int64) if c else np.empty(0, np.int64) for c in made]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), cols)))

    keys = ["q", "split", "block"]
    local = asking.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(lambda a, b: solve(a, b), "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_voronoi_top_k(spark: SparkSession, sf: str) -> DataFrame:
    vectors = whole_vectors(read(spark, sf, "embeddings"))
    return top_k(vectors, vectors.where(F.pmod("vec_id", F.lit(100)) == 0), k=10)


#: The same by brute force.
SQL = """
WITH x AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
  FROM x q JOIN x d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
