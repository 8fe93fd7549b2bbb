"""Merkle manifest of a dataset: leaves, a tree per group, proofs, and their verification, by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skycast.session import staged

from .common import fresh, ordered, read

#: Children of a node.
FAN = 8
#: Levels that one pass of windows climbs: a window holds FAN ** LEVELS rows, never more.
LEVELS = 3
#: The columns of a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value; so no two rows read alike."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return digest(F.concat(*map(field, values)))


def folded_case(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def climb(nodes: DataFrame, group: str, at: str, count: str, value: str, fan: int = FAN, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """``levels`` levels of each group's tree: (nodes with their path, the nodes that result).

    ``at`` numbers the nodes of a group from 0 and ``count`` is their number. The windows cover
    fan ** levels consecutive nodes, so their size is fixed and runs never cross them. On level l
    a node's value stands on the first row below it (``at`` divisible by fan ** l); lag and lead at
    fixed multiples of that stride fetch its run, masked by its slot and the run's length; first
    children hash the run into the parent. Rows below get the siblings of the node above from the
    nearest first row. ``path`` is an array of (left, right) joined sibling digests, from the leaf
    upwards, of the levels on which the group still had several nodes. The second result has one row for each
    window, named as the first: group, at, count, value.
    """
    wide = fan**levels
    block, upper = fresh(nodes, "block"), "climb_value"
    rows = nodes.withColumn(block, F.expr(f"`{at}` div {wide}")).withColumn(upper, F.col(value))
    order = W.partitionBy(group, block).orderBy(at)
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    path = []
    for level in range(levels):
        stride = fan**level
        node = F.expr(f"`{at}` div {stride}")
        here = F.ceil(F.col(count) / stride)
        slot = node % fan
        run = F.least(F.lit(fan), here - node + slot)
        own = F.col(at) % stride == 0
        before = [F.when(F.lit(k) <= slot, F.lag(upper, k * stride).over(order)) for k in range(fan - 1, 0, -1)]
        after = [F.when(slot + k < run, F.lead(upper, k * stride).over(order)) for k in range(1, fan)]
        left, right, several = (f"climb_{x}_{level}" for x in ("left", "right", "several"))
        rows = rows.withColumns({left: F.when(own, F.concat_ws("", *before)), right: F.when(own, F.concat_ws("", *after)), several: here > 1})
        if level:
            rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in (left, right)})
        parent = F.when(F.col(several), digest(F.concat(upper, F.col(right)))).otherwise(F.col(upper))
        rows = rows.withColumn(upper, F.when(F.col(at) % (stride * fan) == 0, parent))
        path.append(F.when(F.col(several), F.struct(F.col(left).alias("left"), F.col(right).alias("right"))))
    kept = [F.col(c) for c in nodes.columns if c != "path"]
    done = rows.select(*kept, F.col(block), F.array_compact(F.array(*path)).alias("path"), upper)
    above = done.where(F.col(at) % wide == 0).select(group, F.col(block).alias(at), F.ceil(F.col(count) / wide).alias(count), F.col(upper).alias(value))
    return done.drop(upper).withColumnRenamed(block, "above"), above


def trees(nodes: DataFrame, group: str, at: str, count: str, value: str, fan: int = FAN, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(leaves with ``path``, all siblings up to the group's root, and ``top``, that root; group and value of the roots).

    The number of passes follows from the largest group. Each pass up writes what results, fan ** levels
    times fewer nodes; paths, which are wide, are never written: they come down from those nodes by
    joins on (group, window), the columns that the rows are dealt by already.
    """
    most = nodes.agg(F.max(count)).first()[0] or 0
    passes = []
    while True:
        done, above = climb(nodes, group, at, count, value, fan, levels)
        passes.append(done)
        nodes = staged(above, "merkle")
        if most <= fan**levels:
            break
        most = -(-most // fan**levels)
    higher = nodes.select(F.col(group).alias("top_group"), F.col(at).alias("top_at"), F.col(value).alias("top"), F.array().cast(done.schema["path"].dataType).alias("top_path"))
    for done in reversed(passes):
        out = done.join(higher, (F.col(group) == F.col("top_group")) & (F.col("above") == F.col("top_at")))
        out = out.withColumn("path", F.concat("path", "top_path")).drop("top_group", "top_at", "top_path", "above")
        higher = out.select(F.col(group).alias("top_group"), F.col(at).alias("top_at"), "top", F.col("path").alias("top_path"))
    return out, nodes.select(group, value)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda h, p: digest(F.concat(p["left"], h, p["right"])))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang", tampered: Column | None = None) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    A leaf digests the named columns of a row. Per group, leaves in ascending order of ``key`` form a tree
    of eights; the groups' roots (null group first, then bytewise) form one more. The proof is all siblings
    from the leaf to the root; folding a leaf's present form (``tampered`` is the
    expression of its text; the text itself if none) with it shows whether the row is as it was.

    Texts are read once: only digests are written and shuffled on. A null key or group sorts first; rows that repeat a key
    follow each other by leaf, and equal rows have the same leaf; an empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    columns = [F.col(c) for c in fields]
    now = leaf([tampered if c == "text" and tampered is not None else F.col(c) for c in fields])
    leaves = docs.select(
        F.col(key).alias("key"), F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp"),
        leaf(columns).alias("leaf"), (now if tampered is not None else F.lit(None).cast("string")).alias("now"),
    )
    leaves = ordered(staged(leaves, "leaves"), ["grp"], ["key", "leaf"], "at", "n")
    done, subroots = trees(leaves, "grp", "at", "n", "leaf")
    subroots = ordered(subroots.withColumnRenamed("leaf", "subroot"), [], ["grp"], "at", "n").withColumn("all", F.lit(0))
    roots = trees(subroots, "all", "at", "n", "subroot")[0].select(F.col("grp").alias("of"), "subroot", F.col("top").alias("root"), F.col("path").alias("rest"))
    out = done.drop("top").join(roots, F.col("grp") == F.col("of")).withColumn("path", F.concat("path", "rest"))
    pieces = F.flatten(F.transform("path", lambda p: F.array(p["left"], p["right"])))
    return out.select(
        F.col("key").alias(key), "leaf", "subroot", "root", digest(F.array_join(pieces, "")).alias("proof_sha256"),
        fold(F.coalesce("now", "leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    drawn = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    text = F.when(F.coalesce(drawn, F.lit(False)), folded_case(F.col("text"))).otherwise(F.col("text"))
    return manifest(read(spark, sf, "documents"), tampered=text)


#: crc32 of UTF-8 bytes: 256 table entries by eight shifts each, then one step for each byte.
SQL = """
WITH RECURSIVE steps AS (
    SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS crc
), docs AS (
    SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g, text,
        concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END,
            CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
            CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
            CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END) AS head
    FROM documents
), leaves AS (
    SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST) - 1 AS i,
        sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
        CASE WHEN xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)),
                lambda c, x: xor(c // 256, crc[xor(c, x) % 256 + 1]), 4294967295), 4294967295) % 3 = 0
            THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' ||
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END) END AS now
    FROM docs, steps
), up AS (
    SELECT 0 AS level, g, i, leaf AS v, count(*) OVER (PARTITION BY g) AS n FROM leaves
    UNION ALL
    SELECT any_value(level) + 1, g, i // 8, sha256(string_agg(v, '' ORDER BY i)), (any_value(n) + 7) // 8
    FROM up WHERE n > 1 GROUP BY g, i // 8
), subroots AS (
    SELECT g, v AS subroot, row_number() OVER (ORDER BY g) - 1 AS i FROM up WHERE n = 1
), top AS (
    SELECT 0 AS level, i, subroot AS v, count(*) OVER () AS n FROM subroots
    UNION ALL
    SELECT any_value(level) + 1, i // 8, sha256(string_agg(v, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM top WHERE n > 1 GROUP BY i // 8
), root AS (
    SELECT v AS root FROM top WHERE n = 1
), siblings AS (
    SELECT 'up' AS part, a.level, a.g, a.i, coalesce(string_agg(b.v, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
        coalesce(string_agg(b.v, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
    FROM up a JOIN up b ON a.g = b.g AND a.level = b.level AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY a.level, a.g, a.i
    UNION ALL
    SELECT 'top', a.level, '', a.i, coalesce(string_agg(b.v, '' ORDER BY b.i) FILTER (b.i < a.i), ''),
        coalesce(string_agg(b.v, '' ORDER BY b.i) FILTER (b.i > a.i), '')
    FROM top a JOIN top b ON a.level = b.level AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY a.level, a.i
), paths AS (
    SELECT doc_id, leaf, coalesce(now, leaf) AS start, subroot,
        coalesce((SELECT list({'l': s.l, 'r': s.r} ORDER BY s.level) FROM siblings s WHERE s.part = 'up' AND s.g = leaves.g AND s.i = leaves.i // (8 ** s.level)::BIGINT), [])
        || coalesce((SELECT list({'l': s.l, 'r': s.r} ORDER BY s.level) FROM siblings s WHERE s.part = 'top' AND s.i = subroots.i // (8 ** s.level)::BIGINT), []) AS path
    FROM leaves JOIN subroots USING (g)
), folds AS (
    SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda p: p.l || p.r), '')) AS proof_sha256,
        CASE WHEN len(path) = 0 THEN start ELSE list_reduce(list_transform(path, lambda p: p.l || '|' || p.r),
            lambda h, p: sha256(split_part(p, '|', 1) || h || split_part(p, '|', 2)), start) END AS folded_root
    FROM paths, root
)
SELECT *, folded_root = root AS verified FROM folds
"""
