"""Document fingerprints from chains of content words that follow common words, and near duplicates by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, read, text_of

#: Common words of English, French, German and Spanish that open a chain.
ANCHORS = tuple(
    "the of and to in is that for it was on are as with be by this at from or an a "
    "le la les de des du un une et en est que qui dans pour pas sur au "
    "der die das und den dem von zu ist mit sich auf für eine ein nicht "
    "el los las del y se por con para una su lo".split()
)
#: Content words of a chain.
CHAIN = 3
#: Ranges of doc_id that the order of documents is cut into: at least so many, more if the session shuffles into more.
RANGES, MOST_RANGES = 128, 8192
SIMILARITY = 0.8
LOWEST = -(2**63)


def words(text: Column) -> Column:
    """Runs of letters and digits, lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def with_signatures(df: DataFrame, text: str, name: str, chain: int = CHAIN) -> DataFrame:
    """Adds the sorted distinct signatures of a text column as array<long>.

    A signature hashes a common word with the next ``chain`` content words (fewer at the end of
    the text); the start of the text counts as a common word. A text of common words only has
    one signature of all of them, a text without words one of its characters, an empty or null one none.
    """
    w, at, content, out = (fresh(df, n) for n in ("spot_words", "spot_at", "spot_content", name))
    opens = lambda x: x.isin(*ANCHORS)
    chained = lambda first, k: F.xxhash64(first, *(F.get(content, k + i) for i in range(chain)))
    signed = F.concat(
        F.array(chained(F.lit(""), F.lit(0))),
        # the j-th common word at place p has p - j content words before it
        F.transform(
            F.filter(at, lambda p: p["p"] >= 0),
            lambda p, j: F.when(p["p"] - j < F.size(content), chained(p["w"], p["p"] - j)),
        ),
    )
    return (
        df.withColumn(w, words(F.coalesce(F.col(text), F.lit(""))))
        .withColumn(at, F.transform(w, lambda x, i: F.struct(F.when(opens(x), i).otherwise(F.lit(-1)).alias("p"), x.alias("w"))))
        .withColumn(content, F.transform(F.filter(at, lambda p: p["p"] < 0), lambda p: p["w"]))
        .withColumn(
            out,
            F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<long>"))
            .when(F.size(w) == 0, F.array(F.xxhash64(text)))
            .when(F.size(content) == 0, F.array(F.xxhash64(F.array_join(w, " "))))
            .otherwise(F.array_sort(F.array_distinct(F.array_compact(signed)))),
        )
        .drop(w, at, content)
    )


def fingerprint(signatures: Column) -> Column:
    """A digest of the set: equal sets have equal fingerprints."""
    return F.sha2(F.array_join(F.transform(signatures, lambda s: F.hex(s)), ",").cast("binary"), 256)


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 without looking at them if their sizes rule out ``least``. Two empty sets are alike."""
    both, small, big = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    exact = (both / (F.size(a) + F.size(b) - both)).cast("double")
    return F.when(big == 0, F.lit(1.0)).when(small < F.lit(least) * big, F.lit(0.0)).when(small == 0, F.lit(0.0)).otherwise(exact)


def near_pairs(docs: DataFrame, least: float = SIMILARITY, chain: int = CHAIN) -> tuple[DataFrame, DataFrame]:
    """Near duplicates: (members, pairs).

    members: doc_id, class_id (smallest id with the same fingerprint). pairs: a_id < b_id, class
    ids, and ``similarity`` of at least ``least``. Only one document of a class is compared, so
    copies cost nothing. Sets are partitioned by length: lengths that could be alike lie in one
    or two neighbouring ranges. Within a range, sets meet on their rarest signatures, as many as
    leave no alike pair unmet, and each pair is verified once. Null ids are left out.
    """
    own = with_signatures(docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text"), "text", "signatures", chain).select("doc_id", "signatures", fingerprint(F.col("signatures")).alias("fingerprint"))
    classes = own.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"))
    members = own.select("doc_id", "fingerprint").distinct().join(classes, "fingerprint").select("doc_id", "class_id")
    sets = own.join(classes, (own.fingerprint == classes.fingerprint) & (own.doc_id == classes.class_id)).groupBy("class_id").agg(F.first("signatures").alias("s")).where(F.size("s") > 0)
    n = F.size("s")
    banded = sets.withColumn("n", n).withColumn("band", F.floor(F.log(n.cast("double")) / F.lit(-_log(least))).cast("int"))
    each = banded.withColumn("x", F.explode("s"))
    often = each.groupBy("x").agg(F.count(F.lit(1)).alias("often"))
    rank = F.row_number().over(W.partitionBy("class_id").orderBy("often", "x"))
    few = each.select("class_id", "n", "band", "x").join(often, "x").withColumn("i", rank)
    few = few.where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select("class_id", "n", "band", "x")
    left, right = few.alias("l"), few.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1))).alias("r")
    fits = (F.col("l.class_id") != F.col("r.class_id")) & (F.least("l.n", "r.n") >= F.greatest("l.n", "r.n") * least - 1e-9)
    met = left.join(right, (F.col("l.x") == F.col("r.x")) & (F.col("l.band") == F.col("r.band")) & fits)
    pairs = met.select(F.least("l.class_id", "r.class_id").alias("a_id"), F.greatest("l.class_id", "r.class_id").alias("b_id")).distinct()
    a, b = sets.select(F.col("class_id").alias("a_id"), F.col("s").alias("a")), sets.select(F.col("class_id").alias("b_id"), F.col("s").alias("b"))
    verified = pairs.join(a, "a_id").join(b, "b_id").withColumn("similarity", likeness(F.col("a"), F.col("b"), least))
    return members, verified.where(F.col("similarity") >= least).select("a_id", "b_id", "similarity")


def _log(x: float) -> float:
    import math

    return math.log(min(x, 0.999))


def with_next(df: DataFrame, columns: list[str], ranges: int | None = None) -> DataFrame:
    """Adds next_<column>: the value in the following row by descending doc_id, for the last row that of the first.

    The order is cut into ranges of doc_id at approximate quantiles (``ranges`` numbers to the
    driver), and the first row of each range also stands, as a guest, at the end of the range
    before, so that every row finds its next within its range. Null ids come last; equal ids are
    ordered by the hash of the columns.
    """
    if ranges is None:
        ranges = min(MOST_RANGES, max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    key, part, guest, dealt, tie = (fresh(df, n) for n in ("next_key", "next_part", "next_guest", "next_dealt", "next_tie"))
    keyed = df.withColumn(key, F.coalesce(F.col("doc_id"), F.lit(LOWEST)))
    got = keyed.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 4 * MOST_RANGES).alias("cuts")).first()
    cuts = sorted(set(got.cuts or []), reverse=True)
    keyed = keyed.withColumn(part, _place(cuts, F.col(key)))
    firsts = sorted((r[part], r["first"]) for r in keyed.groupBy(part).agg(F.max(key).alias("first")).collect())
    own, host = [LOWEST] * (len(cuts) + 1), [0] * (len(cuts) + 1)
    for k, (p, first) in enumerate(firsts):
        own[p], host[p] = first, firsts[k - 1][0]
    is_first = F.col(key) == F.get(F.lit(own).cast("array<long>"), F.col(part))
    spots = F.array(
        F.struct(F.col(part).alias("part"), F.lit(False).alias("guest")),
        F.struct(F.when(is_first, F.get(F.lit(host), F.col(part))).alias("part"), F.lit(True).alias("guest")),
    )
    out = keyed.withColumn(tie, F.xxhash64(*columns)).withColumn(dealt, F.explode(F.filter(spots, lambda s: s["part"].isNotNull())))
    out = out.withColumn(part, F.col(dealt)["part"]).withColumn(guest, F.col(dealt)["guest"])
    order = W.partitionBy(part).orderBy(F.col(guest), F.col(key).desc(), F.col(tie))
    for c in columns:
        out = out.withColumn(f"next_{c}", F.lead(c).over(order))
    return out.where(~F.col(guest)).drop(key, part, guest, dealt, tie)


def _place(cuts: list[int], key: Column) -> Column:
    """How many of the descending cuts lie above the key, by halving."""
    if not cuts:
        return F.lit(0)
    table, steps = F.lit(cuts).cast("array<long>"), [1 << b for b in reversed(range(len(cuts).bit_length()))]
    higher = lambda n, step: F.coalesce(F.get(table, n + step - 1) > key, F.lit(False))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, step: F.when(higher(n, step), n + step).otherwise(n))


def op6_spotsigs(spark: SparkSession, sf: str) -> DataFrame:
    docs = with_signatures(read(spark, sf, "documents").select("doc_id", text_of().alias("text")), "text", "signatures")
    n = F.col("n_chars")
    both = (
        with_next(docs, ["text", "signatures"])
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("third", F.floor(n / 3).cast("int"))
        .withColumn("edited", F.concat(F.substr("text", F.lit(1), n.cast("int") - F.col("third")), F.substr("next_text", F.lit(1), F.col("third"))))
    )
    return with_signatures(both.drop("text", "next_text"), "edited", "edited_signatures").select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("signatures")).alias("fingerprint"), fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )
