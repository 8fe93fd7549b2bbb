"""Importance resampling towards a target: hashed n-grams from running CRCs, gains per bucket, seeded draws."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skycast.session import staged

from .common import on_workers, ordered, read

#: Longest feature in words, buckets of features, fewest words of a document that can be drawn, percent drawn, seed.
WORDS, BUCKETS, LEAST_WORDS, PERCENT, SEED = 2, 10_000, 20, 25, 7
#: Bytes of text that a task works on at once, about.
AT_ONCE = 2_000_000
#: A-Z lower-cased; every ASCII character that is no letter or digit becomes a space.
CLEAN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Lengths up to this have a table of their own; longer ones go by powers of two.
SHORT = 64


@cache
def _byte_table() -> np.ndarray:
    """CRC register after one byte, for each value of its low byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


@cache
def _one_byte() -> np.ndarray:
    """4 x 256: what each byte of a CRC becomes when one zero byte follows."""
    v = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    return _byte_table()[v & 0xFF] ^ (v >> 8)


def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & 0xFF] ^ table[1][(c >> 8) & 0xFF] ^ table[2][(c >> 16) & 0xFF] ^ table[3][c >> 24]


@cache
def _short() -> np.ndarray:
    """SHORT + 1 x 4 x 256: the shifts by 0 to SHORT bytes."""
    v = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    out = [v]
    for _ in range(SHORT):
        out.append(_apply(_one_byte(), out[-1]))
    return np.stack(out)


@cache
def _power(k: int) -> np.ndarray:
    """The shift by 2 ** k bytes; a shift is linear over GF(2), so applying it to its own table doubles it."""
    return _one_byte() if not k else _apply(_power(k - 1), _power(k - 1))


def shifted(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs as n[i] zero bytes after them change them."""
    t = _short()
    few = np.minimum(n, SHORT)
    out = t[few, 0, c & 0xFF] ^ t[few, 1, (c >> 8) & 0xFF] ^ t[few, 2, (c >> 16) & 0xFF] ^ t[few, 3, c >> 24]
    rest, k = n - few, 0
    at = np.flatnonzero(rest)
    rest = rest[at]
    while len(at):
        odd = at[rest & 1 == 1]
        out[odd] = _apply(_power(k), out[odd])
        rest, k = rest >> 1, k + 1
        at, rest = at[rest > 0], rest[rest > 0]
    return out


def running(text: bytes, spaced: bytes = b" ") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of a text, joined by one space: (the prefix's CRC at the start of each word, at its end, the place of its end)."""
    words = text.translate(CLEAN).split()
    c, at_end, at_start = 0, [], []
    for w in words:
        at_start.append(c)
        c = crc32(w, c)
        at_end.append(c)
        c = crc32(spaced, c)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    return np.array(at_start, np.uint32), np.array(at_end, np.uint32), ends


def features(texts: list[bytes], longest: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts: (words of each, CRCs of all runs of 1 to ``longest`` words, the text of each run).

    Each text is read once. The CRC of a run is that of the prefix that ends with it, less the CRC
    of the prefix before it, shifted by the run's bytes: both are linear, so the shared part cancels.
    """
    each = [running(t) for t in texts]
    n = np.array([len(e) for _, e, _ in each], np.int64)
    if not n.sum():
        return n, np.zeros(0, np.uint32), np.zeros(0, np.int64)
    start, end, place = (np.concatenate(x) for x in zip(*each))
    doc = np.repeat(np.arange(len(texts)), n)
    begins = np.concatenate([[0], place[:-1] + 1])
    begins[(np.cumsum(n) - n)[n > 0]] = 0
    crcs, docs = [], []
    for k in range(1, longest + 1):
        if len(doc) < k:
            break
        last = slice(k - 1, None)
        same = doc[: len(doc) - k + 1] == doc[last]
        length = (place[last] - begins[: len(doc) - k + 1])[same]
        crcs.append(end[last][same] ^ shifted(start[: len(doc) - k + 1][same], length))
        docs.append(doc[last][same])
    return n, np.concatenate(crcs), np.concatenate(docs)


def _pieces(texts: list[bytes]) -> Iterator[slice]:
    """Neighbouring texts of about AT_ONCE bytes together, one at least."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > AT_ONCE:
            yield slice(first, i)
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield slice(first, len(texts))


def _bytes(df: DataFrame, text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")


def bucket_counts(df: DataFrame, text: str = "text", longest: int = WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket; a task sends its ``buckets`` sums, whatever it reads."""
    on_workers(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            for some in _pieces(texts):
                total += np.bincount(features(texts[some], longest)[1] % buckets, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    each = df.select(_bytes(df, text)).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(ratio of the smoothed shares of target and source)) of each bucket."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    ratios = (((float(t) + 1) * (s_all + n)) / ((float(s) + 1) * (t_all + n)) for s, t in zip(source, target))
    return np.array([math.floor(1000 * math.log(x)) for x in ratios], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = WORDS) -> DataFrame:
    """Adds n_words, n_features and weight, the floored mean gain of a text's features (none: 0)."""
    on_workers(docs.sparkSession)
    at, buckets = docs.columns.index("text"), len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(at).cast(pa.large_binary()).to_pylist()]
            words, n, total = (np.zeros(len(texts), np.int64) for _ in range(3))
            for some in _pieces(texts):
                size = some.stop - some.start
                words[some], crcs, of = features(texts[some], longest)
                n[some] = np.bincount(of, minlength=size)
                ups = np.zeros(size, np.int64)
                np.add.at(ups, of, gain[crcs % buckets])
                total[some] = ups
            made = [words, n, np.where(n > 0, total // np.maximum(n, 1), 0)]
            kept = [c for k, c in enumerate(b.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, made)], schema.names)

    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])
    return docs.mapInArrow(weigh, schema)


def noise(key: Column, seed: int) -> Column:
    """floor(-1000 * ln(-ln(u))), u in (0, 1) from the first 32 bits of the digest of ``seed:key``: a Gumbel draw that the key fixes."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resampled(
    docs: DataFrame, target: DataFrame, longest: int = WORDS, buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs, drawn towards the texts of ``target``.

    Of the rows with ``least_words`` words or more, the ``percent`` per cent (rounded down) with the
    highest scores are drawn without replacement: rank 1, 2, 3 in descending order of score, ties to the
    smaller doc_id; rank is null for all others. A score is the weight plus a Gumbel draw fixed by seed and doc_id.

    Both tables are read whole; all that reaches the driver are the sums of ``buckets`` buckets. The
    order is cut into ranges, so no task sorts all scores. Null texts count as empty, a null
    doc_id as an empty key that comes first among ties; rows that repeat a doc_id are ranked each;
    empty tables (either one) are allowed; other columns of docs are ignored, whatever their names.
    """
    gain = gains(bucket_counts(docs, "text", longest, buckets), bucket_counts(target, "text", longest, buckets))
    out = weighed(docs.select("doc_id", "text"), gain, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    out = out.withColumn("can", F.col("n_words") >= least_words).drop("n_words")
    out = ordered(staged(out, "scores"), ["can"], [F.desc("score"), "doc_id", "weight", "n_features"], "place", "all")
    drawn = F.col("can") & (F.col("place") < F.expr(f"`all` * {int(percent)} div 100"))
    return out.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("place") + 1).alias("rank"))


def op13_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resampled(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


SQL = """
WITH steps AS (
    SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS crc
), texts AS (
    SELECT 'd' AS part, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents
    UNION ALL
    SELECT 'b', NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') FROM benchmark
), each AS (
    SELECT part, doc_id, unnest(w) AS f FROM texts
    UNION ALL
    SELECT part, doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM texts
), counted AS (
    SELECT part, doc_id, f, count(*) AS n FROM each GROUP BY ALL
), hashed AS (
    SELECT f, xor(list_reduce(list_transform(range(strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT),
        lambda c, x: xor(c // 256, crc[xor(c, x) % 256 + 1]), 4294967295), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT f FROM counted), steps
), sums AS (
    SELECT bucket, sum(n) FILTER (part = 'd') AS s, sum(n) FILTER (part = 'b') AS t FROM counted JOIN hashed USING (f) GROUP BY bucket
), totals AS (
    SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM sums
), gain AS (
    SELECT bucket, floor(1000 * ln(((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000)) / ((coalesce(s, 0)::DOUBLE + 1) * (t_all + 10000))))::BIGINT AS gain FROM sums, totals
), weights AS (
    SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight
    FROM counted JOIN hashed USING (f) JOIN gain USING (bucket) WHERE part = 'd' GROUP BY doc_id
), scored AS (
    SELECT doc_id, len(w) >= 20 AS can, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
    FROM texts LEFT JOIN weights USING (doc_id) WHERE part = 'd'
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY can ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY can) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN can AND place <= n * 25 // 100 THEN place END AS rank FROM placed
"""
