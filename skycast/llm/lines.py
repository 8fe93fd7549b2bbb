"""Line dedup over a corpus: frequent lines in sharded minimal perfect hashes that blocks of documents probe."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycast.session import staged

from .common import fresh, on_workers, read, text_of

#: Shortest key in code points, and the documents it must be found in.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: ASCII white space that a key loses at both ends.
SPACE = b" \t\n\x0b\x0c\r"
#: Averages: keys of a shard, bytes of text of a block of documents, and keys asked of one copy of a shard.
SHARD_KEYS, BLOCK_BYTES, ASKED = 262_144, 4_000_000, 524_288
#: Bits for each key on a level of the perfect hash.
GAMMA = 2
NO_ID = -(2**63)


def key_hashes(text: bytes, least: int = LEAST_CHARS) -> list[tuple[int, bytes]]:
    """(line number, 128-bit hash) of the lines whose key has ``least`` code points or more."""
    from xxhash import xxh3_128_digest

    out = []
    for i, line in enumerate(text.lower().split(b"\n")):  # bytes: A-Z only
        key = line.strip(SPACE)
        if len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least):
            out.append((i, xxh3_128_digest(key)))
    return out


def _pairs(hashes: list[bytes]) -> np.ndarray:
    """n x 2 unsigned longs."""
    return np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


class PerfectHash:
    """Minimal perfect hash of n x 2 unsigned longs, level by level.

    On each level the keys left fall on GAMMA bits each; those alone on theirs keep it, the others try the next
    level. A key's number is the count of set bits before its own, so n keys have the numbers 0 to n - 1.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @staticmethod
    def _spot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = keys[:, 0] ^ (keys[:, 1] + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Of distinct keys."""
        sizes, parts, level = [], [], 0
        while len(keys):
            size = -(-GAMMA * len(keys) // 64) * 64
            spot = cls._spot(keys, level, size)
            alone = np.bincount(spot, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            keys = keys[~alone[spot]]
            level += 1
        return cls(np.array(sizes, np.int64), np.concatenate([np.zeros(0, "<u8"), *parts]))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; other keys get any number, or -1."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (start, size) in enumerate(zip(self.starts, self.sizes)):
            at = start + self._spot(keys[left], level, int(size))
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = self.bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.ranks[word[hit]] + np.bitwise_count(below)
            left = left[~hit]
        return out


def frequent(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(a, b, n, last): the halves of the hash of each key in ``least_docs`` rows or more, their number, and the largest doc_id.

    Each batch of a task counts its own keys first, Spark's partial aggregation then a task's; a
    very common line crosses the shuffle once per task.
    """
    on_workers(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes: list[bytes] = []
            ids: list[int] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {k for _, k in key_hashes(text, least_chars)}
                hashes.extend(own)
                ids.extend([NO_ID if doc is None else doc] * len(own))
            if not hashes:
                continue
            keys, last = _pairs(hashes), np.array(ids, np.int64)
            order = np.lexsort((keys[:, 1], keys[:, 0]))
            keys, last = keys[order], last[order]
            at = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
            n = np.diff(np.append(at, len(keys)))
            yield pa.RecordBatch.from_arrays([_signed(keys[at, 0]), _signed(keys[at, 1]), pa.array(n), pa.array(np.maximum.reduceat(last, at))], ["a", "b", "n", "last"])

    each = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(count, "a long, b long, n long, last long")
    return each.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("last").alias("last")).where(F.col("n") >= least_docs)


def index(keys: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the perfect hash of its keys (sizes, bits), and by number their fingerprints, counts and last ids."""
    on_workers(keys.sparkSession)

    def build(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        cols = {c: table.column(c).to_numpy() for c in ("a", "b", "n", "last")}
        both = np.stack([cols["a"], cols["b"]], axis=1).view(np.uint64)
        made = PerfectHash.build(both)
        order = np.argsort(made.numbers(both))
        return pa.table({"shard": pa.array([shard], pa.int32())} | {
            k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())
            for k, v in (("sizes", made.sizes), ("bits", made.bits), ("prints", both[order, 1]), ("counts", cols["n"][order]), ("lasts", cols["last"][order]))
        })

    dealt = keys.withColumn("shard", F.pmod("a", F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(build, "shard int, sizes binary, bits binary, prints binary, counts binary, lasts binary")


def probe(asked: np.ndarray, shard: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which of the asked keys the shard holds, their counts, their last ids)."""
    of = lambda c, kind: np.frombuffer(shard[c], kind)
    prints = of("prints", "<u8")
    number = PerfectHash(of("sizes", np.int64), of("bits", "<u8")).numbers(asked)
    maybe = np.flatnonzero(number >= 0)
    held = maybe[prints[number[maybe]] == asked[maybe, 1]]
    return held, of("counts", np.int64)[number[held]], of("lasts", np.int64)[number[held]]


def without_common_lines(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS,
    shard_keys: int = SHARD_KEYS, block_bytes: int = BLOCK_BYTES, per_copy: int = ASKED,
) -> DataFrame:
    """The rows of docs, whole, with ``text`` cut and the new columns ``n_lines`` (before) and ``n_dropped``.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. A key of at
    least ``least_chars`` code points in at least ``least_docs`` rows loses all its lines except those in
    the rows of the largest doc_id that has it.

    Keys found often enough are counted exactly by 128-bit hashes and indexed in shards of about
    ``shard_keys``. Documents are dealt into blocks of about ``block_bytes`` by a hash of id and text; each
    block asks each shard once for its distinct keys, so a very common line is asked once per block,
    and gets back the last ids of those that the shard holds. A shard has as many copies as keep the keys
    asked of one near ``per_copy``. All three follow from measured numbers of keys and bytes;
    sizes of tasks depend on them, the rows never do. Texts are shuffled once.

    Null or empty text is one empty line, and null text stays null; a null doc_id is smaller than all
    others; rows with one doc_id are documents of their own that win or lose together; an empty
    table stays empty. Other columns are kept; columns named n_lines or n_dropped are replaced.
    """
    on_workers(docs.sparkSession)
    docs = docs.drop("n_lines", "n_dropped")
    keys = staged(frequent(docs, least_chars, least_docs), "lines")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, blocks = -(-keys.count() // shard_keys) or 1, -(-size // block_bytes) or 1
    # a key asked for has least_chars bytes or more, so the text bounds their number
    copies = -(-size // (max(1, least_chars) * shards * per_copy)) or 1
    arrays = staged(index(keys, shards), "line_index").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    width = len(docs.columns)
    at_id, at_text = docs.columns.index("doc_id"), docs.columns.index("text")
    dealt = docs.withColumn(fresh(docs, "block"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).toDF(*(f"c{k}" for k in range(width)), "block")
    texts = lambda rows: [t or b"" for t in rows.column(at_text).cast(pa.large_binary()).to_pylist()]

    def ask(rows: pa.Table) -> pa.Table:
        distinct = {k for t in texts(rows) for _, k in key_hashes(t, least_chars)}
        asked = _pairs(list(distinct))
        to = np.mod(np.ascontiguousarray(asked[:, 0]).view(np.int64), shards)
        order = np.argsort(to, kind="stable")
        asked, to = asked[order], to[order]
        at = np.flatnonzero(np.append(True, to[1:] != to[:-1])[: len(to)])
        own = rows.column(width)[0].as_py()
        return pa.table({
            "block": pa.array([own] * len(at), pa.int32()), "shard": pa.array(to[at].astype(np.int32)), "copy": pa.array([own % copies] * len(at), pa.int32()),
            "asked": pa.array([np.ascontiguousarray(x).tobytes() for x in np.split(asked, at[1:])][: len(at)], pa.binary()),
        })

    def answer(questions: pa.Table, shard: pa.Table) -> pa.Table:
        to, held, lasts = [], [], []
        if shard.num_rows:
            own = shard.slice(0, 1).to_pylist()[0]
            for block, raw in zip(questions.column("block").to_pylist(), questions.column("asked").to_pylist()):
                asked = np.frombuffer(raw, "<u8").reshape(-1, 2)
                which, _, last = probe(asked, own)
                if len(which):
                    to.append(block)
                    held.append(asked[which].tobytes())
                    lasts.append(last.tobytes())
        return pa.table({"block": pa.array(to, pa.int32()), "held": pa.array(held, pa.binary()), "lasts": pa.array(lasts, pa.binary())})

    def cut(rows: pa.Table, answers: pa.Table) -> pa.Table:
        last: dict[bytes, int] = {}
        for raw, ids in zip(answers.column("held").to_pylist(), answers.column("lasts").to_pylist()):
            last.update(zip((raw[k : k + 16] for k in range(0, len(raw), 16)), np.frombuffer(ids, np.int64).tolist()))
        kept, lines, dropped = [], [], []
        for doc, raw, null in zip(rows.column(at_id).to_pylist(), texts(rows), rows.column(at_text).is_null().to_pylist()):
            doc = NO_ID if doc is None else doc
            drop = {i for i, k in key_hashes(raw, least_chars) if last.get(k, doc) > doc} if last else set()
            lines.append(raw.count(b"\n") + 1)
            dropped.append(len(drop))
            kept.append(None if null else raw if not drop else b"\n".join(x for i, x in enumerate(raw.split(b"\n")) if i not in drop))
        made = [rows.column(k) for k in range(width)]
        made[at_text] = pa.array(kept, pa.binary()).cast(rows.schema.field(at_text).type)
        return pa.table([*made, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=names)

    schema = docs.limit(0).withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}).schema
    names = schema.names
    asked = dealt.groupBy("block").applyInArrow(ask, "block int, shard int, copy int, asked binary")
    held = asked.groupBy("shard", "copy").cogroup(arrays.groupBy("shard", "copy")).applyInArrow(answer, "block int, held binary, lasts binary")
    return dealt.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(cut, schema)


def op12_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = without_common_lines(read(spark, sf, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(text_of().cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents
), keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), often AS (
    SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT k.*, coalesce(k.doc_id < o.last, false) AS dropped FROM keyed k LEFT JOIN often o USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
