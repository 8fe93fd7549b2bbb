"""Best-fit packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skycast.session import staged

from .common import numbered, on_workers, read, text_of

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
END_ID = 0
#: Chunks a worker learns before it drops those that it has not met since it last did so.
REMEMBERED = 200_000

#: Marks that split from a word before them.
MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: What Python's split() takes for white space and the tokenizer does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"

_MEMO: dict[str, "Memo"] = {}


class Memo(dict):
    """Ids of chunks without white space as little-endian bytes, and the chunks of the generation before.

    The tokenizer splits at white space before anything else, so a text's ids are those of its
    chunks between white space one after the other. Words also split from the marks
    behind them, and their case does not count, so each is encoded once for all its forms.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.old: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: Which ids end a word.
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.tails = {"": b""}
        #: Ids of lower-case words, whatever marks stand behind them; kept by generations as the chunks are.
        self.known: dict[str, bytes] = {}
        self.known_old: dict[str, bytes] = {}

    def _others(self, chunks: list[str]) -> list[bytes]:
        """Any chunks: they come back as one sequence, each id with its chunk's number."""
        got = self.tokenizer.encode(chunks, is_pretokenized=True, add_special_tokens=False)
        ids: list[list[int]] = [[] for _ in chunks]
        for i, w in zip(got.ids, got.word_ids):
            ids[w].append(i)
        return [struct.pack(f"<{len(x)}I", *x) for x in ids]

    def _words(self, words: list[str]) -> list[bytes]:
        """Chunks of letters only: a text's words are then its chunks."""
        runs = [words[k : k + 200] for k in range(0, len(words), 200)]
        out: list[bytes] = []
        for run, got in zip(runs, self.tokenizer.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False)):
            at = np.array(got.ids, "<u4")
            ids, ends = at.tobytes(), [0, *(4 * (np.flatnonzero(self.ends[at]) + 1)).tolist()]
            if len(ends) != len(run) + 1:  # not one word each
                out += self._others(run)
            else:
                out += [ids[i:k] for i, k in zip(ends, ends[1:])]
        return out

    def learn(self, chunks: set[str]) -> None:
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()
        if len(self.known) > REMEMBERED:
            self.known, self.known_old = {}, self.known
        old = self.old
        forms: list[str] = []
        words: list[str] = []
        behind: list[str] = []
        others: list[str] = []
        for c in chunks.difference(self):
            if c in old:
                self[c] = old[c]
                continue
            k = c.rstrip(MARKS)
            if k.isalpha() and (k.isascii() or ("\u03a3" not in k and is_normalized("NFC", k) and k.lower().isalpha())):
                forms.append(c)
                words.append(k.lower())
                behind.append(c[len(k) :])
            else:
                others.append(c)
        for k in range(0, len(others), 20_000):
            self.update(zip(others[k : k + 20_000], self._others(others[k : k + 20_000])))
        unknown = list(set(behind).difference(self.tails))
        if len(self.tails) + len(unknown) > REMEMBERED:
            self.tails = {"": b""}
            unknown = list(set(filter(None, behind)))
        self.tails.update(zip(unknown, self._others(unknown)))
        known, before = self.known, self.known_old
        first = set(words).difference(known)
        fresh = first.difference(before)
        known.update((w, before[w]) for w in first.difference(fresh))
        known.update(zip(fresh, self._words(list(fresh))))
        tails = self.tails
        self.update(zip(forms, [known[w] + tails[t] if t else known[w] for w, t in zip(words, behind)]))


def _memo(path: str) -> Memo:
    if path not in _MEMO:
        _MEMO[path] = Memo(path)
    return _MEMO[path]


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers."""
    memo = _memo(path)
    split = [t.split(" ") if any(c in t for c in SEPARATORS) else t.split() for t in texts]
    memo.learn(set().union(*split))
    get = memo.__getitem__
    return [b"".join(map(get, s)) for s in split]


def _slices(texts: list[str], most: int = 2_000_000) -> Iterator[slice]:
    """Runs of texts of bounded total length; a longer text stands alone."""
    begin = size = 0
    for k, t in enumerate(texts):
        if k > begin and size + len(t) > most:
            yield slice(begin, k)
            begin, size = k, 0
        size += len(t)
    if begin < len(texts):
        yield slice(begin, len(texts))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids with ``keep_ids``) of every document.

    A document is its text's ids and ``end_id``; documents over ``capacity`` are cut into pieces
    of ``capacity`` ids, the last may be shorter. A null text counts as empty: one piece that
    holds ``end_id`` alone. Repeated rows give repeated pieces, an empty table none; other
    columns of the input are not looked at.
    """
    on_workers(docs.sparkSession)
    end = struct.pack("<I", end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc_ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for part in _slices(texts):
                cols: list[list] = [[], [], [], [], [], []]
                for d, ids in zip(doc_ids[part], encode_texts(texts[part], tokenizer)):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        for c, v in zip(cols, (d, k, at // 4, len(own) // 4, zlib.crc32(own), own if keep_ids else b"")):
                            c.append(v)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                n = len(names) - (not keep_ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:n], types)], names[:n])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go, from how many there are of each: segments
    (length, first, n, sequence, per_sequence, offset).

    The ``i``-th piece of a segment (numbered from ``first`` within its length) goes to
    sequence ``sequence + i // per_sequence`` at ``offset + i % per_sequence * length``.

    Lengths above a third of the capacity stand at most two in a sequence: greedily, the largest
    left takes the largest that still fits beside it. Smaller lengths follow from the largest
    on, each into the tightest gap that holds it, a new sequence if none does. Equal sequences
    are handled together, so the work depends on the number of lengths, not of pieces.
    """
    left = {n: c for n, c in counts.items() if c}
    taken = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of equal sequences, as (first, count)
    widths: list[int] = []  # the gaps that have runs, ascending
    sequences = 0

    def open_run(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(widths, gap)
            gaps[gap].append((first, n))

    def place(size: int, n: int, first: int, per: int, offset: int) -> None:
        out.append((size, taken[size], n, first, per, offset))
        taken[size] += n
        left[size] -= n

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        k = bisect_left(large, capacity - a + 1) - 1
        while k >= 0 and (not left[large[k]] or (large[k] == a and left[a] < 2)):
            k -= 1
        if k < 0:
            n = left[a]
            place(a, n, sequences, 1, 0)
            open_run(capacity - a, sequences, n)
        else:
            b = large[k]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            place(a, n, sequences, 1, 0)
            place(b, n, sequences, 1, a)
            open_run(capacity - a - b, sequences, n)
        sequences += n
    for size in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[size]:
            k = bisect_left(widths, size)
            if k == len(widths):
                per = capacity // size
                n = -(-left[size] // per)
                open_run(capacity, sequences, n)
                sequences += n
                continue
            gap = widths[k]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                widths.pop(k)
            per = gap // size
            full = min(n, left[size] // per)
            if full:
                place(size, full * per, first, per, capacity - gap)
                open_run(gap - per * size, first, full)
            rest = left[size]
            if full < n and rest < per and rest:
                place(size, rest, first + full, rest, capacity - gap)
                open_run(gap - rest * size, first + full, 1)
                full += 1
            open_run(gap, first + full, n - full)
    return out


def pack(rows: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset to rows that have a ``length`` from 1 to ``capacity``.

    Only the counts per length reach the driver (at most ``capacity`` numbers). Rows are numbered
    within their length in parts, and find their segment by length and number. ``rows`` is read
    twice, so give a stored table. Null lengths or lengths out of bounds raise an error; an
    empty table stays empty.
    """
    bad = F.col("length").isNull() | (F.col("length") < 1) | (F.col("length") > capacity)
    counts = {r.length: (r.n, r.bad) for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.max(bad).alias("bad")).limit(capacity + 2).collect()}
    if any(b for _, b in counts.values()):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    segments = plan({k: n for k, (n, _) in counts.items()}, capacity)
    table = rows.sparkSession.createDataFrame(
        [s for s in segments] or [],
        T.StructType([T.StructField(n, T.LongType()) for n in ("length", "first", "n", "sequence", "per", "at")]),
    )
    # One row per length, with its segments in order: bounded by the number of lengths.
    by_length = table.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "n", "sequence", "per", "at"))).alias("segments"))
    found = F.element_at(F.filter("segments", lambda s: (s["first"] <= F.col("number")) & (F.col("number") < s["first"] + s["n"])), 1)
    i = F.col("number") - F.col("segment.first")
    return (
        numbered(rows, ["length"], list(order), "number")
        .join(F.broadcast(by_length), "length")
        .withColumn("segment", found)
        .withColumn("sequence_id", F.col("segment.sequence") + F.floor(i / F.col("segment.per")))
        .withColumn("offset", F.col("segment.at") + F.pmod(i, F.col("segment.per")) * F.col("length"))
        .drop("segments", "segment", "number")
    )


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Documents to packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    cut = staged(pieces(docs, tokenizer or tokenizer_path(), capacity, end_id, keep_ids), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * keep_ids
    return pack(cut, capacity).select(*columns)


def op1_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(read(spark, sf, "documents"))
