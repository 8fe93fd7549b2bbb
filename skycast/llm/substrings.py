"""Substring dedup: word windows that an earlier document has, found in a compressed FM-index per shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skycast.session import staged

from .common import fresh, on_workers, read, text_of

WINDOW = 13
#: Words of the grams that route a window; must be shorter than the window.
GRAM = 4
#: A gram of so many bytes says something about where it is from; it goes before shorter ones.
TELLING = 20
#: Text bytes of a block, about; a longer document is a block of its own.
BLOCK_BYTES = 1_000_000
#: Words of the corpus per shard.
SHARD_WORDS = 500_000
#: Windows under one key, about; those of a key with more are routed each by all of its words.
KEY_WINDOWS = 10_000

U = np.uint64


# --- FM-index ------------------------------------------------------------------------------


class WaveletMatrix:
    """Rank of a symbol before a place, over a sequence of numbers: one bit vector per bit, with counts per 64 bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n, self.levels = len(symbols), []
        for k in reversed(range(bits)):
            bit = (symbols >> k & 1).astype(bool)
            packed = np.zeros(8 * (self.n // 64 + 1), np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view("<u8")
            before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            self.levels.append((k, words, before[:-1], self.n - int(bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        low = (U(1) << (at & 63).astype(U)) - U(1)
        w = at >> 6
        return before[w] + np.bitwise_count(words[w] & low)

    def rank(self, symbol: np.ndarray, at: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place; ``start`` is ``begin(symbol)``."""
        for k, words, before, zeros in self.levels:
            ones = self._ones(words, before, at)
            at = np.where(symbol >> k & 1, zeros + ones, at - ones)
        return at - start

    def begin(self, symbol: np.ndarray) -> np.ndarray:
        """Where the run of each symbol begins on the last level."""
        at = np.zeros(len(symbol), np.int64)
        for k, words, before, zeros in self.levels:
            ones = self._ones(words, before, at)
            at = np.where(symbol >> k & 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """An index of texts (arrays of word numbers from 1) for windows of ``window`` words.

    Suffixes are ordered by their first words (a power of two, ``window`` or more), which is all
    that patterns of ``window`` words can tell apart. ``low`` is the smallest value of the texts that
    hold the window of a row.
    """

    def __init__(self, text: np.ndarray, values: np.ndarray, window: int = WINDOW):
        # text: all texts, each followed by 0; values: of each place
        n = len(text)
        rank, depth = text.astype(np.int64), 1
        place = np.arange(n)
        prefix: np.ndarray | None = None
        while depth < window:
            # keys of up to `window` words: the last round only adds what is missing to the window
            step = min(depth, window - depth)
            key = rank * (int(rank.max(initial=0)) + 2)
            key[: n - step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)]) if n else np.empty(0, np.int64)
            rank = np.empty(n, np.int64)
            rank[order] = new
            depth += step
            prefix = order
        order = prefix if prefix is not None else np.argsort(rank, kind="stable")
        self.blocks = rank[order]  # of rows: which window they begin with
        self._text, self._order, self._edges = text, order, {}
        self.window = window
        starts = np.flatnonzero(np.diff(self.blocks, prepend=-1))
        self.begins, self.ends = starts, np.append(starts[1:], n)
        self.low = np.minimum.reduceat(values[order], starts) if n else values
        before = text[place[order] - 1] if n else text
        top = int(text.max(initial=0)) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top))])
        self.matrix = WaveletMatrix(before.astype(np.int64), max(1, int(top).bit_length()))
        self.start = self.matrix.begin(np.arange(top))

    def step(self, symbol: np.ndarray, l: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From the rows of a pattern to those of the symbol and the pattern behind it."""
        s = self.start[symbol]
        return self.first[symbol] + self.matrix.rank(symbol, l, s), self.first[symbol] + self.matrix.rank(symbol, r, s)

    @cached_property
    def common(self) -> np.ndarray:
        """How many words (``window`` at most) each row has in common with the one before; 0 for the first and behind the last."""
        out = np.zeros(len(self._order) + 1, np.int64)
        text = np.concatenate([self._text, np.full(self.window, -1)])
        same = np.ones(max(0, len(self._order) - 1), bool)
        for k in range(self.window):
            words = text[self._order + k]
            same &= (words[1:] == words[:-1]) & (words[1:] >= 0)
            out[1:-1] += same
        return out

    def shorter(self, l: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the rows of a pattern to those of its longest beginning that has more rows, and how many words that has."""
        keep = np.maximum(self.common[l], self.common[r])
        a, b = l.copy(), r.copy()
        for k in np.unique(keep).tolist():
            if k not in self._edges:
                self._edges[k] = np.append(np.flatnonzero(self.common[:-1] < k), len(self.blocks)) if k else np.array([0, len(self.blocks)])
            edges, of = self._edges[k], keep == k
            at = np.searchsorted(edges, l[of], side="right")
            a[of], b[of] = edges[at - 1], edges[at]
        return a, b, keep

    def statistics(self, text: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each window of each text, in order, the smallest value of the texts that hold it; the largest int64 where none does.

        All texts are streamed backwards at once. The first ``window`` words build up a pattern; from
        then on each further word gives a pattern one word longer, whose last word is dropped by
        widening its rows to all that begin with the same window. Where a word does not fit in front, last
        words are dropped until it does; if it stands nowhere, the pattern starts again at the word before.
        """
        windows = lengths - self.window + 1
        offset = np.concatenate([[0], np.cumsum(windows)])
        out = np.full(int(offset[-1]), np.iinfo(np.int64).max)
        l, r = np.zeros(len(begins), np.int64), np.full(len(begins), len(self.blocks), np.int64)
        matched = np.zeros(len(begins), np.int64)
        live = np.arange(len(begins))
        for back in range(int(lengths.max(initial=0))):
            live = live[lengths[live] > back]
            at = lengths[live] - 1 - back
            symbol = text[begins[live] + at]
            low, high, length = l[live], r[live], matched[live] + 1
            a, b = self.step(symbol, low, high)
            lost = np.flatnonzero((a >= b) & (length > 1))
            while len(lost):
                low[lost], high[lost], keep = self.shorter(low[lost], high[lost])
                a[lost], b[lost] = self.step(symbol[lost], low[lost], high[lost])
                length[lost] = keep + 1
                lost = lost[(a[lost] >= b[lost]) & (keep > 0)]
            some = a < b
            length[~some] = 0
            full = length >= self.window
            block = self.blocks[a[full]]
            a[full], b[full] = self.begins[block], self.ends[block]
            a[~some], b[~some] = 0, len(self.blocks)
            l[live], r[live], matched[live] = a, b, np.minimum(length, self.window)
            out[offset[live[full]] + at[full]] = self.low[block]
        return out


def match(texts: list[bytes], values: list[int], asked: list[bytes], window: int = WINDOW) -> list[np.ndarray]:
    """For each asked text (words joined by a space, ``window`` or more) the smallest value of the texts that hold each of its windows."""
    if not asked:
        return []
    numbers: dict[bytes, int] = {}
    split = [t.split(b" ") for t in texts]
    for words in split:
        for w in words:
            if w not in numbers:
                numbers[w] = len(numbers) + 1
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    text = _numbered(split, numbers, lengths)
    index = FMIndex(text, np.repeat(np.array(values, np.int64), lengths + 1), window)
    queries = [t.split(b" ") for t in asked]
    sizes = np.fromiter(map(len, queries), np.int64, len(queries))
    unknown = len(numbers) + 1
    flat = np.fromiter((numbers.get(w, unknown) for q in queries for w in q), np.int64, int(sizes.sum()))
    if (flat == unknown).any():  # a word that no text has: it gets a run of no rows
        index.first = np.append(index.first, index.first[-1])
        index.start = np.append(index.start, index.matrix.begin(np.array([unknown])))
    found = index.statistics(flat, np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return np.split(found, np.cumsum(sizes - window + 1)[:-1])


def _numbered(split: list[list[bytes]], numbers: dict[bytes, int], lengths: np.ndarray) -> np.ndarray:
    """The texts' word numbers, a 0 behind each text."""
    out = np.zeros(int(lengths.sum()) + len(split), np.int64)
    real = np.ones(len(out), bool)
    real[np.cumsum(lengths + 1) - 1] = False
    out[real] = np.fromiter((numbers[w] for words in split for w in words), np.int64, int(lengths.sum()))
    return out


# --- blocks and segments -----------------------------------------------------------------------


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(29))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        p = np.full(n, base, U)
        p[:1] = 1
        _POWERS[base] = np.cumprod(p, dtype=U)
    return _POWERS[base][:n]


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)


@dataclass
class Block:
    """Documents as canonical text: words joined by a space, documents by a line end."""

    text: bytes
    ids: np.ndarray

    def __post_init__(self) -> None:
        buf = np.frombuffer(self.text, np.uint8)
        gap = (buf == 32) | (buf == 10)
        edge = np.flatnonzero(np.diff(gap.astype(np.int8), prepend=1, append=1))
        self.begins, self.ends = edge[::2], edge[1::2]
        self.lines = np.flatnonzero(buf == 10)
        #: Which document (by place in the block) each word is of.
        self.doc = np.searchsorted(self.lines, self.begins)
        self.buf = buf

    def segments(self, window: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows of one document with the same key: first word, number of windows, key, and whether it is of one window.

        A window's key is the smallest hash of the grams in it, so equal windows have equal keys
        wherever they stand; neighbouring windows mostly share theirs. Each window whose key is in ``hot``
        is a run of its own, and its key the hash of all its words.
        """
        n = len(self.begins)
        if n < window:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U), np.empty(0, bool)
        total = np.concatenate([np.zeros(1, U), np.cumsum((self.buf.astype(U) + U(1)) * _powers(_BASE, len(self.buf)), dtype=U)])
        h = _mix((total[self.ends] - total[self.begins]) * _powers(_BACK, len(self.buf))[self.begins])
        gram = min(GRAM, window)
        g = h[: n - gram + 1].copy()
        for k in range(1, gram):
            g = g * U(0xC2B2AE3D27D4EB4F) + h[k : n - gram + 1 + k]
        short = self.ends[gram - 1 :] - self.begins[: n - gram + 1] < TELLING
        g = (_mix(g) >> U(1)) | (short.astype(U) << U(63))
        width, have = window - gram + 1, 1
        while have < width:
            step = min(have, width - have)
            g = np.minimum(g[:-step], g[step:])
            have += step
        starts = np.flatnonzero(self.doc[: n - window + 1] == self.doc[window - 1 :])
        keys, docs = g[starts], self.doc[starts]
        single = np.isin(keys, hot) if hot is not None and len(hot) else np.zeros(len(keys), bool)
        if single.any():
            at = starts[single]
            whole = h[at]
            for k in range(1, window):
                whole = whole * U(0xC2B2AE3D27D4EB4F) + h[at + k]
            keys[single] = _mix(whole)
        new = np.ones(len(starts), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1]) | single[1:] | single[:-1]
        first = np.flatnonzero(new)
        return starts[first], np.diff(np.append(first, len(starts))), keys[first], single[first]

    def segment_text(self, first: int, windows: int, window: int) -> bytes:
        return self.text[self.begins[first] : self.ends[first + windows + window - 2]]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    deflate = zstandard.ZstdCompressor(level=3).compress
    names = ["block", "ids", "words", "text"]

    def block(ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
        packed = deflate(b"\n".join(texts))
        # the same documents always make the same block number
        number = int.from_bytes(hashlib.blake2b(packed + np.array(ids, "<i8").tobytes(), digest_size=8).digest(), "little", signed=True)
        words = sum(t.count(b" ") + bool(t) for t in texts)
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([words]), pa.array([packed], pa.binary())], names)

    ids: list[int] = []
    texts: list[bytes] = []
    size = 0
    for b in batches:
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            canonical = b" ".join(t.encode("utf-8", "replace").split())
            if texts and size + len(canonical) > BLOCK_BYTES:
                yield block(ids, texts)
                ids, texts, size = [], [], 0
            ids.append(d)
            texts.append(canonical)
            size += len(canonical)
    if texts:
        yield block(ids, texts)


def _open(ids: list[int], packed: bytes) -> Block:
    import zstandard

    return Block(zstandard.ZstdDecompressor().decompress(packed), np.array(ids, np.int64))


def _by_shard(shard: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order by shard (kept within), and the shards present with their slice of it."""
    order = np.argsort(shard, kind="stable")
    at = np.flatnonzero(np.diff(shard[order], prepend=-1))
    return order, [(int(shard[order[a]]), slice(int(a), int(b))) for a, b in zip(at, np.append(at[1:], len(order)))]


@dataclass
class Routes:
    """Numbers of shards: first those of keys, then those of single windows."""

    keys: int
    windows: int = 1

    def of(self, key: np.ndarray, single: np.ndarray) -> np.ndarray:
        return np.where(single, U(self.keys) + key % U(self.windows), key % U(self.keys)).astype(np.int64)


@dataclass
class Shared:
    """What other documents share with a block: keys, the hot ones, and single windows under these."""

    keys: np.ndarray
    hot: np.ndarray
    windows: np.ndarray

    @staticmethod
    def of(table: pa.Table, routes: Routes) -> Shared:
        made: list[list[np.ndarray]] = [[np.empty(0, U)] for _ in range(3)]
        for shard, keys, hot in zip(*(table[c].to_pylist() for c in ("shard", "keys", "hot"))):
            if keys is not None:
                made[2 if shard >= routes.keys else 0].append(np.frombuffer(keys, U))
                made[1].append(np.frombuffer(hot, U))
        return Shared(*map(np.concatenate, made))


def _alive(block: Block, mine: Shared, window: int, routes: Routes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]]:
    """Per shard: the block's segments that ``mine`` holds (first word, windows), which distinct text each
    has, the distinct texts in order of appearance, and the smallest document of each."""
    first, windows, key, single = block.segments(window, mine.hot)
    hit = np.where(single, np.isin(key, mine.windows), np.isin(key, mine.keys))
    first, windows, key, single = first[hit], windows[hit], key[hit], single[hit]
    order, parts = _by_shard(routes.of(key, single))
    for shard, part in parts:
        own = order[part]
        texts: dict[bytes, int] = {}
        which = [texts.setdefault(block.segment_text(a, w, window), len(texts)) for a, w in zip(first[own].tolist(), windows[own].tolist())]
        low = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(low, which, block.ids[block.doc[first[own]]])
        yield shard, first[own], windows[own], np.array(which, np.int64), list(texts), low


def _sent(block: Block, number: int, window: int, routes: Routes, hot: np.ndarray | None = None) -> pa.RecordBatch:
    """A block's keys by shard, those of single windows only if there are ``hot`` ones: each at most twice, for the
    first two documents that have it. ``sizes``: 1 + log2 (upwards) of the block's windows under the key, then 0."""
    first, windows, key, single = block.segments(window, hot)
    if hot is not None:
        first, windows, key, single = first[single], windows[single], key[single], single[single]
    doc = block.doc[first]
    order = np.lexsort((doc, key))
    key, doc, windows = key[order], doc[order], windows[order]
    new_key = np.diff(key, prepend=~key[:1]) != 0
    runs = np.flatnonzero(new_key)
    sizes = np.zeros(len(key), np.uint8)
    sizes[runs] = 1 + np.ceil(np.log2(np.add.reduceat(windows, runs))) if len(runs) else 0
    other = np.ones(len(key), bool)
    other[1:] = new_key[1:] | (doc[1:] != doc[:-1])
    key, new_key, sizes = key[other], new_key[other], sizes[other]
    # the first two documents of each key stand for all of the block
    keep = new_key.copy()
    keep[1:] |= new_key[:-1]
    key, sizes = key[keep], sizes[keep]
    order, parts = _by_shard(routes.of(key, np.full(len(key), hot is not None)))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([s for s, _ in parts], pa.int32()), pa.array([number] * len(parts), pa.int64()),
            pa.array([key[order[p]].tobytes() for _, p in parts], pa.binary()), pa.array([sizes[order[p]].tobytes() for _, p in parts], pa.binary()),
        ],
        ["shard", "block", "keys", "sizes"],
    )


def _shared(table: pa.Table, most: int | None) -> pa.Table:
    """Of the keys that blocks sent to a shard those that two documents have, per block. Those of more than ``most``
    windows in all are ``hot``, not ``keys``; ``hot_windows`` is about how many the block has of them."""
    each = [np.frombuffer(x, U) for x in table["keys"].to_pylist()]
    owner = np.repeat(np.arange(len(each)), [len(x) for x in each])
    key = np.concatenate([np.empty(0, U), *each])
    code = np.concatenate([np.empty(0, np.uint8), *(np.frombuffer(x, np.uint8) for x in table["sizes"].to_pylist())]).astype(np.int64)
    size = np.where(code > 0, np.int64(1) << np.maximum(code - 1, 0), 0)
    order = np.argsort(key, kind="stable")
    key, owner, size = key[order], owner[order], size[order]
    same = np.zeros(len(key), bool)
    same[1:] = key[1:] == key[:-1]
    same[:-1] |= same[1:]
    key, owner, size = key[same], owner[same], size[same]
    runs = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
    total = np.add.reduceat(size, runs) if len(runs) else size
    hot = np.repeat(total, np.diff(np.append(runs, len(key)))) > most if most is not None else np.zeros(len(key), bool)
    order = np.argsort(owner, kind="stable")
    key, hot, size, ends = key[order], hot[order], size[order], np.searchsorted(owner[order], np.arange(len(each) + 1))
    parts = [(key[a:b], hot[a:b], size[a:b]) for a, b in zip(ends, ends[1:])]
    out = table.select(["shard", "block"]).append_column("keys", pa.array([np.unique(k[~h]).tobytes() for k, h, _ in parts], pa.binary()))
    out = out.append_column("hot", pa.array([np.unique(k[h]).tobytes() for k, h, _ in parts], pa.binary()))
    out = out.append_column("hot_windows", pa.array([int(n[h].sum()) for _, h, n in parts], pa.int64()))
    return out.filter(pa.array([len(k) > 0 for k, _, _ in parts], pa.bool_()))


def repeated(docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, key_windows: int = KEY_WINDOWS) -> tuple[DataFrame, DataFrame, Routes]:
    """(blocks, found, routes): the corpus in blocks, and per block and shard the keys that more than one document
    has and the smallest document of each window under them.

    1. Blocks of documents (compressed) are written once.
    2. Every window has a key; each block sends its keys, at most twice each, to the key's shard, and
       learns which of them another document has. Others can not repeat and stay where they are.
    3. A key with more than about ``key_windows`` windows (a short line in very many documents, each time with
       other neighbours) does not go to one shard: the hashes of its windows are sent and answered as the keys were, to
       shards of their own, as many as the windows need.
    4. For the rest each block sends its distinct segments (single windows under such keys), with their smallest
       document, to the shard, which indexes them and streams them through the index. A window that very
       many documents share thus arrives once per block, not once per document.
    """
    spark = docs.sparkSession
    on_workers(spark)
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    blocks = staged(rows.mapInArrow(_pack, "block long, ids array<long>, words long, text binary"), "blocks")
    shards = max(1, -(-(blocks.agg(F.sum("words")).first()[0] or 0) // shard_words))

    routes = Routes(shards)

    def send_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, ids, packed in zip(*(b.column(k).to_pylist() for k in range(3))):
                yield _sent(_open(ids, packed), number, window, routes)

    plain = blocks.select("block", "ids", "text")
    sent, answer = "shard int, block long, keys binary, sizes binary", "shard int, block long, keys binary, hot binary, hot_windows long"
    keys = plain.mapInArrow(send_keys, sent)
    alive = staged(keys.groupBy("shard").applyInArrow(lambda _, table: _shared(table, key_windows), answer), "keys")
    hot_windows = alive.agg(F.sum("hot_windows")).first()[0] or 0
    if hot_windows:
        routes = Routes(shards, -(-hot_windows * window // shard_words))

        def send_windows(left: pa.Table, right: pa.Table) -> pa.Table:
            made = []
            if right.num_rows:
                hot = Shared.of(right, routes).hot
                made = [_sent(_open(ids, packed), number, window, routes, hot) for number, ids, packed in zip(*(left[c].to_pylist() for c in ("block", "ids", "text")))]
            return pa.Table.from_batches(made, pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("sizes", pa.binary())]))

        asking = alive.where("hot_windows > 0")
        singles = plain.groupBy("block").cogroup(asking.groupBy("block")).applyInArrow(send_windows, sent)
        alive = alive.unionByName(staged(singles.groupBy("shard").applyInArrow(lambda _, table: _shared(table, None), answer), "single-windows"))
    alive = alive.drop("hot_windows")

    def send_segments(left: pa.Table, right: pa.Table) -> pa.Table:
        made: list[list] = [[], [], [], []]
        for number, ids, packed in zip(*(left[c].to_pylist() for c in ("block", "ids", "text"))) if right.num_rows else ():
            for shard, _, _, _, texts, low in _alive(_open(ids, packed), Shared.of(right, routes), window, routes):
                for c, v in zip(made, (shard, number, texts, low.tolist())):
                    c.append(v)
            break  # rows of one number are the same block
        types = [pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
        return pa.table([pa.array(c, t) for c, t in zip(made, types)], ["shard", "block", "texts", "docs"])

    def search(_: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        texts = table["texts"].to_pylist()
        low: dict[bytes, int] = {}
        for own, docs_ in zip(texts, table["docs"].to_pylist()):
            for t, d in zip(own, docs_):
                if d < low.get(t, np.iinfo(np.int64).max):
                    low[t] = d
        found = dict(zip(low, match(list(low), list(low.values()), list(low), window)))
        mins = [np.concatenate([found[t] for t in own]).astype("<i8").tobytes() for own in texts]
        return table.select(["shard", "block"]).append_column("mins", pa.array(mins, pa.binary()))

    asked = plain.groupBy("block").cogroup(alive.groupBy("block")).applyInArrow(send_segments, "shard int, block long, texts array<binary>, docs array<long>")
    found = asked.groupBy("shard").applyInArrow(search, "shard int, block long, mins binary")
    both = alive.withColumn("mins", F.lit(None).cast("binary")).unionByName(found.withColumns({c: F.lit(None).cast("binary") for c in ("keys", "hot")}))
    return plain, staged(both, "windows"), routes


def spans(docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, key_windows: int = KEY_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, text_key, spans: for every row, the words that repeat an earlier document.

    A word goes if a window of ``window`` words that covers it also starts in a document with a
    smaller doc_id; all windows are judged on the input. ``spans`` are (from, to) word numbers, to
    exclusive, in order; ``text_key`` hashes the words. Words stand between ASCII white space. A null text has no words. Rows
    with a null doc_id come before and after no other: they keep all words. Rows that repeat an id
    do not repeat each other. An empty table stays empty.
    """
    blocks, found, routes = repeated(docs, window, shard_words, key_windows)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, text_key long, spans array<struct<begin:int,end:int>>"
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "text_key", "spans"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))]

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        mins = {s: np.frombuffer(m, "<i8") for s, m in zip(right["shard"].to_pylist(), right["mins"].to_pylist()) if m is not None}
        mine = Shared.of(right, routes)
        for ids, packed in zip(left["ids"].to_pylist(), left["text"].to_pylist()):
            block = _open(ids, packed)
            cover = np.zeros(len(block.begins) + 1, np.int32)
            for shard, first, windows, which, texts, _ in _alive(block, mine, window, routes):
                size = np.array([t.count(b" ") + 2 - window for t in texts], np.int64)
                base = np.concatenate([[0], np.cumsum(size)])[which]
                # every window of every segment
                k = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
                at = np.repeat(first, windows) + k
                gone = at[mins[shard][np.repeat(base, windows) + k] < block.ids[block.doc[at]]]
                np.add.at(cover, gone, 1)
                np.add.at(cover, gone + window, -1)
            covered = np.cumsum(cover)[:-1] > 0
            ends = np.searchsorted(block.doc, np.arange(len(ids) + 1))
            for k, (d, text) in enumerate(zip(ids, block.text.split(b"\n"))):
                own = covered[ends[k] : ends[k + 1]]
                edge = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).tolist()
                kept = b" ".join(compress(text.split(b" "), (~own).tolist())) if edge else text
                parts = [{"begin": a, "end": b} for a, b in zip(edge[::2], edge[1::2])]
                out.append((d, len(own), int(own.sum()), hashlib.sha256(kept).hexdigest(), _text_key(text), parts))
        return pa.table([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names)

    done = blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(finish, schema)
    words = F.when(F.trim(text_of(), F.lit(" \t\n\x0b\f\r")) == "", F.array().cast("array<string>")).otherwise(F.split(F.trim(text_of(), F.lit(" \t\n\x0b\f\r")), r"[ \t\n\x0B\f\r]+"))
    null = docs.where(F.col("doc_id").isNull()).select(F.lit(None).cast("long").alias("doc_id"), words.alias("w")).select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"),
        F.sha2(F.array_join("w", " ").cast("binary"), 256).alias("kept_sha256"), F.lit(0).cast("long").alias("text_key"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"),
    )
    return done.unionByName(null)


def _text_key(canonical: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(canonical, digest_size=8).digest(), "little", signed=True)


def _cut(text: str, spans_: list[dict]) -> str:
    """The text without the words of the spans, each with the white space behind it."""
    raw = text.encode("utf-8", "replace")
    buf = np.frombuffer(raw, np.uint8)
    gap = (buf == 32) | ((buf >= 9) & (buf <= 13))
    begins = [*np.flatnonzero(np.diff(gap.astype(np.int8), prepend=1) == -1).tolist(), len(raw)]
    out, at = [], 0
    for s in spans_:
        out.append(raw[at : begins[s["begin"]]])
        at = begins[s["end"]]
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")


def without_repeats(docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents with repeated words (see ``spans``) cut out of ``text``, each with the white space behind it.

    Every row stays, with all its columns; ``n_chars``, where there is one, follows the text. ``docs`` is read twice.
    """
    on_workers(docs.sparkSession)
    key, gone, doc_, key_ = (fresh(docs, n) for n in ("text_key", "spans", "span_doc", "span_key"))
    at = docs.columns.index("text")
    found = (
        spans(docs, window, shard_words).where("n_removed > 0").select(F.col("doc_id").alias(doc_), F.col("text_key").alias(key_), F.col("spans").alias(gone))
        .dropDuplicates([doc_, key_])
    )

    def add_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_text_key(b" ".join((t or "").encode("utf-8", "replace").split())) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.int64())], [*b.schema.names, key])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_cut(t, s) if s and t else t for t, s in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist())]
            cols = [pa.array(made, pa.string()) if k == at else c for k, c in enumerate(b.columns[:-1])]
            yield pa.RecordBatch.from_arrays(cols, b.schema.names[:-1])

    keyed = docs.mapInArrow(add_key, T.StructType([*docs.schema.fields, T.StructField(key, T.LongType())]))
    joined = keyed.join(found, (F.col("doc_id") == F.col(doc_)) & (F.col(key) == F.col(key_)), "left").select(*docs.columns, gone)
    out = joined.mapInArrow(apply, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op10_fm_substrings(spark: SparkSession, sf: str) -> DataFrame:
    return spans(read(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
