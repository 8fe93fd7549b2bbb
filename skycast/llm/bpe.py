"""Byte-level BPE encoding and decoding: ranked merges folded over the distinct words of a stream of documents."""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skycast.session import staged

from .common import on_workers, read, text_of

RANKS = "byte_bpe_50k.tiktoken"
#: Cells of the rank map: a map is searched from its start, so each cell holds about one entry.
CELLS = 1 << 16
#: Distinct words that a task refers to before it starts a new dictionary.
DICTIONARY = 400_000
#: Bytes of references in a block of documents.
BLOCK = 32_000_000
#: Bytes of a word from which on a queue replaces the fold, whose work grows with the square of the length.
LONG = 200
NONE = 2**31 - 1
#: Bytes up to which a word's borders fit in the bits of a long.
BORDERS = 62
#: Steps along the tree that stand in the plan by themselves; longer pieces take the loop behind them.
STEPS = 8
#: White space of the patterns' \s. Fixed values.
SPACE = r"\t-\r\x20\x85\xa0  -     　"


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank files: a base64 piece and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


# --- merges, as column expressions ---------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. ``get`` would derive the type of the whole body for every row, ``array_max`` keeps it."""
    return F.array_max(F.transform(F.array(value), body))


def _cell(piece: bytes) -> int:
    import xxhash

    signed = xxhash.xxh64_intdigest(piece.decode("latin-1").encode(), 42)
    return signed & (CELLS - 1)


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as one literal: cells by hash, each a map from pieces to ranks. A piece is a string
    with one character (U+0000 to U+00FF) per byte. The optimizer folds the JSON into a literal."""
    cells: list[dict[str, int]] = [{} for _ in range(CELLS)]
    for piece, rank in ranks.items():
        cells[_cell(piece)][piece.decode("latin-1")] = rank
    return F.from_json(F.lit(json.dumps(cells)), "array<map<string,int>>")


def rank_of(table: Column, piece: Column) -> Column:
    cell = F.get(table, F.xxhash64(piece).bitwiseAND(F.lit(CELLS - 1)).cast("int"))
    return F.coalesce(F.try_element_at(cell, piece), F.lit(NONE))


def merged(table: Column, word: Column) -> Column:
    """The ids of a word (one character per byte): its bytes, and the merge of lowest rank, leftmost first, until none is left.

    A fold over as many steps as the word could need; its state are the pieces and the ranks of
    each two neighbours, of which a merge changes two.
    """
    pieces0 = F.split(word, "")
    ranks0 = lambda p: F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda x, i: rank_of(table, F.concat(F.get(p, i), x)))
    state = lambda p, r: F.struct(p.alias("p"), r.alias("r"))
    none = F.array().cast("array<int>")

    def merge(s: Column, least: Column) -> Column:
        p, r = s["p"], s["r"]

        def at(i: Column) -> Column:  # 1-based place of the pair
            both = F.concat(F.get(p, i - 1), F.get(p, i))
            return let(both, lambda m: state(
                F.concat(F.slice(p, F.lit(1), i - 1), F.array(m), F.slice(p, i + 2, F.size(p))),
                F.concat(
                    F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))),
                    F.when(i > 1, F.array(rank_of(table, F.concat(F.get(p, i - 2), m)))).otherwise(none),
                    F.when(i + 1 < F.size(p), F.array(rank_of(table, F.concat(m, F.get(p, i + 1))))).otherwise(none),
                    F.slice(r, i + 2, F.size(p)),
                ),
            ))

        return let(F.array_position(r, least).cast("int"), at)

    def step(s: Column, _: Column) -> Column:
        return let(F.coalesce(F.array_min(s["r"]), F.lit(NONE)), lambda least: F.when(least == NONE, s).otherwise(merge(s, least)))

    folded = let(pieces0, lambda p: F.aggregate(p, let(p, lambda q: state(q, ranks0(q))), step, lambda s: s["p"]))
    whole = rank_of(table, word)
    return let(whole, lambda w: F.when(w != NONE, F.array(w)).otherwise(F.transform(folded, lambda x: rank_of(table, x))))


def rank_tree(ranks: dict[bytes, int]) -> tuple[list[int], list[int], list[int]]:
    """The ranks as a tree of bytes in three arrays: the child of node ``v`` by byte ``b`` is ``child[base[v] + b]``
    where ``owner`` has ``v`` there. A piece's node is its rank; beginnings that are no pieces follow."""
    nodes, rows = dict(ranks), {}
    count = max(ranks.values()) + 1
    for piece in ranks:
        for k in range(2, len(piece) + 1):
            if piece[:k] not in nodes:
                nodes[piece[:k]] = count
                count += 1
            rows.setdefault(nodes[piece[: k - 1]], {})[piece[k - 1]] = nodes[piece[:k]]
    base, owner, child = [0] * count, [-1] * (2 * count + 512), [-1] * (2 * count + 512)
    low = 256
    for v, row in sorted(rows.items(), key=lambda r: -len(r[1])):
        head, *others = sorted(row)
        at = low
        while owner[at] >= 0 or any(owner[at - head + b] >= 0 for b in others):
            at += 1
        low = max(low, at if not others else at - 100)
        base[v] = at - head
        for b, c in row.items():
            owner[base[v] + b], child[base[v] + b] = v, c
    end = max((k for k, v in enumerate(owner) if v >= 0), default=0) + 1
    return base, owner[:end], child[:end]


def ranks_rise(ranks: dict[bytes, int]) -> bool:
    """Whether the merges of any word come in the order of their ranks: each byte is a piece, and each longer piece comes of
    the merges of lower rank and one of its own. Then no merge makes a pair of lower rank: such a pair is a piece whose
    bytes the earlier merges would have joined already."""
    if any(bytes([b]) not in ranks for b in range(256)) or not 0 <= max(ranks.values()) < 1 << 18 or len(set(ranks.values())) < len(ranks):
        return False
    return all(len(p) < 2 or len(merged_long(p, ranks, r)) == 2 for p, r in ranks.items())


def merged_in_order(ranks: dict[bytes, int], word: Column) -> Column:
    """As ``merged``, for words (bytes as integers) of at most BORDERS bytes, where ``ranks_rise``.

    The tree gives every span of the word that is a piece. A fold over these spans by rank, leftmost first, merges a span
    where it is two pieces by now; its state is a long with a bit for each border. Each table is bound once, since every
    mention of a literal is a copy of its own in every task.
    """
    table = lambda values, kind="int": F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")
    tree = [table(t) for t in rank_tree(ranks)]
    single = table([ranks[bytes([b])] for b in range(256)])
    pieces = max(ranks.values()) + 1
    # By span, 64 * begin + end: its two borders, and all bits from the one to the other.
    spans = [(k >> 6, k & 63) if k >> 6 < k & 63 <= BORDERS else None for k in range(4096)]
    ends_ = [(1 << s[0]) + (1 << s[1]) if s else 0 for s in spans]
    whole_ = [(2 << s[1]) - (1 << s[0]) if s else 0 for s in spans]
    masks = [table(t, "bigint") for t in (ends_, whole_, [~w for w in whole_])]

    def bound(tables: list[Column], body: Callable[..., Column], *got: Column) -> Column:
        return let(tables[0], lambda t: bound(tables[1:], body, *got, t)) if tables else body(*got)

    return bound([*tree, single, *masks], lambda *t: _folded(word, pieces, *t))


def _folded(word: Column, pieces: int, base: Column, owner: Column, child: Column, bytes_: Column, ends: Column, whole: Column, outside: Column) -> Column:
    def further(nodes: Column, n: Column) -> Column:  # from spans of n bytes to those of n + 1, by where they begin
        def child_of(v: Column, i: Column) -> Column:
            slot = F.get(base, v) + F.get(word, i + n)
            return F.when(F.get(owner, slot) == v, F.get(child, slot))

        return F.transform(nodes, child_of)

    found = lambda nodes, n: F.transform(nodes, lambda v, i: v * 4096 + (i * 65 + n))

    def longer(nodes: Column, known: Column) -> Column:
        state = lambda v, a: F.struct(v.alias("v"), a.alias("a"))
        step = lambda s, n: let(further(s["v"], n), lambda v: state(v, F.concat(s["a"], found(v, n + 1))))
        loop = F.aggregate(F.sequence(F.lit(STEPS), F.size(word) - 1), state(nodes, known), step, lambda s: s["a"])
        return F.when(F.exists(nodes, lambda v: v.isNotNull()) & (F.size(word) > STEPS), loop).otherwise(known)

    def steps(n: int, nodes: Column, got: list[Column]) -> Column:
        if n == STEPS:
            return ids(longer(nodes, F.concat(*got)))
        return let(further(nodes, F.lit(n)), lambda v: steps(n + 1, v, [*got, found(v, F.lit(n + 1))]))

    def merge(borders: Column, span: Column) -> Column:
        two = (F.bit_count(borders.bitwiseAND(F.get(whole, span))) == 3) & (borders.bitwiseAND(F.get(ends, span)) == F.get(ends, span))
        return F.when(two, borders.bitwiseAND(F.get(outside, span)).bitwiseOR(F.get(ends, span))).otherwise(borders)

    def ids(spans: Column) -> Column:
        place = lambda c: c.bitwiseAND(F.lit(4095))
        rank = lambda c: F.shiftright(c, 12)

        def left(known: Column) -> Column:
            folded = F.aggregate(F.transform(F.sort_array(known), place), F.lit(-1).cast("long"), merge)
            single = F.transform(word, lambda b, i: F.get(bytes_, b) * 4096 + (i * 65 + 1))
            stands = lambda m: lambda c: m.bitwiseAND(F.get(whole, place(c))) == F.get(ends, place(c))
            by_place = lambda c: place(c).cast("long") * (1 << 20) + rank(c)
            kept = let(folded, lambda m: F.filter(F.concat(single, known), stands(m)))
            return F.transform(F.sort_array(F.transform(kept, by_place)), lambda c: c.bitwiseAND(F.lit((1 << 20) - 1)).cast("int"))

        return let(F.filter(spans, lambda c: c < pieces * 4096), left)

    return steps(1, F.transform(word, lambda b: F.get(bytes_, b)), [])


def decoded(pieces: Column, ids: Column) -> Column:
    """The bytes of ids, one character per byte: the pieces of the ids one after the other."""
    return F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")


def merged_long(word: bytes, ranks: dict[bytes, int], below: int = NONE) -> list[int]:
    """The same merges for a long word, with the pairs in a queue by rank and place; only those of a rank ``below`` the given one."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the piece that begins here
    alive = [True] * n
    queue: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n:
            end = after[after[i]]
            if (rank := ranks.get(word[i:end], NONE)) < below:
                heappush(queue, (rank, i, end))

    for i in range(n):
        offer(i)
    while queue:
        _, i, end = heappop(queue)
        if not alive[i] or after[i] >= n or after[after[i]] != end:
            continue
        alive[after[i]] = False
        after[i] = end
        if end < n:
            before[end] = i
        offer(before[i])
        offer(i)
    return [ranks[word[i : after[i]]] for i in range(n) if alive[i]]


# --- documents as a stream of new words and references -----------------------------------


class Splitter:
    """Cuts texts into words and numbers the words of a dictionary.

    Between two words stands no boundary but those of the pattern, and none of its matches goes on
    over a blank that follows a character that is no white space; so the words of a chunk
    between such blanks, its blank included, depend on the chunk alone, and each chunk is cut once.
    """

    def __init__(self, pattern: str):
        import regex

        self.find = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")).findall
        self.reset()

    def reset(self) -> None:
        self.refs: dict[str, bytes] = {}  # of words
        self.chunks: dict[str, bytes] = {}  # of chunks behind a blank
        self.new: list[str] = []

    def _ref(self, word: str) -> bytes:
        if (got := self.refs.get(word)) is None:
            got = self.refs[word] = len(self.refs).to_bytes(4, "little")
            self.new.append(word)
        return got

    def _chunk(self, c: str) -> bytes:
        if c.isalpha():
            got = self._ref(" " + c)
        elif c.endswith((",", ".")) and c[:-1].isalpha():
            got = self._ref(" " + c[:-1]) + self._ref(c[-1])
        else:
            got = b"".join(map(self._ref, self.find(" " + c)))
        self.chunks[c] = got
        return got

    def words(self, text: str) -> bytes:
        """References of the text's words, little-endian 32-bit numbers."""
        first, *rest = text.split(" ")
        known = self.chunks
        for c in set(rest).difference(known):
            if not c or c[-1].isspace():  # the blanks around it belong together
                return b"".join(map(self._ref, self.find(text)))
            self._chunk(c)
        if first and first[-1].isspace():
            return b"".join(map(self._ref, self.find(text)))
        return b"".join([*map(self._ref, self.find(first)), *map(known.__getitem__, rest)])


def _referred(pattern: str, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, ranks = Splitter(pattern), shared.value
        starts = True
        for b in batches:
            rows: list[tuple] = []
            size = 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(split.refs) > DICTIONARY:
                    split.reset()
                    starts = True
                refs = split.words(text)
                for w in split.new:
                    raw = w.encode("utf-8", "replace")
                    rows.append((starts, raw.decode("latin-1"), None, None, merged_long(raw, ranks) if len(raw) > LONG else None))
                    starts = False
                    size += len(w)
                split.new.clear()
                rows.append((False, None, doc, refs, None))
                size += len(refs)
                if size > 8_000_000:
                    yield _batch(rows)
                    rows, size = [], 0
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("starts", pa.bool_()), ("word", pa.string()), ("doc_id", pa.int64()), ("refs", pa.binary()), ("long", pa.list_(pa.int32())))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])


def _joined(finish: Callable[[int, bytes, bytes], tuple], names: list[str], types: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        ids: list[bytes] = []
        back: list[bytes] = []
        for b in batches:
            out: list[tuple] = []
            starts, docs, refs, got, text = (c.to_pylist() if k != 3 else c for k, c in enumerate(b.columns))
            flat, ends = np.asarray(got.flatten(), "<u4").tobytes(), (np.asarray(got.offsets).astype(np.int64) - got.offsets[0].as_py()) * 4
            ends = ends.tolist()
            for k, r in enumerate(refs):
                if r is None:
                    if starts[k]:
                        ids, back = [], []
                    ids.append(flat[ends[k] : ends[k + 1]])
                    back.append(text[k].encode("latin-1"))
                else:
                    own = np.frombuffer(r, "<u4").tolist()
                    out.append(finish(docs[k], b"".join(map(ids.__getitem__, own)), b"".join(map(back.__getitem__, own))))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names)

    return run


def _packed(values) -> bytes:
    """32-bit numbers, compressed by the planes of their bytes."""
    import numpy as np

    return zlib.compress(np.asarray(values, "<u4").view("u1").reshape(-1, 4).T.tobytes(), 1)


def _unpacked(blob: bytes):
    import numpy as np

    return np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), "u1").reshape(4, -1).T).view("<u4").ravel()


def _coding(numbers) -> bytes:
    """Numbers of words, the frequent ones small: what is above the lowest byte, then the lowest bytes, those of the most frequent words first."""
    import numpy as np

    high, low = numbers >> 8, numbers.astype("u1")
    head = _packed(high)
    code = zlib.compressobj(6, zlib.DEFLATED, 15, 9, zlib.Z_HUFFMAN_ONLY)
    return len(head).to_bytes(4, "little") + head + code.compress(np.concatenate([low[high == 0], low[high > 0]]).tobytes()) + code.flush()


def _numbers(blob: bytes):
    import numpy as np

    end = 4 + int.from_bytes(blob[:4], "little")
    high, low = _unpacked(blob[4:end]), np.frombuffer(zlib.decompress(blob[end:]), "u1")
    out = high << 8
    few = int((high == 0).sum())
    out[high == 0] |= low[:few]
    out[high > 0] |= low[few:]
    return out


def _dealt(pattern: str, shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of documents: a row with each block's references, and a row for each shard with the block's distinct words of that shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        split, part, blocks = Splitter(pattern), TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        refs: list[bytes] = []

        def block() -> pa.RecordBatch:
            split.chunks.clear(), split.refs.clear()
            counts, flat = _packed([len(r) // 4 for r in refs]), np.frombuffer(b"".join(refs), "<u4")
            refs.clear()
            number = np.empty(len(split.new), "<u4")
            sent: list[list[bytes]] = [[] for _ in range(shards)]
            for k in np.argsort(-np.bincount(flat, minlength=len(number)), kind="stable").tolist():
                raw = split.new[k].encode("utf-8", "replace")
                own = sent[zlib.crc32(raw) % shards]
                number[k] = len(own) * shards + zlib.crc32(raw) % shards  # by place and shard, so the frequent ones are small
                own.append(raw)
            name = (part << 24) + blocks
            rows = [(name, None, docs, counts, _coding(number[flat]))]
            rows += [(name, k, None, _packed([len(w) for w in ws]), zlib.compress(b"".join(ws), 6)) for k, ws in enumerate(sent) if ws]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(DEALT)], schema=DEALT)

        size = 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(split.refs) > DICTIONARY or len(split.chunks) > 2 * DICTIONARY or size > BLOCK:
                    yield block()
                    split.reset()
                    docs.clear()
                    blocks, size = blocks + 1, 0
                docs.append(doc)
                refs.append(split.words(text))
                size += len(refs[-1])
        if docs:
            yield block()

    return run


def _distinct(shared) -> Callable[[pa.Table], pa.Table]:
    """Of a shard's words: each distinct one as a row, then a row for each block with references to them."""

    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        ranks, known = shared.value, {}
        rows: list[tuple] = []
        for name, shard, sizes, words in zip(*(table.column(c).to_pylist() for c in ("block", "shard", "sizes", "words"))):
            text, ends = zlib.decompress(words), np.cumsum(_unpacked(sizes)).tolist()
            own = [known.setdefault(text[i:j], len(known)) for i, j in zip([0, *ends], ends)]
            rows.append((False, None, None, name, shard, np.asarray(own, "<u4").tobytes(), None))
        first = []
        for k, w in enumerate(known):
            short = len(w) <= BORDERS
            long = merged_long(w, ranks) if len(w) > LONG else None
            first.append((k == 0, list(w) if short else None, None if short or long else w.decode("latin-1"), None, None, None, long))
        rows = first + rows
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(DISTINCT)], schema=DISTINCT)

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and shard the ids of its words, in the order they were sent."""
    import numpy as np

    ids: list[bytes] = []
    for b in batches:
        out: list[tuple] = []
        starts, blocks, shards, refs = (b.column(k).to_pylist() for k in range(4))
        got = b.column(4)
        flat = np.asarray(got.flatten(), "<u4").tobytes()
        ends = ((np.asarray(got.offsets).astype(np.int64) - got.offsets[0].as_py()) * 4).tolist()
        for k, r in enumerate(refs):
            if r is None:
                if starts[k]:
                    ids = []
                ids.append(flat[ends[k] : ends[k + 1]])
            else:
                own = [ids[n] for n in np.frombuffer(r, "<u4").tolist()]
                out.append((blocks[k], shards[k], _packed([len(x) // 4 for x in own]), _packed(np.frombuffer(b"".join(own), "<u4"))))
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], f.type) for k, f in enumerate(ANSWERED)], schema=ANSWERED)


def _finished(finish: Callable[[int, bytes, bytes], tuple], names: list[str], types: list[pa.DataType], shared, shards: int):
    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        import numpy as np

        pieces = {rank: piece for piece, rank in shared.value.items()}
        out: list[tuple] = []
        ids: dict[int, bytes] = {}
        back: dict[int, bytes] = {}
        for shard, sizes, got in zip(*(answers.column(c).to_pylist() for c in ("shard", "sizes", "ids"))):
            flat, ends = _unpacked(got), np.cumsum(_unpacked(sizes), dtype=np.int64).tolist()
            raw, text = flat.tobytes(), [pieces[i] for i in flat.tolist()]
            for n, (i, j) in enumerate(zip([0, *ends], ends)):
                ids[n * shards + shard] = raw[4 * i : 4 * j]
                back[n * shards + shard] = b"".join(text[i:j])
        for docs, counts, refs in zip(*(own.column(c).to_pylist() for c in ("docs", "sizes", "words"))):
            refs, at = _numbers(refs), 0
            for doc, count in zip(docs, _unpacked(counts).tolist()):
                mine = refs[at : at + count].tolist()
                at += count
                out.append(finish(doc, b"".join(map(ids.__getitem__, mine)), b"".join(map(back.__getitem__, mine))))
        return pa.Table.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names)

    return run


DEALT = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("docs", pa.list_(pa.int64())), ("sizes", pa.binary()), ("words", pa.binary())])
DISTINCT = pa.schema([("starts", pa.bool_()), ("bytes", pa.list_(pa.int32())), ("word", pa.string()), ("block", pa.int64()), ("shard", pa.int32()), ("refs", pa.binary()), ("long", pa.list_(pa.int32()))])
ANSWERED = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("sizes", pa.binary()), ("ids", pa.binary())])


def _coded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, finish, names: list[str], types: list[pa.DataType], schema: str) -> DataFrame:
    """Documents stay in blocks that send their distinct words to shards by hash. There each distinct word of the corpus is
    folded once, and its ids go back to the blocks that have it."""
    spark = docs.sparkSession
    on_workers(spark)
    shared = spark.sparkContext.broadcast(ranks)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    shards = 24 + texts.rdd.getNumPartitions() // 4
    dealt = texts.mapInArrow(_dealt(pattern, shards), "block long, shard int, docs array<long>, sizes binary, words binary")
    dealt = staged(dealt, "words")
    sent = dealt.where("shard is not null").select("block", "shard", "sizes", "words").repartition(shards, "shard")
    stream = sent.groupBy("shard").applyInArrow(_distinct(shared), "starts boolean, bytes array<int>, word string, block long, shard int, refs binary, long array<int>")
    fold = let(rank_map(ranks), lambda table: F.when(F.col("word").isNotNull(), merged(table, F.col("word"))))
    if ranks_rise(ranks):
        fold = F.when(F.col("bytes").isNotNull(), merged_in_order(ranks, F.col("bytes"))).otherwise(fold)
    else:
        stream = stream.withColumn("word", F.coalesce("word", F.array_join(F.transform("bytes", lambda b: F.char(b)), "")))
    coded = stream.select("starts", "block", "shard", "refs", F.coalesce("long", fold).alias("ids"))
    answers = coded.mapInArrow(_answered, "block long, shard int, sizes binary, ids binary")
    own = dealt.where("shard is null").select("block", "docs", "sizes", "words")
    return own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_finished(finish, names, types, shared, shards), schema)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, ids (array<int>) and decoded (binary) of every whole text.

    ``pattern`` cuts a text into words, each is encoded by itself. A null text counts as empty and has no ids; repeated rows
    give repeated rows. Words over LONG bytes are merged by a queue in the task that meets them. Nothing is shuffled: each task names a word once and refers to it
    from its documents, so a word is encoded once per task, whatever the document, and memory is
    bounded by the dictionary (DICTIONARY words) and the longest text.
    """
    import numpy as np

    finish = lambda d, ids, back: (d, np.frombuffer(ids, "<u4").tolist(), back)
    types = [pa.int64(), pa.list_(pa.int32()), pa.binary()]
    return _coded(docs, ranks, pattern, finish, ["doc_id", "ids", "decoded"], types, "doc_id long, ids array<int>, decoded binary")


def decode(coded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Adds ``decoded`` (binary) to rows with ``ids``: the pieces of the ids one after the other; null ids give null."""
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    vocabulary = F.from_json(F.lit(json.dumps([p.decode("latin-1") for p in pieces])), "array<string>")
    return coded.withColumn("decoded", F.encode(decoded(vocabulary, F.col("ids")), "ISO-8859-1"))


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256; as ``encode``, without its arrays."""

    def finish(doc: int, ids: bytes, back: bytes) -> tuple:
        return doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()

    names, types = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.int64(), pa.string(), pa.string()]
    return _coded(docs, ranks, pattern, finish, names, types, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return digests(read(spark, sf, "documents"), read_ranks(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN)
