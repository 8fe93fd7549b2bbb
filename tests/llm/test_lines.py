"""Line dedup and its perfect hash against plain versions."""

import hashlib
import random
from collections import defaultdict

import numpy as np

from skycast.llm import lines

SPACE = " \t\n\x0b\x0c\r"
COLUMNS = "doc_id long, text string, n_lines string, Block int, shard long"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, least_chars=40, least_docs=5):
    """Per row: (n_lines, n_dropped, kept text)."""
    held = defaultdict(list)
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= least_chars:
                held[k].append(-1 if doc is None else doc)
    out = []
    for doc, text in rows:
        own = (text or "").split("\n")
        d = -1 if doc is None else doc
        kept = [x for x in own if not (len(held.get(key(x), ())) >= least_docs and d < max(held[key(x)]))]
        out.append((doc, len(own), len(own) - len(kept), None if text is None else "\n".join(kept)))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def corpus(n, seed=0):
    rng = random.Random(seed)
    common = [f"This Line {k} is FOUND in many documents, more than forty characters" for k in range(12)]
    common += ["é" * 39 + "x", "é" * 38 + "x", "日" * 40, "A" * 40, "\x1c" + "b" * 39, " " + "c" * 39 + " "]
    spaced = lambda x: rng.choice(["", " ", "\t\x0b"]) + (x.upper() if rng.random() < 0.2 and x.isascii() else x) + rng.choice(["", "\r", " \x0c"])
    rows = []
    for i in range(n):
        own = [spaced(rng.choice(common)) if rng.random() < 0.4 else f"own line {rng.random()} of document {i}, which is long" for _ in range(rng.randint(0, 12))]
        rows.append((i * 3 % n, "\n".join(own)))
    rows += [(None, common[0]), (None, None), (7, ""), (7, common[1] + "\n" + common[1]), (7, common[1]), (n + 5, "\n\n"), (2**40, "x" * 30 + " y" * 200_000)]
    return rows


def run(spark, rows, **sizes):
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], COLUMNS)
    got = lines.without_common_lines(df, **sizes).select("doc_id", "n_lines", "n_dropped", "text", "Block", "shard").collect()
    assert all((r.Block, r.shard) == (1, 2) for r in got)
    return ordered((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got)


def test_lines_as_a_plain_version_drops_them(spark):
    rows = corpus(400)
    want = ordered(brute(rows))
    assert sum(r[2] for r in want) > 100
    assert run(spark, rows) == want


def test_many_blocks_shards_and_copies_change_nothing(spark):
    rows = corpus(300, 1)
    assert run(spark, rows, shard_keys=3, block_bytes=2_000, per_copy=200) == ordered(brute(rows))


def test_other_bounds_and_small_tables(spark):
    rows = [(1, "a\nb"), (2, "A \nc"), (3, "b")]
    assert run(spark, rows, least_chars=1, least_docs=2) == ordered(brute(rows, 1, 2)) == [(1, 2, 2, ""), (2, 2, 0, "A \nc"), (3, 1, 0, "b")]
    assert run(spark, rows, least_chars=0, least_docs=2) == ordered(brute(rows, 0, 2))
    assert run(spark, []) == []
    assert run(spark, [(1, None), (None, None)]) == [(None, 1, 0, None), (1, 1, 0, None)]


def test_equal_rows_share_their_fate(spark):
    line = "the same long line in each of the documents of this table"
    assert run(spark, [(1, line)] * 4) == [(1, 1, 0, line)] * 4
    assert run(spark, [(1, line)] * 4 + [(2, line)]) == [(1, 1, 1, "")] * 4 + [(2, 1, 0, line)]
    assert run(spark, [(None, line)] * 5 + [(0, None)]) == ordered([(None, 1, 0, line)] * 5 + [(0, 1, 0, None)])


def test_perfect_hash_numbers_its_keys_without_gaps_and_knows_strangers():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 64, 65, 5000):
        keys = rng.integers(0, 2**63, (n, 2), dtype=np.uint64)
        if n > 10:
            keys[:5, 0] = 7  # equal first halves
        made = lines.PerfectHash.build(keys)
        assert sorted(made.numbers(keys).tolist()) == list(range(n))
        order = np.argsort(made.numbers(keys))
        shard = {"sizes": made.sizes.tobytes(), "bits": made.bits.tobytes(), "prints": keys[order, 1].tobytes(), "counts": np.arange(n)[order].tobytes(), "lasts": np.arange(n)[order].tobytes()}
        others = rng.integers(0, 2**63, (1000, 2), dtype=np.uint64)
        which, counts, _ = lines.probe(np.concatenate([others, keys]), shard)
        assert which.tolist() == list(range(1000, 1000 + n)) and counts.tolist() == list(range(n))
        assert len(made.bits) * 64 <= 6 * n + 64 * 40


def test_query_returns_the_digest_of_what_stays(spark, tmp_path):
    rows = [(i, t) for i, (_, t) in enumerate(corpus(60, 2))]
    spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in lines.op12_line_dedup(spark, str(tmp_path)).collect())
    assert got == sorted((d, n, k, hashlib.sha256((t or "").encode()).hexdigest()) for d, n, k, t in brute(rows))
