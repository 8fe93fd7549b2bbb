"""Importance resampling against a plain version with zlib's CRC of every feature."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skycast.llm import resample

COLUMNS = "doc_id long, text string, score string, rank int, Weight int"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest=2):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    words = WORD.findall(lower)
    return len(words), [b" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, longest=2, buckets=10_000, least=20, percent=25, seed=7):
    bucket = lambda f: zlib.crc32(f) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, longest)[1])
    t = Counter(bucket(f) for x in target for f in features(x, longest)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for doc, text in docs:
        n, own = features(text, longest)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return ordered(r[:5] for r in out)


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


def corpus(n, seed=0):
    rng = random.Random(seed)
    words = "Alpha beta, Gamma! delta-4 x9 Ünï ÇØDÉ 日本 the of and_to in".split()
    rows = [(i * 7 % n, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 19, 20, 21, 200])))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "word"), (n + 3, "x" * 100_000 + " y"), (n + 4, "a\x00b\x7fc`d{e@[/:")]


def run(spark, docs, target, **kw):
    df = spark.createDataFrame([(d, t, "s", 1, 2) for d, t in docs], COLUMNS)
    return ordered(resample.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), **kw).collect())


def test_draws_are_those_of_a_plain_version(spark):
    docs, target = corpus(150), ["alpha beta alpha", "日本 the of", None, ""]
    got = run(spark, docs, target)
    assert got == brute(docs, target)
    assert sum(r[4] is not None for r in got) > 10


def test_other_lengths_buckets_and_shares(spark):
    docs, target = corpus(60, 1), ["gamma delta 4 x9 ünï"]
    kw = {"longest": 4, "buckets": 97, "percent": 60, "seed": 3}
    assert run(spark, docs, target, least_words=1, **kw) == brute(docs, target, least=1, **kw)


def test_nulls_repeats_and_nothing(spark):
    text = "one two three four five " * 5
    docs = [(None, text), (None, text), (5, text), (5, text), (5, "other " * 30), (6, None)]
    assert run(spark, docs, [], percent=100) == brute(docs, [], percent=100)
    assert run(spark, [], ["a b"]) == []
    assert run(spark, docs, ["one two"], percent=0) == brute(docs, ["one two"], percent=0)


@pytest.mark.parametrize("seed", range(3))
def test_every_run_of_words_has_its_crc_from_two_prefixes(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("aZ09 .-é日\x00\x7f") for _ in range(rng.choice([0, 1, 30, 400]))).encode() for _ in range(20)]
    texts += [b"q" * n + b" " + b"r" * n for n in (1, 63, 64, 65, 127, 4000)]
    words, crcs, of = resample.features(texts, 3)
    for i, t in enumerate(texts):
        n, want = features(t.decode(), 3)
        assert words[i] == n and Counter(crcs[of == i].tolist()) == Counter(map(zlib.crc32, want))


def test_shifts_are_zero_bytes():
    c = np.array([1, 0xDEADBEEF, 0xFFFFFFFF], np.uint32)
    for n in (0, 1, 2, 63, 64, 65, 1000, 70_000):
        want = [zlib.crc32(b"\0" * n, int(x)) ^ zlib.crc32(b"\0" * n) for x in c]
        assert resample.shifted(c, np.full(3, n)).tolist() == want


def test_drawn_documents_lean_to_the_target(spark):
    rng = random.Random(4)
    near = [(i, " ".join(rng.choice("red green blue".split()) for _ in range(60))) for i in range(100)]
    far = [(i, " ".join(rng.choice("iron tin zinc".split()) for _ in range(60))) for i in range(100, 400)]
    drawn = [r[0] for r in run(spark, near + far, ["red green blue red blue green"] * 20) if r[4] is not None]
    assert len(drawn) == 100 and sum(d < 100 for d in drawn) > 90
