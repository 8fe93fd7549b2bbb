"""Byte-level BPE: each distinct word of the corpus is folded once, whatever the number of tasks."""

import random

from pyspark.sql import functions as F

from skycast.llm import bpe


def ranks_of(pieces):
    return {bytes([b]): b for b in range(256)} | {p: 256 + k for k, p in enumerate(pieces)}


def test_words_are_folded_once_for_all_blocks(spark, monkeypatch):
    folded = spark.sparkContext.accumulator(0)
    distinct = bpe._distinct

    def counting(shared):
        run = distinct(shared)

        def counted(table):
            out = run(table)
            folded.add(sum(x is not None or y is not None for x, y in zip(out.column("bytes").to_pylist(), out.column("word").to_pylist())))
            return out

        return counted

    monkeypatch.setattr(bpe, "_distinct", counting)
    docs = spark.range(40, numPartitions=4).select(F.col("id").alias("doc_id"), F.lit("the then there the").alias("text"))
    rows = bpe.encode(docs, ranks_of([b"th", b"the", b" the"]), r" ?\p{L}+").collect()
    assert len(rows) == 40 and all(bytes(r.decoded) == b"the then there the" for r in rows)
    assert folded.value == 4  # "the", " then", " there", " the"; once per task before


def test_ordered_fold_equals_the_stepwise_one(spark):
    rng = random.Random(3)
    rising, falling = ranks_of([b"aa", b"ab", b"aab", b"abaab"]), ranks_of([b"abc", b"bc", b"ab"])
    assert bpe.ranks_rise(rising) and not bpe.ranks_rise(falling)
    words = ["".join(rng.choice("aab") for _ in range(rng.randint(1, 62))) for _ in range(200)] + ["a" * 62, "b"]
    df = spark.createDataFrame([(w, list(w.encode())) for w in words], "word string, bytes array<int>")
    for r in df.select("word", bpe.merged_in_order(rising, F.col("bytes")).alias("ids")).collect():
        assert r.ids == bpe.merged_long(r.word.encode(), rising)


def test_numbers_of_words_come_back():
    import numpy as np

    for n in ([], [0], [255, 256, 7, 70_000, 0, 1 << 24]):
        assert bpe._numbers(bpe._coding(np.array(n, "<u4"))).tolist() == n
