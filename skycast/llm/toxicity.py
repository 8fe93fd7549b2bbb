"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skycast.session import staged

from .common import on_workers, read, text_of
from .labelled import SAMPLE, fold, logistic, sample

#: Lengths of the n-grams, in code points.
SIZES = (3, 4, 5, 6)
#: n-grams are counted in 2 ** BITS cells.
BITS = 20
#: Cells the classifier may use: those that tell the classes apart best.
FEATURES = 4_000
#: Documents that a cell must occur in.
LEAST = 4
#: Tasks that count the bounded sample.
COUNT_TASKS = 8
#: Code points that are hashed at once, so that memory does not follow the longest text.
BLOCK = 1_000_000
RIDGE = 3e-5
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.5


def grams(text: str) -> Iterator[np.ndarray]:
    """Cells of all n-grams of the whole text: lower case, white space as one blank, a blank at either end."""
    s = " " + " ".join(text.lower().split()) + " "
    longest = max(SIZES)
    for at in range(0, len(s), BLOCK):
        # the block, and what n-grams that begin in it need from the next
        code = np.frombuffer(s[at : at + BLOCK + longest - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        h = code.copy()
        for n in range(2, longest + 1):
            if len(code) < n:
                break
            h = h[:-1] * np.uint32(0x01000193) + code[n - 1 :]
            if n in SIZES:
                x = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
                yield (x >> np.uint32(32 - BITS))[:BLOCK]


def cells(text: str, among: np.ndarray | None = None) -> np.ndarray:
    """The distinct cells of a text, of those that ``among`` marks."""
    found = [np.empty(0, np.uint32)]
    for g in grams(text):
        found.append(np.unique(g if among is None else g[among[g]]))
    return np.unique(np.concatenate(found))


@dataclass
class Model:
    """Weight of each used cell, and the intercept."""

    used: np.ndarray
    weights: np.ndarray
    intercept: float

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        among, weight = np.zeros(2**BITS, bool), np.zeros(2**BITS)
        among[self.used], weight[self.used] = True, self.weights
        return among, weight


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """In how many documents of class 1 and 0 each cell occurs, and how many there are. Rows: text, y."""
    width, parts = 2**BITS, 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, width), np.int32)
        n = [0, 0]
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[y, cells(text)] += 1
                n[y] += 1
        cut = seen.reshape(2, parts, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(parts), pa.int32()), pa.array([cut[:, k].tobytes() for k in range(parts)]), pa.array([n[1]] * parts), pa.array([n[0]] * parts)],
            ["part", "counts", "ones", "zeros"],
        )

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in table["counts"].to_pylist())
        sums = [sum(table[c].to_pylist()) for c in ("ones", "zeros")]
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": [total.astype(np.int32).tobytes()], "ones": [sums[0]], "zeros": [sums[1]]})

    schema = "part int, counts binary, ones long, zeros long"
    got = sorted(rows.select("text", "y").repartition(COUNT_TASKS).mapInArrow(count, schema).groupBy("part").applyInArrow(add, schema).collect())
    if not got:
        return np.zeros(width, np.int32), np.zeros(width, np.int32), 0, 0
    both = np.concatenate([np.frombuffer(r.counts, np.int32).reshape(2, -1) for r in got], axis=1)
    return both[1], both[0], got[0].ones, got[0].zeros


def fit(rows: DataFrame, features: int = FEATURES) -> Model:
    """Fits on a bounded table of text and y (see ``labelled.sample``).

    The executors count cells by class; the driver receives the counts (2 ** BITS cells) and, of each
    document, its used cells (at most ``features``). A cell's input is its log-count ratio if
    the document has it, else 0. Rows without a label are left out; without both classes
    the score is the smoothed share of ones.
    """
    on_workers(rows.sparkSession)
    rows = staged(rows.where(F.col("y").isNotNull()).select(text_of().alias("text"), F.col("y").cast("int").alias("y")), "toxic-sample")
    ones, zeros, n1, n0 = _counts(rows)
    p, q = (ones + 1) / (n1 + 2), (zeros + 1) / (n0 + 2)
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    share = (ones + zeros) / max(1, n1 + n0)
    gap = np.abs(ones / max(1, n1) - zeros / max(1, n0)) / np.sqrt(share * (1 - share) * (1 / max(1, n1) + 1 / max(1, n0)) + 1e-9)
    gap[(ones + zeros) < LEAST] = 0
    used = np.sort(np.argsort(-gap, kind="stable")[:features]).astype(np.uint32)
    used = used[gap[used] > 0]
    among = np.zeros(2**BITS, bool)
    among[used] = True

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.searchsorted(used, cells(t, among)).astype(np.uint16).tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), b.column(1)], ["cells", "y"])

    table = rows.mapInArrow(hits, "cells binary, y int").toArrow()
    own = [np.frombuffer(x, np.uint16) for x in table["cells"].to_pylist()]
    y = np.array(table["y"].to_pylist(), float)
    at = np.repeat(np.arange(len(own)), [len(x) for x in own])
    cols = np.concatenate([np.empty(0, np.uint16), *own]).astype(np.int64)
    scale = ratio[used]
    w, b = logistic(at, cols, scale[cols], y, len(used), ridge=RIDGE)
    return Model(used, w * scale, b)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Adds ``name``, the likelihood of label 1, from the whole ``text``; a null text counts as empty.

    All columns of the input stay, one of that name is replaced.
    """
    on_workers(docs.sparkSession)
    docs = docs.drop(name)
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among, weight = shared.value.tables()
        for b in batches:
            z = np.array([weight[cells(t or "", among)].sum() for t in b.column(at).to_pylist()], float) + shared.value.intercept
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], [*b.schema.names, name])

    return docs.mapInArrow(apply, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def fitted(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """The model for ``labels.toxic`` from rows outside the held-out fold."""
    return fit(sample(docs, labels, "toxic", fold("doc_id", FOLDS) != HELD_OUT, most))


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    model = fitted(docs, read(spark, sf, "labels"))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
