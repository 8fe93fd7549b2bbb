"""Quality: a sparse ensemble of rules over text statistics, applied as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import on_workers, read
from .labelled import SAMPLE, fold, logistic, sample

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
#: Trees, their depth, and the cut points tried for each statistic.
TREES, DEPTH, CUTS = 40, 3, 24
#: Most rows that one tree is grown on, drawn from the sample for each tree; the rules' weights use all of it.
TREE_ROWS = 4_000
#: Rows a rule must hold for, and the lasso penalty.
LEAST, LASSO = 12, 4e-4

STATISTICS = (
    "log_chars", "log_words", "mean_word", "distinct_words", "repeated_words", "distinct_lines", "upper_words", "title_words",
    "marks", "pipes", "exclamations", "stops", "commas", "digits", "other_ascii", "beyond_ascii", "line_share",
)
_MARKS = np.frombuffer(b"#$%&*@^~", np.uint8)
_DIGITS = np.frombuffer(b"0123456789", np.uint8)
_OTHER = np.frombuffer(b"\"'()+-/:;<=>?[\\]_`{}", np.uint8)


def statistics(text: str) -> tuple[float, ...]:
    """The values of STATISTICS for one whole text; shares are of words, lines or bytes, 0 where there are none."""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, size, rows = max(1, len(words)), max(1, int(raw.sum())), max(1, len(lines))
    return (
        float(np.log1p(len(text))), float(np.log1p(len(words))), sum(map(len, words)) / n, len(set(words)) / n,
        sum(map(str.__eq__, words, words[1:])) / n, len(set(lines)) / rows, sum(map(str.isupper, words)) / n, sum(map(str.istitle, words)) / n,
        float(raw[_MARKS].sum()) / size, raw[124] / size, raw[33] / size, raw[46] / size, raw[44] / size, raw[_DIGITS].sum() / size,
        raw[_OTHER].sum() / size, raw[128:].sum() / size, rows / n,
    )


def with_statistics(docs: DataFrame, prefix: str = "stat_") -> DataFrame:
    """Adds a double column for each statistic of ``text`` (null counts as empty); columns of these names are replaced."""
    on_workers(docs.sparkSession)
    names = [prefix + s for s in STATISTICS]
    docs = docs.drop(*names)
    at = docs.columns.index("text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([statistics(t or "") for t in b.column(at).to_pylist()], float).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c) for c in made.T.copy())], [*b.schema.names, *names])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)]))


@dataclass
class Rules:
    """Rules as conjunctions of (statistic, over, cut), their weights, and the intercept."""

    rules: list[tuple[tuple[int, bool, float], ...]]
    weights: list[float]
    intercept: float

    def column(self, prefix: str = "stat_") -> Column:
        """The score from 0 to 1 as a column over the statistics: a balanced sum, since plans of deep chains cost the driver memory."""
        terms = [F.lit(self.intercept)]
        for rule, w in zip(self.rules, self.weights):
            sides = [F.col(prefix + STATISTICS[k]) > cut if over else F.col(prefix + STATISTICS[k]) <= cut for k, over, cut in rule]
            held = reduce(lambda a, b: a & b, sides)
            terms.append(F.when(held, F.lit(w)).otherwise(F.lit(0.0)))
        while len(terms) > 1:
            terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) & ~1 :]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-terms[0]))


def _paths(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> list[tuple[tuple[int, bool, float], ...]]:
    """All paths from the root of one tree to its nodes, on a draw of the rows and statistics."""
    out: list[tuple[tuple[int, bool, float], ...]] = []

    def grow(rows: np.ndarray, path: tuple[tuple[int, bool, float], ...]) -> None:
        if path:
            out.append(path)
        if len(path) == DEPTH or len(rows) < 2 * LEAST or y[rows].min() == y[rows].max():
            return
        best = (1e-6, -1, 0.0)
        mean, m = y[rows].mean(), len(rows)
        for k in rng.choice(x.shape[1], size=max(1, x.shape[1] * 2 // 3), replace=False):
            v = x[rows, k]
            order = np.argsort(v, kind="stable")
            total = np.cumsum(y[rows][order])
            cuts = np.unique(np.quantile(v, np.linspace(0.01, 0.99, CUTS), method="lower"))
            n = np.searchsorted(v[order], cuts, side="right")
            ok = (n >= LEAST) & (n <= m - LEAST)
            if not ok.any():
                continue
            n, cuts = n[ok], cuts[ok]
            left = total[n - 1]
            gain = left**2 / n + (total[-1] - left) ** 2 / (m - n) - m * mean**2
            g = int(gain.argmax())
            if gain[g] > best[0]:
                # between two values, so that no rounding decides
                above = v[order][n[g]] if n[g] < m else cuts[g]
                best = (float(gain[g]), int(k), float((cuts[g] + above) / 2))
        if best[1] < 0:
            return
        _, k, cut = best
        over = x[rows, k] > cut
        for side in (False, True):
            grow(rows[over == side], (*path, (k, side, cut)))

    grow(rng.choice(len(y), size=min(len(y), TREE_ROWS), replace=False), ())
    return out


def _holds(x: np.ndarray, rule: tuple[tuple[int, bool, float], ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, over, cut in rule:
        out &= x[:, k] > cut if over else x[:, k] <= cut
    return out


def fit(x: np.ndarray, y: np.ndarray, seed: int = 0) -> Rules:
    """Rules from trees on random draws, weighted by a lasso logistic fit; rules of weight 0 are dropped.

    Without rows or without both classes only the intercept is left.
    """
    if not len(y) or y.min() == y.max():
        return Rules([], [], logistic(np.empty(0, int), np.empty(0, int), np.empty(0), y, 0)[1] if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    rules = list(dict.fromkeys(p for _ in range(TREES) for p in _paths(x, y, rng)))
    held: dict[bytes, int] = {}
    for k, r in enumerate(rules):  # rules that hold for the same rows say the same: the shortest stays
        bits = np.packbits(_holds(x, r)).tobytes()
        if bits not in held or len(rules[held[bits]]) > len(r):
            held[bits] = k
    rules = [rules[k] for k in sorted(held.values())]
    matrix = np.array([_holds(x, r) for r in rules]).T
    at, cols = np.nonzero(matrix)
    w, b = logistic(at, cols, np.ones(len(at)), y, len(rules), lasso=LASSO, steps=300)
    kept = [k for k in range(len(rules)) if abs(w[k]) > 1e-3]
    return Rules([rules[k] for k in kept], [float(w[k]) for k in kept], b)


def fitted(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Rules:
    """Rules for ``labels.quality`` from rows outside the held-out fold. The driver receives the
    statistics of the sample: ``most`` rows of a few numbers."""
    rows = with_statistics(sample(docs, labels, "quality", fold("doc_id", FOLDS) != HELD_OUT, most))
    got = rows.select("doc_id", "y", *("stat_" + s for s in STATISTICS)).toArrow().to_pandas().sort_values("doc_id", kind="stable")
    return fit(got[["stat_" + s for s in STATISTICS]].to_numpy(float), got["y"].to_numpy(float))


def score(docs: DataFrame, rules: Rules, name: str = "score") -> DataFrame:
    """Adds ``name``, the likelihood of label 1, from the whole ``text``; a column of that name is replaced.

    A null text counts as empty; an empty text has all statistics 0 and gets a score like any other.
    """
    names = ["stat_" + s for s in STATISTICS]
    made = with_statistics(docs.drop(name))
    return made.withColumn(name, rules.column()).drop(*names)


def op4_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    rules = fitted(docs, read(spark, sf, "labels"))
    return score(docs.select("doc_id", "text"), rules).select(
        "doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
