"""Quality classifier: a sparse rule ensemble over text statistics.

Shallow trees are boosted on the statistics of a bounded labelled sample; every path from a root is one conjunctive
rule; a lasso logistic regression over the rules keeps few of them; what it keeps is compiled into one Spark column
expression over the statistics, which are taken from every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, prefix_sums, span_hashes, table, text_blocks

#: statistics a rule may test, none of which reads labels, language, source or id
STATS = ("n_bytes", "n_words", "word_length", "upper", "digit", "symbol", "pipe", "bang", "stop", "comma", "non_ascii", "line_words", "repeat_next", "repeat_two", "distinct")
#: rows the trees and the lasso are fitted on at most
FIT_ROWS = 20_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_UPPER, _DIGIT, _SYMBOL, _WIDE = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'-|!"]] = True
_WIDE[128:] = True


def block_stats(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of STATS for each text of a block; shares are of bytes or of words, 0 for an empty text."""
    n = np.diff(offs)

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return np.diff(total[offs])

    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    first = offs[:-1][n > 0]
    begins[first] = ~space[first]
    ends = ~space
    ends[:-1] &= space[1:]
    last = offs[1:][n > 0] - 1
    ends[last] = ~space[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    words = per_text(begins)
    wide_upper = np.zeros(len(data), bool)
    wide_upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    key = span_hashes(prefix_sums(data), starts, stops)
    doc = np.repeat(np.arange(len(n)), words)
    next_same, two_same = np.zeros(len(key), bool), np.zeros(len(key), bool)
    next_same[1:] = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])
    two_same[2:] = (key[2:] == key[:-2]) & (doc[2:] == doc[:-2])
    order = np.lexsort((key, doc))
    new = np.ones(len(key), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    by_doc = lambda mask, at=doc: np.bincount(at, mask, len(n))
    b, w = np.maximum(n, 1), np.maximum(words, 1)
    lines = per_text(data == 10)
    return np.stack(
        [n, words, per_text(~space) / w, (per_text(_UPPER[data]) + per_text(wide_upper)) / b, per_text(_DIGIT[data]) / b, per_text(_SYMBOL[data]) / b, per_text(data == 124) / w, per_text(data == 33) / w, per_text(data == 46) / w]
        + [per_text(data == 44) / w, per_text(_WIDE[data]) / b, words / (lines + 1), by_doc(next_same) / w, by_doc(two_same) / w, by_doc(new, doc[order]) / w],
        1,
    ).astype(np.float64)


def text_stats(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The key columns and STATS of every whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_blocks(batch, "text"):
                x = block_stats(data, offs)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in keys), *(pa.array(x[:, j]) for j in range(len(STATS)))], [*keys, *STATS])

    kept = docs.select(*keys, F.coalesce("text", F.lit("")).alias("text"))
    types = ", ".join(f"{k} {t}" for k, t in kept.dtypes if k != "text")
    return kept.mapInArrow(run, f"{types}, " + ", ".join(f"{s} double" for s in STATS))


# ------------------------------------------------------------------ fitting, on the driver, over a bounded sample

Rule = tuple[tuple[int, bool, float], ...]


def grow(x: np.ndarray, target: np.ndarray, rows: np.ndarray, depth: int, path: Rule, out: list[tuple[Rule, float]]) -> None:
    """A regression tree by variance over at most 31 quantile cuts a statistic; adds every node below the root to out."""
    if path:
        out.append((path, float(target[rows].mean())))
    if depth == 0 or len(rows) < 20:
        return
    best, y = (1e-9, 0, 0.0), target[rows]
    base = y.sum() ** 2 / len(y)
    for j in range(x.shape[1]):
        v = x[rows, j]
        for cut in np.unique(np.quantile(v, np.linspace(0.03, 0.97, 31))):
            low = v <= cut
            k = int(low.sum())
            if 5 <= k <= len(v) - 5:
                s = y[low].sum()
                gain = s * s / k + (y.sum() - s) ** 2 / (len(y) - k) - base
                if gain > best[0]:
                    best = (gain, j, float(cut))
    if best[0] > 1e-9:
        low = x[rows, best[1]] <= best[2]
        grow(x, target, rows[low], depth - 1, (*path, (best[1], True, best[2])), out)
        grow(x, target, rows[~low], depth - 1, (*path, (best[1], False, best[2])), out)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, ((x[:, j] <= cut) == low for j, low, cut in rule))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 2e-3) -> tuple[float, list[tuple[Rule, float]]]:
    """(intercept, [(rule, weight)]): rules of boosted trees, each grown on all rows, then L1-penalised logistic weights by FISTA."""
    if len(y) == 0 or y.min() == y.max():
        return (0.0 if len(y) == 0 else float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))), []
    z, rules = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}
    for _ in range(trees):
        nodes: list[tuple[Rule, float]] = []
        grow(x, y - sigmoid(z), np.arange(len(y)), depth, (), nodes)
        for rule, value in nodes:
            rules[rule] = None
            if len(rule) == depth or not any(len(r) > len(rule) and r[: len(rule)] == rule for r, _ in nodes):
                z = z + 1.5 * value * holds(rule, x)
    names = list(rules)
    a = np.stack([holds(r, x) for r in names], 1).astype(np.float64) if names else np.zeros((len(y), 0))
    centre, scale = a.mean(0), np.maximum(a.std(0), 1e-3)
    a = (a - centre) / scale
    step = 4 * len(y) / max(1e-9, np.linalg.norm(a, 2) ** 2 + len(y))
    w, b = np.zeros(a.shape[1]), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    v, vb, t = w, b, 1.0
    for _ in range(400):
        g = sigmoid(a @ v + vb) - y
        w2 = v - step * (a.T @ g) / len(y)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2, t2 = vb - step * g.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    kept = np.flatnonzero(w)
    return float(b - (w * centre / scale).sum()), [(names[i], float(w[i] / scale[i])) for i in kept]


def compile_rules(intercept: float, rules: list[tuple[Rule, float]]) -> Column:
    """The probability as one column expression over STATS."""

    def met(rule: Rule) -> Column:
        return reduce(lambda p, q: p & q, ((F.col(STATS[j]) <= cut) if low else (F.col(STATS[j]) > cut) for j, low, cut in rule))

    z = reduce(lambda p, q: p + q, (F.when(met(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in rules), F.lit(intercept))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))


def train(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> tuple[float, list[tuple[Rule, float]]]:
    """Fits on at most ``limit`` labelled rows outside the held-out fold."""
    rows = text_stats(labelled_sample(docs, labels, "quality", limit), ("doc_id", "y")).orderBy("doc_id").toPandas()
    return fit_rules(rows[list(STATS)].to_numpy(np.float64), rows["y"].to_numpy(np.float64))


def score(docs: DataFrame, model: tuple[float, list[tuple[Rule, float]]], threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Null and empty texts are scored on zero statistics."""
    return text_stats(docs).select("doc_id", held_out().alias("held_out"), compile_rules(*model).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
