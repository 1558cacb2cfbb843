"""Quality classifier: regularised quadratic discriminant over transformed text statistics.

Each text becomes a fixed vector of statistics (length, words, letter case, symbols, repetition,
lines), counts on a log scale and shares on a smoothed logit scale. Per class, Spark sums the vectors
and their products over every labelled row, so nothing is sampled. The class covariances are shrunk
towards the pooled one and then towards its diagonal. A score is the logistic of the difference of
the two log densities (Mahalanobis distances through cached Cholesky factors) plus the log prior.

A null text counts as an empty one. Without labels of both classes the score is the share of the
class that is there, 0.5 without any. Repeated label rows count each time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, raw_texts, sliced

TOWARDS_POOLED = 0.1
TOWARDS_DIAGONAL = 0.05
UPPER, LOWER, DIGIT, SPACE, MARK, BANG, BAR, SYMBOL, HIGH = range(9)
NAMES = ["bytes", "words", "upper", "digits", "marks", "bangs", "bars", "symbols", "high", "word_length",
         "word_spread", "distinct_words", "repeats", "top_word", "lines", "distinct_lines"]


def _classes() -> np.ndarray:
    kinds = np.full(256, SYMBOL, np.int64)
    kinds[ord("A"):ord("Z") + 1] = UPPER
    kinds[ord("a"):ord("z") + 1] = LOWER
    kinds[ord("0"):ord("9") + 1] = DIGIT
    kinds[[9, 10, 11, 12, 13, 32]] = SPACE
    kinds[[ord(c) for c in ".,;:'\"-()?"]] = MARK
    kinds[ord("!")], kinds[ord("|")] = BANG, BAR
    kinds[128:] = HIGH
    return kinds


CLASSES = _classes()


def _logit(part: np.ndarray | float, whole: np.ndarray | float):
    share = (part + 0.5) / (whole + 1.0)
    return np.log(share / (1 - share))


def statistics(text: bytes) -> list[float]:
    """The vector of one text, in the order of NAMES."""
    kinds = np.bincount(CLASSES[np.frombuffer(text, np.uint8)], minlength=9)
    words, lines = text.split(), text.split(b"\n")
    n, size = len(words), len(text)
    lengths = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    counts = Counter(words)
    letters = int(kinds[UPPER] + kinds[LOWER])
    return [
        np.log1p(size), np.log1p(n), _logit(kinds[UPPER], letters), _logit(kinds[DIGIT], size),
        _logit(kinds[MARK], size), _logit(kinds[BANG], size), _logit(kinds[BAR], size),
        _logit(kinds[SYMBOL], size), _logit(kinds[HIGH], size), np.log1p(lengths.mean()),
        np.log1p(lengths.var()), _logit(len(counts), n), _logit(sum(map(eq, words, words[1:])), n),
        _logit(max(counts.values(), default=0), n), np.log1p(len(lines)),
        _logit(len(set(lines)), len(lines))]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in sliced(whole, "text"):
            rows = [np.array(statistics(t)) for t in raw_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), packed(rows, pa.float64())], ["doc_id", "stats"])


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) for every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _measured, f"doc_id {kind}, stats array<double>")


@dataclass
class Model:
    """Class means, inverse Cholesky factors, log determinants and the log prior ratio."""

    prior: float
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    log_dets: np.ndarray | None = None

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of statistics."""
        if self.means is None:
            return np.full(len(stats), self.prior)
        density = [
            -0.5 * (((stats - self.means[k]) @ self.factors[k].T) ** 2).sum(axis=1)
            - self.log_dets[k] for k in (0, 1)]
        gap = np.clip(density[1] - density[0] + np.log(self.prior / (1 - self.prior)), -700, 700)
        return 1 / (1 + np.exp(-gap))


def solve(counts: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Model:
    """The model from per-class counts, sums and sums of products."""
    if not counts.all():
        return Model(0.5 if not counts.any() else float(counts[1] > 0))
    means = sums / counts[:, None]
    spread = [products[k] / counts[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (counts[0] * spread[0] + counts[1] * spread[1]) / counts.sum()
    diagonal = np.diag(np.maximum(np.diag(pooled), 1e-6))
    factors, log_dets = [], []
    for own in spread:
        mixed = (1 - TOWARDS_POOLED) * own + TOWARDS_POOLED * pooled
        mixed = (1 - TOWARDS_DIAGONAL) * mixed + TOWARDS_DIAGONAL * diagonal
        factor = np.linalg.cholesky(mixed)
        factors.append(np.linalg.inv(factor))
        log_dets.append(np.log(np.diag(factor)).sum())
    return Model(float(counts[1] / counts.sum()), means, np.array(factors), np.array(log_dets))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of (1, statistics) per class over one partition."""
    width = len(NAMES) + 1
    sums = np.zeros((2, width, width))
    for batch in batches:
        stats = batch.column("stats").flatten().to_numpy(zero_copy_only=False)
        rows = np.hstack([np.ones((batch.num_rows, 1)), stats.reshape(-1, len(NAMES))])
        label = batch.column("label").to_numpy(zero_copy_only=False)
        for k in (0, 1):
            sums[k] += rows[label == k].T @ rows[label == k]
    label, i, j = (x.ravel().astype(np.int32) for x in np.indices(sums.shape))
    yield pa.RecordBatch.from_arrays(
        [pa.array(label), pa.array(i), pa.array(j), pa.array(sums.ravel())], ["label", "i", "j", "s"])


def fit(measured: DataFrame, labels: DataFrame) -> Model:
    """Learn from (doc_id, stats) rows with a label: (doc_id, label 0 or 1). All rows count."""
    rows = measured.join(labels.where("label in (0, 1)").select("doc_id", "label"), "doc_id")
    cells = rows.select(F.col("label").cast("int"), "stats").mapInArrow(
        _moments, "label int, i int, j int, s double")
    width = len(NAMES) + 1
    moments = np.zeros((2, width, width))
    for row in cells.groupBy("label", "i", "j").agg(F.sum("s").alias("s")).collect():
        moments[row["label"], row["i"], row["j"]] = row["s"]
    return solve(moments[:, 0, 0], moments[:, 0, 1:], moments[:, 1:, 1:])


def scored(measured: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every measured document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = batch.column("stats").flatten().to_numpy(zero_copy_only=False)
            score = model.score(stats.reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    kind = measured.schema["doc_id"].dataType.simpleString()
    return measured.select("doc_id", "stats").mapInArrow(run, f"doc_id {kind}, score double")
