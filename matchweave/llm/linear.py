"""Logistic models on small numeric matrices, and the bounded samples that they are fitted on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labelled documents that a classifier is fitted on, at most; all others are only scored.
SAMPLE = 20_000
ITERATIONS = 300


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p) - np.log1p(-p)


class Cells:
    """A matrix of zeros and ones given by its ones, beside a few dense columns."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, shape: tuple[int, int], dense: np.ndarray | None = None):
        self.rows, self.cols, self.ones = rows, cols, shape[1]
        self.dense = np.zeros((shape[0], 0)) if dense is None else dense
        self.shape = shape[0], shape[1] + self.dense.shape[1]

    def with_column(self, column: np.ndarray) -> Cells:
        return Cells(self.rows, self.cols, (self.shape[0], self.ones), np.hstack([self.dense, column[:, None]]))

    def some(self, wanted: np.ndarray) -> Cells:
        """The rows for which ``wanted`` is true."""
        number = np.cumsum(wanted) - 1
        held = wanted[self.rows]
        return Cells(number[self.rows[held]], self.cols[held], (int(wanted.sum()), self.ones), self.dense[wanted])

    def times(self, weights: np.ndarray) -> np.ndarray:
        sums = np.bincount(self.rows, weights[self.cols], self.shape[0])
        return sums + self.dense @ weights[self.ones :]

    def across(self, values: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.cols, values[self.rows], self.ones), self.dense.T @ values])


def fit_logistic(x: Cells, y: np.ndarray, sparse: float = 0.0, ridge: float = 1e-4, steps: int = ITERATIONS) -> np.ndarray:
    """Weights, the last of them the constant, by accelerated gradient steps.

    ``sparse`` draws small weights to zero, ``ridge`` all of them a little. With one class
    only, or no row, the result is a constant near that class.
    """
    rows, width = x.shape
    out = np.zeros(width + 1)
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    out[-1] = logit(np.array([share]))[0]
    if rows == 0 or y.min() == y.max():
        return out
    direction = np.ones(width + 1)
    for _ in range(12):  # the largest curvature, by power iteration
        seen = x.times(direction[:-1]) + direction[-1]
        direction = np.append(x.across(seen), seen.sum())
        size = np.linalg.norm(direction)
        direction /= size
    step = 4.0 * rows / (1.2 * size)
    look, momentum = out.copy(), 1.0
    for _ in range(steps):
        off = (sigmoid(x.times(look[:-1]) + look[-1]) - y) / rows
        gradient = np.append(x.across(off) + ridge * look[:-1], off.sum())
        new = look - step * gradient
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * sparse, 0)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look = new + (momentum - 1) / following * (new - out)
        out, momentum = new, following
    return out


def predict(x: Cells, weights: np.ndarray) -> np.ndarray:
    return sigmoid(x.times(weights[:-1]) + weights[-1])


def sampled_labels(labels: DataFrame, column: str, sample: int = SAMPLE, seed: int = 5) -> DataFrame:
    """``doc_id``, ``label`` (0 or 1) of at most ``sample`` labelled documents, chosen by hash.

    Rows with a null id or label are left out; of repeated ids the largest label counts.
    """
    label = F.max((F.col(column) > 0).cast("int")).alias("label")
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    rows = usable.groupBy("doc_id").agg(label)
    return rows.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample)
