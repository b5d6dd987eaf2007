"""Random forests of two classes, grown a whole tree in a task; rows as small codes, trees as rows of a table.

MLlib grows all trees a level at a time: each level is a job, and the nodes of every tree are objects of
the driver. Here the rows are cut into bins once (by the same rule) and written as blocks of codes; a
task gets all rows that its forest draws, a byte for each value, grows its share of the trees, and writes
each straight into a table. The driver holds the cuts of the columns and nothing else. Bins, draws, tried
columns, gains, leaves and merged sister leaves follow MLlib, so without draws the trees are the same
node by node.

Several fits may share coded rows (folds, bags): each has a column of weights, how often it draws a row.
Rows of weight 0 are held out from it. Cuts are found for each fit from its own rows alone.
"""

from __future__ import annotations

import itertools
import json
import math
import tempfile
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from matchweave.sources.store import stage

# Points that a partition, and then all of them, keep of a column's distribution; fewer values stay as they are.
POINTS = 4096
# Cells of histograms and rows that are handled at once.
CELLS = 1 << 19
SLICE = 1 << 15
# Nodes of so many rows are handled alone, column after column.
LARGE = 1 << 11
# Bins of more bytes than this lie in a file of the task instead of its memory.
IN_MEMORY = 1 << 29
TRIED = {
    "all": lambda p: p,
    "sqrt": lambda p: math.ceil(math.sqrt(p)),
    "log2": lambda p: max(1, math.ceil(math.log2(p))),
    "onethird": lambda p: math.ceil(p / 3),
}
TREES = (
    "fit int, tree int, feature binary, cut binary, right binary, negative binary, positive binary, gain binary, won array<double>"
)
# Types of the arrays of a tree, nodes from the root on, left before right; a left child follows its parent.
KINDS = {"feature": np.int16, "cut": np.uint16, "right": np.int32, "negative": np.float64, "positive": np.float64, "gain": np.float64}


def grows(train: DataFrame | Part, columns: Sequence[str], estimator) -> bool:
    """Whether forests of this kind are grown here; MLlib fits the others (and rejects what no forest takes)."""
    if not isinstance(estimator, RandomForestClassifier) or not columns or len(columns) > np.iinfo(np.int16).max:
        return False
    plain = (
        estimator.getImpurity() == "gini"
        and estimator.getSubsamplingRate() == 1.0
        and estimator.getMinInstancesPerNode() == 1
        and estimator.getMinWeightFractionPerNode() == 0.0
        and estimator.getMaxBins() <= 256
        and estimator.getFeatureSubsetStrategy() in {*TRIED, "auto"}
        and not estimator.isSet("thresholds")
        and not estimator.isSet("leafCol")
    )
    if isinstance(train, Part) or not plain:
        return plain
    # NULL where there are no rows.
    two = F.bool_and(F.coalesce(F.col(estimator.getLabelCol()).cast("double").isin(0.0, 1.0), F.lit(False)))
    return not estimator.isSet("weightCol") and bool(train.agg(two).first()[0])


# --- rows as codes ---------------------------------------------------------------------


@dataclass
class Part:
    """The coded rows as one fit sees them."""

    rows: Coded
    fit: int


@dataclass
class Coded:
    """Blocks of coded rows and, for every fit on them, the cuts of each column.

    ``table`` has chunk, codes (a row after the other), label, weights (of each row, a byte for every
    fit; none where a single fit takes all rows once) and the ids as arrays. A code is the
    number of cuts of any fit below the value.
    """

    table: DataFrame
    columns: list[str]
    ids: list[str]
    all_cuts: list[np.ndarray]
    cuts: list[list[np.ndarray]]
    n_drawn: list[int]
    weighted: bool
    planned: list[ForestModel] = field(default_factory=list)

    def part(self, fit: int) -> Part:
        return Part(self, fit)

    def grow(self) -> None:
        """Grow all planned forests together."""
        planned, self.planned = self.planned, []
        trees = _grow(self, planned)
        for model in planned:
            model.grown = trees.where(F.col("fit") == model.fit)
            model.grown_together = trees


def _matrix(batch: pa.RecordBatch, first: int, n: int) -> np.ndarray:
    found = np.empty((batch.num_rows, n))
    for i in range(n):
        found[:, i] = batch.column(first + i).to_numpy(zero_copy_only=False)
    return found


def _measured(batch: pa.RecordBatch, p: int) -> np.ndarray:
    x = _matrix(batch, 0, p)
    if np.isnan(x).any():
        raise ValueError("a forest's rows have NULL or NaN in a column")
    return x


def _merged(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return values[first], np.add.reduceat(counts, first, axis=0)


def _shortened(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most POINTS neighbouring groups of values with about as many rows each (the first count)."""
    if len(values) <= POINTS:
        return values, counts
    rows = counts[:, 0]
    reached = np.cumsum(rows)
    group = ((reached - rows / 2) / reached[-1] * POINTS).astype(np.int64)
    last = np.flatnonzero(np.r_[group[1:] != group[:-1], True])
    return values[last], np.add.reduceat(counts, np.r_[0, last[:-1] + 1], axis=0)


def _cuts_of(values: np.ndarray, weights: np.ndarray, n_rows: int, bins: int) -> np.ndarray:
    """Where a column is cut for one fit, by MLlib's rule: between all values, or at strides of the weight."""
    values, weights = values[weights > 0], weights[weights > 0]
    most = min(bins, n_rows) - 1
    between = (values[:-1] + values[1:]) / 2
    if len(between) <= most:
        return between
    reached = np.cumsum(weights)
    middle = (reached[:-1] + reached[1:]) / 2
    stride = reached[-1] / (most + 1)
    found, at, target = [], 0, stride
    while (at := max(at, int(np.searchsorted(middle, target, side="right")))) < len(middle):
        found.append(between[at])
        at, target = at + 1, target + stride
    return np.array(found)


def _distribution(p: int, n_weights: int):
    """Of each column the values of a partition with their rows and weights, and the rows each fit draws."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.empty(0), np.empty((0, 1 + max(n_weights, 1))))] * p
        drawn = np.zeros(1 + max(n_weights, 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _measured(batch, p)
            weights = np.ones((batch.num_rows, 1 + max(n_weights, 1)))
            if n_weights:
                weights[:, 1:] = _matrix(batch, p, n_weights)
            drawn += (weights > 0).sum(axis=0)
            for j in range(p):
                values, place = np.unique(x[:, j], return_inverse=True)
                counts = np.stack([np.bincount(place, w, len(values)) for w in weights.T], axis=1)
                kept[j] = _shortened(*_merged(np.concatenate([kept[j][0], values]), np.concatenate([kept[j][1], counts])))
        if drawn[0]:
            for j, (values, counts) in enumerate(kept):
                yield pa.RecordBatch.from_pydict(
                    {
                        "feature": pa.array([j], pa.int32()),
                        "points": pa.array([values.tobytes()], pa.binary()),
                        "counts": pa.array([counts.tobytes()], pa.binary()),
                        "drawn": pa.array([drawn.tolist()], pa.list_(pa.int64())),
                    }
                )

    return work


def _cut(bins: int, fits: int):
    def work(table: pa.Table) -> pa.Table:
        values = np.concatenate([np.frombuffer(b.as_buffer()) for b in table["points"]])
        counts = np.concatenate([np.frombuffer(b.as_buffer()).reshape(-1, 1 + fits) for b in table["counts"]])
        drawn = np.sum([d.as_py() for d in table["drawn"]], axis=0)
        values, counts = _shortened(*_merged(values, counts))
        cuts = [_cuts_of(values, counts[:, 1 + f], int(drawn[1 + f]), bins).tolist() for f in range(fits)]
        return pa.table(
            {
                "feature": pa.array([table["feature"][0].as_py()], pa.int32()),
                "cuts": pa.array([cuts], pa.list_(pa.list_(pa.float64()))),
                "drawn": pa.array([drawn.tolist()], pa.list_(pa.int64())),
            }
        )

    return work


def _coded(p: int, n_weights: int, ids: int, cuts: list[np.ndarray]):
    """The rows of each batch as one block."""
    kind = np.uint8 if max(map(len, cuts)) < 256 else np.uint16

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            n = batch.num_rows
            if not n:
                continue
            x = _measured(batch, p)
            codes = np.empty((n, p), kind)
            for j in range(p):
                codes[:, j] = np.searchsorted(cuts[j], x[:, j], side="left")
            weights = _matrix(batch, p, n_weights).astype(np.uint8)
            labels = batch.column(p + n_weights)
            out = [
                pa.array([(partition << 32) + number], pa.int64()),
                pa.array([codes.tobytes()], pa.binary()),
                pa.array([weights.tobytes()], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), labels),
            ]
            for i in range(ids):
                out.append(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column(p + n_weights + 1 + i)))
            yield pa.RecordBatch.from_arrays(out, names=["chunk", "codes", "weights", "label", *[f"id{i}" for i in range(ids)]])

    return work


def _plain(df: DataFrame, columns: Sequence[str], ids: Sequence[str], label: str, weights: Sequence[Column] = ()) -> DataFrame:
    return df.select(
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)],
        *[w.cast("short").alias(f"w{i}") for i, w in enumerate(weights)],
        F.col(label).cast("double").alias("label"),
        *[F.col(c).alias(f"id{i}") for i, c in enumerate(ids)],
    )


def _blocks(plain: DataFrame, p: int, n_weights: int, ids: int, cuts: list[np.ndarray]) -> DataFrame:
    schema = StructType().add("chunk", "long").add("codes", "binary").add("weights", "binary").add("label", ArrayType(DoubleType()))
    for i in range(ids):
        schema = schema.add(StructField(f"id{i}", ArrayType(plain.schema[f"id{i}"].dataType)))
    return stage(plain.mapInArrow(_coded(p, n_weights, ids, cuts), schema), "coded")


def coded(
    train: DataFrame,
    columns: Sequence[str],
    label: str,
    ids: Sequence[str] = (),
    weights: Sequence[Column] = (),
    bins: int = 32,
) -> Coded:
    """The rows as codes, for one fit on all of them or for a fit by each of some columns of weights (0 to 255).

    All rows count where the columns are cut: a partition keeps of each column its values with
    their weights, or 4,096 neighbouring groups of them, and these are put together by column.
    """
    p, fits = len(columns), max(len(weights), 1)
    plain = _plain(train, columns, ids, label, weights)
    if weights:
        # Hashing the draws of all fits takes longer than all else here, and there are two passes.
        plain = stage(plain, "weighted")
    points = plain.mapInArrow(_distribution(p, len(weights)), "feature int, points binary, counts binary, drawn array<long>")
    found = points.groupBy("feature").applyInArrow(_cut(bins, fits), "feature int, cuts array<array<double>>, drawn array<long>")
    rows = sorted(found.collect())
    if not rows:
        raise ValueError("there are no rows to grow a forest on")
    drawn = rows[0]["drawn"]
    if min(drawn[1:]) == 0:
        raise ValueError("a fold or bag has no rows to grow a forest on")
    cuts = [[np.array(r["cuts"][f]) for r in rows] for f in range(fits)]
    every = [np.unique(np.concatenate([c[j] for c in cuts])) for j in range(p)]
    table = _blocks(plain, p, len(weights), len(ids), every)
    return Coded(table, list(columns), list(ids), every, cuts, drawn[1:], bool(weights))


def _to_tasks(table: DataFrame, tasks: int) -> DataFrame:
    """Every row for every task."""
    return table.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))


def _tasks(spark: SparkSession, trees: int) -> int:
    return min(trees, 2 * spark.sparkContext.defaultParallelism)


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for record in zip(*batch.columns):
            yield record


# --- growing ---------------------------------------------------------------------------


@dataclass
class _Fit:
    """What a task knows of one fit."""

    number: int
    trees: int
    depth: int
    tried: int
    draws: bool
    least_gain: float
    seed: int
    bins: int


def _gini(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a + b
    return 1.0 - (a / n) ** 2 - (b / n) ** 2


@dataclass
class _Rows:
    """The rows of a tree's open nodes, node after node: places and, in one number, weight and label."""

    at: np.ndarray
    about: np.ndarray
    sizes: np.ndarray


class _Grower:
    """Grows trees of one fit on the bins of its rows, column after column."""

    def __init__(self, bins: np.ndarray, label: np.ndarray, fit: _Fit):
        self.bins, self.label, self.fit = bins, label, fit
        self.p, self.n = bins.shape

    def _runs(self, sizes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Nodes and rows that are handled at once: a large node, or small ones up to some number of rows and cells."""
        ends, large = np.cumsum(sizes), np.append(np.flatnonzero(sizes >= LARGE), len(sizes))
        most = max(1, CELLS // (2 * self.fit.tried * self.fit.bins))
        first = 0
        while first < len(sizes):
            start = int(ends[first] - sizes[first])
            if sizes[first] >= LARGE:
                last = first + 1
            else:
                full = int(np.searchsorted(ends, start + SLICE, side="right"))
                last = min(first + most, max(first + 1, full), int(large[np.searchsorted(large, first)]))
            yield first, last, start, int(ends[last - 1])
            first = last

    def _histogram(self, rows: _Rows, start: int, end: int, tried: np.ndarray) -> np.ndarray:
        """label x tried column x bin, of one node."""
        at, about, bins = rows.at[start:end], rows.about[start:end], self.fit.bins
        out = np.empty((2, len(tried), bins))
        for i, j in enumerate(tried):
            counts = np.bincount(self.bins[j].take(at) + about, minlength=len(self.weights) * 2 * bins)
            out[:, i] = np.tensordot(self.weights, counts.reshape(-1, 2, bins), 1)
        return out

    def _histograms(self, rows: _Rows, sizes: np.ndarray, start: int, end: int, tried: np.ndarray) -> np.ndarray:
        """label x node x tried column x bin, of several nodes."""
        nodes, m, bins = len(sizes), self.fit.tried, self.fit.bins
        cells = nodes * m * bins
        node = np.repeat(np.arange(nodes), sizes)
        code = self.bins.reshape(-1).take((tried * self.n)[node] + rows.at[start:end, None])
        about = rows.about[start:end].astype(np.int64) // bins
        key = (node * (m * bins) + (about & 1) * cells)[:, None] + np.arange(m) * bins + code
        weight = np.repeat(self.weights[about >> 1], m)
        return np.bincount(key.reshape(-1), weight, 2 * cells).reshape(2, nodes, m, bins)

    def _best(self, rows: _Rows, zero: np.ndarray, one: np.ndarray, rng) -> dict[str, np.ndarray]:
        """For each open node the column and cut that win most, what they win and the counts on the left; column -1 where none wins."""
        count, m, bins = len(rows.sizes), self.fit.tried, self.fit.bins
        best = {"feature": np.full(count, -1), "cut": np.zeros(count, np.int64), "gain": np.full(count, -1.0)}
        best |= {"zero": np.zeros(count), "one": np.zeros(count)}
        if bins < 2:
            return best
        for first, last, start, end in self._runs(rows.sizes):
            nodes = last - first
            if m == self.p:
                tried = np.tile(np.arange(m), (nodes, 1))
            else:
                tried = np.argpartition(rng.random((nodes, self.p)), m - 1, axis=1)[:, :m]
            if rows.sizes[first] >= LARGE:
                found = self._histogram(rows, start, end, tried[0])[:, None]
            else:
                found = self._histograms(rows, rows.sizes[first:last], start, end, tried)
            h0, h1 = np.cumsum(found, axis=3)[..., :-1]
            z, o = zero[first:last], one[first:last]
            r0, r1 = z[:, None, None] - h0, o[:, None, None] - h1
            left, right = h0 + h1, r0 + r1
            with np.errstate(divide="ignore", invalid="ignore"):
                score = (h0 * h0 + h1 * h1) / left + (r0 * r0 + r1 * r1) / right
            score[(left <= 0) | (right <= 0)] = -1.0
            score = score.reshape(nodes, -1)
            chosen = np.argmax(score, axis=1)
            every = np.arange(nodes)
            split = score[every, chosen] >= 0
            a0, a1 = h0.reshape(nodes, -1)[every, chosen], h1.reshape(nodes, -1)[every, chosen]
            b0, b1, n = z - a0, o - a1, z + o
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = _gini(z, o) - (a0 + a1) / n * _gini(a0, a1) - (b0 + b1) / n * _gini(b0, b1)
            split &= (gain > 0) & (gain >= self.fit.least_gain)
            here = slice(first, last)
            best["feature"][here] = np.where(split, tried[every, chosen // (bins - 1)], -1)
            best["cut"][here] = chosen % (bins - 1)
            best["gain"][here] = np.where(split, gain, -1.0)
            best["zero"][here], best["one"][here] = a0, a1
        return best

    def _divide(self, rows: _Rows, best: dict[str, np.ndarray], is_open: np.ndarray) -> _Rows:
        """The rows of the open children of the nodes that are split, child after child."""
        at, about, sizes, child = [], [], [], 0
        for first, last, start, end in self._runs(rows.sizes):
            split = best["feature"][first:last] >= 0
            if not split.any():
                continue
            feature, cut, here = best["feature"][first:last], best["cut"][first:last], slice(start, end)
            if rows.sizes[first] >= LARGE:
                left = self.bins[feature[0]].take(rows.at[here]) <= cut[0]
                for side in (left, ~left):
                    if is_open[child]:
                        at.append(rows.at[here][side])
                        about.append(rows.about[here][side])
                        sizes.append([len(at[-1])])
                    child += 1
                continue
            nodes = int(split.sum())
            kept = np.repeat(split, rows.sizes[first:last])
            node = np.repeat(np.arange(nodes), rows.sizes[first:last][split])
            some, what = rows.at[here][kept], rows.about[here][kept]
            left = self.bins.reshape(-1).take((feature[split] * self.n)[node] + some) <= cut[split][node]
            goes = 2 * node + ~left
            opened = is_open[child : child + 2 * nodes]
            child += 2 * nodes
            order = np.argsort(goes, kind="stable")
            order = order[opened[goes[order]]]
            at.append(some[order])
            about.append(what[order])
            sizes.append(np.bincount(goes, minlength=2 * nodes)[opened])
        joined = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (at, about, sizes))
        return _Rows(*joined)

    def tree(self, number: int, drawn: np.ndarray | None) -> dict:
        """The arrays of one tree; drawn says how often the fit draws each row."""
        rng = np.random.default_rng([self.fit.seed & 0xFFFFFFFFFFFFFFFF, self.fit.number, number])
        weight = np.ones(self.n, np.int64) if drawn is None else drawn.astype(np.int64)
        if self.fit.draws:
            weight *= rng.poisson(1.0, self.n)
        at = np.flatnonzero(weight)
        weight, label = weight[at], self.label[at]
        # The different weights are few, so a histogram counts them apart.
        found = np.bincount(weight)
        self.weights = np.flatnonzero(found).astype(np.float64)
        about = ((np.cumsum(found > 0) - 1)[weight] * 2 + label) * self.fit.bins
        kind = np.uint16 if len(self.weights) * 2 * self.fit.bins <= 1 << 16 else np.int64
        rows = _Rows(at, about.astype(kind), np.array([len(at)]))
        one = np.array([float(weight[label > 0].sum())])
        zero = np.array([float(weight.sum())]) - one
        levels, best = [], None
        for depth in range(self.fit.depth + 1):
            is_open = (zero > 0) & (one > 0) & (depth < self.fit.depth)
            level = {"negative": zero, "positive": one, "feature": np.full(len(zero), -1), "cut": np.zeros(len(zero), np.int64)}
            level["gain"] = np.full(len(zero), -1.0)
            levels.append(level)
            if not is_open.any():
                break
            if depth:
                rows = self._divide(rows, best, is_open)
            best = self._best(rows, zero[is_open], one[is_open], rng)
            for name in ("feature", "cut", "gain"):
                level[name][is_open] = best[name]
            split = best["feature"] >= 0
            if not split.any():
                break
            a0, a1 = best["zero"][split], best["one"][split]
            b0, b1 = zero[is_open][split] - a0, one[is_open][split] - a1
            zero, one = np.stack([a0, b0], axis=1).reshape(-1), np.stack([a1, b1], axis=1).reshape(-1)
        return _in_order(levels)


def _in_order(levels: list[dict]) -> dict:
    """The nodes of all levels from the root on, left before right; sister leaves that predict the same are merged."""
    sizes = [None] * len(levels)
    for i in range(len(levels) - 1, -1, -1):
        level = levels[i]
        split = level["feature"] >= 0
        size = np.ones(len(split), np.int64)
        if split.any():
            below = levels[i + 1]
            leaf, says = below["feature"] < 0, below["positive"] > below["negative"]
            same = leaf[0::2] & leaf[1::2] & (says[0::2] == says[1::2])
            inner = np.flatnonzero(split)
            level["feature"][inner[same]] = -1
            level["gain"][inner[same]] = -1.0
            level["child"] = np.full(len(split), -1)
            level["child"][inner] = 2 * np.arange(len(inner))
            grown = inner[~same]
            c = level["child"][grown]
            size[grown] += sizes[i + 1][c] + sizes[i + 1][c + 1]
        sizes[i] = size
    out = {name: np.full(sizes[0][0], -1, kind) if name == "right" else np.empty(sizes[0][0], kind) for name, kind in KINDS.items()}
    here, place = np.array([0]), np.array([0])
    for i, level in enumerate(levels):
        for name in KINDS:
            if name != "right":
                out[name][place] = level[name][here]
        inner = level["feature"][here] >= 0
        if not inner.any():
            break
        c, left = level["child"][here[inner]], place[inner] + 1
        right = left + sizes[i + 1][c]
        out["right"][place[inner]] = right
        here, place = np.concatenate([c, c + 1]), np.concatenate([left, right])
    return out


def _codes_at_cuts(rows: Coded, fit: int) -> list[np.ndarray]:
    return [np.searchsorted(every, own) for every, own in zip(rows.all_cuts, rows.cuts[fit])]


def _bins_of_codes(rows: Coded, fit: int) -> np.ndarray:
    """column x code -> bin of one fit."""
    codes = np.arange(1 + max(map(len, rows.all_cuts)))
    return np.stack([np.searchsorted(at, codes, side="left") for at in _codes_at_cuts(rows, fit)]).astype(np.uint8)


def _codes_of_bins(rows: Coded, fit: int) -> np.ndarray:
    """column x cut of one fit -> code."""
    at = _codes_at_cuts(rows, fit)
    found = np.zeros((len(at), max(1, *map(len, at))), np.uint16)
    for j, codes in enumerate(at):
        found[j, : len(codes)] = codes
    return found


def _space(shape: tuple[int, int]) -> np.ndarray:
    if shape[0] * shape[1] <= IN_MEMORY:
        return np.empty(shape, np.uint8)
    return np.memmap(tempfile.TemporaryFile(), np.uint8, "w+", shape=shape)


def _by_content(bins: np.ndarray, label: np.ndarray, drawn: np.ndarray) -> None:
    """Put the rows into the order of their digests, so that draws do not depend on how the rows lie; equal rows are alike."""
    digest = label.astype(np.uint64) * np.uint64(256) + drawn
    for column in bins:
        digest = (digest ^ column) * np.uint64(0x9E3779B97F4A7C15)
        digest ^= digest >> np.uint64(29)
    order = np.argsort(digest, kind="stable")
    for column in (*bins, label, drawn):
        column[:] = column[order]


def _deal(p: int, n_weights: int, bins: dict[int, np.ndarray]):
    """Of each block and fit the rows that the fit draws, as bins, column after column."""
    n_codes = next(iter(bins.values())).shape[1]
    kind, first = np.uint8 if n_codes <= 256 else np.uint16, np.arange(p) * n_codes

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, code, weight, labels in _records(batches):
            codes = np.frombuffer(code.as_buffer(), kind).reshape(-1, p)
            label = labels.values.to_numpy(zero_copy_only=False).astype(np.uint8)
            weights = np.frombuffer(weight.as_buffer(), np.uint8).reshape(len(codes), n_weights)
            for fit_number, of_code in bins.items():
                drawn = weights[:, fit_number] if n_weights else np.ones(len(codes), np.uint8)
                some = drawn > 0
                if not some.any():
                    continue
                found = of_code.take(first[:, None] + codes[some].T)
                out = {"fit": pa.array([fit_number], pa.int32()), "chunk": pa.array([chunk.as_py()], pa.int64())}
                out |= {"bins": pa.array([found.tobytes()], pa.binary()), "drawn": pa.array([drawn[some].tobytes()], pa.binary())}
                out["label"] = pa.array([label[some].tobytes()], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    return work


def _grow_in_task(p: int, n_rows: dict[int, int], n_weights: int, fits: dict[int, _Fit], places: dict[int, np.ndarray], tasks: int):
    """The trees of a task, with cuts as codes."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (fit_number, part), records in itertools.groupby(_records(batches), key=lambda r: (r[0].as_py(), r[1].as_py())):
            fit, n, at = fits[fit_number], n_rows[fit_number], 0
            bins, label, drawn = _space((p, n)), np.empty(n, np.uint8), np.empty(n, np.uint8)
            for _, _, block, draws, labels in records:
                found = np.frombuffer(labels.as_buffer(), np.uint8)
                there = slice(at, at + len(found))
                bins[:, there] = np.frombuffer(block.as_buffer(), np.uint8).reshape(p, -1)
                label[there], drawn[there] = found, np.frombuffer(draws.as_buffer(), np.uint8)
                at = there.stop
            if at != n:
                raise ValueError(f"a task got {at} rows of {n}")
            _by_content(bins, label, drawn)
            grower = _Grower(bins, label, fit)
            for number in range(part, fit.trees, tasks):
                tree = grower.tree(number, drawn if n_weights else None)
                inner = tree["feature"] >= 0
                won = tree["gain"][inner] * (tree["negative"][inner] + tree["positive"][inner])
                tree["cut"][inner] = places[fit_number][tree["feature"][inner], tree["cut"][inner]]
                out = {"fit": pa.array([fit_number], pa.int32()), "tree": pa.array([number], pa.int32())}
                out |= {name: pa.array([tree[name].tobytes()], pa.binary()) for name in KINDS}
                out["won"] = pa.array([np.bincount(tree["feature"][inner], won, p).tolist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_pydict(out)

    return work


def _grow(rows: Coded, models: Sequence[ForestModel]) -> DataFrame:
    """The trees of several forests; a task grows some trees of one of them and gets the rows that this one draws."""
    p, fits = len(rows.columns), {}
    for m in models:
        e = m.estimator
        how = e.getFeatureSubsetStrategy()
        how = ("all" if e.getNumTrees() == 1 else "sqrt") if how == "auto" else how
        draws, bins = e.getBootstrap() and e.getNumTrees() > 1, 1 + max(map(len, rows.cuts[m.fit]))
        fits[m.fit] = _Fit(m.fit, e.getNumTrees(), e.getMaxDepth(), TRIED[how](p), draws, e.getMinInfoGain(), e.getSeed(), bins)
    cores = rows.table.sparkSession.sparkContext.defaultParallelism
    each = min(max(f.trees for f in fits.values()), -(-2 * cores // len(fits)))
    n_weights = len(rows.cuts) if rows.weighted else 0
    bins = {f: _bins_of_codes(rows, f) for f in fits}
    kinds = "fit int, chunk long, bins binary, drawn binary, label binary"
    dealt = rows.table.select("chunk", "codes", "weights", "label").mapInArrow(_deal(p, n_weights, bins), kinds)
    order = F.array_position(F.array(*[F.lit(f) for f in fits]), F.col("fit")).cast("int") - 1
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(each - 1)))).withColumn("task", order * each + F.col("part"))
    dealt = dealt.repartitionById(each * len(fits), "task").sortWithinPartitions("fit", "part", "chunk")
    dealt = dealt.select("fit", "part", "bins", "drawn", "label")
    n_rows, places = {f: rows.n_drawn[f] for f in fits}, {f: _codes_of_bins(rows, f) for f in fits}
    return stage(dealt.mapInArrow(_grow_in_task(p, n_rows, n_weights, fits, places, each), TREES), "forest")


# --- fitted forests --------------------------------------------------------------------


class ForestModel:
    """A forest as a table of trees; stands where a fitted pipeline does."""

    def __init__(self, columns: Sequence[str], all_cuts: list[np.ndarray], estimator, fit: int, rows: Coded | None, grown=None):
        self.columns, self.all_cuts, self.estimator, self.fit, self.rows = list(columns), all_cuts, estimator, fit, rows
        self.grown = self.grown_together = grown

    @property
    def stages(self) -> list[ForestModel]:
        return [self]

    @property
    def trees(self) -> DataFrame:
        if self.grown is None:
            self.rows.grow()
        return self.grown

    @property
    def n_trees(self) -> int:
        return self.estimator.getNumTrees()

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - named as in MLlib
        """Each column's share of what the trees win, all trees counting the same."""
        total = F.aggregate("won", F.lit(0.0), lambda a, x: a + x)
        parts = self.trees.select(F.posexplode(F.transform("won", lambda x: F.when(total > 0, x / total).otherwise(0.0))))
        found = np.zeros(len(self.columns))
        for row in parts.groupBy("pos").agg(F.sum("col").alias("part")).collect():
            found[row["pos"]] = row["part"]
        return Vectors.dense(found / found.sum() if found.sum() > 0 else found)

    @property
    def toDebugString(self) -> str:  # noqa: N802 - named as in MLlib
        """The trees as text; all of them come to the driver."""
        lines = [f"{type(self).__name__} of {self.n_trees} trees on {len(self.columns)} columns"]
        for row in self.trees.orderBy("tree").collect():
            tree = _unpacked(row)
            lines.append(f"  Tree {row['tree']} (weight 1.0):")
            todo = [(0, 2, "")]
            while todo:
                i, indent, side = todo.pop()
                if side:
                    lines.append(" " * 2 * indent + side)
                    indent += 1
                j = tree["feature"][i]
                if j < 0:
                    lines.append(" " * 2 * indent + f"Predict: {float(tree['positive'][i] > tree['negative'][i])}")
                    continue
                cut = self.all_cuts[j][tree["cut"][i]]
                todo += [(tree["right"][i], indent, f"Else (feature {j} > {cut})"), (i + 1, indent, f"If (feature {j} <= {cut})")]
        return "\n".join(lines) + "\n"

    def write(self) -> _Writer:
        return _Writer(self)


class _Writer:
    def __init__(self, model: ForestModel):
        self.model, self.mode = model, "errorifexists"

    def overwrite(self) -> _Writer:
        self.mode = "overwrite"
        return self

    def save(self, path: str) -> None:
        m = self.model
        params = {p.name: v for p, v in m.estimator.extractParamMap().items()}
        about = {"columns": m.columns, "cuts": [c.tolist() for c in m.all_cuts], "fit": m.fit, "params": params}
        m.trees.write.mode(self.mode).parquet(f"{path}/trees")
        m.trees.sparkSession.createDataFrame([(json.dumps(about),)], "about string").write.mode(self.mode).parquet(f"{path}/forest")


def load(spark: SparkSession, path: str) -> ForestModel:
    about = json.loads(spark.read.parquet(f"{path}/forest").first()["about"])
    cuts = [np.array(c) for c in about["cuts"]]
    return ForestModel(
        about["columns"], cuts, RandomForestClassifier(**about["params"]), about["fit"], None, spark.read.parquet(f"{path}/trees")
    )


def is_stored(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/forest")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def fit(train: DataFrame | Part, columns: Sequence[str], estimator) -> ForestModel:
    """A forest on some rows; on a part of coded rows it is only planned, and grown with the others at first use."""
    if isinstance(train, Part):
        model = ForestModel(columns, train.rows.all_cuts, estimator, train.fit, train.rows)
        train.rows.planned.append(model)
        return model
    rows = coded(train, columns, estimator.getLabelCol(), bins=estimator.getMaxBins())
    model = fit(rows.part(0), columns, estimator)
    rows.grow()
    return model


def _unpacked(row) -> dict[str, np.ndarray]:
    return {name: np.frombuffer(row[name], kind) for name, kind in KINDS.items()}


def node_table(model: ForestModel) -> DataFrame:
    """The nodes of a forest, as `trees.node_table` gives them."""
    cuts = model.all_cuts

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                t = _unpacked(row)
                n, inner = len(t["feature"]), t["feature"] >= 0
                threshold = [cuts[j][c] if j >= 0 else None for j, c in zip(t["feature"].tolist(), t["cut"].tolist())]
                counts = pa.array(np.stack([t["negative"], t["positive"]], axis=1).reshape(-1))
                yield pa.RecordBatch.from_pydict(
                    {
                        "tree": pa.array(np.full(n, row["tree"], np.int32)),
                        "node": pa.array(np.arange(n, dtype=np.int32)),
                        "feature": pa.array(t["feature"].astype(np.int32), mask=~inner),
                        "threshold": pa.array(threshold, pa.float64()),
                        "left": pa.array(np.where(inner, np.arange(1, n + 1), -1).astype(np.int32)),
                        "right": pa.array(t["right"]),
                        "gain": pa.array(t["gain"]),
                        "rows": pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * n + 1, 2, dtype=np.int32)), counts),
                    }
                )

    kinds = "tree int, node int, feature int, threshold double, left int, right int, gain double, rows array<double>"
    return model.trees.select("tree", *KINDS).mapInArrow(work, kinds)


# --- votes -----------------------------------------------------------------------------


def _leaves(codes: np.ndarray, tree: dict[str, np.ndarray]) -> np.ndarray:
    """The leaf that each row reaches."""
    n, p = codes.shape
    codes, found = codes.reshape(-1), np.zeros(n, np.int64)
    rows, node = np.arange(n), np.zeros(n, np.int64)
    while len(rows):
        feature = tree["feature"][node]
        inner = feature >= 0
        if not inner.all():
            found[rows[~inner]] = node[~inner]
            rows, node, feature = rows[inner], node[inner], feature[inner]
        left = codes.take(rows * p + feature) <= tree["cut"][node]
        node = np.where(left, node + 1, tree["right"][node])
    return found


def _vote_in_task(p: int, n_weights: int, n_codes: int):
    """Sums of the positive shares of the leaves that each row reaches, over the trees of a task that hold it out.

    The trees of a task come before the blocks of rows.
    """
    kind = np.uint8 if n_codes <= 256 else np.uint16

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task, records in itertools.groupby(_records(batches), key=lambda r: r[0].as_py()):
            forest: dict[int, list] = {}
            for _, fit_number, chunk, code, weight, feature, cut, right, negative, positive in records:
                if not code.is_valid:
                    arrays = {"feature": feature, "cut": cut, "right": right, "negative": negative, "positive": positive}
                    tree = {name: np.frombuffer(a.as_buffer(), KINDS[name]).copy() for name, a in arrays.items()}
                    tree["share"] = tree["positive"] / (tree["negative"] + tree["positive"])
                    tree["feature"] = tree["feature"].astype(np.int64)
                    forest.setdefault(fit_number.as_py(), []).append(tree)
                    continue
                codes = np.frombuffer(code.as_buffer(), kind).reshape(-1, p)
                weights = np.frombuffer(weight.as_buffer(), np.uint8).reshape(len(codes), n_weights) if n_weights else None
                votes = np.zeros(len(codes))
                for number, trees in forest.items():
                    out = np.arange(len(codes)) if weights is None else np.flatnonzero(weights[:, number] == 0)
                    some = codes if weights is None else codes[out]
                    for tree in trees:
                        votes[out] += tree["share"][_leaves(some, tree)]
                yield pa.RecordBatch.from_pydict(
                    {"chunk": pa.array([chunk.as_py()], pa.int64()), "task": pa.array([task], pa.int32()), "votes": pa.array([votes.tobytes()], pa.binary())}
                )

    return work


def _put_together(ids: int, n_weights: int, fits: list[int], n_trees: int):
    def work(blocks: pa.Table, votes: pa.Table) -> pa.Table:
        labels = blocks["label"].combine_chunks().values
        total = np.zeros(len(labels))
        for task in np.argsort(votes["task"].to_numpy()):
            total += np.frombuffer(votes["votes"][int(task)].as_buffer())
        fitted = np.ones(len(labels), np.int64)
        if n_weights:
            weights = np.frombuffer(blocks["weights"][0].as_buffer(), np.uint8).reshape(-1, n_weights)
            fitted = (weights[:, fits] == 0).sum(axis=1)
        share = pa.array(total / np.maximum(fitted, 1) / n_trees, mask=fitted == 0)
        named = {f"id{i}": blocks[f"id{i}"].combine_chunks().values for i in range(ids)}
        return pa.table({**named, "label": labels, "n_votes": pa.array(fitted), "share": share})

    return work


def _votes(blocks: DataFrame, models: Sequence[ForestModel], ids: Sequence[str], n_weights: int) -> DataFrame:
    """ids, label, n_votes and share of each row of the blocks."""
    first = models[0]
    if len({m.n_trees for m in models}) > 1:
        raise ValueError("forests that vote together have as many trees")
    p, n_codes = len(first.columns), 1 + max(map(len, first.all_cuts))
    numbers = [m.fit for m in models]
    for m in models:
        _ = m.trees
    # Planned on the same rows, so grown into the same table.
    trees = first.grown_together.where(F.col("fit").isin(numbers))
    tasks = _tasks(blocks.sparkSession, first.n_trees * len(models))
    arrays = ["feature", "cut", "right", "negative", "positive"]
    dealt = _to_tasks(blocks.select("chunk", "codes", "weights"), tasks).unionByName(
        trees.select(F.pmod(F.col("fit") * first.n_trees + F.col("tree"), F.lit(tasks)).cast("int").alias("task"), "fit", "tree", *arrays),
        allowMissingColumns=True,
    )
    # NULLs come first in the order, so the trees do.
    dealt = dealt.repartitionById(tasks, "task").sortWithinPartitions("task", "chunk", "fit", "tree")
    dealt = dealt.select("task", "fit", "chunk", "codes", "weights", *arrays)
    votes = dealt.mapInArrow(_vote_in_task(p, n_weights, n_codes), "chunk long, task int, votes binary")
    named = [f"id{i}" for i in range(len(ids))]
    schema = StructType([StructField(c, blocks.schema[c].dataType.elementType) for c in named])
    schema = schema.add("label", "double").add("n_votes", "long").add("share", "double")
    out = (
        blocks.select("chunk", "weights", "label", *named)
        .groupBy("chunk")
        .cogroup(votes.groupBy("chunk"))
        .applyInArrow(_put_together(len(ids), n_weights, numbers, first.n_trees), schema)
    )
    return out.select(*[F.col(c).alias(name) for c, name in zip(named, ids)], "label", "n_votes", "share")


def held_out(models: Sequence[ForestModel]) -> DataFrame:
    """The ids of the coded rows, label, ``n_votes`` and ``share``: of each row the fits that hold it out and their mean score."""
    rows = models[0].rows
    return _votes(rows.table, models, rows.ids, len(rows.cuts))


def predict(model: ForestModel, test: DataFrame, ids: Sequence[str], label: str) -> DataFrame:
    """ids, label, prediction and score, as `models.predict` gives them."""
    p = len(model.columns)
    _ = model.trees
    blocks = _blocks(_plain(test, model.columns, ids, label), p, 0, len(ids), model.all_cuts)
    found = _votes(blocks, [model], ids, 0)
    return found.select(*ids, "label", (F.col("share") > 0.5).cast("double").alias("prediction"), F.col("share").alias("score"))
