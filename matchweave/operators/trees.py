"""What is inside fitted trees: node tables, raw importance, cost-complexity pruning, out-of-bag error."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchweave.functions.exprs import hash_order
from matchweave.operators import forests
from matchweave.operators.models import (
    LABEL,
    drawn_count,
    fit,
    fit_vectors,
    fold_of,
    predict,
    side_by_side,
    tree,
    vectors_once,
)
from matchweave.sources.store import new_path

# Differences of risk below this are taken for rounding.
EPSILON = 1e-12


def node_table(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The nodes of a fitted tree or forest, read from the model's stored form.

    Columns: tree, node (numbered from the root, left before right), feature (its number) and
    threshold of the split, left, right (both -1 at a leaf), gain, rows (weighted, by class).
    """
    if isinstance(model, forests.ForestModel):
        return forests.node_table(model)
    path = new_path(df.sparkSession, "model")
    model.stages[-1].write().save(path)
    stored = df.sparkSession.read.parquet(f"{path}/data")
    many = "nodeData" in stored.columns
    nodes = stored.select(F.col("treeID").alias("tree"), "nodeData.*") if many else stored.withColumn("tree", F.lit(0))
    inner = F.col("leftChild") >= 0
    return nodes.select(
        "tree",
        F.col("id").alias("node"),
        F.when(inner, F.col("split.featureIndex")).alias("feature"),
        F.when(inner, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
        F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"),
        "gain",
        F.col("impurityStats").alias("rows"),
    )


def raw_importance(nodes: DataFrame, columns: Sequence[str], at_least: float | None = None) -> DataFrame:
    """Variables by the decrease of impurity they bring, a tree on average, and their share.

    ``decrease`` is the sum of gain times rows over the splits on the variable; ``share`` takes
    each tree's decreases as parts of one first, as MLlib's importance does. Variables that no
    tree uses have 0. ``at_least`` keeps the variables with that much decrease or more.
    """
    names = nodes.sparkSession.createDataFrame([(i, c) for i, c in enumerate(columns)], "feature int, variable string")
    total = F.aggregate("rows", F.lit(0.0), lambda a, n: a + n)
    won = nodes.where(F.col("left") >= 0).groupBy("tree", "feature").agg(F.sum(F.col("gain") * total).alias("won"))
    of_tree = won.groupBy("tree").agg(F.sum("won").alias("all"))
    trees = nodes.agg(F.count_distinct("tree").alias("trees"))
    parts = won.join(of_tree, "tree").groupBy("feature").agg(
        F.sum("won").alias("won"), F.sum(F.when(F.col("all") > 0, F.col("won") / F.col("all"))).alias("part")
    )
    whole = parts.agg(F.sum("part").alias("parts"))
    # One row each: the number of trees and the sum of all parts.
    table = names.join(F.broadcast(parts), "feature", "left").join(F.broadcast(trees)).join(F.broadcast(whole))
    out = table.select(
        "variable",
        F.coalesce(F.col("won") / F.col("trees"), F.lit(0.0)).alias("decrease"),
        F.coalesce(F.col("part") / F.col("parts"), F.lit(0.0)).alias("share"),
    )
    kept = out if at_least is None else out.where(F.col("decrease") >= at_least)
    return kept.orderBy(F.desc("decrease"), "variable")


@dataclass
class Subtree:
    """A pruned tree: the cost per leaf from which it is best, its leaves and its share of errors."""

    cost: float
    leaves: frozenset[int]
    risk: float


@dataclass
class PrunedTree:
    """The nested subtrees of a fitted tree, from the largest to the root alone."""

    rows: dict[int, list[float]]
    children: dict[int, tuple[int, int]]
    steps: list[Subtree] = field(default_factory=list)

    def __post_init__(self):
        self.total = sum(self.rows[0])
        inner = dict(self.children)
        cost = 0.0
        while True:
            risk, leaves, parents = {}, {}, self._from_below(inner)
            for t in parents:
                if t in inner:
                    risk[t] = sum(risk[c] for c in inner[t])
                    leaves[t] = sum(leaves[c] for c in inner[t])
                else:
                    risk[t], leaves[t] = self.risk(t), 1
            links = {t: (self.risk(t) - risk[t]) / (leaves[t] - 1) for t in parents if t in inner}
            weak = [t for t, g in links.items() if g <= cost + EPSILON]
            if not weak:
                self.steps.append(Subtree(cost, frozenset(t for t in parents if t not in inner), risk[0]))
                if not links:
                    return
                cost = min(links.values())
                continue
            for t in weak:
                self._cut(inner, t)

    def _from_below(self, inner: dict) -> list[int]:
        order, stack = [], [0]
        while stack:
            t = stack.pop()
            order.append(t)
            stack += inner.get(t, ())
        return order[::-1]

    @staticmethod
    def _cut(inner: dict, t: int) -> None:
        stack = [t]
        while stack:
            t = stack.pop()
            stack += inner.pop(t, ())

    def risk(self, t: int) -> float:
        """Errors, as a share of all rows, if node t were a leaf."""
        return (sum(self.rows[t]) - max(self.rows[t])) / self.total

    def prediction(self, t: int) -> float:
        return float(self.rows[t].index(max(self.rows[t])))

    def at_cost(self, cost: float) -> Subtree:
        """The subtree that is best at a cost per leaf."""
        return [s for s in self.steps if s.cost <= cost + EPSILON][-1]

    def predictions(self, subtree: Subtree) -> list[float]:
        """What a subtree predicts for the rows of each leaf of the whole tree, leaves from left to right."""
        found, stack = [], [(0, None)]
        while stack:
            t, decided = stack.pop()
            if decided is None and t in subtree.leaves:
                decided = self.prediction(t)
            if t in self.children:
                left, right = self.children[t]
                stack += [(right, decided), (left, decided)]
            else:
                found.append(decided)
        return found


def pruned(nodes: DataFrame) -> PrunedTree:
    """The weakest-link sequence of one tree; its nodes are few, as its depth is bounded."""
    rows = nodes.select("node", "left", "right", "rows").collect()
    return PrunedTree(
        {r["node"]: list(r["rows"]) for r in rows}, {r["node"]: (r["left"], r["right"]) for r in rows if r["left"] >= 0}
    )


def leaf_counts(model: PipelineModel, df: DataFrame) -> dict[tuple[int, float], int]:
    """Rows of each leaf, counted from the left, and class."""
    model.stages[-1].setLeafCol("leaf")
    scored = model.transform(df.withColumn(LABEL, F.col(LABEL).cast("double")))
    counts = scored.groupBy(F.col("leaf").cast("int").alias("leaf"), LABEL).agg(F.count(F.lit(1)).alias("n"))
    return {(r["leaf"], r[LABEL]): r["n"] for r in counts.collect()}


def _errors(pruned_tree: PrunedTree, subtree: Subtree, counts: dict[tuple[int, float], int]) -> int:
    says = pruned_tree.predictions(subtree)
    return sum(n for (leaf, label), n in counts.items() if says[leaf] != label)


@dataclass
class Complexity:
    """A fitted tree's subtrees, with their errors on the training rows and in cross-validation."""

    tree: PrunedTree
    counts: dict[tuple[int, float], int]
    held_out_errors: list[int]

    def rows(self) -> list[tuple]:
        n, base = self.tree.total, self.tree.risk(0)
        out = []
        for step, wrong in zip(self.tree.steps, self.held_out_errors):
            rate = wrong / n
            out.append(
                (
                    step.cost / base, len(step.leaves) - 1, step.risk / base, rate / base,
                    math.sqrt(rate * (1 - rate) / n) / base,
                )
            )
        return out[::-1]

    def violations(self) -> list[tuple[str, int]]:
        """Where the table contradicts the training rows or itself: nowhere, in a sound table."""
        steps = self.tree.steps
        pairs = list(zip(steps, steps[1:]))
        confirmed = [abs(_errors(self.tree, s, self.counts) / self.tree.total - s.risk) < 1e-9 for s in steps]
        below = {t: self._path(t) for t in self.tree.rows}
        return [
            ("relative errors that the training rows do not confirm", confirmed.count(False)),
            ("subtrees that do not contain the next", sum(any(not below[t] & b.leaves for t in a.leaves) for a, b in pairs)),
            ("costs that do not rise", sum(a.cost >= b.cost for a, b in pairs)),
            ("smaller subtrees with fewer errors", sum(b.risk < a.risk - EPSILON for a, b in pairs)),
            ("costs that are not the errors won for each leaf", sum(self._off(a, b) for a, b in pairs)),
            ("sequences that do not end with the root", int(steps[-1].leaves != {0})),
        ]

    def _path(self, t: int) -> set[int]:
        parent = {c: p for p, cs in self.tree.children.items() for c in cs}
        path = {t}
        while t in parent:
            t = parent[t]
            path.add(t)
        return path

    @staticmethod
    def _off(a: Subtree, b: Subtree) -> bool:
        return abs((b.risk - a.risk) / (len(a.leaves) - len(b.leaves)) - b.cost) > 1e-9


def complexity(
    train: DataFrame, columns: Sequence[str], group: str, depth: int = 5, folds: int = 10, seed: int = 42
) -> Complexity:
    """The subtrees of a tree by weakest-link pruning, cross-validated over folds by group.

    A subtree is scored in a fold by the fold's own tree, cut back at the geometric mean of the
    costs between which the subtree is best. Training rows without any error give no sequence
    beyond the root, and a relative error of 0 / 0 is avoided by refusing labels of one class.
    """
    with vectors_once(train.withColumn("fold", fold_of(group, folds, seed)), columns, "fold") as folded:
        fitted = fit_vectors(folded, tree(depth, seed=seed))
        whole = pruned(node_table(fitted, train))
        if whole.risk(0) == 0:
            raise ValueError("the training rows have one class only")
        costs = [s.cost for s in whole.steps]
        between = [math.sqrt(a * b) for a, b in zip(costs, costs[1:])] + [math.inf]

        def one(i: int) -> list[int]:
            model = fit_vectors(folded.where(F.col("fold") != i), tree(depth, seed=seed))
            of_fold = pruned(node_table(model, train))
            counts = leaf_counts(model, folded.where(F.col("fold") == i))
            return [_errors(of_fold, of_fold.at_cost(c), counts) for c in between]

        errors = side_by_side(one, range(folds))
        return Complexity(whole, leaf_counts(fitted, folded), [sum(e) for e in zip(*errors)])


def cp_table(train: DataFrame, columns: Sequence[str], group: str, **how) -> DataFrame:
    """cp, n_splits, relative_error, cv_error, cv_deviation of each subtree, the root first.

    All relative to the root's error. ``cp`` is the cost per leaf from which the subtree is best.
    """
    rows = complexity(train, columns, group, **how).rows()
    kinds = "cp double, n_splits int, relative_error double, cv_error double, cv_deviation double"
    return train.sparkSession.createDataFrame(rows, kinds)


def out_of_bag(
    train: DataFrame, columns: Sequence[str], key: str, bags: int = 25, trees: int = 500, depth: int = 30, seed: int = 42
) -> DataFrame:
    """key, label, ``n_votes``, ``share`` and ``prediction`` of each row by the trees that did not draw it.

    A bag draws rows as often as a Poisson count from the row's hash says (`drawn_count`), the same
    wherever it is computed. ``trees`` are dealt evenly to the bags and grown on whole bags; a row's
    votes come from the bags that did not draw it. A row that all bags drew has no vote and no
    prediction. The rows are coded once, with the draws of all bags, and the trees of all bags are
    grown and vote together.
    """
    per_bag = max(1, trees // bags)
    bag_forests = [
        RandomForestClassifier(
            labelCol=LABEL, weightCol="weight", numTrees=per_bag, maxDepth=depth, bootstrap=False,
            featureSubsetStrategy="sqrt", seed=seed + i, cacheNodeIds=True,
        )
        for i in range(bags)
    ]
    if forests.grows(train, columns, RandomForestClassifier(labelCol=LABEL)):
        rows = forests.coded(train, columns, LABEL, [key], [drawn_count(key, i, seed) for i in range(bags)])
        voted = forests.held_out([fit(rows.part(i), columns, f) for i, f in enumerate(bag_forests)])
    else:
        voted = _votes_by_mllib(train, columns, key, bag_forests, seed)
    return voted.select(
        key, LABEL, "n_votes", "share", F.when(F.col("share").isNotNull(), (F.col("share") > 0.5).cast("double")).alias("prediction")
    )


def _votes_by_mllib(train: DataFrame, columns: Sequence[str], key: str, bag_forests: Sequence, seed: int) -> DataFrame:
    """Votes where labels are no two classes: a pass over the rows for each bag, and one aggregation of all votes."""

    def one(i: int) -> DataFrame:
        weighted = train.withColumn("weight", drawn_count(key, i, seed).cast("double"))
        model = fit(weighted.where(F.col("weight") > 0), columns, bag_forests[i])
        return predict(model, weighted.where(F.col("weight") == 0), [key])

    votes = reduce(DataFrame.unionByName, side_by_side(one, range(len(bag_forests))))
    counted = votes.groupBy(key).agg(F.count(F.lit(1)).alias("n_votes"), F.avg("score").alias("share"))
    rows = train.select(key, F.col(LABEL).cast("double").alias(LABEL)).join(counted, key, "left")
    return rows.select(key, LABEL, F.coalesce("n_votes", F.lit(0)).cast("long").alias("n_votes"), "share")
