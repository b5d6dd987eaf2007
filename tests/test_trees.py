"""Node tables, pruning, importance, out-of-bag votes and dependent columns."""

import datetime
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchweave.operators import cases, evaluate, models, trees


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        a, b, c = rng.random(), rng.randrange(6), rng.gauss(0, 1)
        label = int(a + 0.1 * b + 0.2 * c + rng.gauss(0, 0.3) > 0.8)
        rows.append((i, i // 6, label, a, float(b), c))
    return spark.createDataFrame(rows, "person long, group_id long, label int, a double, b double, c double").repartition(4).cache()


COLUMNS = ["a", "b", "c"]


def random_tree(rng, depth):
    """Class counts of every node and the two children of inner ones, numbered before their children."""
    rows, children = {}, {}

    def grow(left_over, counts):
        t = len(rows)
        rows[t] = counts
        if left_over and min(counts) > 0 and rng.random() < 0.85:
            first = [rng.randrange(n + 1) for n in counts]
            second = [n - f for n, f in zip(counts, first)]
            if sum(first) and sum(second):
                children[t] = (grow(left_over - 1, first), grow(left_over - 1, second))
        return t

    grow(depth, [rng.randrange(20, 60), rng.randrange(20, 60)])
    return {t: [float(x) for x in c] for t, c in rows.items()}, children


def all_prunings(children, t=0):
    yield {t}
    if t in children:
        left, right = children[t]
        for a, b in itertools.product(list(all_prunings(children, left)), list(all_prunings(children, right))):
            yield a | b


@pytest.mark.parametrize("seed", range(12))
def test_weakest_links_are_best_at_every_cost(seed):
    rows, children = random_tree(random.Random(seed), 4)
    found = trees.PrunedTree(rows, children)
    costs = [s.cost for s in found.steps]
    assert costs == sorted(costs) and found.steps[-1].leaves == {0}
    for cost in [*costs, *[(a + b) / 2 for a, b in zip(costs, costs[1:])], 1.0]:
        best = min(sum(found.risk(t) for t in leaves) + cost * len(leaves) for leaves in all_prunings(children))
        step = found.at_cost(cost)
        assert step.risk + cost * len(step.leaves) == pytest.approx(best, abs=1e-9)
    for a, b in zip(found.steps, found.steps[1:]):
        assert len(b.leaves) < len(a.leaves)


def test_cp_table_agrees_with_the_rows(table):
    found = trees.complexity(table, COLUMNS, "group_id", depth=4, folds=4)
    assert all(n == 0 for _, n in found.violations())
    rows = found.rows()
    assert rows[0][1] == 0 and rows[0][2] == 1.0 and [r[1] for r in rows] == sorted(r[1] for r in rows)
    fitted = models.fit(table, COLUMNS, models.tree(4))
    wrong = models.predict(fitted, table, []).where("prediction <> label").count()
    assert rows[-1][2] == pytest.approx(wrong / 600 / found.tree.risk(0))
    assert all(0 < r[3] < 3 and r[4] > 0 for r in rows)


def test_raw_importance_has_the_shares_of_the_model(table):
    model = models.fit(table, COLUMNS, models.forest(trees=7, depth=4))
    nodes = trees.node_table(model, table)
    assert nodes.select("tree").distinct().count() == 7
    raw = {r["variable"]: r for r in trees.raw_importance(nodes, [*COLUMNS, "unused"]).collect()}
    shares = {r["variable"]: r["importance"] for r in models.importance(model, COLUMNS, table).collect()}
    for c in COLUMNS:
        assert raw[c]["share"] == pytest.approx(shares[c], abs=1e-9)
    assert raw["unused"]["decrease"] == 0
    cut = sorted(raw[c]["decrease"] for c in COLUMNS)[1]
    assert trees.raw_importance(nodes, COLUMNS, at_least=cut).count() == 2


def test_votes_come_from_the_bags_that_left_a_row_out(table):
    found = trees.out_of_bag(table, COLUMNS, "person", bags=6, trees=12, depth=3).collect()
    counts = table.select("person", *[(models.drawn_count("person", i, 42) == 0).cast("int").alias(f"b{i}") for i in range(6)])
    free = {r[0]: sum(r[1:]) for r in counts.collect()}
    assert {r["person"]: r["n_votes"] for r in found} == free
    assert all((r["prediction"] is None) == (r["n_votes"] == 0) for r in found)
    judged = [r for r in found if r["n_votes"]]
    assert sum(r["prediction"] == r["label"] for r in judged) / len(judged) > 0.7


def test_draws_of_a_bag_are_poisson(spark):
    counts = spark.range(20000).select(models.drawn_count("id", 3, 1).alias("n")).groupBy("n").count().collect()
    share = {r[0]: r[1] / 20000 for r in counts}
    assert share[0] == pytest.approx(np.exp(-1), abs=0.015) and share[1] == pytest.approx(np.exp(-1), abs=0.015)
    assert share[2] == pytest.approx(np.exp(-1) / 2, abs=0.012)


def test_dependent_columns_have_no_coefficient(table):
    more = table.withColumns({"same": F.col("a") * 3 - 2, "fixed": F.lit(1.0), "sum": F.col("a") + F.col("b") - F.col("c")})
    names = ["a", "same", "b", "fixed", "c", "sum"]
    assert models.independent_columns(more, names) == COLUMNS
    assert models.independent_columns(more, ["sum", "c", "a", "b"]) == ["sum", "c", "a"]
    assert models.independent_columns(more, ["fixed"]) == []
    rows = {r["variable"]: r for r in models.glm_table(more, names).collect()}
    assert {v for v, r in rows.items() if r["aliased"]} == {"same", "fixed", "sum"}
    assert all((r["estimate"] is None) == r["aliased"] for r in rows.values())
    model = models.fit(more, COLUMNS, models.logistic_glm())
    left = models.score_equations(more, COLUMNS, model).collect()
    assert all(abs(r["share"]) < 1e-5 for r in left)


COUNTS = [(3298, 432, 560, 3426), (40, 3, 9, 100), (0, 5, 6, 0), (7, 0, 0, 9), (1, 0, 0, 0), (2, 40, 1, 3), (500000, 300, 250, 499000)]


def test_tests_as_expressions_equal_the_driver_s(spark):
    counts = spark.createDataFrame(COUNTS, "tp long, fp long, fn long, tn long")
    for row in evaluate.agreement_report(counts).collect():
        want = evaluate.agreement_tests(*row[:4])
        for name, value in want.items():
            if value != value:
                assert row[name] is None
            else:
                assert row[name] == pytest.approx(value, abs=1e-9), (row[:4], name)
    none = evaluate.agreement_report(spark.createDataFrame([(0, 0, 0, 0)], "tp long, fp long, fn long, tn long")).first()
    assert all(v is None for v in none[4:])


def test_covered_throughout_equals_a_calendar(spark):
    rng, first, rows = random.Random(9), datetime.date(2015, 1, 1), []
    for person in range(80):
        for _ in range(rng.randrange(1, 9)):
            start = first + datetime.timedelta(rng.randrange(-15, 30))
            rows.append((person, start, start + datetime.timedelta(rng.randrange(-2, 25))))
    rows += [(None, first, first + datetime.timedelta(99)), (99, None, first), (98, first, None), (97, first, first + datetime.timedelta(99))]
    rows += [(96, first, first + datetime.timedelta(10)), (96, first + datetime.timedelta(11), first + datetime.timedelta(30))] * 3
    df = spark.createDataFrame(rows, "person int, start date, end date")
    got = {r[0] for r in cases.covered_throughout(df, "person", "start", "end", "2015-01-01", "2015-01-21").collect()}
    days = {first + datetime.timedelta(n) for n in range(21)}
    want = set()
    for person in {p for p, *_ in rows if p is not None}:
        held = set()
        for p, s, e in rows:
            if p == person and s and e:
                held |= {s + datetime.timedelta(n) for n in range((e - s).days + 1)}
        if days <= held:
            want.add(person)
    assert got == want and {96, 97} <= want and len(want) < 80


def _counting(spark, table):
    """The table with column a passed through a function that counts the rows it is computed for."""
    seen = spark.sparkContext.accumulator(0)

    def count(a):
        seen.add(1)
        return a

    return table.withColumn("a", F.udf(count, "double").asNondeterministic()("a")), seen


def test_folds_of_a_tree_read_the_rows_once(spark, table):
    counted, seen = _counting(spark, table)
    found = trees.complexity(counted, COLUMNS, "group_id", depth=3, folds=5)
    assert seen.value == 600
    assert found.rows() == trees.complexity(table, COLUMNS, "group_id", depth=3, folds=5).rows()
    counted, seen = _counting(spark, table)
    models.cross_validate(counted, COLUMNS, models.tree(2), "group_id", folds=3)
    assert seen.value == 600


def test_forests_keep_the_nodes_of_rows_and_grow_the_same_trees(table, monkeypatch):
    forest = models.forest(trees=9, depth=6)
    assert forest.getCacheNodeIds()
    kept, sent = (models.fit(table, COLUMNS, forest.copy().setCacheNodeIds(k)).stages[-1].toDebugString for k in (True, False))
    assert kept.split("\n", 1)[1] == sent.split("\n", 1)[1]
    made = []
    monkeypatch.setattr(trees, "fit", lambda *given: made.append(given[-1]) or models.fit(*given))
    trees.out_of_bag(table, COLUMNS, "person", bags=3, trees=6, depth=3)
    assert len(made) == 3 and all(f.getCacheNodeIds() for f in made)
