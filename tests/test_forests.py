"""Forests grown whole trees at a time against MLlib's, by node, vote, fold and bag."""

import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from matchweave.operators import forests, models, trees
from matchweave.sources import store

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        a, b, c = rng.random(), rng.randrange(6), rng.gauss(0, 1)
        label = int(a + 0.1 * b + 0.2 * c + rng.gauss(0, 0.3) > 0.8)
        rows.append((i, i // 6, label, a, float(b), c))
    return spark.createDataFrame(rows, "person long, group_id long, label int, a double, b double, c double").repartition(3).cache()


def by_mllib(df, estimator):
    ready = df.withColumn("label", F.col("label").cast("double"))
    return Pipeline(stages=[VectorAssembler(inputCols=COLUMNS, outputCol="features"), estimator]).fit(ready)


def lone(depth, **how):
    return RandomForestClassifier(
        labelCol="label", numTrees=1, maxDepth=depth, bootstrap=False, featureSubsetStrategy="all", seed=1, **how
    )


def jobs_of(spark, work):
    spark.sparkContext.setJobGroup("forest-jobs", "counted")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("forest-jobs"))
    work()
    found = len(spark.sparkContext.statusTracker().getJobIdsForGroup("forest-jobs")) - before
    spark.sparkContext.setJobGroup("other", "not counted")
    return found


def test_a_forest_takes_as_many_jobs_however_deep(spark, table):
    # MLlib runs a job for each level, with the nodes of all trees on the driver.
    table.count()
    shallow, deep = (jobs_of(spark, lambda d=d: models.fit(table, COLUMNS, models.forest(12, d))) for d in (2, 14))
    assert shallow == deep
    model = models.fit(table, COLUMNS, models.forest(12, 14))
    assert model.trees.count() == 12 and model.trees.select("tree").distinct().count() == 12


@pytest.mark.parametrize("bins", [32, 8, 200])
def test_without_draws_the_tree_is_the_one_of_mllib(table, bins):
    estimator = lone(4, maxBins=bins)
    ours, theirs = models.fit(table, COLUMNS, estimator), by_mllib(table, estimator)
    assert isinstance(ours, forests.ForestModel)
    got, want = ([tuple(r) for r in trees.node_table(m, table).orderBy("node").collect()] for m in (ours, theirs))
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and g[4:6] == w[4:6] and g[7] == w[7]
        assert g[3] == w[3] and g[6] == pytest.approx(w[6], abs=1e-12)
    scored = [{r["person"]: r for r in models.predict(m, table, ["person"]).collect()} for m in (ours, theirs)]
    assert all(scored[0][k]["score"] == pytest.approx(r["score"], abs=1e-12) for k, r in scored[1].items())
    assert all(scored[0][k]["prediction"] == r["prediction"] for k, r in scored[1].items()) and len(scored[0]) == 900


def test_importances_are_those_of_mllib(table):
    # F2, F3
    estimator = lone(4)
    ours, theirs = models.fit(table, COLUMNS, estimator), by_mllib(table, estimator)
    want = theirs.stages[-1].featureImportances.toArray()
    assert ours.stages[-1].featureImportances.toArray() == pytest.approx(want, abs=1e-12)
    raw = [{r["variable"]: r for r in trees.raw_importance(trees.node_table(m, table), COLUMNS).collect()} for m in (ours, theirs)]
    assert all(raw[0][c]["decrease"] == pytest.approx(raw[1][c]["decrease"], rel=1e-9) for c in COLUMNS)


def test_scores_are_the_mean_shares_of_leaves(table):
    # the votes of all tasks, from the node table row by row.
    model = models.fit(table, COLUMNS[:2], models.forest(15, 9))
    nodes = {}
    for r in trees.node_table(model, table).collect():
        nodes.setdefault(r["tree"], {})[r["node"]] = r
    scored = {r["person"]: r for r in models.predict(model, table, ["person", "group_id"]).collect()}
    for row in table.limit(60).collect():
        shares = []
        for tree in nodes.values():
            at = tree[0]
            while at["left"] >= 0:
                at = tree[at["left"] if row[COLUMNS[at["feature"]]] <= at["threshold"] else at["right"]]
            shares.append(at["rows"][1] / sum(at["rows"]))
        found = scored[row["person"]]
        assert found["score"] == pytest.approx(np.mean(shares), abs=1e-12) and found["group_id"] == row["group_id"]
        assert found["prediction"] == float(found["score"] > 0.5) and found["label"] == row["label"]


def test_sister_leaves_differ_and_draws_vary(table):
    model = models.fit(table, COLUMNS, models.forest(10, 30))
    nodes = {}
    for r in trees.node_table(model, table).collect():
        nodes.setdefault(r["tree"], {})[r["node"]] = r
    sizes = set()
    for tree in nodes.values():
        says = {i: float(r["rows"][1] > r["rows"][0]) for i, r in tree.items()}
        for r in tree.values():
            if r["left"] >= 0:
                left, right = tree[r["left"]], tree[r["right"]]
                assert [x + y for x, y in zip(left["rows"], right["rows"])] == r["rows"] and r["gain"] > 0
                assert left["left"] >= 0 or right["left"] >= 0 or says[r["left"]] != says[r["right"]]
        sizes.add(sum(tree[0]["rows"]))
    assert len(sizes) > 5 and 850 < np.mean(list(sizes)) < 950


def test_draws_do_not_depend_on_how_rows_lie(table):
    forest = models.forest(8, 9)
    texts = [models.fit(df, COLUMNS, forest).toDebugString for df in (table, table.repartition(7, "c"))]
    assert texts[0] == texts[1]


def test_large_and_small_nodes_are_split_alike(monkeypatch):
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 8, (5, 6000), dtype=np.uint8)
    label = (bins[0] + bins[1] + rng.integers(0, 6, 6000) > 9).astype(np.uint8)
    found = []
    for large, rows in ((1 << 11, 1 << 15), (1, 1 << 15), (1 << 30, 1 << 30), (1 << 11, 50)):
        monkeypatch.setattr(forests, "LARGE", large)
        monkeypatch.setattr(forests, "SLICE", rows)
        fit = forests._Fit(0, 2, 12, 5, True, 0.0, 3, 8)
        found.append(forests._Grower(bins, label, fit).tree(1, None))
    for other in found[1:]:
        assert all(np.array_equal(found[0][k], other[k]) for k in found[0])
    assert len(found[0]["feature"]) > 200


def test_cuts_follow_all_rows_when_values_are_many(spark):
    df = spark.range(60000).select(F.col("id"), (F.rand(2) ** 2).alias("a"), (F.col("id") % 2).alias("label")).repartition(5).cache()
    rows = forests.coded(df, ["a"], "label")
    values = np.sort([r["a"] for r in df.collect()])
    below = np.searchsorted(values, rows.cuts[0][0]) / 60000
    assert len(below) == 31 and np.abs(below - np.arange(1, 32) / 32).max() < 0.002


@pytest.fixture(scope="module")
def noise(spark):
    """Groups whose rows share a value of their own and a label by lot: to be known only by who has seen them."""
    value = F.pmod(F.xxhash64(F.lit(1), F.col("group_id")), F.lit(100003)).cast("double")
    label = F.pmod(F.xxhash64(F.lit(2), F.col("group_id")), F.lit(2)).cast("int")
    groups = spark.range(1200).withColumn("group_id", (F.col("id") / 6).cast("long"))
    return groups.select(F.col("id").alias("person"), "group_id", label.alias("label"), value.alias("a"), (value % 97).alias("b")).cache()


def test_folds_are_judged_by_forests_that_have_not_seen_them(spark, noise):
    # F7, F8
    forest = RandomForestClassifier(labelCol="label", numTrees=10, maxDepth=20, maxBins=256, featureSubsetStrategy="all", seed=4)
    scored = models.out_of_fold(noise, ["a", "b"], forest, "group_id", ["person"], folds=4)
    assert scored.count() == 1200 == scored.select("person").distinct().count()
    right = scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    seen = models.predict(models.fit(noise, ["a", "b"], forest), noise, [])
    assert 0.3 < right < 0.7 < seen.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    found = models.cross_validate(noise, ["a", "b"], forest, "group_id", folds=4)
    folded = noise.withColumn("fold", models.fold_of("group_id", 4, 42)).join(scored.drop("label"), "person")
    each = folded.groupBy("fold").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("right"))
    rates = [r["right"] for r in each.collect()]
    assert found.avgMetrics == [pytest.approx(np.mean(rates))] and found.stdMetrics == [pytest.approx(np.std(rates))]
    assert found.bestModel.trees.count() == 10


def test_all_folds_and_bags_are_grown_together(spark, noise):
    forest = models.forest(6, 5)
    noise.count()
    few, many = (
        jobs_of(spark, lambda n=n: models.out_of_fold(noise, ["a", "b"], forest, "group_id", ["person"], folds=n).count()) for n in (2, 8)
    )
    assert few == many
    few, many = (jobs_of(spark, lambda n=n: trees.out_of_bag(noise, ["a", "b"], "person", bags=n, trees=n, depth=4).count()) for n in (2, 8))
    assert few == many


def test_bags_vote_on_rows_they_did_not_draw(noise):
    # F4, F9
    found = trees.out_of_bag(noise, ["a"], "person", bags=5, trees=10, depth=0).collect()
    draws = noise.select("person", "label", *[models.drawn_count("person", i, 42).alias(f"b{i}") for i in range(5)]).collect()
    # Trees of depth 0 say what share of their bag is positive.
    says = [sum(r[f"b{i}"] * r["label"] for r in draws) / sum(r[f"b{i}"] for r in draws) for i in range(5)]
    want = {r["person"]: sum(r[f"b{i}"] == 0 for i in range(5)) for r in draws}
    assert {r["person"]: r["n_votes"] for r in found} == want
    shares = {r["person"]: [says[i] for i in range(5) if r[f"b{i}"] == 0] for r in draws}
    assert all(r["share"] == pytest.approx(np.mean(shares[r["person"]])) for r in found if r["n_votes"])
    assert all((r["share"] is None) == (r["n_votes"] == 0) and (r["prediction"] is None) == (r["n_votes"] == 0) for r in found)


def test_forests_survive_storage(spark, table):
    model = models.fit(table, COLUMNS, models.forest(8, 7))
    folder = store.new_path(spark, "forest-test")
    store.save_model(model, folder)
    store.save_model(model, folder)
    again = store.load_model(folder)
    both = [sorted(map(tuple, models.predict(m, table, ["person"]).collect())) for m in (model, again)]
    assert both[0] == both[1] and again.estimator.getMaxDepth() == 7


def test_what_no_forest_takes(table):
    with pytest.raises(Exception, match="NULL or NaN"):
        models.fit(table.withColumn("c", F.when(F.col("person") != 5, F.col("c"))), COLUMNS, models.forest(2, 2))
    three = table.withColumn("label", F.col("person") % 3)
    assert isinstance(models.fit(three, COLUMNS, models.forest(2, 2)), PipelineModel)
    with pytest.raises(Exception, match="(?i)empty|requirement failed"):
        models.fit(table.where("person < 0"), COLUMNS, models.forest(2, 2))
    none = models.predict(models.fit(table, COLUMNS, models.forest(2, 2)), table.where("person < 0"), ["person"])
    assert none.count() == 0 and none.columns == ["person", "label", "prediction", "score"]
    constant = models.fit(table.withColumn("a", F.lit(1.0)), ["a"], models.forest(3, 4))
    assert constant.featureImportances.toArray().tolist() == [0.0]
