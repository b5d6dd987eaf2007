import math

import pytest
from pyspark.sql import functions as F

from matchweave.operators import evaluate, models
from matchweave.sources import store

COLUMNS = ["n_a", "val_b", "val_noise"]


@pytest.fixture(scope="module")
def data(spark):
    """Matched groups of two in which n_a and val_b carry the label."""
    noise = lambda seed: F.pmod(F.xxhash64(F.lit(seed), F.col("person")), F.lit(1000)) / 1000.0
    return (
        spark.range(600)
        .select(
            F.col("id").alias("person"),
            F.call_function("div", F.col("id"), F.lit(2)).alias("group_id"),
            (F.col("id") % 2).cast("int").alias("label"),
        )
        .withColumn("n_a", (F.col("label") * 3 + noise(1) * 4).cast("long"))
        .withColumn("val_b", F.col("label") + noise(2) * 1.5)
        .withColumn("val_noise", noise(3))
        .cache()
    )


@pytest.mark.parametrize(
    "make",
    [
        lambda: models.forest(20, 5),
        models.tree,
        lambda: models.linear_svm(20),
        models.naive_bayes,
        models.logistic_glm,
    ],
    ids=["forest", "tree", "svm", "bayes", "glm"],
)
def test_models_find_the_signal(data, make):
    train, test = data.where("group_id < 225"), data.where("group_id >= 225")
    model = models.fit(train, COLUMNS, make())
    scored = models.predict(model, test, ["person"])
    assert scored.columns == ["person", "label", "prediction", "score"] and scored.count() == 150
    report = evaluate.confusion_report(evaluate.confusion_counts(scored, "label", "prediction")).first()
    assert report.accuracy > 0.8
    assert evaluate.auc_exact(scored, "label", "score").first().auc > 0.9


def test_importance(data):
    model = models.fit(data, COLUMNS, models.forest(20, 5))
    table = models.importance(model, COLUMNS, data).collect()
    assert sum(r.importance for r in table) == pytest.approx(1)
    assert table[-1].variable == "val_noise"
    assert set(models.top_variables(model, COLUMNS, 2)) == {"n_a", "val_b"}


def test_cross_validation_and_tree_sizes(data):
    found = models.cross_validate(data, COLUMNS, models.tree(), "group_id", folds=3)
    assert found.avgMetrics[0] > 0.8
    table = models.tree_size_table(data, COLUMNS, "group_id", [1, 4], [0.0], folds=3).orderBy("max_depth").collect()
    assert [r.n_nodes for r in table][0] == 3
    assert table[1].train_error <= table[0].train_error


def test_out_of_fold_covers_every_row_once(data):
    scored = models.out_of_fold(data, COLUMNS, models.tree(), "group_id", ["person"], folds=3)
    assert scored.count() == 600 == scored.select("person").distinct().count()
    report = evaluate.confusion_report(evaluate.confusion_counts(scored, "label", "prediction")).first()
    assert report.accuracy > 0.8


def test_folds_keep_groups_together(data):
    folds = data.withColumn("fold", models.fold_of("group_id", 5, 1))
    assert folds.groupBy("group_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert folds.select("fold").distinct().count() == 5


def test_glm_table(data):
    weaker = F.pmod(F.xxhash64(F.lit(9), F.col("person")), F.lit(3))
    data = data.withColumn("n_a", F.col("label") + weaker).withColumn("val_b", F.rand(4))
    model = models.fit(data, COLUMNS, models.logistic_glm())
    rows = {r.variable: r for r in models.glm_summary(model, COLUMNS, data).collect()}
    assert set(rows) == {*COLUMNS, "(Intercept)"}
    assert rows["n_a"].estimate > 0 and rows["n_a"].p_value < 0.001 < rows["val_noise"].p_value
    r = rows["n_a"]
    assert r.z_value == pytest.approx(r.estimate / r.std_error)
    assert r.null_deviance == pytest.approx(600 * 2 * math.log(2), rel=1e-6)
    assert r.aic == pytest.approx(r.residual_deviance + 2 * 4, rel=1e-6)


def test_bootstrap(spark, data):
    counts = spark.range(20000).select(models.poisson_count("id", 3).alias("n"))
    row = counts.agg(F.avg("n"), F.var_pop("n"), F.avg((F.col("n") == 0).cast("int"))).first()
    assert row[0] == pytest.approx(1, abs=0.03) and row[1] == pytest.approx(1, abs=0.05)
    assert row[2] == pytest.approx(math.exp(-1), abs=0.01)
    out = models.glm_bootstrap(data, COLUMNS, "person", replicates=3).collect()
    assert len(out) == 3 and all(r.accuracy > 0.8 and r.kappa > 0.6 for r in out)


def test_constant_columns_are_left_out(data):
    df = data.withColumn("n_same", F.lit(1)).withColumn("n_null", F.lit(None).cast("int"))
    assert models.varying_columns(df, [*COLUMNS, "n_same", "n_null"]) == COLUMNS


def test_tables_and_models_survive_storage(spark, data):
    folder = store.new_path(spark, "test")
    store.write_table(data, f"{folder}/t")
    store.append_table(data, f"{folder}/t")
    assert store.read_table(spark, f"{folder}/t", rename={"label": "y"}).where("y = 1").count() == 600
    model = models.fit(data, COLUMNS, models.tree())
    store.save_model(model, f"{folder}/m")
    again = store.load_model(f"{folder}/m")
    both = [sorted(map(tuple, models.predict(m, data, ["person"]).collect())) for m in (model, again)]
    assert both[0] == both[1]
