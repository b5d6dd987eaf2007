"""Classifiers on the wide table: fitting, prediction, importance, cross-validation."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.stat import Correlation
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchweave.functions.exprs import hash_order
from matchweave.operators import forests
from matchweave.operators.evaluate import confusion_counts, confusion_report

LABEL = "label"


def forest(trees: int = 500, depth: int = 30, seed: int = 42) -> RandomForestClassifier:
    """Random forest of trees grown as deep as MLlib allows, trying sqrt(p) variables per split.

    `fit` grows it whole trees at a time (`forests`). Where MLlib has to, the node that a row has
    reached in each tree is kept with the row, so a level does not send all trees out again and walk
    every row down from their roots. The trees are the same.
    """
    return RandomForestClassifier(
        labelCol=LABEL, numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed, cacheNodeIds=True
    )


def tree(depth: int = 5, min_gain: float = 0.0, seed: int = 42) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(
        labelCol=LABEL, impurity="gini", maxDepth=depth, minInfoGain=min_gain, seed=seed
    )


def linear_svm(iterations: int = 100, penalty: float = 0.01, tolerance: float = 1e-3) -> LinearSVC:
    return LinearSVC(labelCol=LABEL, maxIter=iterations, regParam=penalty, tol=tolerance)


def naive_bayes() -> NaiveBayes:
    return NaiveBayes(labelCol=LABEL, modelType="gaussian")


def logistic_glm() -> GeneralizedLinearRegression:
    """Logistic regression with an inference table; models P(label = 1)."""
    return GeneralizedLinearRegression(labelCol=LABEL, family="binomial", link="logit")


def varying_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at least two different values; a constant one breaks the linear solvers."""
    row = df.agg(*[(F.min(c) < F.max(c)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def fit(train: DataFrame | forests.Part, columns: Sequence[str], estimator) -> PipelineModel | forests.ForestModel:
    if forests.grows(train, columns, estimator):
        return forests.fit(train, columns, estimator)
    assembler = VectorAssembler(inputCols=list(columns), outputCol="features")
    labelled = train.withColumn(LABEL, F.col(LABEL).cast("double"))
    return Pipeline(stages=[assembler, estimator]).fit(labelled)


@contextmanager
def vectors_once(train: DataFrame, columns: Sequence[str], *others: str) -> Iterator[DataFrame]:
    """label, ``features`` and some other columns, kept while several models are fitted on parts of them."""
    labelled = train.withColumn(LABEL, F.col(LABEL).cast("double"))
    vectors = VectorAssembler(inputCols=list(columns), outputCol="features").transform(labelled)
    kept = vectors.select(LABEL, "features", *others).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def fit_vectors(vectors: DataFrame, estimator) -> PipelineModel:
    return Pipeline(stages=[estimator]).fit(vectors)


def predict(model: PipelineModel, test: DataFrame, ids: Sequence[str]) -> DataFrame:
    """ids, label, prediction and score of the positive class.

    The score is a probability where the model gives one, else the signed distance to the
    separating plane, which ranks the rows just as well.
    """
    if isinstance(model, forests.ForestModel):
        return forests.predict(model, test, ids, LABEL)
    out = model.transform(test.withColumn(LABEL, F.col(LABEL).cast("double")))
    if "probability" in out.columns:
        score = vector_to_array("probability")[1]
        prediction = F.col("prediction")
    elif "rawPrediction" in out.columns:
        score = vector_to_array("rawPrediction")[1]
        prediction = F.col("prediction")
    else:
        score = F.col("prediction")
        prediction = (F.col("prediction") > 0.5).cast("double")
    return out.select(*ids, LABEL, prediction.alias("prediction"), score.alias("score"))


def importance(model: PipelineModel, columns: Sequence[str], df: DataFrame) -> DataFrame:
    """Variables with their share of the total importance, largest first."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(c, float(v)) for c, v in zip(columns, values)]
    table = df.sparkSession.createDataFrame(rows, "variable string, importance double")
    return table.orderBy(F.desc("importance"), "variable")


def top_variables(model: PipelineModel, columns: Sequence[str], k: int) -> list[str]:
    values = model.stages[-1].featureImportances.toArray()
    ranked = sorted(zip(columns, values), key=lambda cv: (-cv[1], cv[0]))
    return [c for c, _ in ranked[:k]]


def fold_of(group: str, folds: int, seed: int) -> Column:
    """Fold number of a matched group, from its hash: all members share a fold."""
    digits = F.substring(hash_order(F.col(group), seed), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(folds)).cast("int")


def cross_validate(
    train: DataFrame,
    columns: Sequence[str],
    estimator,
    group: str,
    folds: int = 10,
    grid: Sequence[dict] | None = None,
    seed: int = 42,
    parallelism: int = 4,
):
    """Cross-validated accuracy with folds by matched group. Returns the CrossValidatorModel."""
    maps = ParamGridBuilder().build() if grid is None else list(grid)
    candidates = [estimator.copy(m) for m in maps]
    if all(forests.grows(train, columns, e) for e in candidates):
        return _cross_validate_forests(train, columns, candidates, group, folds, seed)
    validator = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=maps,
        evaluator=MulticlassClassificationEvaluator(labelCol=LABEL, metricName="accuracy"),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
    )
    with vectors_once(train.withColumn("fold", fold_of(group, folds, seed)), columns, "fold") as ready:
        return validator.fit(ready)


def _fold_rows(
    train: DataFrame, columns: Sequence[str], group: str, ids: Sequence[str], folds: int, seed: int, bins: int
) -> forests.Coded:
    """Coded rows with a fit for each fold, which holds the fold out, and one for all rows; the fold is the first id."""
    folded = train.withColumn("fold", fold_of(group, folds, seed))
    weights = [*[F.coalesce(F.col("fold") != i, F.lit(False)).cast("int") for i in range(folds)], F.lit(1)]
    return forests.coded(folded, columns, LABEL, ["fold", *ids], weights, bins)


def _cross_validate_forests(train: DataFrame, columns: Sequence[str], candidates, group: str, folds: int, seed: int):
    """What CrossValidator does, with all forests of a candidate grown together."""
    means, deviations, fitted = [], [], []
    for estimator in candidates:
        rows = _fold_rows(train, columns, group, [], folds, seed, estimator.getMaxBins())
        of_folds = [fit(rows.part(i), columns, estimator) for i in range(folds)]
        whole = fit(rows.part(folds), columns, estimator) if len(candidates) == 1 else None
        scored = forests.held_out(of_folds).where(F.col("fold").isNotNull())
        right = F.avg(((F.col("share") > 0.5).cast("double") == F.col(LABEL)).cast("double"))
        found = {r["fold"]: r["right"] for r in scored.groupBy("fold").agg(right.alias("right")).collect()}
        if len(found) < folds:
            raise ValueError("a fold has no rows to judge by")
        means.append(float(np.mean([found[i] for i in range(folds)])))
        deviations.append(float(np.std([found[i] for i in range(folds)])))
        fitted.append(whole)
    best = int(np.argmax(means))
    model = fitted[best] or fit(train, columns, candidates[best])
    return CrossValidatorModel(model, avgMetrics=means, subModels=None, stdMetrics=deviations)


def side_by_side(work, items, parallelism: int = 4) -> list:
    """Results of independent fits, a few at a time, in the order of the items."""
    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(work, items))


def out_of_fold(
    train: DataFrame, columns: Sequence[str], estimator, group: str, ids: Sequence[str], folds: int = 10, seed: int = 42
) -> DataFrame:
    """Prediction of every training row by a model that has not seen its matched group."""
    if forests.grows(train, columns, estimator):
        rows = _fold_rows(train, columns, group, ids, folds, seed, estimator.getMaxBins())
        scored = forests.held_out([fit(rows.part(i), columns, estimator) for i in range(folds)])
        judged = scored.where(F.col("fold").isNotNull())
        return judged.select(*ids, LABEL, (F.col("share") > 0.5).cast("double").alias("prediction"), F.col("share").alias("score"))
    folded = train.withColumn("fold", fold_of(group, folds, seed))

    def one(i: int) -> DataFrame:
        model = fit(folded.where(F.col("fold") != i), columns, estimator)
        return predict(model, folded.where(F.col("fold") == i), ids)

    return reduce(DataFrame.unionByName, side_by_side(one, range(folds)))


def tree_size_table(
    train: DataFrame,
    columns: Sequence[str],
    group: str,
    depths: Sequence[int],
    gains: Sequence[float],
    folds: int = 10,
    seed: int = 42,
) -> DataFrame:
    """Tree size against training and cross-validated error over depth and minimum gain."""
    base = tree(seed=seed)
    grid = [
        {base.maxDepth: d, base.minInfoGain: g} for d in depths for g in gains
    ]
    validated = cross_validate(train, columns, base, group, folds, grid, seed)

    def one(point) -> tuple:
        params, accuracy = point
        depth, gain = params[base.maxDepth], params[base.minInfoGain]
        model = fit(train, columns, tree(depth, gain, seed))
        scored = predict(model, train, [])
        wrong = scored.agg(F.avg((F.col("prediction") != F.col(LABEL)).cast("double"))).first()[0]
        return depth, gain, model.stages[-1].numNodes, wrong, 1 - float(accuracy)

    rows = side_by_side(one, zip(grid, validated.avgMetrics))
    return train.sparkSession.createDataFrame(
        rows, "max_depth int, min_gain double, n_nodes int, train_error double, cv_error double"
    )


def independent_columns(df: DataFrame, columns: Sequence[str], tolerance: float = 1e-9) -> list[str]:
    """Columns that are no linear combination of a constant and the columns before them.

    The correlations of all columns are summed up in one aggregation; eliminating them in turn
    leaves of each column what the earlier ones do not explain, and a column with next to
    nothing left is dependent. The matrix that reaches the driver is as wide as the model.
    """
    varying = varying_columns(df, columns)
    if len(varying) < 2:
        return varying
    assembled = VectorAssembler(inputCols=varying, outputCol="features").transform(df.select(*varying))
    left = Correlation.corr(assembled, "features").first()[0].toArray()
    kept = []
    for i, name in enumerate(varying):
        if left[i, i] <= tolerance:
            continue
        kept.append(name)
        left = left - np.outer(left[:, i], left[i]) / left[i, i]
    return kept


def glm_table(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The logistic GLM's coefficients over all columns; a dependent column has NULL, as it adds nothing.

    Columns as in `glm_summary`, with ``aliased`` true for the columns left out of the fit.
    """
    used = independent_columns(train, columns)
    found = glm_summary(fit(train, used, logistic_glm()), used, train)
    aliased = [(c,) for c in columns if c not in set(used)]
    rest = train.sparkSession.createDataFrame(aliased, "variable string").withColumn("aliased", F.lit(True))
    return found.withColumn("aliased", F.lit(False)).unionByName(rest, allowMissingColumns=True)


def score_equations(train: DataFrame, columns: Sequence[str], model: PipelineModel) -> DataFrame:
    """variable and ``share``: what is left of sum(x * (label - probability)), over sum(|x|), 0 at the best fit."""
    scored = model.transform(train.withColumn(LABEL, F.col(LABEL).cast("double")))
    missed = F.col(LABEL) - F.col("prediction")
    sums = scored.agg(*[F.try_divide(F.sum(F.col(c) * missed), F.sum(F.abs(c))).alias(c) for c in columns])
    return sums.unpivot([], list(columns), "variable", "share")


def glm_summary(model: PipelineModel, columns: Sequence[str], df: DataFrame) -> DataFrame:
    """Coefficient, standard error, z and p per variable, with the fit's deviances and AIC."""
    fitted = model.stages[-1]
    s = fitted.summary
    names = [*columns, "(Intercept)"]
    values = [*fitted.coefficients.toArray(), fitted.intercept]
    rows = [
        (n, float(v), float(e), float(z), float(p))
        for n, v, e, z, p in zip(names, values, s.coefficientStandardErrors, s.tValues, s.pValues)
    ]
    table = df.sparkSession.createDataFrame(
        rows, "variable string, estimate double, std_error double, z_value double, p_value double"
    )
    return table.withColumns(
        {
            "null_deviance": F.lit(float(s.nullDeviance)),
            "residual_deviance": F.lit(float(s.deviance)),
            "aic": F.lit(float(s.aic)),
            "iterations": F.lit(int(s.numIterations)),
        }
    )


def _poisson_of(unit: Column) -> Column:
    """The Poisson(1) count at a point of its distribution function; it ends where the chance left is below the hash's resolution."""
    most = 19
    chance, reached, count = math.exp(-1.0), math.exp(-1.0), F.lit(most)
    steps = []
    for k in range(most):
        steps.append((reached, k))
        chance /= k + 1
        reached += chance
    for bound, k in reversed(steps):
        count = F.when(unit < bound, F.lit(k)).otherwise(count)
    return count


def poisson_count(key: str, seed: int) -> Column:
    """How often a bootstrap replicate draws a row: a Poisson(1) count from the row's hash.

    The draw depends on the row alone, so it is the same wherever and however often the
    row is computed.
    """
    bits = 52
    return _poisson_of(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << bits)) / F.lit(float(1 << bits)))


def drawn_count(key: str, bag: int, seed: int) -> Column:
    """How often a bag of a forest draws a row, from a digest that any engine gives."""
    digits = F.substring(hash_order(F.concat_ws("|", F.lit(bag), F.col(key).cast("string")), seed), 1, 12)
    return _poisson_of(F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 48)))


def glm_bootstrap(
    train: DataFrame, columns: Sequence[str], key: str, replicates: int = 25, seed: int = 42
) -> DataFrame:
    """Accuracy and kappa of the logistic GLM on the rows each bootstrap replicate leaves out."""

    def one(i: int) -> tuple:
        weighted = train.withColumn("weight", poisson_count(key, seed + i).cast("double"))
        drawn = weighted.where(F.col("weight") > 0)
        used = varying_columns(drawn, columns)
        model = fit(drawn, used, logistic_glm().setWeightCol("weight"))
        scored = predict(model, weighted.where(F.col("weight") == 0), [])
        report = confusion_report(confusion_counts(scored, LABEL, "prediction")).first()
        return i + 1, report["accuracy"], report["kappa"]

    rows = side_by_side(one, range(replicates))
    return train.sparkSession.createDataFrame(rows, "replicate int, accuracy double, kappa double")
