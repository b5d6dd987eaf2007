"""Confusion counts, rates, agreement tests, ROC points and AUC of scored rows."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchweave.functions.ordering import running_totals


def scored_frame(scored: DataFrame, truth: str, prediction: str, score: str) -> DataFrame:
    return scored.select(
        F.col(truth).cast("int").alias("truth"),
        F.col(prediction).cast("int").alias("prediction"),
        F.col(score).cast("double").alias("score"),
    )


def classify(df: DataFrame, score: str, threshold: float = 0.5, out: str = "prediction") -> DataFrame:
    return df.withColumn(out, (F.col(score) > threshold).cast("int"))


def contingency(df: DataFrame, prediction: str, truth: str) -> DataFrame:
    return df.groupBy(prediction, truth).agg(F.count(F.lit(1)).alias("n"))


def confusion_counts(df: DataFrame, truth: str, prediction: str, positive: int = 1) -> DataFrame:
    """One row: tp, fp, fn, tn. Rows without a truth or a prediction are not counted."""
    t, p = F.col(truth) == positive, F.col(prediction) == positive
    return df.agg(
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & ~p).alias("tn"),
    )


def confusion_report(counts: DataFrame) -> DataFrame:
    """Rates, kappa and the continuity-corrected McNemar statistic from the four counts."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    div = F.try_divide
    sensitivity, specificity = div(tp, tp + fn), div(tn, tn + fp)
    accuracy = div(tp + tn, n)
    chance = div((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    return counts.select(
        "tp",
        "fp",
        "fn",
        "tn",
        accuracy.alias("accuracy"),
        sensitivity.alias("sensitivity"),
        specificity.alias("specificity"),
        div(tp, tp + fp).alias("ppv"),
        div(tn, tn + fn).alias("npv"),
        div(tp + fn, n).alias("prevalence"),
        div(tp, n).alias("detection_rate"),
        div(tp + fp, n).alias("detection_prevalence"),
        ((sensitivity + specificity) / 2).alias("balanced_accuracy"),
        div(accuracy - chance, 1 - chance).alias("kappa"),
        div(F.greatest(tp + fn, tn + fp), n).alias("no_information_rate"),
        div(F.pow(F.greatest(F.abs(fp - fn) - 1, F.lit(0)), 2), fp + fn).alias("mcnemar"),
    )


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz evaluation)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            delta = c * d
            value *= delta
        if abs(delta - 1.0) < 1e-14:
            break
    return value


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, the CDF of a beta(a, b) variable."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def _beta_quantile(a: float, b: float, p: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(a, b, mid) < p else (lo, mid)
    return (lo + hi) / 2


def agreement_tests(tp: int, fp: int, fn: int, tn: int, level: float = 0.95) -> dict[str, float]:
    """Exact accuracy interval, P[accuracy > no-information rate] and McNemar's p-value."""
    n, right = tp + fp + fn + tn, tp + tn
    rate = max(tp + fn, fp + tn) / n
    tail = (1 - level) / 2
    moved = fp + fn
    mcnemar = max(abs(fp - fn) - 1, 0) ** 2 / moved if moved else float("nan")
    return {
        "accuracy_low": 0.0 if right == 0 else _beta_quantile(right, n - right + 1, tail),
        "accuracy_high": 1.0 if right == n else _beta_quantile(right + 1, n - right, 1 - tail),
        "p_accuracy_over_nir": 1.0 if right == 0 else beta_cdf(right, n - right + 1, rate),
        "p_mcnemar": math.erfc(math.sqrt(mcnemar / 2)) if moved else float("nan"),
    }


def _log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive number, by Stirling's series ten places on."""
    z = x + 10
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3))) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7)))
    steps = F.log(x)
    for i in range(1, 10):
        steps = steps + F.log(x + i)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - steps


def _beta_tail(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, evaluated from its far end."""
    # It settles after some square roots of the parameters; further terms change nothing.
    terms = F.sequence(F.ceil(100 + 5 * F.sqrt(F.greatest(a, b))).cast("int"), F.lit(1), F.lit(-1))

    def step(value: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1 + even / (1 + odd / value)

    first = -(a + b) * x / (a + 1)
    return 1 / (1 + first / F.aggregate(terms, F.lit(1.0), step))


def beta_probability(a: Column, b: Column, x: Column) -> Column:
    """Distribution function of a beta(a, b) variable, as an expression; x lies inside (0, 1)."""
    front = _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * F.log(x) + b * F.log1p(-x)
    return F.when(x < (a + 1) / (a + b + 2), F.exp(front) * _beta_tail(a, b, x) / a).otherwise(
        1 - F.exp(front) * _beta_tail(b, a, 1 - x) / b
    )


def beta_point(a: Column, b: Column, p: float) -> Column:
    """Where the distribution function of a beta(a, b) variable reaches p, by halving."""
    whole = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))

    def halve(ends: Column, _: Column) -> Column:
        middle = (ends["low"] + ends["high"]) / 2
        below = beta_probability(a, b, middle) < p
        return F.struct(
            F.when(below, middle).otherwise(ends["low"]).alias("low"),
            F.when(below, ends["high"]).otherwise(middle).alias("high"),
        )

    ends = F.aggregate(F.sequence(F.lit(1), F.lit(52)), whole, halve)
    return (ends["low"] + ends["high"]) / 2


def _two_sided_normal(z: Column) -> Column:
    """Probability that a standard normal variable lies further out than z >= 0, on either side."""
    x = z / math.sqrt(2)
    near = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(x.alias("term"), x.alias("total")),
        lambda s, n: F.struct(
            (-s["term"] * x * x / n).alias("term"), (s["total"] - s["term"] * x * x / n / (2 * n + 1)).alias("total")
        ),
        lambda s: 1 - 2 / math.sqrt(math.pi) * s["total"],
    )
    far = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), x, lambda value, n: x + n / 2 / value)
    return F.when(x < 2, near).otherwise(F.exp(-x * x) / math.sqrt(math.pi) / far)


def agreement_report(counts: DataFrame, level: float = 0.95) -> DataFrame:
    """Exact accuracy interval, P[accuracy > no-information rate] and McNemar's p-value.

    Binomial tails are beta probabilities; all is computed in expressions over the four counts
    (tp, fp, fn, tn), one row of tests for each row of counts. Without any row counted all are
    NULL, and McNemar's is NULL where nothing was misclassified.
    """
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    sized = counts.select(
        "*", (tp + fp + fn + tn).alias("__n"), (tp + tn).alias("__x"), F.greatest(tp + fn, tn + fp).alias("__most"), (fp + fn).alias("__moved")
    )
    n, x, moved = F.col("__n"), F.col("__x"), F.col("__moved")
    rate, tail = F.col("__most") / n, (1 - level) / 2
    changed = F.greatest(F.abs(fp - fn) - 1, F.lit(0.0))
    some = n > 0
    return sized.select(
        *counts.columns,
        F.when(some, F.when(x == 0, F.lit(0.0)).otherwise(beta_point(x, n - x + 1, tail))).alias("accuracy_low"),
        F.when(some, F.when(x == n, F.lit(1.0)).otherwise(beta_point(x + 1, n - x, 1 - tail))).alias("accuracy_high"),
        F.when(some, F.when((x == 0) | (rate == 1), F.lit(1.0)).otherwise(beta_probability(x, n - x + 1, rate))).alias("p_accuracy_over_nir"),
        F.when(moved > 0, _two_sided_normal(changed / F.sqrt(moved))).alias("p_mcnemar"),
    )


def _score_counts(df: DataFrame, truth: str, score: str, positive: int) -> DataFrame:
    labelled = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull())
    return labelled.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(truth) == positive).alias("pos"),
        F.count_if(F.col(truth) != positive).alias("neg"),
    )


def roc_points(
    df: DataFrame, truth: str, score: str, positive: int = 1, endpoints: bool = False
) -> DataFrame:
    """Sensitivity and specificity when a row counts as positive from each score upward.

    Rows are counted per distinct score first; the running sums go over those counts.
    ``endpoints`` adds the all-positive and all-negative thresholds.
    """
    counts = _score_counts(df, truth, score, positive)
    run = running_totals(counts, "threshold", {"pos": "tp", "neg": "fp"}, descending=True)
    points = run.select(
        "threshold",
        "tp",
        "fp",
        F.try_divide("tp", "tp_total").alias("sensitivity"),
        (1 - F.try_divide("fp", "fp_total")).alias("specificity"),
    )
    if not endpoints:
        return points
    ends = points.sparkSession.createDataFrame(
        [(float("-inf"), None, None, 1.0, 0.0), (float("inf"), 0, 0, 0.0, 1.0)], points.schema
    )
    return points.unionByName(ends)


def roc_overlay(scored: Mapping[str, DataFrame], truth: str, score: str) -> DataFrame:
    """ROC points of several models in one table, with the false positive rate to plot."""
    out = None
    for name, df in scored.items():
        points = roc_points(df, truth, score).select(
            F.lit(name).alias("model"),
            "threshold",
            (1 - F.col("specificity")).alias("false_positive_rate"),
            "sensitivity",
        )
        out = points if out is None else out.unionByName(points)
    return out


def auc_exact(df: DataFrame, truth: str, score: str, positive: int = 1) -> DataFrame:
    """Area under the ROC curve as the exact rank statistic; ties count one half."""
    counts = _score_counts(df, truth, score, positive)
    run = running_totals(counts, "threshold", {"pos": "tp", "neg": "fp"}, descending=True)
    won = F.col("neg") * (F.col("tp") - F.col("pos") / 2)
    return run.agg(
        F.max("tp_total").alias("n_positive"),
        F.max("fp_total").alias("n_negative"),
        F.sum(won).alias("__won"),
    ).select(
        "n_positive",
        "n_negative",
        F.try_divide(
            F.col("__won"), F.col("n_positive").cast("double") * F.col("n_negative").cast("double")
        ).alias("auc"),
    )
