import random

import pytest
from pyspark.sql import functions as F

from matchweave.functions import ordering
from matchweave.operators import evaluate

# tp, fp, fn, tn -> accuracy, sensitivity, specificity, ppv, npv, kappa as published.
PUBLISHED = [
    ((3298, 432, 560, 3426), (0.8714, 0.8548, 0.8880, 0.8842, 0.8595, 0.7429)),
    ((3309, 442, 549, 3416), (0.8716, 0.8577, 0.8854, 0.8822, 0.8615, 0.7431)),
    ((2704, 0, 1154, 19290), (0.9501, 0.7009, 1.0, 1.0, 0.9436, 0.7961)),
    ((2744, 12510, 1114, 6780), (0.4114, 0.7112, 0.3515, 0.1799, 0.8589, 0.0288)),
    ((2452, 1894, 1406, 1964), (0.5723, 0.6356, 0.5091, 0.5642, 0.5828, 0.1446)),
]


@pytest.mark.parametrize("counts,rates", PUBLISHED)
def test_published_rates(spark, counts, rates):
    df = spark.createDataFrame([counts], "tp long, fp long, fn long, tn long")
    row = evaluate.confusion_report(df).first()
    got = [row[c] for c in ("accuracy", "sensitivity", "specificity", "ppv", "npv", "kappa")]
    assert [round(g, 4) for g in got] == pytest.approx(rates, abs=1.01e-4)


def test_published_tests():
    got = evaluate.agreement_tests(3298, 432, 560, 3426)
    assert round(got["accuracy_low"], 4) == 0.8638
    assert round(got["accuracy_high"], 4) == 0.8788
    assert got["p_accuracy_over_nir"] < 2.2e-16
    assert got["p_mcnemar"] == pytest.approx(5.524e-05, rel=1e-3)
    second = evaluate.agreement_tests(3309, 442, 549, 3416)
    assert second["p_mcnemar"] == pytest.approx(0.0007594, rel=1e-3)
    weak = evaluate.agreement_tests(2744, 12510, 1114, 6780)
    assert (round(weak["accuracy_low"], 4), round(weak["accuracy_high"], 4)) == (0.4051, 0.4178)
    assert weak["p_accuracy_over_nir"] == pytest.approx(1.0)


def test_counts_and_contingency(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1), (1, 1), (None, 1)], "t int, p int")
    assert tuple(evaluate.confusion_counts(df, "t", "p").first()) == (2, 1, 1, 1)
    table = {(r.p, r.t): r.n for r in evaluate.contingency(df, "p", "t").collect()}
    assert table[(1, 1)] == 2 and table[(1, None)] == 1


@pytest.mark.parametrize("buckets", [5, 256])
def test_roc_area_equals_rank_auc(spark, monkeypatch, buckets):
    monkeypatch.setattr(ordering, "BUCKETS", buckets)
    monkeypatch.setattr(ordering, "SAMPLE_PER_BUCKET", 3)
    rng = random.Random(5)
    data = [(int(rng.random() < 0.4), rng.randrange(60) / 10) for _ in range(500)]
    df = spark.createDataFrame(data, "t int, s double")
    pos = [s for t, s in data if t == 1]
    neg = [s for t, s in data if t == 0]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert evaluate.auc_exact(df, "t", "s").first().auc == pytest.approx(want)
    points = evaluate.roc_points(df, "t", "s", endpoints=True).orderBy(F.desc("threshold")).collect()
    xy = [(1 - p.specificity, p.sensitivity) for p in points]
    assert xy[0] == (0.0, 0.0) and xy[-1] == (1.0, 1.0)
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(xy, xy[1:]))
    assert area == pytest.approx(want)


def test_classify_and_overlay(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.5), (0, 0.1)], "truth int, score double")
    assert [r.prediction for r in evaluate.classify(df, "score").orderBy("score").collect()] == [0, 0, 1]
    both = evaluate.roc_overlay({"a": df, "b": df}, "truth", "score")
    assert {r.model: r["count"] for r in both.groupBy("model").count().collect()} == {"a": 3, "b": 3}
