import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from matchweave.functions import ordering
from matchweave.functions.exprs import hash_bucket, hash_order


@pytest.fixture
def small_cuts(monkeypatch):
    monkeypatch.setattr(ordering, "BUCKETS", 7)
    monkeypatch.setattr(ordering, "SAMPLE_PER_BUCKET", 2)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    # Key 0 holds more than a third of all rows; some values tie, some are missing.
    data = [
        (
            i,
            0 if rng.random() < 0.4 else rng.randrange(1, 30),
            rng.randrange(0, 60),
            None if rng.random() < 0.1 else rng.choice([rng.random(), float(rng.randrange(5))]),
        )
        for i in range(3000)
    ]
    return spark.createDataFrame(data, "id long, key long, step long, value double").cache()


@pytest.mark.parametrize("limit", [None, 25])
def test_rank_equals_row_number(rows, limit):
    keyed = rows.withColumn("draw", hash_order(F.col("id"), 3))
    got = ordering.rank_in_group(
        keyed, ["key"], ["draw", "id"], [hash_bucket(F.col("draw"), 1)], "rank", limit
    )
    want = keyed.withColumn(
        "rank", F.row_number().over(Window.partitionBy("key").orderBy("draw", "id")).cast("long")
    )
    if limit:
        want = want.where(F.col("rank") <= limit)
    assert sorted(map(tuple, got.select("id", "rank").collect())) == sorted(
        map(tuple, want.select("id", "rank").collect())
    )


@pytest.mark.parametrize("step", [-1, 1])
def test_neighbour_equals_window(rows, step):
    df = rows.withColumn("step", F.when(F.col("step") > 2, F.col("step")))
    order = [F.col("step").asc_nulls_last(), F.col("id").asc_nulls_last()]
    fn = F.lag if step < 0 else F.lead
    want = df.withColumn("near_value", fn("value").over(Window.partitionBy("key").orderBy(*order)))
    same(ordering.neighbour(df, ["key"], ["step", "id"], ["value"], "near_", step), want)


def test_neighbour_of_text_and_null_keys(spark):
    data = [(i, None if i % 5 == 0 else "ab"[i % 2], f"t{i:03d}", float(i)) for i in range(200)]
    df = spark.createDataFrame(data, "id long, key string, t string, value double").repartition(5)
    got = {r.id: r.near_value for r in ordering.neighbour(df, ["key"], ["t"], ["value"], "near_", -1).collect()}
    last, want = {}, {}
    for i, key, _, value in data:
        want[i] = last.get(key) if key else None
        last[key] = value
    assert got == want


@pytest.mark.parametrize("step", [-1, 1])
def test_neighbour_of_a_frequent_key_is_cut(spark, step):
    """Most rows have one key; order values are text, missing or NaN. The key's rows spread over cuts."""
    texts = [None, "a", "b", "é", "zz"]
    data = [(i, "hot" if i % 10 else f"k{i % 50}", texts[i % 5], float("nan") if i % 7 == 0 else float(i % 13), i * 1.0) for i in range(3000)]
    df = spark.createDataFrame(data, "id long, key string, t string, x double, value double").repartition(4)
    bounds = ordering.hot_bounds(df, ["key"], ["t", "x", "id"])
    assert bounds.count() >= 1 and bounds.selectExpr("max(size(__bounds))").first()[0] >= 4
    order = [F.col(c).asc_nulls_last() for c in ("t", "x", "id")]
    want = df.withColumn("near_value", (F.lag if step < 0 else F.lead)("value").over(Window.partitionBy("key").orderBy(*order)))
    got = ordering.neighbour(df, ["key"], ["t", "x", "id"], ["value"], "near_", step).select(*want.columns)
    key = lambda r: r["id"]
    assert [r["near_value"] for r in sorted(got.collect(), key=key)] == [r["near_value"] for r in sorted(want.collect(), key=key)]


def test_ranks_with_null_keys_and_cuts(spark):
    data = [(i, None if i % 4 == 0 else i % 3, None if i % 7 == 0 else i % 11) for i in range(300)]
    df = spark.createDataFrame(data, "id long, key long, v long").repartition(4)
    got = {r.id: r["rank"] for r in ordering.rank_in_group(df, ["key"], ["v", "id"], [F.col("v")], "rank").collect()}
    want, place = {}, {}
    for i, key, _ in sorted(data, key=lambda r: (r[2] is None, r[2], r[0])):
        place[key] = place.get(key, 0) + 1
        want[i] = place[key]
    assert got == want
    few = ordering.rank_in_group(df, ["key"], ["v", "id"], [F.col("v")], "rank", limit=9)
    assert {r.id: r["rank"] for r in few.collect()} == {i: r for i, r in want.items() if r <= 9}


def test_dense_ids_of_text(spark):
    df = spark.createDataFrame([(f"é{x % 40:02d}" if x % 3 else None,) for x in range(300)], "c string")
    got = {r.c: r.g for r in ordering.dense_ids(df, "c", "g").collect()}
    assert got == {f"é{x:02d}": x + 1 for x in range(40)}


def same(got, want):
    key = lambda r: r[0]
    assert sorted(map(tuple, got.select("id", "near_value").collect()), key=key) == sorted(
        map(tuple, want.select("id", "near_value").collect()), key=key
    )


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, small_cuts, descending):
    rng = random.Random(1)
    data = [(float(v), rng.randrange(10)) for v in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(data, "v double, n long")
    assert ordering.order_bounds(df, "v")
    got = {r.v: (r.run, r.run_total) for r in ordering.running_totals(df, "v", {"n": "run"}, descending).collect()}
    total, want = 0, {}
    for v, n in sorted(data, reverse=descending):
        total += n
        want[v] = total
    assert got == {v: (r, total) for v, r in want.items()}


def test_dense_ids(spark, small_cuts, day):
    df = spark.createDataFrame([(x % 90 * 7,) for x in range(400)], "c long")
    got = {r.c: r.g for r in ordering.dense_ids(df, "c", "g").collect()}
    assert got == {x * 7: x + 1 for x in range(90)}


@pytest.mark.parametrize("cuts", [True, False])
def test_group_median(rows, request, cuts):
    if cuts:
        request.getfixturevalue("small_cuts")
    got = {r.key: r.m for r in ordering.group_median(rows, ["key"], "value", "m").collect()}
    want = {r.key: r.m for r in rows.groupBy("key").agg(F.median("value").alias("m")).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_median_of_four(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 4.0, 10.0)], "k string, v double")
    assert ordering.group_median(df, ["k"], "v", "m").first().m == 3.0


def test_cut_of_dates(spark, day, small_cuts):
    df = spark.sql("SELECT explode(sequence(DATE'2020-01-01', DATE'2020-12-31')) AS d")
    bounds = ordering.order_bounds(df, "d")
    cut = ordering.with_cut(df, "d", bounds)
    ordered = [r["__cut"] for r in cut.orderBy("d").collect()]
    assert ordered == sorted(ordered) and len(set(ordered)) == len(bounds) + 1 == 7


def test_text_order_is_refused(spark):
    with pytest.raises(TypeError):
        ordering.order_bounds(spark.createDataFrame([("a",)], "c string"), "c")
