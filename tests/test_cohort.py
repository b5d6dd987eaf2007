import random

import pytest
from pyspark.sql import functions as F

from matchweave.functions.exprs import hash_order, year_window
from matchweave.operators import cases, controls, features, matching, wide
from matchweave.plans.retail import RetailStudy


def tuples(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_first_event_ranks_before_the_window(spark, day):
    events = spark.createDataFrame(
        [(1, day("2014-05-01"), "x"), (1, day("2016-05-01"), "x"), (2, day("2016-01-01"), "x"),
         (2, day("2015-01-01"), "y"), (None, day("2016-01-01"), "x")],
        "person long, at date, code string",
    )
    codes = spark.createDataFrame([("x",)], "code string")
    index = cases.index_event(events, codes, "person", "code", ["at"])
    kept = cases.eligible(index, {"window": ~year_window(F.col("at"), 2015, 2019)})
    assert tuples(kept, "person", "at") == [(2, day("2016-01-01"))]


def test_eligible_keeps_unknown(spark):
    df = spark.createDataFrame([(1, 10), (2, None), (3, 40)], "p int, age int")
    assert tuples(cases.eligible(df, {"minor": F.col("age") < 18}), "p") == [(2,), (3,)]


def test_code_list(spark):
    df = spark.createDataFrame(
        [("A1", "early alzheimer x"), ("A2", "Alzheimer society"), ("B1", "other"), ("B2", None)],
        "code string, text string",
    )
    found = cases.code_list(df, "code", "text", ["%lzheimer%"], exclude=["A2"])
    assert tuples(found, "code") == [("A1",)]


def test_reconcile(spark, day):
    schema = "person long, sex int, at date, age int, code string"
    gp = spark.createDataFrame(
        [(1, 1, day("2016-05-01"), 80, "r1"), (2, None, day("2015-01-01"), 70, "r2")], schema
    )
    hospital = spark.createDataFrame(
        [(1, 2, day("2015-02-01"), None, "h1"), (3, 2, day("2018-01-01"), 66, "h3")], schema
    )
    got = cases.reconcile(
        gp, hospital, "person", ["sex"], ["at", "age"], {"code": "read"}, {"code": "icd"}
    )
    assert tuples(got, "person", "sex", "at", "age", "read", "icd") == [
        (1, 1, day("2015-02-01"), 80, "r1", "h1"),
        (2, None, day("2015-01-01"), 70, "r2", None),
        (3, 2, day("2018-01-01"), 66, None, "h3"),
    ]


def test_asof(spark, day):
    history = spark.createDataFrame(
        [(1, day("2010-01-01"), day("2012-12-31"), 2), (1, day("2013-01-01"), day("9999-01-01"), 4)],
        "person long, start date, end date, score int",
    )
    at = spark.createDataFrame(
        [(1, day("2012-12-31")), (1, day("2013-01-01")), (1, day("2009-06-01"))], "person long, at date"
    )
    got = cases.asof_attribute(at, history, "person", "at", "start", "end", "score", "dep")
    assert tuples(got, "at", "dep") == [(day("2012-12-31"), 2), (day("2013-01-01"), 4)]


def match(spark, case_rows, pool_rows, k=5):
    listed = spark.createDataFrame(case_rows, "person long, stratum long")
    pool = spark.createDataFrame(pool_rows, "person long, stratum long")
    tenth = F.call_function("div", F.col("person"), F.lit(10))
    return matching.match_exact(
        listed, pool, "person", ["stratum"], k, ["person"], ["person"], [tenth], [tenth]
    )


def test_match_runs_out(spark):
    pairs = match(spark, [(101, 1), (102, 1)], [(i, 1) for i in range(1, 8)])
    assert tuples(pairs, "case_person", "control_person") == [
        (101, 1), (101, 2), (101, 3), (101, 4), (101, 5), (102, 6), (102, 7),
    ]
    assert tuples(matching.complete_sets(pairs, "case_person", 5), "case_person") == [(101,)] * 5


@pytest.mark.parametrize("seed", range(3))
def test_match_equals_sequential_loop(spark, seed):
    rng = random.Random(seed)
    # One stratum holds most cases and controls.
    stratum = lambda: 0 if rng.random() < 0.6 else rng.randrange(1, 5)
    listed = [(1000 + i, stratum()) for i in range(40)]
    pool = [(i, stratum()) for i in range(150)]
    left, want = sorted(pool), []
    for case, s in sorted(listed):
        taken = [c for c in left if c[1] == s][:5]
        left = [c for c in left if c not in taken]
        want += [(case, c) for c, _ in taken]
    pairs = match(spark, listed, pool)
    assert tuples(pairs, "case_person", "control_person") == sorted(want, key=repr)
    assert pairs.select("control_person").distinct().count() == pairs.count()


def test_control_pool_caps_each_stratum(spark):
    people = spark.range(600).select(
        F.col("id").alias("person"), F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 3).alias("s")
    )
    drawn = controls.control_pool(people, "person", ["s"], 50, seed=1)
    sizes = {r.s: r.n for r in controls.stratum_sizes(drawn, ["s"]).collect()}
    assert sizes == {0: 50, 1: 50, 2: 50}
    order = people.withColumn("o", hash_order(F.col("person"), 1)).where("s = 0").orderBy("o").limit(50)
    assert tuples(drawn.where("s = 0"), "person") == tuples(order, "person")


def test_exclusions_and_ledger(spark):
    pool = spark.range(10).withColumnRenamed("id", "person")
    sources = {
        "a": spark.createDataFrame([(1,), (1,), (2,)], "person long"),
        "b": spark.createDataFrame([(2,), (3,), (99,)], "person long"),
    }
    assert tuples(controls.exclude(pool, sources), "person") == [
        (0,), (4,), (5,), (6,), (7,), (8,), (9,),
    ]
    assert tuples(controls.exclusion_ledger(pool, sources), "step", "source", "n_removed", "n_left") == [
        (1, "a", 2, 8), (2, "b", 1, 7),
    ]


def test_persons_by_list(spark):
    events = spark.createDataFrame(
        [(1, "a"), (1, "a"), (2, "b"), (3, "c"), (4, "ab"), (None, "a")], "person long, code string"
    )
    lists = {"x": ["a", "ab"], "y": ["b", "ab", "ab"]}
    lists = {n: spark.createDataFrame([(c,) for c in cs], "code string") for n, cs in lists.items()}
    found = controls.persons_by_list(events, lists, "code", ["person"])
    assert {n: tuples(df, "person") for n, df in found.items()} == {"x": [(1,), (4,)], "y": [(2,), (4,)]}


def test_group_and_stack(spark, day):
    pairs = spark.createDataFrame(
        [(20, 1, day("2016-01-01")), (20, 2, day("2016-01-01")), (10, 3, day("2017-01-01"))],
        "case_person long, control_person long, at date",
    )
    grouped = matching.assign_group(pairs, "case_person")
    assert tuples(grouped, "case_person", "group_id") == [(10, 1), (20, 2), (20, 2)]
    members = matching.stack_members(grouped, "case_person", "control_person", ["at", "group_id"])
    assert tuples(members, "person", "group_id", "label") == [
        (1, 2, 0), (10, 1, 1), (2, 2, 0), (20, 2, 1), (3, 1, 0),
    ]


@pytest.fixture
def lookback(spark, day):
    members = spark.createDataFrame(
        [(1, 1, 1, day("2020-01-01")), (2, 1, 0, day("2020-01-01"))],
        "person long, group_id long, label int, index_date date",
    )
    events = spark.createDataFrame(
        [
            (1, "A", day("2010-01-01"), 2.0),
            (1, "A", day("2010-01-01"), None),
            (1, "A", day("2011-01-01"), 4.0),
            (1, "A", day("2012-01-01"), 6.0),
            (1, "A", day("2019-01-01"), 600.0),
            (1, "B", day("2010-01-01"), 0.0),
            (1, "C", day("2010-01-01"), 1.0),
            (3, "A", day("2010-01-01"), 1.0),
        ],
        "person long, code string, at date, value double",
    )
    codes = spark.createDataFrame([("A",), ("B",)], "code string")

    def run(mode="reference"):
        return features.lookback_features(
            members, events, codes, "person", "code", "index_date", "at", "value", 1825, mode
        )

    return members, run


def test_lookback_counts_from_the_first_day(lookback):
    _, run = lookback
    assert tuples(run(), "person", "code", "mean_value", "n_events") == [(1, "A", 4.0, 3), (1, "B", 0.0, 1)]
    assert tuples(run("all"), "person", "code", "n_events") == [(1, "A", 4), (1, "B", 1)]


def test_lookback_without_a_small_member_table(lookback, monkeypatch):
    _, run = lookback
    monkeypatch.setattr(features, "is_small", lambda df: False)
    assert tuples(run(), "person", "code", "mean_value", "n_events") == [(1, "A", 4.0, 3), (1, "B", 0.0, 1)]


def test_backfill(lookback):
    members, run = lookback
    full = features.backfill(run(), members.drop("index_date"), "person", "code")
    assert tuples(full.where("code = 'Z'"), "person", "label", "mean_value", "n_events") == [(2, 0, None, 0)]
    assert full.count() == 3


def test_frequent_codes(spark, day):
    listed = spark.createDataFrame([(1, 1, day("2016-03-20"))], "person long, sex int, at date")
    rows = [("A", 3), ("B", 2), ("C", 2), ("D", 1)]
    data = [(1, 1, c, day("2011-03-21")) for c, n in rows for _ in range(n)]
    data += [(1, 2, "D", day("2011-03-21"))] * 9 + [(1, 1, "D", day("2015-03-21"))] * 9
    events = spark.createDataFrame(data, "person long, sex int, code string, day date")

    def run(**kw):
        out = features.frequent_codes(listed, events, ["person", "sex"], "code", "at", "day", 1825, **kw)
        return tuples(out, "code", "n")

    assert run(k=3) == [("A", 3), ("B", 2), ("C", 2)]
    assert run(k=3, exclude=["A"], keep=1) == [("B", 2)]
    assert run(k=9, min_count=2) == [("A", 3), ("B", 2), ("C", 2)]
    assert run(k=9, variant="day") == []


def test_rebalance_keeps_the_case_and_the_smallest_control(spark):
    rows = [(1, p, int(p == 5), c) for p in (5, 9, 2, 7) for c in "ab"]
    df = spark.createDataFrame(rows, "group_id long, person long, label int, code string")
    assert tuples(features.rebalance(df, "group_id", "label", "person"), "person", "code") == [
        (2, "a"), (2, "b"), (5, "a"), (5, "b"),
    ]


def test_contrast(spark):
    rows = [("A", 1, 1.0, 1), ("A", 1, 2.0, 5), ("A", 1, None, 3), ("A", 0, None, 2), ("B", 0, 9.0, 9)]
    df = spark.createDataFrame(rows, "code string, label int, v double, n long")
    out = features.feature_contrast(df, "code", "label", ["v", "n"], ["A"])
    assert tuples(out, "code", "label", "mean_v", "median_v", "mean_n", "median_n") == [
        ("A", 0, None, None, 2.0, 2.0), ("A", 1, 1.5, 1.5, 3.0, 3.0),
    ]


def test_leak_check_and_descriptions(spark):
    chosen = spark.createDataFrame([("A",), ("B",)], "code string")
    outcome = spark.createDataFrame([("B",), ("C",)], "code string")
    names = spark.createDataFrame([("A", "apple"), ("C", "cherry")], "code string, text string")
    assert tuples(features.leak_check(chosen, outcome, "code"), "code") == [("B",)]
    assert tuples(features.describe_codes(chosen, names, "code"), "code", "text") == [("A", "apple")]


def test_sparse_columns_by_class(spark):
    rows = [(1, None, None), (1, None, 1.0), (1, 1.0, 1.0), (1, 1.0, 1.0)] + [(0, 1.0, None)] * 3
    df = spark.createDataFrame(rows, "label int, val_a double, val_b double")
    kept = wide.drop_sparse(df, ["val_a", "val_b"], "label")
    # a: dropped by cases, kept by controls; b: the other way round.
    assert tuples(kept, "label", "val_a", "val_b") == sorted(
        [(0, 1.0, None)] * 3 + [(1, None, 1.0)] * 3 + [(1, None, None)], key=repr
    )
    assert wide.drop_sparse(df, ["val_a", "val_b"], "label", keep="all").columns == ["label"]
    assert wide.drop_sparse(df.drop("val_b").where("label = 1"), ["val_a"], "label").columns == ["label"]
    empty = df.withColumn("val_c", F.lit(None).cast("double"))
    assert wide.drop_all_missing(empty, ["val_a", "val_c"]).columns == ["label", "val_a", "val_b"]


def test_impute_by_class_and_from_train(spark):
    rows = [(1, 1.0), (1, None), (1, 3.0), (1, 10.0), (0, None), (0, 4.0)]
    df = spark.createDataFrame(rows, "label int, val_a double")
    by_class = wide.impute_median(df, ["val_a"], by="label")
    assert tuples(by_class, "label", "val_a") == sorted(
        [(1, 1.0), (1, 3.0), (1, 3.0), (1, 10.0), (0, 4.0), (0, 4.0)], key=repr
    )
    from_train = wide.impute_median(df, ["val_a"], by=None, fit_on=df.where("label = 1"))
    assert tuples(from_train.where("label = 0"), "val_a") == [(3.0,), (4.0,)]


def test_long_rows_give_the_wide_tables_medians_and_missing_counts(spark):
    rows = [(1, 1, "A", 2, 3.0), (1, 1, "B", 1, None), (2, 1, "A", 1, 8.0), (3, 0, "A", 1, 4.0), (4, 0, "Z", 0, None), (5, 1, "B", 2, 7.0),
            (6, None, "A", 1, 2.0), (7, None, "C", 1, 1.0)]
    long = spark.createDataFrame(rows, "person long, label int, code string, n_events long, mean_value double")
    table = wide.pivot_wide(long, ["person", "label"], "code", ["A", "B"])
    members = long.select("person", "label").distinct()
    columns = ["val_A", "val_B"]
    by_wide = wide.missingness(table, columns, "label")
    by_long = wide.missingness_of_long(long, members, "label", "code", ["A", "B"])
    names = ["label", "n_rows", "column_name", "n_missing", "kept"]
    assert tuples(by_long, *names) == tuples(by_wide, *names)
    medians = wide.medians_of_long(long, "label", "code", ["A", "B"])
    known = wide.impute_median(table, columns, by="label", medians=medians)
    assert tuples(known, *table.columns) == tuples(wide.impute_median(table, columns, by="label"), *table.columns)
    blanked = wide.drop_sparse(table, columns, "label", profile=by_long)
    left = wide.medians_of_long(long, "label", "code", ["A", "B"], profile=by_long)
    again = wide.impute_median(blanked, wide.value_columns(blanked), by="label", medians=left)
    assert tuples(again, *blanked.columns) == tuples(wide.impute_median(blanked, wide.value_columns(blanked), by="label"), *blanked.columns)
    assert wide.missingness_of_long(long, members, "label", "code", []).count() == 0
    assert wide.medians_of_long(long, "label", "code", []).count() == 0
    assert wide.medians_of_long(long.limit(0), "label", "code", ["A"]).count() == 0


def test_codes_beyond_the_columns_stay_in_long_form(spark):
    rows = [(1, "B"), (2, "B"), (3, "A"), (4, "A"), (5, "C"), (6, "Z"), (7, "Z"), (8, "Z"), (9, None)]
    long = spark.createDataFrame(rows, "person long, code string")
    assert wide.top_codes(long, "code", 2) == ["A", "B"]
    assert wide.top_codes(long, "code", 9) == ["A", "B", "C"]
    assert wide.top_codes(long.limit(0), "code", 9) == []
    assert tuples(wide.outside_codes(long, "code", ["A", "B"]), "person", "code") == [(5, "C")]
    assert wide.outside_codes(long, "code", []).count() == 5
    assert wide.code_list(long, "code") == ["A", "B", "C", "Z"]
    with pytest.raises(ValueError, match="more than 3 codes"):
        wide.code_list(long, "code", 3)


def test_split_is_exact_and_by_group(spark):
    groups = spark.range(1, 15430).withColumnRenamed("id", "group_id")
    twice = groups.union(groups)
    sizes = {r.part: r["count"] for r in wide.group_split(twice, "group_id", 0.75, 1).groupBy("part").count().collect()}
    assert sizes == {"train": 11571, "test": 3858}


def test_pivot_names(spark):
    rows = [(1, 1, "44E..", 2, 1.5), (1, 1, "Z9", 1, None), (2, 0, "Z", 0, None)]
    df = spark.createDataFrame(rows, "person long, label int, code string, n_events long, mean_value double")
    out = wide.pivot_wide(df, ["person", "label"], "code", ["44E..", "Z9"])
    assert out.columns == ["person", "label", "n_44E__", "n_Z9", "val_44E__", "val_Z9"]
    assert tuples(out, *out.columns) == [(1, 1, 2, 1, 1.5, None), (2, 0, 0, 0, None, None)]
    rows += [(1, 1, "44e..", 5, 2.5), (1, 1, "44E__", 7, None)]
    df = spark.createDataFrame(rows, df.schema)
    out = wide.pivot_wide(df, ["person", "label"], "code", ["44e..", "44E..", "44E__"])
    assert len({c.lower() for c in out.columns}) == 8
    first = out.where("person = 1").first().asDict()
    names = wide.column_names(["44e..", "44E..", "44E__"])
    assert [first["n_" + names[c]] for c in ("44e..", "44E..", "44E__")] == [5, 2, 7]
    assert [first["val_" + names[c]] for c in ("44e..", "44E..", "44E__")] == [2.5, 1.5, None]


def test_retail_study_invariants(spark):
    study = RetailStudy(spark, "/root/testdata/sf0.01")
    assert (study.index.count(), study.cases.count()) == (480, 177)
    assert (study.staged_pairs.count(), study.sets.count()) == (793, 770)
    members = study.members
    assert members.count() == 924 == members.select("person").distinct().count()
    assert members.where("label = 1").count() == 154
    assert study.features.select("person").distinct().count() == 924
