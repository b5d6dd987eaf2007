import pytest
from pyspark.sql import functions as F

from matchweave.functions import exprs
from matchweave.operators import quality


def one(spark, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])


def test_age_truncates(spark, day):
    df = one(spark, at=day("2016-03-01"), born=day("1950-06-15"))
    assert df.select(exprs.age_years(F.col("at"), F.col("born"))).first()[0] == 65
    early = one(spark, at=day("1950-06-01"), born=day("1950-06-15"))
    assert early.select(exprs.age_years(F.col("at"), F.col("born"))).first()[0] == 0


@pytest.mark.parametrize("variant,expected", [("day", 1824), ("day_minus_month", 1842), ("exact", 1826)])
def test_day_variants(spark, day, variant, expected):
    df = one(spark, late=day("2016-03-20"), early=day("2011-03-21"))
    assert df.select(exprs.days_approx(F.col("late"), F.col("early"), variant)).first()[0] == expected


def test_unknown_variant(spark):
    with pytest.raises(ValueError):
        exprs.days_approx(F.col("a"), F.col("b"), "other")


def test_delete_keeps_null(spark, day):
    rows = [
        (1, day("2020-01-01"), day("2020-01-02")),
        (2, day("2020-01-03"), day("2020-01-02")),
        (3, day("2020-01-01"), None),
    ]
    df = spark.createDataFrame(rows, "id int, admitted date, discharged date")
    left = quality.drop_where(df, F.col("admitted") > F.col("discharged"))
    assert sorted(r.id for r in left.collect()) == [1, 3]


def test_null_out(spark):
    df = spark.createDataFrame([(1, "1"), (2, "2"), (3, "9"), (4, None)], "id int, sex string")
    fixed = quality.null_where(df, "sex", (F.col("sex") > "2") | (F.col("sex") < "1"))
    assert [r.sex for r in fixed.orderBy("id").collect()] == ["1", "2", None, None]


def test_zero_to_null(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (None,)], "v double")
    assert sorted((r.v for r in quality.zero_to_null(df, "v").collect()), key=str) == [1.0, None, None]


def test_attrition_counts_null_persons_as_rows_only(spark):
    df = spark.createDataFrame([(1, 5), (1, 50), (2, 50), (None, 5)], "p int, x int")
    out = quality.attrition(df, "p", {"big": F.col("x") > 10})
    got = {r.step: (r.step_name, r.n_rows, r.n_persons) for r in out.collect()}
    assert got == {0: ("start", 4, 2), 1: ("big", 2, 1)}
