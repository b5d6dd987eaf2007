"""Exact 1:k matching without replacement, and the matched sets that follow from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchweave.functions.ordering import dense_ids, rank_in_group


def match_exact(
    cases: DataFrame,
    pool: DataFrame,
    person: str,
    strata: Sequence[str],
    k: int,
    case_order: Sequence[str],
    pool_order: Sequence[str],
    case_split: Sequence[Column],
    pool_split: Sequence[Column],
    case_person: str = "case_person",
    control_person: str = "control_person",
) -> DataFrame:
    """Give each case the next ``k`` unused controls of its stratum.

    Taking cases in turn and removing the controls they use is the same as numbering
    cases and controls within the stratum and pairing case *i* with the *i*-th run of
    ``k`` controls. Numbering and pairing key on (stratum, slot), so neither step holds
    a whole stratum in one task. Cases for which the pool has run out get no row. Rows
    without a person are nobody: they take no place in the numbering.
    """
    strata = list(strata)
    cases, pool = (df.where(F.col(person).isNotNull()) for df in (cases, pool))
    slots = rank_in_group(cases, strata, case_order, case_split, "__slot")
    runs = rank_in_group(pool, strata, pool_order, pool_split, "__rank")
    runs = runs.select(
        *strata,
        F.col(person).alias(control_person),
        (F.call_function("div", F.col("__rank") - 1, F.lit(k)) + 1).alias("__slot"),
    )
    slots = slots.withColumnRenamed(person, case_person)
    return slots.join(runs, strata + ["__slot"]).drop("__slot")


def complete_sets(pairs: DataFrame, case: str, k: int) -> DataFrame:
    """Pairs of the cases that have exactly ``k`` controls."""
    paired = pairs.where(F.col(case).isNotNull())
    full = paired.groupBy(case).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == k)
    return paired.join(full.select(case), case, "left_semi")


def assign_group(pairs: DataFrame, case: str, out: str = "group_id") -> DataFrame:
    """Number the matched sets 1.. in case order (a dense rank of the distinct cases)."""
    return pairs.join(dense_ids(pairs, case, out), case)


def stack_members(
    pairs: DataFrame,
    case: str,
    control: str,
    shared: Sequence[str],
    person: str = "person",
    label: str = "label",
) -> DataFrame:
    """One row per case and per control; controls inherit the case's shared columns."""
    cases = (
        pairs.select(F.col(case).alias(person), *shared).distinct().withColumn(label, F.lit(1))
    )
    controls = pairs.select(F.col(control).alias(person), *shared).withColumn(label, F.lit(0))
    return cases.unionByName(controls)


def cohort_checks(
    pairs: DataFrame,
    members: DataFrame,
    features: DataFrame,
    outcome: DataFrame,
    case: str,
    control: str,
    person: str,
    code: str,
    k: int,
) -> DataFrame:
    """Violations of what every finished cohort must satisfy; all counts should be 0."""
    sizes = pairs.groupBy(case).agg(F.count(F.lit(1)).alias("n"))
    reused = pairs.groupBy(control).agg(F.count(F.lit(1)).alias("n"))
    repeated = members.groupBy(person).agg(F.count(F.lit(1)).alias("n"))
    incomplete_rows = pairs.select(F.exists(F.array(*[F.col(c).isNull() for c in pairs.columns]), lambda x: x).alias("x"))
    without = members.select(person).join(features.select(person).distinct(), person, "left_anti")
    leaked = features.select(code).distinct().join(outcome.select(code).distinct(), code, "left_semi")
    checks = {
        "sets of the wrong size": sizes.agg(F.count_if(F.col("n") != k).alias("n")),
        "controls used twice": reused.agg(F.count_if(F.col("n") > 1).alias("n")),
        "members listed twice": repeated.agg(F.count_if(F.col("n") > 1).alias("n")),
        "matched rows with a NULL": incomplete_rows.agg(F.count_if("x").alias("n")),
        "members without a feature row": without.agg(F.count(F.lit(1)).alias("n")),
        "outcome codes among the features": leaked.agg(F.count(F.lit(1)).alias("n")),
    }
    out = None
    for name, counted in checks.items():
        row = counted.select(F.lit(name).alias("check"), F.col("n").alias("n_violations"))
        out = row if out is None else out.unionByName(row)
    return out
