"""Code frequencies and look-back features of matched members."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchweave.functions.exprs import days_approx
from matchweave.functions.ordering import group_median
from matchweave.sources.store import broadcast_if_small, is_small


def frequent_codes(
    cases: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    code: str,
    index_date: str,
    event_date: str,
    gap_days: int,
    k: int,
    exclude: Sequence = (),
    keep: int | None = None,
    min_count: int | None = None,
    variant: str = "day_minus_month",
) -> DataFrame:
    """The ``k`` codes most often recorded for cases more than ``gap_days`` before their index date.

    Unwanted codes are taken out after the top ``k``, as is the final cut to ``keep``
    codes or to codes counted at least ``min_count`` times.
    """
    slim = events.select(*keys, code, event_date)
    linked = slim.join(broadcast_if_small(cases.select(*keys, index_date)), list(keys))
    early = linked.where(days_approx(F.col(index_date), F.col(event_date), variant) > gap_days)
    top = (
        early.groupBy(code)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc_nulls_last(code))
        .limit(k)
    )
    if exclude:
        top = top.where(F.col(code).isNull() | ~F.col(code).isin(*exclude))
    if min_count is not None:
        top = top.where(F.col("n") >= min_count)
    if keep is not None:
        top = top.orderBy(F.desc("n"), F.asc_nulls_last(code)).limit(keep)
    return top


def leak_check(features: DataFrame, outcome: DataFrame, code: str) -> DataFrame:
    """Selected feature codes that are outcome codes (an empty result is the expected one)."""
    return features.select(code).distinct().join(outcome.select(code).distinct(), code, "left_semi")


def describe_codes(codes: DataFrame, dictionary: DataFrame, code: str) -> DataFrame:
    """Selected codes with their dictionary entry."""
    return dictionary.join(broadcast_if_small(codes), code)


def lookback_features(
    members: DataFrame,
    events: DataFrame,
    codes: DataFrame,
    person: str,
    code: str,
    index_date: str,
    event_date: str,
    value: str,
    gap_days: int,
    count_mode: str = "reference",
    variant: str = "day",
) -> DataFrame:
    """Mean value and event count per member and code, at least ``gap_days`` before the index date.

    ``reference`` counts the events from the first one of the earliest day on: the other
    events of that day are not counted, n - t + 1 for t events on the earliest day of n.
    ``all`` counts every event. Events are first summed per person, code and day, so the
    row-level log is shuffled once and already reduced, whatever one person or code holds.
    """
    if count_mode not in ("reference", "all"):
        raise ValueError(f"unknown count mode {count_mode!r}")
    listed = events.join(broadcast_if_small(codes.select(code).distinct()), code, "left_semi")
    small = is_small(members)
    if small:
        listed = listed.join(F.broadcast(members.select(person)), person, "left_semi")
    daily = listed.groupBy(person, code, event_date).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(value).alias("__sum"), F.count(value).alias("__present")
    )
    linked = daily.join(F.broadcast(members) if small else members, person)
    old = linked.where(days_approx(F.col(index_date), F.col(event_date), variant) >= gap_days)
    kept = [c for c in members.columns if c != index_date]
    n_all = F.sum("__n")
    n_first_day = F.min_by("__n", event_date)
    count = n_all if count_mode == "all" else n_all - n_first_day + 1
    return old.groupBy(*kept, code).agg(
        F.try_divide(F.sum("__sum"), F.sum("__present")).alias("mean_value"),
        count.cast("long").alias("n_events"),
    )


def backfill(
    features: DataFrame, members: DataFrame, person: str, code: str, sentinel: str = "Z"
) -> DataFrame:
    """Add one row, with a sentinel code, for each member that has no feature row."""
    missing = members.join(features.select(person).distinct(), person, "left_anti")
    filled = missing.withColumns(
        {
            code: F.lit(sentinel),
            "mean_value": F.lit(None).cast("double"),
            "n_events": F.lit(0).cast("long"),
        }
    )
    return features.unionByName(filled.select(*features.columns))


def rebalance(features: DataFrame, group: str, label: str, person: str, n: int = 2) -> DataFrame:
    """Feature rows of the first ``n`` members of each set: the case, then the smallest ids."""
    members = features.select(group, label, person).distinct()
    order = Window.partitionBy(group).orderBy(F.desc(label), F.asc(person))
    first = members.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= n)
    return features.join(first.select(group, person), [group, person], "left_semi")


def feature_contrast(
    features: DataFrame, code: str, label: str, measures: Sequence[str], codes: Sequence | None = None
) -> DataFrame:
    """Mean and exact median of each measure by code and class; all medians in one pass."""
    chosen = features if codes is None else features.where(F.col(code).isin(*codes))
    out = chosen.groupBy(code, label).agg(*[F.avg(m).alias(f"mean_{m}") for m in measures])
    pairs = F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("v")) for m in measures])
    long = chosen.select(code, label, F.explode(pairs).alias("__pair")).select(code, label, "__pair.m", "__pair.v")
    middle = group_median(long.withColumnsRenamed({"m": "__measure", "v": "__value"}), [code, label, "__measure"], "__value", "__median")
    medians = middle.groupBy(code, label).agg(
        *[F.max(F.when(F.col("__measure") == m, F.col("__median"))).alias(f"median_{m}") for m in measures]
    )
    return out.join(medians, [code, label], "left")
