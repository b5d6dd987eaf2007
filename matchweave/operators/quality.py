"""Checks and repairs for raw tables.

Each check is one pass over the table. Repairs follow DELETE / UPDATE semantics: a row is
touched only where the predicate is TRUE, so rows where it is NULL stay as they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchweave.functions.exprs import is_true
from matchweave.functions.ordering import neighbour, rank_in_group


def _unpivot(row: DataFrame, label: str, names: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One wide row of ``<measure>__<i>`` columns -> one row per name."""
    entries = F.array(
        *[
            F.struct(F.lit(n).alias(label), *[F.col(f"{m}__{i}").alias(m) for m in measures])
            for i, n in enumerate(names)
        ]
    )
    return row.select(F.inline(entries))


def cutdown(df: DataFrame, columns: Mapping[str, str | Column]) -> DataFrame:
    """Keep and name the listed columns (output -> source); the scan reads only those."""
    return df.select(
        *[(F.col(s) if isinstance(s, str) else s).alias(out) for out, s in columns.items()]
    )


def drop_where(df: DataFrame, predicate: Column) -> DataFrame:
    return df.where(~is_true(predicate))


def null_where(df: DataFrame, column: str, predicate: Column) -> DataFrame:
    kind = df.schema[column].dataType
    return df.withColumn(column, F.when(is_true(predicate), F.lit(None).cast(kind)).otherwise(F.col(column)))


def zero_to_null(df: DataFrame, column: str) -> DataFrame:
    return null_where(df, column, F.col(column) == 0)


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, non-null rows and null rows per column."""
    aggs = []
    for i, c in enumerate(columns):
        aggs += [
            F.count(F.lit(1)).alias(f"n_rows__{i}"),
            F.count(F.col(c)).alias(f"n_present__{i}"),
            F.count_if(F.col(c).isNull()).alias(f"n_null__{i}"),
        ]
    return _unpivot(df.agg(*aggs), "column_name", columns, ["n_rows", "n_present", "n_null"])


def range_violations(df: DataFrame, ranges: Mapping[str, tuple]) -> DataFrame:
    """Rows below and above the allowed range, per rule (either bound may be None)."""
    aggs = []
    for i, (c, (lo, hi)) in enumerate(ranges.items()):
        below = F.lit(False) if lo is None else F.col(c) < F.lit(lo)
        above = F.lit(False) if hi is None else F.col(c) > F.lit(hi)
        aggs += [F.count_if(below).alias(f"n_below__{i}"), F.count_if(above).alias(f"n_above__{i}")]
    return _unpivot(df.agg(*aggs), "column_name", list(ranges), ["n_below", "n_above"])


def duplicate_keys(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Keys in which ``column`` repeats a value."""
    counts = df.groupBy(*keys).agg(
        F.count(column).alias("n_values"), F.count_distinct(F.col(column)).alias("n_distinct")
    )
    return counts.where(F.col("n_values") != F.col("n_distinct"))


def duplicate_sequence(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], split: Sequence[Column], out: str = "seq"
) -> DataFrame:
    """Second and later rows of each key, numbered for inspection."""
    return rank_in_group(df, keys, order, split, out).where(F.col(out) > 1)


def date_order_violations(df: DataFrame, earlier: str, later: str) -> DataFrame:
    """Rows whose ``later`` date lies before the ``earlier`` one."""
    return df.where(F.col(later) < F.col(earlier))


def overlaps(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    tie_break: Sequence[str],
    inclusive: bool = True,
) -> DataFrame:
    """Rows that start before (or, if inclusive, on) the end of the previous row of their key.

    Rows with a NULL key belong to nobody and overlap nothing.
    """
    near = neighbour(df, keys, [start, *tie_break], [end], "previous_", -1)
    previous = F.col(f"previous_{end}")
    return near.where(F.col(start) <= previous if inclusive else F.col(start) < previous)


def sequence_overlaps(
    df: DataFrame,
    keys: Sequence[str],
    sequence: str,
    start: str,
    end: str,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Rows whose successor by sequence number starts before they end."""
    near = neighbour(df, keys, [sequence, start, *tie_break], [sequence, start], "next_", 1)
    return near.where((F.col(f"next_{sequence}") > F.col(sequence)) & (F.col(f"next_{start}") < F.col(end)))


def inconsistent_within(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Keys in which a supposedly constant column takes more than one value; NULL is no key."""
    known = df.where(F.forall(F.array(*[F.col(k).isNotNull() for k in keys]), lambda x: x))
    counts = known.groupBy(*keys).agg(F.count_distinct(F.col(column)).alias("n_distinct"))
    return counts.where(F.col("n_distinct") > 1)


def attrition(df: DataFrame, person: str, steps: Mapping[str, Column]) -> DataFrame:
    """Rows and persons left at the start and after each exclusion, in one shuffle.

    ``steps`` maps a step name to the predicate whose TRUE rows it deletes.
    """
    names = ["start", *steps]
    kept = F.lit(True)
    flags = [kept]
    for predicate in steps.values():
        kept = kept & ~is_true(predicate)
        flags.append(kept)
    per_person = df.groupBy(person).agg(
        *[F.count_if(flag).alias(f"n__{i}") for i, flag in enumerate(flags)]
    )
    totals = per_person.agg(
        *[F.coalesce(F.sum(f"n__{i}"), F.lit(0)).alias(f"n_rows__{i}") for i in range(len(names))],
        *[
            F.count_if((F.col(f"n__{i}") > 0) & F.col(person).isNotNull()).alias(f"n_persons__{i}")
            for i in range(len(names))
        ],
        *[F.lit(i).alias(f"step__{i}") for i in range(len(names))],
    )
    return _unpivot(totals, "step_name", names, ["step", "n_rows", "n_persons"])


def optout_list(df: DataFrame, flag: str, key: str) -> DataFrame:
    """Distinct persons with the flag set."""
    return df.where(F.col(flag).isNotNull() & F.col(key).isNotNull()).select(key).distinct()
