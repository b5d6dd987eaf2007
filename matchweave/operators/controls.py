"""Control pool: stratum sizes, capped random draw and exclusions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchweave.functions.exprs import hash_bucket, hash_order, is_true
from matchweave.functions.ordering import rank_in_group
from matchweave.sources.store import broadcast_if_small, stage


def stratum_sizes(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    return df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))


def control_pool(
    candidates: DataFrame, person: str, strata: Sequence[str], cap: int, seed: int
) -> DataFrame:
    """At most ``cap`` persons per stratum, drawn by a seeded hash order.

    ``candidates`` has one row per person. Hash buckets keep a large stratum out of any
    one task, and buckets beyond the cap are left out before the sort.
    """
    keyed = candidates.withColumn("__order", hash_order(F.col(person), seed))
    drawn = rank_in_group(
        keyed, strata, ["__order", person], [hash_bucket(F.col("__order"))], "draw", limit=cap
    )
    return drawn.drop("__order")


def persons_with(events: DataFrame, *keys: str) -> DataFrame:
    """Distinct persons of a record source; duplicates collapse before the shuffle."""
    return events.select(*keys).na.drop().distinct()


def persons_by_list(
    events: DataFrame, lists: Mapping[str, DataFrame], code: str, keys: Sequence[str]
) -> dict[str, DataFrame]:
    """Persons with an event on each of several code lists, from one pass over the log."""
    tagged = None
    for name, codes in lists.items():
        part = codes.select(code).distinct().withColumn("__list", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part)
    found = events.select(*keys, code).join(broadcast_if_small(tagged), code)
    persons = stage(persons_with(found, *keys, "__list"), "persons_by_list")
    return {name: persons.where(F.col("__list") == name).select(*keys) for name in lists}


def exclude(pool: DataFrame, sources: Mapping[str, DataFrame]) -> DataFrame:
    """Delete the rows listed by any source; a source's columns are the key it is joined on."""
    left = pool
    for source in sources.values():
        left = left.join(source, source.columns, "left_anti")
    return left


def exclusion_ledger(pool: DataFrame, sources: Mapping[str, DataFrame]) -> DataFrame:
    """Rows found by each source among those still in the pool, and rows left after it."""
    flagged = pool
    for i, source in enumerate(sources.values()):
        hits = source.distinct().withColumn(f"__hit{i}", F.lit(True))
        flagged = flagged.join(hits, source.columns, "left")
    gone = F.lit(False)
    aggs, entries = [], []
    for i, name in enumerate(sources):
        hit = is_true(F.col(f"__hit{i}"))
        aggs.append(F.count_if(hit & ~gone).alias(f"removed{i}"))
        gone = gone | hit
        aggs.append(F.count_if(~gone).alias(f"left{i}"))
        entries.append(
            F.struct(
                F.lit(i + 1).alias("step"),
                F.lit(name).alias("source"),
                F.col(f"removed{i}").alias("n_removed"),
                F.col(f"left{i}").alias("n_left"),
            )
        )
    return flagged.agg(*aggs).select(F.inline(F.array(*entries)))
