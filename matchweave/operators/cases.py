"""Code lists, index events, eligibility and linkage of case sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchweave.operators.quality import drop_where
from matchweave.sources.store import broadcast_if_small, stage


def code_list(
    dictionary: DataFrame,
    code: str,
    description: str,
    patterns: Sequence[str],
    exclude: Sequence[str] = (),
    drop: Column | None = None,
) -> DataFrame:
    """Dictionary rows whose description matches any LIKE pattern, less unwanted codes."""
    wanted = F.lit(False)
    for pattern in patterns:
        wanted = wanted | F.col(description).like(pattern)
    found = dictionary.where(wanted)
    if exclude:
        found = found.where(~F.col(code).isin(*exclude))
    return found if drop is None else drop_where(found, drop)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key; each map task passes on at most one row per key."""
    first = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return df.withColumn("__rn", F.row_number().over(first)).where(F.col("__rn") == 1).drop("__rn")


def with_codes(events: DataFrame, codes: DataFrame, code: str) -> DataFrame:
    """Events whose code is on the list. A long list joins by shuffle, a short one is broadcast."""
    return events.join(broadcast_if_small(codes.select(code).distinct()), code, "left_semi")


def index_event(
    events: DataFrame, codes: DataFrame, person: str, code: str, order: Sequence[str]
) -> DataFrame:
    """First event ever on the code list, per person. Study windows are applied afterwards."""
    listed = with_codes(events, codes, code).where(F.col(person).isNotNull())
    return first_per_key(listed, [person], order)


def index_event_hier(
    diagnoses: DataFrame,
    episodes: DataFrame,
    spells: DataFrame,
    codes: DataFrame,
    person: str,
    code: str,
    spell_keys: Sequence[str],
    episode_keys: Sequence[str],
    order: Sequence[str],
) -> DataFrame:
    """Index event through diagnosis -> episode -> spell.

    The code list cuts the largest table first. What is left of it is written, so that a
    short result meets episodes and spells without shuffling them.
    """
    listed = stage(with_codes(diagnoses, codes, code), "listed")
    linked = episodes.join(broadcast_if_small(listed), list(episode_keys))
    linked = spells.join(broadcast_if_small(stage(linked, "linked")), list(spell_keys))
    return first_per_key(linked.where(F.col(person).isNotNull()), [person], order)


def eligible(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Delete the rows that break a rule; a rule that is NULL for a row leaves it in."""
    broken = F.lit(False)
    for predicate in rules.values():
        broken = broken | F.coalesce(predicate, F.lit(False))
    return df.where(~broken)


def reconcile(
    primary: DataFrame,
    secondary: DataFrame,
    person: str,
    prefer: Sequence[str] = (),
    earliest: Sequence[str] = (),
    keep: Mapping[str, str] | None = None,
    keep_secondary: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per person from two case sources.

    ``prefer`` columns come from the primary source unless NULL there; ``earliest``
    columns take the smaller of the two, each column on its own. ``keep`` and
    ``keep_secondary`` pass columns of one source through under an output name.
    """
    a, b = primary.alias("a"), secondary.alias("b")
    linked = a.join(b, F.col(f"a.{person}") == F.col(f"b.{person}"), "full")
    return linked.select(
        F.coalesce(F.col(f"b.{person}"), F.col(f"a.{person}")).alias(person),
        *[F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in prefer],
        *[F.least(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in earliest],
        *[F.col(f"a.{c}").alias(out) for c, out in (keep or {}).items()],
        *[F.col(f"b.{c}").alias(out) for c, out in (keep_secondary or {}).items()],
    )


def asof_attribute(
    df: DataFrame, history: DataFrame, person: str, at: str, start: str, end: str, value: str, out: str
) -> DataFrame:
    """Value valid at a date (both ends inclusive); rows without one are dropped.

    Dropping them makes this an inner join, so a person with a very long history can be
    split at run time, which an outer join would not allow.
    """
    h = history.where(F.col(value).isNotNull()).select(
        F.col(person).alias("__p"),
        F.col(start).alias("__start"),
        F.col(end).alias("__end"),
        F.col(value).alias(out),
    )
    valid = (F.col(person) == F.col("__p")) & (F.col(at) >= F.col("__start")) & (F.col(at) <= F.col("__end"))
    return h.join(broadcast_if_small(df), valid).select(*df.columns, out)


def covered_throughout(history: DataFrame, person: str, start: str, end: str, first_day: str, last_day: str) -> DataFrame:
    """Persons whose intervals together cover every day from the first to the last.

    Intervals (both ends inclusive) may touch, overlap or repeat; one without a start or end
    covers nothing. Starts are moved up to the first day, so a person is left with one row for
    each day of the window at most, however long the history.
    """
    low, high = (F.lit(d).cast("date") for d in (first_day, last_day))
    known = history.where(F.col(person).isNotNull() & (F.col(start) <= high) & (F.col(end) >= low) & (F.col(start) <= F.col(end)))
    days = known.groupBy(person, F.greatest(F.col(start), low).alias("__start")).agg(F.max(end).alias("__end"))
    before = Window.partitionBy(person).orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("__end").over(before), F.date_sub(low, 1))
    return (
        days.withColumn("__gap", F.col("__start") > F.date_add(reached, 1))
        .groupBy(person)
        .agg(F.bool_or("__gap").alias("__gap"), F.max("__end").alias("__end"))
        .where(~F.col("__gap") & (F.col("__end") >= high))
        .select(person)
    )


def deaths_before(cases: DataFrame, deaths: DataFrame, person: str, died: str, year: int) -> DataFrame:
    """Cases whose recorded death lies before a year (an empty result is the expected one)."""
    early = deaths.where(F.col(died) < F.lit(f"{year}-01-01").cast("date")).select(person, died)
    return early.join(broadcast_if_small(cases), person)
