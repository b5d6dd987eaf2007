"""Long features to a model-ready wide table: pivot, missing values, group split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchweave.functions.exprs import hash_bucket, hash_order, safe_name
from matchweave.functions.ordering import group_median, rank_in_group
from matchweave.sources.store import broadcast_if_small, stage

# Rows of a training table in one partition, about.
ROWS_PER_PARTITION = 50_000
# A wide table is for a chosen list of codes, not for a whole dictionary.
MAX_CODES = 5_000
COUNT_PREFIX = "n_"
VALUE_PREFIX = "val_"


def column_names(codes: Sequence[str]) -> dict[str, str]:
    """Code -> the part of a column name it is written as.

    Names differ also without regard to case, as Spark compares them: of codes that would
    share a name, the later in order get a number.
    """
    if len(codes) > MAX_CODES:
        raise ValueError(f"{len(codes)} codes are too many for columns")
    names, taken = {}, set()
    for c in sorted(codes):
        name, n = safe_name(c), 2
        while name.lower() in taken:
            name, n = f"{safe_name(c)}_{n}", n + 1
        taken.add(name.lower())
        names[c] = name
    return names


def code_list(codes: DataFrame, code: str, limit: int = MAX_CODES) -> list[str]:
    """The distinct codes of a table in their order, without NULL; not more than ``limit`` reach the driver."""
    found = codes.select(code).where(F.col(code).isNotNull()).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} codes are too many for columns; take the top_codes, and the rest from outside_codes")
    return sorted(r[0] for r in found)


def top_codes(features: DataFrame, code: str, limit: int = MAX_CODES, sentinel: str = "Z") -> list[str]:
    """The ``limit`` codes with most feature rows, most first, ties by code; all of them if there are fewer.

    Codes are counted and cut in Spark, so a dictionary of any size will do.
    """
    counts = features.where(F.col(code) != sentinel).groupBy(code).agg(F.count(F.lit(1)).alias("__n"))
    return [r[0] for r in counts.orderBy(F.desc("__n"), F.asc(code)).limit(limit).collect()]


def outside_codes(features: DataFrame, code: str, codes: Sequence[str], sentinel: str = "Z") -> DataFrame:
    """Feature rows of codes that have no column, in long form: with the pivot, nothing is lost."""
    rest = features.where(F.col(code) != sentinel)
    return rest.where(~F.col(code).isin(*codes)) if codes else rest


def pivot_wide(
    features: DataFrame,
    ids: Sequence[str],
    code: str,
    codes: Sequence[str],
    count: str = "n_events",
    value: str = "mean_value",
    names: dict[str, str] | None = None,
) -> DataFrame:
    """One row per member: an event count (0 if absent) and a mean value per code.

    Both measures come from one pivot, over rows already brought together by member, so
    the long table is shuffled once. Codes outside ``codes``, the sentinel of members
    without features among them, keep their member but add no column; `outside_codes` gives
    their rows. ``names`` are the codes' parts of column names, else made from the codes.
    """
    names = column_names(codes) if names is None else names
    number = {c: i for i, c in enumerate(codes)}
    # Codes become numbers first, so that column names cannot clash inside the pivot.
    numbered = F.create_map(*[F.lit(x) for c, i in number.items() for x in (c, i)]) if codes else F.lit(None)
    pivoted = (
        features.withColumn("__number", numbered[F.col(code)] if codes else numbered.cast("int"))
        .repartition(*ids)
        .groupBy(*ids)
        .pivot("__number", list(number.values()))
        .agg(F.first(count).alias("c"), F.first(value).alias("v"))
    )
    return pivoted.select(
        *ids,
        *[F.coalesce(F.col(f"`{i}_c`"), F.lit(0).cast("long")).alias(COUNT_PREFIX + names[c]) for c, i in number.items()],
        *[F.col(f"`{i}_v`").alias(VALUE_PREFIX + names[c]) for c, i in number.items()],
    )


def value_columns(wide: DataFrame) -> list[str]:
    return [c for c in wide.columns if c.startswith(VALUE_PREFIX)]


def feature_columns(wide: DataFrame) -> list[str]:
    return [c for c in wide.columns if c.startswith((COUNT_PREFIX, VALUE_PREFIX))]


def unpivot_values(wide: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Wide measure columns back to (ids, column_name, value) rows."""
    return wide.unpivot(list(ids), list(columns), "column_name", "value")


def missingness(wide: DataFrame, columns: Sequence[str], by: str, max_missing: float = 0.5) -> DataFrame:
    """Rows and missing values per class and column, and whether the class keeps the column."""
    counts = wide.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    long = counts.unpivot([by, "n_rows"], list(columns), "column_name", "n_missing")
    return long.withColumn("kept", F.col("n_missing") < F.col("n_rows") * F.lit(max_missing))


def _value_rows(features: DataFrame, by: str, code: str, codes: Sequence[str], value: str) -> DataFrame:
    """Class, name of the wide table's column, and value of the long rows that have one."""
    named = [F.lit(x) for c, n in column_names(codes).items() for x in (c, VALUE_PREFIX + n)]
    name = F.create_map(*named)[F.col(code)] if named else F.lit(None).cast("string")
    listed = features.where((F.col(code).isin(*codes) if codes else F.lit(False)) & F.col(value).isNotNull())
    return listed.select(by, name.alias("column_name"), F.col(value).alias("value"))


def missingness_of_long(
    features: DataFrame,
    members: DataFrame,
    by: str,
    code: str,
    codes: Sequence[str],
    value: str = "mean_value",
    max_missing: float = 0.5,
) -> DataFrame:
    """`missingness` of the value columns, from the long rows and the members' class sizes alone.

    A member's value is missing where it has no row, or one without a value, so the counts of the
    wide table follow without it. ``members`` has one row for each of the wide table.
    """
    columns = [VALUE_PREFIX + n for n in column_names(codes).values()]
    sizes = members.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"))
    grid = sizes.select(by, "n_rows", F.explode(F.array(*[F.lit(c) for c in columns]).cast("array<string>")).alias("column_name"))
    present = _value_rows(features, by, code, codes, value).groupBy(by, "column_name").agg(F.count(F.lit(1)).alias("__present"))
    missing = F.col("n_rows") - F.coalesce(F.col("__present"), F.lit(0))
    same = [grid[by].eqNullSafe(present[by]), grid["column_name"] == present["column_name"]]
    long = grid.join(present, same, "left").select(grid[by], "n_rows", grid["column_name"], missing.alias("n_missing"))
    return long.withColumn("kept", F.col("n_missing") < F.col("n_rows") * F.lit(max_missing))


def medians_of_long(
    features: DataFrame, by: str, code: str, codes: Sequence[str], value: str = "mean_value", profile: DataFrame | None = None
) -> DataFrame:
    """Exact median per class and value column, as `impute_median` takes it, without pivot and unpivot.

    With a ``profile`` (`missingness`), only of the columns that a class keeps; what `drop_sparse`
    blanked out stays missing.
    """
    rows = _value_rows(features, by, code, codes, value)
    if profile is not None:
        kept = profile.where("kept").select(F.col(by).alias("__by"), F.col("column_name").alias("__column"))
        same = rows[by].eqNullSafe(kept["__by"]) & (rows["column_name"] == kept["__column"])
        rows = rows.join(broadcast_if_small(kept), same, "left_semi")
    return group_median(rows, [by, "column_name"], "value", "median")


def kept_columns(profile: DataFrame, by: str) -> dict:
    """Class -> columns it keeps; at most one row per class and column reaches the driver."""
    kept: dict = {}
    for row in profile.select(by, "column_name", "kept").collect():
        columns = kept.setdefault(row[by], [])
        if row["kept"]:
            columns.append(row["column_name"])
    return kept


def drop_all_missing(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop the columns that have no value in any row."""
    present = wide.agg(*[F.count(F.col(c)).alias(c) for c in columns]).first()
    return wide.drop(*[c for c in columns if present[c] == 0])


def drop_sparse(
    wide: DataFrame,
    columns: Sequence[str],
    by: str,
    max_missing: float = 0.5,
    keep: str = "any",
    profile: DataFrame | None = None,
) -> DataFrame:
    """Per class, blank out the columns too often missing there.

    ``keep="any"`` leaves a column that some class keeps, missing throughout the others;
    ``keep="all"`` leaves only the columns that every class keeps, which a model needs.
    ``profile`` is the `missingness` where it is known already.
    """
    if not columns:
        return wide
    kept = kept_columns(missingness(wide, columns, by, max_missing) if profile is None else profile, by)
    changes, dropped = {}, []
    for c in columns:
        classes = [k for k, cs in kept.items() if c in cs]
        if not classes or (keep == "all" and len(classes) < len(kept)):
            dropped.append(c)
        elif len(classes) < len(kept):
            changes[c] = F.when(F.col(by).isin(*classes), F.col(c))
    return (wide.withColumns(changes) if changes else wide).drop(*dropped)


def impute_median(
    wide: DataFrame,
    columns: Sequence[str],
    by: str | None = None,
    fit_on: DataFrame | None = None,
    medians: DataFrame | None = None,
) -> DataFrame:
    """Fill missing values with the exact median of their column.

    ``by="label"`` takes the median within each class, which lets a feature carry its
    label; ``by=None`` with ``fit_on=<train part>`` avoids that. A column with no value
    in a class stays missing there. ``medians`` (class, column_name, median) are those of
    the class where they are known already, as from `medians_of_long`.
    """
    if not columns:
        return wide
    source = wide if fit_on is None else fit_on
    keys = [by] if by else []
    if medians is None:
        long = unpivot_values(source.select(*keys, *columns), keys, columns)
        medians = group_median(long, [*keys, "column_name"], "value", "median")
    medians = stage(medians, "medians")
    if by is None:
        # One median per column: small enough to become constants of the plan.
        found = {r["column_name"]: r["median"] for r in medians.collect()}
        return wide.withColumns(
            {c: F.coalesce(F.col(c), F.lit(found.get(c)).cast("double")) for c in columns}
        )
    filler = medians.groupBy(by).pivot("column_name", list(columns)).agg(F.first("median"))
    filler = filler.select(by, *[F.col(c).alias(f"__m_{c}") for c in columns])
    joined = wide.join(broadcast_if_small(filler), by, "left")
    filled = {c: F.coalesce(F.col(c), F.col(f"__m_{c}")) for c in columns}
    return joined.withColumns(filled).select(*wide.columns)


def group_split(groups: DataFrame, group: str, fraction: float, seed: int, out: str = "part") -> DataFrame:
    """Distinct groups labelled train / test with exactly floor(fraction * n) in train.

    Groups are drawn by a seeded hash order, so all members of a set fall on one side.
    """
    ids = groups.select(group).where(F.col(group).isNotNull()).distinct()
    total = ids.agg(F.floor(F.count(F.lit(1)) * F.lit(fraction)).alias("__train"))
    keyed = ids.withColumn("__order", hash_order(F.col(group), seed))
    ranked = rank_in_group(keyed, [], ["__order", group], [hash_bucket(F.col("__order"))], "__rank")
    bound = total.scalar()
    return ranked.select(
        group, F.when(F.col("__rank") <= bound, F.lit("train")).otherwise(F.lit("test")).alias(out)
    )


def training_partitions(members: DataFrame) -> int:
    """Partitions for a training table: by its rows, and one per core at least."""
    cores = members.sparkSession.sparkContext.defaultParallelism
    return max(cores, members.count() // ROWS_PER_PARTITION + 1)


def split_parts(wide: DataFrame, part: str = "part") -> tuple[DataFrame, DataFrame]:
    """Rows of the train groups and of the test groups."""
    train, test = (wide.where(F.col(part) == p).drop(part) for p in ("train", "test"))
    return train, test
