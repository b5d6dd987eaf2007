"""Ranks, neighbours, running totals and medians that never put a whole group in one task.

A plain window sorts each of its groups in a single task. Strata, codes and persons can
hold a large share of all rows, so these helpers cut a group along its own order into
sub-groups, work inside the sub-groups, and carry small per-sub-group totals across.
Where the cut falls changes the balance of the tasks only, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StructField, StructType, TimestampType

from matchweave.sources.store import stage

# Number of sub-groups of a global order, and values sampled per sub-group to place the cuts.
BUCKETS = 2048
SAMPLE_PER_BUCKET = 8


def _position(df: DataFrame, column: str) -> Column:
    """The order column as a double, without ever putting two values out of order."""
    kind = df.schema[column].dataType
    if isinstance(kind, DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, (NumericType, TimestampType)):
        return F.col(column).cast("double")
    raise TypeError(f"cannot order {column} of type {kind.simpleString()}; number the values first")


def order_bounds(df: DataFrame, column: str) -> list[float]:
    """At most ``BUCKETS - 1`` cut points that split the distinct values about evenly.

    Values with the smallest hashes are a uniform sample of the distinct values, and
    a top-k by hash brings only that fixed number of values to the driver. An order
    with fewer distinct values than the sample holds needs no cut.
    """
    wanted = BUCKETS * SAMPLE_PER_BUCKET
    distinct = df.select(_position(df, column).alias("p")).where(F.col("p").isNotNull()).distinct()
    sample = distinct.orderBy(F.xxhash64("p"), "p").limit(wanted).collect()
    if len(sample) < wanted:
        return []
    values = sorted(row[0] for row in sample)
    return values[SAMPLE_PER_BUCKET::SAMPLE_PER_BUCKET]


def with_cut(df: DataFrame, column: str, bounds: Sequence[float], out: str = "__cut") -> DataFrame:
    """Number of the bucket a value falls in, increasing with the value."""
    if not bounds:
        return df.withColumn(out, F.lit(0.0))
    splits = [float("-inf"), *bounds, float("inf")]
    placed = df.withColumn("__position", _position(df, column))
    cutter = Bucketizer(splits=splits, inputCol="__position", outputCol=out, handleInvalid="keep")
    return cutter.transform(placed).drop("__position")


def rank_in_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    split: Sequence[Column],
    out: str,
    limit: int | None = None,
) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` with groups cut by ``split``.

    ``split`` columns must not decrease along ``order``, nulls last in both. With ``limit``
    only ranks up to it are returned, and sub-groups that start beyond it are left out before
    any sort. Rows with the same NULL key are a group like any other.
    """
    keys, order = list(keys), list(order)
    cuts = [f"__cut{i}" for i in range(len(split))]
    tagged = df.select("*", *[c.alias(n) for c, n in zip(split, cuts)])
    by_cut = [F.col(c).asc_nulls_last() for c in cuts]
    before = Window.partitionBy(*keys).orderBy(*by_cut).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys, *cuts)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*keys, *cuts, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
        .alias("offsets")
    )
    same = [F.col(f"rows.`{c}`").eqNullSafe(F.col(f"offsets.`{c}`")) for c in [*keys, *cuts]]
    inside = Window.partitionBy(*keys, *cuts).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    number = F.row_number().over(inside).alias("__rn")
    if limit is not None:
        tagged = tagged.alias("rows").join(offsets.where(F.col("__before") < limit), same)
        ranked = tagged.select("rows.*", "__before").select("*", number)
    else:
        ranked = tagged.select("*", number).alias("rows").join(offsets, same).select("rows.*", "__before")
    ranked = ranked.withColumn(out, (F.col("__before") + F.col("__rn")).cast("long"))
    if limit is not None:
        ranked = ranked.where(F.col(out) <= limit)
    return ranked.select(*df.columns, out)


def range_cut(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The table written with ``__cut``, which numbers ranges of its order, nulls last.

    Works for any orderable types. The bounds are sampled, and written with the rows, so
    that every later pass sees the same cuts.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *[F.col(c).asc_nulls_last() for c in order])
    return stage(ranged.withColumn("__cut", F.spark_partition_id()), "ranges")


def running_totals(
    df: DataFrame, order: str, totals: dict[str, str], descending: bool = False
) -> DataFrame:
    """Running sum of each column in ``totals`` (source -> output) along a global order.

    ``df`` has one row per value of ``order``; it is written once, as three passes follow.
    Also adds ``<output>_total``, the full sum. The table of sub-group sums has at most ``BUCKETS`` rows, so it is broadcast and its
    prefix sums are taken in one small window.
    """
    df = stage(df, "ordered")
    tagged = with_cut(df, order, order_bounds(df, order))

    def along(column: str) -> Column:
        return F.col(column).desc() if descending else F.col(column).asc()

    sums = tagged.groupBy("__cut").agg(*[F.sum(s).alias(f"__{o}") for s, o in totals.items()])
    before = (
        Window.partitionBy(F.lit(0)).orderBy(along("__cut")).rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy(F.lit(0))
    carried = sums.select(
        "__cut",
        *[F.coalesce(F.sum(f"__{o}").over(before), F.lit(0)).alias(f"__{o}_before") for o in totals.values()],
        *[F.sum(f"__{o}").over(whole).alias(f"{o}_total") for o in totals.values()],
    )
    inside = (
        Window.partitionBy("__cut")
        .orderBy(along(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        tagged.select("*", *[F.sum(s).over(inside).alias(f"__{o}_run") for s, o in totals.items()])
        .join(F.broadcast(carried), "__cut")
        .select(
            *df.columns,
            *[(F.col(f"__{o}_run") + F.col(f"__{o}_before")).alias(o) for o in totals.values()],
            *[f"{o}_total" for o in totals.values()],
        )
    )


def dense_ids(df: DataFrame, column: str, out: str) -> DataFrame:
    """Distinct values of a column of any orderable type, numbered 1.. in their order."""
    cut = range_cut(df.select(column).where(F.col(column).isNotNull()).distinct(), [column])
    before = Window.partitionBy(F.lit(0)).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range, and there are as many as shuffle partitions.
    offsets = (
        cut.groupBy("__cut")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__cut", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    inside = F.row_number().over(Window.partitionBy("__cut").orderBy(column))
    numbered = cut.withColumn("__rn", inside).join(F.broadcast(offsets), "__cut")
    return numbered.select(column, (F.col("__before") + F.col("__rn")).cast("long").alias(out))


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _struct(columns: Sequence[str]) -> Column:
    """Columns as one comparable value, nulls last in each."""
    return F.struct(*[p.alias(f"{x}{i}") for i, c in enumerate(columns) for x, p in (("n", F.col(c).isNull()), ("v", F.col(c)))])


def hot_bounds(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame | None:
    """Cuts through the order of each very frequent key: keys and ``__bounds``, rising; None if no key is.

    A sample of rows, by least hashes, has a fixed size for each shuffle partition, so it and the
    cuts stay small whatever the table holds. A key with half a partition's share of the sample is
    frequent; it is cut after as many sampled rows. Any orderable types will do.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    chosen = df.where(known).select(*keys, *order)
    every = SAMPLE_PER_BUCKET // 2
    sample = chosen.orderBy(F.xxhash64(*keys, *order)).limit(_parts(df) * SAMPLE_PER_BUCKET).toArrow()
    by_key: dict[tuple, list[dict]] = {}
    for row in sample.to_pylist():
        by_key.setdefault(tuple(row[k] for k in keys), []).append(row)
    rows = []
    for key, members in by_key.items():
        if len(members) >= every:
            members.sort(key=lambda r: [(True,) if r[c] is None else (False, r[c]) for c in order])
            rows += [(*key, *[r[c] for c in order]) for r in members[every::every]]
    if not rows:
        return None
    schema = StructType([StructField(f"b{i}", chosen.schema[c].dataType) for i, c in enumerate([*keys, *order])])
    table = df.sparkSession.createDataFrame(rows, schema)
    names = [f"b{i + len(keys)}" for i in range(len(order))]
    of_keys = table.groupBy(*[f"b{i}" for i in range(len(keys))]).agg(F.array_sort(F.collect_list(_struct(names))).alias("__bounds"))
    return of_keys.select(*[F.col(f"b{i}").alias(k) for i, k in enumerate(keys)], "__bounds")


def _cut_number(value: Column, bounds: str, most: int) -> Column:
    """How many of the rising bounds are not above a value, by binary search; 0 without bounds."""
    steps = [1 << i for i in reversed(range(most.bit_length()))]
    count = F.coalesce(F.size(bounds), F.lit(0))

    def step(low: Column, width: Column) -> Column:
        inside = low + width <= count
        return F.when(inside & (F.try_element_at(F.col(bounds), low + width) <= value), low + width).otherwise(low)

    return F.when(count > 0, F.aggregate(F.array(*[F.lit(w) for w in steps]), F.lit(0), step)).otherwise(F.lit(0))


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    prefix: str,
    step: int,
) -> DataFrame:
    """Values of the previous (``step=-1``) or next (``step=1``) row of the same key.

    Adds ``<prefix><value>`` columns, NULL at the end of a key and for rows with a NULL key,
    which are spread over all tasks. A very frequent key is cut along its order (`hot_bounds`)
    and its rows at the edge of a cut take theirs from the cut beyond it; those edges are as few
    as the cuts. Where no key is frequent there is nothing to cut, and one window is all.
    """
    keys = list(keys)
    fn, pick = (F.lag, F.max_by) if step < 0 else (F.lead, F.min_by)
    none = F.lit(False)
    for k in keys:
        none = none | F.col(k).isNull()
    spread = F.when(none, F.monotonically_increasing_id()).otherwise(F.lit(0).cast("long"))
    payload = F.struct(*[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    bounds = hot_bounds(df, keys, order)
    cut = df.withColumn("__spread", spread)
    if bounds is None:
        cut = cut.withColumn("__cut", F.lit(0))
    else:
        most = _parts(df) * 2
        placed = cut.join(F.broadcast(bounds), keys, "left")
        cut = placed.withColumn("__cut", _cut_number(_struct(order), "__bounds", most))
    inside = Window.partitionBy(*keys, "__cut", "__spread").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    near = cut.withColumn("__near", fn(payload).over(inside))
    if bounds is not None:
        # At most one row for each cut of the frequent keys.
        edges = cut.where(F.col("__bounds").isNotNull()).groupBy(*keys, "__cut").agg(pick(payload, _struct(order)).alias("__last"))
        along = Window.partitionBy(*keys).orderBy("__cut")
        edges = edges.select(*keys, "__cut", fn("__last").over(along).alias("__edge"))
        near = near.join(F.broadcast(edges), [*keys, "__cut"], "left").withColumn("__near", F.coalesce("__near", "__edge"))
    added = [F.when(~none, F.col(f"__near.v{i}")).alias(f"{prefix}{v}") for i, v in enumerate(values)]
    return near.select(*df.columns, *added)


def group_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact interpolating median per group; NULL values are ignored.

    Equal values are counted before the shuffle and the counts written once. Per-bucket
    counts then name the one or two buckets that hold the middle ranks, and only those
    buckets are sorted.
    """
    keys = list(keys)
    present = df.where(F.col(value).isNotNull())
    counted = stage(present.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n")), "counted")
    counted = with_cut(counted, value, order_bounds(counted, value))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        counted.groupBy(*keys, "__cut")
        .agg(F.sum("__n").alias("__size"))
        .withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0)))
        .withColumn("__total", F.sum("__size").over(whole))
        .withColumn("__lo", F.call_function("div", F.col("__total") + 1, F.lit(2)))
        .withColumn("__hi", F.call_function("div", F.col("__total") + 2, F.lit(2)))
    )
    middle = sizes.where(
        (F.col("__before") < F.col("__hi")) & (F.col("__before") + F.col("__size") >= F.col("__lo"))
    ).select(*keys, "__cut", "__before", "__lo", "__hi")
    inside = (
        Window.partitionBy(*keys, "__cut")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = (
        counted.join(middle, keys + ["__cut"])
        .withColumn("__last", F.col("__before") + F.sum("__n").over(inside))
        .withColumn("__first", F.col("__last") - F.col("__n") + 1)
    )

    def at(rank: str) -> Column:
        return F.max(F.when(F.col(rank).between(F.col("__first"), F.col("__last")), F.col(value)))

    return ranked.groupBy(*keys).agg(
        ((at("__lo").cast("double") + at("__hi").cast("double")) / 2).alias(out)
    )
