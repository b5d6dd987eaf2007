"""Mixing sources to target weights by dependent rounding of copy numbers.

Every source has a target number of words, so each of its documents should be copied
target / size times. Whole copies are given to all; the fractions left are rounded by the
pivotal method: two documents meet, one hands words to the other at random until one of
them is integral, the other goes on with what is left. The words of a source stay the same
in every step, so a source ends within half a document of its target.

Documents meet in groups of a bounded size, and each group leaves at most one fraction per
source for the next level, so a hot source is spread over many tasks. All steps are
DataFrame operations; the random choices are hashes of the ids, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchweave.functions.ordering import rank_in_group
from matchweave.llm.shared import WORD, group_count, hash_share, write_stage
from matchweave.sources.store import broadcast_if_small

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 17
# Documents that meet in a group of the first level, and groups that meet in one afterwards.
GROUP = 512
FAN_IN = 256
# Sources numbered by one task at a time.
SOURCES_AT_ONCE = 100_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_sizes(sizes: DataFrame) -> DataFrame:
    """``source``, ``source_size`` and ``__rank``: its place from 0 by code point, null last."""
    totals, _ = write_stage(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    parts = group_count(totals.count(), SOURCES_AT_ONCE)
    order = [F.col("source").isNull(), F.col("source")]
    ranged = totals.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    ranged, _ = write_stage(ranged, "sources")
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.withColumn("__in", inside).join(offsets, "__part").select(
        "source", "source_size", (F.col("__before") + F.col("__in") - 1).alias("__rank")
    )


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source``, ``source_size``, ``target``: words each source gives to the mix.

    Sources share ``share`` of all words by weight, the weights repeating along the sources
    by code point, null last. None gives more than ``most`` times its size; what it cannot
    give the others share by weight, again until none is above. ``sizes`` has source and size.
    """
    at = (F.col("__rank") % len(weights)).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at + 1)
    ranked, _ = write_stage(source_sizes(sizes).select("source", "source_size", weight.alias("weight")), "sources")
    limit = F.col("source_size") * F.lit(float(most))
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > limit
        row = ranged_sums(ranked, over, limit)
        if row["capped"] == capped or not row["open_weight"]:
            break
        capped = row["capped"]
        level = (share * row["total"] - row["given"]) / row["open_weight"]
    target = F.least(F.col("weight") * F.lit(level), limit)
    return ranked.select("source", "source_size", target.alias("target"))


def ranged_sums(ranked: DataFrame, over: Column, limit: Column):
    """One row of sums over all sources: those above their limit, and the weights of the rest."""
    return ranked.agg(
        F.coalesce(F.sum("source_size"), F.lit(0)).cast("double").alias("total"),
        F.count_if(over).alias("capped"),
        F.coalesce(F.sum(F.when(over, limit)), F.lit(0.0)).alias("given"),
        F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("open_weight"),
    ).first()


# One step of the pivotal method on the carried fraction c and the next document u, both
# with a size and a fraction p. `up` words can go from u to c, `down` from c to u; the
# direction is drawn so that the expected fractions do not change.
_PIVOT = """
aggregate(units, cast(named_struct('row', null, 'size', 0, 'p', 0, 'done', array()) as
    struct<row: bigint, size: bigint, p: double, done: array<struct<row: bigint, taken: boolean>>>),
  (c, u) -> if(c.row is null, named_struct('row', u.row, 'size', u.size, 'p', u.p, 'done', c.done),
    aggregate(array(named_struct('up', least((1 - c.p) * c.size, u.p * u.size),
                                 'down', least(c.p * c.size, (1 - u.p) * u.size))), c,
      (s, d) -> if(u.draw * (d.up + d.down) < d.down,
        if((1 - c.p) * c.size <= u.p * u.size,
          named_struct('row', u.row, 'size', u.size, 'p', u.p - d.up / u.size,
                       'done', concat(c.done, array(named_struct('row', c.row, 'taken', true)))),
          named_struct('row', c.row, 'size', c.size, 'p', c.p + d.up / c.size,
                       'done', concat(c.done, array(named_struct('row', u.row, 'taken', false))))),
        if(c.p * c.size <= (1 - u.p) * u.size,
          named_struct('row', u.row, 'size', u.size, 'p', u.p + d.down / u.size,
                       'done', concat(c.done, array(named_struct('row', c.row, 'taken', false)))),
          named_struct('row', c.row, 'size', c.size, 'p', c.p - d.down / c.size,
                       'done', concat(c.done, array(named_struct('row', u.row, 'taken', true)))))))))
"""


def pivotal_rounding(units: DataFrame, seed: int = SEED, group: int = GROUP, fan_in: int = FAN_IN) -> DataFrame:
    """``row``, ``taken``: each fraction rounded, keeping the words of each source.

    ``units`` has row (unique), key (a number that stays the same in reruns), source, size
    (over 0) and p (over 0, under 1). Each level meets in groups that leave one fraction per
    source; the last fraction of a source goes to the nearer end. No unit gives no row.
    """
    groups = group_count(units.count(), group)
    level, decided = 0, None
    while True:
        bucket = F.pmod(F.xxhash64(F.lit(seed + level), "key"), F.lit(groups))
        draw = hash_share("key", "size", seed=seed + 1000 + level)
        unit = F.struct(F.xxhash64(F.lit(seed), "key").alias("at"), "row", "size", "p", "key", draw.alias("draw"))
        met = units.groupBy("source", bucket.alias("bucket")).agg(F.sort_array(F.collect_list(unit)).alias("units"))
        folded, _ = write_stage(met.select("source", F.expr(_PIVOT).alias("left"), F.col("units")[0]["key"].alias("key")), "rounded")
        done = folded.select(F.explode("left.done").alias("d")).select("d.row", "d.taken")
        decided = done if decided is None else decided.unionByName(done)
        units = folded.select("left.row", "left.size", "left.p", "key", "source")
        if groups == 1:
            last = units.select("row", (F.col("p") >= 0.5).alias("taken"))
            return decided.unionByName(last)
        groups, level = math.ceil(groups / fan_in), level + 1


def repeats(sized: DataFrame) -> DataFrame:
    """row and ``occurrence`` (from 2) of rows that repeat source, doc_id and size.

    Equal rows change places in another layout, so their numbers together do not depend on it.
    """
    many = sized.where(F.col("doc_id").isNotNull()).groupBy("doc_id", "size").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = sized.join(broadcast_if_small(many.select("doc_id", "size")), ["doc_id", "size"], "left_semi")
    numbered = rank_in_group(rows, ["source", "doc_id", "size"], ["row"], [F.shiftright("row", 33)], "occurrence")
    return numbered.where("occurrence > 1").select("row", "occurrence")


def copies(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """``row``, ``source_size``, ``target``, ``copies`` (0 to ``most``) of each row.

    ``sized`` is a written table with row (unique), doc_id, source and size. Rows without a
    word take no part in the rounding: their fraction is drawn by itself. Equal rows are
    separate documents, told apart by a number so that they need not meet. A null source is a source; a null doc_id is drawn by its row.
    """
    found, _ = write_stage(targets(sized, weights, share, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    again, _ = write_stage(repeats(sized), "again")
    key = F.xxhash64("doc_id", "size", F.when(F.col("doc_id").isNull(), F.col("row")), "occurrence")
    same_source = sized["source"].eqNullSafe(found["source"])
    rated = (
        sized.join(found, same_source)
        .select("row", "doc_id", sized["source"].alias("source"), "size", "source_size", "target", rate.alias("rate"))
        .withColumn("whole", F.floor("rate"))
        .withColumn("p", F.col("rate") - F.col("whole"))
        .join(broadcast_if_small(again), "row", "left")
        .withColumn("key", key)
        .drop("occurrence")
    )
    rated, _ = write_stage(rated, "rated")
    rounded = pivotal_rounding(rated.where("size > 0 and p > 0").select("row", "key", "source", "size", "p"), seed)
    alone = F.when(F.col("size") == 0, hash_share("key", seed=seed + 9000) < F.col("p"))
    more = F.coalesce("taken", alone, F.lit(False)).cast("long")
    return rated.join(rounded, "row", "left").select(
        "row", "doc_id", "source", "size", "source_size", "target", (F.col("whole") + more).alias("copies")
    )


def mix_plan(docs: DataFrame, **how) -> DataFrame:
    """Each document with the words that the mix takes of it.

    Columns: doc_id, size, source_size, target (its source's), taken (copies times size),
    copies, source. One row per input row; a null text has no word. Extra columns are ignored.
    """
    sized = docs.select("doc_id", "source", word_count().alias("size"))
    sized, _ = write_stage(sized.withColumn("row", F.monotonically_increasing_id()), "sized")
    return copies(sized, **how).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source"
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each row as often as the mix takes it, with the columns of ``docs``."""
    names = docs.columns
    numbered, _ = write_stage(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    sized, _ = write_stage(numbered.select(F.col("__row").alias("row"), "doc_id", "source", word_count().alias("size")), "sized")
    wanted = copies(sized, **how).where("copies > 0").select(F.col("row").alias("__row"), F.col("copies").alias("__copies"))
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))
    return numbered.join(wanted, "__row").select("*", again.alias("__copy")).select(*names)
