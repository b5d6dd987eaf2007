"""The matched case-control study laid over order tables.

customer = person, orders x lineitem = event log, part = code dictionary, consecutive
orders = validity intervals, orders -> lineitem -> part = spell -> episode -> diagnosis.
A table that several later steps read is written once (``stage``) and read back.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave.functions.exprs import age_years, hash_bucket, hash_order, year_window
from matchweave.functions.ordering import neighbour
from matchweave.operators import cases, controls, features, matching, wide
from matchweave.sources.store import broadcast_if_small, read_table, split_hot_joins, stage

SEED = 42
FIRST_YEAR, LAST_YEAR = 1998, 2000
GAP_DAYS = 365
CONTROLS_PER_CASE = 5
STRATA = ["segment", "area"]
ORDER = ["event_date", "o_orderkey", "l_linenumber", "code", "l_suppkey", "value"]
OPEN_END = "9999-01-01"


class RetailStudy:
    """Stages of the study for one data folder; each stage is built when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = split_hot_joins(spark)
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.sf_dir}/{name}.parquet")

    @property
    def persons(self) -> DataFrame:
        born = F.date_add(F.lit("1940-01-01").cast("date"), (F.col("c_custkey") * 37 % 20000).cast("int"))
        return self.table("customer").select(
            F.col("c_custkey").alias("person"),
            F.col("c_mktsegment").alias("segment"),
            (F.col("c_nationkey") % 5).alias("area"),
            born.alias("born"),
        )

    @property
    def events(self) -> DataFrame:
        """Person-event log with its event code (part) and value."""
        return self._log(self._dated_orders())

    def _dated_orders(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey"),
            F.col("o_custkey").alias("person"),
            F.col("o_orderdate").cast("date").alias("event_date"),
        )

    def _log(self, orders: DataFrame) -> DataFrame:
        lines = self.table("lineitem").select(
            F.col("l_orderkey").alias("o_orderkey"),
            "l_linenumber",
            F.col("l_partkey").alias("code"),
            "l_suppkey",
            F.col("l_quantity").alias("value"),
        )
        return lines.join(orders, "o_orderkey")

    def _by_brand(self, events: DataFrame) -> DataFrame:
        brands = self.table("part").select(F.col("p_partkey").alias("code"), F.col("p_brand").alias("brand"))
        return events.join(brands, "code").select("person", "event_date", "brand", "value")

    @property
    def brand_events(self) -> DataFrame:
        """The same log coded by brand."""
        return self._by_brand(self.events)

    def brand_events_of(self, persons: DataFrame) -> DataFrame:
        """The log of some persons, who are looked up among the orders before the lines are joined."""
        listed = broadcast_if_small(persons.select("person").distinct())
        return self._by_brand(self._log(self._dated_orders().join(listed, "person", "left_semi")))

    def codes(self, pattern: str = "%gizmo", max_size: int = 5) -> DataFrame:
        found = cases.code_list(
            self.table("part").select("p_partkey", "p_name", "p_size"),
            "p_partkey",
            "p_name",
            [pattern],
            drop=F.col("p_size") > max_size,
        )
        return found.withColumnRenamed("p_partkey", "code")

    @cached_property
    def brands(self) -> DataFrame:
        return stage(self.table("part").select(F.col("p_brand").alias("brand")).distinct(), "brands")

    def index_events(self) -> DataFrame:
        """First outcome event of each person, with the person's attributes."""
        listed = cases.index_event(self.events, self.codes().select("code"), "person", "code", ORDER)
        dated = listed.select("person", F.col("event_date").alias("index_date"), "code")
        return dated.join(self.persons, "person")

    @cached_property
    def index(self) -> DataFrame:
        return stage(self.index_events(), "index")

    def aged_index(self) -> DataFrame:
        return self.index_events().withColumn("age", age_years(F.col("index_date"), F.col("born")))

    def eligible(self) -> DataFrame:
        day = F.col("index_date")
        return cases.eligible(
            self.aged_index(),
            {
                "outside study window": ~year_window(day, FIRST_YEAR, LAST_YEAR),
                "implausible birth year": (F.year("born") < 1941) | (F.year("born") > 1990),
                "not adult": F.col("age") < 18,
            },
        )

    def spells(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("spell"),
            F.col("o_custkey").alias("person"),
            F.col("o_orderstatus").alias("status"),
        )

    def episodes(self, spells: DataFrame) -> DataFrame:
        """Start of each episode (line number) of the given spells."""
        lines = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
        wanted = broadcast_if_small(spells.select(F.col("spell").alias("l_orderkey")).distinct())
        return (
            lines.join(wanted, "l_orderkey", "left_semi")
            .groupBy(F.col("l_orderkey").alias("spell"), F.col("l_linenumber").alias("episode"))
            .agg(F.min("l_shipdate").cast("date").alias("episode_start"))
        )

    def diagnoses(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("spell"),
            F.col("l_linenumber").alias("episode"),
            F.col("l_partkey").alias("code"),
            F.col("l_suppkey").alias("diag_num"),
        )

    def hospital_index(self, max_size: int = 12) -> DataFrame:
        """Index events through the order -> line -> part hierarchy, on a wider code list."""
        codes = self.codes(max_size=max_size).select("code")
        listed = stage(cases.with_codes(self.diagnoses(), codes, "code"), "listed_lines")
        return cases.index_event_hier(
            listed,
            self.episodes(listed),
            self.spells(),
            codes,
            "person",
            "code",
            ["spell"],
            ["spell", "episode"],
            ["episode_start", "episode", "diag_num", "code", "spell"],
        )

    def intervals(self, of: DataFrame | None = None) -> DataFrame:
        """Validity intervals: each order's priority holds until the day before the next order.

        With ``of`` only those of some persons, who are looked up before the orders are sorted.
        """
        orders = self.table("orders").select(
            F.col("o_custkey").alias("person"),
            F.col("o_orderdate").cast("date").alias("start"),
            F.col("o_orderkey").alias("o_orderkey"),
            F.col("o_orderpriority").alias("priority"),
        )
        if of is not None:
            orders = orders.join(broadcast_if_small(of.select("person").distinct()), "person", "left_semi")
        near = neighbour(orders, ["person"], ["start", "o_orderkey"], ["start"], "next_", 1)
        return near.select(
            "person",
            "o_orderkey",
            "start",
            F.coalesce(F.date_sub("next_start", 1), F.lit(OPEN_END).cast("date")).alias("end"),
            "priority",
        )

    @property
    def cases(self) -> DataFrame:
        """Index persons inside the study window, with their strata."""
        inside = self.index.where(year_window(F.col("index_date"), FIRST_YEAR, LAST_YEAR))
        return inside.drop("born")

    def pool(self) -> DataFrame:
        """Persons that never had an index event."""
        return controls.exclude(
            self.persons.drop("born"), {"index persons": self.index.select("person")}
        )

    def pairs(self) -> DataFrame:
        keyed = self.pool().withColumn("draw", hash_order(F.col("person"), SEED))
        listed = self.cases.withColumn("turn", hash_order(F.col("person"), SEED))
        return matching.match_exact(
            listed.select("person", "index_date", "turn", *STRATA),
            keyed,
            "person",
            STRATA,
            CONTROLS_PER_CASE,
            ["turn", "person"],
            ["draw", "person"],
            [hash_bucket(F.col("turn"))],
            [hash_bucket(F.col("draw"))],
        ).drop("turn")

    @cached_property
    def sets(self) -> DataFrame:
        """Complete matched sets."""
        return stage(matching.complete_sets(self.staged_pairs, "case_person", CONTROLS_PER_CASE), "sets")

    @cached_property
    def staged_pairs(self) -> DataFrame:
        return stage(self.pairs(), "pairs")

    def grouped(self) -> DataFrame:
        return matching.assign_group(self.sets, "case_person")

    @cached_property
    def members(self) -> DataFrame:
        return stage(
            matching.stack_members(
                self.grouped(), "case_person", "control_person", ["index_date", *STRATA, "group_id"]
            ),
            "members",
        )

    def lookback(self, codes: DataFrame | None = None) -> DataFrame:
        """Features of members on some codes; on all brands where none are given."""
        return features.lookback_features(
            self.members,
            self.brand_events,
            self.brands if codes is None else codes,
            "person",
            "brand",
            "index_date",
            "event_date",
            "value",
            GAP_DAYS,
        )

    @cached_property
    def features(self) -> DataFrame:
        """Features of every member, those without any code included."""
        found = stage(self.lookback(), "found")
        return stage(features.backfill(found, self.members.drop("index_date"), "person", "brand"), "features")

    @cached_property
    def brand_names(self) -> list[str]:
        """Selected codes: the brands of the dictionary, a list that does not grow with the log."""
        return wide.code_list(self.brands, "brand")

    @cached_property
    def balanced_features(self) -> DataFrame:
        """Features of the case and the first control of each set."""
        return stage(features.rebalance(self.features, "group_id", "label", "person"), "balanced")

    def wide_table(self, balanced: bool = False) -> DataFrame:
        long = self.balanced_features if balanced else self.features
        return wide.pivot_wide(long, ["person", "group_id", "label"], "brand", self.brand_names)

    @cached_property
    def wide(self) -> DataFrame:
        return stage(self.wide_table(), "wide")

    @cached_property
    def balanced_wide(self) -> DataFrame:
        return stage(self.wide_table(balanced=True), "wide")

    def value_profile(self, balanced: bool = False) -> DataFrame:
        """Missing values per class and value column, from the long features."""
        long = self.balanced_features if balanced else self.features
        members = long.select("person", "group_id", "label").distinct()
        return wide.missingness_of_long(long, members, "label", "brand", self.brand_names)

    def imputed(self, balanced: bool = False, keep: str = "all") -> DataFrame:
        """Wide table with sparse value columns dropped and the rest filled by class median.

        What is sparse and the medians come from the long features, so the table is pivoted once.
        """
        long, table = (self.balanced_features, self.balanced_wide) if balanced else (self.features, self.wide)
        profile = stage(self.value_profile(balanced), "profile")
        kept = wide.drop_sparse(table, wide.value_columns(table), "label", keep=keep, profile=profile)
        medians = wide.medians_of_long(long, "label", "brand", self.brand_names, profile=profile)
        return wide.impute_median(kept, wide.value_columns(kept), by="label", medians=medians)

    def model_table(self, balanced: bool = False) -> DataFrame:
        """Imputed wide table with the columns that every class keeps."""
        return self.imputed(balanced)

    def split(self) -> DataFrame:
        return wide.group_split(self.members, "group_id", 0.75, SEED)

    def _train_test(self, table: DataFrame) -> tuple[DataFrame, DataFrame]:
        # Fitting passes over the rows many times: spread them evenly once.
        parts = wide.training_partitions(self.members)
        joined = table.join(self.split(), "group_id").repartition(parts, "group_id")
        return wide.split_parts(stage(joined, "model_table"))

    @cached_property
    def train_test(self) -> tuple[DataFrame, DataFrame]:
        return self._train_test(self.model_table())

    @cached_property
    def balanced_train_test(self) -> tuple[DataFrame, DataFrame]:
        """Train and test rows of the 1:1 data: imputed by the medians of its own classes."""
        return self._train_test(self.model_table(balanced=True))

    @cached_property
    def unlabelled_train_test(self) -> tuple[DataFrame, DataFrame]:
        """Train and test rows filled by medians of the train rows alone, whatever their class."""
        train, test = self._train_test(self.wide)
        columns = wide.value_columns(train)
        filled = [wide.impute_median(t, columns, by=None, fit_on=train) for t in (train, test)]
        return filled[0], filled[1]
