"""The study on linked health records: raw tables to matched, model-ready features.

``RecordStudy`` takes the tables of ``sources.schemas`` as DataFrames. Each property is a
step of the study; steps that several later ones read are written once.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchweave.functions.exprs import age_years, hash_bucket, hash_order, year_window
from matchweave.operators import cases, controls, features, matching, quality, wide
from matchweave.sources import schemas
from matchweave.sources.store import split_hot_joins, stage

STRATA = ["sex", "birth_year", "quintile"]


# Fixed values of the study design; every one is a parameter.
@dataclass(frozen=True)
class Settings:
    outcome_pattern: str = "%lzheimer%"
    event_codes_excluded: tuple[str, ...] = ("13Y7.", "Eu002")
    diagnosis_codes_excluded: tuple[str, ...] = ("F002",)
    broad_pattern: str = "%ementia%"
    first_year: int = 2015
    last_year: int = 2019
    min_age: int = 18
    max_age: int = 120
    case_birth_years: tuple[int, int] = (1870, 2003)
    control_birth_after: int = 1870
    control_birth_before: int = 2001
    code_version: str = "2"
    earliest_year: int = 1880
    latest_year: int = 2022
    died_method: str = "4"
    gap_days: int = 1825
    top_codes: int = 200
    codes_excluded: tuple[str, ...] = ("ZZZZZ", "", "PCSDT", "EMISA", "8B314")
    kept_codes: int | None = 50
    min_code_count: int | None = None
    stratum_cap: int = 799
    controls_per_case: int = 5
    train_share: float = 0.75
    max_missing: float = 0.5
    apply_opt_outs: bool = False
    seed: int = 42


class RecordStudy:
    def __init__(self, tables: Mapping[str, DataFrame], settings: Settings = Settings()):
        lacking = schemas.missing_columns(dict(tables))
        if lacking:
            raise ValueError(f"missing columns: {lacking}")
        self.tables = {n: tables[n].select(*schemas.columns_of(n)) for n in schemas.SCHEMAS}
        self.settings = settings
        split_hot_joins(self.tables["gp_events"].sparkSession)

    # --- cleaning ------------------------------------------------------------------

    def _implausible(self, *dates: str, earliest: int | None = None):
        s = self.settings
        broken = F.lit(False)
        for d in dates:
            year = F.year(d)
            broken = broken | F.coalesce(
                (year > s.latest_year) | (year < (earliest or s.earliest_year)), F.lit(False)
            )
        return broken

    @property
    def deaths(self) -> DataFrame:
        raw = self.tables["deaths"].where(F.col("person").isNotNull())
        return quality.drop_where(
            raw, (F.col("death_date_valid") == "Invalid") | F.col("death_date").isNull()
        )

    @property
    def persons(self) -> DataFrame:
        return quality.drop_where(self.tables["persons"], F.col("sex") > 2)

    @property
    def addresses(self) -> DataFrame:
        return self.tables["addresses"]

    @property
    def diagnoses(self) -> DataFrame:
        return self.tables["diagnoses"].where(F.col("spell").isNotNull())

    @property
    def episodes(self) -> DataFrame:
        s = self.settings
        df = quality.drop_where(self.tables["episodes"], F.col("end_date") < F.col("start_date"))
        df = quality.drop_where(df, F.year("end_date") > s.latest_year)
        df = quality.drop_where(df, (F.col("age") < 0) | (F.col("age") > s.max_age))
        return quality.drop_where(
            df,
            F.col("spell").isNull()
            | F.col("start_date").isNull()
            | (F.col("diag_codes").isNull() & F.col("operation").isNull()),
        )

    @property
    def spells(self) -> DataFrame:
        df = self.tables["spells"].where(F.col("spell").isNotNull() & F.col("person").isNotNull())
        df = quality.null_where(df, "sex", (F.col("sex") > "2") | (F.col("sex") < "1"))
        df = quality.drop_where(df, F.col("admit_date") > F.col("discharge_date"))
        return df.where(~self._implausible("admit_date", "discharge_date"))

    @property
    def opt_outs(self) -> DataFrame:
        return quality.optout_list(self.tables["gp_patients"], "opt_out", "person")

    def checks(self) -> dict[str, DataFrame]:
        """The data-quality reports on the raw tables, by name."""
        t, s = self.tables, self.settings
        out = {f"nulls: {n}": quality.null_profile(df, df.columns) for n, df in t.items()}
        ages, people, sexes = (0, s.max_age), (1, 150), (1, 2)
        out["ranges: deaths"] = quality.range_violations(t["deaths"], {"age": ages, "sex": sexes})
        out["ranges: persons"] = quality.range_violations(t["persons"], {"sex": sexes})
        out["ranges: addresses"] = quality.range_violations(t["addresses"], {"quintile": (1, 5)})
        out["ranges: diagnoses"] = quality.range_violations(
            t["diagnoses"], {"episode": people, "diag_num": people}
        )
        out["ranges: episodes"] = quality.range_violations(t["episodes"], {"episode": people, "age": ages})
        for name in ("deaths", "persons"):
            out[f"repeated persons: {name}"] = (
                t[name].groupBy("person").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            )
        keys = ["provider", "spell", "episode"]
        out["repeated diagnosis numbers"] = quality.duplicate_keys(self.diagnoses, keys, "diag_num")
        out["repeated diagnosis codes"] = quality.duplicate_keys(self.diagnoses, keys, "code")
        for name, a, b in (
            ("addresses", "start_date", "end_date"),
            ("registrations", "start_date", "end_date"),
            ("episodes", "start_date", "end_date"),
            ("spells", "admit_date", "discharge_date"),
            ("persons", "birth_date", "death_date"),
        ):
            out[f"date order: {name}"] = quality.date_order_violations(t[name], a, b)
        out["overlapping addresses"] = quality.overlaps(
            t["addresses"], ["person"], "start_date", "end_date", ["quintile"]
        )
        out["overlapping episodes"] = quality.sequence_overlaps(
            t["episodes"], ["provider", "spell"], "episode", "start_date", "end_date"
        )
        out["changing sex"] = quality.inconsistent_within(t["spells"], ["person"], "sex")
        return out

    # --- cases ---------------------------------------------------------------------

    @cached_property
    def outcome_event_codes(self) -> DataFrame:
        s = self.settings
        found = cases.code_list(
            self.tables["event_codes"], "code", "description", [s.outcome_pattern], s.event_codes_excluded
        )
        return stage(found, "outcome_event_codes")

    @cached_property
    def outcome_diagnosis_codes(self) -> DataFrame:
        s = self.settings
        found = cases.code_list(
            self.tables["diagnosis_codes"], "code", "description", [s.outcome_pattern], s.diagnosis_codes_excluded
        )
        return stage(found, "outcome_diagnosis_codes")

    @cached_property
    def broad_codes(self) -> DataFrame:
        found = cases.code_list(
            self.tables["event_codes"], "code", "description", [self.settings.broad_pattern]
        )
        return stage(found, "broad_codes")

    @property
    def gp_index(self) -> DataFrame:
        """First outcome event ever in general practice, then the study's restrictions."""
        s = self.settings
        first = cases.index_event(
            self.tables["gp_events"],
            self.outcome_event_codes,
            "person",
            "code",
            ["event_date", "practice", "local_num", "sequence", "code"],
        ).withColumn("age", age_years(F.col("event_date"), F.col("birth_date")))
        born = F.year("birth_date")
        return cases.eligible(
            first,
            {
                "outside study years": ~year_window(F.col("event_date"), s.first_year, s.last_year),
                "implausible birth year": (born < s.case_birth_years[0]) | (born > s.case_birth_years[1]),
                "not adult": F.col("age") < s.min_age,
            },
        )

    @property
    def hospital_index(self) -> DataFrame:
        """First outcome diagnosis ever in hospital, then the study's restrictions."""
        s = self.settings
        first = cases.index_event_hier(
            self.diagnoses,
            self.episodes.select("provider", "spell", "episode", "start_date", "age", "operation"),
            self.spells.select("provider", "spell", "person", "sex", "discharge_date", "discharge_method"),
            self.outcome_diagnosis_codes,
            "person",
            "code",
            ["provider", "spell"],
            ["provider", "spell", "episode"],
            ["start_date", "episode", "diag_num", "provider", "spell", "code"],
        )
        return cases.eligible(
            first,
            {
                "died before the study": (F.col("discharge_method") == s.died_method)
                & (F.year("discharge_date") < s.first_year),
                "starts after discharge": F.col("start_date") > F.col("discharge_date"),
                "outside study years": ~year_window(F.col("start_date"), s.first_year, s.last_year),
                "not adult": (F.col("age") < s.min_age) | (F.col("age") > s.max_age),
            },
        )

    @cached_property
    def all_cases(self) -> DataFrame:
        gp = self.gp_index.select("person", "sex", F.col("event_date").alias("index_date"), "age", "code")
        hospital = self.hospital_index.select(
            "person",
            F.col("sex").try_cast("int").alias("sex"),
            F.col("start_date").alias("index_date"),
            "age",
            "code",
        )
        merged = cases.reconcile(
            gp, hospital, "person", ["sex"], ["index_date", "age"],
            {"code": "event_code"}, {"code": "diagnosis_code"},
        )
        return stage(merged, "all_cases")

    @cached_property
    def cases(self) -> DataFrame:
        """Cases with the deprivation quintile of their address at the index date."""
        placed = cases.asof_attribute(
            self.all_cases, self.addresses, "person", "index_date", "start_date", "end_date", "quintile", "quintile"
        )
        return stage(placed.withColumn("label", F.lit(1)), "cases")

    def cases_dead_before(self) -> DataFrame:
        return cases.deaths_before(self.cases, self.deaths, "person", "death_date", self.settings.first_year)

    # --- codes and controls --------------------------------------------------------

    @cached_property
    def selected_codes(self) -> DataFrame:
        s = self.settings
        top = features.frequent_codes(
            self.cases, self.tables["gp_events"], ["person", "sex"], "code", "index_date", "event_date",
            s.gap_days, s.top_codes, s.codes_excluded, s.kept_codes, s.min_code_count,
        )
        return stage(top, "selected_codes")

    def described_codes(self) -> DataFrame:
        return features.describe_codes(self.selected_codes, self.tables["event_codes"], "code")

    def stratum_sizes(self) -> DataFrame:
        return controls.stratum_sizes(self.cases, ["sex", "quintile", "age"])

    def candidates(self) -> DataFrame:
        """One row per person who could be a control, before any exclusion.

        The log is cut to each person's first usable event before it meets the address
        history, since the address conditions do not depend on the event.
        """
        s = self.settings
        born = F.year("birth_date")
        usable = self.tables["gp_events"].where(
            F.col("person").isNotNull()
            & (born > s.control_birth_after)
            & (born < s.control_birth_before)
            & (F.col("code_version") == s.code_version)
            & F.col("sex").between(1, 2)
        )
        first = cases.first_per_key(
            usable.select("person", "sex", "birth_date", "event_date", "practice", "local_num", "sequence"),
            ["person"],
            ["event_date", "practice", "local_num", "sequence", "sex", "birth_date"],
        )
        settled = self.addresses.where(
            (F.col("start_date") < F.lit(f"{s.first_year}-01-01").cast("date"))
            & (F.col("end_date") >= F.lit(f"{s.last_year + 1}-01-01").cast("date"))
        )
        placed = cases.first_per_key(settled, ["person"], ["start_date", "end_date", "quintile"])
        return first.select("person", "sex", F.year("birth_date").alias("birth_year")).join(
            placed.select("person", "quintile"), "person"
        )

    @cached_property
    def drawn(self) -> DataFrame:
        s = self.settings
        pool = controls.control_pool(self.candidates(), "person", STRATA, s.stratum_cap, s.seed)
        return stage(pool.select("person", *STRATA), "drawn")

    @cached_property
    def exclusions(self) -> dict[str, DataFrame]:
        lists = {"broad code": self.broad_codes, "outcome code": self.outcome_event_codes}
        hospital = cases.with_codes(self.diagnoses, self.outcome_diagnosis_codes, "code").join(
            self.spells.select("provider", "spell", "person"), ["provider", "spell"]
        )
        sources = {
            "dead": controls.persons_with(self.deaths, "person"),
            "already a case": self.cases.select("person"),
            **controls.persons_by_list(self.tables["gp_events"], lists, "code", ["person", "sex"]),
            "outcome code in hospital": controls.persons_with(hospital, "person"),
        }
        if self.settings.apply_opt_outs:
            sources["opted out"] = self.opt_outs
        return sources

    @cached_property
    def pool(self) -> DataFrame:
        return stage(controls.exclude(self.drawn, self.exclusions), "pool")

    def exclusion_ledger(self) -> DataFrame:
        return controls.exclusion_ledger(self.drawn, self.exclusions)

    # --- matching ------------------------------------------------------------------

    @cached_property
    def pairs(self) -> DataFrame:
        s = self.settings
        listed = self.cases.select(
            "person",
            "index_date",
            "sex",
            (F.year("index_date") - F.col("age")).alias("birth_year"),
            "quintile",
            hash_order(F.col("person"), s.seed).alias("turn"),
        )
        if s.apply_opt_outs:
            listed = listed.join(self.opt_outs, "person", "left_anti")
        keyed = self.pool.withColumn("draw", hash_order(F.col("person"), s.seed))
        pairs = matching.match_exact(
            listed, keyed, "person", STRATA, s.controls_per_case, ["turn", "person"], ["draw", "person"],
            [hash_bucket(F.col("turn"))], [hash_bucket(F.col("draw"))],
        )
        return stage(pairs.drop("turn"), "pairs")

    @cached_property
    def sets(self) -> DataFrame:
        full = stage(matching.complete_sets(self.pairs, "case_person", self.settings.controls_per_case), "full")
        return stage(matching.assign_group(full, "case_person"), "sets")

    @cached_property
    def members(self) -> DataFrame:
        shared = ["index_date", *STRATA, "group_id"]
        return stage(matching.stack_members(self.sets, "case_person", "control_person", shared), "members")

    # --- features ------------------------------------------------------------------

    @cached_property
    def features(self) -> DataFrame:
        s = self.settings
        found = stage(
            features.lookback_features(
                self.members, self.tables["gp_events"], self.selected_codes, "person", "code",
                "index_date", "event_date", "value", s.gap_days,
            ),
            "found",
        )
        full = features.backfill(found, self.members.drop("index_date"), "person", "code")
        return stage(quality.zero_to_null(full, "mean_value"), "features")

    @cached_property
    def balanced_features(self) -> DataFrame:
        return stage(features.rebalance(self.features, "group_id", "label", "person"), "balanced")

    def checks_of_cohort(self) -> DataFrame:
        return matching.cohort_checks(
            self.sets, self.members, self.features, self.outcome_event_codes,
            "case_person", "control_person", "person", "code", self.settings.controls_per_case,
        )

    def codes(self) -> list[str]:
        """Selected codes as a list, without NULL; their number is bounded by ``top_codes``."""
        return wide.code_list(self.selected_codes, "code")

    def wide(self, balanced: bool = False, keep: str = "any") -> DataFrame:
        """One row per member: counts, and values filled by the median of the class."""
        s = self.settings
        long = self.balanced_features if balanced else self.features
        table = stage(wide.pivot_wide(long, ["person", "group_id", "label"], "code", self.codes()), "wide")
        table = wide.drop_all_missing(table, wide.value_columns(table))
        profile = stage(wide.missingness_of_long(long, table, "label", "code", self.codes(), max_missing=s.max_missing), "profile")
        kept = wide.drop_sparse(table, wide.value_columns(table), "label", s.max_missing, keep, profile)
        medians = wide.medians_of_long(long, "label", "code", self.codes(), profile=profile)
        return wide.impute_median(kept, wide.value_columns(kept), by="label", medians=medians)

    def train_test(self, balanced: bool = False) -> tuple[DataFrame, DataFrame]:
        """Train and test rows, without the columns that a class has no values for."""
        s = self.settings
        split = wide.group_split(self.members, "group_id", s.train_share, s.seed)
        table = self.wide(balanced, keep="all").join(split, "group_id")
        # Fitting passes over the rows many times: spread them evenly once.
        parts = wide.training_partitions(self.members)
        return wide.split_parts(stage(table.repartition(parts, "group_id"), "model_table"))

    def contrast(self, balanced: bool = True) -> DataFrame:
        """Mean and median of value and count by code and class."""
        long = self.balanced_features if balanced else self.features
        return features.feature_contrast(long, "code", "label", ["mean_value", "n_events"], self.codes())
