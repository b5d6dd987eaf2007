"""Every registered query against its SQL, and the shape of the physical plans."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from check import rows_of
from matchweave.plans.catalogue import ORACLES, STEPS
from matchweave.plans.retail import RetailStudy
from matchweave.sources import store

ROOT = Path(__file__).resolve().parent.parent
SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def connections():
    return {folder: connect(folder) for folder in (SMALL, MEDIUM)}  # in-process, read-only views


@pytest.fixture(scope="module")
def studies(spark):
    """One study per folder, so that the queries share the stages they are built on."""
    return {folder: RetailStudy(spark, folder) for folder in (SMALL, MEDIUM)}


# The smallest data leaves strata short of controls and most sets incomplete.
THIN = ["match_exact", "complete_sets", "backfill_members", "asof_attribute", "roc_points", "duplicate_sequence"]


@pytest.mark.parametrize(
    "name,folder", [(n, MEDIUM) for n in sorted(ORACLES)] + [(n, SMALL) for n in THIN]
)
def test_query_equals_sql(studies, connections, name, folder):
    df = STEPS[name](studies[folder])
    rel = connections[folder].sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())


MODEL_QUERIES = sorted(set(STEPS) - set(ORACLES))


@pytest.mark.parametrize("name", ["store_roundtrip", "glm_summary", "rf_importance_raw"])
def test_model_query_gives_rows(studies, name):
    assert name in MODEL_QUERIES
    assert STEPS[name](studies[MEDIUM]).count() > 0


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and "n_events" in df.columns


# Plans without a task that sees all rows. The prefix sums of group_split, roc and auc
# run over one row per bucket and are checked by their own bound instead.
@pytest.mark.parametrize(
    "name",
    [
        "interval_overlaps", "episode_sequence_overlap", "duplicate_sequence", "index_event",
        "index_event_hier", "asof_attribute", "control_pool", "match_exact", "complete_sets",
        "exclude_cascade", "lookback_features", "rebalance_1to1", "pivot_wide", "feature_contrast",
    ],
)
def test_plan_has_no_single_task_or_cross_join(studies, name):
    plan = STEPS[name](studies[SMALL])._jdf.queryExecution().toString()
    for operator in ("SinglePartition", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan.split("== Physical Plan ==")[1]


def test_scan_reads_only_needed_columns(spark):
    plan = entry_points.queries()["index_event"](spark, SMALL)._jdf.queryExecution().toString()
    assert "l_extendedprice" not in plan.split("== Physical Plan ==")[1]


@pytest.mark.parametrize(
    "name",
    ["index_event", "reconcile_sources", "frequent_codes", "exclude_ledger", "lookback_features", "impute_median_by_class"],
)
def test_query_without_any_broadcast(spark, connections, monkeypatch, name):
    """The way taken when no side is small: every join by shuffle, same rows."""
    monkeypatch.setattr(store, "BROADCAST_ROWS", 0)
    before = {k: spark.conf.get(k, None) for k in NO_BROADCAST}
    try:
        for k, v in NO_BROADCAST.items():
            spark.conf.set(k, v)
        df = entry_points.queries()[name](spark, SMALL)
        rel = connections[SMALL].sql(entry_points.oracle_sql()[name])
        assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


NO_BROADCAST = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


class Settings:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class Session:
    def __init__(self, master, **values):
        self.conf = Settings(values)
        self.sparkContext = type("C", (), {"master": master, "applicationId": f"app-{master}"})


def test_shared_folder_comes_from_the_session():
    named = Session("yarn", **{"spark.checkpoint.dir": "hdfs://x/shared/"})
    assert store.shared_folder(named) == "hdfs://x/shared"
    with pytest.raises(RuntimeError):
        store.shared_folder(Session("yarn"))
    local = Session("local[2]")
    assert store.shared_folder(local) == store.shared_folder(local)


def test_staged_tables_can_be_dropped(tmp_path):
    """In a session of its own, with the folder named by its settings."""
    code = f"""
import os, sys
from pyspark.sql import SparkSession
from matchweave.sources import store
spark = (SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", "{tmp_path}")
         .config("spark.ui.enabled", "false").getOrCreate())
assert store.shared_folder(spark) == "{tmp_path}"
assert store.stage(spark.range(5), "t").count() == 5
folder = store.staged_folder(spark)
assert os.listdir(folder)
store.drop_staged(spark)
assert not os.path.exists(folder)
print("dropped")
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=ROOT)
    assert done.stdout.strip().endswith("dropped"), done.stderr[-2000:]


def test_broadcast_only_behind_a_size_check(spark):
    small, large = spark.range(10), spark.range(1000)
    assert store.is_small(small, 10) and not store.is_small(large, 999)
    hinted = store.broadcast_if_small(small, 10)._jdf.queryExecution().toString()
    plain = store.broadcast_if_small(large, 999)._jdf.queryExecution().toString()
    assert "broadcast" in hinted and "broadcast" not in plain
