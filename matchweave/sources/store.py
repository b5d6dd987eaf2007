"""Reading, writing and staging tables and models."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# A join side is broadcast only after a count shows it has at most this many rows.
BROADCAST_ROWS = 200_000

_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where the setting is missing, a local session gets a new folder of its own; a
    cluster session is an error, since a machine-local folder would not be shared.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="matchweave-")
    return _LOCAL_FOLDERS[app]


def split_hot_joins(spark: SparkSession) -> SparkSession:
    """Let joins split the partitions of a very frequent key, also where that costs a shuffle.

    Without the last setting Spark leaves a hot key in one task whenever the next step
    groups by the same key.
    """
    for name in ("enabled", "skewJoin.enabled", "forceOptimizeSkewedJoin"):
        spark.conf.set(f"spark.sql.adaptive.{name}", "true")
    return spark


def staged_folder(spark: SparkSession) -> str:
    """Where this application writes its staged tables."""
    return f"{shared_folder(spark)}/matchweave/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{staged_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_staged(spark: SparkSession) -> None:
    """Delete the staged tables of this application; DataFrames read from them end with it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several later steps read, and continue from the written files.

    The files survive lost executors, cut the lineage, and give the planner real sizes.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, max_rows: int | None = None) -> bool:
    max_rows = BROADCAST_ROWS if max_rows is None else max_rows
    return df.select(F.lit(1)).limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Broadcast hint after a size check; a larger table joins by shuffle instead."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def read_table(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    rename: Mapping[str, str] | None = None,
) -> DataFrame:
    """Parquet table with types fixed at load and optional renaming (source -> name)."""
    df = spark.read.parquet(path)
    if rename:
        df = df.withColumnsRenamed(dict(rename))
    if schema is not None:
        df = df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])
    return df


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def append_table(df: DataFrame, path: str) -> None:
    write_table(df, path, mode="append")


def save_model(model, path: str) -> None:
    """Write a fitted pipeline or a forest."""
    model.write().overwrite().save(path)


def load_model(path: str):
    # Forests build on this module.
    from matchweave.operators import forests

    spark = SparkSession.active()
    return forests.load(spark, path) if forests.is_stored(spark, path) else PipelineModel.load(path)
