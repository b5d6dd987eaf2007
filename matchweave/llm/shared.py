"""Helpers that several corpus operators share."""

from __future__ import annotations

import gc
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave.sources.store import new_path

# Rows of texts that go to a Python task at a time.
ROWS_PER_BATCH = 500
# White space of the word rule `[^\x20\x09-\x0D]+`, as Spark's regular expressions spell it.
WORD = r"[^\x20\x09-\x0D]+"


def write_stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a table into the shared folder; return it as read back, and its path.

    Lineage ends at the written files, so a lost executor costs no earlier step.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_stage(spark: SparkSession, *paths: str) -> None:
    """Delete written stages that no later step reads."""
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files and broadcasts of finished steps, as it does when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> SparkSession:
    """Send rows to Python in small batches: with the 10,000 rows of the default each side holds that many whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    return spark


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns of a table; other columns, whatever their names, stay out."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def hash_share(*cols: Column | str, seed: int) -> Column:
    """A repeatable number in [0, 1) from the values of some columns."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)
    return bits.cast("double") / float(1 << 53)


def group_count(rows: int, per_group: int) -> int:
    return max(1, math.ceil(rows / per_group))
