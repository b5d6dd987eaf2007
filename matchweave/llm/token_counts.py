"""Exact token counts of a corpus for every context limit.

Documents are aggregated by encoded length; the histogram is all that later answers need.
Sums along the lengths are taken inside ranges of lengths and carried across ranges, so
neither a hot length nor a long list of lengths meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchweave.llm.shared import write_stage
from matchweave.llm.tokens import default_vocabulary, encoder_of, slices

# Lengths per range of the two-level sums.
RANGE = 128


def encoded_lengths(docs: DataFrame, vocabulary: str | None = None, text: str = "text") -> DataFrame:
    """One row per document: ``length``, its number of token ids (null or empty text: 0)."""
    path = vocabulary or default_vocabulary()

    def count(batches):
        encoder = encoder_of(path)
        for batch in batches:
            for part in slices(batch):
                ids = encoder.encode(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([len(x) // 4 for x in ids], pa.int64())], ["length"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "length long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """``length``, ``docs``: how many documents have each length. An empty table gives no row."""
    return lengths.groupBy("length").agg(F.count(F.lit(1)).alias("docs"))


def every_limit(histogram: DataFrame) -> DataFrame:
    """Totals at each context limit that is the length of some document.

    ``docs`` of that length, ``docs_within`` and ``docs_longer`` (up to and over the limit),
    ``tokens_total``, ``tokens_kept`` (each document cut at the limit), ``tokens_lost`` and
    ``quantile`` (share of documents up to the limit). Limits between two lengths follow
    with `at_limits`. The histogram is written once, as it is passed over twice.
    """
    histogram, _ = write_stage(histogram, "histogram")
    ranged = histogram.withColumn("__range", F.floor(F.col("length") / RANGE))
    tokens = (F.col("length") * F.col("docs")).alias("__tokens")
    per_range = ranged.select("*", tokens).groupBy("__range").agg(
        F.sum("docs").alias("__docs"), F.sum("__tokens").alias("__sum")
    )
    after = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    carried = per_range.select(
        "__range",
        F.coalesce(F.sum("__docs").over(after), F.lit(0)).alias("__docs_after"),
        F.coalesce(F.sum("__sum").over(after), F.lit(0)).alias("__sum_after"),
        F.sum("__docs").over(whole).alias("__docs_all"),
        F.sum("__sum").over(whole).alias("tokens_total"),
    )
    inside = Window.partitionBy("__range").orderBy("length").rowsBetween(1, Window.unboundedFollowing)
    longer = F.coalesce(F.sum("docs").over(inside), F.lit(0)) + F.col("__docs_after")
    over = F.coalesce(F.sum("__tokens").over(inside), F.lit(0)) + F.col("__sum_after")
    return (
        ranged.select("*", tokens)
        .join(carried, "__range")
        .select("*", longer.alias("docs_longer"), over.alias("__over"))
        .select(
            F.col("length").alias("context_limit"),
            "docs",
            (F.col("__docs_all") - F.col("docs_longer")).alias("docs_within"),
            "docs_longer",
            "tokens_total",
            (F.col("tokens_total") - F.col("__over") + F.col("length") * F.col("docs_longer")).alias("tokens_kept"),
            (F.col("__over") - F.col("length") * F.col("docs_longer")).alias("tokens_lost"),
            ((F.col("__docs_all") - F.col("docs_longer")) / F.col("__docs_all")).alias("quantile"),
        )
    )


def at_limits(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """Totals at given context limits, one row each: documents over it, tokens kept and lost."""
    parts = []
    for limit in limits:
        cut = F.least(F.col("length"), F.lit(int(limit)))
        parts.append(
            histogram.agg(
                F.lit(int(limit)).cast("long").alias("context_limit"),
                F.coalesce(F.sum(F.when(F.col("length") > limit, F.col("docs"))), F.lit(0)).alias("docs_longer"),
                F.coalesce(F.sum(cut * F.col("docs")), F.lit(0)).alias("tokens_kept"),
                F.coalesce(F.sum((F.col("length") - cut) * F.col("docs")), F.lit(0)).alias("tokens_lost"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def quantiles(limits: DataFrame, shares: Sequence[float]) -> DataFrame:
    """Smallest length that holds each share of the documents, from `every_limit`."""
    return limits.agg(
        *[F.min(F.when(F.col("quantile") >= s, F.col("context_limit"))).alias(f"q{s:g}") for s in shares]
    )
