"""From raw documents to packed sequences: the corpus operators as a pipeline of stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchweave.llm import mixing, packing, quality, simhash, toxicity
from matchweave.llm.shared import columns, small_batches, write_stage

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "toxic", "quality")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier chain, learned from the labels, does not judge toxic."""
    small_batches(spark)
    return toxicity.without_toxic(docs, _labels(spark, sf_dir))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality, by text and site, is good enough."""
    small_batches(spark)
    return quality.good_documents(docs, _labels(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    small_batches(spark)
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: never, once or twice."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents cut and packed into sequences of 2,048 tokens, one row per piece."""
    small_batches(spark)
    return packing.pack_documents(docs, capacity=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again."""
    docs = columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), *DOCUMENT_COLUMNS)
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs, _ = write_stage(docs, name.replace(" ", "_"))
    return docs


# Trained stages have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None
