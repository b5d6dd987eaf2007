"""Near copies: texts whose sets of five-word shingles have a Jaccard likeness of 0.8 or more.

Candidates meet by MinHash: 64 least hashes in 16 bands of four, so that two texts at 0.8
share a band with a probability of 0.9998, and more alike ones more surely. Texts that share
a band link only if the likeness of their whole sets, not of their least hashes, is enough.

Texts with equal sets are one text here. What shares a band is compared as in `jaccard`: with
the first of the bucket, then only between classes, and the sets of a bucket with too many such
pairs are indexed by prefixes of their rarest shingles, of which linked sets share one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchweave.llm import jaccard
from matchweave.llm.shared import drop_stage, release, write_stage
from matchweave.llm.shingling import shingles
from matchweave.llm.tokens import slices
from matchweave.sources.store import broadcast_if_small

THRESHOLD = (80, 100)
SHINGLE = 5
SEED = 43
BANDS = 16
BAND_ROWS = 4
# Shingles whose least hashes are looked for at a time.
HASHES_AT_ONCE = 1 << 12

_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64)
_MIXER = np.uint64(0x9E3779B97F4A7C15)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One number per band from the least hashes of a set that is not empty."""
    least = np.full(BANDS * BAND_ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        block = hashes[at : at + HASHES_AT_ONCE, None] * _FACTORS + _SHIFTS
        least = np.minimum(least, block.min(axis=0))
    rows = least.reshape(BANDS, BAND_ROWS)
    keys = rows[:, 0].copy()
    for n in range(1, BAND_ROWS):
        keys = (keys ^ (keys >> np.uint64(31))) * _MIXER + rows[:, n]
    # Keys of different bands differ.
    return (keys ^ np.arange(BANDS, dtype=np.uint64)) * _MIXER + np.arange(BANDS, dtype=np.uint64)


def _signatures(numbered: DataFrame, fingerprint: Callable[[np.ndarray], int]) -> DataFrame:
    """``__row``, a hash of the text, and of its set a digest (128 bits), the size, fingerprint, band keys and sketch."""

    def each(batches):
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t, SHINGLE) for t in part.column(2).to_pylist()]
                arrays = [
                    *part.columns[:2],
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64)),
                    pa.array([band_keys(s).view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                    pa.array([jaccard.parities(s) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["__row", "text_hash", "digest", "size", "fp", "keys", "sketch"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    given = numbered.select("__row", F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    kinds = "__row long, text_hash long, digest binary, size long, fp long, keys array<long>, sketch array<long>"
    return given.mapInArrow(each, kinds)


def _pairs_of(reps: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets: one of each of two linked fingerprints, and of one fingerprint each with the first."""
    ends = reps.groupBy("fp").agg(F.min("rep").alias("end"))
    of_a, of_b = ends.select(F.col("fp").alias("a"), F.col("end").alias("x")), ends.select(F.col("fp").alias("b"), F.col("end").alias("y"))
    across = links.join(of_a, "a").join(of_b, "b").select("x", "y")
    equal = reps.select("fp", "rep").join(ends, "fp").where("rep <> end").select("rep", "end")
    return across.unionByName(equal.toDF("x", "y")).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def row_classes(numbered: DataFrame, fingerprint: Callable[[np.ndarray], int], near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``__row``, ``root``: for each row of a written table with text, the class of its near copies.

    Classes are connected by likeness of 0.8 or more. Texts without any word are one class.
    ``near`` gives links between distinct ``fp``, a column of what ``fingerprint`` makes of sets; the
    sets of linked fingerprints are compared and linked before the bands.
    """
    spark = numbered.sparkSession
    signed, signed_path = write_stage(_signatures(numbered, fingerprint), "signatures")
    first, first_path = write_stage(signed.groupBy("digest").agg(F.min("__row").alias("rep")), "firsts")
    chosen = signed.join(broadcast_if_small(first.select("rep")), F.col("__row") == F.col("rep"))
    reps, reps_path = write_stage(chosen.select("rep", F.col("__row").alias("rep_id"), "text_hash", "size", "fp", "keys", "sketch"), "reps")
    ids, _ = write_stage(signed.select("__row", "digest").join(broadcast_if_small(first), "digest").select("__row", "rep"), "row_reps")
    drop_stage(spark, signed_path, first_path)
    docs = numbered.select(F.col("__row").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    join = jaccard.Join(docs, reps, SHINGLE, jaccard.Bands(THRESHOLD))
    with_words = reps.where("size > 0")
    links, links_path = write_stage(near(with_words.select("fp").distinct()), "fingerprint_links")
    release(spark)
    join.add(join.verified(_pairs_of(with_words, links)))
    found = join.run(reps.select(
        F.explode("keys").alias("key"), F.lit(jaccard.ANY_BAND).alias("band"), F.lit(0).cast("long").alias("slot"), "rep", "size", F.lit(0).cast("long").alias("at")
    ), prefixes=False)
    drop_stage(spark, reps_path, links_path)
    rooted = ids.join(broadcast_if_small(found), F.col("rep") == F.col("node"), "left")
    return rooted.select("__row", F.coalesce("root", "rep").alias("root"))
