"""Document fingerprints by winnowing, as DataFrame expressions.

A text is a sequence of tokens. Rolled, as `op2_winnowing` takes them, they are the words of
`[^\\x20\\x09-\\x0D]+` up to eight code points and, in longer ones, the eight code points
from each place on, so that a passage is found wherever it lies in a text without spaces.
Tiled tokens cut longer words every eight code points counted from the word's start: they
are fewer, but a passage in such a word is found only at the same offset modulo eight.

Every run of k tokens is hashed; of each window of w such hashes the smallest is chosen, of
equal ones the rightmost, and its position is kept. Any run of w + k - 1 tokens that two
texts share is therefore seen by at least one hash chosen in both.

Hash and position share one number, the hash above and the position counted down below, so
the smallest number of a window is the choice, and windows are reduced by doubling.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 3
WINDOW_DOUBLINGS = 2  # windows of 2 ** 2 = 4 hashes
TOKEN = r"[^\x20\x09-\x0D]{1,8}"
# Looks ahead from each place: eight code points, or a whole word of fewer (group 1).
ROLLED = r"(?=([^\x20\x09-\x0D]{8}|(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,7}(?![^\x20\x09-\x0D])))[^\x20\x09-\x0D]"
POSITIONS = (1 << 31) - 1
# Ranges of ids per shuffle partition, so that each task gets several.
RANGES = 4


def chosen(tokens: str, k: int = K, doublings: int = WINDOW_DOUBLINGS) -> list[tuple[str, Column]]:
    """Column steps from an array of token hashes to the chosen (hash, position) numbers.

    Fewer than k tokens are one run; fewer hashes than a window are one window; no token
    gives an empty array.
    """
    run = ", ".join(["x"] + [f"get({tokens}, i + {j})" for j in range(1, k)])
    packed = f"shiftleft(xxhash64({run}) & {POSITIONS}L, 31) | ({POSITIONS}L - i)"
    hashes, out = f"__{tokens}_hashes", []
    all_runs = f"transform({tokens}, (x, i) -> {packed})"
    out.append((hashes, F.expr(f"slice({all_runs}, 1, greatest(size({tokens}) - {k - 1}, 1))")))
    last = hashes
    for n in range(doublings):
        name = f"__{tokens}_min{n}"
        out.append((name, F.expr(f"zip_with({last}, slice({last}, {2**n + 1}, greatest(size({last}) - {2**n}, 0)), (a, b) -> least(a, b))")))
        last = name
    whole = f"slice({last}, 1, greatest(size({hashes}) - {2**doublings - 1}, 1))"
    out.append((f"{tokens}_chosen", F.expr(f"array_distinct({whole})")))
    return out


def token_hashes(text: str, rolled: bool = False) -> Column:
    found = (F.lit(ROLLED), F.lit(1)) if rolled else (F.lit(TOKEN), F.lit(0))
    return F.transform(F.regexp_extract_all(F.col(text), *found), lambda t: F.xxhash64(t))


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, doublings: int = WINDOW_DOUBLINGS, rolled: bool = False) -> DataFrame:
    """Adds ``<out>_chosen`` (hash and position in one number each) for a text column."""
    names = df.columns
    df = df.withColumn(out, token_hashes(text, rolled))
    for name, step in chosen(out, k, doublings):
        df = df.withColumn(name, step)
    return df.select(*names, f"{out}_chosen")


def marks(fingerprint: str) -> Column:
    """The chosen hashes and their token positions (from 0) as an array of structs."""
    return F.transform(
        F.col(fingerprint),
        lambda p: F.struct(F.shiftrightunsigned(p, 31).alias("hash"), (F.lit(POSITIONS) - p.bitwiseAND(F.lit(POSITIONS))).alias("position")),
    )


def digest(fingerprint: str) -> Column:
    """128 bits, as hex, of all chosen hashes and positions."""
    halves = [F.lower(F.lpad(F.hex(F.xxhash64(F.lit(salt), F.col(fingerprint))), 16, "0")) for salt in (1, 2)]
    return F.concat(*halves)


def hashes(fingerprint: str) -> Column:
    return F.array_distinct(F.transform(F.col(fingerprint), lambda p: F.shiftrightunsigned(p, 31)))


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two arrays of distinct hashes; two empty ones are alike."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def _cut_ids(df: DataFrame, ranges: int) -> DataFrame:
    """Adds ``__range``: ids fall into about equal ranges, in their order."""
    wanted = [i / ranges for i in range(1, ranges)]
    row = df.agg(F.percentile_approx("__at", wanted, F.lit(20 * ranges)).alias("cuts")).first()
    cuts = sorted({c for c in row["cuts"] or [] if math.isfinite(c)})
    if not cuts:
        return df.withColumn("__range", F.lit(0.0))
    splits = [float("-inf"), *cuts, float("inf")]
    return Bucketizer(splits=splits, inputCol="__at", outputCol="__range", handleInvalid="keep").transform(df)


def beside_next(docs: DataFrame) -> DataFrame:
    """doc_id, text in ranges of ids, each range led by the document before its first.

    Adds ``__range``, ``__own`` (false for the leading copy) and ``__tie``. The first range
    is led by the document with the largest id. A null text is empty; a null id comes before
    all others; equal ids are ordered by a hash of the text.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    at = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    tagged = docs.select("doc_id", text.alias("text"), at.alias("__at"))
    tagged = _cut_ids(tagged, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    # One row per range, and there are as many as the setting says.
    tops = sorted(tagged.groupBy("__range").agg(F.max("__at").alias("top")).collect())
    after = [r["__range"] for r in tops[1:]] + [r["__range"] for r in tops[:1]]
    leads = spark.createDataFrame([(r["top"], a) for r, a in zip(tops, after)], "__top double, __leads double")
    led = tagged.join(F.broadcast(leads), F.col("__at") == F.col("__top"), "left")
    own = F.struct(F.col("__range").alias("range"), F.lit(True).alias("own"))
    lead = F.struct(F.col("__leads").alias("range"), F.lit(False).alias("own"))
    places = F.when(F.col("__leads").isNull(), F.array(own)).otherwise(F.array(own, lead))
    return led.select("doc_id", "text", "__at", F.explode(places).alias("__p")).select(
        "doc_id", "text", "__at", F.col("__p.range").alias("__range"), F.col("__p.own").alias("__own")
    )


def with_edits(docs: DataFrame, k: int = K, doublings: int = WINDOW_DOUBLINGS, rolled: bool = False) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike they and the next one are.

    The edited text has its last half, rounded down, replaced by as many code points from the
    start of the next document by descending doc_id; after the last comes the first. Columns:
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    marks (chosen hashes with token positions). One row per input row. ``rolled`` chooses the tokens.
    """
    along = Window.partitionBy("__range").orderBy("__own", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = (
        beside_next(docs)
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("__next", F.lag("text").over(along))
    )
    rows = with_fingerprint(rows, "text", "own", k, doublings, rolled).withColumn("__hashes", hashes("own_chosen"))
    rows = rows.withColumn("__next_hashes", F.lag("__hashes").over(along)).where("__own")
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int"))
    rows = rows.withColumn("__edited", F.concat(kept, F.substring(F.col("__next"), F.lit(1), half)))
    rows = with_fingerprint(rows, "__edited", "edit", k, doublings, rolled).withColumn("__edit_hashes", hashes("edit_chosen"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("__edited", 256).alias("edited_sha256"),
        digest("own_chosen").alias("fingerprint"),
        digest("edit_chosen").alias("edited_fingerprint"),
        likeness("__hashes", "__edit_hashes").alias("near_edited"),
        likeness("__hashes", "__next_hashes").alias("near_next"),
        marks("own_chosen").alias("marks"),
    )
