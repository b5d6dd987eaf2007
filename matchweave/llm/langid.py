"""Language identification by interpolated Kneser-Ney models of characters.

A text becomes a sequence of lower-cased letters, with every run of other characters as one
boundary; it starts and ends with three boundaries. A sequence of four characters is then one
64-bit number, 16 bits for each: the code point itself, and for letters beyond U+FFFF a hash
into the 8,448 numbers that stand for no letter. Shorter sequences are its low bits.

Counts, continuation counts, discounts and back-off weights are grouped aggregations over all
documents. A sequence's log probability is a sum over its ends of one to four characters: what
an end adds where a language knows it, and what backing off from it costs where it is the
context. As a text starts and ends alike, every end is a context once, so both make one weight
for each language and end. The weights are written as sorted arrays, cut into slices by the number
modulo their count; a task reads slices as it needs them and keeps some, so a model of any size
will do, and the driver holds none.

A document gets the language whose model gives the lowest cross-entropy per character. A
second set of models, counted without one fold, scores that fold; how often the winner is
right there, by its margin, turns margins into probabilities.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchweave.llm.shared import drop_stage, write_stage
from matchweave.llm.tokens import slices
from matchweave.sources.store import broadcast_if_small, new_path

ORDER = 4
BITS = 16
ALPHABET = 1 << BITS
# Numbers that no letter of the basic plane has (surrogates, private use), for letters beyond it.
BEYOND, BEYOND_MANY = 0xD800, 0xF900 - 0xD800
FOLDS = 5
HELD_OUT = 0
CALIBRATION = 1
UNKNOWN = "und"
REJECT_BELOW = 0.5
# Characters gathered before equal sequences are counted together.
CODES_AT_ONCE = 4_000_000
# Sequences a counting task holds before it hands them on.
CODES_HELD = 8_000_000
# Rows of a slice of the models (about 20 MB in a task), and how many slices a worker keeps.
SLICE_ROWS = 1_000_000
SLICES_KEPT = 12
# Scores held at a time: sequences of a piece of text times languages.
CELLS = 16_000_000
FULL, PARTIAL = 0, 1


@functools.cache
def letter_classes() -> np.ndarray:
    """Number of each code point below U+10000: that of its lower-case letter, 0 for no letter."""
    classes = np.zeros(1 << 16, np.uint64)
    for code in range(1 << 16):
        if chr(code).isalpha():
            classes[code] = _class_of(chr(code))
    return classes


def _class_of(letter: str) -> int:
    low = letter.lower()[:1]
    return ord(low) if ord(low) < ALPHABET else BEYOND + zlib.crc32(low.encode("utf-8")) % BEYOND_MANY


def codes_of(text: str | None) -> np.ndarray:
    """The numbers of a text's character sequences, the last three for its end; none without a letter."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    classes = letter_classes()[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        letter = chr(points[i])
        classes[i] = _class_of(letter) if letter.isalpha() else 0
    letters = classes != 0
    if not letters.any():
        return np.zeros(0, np.int64)
    last = len(letters) - int(np.argmax(letters[::-1]))
    after = np.concatenate(([False], letters[:-1]))
    ends = np.zeros(ORDER - 1, np.uint64)
    kept = np.concatenate((ends, classes[:last][(letters | after)[:last]], ends))
    out = kept[ORDER - 1 :].copy()
    for back in range(1, ORDER):
        out |= kept[ORDER - 1 - back : len(kept) - back] << np.uint64(BITS * back)
    return out.view(np.int64)


def fold_of(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo the folds; null for a null id."""
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS).cast("int")


def sequence_counts(labelled: DataFrame) -> DataFrame:
    """``lang``, ``calibrating``, ``code``, ``n`` over all texts of a table with these columns."""

    def count(batches):
        held: dict[tuple[str, bool], tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[tuple[str, bool], list[np.ndarray]] = {}
        size = 0

        def settle():
            for key, parts in waiting.items():
                codes, n = np.unique(np.concatenate(parts), return_counts=True)
                if key in held:
                    both, at = np.unique(np.concatenate((held[key][0], codes)), return_inverse=True)
                    codes, n = both, np.bincount(at, np.concatenate((held[key][1], n))).astype(np.int64)
                held[key] = codes, n
            waiting.clear()

        def hand_on():
            for (lang, cal), (codes, n) in held.items():
                many = len(codes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * many), pa.array([cal] * many), pa.array(codes), pa.array(n.astype(np.int64))],
                    ["lang", "calibrating", "code", "n"],
                )
            held.clear()

        for batch in batches:
            for part in slices(batch):
                for lang, cal, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                    codes = codes_of(text)
                    if len(codes):
                        waiting.setdefault((lang, cal), []).append(codes)
                        size += len(codes)
                if size > CODES_AT_ONCE:
                    settle()
                    size = 0
                    if sum(len(codes) for codes, _ in held.values()) > CODES_HELD:
                        yield from hand_on()
        settle()
        yield from hand_on()

    parts = labelled.select("lang", "calibrating", "text").mapInArrow(count, "lang string, calibrating boolean, code long, n long")
    return parts.groupBy("lang", "calibrating", "code").agg(F.sum("n").alias("n"))


def _end(code: str, order: int) -> Column:
    """The last ``order`` characters of a sequence."""
    return F.col(code).bitwiseAND(F.lit((1 << (BITS * order)) - 1)) if order < ORDER else F.col(code)


def gram_counts(counts: DataFrame) -> DataFrame:
    """``model``, ``order``, ``lang``, ``code``, ``n``: occurrences for the longest sequences and, for
    shorter ones, how many characters come before them. The partial model leaves the calibrating fold out."""
    models = F.when(F.col("calibrating"), F.array(F.lit(FULL))).otherwise(F.array(F.lit(FULL), F.lit(PARTIAL)))
    level = counts.select(F.explode(models).alias("model"), "lang", "code", "n")
    level = level.groupBy("model", "lang", "code").agg(F.sum("n").alias("n"))
    out = level.withColumn("order", F.lit(ORDER))
    for order in range(ORDER - 1, 0, -1):
        level = level.groupBy("model", "lang", _end("code", order).alias("code")).agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(level.withColumn("order", F.lit(order)))
    return out


def _discounted(grams: DataFrame) -> DataFrame:
    """Adds to every sequence its own share after its context, and the ``weight`` left for shorter ones."""
    ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
    kinds = grams.groupBy("model", "lang", "order").agg(
        F.when((ones > 0) & (twos > 0), ones / (ones + 2 * twos)).otherwise(F.lit(0.5)).alias("discount")
    )
    # No context has more followers than the alphabet has characters, so no group is larger.
    same = Window.partitionBy("model", "lang", "order", "context")
    total = F.sum("n").over(same)
    return (
        grams.join(broadcast_if_small(kinds), ["model", "lang", "order"])
        .withColumn("context", F.shiftrightunsigned("code", BITS))
        .withColumn("weight", F.col("discount") * F.count(F.lit(1)).over(same) / total)
        .withColumn("own", F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / total)
        .select("model", "order", "lang", "code", "context", "own", "weight")
    )


def end_weights(shares: DataFrame) -> DataFrame:
    """``model``, ``order``, ``lang``, ``code``, ``weight``: what each end of a sequence adds to its log probability.

    An end that a language knows adds log p, less the back-off of its context and the log p of the
    next shorter end, which the sum has already; as a context it adds the log of its back-off.
    Order 0 is the empty context, which every character has once.
    """
    of_context = F.max(F.log("weight")).alias("weight")
    out = shares.groupBy("model", (F.col("order") - 1).alias("order"), "lang", F.col("context").alias("code")).agg(of_context)
    lower = None
    for order in range(1, ORDER + 1):
        level = shares.where(F.col("order") == order).withColumn("end", _end("code", order - 1) if order > 1 else F.lit(0).cast("long"))
        if lower is None:
            level = level.withColumn("lower", F.lit(1.0 / ALPHABET))
        else:
            level = level.join(lower, ["model", "lang", "end"])
        level = level.withColumn("p", F.col("own") + F.col("weight") * F.col("lower"))
        added = F.log("p") - F.log("weight") - F.log("lower")
        out = out.unionByName(level.select("model", "order", "lang", "code", added.alias("weight")))
        lower = level.select("model", "lang", F.col("code").alias("end"), F.col("p").alias("lower"))
    return out.groupBy("model", "order", "lang", "code").agg(F.sum("weight").alias("weight"))


class Models:
    """The written models of one set of languages: where their slices lie, and their names.

    The driver knows one number for each language; tasks read the slices.
    """

    def __init__(self, folder: str, model: int, many: int, names: list[str], start: list[float]):
        self.folder, self.model, self.many = folder, model, many
        self.langs, self.start = names, np.array(start) - math.log(ALPHABET)

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of each sequence (rows) under each language (columns), but for its order 0."""
        out = np.zeros((len(codes), len(self.langs)), np.float32)
        flat = out.reshape(-1)
        for number in range(self.many):
            held = _slice_of(self.folder, self.model, number, tuple(self.langs))
            for order, (names, start, lang, weight) in held.items():
                ends = codes if order == ORDER else codes & ((1 << (BITS * order)) - 1)
                rows = np.flatnonzero(ends % self.many == number) if self.many > 1 else np.arange(len(ends))
                at = np.minimum(np.searchsorted(names, ends[rows]), len(names) - 1)
                known = names[at] == ends[rows]
                rows, at = rows[known], at[known]
                each = start[at + 1] - start[at]
                entry = np.repeat(start[at] - (np.cumsum(each) - each), each) + np.arange(each.sum())
                flat[np.repeat(rows, each) * len(self.langs) + lang[entry]] += weight[entry]
        return out

    def entropies(self, texts: list[np.ndarray]) -> np.ndarray:
        """Cross-entropy per character of each text (rows) under each language (columns)."""
        lengths = np.array([len(t) for t in texts])
        out = np.zeros((len(texts), len(self.langs)))
        if not lengths.sum() or not self.langs:
            return out
        codes = np.concatenate(texts)
        text = np.repeat(np.arange(len(texts)), lengths)
        size = max(1000, CELLS // len(self.langs))
        for first in range(0, len(codes), size):
            distinct, at = np.unique(codes[first : first + size], return_inverse=True)
            inside = text[first : first + size]
            starts = np.flatnonzero(np.concatenate(([True], inside[1:] != inside[:-1])))
            out[inside[starts]] += np.add.reduceat(self.scores(distinct)[at], starts, axis=0, dtype=np.float64)
        filled = lengths > 0
        out[filled] = -out[filled] / lengths[filled, None] - self.start
        return out


@functools.lru_cache(maxsize=SLICES_KEPT)
def _slice_of(folder: str, model: int, number: int, langs: tuple[str, ...]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each order: sorted sequences, where the weights of each start, their languages and values."""
    store, path = fs.FileSystem.from_uri(f"{folder}/model={model}/slice={number}")
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return {}
    rows = pq.read_table(path, filesystem=store, partitioning=None, columns=["order", "code", "lang", "weight"])
    lang = pc.index_in(rows["lang"], value_set=pa.array(langs, pa.string())).to_numpy()
    orders, codes, weight = (rows[c].to_numpy() for c in ("order", "code", "weight"))
    out = {}
    for order in range(1, ORDER + 1):
        mine = np.flatnonzero(orders == order)
        if len(mine):
            mine = mine[np.argsort(codes[mine], kind="stable")]
            names, start = np.unique(codes[mine], return_index=True)
            out[order] = names, np.append(start, len(mine)), lang[mine].astype(np.int64), weight[mine].astype(np.float32)
    return out


def fit_models(counts: DataFrame) -> tuple[Models, Models]:
    """Full and partial models from ``sequence_counts``, written in slices by sequence modulo their number."""
    spark = counts.sparkSession
    grams, grams_path = write_stage(gram_counts(counts), "grams")
    many = max(1, grams.count() // SLICE_ROWS) | 1
    shares, shares_path = write_stage(_discounted(grams), "shares")
    folder = new_path(spark, "models")
    weights = end_weights(shares).withColumn("slice", F.pmod("code", F.lit(many)))
    placed = weights.repartition("model", "slice").sortWithinPartitions("model", "slice", "order", "code")
    placed.write.partitionBy("model", "slice").parquet(folder)
    # One row for each language and model.
    starts = shares.where((F.col("order") == 1)).groupBy("model", "lang").agg(F.max(F.log("weight")).alias("start")).collect()
    drop_stage(spark, grams_path, shares_path)
    of = {m: sorted((r["lang"], r["start"]) for r in starts if r["model"] == m) for m in (FULL, PARTIAL)}
    full, partial = (Models(folder, m, many, [x for x, _ in of[m]], [y for _, y in of[m]]) for m in (FULL, PARTIAL))
    return full, partial


def _evidence(entropies: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How much better the best language explains a whole text than the second, in logs of nats."""
    if entropies.shape[1] > 1:
        two = np.partition(entropies, 1, axis=1)[:, :2]
        margin = two[:, 1] - two[:, 0]
    else:
        margin = np.maximum(math.log(ALPHABET) - entropies[:, 0], 0)
    return np.log1p(np.maximum(margin, 0) * lengths)


def _score(docs: DataFrame, models: Models, curve: tuple[float, float], extra: str, kinds: str) -> DataFrame:
    """Adds lang_pred, evidence and score to the columns ``extra`` (names) of a table with text."""
    names = extra.split()

    def score(batches):
        langs = np.array(models.langs or [UNKNOWN], object)
        for batch in batches:
            for part in slices(batch):
                texts = [codes_of(t) for t in part.column(part.num_columns - 1).to_pylist()]
                lengths = np.array([len(t) for t in texts])
                known = (lengths > 0) & bool(models.langs)
                entropies = models.entropies(texts) if models.langs else np.zeros((len(texts), 1))
                evidence = np.where(known, _evidence(entropies, lengths), 0.0)
                p = np.where(known, 1 / (1 + np.exp(-(curve[0] + curve[1] * evidence))), 0.0)
                best = np.where(known, langs[np.argmin(entropies, axis=1)], UNKNOWN)
                own = [part.column(i) for i in range(len(names))]
                arrays = [*own, pa.array(best.tolist(), pa.string()), pa.array(evidence), pa.array(p)]
                yield pa.RecordBatch.from_arrays(arrays, [*names, "lang_pred", "evidence", "score"])

    return docs.select(*names, "text").mapInArrow(score, f"{kinds}, lang_pred string, evidence double, score double")


def _curve(scored: DataFrame) -> tuple[float, float]:
    """Logistic curve from evidence to the share of right predictions, fitted on binned counts."""
    width = 0.05
    bins = (
        scored.where(F.col("lang_pred") != UNKNOWN)
        .groupBy(F.floor(F.col("evidence") / width).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang_pred") == F.col("lang")).alias("right"))
        .collect()
    )
    # One right and one wrong prediction without evidence, and one right with much, as a prior.
    x = np.array([(r["bin"] + 0.5) * width for r in bins] + [0.0, 8.0])
    n = np.array([r["n"] for r in bins] + [2.0, 1.0])
    right = np.array([r["right"] for r in bins] + [1.0, 1.0])
    a = b = 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = np.maximum(n * p * (1 - p), 1e-9)
        gradient = np.array([(right - n * p).sum() - 1e-3 * a, ((right - n * p) * x).sum() - 1e-3 * b])
        curvature = np.array([[w.sum() + 1e-3, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-3]])
        step = np.linalg.solve(curvature, gradient)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
        if abs(step).max() < 1e-8:
            break
    return a, max(b, 0.0)


def identify(docs: DataFrame) -> DataFrame:
    """The language of every document, learned from those whose fold is not held out.

    Columns: doc_id, held_out, lang_pred, score (probability that it is right) and accepted
    (score at least ``REJECT_BELOW``). A text that is null or has no letter, or any text where
    nothing could be learned, gets ``und`` with score 0. Rows with a null doc_id are not
    learned from and count as held out; equal rows are treated alike. The true language,
    the source and the id are not inputs of a prediction.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", "lang", fold_of().alias("fold"))
    learned = rows.where((F.col("fold") != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    tagged = learned.withColumn("calibrating", F.col("fold") == CALIBRATION)
    counts, _ = write_stage(sequence_counts(tagged), "sequences")
    full, partial = fit_models(counts)
    curve = _curve(_score(learned.where(F.col("fold") == CALIBRATION), partial, (0.0, 1.0), "lang", "lang string"))
    asked = rows.withColumn("held_out", F.coalesce(F.col("fold") == HELD_OUT, F.lit(True)))
    scored = _score(asked, full, curve, "doc_id held_out", f"doc_id {kind}, held_out boolean")
    return scored.select("doc_id", "held_out", "lang_pred", "score", (F.col("score") >= REJECT_BELOW).alias("accepted"))
