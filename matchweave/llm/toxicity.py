"""Toxic documents by a chain of linear classifiers.

Toxicity has categories, predicted one after another. The model of a category sees which
words and beginnings of words of a learned vocabulary a text holds, and the probabilities of
the categories before it. In fitting, those probabilities come from models that did not see the document, as they
will in use. The last category is toxicity itself.

The models are fitted on at most `linear.SAMPLE` labelled documents; all documents are
scored, whole.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchweave.llm.linear import SAMPLE, Cells, fit_logistic, predict, sampled_labels
from matchweave.llm.shared import write_stage
from matchweave.llm.tokens import slices

LETTERS = re.compile(r"[^\W\d_]+")
VOCABULARY = 1024
# Letters of the beginnings of longer words.
BEGINNINGS = (4, 5)
LEAST_DOCS = 5
LEAST_Z = 5.5
LEAST_ODDS = 4.0
FOLDS = 3
# The vocabulary is already small; a stronger penalty would let no word decide alone.
SPARSE = 1e-6
RIDGE = 1e-6
STEPS = 600
THRESHOLD = 0.5
# Words that mark the weak labels of the categories before the last. A labelled
# toxic document belongs to a category if it holds one of its words.
CATEGORIES = {
    "insult": ("idiot", "moron", "stupid", "clown", "loser", "fool", "dumb"),
    "contempt": ("trash", "worthless", "scum", "pathetic", "disgusting", "vile", "garbage"),
}
TOXIC = "toxic"
# Intercept of a model that finds nothing.
NEVER = -50.0


def words_of(text: str | None) -> set[str]:
    """Distinct lower-cased runs of letters, and beginnings of the longer ones, marked by a hyphen."""
    words = set(LETTERS.findall((text or "").lower()))
    begins = {f"{w[:n]}-" for n in BEGINNINGS for w in words if len(w) > n}
    return words | begins


def _marked(sample: DataFrame, categories: dict[str, Sequence[str]]) -> DataFrame:
    """``words`` and 0/1 ``marks``, one for each category and toxicity last, of each sampled text."""

    def mark(batches):
        for batch in batches:
            for part in slices(batch):
                labels = part.column(0).to_pylist()
                words = [words_of(t) for t in part.column(1).to_pylist()]
                marks = [
                    [int(bool(label) and not held.isdisjoint(c)) for c in categories.values()] + [int(label)]
                    for label, held in zip(labels, words)
                ]
                arrays = [part.column(2), pa.array([sorted(w) for w in words], pa.list_(pa.string())), pa.array(marks, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "words", "marks"])

    chosen = sample.select("label", F.col("text").cast("string").alias("text"), F.col("doc_id").cast("string").alias("doc_id"))
    return chosen.mapInArrow(mark, "doc_id string, words array<string>, marks array<long>")


def _numbered(marked: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``held``, the places in the vocabulary of the words that a text holds, and its ``marks``."""
    names = pa.array(vocabulary, pa.string())

    def number(batches):
        for batch in batches:
            words = batch.column(0)
            places = pc.index_in(words.flatten(), value_set=names)
            known = np.asarray(places.is_valid())
            rows = np.repeat(np.arange(len(words)), np.asarray(words.value_lengths()))[known]
            ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(words))))).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(ends), places.drop_null())
            yield pa.RecordBatch.from_arrays([held, batch.column(1)], ["held", "marks"])

    return marked.select("words", "marks").mapInArrow(number, "held array<int>, marks array<long>")


def _vocabulary(marked: DataFrame) -> list[str]:
    """Words that toxic documents of the sample hold significantly and many times more often.

    At most ``VOCABULARY`` of them. Only toxicity chooses: the weak labels of the categories
    before it also go along with the language, whose common words say nothing of toxicity.
    """
    toxic = F.element_at("marks", -1)
    totals = marked.agg(F.count(F.lit(1)).alias("n"), F.sum(toxic).alias("toxic")).first()
    inside, all_docs = float(totals["toxic"] or 0), float(totals["n"] or 0)
    if not 0 < inside < all_docs:
        return []
    counts = marked.select(F.explode("words").alias("word"), toxic.alias("toxic")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("m")
    )
    share = F.col("n") / all_docs
    spread = F.sqrt(inside * share * (1 - share) * (1 - inside / all_docs) + 1e-9)
    odds = (F.col("m") + 0.5) / (F.col("n") - F.col("m") + 0.5) / ((inside + 0.5) / (all_docs - inside + 0.5))
    rows = counts.where(F.col("n") >= LEAST_DOCS).select("word", ((F.col("m") - inside * share) / spread).alias("z"), odds.alias("odds"))
    rows = rows.where((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS))
    return [r["word"] for r in rows.orderBy(F.desc("z"), "word").limit(VOCABULARY).collect()]


@dataclass
class Chain:
    """Fitted models of the categories in their order, over the presence of vocabulary words."""

    categories: list[str]
    vocabulary: dict[str, int]
    weights: list[np.ndarray]

    def features(self, texts: Sequence[str | None]) -> Cells:
        held = [[self.vocabulary[w] for w in words_of(t) & self.vocabulary.keys()] for t in texts]
        return cells(held, len(self.vocabulary))

    def probabilities(self, texts: Sequence[str | None]) -> np.ndarray:
        """One column per category."""
        x = self.features(texts)
        for weights in self.weights:
            x = x.with_column(predict(x, weights))
        return x.dense


def cells(held: Sequence[Sequence[int]], width: int) -> Cells:
    rows = np.repeat(np.arange(len(held)), [len(h) for h in held])
    cols = np.array([c for h in held for c in h], np.int64)
    return Cells(rows, cols, (len(held), width))


def cells_of(held: pa.ListArray, width: int) -> Cells:
    rows = np.repeat(np.arange(len(held)), np.asarray(held.value_lengths()))
    return Cells(rows, np.asarray(held.flatten()).astype(np.int64), (len(held), width))


def fit_chain(x: Cells, marks: np.ndarray, folds: int = FOLDS) -> list[np.ndarray]:
    """Weights of each category's model; earlier categories enter by out-of-fold probabilities."""
    out, fold = [], np.arange(x.shape[0]) % folds
    for i in range(marks.shape[1]):
        y = marks[:, i].astype(float)
        beyond = np.zeros(x.shape[0])
        for f in range(folds):
            seen = fold != f
            beyond[~seen] = predict(x.some(~seen), fit_logistic(x.some(seen), y[seen], SPARSE, RIDGE, STEPS))
        out.append(fit_logistic(x, y, SPARSE, RIDGE, STEPS))
        x = x.with_column(beyond)
    return out


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Sequence[str]] | None = None, sample: int = SAMPLE) -> Chain:
    """A chain learned from labels (doc_id, toxic) of documents (doc_id, text).

    Without labelled documents of both classes nothing tells them apart: no document is toxic.
    """
    categories = CATEGORIES if categories is None else categories
    chosen = sampled_labels(labels, TOXIC, sample)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` ids
    marked, _ = write_stage(_marked(joined, categories), "marked")
    names = [*categories, TOXIC]
    vocabulary = {w: i for i, w in enumerate(_vocabulary(marked))}
    # A repeated id brings all its rows, so the bound is set again on what comes to the driver.
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = _numbered(chosen, list(vocabulary)).toArrow()
    x = cells_of(rows.column("held").combine_chunks(), len(vocabulary))
    marks = np.array(rows.column("marks").to_pylist(), int).reshape(rows.num_rows, len(names))
    if len(set(marks[:, -1].tolist())) < 2:
        return Chain(names, {}, [np.append(np.zeros(i), NEVER) for i in range(len(names))])
    return Chain(names, vocabulary, fit_chain(x, marks))


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """The table with ``p_<category>`` for each category, in place of columns of that name."""
    added = [f"p_{c}" for c in chain.categories]
    kept = docs.select(*[c for c in docs.columns if c not in added])
    at = kept.columns.index("text")

    def each(batches):
        for batch in batches:
            for part in slices(batch):
                p = chain.probabilities(part.column(at).to_pylist())
                arrays = [*part.columns, *[pa.array(p[:, i]) for i in range(len(added))]]
                yield pa.RecordBatch.from_arrays(arrays, [*part.schema.names, *added])

    schema = ", ".join([*(f"`{n}` {t}" for n, t in kept.dtypes), *(f"{a} double" for a in added)])
    return kept.mapInArrow(each, schema)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the probability of each category, and ``toxic``; one row per document.

    A null or empty text has no word and gets the probabilities of such texts.
    """
    rows = docs.select("doc_id", "text")
    scored = score(rows, fit(rows, labels)).drop("text")
    return scored.withColumn("toxic", F.col(f"p_{TOXIC}") >= threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not judged toxic, with their columns, whatever those are called.

    A null or empty text has no word and is judged by that; rows that repeat an id are judged one
    by one, and a probability equal to the threshold is toxic. Without labels of both classes
    every document stays; an empty table gives none.
    """
    chain = fit(docs, labels)
    names = docs.columns
    own = {c: f"__own_{i}" for i, c in enumerate(names) if c != "text"}
    scored = score(docs.withColumnsRenamed(own), chain).where(F.col(f"p_{TOXIC}") < threshold)
    return scored.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in names])
