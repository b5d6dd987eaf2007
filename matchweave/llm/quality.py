"""Document quality by hierarchical empirical Bayes.

A logistic classifier on what a text looks like gives each document some evidence. Its site
gives more: the share of good documents of a path is drawn toward that of its host, and
that of a host toward the whole corpus, the more the fewer documents it has. How strongly
is itself estimated from how much hosts, and paths within hosts, differ. A document's own
evidence is taken out of its site's, so it does not count twice.

Sites are sums over all documents, taken by grouped aggregation. The classifier is fitted
on at most `linear.SAMPLE` labelled documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchweave.llm.linear import SAMPLE, Cells, fit_logistic, predict, sampled_labels
from matchweave.llm.shared import write_stage
from matchweave.llm.tokens import slices
from matchweave.sources.store import broadcast_if_small

FEATURES = 9
BINS = 10
THRESHOLD = 0.25
# A site's say against that of a document's text; 1 would count both alike.
SITE_WEIGHT = 0.5
# Bounds of the prior's strength in documents.
STRENGTH = (1.0, 1e6)

_UPPER, _DIGIT, _MARK, _BAR, _CALL, _SPACE, _LINE = range(1, 8)


def _byte_kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    for code in range(128):
        c = chr(code)
        if c.isupper():
            kinds[code] = _UPPER
        elif c.isdigit():
            kinds[code] = _DIGIT
        elif c == "|":
            kinds[code] = _BAR
        elif c == "!":
            kinds[code] = _CALL
        elif c == "\n":
            kinds[code] = _LINE
        elif c.isspace():
            kinds[code] = _SPACE
        elif c not in ".,;:'\"()?-" and not c.isalpha():
            kinds[code] = _MARK
    return kinds


KINDS = _byte_kinds()


def features_of(text: str | None) -> list[float]:
    """Numbers that describe a whole text: shares of kinds of characters, and of repetition."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(KINDS[data], minlength=8) / max(len(data), 1)
    words = text.split()
    many = max(len(words), 1)
    threes = set(zip(words, words[1:], words[2:]))
    same = sum(map(str.__eq__, words, words[1:]))
    return [
        kinds[_MARK],
        kinds[_UPPER],
        kinds[_DIGIT],
        kinds[_BAR],
        kinds[_CALL],
        same / many,
        1 - len(threes) / max(len(words) - 2, 1) if len(words) > 2 else 0.0,
        len(text) / many,
        np.log1p(len(words)),
    ]


@dataclass
class Classifier:
    """Features cut into bins at the sample's quantiles, and a weight for each bin."""

    cuts: list[np.ndarray]
    weights: np.ndarray
    share: float

    def binned(self, x: np.ndarray) -> Cells:
        width = BINS + 1
        cols = [i * width + np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(self.cuts)]
        rows = np.tile(np.arange(len(x)), FEATURES)
        return Cells(rows, np.concatenate(cols), (len(x), FEATURES * width))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return predict(self.binned(x), self.weights)


def fit_classifier(x: np.ndarray, y: np.ndarray) -> Classifier:
    shares = np.linspace(0, 1, BINS + 1)[1:-1]
    cuts = [np.unique(np.quantile(x[:, i], shares)) if len(x) else np.zeros(0) for i in range(FEATURES)]
    out = Classifier(cuts, np.zeros(FEATURES * (BINS + 1) + 1), float((y.sum() + 0.5) / (len(y) + 1)))
    out.weights = fit_logistic(out.binned(x), y)
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """A classifier learned from labels (doc_id, quality) of documents (doc_id, text)."""
    chosen = sampled_labels(labels, "quality", sample)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` ids

    def describe(batches):
        for batch in batches:
            for part in slices(batch):
                x = [features_of(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.list_(pa.float64())), part.column(2)], ["doc_id", "x", "label"])

    texts = joined.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("label").cast("long"))
    rows = texts.mapInArrow(describe, "doc_id string, x array<double>, label long")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    x = np.array([r["x"] for r in rows]).reshape(len(rows), FEATURES)
    return fit_classifier(x, np.array([r["label"] for r in rows], float))


def with_evidence(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """The table with ``__p``, the classifier's probability that a text is good."""
    at = docs.columns.index("text")

    def each(batches):
        for batch in batches:
            for part in slices(batch):
                x = np.array([features_of(t) for t in part.column(at).to_pylist()]).reshape(part.num_rows, FEATURES)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(classifier.probability(x))], [*part.schema.names, "__p"])

    schema = ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), "__p double"])
    return docs.mapInArrow(each, schema)


def _log_odds(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p) - F.log(1 - p)


def _strength(groups: DataFrame, good: str, many: str, base: Column) -> float:
    """How many documents the prior of these groups is worth, by the method of moments.

    The spread of the groups' shares around ``base`` beyond that of chance is what the prior
    must allow: the smaller it is, the stronger the prior.
    """
    gap = F.pow(F.col(good) - F.col(many) * base, 2)
    row = groups.where(F.col(many) > 0).agg(
        F.sum(gap).alias("gaps"),
        F.sum(F.col(many) * base * (1 - base)).alias("chance"),
        F.sum(F.col(many) * (F.col(many) - 1) * base * (1 - base)).alias("more"),
    ).first()
    if not row["more"] or row["more"] <= 0:
        return STRENGTH[1]
    likeness = (row["gaps"] - row["chance"]) / row["more"]  # of two documents of a group
    return float(np.clip((1 - likeness) / likeness, *STRENGTH)) if likeness > 0 else STRENGTH[1]


def with_posterior(scored: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """Adds ``__host_share``, ``__path_share`` and ``__posterior`` to a table with ``__p``.

    Paths lie within hosts; a null host or path is one of its own. Shares leave out the row
    itself. Of an empty table nothing follows.
    """
    sums = [F.sum("__p").alias("__good"), F.count(F.lit(1)).alias("__many")]
    paths, _ = write_stage(scored.groupBy(F.col(host).alias("__host"), F.col(path).alias("__path")).agg(*sums), "paths")
    hosts, _ = write_stage(paths.groupBy("__host").agg(F.sum("__good").alias("__host_good"), F.sum("__many").alias("__host_many")), "hosts")
    total = hosts.agg(F.sum("__host_good"), F.sum("__host_many")).first()
    base = float(np.clip((total[0] or 0.0) / (total[1] or 1), 1e-6, 1 - 1e-6))
    of_hosts = _strength(hosts, "__host_good", "__host_many", F.lit(base))
    sites = paths.join(hosts, paths["__host"].eqNullSafe(hosts["__host"])).select(
        paths["__host"], "__path", "__good", "__many", "__host_good", "__host_many"
    )
    host_share = (F.col("__host_good") + of_hosts * base) / (F.col("__host_many") + of_hosts)
    of_paths = _strength(sites, "__good", "__many", host_share)
    sites = broadcast_if_small(sites)
    own_host = (F.col("__host_good") - F.col("__p") + of_hosts * base) / (F.col("__host_many") - 1 + of_hosts)
    own_path = (F.col("__good") - F.col("__p") + of_paths * F.col("__host_share")) / (F.col("__many") - 1 + of_paths)
    same = F.col(f"`{host}`").eqNullSafe(F.col("__host")) & F.col(f"`{path}`").eqNullSafe(F.col("__path"))
    joined = scored.join(sites, same).withColumn("__host_share", own_host).withColumn("__path_share", own_path)
    odds = _log_odds(F.col("__p")) + SITE_WEIGHT * (_log_odds(F.col("__path_share")) - float(np.log(base / (1 - base))))
    return joined.withColumn("__posterior", 1 / (1 + F.exp(-odds))).select(
        *[F.col(f"`{c}`") for c in scored.columns], "__host_share", "__path_share", "__posterior"
    )


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Each document's evidence, site shares, posterior, and whether it is ``kept``.

    Columns: doc_id, p_text, host_share, path_share, posterior, kept. The host is the source,
    the path within it the language. A null or empty text is described by its zero counts.
    """
    rows = docs.select("doc_id", "text", "source", "lang")
    scored, _ = write_stage(with_evidence(rows, fit(rows, labels)).drop("text"), "evidence")
    return with_posterior(scored).select(
        "doc_id",
        F.col("__p").alias("p_text"),
        F.col("__host_share").alias("host_share"),
        F.col("__path_share").alias("path_share"),
        F.col("__posterior").alias("posterior"),
        (F.col("__posterior") >= threshold).alias("kept"),
    )


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose posterior reaches the threshold, with their columns.

    A null or empty text is judged by its zero counts, a null source or language is a site of its
    own, and rows that repeat an id are judged one by one. An empty table gives none.
    """
    scored, _ = write_stage(with_evidence(docs, fit(docs, labels)), "evidence")
    return with_posterior(scored).where(F.col("__posterior") >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
