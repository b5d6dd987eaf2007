"""Exact nearest neighbours by inner product, with branch and bound over dimension blocks.

Queries and candidates are dealt into cells of bounded size; every pair of a query block and
a candidate block is one cell. Inside a cell candidates lie dimension by dimension. Scores
grow block by block of dimensions; after each, what the dimensions left can still add is
bounded by the lengths of the remaining parts, and candidates that can no longer reach the
k-th best are dropped from the arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchweave.llm.shared import group_count, write_stage

SCALE = 256
K = 5
# Rows of a cell at most, about: hashing deals them out.
CANDIDATES = 8192
QUERIES = 2048
# Dimensions added at a time.
STEP = 8
LONG = (1 << 63) - 1


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, embedding as doubles, row (its number), of rows that take part.

    Rows with a null id or vector, or a null or non-finite component, are left out. Rows that
    repeat an id are rows of their own. Shorter vectors count as ended by zeros.
    """
    x = F.col(embedding).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), x.alias("embedding")).where(F.col("vec_id").isNotNull())
    kept = rows.where(F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    return kept.withColumn("row", F.monotonically_increasing_id())


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """floor(256 x) of list rows as a (width, rows) matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths(), np.int64)
    out = np.zeros((len(lengths), width))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    places = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows, places] = np.floor(SCALE * np.asarray(column.flatten(), np.float64))
    return np.ascontiguousarray(out.T)


def best_of(
    queries: np.ndarray, query_rows: np.ndarray, cands: np.ndarray, cand_ids: np.ndarray, k: int = K, step: int = STEP, cand_rows: np.ndarray | None = None
):
    """(query, candidate, score) positions and values of each query's k best candidates.

    Matrices are (dimensions, rows) of integral doubles; candidates come by rising id.
    Equal scores go to the smaller id; a query's own row (by its number, or by its id where no
    numbers are given) is not a candidate.
    """
    cand_rows = cand_ids if cand_rows is None else cand_rows
    dims = len(cands)
    largest = np.abs(queries).max(initial=0.0) * np.abs(cands).max(initial=0.0) * max(dims, 1)
    if largest >= 2.0**52:
        yield from _best_of_large(queries, query_rows, cands, cand_ids, k, cand_rows)
        return
    cuts = list(range(0, dims, step))
    # Length of the part of each vector from a cut on, rounded up.
    rest = lambda m: [np.sqrt((m[c:] ** 2).sum(axis=0)) * (1 + 1e-9) for c in [*cuts[1:], dims]]
    q_rest, c_rest = rest(queries), rest(cands)
    for q in range(queries.shape[1]):
        live = np.flatnonzero(cand_rows != query_rows[q])
        score, block = np.zeros(len(live)), cands
        block_live = None if len(live) == cands.shape[1] else live
        for n, cut in enumerate(cuts):
            part = block[cut : cut + step]
            part = part if block_live is None else part[:, block_live]
            score = score + queries[cut : cut + step, q] @ part
            if len(live) <= k or n == len(cuts) - 1:
                continue
            left = q_rest[n][q] * c_rest[n][live]
            floor = np.partition(score - left, len(live) - k)[len(live) - k]
            keep = score + left >= floor - 1e-6 * (1 + abs(floor))
            if keep.sum() < 0.8 * len(live):
                live, score = live[keep], score[keep]
                block_live = live
        order = np.lexsort((cand_ids[live], -score))[:k]
        for i in order:
            yield q, int(live[i]), int(score[i])


def _best_of_large(queries, query_rows, cands, cand_ids, k, cand_rows):
    """The same with unbounded integers, for components too large for exact doubles."""
    whole = [[int(x) for x in row] for row in cands.T]
    for q in range(queries.shape[1]):
        own = [int(x) for x in queries[:, q]]
        scores = [
            (-max(-LONG, min(LONG, sum(a * b for a, b in zip(own, row)))), int(cand_ids[i]), i)
            for i, row in enumerate(whole)
            if cand_rows[i] != query_rows[q]
        ]
        for score, _, i in sorted(scores)[:k]:
            yield q, i, -score


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, step: int = STEP) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best candidates of each query.

    Both tables have vec_id, embedding and row (unique) as `usable` gives them.
    Scores beyond a long stop at its limits. Fewer candidates than k are all returned.
    """
    slots = group_count(candidates.count(), CANDIDATES)
    blocks = group_count(queries.count(), QUERIES)
    slot = F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(slots))
    block = F.pmod(F.xxhash64(F.lit(2), "row"), F.lit(blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = candidates.select("vec_id", "row", "embedding", slot.alias("slot"), every(blocks).alias("block"))
    q = queries.select("vec_id", "row", "embedding", block.alias("block"), every(slots).alias("slot"))
    cell = (F.col("slot") * F.lit(blocks) + F.col("block")).alias("cell")

    names = ("query_row", "row", "query_id", "vec_id", "score")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * len(names), list(names))
        left = left.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        width = max([0, *(int(np.max(np.asarray(t.column("embedding").combine_chunks().value_lengths()), initial=0)) for t in (left, right))])
        ids, asked = np.asarray(left.column("vec_id")), np.asarray(right.column("vec_id"))
        rows, own = np.asarray(left.column("row")), np.asarray(right.column("row"))
        found = list(best_of(_matrix(right.column("embedding"), width), own, _matrix(left.column("embedding"), width), ids, k, step, rows))
        qi, ci, score = (np.array(x, np.int64) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
        return pa.table({"query_row": pa.array(own[qi], pa.int64()), "row": pa.array(rows[ci], pa.int64()), "query_id": pa.array(asked[qi], pa.int64()), "vec_id": pa.array(ids[ci], pa.int64()), "score": pa.array(score, pa.int64())})

    cells = c.select(cell, "vec_id", "row", "embedding").groupBy("cell")
    met = cells.cogroup(q.select(cell, "vec_id", "row", "embedding").groupBy("cell")).applyInArrow(
        search, "query_row long, row long, query_id long, vec_id long, score long"
    )
    ranked = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return met.withColumn("rank", ranked).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_of_every(vectors: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """The k best of all other rows for each row whose id is divisible by ``every``.

    Which rows take part, and what repeated ids, nulls and short vectors mean: `usable`. Equal
    scores go to the smaller id, then to the earlier row. An empty table gives no row.
    """
    rows, _ = write_stage(usable(vectors), "vectors")
    return top_k(rows.where(F.col("vec_id") % every == 0), rows, k)
