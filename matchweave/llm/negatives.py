"""Hard negatives from vectors: candidates in blocks along a Hilbert curve, chosen by zone maps.

Vectors are ordered along a Hilbert curve through their main axes and written as Parquet in
that order. ``BLOCK`` rows are a block, up to 64 blocks a shelf. A zone map holds the least and
largest component of a block in every dimension, and its least and largest label. By interval
arithmetic it bounds the inner products of an anchor with all rows of the block, so an anchor
reads only blocks that can hold what one of its windows still lacks.

An anchor first reads its own shelf. What it finds there is a floor: a block whose upper bound
lies below it holds nothing better. So it goes twice for its positives, and twice for the
negatives in the windows that the positives open. Blocks stay where they are; anchors are sent
to the shelves they chose, with one bit for each of its blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchweave.llm.hilbert import places
from matchweave.llm.shared import group_count, write_stage
from matchweave.sources.store import broadcast_if_small, split_hot_joins

SCALE = 256
BLOCK = 256
SHELF_BLOCKS = 64
# Axes of the curve and bits of each; they are found in this many rows with the least hashes.
AXES = 8
AXIS_BITS = 7
SAMPLE = 2048
# Anchors and shelves whose bounds one task computes, and anchors scored at a time.
ANCHORS = 1024
SHELVES = 128
AT_ONCE = 64
EXACT = 2.0**52
LONG = (1 << 63) - 1
POSITIVES = 5
NEGATIVES = 5

_ASKED = "a long, vec_id long, label long, x array<double>, windows array<long>, floors array<long>"
_FOUND = "a long, w int, vec_id long, row long, score long"


def usable(vectors: DataFrame) -> DataFrame:
    """row, vec_id, label, x (components times 256, floored) of the rows that take part.

    Rows with a null id, label or vector, or a null or non-finite component, are left out. Rows
    that repeat an id are rows of their own. Shorter vectors count as ended by zeros. Where an
    id is divisible by 7 the label becomes the next of ten.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    label = F.col("label").cast("long")
    # From 2 ** 53 on a double is whole; floor gives a long, which ends before doubles do.
    whole = lambda v: F.when(F.abs(v * SCALE) < 2.0**53, F.floor(v * SCALE).cast("double")).otherwise(v * SCALE)
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % 7 == 0, F.pmod(label + 1, F.lit(10))).otherwise(label).alias("label"),
        F.when(F.coalesce(finite, F.lit(False)), F.transform(x, whole)).alias("x"),
    )
    return rows.where("vec_id is not null and label is not null and x is not null")


def _matrix(column, width: int = 0) -> np.ndarray:
    """Rows of lists as a matrix, shorter ones ended by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lens = np.asarray(column.value_lengths(), np.int64)
    out = np.zeros((len(lens), max(width, int(lens.max(initial=0)))))
    row = np.repeat(np.arange(len(lens)), lens)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)] = np.asarray(column.flatten(), np.float64)
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of integral rows: longs, or objects where they are too large for that."""
    anchors, rows = _same_width(anchors, rows)
    if not anchors.size or not rows.size:
        return np.zeros((len(anchors), len(rows)), np.int64)
    if np.abs(anchors).max() * np.abs(rows).max() * anchors.shape[1] < EXACT:
        return (anchors @ rows.T).astype(np.int64)
    whole = lambda m: [[int(v) for v in r] for r in m]
    out = np.empty((len(anchors), len(rows)), object)
    mine, theirs = whole(anchors), whole(rows)
    for i, p in enumerate(mine):
        for j, q in enumerate(theirs):
            out[i, j] = sum(a * b for a, b in zip(p, q))
    return out


def best(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[int]:
    """Positions of the k highest scores, ties by smaller id and then row."""
    if score.dtype == object:
        return sorted(range(len(score)), key=lambda i: (-score[i], ids[i], rows[i]))[:k]
    at = np.arange(len(score))
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((rows[at], ids[at], -score[at]))[:k]].tolist()


def _axes(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Main axes, and the least and the largest place on each, in a sample of at most ``SAMPLE`` rows."""
    sample = rows.select("x").orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(SAMPLE).toArrow()
    x = _matrix(sample.column("x"))
    x = x / max(np.abs(x).max(initial=0.0), 1.0)
    centred = x - x.mean(axis=0) if len(x) else x
    axes = np.linalg.svd(centred, full_matrices=False)[2][:AXES] if x.size else np.zeros((1, x.shape[1]))
    on = x @ axes.T
    return axes, on.min(axis=0, initial=0.0), on.max(axis=0, initial=0.0)


def shelved(rows: DataFrame, block: int = BLOCK, shelf_blocks: int = SHELF_BLOCKS) -> DataFrame:
    """The rows in order of the curve, with ``shelf``, ``block`` (of the shelf) and ``row``; written as Parquet.

    Ranges of the curve are cut by (place, hash of the id), so that equal vectors may spread.
    """
    axes, low, high = _axes(rows)
    names = ["vec_id", "label", "x", "place"]

    def each(batches):
        for batch in batches:
            x = _matrix(batch.column(2))
            x = x / np.maximum(np.abs(x).max(axis=1, initial=1.0, keepdims=True), 1e3)
            x, own = _same_width(x, axes)
            on = x @ own.T
            span = np.where(high > low, high - low, 1.0)
            cells = np.clip((on - low) / span * (1 << AXIS_BITS), 0, (1 << AXIS_BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places(cells, AXIS_BITS))], names)

    placed = rows.mapInArrow(each, "vec_id long, label long, x array<double>, place long")
    order = [F.col("place"), F.xxhash64("vec_id"), F.xxhash64("label", "x")]
    parts = group_count(rows.count(), block * shelf_blocks)
    ranged = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    number = F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    in_part = F.floor(number / (block * shelf_blocks))
    shelf = F.spark_partition_id().cast("long") * F.lit(1 << 24) + in_part
    at = F.pmod(F.floor(number / block), F.lit(shelf_blocks)).cast("int")
    return write_stage(ranged.select(shelf.alias("shelf"), at.alias("block"), "row", "vec_id", "label", "x"), "shelves")[0]


def zone_maps(index: DataFrame) -> DataFrame:
    """Per shelf: its ``blocks`` and, for each, least and largest components and labels."""

    def parts(batches):
        for batch in batches:
            shelf, block, label = (np.asarray(batch.column(i)) for i in (0, 1, 2))
            x = _matrix(batch.column(3))
            order = np.lexsort((block, shelf))
            shelf, block, label, x = shelf[order], block[order], label[order], x[order]
            starts = np.flatnonzero(np.concatenate(([True], (shelf[1:] != shelf[:-1]) | (block[1:] != block[:-1]))))[: len(shelf)]
            if not len(starts):
                continue
            low, high = (f.reduceat(x, starts) for f in (np.minimum, np.maximum))
            labels = [f.reduceat(label, starts) for f in (np.minimum, np.maximum)]
            lists = [pa.array(list(m), pa.list_(pa.float64())) for m in (low, high)]
            arrays = [pa.array(shelf[starts]), pa.array(block[starts]), *map(pa.array, labels), *lists]
            yield pa.RecordBatch.from_arrays(arrays, ["shelf", "block", "label_low", "label_high", "low", "high"])

    kinds = "label_low long, label_high long, low array<double>, high array<double>"
    partial = index.select("shelf", "block", "label", "x").mapInArrow(parts, f"shelf long, block int, {kinds}")

    def whole(table: pa.Table) -> pa.Table:
        blocks, low, high = np.asarray(table.column("block")), _matrix(table.column("low")), _matrix(table.column("high"))
        low, high = _same_width(low, high)
        order = np.argsort(blocks, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(blocks[order]) > 0)))
        least = lambda m: np.minimum.reduceat(m[order], starts)
        most = lambda m: np.maximum.reduceat(m[order], starts)
        lists = [blocks[order][starts], least(np.asarray(table.column("label_low"))), most(np.asarray(table.column("label_high")))]
        matrices = [least(low).ravel(), most(high).ravel()]
        return pa.table([table.column("shelf").slice(0, 1), *[pa.array([m]) for m in [*lists, *matrices]]], ["shelf", "blocks", "label_low", "label_high", "low", "high"])

    # A shelf has at most 64 blocks, and a batch of rows gives one part of a block.
    found = partial.groupBy("shelf").applyInArrow(
        whole, "shelf long, blocks array<int>, label_low array<long>, label_high array<long>, low array<double>, high array<double>"
    )
    return write_stage(found, "zones")[0]


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each anchor with any row inside each box, by intervals.

    Rounded outwards, so that values too large to be exact still bound.
    """
    plus, minus = np.maximum(anchors, 0), np.minimum(anchors, 0)
    least, most = plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T
    size = np.maximum(np.abs(low), np.abs(high))
    slack = np.abs(anchors) @ size.T * 1e-12
    return least - slack, most + slack


def _chooser(for_windows: bool):
    """Cells of anchors and zone maps to (anchor, shelf, bits of the blocks it must read)."""

    def each(asked: pa.Table, zones: pa.Table) -> pa.Table:
        if not asked.num_rows or not zones.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, ["a", "shelf", "bits"])
        a, label, x = np.asarray(asked.column("a")), np.asarray(asked.column("label")), _matrix(asked.column("x"))
        home = np.asarray(asked.column("home"))
        windows, floors = ([r or [] for r in asked.column(c).to_pylist()] for c in ("windows", "floors"))
        out = [[], [], []]
        for zone in zones.to_pylist():
            blocks = np.array(zone["blocks"], np.int64)
            low, high = (np.array(zone[c]).reshape(len(blocks), -1) for c in ("low", "high"))
            own, low = _same_width(x, low)
            own, high = _same_width(own, high)
            low, high = _same_width(low, high)
            least, most = bounds(own, low, high)
            first, last = np.array(zone["label_low"]), np.array(zone["label_high"])
            for i in np.flatnonzero(home != zone["shelf"]).tolist():
                if for_windows:
                    wanted = np.zeros(len(blocks), bool)
                    for p, floor in zip(windows[i], floors[i]):
                        wanted |= (most[i] >= max(floor, p * 4 / 5 - abs(p) * 1e-12)) & (least[i] <= p + abs(p) * 1e-12)
                    wanted &= (first != label[i]) | (last != label[i])
                else:
                    wanted = (most[i] >= floors[i][0]) & (first <= label[i]) & (last >= label[i])
                if wanted.any():
                    out[0].append(int(a[i]))
                    out[1].append(zone["shelf"])
                    out[2].append(int(np.bitwise_or.reduce(np.int64(1) << blocks[wanted])))
        return pa.table([pa.array(c, pa.int64()) for c in out], ["a", "shelf", "bits"])

    return each


def choose(asked: DataFrame, zones: DataFrame, for_windows: bool) -> DataFrame:
    """a, shelf, bits: the blocks beyond its own shelf that each anchor must read."""
    slots = group_count(zones.count(), SHELVES)
    groups = group_count(asked.count(), ANCHORS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    z = zones.withColumns({"slot": F.pmod(F.xxhash64("shelf"), F.lit(slots)), "group": every(groups)})
    q = asked.withColumns({"group": F.pmod(F.xxhash64("a"), F.lit(groups)), "slot": every(slots)})
    cell = (F.col("slot") * F.lit(groups) + F.col("group")).alias("cell")
    left = q.select(cell, "a", "label", "x", "windows", "floors", "home").groupBy("cell")
    right = z.select(cell, *zones.columns).groupBy("cell")
    return left.cogroup(right).applyInArrow(_chooser(for_windows), "a long, shelf long, bits long")


def _reader(k: int, for_windows: bool):
    """Shelves with their rows first and then the anchors that ask for them, one after another."""

    def answers(asked: pa.RecordBatch, held: dict) -> list[tuple]:
        found = []
        x = _matrix(asked.column(6))
        a, label, bits = (np.asarray(asked.column(i)) for i in (3, 5, 7))
        windows = asked.column(8)
        for at in range(0, len(a), AT_ONCE):
            score = scores(x[at : at + AT_ONCE], held["x"])
            for i in range(at, min(at + AT_ONCE, len(a))):
                read = (int(bits[i]) >> held["block"]) & 1 == 1
                s = score[i - at]
                if for_windows:
                    read &= held["label"] != label[i]
                    spans = [(w, p, read & (s <= p) & (5 * s >= 4 * p)) for w, p in enumerate(windows[i].as_py() or [])]
                else:
                    spans = [(0, 0, read & (held["label"] == label[i]) & (held["row"] != a[i]))]
                for w, _, eligible in spans:
                    e = np.flatnonzero(eligible)
                    for n in best(s[e], held["vec_id"][e], held["row"][e], k):
                        value = max(-LONG, min(LONG, int(s[e[n]])))
                        found.append((int(a[i]), w, int(held["vec_id"][e[n]]), int(held["row"][e[n]]), value))
        return found

    def each(batches):
        shelf, pieces, held = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            of, kind = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (kind[1:] != kind[:-1])) + 1
            found = []
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                part = batch.slice(i, j - i)
                if of[i] != shelf:
                    shelf, pieces, held = of[i], [], None
                if kind[i] == 0:
                    pieces.append(part)
                    continue
                if held is None:
                    rows = pa.Table.from_batches(pieces) if pieces else part.slice(0, 0)
                    names = {"block": 2, "row": 3, "vec_id": 4, "label": 5}
                    held = {n: np.asarray(rows.column(c)).astype(np.int64) for n, c in names.items()} | {"x": _matrix(rows.column(6))}
                found += answers(part, held)
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], t) for n, t in enumerate(kinds)], ["a", "w", "vec_id", "row", "score"])

    return each


def read(index: DataFrame, asked: DataFrame, k: int, for_windows: bool) -> DataFrame:
    """The k best rows for each anchor (and window) in each shelf it asks for (shelf, bits).

    Only blocks that some anchor asks for are read. Rows stay with their shelf; a task holds one
    shelf and goes through its anchors batch by batch, however many they are.
    """
    wanted = asked.groupBy("shelf").agg(F.bit_or("bits").alias("any_bits"))
    none = F.lit(None)
    rows = index.join(broadcast_if_small(wanted), "shelf").where(F.getbit("any_bits", F.col("block")) == 1)
    rows = rows.select(
        "shelf", F.lit(0).alias("kind"), "block", F.col("row").alias("a"), "vec_id", "label", "x", F.lit(0).cast("long").alias("bits"), none.cast("array<long>").alias("windows")
    )
    anchors = asked.select("shelf", F.lit(1).alias("kind"), F.lit(0).alias("block"), "a", "vec_id", "label", "x", "bits", "windows")
    dealt = rows.unionByName(anchors).repartition("shelf").sortWithinPartitions("shelf", "kind")
    return dealt.mapInArrow(_reader(k, for_windows), _FOUND)


def _twice(index: DataFrame, zones: DataFrame, anchors: DataFrame, k: int, for_windows: bool) -> DataFrame:
    """The k best rows of each anchor and window over all blocks, with their rank."""
    at_home = anchors.withColumns({"shelf": F.col("home"), "bits": F.lit(-1).cast("long")})
    near, _ = write_stage(read(index, at_home, k, for_windows), "near")
    # With k found at home, nothing below the least of them is wanted any more.
    least = near.groupBy("a", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    floors = least.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("floor"))
    count = F.size("windows") if for_windows else F.lit(1)
    none = F.lit(-LONG)
    floor = F.transform(F.sequence(F.lit(0), count - 1), lambda w: F.coalesce(F.element_at("floor", w), none))
    asked = anchors.drop("floors").join(broadcast_if_small(floors), "a", "left").withColumn("floors", floor).drop("floor")
    asked, _ = write_stage(asked, "asked")
    chosen, _ = write_stage(choose(asked, zones, for_windows), "chosen")
    far, _ = write_stage(read(index, chosen.join(broadcast_if_small(asked), "a"), k, for_windows), "far")
    order = Window.partitionBy("a", "w").orderBy(F.desc("score"), "vec_id", "row")
    return near.unionByName(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    every: int = 100,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    block: int = BLOCK,
    shelf_blocks: int = SHELF_BLOCKS,
) -> DataFrame:
    """Hard negatives of every row whose vec_id is divisible by ``every`` (its anchors).

    An anchor's positives are its best other rows of the same label, by inner product, ties by
    smaller vec_id. For each, the best rows of another label whose score is at most the
    positive's and at least 80 % of it (none, if the positive's is negative): anchor_id,
    positive_id, rank (from 1), negative_id, positive_score, negative_score. Scores are longs: a
    positive's score beyond their range stops at its end, and its window with it. Which rows take part: `usable`. Anchors that repeat an id are anchors of
    their own. An empty table gives no row.
    """
    split_hot_joins(vectors.sparkSession)
    rows, _ = write_stage(usable(vectors), "vectors")
    index = shelved(rows, block, shelf_blocks)
    zones = zone_maps(index)
    anchors = index.where(F.col("vec_id") % every == 0)
    anchors = anchors.select(
        F.col("row").alias("a"), "vec_id", "label", "x", F.col("shelf").alias("home"), F.lit(None).cast("array<long>").alias("windows"), F.array(F.lit(-LONG)).alias("floors")
    )
    same, _ = write_stage(_twice(index, zones, anchors, positives, False), "positives")
    opened = same.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))
    opened = opened.select("a", F.col("p.score").alias("windows"))
    windowed = anchors.drop("windows").join(broadcast_if_small(opened), "a")
    other = _twice(index, zones, windowed, negatives, True)
    of_positive = same.select("a", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    of_anchor = anchors.select("a", F.col("vec_id").alias("anchor_id"))
    out = other.join(broadcast_if_small(of_positive), ["a", "w"]).join(broadcast_if_small(of_anchor), "a")
    return out.select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
