"""Near-duplicate documents by SimHash fingerprints of word shingles.

Two fingerprints link when they differ in at most three bits. They are found by meeting
in the middle: every fingerprint emits all variants within half the radius, and those that
share a variant are verified. Three bits cannot be halved, so one of them is put aside:
the 64 bits are cut into three blocks, each is masked in turn, and variants flip at most
one of the bits left. Some block holds a differing bit, hence at most two differ outside
it and the variants meet. That is 131 variants per fingerprint, where balls of radius two
would take 2,081, and a key still has 42 bits or more.

Fingerprints that share a key are verified exactly, but a bucket never emits all its
pairs: it emits the links of a forest that connects what is truly linked in it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchweave.llm.components import components
from matchweave.llm.minhash import row_classes
from matchweave.llm.shared import drop_stage, write_stage
from matchweave.llm.tokens import slices
from matchweave.sources.store import broadcast_if_small

RADIUS = 3
SHINGLE = 3
SEED = 42
# First bit and width of the blocks that are masked in turn.
BLOCKS = ((0, 21), (21, 21), (42, 22))
# Hashes whose bits are counted at a time, so that very long texts need no large array.
HASHES_AT_ONCE = 1 << 15
# Buckets up to this many fingerprints compare them directly; larger ones look neighbours up.
DIRECT = 256
# Widths of the blocks of bits of which each key of the pipeline's tables holds three.
TABLE_BLOCKS = (11, 11, 11, 11, 10, 10)
TABLE_EQUAL = 3
_MIXER = np.uint64(0x9E3779B97F4A7C15)


def _table_masks() -> np.ndarray:
    first = np.cumsum((0, *TABLE_BLOCKS)).tolist()
    blocks = [((1 << width) - 1) << at for at, width in zip(first, TABLE_BLOCKS)]
    return np.array([sum(chosen) for chosen in combinations(blocks, TABLE_EQUAL)], np.uint64)


_TABLE_MASKS = _table_masks()


def over_half(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half of some 64-bit hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        block = hashes[at : at + HASHES_AT_ONCE].astype("<u8")
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def table_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of a set's fingerprint, one for each three of its six blocks of bits.

    Three differing bits leave three blocks as they are, so fingerprints that near share a key.
    """
    masked = _TABLE_MASKS & np.uint64(over_half(hashes))
    number = np.arange(len(masked), dtype=np.uint64)
    return ((masked ^ (masked >> np.uint64(31))) * _MIXER ^ number) * _MIXER + number


def fingerprint(text: bytes | None, words: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a UTF-8 text as an unsigned 64-bit number; no word at all gives 0."""
    parts = (text or b"").lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not parts:
        return 0
    joined = b" ".join(parts)
    hash_of = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return hash_of(joined, seed)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = (ends - [len(p) + 1 for p in parts])[: len(parts) - words + 1].tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), HASHES_AT_ONCE):
        block = [hash_of(joined[i:j], seed) for i, j in zip(starts[at : at + HASHES_AT_ONCE], stops[at : at + HASHES_AT_ONCE])]
        bits = np.unpackbits(np.array(block, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    over_half = (2 * counts > len(starts)).astype(np.uint8)
    return int(np.packbits(over_half, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long. A null text counts as empty."""

    def each(batches):
        for batch in batches:
            for part in slices(batch):
                values = np.array([fingerprint(t) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values)], ["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return chosen.mapInArrow(each, f"doc_id {kind}, fp long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _variants(fps: DataFrame) -> DataFrame:
    """Every fingerprint under each of its keys: block number, variant of the bits outside it."""
    rows = []
    for number, (first, width) in enumerate(BLOCKS):
        keep = ((1 << 64) - 1) ^ (((1 << width) - 1) << first)
        flips = [0] + [1 << b for b in range(64) if keep >> b & 1]
        rows += [(number, _signed(keep), _signed(f)) for f in flips]
    literal = F.array(*[F.struct(F.lit(n).cast("byte").alias("block"), F.lit(k).alias("keep"), F.lit(f).alias("flip")) for n, k, f in rows])
    each = fps.select("fp", F.explode(literal).alias("v"))
    return each.select(F.col("v.block").alias("block"), F.col("fp").bitwiseXOR(F.col("v.flip")).bitwiseAND(F.col("v.keep")).alias("key"), "fp")


def _roots(count: int, pairs) -> np.ndarray:
    """Smallest member that each of ``count`` numbers is connected to by the pairs."""
    root = list(range(count))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in pairs:
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return np.array([find(x) for x in range(count)])


def _near_pairs(values: np.ndarray):
    for i in range(len(values) - 1):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= RADIUS):
            yield i, i + 1 + int(j)


def _looked_up_pairs(values: np.ndarray, block: int, key: int):
    """The links of a large bucket, by looking up neighbours instead of comparing all pairs.

    Outside the masked block a member has the key's bits, or all but one of them. Inside
    it, members with equal bits are linked at once; others are found by flipping one bit,
    and, for members that have exactly the key's bits, two or three.
    """
    first, width = BLOCKS[block]
    inside = ((1 << width) - 1) << first
    groups: dict[int, list[int]] = {}
    exact: dict[int, int] = {}
    for i, v in enumerate(values.tolist()):
        groups.setdefault(v & inside, []).append(i)
        if (v ^ key) & ~inside & ((1 << 64) - 1) == 0:
            exact[v & inside] = i
    bits = [1 << (first + b) for b in range(width)]
    for u, members in groups.items():
        for i in members[1:]:
            yield members[0], i
        for x in bits:
            other = groups.get(u ^ x)
            if other and u < u ^ x:
                yield members[0], other[0]
    for u, i in exact.items():
        for n, x in enumerate(bits):
            for m in range(n + 1, width):
                y = x | bits[m]
                for j in groups.get(u ^ y, ()):
                    yield i, j
                for z in bits[m + 1 :]:
                    j = exact.get(u ^ y ^ z)
                    if j is not None:
                        yield i, j


def _bucket_links(batches):
    """Links of a forest for each bucket; rows come sorted by block, key and fingerprint."""

    def links(block: int, key: int, values: np.ndarray):
        values = values.view(np.uint64)
        if len(values) <= DIRECT:
            pairs = _near_pairs(values)
        else:
            pairs = _looked_up_pairs(values, block, key & ((1 << 64) - 1))
        root = _roots(len(values), pairs)
        moved = np.flatnonzero(root != np.arange(len(values)))
        return values[moved].view(np.int64), values[root[moved]].view(np.int64)

    def out(a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    rest = None  # the last bucket of a batch may go on in the next
    for batch in _with_end(batches):
        if batch is None:
            cols, last = rest, True
        else:
            cols, last = [np.asarray(batch.column(i)) for i in range(3)], False
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
        if cols is None or not len(cols[0]):
            continue
        block, key, fp = cols
        starts = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (key[1:] != key[:-1]))))
        stops = np.append(starts[1:], len(fp))
        if not last:
            rest = [c[starts[-1] :] for c in cols]
            starts, stops = starts[:-1], stops[:-1]
        several = stops - starts > 1
        a, b = [], []
        for i, j in zip(starts[several].tolist(), stops[several].tolist()):
            x, y = links(int(block[i]), int(key[i]), fp[i:j])
            if len(x):
                a.append(x)
                b.append(y)
        if a:
            yield out(a, b)


def _with_end(batches):
    yield from batches
    yield None


def near_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all within the radius.

    Every two fingerprints at most three bits apart are connected through these links, and
    the two of a link through steps of at most three bits. ``fps`` has one row per distinct
    value.
    """
    dealt = _variants(fps).repartition("block", "key").sortWithinPartitions("block", "key", "fp")
    return dealt.mapInArrow(_bucket_links, "a long, b long").distinct()


def class_roots(of_docs: DataFrame) -> DataFrame:
    """``fp``, ``root``: for each distinct fingerprint of a written table, the smallest one of its class."""
    fps, path = write_stage(of_docs.select("fp").distinct(), "distinct")
    found, _ = write_stage(components(near_links(fps)), "classes")
    rooted = fps.join(found, fps["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))
    out, _ = write_stage(rooted, "roots")
    drop_stage(of_docs.sparkSession, path)
    return out


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document with its fingerprint and near-duplicate class.

    Columns: doc_id, ``fingerprint`` (16 lowercase hex digits), ``component_id`` (the
    smallest doc_id that links of at most three bits reach, itself included). Texts without
    any word have fingerprint zero and link like others. Rows with a null doc_id take part;
    a class made of them alone has a null component_id. One row per input row.
    """
    of_docs, _ = write_stage(fingerprints(docs, doc_id, text), "fingerprints")
    rooted = class_roots(of_docs)
    ids = of_docs.groupBy("fp").agg(F.min("doc_id").alias("least")).join(rooted, "fp")
    least = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    named, _ = write_stage(rooted.join(least, "root").select("fp", "component_id"), "named")
    return of_docs.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one left of each class of near copies, that with the smallest doc_id.

    Copies link at a five-word likeness of 0.8 or more. They are found by SimHash: texts whose
    fingerprints of five-word shingles are within three bits (`near_links`) are compared and linked.
    Texts at 0.8 may differ in ten bits and more, which no fingerprint of 64 bits tells from chance;
    an exact check of what is still in different classes follows (`minhash`), in which what SimHash
    has linked is not compared again.
    Of rows that repeat the smallest id the first is kept; null ids come last. The input is
    written once with its rows numbered.
    """
    names = docs.columns
    numbered, _ = write_stage(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    ids = numbered.select("__row", "doc_id").join(row_classes(numbered, over_half, near_links), "__row")
    ids, _ = write_stage(ids.select("__row", "doc_id", "root"), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    kept = ids.groupBy("root").agg(F.min(order).alias("first"))
    dropped = ids.join(kept, "root").where(F.col("first.__row") != F.col("__row")).select("__row")
    dropped, _ = write_stage(dropped, "dropped")
    return numbered.join(broadcast_if_small(dropped), "__row", "left_anti").select(*names)
