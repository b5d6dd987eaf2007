"""Exact Jaccard join of documents on word shingles, by prefixes of the rarest shingles.

All shingles have one order: those that a sample of the texts shows to be common come last, the
commonest at the very end. The order only decides the cost; any order gives the same links. Linked
sets have most shingles in common, so the first one in that order that they share lies in the
prefix of both, and a set is indexed by its prefix alone. Where that first one stands also says how
large a partner can be at most: all shingles before it are missing in the other set. So a common
passage brings hardly any sets together, and of a group of near copies those with many changes
of their own meet nobody.

Sets that share a key are first compared with one of them only, the one with the fewest shingles
before the key, and what links falls into classes; what stays apart is compared with a few members
of the key's largest class. Only pairs of different classes are compared afterwards, so that large
groups of copies cost little. A comparison first bounds the difference from below by sketches of
parities, which can only admit too much, and then counts the whole sets' common shingles. In how
many shingles two sets differ is a metric: where one set is close to the first of a key and another
is far from it, the two are told apart by numbers alone.

What all this leaves with too many pairs of a key is dealt by segments. Sets are grouped into size
bands no wider than the threshold's ratio, so linked sets lie in one band or in two neighbouring
ones. For a band the most that two linked sets can differ by, H, is known, and hashing deals all
shingles into an even number of segments, by some more than H. So linked sets have several
segments in common, and of segments taken two by two, several couples differ in at most one
shingle: one segment is equal, the other equal or one shingle short on one side. A set is indexed
by what it has in each single segment. Where a key is cheap, the sets that share it are compared; a
dear key is left alone. Who has fewer dear keys than linked sets have segments in common has met
all its partners in cheap ones. Only the few other sets are indexed further: by a dear segment
together with the couple's other one, whole and once for each shingle left out. Again only sets
with too many dear couples stay; they are dealt anew by other hashes, and what is dear at last is
compared all the same.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchweave.llm.components import components
from matchweave.llm.shared import drop_stage, hash_share, release, write_stage
from matchweave.llm.shingling import shingles
from matchweave.llm.tokens import slices
from matchweave.sources.store import broadcast_if_small, split_hot_joins

WORDS = 4
THRESHOLD = (85, 100)
# A key is dear when its sets have more pairs of different classes than this many a set, pairs with
# the key's largest class aside; of those, which distances mostly settle, there may be more.
PAIRS_PER_SET = 8
BOUNDED_PAIRS_PER_SET = 1024
# The same for keys of prefixes, where the places of a key settle most pairs by numbers.
PLACED_PAIRS_PER_SET = 1 << 14
# Bytes of text in which common shingles are counted, and how many of them the order knows.
COUNTED_BYTES = 64_000_000
COMMON_SHINGLES = 1 << 18
# Segments beyond the least number, in hundredths of how much linked sets differ by at most.
SPARE = 15
# How many members of a key's largest class the others are compared with before all of them.
PIVOTS = 2
# How often sets with too many dear keys are dealt again before these keys' pairs are compared all the same.
REDEALS = 1
LARGEST = 1 << 40
# Of keys that sets of any size may share.
ANY_BAND = -1
BAND_BITS = np.uint64(0xFF)
# Sets whose keys are packed together, and keys of a bucket that one task sorts at once.
SETS_AT_ONCE = 4096
KEYS_PER_BUCKET = 1_000_000
# A key that so many sets of a pack share does not go to the one task of its bucket.
OFTEN = 8
# Numbers without other columns may be broadcast up to this count (about 32 MB).
BROADCAST_NUMBERS = 1_000_000

_MIX_A, _MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    """Numbers scrambled one to one."""
    x = (x ^ (x >> np.uint64(33))) * _MIX_A
    x = (x ^ (x >> np.uint64(33))) * _MIX_B
    return x ^ (x >> np.uint64(33))


@functools.cache
def _salt(*parts: int) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(" ".join(map(str, parts)).encode()))


def band_starts(threshold: tuple[int, int] = THRESHOLD) -> list[int]:
    """Least size of each band; the largest of a band is within the threshold's ratio of it."""
    low, high = threshold
    starts = [1]
    while starts[-1] < LARGEST:
        starts.append(starts[-1] * high // low + 1)
    return starts


class Bands:
    """Bands of set sizes, and the segments that the shingles of a band's sets fall in."""

    def __init__(self, threshold: tuple[int, int] = THRESHOLD):
        self.low, self.high = threshold
        self.starts = band_starts(threshold)

    def of(self, size: int) -> list[int]:
        """The bands a set takes part in: its own, and the next if larger sets can link to it."""
        own = int(np.searchsorted(self.starts, size, side="right")) - 1
        further = self.low * self.starts[own + 1] <= self.high * size
        return [b for b in ([own, own + 1] if further else [own]) if self.difference(b)]

    def difference(self, band: int) -> int:
        """How many shingles two linked sets whose larger one is in the band differ by at most."""
        return (self.high - self.low) * 2 * (self.starts[band + 1] - 1) // (self.high + self.low)

    def segments(self, band: int) -> int:
        differ = self.difference(band)
        more = differ + 1 + SPARE * differ // 100
        return more + more % 2

    def in_common(self) -> tuple[list[int], list[int]]:
        """For each band, how many segments of linked sets are equal, and how many couples nearly, at least."""
        of = [(self.segments(b), self.difference(b)) for b in range(len(self.starts) - 1)]
        return [n - d for n, d in of], [n // 2 - d // 2 for n, d in of]

    def largest_partner(self, size, at):
        """Size of the largest set that may link where ``at`` shingles of a set, or more, are its own."""
        return (size - at) * (self.high + self.low) // self.low - size

    def sums(self, hashes: np.ndarray, band: int, deal: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the (scrambled) shingles in each segment, and the segment of each shingle."""
        count = self.segments(band)
        place = ((_mix(hashes ^ _salt(band, deal)) >> np.uint64(11)) % np.uint64(count)).astype(np.int64)
        sums = np.zeros(count, np.uint64)
        np.add.at(sums, place, _mix(hashes))
        return sums, place

    def keys(self, hashes: np.ndarray, band: int, deal: int = 0) -> np.ndarray:
        """One key for each segment; its last bits are the band."""
        sums, _ = self.sums(hashes, band, deal)
        mixed = _mix(sums + _mix(np.arange(len(sums), dtype=np.uint64) + _salt(band, deal, 1)))
        return (mixed & ~BAND_BITS) | np.uint64(band)

    def all_keys(self, hashes: np.ndarray, deal: int = 0) -> np.ndarray:
        found = [self.keys(hashes, b, deal) for b in self.of(len(hashes))]
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    def one_left_out(self, hashes: np.ndarray, dear: np.ndarray, deal: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Keys, and their couples, of dear segments with the other segment of their couple.

        The other segment counts whole and once for each of its shingles left out. The last bits
        of a key are the band.
        """
        keys, couples = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for band in self.of(len(hashes)):
            own = self.keys(hashes, band, deal)
            at = np.flatnonzero(np.isin(own, dear))
            if not len(at):
                continue
            sums, place = self.sums(hashes, band, deal)
            mixed = _mix(hashes)
            for i in at.tolist():
                other = i ^ 1
                left = np.append(sums[other] - mixed[place == other], sums[other])
                found = _mix(_mix(left + _salt(band, deal, 2)) ^ own[i])
                keys.append((found & ~BAND_BITS) | np.uint64(band))
                couples.append(np.full(len(left), i // 2, np.int64))
        return np.concatenate(keys), np.concatenate(couples)


class Order:
    """An order of all shingles: by hash, but common ones last, and of these the commonest at the end."""

    def __init__(self, common: np.ndarray):
        self.rank = np.argsort(common)
        self.common = common[self.rank]
        self.rank = self.rank + 1

    def prefix(self, hashes: np.ndarray, low: int, high: int) -> np.ndarray:
        """The first shingles of a set in this order, of which linked sets share one at least."""
        count = len(hashes) - (low * len(hashes) + high - 1) // high + 1
        if not len(self.common):
            return hashes[:count]
        at = np.minimum(np.searchsorted(self.common, hashes), len(self.common) - 1)
        rank = np.where(self.common[at] == hashes, self.rank[at], 0)
        return hashes[np.argsort(rank, kind="stable")[:count]]


def order_of(texts: DataFrame, words: int) -> Order:
    """The order after the counts of shingles in a sample of the texts, of bounded size, each text once."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sample = texts.select("text").where(hash_share("text", seed=words) < min(1.0, COUNTED_BYTES / max(total, 1)))

    def each(batches):
        for batch in batches:
            for part in slices(batch):
                found = np.concatenate([np.zeros(0, np.uint64), *(shingles(t, words) for t in part.column(0).to_pylist())])
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["shingle"])

    once = sample.groupBy(F.xxhash64("text").alias("hash")).agg(F.first("text").cast("binary").alias("text"))
    counts = once.select("text").mapInArrow(each, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    top = counts.where("n > 1").orderBy(F.desc("n"), "shingle").limit(COMMON_SHINGLES).toArrow()
    # The rarest first.
    return Order(top.column("shingle").to_numpy()[::-1].view(np.uint64) if top.num_rows else np.zeros(0, np.uint64))


def parities(hashes: np.ndarray) -> np.ndarray:
    """Sketch: whether an odd number of shingles falls on each bit, of at least two bits a shingle.

    Every shingle that only one of two sets has changes one bit at most, so the sketches differ
    in no more bits than the sets in shingles. A sketch folds onto one of half its bits.
    """
    bits = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    at = (_mix(hashes + _salt(4)) & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def _signatures(docs: DataFrame, words: int, bands: Bands, order: Order) -> DataFrame:
    """Rows numbered, with a digest of the set (null if empty), its size, its prefix as keys, and sketch."""

    def each(batches):
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t, words) for t in part.column(2).to_pylist()]
                arrays = [
                    part.column(0),
                    part.column(1),
                    part.column(3),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([order.prefix(s, bands.low, bands.high).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                    pa.array([parities(s) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "text_hash", "digest", "size", "keys", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.col("text").cast("binary").alias("text"),
        F.xxhash64("text").alias("text_hash"),
    )
    return numbered.mapInArrow(
        each,
        f"row long, doc_id {kind}, text_hash long, digest binary, size long, keys binary, sketch array<long>",
    )


def _texts_of(docs: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep, text and the columns of ``wanted`` for some representatives (``rep`` and more columns)."""
    asked = broadcast_if_small(reps.select("rep", "rep_id", "text_hash").join(wanted, "rep"))
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("hash"))
    same = (F.col("hash") == F.col("text_hash")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))
    return texts.join(asked, same).drop("doc_id", "hash", "rep_id", "text_hash")


def _sets(docs: DataFrame, reps: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """rep and ``set`` (its shingles) of each wanted representative."""

    def each(batches):
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t, words).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["rep", "set"])

    texts = _texts_of(docs, reps, wanted.select("rep")).select("rep", "text")
    # Rows that repeat id and text would give a representative twice.
    return texts.mapInArrow(each, "rep long, set array<long>").dropDuplicates(["rep"])


def _shared_keys(signed: DataFrame, bands: Bands) -> DataFrame:
    """key, band, slot, rep, size, at of the keys that several sets (``row``, ``size``, ``keys``) share.

    ``at`` is the place of the key in its set's prefix. Most keys are of one set only. So the keys
    of some thousand sets are packed together by bucket, sorted, and only packs are shuffled; the
    task of a bucket keeps what comes twice in places where sets may link. Of a key that is frequent
    in a pack only a mark goes to its bucket, and its sets go to any task.
    """
    total = signed.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    buckets = max(int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // 8 // KEYS_PER_BUCKET + 1)
    fields = ("reps", "sizes", "keys", "whose", "at")
    schema = pa.schema([("bucket", pa.int32()), *[(f, pa.binary()) for f in fields]])
    mark = np.uint16(SETS_AT_ONCE)

    def packed(rows: list[int], sizes: list[int], lists: list[bytes]) -> pa.RecordBatch:
        rows, sizes = np.array(rows, np.int64), np.array(sizes, np.int64)
        held = [np.frombuffer(k, np.uint64) for k in lists]
        keys = np.concatenate(held)
        whose = np.repeat(np.arange(len(held), dtype=np.uint16), [len(k) for k in held])
        at = np.concatenate([np.arange(len(k), dtype=np.uint32) for k in held])
        order = np.argsort(keys, kind="stable")
        keys, whose, at = keys[order], whose[order], at[order]
        _, start, many = np.unique(keys, return_index=True, return_counts=True)
        often = np.repeat(many >= OFTEN, many)
        marked = start[many >= OFTEN]
        plain = np.concatenate((keys[~often], keys[marked]))
        of_plain = np.concatenate((whose[~often], np.full(len(marked), mark)))
        at_plain = np.concatenate((at[~often], np.zeros(len(marked), np.uint32)))
        bucket = ((_mix(plain) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[by], np.arange(buckets + 1))
        parts = [(n, plain[by[i:j]], of_plain[by[i:j]], at_plain[by[i:j]]) for n, (i, j) in enumerate(zip(ends, ends[1:])) if i < j]
        if often.any():
            any_bucket = int(_mix(rows[:1].astype(np.uint64) + np.uint64(1))[0] % np.uint64(buckets))
            parts.append((buckets + any_bucket, keys[often], whose[often], at[often]))
        found = []
        for n, k, w, a in parts:
            used, place = np.unique(w, return_inverse=True)
            own = np.minimum(used, len(rows) - 1)
            arrays = np.where(used == mark, -1, rows[own]), np.where(used == mark, 0, sizes[own]), k, place.astype(np.uint16), a
            found.append({"bucket": n} | {f: x.tobytes() for f, x in zip(fields, arrays)})
        return pa.RecordBatch.from_pylist(found, schema)

    def pack(batches):
        held = [], [], []
        for batch in batches:
            for part in slices(batch):
                for own, column in zip(held, part.columns):
                    own += column.to_pylist()
                while len(held[0]) >= SETS_AT_ONCE:
                    yield packed(*[own[:SETS_AT_ONCE] for own in held])
                    for own in held:
                        del own[:SETS_AT_ONCE]
        if held[0]:
            yield packed(*held)

    def entries(keys, reps, sizes, at):
        arrays = [pa.array(keys.view(np.int64)), pa.array(reps), pa.array(sizes), pa.array(at.astype(np.int64))]
        return pa.RecordBatch.from_arrays(arrays, ["key", "rep", "size", "at"])

    def settled(held):
        keys, reps, sizes, at = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys, kind="stable")
        keys, reps, sizes, at = keys[order], reps[order], sizes[order], at[order].astype(np.int64)
        # What is only marked here may be of any size and in any place.
        most = np.where(reps < 0, LARGEST, bands.largest_partner(sizes, at))
        while len(keys):
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            many = np.diff(np.append(starts, len(keys)))
            least, reach = (np.repeat(f.reduceat(x, starts), many) for f, x in ((np.minimum, sizes), (np.maximum, most)))
            kept = (np.repeat(many, many) > 1) & (least <= most) & (sizes <= reach)
            if kept.all():
                break
            keys, reps, sizes, at, most = (x[kept] for x in (keys, reps, sizes, at, most))
        kept = reps >= 0
        return entries(keys[kept], reps[kept], sizes[kept], at[kept])

    def unpack(batches):
        held, now = [], None
        for batch in batches:
            for bucket, *packs in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if bucket != now and held:
                    yield settled(held)
                    held = []
                now = bucket
                kinds = np.int64, np.int64, np.uint64, np.uint16, np.uint32
                reps, sizes, keys, whose, at = (np.frombuffer(x, kind) for x, kind in zip(packs, kinds))
                if bucket >= buckets:
                    yield entries(keys, reps[whose], sizes[whose], at)
                else:
                    held.append((keys, reps[whose], sizes[whose], at))
        if held:
            yield settled(held)

    kinds = ", ".join(["bucket int", *[f"{f} binary" for f in fields]])
    packs = signed.select("row", "size", "keys").mapInArrow(pack, kinds)
    dealt = packs.repartition(min(buckets, 4096), "bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(unpack, "key long, rep long, size long, at long")
    return found.select("key", F.lit(ANY_BAND).alias("band"), F.lit(0).cast("long").alias("slot"), "rep", "size", "at")


def _band_of(key: str) -> Column:
    return F.col(key).bitwiseAND(F.lit(int(BAND_BITS))).cast("int").alias("band")


def _further_keys(docs: DataFrame, reps: DataFrame, dear: DataFrame, words: int, bands: Bands, deal: int, how: str) -> DataFrame:
    """key, band, slot, rep, size, at of the sets with dear keys (key, rep).

    The keys are those of their prefixes, in an order of these sets (``how`` is "prefix"), of each
    segment of a dealing ("whole"), or of the dear segments with one shingle left out ("less").
    """
    # A set has no more dear keys than keys, so the lists are as long as its own text at most.
    listed = dear.groupBy("rep").agg(F.collect_set("key").alias("keys"))
    texts = _texts_of(docs, reps, listed).select("rep", "text", "keys")
    order = order_of(texts, words) if how == "prefix" else None

    def each(batches):
        for batch in batches:
            for part in slices(batch):
                for rep, text, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    hashes = shingles(text, words)
                    if how == "prefix":
                        found = order.prefix(hashes, bands.low, bands.high)
                        slots = np.zeros(len(found), np.int64)
                    elif how == "whole":
                        found = bands.all_keys(hashes, deal)
                        slots = found.view(np.int64)
                    else:
                        found, slots = bands.one_left_out(hashes, np.array(own.as_py(), np.int64).view(np.uint64), deal)
                    at = np.arange(len(found)) if how == "prefix" else np.zeros(len(found), np.int64)
                    same = [np.full(len(found), n, np.int64) for n in (rep, len(hashes))]
                    arrays = [pa.array(x) for x in (found.view(np.int64), slots, *same, at)]
                    yield pa.RecordBatch.from_arrays(arrays, ["key", "slot", "rep", "size", "at"])

    found = texts.mapInArrow(each, "key long, slot long, rep long, size long, at long").distinct()
    band = F.lit(ANY_BAND).alias("band") if how == "prefix" else _band_of("key")
    return found.select("key", band, "slot", "rep", "size", "at")


def _differing_bits(x: Column, y: Column) -> Column:
    """How many bits of two sketches differ, the longer one folded onto the length of the shorter."""

    def folded(own: Column, other: Column) -> Column:
        n = F.size(other)
        halves = F.zip_with(F.slice(own, F.lit(1), n), F.slice(own, n + 1, n), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(own) > n, halves).otherwise(own)

    differ = F.zip_with(folded(x, y), folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(differ, F.lit(0), lambda total, n: total + n)


class Join:
    """The links between representatives, round by round."""

    def __init__(self, docs: DataFrame, reps: DataFrame, words: int, bands: Bands):
        self.docs, self.reps, self.words, self.bands = docs, reps, words, bands
        self.spark = docs.sparkSession
        self.links = self.spark.createDataFrame([], "a long, b long")
        self.equal, self.nearly = bands.in_common()

    def met(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) with the size of a, both sizes together and the bits that differ (a lower bound)."""
        side = self.reps.select("rep", "size", "sketch")
        of_a, of_b = (side.select(*[F.col(c).alias(f"{c}_{n}") for c in side.columns]) for n in "ab")
        joined = pairs.join(of_a, F.col("a") == F.col("rep_a")).join(of_b, F.col("b") == F.col("rep_b"))
        both = (F.col("size_a") + F.col("size_b")).alias("both")
        bits = _differing_bits(F.col("sketch_a"), F.col("sketch_b")).cast("long")
        # Sets whose sizes are too far apart differ by that much at least.
        return joined.select("a", "b", "size_a", both, F.greatest(bits, F.abs(F.col("size_a") - F.col("size_b"))).alias("low"))

    def may_link(self, low: Column, both: Column) -> Column:
        return low * (self.bands.high + self.bands.low) <= (self.bands.high - self.bands.low) * both

    def counted(self, near: DataFrame) -> DataFrame:
        """a, b, both, common (shingles that both sets hold) of written pairs."""
        wanted = near.select(F.col("a").alias("rep")).unionByName(near.select(F.col("b").alias("rep"))).distinct()
        sets, path = write_stage(_sets(self.docs, self.reps, wanted, self.words), "sets")
        x, y = sets.select(F.col("rep").alias("a"), F.col("set").alias("x")), sets.select(F.col("rep").alias("b"), F.col("set").alias("y"))
        common = F.size(F.array_intersect("x", "y")).alias("common")
        out, _ = write_stage(near.join(x, "a").join(y, "b").select("a", "b", "both", common), "common")
        drop_stage(self.spark, path)
        return out

    def linked(self, counted: DataFrame) -> DataFrame:
        low, high = self.bands.low, self.bands.high
        return counted.where(high * F.col("common") >= low * (F.col("both") - F.col("common"))).select("a", "b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of representatives that link."""
        near = self.met(pairs).where(self.may_link(F.col("low"), F.col("both")))
        near, path = write_stage(near.select("a", "b", "both"), "near")
        found = self.linked(self.counted(near))
        drop_stage(self.spark, path)
        return found

    def measured(self, pairs: DataFrame) -> DataFrame:
        """a, b, size (of a), low, high: bounds of the difference of all pairs, exact where they may link.

        Adds the links among them.
        """
        met, _ = write_stage(self.met(pairs), "met")
        near = met.where(self.may_link(F.col("low"), F.col("both"))).select("a", "b", "both")
        counted = self.counted(near)
        self.add(self.linked(counted))
        exact = counted.select("a", "b", (F.col("both") - 2 * F.col("common")).alias("exact"))
        bounds = met.join(broadcast_if_small(exact), ["a", "b"], "left")
        return bounds.select("a", "b", F.col("size_a").alias("size"), F.coalesce("exact", "low").alias("low"), F.coalesce("exact", "both").alias("high"))

    def largest_partner(self) -> Column:
        return F.expr(f"(size - at) * {self.bands.high + self.bands.low} div {self.bands.low} - size")

    def classed(self) -> DataFrame:
        """node, root of all links so far."""
        out, _ = write_stage(components(self.links), "classes")
        # The classes say the same as all links that they came from, in fewer rows.
        self.links = out.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        # Many steps follow each other in one query; what is over would stay until its end.
        release(self.spark)
        return out

    def add(self, found: DataFrame) -> None:
        self.links = self.links.unionByName(found)

    def rooted(self, held: DataFrame) -> tuple[DataFrame, str]:
        """key, band, slot, rep, size, at, first and the root of its class so far."""
        roots = self.classed()
        out = held.join(broadcast_if_small(roots), F.col("rep") == F.col("node"), "left")
        return write_stage(out.select("key", "band", "slot", "rep", "size", "at", "first", F.coalesce("root", "rep").alias("root")), "rooted")

    def met_by_pivots(self, held: DataFrame) -> tuple[DataFrame, str]:
        """The rows of keys with their classes, after comparing each with some of its key's largest class."""
        rooted, path = self.rooted(held)
        for turn in range(PIVOTS):
            parts = rooted.groupBy("key", "root").agg(
                F.count(F.lit(1)).alias("n"), F.min_by("rep", F.xxhash64(F.lit(turn), "rep")).alias("pivot")
            )
            largest = parts.groupBy("key").agg(F.max(F.struct("n", "root", "pivot")).alias("most"), F.count(F.lit(1)).alias("classes"))
            largest = largest.where("classes > 1").select("key", F.col("most.root").alias("of"), F.col("most.pivot").alias("pivot"))
            if largest.isEmpty():
                break
            pairs = rooted.join(broadcast_if_small(largest), "key").where(F.col("root") != F.col("of"))
            pairs = pairs.select(F.greatest("rep", "pivot").alias("a"), F.least("rep", "pivot").alias("b")).distinct()
            self.add(self.verified(pairs))
            before = path
            rooted, path = self.rooted(rooted.drop("root"))
            drop_stage(self.spark, before)
        return rooted, path

    def may_meet(self, members: DataFrame) -> tuple[DataFrame, str]:
        """The rows of keys in whose places their sets may link with others of the key."""
        groups = members.withColumn("most", self.largest_partner()).groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.min("size").alias("least"), F.max("most").alias("reach")
        )
        groups, path = write_stage(groups.where("n > 1").drop("n"), "keys")
        met = members.join(broadcast_if_small(groups), "key").withColumn("most", self.largest_partner())
        met, met_path = write_stage(met.where("least <= most AND size <= reach").drop("least", "reach", "most"), "meeting")
        drop_stage(self.spark, path)
        return met, met_path

    def round(self, members: DataFrame, common: list[int] | None = None, all_pairs: bool = False, placed: bool = False):
        """Links the sets that share keys (key, band, slot, rep, size, at); returns what is dear, if anything, and its folder.

        Linked sets share a key in places where neither has too much before it. They have keys in
        common in at least as many slots as ``common`` has for the band. Keys are ``placed`` if they
        have places in their sets; others are all in place 0.
        """
        members, members_path = self.may_meet(members)
        # The set with the fewest shingles before a key is the most likely to be like the others.
        groups = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "rep"))["rep"].alias("first")).where("n > 1")
        groups, groups_path = write_stage(groups, "keys")
        if groups.isEmpty():
            drop_stage(self.spark, members_path, groups_path)
            return None, []
        held, held_path = write_stage(members.join(broadcast_if_small(groups), "key"), "members")
        drop_stage(self.spark, groups_path, members_path)
        star = held.where("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct()
        far = self.measured(star).withColumnsRenamed({"a": "rep", "b": "first"})
        # Keys of two sets are settled; of others, what is still in different classes is to be met.
        rooted, rooted_path = self.met_by_pivots(held.where("n > 2"))
        parts = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).cast("double").alias("n"))
        sums = parts.groupBy("key").agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"),
            F.max("n").alias("largest"), F.max_by("root", F.struct("n", "root")).alias("most"),
        )
        rest = F.col("n") - F.col("largest")
        among = (rest * rest - F.col("squares") + F.col("largest") * F.col("largest")) / 2
        apart = sums.where(rest > 0).select("key", "most", "n", among.alias("pairs"), (rest * F.col("largest")).alias("bounded"))
        apart, apart_path = write_stage(apart, "apart")
        limits = (PLACED_PAIRS_PER_SET, PLACED_PAIRS_PER_SET) if placed else (PAIRS_PER_SET, BOUNDED_PAIRS_PER_SET)
        cheap = (F.col("pairs") <= limits[0] * F.col("n")) & (F.col("bounded") <= limits[1] * F.col("n"))
        cheap = F.lit(True) if all_pairs else cheap
        # What the smallest set was compared with needs no second look.
        direct = rooted.where(F.col("rep") != F.col("first")).join(broadcast_if_small(apart.where(cheap).select("key", "most")), "key")
        direct = direct.join(far.drop("size"), ["rep", "first"]).withColumn("partner", self.largest_partner())
        second = {c: f"{c}2" for c in ("rep", "root", "size", "low", "high", "partner")}
        strays = direct.where("root <> most").select("key", *[F.col(c).alias(n) for c, n in second.items()])
        both = F.col("size") + F.col("size2")
        least = F.greatest(F.col("low") - F.col("high2"), F.col("low2") - F.col("high"), F.abs(F.col("size") - F.col("size2")))
        # Two strays meet from both sides, so one of them is enough.
        once = (F.col("root") == F.col("most")) | (F.col("rep") < F.col("rep2"))
        fit = (F.col("size") <= F.col("partner2")) & (F.col("size2") <= F.col("partner"))
        met = direct.join(strays, (direct["key"] == strays["key"]) & (F.col("root") != F.col("root2")) & once & fit & self.may_link(least, both))
        met = met.select(F.greatest("rep", "rep2").alias("a"), F.least("rep", "rep2").alias("b")).distinct()
        self.add(self.verified(met))
        dear = apart.where(~cheap).select("key")
        if all_pairs or dear.isEmpty():
            drop_stage(self.spark, held_path, rooted_path, apart_path)
            return None, []
        left = rooted.join(broadcast_if_small(dear), "key", "left_semi").select("key", "band", "slot", "rep")
        left, left_path = write_stage(left, "dear")
        drop_stage(self.spark, held_path, rooted_path, apart_path)
        if common is None:
            return left, [left_path]
        # Whoever has fewer dear slots than linked sets have in common met its partners elsewhere.
        several = left.groupBy("rep", "band").agg(F.count_distinct("slot").alias("n"))
        several = several.where(F.col("n") >= F.get(F.lit(common), F.col("band"))).select("rep", "band")
        open_rows, open_path = write_stage(left.join(broadcast_if_small(several), ["rep", "band"], "left_semi"), "open")
        drop_stage(self.spark, left_path)
        if open_rows.isEmpty():
            drop_stage(self.spark, open_path)
            return None, []
        return open_rows, [open_path]

    def again(self, dear: DataFrame, paths: list[str], deal: int, how: str, all_pairs: bool = False):
        """A round with further keys of the sets that have dear keys."""
        further = _further_keys(self.docs, self.reps, dear, self.words, self.bands, deal, how)
        members, path = write_stage(further, "further")
        drop_stage(self.spark, *paths)
        common = {"prefix": None, "whole": self.equal, "less": self.nearly}[how]
        out = self.round(members, common, all_pairs, placed=how == "prefix")
        drop_stage(self.spark, path)
        return out

    def run(self, members: DataFrame, prefixes: bool = True) -> DataFrame:
        """node, root: the classes of all sets that link and share a key (key, band, slot, rep, size, at).

        The keys are those of prefixes, or (``prefixes`` false) any that linked sets share.
        """
        dear, paths = self.round(members, placed=prefixes)
        if dear is not None and not prefixes:
            dear, paths = self.again(dear, paths, 0, "prefix")
        if dear is not None:
            dear, paths = self.again(dear, paths, 0, "whole")
        for deal in range(REDEALS + 1):
            if dear is None:
                break
            dear, paths = self.again(dear, paths, deal, "less", all_pairs=deal == REDEALS)
            if dear is not None:
                dear, paths = self.again(dear, paths, deal + 1, "whole")
        return self.classed()


def classes(docs: DataFrame, words: int = WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Each document with the size of its set and the class that links connect it to.

    Columns: doc_id, ``n_shingles`` (distinct runs of ``words`` words; a text of fewer words is
    one run), ``component_id`` (the smallest doc_id reachable by links, itself included). A-Z is
    lower-cased. Two documents link when their sets' Jaccard likeness is at least the threshold.
    Null and empty texts, and texts without a word, have size 0 and link with nothing: each is
    its own class. Rows that repeat a doc_id are documents of their own; rows with a null doc_id
    link too, and a class made of them alone has a null component_id. Other columns are ignored.
    One row per input row; an empty table gives none.
    """
    spark = split_hot_joins(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bands = Bands(threshold)
    signed, signed_path = write_stage(_signatures(docs, words, bands, order_of(docs, words)), "signed")
    first = signed.where("digest is not null").groupBy("digest").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least"))
    first, first_path = write_stage(first, "firsts")
    of_rep = signed.select("row", F.col("doc_id").alias("rep_id"), "text_hash", "size", "sketch")
    reps = of_rep.join(broadcast_if_small(first.select("rep", "least")), F.col("row") == F.col("rep")).drop("row")
    reps, reps_path = write_stage(reps, "reps")
    ids, _ = write_stage(signed.select("doc_id", "size", "digest").join(broadcast_if_small(first.select("digest", "rep")), "digest", "left").drop("digest"), "ids")
    one_each = signed.join(broadcast_if_small(first.select(F.col("rep").alias("row")), BROADCAST_NUMBERS), "row", "left_semi")
    members, members_path = write_stage(_shared_keys(one_each, bands), "shared")
    drop_stage(spark, signed_path, first_path)
    found = Join(docs, reps, words, bands).run(members)
    drop_stage(spark, members_path)
    least = found.join(reps.select("rep", "least"), F.col("node") == F.col("rep"))
    ends = least.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = found.join(ends, "root").select(F.col("node").alias("rep"), "component_id")
    alone = reps.join(found.select(F.col("node").alias("rep")), "rep", "left_anti").select("rep", F.col("least").alias("component_id"))
    named, _ = write_stage(linked.unionByName(alone), "named")
    drop_stage(spark, reps_path)
    out = ids.join(broadcast_if_small(named), "rep", "left")
    return out.select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
