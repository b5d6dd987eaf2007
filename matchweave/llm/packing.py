"""Packing tokenized documents into sequences of a fixed size.

Documents longer than a sequence are cut into full pieces, which are sequences of their
own, and a shorter rest. Pieces are packed in groups of a bounded number: best fit by
falling length gives a start, then a local search exchanges pieces one for one, two for
one, or moves them, whenever that raises the sum of squared fills. Fuller bins grow,
emptier bins drain until they vanish. Bins of a group that stay underfull give their
pieces back, to be packed with those of other groups.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchweave.llm.shared import group_count, write_stage
from matchweave.llm.tokens import default_vocabulary, encoder_of, slices

# Pieces in a group: the unit that one task packs at a time.
GROUP = 2048
# A bin at least this full keeps its pieces after a round.
FULL_SHARE = 0.995
# Rounds of packing; each takes only the pieces of underfull bins of the one before.
ROUNDS = 2
# The search of a group ends after this many passes, or when a pass changes nothing.
PASSES = 12


def token_pieces(
    docs: DataFrame,
    capacity: int = 2048,
    end_id: int = 0,
    vocabulary: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document, its ids followed by ``end_id``.

    Columns: doc_id, piece (from 0), start, length, ids_crc32 (of the ids as little-endian
    unsigned 32-bit numbers) and, on request, ids as bytes. A null or empty text is one
    piece that holds only the end id. Equal rows give equal pieces, one set per row.
    """
    import zlib

    path = vocabulary or default_vocabulary()
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    schema += ", ids binary" if with_ids else ""
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        encoder = encoder_of(path)
        step = 4 * capacity
        for batch in batches:
            for part in slices(batch):
                which, piece, start, length, crc, kept = [], [], [], [], [], []
                for row, ids in enumerate(encoder.encode(part.column(1).to_pylist())):
                    ids += end
                    for number, at in enumerate(range(0, len(ids), step)):
                        own = ids[at : at + step]
                        which.append(row)
                        piece.append(number)
                        start.append(at // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            kept.append(own)
                arrays = [
                    part.column(0).take(pa.array(which, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(kept, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, schema)


def best_fit(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Bins (lists of item numbers): each item, by falling size, into the fullest bin that takes it."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    free_mask = 0
    bins: list[list[int]] = []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        fitting = free_mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            at = room[free].pop()
            if not room[free]:
                free_mask &= ~(1 << free)
            bins[at].append(item)
            free -= size
        else:
            at = len(bins)
            bins.append([item])
            free = capacity - size
        room[free].append(at)
        free_mask |= 1 << free
    return bins


class _Search:
    """Items and bins of one group, with the items of underfull bins indexed by size."""

    def __init__(self, sizes: Sequence[int], bins: list[list[int]], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins = [set(b) for b in bins]
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        self.home = {i: n for n, b in enumerate(bins) for i in b}
        self.by_size: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.mask = 0
        for n, b in enumerate(self.bins):
            if self.fill[n] < capacity:
                for i in b:
                    self._index(i)

    def _index(self, item: int) -> None:
        size = self.sizes[item]
        self.by_size[size].add(item)
        self.mask |= 1 << size

    def _unindex(self, item: int) -> None:
        size = self.sizes[item]
        self.by_size[size].discard(item)
        if not self.by_size[size]:
            self.mask &= ~(1 << size)

    def largest(self, low: int, high: int, target: int) -> int | None:
        """Item of another, less full bin with the largest size in [low, high]."""
        found = self.mask & ((1 << (high + 1)) - 1)
        limit = self.fill[target]
        while found:
            size = found.bit_length() - 1
            if size < low:
                return None
            for item in self.by_size[size]:
                if self.home[item] != target and self.fill[self.home[item]] <= limit:
                    return item
            found &= ~(1 << size)
        return None

    def exchange(self, target: int, gives: list[int], source: int, takes: list[int]) -> None:
        """Move ``takes`` from source to target, and ``gives`` back."""
        moved = sum(self.sizes[i] for i in takes) - sum(self.sizes[i] for i in gives)
        for items, old, new in ((takes, source, target), (gives, target, source)):
            for i in items:
                self.bins[old].discard(i)
                self.bins[new].add(i)
                self.home[i] = new
        self.fill[target] += moved
        self.fill[source] -= moved
        if self.fill[target] == self.capacity:
            for i in self.bins[target]:
                self._unindex(i)

    def fill_up(self, target: int) -> bool:
        """Exchanges that bring one underfull bin nearer to full; true if any was made."""
        changed = False
        while (free := self.capacity - self.fill[target]) > 0:
            best: tuple[int, list[int], list[int]] | None = None
            item = self.largest(1, free, target)
            if item is not None:  # move
                best = (self.sizes[item], [], [item])
            for own in self.bins[target]:
                if best and best[0] == free:
                    break
                size = self.sizes[own]
                low = size + (best[0] if best else 0) + 1
                item = self.largest(low, min(size + free, self.capacity), target)
                if item is not None:  # one for one
                    best = (self.sizes[item] - size, [own], [item])
                    if best[0] == free:
                        break
                gained = best[0] if best else 0
                pair = self.pair(size + gained + 1, size + free, target)
                if pair:  # two for one, both from one bin
                    best = (sum(self.sizes[i] for i in pair) - size, [own], list(pair))
            if best is None:
                return changed
            self.exchange(target, best[1], self.home[best[2][0]], best[2])
            changed = True
        return changed

    def pair(self, low: int, high: int, target: int) -> tuple[int, int] | None:
        """Two items of one less full bin whose sizes add up to [low, high], the most first tried."""
        found = self.mask & ((1 << max(low, 1)) - 1)
        tried = 0
        while found and tried < 4:
            size = found.bit_length() - 1
            if size * 2 < low:
                return None
            for item in self.by_size[size]:
                source = self.home[item]
                if source == target or self.fill[source] > self.fill[target]:
                    continue
                for other in self.bins[source]:
                    if other != item and low <= size + self.sizes[other] <= high:
                        return item, other
                tried += 1
                if tried >= 4:
                    break
            found &= ~(1 << size)
        return None


def local_search(sizes: Sequence[int], bins: list[list[int]], capacity: int, passes: int = PASSES) -> list[list[int]]:
    """Bins after exchanges that each raise the sum of squared fills; empty bins are dropped.

    Bins are filled up from the fullest to the emptiest. Only less full bins give, so each
    exchange raises the sum of squares; the search ends when none is left or after ``passes``.
    """
    state = _Search(sizes, bins, capacity)
    for _ in range(passes):
        under = sorted((n for n, f in enumerate(state.fill) if 0 < f < capacity), key=lambda n: -state.fill[n])
        changed = [state.fill_up(n) for n in under if 0 < state.fill[n] < capacity]
        if not any(changed):
            break
    return [sorted(b, key=lambda i: (-sizes[i], i)) for b in state.bins if b]


def _pack_groups(pieces: DataFrame, capacity: int, groups: int, round_no: int, passes: int) -> DataFrame:
    """Pack each group; adds ``__bin`` (a number in the group), ``offset`` and ``__fill``."""

    def pack(table: pa.Table) -> pa.Table:
        sizes = table.column("length").to_pylist()
        packed = local_search(sizes, best_fit(sizes, capacity), capacity, passes)
        number, offset, fill = [0] * len(sizes), [0] * len(sizes), [0] * len(sizes)
        for at, items in enumerate(packed):
            total = 0
            for i in items:
                number[i], offset[i] = at, total
                total += sizes[i]
            for i in items:
                fill[i] = total
        for name, values in (("__bin", number), ("offset", offset), ("__fill", fill)):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    grouped = pieces.withColumn("__group", F.pmod(F.xxhash64(F.lit(round_no), "__row"), F.lit(groups)))
    schema = ", ".join(f"`{n}` {t}" for n, t in grouped.dtypes) + ", `__bin` long, offset long, `__fill` long"
    return grouped.groupBy("__group").applyInArrow(pack, schema)


def pack_pieces(
    pieces: DataFrame,
    capacity: int = 2048,
    group: int = GROUP,
    rounds: int = ROUNDS,
    full_share: float = FULL_SHARE,
    passes: int = PASSES,
) -> DataFrame:
    """Each piece with ``sequence_id`` and ``offset``, its place in the sequence.

    ``pieces`` needs a ``length`` of 1 to ``capacity`` and is written once, so that the
    grouping repeats exactly. Sequence numbers are unique but not gapless. An empty table
    gives no row.
    """
    names = pieces.columns
    staged, path = write_stage(pieces, "pieces")
    staged = staged.withColumn("__row", F.monotonically_increasing_id())
    out = staged.where(F.col("length") >= capacity).select(
        *names, (-1 - F.col("__row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest, paths = staged.where(F.col("length") < capacity), []
    for round_no in range(rounds):
        left = rest.count()
        if not left:
            break
        groups = group_count(left, group)
        packed, at = write_stage(_pack_groups(rest, capacity, groups, round_no, passes), "packed")
        paths.append(at)
        last = round_no == rounds - 1 or groups == 1
        done = packed if last else packed.where(F.col("__fill") >= F.lit(full_share * capacity))
        # round, group and bin make the number: 8, 31 and 24 bits
        number = (F.lit(round_no).cast("long") * (1 << 55)) + F.col("__group") * (1 << 24) + F.col("__bin")
        out = out.unionByName(done.select(*names, number.alias("sequence_id"), "offset"))
        if last:
            break
        rest = packed.where(F.col("__fill") < F.lit(full_share * capacity)).select(*names, "__row")
    return out


def pack_documents(docs: DataFrame, capacity: int = 2048, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """Tokenize, cut and pack; one row per piece."""
    return pack_pieces(token_pieces(docs, capacity, end_id, vocabulary), capacity)
