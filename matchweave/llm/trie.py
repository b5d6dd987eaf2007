"""Prefix trie of conversations, with what sharing prefixes saves, from padded turn-id matrices.

A turn's id is a pair of hashes of its role and text. Conversations are cut into blocks of
``DEPTHS`` turns; a block hangs from the hash of all turns before it, so that long conversations
are many short rows. Rows are dealt into shards by ranges of (block, hash before, turn ids,
conversation). A shard is a matrix of turn ids, padded with zeros and sorted by lexsort; a node
of depth d starts where one of the first d columns changes, and reduceat sums up every depth.

What a node says of its subtree is a sum over its members: a member adds one leaf where it is
the smallest of those that end in a leaf, and adds the words of each turn below whose node has
a smaller member. So partial nodes add up. Nodes that hold the first or last row of a shard may
go on in the next; their smallest members and sizes are put together first and handed back, and
the parts of these boundary nodes alone meet in a shuffle at the end.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchweave.llm.shared import WORD, columns, group_count, write_stage
from matchweave.sources.store import broadcast_if_small, split_hot_joins

# Turns of a matrix row at most.
DEPTHS = 64
# Turns of a shard, about.
SHARD_TURNS = 200_000
# Blocks of a conversation that one running sum takes at a time.
RUN = 1024
EMPTY = hashlib.sha256(b"").hexdigest()
# Fixed values of the rebuilding rule: conversations in one family, and heads of 0 to 3 turns.
FAMILY = 20
HEADS = 4

_NODE = (
    "depth long, k1 long, k2 long, open boolean, shard int, conv_id long, parent_conv_id long, up1 long, up2 long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends binary"
)


def turns(conversations: DataFrame) -> DataFrame:
    """conv, ``at`` (from 0), id1, id2, words of every turn, in the order of turns.

    A null turn comes first, and a null role or text is empty. Turns of one number are ordered
    by role and text; equal ones stay as often as they are. Rows without a conversation have no
    place in any and are left out. A conversation of any length is spread over ranges of rows.
    """
    rows = columns(conversations, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").isNotNull().alias("has"),
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        # Equal rows differ by this alone, so that they need not share a range.
        F.xxhash64(F.monotonically_increasing_id()).alias("tie"),
    )
    order = ["conv", "has", "turn", "role", "text", "tie"]
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.where(F.col("conv").isNotNull())
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        "conv",
        F.xxhash64(F.lit(1), "role", "text").alias("id1"),
        F.xxhash64(F.lit(2), "role", "text").alias("id2"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"),
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("place"),
    )
    slim, _ = write_stage(ranged, "turns")
    starts = slim.groupBy("conv", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select("conv", "part", "first", F.coalesce(before, F.lit(0)).alias("before"))
    at = F.col("place") - F.col("first") + F.col("before")
    return slim.join(broadcast_if_small(starts), ["conv", "part"]).select("conv", at.alias("at"), "id1", "id2", "words")


def head_length(conv: Column) -> Column:
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(HEADS))


def rebuilt(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and sizes (conv, total) of conversations rebuilt on the heads of their families.

    Conversation c gets the first h turns of conversation c - c % 20 (all if fewer, none if
    absent) and then its own after its first h, where h is crc32 of c's decimal form, modulo 4.
    The remainder has the sign of c. A conversation may end up without turns.
    """
    lines, _ = write_stage(lines, "lines")
    sizes = lines.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    sizes, _ = write_stage(sizes, "sizes")
    base = F.col("conv") - F.col("conv") % F.lit(FAMILY)
    plan = sizes.select("conv", "n", base.alias("base"), head_length(F.col("conv")).alias("h"))
    of_base = sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    plan = plan.join(broadcast_if_small(of_base), "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0))))
    plan, _ = write_stage(plan.select("conv", "base", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "plan")
    own = lines.where(F.col("at") >= head_length(F.col("conv"))).join(broadcast_if_small(plan.select("conv", "h", "k")), "conv")
    own = own.select("conv", (F.col("at") - F.col("h") + F.col("k")).alias("at"), "id1", "id2", "words")
    heads = lines.where(F.col("at") < HEADS - 1).withColumnsRenamed({"conv": "base"})
    led = plan.where("k > 0").select("conv", "base", "k").join(heads, "base").where("at < k")
    return own.unionByName(led.select("conv", "at", "id1", "id2", "words")), plan.select("conv", "total")


def _before(blocks: DataFrame, total, names: list[str]) -> DataFrame:
    """``total`` (sum or xor) of some columns over a conversation's earlier blocks, in place of them.

    In two steps, so that a conversation of very many blocks is not one window.
    """
    names_of = lambda end: [f"{n}{end}" for n in names]
    runs = blocks.withColumn("run", F.floor(F.col("block") / RUN))
    inside = Window.partitionBy("conv", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    of_runs = runs.groupBy("conv", "run").agg(*[total(n).alias(f"{n}_sum") for n in names])
    of_runs = of_runs.select("conv", "run", *[total(f"{n}_sum").over(along).alias(f"{n}_run") for n in names])
    both = runs.select("conv", "block", "run", *[total(n).over(inside).alias(f"{n}_in") for n in names]).join(of_runs, ["conv", "run"])
    zero = lambda n: F.coalesce(F.col(n), F.lit(0))
    joined = [
        (zero(i).bitwiseXOR(zero(r)) if total is F.bit_xor else zero(i) + zero(r)).alias(n)
        for n, i, r in zip(names, names_of("_in"), names_of("_run"))
    ]
    return both.select("conv", "block", *joined)


def _rows(lines: DataFrame, sizes: DataFrame, depths: int) -> DataFrame:
    """One row per conversation and block, with the hash of all turns before and up to its end."""
    turn = F.struct("at", "id1", "id2", "words")
    blocks = lines.groupBy("conv", F.floor(F.col("at") / depths).alias("block")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    ids = F.flatten(F.transform("t", lambda x: F.array(x["id1"], x["id2"])))
    blocks = blocks.select("conv", "block", ids.alias("ids"), F.col("t.words").alias("words"))
    blocks = blocks.withColumns({f"d{i}": F.xxhash64(F.lit(i), "block", "ids") for i in (1, 2)})
    blocks, _ = write_stage(blocks, "blocks")
    none = F.array().cast("array<long>")
    sized = blocks.join(broadcast_if_small(sizes), "conv").unionByName(
        sizes.where("total = 0").select("conv", "total", F.lit(0).alias("block"), none.alias("ids"), none.alias("words")),
        allowMissingColumns=True,
    )
    long = F.col("total") > depths
    multi = sized.where(long)
    before = _before(multi.select("conv", "block", "d1", "d2"), F.bit_xor, ["d1", "d2"]).withColumnsRenamed({"d1": "p1", "d2": "p2"})
    zero = F.lit(0).cast("long")
    first = sized.where(~long).withColumns({"p1": zero, "p2": zero})
    rows = first.unionByName(multi.join(before, ["conv", "block"]).select(*first.columns))
    full = F.size("words") == depths
    ends = {f"q{i}": F.when(full, F.col(f"p{i}").bitwiseXOR(F.col(f"d{i}"))) for i in (1, 2)}
    return rows.withColumns(ends).select("block", "p1", "p2", "q1", "q2", "conv", "total", "ids", "words")


class _Shard:
    """A shard's sorted matrix, with the runs of rows that make up the nodes of each depth."""

    def __init__(self, table: pa.Table, depths: int):
        table = table.combine_chunks()
        get = lambda name: np.asarray(table.column(name).fill_null(0))
        words = table.column("words").combine_chunks()
        lens = np.asarray(words.value_lengths(), np.int64)
        flat = np.asarray(table.column("ids").combine_chunks().flatten(), np.int64).reshape(-1, 2)
        n, self.width, self.depths = len(lens), int(lens.max(initial=0)), depths
        by_id = np.lexsort((flat[:, 1], flat[:, 0]))
        fresh = np.any(flat[by_id[1:]] != flat[by_id[:-1]], axis=1)
        number = np.empty(len(flat), np.int64)
        number[by_id] = np.concatenate(([True], fresh)).cumsum()[: len(flat)]
        row = np.repeat(np.arange(n), lens)
        place = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)
        turn = np.zeros((n, self.width), np.int64)
        turn[row, place] = number
        said = np.zeros((n, self.width), np.int64)
        said[row, place] = np.asarray(words.flatten(), np.int64)
        block, p1, p2, conv = (get(c) for c in ("block", "p1", "p2", "conv"))
        order = np.lexsort((conv, *(turn[:, j] for j in reversed(range(self.width))), p2, p1, block))
        self.order, self.turn, self.words, self.lens = order, turn[order], said[order], lens[order]
        self.block, self.p1, self.p2, self.conv = block[order], p1[order], p2[order], conv[order]
        self.q1, self.q2, self.total = (get(c)[order] for c in ("q1", "q2", "total"))
        starts = np.cumsum(lens) - lens
        self.flat_of = lambda r: flat[starts[order[r]] : starts[order[r]] + lens[order[r]]]
        self.ends = self.total <= (self.block + 1) * depths
        change = np.concatenate(([True], (self.block[1:] != self.block[:-1]) | (self.p1[1:] != self.p1[:-1]) | (self.p2[1:] != self.p2[:-1])))
        self.masks = [change]
        for j in range(self.width):
            change = change | np.concatenate(([True], self.turn[1:, j] != self.turn[:-1, j]))
            self.masks.append(change)

    def runs(self, j: int) -> np.ndarray:
        return np.flatnonzero(self.masks[j])

    def key(self, row: int, j: int) -> tuple[int, int]:
        """Hash of the turns up to column j of a row."""
        if j == 0:
            return int(self.p1[row]), int(self.p2[row])
        if j == self.depths:
            return int(self.q1[row]), int(self.q2[row])
        head = np.array([self.block[row], self.p1[row], self.p2[row]], np.int64)
        digest = xxhash.xxh3_128_digest(head.tobytes() + self.flat_of(row)[:j].tobytes())
        return tuple(int(x) for x in np.frombuffer(digest, "<i8"))

    def edges(self, j: int) -> list[tuple[int, int]]:
        """(run number, row) of the nodes at column j that hold the first or the last row."""
        last = len(self.lens) - 1
        found = {} if self.lens[0] < j else {0: 0}
        if self.lens[last] >= j:
            found.setdefault(int(self.masks[j].sum()) - 1, last)
        return [(run, row) for run, row in found.items() if j or self.block[row] == 0]


def _edge_nodes(depths: int):
    def each(table: pa.Table) -> pa.Table:
        s, rows = _Shard(table, depths), []
        number = table.column("shard")[0].as_py()
        for j in range(s.width + 1):
            runs = s.runs(j)
            least = np.minimum.reduceat(s.conv, runs)
            ends = np.add.reduceat((s.ends & (s.lens == j)).astype(np.int64), runs)
            sizes = np.diff(np.append(runs, len(s.lens)))
            for run, row in s.edges(j):
                rows.append((number, int(s.block[row]) * depths + j, *s.key(row, j), int(least[run]), int(sizes[run]), int(ends[run])))
        names = ["shard", "depth", "k1", "k2", "least", "n", "n_ends"]
        kinds = [pa.int32(), *[pa.int64()] * 6]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return each


class _Measured(_Shard):
    """A shard with the whole smallest members and sizes of the nodes at its edges."""

    def __init__(self, table: pa.Table, edges: pa.Table, depths: int):
        super().__init__(table, depths)
        self.shard = table.column("shard")[0].as_py()
        known = {(e["depth"], e["k1"], e["k2"]): e for e in edges.to_pylist()}
        self.least, self.going_on, self.smaller = [], [], []
        leaf_member = np.zeros(len(self.lens), bool)
        for j in range(self.width + 1):
            runs = self.runs(j)
            least = np.minimum.reduceat(self.conv, runs)
            ends = np.add.reduceat((self.ends & (self.lens == j)).astype(np.int64), runs)
            leaf = ends == np.diff(np.append(runs, len(self.lens)))
            earlier = np.zeros(len(runs), bool)  # nodes that begin in an earlier shard
            for run, row in self.edges(j):
                whole = known[(int(self.block[row]) * depths + j, *self.key(row, j))]
                least[run], leaf[run], earlier[run] = whole["least"], whole["n"] == whole["n_ends"], whole["first"] < self.shard
            of_row = np.cumsum(self.masks[j]) - 1
            here = self.lens >= j
            self.least.append(least)
            self.going_on.append(earlier)
            self.smaller.append(here & (self.conv != least[of_row]))
            leaf_member |= self.ends & (self.lens == j) & leaf[of_row] & (self.conv == least[of_row])
        self.leaf = leaf_member.astype(np.int64)
        self.added = [self.words[:, j] * self.smaller[j + 1] for j in range(self.width)]


def _of_long_rows(depths: int):
    """conv, block, saved and leaves that the rows of conversations of several blocks add."""

    def each(table: pa.Table, edges: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, ["conv", "block", "saved", "leaves"])
        m = _Measured(table, edges, depths)
        long = m.total > depths
        saved = np.sum(m.added, axis=0) if m.added else np.zeros(len(m.lens), np.int64)
        return pa.table([m.conv[long], m.block[long], saved[long], m.leaf[long]], ["conv", "block", "saved", "leaves"])

    return each


def _nodes_of_shard(depths: int):
    """Nodes that are whole in the shard, and the parts of those that may not be."""
    names = [x.split()[0] for x in _NODE.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _NODE.split(", ")])

    def each(table: pa.Table, edges: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        m = _Measured(table, edges, depths)
        later, later_leaves = (np.asarray(table.column(c).fill_null(0))[m.order] for c in ("later", "later_leaves"))
        leaves = np.where(m.ends, m.leaf, later_leaves)
        saved = [later]  # from the last column back: what a member adds from a depth on
        for j in reversed(range(m.width)):
            saved.append(saved[-1] + m.added[j])
        saved = [saved[-1], *reversed(saved[1:])] if m.width else saved
        out = {name: [] for name in names}
        for j in range(m.width + 1):
            runs = m.runs(j)
            stops = np.append(runs[1:], len(m.lens))
            take = m.lens[runs] >= j
            if j < m.width:
                child_starts = m.masks[j + 1] & (m.lens > j)
                child_starts[m.runs(j + 1)[m.going_on[j + 1]]] = False
                children = np.add.reduceat(child_starts.astype(np.int64), runs)
            else:
                children = np.zeros(len(runs), np.int64)
            sizes, of_leaves, of_saved = stops - runs, np.add.reduceat(leaves, runs), np.add.reduceat(saved[j], runs)
            ending = np.add.reduceat((m.ends & (m.lens == j)).astype(np.int64), runs)
            opened = np.zeros(len(runs), bool)
            for run, _ in m.edges(j):
                opened[run] = True
            opened |= (j == 0) | (np.add.reduceat((~m.ends & (m.lens == j)).astype(np.int64), runs) > 0)
            above = m.least[j - 1][np.cumsum(m.masks[j - 1])[runs] - 1] if j else None
            for i in np.flatnonzero(take).tolist():
                row, block = int(runs[i]), int(m.block[runs[i]])
                only_children = j == 0 and block > 0  # the node itself belongs to the block before
                k1, k2 = m.key(row, j) if opened[i] else (None, None)
                ids = m.conv[:0]
                if ending[i] and not only_children:
                    # By rising number; padding puts members that end here first, but not at a block's end.
                    ids = m.conv[row : int(stops[i])][m.ends[row : int(stops[i])]] if j == depths else m.conv[row : row + int(ending[i])]
                digest = EMPTY
                if len(ids) and not opened[i]:
                    digest = hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()
                values = (
                    block * depths + j, k1, k2, bool(opened[i]), m.shard,
                    None if only_children else int(m.least[j][i]),
                    None if j == 0 or (j == 1 and block > 0) else int(above[i]),
                    *((int(m.p1[row]), int(m.p2[row])) if j == 1 and block > 0 else (None, None)),
                    0 if only_children else int(sizes[i]),
                    int(children[i]),
                    0 if only_children else int(of_leaves[i]),
                    0 if only_children else int(of_saved[i]),
                    digest,
                    ids.astype("<i8").tobytes() if opened[i] else None,
                )
                for name, value in zip(names, values):
                    out[name].append(value)
        return pa.table([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return each


def _digests(parts: DataFrame) -> DataFrame:
    """depth, k1, k2, sha256: over the ends of a node's parts in turn, only the running digest held."""

    def each(batches):
        now, running, first = None, None, True
        done = []

        def flush():
            rows = [(*k, d) for k, d in done]
            done.clear()
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["depth", "k1", "k2", "sha"])

        for batch in batches:
            for depth, k1, k2, ends in zip(*(batch.column(i) for i in range(4))):
                key = (depth.as_py(), k1.as_py(), k2.as_py())
                if key != now:
                    if now is not None:
                        done.append((now, running.hexdigest()))
                    now, running, first = key, hashlib.sha256(), True
                ids = np.frombuffer(ends.as_py(), "<i8").tolist()
                running.update(("" if first else ",").encode() + ",".join(map(str, ids)).encode())
                first = False
            yield flush()
        if now is not None:
            done.append((now, running.hexdigest()))
        yield flush()

    held = parts.where(F.length("ends") > 0).select("depth", "k1", "k2", "shard", "ends")
    held = held.repartition("depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "shard").select("depth", "k1", "k2", "ends")
    return held.mapInArrow(each, "depth long, k1 long, k2 long, sha string")


def nodes(lines: DataFrame, sizes: DataFrame, depths: int = DEPTHS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the prefix trie of conversations given as turns, and their sizes (conv, total).

    One row per distinct sequence of first turns, the root (depth 0) included: conv_id (smallest
    member), depth, parent_conv_id (null for the root), n_convs (members), n_children, n_leaves
    (childless nodes in the subtree), saved_tokens (over the subtree, members but one times the
    words of a node's last turn), ends_sha256 (of the numbers, rising and joined by commas, of
    the members that end there). Conversations without turns are members of the root alone. No
    conversation gives no row. Equal conversations are all members of the same nodes.
    """
    rows, _ = write_stage(_rows(lines, sizes, depths), "blocks_rows")
    total = rows.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    order = ["block", "p1", "p2", "ids", "conv"]
    ranged = rows.repartitionByRange(group_count(total, shard_turns), *order).select(F.spark_partition_id().alias("shard"), "*")
    shards, _ = write_stage(ranged, "shards")
    at_edges, _ = write_stage(
        shards.groupBy("shard").applyInArrow(_edge_nodes(depths), "shard int, depth long, k1 long, k2 long, least long, n long, n_ends long"), "edges"
    )
    whole = at_edges.groupBy("depth", "k1", "k2").agg(
        F.min("least").alias("least"), F.sum("n").alias("n"), F.sum("n_ends").alias("n_ends"), F.min("shard").alias("first")
    )
    known, _ = write_stage(at_edges.select("shard", "depth", "k1", "k2").join(whole, ["depth", "k1", "k2"]), "known")
    by_shard = known.groupBy("shard")
    several = not rows.where(F.col("total") > depths).isEmpty()
    if several:
        added = shards.groupBy("shard").cogroup(by_shard).applyInArrow(_of_long_rows(depths), "conv long, block long, saved long, leaves long")
        added, _ = write_stage(added, "added")
        sums = added.groupBy("conv").agg(F.sum("saved").alias("all_saved"), F.sum("leaves").alias("later_leaves"))
        earlier = _before(added, F.sum, ["saved"]).withColumnRenamed("saved", "earlier")
        later = added.join(earlier, ["conv", "block"]).join(sums, "conv")
        later = later.select("conv", "block", (F.col("all_saved") - F.col("earlier") - F.col("saved")).alias("later"), "later_leaves")
        shards = shards.join(later, ["conv", "block"], "left")
    else:
        shards = shards.withColumns({"later": F.lit(0).cast("long"), "later_leaves": F.lit(0).cast("long")})
    found, _ = write_stage(shards.groupBy("shard").cogroup(by_shard).applyInArrow(_nodes_of_shard(depths), _NODE), "nodes")
    parts = found.where("open")
    node = ["depth", "k1", "k2"]
    joined = parts.groupBy(*node).agg(
        F.min("conv_id").alias("conv_id"),
        *[F.max(c).alias(c) for c in ("parent_conv_id", "up1", "up2")],
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    digests = _digests(parts)
    joined = joined.join(digests, node, "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY))).drop("sha")
    out = joined.unionByName(found.where(~F.col("open")).select(*joined.columns))
    if several:
        out, _ = write_stage(out, "joined")
        first = (F.col("depth") % depths == 1) & (F.col("depth") > 1) if depths > 1 else F.col("depth") > 1
        above = out.where((F.col("depth") % depths == 0) & F.col("k1").isNotNull())
        above = above.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("conv_id").alias("over"))
        hung = out.where(first).join(above, ["depth", "up1", "up2"], "left").withColumn("parent_conv_id", F.col("over"))
        out = out.where(~first).unionByName(hung.select(*out.columns))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return out.select(*names)


def trie_of_rebuilt(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations rebuilt on the heads of their families (`rebuilt`, `nodes`)."""
    split_hot_joins(conversations.sparkSession)
    return nodes(*rebuilt(turns(conversations)))
