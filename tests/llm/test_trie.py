"""The trie of rebuilt conversations against plain loops over conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from matchweave.llm import trie

SCHEMA = "conv_id long, turn int, role string, text string, conv string, at int, words string, total int"


def slow_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, lines in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + lines[h:]
    members = defaultdict(list)
    for c, lines in built.items():
        for d in range(len(lines) + 1):
            members[tuple(lines[:d])].append(c)
    children, below = defaultdict(list), defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    out = []
    for node, convs in members.items():
        words = lambda n: len(re.findall(rb"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        ends = sorted(c for c in convs if len(built[c]) == len(node))
        out.append(
            (
                min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]),
                sum(not children[n] for n in below[node]), sum((len(members[n]) - 1) * words(n) for n in below[node]),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA).repartition(3)


def found(spark, rows, **how):
    made = trie.nodes(*trie.rebuilt(trie.turns(frame(spark, rows))), **how)
    return sorted((tuple(r) for r in made.collect()), key=repr)


def conversations(seed, many, longest, choices):
    rng, rows = random.Random(seed), []
    for c in range(many):
        c = rng.choice([c, c, -c, 20 * c])
        for turn in range(rng.randrange(1, longest)):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", None]), rng.choice(choices)))
    return rows


TEXTS = ["a b", "A", "", None, "  ", "x y z w", "é", "one two\tthree"]


@pytest.mark.parametrize("depths,shard_turns", [(64, 200_000), (3, 40), (1, 25)])
def test_equals_loops_for_any_block_and_shard(spark, depths, shard_turns):
    rows = conversations(1, 90, 9, TEXTS[:3])
    assert found(spark, rows, depths=depths, shard_turns=shard_turns) == slow_trie(rows)


def test_many_equal_conversations_over_many_shards(spark):
    """Most rows are one conversation, and one conversation is long; nulls and ties everywhere."""
    rows = [(20 * c + c % 2, t, "user", f"{t} same") for c in range(150) for t in range(4)]
    rows += [(7, None, "user", TEXTS[t % 5]) for t in range(200)]
    rows += conversations(2, 30, 6, TEXTS)
    rows += [(None, 1, "user", "no conversation"), (10**15, 0, "user", None), (10**15, 0, "user", None)]
    assert found(spark, rows, depths=4, shard_turns=60) == slow_trie(rows)


def test_conversations_without_turns_are_members_of_the_root(spark):
    # With one own turn, an absent family and a head of one turn or more nothing is left.
    rows = [(c, 0, "user", "only one") for c in range(1, 20)]
    nodes = found(spark, rows)
    assert nodes == slow_trie(rows)
    root = next(n for n in nodes if n[1] == 0)
    assert root[3] == 19 and root[7] != trie.EMPTY


def test_empty_table_gives_no_node(spark):
    assert found(spark, []) == []


def test_given_conversations(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    made = sorted((tuple(r) for r in trie.trie_of_rebuilt(table).collect()), key=repr)
    assert made == slow_trie(rows)
