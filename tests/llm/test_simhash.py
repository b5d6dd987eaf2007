import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from matchweave.llm import simhash
from matchweave.llm.components import components


def slow_fingerprint(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(values):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = defaultdict(set)
    for i in range(len(values)):
        out[find(i)].add(values[i])
    return {frozenset(v) for v in out.values()}


TEXTS = ["", None, "  \t\n", "One", "one two", "One two three", "A b c d a b c d", "É é ß", "x y z", "w " * 70000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == slow_fingerprint(text)


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def clustered(seed, centres=12, members=40):
    """Random fingerprints and others a few bits from them, in every block of bits."""
    random.seed(seed)
    out = set()
    for _ in range(centres):
        value = random.getrandbits(64)
        for _ in range(members):
            out.add(value)
            low = random.choice([0, 0, 21, 42])
            for _ in range(random.randrange(5)):
                value ^= 1 << random.randrange(low, min(low + 22, 64))
    return sorted(out)


@pytest.mark.parametrize("direct", [256, 1])
def test_links_connect_all_within_three_bits(spark, monkeypatch, direct):
    # with 1 every bucket takes the way of the large ones
    values = clustered(5)
    if direct == 1:
        found = []
        for number, (first, width) in enumerate(simhash.BLOCKS):
            keep = ((1 << 64) - 1) ^ (((1 << width) - 1) << first)
            buckets = defaultdict(set)
            for v in values:
                for flip in [0] + [1 << b for b in range(64) if keep >> b & 1]:
                    buckets[(v ^ flip) & keep].add(v)
            for key, members in buckets.items():
                members = np.array(sorted(members), np.uint64)
                found += [(int(members[i]), int(members[j])) for i, j in simhash._looked_up_pairs(members, number, key)]
        links = spark.createDataFrame([(signed(a), signed(b)) for a, b in found], "a long, b long")
    else:
        links = simhash.near_links(spark.createDataFrame([(signed(v),) for v in values], "fp long"))
    if direct == 1:
        assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3 for a, b in links.collect())
    classes = defaultdict(set)
    for node, root in components(links).collect():
        classes[root].add(node & ((1 << 64) - 1))
    got = {frozenset(c) for c in classes.values()}
    assert got == {c for c in slow_classes(values) if len(c) > 1}


def test_components_of_chains_stars_and_repeats(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(1, 0), (1, 1), (None, 5), (200, 201), (201, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "x long, y long")).collect()))
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert got == want
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_classes_of_documents(documents):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(9, long), (4, long), (7, long + " tail"), (1, ""), (2, None), (3, " "), (5, "alone here now"), (None, "Alone here NOW"), (None, "nobody else at all"), (5, "alone here now")]
    got = Counter(map(tuple, simhash.classes(documents(rows)).collect()))
    near = (simhash.fingerprint(long.encode()) ^ simhash.fingerprint((long + " tail").encode())).bit_count() <= 3
    least = {9: 4, 4: 4, 7: 4 if near else 7, 1: 1, 2: 1, 3: 1, 5: 5}
    want = Counter((d, f"{slow_fingerprint(t):016x}", least[d] if d is not None else (5 if t[:1] == "A" else None)) for d, t in rows)
    assert got == want
    assert simhash.classes(documents([])).count() == 0


def test_keep_one_keeps_the_smallest_id(documents):
    rows = [(9, "same text here"), (4, "same text here"), (4, "same text here"), (None, "same text here"), (7, "other words now"), (None, "third one is new"), (None, "third one is new")]
    kept = simhash.keep_one(documents(rows))
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("4", "same text here"), ("7", "other words now"), ("None", "third one is new")]
    assert kept.columns == documents(rows).columns
    assert simhash.keep_one(documents([])).count() == 0
