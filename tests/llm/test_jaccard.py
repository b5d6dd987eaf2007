"""The Jaccard join against comparing all pairs, and the promises its index rests on."""

import random

import numpy as np
import pytest

from matchweave.llm import jaccard
from matchweave.llm.shingling import shingles


def slow_sets(rows):
    out = []
    for _, text, *_ in rows:
        words = (text or "").encode().lower().split()
        out.append({tuple(words[i : i + 4]) for i in range(max(len(words) - 3, 1))} if words else set())
    return out


def slow(rows):
    sets, root = slow_sets(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            common = len(x & sets[j])
            if common and 100 * common >= 85 * (len(x) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        least.setdefault(find(i), []).append(doc)
    key = lambda d: (d is None, d)
    return sorted(((rows[i][0], len(s), min(least[find(i)], key=key)) for i, s in enumerate(sets)), key=repr)


def found(documents, rows):
    return sorted((tuple(r) for r in jaccard.classes(documents(rows)).collect()), key=repr)


def prose(rng, n, many=4000):
    return [f"w{rng.randrange(many)}" for _ in range(n)]


def edited(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        at = rng.randrange(len(out))
        out[at : at + rng.choice([0, 1])] = [f"x{rng.randrange(10**9)}"] * rng.choice([0, 1])
    return out


def test_pairs_at_every_likeness_and_length(documents):
    rng, rows = random.Random(5), []
    for n in range(120):
        text = prose(rng, int(4 + 2 ** rng.uniform(0, 9)))
        for copy in range(rng.randrange(1, 5)):
            rows.append((len(rows), " ".join(edited(rng, text, rng.randrange(0, 1 + len(text) // 20)))))
    assert found(documents, rows) == slow(rows)


@pytest.mark.parametrize("redeals,pairs", [(3, 0.01), (0, 0.01)])
def test_dear_keys_lose_no_link(documents, monkeypatch, redeals, pairs):
    """Many unlike texts that share most of a passage: nearly all keys are dear."""
    monkeypatch.setattr(jaccard, "PAIRS_PER_SET", pairs)
    monkeypatch.setattr(jaccard, "BOUNDED_PAIRS_PER_SET", pairs)
    monkeypatch.setattr(jaccard, "REDEALS", redeals)
    rng, rows = random.Random(6), []
    passage = prose(rng, 60)
    for _ in range(40):
        text = passage + prose(rng, rng.randrange(4, 30))
        rows += [(len(rows) + k, " ".join(edited(rng, text, k))) for k in range(3)]
    assert found(documents, rows) == slow(rows)


def test_a_large_group_of_near_copies_is_one_class(documents):
    rng = random.Random(7)
    text = prose(rng, 150)
    rows = [(n, " ".join(edited(rng, text, 2))) for n in range(400)]
    rows += [(400 + n, " ".join(text[: 40 + 3 * n])) for n in range(20)]
    assert found(documents, rows) == slow(rows)


def test_nulls_empty_short_long_and_repeated_rows(documents):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "One two"), (9, "one TWO"), (10, "one two three four"), (None, "one two")]
    rows += [(11, "a b c d e"), (11, "a b c d e"), (11, "other words than these before"), (None, None), (3, "é É ß"), (2, "é É ß")]
    rows += [(20, "again " * 40_000), (21, " ".join(map(str, range(30_000)))), (22, " ".join(map(str, range(100, 30_000))))]
    assert found(documents, rows) == slow(rows)


def test_empty_table_gives_no_row(documents, spark):
    assert jaccard.classes(spark.createDataFrame([], "doc_id long, text string, rep long, size int")).collect() == []


def test_linked_sets_share_a_key_and_a_key_with_one_left_out():
    rng, bands = np.random.default_rng(1), jaccard.Bands()
    for _ in range(300):
        size = int(2 ** rng.uniform(2, 11))
        x = np.unique(rng.integers(0, 1 << 62, size, dtype=np.uint64))
        # As different as the threshold allows: some of x left out, others added.
        drop = int(rng.integers(0, 15 * len(x) // 100 + 1))
        y = x[drop:]
        while True:
            more = np.union1d(y, rng.integers(0, 1 << 62, 1, dtype=np.uint64))
            common = len(np.intersect1d(x, more))
            if 100 * common < 85 * (len(x) + len(more) - common):
                break
            y = more
        if len(np.setxor1d(x, y)) == 0:
            continue
        assert len(np.intersect1d(bands.all_keys(x), bands.all_keys(y))), size
        all_dear = [bands.one_left_out(s, bands.all_keys(s))[0] for s in (x, y)]
        assert len(np.intersect1d(*all_dear)), size
        assert len(np.intersect1d(bands.all_keys(x), bands.all_keys(y)))


def test_sketches_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(2)
    for _ in range(100):
        x = np.unique(rng.integers(0, 1 << 62, int(rng.integers(1, 400)), dtype=np.uint64))
        y = np.union1d(x[int(rng.integers(0, len(x))) :], rng.integers(0, 1 << 62, int(rng.integers(0, 60)), dtype=np.uint64))
        a, b = jaccard.parities(x), jaccard.parities(y)
        n = min(len(a), len(b))
        folded = [np.bitwise_xor.reduce(s.reshape(-1, n), axis=0) for s in (a, b)]
        bits = int(np.bitwise_count((folded[0] ^ folded[1]).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(x, y))


def test_bands_are_no_wider_than_the_threshold():
    bands = jaccard.Bands()
    for size in [*range(1, 3000), 10**6]:
        own = [b for b in range(60) if bands.starts[b] <= size < bands.starts[b + 1]]
        if own and size < bands.starts[60]:
            largest = 100 * size // 85
            over = next(b for b in range(62) if bands.starts[b] <= largest < bands.starts[b + 1])
            assert over <= own[0] + 1
    assert shingles(b"a b c", 4).size == 1


def test_linked_sets_share_a_prefix_key_in_places_that_allow_it():
    rng, bands = np.random.default_rng(3), jaccard.Bands()
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 62, int(2 ** rng.uniform(0, 10)), dtype=np.uint64))
        drop = int(rng.integers(0, 15 * len(x) // 100 + 1))
        y = np.union1d(x[drop:], rng.integers(0, 1 << 62, int(rng.integers(0, 9)), dtype=np.uint64))
        common = len(np.intersect1d(x, y))
        if 100 * common < 85 * (len(x) + len(y) - common):
            continue
        order = jaccard.Order(rng.permutation(np.union1d(x, y))[: len(x) // 2])
        a, b = (order.prefix(s, 85, 100) for s in (x, y))
        places = [(i, int(np.flatnonzero(b == k)[0])) for i, k in enumerate(a) if k in b]
        assert any(len(y) <= bands.largest_partner(len(x), i) and len(x) <= bands.largest_partner(len(y), j) for i, j in places)


def test_copies_with_many_changes_of_their_own_are_not_compared_in_pairs(documents, monkeypatch):
    """150 copies of one text, each too far from all others, and unlike texts that share a passage."""
    met, counts = jaccard.Join.met, []
    monkeypatch.setattr(jaccard.Join, "met", lambda self, pairs: (counts.append(pairs.count()), met(self, pairs))[1])
    rng, rows = random.Random(13), []
    text, passage = prose(rng, 150), prose(rng, 60)
    for n in range(150):
        own = list(text)
        own[5 + n % 5 : 150 : 25] = [f"x{rng.randrange(10**9)}" for _ in own[5 + n % 5 : 150 : 25]]
        rows += [(n, " ".join(own)), (1000 + n, " ".join(passage + prose(rng, 25)))]
    got = found(documents, rows)
    assert got == slow(rows)
    assert sum(counts) < 300


def test_what_prefixes_leave_loses_no_link_in_segments(documents, monkeypatch):
    """With hardly any pairs allowed, the sets of all keys with several classes are dealt by segments."""
    for name in ("PLACED_PAIRS_PER_SET", "PAIRS_PER_SET", "BOUNDED_PAIRS_PER_SET"):
        monkeypatch.setattr(jaccard, name, 0.01)
    again, ways = jaccard.Join.again, []
    monkeypatch.setattr(jaccard.Join, "again", lambda self, dear, paths, deal, how, **more: (ways.append(how), again(self, dear, paths, deal, how, **more))[1])
    monkeypatch.setattr(jaccard, "REDEALS", 0)
    rng, rows = random.Random(6), []
    text = prose(rng, 60)
    for n in range(40):
        rows.append((n, " ".join(text)))
        text = edited(rng, text, 1 + n % 2)
    assert found(documents, rows) == slow(rows)
    assert ways and ways[0] == "whole"
