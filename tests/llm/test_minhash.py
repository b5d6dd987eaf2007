import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from matchweave.llm import jaccard, minhash, shared, simhash


def slow_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def slow_kept(rows):
    """The smallest id of each class linked by likeness of 0.8 or more, comparing all pairs."""
    sets = {i: slow_shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] | sets[j])
            if i < j and (not both or len(sets[i] & sets[j]) / both >= 0.8):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in sets if find(i) == i}


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng, text, changes):
    out = list(text)
    for at in rng.sample(range(len(out)), changes):
        out[at] = f"x{rng.randrange(10**9)}"
    return out


def test_keep_one_finds_copies_at_every_likeness(documents):
    rng = random.Random(8)
    rows, pairs = [], 0
    for n in range(60):
        text = words(rng, 300)
        rows += [(10 * n, " ".join(text))]
        # one changed word takes up to ten shingles of 301: from 0.97 to below 0.8
        for m in range(1, 8):
            rows += [(10 * n + m, " ".join(edited(rng, text, m)))]
            a, b = slow_shingles(rows[-1][1]), slow_shingles(rows[-1 - m][1])
            pairs += 0.8 <= len(a & b) / len(a | b) < 0.95
    assert pairs > 200
    kept = {r["doc_id"] for r in simhash.keep_one(documents(rows)).collect()}
    assert kept == slow_kept(rows)


@pytest.mark.parametrize("pairs", [16, 0.01])
def test_keep_one_links_chains_also_in_large_buckets(documents, monkeypatch, pairs):
    # every text is like the one before it and unlike most others; with few pairs allowed every bucket is dealt again
    monkeypatch.setattr(jaccard, "PAIRS_PER_SET", pairs)
    monkeypatch.setattr(jaccard, "BOUNDED_PAIRS_PER_SET", pairs)
    rng = random.Random(9)
    text = words(rng, 200)
    rows = [(1000 + i, " ".join(words(rng, 200))) for i in range(20)] + [(2000, ""), (2001, None), (2002, " \t"), (2003, "one two"), (2004, "One  two")]
    for i in range(40):
        rows.append((i, " ".join(text)))
        text = edited(rng, text, 1 if i % 5 else 6)
    kept = {r["doc_id"] for r in simhash.keep_one(documents(rows)).collect()}
    assert kept == slow_kept(rows)
    assert len(kept) > 25


def test_band_keys_of_long_sets_and_of_parts():
    hashes = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 3 * minhash.HASHES_AT_ONCE, np.uint64))
    least = (hashes[:, None] * minhash._FACTORS + minhash._SHIFTS).min(axis=0)
    at = least.reshape(minhash.BANDS, -1)
    other = minhash.band_keys(hashes[: len(hashes) // 2])
    keys = minhash.band_keys(hashes)
    assert len(keys) == minhash.BANDS and len(set(keys.tolist())) == minhash.BANDS
    half = (hashes[: len(hashes) // 2, None] * minhash._FACTORS + minhash._SHIFTS).min(axis=0).reshape(minhash.BANDS, -1)
    assert [x == y for x, y in zip(keys, other)] == [bool((a == b).all()) for a, b in zip(at, half)]


def test_thousands_of_unlike_texts_in_one_bucket(documents, monkeypatch):
    """All texts share every band: what they meet there is bounded, and only the true copies link."""
    monkeypatch.setattr(minhash, "band_keys", lambda hashes: np.arange(minhash.BANDS, dtype=np.uint64))
    rng = random.Random(11)
    rows = [(i, " ".join(words(rng, 60))) for i in range(1500)]
    rows += [(5000 + i, " ".join(edited(rng, rows[i][1].split(), 1))) for i in range(0, 1500, 50)]
    kept = {r["doc_id"] for r in simhash.keep_one(documents(rows)).collect()}
    sets = {i: slow_shingles(t) for i, t in rows[1500:]}
    alike = {i for i, s in sets.items() if len(s & slow_shingles(rows[i - 5000][1])) / len(s | slow_shingles(rows[i - 5000][1])) >= 0.8}
    assert kept == {i for i, _ in rows} - alike and len(alike) > 10


def test_fingerprints_within_three_bits_share_a_table():
    rng = random.Random(3)
    for _ in range(300):
        value = rng.getrandbits(64)
        other = value
        for b in rng.sample(range(64), rng.randrange(4)):
            other ^= 1 << b
        keys, others = (simhash.table_keys(np.array([v], np.uint64)) for v in (value, other))
        assert len(set(keys.tolist())) == 20 and set(keys.tolist()) & set(others.tolist())


def test_keep_one_finds_copies_by_simhash_alone(documents, monkeypatch):
    # with bands that no two different texts share, only fingerprints can bring copies together
    monkeypatch.setattr(minhash, "band_keys", lambda hashes: np.array([xxhash.xxh64_intdigest(hashes.tobytes())], np.uint64))
    rng = random.Random(12)
    rows = [(10 * n, " ".join(words(rng, 400))) for n in range(40)]
    rows += [(i + 1, " ".join(edited(rng, t.split(), 1))) for i, t in rows]
    near = []
    for (i, t), (_, u) in zip(rows[:40], rows[40:]):
        a, b = (simhash.over_half(minhash.shingles(x.encode(), 5)) for x in (t, u))
        near += [i + 1] if (a ^ b).bit_count() <= simhash.RADIUS else []
    kept = {r["doc_id"] for r in simhash.keep_one(documents(rows)).collect()}
    assert len(near) > 20 and not kept & set(near)
    assert kept >= {i for i, _ in rows[:40]}


def test_fingerprints_that_share_blocks_by_chance_are_not_compared(spark, documents, monkeypatch):
    """All fingerprints share 33 bits and are far apart in the others: only the copy is compared."""
    met, counts = jaccard.Join.met, []
    monkeypatch.setattr(jaccard.Join, "met", lambda self, pairs: (counts.append(pairs.count()), met(self, pairs))[1])
    monkeypatch.setattr(minhash, "band_keys", lambda hashes: np.array([xxhash.xxh64_intdigest(hashes.tobytes())], np.uint64))
    rng = random.Random(14)
    rows = [(i, " ".join(words(rng, 30))) for i in range(80)]
    rows.append((80, rows[0][1] + " tail"))
    first = int(minhash.shingles(rows[0][1].encode(), 5)[0])
    far = lambda s: (1 if first in s.tolist() else xxhash.xxh32_intdigest(s.tobytes()) >> 1) << 33
    numbered = documents(rows).drop("__row").withColumnRenamed("doc_id", "__row")
    root = dict(map(tuple, minhash.row_classes(numbered, far, simhash.near_links).collect()))
    assert root == {i: i % 80 for i in range(81)}
    assert sum(counts) < 10


def test_the_pipeline_sends_small_batches_to_python(spark, documents):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        assert corpus_pipeline.drop_near_copies(spark, documents([(1, "one text")]), "").count() == 1
        sizes = spark.range(0, 3000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
        assert max(r["n"] for r in sizes.collect()) <= shared.ROWS_PER_BATCH
    finally:
        spark.conf.set(name, before)
