import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from matchweave.llm import packing, token_counts
from matchweave.llm.tokens import PartEncoder, default_vocabulary, encoder_of

TEXTS = ["", None, "Hello, world! It's 2024.", "a" * 9000, "x " * 5000, "<|endoftext|> end", "naïve café ½ ²", "日本語 テキスト", "\x1c\x85\xa0 odd", "'re 'LL"]


def ids_of(text):
    encoded = encoder_of(default_vocabulary()).tokenizer.encode(text or "", add_special_tokens=False)
    return np.array(encoded.ids, "<u4").tobytes()


def test_encoder_equals_the_tokenizer_on_random_characters():
    random.seed(7)
    narrow = [chr(i) for i in range(256)]
    wide = narrow + [chr(random.randrange(256, 0xD7FF)) for _ in range(300)] + ["́", "　", "İ", "Σ", "ς", "<|", "|>", "\U0001f600"]
    word = list("abcdefghiklmnoprstuvwéA '")
    encoder = PartEncoder(default_vocabulary(), remembered=200, longest=12)
    texts = ["".join(random.choices([narrow, wide, word][n % 3], k=random.randrange(1, 40))) for n in range(3000)] + TEXTS
    got = [ids for at in range(0, len(texts), 100) for ids in encoder.encode(texts[at : at + 100])]
    assert got == [ids_of(t) for t in texts]


def test_token_counts_against_brute_force(documents):
    docs = documents([(i, t) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2]), (None, "one two")])
    lengths = [len(ids_of(t)) // 4 for t in [*TEXTS, TEXTS[2], "one two"]]
    histogram = token_counts.length_histogram(token_counts.encoded_lengths(docs))
    rows = token_counts.every_limit(histogram).collect()
    assert {r["context_limit"]: r["docs"] for r in rows} == Counter(lengths)
    for r in rows:
        limit = r["context_limit"]
        assert r["docs_longer"] == sum(n > limit for n in lengths)
        assert r["tokens_kept"] == sum(min(n, limit) for n in lengths)
        assert r["tokens_kept"] + r["tokens_lost"] == r["tokens_total"] == sum(lengths)
        assert r["quantile"] == pytest.approx(sum(n <= limit for n in lengths) / len(lengths))
    at = {r["context_limit"]: r for r in token_counts.at_limits(histogram, [0, 4, 3000]).collect()}
    assert {k: r["tokens_kept"] for k, r in at.items()} == {k: sum(min(n, k) for n in lengths) for k in (0, 4, 3000)}
    assert token_counts.quantiles(token_counts.every_limit(histogram), [0.5]).first()[0] == sorted(lengths)[(len(lengths) + 1) // 2 - 1]


def test_token_counts_of_nothing(documents):
    assert token_counts.every_limit(token_counts.length_histogram(token_counts.encoded_lengths(documents([])))).count() == 0


def check_packed(rows, expected, capacity):
    """Pieces cover the documents; sequences are gapless and hold at most the capacity."""
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_places_every_piece(documents):
    capacity, rows = 64, [(i, t) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2]), (None, "one two")]
    random.seed(1)
    rows += [(100 + i, " ".join(random.choices(["alpha", "be", "gamma", "d"], k=random.randrange(60)))) for i in range(200)]
    expected = Counter()
    for d, t in rows:
        ids = ids_of(t) + bytes(4)
        for n, at in enumerate(range(0, len(ids), 4 * capacity)):
            part = ids[at : at + 4 * capacity]
            expected[(d, n, at // 4, len(part) // 4, zlib.crc32(part))] += 1
    packed = packing.pack_pieces(packing.token_pieces(documents(rows), capacity), capacity, group=32).collect()
    total = sum(k[3] * n for k, n in expected.items())
    used = check_packed(packed, expected, capacity)
    assert -(-total // capacity) <= used <= -(-total // capacity) * 1.1 + 2


def test_packing_of_nothing(documents):
    assert packing.pack_documents(documents([]), 64).count() == 0


def test_pieces_can_carry_their_ids(documents):
    rows = packing.token_pieces(documents([(1, "a b c d e")]), 4, with_ids=True).orderBy("piece").collect()
    assert b"".join(r["ids"] for r in rows) == ids_of("a b c d e") + bytes(4)
    assert [r["start"] for r in rows] == [0, 4]


def test_local_search_raises_squared_fill_and_empties_bins():
    # one item a bin at first: exchanges and moves must bring six bins to three full ones
    sizes, capacity = [6, 5, 4, 5, 7, 3], 10
    start = [[i] for i in range(len(sizes))]
    packed = packing.local_search(sizes, start, capacity)
    squares = lambda bins: sum(sum(sizes[i] for i in b) ** 2 for b in bins)
    assert sorted(i for b in packed for i in b) == list(range(6))
    assert len(packed) == 3 and squares(packed) == 300 > squares(start)


def test_local_search_swaps_two_for_one():
    sizes, capacity = [6, 3, 4, 3], 10  # {6, 3} and {4, 3}: full bins need 6 + 4 and 3 + 3
    packed = packing.local_search(sizes, [[0, 1], [2, 3]], capacity)
    assert sorted(sum(sizes[i] for i in b) for b in packed) == [6, 10]
    sizes = [5, 4, 3, 3]  # {5, 4} takes {3, 3} for its 5
    packed = packing.local_search(sizes, [[0, 1], [2, 3]], capacity)
    assert sorted(sum(sizes[i] for i in b) for b in packed) == [5, 10]


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_and_search_keep_the_capacity(seed):
    random.seed(seed)
    sizes = [random.randrange(1, 2048) for _ in range(400)]
    first = packing.best_fit(sizes, 2048)
    packed = packing.local_search(sizes, first, 2048)
    assert sorted(i for b in packed for i in b) == list(range(400))
    assert all(sum(sizes[i] for i in b) <= 2048 for b in packed)
    assert len(packed) <= len(first)
