import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from matchweave.llm import langid, topk


def slow_top(rows, k=5, every=50):
    whole = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for n, (q, x) in enumerate(whole):
        if q % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(x, v)), i) for m, (i, v) in enumerate(whole) if m != n)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


def vectors(spark, rows):
    full = [(i, v, 1, 2, 3) for i, v in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<float>, rank int, score long, cell long").repartition(3)


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 60)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=20)]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(9)]  # ties
    rows += [(50 * 100, None), (6000, [1.0, None]), (6050, [float("nan")]), (6100, [float("inf")]), (None, [1.0]), (7000, []), (7001, [1.0, 2.0])]
    rows += [(100, rows[100][1]), (7001, [1.0, 1.0])]  # a repeated row, a repeated id
    got = topk.nearest_of_every(vectors(spark, rows)).collect()
    assert Counter(map(tuple, got)) == Counter(slow_top(rows))


def test_top_k_of_few_or_no_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, [3.0, 4.0]), (7, [0.5])]
    assert Counter(map(tuple, topk.nearest_of_every(vectors(spark, rows)).collect())) == Counter(slow_top(rows))
    again = [(50, [1.0]), (50, [2.0]), (1, [1.0]), (1, [1.0]), (2, [3.0])]  # repeated ids are rows of their own
    assert Counter(map(tuple, topk.nearest_of_every(vectors(spark, again)).collect())) == Counter(slow_top(again))
    assert topk.nearest_of_every(vectors(spark, [])).count() == 0
    assert topk.nearest_of_every(vectors(spark, [(1, [1.0])])).count() == 0


def test_large_components_are_exact_and_stop_at_the_limits_of_a_long():
    queries, cands = np.array([[2.0**40], [1.0]]), np.array([[2.0**20, 2.0**60, -(2.0**60)], [3.0, 0.0, 0.0]])
    got = list(topk.best_of(queries, np.array([50]), cands, np.array([1, 2, 3])))
    assert got == [(0, 1, topk.LONG), (0, 0, 2**60 + 3), (0, 2, -topk.LONG)]


def test_branch_and_bound_drops_nothing():
    rng = np.random.default_rng(5)
    cands = np.floor(256 * rng.normal(size=(64, 3000)) * np.linspace(2, 0.01, 64)[:, None])
    queries, ids = cands[:, :20], np.arange(3000)
    got = list(topk.best_of(queries, ids[:20], cands, ids))
    for q in range(20):
        scores = queries[:, q] @ cands
        order = [i for i in np.lexsort((ids, -scores)) if i != q][:5]
        assert [(i, int(s)) for n, i, s in got if n == q] == [(i, int(scores[i])) for i in order]


def slow_codes(text):
    out, last = [], 0
    for c in text or "":
        kind = langid._class_of(c) if c.isalpha() else 0
        if kind or last:
            out.append(kind)
        last = kind
    if not out:
        return []
    n = langid.ORDER
    out = [0] * (n - 1) + (out if last else out[:-1]) + [0] * (n - 1)
    numbers = [sum(c << (langid.BITS * (n - 1 - j)) for j, c in enumerate(out[i : i + n])) for i in range(len(out) - n + 1)]
    return [x - (1 << 64) if x >> 63 else x for x in numbers]


@pytest.mark.parametrize("text", [None, "", "123 !?", "a", "  Hello,  World!! ", "ÀÉß日本 x", "\U0001d400\U0001f600b", "\U00020000 가힣힣힣힣", "1a2"])
def test_codes(text):
    assert langid.codes_of(text).tolist() == slow_codes(text)


def test_letters_keep_their_code_points():
    assert langid.codes_of("日本語の")[3] == np.array([ord("日") << 48 | ord("本") << 32 | ord("語") << 16 | ord("の")], np.uint64).view(np.int64)[0]


def slow_kneser_ney(grams, word):
    """log probability of the last of a tuple of classes, from counted tuples, by the textbook."""
    orders = {langid.ORDER: Counter(grams)}
    for n in range(langid.ORDER - 1, 0, -1):
        orders[n] = Counter(g[1:] for g in orders[n + 1])

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / langid.ALPHABET
        counts = orders[n]
        ones, twos = (sum(c == k for c in counts.values()) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        same = {k: c for k, c in counts.items() if k[:-1] == g[:-1]}
        total = sum(same.values())
        if not total:
            return p(g[1:])
        return max(counts.get(g, 0) - d, 0) / total + d * len(same) / total * p(g[1:])

    return math.log(p(word))


def tuples_of(text):
    codes = langid.codes_of(text).view(np.uint64)
    return [tuple(int(c) >> (langid.BITS * j) & (langid.ALPHABET - 1) for j in range(langid.ORDER - 1, -1, -1)) for c in codes]


@pytest.mark.parametrize("slice_rows", [1_000_000, 20])
def test_models_equal_the_textbook(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(langid, "SLICE_ROWS", slice_rows)
    texts = {"aa": ["banana bandana and ananas", "in a cabana, a band"], "日": ["日本語の文字", "文字と語"]}
    folds = [(x, False, t) for x, both in texts.items() for t in both] + [("aa", True, "sand and bands")]
    rows = spark.createDataFrame(folds, "lang string, calibrating boolean, text string")
    full, partial = langid.fit_models(langid.sequence_counts(rows))
    assert full.langs == partial.langs == ["aa", "日"] and (full.many > 3) == (slice_rows == 20)
    asked = ["banana xyz bandit", "語の文 band", "q", "Ω", *texts["aa"]]
    codes = [langid.codes_of(t) for t in asked]
    for models, seen in ((full, {**texts, "aa": [*texts["aa"], "sand and bands"]}), (partial, texts)):
        got = models.entropies(codes)
        for i, lang in enumerate(models.langs):
            grams = [g for t in seen[lang] for g in tuples_of(t)]
            wanted = [-sum(slow_kneser_ney(grams, g) for g in tuples_of(t)) / len(tuples_of(t)) for t in asked]
            assert got[:, i].tolist() == pytest.approx(wanted, rel=1e-5)


def test_long_texts_are_scored_in_pieces(spark, monkeypatch):
    rows = spark.createDataFrame([("aa", False, "wopi tulo mirena sobe kalu")], "lang string, calibrating boolean, text string")
    full, _ = langid.fit_models(langid.sequence_counts(rows))
    texts = [langid.codes_of(t) for t in ("wopi sobe " * 900, "", "tulo", "mirena kalu " * 300)]
    whole = full.entropies(texts)
    monkeypatch.setattr(langid, "CELLS", 1)
    assert full.entropies(texts)[:, 0].tolist() == pytest.approx(whole[:, 0].tolist())


LANGS = {"aa": "wopi tulo mirena sobe kalu ", "bb": "schrek druml knast vorpf zwilt ", "cc": "éàon îles çure ôdent ûmia "}


def language_rows(many=240):
    random.seed(11)
    rows = []
    for i in range(many):
        lang = random.choice(sorted(LANGS))
        words = LANGS[lang].split()
        text = " ".join("".join(random.choices(words, k=random.randrange(1, 3))) for _ in range(random.randrange(3, 40)))
        rows.append((i, text, ("x", lang)))
    return rows


def test_languages_are_found_on_held_out_documents(documents):
    rows = language_rows() + [(900, None, ("x", "aa")), (901, "123 ?!", ("x", "bb")), (902, "", ("x", None)), (None, "wopi tulo mirena", ("x", "zz")), (903, "schrek knast vorpf druml", ("x", None)), (903, "schrek knast vorpf druml", ("x", None))]
    got = langid.identify(documents(rows)).collect()
    assert len(got) == len(rows)
    of = defaultdict(list)
    for r in got:
        of[r["doc_id"]].append(r)
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    right = [of[i][0]["lang_pred"] == lang for i, _, (_, lang) in language_rows() if of[i][0]["held_out"]]
    assert sum(right) >= 0.95 * len(right)
    assert all(of[i][0]["lang_pred"] == "und" and of[i][0]["score"] == 0 for i in (900, 901, 902))
    assert of[None][0]["lang_pred"] == "aa"  # zz stands on no row with an id, so it is not learned
    assert [r["lang_pred"] for r in of[903]] == ["bb", "bb"]


def test_scripts_and_many_languages(documents):
    """Three scripts, two of them sharing Han, and a hundred languages of a few syllables each."""
    random.seed(5)
    words = {"zh": "天地 玄黄 宇宙 洪荒 日月 盈昃", "ja": "日月の 天地は いろは にほへと 宇宙を", "ru": "слово дело время мир"}
    syllables = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in "lnrst"]
    for i in range(100):
        words[f"x{i:02}"] = " ".join("".join(random.choices(syllables, k=2)) for _ in range(8))
    rows = []
    for i in range(2400):
        lang = sorted(words)[i % len(words)]
        rows.append((i, " ".join(random.choices(words[lang].split(), k=12)), ("x", lang)))
    got = {r["doc_id"]: r for r in langid.identify(documents(rows)).collect()}
    held = [(got[i]["lang_pred"], lang) for i, _, (_, lang) in rows if got[i]["held_out"]]
    assert len(got) == len(rows) and len(held) > 300
    assert sum(a == b for a, b in held) >= 0.98 * len(held)
    assert all(a == b for a, b in held if not b.startswith("x"))


def test_nothing_to_learn_from(documents):
    assert langid.identify(documents([])).count() == 0
    got = langid.identify(documents([(1, "some text", ("x", None))])).first()
    assert (got["lang_pred"], got["score"]) == ("und", 0.0)
