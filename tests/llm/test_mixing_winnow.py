import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from matchweave.llm import mixing, winnow


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def slow_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over


SOURCES = ["b", "a", "é", "z", "Z", "", None]


def mixed_rows(seed=3, many=900):
    random.seed(seed)
    rows = []
    for i in range(many):
        source = "a" if i % 3 == 0 else SOURCES[i % 7]
        n = random.choice([0, 1, 5, 20, 20, 60]) if source != "z" else 2
        rows.append((i, " \t".join(["w"] * n), (source, "en")))
    return rows + [(3, None, ("a", "en")), (None, "null id here", ("b", None)), (None, "null id here", ("b", None)), (5, "again and again", ("a", "en")), (5, "again and again", ("a", "en"))]


def test_mix_plan(documents):
    rows = mixed_rows()
    plan = mixing.mix_plan(documents(rows)).collect()
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in plan) == Counter((d, words(t), s[0]) for d, t, s in rows)
    sizes = Counter()
    for _, t, (s, _) in rows:
        sizes[s] += words(t)
    want, taken, largest = slow_targets(sizes), Counter(), Counter()
    for r in plan:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
        assert r["taken"] in {k * r["size"] for k in range(3)} and r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6


def test_mixing_repeats_in_any_layout(documents):
    docs = documents([r for r in mixed_rows() if r[0] is not None])
    first = Counter(map(tuple, mixing.mix_plan(docs).collect()))
    assert first == Counter(map(tuple, mixing.mix_plan(docs.repartition(7, "doc_id")).collect()))


def test_mixing_edges(documents):
    assert mixing.mix_plan(documents([])).count() == 0
    assert [r["taken"] for r in mixing.mix_plan(documents([(1, None), (2, " ")])).collect()] == [0, 0]
    one = mixing.mix_plan(documents([(1, "a b"), (2, "c d")])).collect()
    assert sum(r["taken"] for r in one) == 6 and {r["target"] for r in one} == {6.0}


def test_mix_repeats_rows(documents):
    docs = documents(mixed_rows(many=300))
    plan = Counter()
    for r in mixing.mix_plan(docs).collect():
        plan[(r["doc_id"], r["source"], r["size"])] += r["copies"]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = Counter((r["doc_id"], r["source"], words(r["text"])) for r in mixed.collect())
    # rows without words are drawn one by one; equal rows may differ, their sum does not
    assert {k: n for k, n in got.items() if k[2] and k[0] is not None} == {k: n for k, n in plan.items() if n and k[2] and k[0] is not None}


def test_rounding_keeps_expected_fractions(spark):
    rows = [(i, i, "s", 10, 0.3) for i in range(400)]
    units = spark.createDataFrame(rows, "row long, key long, source string, size long, p double")
    total = Counter()
    for seed in range(4):
        got = dict(map(tuple, mixing.pivotal_rounding(units, seed=seed * 31, group=16, fan_in=4).collect()))
        assert len(got) == 400 and sum(got.values()) == 120
        total.update(i for i, x in got.items() if x)
    assert 150 < len(total) < 400  # different documents in different draws


def slow_marks(text, hash_of, k=winnow.K, window=2**winnow.WINDOW_DOUBLINGS):
    tokens = re.findall(r"[^\x20\x09-\x0D]{1,8}", text or "")
    if not tokens:
        return set()
    runs = [tuple(tokens[i : i + k]) for i in range(max(len(tokens) - k + 1, 1))]
    hashes = [hash_of[r] for r in runs]
    out = set()
    for i in range(max(len(hashes) - window + 1, 1)):
        block = hashes[i : i + window]
        low = min(block)
        out.add((low, i + max(j for j, h in enumerate(block) if h == low)))
    return out


def run_hashes(spark, texts):
    """Hash of every run of tokens, from Spark's own hash function."""
    from pyspark.sql import functions as F

    runs = set()
    for text in texts:
        tokens = re.findall(r"[^\x20\x09-\x0D]{1,8}", text or "")
        runs |= {tuple(tokens[i : i + winnow.K]) for i in range(max(len(tokens) - winnow.K + 1, 1)) if tokens}
    df = spark.createDataFrame([(list(r),) for r in runs], "r array<string>")
    hashed = F.transform("r", lambda t: F.xxhash64(t))
    out = {}
    for n in range(1, winnow.K + 1):
        of_size = df.where(F.size("r") == n).select("r", hashed.alias("h"))
        value = F.xxhash64(*[F.col("h")[i] for i in range(n)]).bitwiseAND(F.lit(winnow.POSITIONS))
        out |= {tuple(r): h for r, h in of_size.select("r", value).collect()}
    return out


def edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def jaccard(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_winnowing_against_brute_force(spark, documents):
    random.seed(2)
    texts = ["", None, "one", "one two", "one two three", "same same same same same same same same", "日本語のとても長い文章です" * 9, "\x1fé\U0001f600 " * 5]
    texts += [" ".join(random.choices(["alpha", "be", "gamma", "delta", "extraordinary", "f"], k=random.randrange(80))) for _ in range(60)]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in winnow.with_edits(documents(rows)).collect()}
    assert len(got) == len(rows)
    ordered = sorted(rows, key=lambda r: -r[0])
    plain = [t or "" for _, t in ordered]
    nexts = plain[1:] + plain[:1]
    edits = [edited(a, b) for a, b in zip(plain, nexts)]
    hash_of = run_hashes(spark, plain + edits)
    marks = [slow_marks(t, hash_of) for t in plain]
    for n, (doc_id, _) in enumerate(ordered):
        r = got[doc_id]
        assert r["n_chars"] == len(plain[n])
        assert r["edited_sha256"] == hashlib.sha256(edits[n].encode()).hexdigest()
        assert {(m["hash"], m["position"]) for m in r["marks"]} == marks[n]
        assert r["near_edited"] == pytest.approx(jaccard(marks[n], slow_marks(edits[n], hash_of)))
        assert r["near_next"] == pytest.approx(jaccard(marks[n], marks[(n + 1) % len(marks)]))


def test_equal_texts_have_equal_fingerprints_whatever_the_row(documents):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (7, None), (8, "")]
    prints = defaultdict(set)
    got = winnow.with_edits(documents(rows)).collect()
    for r in got:
        prints[r["n_chars"]].add(r["fingerprint"])
    assert len(got) == 6 and len(prints[11]) == len(prints[0]) == 1
    assert winnow.with_edits(documents([])).count() == 0
    alone = winnow.with_edits(documents([(1, "a b c")])).first()
    assert alone["near_next"] == 1.0


def test_shared_run_is_always_found(spark):
    random.seed(4)
    guarantee = winnow.K + 2**winnow.WINDOW_DOUBLINGS - 1
    shared = " ".join(f"s{i}" for i in range(guarantee))
    rows = []
    for i in range(50):
        around = [" ".join(f"r{random.randrange(10**6)}" for _ in range(random.randrange(1, 12))) for _ in range(4)]
        rows.append((f"{around[0]} {shared} {around[1]}", f"{around[2]} {shared} {around[3]}"))
    df = spark.createDataFrame(rows, "x string, y string")
    for c in ("x", "y"):
        df = winnow.with_fingerprint(df, c, f"{c}{c}").withColumn(f"{c}_hashes", winnow.hashes(f"{c}{c}_chosen"))
    assert all(r[0] > 0 for r in df.select(winnow.likeness("x_hashes", "y_hashes")).collect())
