import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from matchweave.llm import linear, mixing, quality, simhash, toxicity

GOOD = "the river runs past old stone houses where people walk and talk about small things each day".split()


def prose(rng, many):
    return " ".join(rng.choice(GOOD) + rng.choice("abcdefgh") for _ in range(many)).capitalize() + "."


def corpus(many=500, seed=9):
    """Rows of (doc_id, text, source, lang, quality, toxic)."""
    rng, rows = random.Random(seed), []
    for i in range(many):
        text, good, toxic = prose(rng, rng.randrange(20, 90)), 1, 0
        kind = i % 10
        if kind == 1:
            text, good = " ".join([rng.choice(GOOD)] * 60), 0
        elif kind == 2:
            text, good = "!! ".join(text.upper().split()) + "!!", 0
        elif kind == 3:
            words = text.split()
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "trash", "scum", "lowei" + rng.choice("abcd")]))
            text, toxic = " ".join(words), 1
        rows.append((i, text, f"site{i % 4}" if i % 3 else "hot", "en" if i % 2 else None, good, toxic))
    return rows


def tables(spark, rows, labelled=lambda i: i % 7 < 4):
    docs = [(i, t, lang, s, len(t or ""), "x", 0.5, 1, 2, 3, 4, 5) for i, t, s, lang, _, _ in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxic string, p_toxic double, kept int"
    schema += ", good int, many int, host_good int, host_many int"
    labels = [(i, q, x, "y") for i, _, _, _, q, x in rows if i is not None and labelled(i)]
    labels += [(None, 1, 1, "y"), (1, None, None, "y")] + labels[:3]
    return spark.createDataFrame(docs, schema).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


ODD = [(900, None, "hot", "en", 1, 0), (901, "", None, None, 1, 0), (None, "plain words walk on", "hot", None, 1, 0), (903, "river " * 40_000, "b", "en", 0, 0)]


def test_toxicity_on_documents_without_label(spark):
    rows = corpus()
    docs, labels = tables(spark, rows + ODD)
    got = toxicity.judge(docs, labels)
    assert got.columns == ["doc_id", "p_insult", "p_contempt", "p_toxic", "toxic"]
    judged = {r["doc_id"]: r for r in got.collect()}
    assert len(judged) == len(rows) + len(ODD)
    wrong = [i for i, *_, toxic in rows if judged[i]["toxic"] != bool(toxic)]
    assert len(wrong) <= 0.02 * len(rows)
    assert not any(judged[i]["toxic"] for i in (900, 901, None))


def test_without_toxic_keeps_the_columns_and_the_rest(spark):
    rows = corpus(200) + [corpus(200)[4]]
    docs, labels = tables(spark, rows)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {(r["p_toxic"], r["toxic"], r["many"]) for r in kept.collect()} == {(0.5, "x", 3)}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, *_, toxic in rows if not toxic)


def test_chain_equals_its_parts_one_after_another():
    rng = np.random.default_rng(0)
    held = [sorted(set(rng.integers(0, 6, rng.integers(0, 4)))) for _ in range(300)]
    x = toxicity.cells(held, 6)
    first = np.array([0 in h for h in held], int)
    marks = np.stack([first, ((first == 1) | np.array([1 in h for h in held])).astype(int)], axis=1)
    weights, how = toxicity.fit_chain(x, marks), (toxicity.SPARSE, toxicity.RIDGE, toxicity.STEPS)
    fold, beyond = np.arange(300) % toxicity.FOLDS, np.zeros(300)
    for f in range(toxicity.FOLDS):
        beyond[fold == f] = linear.predict(x.some(fold == f), linear.fit_logistic(x.some(fold != f), marks[fold != f, 0].astype(float), *how))
    assert np.allclose(weights[0], linear.fit_logistic(x, marks[:, 0].astype(float), *how))
    assert np.allclose(weights[1], linear.fit_logistic(x.with_column(beyond), marks[:, 1].astype(float), *how))
    assert len(weights[1]) == len(weights[0]) + 1


def test_logistic_finds_the_least_loss():
    rng = np.random.default_rng(3)
    dense = rng.integers(0, 2, (400, 5))
    y = (rng.random(400) < linear.sigmoid(dense @ [2, -1, 0, 1, 0] - 0.5)).astype(float)
    rows, cols = np.nonzero(dense)
    x = linear.Cells(rows, cols, dense.shape)
    w = linear.fit_logistic(x, y, ridge=1e-3, steps=3000)
    gradient = np.append(dense.T @ (linear.predict(x, w) - y) / 400 + 1e-3 * w[:-1], (linear.predict(x, w) - y).mean())
    assert np.abs(gradient).max() < 1e-4
    assert np.allclose(x.times(w[:-1]), dense @ w[:-1])


def test_classifiers_without_labels_or_documents(spark):
    docs, labels = tables(spark, corpus(30))
    none = labels.limit(0)
    assert toxicity.judge(docs, none).where("toxic").count() == 0
    assert quality.judge(docs, none).count() == 30
    for judged in (toxicity.judge(docs.limit(0), labels), quality.judge(docs.limit(0), labels)):
        assert judged.count() == 0


def test_quality_on_documents_without_label(spark):
    rows = corpus()
    docs, labels = tables(spark, rows + ODD)
    judged = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    assert len(judged) == len(rows) + len(ODD)
    right = [judged[i]["kept"] == bool(q) for i, _, _, _, q, _ in rows]
    assert sum(right) >= 0.98 * len(right)
    assert all(judged[i]["kept"] for i, _, _, _, q, _ in rows if q)


def slow_posterior(rows):
    """Shares and posteriors of (host, path, p) rows, by plain loops."""
    hosts, paths = defaultdict(list), defaultdict(list)
    for h, a, p in rows:
        hosts[h].append(p)
        paths[h, a].append(p)
    base = sum(p for _, _, p in rows) / len(rows)

    def strength(groups, mean):
        gaps = sum((sum(v) - len(v) * mean(k)) ** 2 for k, v in groups.items())
        chance = sum(len(v) * mean(k) * (1 - mean(k)) for k, v in groups.items())
        more = sum(len(v) * (len(v) - 1) * mean(k) * (1 - mean(k)) for k, v in groups.items())
        likeness = (gaps - chance) / more if more else 0
        return min(max((1 - likeness) / likeness, 1.0), 1e6) if likeness > 0 else 1e6

    k = strength(hosts, lambda _: base)
    share = {h: (sum(v) + k * base) / (len(v) + k) for h, v in hosts.items()}
    m = strength(paths, lambda key: share[key[0]])
    odds = lambda p: np.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    out = []
    for h, a, p in rows:
        host = (sum(hosts[h]) - p + k * base) / (len(hosts[h]) - 1 + k)
        path = (sum(paths[h, a]) - p + m * host) / (len(paths[h, a]) - 1 + m)
        z = odds(p) + quality.SITE_WEIGHT * (odds(path) - np.log(base / (1 - base)))
        out.append((host, path, 1 / (1 + np.exp(-z))))
    return out


def test_site_posteriors_against_plain_loops(spark):
    rng = random.Random(2)
    rows = []
    for h, rate in (("a", 0.95), ("b", 0.3), (None, 0.7), ("c", 0.9)):
        for n in range({"c": 2}.get(h, 60)):
            path = rng.choice(["x", "y", None])
            rows.append((h, path, min(max(rng.gauss(rate - 0.2 * (path == "y"), 0.15), 0.01), 0.99)))
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, source string, lang string, __p double")
    got = quality.with_posterior(df).orderBy("n").collect()
    want = slow_posterior(rows)
    for r, w in zip(got, want):
        assert (r["__host_share"], r["__path_share"], r["__posterior"]) == pytest.approx(w, rel=1e-9)
    assert got[0]["__host_share"] > got[70]["__host_share"]


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = [r for r in corpus(300)] + [(1000 + i, corpus(300)[0][1], "hot", "en", 1, 0) for i in range(30)]
    docs, labels = tables(spark, rows)
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    names = list(corpus_pipeline.DOCUMENT_COLUMNS)
    current = docs.select(*names)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "SimHash near-dedup", "mixing sources to target weights", "best-fit packing"]
    steps = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, current, folder).write.parquet(f"{folder}/{n}")
        current = spark.read.parquet(f"{folder}/{n}")
        assert n == 4 or current.columns == names
        steps.append(current.collect())
    clean = {i for i, *_, q, x in rows if q and not x}
    assert {r["doc_id"] for r in steps[0]} >= {i for i, *_, x in rows if not x}
    assert not {r["doc_id"] for r in steps[0]} & {i for i, *_, x in rows if x}
    assert {r["doc_id"] for r in steps[1]} == clean
    sets = {i: _five_words(t) for i, t, *_ in rows if i in clean}
    kept = {r["doc_id"] for r in steps[2]}
    assert kept == {i for i in clean if _least(i, sets) == i}
    sizes = Counter({s: sum(len(t.split()) for i, t, x, *_ in rows if i in kept and x == s) for s in {r[2] for r in rows}})
    taken = Counter()
    for r in steps[3]:
        taken[r["source"]] += len(r["text"].split())
    targets = dict(map(tuple, mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).select("source", "target").collect()))
    assert all(abs(taken[s] - targets[s]) <= 50 for s in sizes)
    want = Counter()
    for r in steps[3]:
        want[r["doc_id"]] += 1
    assert Counter(r["doc_id"] for r in steps[4] if r["piece"] == 0) == want
    fills = defaultdict(int)
    for r in steps[4]:
        fills[r["sequence_id"]] += r["length"]
    assert max(fills.values()) <= 2048 and len(fills) <= sum(fills.values()) / 2048 * 1.1 + 1
    ran = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect())
    assert ran == Counter(r["doc_id"] for r in steps[4])


def _least(i, sets):
    """Smallest id that likeness of 0.8 or more over five-word shingles reaches."""
    reached, todo = {i}, [i]
    while todo:
        a = todo.pop()
        for b, x in sets.items():
            both = len(sets[a] | x)
            if b not in reached and (not both or len(sets[a] & x) / both >= 0.8):
                reached.add(b)
                todo.append(b)
    return min(reached)


def _five_words(text):
    words = text.lower().split()
    return {tuple(words[n : n + 5]) for n in range(max(len(words) - 4, 1))} if words else set()


def test_seeded_choices_do_not_follow_crc(spark):
    # folds of other operators must not decide what a sample holds
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1000)], "doc_id long, quality int, toxic int")
    chosen = [r["doc_id"] for r in linear.sampled_labels(labels, "toxic", 300).collect()]
    folds = Counter(zlib.crc32(str(i).encode()) % 5 for i in chosen)
    assert len(chosen) == 300 and min(folds.values()) > 30
