"""Hard negatives against comparing all pairs, and the parts that choose blocks."""

import itertools
import math
import random

import numpy as np
import pytest

from matchweave.llm import hilbert, negatives

SCHEMA = "vec_id long, embedding array<float>, label int, x string, row int, block string, w int"


def slow(rows, every):
    kept = []
    for vec, x, label in rows:
        if None in (vec, x, label) or any(v is None or not math.isfinite(v) for v in x):
            continue
        whole = [math.floor(256 * float(np.float32(v))) for v in x]
        kept.append((vec, whole, (label + 1) % 10 if vec % 7 == 0 else label))
    out = []
    for i, (vec, x, label) in enumerate(kept):
        if vec % every:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y)), other, lab) for j, (other, y, lab) in enumerate(kept) if j != i]
        scored.sort()
        for p, positive, _ in [s for s in scored if s[2] == label][:5]:
            fit = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(vec, positive, n + 1, s[1], -p, -s[0]) for n, s in enumerate(fit)]
    return sorted(out)


def found(spark, rows, every, **how):
    table = spark.createDataFrame([(*r, "x", 1, "b", 2) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in negatives.mine(table, every, **how).collect())


def vectors(seed, many, width, labels):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, width))
    for n in range(many):
        label = int(rng.integers(labels))
        x = centres[label] * 0.3 + rng.normal(size=width) * 0.3
        yield n, [float(v) for v in x], label


@pytest.mark.parametrize("block,shelf_blocks", [(256, 64), (4, 3)])
def test_equals_all_pairs(spark, block, shelf_blocks):
    rows = list(vectors(1, 400, 12, 4))
    assert found(spark, rows, 10, block=block, shelf_blocks=shelf_blocks) == slow(rows, 10)


def test_ties_repeats_nulls_and_lengths(spark):
    rows = [(n % 40, [1.0, 0.5] if n % 3 else [1.0], n % 3) for n in range(200)]
    rows += [(200, None, 1), (None, [1.0], 1), (300, [1.0], None), (20, [float("nan")], 1), (40, [None], 2), (60, [], 0)]
    assert found(spark, rows, 20, block=8, shelf_blocks=2) == slow(rows, 20)


def test_one_vector_is_a_third_of_all(spark):
    rows = list(vectors(3, 200, 6, 3))
    rows += [(200 + n, [0.25] * 6, 1) for n in range(100)]
    assert found(spark, rows, 20, block=8, shelf_blocks=4) == slow(rows, 20)


def test_components_too_large_for_doubles(spark):
    rng = random.Random(2)
    rows = [(n, [float(rng.randrange(1, 100)) * 2.0**14, 3.0 + n], n % 2) for n in range(60)]
    assert found(spark, rows, 20, block=8, shelf_blocks=2) == slow(rows, 20)


def test_empty_table(spark):
    assert found(spark, [], 20) == []


def test_curve_steps_to_a_neighbour_every_time():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        along = hilbert.places(cells, bits)
        assert sorted(along.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(along)], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_every_product():
    rng = np.random.default_rng(4)
    anchors, rows = np.floor(rng.normal(size=(20, 7)) * 100), np.floor(rng.normal(size=(300, 7)) * 100)
    least, most = negatives.bounds(anchors, rows.min(axis=0)[None], rows.max(axis=0)[None])
    real = anchors @ rows.T
    assert (least[:, 0] <= real.min(axis=1)).all() and (most[:, 0] >= real.max(axis=1)).all()
