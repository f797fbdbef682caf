"""Hard negatives against all pairs, and the bounds against exact scores."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weightloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    first = lambda found: sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))
    out = []
    for i, label, v in sorted(set(x for x in kept if x[0] is not None and x[0] % 50 == 0)):
        others = [(sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in kept if j != i and len(w) == len(v)]
        for p, j, _ in first([x for x in others if x[2] == label])[:5]:
            fit = [x for x in others if x[2] != label and 50 * p <= 100 * x[0] <= 95 * p]
            out += [(i, j, k + 1, n, p, s) for k, (s, n, _) in enumerate(first(fit)[:3])]
    return out


def key(r):
    return tuple((x is not None, str(x)) for x in r)


def clustered(n=700, width=24, seed=1):
    """Rows around a few centres: ties, repeats, nulls, other widths and awkward components among them."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.4, (6, width))
    rows = []
    for i in range(n):
        v = (centres[i % 6] + rng.normal(0, 0.05, width)).astype(np.float32)
        rows.append((i, [float(x) for x in (np.round(v * 8) / 8 if i % 3 else v)], int(rng.integers(0, 3)) if i % 2 else 1))
    rows += [(n + 1, None, 1), (n + 2, [0.5] * width, None), (n + 3, [float("nan")] * width, 1), (n + 4, [float("inf")] + [0.0] * (width - 1), 1), (n + 5, [None] + [0.1] * (width - 1), 1)]
    rows += [(None, rows[10][1], 1), (None, rows[11][1], 2), rows[50], rows[51], rows[51], (100, rows[3][1], 2), (n + 6, [], 1), (750, [], 1), (800, [0.1] * 3, 1), (801, [0.2] * 3, 1), (802, [0.15] * 3, 2), (803, [0.1, 0.2, -0.1], 0)]
    return rows


def test_against_all_pairs(spark):
    rows = clustered()
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("mine")).repartition(5)
    got = negatives.hard_negatives(frame).collect()
    assert len(got) > 50 and sorted(map(tuple, got), key=key) == sorted(plain(rows), key=key)


def test_several_blocks_give_the_same(spark):
    rows = clustered(seed=3)
    frame = negatives.quantised(spark.createDataFrame(rows, SCHEMA))
    got = negatives.mine(frame, lambda i: i % 50 == 0, anchors=4).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows), key=key)


@pytest.mark.parametrize("rows", [[], [(0, [0.5, 0.5], 1)], [(None, [0.5], 1), (1, [0.25], 2)], [(0, [3e30, 1.0], 1), (1, [2e30, 1.0], 1), (50, [2.0, 1.0], 2)]])
def test_small_tables(spark, rows):
    assert negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_large_components_stay_exact(spark):
    big = lambda *x: [float(a) for a in x]
    rows = [(50, big(2**20, 1), 1), (51, big(2**20, 3), 1), (52, big(2**20 - 2**17, 5), 2), (53, big(2**20 - 2**17, 9), 2)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows)) and got


@pytest.mark.parametrize("width", [1, 3, 5, 16, 17, 64, 100])
def test_bounds_hold_and_tighten(width):
    rng = np.random.default_rng(width)
    x = np.floor(rng.normal(0, 60, (40, width)))
    exact, before = x @ x.T, np.inf
    for mean, spread in negatives.summary(x):
        centre, reach = mean @ mean.T, spread @ spread.T
        assert (np.abs(exact - centre) <= reach + 1e-6).all() and (reach <= before + 1e-6).all()
        before = reach


def test_bounds_leave_out_far_rows():
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 80, (2, 64))
    x = np.floor(centres[np.arange(400) % 2] + rng.normal(0, 4, (400, 64))).astype(np.int64)
    levels = [(a.astype(np.float32).astype(float), b.astype(np.float32).astype(float)) for a, b in negatives.summary(x.astype(float))]
    side = negatives.Side(np.arange(400), np.ones(400, bool), np.zeros(400, np.int64), x, levels)
    exact = x @ x.T
    need = np.sort(exact, axis=1)[:, -5]
    i, j, score = negatives.scored(side, side, np.ones((400, 400), bool), need, np.full(400, negatives.MOST))
    assert (score == exact[i, j]).all() and {(a, b) for a, b in zip(i.tolist(), j.tolist())} >= set(zip(*map(np.ndarray.tolist, np.nonzero(exact >= need[:, None]))))
    assert len(i) < 0.6 * exact.size
