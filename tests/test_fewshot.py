"""Examples of every fold against plain Lloyd rounds from the same start."""

import hashlib

import numpy as np
import pytest

from weightloom.operators import fewshot as FS
from weightloom.operators.panel import FEATURES

ASSETS, DAYS, K = 3, 60, 4


def plain(x, fold, days, k, seed=42):
    """x: rows of the fold's training days. Nearest day, distance and size by cluster."""
    sd = x.std(axis=0, ddof=1)
    z = np.where(sd > 0, (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1), 0.0)
    order = sorted(range(len(days)), key=lambda i: hashlib.md5(f"{seed}|{fold}|{days[i]}".encode()).hexdigest())
    centres = z[order[:k]]
    while True:
        d2 = ((z[:, None] - centres[None]) ** 2).sum(axis=2)
        own = d2.argmin(axis=1)
        new = np.array([z[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(k)])
        if np.allclose(new, centres, atol=1e-12):
            break
        centres = new
    return {c: (days[np.flatnonzero(own == c)[d2[own == c, c].argmin()]], float(np.sqrt(d2[own == c, c].min())), int((own == c).sum())) for c in range(k) if (own == c).any()}


@pytest.fixture(scope="module")
def market(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(0, 2, (5, ASSETS, len(FEATURES)))
    x = centre[rng.integers(0, 5, DAYS)] + rng.normal(0, 0.5, (DAYS, ASSETS, len(FEATURES)))
    cross = rng.normal(0, 1, DAYS)
    names = ", ".join(f"{f} double" for f in FEATURES)
    rows = [(t, f"A{a}", a + 1, *map(float, x[t, a]), float(cross[t])) for t in range(DAYS) for a in range(ASSETS)]
    feats = spark.createDataFrame(rows, f"t int, asset string, ord int, {names}, cross_vol double")
    return np.concatenate([x.reshape(DAYS, -1), cross[:, None]], axis=1), feats


def test_all_folds_at_once(spark, market):
    x, feats = market
    folds = spark.createDataFrame([(1, 0, 20), (2, 0, 40), (3, 15, 60), (4, 0, 3)], "fold int, train_start int, train_end int")
    got = {}
    for r in FS.fold_representatives(feats, folds, K).collect():
        got.setdefault(r["fold"], {})[r["cluster"]] = (r["t"], r["distance"], r["members"])
    assert got.keys() == {1, 2, 3}  # three days are too few for four examples
    for fold, a, b in ((1, 0, 20), (2, 0, 40), (3, 15, 60)):
        want = plain(x[a:b], fold, list(range(a, b)), K)
        assert got[fold].keys() == want.keys()
        for c, (t, distance, members) in want.items():
            assert got[fold][c][0] == t and got[fold][c][2] == members and got[fold][c][1] == pytest.approx(distance, abs=1e-9)


def test_blocks_of_folds(spark, market):
    _, feats = market
    folds = spark.createDataFrame([(1, 0, 20), (2, 0, 40)], "fold int, train_start int, train_end int")
    reps = FS.fold_representatives(feats, folds, K)
    examples = FS.labelled_examples(feats, reps, "P4")
    blocks = {r["fold"]: r["examples"] for r in FS.fold_blocks(FS.example_blocks(examples, feats, 3, 5)).collect()}
    assert blocks.keys() == {1, 2}
    for text in blocks.values():
        lines = text.split("\n")
        assert [x for x in lines if x.startswith("### EXAMPLE")] == ["### EXAMPLE 1", "### EXAMPLE 2", "### EXAMPLE 3"]
        assert sum(x.startswith("- A") for x in lines) == 15 and sum('"A0": 0.3333' in x for x in lines) == 3
