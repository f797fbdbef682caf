"""Snooping tests and stationary resamples against day-by-day brute force."""

import hashlib

import numpy as np
import pytest

from weightloom.operators import resample as B
from weightloom.operators import stats as T


def lanes(rep, t, seed=42):
    h = hashlib.md5(f"{seed}|{rep}|{t}".encode()).hexdigest()
    return [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


def plain_index(n, rep, p):
    out = []
    for t in range(n):
        u, start = lanes(rep, t)[:2]
        out.append(start % n if t == 0 or u / 2**32 < p else (out[-1] + 1) % n)
    return np.array(out)


def plain_variance(y, lags):
    n, y = len(y), y - y.mean()
    top = min(lags, n - 1)
    return max(y @ y / n + sum(2 * (1 - k / (top + 1)) * (y[k:] @ y[:-k]) / n for k in range(1, top + 1)), 0.0)


def plain_test(series, reps, p, lags, spa, studentise):
    def stat(y, observed):
        sd = np.sqrt(plain_variance(y, lags) / len(y)) if studentise else y.std(ddof=1) / np.sqrt(len(y))
        if sd <= (1e-12 if observed else 0):
            return np.sign(y.mean()) * 1e6 if observed and abs(y.mean()) > 1e-12 else 0.0
        return y.mean() / sd

    clip = (lambda v: max(v, 0.0)) if spa else (lambda v: v)
    seen = {k: clip(stat(y, True)) for k, y in series.items()}
    tops = [max(clip(stat((y - y.mean())[plain_index(len(y), rep, p)], False)) for y in series.values()) for rep in range(1, reps + 1)]
    return {k: (series[k].mean(), v, np.mean([x >= v for x in tops])) for k, v in seen.items()}


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(8)
    out = {f"s{i}": rng.normal(0.02 * i, 1, 40).cumsum() * 0.1 + rng.normal(0.1, 1, 40) for i in range(3)}
    return out | {"short": rng.normal(0.3, 1, 9), "tiny": np.array([0.1, -0.2, 0.4])}


@pytest.fixture(scope="module")
def frame(spark, series):
    return spark.createDataFrame([(k, t, float(x)) for k, y in series.items() for t, x in enumerate(y)], "series string, t int, diff double")


@pytest.mark.parametrize("p", [0.1, 0.6])
@pytest.mark.parametrize("lags", [0, 2, 5])
def test_run_sums(spark, frame, series, lags, p):
    got = {(r["series"], r["rep"]): r for r in B.run_replicates(B.positions(frame, "diff"), 12, p, lags).collect()}
    assert len(got) == 12 * len(series)
    for (k, rep), r in got.items():
        y = series[k][plain_index(len(series[k]), rep, p)]
        assert r["s"] == pytest.approx(y.sum(), abs=1e-9)
        for j in range(lags + 1):
            assert r[f"c{j}"] == pytest.approx(y[j:] @ y[: len(y) - j] if j < len(y) else 0.0, abs=1e-9), (k, rep, j)
            if j:
                assert r[f"head{j}"] == pytest.approx(y[:j].sum(), abs=1e-9) and r[f"tail{j}"] == pytest.approx(y[-j:].sum(), abs=1e-9)


@pytest.mark.parametrize("spa", [False, True])
@pytest.mark.parametrize("studentise", [False, True])
def test_against_brute_force(spark, frame, series, spa, studentise):
    long = {k: y for k, y in series.items() if k != "tiny"}
    got = {r["series"]: r for r in T.reality_check(frame.where("series <> 'tiny'"), 60, spa=spa, studentise=studentise).collect()}
    want = plain_test(long, 60, 0.1, 5, spa, studentise)
    assert got.keys() == want.keys()
    for k, (mean, t_like, p) in want.items():
        assert (got[k]["mean_diff"], got[k]["t_like"], got[k]["p"]) == pytest.approx((mean, t_like, p), abs=1e-9)


def test_block_test_needs_enough_draws(frame):
    few = B.block_bootstrap_p(frame, 7, 199).collect()
    assert len(few) == 5 and all(r["mbb_p"] is None for r in few)
    enough = {r["series"]: r["mbb_p"] for r in B.block_bootstrap_p(frame, 7, 200).collect()}
    greater = {r["series"]: r["mbb_p"] for r in B.block_bootstrap_p(frame, 7, 200, two_sided=False).collect()}
    assert enough["tiny"] is None and all(0 <= v <= 1 for k, v in enough.items() if k != "tiny")
    assert all(greater[k] <= enough[k] for k, y in ((k, v) for k, v in enough.items() if v is not None) if frame.where(f"series = '{k}'").agg({"diff": "avg"}).first()[0] > 0)


def test_no_python(spark, frame):
    plan = T.reality_check(frame, 5)._jdf.queryExecution().toString()
    assert "Python" not in plan
