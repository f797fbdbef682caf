"""The ledger fold against a plain day-by-day run: costs by asset class, turnover cap, warm-up, explicit calendars."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weightloom.functions import scalars as X
from weightloom.operators import dates as D
from weightloom.operators import ledger as L

ASSETS = ["AAA", "BTC", "GLD", "TLT"]
DAYS = 80


def capped(a, cap):
    """Projection on weights between 0 and the cap that add to one, by bisection."""
    a = np.where(np.isfinite(a), a, 0.0)
    if cap * len(a) < 1 - 1e-12:
        return np.full(len(a), 1 / len(a))
    lo, hi = -a.max() - 1, cap - a.min() + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.clip(a + mid, 0, cap).sum() < 1 else (lo, mid)
    w = np.clip(a + hi, 0, cap)
    return w / w.sum()


def plain_run(prices, start, end, targets, due, cap, tau, cost):
    """(t, return, gross, fee) of every day, as one would step through it."""
    px = prices[start:end].copy()
    for i in range(1, len(px)):
        px[i] = np.where(np.isnan(px[i]), px[i - 1], px[i])
    rets = np.zeros_like(px)
    rets[1:] = px[1:] / px[:-1] - 1
    rets[~np.isfinite(rets)] = 0.0
    held, out = None, []
    for i in range(len(px)):
        gross = float(held @ rets[i]) if held is not None else 0.0
        drifted = held * (1 + rets[i]) / (1 + gross) if held is not None else np.zeros(len(cost))
        fee, now = 0.0, drifted
        if due(i):
            wanted = capped(targets[start + i], cap)
            if held is None:
                now = wanted
            else:
                prev = capped(drifted, cap)
                gap = np.abs(wanted - prev).sum()
                now = prev if tau <= 0 else wanted if gap <= max(tau, 1e-12) else prev + tau / gap * (wanted - prev)
                fee = -float((np.abs(now - drifted) * cost).sum())
            held = now
        elif held is not None:
            held = drifted
        out.append((start + i, gross + fee, gross, fee))
    return out


@pytest.fixture(scope="module")
def market(spark):
    rng = np.random.default_rng(12)
    prices = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, (DAYS, 4)), axis=0))
    prices[rng.random((DAYS, 4)) < 0.1] = np.nan
    prices[:3, 2] = np.nan
    targets = rng.normal(0.25, 0.3, (DAYS, 4))
    cell = lambda v: None if np.isnan(v) else float(v)
    grid = spark.createDataFrame([(a, k + 1, t, cell(prices[t, k])) for t in range(DAYS) for k, a in enumerate(ASSETS)], "asset string, ord int, t int, px double")
    grid = grid.withColumn("dt", F.date_add(F.lit("2020-01-01"), F.col("t")))
    wanted = spark.createDataFrame([("x", t, [float(v) for v in targets[t]]) for t in range(DAYS)], "series string, t int, target array<double>")
    return prices, targets, grid, wanted


@pytest.mark.parametrize("by_class", [False, True])
@pytest.mark.parametrize("cap, tau, step, first", [(0.6, 0.25, 7, 0), (0.4, 0.1, 5, 12), (0.5, 0.0, 9, 0), (0.2, 1.0, 4, 30), (1.0, 9.0, 1, 0)])
def test_fold_against_daily_steps(spark, market, by_class, cap, tau, step, first):
    prices, targets, grid, wanted = market
    folds = spark.createDataFrame([(1, 0, 40), (2, 40, DAYS)], "fold int, test_start int, test_end int")
    folds = D.warm_start(folds, first)  # only the fold that starts with row 0 waits for its history
    levels = L.level_vectors(L.fold_rows(grid, folds))
    decisions = wanted.join(folds, (F.col("t") >= F.col("test_start")) & (F.col("t") < F.col("test_end"))).select("series", "fold", "t", "target")
    points = spark.createDataFrame([("p", 0.002, step, cap, tau)], "run string, tcost double, rebalance int, max_weight double, turnover_cap double")
    params = L.run_params(points, grid.select("asset", "ord").distinct(), by_class)
    got = {r["t"]: r for r in L.daily_valuation(L.rebalance_ledger(decisions, levels, params), levels).collect()}
    times = [X.CRYPTO_MULTIPLIER if a == "BTC" else X.COMMODITY_MULTIPLIER if a == "GLD" else 1.0 for a in ASSETS] if by_class else [1.0] * 4
    want = [row for a, b in ((first, 40), (40, DAYS)) for row in plain_run(prices, a, b, targets, lambda i: i % step == 0, cap, tau, 0.002 * np.array(times))]
    assert sorted(got) == [t for t, *_ in want]
    for t, ret, gross, fee in want:
        assert (got[t]["ret"], got[t]["gross"], got[t]["fee"]) == pytest.approx((ret, gross, fee), abs=1e-9), t


def test_fold_needs_no_python(spark, market):
    _, _, grid, wanted = market
    folds = spark.createDataFrame([(1, 0, DAYS)], "fold int, test_start int, test_end int")
    levels = L.level_vectors(L.fold_rows(grid, folds))
    points = spark.createDataFrame([("p", 0.002, 7, 0.6, 0.25)], "run string, tcost double, rebalance int, max_weight double, turnover_cap double")
    led = L.rebalance_ledger(wanted.withColumn("fold", F.lit(1)), levels, L.run_params(points, grid.select("asset", "ord").distinct()))
    assert "Python" not in led._jdf.queryExecution().toString() and "Pandas" not in led._jdf.queryExecution().toString()
