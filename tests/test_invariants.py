"""Brute-force comparisons and invariants."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from weightloom.functions import vectors as V
from weightloom.operators import covariance as M
from weightloom.operators import ledger as L
from weightloom.operators import panel as P
from weightloom.operators import projection as C
from weightloom.operators import resample as B
from weightloom.operators import rules as W
from weightloom.operators import stats as T
from weightloom.operators import textrules as R
from weightloom.sources import calls as SC
from weightloom.streaming import calls as ST


def bisect(a, cap):
    a = np.asarray(a, float)
    if cap * len(a) < 1 - 1e-12:
        return np.full(len(a), 1 / len(a))
    lo, hi = (a - cap).min() - 1, a.max() + 1
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.clip(a - mid, 0, cap).sum() > 1 else (lo, mid)
    w = np.clip(a - hi, 0, cap)
    return w / w.sum()


def test_projection_forms_agree_with_bisection(spark):
    rng = np.random.default_rng(0)
    vecs = [rng.normal(0.1, 0.4, n).tolist() for n in (2, 3, 7, 25) for _ in range(10)]
    vecs += [[1.2, -0.1, 0.0, 0.0], [0.0] * 5, [0.25] * 4, [5.0, -5.0]]
    for cap in (0.25, 0.5, 0.6, 1.0):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(vecs)], "k int, raw array<double>")
        got = {r["k"]: r["w"] for r in C.project_vectors(df, "raw", cap).collect()}
        lng = df.select("k", F.posexplode("raw").alias("i", "a"))
        rows = C.project_long(lng, ["k"], "a", cap).collect()
        for i, v in enumerate(vecs):
            want = bisect(v, cap)
            assert np.allclose(got[i], want, atol=1e-9), (cap, v)
            mine = [r["w"] for r in sorted((r for r in rows if r["k"] == i), key=lambda r: r["i"])]
            assert np.allclose(mine, want, atol=1e-9)


def test_projection_is_idempotent_and_optimal(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.normal(0, 0.5, 12).tolist()) for i in range(40)], "k int, raw array<double>")
    p = C.project_vectors(df, "raw", 0.3)
    again = C.project_vectors(p, "w", 0.3, "w2").select(F.max(V.l1(F.col("w"), F.col("w2")))).first()[0]
    assert again < 1e-12
    assert C.optimality_residual(p, "raw", "w", 0.3).agg(F.max("kkt_residual")).first()[0] < 1e-12
    bad = p.withColumn("w", V.equal_like(F.col("w")))
    assert C.optimality_residual(bad, "raw", "w", 0.3).agg(F.min("kkt_residual")).first()[0] > 1e-3


def panel(spark, n_days=90, n=4, seed=2, holes=True):
    rng = np.random.default_rng(seed)
    px = 100 * np.cumprod(1 + rng.normal(0.0005, 0.02, (n_days, n)), axis=0)
    days = np.datetime64("2020-01-01") + np.arange(n_days)
    rows = [(f"A{j}", j + 1, str(days[i]), float(px[i, j])) for i in range(n_days) for j in range(n)
            if not (holes and (i * 7 + j * 3) % 11 == 0)]
    df = spark.createDataFrame(rows, "asset string, ord int, d string, px double")
    return df.select("asset", "ord", F.to_date("d").alias("dt"), "px")


def day_loop(px, targets, every, cap, tau, cost):
    """Plain simulation of one fold; px has NaN where unobserved."""
    T_, n = px.shape
    ff = px.copy()
    for i in range(1, T_):
        ff[i] = np.where(np.isnan(ff[i]), ff[i - 1], ff[i])
    r = np.zeros_like(ff)
    r[1:] = np.nan_to_num(ff[1:] / ff[:-1] - 1)
    w, out, turn = None, [], []
    for i in range(T_):
        if w is None:
            gross, drift = 0.0, np.zeros(n)
        else:
            gross = float(w @ r[i])
            drift = w * (1 + r[i]) / (1 + gross)
        fee, new = 0.0, drift
        if (i in every) if isinstance(every, set) else i % every == 0:
            tgt = bisect(targets[i], cap)
            if w is None:
                new = tgt
            else:
                prev = bisect(drift, cap)
                gap = np.abs(tgt - prev).sum()
                new = tgt if gap <= tau else prev + tau / gap * (tgt - prev)
                fee = -cost * np.abs(new - drift).sum()
        turn.append(0.0 if i == 0 else np.abs(new - last).sum())
        last = new
        if w is not None or ((i in every) if isinstance(every, set) else i % every == 0):
            w = new
        out.append(gross + fee)
    return np.array(out), np.array(turn)


@pytest.mark.parametrize("cap,tau,every", [(1.0, 2.0, 10), (0.5, 0.25, 7), (0.4, 0.05, 1)])
def test_ledger_equals_day_loop(spark, cap, tau, every):
    g = P.panel_grid(panel(spark))
    folds = spark.createDataFrame([(1, 0, 0, 5, 50), (2, 0, 50, 50, 90)], "fold int, train_start int, train_end int, test_start int, test_end int")
    lv = L.level_vectors(L.fold_rows(g, folds))
    rng = np.random.default_rng(9)
    tg = {t: rng.dirichlet(np.ones(4) * 0.4).tolist() for t in range(90)}
    dec = spark.createDataFrame([("s", t, v) for t, v in tg.items()], "series string, t int, target array<double>")
    dec = dec.join(lv.select("fold", "t"), "t")
    uni = g.select("asset", "ord").distinct()
    pts = spark.createDataFrame([("r", 0.001, every, cap, tau)], "run string, tcost double, rebalance int, max_weight double, turnover_cap double")
    day = L.daily_valuation(L.rebalance_ledger(dec, lv, L.run_params(pts, uni)), lv).orderBy("fold", "t").collect()
    pxr = g.select("t", "ord", "px").collect()
    px = np.full((90, 4), np.nan)
    for r in pxr:
        px[r["t"], r["ord"] - 1] = np.nan if r["px"] is None else r["px"]
    for f, a, b in ((1, 5, 50), (2, 50, 90)):
        want, turn = day_loop(px[a:b], [tg[t] for t in range(a, b)], every, cap, tau, 0.001)
        got = [r for r in day if r["fold"] == f]
        assert len(got) == b - a
        assert np.allclose([r["ret"] for r in got], want, atol=1e-10)
        assert np.allclose([r["turnover"] for r in got], turn, atol=1e-9)


def test_explicit_rebalance_calendar(spark):
    g = P.panel_grid(panel(spark, 60))
    folds = spark.createDataFrame([(1, 0, 10, 10, 60)], "fold int, train_start int, train_end int, test_start int, test_end int")
    lv = L.level_vectors(L.fold_rows(g, folds))
    rows = {3, 11, 12, 40}  # relative to the fold, the first one after its start
    tg = np.random.default_rng(3).dirichlet(np.ones(4), 50)
    dec = spark.createDataFrame([("s", 1, 10 + i, tg[i].tolist()) for i in rows], "series string, fold int, t int, target array<double>")
    pts = spark.createDataFrame([("r", 0.002, None, 0.7, 0.3)], "run string, tcost double, rebalance int, max_weight double, turnover_cap double")
    led = L.rebalance_ledger(dec, lv, L.run_params(pts, g.select("asset", "ord").distinct()))
    day = L.daily_valuation(led, lv).orderBy("t").collect()
    px = np.full((60, 4), np.nan)
    for r in g.select("t", "ord", "px").collect():
        px[r["t"], r["ord"] - 1] = np.nan if r["px"] is None else r["px"]
    want, _ = day_loop(px[10:], tg, rows, 0.7, 0.3, 0.002)
    assert len(day) == 50 and np.allclose([r["ret"] for r in day], want, atol=1e-10)


def test_rules_are_portfolios(spark):
    g = P.rolling_features(P.panel_grid(panel(spark, 420, 6)))
    dec = g.select("t").distinct().where("t in (100, 300, 400)")
    tg = W.build_targets(sorted(W.REGISTRY), g, dec)
    raw = tg.where("series <> 'BL'").groupBy("series", "t").agg(F.sum("w").alias("s"), F.min("w").alias("lo"), F.count("*").alias("n")).collect()
    assert {r["series"] for r in raw} == set(W.REGISTRY) - {"BL"}
    for r in raw:
        assert r["n"] == 6 and r["s"] == pytest.approx(1.0, abs=1e-9) and r["lo"] >= 0, r
    pol = W.policy_weights(g.join(dec, "t", "left_semi"), 0.6, ("A1",)).groupBy("policy", "t").agg(F.sum("w").alias("s")).collect()
    assert len(pol) == 36 and all(r["s"] == pytest.approx(1.0, abs=1e-9) for r in pol)


def test_minimum_variance_and_views_against_numpy(spark):
    g = P.simple_returns(P.panel_grid(panel(spark, 100, 5, holes=False)), zero_fill=True)
    dec = g.select("t").distinct().where("t = 90")
    x = np.full((100, 5), 0.0)
    for r in g.select("t", "ord", "ret").collect():
        x[r["t"], r["ord"] - 1] = r["ret"]
    win = x[30:90]
    s = np.cov(win, rowvar=False)
    w = np.linalg.solve(s, np.ones(5))
    got = [r["w"] for r in M.min_variance(g, dec).orderBy("ord").collect()]
    assert np.allclose(got, np.clip(w / w.sum(), 0, None), atol=1e-9)
    w = np.clip(np.linalg.solve(shrunk(win) + 1e-6 * np.eye(5), np.ones(5)), 0, None)
    got = [r["w"] for r in M.min_variance(g, dec, "ridge").orderBy("ord").collect()]
    assert np.allclose(got, w / w.sum(), atol=1e-9)
    # a short position: cut, and normalised only in the ridge form
    c = np.array([[1.0, 1.4], [1.4, 4.0]])
    x = np.linalg.inv(c).sum(axis=1)
    assert x.min() < 0 < x.sum()
    assert np.allclose(M.budget_minimum_variance(c), [x[0] / x.sum(), 0]) and np.allclose(M.minimum_variance(c), [1, 0])
    p, q = np.array([[1.0, -1.0, 0, 0, 0]]), np.array([0.01])
    pi, ts = 2.5 * s @ np.full(5, 0.2), 0.05 * s
    om = np.diag(np.diag(p @ ts @ p.T))
    mu = np.linalg.solve(np.linalg.inv(ts) + p.T @ np.linalg.inv(om) @ p, np.linalg.inv(ts) @ pi + p.T @ np.linalg.inv(om) @ q)
    got = [r["w"] for r in M.bl_rule(g, dec, "sample", p=p.tolist(), q=q.tolist()).orderBy("ord").collect()]
    assert np.allclose(got, np.clip(np.linalg.solve(s, mu), 0, None), rtol=1e-6)


def shrunk(x):
    """The published shrinkage, observation by observation."""
    n, p = x.shape
    x = x - x.mean(axis=0)
    s = x.T @ x / n
    m = np.trace(s) / p
    d2 = np.square(s - m * np.eye(p)).sum() / p
    b2 = sum(np.square(np.outer(r, r) - s).sum() for r in x) / p / n**2
    share = min(b2, d2) / d2 if d2 > 0 else 0.0
    return (1 - share) * s + share * m * np.eye(p)


def matrices(df, p, value="cov"):
    out = {}
    for r in df.collect():
        c = out.setdefault(r["t"], np.full((p, p), np.nan))
        c[r["i"] - 1, r["j"] - 1] = c[r["j"] - 1, r["i"] - 1] = r[value]
    return out


@pytest.mark.parametrize("lookback", [20, 60])
def test_moments_against_numpy(spark, lookback):
    rng = np.random.default_rng(lookback)
    x = rng.normal(0.001, 0.02, (150, 6)) @ rng.normal(0, 1, (6, 6))
    x[30] = 1e4  # long gone for the later windows, and without a trace
    g = spark.createDataFrame([(t, f"A{i}", i + 1, float(x[t, i])) for t in range(150) for i in range(6)], "t int, asset string, ord int, ret double")
    at = sorted({lookback - 1, lookback, lookback + 1, 2 * lookback, 91, 120, 149, 150})
    dec = spark.createDataFrame([(t,) for t in at], "t int")
    full = {t: x[t - lookback : t] for t in at if t >= lookback}
    forms = {"sample": lambda w: np.cov(w, rowvar=False), "shrunk": shrunk, "ridge": lambda w: shrunk(w) + 1e-6 * np.eye(6) if lookback >= 60 else np.eye(6)}
    for method, plain in forms.items():
        got = matrices(M.covariance(g, dec, lookback, method), 6)
        assert got.keys() == full.keys()
        for t, w in full.items():
            assert np.allclose(got[t], plain(w), rtol=1e-7, atol=1e-12 if t > 30 + lookback else 1e-3), (method, t)
    got = matrices(M.correlation_distance(g, dec, lookback), 6, "dist")
    columns = matrices(M.correlation_distance(g, dec, lookback, of_columns=True), 6, "dist")
    for t, w in full.items():
        if t > 30 + lookback:
            assert np.allclose(got[t], np.sqrt(np.clip(0.5 * (1 - np.corrcoef(w, rowvar=False)), 0, None)), atol=1e-7)
            assert np.allclose(columns[t], np.sqrt(np.clip(0.5 * (1 - np.corrcoef(np.cov(w, rowvar=False))), 0, None)), atol=1e-7)
    parity = M.inverse_risk(g, dec, "sample", lookback, volatility=True).collect()
    for t in at:
        w = 1 / x[t - lookback : t].std(axis=0) if t >= lookback else np.ones(6)
        assert np.allclose([r["w"] for r in sorted(parity, key=lambda r: r["ord"]) if r["t"] == t], w / w.sum(), rtol=1e-6)


def test_moments_need_no_python(spark):
    g = spark.createDataFrame([(t, f"A{i}", i, 0.01 * t * i) for t in range(8) for i in (1, 2)], "t int, asset string, ord int, ret double")
    dec = spark.createDataFrame([(6,)], "t int")
    for df in (M.covariance(g, dec, 4), M.covariance(g, dec, 4, "shrunk"), M.correlation_distance(g, dec, 4), M.inverse_risk(g, dec, "shrunk", 4)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan


def test_clustered_logit_against_newton(spark):
    rng = np.random.default_rng(4)
    n = 600
    g = rng.integers(0, 3, n)
    c = rng.integers(0, 40, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.3 + 0.8 * (g == 1) - 0.5 * (g == 2))))).astype(int)
    df = spark.createDataFrame([(int(a), f"g{b}", int(k)) for a, b, k in zip(y, g, c)], "y int, grp string, c int")
    got = {r["term"]: r for r in T.clustered_logit(df, "y", ["grp"], "c").collect()}
    # dummies for all but the last level in descending order
    x = np.column_stack([np.ones(n), g == 2, g == 1]).astype(float)
    b = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        h = x.T @ (x * (p * (1 - p))[:, None])
        b = b + np.linalg.solve(h, x.T @ (y - p))
    u = np.array([(x[c == k] * (y - p)[c == k][:, None]).sum(axis=0) for k in np.unique(c)])
    cov = np.linalg.inv(h) @ (u.T @ u) @ np.linalg.inv(h)
    for i, t in enumerate(("(Intercept)", "grp=g2", "grp=g1")):
        assert got[t]["coefficient"] == pytest.approx(b[i], abs=1e-4)
        assert got[t]["se"] == pytest.approx(np.sqrt(cov[i, i]), abs=1e-4)
    assert got["(Intercept)"]["clusters"] == len(np.unique(c))


def test_intervals_contain_their_estimates(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([("a" if i % 3 else "hot", int(i % 50), float(rng.random() < 0.4)) for i in range(3000)], "scope string, c int, y double")
    for r in B.cluster_bootstrap(df, ["scope"], ["c"], "y", 300).collect():
        assert r["ci95_lower"] <= r["estimate"] <= r["ci95_upper"]
    one = B.cluster_bootstrap(df.where("c = 1"), ["scope"], ["c"], "y", 50).first()
    assert one["ci95_lower"] is None and one["estimate"] is not None


def broadcast_parts(df):
    """What the plan sends to the driver and to all tasks, down to the first aggregate below."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [next((i for i, c in enumerate(x) if c.isalpha()), len(x)) for x in lines]
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i:end]).split("Aggregate")[0]


def test_draws_are_never_broadcast(spark, monkeypatch):
    rows = [(["a", "b", None][i % 3], i, float(i * 7 % 11) if i % 13 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "scope string, id long, y double")
    monkeypatch.setattr(B, "SLICE", 16)
    found = []
    for limit in (1 << 21, 10):
        monkeypatch.setattr(B, "BROADCAST", limit)
        got = B.mean_interval(df, ["scope"], ["id"], "y", 300)
        assert not any("md5(" in part for part in broadcast_parts(got))
        found.append(sorted((str(r.scope), r.estimate, round(r.ci95_lower, 9), round(r.ci95_upper, 9), r.records, r.clusters) for r in got.collect() if r.scope))
    assert found[0] == found[1] and len(found[0]) == 2
    series = spark.createDataFrame([("s", t, float(t % 5)) for t in range(60)], "series string, t int, diff double")
    assert not any("md5(" in part for part in broadcast_parts(B.block_replicates(B.positions(series, "diff"), 7, 300, 42)))


def test_spread_index_is_dense(spark):
    df = spark.range(5000).select(F.lit("s").alias("scope"), F.col("id").alias("k"))
    ix = sorted(r["idx"] for r in B.spread_index(df, ["scope"], ["k"]).collect())
    assert ix == list(range(5000))


def test_turnover_cap_binds(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.0], [0.0, 0.5, 0.5])], "a array<double>, b array<double>")
    for cap, moved in ((0.25, 0.25), (2.0, 1.0), (0.0, 0.0)):
        x = df.select(V.l1(F.col("a"), C.turnover_capped(F.col("a"), F.col("b"), cap)).alias("m")).first()["m"]
        assert x == pytest.approx(moved)


def test_masks_are_invertible(spark):
    u = spark.createDataFrame([(f"T{i}", i) for i in range(1, 9)], "asset string, ord int")
    for c in ("real_ticker", "masked_ticker", "shuffled_masked", "symbolic_masked"):
        lab = R.mask_labels(u, c)
        back = R.unmask(lab.select("label", F.col("ord").alias("w")), lab)
        assert back.where("w <> ord").count() == 0 and back.count() == 8


def test_log_round_trip_and_stream(spark, tmp_path):
    schema = "call_id string, experiment_id string, ts timestamp, status string, latency_sec double"
    rows = [(f"c{i}", "e", f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", "completed", float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "call_id string, experiment_id string, t string, status string, latency_sec double")
    df = df.select("call_id", "experiment_id", F.to_timestamp("t").alias("ts"), "status", "latency_sec")
    js, pq = str(tmp_path / "log"), str(tmp_path / "table")
    SC.append_calls(df, js, pq)
    SC.append_calls(df.where("call_id in ('c1', 'c299')"), js, pq)  # repeated reports
    assert SC.read_calls_json(spark, js, schema).count() == 302
    assert spark.read.parquet(pq).count() == 302
    s = ST.read_log(spark, js, schema, per_trigger=1000)
    out = ST.run_available(ST.window_counts(ST.first_reports(s, "call_id", "ts", "10 minutes"), "ts", ["status"], "1 hour"), "t")
    assert [r["n"] for r in out.orderBy("start").collect()] == [60, 60, 60, 60]  # the open window stays open
    gaps = ST.run_available(ST.stale_gaps(ST.read_log(spark, js, schema, per_trigger=1000), "experiment_id", "ts", 30.0), "g")
    assert gaps.where("kind = 'gap'").count() == 299


def test_required_columns_are_checked(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError):
        SC.require_columns(df, ["a", "b"])
    with pytest.raises(ValueError):
        W.build_targets(["unknown"], df, df)


def test_nothing_is_collected_or_pinned_locally():
    root = os.path.join(os.path.dirname(__file__), "..", "weightloom")
    for base, folders, files in os.walk(root):
        if "llm" in folders:
            folders.remove("llm")  # that package names its bounded reads in tests of its own
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(base, f)).read()
                assert "localCheckpoint" not in text and ".toPandas(" not in text and ".collect()" not in text and "crossJoin" not in text, f


def test_snooping_keeps_series_of_different_lengths_apart(spark):
    rng = np.random.default_rng(4)
    short = [("a", i, float(x)) for i, x in enumerate(rng.normal(0.25, 1, 40))]  # a positive mean, so clipping at 0 changes nothing
    flat = [("b", i, 0.5) for i in range(60)]  # never varies, so its replicates are all 0
    schema = "series string, t int, diff double"
    p = lambda rows: {r["series"]: r["p"] for r in T.reality_check(spark.createDataFrame(rows, schema), 60).collect()}
    alone, both = p(short), p(short + flat)
    assert 0 < alone["a"] < 1 and both["a"] == alone["a"]
