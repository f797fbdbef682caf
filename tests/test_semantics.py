"""Traps, published relations and ported unit cases."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weightloom.functions import scalars as X
from weightloom.functions import vectors as V
from weightloom.functions.quantiles import exact_percentiles
from weightloom.operators import audit as A
from weightloom.operators import dates as D
from weightloom.operators import metrics as K
from weightloom.operators import panel as P
from weightloom.operators import stats as T
from weightloom.operators import textrules as R
from weightloom.plans import study as PL


def prices(spark, px, asset="A", ord_=1):
    rows = [(asset, ord_, f"2020-{1 + i // 28:02d}-{1 + i % 28:02d}", v) for i, v in enumerate(px)]
    return spark.createDataFrame(rows, "asset string, ord int, d string, px double").select(
        "asset", "ord", F.to_date("d").alias("dt"), "px")


def test_rolling_product_is_null_poisoned(spark):
    rng = np.random.default_rng(1)
    px = (100 * np.cumprod(1 + rng.normal(0, 0.01, 60))).tolist()
    f = P.rolling_features(P.panel_grid(prices(spark, px)), fill=False).orderBy("t").collect()
    assert all(r["r1m"] is None for r in f[:21])  # row 0 has no return
    want = np.prod([px[i] / px[i - 1] for i in range(1, 22)]) - 1
    assert f[21]["r1m"] == pytest.approx(want, abs=1e-12)
    rets = np.diff(px) / np.array(px[:-1])
    assert f[20]["vol3m"] is None and f[21]["vol3m"] == pytest.approx(np.std(rets[:21], ddof=1) * math.sqrt(252), abs=1e-12)
    # forward fill never reaches back, and what remains is 0
    filled = P.carry_forward(P.rolling_features(P.panel_grid(prices(spark, px)), fill=False)).orderBy("t").collect()
    assert filled[5]["r1m"] == 0.0


def test_infinite_and_missing_prices(spark):
    px = [10.0, float("inf"), 11.0, None, 12.0]
    a, b = prices(spark, px), prices(spark, [1.0] * 5, "B", 2)
    g = P.panel_grid(a.unionByName(b)).where("asset = 'A'").orderBy("t").collect()
    assert [r["px"] for r in g] == [10.0, None, 11.0, None, 12.0]
    assert [r["px_ff"] for r in g] == [10.0, 10.0, 11.0, 11.0, 12.0]


def test_late_starters_are_not_backfilled(spark):
    a, b = prices(spark, [None, None, 5.0, 6.0]), prices(spark, [1.0] * 4, "B", 2)
    g = P.panel_grid(a.unionByName(b)).where("asset = 'A'").orderBy("t").collect()
    assert [r["px_ff"] for r in g] == [None, None, 5.0, 6.0]


def test_metric_definitions_differ(spark):
    r = [0.10, -0.05, 0.02]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(r)], "series string, t int, ret double")
    first = K.summary(df, ["series"]).first()
    assert first["cagr"] == pytest.approx((0.95 * 1.02) ** (252 / 3) - 1)
    assert K.whole_sample(df, ["series"]).first()["ann_return"] == pytest.approx((1.1 * 0.95 * 1.02) ** (252 / 3) - 1)
    flat = spark.createDataFrame([("s", i, 0.0) for i in range(5)], "series string, t int, ret double")
    z = K.summary(flat, ["series"]).first()
    assert z["sharpe"] == 0.0 and z["calmar"] == float("inf")
    assert K.whole_sample(flat, ["series"]).first()["sharpe"] is None
    assert K.stress_performance(flat, ["series"]).first()["sharpe"] is None


def test_turnover_counts_the_first_day_as_zero(spark):
    w = spark.createDataFrame([("s", 0, [1.0, 0.0]), ("s", 1, [0.5, 0.5])], "series string, t int, w array<double>")
    assert K.turnover_by_day(w, ["series"]).agg(F.avg("turnover")).first()[0] == pytest.approx(0.5)


def test_topk_overlap_divides_by_k(spark):
    row = spark.range(1).select(V.topk_overlap(F.array(F.lit(0.6), F.lit(0.4)), F.array(F.lit(0.4), F.lit(0.6)), 3).alias("x")).first()
    assert row["x"] == pytest.approx(2 / 3)


def test_ties_go_to_the_first_asset(spark):
    row = spark.range(1).select(V.first_argmax(F.array(F.lit(0.3), F.lit(0.4), F.lit(0.4))).alias("x")).first()
    assert row["x"] == 2


def test_stress_windows_are_inclusive_and_reads_half_open(spark):
    df = spark.createDataFrame([("A", 1, f"2020-01-0{i}", float(i)) for i in range(1, 6)], "asset string, ord int, d string, px double")
    df = df.select("asset", "ord", F.to_date("d").alias("dt"), "px")
    per = D.period_table(spark, {"x": ("2020-01-02", "2020-01-04"), "y": ("2020-01-04", "2020-01-05")})
    assert D.in_periods(df, per).count() == 5
    assert P.clip_dates(df, "2020-01-02", "2020-01-04").count() == 2


def test_published_relations(spark):
    p = spark.createDataFrame([(1.1530147922460066,), (-2.2013966866308197,)], "t double").select(X.two_sided_p("t").alias("p")).collect()
    assert p[0]["p"] == pytest.approx(0.24890431304413096, abs=1e-12)
    assert p[1]["p"] == pytest.approx(0.02770795336745516, abs=1e-12)
    c = spark.createDataFrame([(19.8461538461539, 3.0)], "x double, d double").select(X.chi2_upper_p("x", "d").alias("p")).first()
    assert c["p"] == pytest.approx(0.0001826703890590291, rel=1e-10)
    assert 19.8461538461539 / (18 * 3) == pytest.approx(0.3675213675213685)


CLASSIFY = [("choose the highest r12m momentum winner", "P1"), ("lowest volatility defensive allocation", "P2"),
            ("equal-weight control; ignore all feature data", "P4"),
            ("risk-adjusted return with lower volatility and smaller drawdowns", "P5"),
            ("hybrid defensive-momentum with an above-median r12m screen", "P6"), ("nothing known", "P4")]
RETRIEVE = [("contrarian weakest r3m underperformer", "P3"), ("equal weight control ignore features uniform allocation", "P4"),
            ("risk adjusted return lower volatility smaller drawdowns", "P5"), ("hybrid defensive momentum with a bond cash sleeve", "P6"),
            ("", "P6")]


def test_text_classifiers(spark):
    df = spark.createDataFrame(CLASSIFY, "text string, want string")
    assert df.where(R.keyword_policy(F.col("text")) != F.col("want")).count() == 0
    df = spark.createDataFrame(RETRIEVE, "text string, want string")
    got = {r["text"]: r["policy"] for r in R.tfidf_policy(df, "text", "text").collect()}
    assert got == dict(RETRIEVE)


def test_projection_ablation_and_collapse(spark):
    row = [(json.dumps({"A": .9, "B": .1}), json.dumps({"A": .5, "B": .5}), json.dumps({"A": .6, "B": .4}), "{}", 0, 0)]
    df = spark.createDataFrame(row, "raw_weights string, projected_weights string, reference_weights string, raw_output string, parse_fail int, repair_used int")
    a = A.projection_ablation(df, "raw_weights", "projected_weights", "reference_weights").first()
    assert (a["fidelity_raw"], a["fidelity_projected"]) == (1, 1)
    assert a["l1_raw_reference"] == pytest.approx(0.6) and a["projection_l1"] == pytest.approx(0.8)
    c = A.collapse_audit(df, "projected_weights").first()
    assert c["collapse"] == 1 and c["probable_cause"] == "model_equalization"


def test_resume_skips_completed_and_requeues_interrupted(spark):
    plan = spark.createDataFrame([("done",), ("interrupted",), ("new",), ("broken",)], "call_id string")
    log = spark.createDataFrame([("done", 1, "running"), ("done", 2, "completed"), ("interrupted", 1, "running"), ("broken", 1, "failed")],
                                "call_id string, ts int, status string")
    st = PL.latest_status(log)
    assert {r[0] for r in PL.pending(plan, st).collect()} == {"interrupted", "new", "broken"}
    assert {r[0] for r in PL.pending(plan, st, retry_failed=False).collect()} == {"interrupted", "new"}


RESPONSES = [
    ('{"SPY": 0.5, "QQQ": 0.5}', 1, 0), ("{'SPY': 0.5, 'QQQ': 0.5,}", 1, 1), ("{SPY: 1}", 1, 1), ("no object", 0, 0), ("", 0, 0), (None, 0, 0),
    ('text {"weights": {"SPY": 1}} and {"SPY": 2}', 1, 0), ("{{", 0, 0), ('{"SPY": }', 0, 0), ('```json\n{"SPY": 3}\n```', 1, 0),
]


def test_response_parsing(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(RESPONSES)], "i int, raw string")
    got = {r["i"]: (r["json_valid"], r["repair_used"]) for r in R.extract_weights(df, "raw").collect()}
    assert got == {i: (v, r) for i, (_, v, r) in enumerate(RESPONSES)}


def test_long_unbalanced_text_does_not_overflow(spark):
    df = spark.createDataFrame([("{" + "x" * 300_000,), ("a{b}" * 50_000,)], "raw string")
    assert R.extract_weights(df, "raw").agg(F.sum("json_valid")).first()[0] == 0


def test_responses_are_parsed_once(spark):
    import re

    from weightloom.operators import textrules as R

    rows = [(0, '{"A": 0.9, "B": "x"}'), (1, "{A: 0.2, 'B': 0.3,}"), (2, "none"), (3, '{"weights": [1]}'), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "i int, raw string")
    got = R.repair_rows(R.extract_weights(df, "raw").select("i", "parsed"), F.array(F.lit("A"), F.lit("B")))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # strictly, repaired, and the weights of either: a filter or a lambda must not evaluate them anew
    assert len(re.findall(r"from_json\(", plan)) == 3
    out = [(r.i, r.ticker, r.raw_weight, round(r.projected_weight, 9), round(r.sum_projected, 9)) for r in got.collect()]
    assert sorted(out) == [(0, "A", 0.9, 0.6, 1.0), (0, "B", 0.0, 0.4, 1.0), (1, "A", 0.2, 0.45, 1.0), (1, "B", 0.3, 0.55, 1.0)]


def test_hyphenated_tickers_never_match_feature_lines(spark):
    text = "- BTC-USD_r1m: 0.1\n- SPY_r1m: -0.25\n- SPY_vol3m: 1e-3"
    got = spark.range(1).select(R.parse_features(F.lit(text)).alias("f")).first()["f"]
    assert [(e["asset"], e["feature"], e["value"]) for e in got] == [("SPY", "r1m", -0.25), ("SPY", "vol3m", 0.001)]


def test_exact_percentiles_on_a_hot_key_with_ties(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([np.round(rng.gamma(2.0, 10.0, 90_000), 1), np.full(30_000, 7.0)])
    small = np.array([1.0, 2.0, 4.0, 8.0])
    df = spark.createDataFrame([("hot", float(x)) for x in v] + [("cold", float(x)) for x in small], "k string, x double")
    got = {r["k"]: r for r in exact_percentiles(df, ["k"], "x", {"a": 0.05, "m": 0.5, "z": 0.999, "hi": 1.0}).collect()}
    for k, arr in (("hot", v), ("cold", small)):
        for n, p in (("a", 0.05), ("m", 0.5), ("z", 0.999), ("hi", 1.0)):
            assert got[k][n] == pytest.approx(np.quantile(arr, p), abs=1e-9), (k, n)


def test_sample_moments_are_bias_corrected(spark):
    x = np.array([0.1, -0.2, 0.3, 0.05, 0.7, -0.4])
    r = P.describe_returns(spark.createDataFrame([("A", float(v)) for v in x], "asset string, ret double")).first()
    n, d = len(x), x - x.mean()
    s = x.std(ddof=1)
    assert r["skew"] == pytest.approx(n / ((n - 1) * (n - 2)) * (d**3).sum() / s**3)
    k = n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * (d**4).sum() / s**4 - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3))
    assert r["kurt"] == pytest.approx(k)


def test_degenerate_wilcoxon(spark):
    rows = [("few", float(i)) for i in range(1, 6)] + [("same", 1.0) for _ in range(12)] + [("zero", 0.0) for _ in range(12)]
    df = spark.createDataFrame(rows, "series string, diff double")
    got = {r["series"]: r["p"] for r in T.wilcoxon(df, ["series"]).collect()}
    assert got == {"few": None, "same": 1.0}
    pr = {r["series"]: r["status"] for r in T.wilcoxon(df, ["series"], pratt=True).collect()}
    assert pr["zero"] == "not_testable_all_zero" and pr["few"] == "tested"
    holm = T.holm(T.wilcoxon(df, ["series"], pratt=True).withColumn("g", F.lit(1)), ["g"]).where("series = 'zero'").first()
    assert holm["p_holm"] is None


def test_zero_variance_hac(spark):
    df = spark.createDataFrame([("flat", i, 0.5) for i in range(8)], "series string, t int, diff double")
    r = T.hac_test(df).first()
    assert r["t_hac"] == 0.0 and r["p_hac"] == 1.0
    assert T.excess_regression(df).first()["hac_t"] is None


def test_null_groups_keep_their_percentiles(spark):
    from weightloom.functions.quantiles import exact_percentiles
    from weightloom.operators.audit import latency_table

    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 9.0)], "k string, latency_sec double")
    assert {r.k: r.m for r in exact_percentiles(rows, ["k"], "latency_sec", {"m": 0.5}).collect()} == {"a": 2.0, None: 7.0}
    assert {r.k: r.median_latency for r in latency_table(rows, ["k"]).collect()} == {"a": 2.0, None: 7.0}


def test_repeated_feature_lines_keep_the_last(spark):
    from weightloom.operators.textrules import parse_features

    rows = spark.createDataFrame([("- SPY_r1m: 0.5\n- QQQ_mdd: 0\n- SPY_r1m: 0.0",), (None,), ("",)], "p string")
    got = [sorted((e.asset, e.feature, e.value) for e in r[0] or []) for r in rows.select(parse_features(rows.p)).collect()]
    assert got == [[("QQQ", "mdd", 0.0), ("SPY", "r1m", 0.0)], [], []]


def test_objects_are_found_at_any_depth(spark):
    from weightloom.operators.textrules import first_object

    deep = "{" * 40 + "}" * 40
    rows = spark.createDataFrame([("x " + deep + " {",), ("{ {",), ("none",), ("} {1} {2}",)], "t string")
    assert [r[0] for r in rows.select(first_object(rows.t)).collect()] == [deep, "", "", "{1}"]


def test_no_local_folder_off_local_mode(spark):
    from types import SimpleNamespace

    from weightloom.session import shared_dir

    class Conf:
        def get(self, key, default=None):
            return default

    for master, fails in (("local[4]", False), ("local", False), ("local-cluster[2,1,512]", True), ("spark://host:7077", True), ("yarn", True)):
        fake = SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master=master, getConf=lambda: Conf()))
        try:
            shared_dir(fake, "x")
            failed = False
        except ValueError:
            failed = True
        assert failed == fails, master


def test_tail_probabilities_without_python(spark):
    ts = [0.0, 1e-9, 0.3, -1.0, 1.7, 1.96, 2.4, -3.3, 5.0, 8.0, 12.0, 37.0, float("inf")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ts)] + [(90, None), (91, float("nan"))], "i int, t double")
    got = {r["i"]: r["p"] for r in df.select("i", X.two_sided_p("t").alias("p")).collect()}
    for i, t in enumerate(ts):
        assert math.isclose(got[i], math.erfc(abs(t) / math.sqrt(2)), rel_tol=1e-11, abs_tol=1e-300), t
    assert got[90] is None and got[91] is None
    # closed forms: one degree is a squared normal, an even number a Poisson sum
    cases = [(x, d) for d in (1, 2, 4, 10, 40, 200, 2000) for x in (0.0, 0.01, 0.5 * d, 0.98 * d, d, 1.02 * d + 2, 1.5 * d, 3.0 * d + 10)]
    df = spark.createDataFrame([(i, float(x), float(d)) for i, (x, d) in enumerate(cases)] + [(900, 1.0, 0.0), (901, None, 3.0)], "i int, x double, d double")
    out = df.select("i", X.chi2_upper_p("x", F.col("d")).alias("p"))
    got = {r["i"]: r["p"] for r in out.collect()}
    for i, (x, d) in enumerate(cases):
        if d == 1:
            want = math.erfc(math.sqrt(x / 2))
        else:
            want = math.fsum(math.exp(-x / 2 + k * math.log(x / 2) - math.lgamma(k + 1)) for k in range(d // 2)) if x else 1.0
        assert math.isclose(got[i], want, rel_tol=1e-9, abs_tol=1e-13), (x, d, got[i], want)
    assert math.isnan(got[900]) and got[901] is None
    assert "Python" not in out._jdf.queryExecution().toString()
