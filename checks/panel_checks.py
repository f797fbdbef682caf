"""Registered queries: panel, features, calendars, metrics."""

from pyspark.sql import functions as F
from pyspark.sql import Window

from checks import sqlparts as S
from weightloom.operators import dates as D
from weightloom.operators import metrics as K
from weightloom.operators import panel as P
from weightloom.sources import archive as A
from weightloom.sources import testbed as TB

Q, O = {}, {}


def r6(df, *keep, skip=()):
    """Round every double to 6 digits for order-insensitive comparison."""
    out = []
    for f in df.schema.fields:
        if keep and f.name not in keep:
            continue
        out.append(F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name))
    return df.select(*out)


def live_grid(s, d):
    """The panel from the source tables, not from the archive."""
    return P.panel_grid(TB.brand_prices(s, d), TB.brand_calendar(s, d))


def grid(s, d):
    return A.brand_features(s, d).select("asset", "ord", "t", "dt", "n_dates", "px", "px_ff", "r")


def feats(s, d):
    return A.brand_features(s, d)


def cal(s, d):
    return A.brand_days(s, d)


def series_returns(s, d):
    """One series per brand plus the equal mix: (series, t, dt, ret)."""
    g = grid(s, d)
    one = g.select(F.col("asset").alias("series"), "t", "dt", F.col("r").alias("ret"))
    mix = g.groupBy("t", "dt").agg(F.avg("r").alias("ret")).select(F.lit("EQUAL").alias("series"), "t", "dt", "ret")
    return one.unionByName(mix)


SERIES = S.BRAND + """,
series AS (SELECT asset AS series, t, dt, r AS ret FROM grid
  UNION ALL SELECT 'EQUAL', t, dt, avg(r) FROM grid GROUP BY t, dt)"""
CURVE = """,
eq0 AS (SELECT *, product(1e0 + ret) OVER (PARTITION BY series ORDER BY t ROWS UNBOUNDED PRECEDING) AS eq FROM {src}),
curve AS (SELECT *, eq / max(eq) OVER (PARTITION BY series ORDER BY t ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM eq0)"""

# --- S1, S2, S3 --------------------------------------------------------------
Q["price_snapshot_range"] = lambda s, d: r6(
    P.clip_dates(TB.brand_prices(s, d), "1996-01-01", "1998-01-01").select("asset", "dt", "px"))
O["price_snapshot_range"] = f"""WITH {S.BRAND} SELECT asset, dt, round(px, 6) AS px FROM prices
WHERE dt >= DATE '1996-01-01' AND dt < DATE '1998-01-01'"""

Q["price_audit"] = lambda s, d: r6(P.with_provenance(P.price_audit(live_grid(s, d)), source="snapshot"))
O["price_audit"] = f"""WITH {S.BRAND} SELECT asset, min(dt) FILTER (px IS NOT NULL) AS first_valid,
max(dt) FILTER (px IS NOT NULL) AS last_valid, round(avg(CASE WHEN px IS NULL THEN 1e0 ELSE 0e0 END), 6) AS missing_rate,
count(px) AS n_obs, 'snapshot' AS source FROM grid GROUP BY asset"""

# --- E1-E3, F1-F7 ------------------------------------------------------------
Q["panel_fill_and_returns"] = lambda s, d: r6(
    P.simple_returns(live_grid(s, d)).select("asset", "t", "dt", "px", "px_ff", "ret"))
O["panel_fill_and_returns"] = f"""WITH {S.RETS} SELECT asset, t, dt, {S.Rs('px', 'px_ff', 'ret')} FROM rets"""

Q["features_unfilled"] = lambda s, d: r6(
    P.rolling_features(live_grid(s, d), fill=False).select("asset", "t", "r1m", "r3m", "r12m", "vol3m", "mdd", "cross_vol"))
O["features_unfilled"] = f"""WITH {S.RAWFEAT} SELECT asset, t, {S.Rs('r1m', 'r3m', 'r12m', 'vol3m', 'mdd', 'cross_vol')} FROM rf"""

Q["features"] = lambda s, d: r6(P.rolling_features(live_grid(s, d)).select("asset", "t", "r1m", "r3m", "r12m", "vol3m", "mdd", "cross_vol"))
O["features"] = f"""WITH {S.FEAT} SELECT asset, t, {S.Rs('r1m', 'r3m', 'r12m', 'vol3m', 'mdd', 'cross_vol')} FROM feats"""

Q["features_small_universe"] = lambda s, d: r6(
    P.rolling_features(P.panel_grid(TB.segment_prices(s, d))).groupBy("asset").agg(
        F.count("*").alias("n"), F.avg("r1m").alias("m1"), F.avg("r12m").alias("m12"), F.max("vol3m").alias("vmax"), F.min("mdd").alias("ddmin")))
SEG = """
cells AS (
  SELECT c_mktsegment AS asset, CAST(o_orderdate AS DATE) AS dt,
         0.2e0 * (CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT) % 11) AS DOUBLE) / (1e2 * count(o_totalprice)) - 0.05e0) AS r
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),"""
SEG_FEAT = S.FEAT.replace(S.FEAT[: S.FEAT.index("prices AS (")], SEG).replace(
    "SELECT DISTINCT p_brand AS asset FROM part", "SELECT DISTINCT c_mktsegment AS asset FROM customer")
O["features_small_universe"] = f"""WITH {SEG_FEAT} SELECT asset, count(*) AS n, {S.R('avg(r1m)', 'm1')}, {S.R('avg(r12m)', 'm12')},
{S.R('max(vol3m)', 'vmax')}, {S.R('min(mdd)', 'ddmin')} FROM feats GROUP BY asset"""

# --- F10 ---------------------------------------------------------------------
Q["describe_returns"] = lambda s, d: r6(P.describe_returns(
    grid(s, d).select("asset", F.col("r").alias("ret"))))
O["describe_returns"] = f"""WITH {S.BRAND} SELECT asset, count(r) AS n, {S.R('avg(r)', 'mean')}, {S.R('stddev_samp(r)', 'std')},
{S.R('min(r)', 'min')}, {S.R('quantile_cont(r, 0.25)', 'p25')}, {S.R('quantile_cont(r, 0.5)', 'p50')}, {S.R('quantile_cont(r, 0.75)', 'p75')},
{S.R('max(r)', 'max')}, {S.R('skewness(r)', 'skew')}, {S.R('kurtosis(r)', 'kurt')} FROM grid GROUP BY asset"""

# --- E14 ---------------------------------------------------------------------


def q_swap(s, d):
    c = D.decision_dates(cal(s, d))
    pair = c.select("t", F.lit("Brand#11").alias("asset_a"), F.lit("Brand#25").alias("asset_b"))
    return r6(P.swap_feature(feats(s, d), pair).select("t", "asset", "original", "vol3m", "moved"))


Q["counterfactual_swap"] = q_swap
O["counterfactual_swap"] = f"""WITH {S.DFEAT},
sw AS (SELECT t, asset, ord, vol3m AS original,
  CASE asset WHEN 'Brand#11' THEN max(CASE WHEN asset = 'Brand#25' THEN vol3m END) OVER (PARTITION BY t)
             WHEN 'Brand#25' THEN max(CASE WHEN asset = 'Brand#11' THEN vol3m END) OVER (PARTITION BY t) ELSE vol3m END AS vol3m FROM df)
SELECT t, asset, round(original, 6) AS original, round(vol3m, 6) AS vol3m,
  CAST(first_value(asset) OVER (PARTITION BY t ORDER BY sw.vol3m, ord) = 'Brand#25' AS INT) AS moved FROM sw"""

# --- D1-D8 -------------------------------------------------------------------
Q["split_index"] = lambda s, d: cal(s, d).groupBy(F.year("dt").alias("year")).agg(F.count("*").cast("int").alias("n")).select(
    "year", "n", D.split_point("n").alias("split"))
O["split_index"] = f"""WITH {S.BRAND}, y AS (SELECT year(dt) AS year, count(*) AS n FROM cal GROUP BY 1)
SELECT year, n, greatest(1, least(n - 1, CAST(round_even(n * 0.7e0, 0) AS INT))) AS split FROM y"""

Q["decision_calendar"] = lambda s, d: D.decision_dates(TB.brand_calendar(s, d)).select("t", "dt", "decision")
O["decision_calendar"] = f"WITH {S.BRAND}{S.DECIDE} SELECT t, dt, decision FROM decisions"

Q["regime_sample"] = lambda s, d: D.regime_sample(
    D.decision_dates(cal(s, d)), feats(s, d).groupBy("t").agg(F.max("cross_vol").alias("cross_vol")), 10
).select("t", "regime", F.round("cross_vol", 6).alias("cross_vol"))
O["regime_sample"] = f"""WITH {S.DFEAT}, x AS (SELECT t, max(cross_vol) AS cross_vol FROM df GROUP BY t),
q AS (SELECT quantile_cont(cross_vol, 1e0/3) AS a, quantile_cont(cross_vol, 2e0/3) AS b FROM x),
g AS (SELECT t, cross_vol, CASE WHEN cross_vol <= a THEN 'low' WHEN cross_vol <= b THEN 'mid' ELSE 'high' END AS regime FROM x, q)
SELECT t, regime, round(cross_vol, 6) AS cross_vol FROM g QUALIFY row_number() OVER (PARTITION BY regime ORDER BY md5('42|' || t), t) <= 10"""

Q["walk_forward_folds"] = lambda s, d: D.folds(cal(s, d), 504, 378)
O["walk_forward_folds"] = f"WITH {S.BRAND}{S.FOLDS} SELECT * FROM folds"

Q["walk_forward_folds_rolling"] = lambda s, d: D.rows_in_folds(cal(s, d), D.folds(cal(s, d), 504, 378, rolling=True)).groupBy(
    "fold").agg(F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"), F.count("*").alias("n"))
O["walk_forward_folds_rolling"] = f"""WITH {S.BRAND}{S.FOLDS}
SELECT fold, min(dt) AS first_dt, max(dt) AS last_dt, count(*) AS n FROM cal JOIN folds ON t >= test_start AND t < test_end GROUP BY fold"""

Q["adaptive_folds"] = lambda s, d: D.adaptive_folds(cal(s, d))
O["adaptive_folds"] = f"""WITH {S.BRAND}, p0 AS (SELECT max(n_dates) AS n, 42 AS min_test FROM cal),
p1 AS (SELECT n, min_test, CASE WHEN n <= greatest(126, least(252, CAST(floor(n * 0.7e0) AS INT))) + min_test
   THEN greatest(126, CAST(floor(n * 0.5e0) AS INT)) ELSE greatest(126, least(252, CAST(floor(n * 0.7e0) AS INT))) END AS tr FROM p0),
p2 AS (SELECT *, n - tr AS oos, greatest(2, least(5, (n - tr) // min_test)) AS k FROM p1 WHERE n > tr + min_test),
p3 AS (SELECT *, greatest(min_test, oos // k) AS step FROM p2),
p4 AS (SELECT 0 AS train_start, tr + i * step AS train_end, tr + i * step AS test_start, least(tr + (i + 1) * step, n) AS test_end, min_test
   FROM p3, range(0, 5) g(i) WHERE i < k)
SELECT row_number() OVER (ORDER BY test_start) AS fold, train_start, train_end, test_start, test_end FROM p4 WHERE test_end - test_start >= min_test"""

Q["evenly_spaced_dates"] = lambda s, d: D.evenly_spaced(D.folds(cal(s, d), 504, 378), cal(s, d), 42, 7)
O["evenly_spaced_dates"] = f"""WITH {S.BRAND}{S.FOLDS},
cand AS (SELECT fold, train_start, train_end, t, dt, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n
  FROM folds JOIN cal ON t >= test_start AND t < test_end AND (t - test_start) % 42 = 0)
SELECT fold, t AS position, dt AS decision_date, train_start, train_end FROM cand
WHERE i IN (SELECT CAST(floor(k * ((n - 1) / 6e0)) AS INT) FROM range(0, 7) r(k), (SELECT max(n) AS n FROM cand))"""

Q["rebalance_schedule"] = lambda s, d: D.rebalance_flags(
    D.rows_in_folds(cal(s, d), D.folds(cal(s, d), 504, 378)), 42).where("is_rebalance = 1").select("fold", "t", "dt")
O["rebalance_schedule"] = f"""WITH {S.BRAND}{S.FOLDS} SELECT fold, t, dt FROM cal JOIN folds
ON t >= test_start AND t < test_end WHERE (t - test_start) % 42 = 0"""

PERIODS = {"crash": ("1996-02-01", "1996-06-30"), "shock": ("1998-01-01", "1998-12-31"),
           "high_rate": ("1998-01-01", "1999-12-31"), "rally": ("1999-01-01", "2001-12-29")}
PERIOD_SQL = ", periods AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', DATE '{a}', DATE '{b}')" for k, (a, b) in PERIODS.items()) + ") v(period, ps, pe))"
Q["stress_performance"] = lambda s, d: r6(K.stress_performance(
    D.in_periods(series_returns(s, d), D.period_table(s, PERIODS)), ["period", "series"]))
O["stress_performance"] = f"""WITH {SERIES}{PERIOD_SQL},
x AS (SELECT period || '|' || series AS series, t, ret FROM series JOIN periods ON dt BETWEEN ps AND pe){CURVE.format(src='x')},
a AS (SELECT series AS k, count(*) AS n, avg(ret) AS mu, stddev_samp(ret) AS sd, stddev_samp(least(ret, 0)) AS dsd, min(dd) AS mdd, arg_max(eq, t) AS e FROM curve GROUP BY 1)
SELECT split_part(k, '|', 1) AS period, split_part(k, '|', 2) AS series, n AS n_days,
 round(CASE WHEN sd > 1e-12 THEN sqrt(252e0) * mu / sd END, 6) AS sharpe, round(CASE WHEN dsd > 1e-12 THEN sqrt(252e0) * mu / dsd END, 6) AS sortino,
 round(CASE WHEN e > 0 THEN pow(e, 252e0 / n) - 1 END, 6) AS cagr, round(sd * sqrt(252e0), 6) AS vol, round(mdd, 6) AS mdd, round(e - 1, 6) AS cum_return FROM a"""

# --- K1-K9 -------------------------------------------------------------------
Q["performance_summary"] = lambda s, d: r6(K.summary(series_returns(s, d), ["series"]))
O["performance_summary"] = f"""WITH {SERIES}{CURVE.format(src='series')},
a AS (SELECT series, count(*) AS n, avg(ret) AS mu, stddev_samp(ret) AS sd, stddev_samp(least(ret, 0)) AS dsd, min(dd) AS mdd,
  arg_min(eq, t) AS e0, arg_max(eq, t) AS e1 FROM curve GROUP BY series),
b AS (SELECT *, CASE WHEN e1 / e0 > 0 THEN pow(e1 / e0, 252e0 / n) - 1 ELSE 0 END AS cagr FROM a)
SELECT series, n, round(cagr, 6) AS cagr, round(CASE WHEN sd > 0 THEN sqrt(252e0) * mu / sd ELSE 0 END, 6) AS sharpe,
 round(CASE WHEN dsd > 0 THEN sqrt(252e0) * mu / dsd ELSE 0 END, 6) AS sortino, round(sd * sqrt(252e0), 6) AS vol, round(mdd, 6) AS mdd,
 round(CASE WHEN mdd < 0 THEN cagr / abs(mdd) ELSE 'inf'::DOUBLE END, 6) AS calmar, round(e1, 6) AS terminal FROM b"""

Q["performance_whole_sample"] = lambda s, d: r6(K.whole_sample(series_returns(s, d), ["series"]))
O["performance_whole_sample"] = f"""WITH {SERIES}{CURVE.format(src='series')}
SELECT series, count(*) AS n, round(CASE WHEN min(ret) > -1 THEN pow(arg_max(eq, t), 252e0 / count(*)) - 1 END, 6) AS ann_return,
 round(stddev_samp(ret) * sqrt(252e0), 6) AS ann_vol, round(CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(252e0) END, 6) AS sharpe,
 round(min(dd), 6) AS mdd FROM curve GROUP BY series"""

Q["robust_returns"] = lambda s, d: r6(K.robust_returns(
    P.simple_returns(grid(s, d)).select(F.col("asset").alias("series"), "t", "ret"), ["series"]))
O["robust_returns"] = f"""WITH {S.RETS} SELECT asset AS series, round(product(1e0 + coalesce(ret, 0)) - 1, 6) AS cum_return,
round(pow(product(1e0 + coalesce(ret, 0)), 252e0 / count(*)) - 1, 6) AS ann_return FROM rets GROUP BY asset"""

Q["metrics_table"] = lambda s, d: r6(K.metrics_table(
    K.summary(series_returns(s, d), ["series"]).select("series", "sharpe", "mdd"), K.robust_returns(series_returns(s, d), ["series"]), ["series"]))
O["metrics_table"] = f"""WITH {SERIES}{CURVE.format(src='series')}
SELECT series, round(CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(252e0) ELSE 0 END, 6) AS sharpe, round(min(dd), 6) AS mdd,
 round(arg_max(eq, t) - 1, 6) AS cum_return, round(pow(arg_max(eq, t), 252e0 / count(*)) - 1, 6) AS ann_return FROM curve GROUP BY series"""
