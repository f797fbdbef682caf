"""Registered queries: target-weight rules."""

from pyspark.sql import functions as F

from checks import sqlparts as S
from checks.panel_checks import cal, feats, grid, r6
from weightloom.operators import dates as D
from weightloom.operators import rules as W

Q, O = {}, {}
SAFE = ("Brand#14", "Brand#21", "Brand#3")


def decisions(s, d):
    return D.decision_dates(cal(s, d))


def decided(s, d):
    return feats(s, d).join(F.broadcast(decisions(s, d).select("t")), "t", "left_semi")


def filled_grid(s, d):
    """The panel with forward-filled prices as input prices."""
    return grid(s, d).withColumn("px", F.col("px_ff"))


Q["policy_weights"] = lambda s, d: r6(W.policy_weights(decided(s, d), 0.6, SAFE).select("policy", "t", "asset", "w"))
POLICY_SQL = S.DFEAT + """,
st AS (SELECT *, count(*) OVER d AS n, quantile_cont(vol3m, 0.25) OVER d AS v25, quantile_cont(vol3m, 0.5) OVER d AS v50,
   quantile_cont(vol3m, 0.75) OVER d AS v75, quantile_cont(r12m, 0.5) OVER d AS m50, quantile_cont(r12m, 0.75) OVER d AS m75,
   quantile_cont(r12m, 0.9) OVER d AS m90, avg(vol3m) OVER d AS vm,
   CASE WHEN stddev_pop(r12m) OVER d > 1e-12 THEN (r12m - avg(r12m) OVER d) / stddev_pop(r12m) OVER d ELSE 0 END AS z12,
   CASE WHEN stddev_pop(r3m) OVER d > 1e-12 THEN (r3m - avg(r3m) OVER d) / stddev_pop(r3m) OVER d ELSE 0 END AS z3,
   CASE WHEN stddev_pop(vol3m) OVER d > 1e-12 THEN (vol3m - avg(vol3m) OVER d) / stddev_pop(vol3m) OVER d ELSE 0 END AS zv,
   CASE WHEN stddev_pop(mdd) OVER d > 1e-12 THEN (mdd - avg(mdd) OVER d) / stddev_pop(mdd) OVER d ELSE 0 END AS zd,
   greatest(r1m / greatest(vol3m, 1e-12), 0e0) AS rr,
   CASE WHEN asset IN ('Brand#14', 'Brand#21', 'Brand#3') THEN 1e0 ELSE 0e0 END AS safe
   FROM df WINDOW d AS (PARTITION BY t)),
sc AS (SELECT *, z12 - zv + zd AS s2,
   CASE WHEN vm >= v75 THEN zd - zv WHEN vm <= v25 THEN z12 + 0.5 * z3 ELSE z12 - zv + zd END AS s3,
   CASE WHEN mdd > -0.2 OR (r12m >= m75 AND vol3m <= v50) THEN z12 - zv + zd ELSE -1e6 END AS s4,
   -zv + 0.5 * z12 + zd + CASE WHEN r12m >= m90 AND vol3m <= v50 THEN 0.5 ELSE 0 END - CASE WHEN mdd <= -0.25 THEN 1 ELSE 0 END AS s5,
   0.75 * z12 - 0.75 * zv + 0.5 * zd - CASE WHEN r12m >= m50 AND (mdd > -0.2 OR (r12m >= m90 AND vol3m <= v50)) THEN 0 ELSE 1 END AS s6 FROM st),
rk AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY r12m DESC, ord) AS k1, row_number() OVER (PARTITION BY t ORDER BY vol3m, ord) AS k2,
   row_number() OVER (PARTITION BY t ORDER BY r3m, ord) AS k3, row_number() OVER (PARTITION BY t ORDER BY s2 DESC, ord) AS q2,
   row_number() OVER (PARTITION BY t ORDER BY s3 DESC, ord) AS q3, row_number() OVER (PARTITION BY t ORDER BY s4 DESC, ord) AS q4,
   sum(rr) OVER (PARTITION BY t) AS rrs, exp((s5 - max(s5) OVER (PARTITION BY t)) / 0.75e0) AS e5, exp((s6 - max(s6) OVER (PARTITION BY t)) / 0.75e0) AS e6 FROM sc),
sm AS (SELECT *, least(e5 / sum(e5) OVER (PARTITION BY t), 0.3e0) AS c5, least(e6 / sum(e6) OVER (PARTITION BY t), 0.4e0) AS c6,
   sum(safe) OVER (PARTITION BY t) AS ns FROM rk),
fin AS (SELECT *, c5 / sum(c5) OVER (PARTITION BY t) AS w5, c6 / sum(c6) OVER (PARTITION BY t) AS w6 FROM sm),
wide AS (SELECT t, asset, ord,
   CASE WHEN k1 = 1 THEN 0.6e0 ELSE 0.4e0 / (n - 1) END AS P1, CASE WHEN k2 = 1 THEN 0.6e0 ELSE 0.4e0 / (n - 1) END AS P2,
   CASE WHEN k3 = 1 THEN 0.6e0 ELSE 0.4e0 / (n - 1) END AS P3, 1e0 / n AS P4, CASE WHEN rrs > 1e-12 THEN rr / rrs ELSE 1e0 / n END AS P5,
   CASE WHEN cross_vol >= v75 AND ns > 0 THEN w6 * 0.8e0 + 0.2e0 * safe / ns ELSE w6 END AS P6,
   CASE WHEN k2 = 1 THEN 0.6e0 ELSE 0.4e0 / (n - 1) END AS L1,
   CASE q2 WHEN 1 THEN 0.4e0 WHEN 2 THEN 0.25e0 WHEN 3 THEN 0.15e0 ELSE 0.2e0 / (n - 3) END AS L2,
   CASE q3 WHEN 1 THEN 0.4e0 WHEN 2 THEN 0.25e0 WHEN 3 THEN 0.15e0 ELSE 0.2e0 / (n - 3) END AS L3,
   CASE q4 WHEN 1 THEN 0.4e0 WHEN 2 THEN 0.25e0 WHEN 3 THEN 0.15e0 ELSE 0.2e0 / (n - 3) END AS L4, w5 AS L5,
   CASE WHEN cross_vol >= v75 AND ns > 0 THEN w6 * 0.8e0 + 0.2e0 * safe / ns ELSE w6 END AS L6 FROM fin),
pw AS (UNPIVOT wide ON P1, P2, P3, P4, P5, P6, L1, L2, L3, L4, L5, L6 INTO NAME policy VALUE w)"""
O["policy_weights"] = f"WITH {POLICY_SQL} SELECT policy, t, asset, round(w, 6) AS w FROM pw"

Q["intended_core_asset"] = lambda s, d: W.intended_core(decided(s, d))
O["intended_core_asset"] = f"""WITH {S.DFEAT} SELECT 'P1' AS policy, t, first(asset ORDER BY r12m DESC, ord) AS core FROM df GROUP BY t
UNION ALL SELECT 'P2', t, first(asset ORDER BY vol3m, ord) FROM df GROUP BY t
UNION ALL SELECT 'P3', t, first(asset ORDER BY r3m, ord) FROM df GROUP BY t"""

ZRET = S.RETS.replace("lag(px_ff) OVER (PARTITION BY asset ORDER BY t) - 1 AS ret FROM grid", "lag(px_ff) OVER (PARTITION BY asset ORDER BY t) - 1 AS ret0 FROM grid") + """,
zr AS (SELECT asset, ord, t, px_ff AS px, coalesce(ret0, 0e0) AS ret, r FROM rets)""" + S.DECIDE

Q["rule_equal"] = lambda s, d: r6(W.equal(grid(s, d), decisions(s, d)).select("t", "asset", "w"))
O["rule_equal"] = f"WITH {S.BRAND}{S.DECIDE} SELECT t, asset, round(1e0 / count(*) OVER (PARTITION BY t), 6) AS w FROM grid JOIN decisions USING (t)"

for name, lb in (("rule_momentum_126", 126), ("rule_momentum_252", 252)):
    Q[name] = lambda s, d, lb=lb: r6(W.momentum(filled_grid(s, d), decisions(s, d), lb).select("t", "asset", "w"))
    O[name] = f"""WITH {ZRET}, g AS (SELECT *, coalesce(px / lag(px, {lb}) OVER (PARTITION BY asset ORDER BY t) - 1, 0) AS gain FROM zr),
    k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY gain DESC, ord) AS rk, count(*) OVER (PARTITION BY t) AS n FROM g JOIN decisions USING (t))
    SELECT t, asset, round(CASE WHEN t < {lb} THEN 1e0 / n WHEN rk <= n // 2 THEN 1e0 / (n // 2) ELSE 0 END, 6) AS w FROM k"""

for name, lb in (("rule_trend_126", 126), ("rule_trend_210", 210)):
    Q[name] = lambda s, d, lb=lb: r6(W.trend(filled_grid(s, d), decisions(s, d), lb).select("t", "asset", "w"))
    O[name] = f"""WITH {ZRET}, g AS (SELECT *, CASE WHEN count(px) OVER f = {lb} AND px > avg(px) OVER f THEN 1 ELSE 0 END AS up FROM zr
      WINDOW f AS (PARTITION BY asset ORDER BY t ROWS {lb - 1} PRECEDING)),
    k AS (SELECT *, sum(up) OVER (PARTITION BY t) AS nu, count(*) OVER (PARTITION BY t) AS n FROM g JOIN decisions USING (t))
    SELECT t, asset, round(CASE WHEN t < {lb} OR nu = 0 THEN 1e0 / n ELSE up / CAST(nu AS DOUBLE) END, 6) AS w FROM k"""

for name, down in (("rule_sharpe_weighted", False), ("rule_sortino_weighted", True)):
    Q[name] = lambda s, d, down=down: r6(W.ratio_weighted(grid(s, d), decisions(s, d), 60, down).select("t", "asset", "w"))
    x = "least(ret, 0e0)" if down else "ret"
    O[name] = f"""WITH {ZRET}, g AS (SELECT *, coalesce(greatest(avg(ret) OVER f / nullif(stddev_samp({x}) OVER f, 0), 0), 0) AS sc FROM zr
      WINDOW f AS (PARTITION BY asset ORDER BY t ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
    k AS (SELECT *, sum(sc) OVER (PARTITION BY t) AS s, count(*) OVER (PARTITION BY t) AS n FROM g JOIN decisions USING (t))
    SELECT t, asset, round(CASE WHEN s > 0 THEN sc / s ELSE 1e0 / n END, 6) AS w FROM k"""

Q["rule_min_cvar"] = lambda s, d: r6(W.min_cvar(grid(s, d).withColumn("ret", F.col("r")), decisions(s, d)).select("t", "asset", "w"))
O["rule_min_cvar"] = f"""WITH {ZRET}, m AS (SELECT d.t, z.asset, round(-z.r, 12) AS loss FROM decisions d JOIN zr z ON z.t >= d.t - 126 AND z.t < d.t),
q AS (SELECT t, asset, quantile_cont(loss, 0.95) AS q FROM m GROUP BY 1, 2),
c AS (SELECT t, asset, 1e0 / greatest(avg(loss), 1e-6) AS inv FROM m JOIN q USING (t, asset) WHERE loss >= q GROUP BY 1, 2)
SELECT t, asset, round(inv / sum(inv) OVER (PARTITION BY t), 6) AS w FROM c"""

Q["rule_vol_scaled_trend"] = lambda s, d: r6(W.vol_scaled_trend(grid(s, d), decisions(s, d)).select("t", "asset", "w"))
O["rule_vol_scaled_trend"] = f"""WITH {ZRET}, g AS (SELECT *, product(1e0 + ret) OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN 126 PRECEDING AND 1 PRECEDING) - 1 AS gain,
  stddev_samp(ret) OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING) AS vol FROM zr),
k AS (SELECT *, CASE WHEN gain > 0 AND vol > 0 THEN 1e0 / greatest(vol, 1e-6) ELSE 0 END AS sc FROM g JOIN decisions USING (t)),
z AS (SELECT *, sum(sc) OVER (PARTITION BY t) AS s, count(*) OVER (PARTITION BY t) AS n FROM k)
SELECT t, asset, round(CASE WHEN s > 1e-12 THEN sc / s ELSE 1e0 / n END, 6) AS w FROM z"""
