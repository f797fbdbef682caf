"""Every registered rule's targets in SQL, for the oracles that value them: CTE rt(series, t, asset, ord, w).

It stands behind the policy CTEs (feats, decisions, pw) of a statement. Linear systems are solved by elimination.
"""

from pyspark.sql import functions as F

from checks import sqlparts as S
from checks.cov_checks import LW
from checks.panel_checks import feats, r6
from checks.rule_checks import POLICY_SQL, decisions
from weightloom.operators import covariance  # noqa: F401  registers its rules
from weightloom.operators import rules as W

Q, O = {}, {}
ALL_RULES = sorted(W.REGISTRY)

COVS = f""",
covs AS MATERIALIZED (WITH {LW[len(S.RETS + S.DECIDE):].lstrip().lstrip(',')},
  three AS (SELECT 'sample' AS m, dt_ AS t, i, j, xx / 59e0 AS cov FROM pr UNION ALL SELECT 'shrunk', t, i, j, cov FROM lw
    UNION ALL SELECT 'ridge', t, i, j, cov + CASE WHEN i = j THEN 1e-6 ELSE 0e0 END FROM lw)
  SELECT * FROM three WHERE t >= 60),
mats AS (SELECT m, t, list(line ORDER BY i) AS a FROM (SELECT m, t, i, list_append(list(cov ORDER BY j), 1e0) AS line FROM covs GROUP BY m, t, i) GROUP BY m, t),
solved AS (WITH RECURSIVE s AS (SELECT m, t, a, 1 AS k FROM mats
    UNION ALL SELECT m, t, list_transform(a, lambda line, i: CASE WHEN i = k THEN list_transform(line, lambda x: x / line[k])
      ELSE list_transform(line, lambda x, j: x - line[k] / a[k][k] * a[k][j]) END), k + 1 FROM s WHERE k <= len(a))
  SELECT m, t, list_transform(a, lambda line: line[len(line)]) AS x FROM s WHERE k = len(a) + 1),
mv AS (SELECT m, t, ord, x[ord] AS x, list_sum(x) AS sx, list_sum(list_transform(x, lambda y: greatest(y, 0e0))) AS sp FROM solved, uni)"""

TARGETS = COVS + """,
zf AS (SELECT asset, ord, t, px, coalesce(ret, 0e0) AS ret FROM feats),
wn AS (SELECT *, coalesce(px / lag(px, 126) OVER a - 1, 0e0) AS g126, coalesce(px / lag(px, 252) OVER a - 1, 0e0) AS g252,
    CASE WHEN count(px) OVER s126 = 126 AND px > avg(px) OVER s126 THEN 1e0 ELSE 0e0 END AS u126, CASE WHEN count(px) OVER s210 = 210 AND px > avg(px) OVER s210 THEN 1e0 ELSE 0e0 END AS u210,
    coalesce(greatest(avg(ret) OVER f60 / nullif(stddev_samp(ret) OVER f60, 0), 0e0), 0e0) AS shp,
    coalesce(greatest(avg(ret) OVER f60 / nullif(stddev_samp(least(ret, 0e0)) OVER f60, 0), 0e0), 0e0) AS srt,
    product(1e0 + ret) OVER b126 - 1 AS gain, stddev_samp(ret) OVER b63 AS vol
  FROM zf WINDOW a AS (PARTITION BY asset ORDER BY t), s126 AS (PARTITION BY asset ORDER BY t ROWS 125 PRECEDING), s210 AS (PARTITION BY asset ORDER BY t ROWS 209 PRECEDING),
    f60 AS (PARTITION BY asset ORDER BY t ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), b126 AS (PARTITION BY asset ORDER BY t ROWS BETWEEN 126 PRECEDING AND 1 PRECEDING),
    b63 AS (PARTITION BY asset ORDER BY t ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)),
cv AS (SELECT d.t, z.asset, round(-z.ret, 12) AS loss FROM decisions d JOIN zf z ON z.t >= d.t - 126 AND z.t < d.t),
cq AS (SELECT t, asset, quantile_cont(loss, 0.95) AS q, count(*) AS days FROM cv GROUP BY 1, 2),
ci AS (SELECT t, asset, any_value(days) AS days, 1e0 / greatest(avg(loss) FILTER (loss >= q), 1e-6) AS inv FROM cv JOIN cq USING (t, asset) GROUP BY 1, 2),
dk AS (SELECT wn.*, days, inv, CASE WHEN gain > 0 AND vol > 0 THEN 1e0 / greatest(vol, 1e-6) ELSE 0e0 END AS vt, count(*) OVER d AS n,
    row_number() OVER (PARTITION BY t ORDER BY g126 DESC, ord) AS r126, row_number() OVER (PARTITION BY t ORDER BY g252 DESC, ord) AS r252
  FROM wn JOIN (SELECT DISTINCT t FROM decisions) USING (t) LEFT JOIN ci USING (t, asset) WINDOW d AS (PARTITION BY t)),
dw AS (SELECT *, sum(u126) OVER d AS n126, sum(u210) OVER d AS n210, sum(shp) OVER d AS tshp, sum(srt) OVER d AS tsrt, sum(inv) OVER d AS tinv, sum(vt) OVER d AS tvt FROM dk WINDOW d AS (PARTITION BY t)),
rp AS (SELECT t, i AS ord, (1e0 / sqrt(cov)) / sum(1e0 / sqrt(cov)) OVER (PARTITION BY t) AS w FROM covs WHERE m = 'ridge' AND i = j),
rt AS (
  SELECT 'MOM6' AS series, t, asset, ord, CASE WHEN t < 126 THEN 1e0 / n WHEN r126 <= n // 2 THEN 1e0 / (n // 2) ELSE 0e0 END AS w FROM dw
  UNION ALL SELECT 'MOM12', t, asset, ord, CASE WHEN t < 252 THEN 1e0 / n WHEN r252 <= n // 2 THEN 1e0 / (n // 2) ELSE 0e0 END FROM dw
  UNION ALL SELECT 'TRND6', t, asset, ord, CASE WHEN t < 126 OR n126 = 0 THEN 1e0 / n ELSE u126 / n126 END FROM dw
  UNION ALL SELECT 'TRND10', t, asset, ord, CASE WHEN t < 210 OR n210 = 0 THEN 1e0 / n ELSE u210 / n210 END FROM dw
  UNION ALL SELECT 'SHARPE', t, asset, ord, CASE WHEN tshp > 0 THEN shp / tshp ELSE 1e0 / n END FROM dw
  UNION ALL SELECT 'SORTINO', t, asset, ord, CASE WHEN tsrt > 0 THEN srt / tsrt ELSE 1e0 / n END FROM dw
  UNION ALL SELECT 'MinCVaR', t, asset, ord, CASE WHEN coalesce(days, 0) < 20 OR tinv <= 1e-12 THEN 1e0 / n ELSE inv / tinv END FROM dw
  UNION ALL SELECT 'VOLT_TRND6', t, asset, ord, CASE WHEN t < 126 OR tvt <= 1e-12 THEN 1e0 / n ELSE vt / tvt END FROM dw
  UNION ALL SELECT s, t, dw.asset, dw.ord, coalesce(rp.w, 1e0 / n) FROM dw LEFT JOIN rp USING (t, ord), (VALUES ('RiskParity'), ('ERC')) v(s)
  UNION ALL SELECT s, t, asset, ord, 1e0 / n FROM dw, (VALUES ('EQUAL'), ('BL')) v(s)
  UNION ALL SELECT s, dw.t, dw.asset, dw.ord, CASE WHEN x IS NULL THEN 1e0 / n WHEN v.m = 'ridge' THEN CASE WHEN sp > 0 THEN greatest(x, 0e0) / sp ELSE 1e0 / n END
      WHEN sx > 0 THEN greatest(x / sx, 0e0) ELSE 1e0 / n END
    FROM (VALUES ('MVP', 'sample'), ('LW-MVP', 'shrunk'), ('MVP-ridge', 'ridge')) v(s, m) CROSS JOIN dw LEFT JOIN mv ON mv.m = v.m AND mv.t = dw.t AND mv.ord = dw.ord
  UNION ALL SELECT 'CODED_' || policy, t, asset, ord, w FROM pw WHERE policy IN ('P1', 'P2', 'P3', 'P4', 'P5'))"""

RT = f"WITH {POLICY_SQL}{TARGETS}"


def one(rule: str) -> str:
    """Rounded weights of one rule at the usual decisions."""
    return f"{RT} SELECT t, asset, round(w, 6) AS w FROM rt WHERE series = '{rule}'"


Q["rule_registry"] = lambda s, d: r6(W.build_targets([*ALL_RULES, "no_such_rule"], feats(s, d), decisions(s, d)).groupBy("series", "t").agg(
    F.count("*").alias("n"), F.sum("w").alias("total"), F.max("w").alias("top"), F.sum(F.col("w") * F.col("ord")).alias("centre")))
# what the posterior-mean rule hands to the projection is no portfolio yet: the market times the risk aversion
O["rule_registry"] = f"""{RT} SELECT series, t, count(*) AS n, round(sum(w) * CASE WHEN series = 'BL' THEN 2.5 ELSE 1 END, 6) AS total,
 round(max(w) * CASE WHEN series = 'BL' THEN 2.5 ELSE 1 END, 6) AS top, round(sum(w * ord) * CASE WHEN series = 'BL' THEN 2.5 ELSE 1 END, 6) AS centre FROM rt GROUP BY 1, 2"""
for rule, method in (("MVP", "sample"), ("LW-MVP", "shrunk"), ("MVP-ridge", "ridge")):
    O[f"rule_min_variance_{method}"] = one(rule)
# one view: the posterior mean moves by tau C p' (q - p pi) / (2 p tau C p'), so the weights move along p alone
O["rule_black_litterman_views"] = f"""{RT},
pv AS (SELECT t, sum(CASE WHEN i = j THEN cov ELSE -cov END) FILTER (i <= 2 AND j <= 2) AS pcp, 0.1e0 * (sum(cov) FILTER (i = 1) - sum(cov) FILTER (i = 2)) AS ppi FROM covs WHERE m = 'shrunk' GROUP BY t),
raw AS (SELECT t, list(greatest(0.1e0 + CASE ord WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END * (0.001e0 - ppi) / (2 * pcp), 0e0) ORDER BY ord) AS raw FROM pv, uni GROUP BY t)
SELECT t, asset, round(fin_[ord], 6) AS final FROM ({S.proj_sql("SELECT * FROM raw", "raw", "fin_", "0.6e0")}), uni"""
