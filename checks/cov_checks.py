"""Registered queries: covariance and the rules built on it."""

from pyspark.sql import functions as F

from checks import sqlparts as S
from checks.panel_checks import feats, r6
from checks.rule_checks import decisions
from weightloom.operators import covariance as M
from weightloom.operators import projection as C

Q, O = {}, {}


def grid_ret(s, d):
    return feats(s, d).select("asset", "ord", "t", "ret")


WIN = S.RETS + S.DECIDE + """,
z AS (SELECT asset, ord, t, coalesce(ret, 0e0) AS ret FROM rets),
w AS (SELECT d.t AS dt_, z.t, ord, ret FROM decisions d JOIN z ON z.t >= d.t - 60 AND z.t < d.t),
c AS (SELECT dt_, t, ord, ret - avg(ret) OVER (PARTITION BY dt_, ord) AS x FROM w),
pr AS (SELECT a.dt_ AS dt_, a.ord AS i, b.ord AS j, sum(a.x * b.x) AS xx FROM c a JOIN c b ON a.dt_ = b.dt_ AND a.t = b.t GROUP BY ALL)"""
LW = WIN + """,
g AS (SELECT dt_, count(DISTINCT i) AS p, sum(CASE WHEN i = j THEN xx END) / 60e0 AS tr, sum(xx * xx) / 3600e0 AS s2 FROM pr GROUP BY dt_),
q AS (SELECT dt_, sum(n2 * n2) AS q4 FROM (SELECT dt_, t, sum(x * x) AS n2 FROM c GROUP BY dt_, t) GROUP BY dt_),
sh AS (SELECT dt_, tr / p AS m, (s2 - tr * tr / p) / p AS d2, (q4 / 60e0 - s2) / (p * 60e0) AS b2 FROM g JOIN q USING (dt_)),
lw AS (SELECT pr.dt_ AS t, i, j, (1 - least(greatest(b2, 0), d2) / d2) * xx / 60e0 + CASE WHEN i = j THEN least(greatest(b2, 0), d2) / d2 * m ELSE 0 END AS cov FROM pr JOIN sh USING (dt_))"""
Q["covariance_sample"] = lambda s, d: M.covariance(grid_ret(s, d), decisions(s, d)).select("t", "i", "j", F.round(F.col("cov") * 1e6, 6).alias("cov_e6"))
O["covariance_sample"] = f"WITH {WIN} SELECT dt_ AS t, i, j, round(1e6 * xx / 59e0, 6) AS cov_e6 FROM pr WHERE i <= j"
Q["covariance_shrunk"] = lambda s, d: M.covariance(grid_ret(s, d), decisions(s, d), method="shrunk").select("t", "i", "j", F.round(F.col("cov") * 1e6, 6).alias("cov_e6"))
O["covariance_shrunk"] = f"WITH {LW} SELECT t, i, j, round(1e6 * cov, 6) AS cov_e6 FROM lw WHERE i <= j"
Q["correlation_distance"] = lambda s, d: r6(M.correlation_distance(grid_ret(s, d), decisions(s, d)))
O["correlation_distance"] = f"""WITH {WIN}, v AS (SELECT dt_, i, xx AS v FROM pr WHERE i = j) SELECT pr.dt_ AS t, pr.i, pr.j,
 round(CASE WHEN pr.i = pr.j THEN 0 ELSE sqrt(0.5 * (1 - xx / sqrt(a.v * b.v))) END, 6) AS dist FROM pr JOIN v a ON a.dt_ = pr.dt_ AND a.i = pr.i JOIN v b ON b.dt_ = pr.dt_ AND b.i = pr.j WHERE pr.i <= pr.j"""
Q["correlation_distance_of_columns"] = lambda s, d: r6(M.correlation_distance(grid_ret(s, d), decisions(s, d), of_columns=True))
O["correlation_distance_of_columns"] = f"""WITH {WIN}, k AS (SELECT a.dt_, a.i, b.i AS j, corr(a.xx, b.xx) AS rho FROM pr a JOIN pr b ON a.dt_ = b.dt_ AND a.j = b.j AND a.i <= b.i GROUP BY ALL)
 SELECT dt_ AS t, i, j, round(CASE WHEN i = j THEN 0 ELSE sqrt(greatest(0.5 * (1 - rho), 0)) END, 6) AS dist FROM k"""
Q["inverse_variance_weights"] = lambda s, d: r6(M.inverse_risk(grid_ret(s, d), decisions(s, d)).select("t", "asset", "w"))
O["inverse_variance_weights"] = f"WITH {WIN} SELECT dt_ AS t, asset, round((1 / xx) / sum(1 / xx) OVER (PARTITION BY dt_), 6) AS w FROM pr JOIN uni ON ord = i WHERE i = j"
Q["rule_risk_parity"] = lambda s, d: r6(M.risk_parity(grid_ret(s, d), decisions(s, d)).select("t", "asset", "w"))
O["rule_risk_parity"] = f"WITH {LW} SELECT t, asset, round((1 / sqrt(cov + 1e-6)) / sum(1 / sqrt(cov + 1e-6)) OVER (PARTITION BY t), 6) AS w FROM lw JOIN uni ON ord = i WHERE i = j"
for m in ("sample", "shrunk", "ridge"):
    Q[f"rule_min_variance_{m}"] = lambda s, d, m=m: r6(M.min_variance(grid_ret(s, d), decisions(s, d), m).select("t", "asset", "w"))
Q["rule_black_litterman"] = lambda s, d: r6(C.project_long(M.bl_rule(grid_ret(s, d), decisions(s, d)), ["t"], "w", 0.6, "final").select("t", "asset", F.col("final").alias("w")))
# without views the posterior equals the equilibrium: w is the market portfolio
O["rule_black_litterman"] = f"WITH {S.BRAND}{S.DECIDE} SELECT t, asset, round(1e0 / count(*) OVER (PARTITION BY t), 6) AS w FROM grid JOIN decisions USING (t)"
Q["rule_black_litterman_views"] = lambda s, d: r6(C.project_long(
    M.bl_rule(grid_ret(s, d), decisions(s, d), p=[[1.0, -1.0] + [0.0] * 23], q=[0.001]), ["t"], "w", 0.6, "final").select("t", "asset", "final"))
