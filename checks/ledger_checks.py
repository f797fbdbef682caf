"""Registered queries: projection, feasibility, ledger, valuation."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import sqlparts as S
from checks.panel_checks import PERIODS, PERIOD_SQL, cal, feats, grid, r6
from checks.rule_checks import POLICY_SQL
from checks.rule_targets import ALL_RULES, TARGETS
from weightloom.functions import vectors as V
from weightloom.operators import dates as D
from weightloom.operators import ledger as L
from weightloom.operators import metrics as K
from weightloom.operators import projection as C
from weightloom.operators import rules as W
from weightloom.sources import testbed as TB

Q, O = {}, {}

# --- C1-C6 on the embedding vectors -------------------------------------------


def raw_vectors(s, d):
    """All components divided by their absolute sum, as doubles."""
    e = TB.table(s, d, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    e = e.select("vec_id", v.alias("v"))
    return e.select("vec_id", V.bind(
        V.total(F.transform("v", lambda y: F.abs(y))), lambda n: F.transform("v", lambda x: x / n)).alias("raw"))


def projected(s, d, cap=0.15):
    return C.project_vectors(raw_vectors(s, d), "raw", cap)


RAW = """raw AS (SELECT vec_id, list_transform(v, lambda x: x / list_sum(list_transform(v, lambda y: abs(y)))) AS raw FROM
  (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings))"""
# the oracle bisects like the textbook form: independent of the kink walk
BISECT = RAW + """,
el AS (SELECT vec_id, i, raw[i] AS a FROM raw, range(1, 65) r(i)),
bis AS (
  WITH RECURSIVE b AS (
    SELECT vec_id, 0 AS k, min(a) - 1.15e0 AS lo, max(a) + 1e0 AS hi FROM el GROUP BY vec_id
    UNION ALL
    SELECT b.vec_id, k + 1, CASE WHEN s > 1 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN s > 1 THEN hi ELSE (lo + hi) / 2 END
    FROM (SELECT b.*, (SELECT list_sum(list_transform(raw, lambda x: least(greatest(x - (b.lo + b.hi) / 2, 0e0), 0.15e0))) FROM raw WHERE raw.vec_id = b.vec_id) AS s FROM b) b
    WHERE k < 60)
  SELECT vec_id, hi FROM b WHERE k = 60),
pj AS (SELECT vec_id, raw, list_transform(c, lambda x: x / list_sum(c)) AS w FROM
  (SELECT raw.vec_id, raw.raw, list_transform(raw.raw, lambda x: least(greatest(x - hi, 0e0), 0.15e0)) AS c FROM raw JOIN bis USING (vec_id)))"""

Q["project_vectors"] = lambda s, d: projected(s, d).select("vec_id", F.posexplode("w").alias("i", "w")).select(
    "vec_id", "i", F.round("w", 6).alias("w"))
O["project_vectors"] = f"WITH {BISECT} SELECT vec_id, i - 1 AS i, round(w[i], 6) AS w FROM pj, range(1, 65) r(i)"

Q["project_long"] = lambda s, d: C.project_long(
    raw_vectors(s, d).select("vec_id", F.posexplode("raw").alias("i", "a")), ["vec_id"], "a", 0.15
).select("vec_id", "i", F.round("w", 6).alias("w"))
O["project_long"] = O["project_vectors"]

Q["projection_diagnostics"] = lambda s, d: r6(C.projection_diagnostics(projected(s, d), "raw", "w", 0.15).drop("raw", "w"))
O["projection_diagnostics"] = f"""WITH {BISECT} SELECT vec_id,
 round(list_sum(list_transform(raw, lambda x, i: abs(x - w[i]))), 6) AS proj_l1, round(sqrt(list_sum(list_transform(raw, lambda x, i: (x - w[i]) ** 2))), 6) AS proj_l2,
 len(list_filter(raw, lambda x: x < 0)) AS neg_weight_count, len(list_filter(raw, lambda x: x > 0.15e0)) AS over_cap_count,
 CAST(len(list_filter(raw, lambda x: x < 0 OR x > 0.15e0)) > 0 AS INT) AS cap_clip,
 round(-list_sum(list_transform(w, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)), 6) AS entropy, round(list_sum(list_transform(w, lambda x: x * x)), 6) AS herfindahl,
 CAST(list_sum(list_transform(w, lambda x: abs(x - 1e0 / 64))) < 1e-4 AS INT) AS equal_collapse,
 round(list_sum(w), 6) AS sum_weight, round(list_max(w), 6) AS max_weight, round(list_min(w), 6) AS min_weight FROM pj"""

Q["feasibility_metrics"] = lambda s, d: r6(C.feasibility(projected(s, d), "raw", "w", 0.15).drop("raw", "w"))
O["feasibility_metrics"] = f"""WITH {BISECT} SELECT vec_id, round(list_sum(raw), 6) AS raw_sum, round(list_max(raw), 6) AS raw_max_weight, round(list_min(raw), 6) AS raw_min_weight,
 round(abs(list_sum(raw) - 1), 6) AS raw_budget_violation, CAST(list_max(raw) > 0.15e0 + 1e-8 AS INT) AS raw_cap_violation, CAST(list_min(raw) < -1e-12 AS INT) AS raw_longonly_violation,
 round(list_sum(w), 6) AS post_sum, round(list_max(w), 6) AS post_max_weight, round(list_min(w), 6) AS post_min_weight,
 1 AS post_feasible_budget, 1 AS post_feasible_cap, 1 AS post_feasible_longonly FROM pj"""

Q["projection_optimality"] = lambda s, d: C.optimality_residual(projected(s, d), "raw", "w", 0.15).agg(
    F.count("*").alias("n"), F.round(F.max("kkt_residual"), 6).alias("worst"))
O["projection_optimality"] = "SELECT count(*) AS n, 0e0 AS worst FROM embeddings"

Q["turnover_cap_vectors"] = lambda s, d: r6(
    C.project_vectors(projected(s, d), "raw", 0.3, "tgt").select(
        "vec_id", V.l1(F.col("w"), F.col("tgt")).alias("gap"),
        V.l1(F.col("w"), C.turnover_capped(F.col("w"), F.col("tgt"), 0.05)).alias("moved")))

O["turnover_cap_vectors"] = f"""WITH {RAW}, p AS ({S.proj_sql(S.proj_sql("SELECT * FROM raw", "raw", "w", "0.15e0"), "raw", "tg", "0.3e0")}),
g AS (SELECT vec_id, list_sum(list_transform(w, lambda x, i: abs(x - tg[i]))) AS gap FROM p) SELECT vec_id, round(gap, 6) AS gap, round(least(gap, 0.05e0), 6) AS moved FROM g"""

# --- ledger -------------------------------------------------------------------


def wf(s, d):
    """Folds, panel and levels of the walk-forward study."""
    g = grid(s, d)
    f = D.folds(cal(s, d), 504, 378)
    return g, f, L.level_vectors(L.fold_rows(g, f))


def base_params(s, d):
    pts = s.createDataFrame([("base", 0.001, 42, 0.6, 0.25)], "run string, tcost double, rebalance int, max_weight double, turnover_cap double")
    return L.run_params(pts, TB.universe(s, d))


def ledger(s, d):
    g, f, lv = wf(s, d)
    dates = lv.where((F.col("t") - F.col("test_start")) % 42 == 0).select("t", "fold")
    tg = L.target_vectors(W.build_targets(ALL_RULES, feats(s, d), dates.select("t").distinct()))
    dec = tg.join(dates, "t").select("series", "fold", "t", "target")
    return L.rebalance_ledger(dec, lv, base_params(s, d)), lv


def diagnostics(s, d):
    return L.rebalance_diagnostics(ledger(s, d)[0], cal(s, d), base_params(s, d), D.folds(cal(s, d), 504, 378))


def daily(s, d):
    led, lv = ledger(s, d)
    return L.daily_valuation(led, lv)


FOLD_DAYS = """,
fr AS (SELECT fold, test_start, test_end, asset, ord, t, dt, last_value(px IGNORE NULLS) OVER (PARTITION BY fold, asset ORDER BY t ROWS UNBOUNDED PRECEDING) AS sp
  FROM grid JOIN folds ON t >= test_start AND t < test_end),
fret AS (SELECT *, coalesce(sp / lag(sp) OVER (PARTITION BY fold, asset ORDER BY t) - 1, 0e0) AS rr FROM fr),
days AS MATERIALIZED (SELECT fold, t, dt, t - test_start AS i, list(rr ORDER BY ord) AS r FROM fret GROUP BY fold, t, dt, i)"""


def daily_sql(targets: str, params: str) -> str:
    """Day-by-day recursion: drift, rebalance, cap, charge.

    targets: CTE tg(series, t, target list); params: CTE pr(run, reb, cap, tau, c).
    """
    step = """SELECT rec.run, rec.series, rec.fold, dy.i, dy.t, dy.dt, reb, cap, tau, c, rec.w AS pw,
        list_sum(list_transform(rec.w, lambda x, k: x * dy.r[k])) AS gross, dy.r AS r, dy.i % reb = 0 AS is_reb,
        coalesce(dy.target, rec.w) AS tgt0
      FROM rec JOIN dt_ dy ON dy.series = rec.series AND dy.fold = rec.fold AND dy.i = rec.i + 1"""
    step = f"SELECT *, list_transform(pw, lambda x, k: x * (1 + r[k]) / (1 + gross)) AS dr FROM ({step})"
    step = S.proj_sql(S.proj_sql(step, "dr", "pd", "cap"), "tgt0", "pt", "cap")
    step = f"SELECT *, list_sum(list_transform(pd, lambda x, k: abs(pt[k] - x))) AS gap FROM ({step})"
    step = f"""SELECT *, CASE WHEN NOT is_reb THEN dr WHEN gap <= tau OR gap <= 1e-12 THEN pt
        ELSE list_transform(pd, lambda x, k: x + tau / gap * (pt[k] - x)) END AS nw FROM ({step})"""
    step = f"""SELECT run, series, fold, i, t, dt, reb, cap, tau, c, nw AS w, dr, pt, gross,
        CASE WHEN is_reb THEN -c * list_sum(list_transform(nw, lambda x, k: abs(x - dr[k]))) ELSE 0e0 END AS fee FROM ({step})"""
    base = S.proj_sql("SELECT pr.*, dy.series, dy.fold, dy.i, dy.t, dy.dt, dy.target FROM dt_ dy, pr WHERE dy.i = 0", "target", "w", "cap")
    return f""",
{targets}, {params},
dt_ AS MATERIALIZED (SELECT tg0.series, days.*, tg.target FROM (SELECT DISTINCT series FROM tg) tg0, days LEFT JOIN tg ON tg.series = tg0.series AND tg.t = days.t),
rec AS (
  SELECT run, series, fold, i, t, dt, reb, cap, tau, c, w, list_transform(w, lambda x: 0e0) AS dr, w AS pt, 0e0 AS gross, 0e0 AS fee FROM ({base})
  UNION ALL
  {step}),
ledger_days AS MATERIALIZED (SELECT *, gross + fee AS ret FROM rec)"""


TG = "tg AS MATERIALIZED (SELECT series, t, list(w ORDER BY ord) AS target FROM rt GROUP BY 1, 2)"
PR = "pr AS (SELECT 'base' AS run, 42 AS reb, 0.6e0 AS cap, 0.25e0 AS tau, 0.001e0 AS c)"
FOLD_POLICY = POLICY_SQL.replace(S.DECIDE, S.FOLDS + """,
decisions AS (SELECT DISTINCT t FROM cal JOIN folds ON t >= test_start AND t < test_end AND (t - test_start) % 42 = 0)""")
WF = "WITH RECURSIVE " + FOLD_POLICY + TARGETS + FOLD_DAYS + daily_sql(TG, PR)

Q["rebalance_ledger"] = lambda s, d: r6(ledger(s, d)[0].select(
    "run", "series", "fold", "t", "turnover_before_cap", "turnover_after_cap", "fee",
    F.array_max("w").alias("top"), V.herfindahl(F.col("w")).alias("hhi")))
O["rebalance_ledger"] = WF + """ SELECT run, series, fold, t,
 CASE WHEN i > 0 THEN round(list_sum(list_transform(pt, lambda x, k: abs(x - dr[k]))), 6) END AS turnover_before_cap,
 CASE WHEN i > 0 THEN round(list_sum(list_transform(w, lambda x, k: abs(x - dr[k]))), 6) END AS turnover_after_cap,
 round(fee, 6) AS fee, round(list_max(w), 6) AS top, round(list_sum(list_transform(w, lambda x: x * x)), 6) AS hhi FROM ledger_days WHERE i % 42 = 0"""

Q["walk_forward_daily"] = lambda s, d: r6(daily(s, d).select("series", "fold", "t", "dt", "ret", "gross", "fee"))
O["walk_forward_daily"] = WF + " SELECT series, fold, t, dt, round(ret, 6) AS ret, round(gross, 6) AS gross, round(fee, 6) AS fee FROM ledger_days"


def q_wf_metrics(s, d):
    out = K.fold_summary(daily(s, d), ["series"])
    return r6(out.select("series", F.col("scope").alias("fold"), "n", "sharpe", "sortino", "cagr", "vol", "mdd", "avg_turnover"))


Q["walk_forward_metrics"] = q_wf_metrics
MET = """,
to_ AS (SELECT series, fold, t, ret, coalesce(list_sum(list_transform(w, lambda x, k: abs(x - lw[k]))), 0e0) AS turnover FROM
  (SELECT *, lag(w) OVER (PARTITION BY run, series, fold ORDER BY t) AS lw FROM ledger_days)),
both_ AS (SELECT series || '#' || fold AS k, t, ret FROM to_ UNION ALL SELECT series || '#ALL', t, ret FROM to_),
e0 AS (SELECT *, product(1e0 + ret) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING) AS eq FROM both_),
e1 AS (SELECT *, eq / max(eq) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e0),
m AS (SELECT k, count(*) AS n, avg(ret) AS mu, stddev_samp(ret) AS sd, stddev_samp(least(ret, 0)) AS ds, min(dd) AS mdd, arg_max(eq, t) / arg_min(eq, t) AS g FROM e1 GROUP BY k),
tf AS (SELECT series, CAST(fold AS VARCHAR) AS fold, avg(turnover) AS tau FROM to_ GROUP BY 1, 2),
ta AS (SELECT * FROM tf UNION ALL SELECT series, 'ALL', avg(tau) FROM tf GROUP BY 1)
SELECT series, fold, n, round(CASE WHEN sd > 0 THEN sqrt(252e0) * mu / sd ELSE 0 END, 6) AS sharpe, round(CASE WHEN ds > 0 THEN sqrt(252e0) * mu / ds ELSE 0 END, 6) AS sortino,
 round(pow(g, 252e0 / n) - 1, 6) AS cagr, round(sd * sqrt(252e0), 6) AS vol, round(mdd, 6) AS mdd, round(tau, 6) AS avg_turnover
FROM m JOIN ta ON m.k = ta.series || '#' || ta.fold"""
O["walk_forward_metrics"] = WF + MET

Q["tidy_equity"] = lambda s, d: r6(L.tidy_equity(daily(s, d), "brands").drop("run"))
O["tidy_equity"] = WF + """ SELECT series, dt, fold, 'fold_oos' AS segment, round(product(1e0 + ret) OVER (PARTITION BY series, fold ORDER BY t ROWS UNBOUNDED PRECEDING), 6) AS equity, 1 AS is_oos, 'brands' AS universe FROM ledger_days
UNION ALL SELECT series, dt, 0, 'stitched_oos', round(product(1e0 + ret) OVER (PARTITION BY series ORDER BY t ROWS UNBOUNDED PRECEDING), 6), 1, 'brands' FROM ledger_days"""

Q["rebalance_diagnostics"] = lambda s, d: r6(diagnostics(s, d))
O["rebalance_diagnostics"] = WF + """ SELECT run, series, l.fold, i // 42 AS seq, l.dt AS decision_date, coalesce(CAST(n.dt AS VARCHAR), 'END') AS effective_from, 1 AS execution_lag_days, 0 AS uses_same_day_return,
 1 AS weight_drift_applied, CASE WHEN i > 0 THEN round(list_sum(list_transform(pt, lambda x, k: abs(x - dr[k]))), 6) END AS turnover_before_cap,
 CASE WHEN i > 0 THEN round(list_sum(list_transform(w, lambda x, k: abs(x - dr[k]))), 6) END AS turnover_after_cap,
 round(list_sum(list_transform(w, lambda x, k: abs(x - pt[k]))), 6) AS projection_l1_target_to_final, round(sqrt(list_sum(list_transform(w, lambda x, k: (x - pt[k]) ** 2))), 6) AS projection_l2_target_to_final,
 round(list_max(w), 6) AS max_weight_final, round(list_sum(w), 6) AS sum_weight_final, round(list_min(w), 6) AS min_weight_final, 1 AS feasible_budget, 1 AS feasible_nonnegative,
 CAST(list_max(w) <= 0.6 + 1e-8 AS INT) AS feasible_cap, 0.25e0 AS turnover_cap, 0.6e0 AS max_weight_cap, round(fee, 6) AS fee, round(gross, 6) AS gross_return_before_fee
FROM ledger_days l LEFT JOIN (SELECT DISTINCT fold, t, dt FROM days) n ON n.fold = l.fold AND n.t = l.t + 1 WHERE i % 42 = 0"""

Q["feasibility_violation_rates"] = lambda s, d: r6(C.violation_rates(
    diagnostics(s, d), ["series"]))
O["feasibility_violation_rates"] = WF + """ SELECT series, 0e0 AS budget_violation_rate, 0e0 AS nonnegative_violation_rate,
 round(1 - avg(CASE WHEN list_max(w) <= 0.6 + 1e-8 THEN 1e0 ELSE 0 END), 6) AS cap_violation_rate FROM ledger_days WHERE i % 42 = 0 GROUP BY series"""

Q["projection_effects"] = lambda s, d: r6(K.with_series_parts(diagnostics(s, d).groupBy("series").agg(
    *[F.avg(c).alias(c) for c in ("turnover_before_cap", "turnover_after_cap", "projection_l1_target_to_final", "max_weight_final", "feasible_cap")])))
O["projection_effects"] = WF + """ SELECT series, CASE WHEN series LIKE 'CODED_P%' THEN 'CodedPolicy' ELSE 'Baseline' END AS method_group, '' AS model,
 CASE WHEN series LIKE 'CODED_P%' THEN replace(series, 'CODED_', '') ELSE '' END AS persona,
 round(avg(list_sum(list_transform(pt, lambda x, k: abs(x - dr[k])))) FILTER (i > 0), 6) AS turnover_before_cap, round(avg(list_sum(list_transform(w, lambda x, k: abs(x - dr[k])))) FILTER (i > 0), 6) AS turnover_after_cap,
 round(avg(list_sum(list_transform(w, lambda x, k: abs(x - pt[k])))), 6) AS projection_l1_target_to_final, round(avg(list_max(w)), 6) AS max_weight_final,
 round(avg(CAST(list_max(w) <= 0.6 + 1e-8 AS INT)), 6) AS feasible_cap FROM ledger_days WHERE i % 42 = 0 GROUP BY series"""

# --- sensitivity, stress, conflict --------------------------------------------
AXES = {"tcost": [0.0, 0.001, 0.0025, 0.005], "max_weight": [0.4, 0.5, 0.6, 0.8],
        "turnover_cap": [0.10, 0.25, 0.50, 1.00], "rebalance": [5, 21, 42, 63]}
BASE = {"tcost": 0.001, "max_weight": 0.6, "turnover_cap": 0.25, "rebalance": 42}


def grid_points(s):
    g = D.sensitivity_grid(s, BASE, AXES)
    return g.withColumn("run", F.format_string("%s=%.4f", "axis", "value"))


def run_study(s, d, folds, rules, points):
    g = grid(s, d)
    lv = L.level_vectors(L.fold_rows(g, folds))
    steps = F.broadcast(points.select("rebalance").distinct())
    due = lv.join(steps, (F.col("t") - F.col("test_start")) % F.col("rebalance") == 0).select("fold", "t").distinct()
    tg = L.target_vectors(W.build_targets(rules, feats(s, d), due.select("t").distinct()))
    dec = tg.join(due, "t").select("series", "fold", "t", "target")
    led = L.rebalance_ledger(dec, lv, L.run_params(points, TB.universe(s, d)))
    return L.daily_valuation(led, lv)


def holdout(s, d):
    n = cal(s, d).agg(F.max("n_dates").alias("n"))
    sp = D.split_point("n")
    return n.select(F.lit(1).alias("fold"), F.lit(0).alias("train_start"), sp.alias("train_end"), sp.alias("test_start"), F.col("n").alias("test_end"))


def q_sensitivity(s, d):
    pts = grid_points(s)
    day = run_study(s, d, holdout(s, d), ALL_RULES, pts)
    keys = ["run", "series"]
    out = K.summary(day.drop("w"), keys)
    return r6(out.select("run", "series", "sharpe", "mdd", "cagr", F.col("avg_turnover").alias("turnover")))


Q["sensitivity_table"] = q_sensitivity
HOLD = """,
folds AS (SELECT 1 AS fold, greatest(1, least(n - 1, CAST(round_even(n * 0.7e0, 0) AS INT))) AS test_start, n AS test_end FROM (SELECT max(n_dates) AS n FROM cal)),
decisions AS (SELECT DISTINCT t FROM cal JOIN folds ON t >= test_start AND ((t - test_start) % 5 = 0 OR (t - test_start) % 21 = 0))"""
GRID_SQL = "pr AS (SELECT * FROM (VALUES " + ", ".join(
    "('{}={:.4f}', {}, {}e0, {}e0, {}e0)".format(ax, v, int({**BASE, ax: v}["rebalance"]), {**BASE, ax: v}["max_weight"],
                                                  {**BASE, ax: v}["turnover_cap"], {**BASE, ax: v}["tcost"])
    for ax, vs in AXES.items() for v in vs) + ") v(run, reb, cap, tau, c))"
MET2 = """,
to_ AS (SELECT run, series, t, ret, coalesce(list_sum(list_transform(w, lambda x, k: abs(x - lw[k]))), 0e0) AS turnover FROM
  (SELECT *, lag(w) OVER (PARTITION BY run, series, fold ORDER BY t) AS lw FROM ledger_days)),
e0 AS (SELECT *, product(1e0 + ret) OVER (PARTITION BY run, series ORDER BY t ROWS UNBOUNDED PRECEDING) AS eq FROM to_),
e1 AS (SELECT *, eq / max(eq) OVER (PARTITION BY run, series ORDER BY t ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e0)
SELECT run, series, round(CASE WHEN stddev_samp(ret) > 0 THEN sqrt(252e0) * avg(ret) / stddev_samp(ret) ELSE 0 END, 6) AS sharpe,
 round(min(dd), 6) AS mdd, round(pow(arg_max(eq, t) / arg_min(eq, t), 252e0 / count(*)) - 1, 6) AS cagr, round(avg(turnover), 6) AS turnover FROM e1 GROUP BY run, series"""
O["sensitivity_table"] = "WITH RECURSIVE " + POLICY_SQL.replace(S.DECIDE, HOLD) + TARGETS + FOLD_DAYS + daily_sql(TG, GRID_SQL) + MET2


def stress_folds(s, d):
    hit = D.in_periods(cal(s, d), D.period_table(s, PERIODS))
    f = hit.groupBy("period").agg(F.min("t").alias("test_start"), (F.max("t") + 1).alias("test_end"), F.count("*").alias("n"))
    return f.where("n >= 30").select(F.col("period").alias("fold"), "test_start", "test_end")


def q_stress(s, d):
    pts = s.createDataFrame([("base", 0.001, 42, 0.6, 0.25)], "run string, tcost double, rebalance int, max_weight double, turnover_cap double")
    day = run_study(s, d, stress_folds(s, d), ALL_RULES, pts)
    out = K.summary(day.drop("w"), ["fold", "series"])
    return r6(out.select(F.col("fold").alias("period"), "series", "n", "sharpe", "cagr", "mdd", F.col("avg_turnover").alias("turnover")))


Q["stress_suite"] = q_stress
STRESS = PERIOD_SQL + """,
folds AS (SELECT period AS fold, min(t) AS test_start, max(t) + 1 AS test_end FROM cal JOIN periods ON dt BETWEEN ps AND pe GROUP BY 1 HAVING count(*) >= 30),
decisions AS (SELECT DISTINCT t FROM cal JOIN folds ON t >= test_start AND t < test_end AND (t - test_start) % 42 = 0)"""
MET3 = MET2.replace("SELECT run, series, t, ret, coalesce", "SELECT fold AS run, series, t, ret, coalesce").replace(
    "SELECT run, series, round(CASE", "SELECT run AS period, series, count(*) AS n, round(CASE")
O["stress_suite"] = "WITH RECURSIVE " + POLICY_SQL.replace(S.DECIDE, STRESS) + TARGETS + FOLD_DAYS + daily_sql(TG, PR) + MET3
