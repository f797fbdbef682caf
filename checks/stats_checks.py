"""Registered queries: bootstraps and significance tests."""

from pyspark.sql import functions as F

from checks import sqlparts as S
from checks.audit_checks import DIFFS, diffs
from checks.panel_checks import SERIES, r6, series_returns
from weightloom.functions import scalars as X
from weightloom.operators import resample as B
from weightloom.operators import stats as T
from weightloom.sources import testbed as TB

Q, O = {}, {}

# Phi and the chi-square tail as series in SQL, independent of the Python helpers
PHI2 = """CASE WHEN {z} > 8 THEN 0e0 ELSE greatest(0e0, 1 - 2 * (exp(-{z} * {z} / 2) / sqrt(2 * pi())) * list_sum(list_transform(range(0, 160),
  lambda jj: CASE WHEN {z} = 0 THEN 0e0 ELSE exp((2 * jj + 1) * ln({z}) - ((jj + 1) * ln(2e0) + lgamma(jj + 1.5e0) - 0.5 * ln(pi()))) END))) END"""
CHI2 = """greatest(0e0, 1 - list_sum(list_transform(range(0, 200), lambda jj: exp(({d} / 2 + jj) * ln({x} / 2) - {x} / 2 - lgamma({d} / 2 + jj + 1)))))"""


def p_of(z):
    return PHI2.format(z=f"abs({z})")


def lane(h, k):
    return f"('0x' || substr({h}, {8 * k + 1}, 8))::BIGINT"


def draws_sql(name, sizes, n, count, reps, seed=42):
    """CTE name(rep, slot, draw, <size columns>)."""
    return f"""{name} AS (SELECT z.*, rep, blk * 4 + lane AS slot, CASE lane WHEN 0 THEN {lane('h', 0)} WHEN 1 THEN {lane('h', 1)} WHEN 2 THEN {lane('h', 2)} ELSE {lane('h', 3)} END % {n} AS draw
  FROM (SELECT z.*, r.rep, b.blk, md5('{seed}|' || r.rep || '|' || b.blk) AS h FROM {sizes} z, range(1, {reps + 1}) r(rep), range(0, 100000) b(blk) WHERE b.blk <= ({count} - 1) // 4) z, range(0, 4) l(lane)
  WHERE blk * 4 + lane < {count})"""


def outcome_calls(s, d):
    doc = TB.table(s, d, "documents").select("doc_id", "lang", "source")
    return TB.table(s, d, "labels").join(doc, "doc_id").select(
        "doc_id", "lang", "source", "quality", "toxic", (F.col("doc_id") % 18).alias("decision"))


def boot_sql(scope, keys, metric, reps, src="SELECT doc_id, lang, source, quality, toxic, doc_id % 18 AS decision FROM labels JOIN documents USING (doc_id)"):
    sc = ", ".join(scope)
    cols = ", ".join([*scope, *keys])
    kk = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    part = f"PARTITION BY {sc} " if scope else ""
    js = " AND ".join(["d.draw = g.idx", *[f"d.{k} = g.{k}" for k in scope]])
    grp = f"{sc}, " if scope else ""
    return f"""WITH src AS ({src}),
g0 AS (SELECT {cols}, CAST(sum({metric}) AS DOUBLE) AS s, count({metric}) AS c FROM src GROUP BY {cols}),
g AS (SELECT *, row_number() OVER ({part}ORDER BY substr(md5({kk}), 1, 2), {', '.join(keys)}) - 1 AS idx FROM g0),
sz AS (SELECT {grp}count(*) AS clusters, sum(c) AS records, sum(s) / sum(c) AS estimate FROM g {'GROUP BY ' + sc if scope else ''}),
{draws_sql('d', '(SELECT * FROM sz WHERE clusters >= 2)', 'clusters', 'clusters', reps)},
v AS (SELECT {', '.join('d.' + k for k in scope) + ', ' if scope else ''}rep, sum(g.s) / sum(g.c) AS v FROM d JOIN g ON {js} GROUP BY {', '.join('d.' + k for k in scope) + ', ' if scope else ''}rep),
q AS (SELECT {grp}quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM v {'GROUP BY ' + sc if scope else ''})
SELECT {', '.join('sz.' + k for k in scope) + ', ' if scope else ''}round(estimate, 6) AS estimate, round(lo, 6) AS ci95_lower, round(hi, 6) AS ci95_upper, records, clusters
FROM sz LEFT JOIN q ON {' AND '.join(f'sz.{k} = q.{k}' for k in scope) if scope else 'true'}"""


Q["cluster_bootstrap"] = lambda s, d: r6(B.cluster_bootstrap(outcome_calls(s, d), ["lang"], ["lang", "source"][1:], "quality"))
O["cluster_bootstrap"] = boot_sql(["lang"], ["source"], "quality", 10_000)
Q["cluster_bootstrap_overall"] = lambda s, d: r6(B.cluster_bootstrap(outcome_calls(s, d), [], ["lang", "source"], "quality"))
O["cluster_bootstrap_overall"] = boot_sql([], ["lang", "source"], "quality", 10_000)
Q["date_block_bootstrap"] = lambda s, d: r6(B.cluster_bootstrap(outcome_calls(s, d), ["lang"], ["decision"], "toxic"))
O["date_block_bootstrap"] = boot_sql(["lang"], ["decision"], "toxic", 10_000)
Q["iid_mean_interval"] = lambda s, d: r6(B.mean_interval(outcome_calls(s, d), ["lang"], ["doc_id"], "quality"))
O["iid_mean_interval"] = boot_sql(["lang"], ["doc_id"], "quality", 2000)

Q["bootstrap_scopes"] = lambda s, d: r6(B.scoped_bootstrap(
    outcome_calls(s, d), {"overall": F.lit(True), "src4_excluded": F.col("source") != "src4"}, "lang", ["source", "decision"], ["quality", "toxic"]))
O["bootstrap_scopes"] = boot_sql(["scope", "metric"], ["source", "decision"], "value", 10_000, """
  WITH o AS (SELECT lang, source, quality, toxic, doc_id % 18 AS decision FROM labels JOIN documents USING (doc_id)),
  m AS (SELECT lang, source, decision, 'quality' AS metric, quality AS value FROM o UNION ALL SELECT lang, source, decision, 'toxic', toxic FROM o)
  SELECT *, 'overall' AS scope FROM m UNION ALL SELECT *, 'src4_excluded' FROM m WHERE source <> 'src4' UNION ALL SELECT *, lang FROM m""")

# ---- T1, T2, T11 ---------------------------------------------------------------


def hac_sql(src, lags=5):
    """CTEs ending in hac(series, n, mu, v): biased autocovariances, Bartlett weights."""
    lag = ", ".join(f"lag(x, {k}) OVER w AS l{k}" for k in range(1, lags + 1)) or "0 AS l0"
    var = "sum(x * x) / count(*)" + "".join(f" + 2 * (1 - {k}e0 / {lags + 1}) * coalesce(sum(x * l{k}), 0) / count(*)" for k in range(1, lags + 1))
    return f"""hx AS (SELECT series, t, diff - avg(diff) OVER (PARTITION BY series) AS x, avg(diff) OVER (PARTITION BY series) AS mu FROM {src}),
hl AS (SELECT series, x, mu, {lag} FROM hx WINDOW w AS (PARTITION BY series ORDER BY t)),
hac AS (SELECT series, count(*) AS n, first(mu) AS mu, greatest({var}, 0) AS v FROM hl GROUP BY series)"""


T_SQL = "mu / sqrt(v / n)"
Q["hac_test"] = lambda s, d: r6(T.hac_test(diffs(s, d)).select("series", "n", F.col("mean") * 1e6, "t_hac", "p_hac").toDF("series", "n", "mean_e6", "t_hac", "p_hac"))
O["hac_test"] = f"WITH {DIFFS}, {hac_sql('diffs')} SELECT series, n, {S.R('mu * 1e6', 'mean_e6')}, {S.R(T_SQL, 't_hac')}, {S.R(p_of(T_SQL), 'p_hac')} FROM hac"
Q["excess_regression"] = lambda s, d: r6(T.excess_regression(diffs(s, d)))
O["excess_regression"] = f"""WITH {DIFFS}, {hac_sql('diffs')} SELECT series, n, {S.R('mu', 'mean_daily_excess')}, {S.R('252 * mu', 'annualized_excess')}, {S.R(T_SQL, 'hac_t')},
 {S.R(p_of(T_SQL), 'hac_p')} FROM hac"""


def dm_pairs(s, d):
    r = series_returns(s, d)
    base = r.where("series = 'EQUAL'").select("t", F.col("ret").alias("y"))
    return r.where("series <> 'EQUAL'").join(base, "t").select("series", "t", F.col("ret").alias("x"), "y")


for pw, expr in ((1, "-a.ret + b.ret"), (2, "-a.ret * a.ret + b.ret * b.ret"), (3, "-abs(a.ret) + abs(b.ret)")):
    nm = f"diebold_mariano_{pw}"
    Q[nm] = lambda s, d, pw=pw: r6(T.diebold_mariano(dm_pairs(s, d), 1, pw).select("series", "n", F.col("t_hac").alias("dm_t"), F.col("p_hac").alias("dm_p")))
    O[nm] = f"""WITH {SERIES}, ld AS (SELECT a.series, a.t, {expr} AS diff FROM series a JOIN series b ON b.series = 'EQUAL' AND b.t = a.t WHERE a.series <> 'EQUAL'),
 {hac_sql('ld', 0)} SELECT series, n, {S.R(T_SQL, 'dm_t')}, {S.R(p_of(T_SQL), 'dm_p')} FROM hac"""

# ---- T3, T4, T5 ------------------------------------------------------------------


def rank_sql(src, keys, drop_zero):
    k = ", ".join(keys)
    return f"""rkd AS (SELECT {k}, diff, rank() OVER (PARTITION BY {k} ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY {k}, abs(diff)) - 1) / 2e0 AS rk,
   count(*) OVER (PARTITION BY {k}, abs(diff)) AS ties FROM {src} {'WHERE diff <> 0' if drop_zero else ''}),
wx AS (SELECT {k}, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (diff = 0) AS DOUBLE) AS z, coalesce(sum(rk) FILTER (diff > 0), 0) AS rp, coalesce(sum(rk) FILTER (diff < 0), 0) AS rm,
   coalesce(sum(ties * ties - 1) FILTER (diff <> 0), 0) AS tt, avg(diff) AS md FROM rkd GROUP BY {k}),
wz AS (SELECT *, least(rp, rm) AS w, (least(rp, rm) - n * (n + 1) / 4 + z * (z + 1) / 4) / nullif(sqrt((n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1) - tt / 2e0) / 24), 0) AS zs FROM wx)"""


Q["wilcoxon"] = lambda s, d: r6(T.wilcoxon(diffs(s, d).withColumn("diff", F.round("diff", 9)), ["series"]))
O["wilcoxon"] = f"WITH {DIFFS}, rd AS (SELECT series, t, round(diff, 9) AS diff FROM diffs), {rank_sql('rd', ['series'], True)} SELECT series, CAST(n AS BIGINT) AS n, {S.R('w')}, {S.R(p_of('zs'), 'p')} FROM wz"
Q["jackknife_sharpe"] = lambda s, d: r6(T.jackknife_sharpe(diffs(s, d)))
O["jackknife_sharpe"] = f"""WITH {DIFFS}, m AS (SELECT series, count(*) AS n, sum(diff) AS s1, sum(diff * diff) AS s2, avg(diff) AS mu, stddev_samp(diff) AS sd FROM diffs GROUP BY series),
l AS (SELECT series, ((s1 - diff) / (n - 1)) / sqrt(((s2 - diff * diff) - (s1 - diff) * (s1 - diff) / (n - 1)) / (n - 2)) * sqrt(252e0) AS th FROM diffs JOIN m USING (series)),
v AS (SELECT series, var_pop(th) AS v FROM l GROUP BY series)
SELECT series, n, {S.R('mu / sd * sqrt(252e0)', 'sharpe')}, {S.R('(mu / sd * sqrt(252e0)) / sqrt((n - 1) * v)', 'jk_z')} FROM m JOIN v USING (series)"""

# ---- T6-T10 -----------------------------------------------------------------------


def pos_sql(src):
    return f"pos AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY t) - 1 AS pos, count(*) OVER (PARTITION BY series) AS n, diff AS x FROM {src})"


def block_rows(block, reps):
    """Every resampled observation, one by one: the naive form."""
    return f"""sz AS (SELECT DISTINCT n FROM pos), {draws_sql('dr', 'sz', 'n', f'CAST(ceil(n / {block}e0) AS BIGINT)', reps)},
ix AS (SELECT dr.n, rep, (draw + k) % dr.n AS pos FROM dr, range(0, {block}) b(k) WHERE slot * {block} + k < dr.n),
bs AS (SELECT series, rep, pos.n, avg(x) AS mu, stddev_samp(x) AS sd FROM ix JOIN pos ON pos.n = ix.n AND pos.pos = ix.pos GROUP BY ALL)"""


Q["moving_block_bootstrap"] = lambda s, d: r6(B.block_bootstrap_p(diffs(s, d)))
O["moving_block_bootstrap"] = f"""WITH {DIFFS}, {pos_sql('diffs')}, {block_rows(7, 2000)}, m AS (SELECT series, avg(x) AS mu0 FROM pos GROUP BY 1)
SELECT series, n, round(avg(CASE WHEN abs(mu - mu0) >= abs(mu0) THEN 1e0 ELSE 0 END), 6) AS mbb_p FROM bs JOIN m USING (series) GROUP BY series, n"""
Q["moving_block_bootstrap_greater"] = lambda s, d: r6(B.block_bootstrap_p(diffs(s, d), two_sided=False))
O["moving_block_bootstrap_greater"] = O["moving_block_bootstrap"].replace("abs(mu - mu0) >= abs(mu0)", "mu - mu0 >= mu0")
Q["block_sharpe_interval"] = lambda s, d: r6(B.block_sharpe_interval(diffs(s, d)))
O["block_sharpe_interval"] = f"""WITH {DIFFS}, {pos_sql('diffs')}, {block_rows(20, 2000)}, e AS (SELECT series, count(*) AS n, avg(x) / stddev_samp(x) * sqrt(252e0) AS est FROM pos GROUP BY 1),
q AS (SELECT series, quantile_cont(mu / sd * sqrt(252e0), 0.025) AS lo, quantile_cont(mu / sd * sqrt(252e0), 0.975) AS hi FROM bs GROUP BY 1)
SELECT series, n, round(est, 6) AS estimate, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high FROM e JOIN q USING (series)"""


def lengths(s, d):
    return B.positions(diffs(s, d), "diff").select("n").distinct()


def index_digest(x):
    """What one resample draws, as one row: a sum that depends on the order."""
    return x.groupBy("n", "rep").agg(F.countDistinct("idx").alias("distinct_days"), F.sum((F.col("t") + 1) * F.col("idx").cast("bigint")).alias("weighted"))


Q["stationary_bootstrap_index"] = lambda s, d: index_digest(B.stationary_index(lengths(s, d), 2000)).withColumn("n", F.col("n").cast("bigint"))
STAT = """sz AS (SELECT DISTINCT n FROM pos),
st0 AS (SELECT n, rep, t, md5('42|' || rep || '|' || t) AS h FROM sz, range(1, {R}) r(rep), range(0, 100000) g(t) WHERE t < n),
st1 AS (SELECT n, rep, t, CASE WHEN t = 0 OR """ + lane("h", 0) + """ / 4294967296e0 < 0.1e0 THEN """ + lane("h", 1) + """ % n END AS start FROM st0),
st AS (SELECT n, rep, t, (last_value(start IGNORE NULLS) OVER w + t - last_value(CASE WHEN start IS NOT NULL THEN t END IGNORE NULLS) OVER w) % n AS idx FROM st1
  WINDOW w AS (PARTITION BY n, rep ORDER BY t ROWS UNBOUNDED PRECEDING))"""
# the index is checked against the sequential definition, all resamples a step at a time
O["stationary_bootstrap_index"] = f"""WITH RECURSIVE {DIFFS}, {pos_sql('diffs')}, {STAT.format(R=2001)},
walk AS (SELECT rep, t, start AS idx, n FROM st1 WHERE t = 0
  UNION ALL SELECT w.rep, s.t, coalesce(s.start, (w.idx + 1) % w.n), w.n FROM walk w JOIN st1 s ON s.rep = w.rep AND s.n = w.n AND s.t = w.t + 1)
SELECT n, rep, count(DISTINCT idx) AS distinct_days, CAST(sum((t + 1) * idx) AS BIGINT) AS weighted FROM walk GROUP BY n, rep"""


# 2,000 resamples of every series, day by day, are too much for SQL: tests compare a small table with brute force
Q["reality_check"] = lambda s, d: r6(T.reality_check(diffs(s, d)))
Q["reality_check_plain"] = lambda s, d: r6(T.reality_check(diffs(s, d), studentise=False))
Q["spa_test"] = lambda s, d: r6(T.reality_check(diffs(s, d), spa=True))
Q["spa_test_plain"] = lambda s, d: r6(T.reality_check(diffs(s, d), spa=True, studentise=False))

Q["comparison_table"] = lambda s, d: r6(T.comparison_table(
    series_returns(s, d).withColumn("ret", F.round("ret", 9)), "EQUAL", "brands", "panel"))
RD = DIFFS.replace("a.ret - b.ret AS diff", "round(a.ret, 9) - round(b.ret, 9) AS diff")
O["comparison_table"] = f"""WITH {RD}, {hac_sql('diffs')}, {rank_sql('diffs', ['series'], True)},
m AS (SELECT series, count(*) AS n, sum(diff) AS s1, sum(diff * diff) AS s2, avg(diff) AS mu, stddev_samp(diff) AS sd FROM diffs GROUP BY series),
l AS (SELECT series, ((s1 - diff) / (n - 1)) / sqrt(((s2 - diff * diff) - (s1 - diff) * (s1 - diff) / (n - 1)) / (n - 2)) * sqrt(252e0) AS th FROM diffs JOIN m USING (series)),
v AS (SELECT series, var_pop(th) AS v FROM l GROUP BY series),
{pos_sql('diffs')}, {block_rows(7, 2000)}, m0 AS (SELECT series, avg(x) AS mu0 FROM pos GROUP BY 1),
mb AS (SELECT series, avg(CASE WHEN abs(bs.mu - mu0) >= abs(mu0) THEN 1e0 ELSE 0 END) AS mbb FROM bs JOIN m0 USING (series) GROUP BY series),
f AS (SELECT hac.series, hac.n, hac.mu, hac.mu / sqrt(hac.v / hac.n) AS th, m.mu / m.sd * sqrt(252e0) / sqrt((m.n - 1) * v.v) AS jk, mbb, zs FROM hac JOIN wz USING (series) JOIN m USING (series) JOIN v USING (series) JOIN mb USING (series)),
pf AS (SELECT *, {p_of('th')} AS ph FROM f)
SELECT 'brands' AS grp, 'panel' AS algo, series AS comparator, n, round(252 * mu, 6) AS mean_diff_ann, round(th, 6) AS t_hac, round(ph, 6) AS p_hac, round({p_of('zs')}, 6) AS wilcoxon_p,
 round(jk, 6) AS jk_z, round(mbb, 6) AS mbb_p, CASE WHEN ph < 0.01 THEN '***' WHEN ph < 0.05 THEN '**' WHEN ph < 0.1 THEN '*' ELSE '' END AS stars FROM pf"""

# ---- T16-T19 -----------------------------------------------------------------------


def scores(s, d):
    """Block = day, treatment = user group, group = event type."""
    e = TB.table(s, d, "events")
    return e.groupBy(F.col("event_type").alias("policy"), F.to_date("ts").alias("dt"), F.concat(F.lit("m"), F.col("user_id") % 4).alias("model")).agg(
        (F.sum(F.round(F.col("value") * 100).cast("bigint")) / (F.count("*") * 100.0)).alias("score"))


SCORES = """sc AS (SELECT event_type AS policy, CAST(ts AS DATE) AS dt, 'm' || (user_id % 4) AS model, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 1e2) AS score FROM events GROUP BY 1, 2, 3),
kk AS (SELECT policy, count(DISTINCT model) AS k FROM sc GROUP BY 1), fb AS (SELECT policy, dt FROM sc JOIN kk USING (policy) GROUP BY policy, dt, k HAVING count(DISTINCT model) = k),
cb AS (SELECT sc.* FROM sc JOIN fb USING (policy, dt))"""
FRIED = SCORES + f""", rf AS (SELECT policy, model, rank() OVER (PARTITION BY policy, dt ORDER BY score) + (count(*) OVER (PARTITION BY policy, dt, score) - 1) / 2e0 AS rk, count(*) OVER (PARTITION BY policy, dt, score) AS ti FROM cb),
rs AS (SELECT policy, model, sum(rk) AS s, count(*) AS n, sum(ti * ti - 1) AS tt FROM rf GROUP BY 1, 2),
fr0 AS (SELECT policy, first(n) AS n, count(*) AS k, sum(s * s) AS ssq, sum(tt) AS tt FROM rs GROUP BY 1),
fr AS (SELECT policy, n, k, (12e0 / (k * n * (k + 1)) * ssq - 3e0 * n * (k + 1)) / (1 - tt / (CAST(k AS DOUBLE) * (k * k - 1) * n)) AS chi2 FROM fr0)"""
Q["friedman"] = lambda s, d: r6(T.friedman(scores(s, d), ["policy"], "dt", "model", "score"))
O["friedman"] = f"WITH {FRIED} SELECT policy, n AS n_blocks, k AS n_models, round(chi2, 6) AS chi2, round({CHI2.format(x='chi2', d='(k - 1e0)')}, 6) AS p, round(chi2 / (n * (k - 1)), 6) AS kendalls_w, 0 AS untestable FROM fr"


def pair_tests(s, d):
    p = T.treatment_pairs(scores(s, d), ["policy"], "dt", "model", "score").withColumn("diff", F.round("diff", 9))
    return T.holm(T.wilcoxon(p, ["policy", "a", "b"], pratt=True), ["policy"])


Q["pratt_pairs_holm"] = lambda s, d: r6(pair_tests(s, d))
PAIRS = SCORES + ", pr AS (SELECT x.policy, x.model AS a, y.model AS b, round(x.score - y.score, 9) AS diff FROM cb x JOIN cb y ON x.policy = y.policy AND x.dt = y.dt AND x.model < y.model), " + rank_sql("pr", ["policy", "a", "b"], False)
HOLM = f""", pw AS (SELECT policy, a, b, CAST(n AS BIGINT) AS n, md, w, {p_of('zs')} AS p FROM wz),
ho AS (SELECT *, (count(p) OVER (PARTITION BY policy) - row_number() OVER (PARTITION BY policy ORDER BY p, a, b) + 1) * p AS h FROM pw)"""
O["pratt_pairs_holm"] = f"""WITH {PAIRS}{HOLM} SELECT policy, a, b, n, round(md, 6) AS mean_diff, round(w, 6) AS w, round(p, 6) AS p, 'tested' AS status,
 round(least(max(h) OVER (PARTITION BY policy ORDER BY p, a, b ROWS UNBOUNDED PRECEDING), 1e0), 6) AS p_holm FROM ho"""


def posthoc_scores(s, d):
    """Model m3 lifted by 20 so that the omnibus test rejects."""
    x = scores(s, d)
    return x.withColumn("score", F.when(F.col("model") == "m3", F.col("score") + 20).otherwise(F.col("score")))


Q["posthoc_after_omnibus"] = lambda s, d: r6(T.posthoc(posthoc_scores(s, d), ["policy"], "dt", "model", "score").select("policy", "a", "b", "n", "p", "p_holm"))
POSTH = (FRIED + PAIRS[len(SCORES):].replace("round(x.score - y.score, 9)", "x.score - y.score")).replace(
    "/ (count(*) * 1e2) AS score FROM events GROUP BY 1, 2, 3)", "/ (count(*) * 1e2) + CASE WHEN user_id % 4 = 3 THEN 20 ELSE 0 END AS score FROM events GROUP BY 1, 2, 3, user_id % 4)")
O["posthoc_after_omnibus"] = f"""WITH {POSTH}{HOLM}, ok AS (SELECT policy FROM fr WHERE {CHI2.format(x='chi2', d='(k - 1e0)')} < 0.05)
SELECT policy, a, b, n, round(p, 6) AS p, round(least(max(h) OVER (PARTITION BY policy ORDER BY p, a, b ROWS UNBOUNDED PRECEDING), 1e0), 6) AS p_holm FROM ho WHERE policy IN (SELECT policy FROM ok)"""

Q["score_descriptives"] = lambda s, d: r6(T.descriptives(scores(s, d), ["policy", "model"], ["dt"], "score"))
O["score_descriptives"] = f"""WITH {SCORES}, g AS (SELECT *, score AS s, 1 AS c, row_number() OVER (PARTITION BY policy, model ORDER BY substr(md5(CAST(dt AS VARCHAR)), 1, 2), dt) - 1 AS idx FROM sc),
sz AS (SELECT policy, model, count(*) AS clusters FROM g GROUP BY 1, 2), {draws_sql('d', 'sz', 'clusters', 'clusters', 2000)},
v AS (SELECT d.policy, d.model, rep, avg(s) AS v FROM d JOIN g ON d.policy = g.policy AND d.model = g.model AND d.draw = g.idx GROUP BY 1, 2, 3),
q AS (SELECT policy, model, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM v GROUP BY 1, 2)
SELECT policy, model, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd, round(median(score), 6) AS median, round(any_value(lo), 6) AS ci95_lower, round(any_value(hi), 6) AS ci95_upper
FROM sc JOIN q USING (policy, model) GROUP BY policy, model"""


def logit_rows(s, d):
    c = outcome_calls(s, d).withColumn("band", F.concat(F.lit("b"), F.col("doc_id") % 3))
    return T.varying_cells(c, "lang", "quality")


Q["clustered_logit"] = lambda s, d: r6(T.clustered_logit(logit_rows(s, d), "quality", ["lang", "band"], "source"))
Q["varying_cells"] = lambda s, d: T.varying_cells(outcome_calls(s, d), "source", "toxic").groupBy("source").agg(F.count("*").alias("n"))
O["varying_cells"] = "SELECT source, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1 HAVING min(toxic) < max(toxic)"
Q["p_values"] = lambda s, d: r6(TB.table(s, d, "events").select(
    "event_id", X.two_sided_p(F.col("value") / 100.0).alias("p_normal"), X.chi2_upper_p(F.col("value") / 10.0, F.lit(3.0)).alias("p_chi2")))
O["p_values"] = f"SELECT event_id, {S.R(p_of('(value / 1e2)'), 'p_normal')}, {S.R(CHI2.format(x='(value / 1e1)', d='3e0'), 'p_chi2')} FROM events"
