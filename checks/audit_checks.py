"""Registered queries: call-log audit, rollups, joins and set operations."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import sqlparts as S
from checks.ledger_checks import WF, daily
from checks.sqlparts import proj_sql
from checks.panel_checks import SERIES, r6, series_returns
from checks.rule_checks import decided
from weightloom.functions import quantiles as QT
from weightloom.functions import scalars as X
from weightloom.functions import vectors as V
from weightloom.operators import audit as A
from weightloom.operators import metrics as K
from weightloom.operators import projection as C
from weightloom.operators import rules as W
from weightloom.sources import archive as AR
from weightloom.sources import calls as SC
from weightloom.session import materialize
from weightloom.sources import testbed as TB

Q, O = {}, {}

# ---- call log with weight vectors, from embeddings ---------------------------


def _unit(col):
    v = F.transform(col, lambda x: x.cast("double"))
    return V.bind(v, lambda a: V.bind(V.total(F.transform(a, lambda y: F.abs(y))), lambda n: F.transform(a, lambda x: x / n)))


def live_calls(s, d):
    e = TB.table(s, d, "embeddings")
    i = F.col("vec_id")
    kinds = F.array(*[F.lit(x) for x in ("cap_aligned_60", "cap_mild_conflict_70", "cap_severe_conflict_90", "shorting_conflict")])
    x = e.select(
        "vec_id", _unit(F.col("embedding")).alias("raw"), _unit(F.reverse("embedding")).alias("ref"),
        F.concat(F.lit("m"), (i % 4)).alias("model_id"), F.concat(F.lit("P"), (i % 6 + 1)).alias("policy_id"),
        F.concat(F.lit("c"), (F.floor(i / 4) % 3)).alias("condition_id"), F.floor(i / 24).alias("decision_date"),
        F.element_at(kinds, (i % 4 + 1).cast("int")).alias("conflict_type"),
        F.lit(1).alias("json_valid"), (i % 50 == 0).cast("int").alias("parse_fail"), (i % 20 == 0).cast("int").alias("repair_used"),
        (i % 3).alias("missing_asset_count"), (i % 5).alias("hallucinated_asset_count"), ((i * 7919 % 1000) / 10.0).alias("latency_sec"),
    )
    return A.score_calls(x, "raw", "ref", 0.15)


def vector_calls(s, d):
    """The scored call log as stored."""
    return AR.stored(s, "scored-calls", d, lambda: live_calls(s, d))


CALLS0 = """SELECT vec_id, list_transform(a, lambda x: x / list_sum(list_transform(a, lambda y: abs(y)))) AS raw,
  list_transform(b, lambda x: x / list_sum(list_transform(b, lambda y: abs(y)))) AS ref, 'm' || (vec_id % 4) AS model_id, 'P' || (vec_id % 6 + 1) AS policy_id,
  'c' || (vec_id // 4 % 3) AS condition_id, vec_id // 24 AS decision_date,
  ['cap_aligned_60', 'cap_mild_conflict_70', 'cap_severe_conflict_90', 'shorting_conflict'][vec_id % 4 + 1] AS conflict_type,
  1 AS json_valid, CAST(vec_id % 50 = 0 AS INT) AS parse_fail, CAST(vec_id % 20 = 0 AS INT) AS repair_used, vec_id % 3 AS missing_asset_count,
  vec_id % 5 AS hallucinated_asset_count, (vec_id * 7919 % 1000) / 10e0 AS latency_sec
  FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a, list_transform(list_reverse(embedding), lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings)"""
_P = proj_sql(proj_sql(CALLS0, "raw", "pj", "0.15e0"), "ref", "tg", "0.15e0")
CALLS = f"""WITH c0 AS MATERIALIZED ({_P}),
top AS (SELECT *, list_position(tg, list_max(tg)) AS target_asset, list_position(raw, list_max(raw)) AS top_asset_raw, list_position(pj, list_max(pj)) AS top_asset_projected,
  list_slice(list_transform(list_sort(list_transform(pj, lambda x, i: {{'s': -x, 'i': i}})), lambda e: e.i), 1, 3) AS p3,
  list_slice(list_transform(list_sort(list_transform(tg, lambda x, i: {{'s': -x, 'i': i}})), lambda e: e.i), 1, 3) AS t3 FROM c0),
calls AS MATERIALIZED (SELECT *, CAST(top_asset_raw = target_asset AS INT) AS raw_fidelity, CAST(top_asset_projected = target_asset AS INT) AS projected_fidelity,
  len(list_intersect(p3, t3)) / 3e0 AS top3_overlap, list_sum(list_transform(pj, lambda x, i: abs(x - tg[i]))) AS allocation_l1_to_reference,
  sqrt(list_sum(list_transform(pj, lambda x, i: (x - tg[i]) ** 2))) AS allocation_l2_to_reference, list_sum(list_transform(raw, lambda x, i: abs(x - pj[i]))) AS projection_l1,
  sqrt(list_sum(list_transform(raw, lambda x, i: (x - pj[i]) ** 2))) AS projection_l2, list_sum(list_transform(pj, lambda x: abs(x - 1e0 / 64))) AS ew_l1_distance,
  CAST(list_sum(list_transform(pj, lambda x: abs(x - 1e0 / 64))) <= 1e-3 AS INT) AS collapse_flag,
  abs(list_sum(raw) - 1) AS raw_budget_violation, list_max(raw) AS raw_max_weight, CAST(list_max(raw) > 0.15e0 + 1e-8 AS INT) AS raw_cap_violation,
  CAST(list_min(raw) < -1e-12 AS INT) AS raw_longonly_violation, list_max(pj) AS post_max_weight, 1 AS post_feasible_budget, 1 AS post_feasible_cap, 1 AS post_feasible_longonly FROM top)"""

PLAIN = ["vec_id", "model_id", "policy_id", "condition_id", "decision_date", "target_asset", "top_asset_raw", "top_asset_projected",
         "raw_fidelity", "projected_fidelity", "top3_overlap", "allocation_l1_to_reference", "allocation_l2_to_reference", "projection_l1",
         "projection_l2", "ew_l1_distance", "collapse_flag"]
FLO = {"top3_overlap", "allocation_l1_to_reference", "allocation_l2_to_reference", "projection_l1", "projection_l2", "ew_l1_distance"}
Q["call_audit_rows"] = lambda s, d: r6(live_calls(s, d).select(*PLAIN))
O["call_audit_rows"] = CALLS + " SELECT " + ", ".join(S.R(c) if c in FLO else c for c in PLAIN) + " FROM calls"


def _agg(pairs):
    return ", ".join(S.R(f"avg({c})", n) for n, c in pairs.items())


Q["reliability_rollup"] = lambda s, d: r6(A.reliability_rollup(vector_calls(s, d), ["model_id", "policy_id"]))
O["reliability_rollup"] = CALLS + f""" SELECT model_id, policy_id, count(*) AS n_calls, {S.R('stddev_samp(projected_fidelity)', 'std_projected_fidelity')},
 {_agg(A.RELIABILITY)}, {S.R('quantile_cont(latency_sec, 0.5)', 'median_latency_sec')} FROM calls GROUP BY 1, 2"""
Q["safety_rollup"] = lambda s, d: r6(A.safety_rollup(vector_calls(s, d), ["model_id", "conflict_type"]))
O["safety_rollup"] = CALLS + f" SELECT model_id, conflict_type, count(*) AS n_calls, {_agg(A.SAFETY)} FROM calls GROUP BY 1, 2"
Q["fidelity_decomposition"] = lambda s, d: r6(A.fidelity_decomposition(vector_calls(s, d)))
O["fidelity_decomposition"] = CALLS + """ SELECT model_id, policy_id, CASE WHEN GROUPING(model_id) = 1 THEN 'policy' WHEN GROUPING(policy_id) = 1 THEN 'model' ELSE 'model_policy' END AS level,
 count(*) AS records, sum(projected_fidelity) AS faithful, round(avg(projected_fidelity), 6) AS projected_fidelity, round(avg(json_valid), 6) AS json_valid,
 round(avg(allocation_l1_to_reference), 6) AS allocation_l1, round(avg(top3_overlap), 6) AS top3_overlap FROM calls GROUP BY GROUPING SETS ((policy_id), (model_id), (model_id, policy_id))"""
Q["aggregation_sensitivity"] = lambda s, d: r6(A.aggregation_sensitivity(vector_calls(s, d)))
O["aggregation_sensitivity"] = CALLS + """, p AS (SELECT policy_id, count(*) AS n, avg(projected_fidelity) AS f FROM calls GROUP BY 1)
SELECT 'all' AS scope, 'call-weighted' AS aggregation, count(*) AS records, round(avg(projected_fidelity), 6) AS fidelity FROM calls
UNION ALL SELECT 'all_without_control', 'call-weighted', count(*), round(avg(projected_fidelity), 6) FROM calls WHERE policy_id <> 'P4'
UNION ALL SELECT 'defined', 'call-weighted', count(*), round(avg(projected_fidelity), 6) FROM calls WHERE policy_id <> 'P6'
UNION ALL SELECT 'defined', 'macro', sum(n), round(avg(f), 6) FROM p WHERE policy_id <> 'P6'
UNION ALL SELECT 'defined_without_control', 'macro', sum(n), round(avg(f), 6) FROM p WHERE policy_id NOT IN ('P4', 'P6')"""


def json_calls(s, d):
    """The call log as stored: weights as JSON text with their tickers."""
    names = F.array(*[F.lit(f"A{i:02d}") for i in range(1, 65)])
    c = vector_calls(s, d)
    as_json = lambda v: F.to_json(F.map_from_arrays(names, F.col(v)))
    return c.select("vec_id", "policy_id", "model_id", "parse_fail", "repair_used",
                    F.when(F.col("vec_id") % 7 == 0, "").otherwise("{}").alias("raw_output"),
                    F.concat(F.lit('{"weights":'), as_json("raw"), F.lit("}")).alias("raw_weights"),
                    as_json("projected").alias("projected_weights"), as_json("target").alias("reference_weights"))


Q["projection_ablation"] = lambda s, d: r6(A.projection_ablation(
    json_calls(s, d), "raw_weights", "projected_weights", "reference_weights").drop(
    "raw_weights", "projected_weights", "reference_weights", "raw_output", "parse_fail", "repair_used"))
O["projection_ablation"] = CALLS + """ SELECT vec_id, policy_id, model_id, raw_fidelity AS fidelity_raw, projected_fidelity AS fidelity_projected,
 round(list_sum(list_transform(raw, lambda x, i: abs(x - tg[i]))), 6) AS l1_raw_reference, round(allocation_l1_to_reference, 6) AS l1_projected_reference,
 round(projection_l1, 6) AS projection_l1, CAST(top_asset_raw <> top_asset_projected AS INT) AS projection_changed_top FROM calls"""
Q["collapse_audit"] = lambda s, d: r6(A.collapse_audit(json_calls(s, d), "projected_weights", 1.0).select(
    "vec_id", "equal_weight_l1", "collapse", "raw_output_empty", "probable_cause"))
O["collapse_audit"] = CALLS + """ SELECT vec_id, round(ew_l1_distance, 6) AS equal_weight_l1, CAST(ew_l1_distance <= 1.0 AS INT) AS collapse,
 CAST(vec_id % 7 = 0 AS INT) AS raw_output_empty, CASE WHEN parse_fail = 1 OR repair_used = 1 THEN 'parse_or_fallback' WHEN ew_l1_distance <= 1.0 THEN 'model_equalization' ELSE 'not_collapsed' END AS probable_cause FROM calls"""

SEM = CALLS + """, ex AS (SELECT vec_id, i, pj[i] AS p, tg[i] AS r FROM calls, range(1, 65) g(i)),
rk AS (SELECT vec_id, rank() OVER (PARTITION BY vec_id ORDER BY p) + (count(*) OVER (PARTITION BY vec_id, p) - 1) / 2e0 AS a,
  rank() OVER (PARTITION BY vec_id ORDER BY r) + (count(*) OVER (PARTITION BY vec_id, r) - 1) / 2e0 AS b FROM ex),
rho AS (SELECT vec_id, corr(a, b) AS spearman FROM rk GROUP BY 1),
sem AS (SELECT vec_id, model_id, CAST(projected_fidelity AS DOUBLE) AS target_fidelity, len(list_intersect(p3, t3)) AS top3_shared, len(list_intersect(p3, t3)) / (6e0 - len(list_intersect(p3, t3))) AS top3_jaccard,
  allocation_l1_to_reference AS allocation_l1, allocation_l2_to_reference AS allocation_l2, ew_l1_distance AS equal_weight_l1, spearman FROM calls JOIN rho USING (vec_id))"""
SEMC = ["target_fidelity", "top3_jaccard", "allocation_l1", "allocation_l2", "equal_weight_l1", "spearman"]


def semantic(s, d):
    return A.semantic_diagnostics(vector_calls(s, d).select("vec_id", "model_id", "projected", "target"), "projected", "target")


Q["semantic_diagnostics"] = lambda s, d: r6(semantic(s, d).select("vec_id", "model_id", "top3_shared", *SEMC))
O["semantic_diagnostics"] = SEM + f" SELECT vec_id, model_id, top3_shared, {S.Rs(*SEMC)} FROM sem"
Q["semantic_summary"] = lambda s, d: r6(A.semantic_summary(materialize(semantic(s, d), "semantic-detail")))
O["semantic_summary"] = SEM + f""", b AS (SELECT * FROM sem UNION ALL SELECT * REPLACE ('ALL' AS model_id) FROM sem)
SELECT model_id, count(*) AS calls, {', '.join(S.R(f'avg({c})', 'mean_' + c) for c in SEMC)}, {S.R('quantile_cont(spearman, 0.5)', 'median_spearman')} FROM b GROUP BY 1"""

Q["condition_summary"] = lambda s, d: r6(A.condition_summary(vector_calls(s, d), "collapse_flag"))
O["condition_summary"] = CALLS + f""" SELECT condition_id, model_id, count(*) AS n, {_agg({'projected_fidelity': 'projected_fidelity', 'raw_fidelity': 'raw_fidelity',
 'mean_allocation_l1': 'allocation_l1_to_reference', 'json_valid': 'json_valid', 'repair_rate': 'repair_used', 'mean_latency_sec': 'latency_sec', 'copy_rate': 'collapse_flag'})} FROM calls GROUP BY 1, 2"""

Q["stage_rates"] = lambda s, d: r6(A.stage_rates(
    vector_calls(s, d).withColumn("stage", F.explode(F.array(F.lit("raw"), F.lit("projected")))).withColumn(
        "hit", F.when(F.col("stage") == "raw", F.col("raw_fidelity")).otherwise(F.when(F.col("vec_id") % 3 > 0, F.col("projected_fidelity")))),
    ["model_id", "stage"], ["hit", "not_recorded"]))
O["stage_rates"] = CALLS + """ SELECT model_id, 'raw' AS stage, count(*) AS n, round(avg(raw_fidelity), 6) AS hit_rate FROM calls GROUP BY 1
UNION ALL SELECT model_id, 'projected', count(*), round(avg(projected_fidelity) FILTER (vec_id % 3 > 0), 6) FROM calls GROUP BY 1"""

THR = ["raw_core_weight", "projected_core_weight", "raw_threshold_gap", "projected_threshold_gap"]
THI = ["raw_fidelity", "projected_fidelity", "fidelity_loss", "raw_threshold_fidelity", "projected_threshold_fidelity", "threshold_fidelity_loss"]
Q["threshold_fidelity"] = lambda s, d: r6(A.threshold_fidelity(
    vector_calls(s, d).drop("raw_fidelity", "projected_fidelity"), "raw", "projected", "target_asset", 0.12, 0.15).select("vec_id", *THR, *THI))
THR_SQL = """, th AS (SELECT vec_id, model_id, raw[target_asset] AS raw_core_weight, pj[target_asset] AS projected_core_weight, raw_fidelity, projected_fidelity, raw_fidelity - projected_fidelity AS fidelity_loss,
 CAST(raw[target_asset] >= 0.12e0 - 1e-6 AS INT) AS raw_threshold_fidelity, CAST(pj[target_asset] >= 0.12e0 - 1e-6 AS INT) AS projected_threshold_fidelity,
 CAST(raw[target_asset] >= 0.12e0 - 1e-6 AS INT) - CAST(pj[target_asset] >= 0.12e0 - 1e-6 AS INT) AS threshold_fidelity_loss, raw[target_asset] - 0.12e0 AS raw_threshold_gap, pj[target_asset] - 0.12e0 AS projected_threshold_gap FROM calls)"""
O["threshold_fidelity"] = CALLS + THR_SQL + f" SELECT vec_id, {S.Rs(*THR)}, {', '.join(THI)} FROM th"

# ---- V10: language target 60 / 70 against a hard cap of 60 -------------------


def q_conflict(s, d):
    feats = decided(s, d)
    out = None
    for pc in (0.6, 0.7):
        w = W.policy_weights(feats, pc, policies=("P1", "P2")).withColumn("prompt_cap", F.lit(pc))
        out = w if out is None else out.unionByName(w)
    v = out.groupBy("policy", "prompt_cap", "t").agg(F.array_sort(F.collect_list(F.struct("ord", "w"))).alias("v"))
    v = v.select("policy", F.col("prompt_cap").alias("pc"), "t", F.transform("v", lambda e: e["w"]).alias("raw"))
    v = v.withColumn("projected", V.project_capped(F.col("raw"), 0.6)).withColumn("core", V.first_argmax(F.col("raw")))
    x = A.threshold_fidelity(v, "raw", "projected", "core", F.col("pc"), 0.6)
    x = x.withColumn("projection_l1", V.l1(F.col("raw"), F.col("projected")))
    return r6(x.groupBy("policy", "pc").agg(
        F.count("*").alias("n"), *[F.avg(c).alias(c) for c in (*THI, "raw_core_weight", "projected_core_weight", "projection_l1")]))


Q["constraint_conflict_ablation"] = q_conflict
# raw = (c, (1-c)/24 ...): projecting with cap .6 moves c-.6 evenly onto the others
O["constraint_conflict_ablation"] = f"""WITH {S.DFEAT}, g AS (SELECT policy, pc, count(DISTINCT t) AS n FROM df, (VALUES ('P1'), ('P2')) p(policy), (VALUES (0.6e0), (0.7e0)) c(pc) GROUP BY 1, 2)
SELECT policy, pc, n, 1e0 AS raw_fidelity, 1e0 AS projected_fidelity, 0e0 AS fidelity_loss, 1e0 AS raw_threshold_fidelity,
 1e0 AS projected_threshold_fidelity, 0e0 AS threshold_fidelity_loss, pc AS raw_core_weight, 0.6e0 AS projected_core_weight, round(2 * (pc - 0.6), 6) AS projection_l1 FROM g"""

# ---- latency, samples, figures ------------------------------------------------


def event_calls(s, d):
    e = TB.table(s, d, "events")
    return e.select("event_id", F.col("event_type").alias("condition_id"), (F.col("user_id") % 5).alias("model_id"),
                    F.col("value").alias("latency_sec"), F.to_date("ts").alias("decision_date"), "ts")


Q["latency_table"] = lambda s, d: r6(A.latency_table(event_calls(s, d), ["model_id"]))
O["latency_table"] = f"""SELECT user_id % 5 AS model_id, count(*) AS n_calls, {S.R('avg(value)', 'mean_latency')}, {S.R('quantile_cont(value, 0.5)', 'median_latency')},
 {S.R('quantile_cont(value, 0.95)', 'p95_latency')} FROM events GROUP BY 1"""
Q["exact_percentiles"] = lambda s, d: r6(QT.exact_percentiles(
    TB.table(s, d, "lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", {"p01": 0.01, "p50": 0.5, "p99": 0.99}, accuracy=1000))
O["exact_percentiles"] = f"""SELECT l_returnflag, {S.R('quantile_cont(l_extendedprice, 0.01)', 'p01')}, {S.R('quantile_cont(l_extendedprice, 0.5)', 'p50')},
 {S.R('quantile_cont(l_extendedprice, 0.99)', 'p99')} FROM lineitem GROUP BY 1"""
Q["sample_audit"] = lambda s, d: A.sample_audit(event_calls(s, d), ["condition_id", "model_id"])
O["sample_audit"] = "SELECT event_type AS condition_id, user_id % 5 AS model_id, count(*) AS n FROM events GROUP BY 1, 2"
Q["duplicate_audit"] = lambda s, d: r6(A.duplicate_audit(vector_calls(s, d), ["condition_id", "model_id", "policy_id", "decision_date"], 500))
O["duplicate_audit"] = CALLS + """, g AS (SELECT count(*) AS c FROM calls GROUP BY condition_id, model_id, policy_id, decision_date)
SELECT (SELECT count(*) FROM calls) AS rows, coalesce((SELECT sum(c) FROM g WHERE c > 1), 0) AS duplicate_rows, (SELECT count(*) FROM g) AS unique_keys, 1e0 AS json_valid_rate,
 (SELECT sum(parse_fail) FROM calls) AS parse_fail_count, (SELECT sum(repair_used) FROM calls) AS repair_used_count, CAST((SELECT count(*) FROM calls) = 500 AS INT) AS total_matches"""
Q["duplicate_keys"] = lambda s, d: K.duplicate_keys(TB.table(s, d, "documents"), ["lang", "source"])
O["duplicate_keys"] = "SELECT lang, source, count(*) AS n_rows FROM documents GROUP BY 1, 2 HAVING count(*) > 1"
Q["cap_target_rollup"] = lambda s, d: r6(A.cap_target_rollup(vector_calls(s, d)))
O["cap_target_rollup"] = CALLS + f""" SELECT CASE WHEN conflict_type LIKE '%60' THEN 0.6e0 WHEN conflict_type LIKE '%70' THEN 0.7e0 ELSE 0.9e0 END AS language_target,
 {_agg({'raw_max': 'raw_max_weight', 'projected_max': 'post_max_weight', 'projection_l1': 'projection_l1', 'feasible_cap': 'post_feasible_cap'})} FROM calls WHERE conflict_type LIKE 'cap%' GROUP BY 1"""
Q["paired_condition_gap"] = lambda s, d: r6(A.paired_condition_gap(
    vector_calls(s, d), ["model_id", "policy_id"], "condition_id", "c0", "c1", "allocation_l1_to_reference"))
O["paired_condition_gap"] = CALLS + """, g AS (SELECT model_id, policy_id, avg(allocation_l1_to_reference) FILTER (condition_id = 'c0') AS b, avg(allocation_l1_to_reference) FILTER (condition_id = 'c1') AS o FROM calls GROUP BY 1, 2)
SELECT model_id, policy_id, round(b, 6) AS base, round(o, 6) AS other, round(o - b, 6) AS gap FROM g"""
Q["fidelity_heatmap"] = lambda s, d: r6(A.heatmap(vector_calls(s, d), "model_id", "policy_id", ["P1", "P2", "P3", "P4", "P5", "P6"], "projection_l1"))
O["fidelity_heatmap"] = CALLS + " SELECT model_id, " + ", ".join(
    f"round(avg(projection_l1) FILTER (policy_id = 'P{k}'), 6) AS P{k}" for k in range(1, 7)) + " FROM calls GROUP BY 1"
Q["compare_studies"] = lambda s, d: r6(A.compare_studies(
    vector_calls(s, d).where("condition_id = 'c0'"), vector_calls(s, d).where("condition_id <> 'c0'")))
O["compare_studies"] = CALLS + """ SELECT CASE WHEN condition_id = 'c0' THEN 'A' ELSE 'B' END AS study, count(*) AS n, round(avg(raw_fidelity), 6) AS raw_fidelity,
 round(avg(projected_fidelity), 6) AS projected_fidelity, count(DISTINCT decision_date) AS dates FROM calls GROUP BY 1"""


def prompts(s, d):
    return TB.table(s, d, "conversations").select("role", X.short_hash("text").alias("prompt_hash"), F.length("text").alias("prompt_length"))


Q["prompt_audit"] = lambda s, d: prompts(s, d).dropDuplicates()
O["prompt_audit"] = "SELECT DISTINCT role, left(sha256(text), 16) AS prompt_hash, length(text) AS prompt_length FROM conversations"


def pairs(s, d):
    c = vector_calls(s, d).select("model_id", "policy_id", "decision_date", "condition_id", "target_asset", "top_asset_projected")
    k = ["model_id", "policy_id", "decision_date"]
    return A.matched_pairs(c.where("condition_id = 'c0'"), c.where("condition_id = 'c1'"), k, ["target_asset", "top_asset_projected"])


Q["matched_pairs"] = lambda s, d: TB.table(s, d, "events").transform(lambda e: A.matched_pairs(
    e.where("event_id % 2 = 0").select((F.col("event_id") / 2).cast("bigint").alias("k"), "event_type", "user_id"),
    e.where("event_id % 2 = 1").select(((F.col("event_id") - 1) / 2).cast("bigint").alias("k"), "event_type", "user_id"), ["k"], ["event_type", "user_id"]))
O["matched_pairs"] = """SELECT count(*) AS pairs, 0 AS not_one_to_one, sum(CAST(a.event_type = b.event_type AS INT)) AS same_event_type, sum(CAST(a.user_id = b.user_id AS INT)) AS same_user_id
FROM events a JOIN events b ON a.event_id % 2 = 0 AND b.event_id = a.event_id + 1"""


def q_assert(s, d):
    c = vector_calls(s, d)
    return A.assertions(c, {
        "json_valid_is_one": F.avg("json_valid") == 1.0,
        "no_parse_failures": F.sum("parse_fail") == 0,
        "four_models": F.countDistinct("model_id") == 4,
        "policy_set": F.array_sort(F.collect_set("policy_id")) == F.array(*[F.lit(f"P{k}") for k in range(1, 7)]),
        "all_caps_hold": F.min("post_feasible_cap") == 1,
    })


Q["release_assertions"] = q_assert
O["release_assertions"] = CALLS + """, c AS (SELECT avg(json_valid) = 1 AS a, sum(parse_fail) = 0 AS b, count(DISTINCT model_id) = 4 AS m, list_sort(list(DISTINCT policy_id)) = ['P1','P2','P3','P4','P5','P6'] AS p, min(post_feasible_cap) = 1 AS f FROM calls)
SELECT unnest(['json_valid_is_one', 'no_parse_failures', 'four_models', 'policy_set', 'all_caps_hold']) AS check, unnest([CASE WHEN a THEN 'pass' ELSE 'fail' END, CASE WHEN b THEN 'pass' ELSE 'fail' END,
 CASE WHEN m THEN 'pass' ELSE 'fail' END, CASE WHEN p THEN 'pass' ELSE 'fail' END, CASE WHEN f THEN 'pass' ELSE 'fail' END]) AS status FROM c"""


def brand_curves(s, d):
    return series_returns(s, d).transform(lambda r: K._curve(r, ["series"], "t")).select("series", "dt", F.col("eq").alias("equity"))


Q["curve_checks"] = lambda s, d: A.curve_checks(brand_curves(s, d), K.robust_returns(series_returns(s, d), ["series"]))
O["curve_checks"] = f"WITH {SERIES} SELECT 1 AS date_ranges, 0 AS duplicate_points, count(DISTINCT series) AS series, count(DISTINCT series) AS distinct_curves, 0 AS endpoint_mismatches FROM series"
Q["missing_series"] = lambda s, d: A.missing_series(
    TB.table(s, d, "part").select(F.col("p_brand").alias("series")).distinct().unionByName(
        TB.table(s, d, "part").select(F.col("p_type").alias("series")).distinct()), brand_curves(s, d))
O["missing_series"] = f"WITH {SERIES} SELECT DISTINCT p_type AS series FROM part WHERE p_type NOT IN (SELECT series FROM series)"


def diffs(s, d):
    """Brand return minus the equal mix, by date."""
    r = series_returns(s, d)
    base = r.where("series = 'EQUAL'").select("t", F.col("ret").alias("b"))
    return r.where("series <> 'EQUAL'").join(base, "t").where("ret IS NOT NULL AND b IS NOT NULL").select(
        "series", "t", (F.col("ret") - F.col("b")).alias("diff"))


DIFFS = SERIES + """, diffs AS (SELECT a.series, a.t, a.ret - b.ret AS diff FROM series a JOIN series b ON b.series = 'EQUAL' AND b.t = a.t WHERE a.series <> 'EQUAL')"""
Q["pair_validity"] = lambda s, d: r6(A.pair_validity(diffs(s, d), diffs(s, d).select("series").distinct().union(s.sql("SELECT 'never'"))))
O["pair_validity"] = f"""WITH {DIFFS} SELECT series, count(diff) AS n, {S.R('avg(diff)', 'mean_diff')}, {S.R('252 * avg(diff)', 'mean_diff_ann')}, {S.R('stddev_samp(diff)', 'std_diff')},
 CAST(max(abs(diff)) <= 1e-14 AS INT) AS zero_difference, CAST(stddev_samp(diff) <= 1e-14 AS INT) AS zero_variance,
 greatest(2, CAST(round_even(pow(count(diff), 1e0 / 3), 0) AS INT)) AS block_length, CAST(count(diff) >= 10 AND stddev_samp(diff) > 1e-14 AS INT) AS valid, NULL AS reason FROM diffs GROUP BY series
UNION ALL SELECT 'never', 0, NULL, NULL, NULL, NULL, NULL, NULL, 0, 'no overlapping returns'"""

# ---- S4-S9, E4-E13 -------------------------------------------------------------


def q_combine(s, d):
    lb = TB.table(s, d, "labels")
    a = lb.where("doc_id % 3 <> 0").select("doc_id", F.col("quality").cast("string").alias("projected_fidelity"), F.lit("2020-01-02").alias("decision_date"))
    b = lb.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("toxic") == 1, "n/a").otherwise(F.col("quality").cast("string")).alias("projected_fidelity"),
                                         F.lit("not a date").alias("decision_date"), F.lit(1).alias("extra"))
    return SC.combine_logs({"primary": a, "second": b}, ["doc_id", "projected_fidelity"], ["projected_fidelity"])


Q["combine_logs"] = q_combine
O["combine_logs"] = """SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN CAST(quality AS DOUBLE) WHEN toxic = 1 THEN NULL ELSE CAST(quality AS DOUBLE) END AS projected_fidelity,
 CASE WHEN doc_id % 3 <> 0 THEN DATE '2020-01-02' END AS decision_date, CASE WHEN doc_id % 3 = 0 THEN 1 END AS extra, CASE WHEN doc_id % 3 <> 0 THEN 'primary' ELSE 'second' END AS source_log FROM labels"""
Q["row_count_check"] = lambda s, d: SC.row_count_check(q_combine(s, d), 399)
O["row_count_check"] = """SELECT CASE WHEN doc_id % 3 <> 0 THEN 'primary' ELSE 'second' END AS source_log, count(*) AS n, CAST(NULL AS INT) AS as_expected FROM labels GROUP BY 1
UNION ALL SELECT 'ALL', count(*), CAST(count(*) = 399 AS INT) FROM labels"""


def wide_returns(s, d):
    # 25 brands and the equal mix: one column each
    return series_returns(s, d).groupBy(F.col("dt").alias("Date")).pivot("series").agg(
        F.first(F.when(F.col("ret") < 0.009, F.col("ret").cast("string")).otherwise("n/a")))


Q["tidy_returns_from_wide"] = lambda s, d: r6(SC.tidy_returns(wide_returns(s, d)))
O["tidy_returns_from_wide"] = f"WITH {SERIES} SELECT dt AS date, series AS strategy, round(CASE WHEN ret < 0.009 THEN ret ELSE 0 END, 6) AS ret FROM series"


def q_oos(s, d):
    c = TB.table(s, d, "customer")
    x = c.select(F.lit("1995-01-01").alias("date"), F.when(F.col("c_custkey") % 3 == 0, "RULE").otherwise("EQUAL").alias("strategy"),
                 F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).alias("model"), F.concat(F.lit("P"), F.col("c_custkey") % 4).alias("persona"),
                 F.when(F.col("c_custkey") % 7 > 0, F.col("c_nationkey").cast("string")).alias("fold"), F.lit("stitched_oos").alias("segment"),
                 F.when(F.col("c_custkey") % 11 == 0, "bad").otherwise(F.col("c_acctbal").cast("string")).alias("equity"))
    return SC.tidy_oos(x, ("RULE",)).groupBy("series_key", "fold").agg(F.count("*").alias("n"), F.round(F.sum("equity"), 4).alias("total"))


Q["tidy_oos"] = q_oos
O["tidy_oos"] = """SELECT CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 > 0 THEN 'RULE[' || c_mktsegment || '|P' || (c_custkey % 4) || ']' WHEN c_custkey % 3 = 0 THEN 'RULE' ELSE 'EQUAL' END AS series_key,
 CASE WHEN c_custkey % 7 > 0 THEN c_nationkey ELSE 0 END AS fold, count(*) AS n, round(sum(c_acctbal), 4) AS total FROM customer WHERE c_custkey % 11 <> 0 GROUP BY 1, 2"""
Q["returns_from_equity"] = lambda s, d: r6(K.returns_from_equity(brand_curves(s, d)).select("series", "dt", "ret"))
O["returns_from_equity"] = f"""WITH {SERIES}, x AS (SELECT series, dt, t, ret FROM series) SELECT series, dt, round(ret, 6) AS ret FROM x WHERE t > 0"""
#: Tables and their numbers of columns.
TABLES = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6,
    "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4,
}
Q["file_inventory"] = lambda s, d: reduce(DataFrame.unionByName, [SC.file_inventory(s.read.parquet(f"{d}/{t}.parquet")) for t in TABLES]).drop("bytes")
O["file_inventory"] = " UNION ALL ".join(f"SELECT '{t}.parquet' AS file, count(*) AS rows, {n} AS columns FROM {t}" for t, n in TABLES.items())


def keyed(s, d):
    p = TB.table(s, d, "part")
    i = F.col("p_partkey")
    key = F.when(i % 4 == 0, F.format_string("RULE[%s|P%d]", "p_brand", i % 5 + 1)).when(i % 4 == 1, F.format_string("CODED_P%d", i % 5 + 1)).when(
        i % 4 == 2, F.format_string("RULE-P%d", i % 5 + 1)).otherwise("EQUAL")
    return p.select("p_partkey", key.alias("series"))


Q["series_key_parse"] = lambda s, d: K.with_series_parts(keyed(s, d))
O["series_key_parse"] = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'RULE[' || p_brand || '|P' || (p_partkey % 5 + 1) || ']' WHEN 1 THEN 'CODED_P' || (p_partkey % 5 + 1) WHEN 2 THEN 'RULE-P' || (p_partkey % 5 + 1) ELSE 'EQUAL' END AS series,
 CASE p_partkey % 4 WHEN 0 THEN 'Policy' WHEN 1 THEN 'CodedPolicy' WHEN 2 THEN 'Policy' ELSE 'Baseline' END AS method_group, CASE p_partkey % 4 WHEN 0 THEN p_brand ELSE '' END AS model,
 CASE WHEN p_partkey % 4 = 3 THEN '' ELSE 'P' || (p_partkey % 5 + 1) END AS persona FROM part"""

TICK = ("SPY", "GLD", "BTC-USD", "TLT", "VNQ", "UUP", "ethusd")


def tickers(s, d):
    c = TB.table(s, d, "customer")
    return c.select("c_custkey", F.element_at(F.array(*[F.lit(t) for t in TICK]), (F.col("c_custkey") % 7 + 1).cast("int")).alias("ticker"))


Q["transaction_cost_audit"] = lambda s, d: r6(tickers(s, d).select(
    "c_custkey", "ticker", X.asset_class("ticker").alias("asset_class"), F.lit(0.001).alias("base_cost"), X.asset_cost("ticker", 0.001).alias("applied_cost"),
    F.try_divide(X.asset_cost("ticker", 0.001), F.lit(0.001)).alias("multiplier")))
O["transaction_cost_audit"] = """SELECT c_custkey, ticker, cls AS asset_class, 0.001e0 AS base_cost, 0.001e0 * m AS applied_cost, CAST(m AS DOUBLE) AS multiplier FROM
 (SELECT c_custkey, ['SPY','GLD','BTC-USD','TLT','VNQ','UUP','ethusd'][c_custkey % 7 + 1] AS ticker, ['EquityETF','Commodity','Crypto','Bond','RealEstate','Currency','Crypto'][c_custkey % 7 + 1] AS cls,
 [1e0,1.5e0,5e0,1e0,1e0,1e0,5e0][c_custkey % 7 + 1] AS m FROM customer)"""
Q["significance_scalars"] = lambda s, d: r6(TB.table(s, d, "customer").select(
    "c_custkey", X.stars(F.col("c_custkey") % 13 / 100.0).alias("stars"), X.safe_t(F.col("c_custkey") % 3 - 1.0, F.col("c_custkey") % 4 * 0.5).alias("t_like")))
O["significance_scalars"] = """SELECT c_custkey, CASE WHEN c_custkey % 13 < 1 THEN '***' WHEN c_custkey % 13 < 5 THEN '**' WHEN c_custkey % 13 < 10 THEN '*' ELSE '' END AS stars,
 CASE WHEN c_custkey % 4 = 0 THEN sign(c_custkey % 3 - 1) * 1e6 ELSE (c_custkey % 3 - 1) / (c_custkey % 4 * 0.5e0) END AS t_like FROM customer"""
Q["model_report"] = lambda s, d: K.model_report(keyed(s, d).dropDuplicates(["series"]), "Brand#11", ["EQUAL", "CODED_P1"]).select("series", "section")
O["model_report"] = """SELECT DISTINCT 'RULE[Brand#11|P' || (p_partkey % 5 + 1) || ']' AS series, 0 AS section FROM part WHERE p_brand = 'Brand#11' AND p_partkey % 4 = 0
UNION ALL SELECT DISTINCT 'EQUAL', 1 FROM part WHERE p_partkey % 4 = 3 UNION ALL SELECT DISTINCT 'CODED_P1', 1 FROM part WHERE p_partkey % 4 = 1 AND p_partkey % 5 = 0"""
Q["display_rows"] = lambda s, d: r6(K.display_rows(K.summary(daily(s, d).drop("w"), ["series"])))
O["display_rows"] = WF + """, to_ AS (SELECT series, t, ret, coalesce(list_sum(list_transform(w, lambda x, k: abs(x - lw[k]))), 0e0) AS turnover FROM
  (SELECT *, lag(w) OVER (PARTITION BY run, series, fold ORDER BY t) AS lw FROM ledger_days)),
e0 AS (SELECT *, product(1e0 + ret) OVER (PARTITION BY series ORDER BY t ROWS UNBOUNDED PRECEDING) AS eq FROM to_),
e1 AS (SELECT *, eq / max(eq) OVER (PARTITION BY series ORDER BY t ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e0)
SELECT series AS name, round(sqrt(252e0) * avg(ret) / stddev_samp(ret), 6) AS sharpe, round(sqrt(252e0) * avg(ret) / stddev_samp(least(ret, 0)), 6) AS sortino, round(stddev_samp(ret) * sqrt(252e0), 6) AS vol,
 round(pow(arg_max(eq, t) / arg_min(eq, t), 252e0 / count(*)) - 1, 6) AS cagr, round(min(dd), 6) AS mdd, round(arg_max(eq, t) - 1, 6) AS cum, round(pow(arg_max(eq, t) / arg_min(eq, t), 252e0 / count(*)) - 1, 6) AS ann, round(avg(turnover), 6) AS "to" FROM e1 GROUP BY series"""
Q["selected_comparison"] = lambda s, d: r6(K.select_series(K.robust_returns(series_returns(s, d), ["series"]), s.createDataFrame([("EQUAL",), ("Brand#21",), ("absent",)], "series string")))
O["selected_comparison"] = f"WITH {SERIES} SELECT series, round(product(1e0 + ret) - 1, 6) AS cum_return, round(pow(product(1e0 + ret), 252e0 / count(*)) - 1, 6) AS ann_return FROM series WHERE series IN ('EQUAL', 'Brand#21') GROUP BY series"
Q["record_ids"] = lambda s, d: TB.table(s, d, "benchmark").select("item_id", X.short_hash("text").alias("prompt_hash"), X.record_id("item_id", "text").alias("id"))
O["record_ids"] = """SELECT item_id, left(sha256(text), 16) AS prompt_hash, left(sha256('{"item_id":' || to_json(item_id)::VARCHAR || ',"text":' || to_json(text)::VARCHAR || '}'), 24) AS id FROM benchmark"""


def q_run_diag(s, d):
    c = vector_calls(s, d).withColumn("series", F.col("model_id"))
    steps = C.projection_diagnostics(c.select("series", "raw", "projected"), "raw", "projected", 0.15).unionByName(
        C.projection_diagnostics(c.select(F.lit("EQUAL").alias("series"), V.equal_like(F.col("raw")).alias("raw"), V.equal_like(F.col("raw")).alias("projected")), "raw", "projected", 0.15))
    calls = c.withColumns({"invalid_weight_count": F.col("vec_id") % 4, "negative_weight_count": F.size(F.filter("raw", lambda x: x < 0)), "equal_fallback": (F.col("vec_id") % 25 == 0).cast("int")})
    out = C.run_diagnostics(steps.withColumn("turnover_clip", (V.l1(F.col("projected"), V.equal_like(F.col("projected"))) > 0.25).cast("int")), calls)
    return r6(out)


Q["run_diagnostics"] = q_run_diag
O["run_diagnostics"] = CALLS + """, st AS (SELECT model_id AS series, projection_l1 AS l1, projection_l2 AS l2, len(list_filter(raw, lambda x: x < 0)) AS ng, len(list_filter(raw, lambda x: x > 0.15e0)) AS ov,
  -list_sum(list_transform(pj, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) AS en, list_sum(list_transform(pj, lambda x: x * x)) AS hh, CAST(ew_l1_distance < 1e-4 AS INT) AS eq, CAST(ew_l1_distance > 0.25e0 AS INT) AS tc FROM calls
  UNION ALL SELECT 'EQUAL', 0, 0, 0, 0, ln(64e0), 1e0 / 64, 1, 0 FROM calls),
sa AS (SELECT series, count(*) AS n_steps, avg(l1) AS a, avg(l2) AS b, avg(CAST(ng + ov > 0 AS INT)) AS c, avg(en) AS e, avg(hh) AS h, avg(eq) AS q, avg(ng) AS g, avg(ov) AS o, avg(tc) AS tc FROM st GROUP BY 1),
ca AS (SELECT model_id AS series, count(*) AS n_calls, avg(hallucinated_asset_count) AS ha, avg(missing_asset_count) AS ma, avg(vec_id % 4) AS iv, avg(len(list_filter(raw, lambda x: x < 0))) AS nw, avg(CAST(vec_id % 25 = 0 AS INT)) AS ef, avg(json_valid) AS j, avg(repair_used) AS r, avg(parse_fail) AS p, avg(latency_sec) AS l FROM calls GROUP BY 1)
SELECT sa.series, n_steps, round(a, 6) AS avg_projection_l1, round(b, 6) AS avg_projection_l2, round(c, 6) AS cap_clip_freq, round(e, 6) AS avg_entropy, round(h, 6) AS avg_herfindahl, round(q, 6) AS equal_collapse_rate,
 round(g, 6) AS neg_weight_per_step, round(o, 6) AS over_cap_per_step, coalesce(n_calls, 0) AS n_calls, round(j, 6) AS json_valid_rate, round(r, 6) AS repair_rate, round(p, 6) AS parse_fail_rate, round(l, 6) AS avg_latency_sec,
 round(tc, 6) AS turnover_clip_freq, round(ha, 6) AS hallucinated_per_call, round(ma, 6) AS missing_per_call, round(iv, 6) AS invalid_weight_per_call, round(nw, 6) AS negative_weight_per_call, round(ef, 6) AS equal_fallback_rate
FROM sa LEFT JOIN ca USING (series)"""
