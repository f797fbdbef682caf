"""Registered queries: text, plans, progress and streams."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import sqlparts as S
from checks.audit_checks import vector_calls
from checks.panel_checks import SERIES, cal, feats, r6, series_returns
from checks.rule_checks import POLICY_SQL, SAFE, decided, decisions
from weightloom.functions import vectors as V
from weightloom.operators import dates as D
from weightloom.operators import fewshot as FS
from weightloom.operators import rules as W
from weightloom.operators import textrules as R
from weightloom.plans import study as PL
from weightloom.plans import variants as VR
from weightloom.session import fan_out, shared_dir
from weightloom.sources import calls as SC
from weightloom.sources import testbed as TB
from weightloom.streaming import calls as ST

Q, O = {}, {}

# ---- R1-R3 ------------------------------------------------------------------------
ALLOWED = ("SPY", "QQQ", "AGG")


def responses(s, d):
    # a small file is read by few tasks, and each row takes long
    e = TB.table(s, d, "events").select("event_id", "props").repartition(fan_out(s))
    i, v = F.col("event_id") % 12, F.col("event_id") % 90 / 100.0
    raw = (
        F.when(i == 0, F.format_string('Sure.\n```json\n{"weights": {"SPY": %.2f, "qqq ": 0.10}}\n```\nDone {x}', v))
        .when(i == 1, F.format_string('{"SPY": %.2f, "QQQ": 0.40, "FAKE": 0.50}', v))
        .when(i == 2, F.format_string("weights {'SPY': 0.50, 'AGG': %.2f,}", v))
        .when(i == 3, F.format_string("{SPY: 0.70, QQQ: %.2f}", v))
        .when(i == 4, F.col("props"))
        .when(i == 6, F.format_string('{"weights": {"SPY": %.2f, "QQQ": 0.40}, "m": {"a": {"b": {"c": {"d": {}}}}}} {', v))
        .when(i == 7, F.lit("{} {}"))
        .when(i == 8, F.lit('{"weights": [1, 2], "SPY": 1}'))
        .when(i == 9, F.lit('{"weights": {}}'))
        .when(i == 10, F.lit('{"FAKE": 1}'))
        .when(i == 11, F.lit('{"SPY": 1, "open": {'))
        .otherwise(F.lit('{"SPY": -0.2, "QQQ": "abc", "AGG": 0.5, "SPY2": {"a": 1}}'))
    )
    pol = F.when(F.col("event_id") % 35 == 0, "P4").when(F.col("event_id") % 35 == 1, "P5").otherwise("P1")
    return e.select("event_id", raw.alias("raw_output"), pol.alias("policy_id"))


def cleaned(s, d):
    x = R.extract_weights(responses(s, d), "raw_output")
    return R.clean_weights(x, F.array(*[F.lit(a) for a in ALLOWED]), "policy_id")


Q["response_weights"] = lambda s, d: r6(cleaned(s, d).select(
    "event_id", "json_valid", "repair_used", "unknown_count", "missing_count", "invalid_count", "negative_count", "equal_fallback",
    F.col("weights")[0].alias("spy"), F.col("weights")[1].alias("qqq"), F.col("weights")[2].alias("agg")))
O["response_weights"] = """WITH e AS (SELECT event_id, event_id % 12 AS i, round(event_id % 90 / 1e2, 2) AS v, CASE event_id % 35 WHEN 0 THEN 'P4' WHEN 1 THEN 'P5' ELSE 'P1' END AS pol FROM events),
g AS (SELECT *, i IN (4, 7, 8, 9, 10, 11) AS nothing, CASE i WHEN 0 THEN v WHEN 1 THEN v WHEN 6 THEN v WHEN 2 THEN 0.5e0 WHEN 3 THEN 0.7e0 WHEN 5 THEN CASE WHEN pol = 'P5' THEN 0 ELSE -0.2e0 END END AS a,
  CASE i WHEN 0 THEN 0.1e0 WHEN 1 THEN 0.4e0 WHEN 6 THEN 0.4e0 WHEN 3 THEN v WHEN 5 THEN 0e0 END AS b, CASE i WHEN 2 THEN v WHEN 5 THEN 0.5e0 END AS c FROM e),
n AS (SELECT *, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) AS s FROM g),
p AS (SELECT *, greatest(coalesce(a, 0) / nullif(s, 0), 0) AS x, greatest(coalesce(b, 0) / nullif(s, 0), 0) AS y, greatest(coalesce(c, 0) / nullif(s, 0), 0) AS z FROM n)
SELECT event_id, CAST(i NOT IN (7, 8, 11) AS INT) AS json_valid, CAST(i IN (2, 3, 4, 9, 10) AS INT) AS repair_used, CAST(i IN (1, 4, 5, 10) AS INT) AS unknown_count, CASE WHEN nothing THEN 3 WHEN i = 5 THEN 0 ELSE 1 END AS missing_count,
 CAST(i = 5 AS INT) AS invalid_count, CAST(i = 5 AS INT) AS negative_count, CAST(nothing OR pol = 'P4' AS INT) AS equal_fallback,
 round(CASE WHEN nothing OR pol = 'P4' THEN 1e0 / 3 ELSE x / (x + y + z) END, 6) AS spy, round(CASE WHEN nothing OR pol = 'P4' THEN 1e0 / 3 ELSE y / (x + y + z) END, 6) AS qqq,
 round(CASE WHEN nothing OR pol = 'P4' THEN 1e0 / 3 ELSE z / (x + y + z) END, 6) AS agg FROM p"""

Q["repair_walkthrough"] = lambda s, d: r6(R.repair_rows(
    R.extract_weights(responses(s, d), "raw_output").select("event_id", "parsed"), F.array(*[F.lit(a) for a in ALLOWED])).drop("parsed"))
# responses without a usable object give no rows; three assets, cap .6: solve the projection by trying every pattern of floored and capped entries
O["repair_walkthrough"] = """WITH e AS (SELECT event_id, event_id % 12 AS i, round(event_id % 90 / 1e2, 2) AS v FROM events),
g AS (SELECT event_id, CASE i WHEN 0 THEN [v, 0e0, 0e0] WHEN 1 THEN [v, 0.4e0, 0e0] WHEN 2 THEN [0.5e0, 0e0, v] WHEN 6 THEN [v, 0.4e0, 0e0] WHEN 3 THEN [0.7e0, v, 0e0] WHEN 5 THEN [-0.2e0, 0e0, 0.5e0] ELSE [0e0, 0e0, 0e0] END AS a FROM e WHERE i NOT IN (7, 8, 11)),
pt AS (SELECT x.k AS p, y.k AS q, z.k AS r, CAST((x.k = 1)::INT + (y.k = 1)::INT + (z.k = 1)::INT AS INT) AS free, (x.k = 2)::INT + (y.k = 2)::INT + (z.k = 2)::INT AS capped FROM range(0, 3) x(k), range(0, 3) y(k), range(0, 3) z(k)),
ta AS (SELECT event_id, a, p, q, r, ((p = 1)::INT * a[1] + (q = 1)::INT * a[2] + (r = 1)::INT * a[3] + 0.6e0 * capped - 1) / free AS tau FROM g, pt WHERE free > 0),
ca AS (SELECT DISTINCT event_id, a, round(tau, 12) AS tau FROM ta),
ev AS (SELECT event_id, a, list_transform(a, lambda x: least(greatest(x - tau, 0e0), 0.6e0)) AS w FROM ca),
ok AS (SELECT event_id, a, w FROM ev WHERE abs(list_sum(w) - 1) < 1e-9 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(list_sum(w) - 1)) = 1)
SELECT event_id, ['SPY', 'QQQ', 'AGG'][k] AS ticker, round(a[k], 6) AS raw_weight, round(w[k], 6) AS projected_weight, 1e0 AS sum_projected, round(list_max(w), 6) AS max_projected, round(list_min(w), 6) AS min_projected
FROM ok, range(1, 4) r(k)"""

Q["parse_event_props"] = lambda s, d: R.extract_weights(TB.table(s, d, "events"), "props").select(
    "event_id", F.col("parsed")["k"].try_cast("int").alias("k"), "json_valid", "repair_used")
O["parse_event_props"] = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, 1 AS json_valid, 0 AS repair_used FROM events"

# ---- R5, R6 over whole texts ------------------------------------------------------


def texts(s, d):
    doc = TB.table(s, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    conv = TB.table(s, d, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text")
    hints = F.array(*[F.lit(x) for x in HINTS])
    conv = conv.withColumn("text", F.concat("text", F.lit(" "), F.element_at(hints, (F.pmod(F.length("text"), F.lit(len(HINTS))) + 1).cast("int"))))
    return doc.unionByName(conv)


HINTS = ("", "choose the highest r12m winner", "lowest volatility first", "Contrarian allocation", "equal-weight control; ignore all feature data",
         "risk-adjusted return with smaller drawdowns", "an above-median screen with a bond cash sleeve", "highest 1/n of the lowest vol3m", "mean reversion of the weakest")
TEXTS = "tx AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, text || ' ' || [" + ", ".join(
    f"'{h}'" for h in HINTS) + f"][length(text) % {len(HINTS)} + 1] FROM conversations)"


def _kw(policy, words):
    hit = " OR ".join(f"contains(s, '{w}')" for w in words)
    for t in R.JOINT_RULES.get(policy, ()):
        hit += " OR (" + " AND ".join(f"contains(s, '{w}')" for w in t) + ")"
    return f"WHEN {hit} THEN '{policy}'"


Q["keyword_policy"] = lambda s, d: texts(s, d).select("id", R.keyword_policy(F.col("text")).alias("policy"))
O["keyword_policy"] = f"WITH {TEXTS} SELECT id, CASE {' '.join(_kw(p, w) for p, w in R.KEYWORD_RULES)} ELSE 'P4' END AS policy FROM (SELECT id, lower(text) AS s FROM tx)"
Q["tfidf_policy"] = lambda s, d: r6(R.tfidf_policy(texts(s, d), "id", "text"))
CORPUS = "co AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{w}')" for p, w in R.POLICY_WORDS.items()) + ") v(policy, words))"
O["tfidf_policy"] = f"""WITH {TEXTS}, {CORPUS},
ct AS (SELECT policy, token, count(*) / any_value(len) AS tf FROM (SELECT policy, unnest(string_split(words, ' ')) AS token, CAST(len(string_split(words, ' ')) AS DOUBLE) AS len FROM co) GROUP BY policy, token),
cd AS (SELECT token, count(*) AS df FROM ct GROUP BY token),
qt0 AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS toks FROM tx),
qt AS (SELECT id, token, count(*) / any_value(n) AS tf FROM (SELECT id, unnest(toks) AS token, CAST(len(toks) AS DOUBLE) AS n FROM qt0) GROUP BY id, token),
qd AS (SELECT qt.*, tf * (ln(8e0 / (2 + coalesce(df, 0))) + 1) AS w FROM qt LEFT JOIN cd USING (token)),
qn AS (SELECT id, sum(w * w) AS qn2 FROM qd GROUP BY id),
pv AS (SELECT ids.id, ct.policy, ct.token, ct.tf * (ln(8e0 / (1 + df + CASE WHEN qd.token IS NOT NULL THEN 1 ELSE 0 END)) + 1) AS w, qd.w AS qw
  FROM (SELECT DISTINCT id FROM qd) ids CROSS JOIN ct JOIN cd USING (token) LEFT JOIN qd ON qd.id = ids.id AND qd.token = ct.token),
sc AS (SELECT id, policy, round(coalesce(sum(w * qw), 0) / sqrt(sum(w * w) * any_value(qn2)), 12) AS score FROM pv JOIN qn USING (id) GROUP BY id, policy),
be AS (SELECT id, first(policy ORDER BY score DESC, policy DESC) AS policy, max(score) AS score FROM sc GROUP BY id)
SELECT tx.id, coalesce(policy, 'P6') AS policy, round(coalesce(score, 0), 6) AS score FROM tx LEFT JOIN be USING (id)"""

# ---- R4, F8, F9, E11 ----------------------------------------------------------------


MODELS = ["m0", "m1"]


def labels(s, d):
    """(mask_condition, asset, ord, label) for every mask of the plan."""
    u = TB.universe(s, d).withColumn("asset", F.regexp_replace("asset", "#", ""))
    return reduce(DataFrame.unionByName, [R.mask_labels(u, c).withColumn("mask_condition", F.lit(c)) for c in PL.MASKS])


def blocks(s, d):
    f = decided(s, d).withColumn("asset", F.regexp_replace("asset", "#", "")).withColumns(
        {c: F.round(c, 6) for c in ("r1m", "r3m", "r12m", "vol3m", "mdd", "cross_vol")})
    lab = labels(s, d)
    each = [R.feature_blocks(f, lab.where(F.col("mask_condition") == c), ["t"]).withColumn("mask_condition", F.lit(c)) for c in PL.MASKS]
    return reduce(DataFrame.unionByName, each)


def prompts(s, d):
    """Every call of the five experiments, all models, variants and masks."""
    plan = PL.experiment_plan(decisions(s, d), VR.policy_variants(s), MODELS).drop("decision_date", "prompt_hash", "seed")
    return R.render_prompts(plan, blocks(s, d), ["t", "mask_condition"])


def _planned():
    """(experiment, condition, policy, mask, reminded, template) of one model and date, as SQL rows."""
    sets = {}
    for kind, policy, variant, text in VR.templates():
        sets.setdefault(kind, []).append((policy, variant, text))
    rows = [("prompt_robustness", f"{p}_paraphrase_{v}", p, "real_ticker", 1, x) for p, v, x in sets["paraphrase"]]
    rows += [("ticker_masking", f"{p}_{m}", p, m, 1, x) for p, v, x in sets["base"] for m in PL.MASKS]
    rows += [("policy_complexity", p, p, "real_ticker", 1, x) for p, v, x in sets["complexity"]]
    rows += [("constraint_conflict_stress", f"{v}_{'reminded' if r else 'blind'}", p, "real_ticker", r, x) for p, v, x in sets["conflict"] for r in (1, 0)]
    rows += [("model_family_generalization", p, p, "real_ticker", 1, x) for p, v, x in sets["base"]]
    q = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "plan AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows) + ") v(e, cond, p, m, r, template))"


PLANNED = f"""{S.DFEAT},
lab AS (SELECT 'real_ticker' AS m, asset, replace(asset, '#', '') AS label FROM uni UNION ALL SELECT 'masked_ticker', asset, printf('Asset_%02d', ord) FROM uni
  UNION ALL SELECT 'shuffled_masked', asset, printf('Asset_%02d', row_number() OVER (ORDER BY md5('42|' || replace(asset, '#', '')))) FROM uni),
fv AS (SELECT m, t, ord, df.asset, label, round(r1m, 6) + 0e0 AS r1m, round(r3m, 6) + 0e0 AS r3m, round(r12m, 6) + 0e0 AS r12m, round(vol3m, 6) + 0e0 AS vol3m, round(mdd, 6) + 0e0 AS mdd,
  round(cross_vol, 6) + 0e0 AS cv FROM df JOIN lab ON lab.asset = df.asset),
lo AS (UNPIVOT (SELECT m, t, label, r1m, r3m, r12m, vol3m, mdd FROM fv) ON r1m, r3m, r12m, vol3m, mdd INTO NAME feature VALUE value),
models AS (SELECT unnest({MODELS}) AS model_id),
{_planned()}"""
LINES = " || chr(10) || ".join(f"'- ' || label || '_{f}: ' || printf('%.8f', {f})" for f in ("r1m", "r3m", "r12m", "vol3m", "mdd"))

Q["prompt_rendering"] = lambda s, d: prompts(s, d).select(
    "experiment_id", "condition_id", "model_id", "t", F.size(F.split("prompt_text", "\n")).alias("lines"), F.md5("prompt_text").alias("text_md5"))
O["prompt_rendering"] = f"""WITH {PLANNED},
bl AS (SELECT m, t, string_agg({LINES}, chr(10) ORDER BY ord) || chr(10) || '- cross_vol: ' || printf('%.8f', max(cv)) AS block, string_agg(label, ', ' ORDER BY ord) AS assets FROM fv GROUP BY m, t),
tx AS (SELECT e, cond, model_id, t, replace(replace(template, '{{prompt_cap_pct}}', '60'), '{{max_weight}}', '0.60')
  || CASE WHEN r = 1 THEN chr(10) || 'Execution limits: no short positions, weights add to one, at most 0.60 per asset, turnover at most 0.25; your proposal is projected onto them.' ELSE '' END
  || chr(10) || chr(10) || 'Current Features:' || chr(10) || block || chr(10) || chr(10) || 'Assets: ' || assets AS x FROM plan JOIN bl USING (m), models)
SELECT e AS experiment_id, cond AS condition_id, model_id, t, len(string_split(x, chr(10)))::INTEGER AS lines, md5(x) AS text_md5 FROM tx"""

# asset names are letters and digits only: masked labels, with their underscore, give no feature lines
Q["prompt_feature_values"] = lambda s, d: r6(prompts(s, d).select("experiment_id", "mask_condition", "t", F.inline(R.parse_features(F.col("prompt_text")))).groupBy(
    "experiment_id", "mask_condition", "t", "asset", "feature").agg(F.count("*").alias("calls"), F.min("value").alias("value"), F.max("value").alias("largest")))
O["prompt_feature_values"] = f"""WITH {PLANNED} SELECT e AS experiment_id, m AS mask_condition, t, label AS asset, feature, n AS calls, value, value AS largest
FROM (SELECT e, m, count(*) AS n FROM plan, models GROUP BY e, m) JOIN lo USING (m) WHERE m = 'real_ticker'"""


def zero_calls(s, d):
    core = W.intended_core(decided(s, d)).select(F.col("policy").alias("policy_id"), "t", F.regexp_replace("core", "#", "").alias("asset"))
    named = core.join(labels(s, d), "asset").select("policy_id", "t", "mask_condition", F.col("label").alias("target_asset"))
    return R.zero_feature_calls(prompts(s, d).join(named, ["policy_id", "t", "mask_condition"], "left"))


Q["zero_feature_summary"] = lambda s, d: r6(R.zero_feature_summary(zero_calls(s, d)))
O["zero_feature_summary"] = f"""WITH {PLANNED}, z AS (SELECT t, sum(CAST(r1m = 0 AS INT) + CAST(r3m = 0 AS INT) + CAST(r12m = 0 AS INT) + CAST(vol3m = 0 AS INT) + CAST(mdd = 0 AS INT)) AS z,
  CAST(max(r12m) = 0 AS INT) AS z1, CAST(min(vol3m) = 0 AS INT) AS z2, CAST(min(r3m) = 0 AS INT) AS z3 FROM fv WHERE m = 'real_ticker' GROUP BY t),
c AS (SELECT p, t, CASE WHEN m <> 'real_ticker' THEN 0 WHEN p = 'P1' THEN z1 WHEN p = 'P2' THEN z2 WHEN p = 'P3' THEN z3 ELSE 0 END AS hit, CASE WHEN m = 'real_ticker' THEN z ELSE 0 END AS z FROM plan, models, z)
SELECT p AS policy_id, count(*) AS calls, sum(CAST(z > 0 AS INT)) AS calls_with_any_exact_zero, round(avg(z), 6) AS mean_exact_zero_features,
 sum(hit) AS target_relevant_feature_zero, sum(hit) AS optimum_selected_from_zero FROM c GROUP BY p"""
Q["zero_feature_detail"] = lambda s, d: R.zero_feature_detail(prompts(s, d), ["experiment_id", "condition_id", "model_id", "t"])
O["zero_feature_detail"] = f"WITH {PLANNED} SELECT e AS experiment_id, cond AS condition_id, model_id, t, label AS asset, feature, value FROM plan JOIN lo USING (m), models WHERE value = 0 AND m = 'real_ticker'"


def q_masks(s, d):
    u = TB.universe(s, d)
    out = None
    for c in ("real_ticker", "masked_ticker", "shuffled_masked", "symbolic_masked"):
        x = R.mask_labels(u, c).withColumn("condition", F.lit(c))
        out = x if out is None else out.unionByName(x)
    return out


Q["mask_labels"] = q_masks
O["mask_labels"] = f"""WITH {S.BRAND} SELECT asset, ord, asset AS label, 'real_ticker' AS condition FROM uni UNION ALL SELECT asset, ord, printf('Asset_%02d', ord), 'masked_ticker' FROM uni
UNION ALL SELECT asset, ord, printf('Asset_%02d', row_number() OVER (ORDER BY md5('42|' || asset))), 'shuffled_masked' FROM uni UNION ALL SELECT asset, ord, printf('X%02d', (ord - 1) * 7 + 3), 'symbolic_masked' FROM uni"""
Q["unmask_weights"] = lambda s, d: R.unmask(
    TB.table(s, d, "part").select("p_partkey", F.format_string("Asset_%02d", F.col("p_partkey") % 30).alias("label")), R.mask_labels(TB.universe(s, d), "masked_ticker"))
O["unmask_weights"] = f"WITH {S.BRAND} SELECT p_partkey, asset, ord FROM part JOIN uni ON p_partkey % 30 = ord"
# ---- D10, D11, A21 -------------------------------------------------------------------
Q["fewshot_representatives"] = lambda s, d: r6(FS.representatives(feats(s, d).where("t >= 252"), 8))
Q["fewshot_examples"] = lambda s, d: r6(FS.labelled_examples(feats(s, d), FS.representatives(feats(s, d).where("t >= 252"), 8), "P2"))


def fold_examples(s, d):
    """Examples of every fold from its own training dates, with the text that a prompt carries."""
    f = feats(s, d)
    folds = D.folds(cal(s, d), 504, 378)
    reps = FS.fold_representatives(f.where("t >= 252"), folds, 6)
    return f, folds, reps, FS.labelled_examples(f, reps, "P2")


def q_fold_examples(s, d):
    """Each example is a training date of its fold and nearer to its centre than any other member."""
    _, folds, reps, examples = fold_examples(s, d)
    w = examples.groupBy("fold", "cluster").agg(F.sum("w").alias("total"), F.max("w").alias("top"))
    inside = ((F.col("t") >= F.col("train_start")) & (F.col("t") < F.col("train_end"))).cast("int").alias("in_training")
    return r6(reps.join(folds, "fold").join(w, ["fold", "cluster"]).select("fold", "cluster", "t", "distance", "members", inside, "total", "top"))


Q["fewshot_by_fold"] = q_fold_examples


def q_fold_prompts(s, d):
    """Prompts of the base policies at the test dates, each with its fold's examples."""
    f, folds, _, examples = fold_examples(s, d)
    texts_ = FS.fold_blocks(FS.example_blocks(examples, f))
    at = folds.join(decisions(s, d), (F.col("t") >= F.col("test_start")) & (F.col("t") < F.col("test_end"))).select("fold", "t").join(texts_, "fold")
    var = VR.policy_variants(s).where("variant_set = 'base'")
    plan = at.join(F.broadcast(var.select("policy_id", "template"))).withColumn("reminder", F.lit(True))
    x = R.render_prompts(plan, blocks(s, d).where("mask_condition = 'real_ticker'"), ["t"])
    shown = F.regexp_count("prompt_text", F.lit("### EXAMPLE [0-9]+"))
    return x.select("fold", "policy_id", "t", shown.alias("examples"), F.regexp_count("prompt_text", F.lit("TargetWeights")).alias("weights"), F.md5("prompt_text").alias("text_md5"))


Q["fewshot_prompts"] = q_fold_prompts


def q_baselines(s, d):
    var = VR.policy_variants(s).where("variant_set = 'base'").select("policy_id", "template")
    rule = var.select("policy_id", R.keyword_policy(F.col("template")).alias("policy")).withColumn("method", F.lit("rule"))
    tf = R.tfidf_policy(var, "policy_id", "template").select("policy_id", "policy").withColumn("method", F.lit("tfidf"))
    w = W.policy_weights(decided(s, d), 0.6, SAFE, ("P1", "P2", "P3", "P4", "P5", "P6"))
    vec = w.groupBy("policy", "t").agg(F.array_sort(F.collect_list(F.struct("ord", "w"))).alias("v")).select(
        "policy", "t", V.project_capped(F.transform("v", lambda e: e["w"]), 0.6).alias("w"))
    got = rule.unionByName(tf).join(vec, "policy").withColumnRenamed("w", "pw")
    ref = vec.select(F.col("policy").alias("policy_id"), "t", F.col("w").alias("rw"))
    j = got.join(ref, ["policy_id", "t"])
    return r6(j.groupBy("method").agg(
        F.count("*").alias("n"), F.avg((F.col("policy") == F.col("policy_id")).cast("double")).alias("accuracy"), F.avg(V.l1(F.col("pw"), F.col("rw"))).alias("mean_l1")))


Q["baseline_summary"] = q_baselines
O["baseline_summary"] = f"""WITH {S.BRAND}{S.DECIDE} SELECT unnest(['rule', 'tfidf']) AS method, 6 * count(*) AS n, 1e0 AS accuracy, 0e0 AS mean_l1 FROM decisions"""

# ---- X1-X5, X8, X9, R8, S8 --------------------------------------------------------------
Q["experiment_plan"] = lambda s, d: PL.experiment_plan(decisions(s, d), VR.policy_variants(s), MODELS).groupBy("experiment_id", "model_id", "policy_id").agg(
    F.count("*").alias("calls"), F.countDistinct("call_id").alias("ids"), F.countDistinct("condition_id").alias("conditions"))
O["experiment_plan"] = f"""WITH {S.BRAND}{S.DECIDE}, n AS (SELECT count(*) AS n FROM decisions),
x(e, p, c) AS (SELECT 'prompt_robustness', 'P' || k, CASE k WHEN 4 THEN 5 WHEN 6 THEN 6 ELSE 10 END FROM range(1, 7) r(k) UNION ALL SELECT 'ticker_masking', 'P' || k, 3 FROM range(1, 7) r(k)
 UNION ALL SELECT 'policy_complexity', 'L' || k, 1 FROM range(1, 7) r(k) UNION ALL SELECT 'constraint_conflict_stress', 'P1', 22 UNION ALL SELECT 'model_family_generalization', 'P' || k, 1 FROM range(1, 7) r(k))
SELECT e AS experiment_id, 'm' || m AS model_id, p AS policy_id, c * n AS calls, c * n AS ids, c AS conditions FROM x, n, range(0, 2) g(m)"""
Q["experiment_plan_capped"] = lambda s, d: PL.experiment_plan(decisions(s, d), VR.policy_variants(s), ["m1", "m0"], ["P2"], 25).select(
    "experiment_id", "model_id", "condition_id", "mask_condition", F.col("reminder").cast("int").alias("reminder"), "t")
O["experiment_plan_capped"] = f"""WITH {S.BRAND}{S.DECIDE},
c(e, k, c, m, r) AS (SELECT 'prompt_robustness', j, 'P2_paraphrase_0' || j, 'real_ticker', 1 FROM range(0, 10) g(j)
 UNION ALL SELECT * FROM (VALUES ('ticker_masking', 0, 'P2_real_ticker', 'real_ticker', 1), ('ticker_masking', 1, 'P2_masked_ticker', 'masked_ticker', 1), ('ticker_masking', 2, 'P2_shuffled_masked', 'shuffled_masked', 1))
 UNION ALL SELECT 'policy_complexity', j, 'L' || j, 'real_ticker', 1 FROM range(1, 7) g(j)
 UNION ALL SELECT 'constraint_conflict_stress', 2 * i + b, n || CASE b WHEN 0 THEN '_reminded' ELSE '_blind' END, 'real_ticker', 1 - b FROM (SELECT unnest({list(VR.CONFLICTS)}) AS n, generate_subscripts({list(VR.CONFLICTS)}, 1) AS i), range(0, 2) g(b)
 UNION ALL SELECT 'model_family_generalization', 0, 'P2', 'real_ticker', 1),
x AS (SELECT c.*, m.i, m.n AS model, t FROM c, (VALUES (0, 'm1'), (1, 'm0')) m(i, n), decisions),
y AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY i, k, t) AS q FROM x)
SELECT e AS experiment_id, model AS model_id, c AS condition_id, m AS mask_condition, r AS reminder, t FROM y WHERE q <= 25"""
Q["supplementary_plan"] = lambda s, d: PL.supplementary_plan(decisions(s, d), VR.policy_variants(s), MODELS, ["P1", "P2"]).groupBy("kind", "protocol").agg(
    F.count("*").alias("tasks"), F.countDistinct("task_id").alias("ids"), F.max("seed").alias("last_seed"))
O["supplementary_plan"] = f"""WITH {S.BRAND}{S.DECIDE}, n AS (SELECT count(*) AS n FROM decisions), x AS (SELECT * FROM (VALUES ('baseline', 'rule', 6, 42), ('baseline', 'tfidf', 6, 42), ('bridge', 'A_original', 4, 42), ('bridge', 'B_canonical', 4, 42), ('repeatability', 'B_canonical', 20, 46)) v(kind, protocol, c, last_seed))
SELECT kind, protocol, c * n AS tasks, c * n AS ids, last_seed FROM x, n"""


def status_log(s, d):
    """Two reports per call: started, then its outcome."""
    e = TB.table(s, d, "events")
    st = F.element_at(F.array(*[F.lit(x) for x in ("completed", "failed", "running", "completed", "timed_out")]), (F.col("user_id") % 5 + 1).cast("int"))
    base = e.select(F.floor(F.col("event_id") / 2).alias("call_id"), "ts", "event_type", "value", "user_id", "event_id",
                    F.when(F.col("event_id") % 2 == 0, "running").otherwise(st).alias("status"))
    return base.select("call_id", "ts", F.col("event_type").alias("experiment_id"), (F.col("user_id") % 3).alias("model_id"), "status",
                       F.col("ts").alias("started_at"), F.when(F.col("status") != "running", F.col("ts")).alias("completed_at"),
                       F.col("value").alias("elapsed_sec"))


LATEST = """lg AS (SELECT event_id // 2 AS call_id, ts, event_type AS experiment_id, user_id % 3 AS model_id, CASE WHEN event_id % 2 = 0 THEN 'running' ELSE ['completed','failed','running','completed','timed_out'][user_id % 5 + 1] END AS status, value AS elapsed_sec FROM events),
ls AS (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY ts DESC, experiment_id DESC, model_id DESC) = 1)"""
Q["latest_status"] = lambda s, d: PL.latest_status(status_log(s, d)).select("call_id", "status", "experiment_id", "model_id")
O["latest_status"] = f"WITH {LATEST} SELECT call_id, status, experiment_id, model_id FROM ls"
Q["status_counts"] = lambda s, d: PL.status_counts(PL.latest_status(status_log(s, d)), ["experiment_id", "model_id"])
O["status_counts"] = f"""WITH {LATEST} SELECT experiment_id, model_id, count(*) FILTER (status = 'completed') AS done, count(*) FILTER (status IN ('failed', 'timed_out')) AS failed,
 count(*) FILTER (status = 'running') AS running, count(*) AS total FROM ls GROUP BY 1, 2"""
Q["pending_work"] = lambda s, d: PL.pending(TB.table(s, d, "events").select(F.col("event_id").alias("call_id")), PL.latest_status(status_log(s, d)))
O["pending_work"] = f"WITH {LATEST} SELECT event_id AS call_id FROM events WHERE event_id NOT IN (SELECT call_id FROM ls WHERE status = 'completed')"
Q["progress"] = lambda s, d: r6(PL.progress(PL.latest_status(status_log(s, d)), 20000).select(
    "active_call", "avg_sec", "recent_avg_sec", "ended", "running", "eta_sec"))
O["progress"] = f"""WITH {LATEST}, r AS (SELECT avg(elapsed_sec) AS ra FROM (SELECT elapsed_sec FROM ls WHERE status = 'completed' ORDER BY ts DESC, call_id LIMIT 30)),
a AS (SELECT first(call_id ORDER BY ts DESC, call_id DESC) FILTER (status = 'running') AS ac, avg(elapsed_sec) FILTER (status = 'completed') AS av, count(*) FILTER (status <> 'running') AS en, count(*) FILTER (status = 'running') AS ru FROM ls)
SELECT ac AS active_call, round(av, 6) AS avg_sec, round(ra, 6) AS recent_avg_sec, en AS ended, ru AS running, round((20000 - en) * ra, 6) AS eta_sec FROM a, r"""
Q["progress_alerts"] = lambda s, d: PL.alerts(PL.progress(PL.latest_status(status_log(s, d)), 20000), F.lit("2024-02-15 00:00:00"))
O["progress_alerts"] = "SELECT unnest(['stale', 'several_running']) AS alert WHERE (SELECT max(ts) FROM events) < TIMESTAMP '2024-02-14'"
Q["failure_kinds"] = lambda s, d: TB.table(s, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "ReadTimeout").otherwise("ValueError").alias("error_type"),
    F.when(F.col("event_id") % 5 == 0, "connect TIMEOUT").otherwise(F.col("props")).alias("error_message")).select("event_id", PL.failure_kind("error_type", "error_message").alias("status"))
O["failure_kinds"] = "SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN 'timed_out' ELSE 'failed' END AS status FROM events"


def attempts(s, d):
    e = TB.table(s, d, "events")
    one = F.to_json(F.array(F.struct(F.lit(1).alias("attempt"), F.lit("parse").alias("kind"), F.col("value").alias("elapsed_sec"), F.lit("x").alias("error")),
                            F.struct(F.lit(2).alias("attempt"), F.lit("network").alias("kind"), F.lit(1.0).alias("elapsed_sec"), F.lit("y").alias("error"))))
    return e.select("event_type", F.when(F.col("event_id") % 4 == 0, "[]").otherwise(one).alias("attempt_diagnostics"))


Q["attempt_rollup"] = lambda s, d: r6(PL.attempt_rollup(attempts(s, d), ["event_type"]))
O["attempt_rollup"] = """SELECT event_type, 2 * count(*) FILTER (event_id % 4 > 0) AS attempts, count(*) FILTER (event_id % 4 > 0) AS parse_retries, count(*) FILTER (event_id % 4 > 0) AS network_retries,
 0 AS timeout_retries, round(sum(value + 1) FILTER (event_id % 4 > 0), 6) AS attempt_sec FROM events GROUP BY 1"""


def run_log(s, d):
    e = TB.table(s, d, "events")
    i = F.col("event_id") % 5
    return e.select("event_id", F.when(i == 0, F.format_string("[CALL DONE] %d/10000 id=x", "event_id")).when(i == 1, F.format_string("[MODEL START] m%d", F.col("user_id"))).when(
        i == 2, F.concat(F.lit("[RUN] "), "event_type")).when(i == 3, F.lit("[CALL FAILED] 7/9 Timeout")).otherwise(F.col("props")).alias("value"))


Q["run_log"] = lambda s, d: PL.parse_run_log(run_log(s, d)).drop("value")
O["run_log"] = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'DONE' WHEN 3 THEN 'FAILED' END AS call_event, CASE event_id % 5 WHEN 0 THEN event_id WHEN 3 THEN 7 END AS ordinal, CASE event_id % 5 WHEN 0 THEN 10000 WHEN 3 THEN 9 END AS plan_total,
 CASE event_id % 5 WHEN 1 THEN 'START' END AS model_event, CASE event_id % 5 WHEN 1 THEN 'm' || user_id END AS model, CASE event_id % 5 WHEN 2 THEN event_type END AS experiment, CAST(event_id % 5 IN (0, 1, 3) AS INT) AS is_event,
 CAST(event_id % 5 = 3 OR (event_id % 5 = 2 AND event_type = 'error') AS INT) AS is_warning FROM events"""
Q["rebuild_exports"] = lambda s, d: SC.rebuild_exports(
    status_log(s, d).withColumn("result_json", F.to_json(F.struct(F.col("call_id").cast("string").alias("call_id"), F.col("elapsed_sec").alias("latency_sec")))), "call_id string, latency_sec double")
O["rebuild_exports"] = f"WITH {LATEST} SELECT CAST(call_id AS VARCHAR) AS call_id, elapsed_sec AS latency_sec FROM lg WHERE status = 'completed'"

# ---- X6, X7 streams -------------------------------------------------------------------------
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream(s, d):
    return ST.read_log(s, d, EVENTS, "parquet", "events.parquet")


Q["stream_status_windows"] = lambda s, d: ST.run_available(
    ST.window_counts(ST.first_reports(stream(s, d), "event_id", "ts", "1 hour"), "ts", ["event_type"], "6 hours"), "status-windows")
O["stream_status_windows"] = """SELECT start, start + INTERVAL 6 HOURS AS "end", event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, event_type FROM events) GROUP BY 1, 2, 3
HAVING start + INTERVAL 6 HOURS <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""
Q["stream_sliding_latency"] = lambda s, d: r6(ST.run_available(ST.sliding_latency(
    stream(s, d).withWatermark("ts", "1 hour"), "ts", ["event_type"], "value", "12 hours", "6 hours"), "sliding-latency"))
O["stream_sliding_latency"] = """WITH x AS (SELECT time_bucket(INTERVAL 6 HOURS, ts) - k * INTERVAL 6 HOURS AS start, event_type, value FROM events, range(0, 2) r(k))
SELECT start, event_type, round(avg(value), 6) AS mean_latency, max(value) AS max_latency, count(*) AS n FROM x GROUP BY 1, 2 HAVING start + INTERVAL 12 HOURS <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""
Q["stream_stale_gaps"] = lambda s, d: r6(ST.run_available(ST.stale_gaps(stream(s, d), "user_id", "ts", 36000.0), "stale").select(
    F.col("key").cast("bigint").alias("user_id"), "kind", "gap_sec"))
O["stream_stale_gaps"] = """WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
last_ AS (SELECT user_id, max(epoch_ms(ts)) AS seen FROM events GROUP BY 1)
SELECT user_id, 'gap' AS kind, round(gap / 1e6, 6) AS gap_sec FROM g WHERE gap / 1e6 > 36000
UNION ALL SELECT user_id, 'silent', NULL FROM last_ WHERE seen + 36000000 < (SELECT max(seen) FROM last_)"""


def replayed(s, d):
    """All batches, and then all of them again, as after a lost checkpoint."""
    path = shared_dir(s, "upserts")
    for run in range(2):
        SC.upsert_batches(stream(s, d).select("user_id", "ts", "event_id", "event_type", "value"), f"{path}/data", f"{path}/checkpoint-{run}")
    return SC.upserted(s, f"{path}/data", "user_id long, ts timestamp, event_id long, event_type string, value double", "user_id", "ts")


Q["replayed_upserts"] = lambda s, d: replayed(s, d).withColumn("ts", F.unix_micros("ts"))
O["replayed_upserts"] = """SELECT user_id, epoch_us(ts) AS ts, event_id, event_type, value, n AS reports
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE k = 1"""


def csv_log(s, d):
    """A call log as CSV: quotes and commas in texts, numbers and dates that cannot be read."""
    i = F.col("event_id")
    log = TB.table(s, d, "events").select(
        i.alias("call_id"), F.when(i % 7 == 0, "n/a").when(i % 13 == 0, "inf").otherwise(F.col("value").cast("string")).alias("latency_sec"),
        F.when(i % 11 == 0, "2024-13-45").otherwise(F.to_date("ts").cast("string")).alias("decision_date"), F.concat(F.lit('say "x, y" '), "props").alias("note"))
    path = shared_dir(s, "csv-log")
    log.write.option("header", True).option("escape", '"').csv(path)
    return SC.combine_logs({"csv": SC.read_calls_csv(s, path)}, ["call_id", "latency_sec", "decision_date"], ["latency_sec"])


Q["csv_log"] = lambda s, d: r6(csv_log(s, d).select(F.col("call_id").cast("bigint").alias("call_id"), "latency_sec", "decision_date", F.md5("note").alias("note_md5"), "source_log"))
O["csv_log"] = """SELECT event_id AS call_id, CASE WHEN event_id % 7 = 0 OR event_id % 13 = 0 THEN NULL ELSE round(value, 6) END AS latency_sec, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS decision_date,
 md5('say "x, y" ' || props) AS note_md5, 'csv' AS source_log FROM events"""


def artefacts(s, d):
    path = shared_dir(s, "artefacts")
    SC.write_artefacts(series_returns(s, d).select("series", "t", "ret"), path)
    return s.read.parquet(path)


Q["artefact_partitions"] = lambda s, d: r6(artefacts(s, d).groupBy("series").agg(F.count("*").alias("days"), F.sum("ret").alias("total")))
O["artefact_partitions"] = f"WITH {SERIES} SELECT series, count(*) AS days, round(sum(ret), 6) AS total FROM series GROUP BY series"
