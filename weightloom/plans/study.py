"""Experiment plans, resume and progress, all as tables.

A plan is the product of small dimensions (models, variants, conditions) with
the decision dates, so its size is the number of calls to make.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weightloom.functions.scalars import record_id, short_hash

EXPERIMENTS = {
    "prompt_robustness": "paraphrase", "ticker_masking": "base", "policy_complexity": "complexity",
    "constraint_conflict_stress": "conflict", "model_family_generalization": "base",
}
MASKS = ("real_ticker", "masked_ticker", "shuffled_masked")


def _with(df: DataFrame, col: Column, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(col))


def _literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def experiment_plan(
    dates: DataFrame, variants: DataFrame, models: list[str], policies: list[str] | None = None,
    max_calls: int | None = None, seed: int = 42,
) -> DataFrame:
    """Calls of the five experiments: one row per model, condition and date.

    Dimensions are expanded onto the dates by generators.  ``max_calls`` keeps
    the first calls of each experiment: models as given, variants by their
    ``ordinal`` (policy and variant id where that is absent), labels real, masked,
    shuffled, reminded before blind, then dates.
    """
    ordinal = F.col("ordinal") if "ordinal" in variants.columns else F.lit(0)
    parts = []
    for experiment, kind in EXPERIMENTS.items():
        v = variants.where(F.col("variant_set") == kind)
        if policies and kind in ("base", "paraphrase"):
            v = v.where(F.col("policy_id").isin(*policies))
        v = v.agg(F.collect_list(F.struct("policy_id", "variant_id", "template", ordinal.alias("_ordinal"))).alias("v"))  # a literal dimension
        x = dates.select(F.col("dt").alias("decision_date"), "t").join(F.broadcast(v)).select("decision_date", "t", F.inline("v"))
        x = _with(x, _literals(models), "model_id")
        mask, remind, cond = F.lit("real_ticker"), F.lit(True), F.col("policy_id")
        if experiment == "ticker_masking":
            x = _with(x, _literals(MASKS), "mask_condition")
            mask, cond = F.col("mask_condition"), F.concat_ws("_", "policy_id", "mask_condition")
        elif experiment == "constraint_conflict_stress":
            x = _with(x, _literals([True, False]), "reminder")
            remind = F.col("reminder")
            cond = F.concat_ws("_", "variant_id", F.when(F.col("reminder"), "reminded").otherwise("blind"))
        elif experiment == "prompt_robustness":
            cond = F.concat(F.col("policy_id"), F.lit("_paraphrase_"), F.col("variant_id"))
        parts.append(
            x.select(
                F.lit(experiment).alias("experiment_id"), cond.alias("condition_id"), "model_id", "policy_id", "variant_id",
                mask.alias("mask_condition"), remind.alias("reminder"), "decision_date", "t", "template", "_ordinal",
            )
        )
    plan = reduce(DataFrame.unionByName, parts)
    if max_calls is not None:
        order = Window.partitionBy("experiment_id").orderBy(
            F.array_position(_literals(models), F.col("model_id")), "_ordinal", "policy_id", "variant_id",
            F.array_position(_literals(MASKS), F.col("mask_condition")), F.col("reminder").desc(), "t")
        plan = plan.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= max_calls).drop("_k")
    return with_call_id(plan.drop("_ordinal"), seed)


def with_call_id(plan: DataFrame, seed: int = 42) -> DataFrame:
    x = plan.withColumn("prompt_hash", short_hash("template")).withColumn("seed", F.lit(seed))
    key = ("experiment_id", "model_id", "condition_id", "policy_id", "decision_date", "prompt_hash", "seed")
    return x.withColumn("call_id", record_id(*key))


def supplementary_plan(
    dates: DataFrame, variants: DataFrame, models: list[str], policies: list[str], repeats: int = 5, seed: int = 42
) -> DataFrame:
    """Baseline, bridge (two protocols) and repeatability tasks."""
    base = variants.where("variant_set = 'base'").agg(F.collect_list("policy_id").alias("p"))
    d = dates.select("dt", "t")
    cols = ["kind", "dt", "t", "model_id", "policy_id", "protocol", "rep", "seed"]
    b = _with(d.join(F.broadcast(base)), F.col("p"), "policy_id")
    b = _with(b, _literals(["rule", "tfidf"]), "protocol").withColumns(
        {"kind": F.lit("baseline"), "model_id": F.lit(""), "rep": F.lit(0), "seed": F.lit(seed)})
    m = _with(_with(d, _literals(models), "model_id"), _literals(policies), "policy_id")
    g = _with(m, _literals(["A_original", "B_canonical"]), "protocol").withColumns(
        {"kind": F.lit("bridge"), "rep": F.lit(0), "seed": F.lit(seed)})
    r = _with(m, F.sequence(F.lit(0), F.lit(repeats - 1)), "rep").withColumns(
        {"kind": F.lit("repeatability"), "protocol": F.lit("B_canonical"), "seed": F.col("rep") + seed})
    plan = b.select(cols).unionByName(g.select(cols)).unionByName(r.select(cols))
    return plan.withColumn("task_id", record_id(*[c for c in cols if c != "dt"]))


def latest_status(log: DataFrame, key: str = "call_id", order: str = "ts") -> DataFrame:
    """Last state per call; partial maxima combine before the shuffle."""
    rest = [c for c in log.columns if c not in (key, order)]
    a = log.groupBy(key).agg(F.max(order).alias(order), F.max_by(F.struct(*rest), F.struct(order, *rest)).alias("_s"))
    return a.select(key, order, "_s.*")


def pending(plan: DataFrame, status: DataFrame, key: str = "call_id", retry_failed: bool = True) -> DataFrame:
    """Planned work that is not done; interrupted (running) work is due again."""
    done = ["completed"] if retry_failed else ["completed", "failed", "timed_out"]
    return plan.join(status.where(F.col("status").isin(*done)).select(key), key, "left_anti")


def failure_kind(error_type, message) -> Column:
    text = F.lower(F.concat_ws(" ", F.col(error_type), F.col(message)))
    return F.when(text.contains("timeout"), "timed_out").otherwise("failed")


def status_counts(status: DataFrame, keys: list[str]) -> DataFrame:
    s = F.col("status")
    return status.groupBy(*keys).agg(
        F.count_if(s == "completed").alias("done"), F.count_if(s.isin("failed", "timed_out")).alias("failed"),
        F.count_if(s == "running").alias("running"), F.count("*").alias("total"),
    )


def progress(status: DataFrame, planned: int, recent: int = 30) -> DataFrame:
    """One row: active call, last completion, mean and recent duration, ETA.

    The recent mean needs the newest completions only: a top-k, not a sort.
    """
    s = F.col("status")
    done = s == "completed"
    ended = s.isin("completed", "failed", "timed_out")
    a = status.agg(
        F.max_by(F.when(s == "running", F.col("call_id")), F.when(s == "running", F.struct("started_at", "call_id"))).alias("active_call"),
        F.max(F.when(ended, F.col("completed_at"))).alias("last_done"), F.avg(F.when(done, F.col("elapsed_sec"))).alias("avg_sec"),
        F.count_if(ended).alias("ended"), F.count_if(s == "running").alias("running"),
    )
    last = status.where(done & F.col("elapsed_sec").isNotNull()).orderBy(F.desc("completed_at"), "call_id").limit(recent)
    r = last.agg(F.avg("elapsed_sec").alias("recent_avg_sec"))
    x = a.join(F.broadcast(r))  # one row each
    eta = F.greatest(F.lit(planned) - F.col("ended"), F.lit(0)) * F.coalesce("recent_avg_sec", "avg_sec")
    return x.withColumn("eta_sec", eta)


def alerts(progress_row: DataFrame, now: Column, stale_minutes: float = 30.0) -> DataFrame:
    """Alert rows: stale log, several running calls."""
    age = (now.cast("timestamp").cast("double") - F.col("last_done").cast("timestamp").cast("double")) / 60.0
    rules = F.array(
        F.struct(F.lit("stale").alias("alert"), (age >= stale_minutes).alias("on")),
        F.struct(F.lit("several_running").alias("alert"), (F.col("running") > 1).alias("on")),
    )
    return progress_row.select(F.inline(rules)).where("on").select("alert")


ATTEMPTS = "array<struct<attempt:int,kind:string,elapsed_sec:double,error:string>>"


def attempt_rollup(calls: DataFrame, keys: list[str], text: str = "attempt_diagnostics") -> DataFrame:
    """Attempts, retries by kind and time spent, from the JSON list per call."""
    a = calls.select(*keys, F.explode_outer(F.from_json(text, ATTEMPTS)).alias("a"))
    kind = F.col("a.kind")
    return a.groupBy(*keys).agg(
        F.count("a").alias("attempts"), F.count_if(kind == "parse").alias("parse_retries"),
        F.count_if(kind == "network").alias("network_retries"), F.count_if(kind == "timeout").alias("timeout_retries"),
        F.sum("a.elapsed_sec").alias("attempt_sec"),
    )


# ---- fixed values: run-log tokens ------------------------------------------------
CALL_LINE = r"\[CALL (START|DONE|FAILED)\]\s+(\d+)/(\d+)"
MODEL_LINE = r"\[MODEL (START|DONE)\]\s+(\S+)"
RUN_LINE = r"\[RUN\]\s+(\S+)"
EVENT_LINE = r"\[(?:CALL START|CALL DONE|CALL FAILED|WARN|MODEL START|MODEL DONE|ALL DONE)\]"
WARN_WORDS = r"timeout|failed|error"
# -----------------------------------------------------------------------------------


def parse_run_log(lines: DataFrame, col: str = "value") -> DataFrame:
    """Structured fields of a run log; works on a batch or a stream of lines."""
    c = F.col(col)
    some = lambda e: F.when(e != "", e)
    return lines.withColumns(
        {
            "call_event": some(F.regexp_extract(c, CALL_LINE, 1)),
            "ordinal": F.regexp_extract(c, CALL_LINE, 2).try_cast("int"),
            "plan_total": F.regexp_extract(c, CALL_LINE, 3).try_cast("int"),
            "model_event": some(F.regexp_extract(c, MODEL_LINE, 1)),
            "model": some(F.regexp_extract(c, MODEL_LINE, 2)),
            "experiment": some(F.regexp_extract(c, RUN_LINE, 1)),
            "is_event": c.rlike(EVENT_LINE).cast("int"),
            "is_warning": F.lower(c).rlike(WARN_WORDS).cast("int"),
        }
    )
