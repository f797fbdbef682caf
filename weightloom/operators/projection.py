"""Projection on the capped simplex, feasibility and diagnostics.

Two physical forms of one exact algorithm: ``project_vectors`` for tables that
hold a weight vector per row (no shuffle) and ``project_long`` for exploded
``(key, asset, a)`` tables (one shuffle by key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weightloom.functions import vectors as V
from weightloom.functions.scalars import finite


def project_vectors(df: DataFrame, raw: str, cap: Column | float, out: str = "w") -> DataFrame:
    return df.withColumn(out, V.project_capped(F.col(raw), cap))


def project_long(df: DataFrame, keys: list[str], raw: str = "a", cap: Column | float = 0.60, out: str = "w") -> DataFrame:
    """Set-based projection of every key at once.

    Each entry contributes two kinks of g(u) = sum clip(a + u, 0, cap): one
    where it becomes positive, one where it reaches the cap.  A running slope
    and a running height along the sorted kinks locate g = 1.
    """
    cap = F.lit(cap).cast("double") if not isinstance(cap, Column) else cap
    x = df.withColumn("_a", F.coalesce(finite(raw), F.lit(0.0))).withColumn("_cap", cap)
    kinks = x.withColumn(
        "_k",
        F.explode(
            F.array(
                F.struct((-F.col("_a")).alias("u"), F.lit(1.0).alias("s")),
                F.struct((F.col("_cap") - F.col("_a")).alias("u"), F.lit(-1.0).alias("s")),
            )
        ),
    )
    line = Window.partitionBy(*keys).orderBy("_k.u", "_k.s")
    whole = Window.partitionBy(*keys)
    slope = F.coalesce(F.sum("_k.s").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    prev = F.coalesce(F.lag("_k.u").over(line), F.col("_k.u"))
    k = kinks.withColumns({"_slope": slope, "_prev": prev})
    k = k.withColumn("_gain", F.col("_slope") * (F.col("_k.u") - F.col("_prev")))
    k = k.withColumn("_g", F.sum("_gain").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    below = F.col("_g") - F.col("_gain")
    hit = F.when(
        (F.col("_slope") > 0) & (F.col("_g") >= 1.0) & (below < 1.0), F.col("_prev") + F.try_divide(1.0 - below, F.col("_slope"))
    )
    k = k.withColumn("_hit", hit)
    shift = F.coalesce(F.min("_hit").over(whole), F.max("_k.u").over(whole))
    k = k.withColumn("_u", shift).where("_k.s > 0").withColumn("_n", F.count("*").over(whole))
    clipped = F.least(F.greatest(F.col("_a") + F.col("_u"), F.lit(0.0)), F.col("_cap"))
    k = k.withColumn("_w", clipped)
    w = F.when(F.col("_cap") * F.col("_n") < 1.0 - 1e-12, 1.0 / F.col("_n")).otherwise(
        F.try_divide(F.col("_w"), F.sum("_w").over(whole))
    )
    return k.withColumn(out, w).select(*df.columns, out)


def projection_diagnostics(df: DataFrame, raw: str, projected: str, cap: Column | float) -> DataFrame:
    """Distances, clip counts, concentration and collapse of each vector."""
    cap = F.lit(cap).cast("double") if not isinstance(cap, Column) else cap
    a, w = F.col(raw), F.col(projected)
    neg = F.size(F.filter(a, lambda x: x < 0))
    over = F.size(F.filter(a, lambda x: x > cap))
    return df.withColumns(
        {
            "proj_l1": V.l1(a, w),
            "proj_l2": V.l2(a, w),
            "neg_weight_count": neg,
            "over_cap_count": over,
            "cap_clip": ((neg > 0) | (over > 0)).cast("int"),
            "entropy": V.entropy(w),
            "herfindahl": V.herfindahl(w),
            "equal_collapse": (V.l1(w, V.equal_like(w)) < 1e-4).cast("int"),
            "sum_weight": V.total(w),
            "max_weight": F.array_max(w),
            "min_weight": F.array_min(w),
        }
    )


def feasibility(df: DataFrame, raw: str, post: str, cap: Column | float) -> DataFrame:
    """Feasibility of the raw and of the projected vector."""
    cap = F.lit(cap).cast("double") if not isinstance(cap, Column) else cap
    r, p = F.col(raw), F.col(post)
    raw_sum, post_sum = V.total(r), V.total(p)
    return df.withColumns(
        {
            "raw_sum": raw_sum,
            "raw_max_weight": F.array_max(r),
            "raw_min_weight": F.array_min(r),
            "raw_budget_violation": F.abs(raw_sum - 1.0),
            "raw_cap_violation": (F.array_max(r) > cap + 1e-8).cast("int"),
            "raw_longonly_violation": (F.array_min(r) < -1e-12).cast("int"),
            "post_sum": post_sum,
            "post_max_weight": F.array_max(p),
            "post_min_weight": F.array_min(p),
            "post_feasible_budget": (F.abs(post_sum - 1.0) <= 1e-6).cast("int"),
            "post_feasible_cap": (F.array_max(p) <= cap + 1e-8).cast("int"),
            "post_feasible_longonly": (F.array_min(p) >= -1e-10).cast("int"),
        }
    )


def turnover_capped(prev: Column, target: Column, turnover_cap: Column | float) -> Column:
    """Move from ``prev`` towards ``target`` by at most the cap in L1.

    Both ends must be feasible; a convex combination of them stays feasible.
    """
    cap = F.lit(turnover_cap).cast("double") if not isinstance(turnover_cap, Column) else turnover_cap
    gap = V.l1(prev, target)
    share = F.when(cap <= 0, 0.0).when((gap <= cap) | (gap <= 1e-12), 1.0).otherwise(F.try_divide(cap, gap))
    return V.bind(share, lambda a: F.zip_with(prev, target, lambda p, t: p + a * (t - p)))


def optimality_residual(df: DataFrame, raw: str, projected: str, cap: Column | float) -> DataFrame:
    """KKT residual of a projection.

    At the optimum a_i - w_i equals one multiplier on every free coordinate, is
    no larger at the floor and no smaller at the cap.  ``kkt_residual`` is the
    worst violation together with the budget error; 0 means optimal.
    """
    cap = F.lit(cap).cast("double") if not isinstance(cap, Column) else cap
    pairs = F.zip_with(raw, projected, lambda a, w: F.struct((a - w).alias("d"), w.alias("w")))
    eps = 1e-12
    # every coordinate above the floor needs d >= tau, every one below the cap d <= tau
    lowest = F.array_min(F.transform(F.filter(pairs, lambda p: p["w"] > eps), lambda p: p["d"]))
    highest = F.array_max(F.transform(F.filter(pairs, lambda p: p["w"] < cap - eps), lambda p: p["d"]))
    gap = F.greatest(F.coalesce(highest - lowest, F.lit(0.0)), F.lit(0.0))
    budget = F.abs(V.total(F.col(projected)) - 1.0)
    return df.withColumn("kkt_residual", F.greatest(gap, budget))


def violation_rates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        *[
            (F.lit(1.0) - F.avg(c)).alias(f"{n}_violation_rate")
            for c, n in (("feasible_budget", "budget"), ("feasible_nonnegative", "nonnegative"), ("feasible_cap", "cap"))
        ]
    )


#: What a recorded call may count, and the name of its mean per call.
CALL_COUNTS = {
    "hallucinated_asset_count": "hallucinated_per_call", "missing_asset_count": "missing_per_call", "invalid_weight_count": "invalid_weight_per_call",
    "negative_weight_count": "negative_weight_per_call", "equal_fallback": "equal_fallback_rate",
}


def run_diagnostics(steps: DataFrame, calls: DataFrame | None, key: str = "series") -> DataFrame:
    """Per-step projection averages and per-call parsing rates of a run.

    Series without recorded calls get NULL parsing rates rather than 0. Counts that the steps or
    calls do not carry (``turnover_clip``; ``CALL_COUNTS``) give no column.
    """
    clipped = [F.avg("turnover_clip").alias("turnover_clip_freq")] if "turnover_clip" in steps.columns else []
    out = steps.groupBy(key).agg(
        F.count("*").alias("n_steps"),
        F.avg("proj_l1").alias("avg_projection_l1"),
        F.avg("proj_l2").alias("avg_projection_l2"),
        F.avg("cap_clip").alias("cap_clip_freq"),
        F.avg("entropy").alias("avg_entropy"),
        F.avg("herfindahl").alias("avg_herfindahl"),
        F.avg("equal_collapse").alias("equal_collapse_rate"),
        F.avg("neg_weight_count").alias("neg_weight_per_step"),
        F.avg("over_cap_count").alias("over_cap_per_step"),
        *clipped,
    )
    if calls is None:
        return out
    per_call = calls.groupBy(key).agg(
        F.count("*").alias("n_calls"),
        F.avg("json_valid").alias("json_valid_rate"),
        F.avg("repair_used").alias("repair_rate"),
        F.avg("parse_fail").alias("parse_fail_rate"),
        F.avg("latency_sec").alias("avg_latency_sec"),
        *[F.avg(c).alias(name) for c, name in CALL_COUNTS.items() if c in calls.columns],
    )
    return out.join(per_call, key, "left").fillna(0, ["n_calls"])
