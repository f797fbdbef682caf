"""Audit of recorded allocation decisions: per-call scores and rollups.

A call holds its raw, projected and reference weights in one row, so per-call
scores are column expressions without a shuffle; rollups are plain grouped
aggregations whose partial sums combine on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weightloom.functions import vectors as V
from weightloom.functions.quantiles import exact_percentiles, join_groups
from weightloom.functions.scalars import cap_target
from weightloom.operators.projection import feasibility


def weight_map(text) -> Column:
    """JSON text -> map; a nested ``weights`` object is unwrapped."""
    c = F.col(text) if isinstance(text, str) else text
    return F.from_json(F.coalesce(F.get_json_object(c, "$.weights"), c), "map<string,double>")


def aligned(*maps: Column) -> tuple[Column, list[Column]]:
    """Common sorted key list and the vectors over it, absent keys 0."""
    keys = F.array().cast("array<string>")
    for m in maps:
        keys = F.array_union(keys, F.coalesce(F.map_keys(m), F.array().cast("array<string>")))
    keys = F.array_sort(keys)

    def over(m):
        return F.transform(keys, lambda k: F.coalesce(m[k], F.lit(0.0)))

    return keys, [over(m) for m in maps]


def score_calls(df: DataFrame, raw: str, reference: str, cap: float = 0.60, collapse: float = 1e-3) -> DataFrame:
    """The audit row of every call from its raw and reference vectors.

    Adds projected weights, top assets (1-based positions), fidelity, top-3
    overlap, distances, collapse flag and feasibility.
    """
    x = df.withColumn("projected", V.project_capped(F.col(raw), cap))
    x = x.withColumn("target", V.project_capped(F.col(reference), cap))
    r, p, t = F.col(raw), F.col("projected"), F.col("target")
    ew = V.l1(p, V.equal_like(p))
    x = x.withColumns(
        {
            "target_asset": V.first_argmax(t),
            "top_asset_raw": V.first_argmax(r),
            "top_asset_projected": V.first_argmax(p),
            "top3_overlap": V.topk_overlap(p, t, 3),
            "allocation_l1_to_reference": V.l1(p, t),
            "allocation_l2_to_reference": V.l2(p, t),
            "projection_l1": V.l1(r, p),
            "projection_l2": V.l2(r, p),
            "ew_l1_distance": ew,
        }
    )
    x = x.withColumns(
        {
            "raw_fidelity": (F.col("top_asset_raw") == F.col("target_asset")).cast("int"),
            "projected_fidelity": (F.col("top_asset_projected") == F.col("target_asset")).cast("int"),
            "collapse_flag": (F.col("ew_l1_distance") <= collapse).cast("int"),
        }
    )
    return feasibility(x, raw, "projected", cap)


def _avg(pairs: dict[str, str]) -> list[Column]:
    return [F.avg(c).alias(n) for n, c in pairs.items()]


RELIABILITY = {
    "mean_projected_fidelity": "projected_fidelity", "mean_raw_fidelity": "raw_fidelity",
    "mean_top3_overlap": "top3_overlap", "mean_allocation_l1": "allocation_l1_to_reference",
    "mean_projection_l1": "projection_l1", "collapse_rate": "collapse_flag", "json_valid_rate": "json_valid",
    "parse_fail_rate": "parse_fail", "repair_rate": "repair_used", "mean_missing_assets": "missing_asset_count",
    "mean_hallucinated_assets": "hallucinated_asset_count", "mean_latency_sec": "latency_sec",
}
SAFETY = {
    "raw_cap_violation_rate": "raw_cap_violation", "raw_longonly_violation_rate": "raw_longonly_violation",
    "mean_budget_violation": "raw_budget_violation", "post_feasible_budget_rate": "post_feasible_budget",
    "post_feasible_cap_rate": "post_feasible_cap", "post_feasible_longonly_rate": "post_feasible_longonly",
    "mean_projection_l1": "projection_l1", "json_valid_rate": "json_valid", "repair_rate": "repair_used",
    "mean_missing_assets": "missing_asset_count", "mean_hallucinated_assets": "hallucinated_asset_count",
}


def reliability_rollup(calls: DataFrame, keys: list[str]) -> DataFrame:
    """15-measure rollup; the median latency is exact."""
    out = calls.groupBy(*keys).agg(
        F.count("*").alias("n_calls"), F.stddev_samp("projected_fidelity").alias("std_projected_fidelity"), *_avg(RELIABILITY)
    )
    return join_groups(out, exact_percentiles(calls, keys, "latency_sec", {"median_latency_sec": 0.5}), keys, "left")


def safety_rollup(calls: DataFrame, keys: list[str]) -> DataFrame:
    return calls.groupBy(*keys).agg(F.count("*").alias("n_calls"), *_avg(SAFETY))


def fidelity_decomposition(calls: DataFrame) -> DataFrame:
    """By policy, by model and by both, in one pass over grouping sets."""
    m, p = F.col("model_id"), F.col("policy_id")
    g = calls.groupingSets([[p], [m], [m, p]], m, p)
    return g.agg(
        F.when(F.grouping("model_id") == 1, "policy").when(F.grouping("policy_id") == 1, "model")
        .otherwise("model_policy").alias("level"),
        F.count("*").alias("records"), F.sum("projected_fidelity").alias("faithful"),
        F.avg("projected_fidelity").alias("projected_fidelity"), F.avg("json_valid").alias("json_valid"),
        F.avg("allocation_l1_to_reference").alias("allocation_l1"), F.avg("top3_overlap").alias("top3_overlap"),
    )


def aggregation_sensitivity(
    calls: DataFrame, defined: tuple[str, ...] = ("P1", "P2", "P3", "P4", "P5"), control: str = "P4"
) -> DataFrame:
    """Call-weighted against macro averages, with and without the control policy.

    Everything follows from one (sum, count) row per policy.
    """
    g = calls.groupBy("policy_id").agg(
        F.sum("projected_fidelity").alias("s"), F.count("projected_fidelity").alias("c"), F.count("*").alias("n")
    )
    inside, not_control = F.col("policy_id").isin(*defined), F.col("policy_id") != control

    def flat(cond):
        return F.sum(F.when(cond, F.col("s"))) / F.sum(F.when(cond, F.col("c")))

    def macro(cond):
        return F.avg(F.when(cond, F.try_divide("s", "c")))

    def size(cond):
        return F.sum(F.when(cond, F.col("n")).otherwise(0))

    every = F.lit(True)
    rows = [
        ("all", "call-weighted", every, flat(every)),
        ("all_without_control", "call-weighted", not_control, flat(not_control)),
        ("defined", "call-weighted", inside, flat(inside)),
        ("defined", "macro", inside, macro(inside)),
        ("defined_without_control", "macro", inside & not_control, macro(inside & not_control)),
    ]
    packed = [
        F.struct(F.lit(a).alias("scope"), F.lit(b).alias("aggregation"), size(c).alias("records"), v.alias("fidelity"))
        for a, b, c, v in rows
    ]
    return g.agg(F.array(*packed).alias("r")).select(F.inline("r"))


def projection_ablation(calls: DataFrame, raw: str, projected: str, reference: str) -> DataFrame:
    """Raw against projected fidelity and distance, from JSON weight maps."""
    x = calls.withColumns({"_r": weight_map(raw), "_p": weight_map(projected), "_f": weight_map(reference)})
    _, (a, b, c) = aligned(F.col("_r"), F.col("_p"), F.col("_f"))
    x = x.withColumns({"_a": a, "_b": b, "_c": c})
    r, p, f = F.col("_a"), F.col("_b"), F.col("_c")
    top = V.first_argmax
    some = F.size(r) > 0
    flag = lambda cond: F.coalesce((some & cond).cast("int"), F.lit(0))
    return x.withColumns(
        {
            "fidelity_raw": flag(top(r) == top(f)),
            "fidelity_projected": flag(top(p) == top(f)),
            "l1_raw_reference": V.l1(r, f),
            "l1_projected_reference": V.l1(p, f),
            "projection_l1": V.l1(r, p),
            "projection_changed_top": flag(top(r) != top(p)),
        }
    ).drop("_r", "_p", "_f", "_a", "_b", "_c")


def collapse_audit(calls: DataFrame, projected: str, threshold: float = 0.02) -> DataFrame:
    """Equal-weight collapse and its probable cause."""
    x = calls.withColumn("_w", F.map_values(weight_map(projected)))
    w = F.col("_w")
    x = x.withColumn("equal_weight_l1", F.when(F.size(w) > 0, V.l1(w, V.equal_like(w))))
    flat = F.coalesce(F.col("equal_weight_l1") <= threshold, F.lit(False))
    fail, fix = F.coalesce("parse_fail", F.lit(0)), F.coalesce("repair_used", F.lit(0))
    text = F.trim(F.coalesce("raw_output", F.lit("")))
    return x.withColumns(
        {
            "collapse": flat.cast("int"),
            "raw_output_empty": text.isin("", "nan").cast("int"),
            "probable_cause": F.when((fail != 0) | (fix != 0), "parse_or_fallback")
            .when(flat, "model_equalization").otherwise("not_collapsed"),
        }
    ).drop("_w")


def _mean_ranks(v: Column) -> Column:
    """Average-tie ranks: the middle of the first and last place in sorted order."""
    return V.bind(
        F.array_sort(v),
        lambda s: V.bind(
            F.reverse(s),
            lambda d: F.transform(v, lambda x: (F.array_position(s, x) + F.size(s) + 1 - F.array_position(d, x)) / 2.0),
        ),
    )


def spearman(a: Column, b: Column) -> Column:
    """Rank correlation of two vectors; NULL if one of them is constant."""
    flat = (F.size(a) < 2) | (F.array_max(a) - F.array_min(a) <= 1e-12) | (F.array_max(b) - F.array_min(b) <= 1e-12)
    mean = (F.size(a) + 1) / 2.0

    def centred(v):
        return V.bind(mean, lambda m: V.bind(_mean_ranks(v), lambda r: F.transform(r, lambda x: x - m)))

    rho = V.bind(
        centred(a),
        lambda x: V.bind(centred(b), lambda y: F.try_divide(V.dot(x, y), F.sqrt(V.dot(x, x) * V.dot(y, y)))),
    )
    return F.when(~flat, rho)


def semantic_diagnostics(calls: DataFrame, projected: str, reference: str) -> DataFrame:
    """Target hit, top-3 Jaccard, distances and rank correlation per call."""
    p, r = F.col(projected), F.col(reference)
    a, b = V.top_k(p, 3), V.top_k(r, 3)
    shared = F.size(F.array_intersect(a, b))
    return calls.withColumns(
        {
            "target_fidelity": (V.first_argmax(p) == V.first_argmax(r)).cast("double"),
            "top3_shared": shared,
            "top3_jaccard": shared / F.greatest(F.size(F.array_union(a, b)), F.lit(1)),
            "allocation_l1": V.l1(p, r),
            "allocation_l2": V.l2(p, r),
            "equal_weight_l1": V.l1(p, V.equal_like(p)),
            "spearman": spearman(p, r),
        }
    )


def semantic_summary(detail: DataFrame, key: str = "model_id") -> DataFrame:
    """Means and median rank correlation per model, plus the ALL row."""
    both = detail.select("*", F.explode(F.array(F.col(key), F.lit("ALL"))).alias("_k")).drop(key).withColumnRenamed("_k", key)
    names = ("target_fidelity", "top3_jaccard", "allocation_l1", "allocation_l2", "equal_weight_l1", "spearman")
    out = both.groupBy(key).agg(F.count("*").alias("calls"), *[F.avg(c).alias(f"mean_{c}") for c in names])
    return join_groups(out, exact_percentiles(both, [key], "spearman", {"median_spearman": 0.5}), [key], "left")


def condition_summary(calls: DataFrame, copy_flag: str | None = None) -> DataFrame:
    """Condition x model means, with the copy rate where recorded."""
    pairs = {
        "projected_fidelity": "projected_fidelity", "raw_fidelity": "raw_fidelity",
        "mean_allocation_l1": "allocation_l1_to_reference", "json_valid": "json_valid",
        "repair_rate": "repair_used", "mean_latency_sec": "latency_sec",
    }
    if copy_flag:
        pairs["copy_rate"] = copy_flag
    return calls.groupBy("condition_id", "model_id").agg(F.count("*").alias("n"), *_avg(pairs))


def stage_rates(events: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Stage-wise rates; absent measures are tolerated, NULLs are skipped."""
    have = [m for m in measures if m in events.columns]
    return events.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.avg(F.col(m).cast("double")).alias(f"{m}_rate") for m in have]
    )


def threshold_fidelity(calls: DataFrame, raw: str, projected: str, core: str, prompt_cap: Column | float, hard_cap: float) -> DataFrame:
    """Does the intended asset carry its language-level weight, before and after
    projection?  ``core`` is its 1-based position."""
    pc = F.lit(prompt_cap).cast("double") if not isinstance(prompt_cap, Column) else prompt_cap
    rw, pw = F.element_at(raw, F.col(core)), F.element_at(projected, F.col(core))
    x = calls.withColumns({"raw_core_weight": rw, "projected_core_weight": pw, "prompt_cap": pc})
    raw_top = (V.first_argmax(F.col(raw)) == F.col(core)).cast("int")
    post_top = (V.first_argmax(F.col(projected)) == F.col(core)).cast("int")
    raw_hit = (F.col("raw_core_weight") >= F.least(pc, F.lit(1.0)) - 1e-6).cast("int")
    post_hit = (F.col("projected_core_weight") >= F.least(pc, F.lit(hard_cap)) - 1e-6).cast("int")
    return x.withColumns(
        {
            "raw_fidelity": raw_top,
            "projected_fidelity": post_top,
            "fidelity_loss": raw_top - post_top,
            "raw_threshold_fidelity": raw_hit,
            "projected_threshold_fidelity": post_hit,
            "threshold_fidelity_loss": raw_hit - post_hit,
            "raw_threshold_gap": F.col("raw_core_weight") - pc,
            "projected_threshold_gap": F.col("projected_core_weight") - pc,
        }
    )


def latency_table(calls: DataFrame, keys: list[str], value: str = "latency_sec") -> DataFrame:
    """Mean, exact median and exact 95th percentile by key."""
    mean = calls.groupBy(*keys).agg(F.count("*").alias("n_calls"), F.avg(value).alias("mean_latency"))
    return join_groups(mean, exact_percentiles(calls, keys, value, {"median_latency": 0.5, "p95_latency": 0.95}), keys, "left")


def sample_audit(calls: DataFrame, keys: list[str]) -> DataFrame:
    return calls.groupBy(*keys).agg(F.count("*").alias("n"))


def duplicate_audit(calls: DataFrame, keys: list[str], expected: int | None = None) -> DataFrame:
    """One row: sizes, duplicated rows by key, validity rates."""
    g = calls.groupBy(*keys).agg(
        F.count("*").alias("c"), F.sum("json_valid").alias("v"), F.sum("parse_fail").alias("f"), F.sum("repair_used").alias("r")
    )
    n = F.sum("c")
    return g.agg(
        n.alias("rows"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("duplicate_rows"),
        F.count("*").alias("unique_keys"), (F.sum("v") / n).alias("json_valid_rate"),
        F.sum("f").alias("parse_fail_count"), F.sum("r").alias("repair_used_count"),
        *([(n == expected).cast("int").alias("total_matches")] if expected is not None else []),
    )


def cap_target_rollup(calls: DataFrame) -> DataFrame:
    """Language target (60/70/90 %) against realised weights."""
    x = calls.withColumn("language_target", cap_target("conflict_type")).where("language_target IS NOT NULL")
    return x.groupBy("language_target").agg(
        *_avg({"raw_max": "raw_max_weight", "projected_max": "post_max_weight", "projection_l1": "projection_l1",
               "feasible_cap": "post_feasible_cap"})
    )


def paired_condition_gap(calls: DataFrame, keys: list[str], condition: str, base: str, other: str, value: str) -> DataFrame:
    """Mean difference between two conditions per key (wide by aggregation)."""
    pick = lambda c: F.avg(F.when(F.col(condition) == c, F.col(value)))
    return calls.groupBy(*keys).agg(pick(base).alias("base"), pick(other).alias("other")).withColumn(
        "gap", F.col("other") - F.col("base")
    )


def heatmap(calls: DataFrame, row: str, column: str, values: list[str], measure: str) -> DataFrame:
    """Pivot with a fixed column list, so no extra pass discovers it."""
    return calls.groupBy(row).pivot(column, values).agg(F.avg(measure))


def compare_studies(a: DataFrame, b: DataFrame) -> DataFrame:
    """Size, mean fidelities and distinct dates of two studies side by side."""
    def one(df, name):
        return df.agg(
            F.lit(name).alias("study"), F.count("*").alias("n"), F.avg("raw_fidelity").alias("raw_fidelity"),
            F.avg("projected_fidelity").alias("projected_fidelity"), F.countDistinct("decision_date").alias("dates"),
        )
    return one(a, "A").unionByName(one(b, "B"))


def matched_pairs(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """1:1 join with its uniqueness check and per-column agreement counts."""
    def unique(df, side):
        return df.groupBy(*keys).agg(
            F.count("*").alias(f"{side}_rows"), *[F.first(c).alias(f"{side}_{c}") for c in columns]
        )
    j = unique(a, "a").join(unique(b, "b"), keys)
    same = [F.sum((F.col(f"a_{c}") == F.col(f"b_{c}")).cast("int")).alias(f"same_{c}") for c in columns]
    one_to_one = F.sum(((F.col("a_rows") > 1) | (F.col("b_rows") > 1)).cast("int"))
    return j.agg(F.count("*").alias("pairs"), one_to_one.alias("not_one_to_one"), *same)


def assertions(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Data-quality rows (check, status) from aggregate conditions in one pass."""
    packed = [
        F.struct(F.lit(k).alias("check"), F.when(F.coalesce(c, F.lit(False)), "pass").otherwise("fail").alias("status"))
        for k, c in rules.items()
    ]
    return df.agg(F.array(*packed).alias("r")).select(F.inline("r"))


def curve_checks(equity: DataFrame, performance: DataFrame, tolerance: float = 2e-3) -> DataFrame:
    """Structural checks of stitched curves ``(series, dt, equity)``.

    Common date range, duplicates, distinct curves (order-independent digest of
    the rounded points) and endpoint against ``performance(series, cum_return)``.
    A digest per row plus a sum keeps any curve length in constant memory.
    """
    point = F.xxhash64("dt", F.round("equity", 10))
    by_day = equity.groupBy("series", "dt").agg(F.count("*").alias("c"), F.max("equity").alias("equity"), F.sum(point.cast("decimal(38,0)")).alias("h"))
    s = by_day.groupBy("series").agg(
        F.min("dt").alias("lo"), F.max("dt").alias("hi"), F.sum("c").alias("points"), F.count("*").alias("days"),
        F.max_by("equity", "dt").alias("end"), F.sum("h").alias("digest"),
    )
    j = s.join(performance.select("series", "cum_return"), "series", "left")
    off = F.abs(F.col("end") - 1.0 - F.col("cum_return")) > tolerance
    return j.agg(
        F.countDistinct("lo", "hi").alias("date_ranges"), F.sum(F.col("points") - F.col("days")).alias("duplicate_points"),
        F.count("*").alias("series"), F.countDistinct("digest").alias("distinct_curves"),
        F.coalesce(F.sum(off.cast("int")), F.lit(0)).alias("endpoint_mismatches"),
    )


def missing_series(required: DataFrame, present: DataFrame, key: str = "series") -> DataFrame:
    return required.join(present.select(key).distinct(), key, "left_anti")


def pair_validity(diffs: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Validity of paired differences ``(series, diff)``: zero difference, zero
    variance, suggested block length n^(1/3).

    Series of ``expected`` without a common day get a row with n = 0 and the reason.
    """
    a = diffs.groupBy("series").agg(
        F.count("diff").alias("n"), F.avg("diff").alias("mean_diff"), F.stddev_samp("diff").alias("std_diff"),
        F.max(F.abs("diff")).alias("worst"),
    )
    flat = F.col("std_diff").isNull() | F.isnan("std_diff") | (F.col("std_diff") <= 1e-14)
    out = a.select(
        "series", "n", "mean_diff", (F.col("mean_diff") * 252.0).alias("mean_diff_ann"), "std_diff",
        (F.col("worst") <= 1e-14).cast("int").alias("zero_difference"), flat.cast("int").alias("zero_variance"),
        F.greatest(F.lit(2), F.bround(F.pow("n", F.lit(1.0 / 3.0))).cast("int")).alias("block_length"),
        ((F.col("n") >= 10) & ~flat).cast("int").alias("valid"), F.lit(None).cast("string").alias("reason"),
    )
    if expected is None:
        return out
    alone = expected.select("series").distinct().join(out.select("series"), "series", "left_anti")
    nothing = [F.lit({"n": 0, "valid": 0, "reason": "no overlapping returns"}.get(f.name)).cast(f.dataType).alias(f.name) for f in out.schema.fields[1:]]
    return out.unionByName(alone.select("series", *nothing))
