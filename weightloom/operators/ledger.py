"""Holdings valuation and the rebalance ledger.

Between two rebalances a portfolio has a closed form: with weights w executed at
row s and price levels L, its value is V_t = sum_a w_a L_a(t) / L_a(s), the gross
return V_t / V_{t-1} - 1 and the drifted weight w_a L_a(t) / L_a(s) / V_t.  Only
the rebalance-to-rebalance step is recursive (the turnover cap depends on the
drifted weights), so a run is

  marks    price-level vectors per (fold, t)                 Spark windows
  ledger   one short fold per (series, fold, parameters)     aggregate over an array
  daily    value, return and weights of every day            join + one window

Vectors are arrays in universe order: a row holds one universe, a ledger row
one series' rebalances of one fold while they are folded.  Parallelism and data volume come from the
number of series, folds and grid points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weightloom.functions import vectors as V
from weightloom.functions.scalars import asset_cost
from weightloom.operators.projection import turnover_capped
from weightloom.session import fan_out, materialize

#: What the fold carries: the vector held, the levels it was bought at, and the ledger rows so far.
ROW = """struct<seq: int, t: int, w: array<double>, drifted: array<double>, target: array<double>,
turnover_before_cap: double, turnover_after_cap: double, fee: double, gross_before_fee: double, gross_return_before_fee: double>"""
CARRIED = f"struct<held: array<double>, held_lvl: array<double>, rows: array<{ROW}>>"


def fold_rows(grid: DataFrame, folds: DataFrame) -> DataFrame:
    """Panel rows inside the test range of each fold.  The fold table has one row
    per fold, hence the broadcast."""
    f = F.broadcast(folds.select("fold", "test_start", "test_end"))
    return grid.join(f, (F.col("t") >= F.col("test_start")) & (F.col("t") < F.col("test_end")))


def level_vectors(rows: DataFrame) -> DataFrame:
    """(fold, t, dt, test_start, test_end, lvl): price relative to the fold's first price.

    Filling restarts with the fold: before its first price inside the fold an
    asset is worth 1, as its return there counts as 0.
    """
    w = Window.partitionBy("fold", "asset").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    px = F.last("px", ignorenulls=True).over(w)
    base = F.first("px", ignorenulls=True).over(w)
    lvl = F.coalesce(F.try_divide(px, base), F.lit(1.0))
    keys = ["fold", "t", "dt", "test_start", "test_end"]
    marked = rows.select(*keys, "ord", lvl.alias("lvl"))
    packed = marked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "lvl"))).alias("v"))
    return packed.select(*keys, F.transform("v", lambda e: e["lvl"]).alias("lvl"))


def target_vectors(targets: DataFrame) -> DataFrame:
    """(series, t, target) from long targets (series, t, asset, ord, w)."""
    packed = targets.groupBy("series", "t").agg(F.array_sort(F.collect_list(F.struct("ord", "w"))).alias("v"))
    return packed.select("series", "t", F.transform("v", lambda e: e["w"]).alias("target"))


def run_params(grid_points: DataFrame, universe: DataFrame, by_asset_class: bool = False) -> DataFrame:
    """Attach the per-asset cost vector to (run, tcost, rebalance, max_weight, turnover_cap)."""
    mult = asset_cost("asset", 1.0) if by_asset_class else F.lit(1.0)
    row = universe.agg(F.array_sort(F.collect_list(F.struct("ord", mult.alias("m")))).alias("m")).withColumn("_one", F.lit(1))
    p = grid_points.withColumn("_one", F.lit(1)).join(F.broadcast(row), "_one")
    return p.select(
        "run", F.col("rebalance").cast("int"), "max_weight", "turnover_cap",
        F.transform("m", lambda e: e["m"] * F.col("tcost")).alias("cost"),
    )


def _grown(held: Column, lvl: Column, held_lvl: Column) -> Column:
    return F.zip_with(held, F.zip_with(lvl, held_lvl, lambda x, y: F.try_divide(x, y)), lambda w, g: w * g)


def _entry(acc: Column, r: Column) -> Column:
    """The first rebalance: nothing is held before, and the entry is free."""
    none = F.lit(None).cast("double")
    return F.struct(
        F.size(acc["rows"]).alias("seq"), r["t"].alias("t"), r["wanted"].alias("w"), F.transform(r["wanted"], lambda x: F.lit(0.0)).alias("drifted"),
        r["wanted"].alias("target"), none.alias("turnover_before_cap"), none.alias("turnover_after_cap"),
        F.lit(0.0).alias("fee"), F.lit(0.0).alias("gross_before_fee"), F.lit(0.0).alias("gross_return_before_fee"),
    )


def _rebalance(acc: Column, r: Column, cap: Column, tau: Column, cost: Column) -> Column:
    """Drift, project, cap, charge. The cap is measured between projected ends, the cost on drifted weights."""
    def charged(value: Column, drifted: Column, now: Column) -> Column:
        fee = V.total(F.zip_with(F.zip_with(now, drifted, lambda x, y: F.abs(x - y)), cost, lambda d, c: d * F.abs(c)))
        day = F.try_divide(value, V.total(_grown(acc["held"], r["lvl_eve"], acc["held_lvl"]))) - 1.0
        return F.struct(
            F.size(acc["rows"]).alias("seq"), r["t"].alias("t"), now.alias("w"), drifted.alias("drifted"), r["wanted"].alias("target"),
            V.l1(r["wanted"], drifted).alias("turnover_before_cap"), V.l1(now, drifted).alias("turnover_after_cap"),
            V.bind(fee, lambda f: F.when(f > 1e-12, -f).otherwise(0.0)).alias("fee"), (value - 1.0).alias("gross_before_fee"), day.alias("gross_return_before_fee"),
        )

    def moved(value: Column, drifted: Column) -> Column:
        now = V.bind(V.project_capped(drifted, cap), lambda prev: turnover_capped(prev, r["wanted"], tau))
        return V.bind(now, lambda w: charged(value, drifted, w))

    def drift(grown: Column, value: Column) -> Column:
        drifted = F.when(value > 1e-12, F.transform(grown, lambda x: x / value)).otherwise(acc["held"])
        return V.bind(drifted, lambda d: moved(value, d))

    return V.bind(_grown(acc["held"], r["lvl"], acc["held_lvl"]), lambda g: V.bind(V.total(g), lambda value: drift(g, value)))


def walk(steps: Column, cap: Column, tau: Column, cost: Column) -> Column:
    """Ledger rows of one run from its rebalances in time order: structs (t, wanted, lvl, lvl_eve)."""
    start = F.struct(F.lit(None).alias("held"), F.lit(None).alias("held_lvl"), F.array().alias("rows")).cast(CARRIED)

    def step(acc: Column, r: Column) -> Column:
        row = F.when(acc["held"].isNull(), _entry(acc, r)).otherwise(_rebalance(acc, r, cap, tau, cost)).cast(ROW)
        return V.bind(row, lambda x: F.struct(x["w"].alias("held"), r["lvl"].alias("held_lvl"), F.concat(acc["rows"], F.array(x)).alias("rows")).cast(CARRIED))

    return F.aggregate(steps, start, step, lambda acc: acc["rows"])


def rebalance_ledger(decisions: DataFrame, levels: DataFrame, params: DataFrame) -> DataFrame:
    """Executed weights at every rebalance.

    decisions: (series, fold, t, target); levels: from level_vectors; params:
    (run, rebalance, max_weight, turnover_cap, cost array) with one row per grid
    point.  A decision takes part in a run if it falls on the run's schedule (or,
    with a NULL ``rebalance``, always: the decisions are an explicit calendar), so
    one job values a whole sensitivity grid.  ``gross_before_fee`` is the growth
    since the previous rebalance, ``gross_return_before_fee`` that of the day itself.
    """
    eve = levels.select("fold", (F.col("t") + 1).alias("t"), F.col("lvl").alias("lvl_eve"))
    marked = decisions.join(levels, ["fold", "t"]).join(eve, ["fold", "t"], "left")
    p = F.broadcast(params)  # the parameter grid: a few rows by construction
    step = F.greatest(F.coalesce("rebalance", F.lit(1)), F.lit(1))
    runs = marked.join(p, F.col("rebalance").isNull() | ((F.col("t") - F.col("test_start")) % step == 0))
    keys = ["run", "series", "fold"]
    step = F.struct(F.col("t").cast("int").alias("t"), V.project_capped(F.col("target"), F.col("max_weight")).alias("wanted"), "lvl", "lvl_eve")
    need = runs.select(*keys, step.alias("step"), "max_weight", "turnover_cap", "cost")
    # explicit count: a segment expands to one row per day right after this step
    need = need.repartition(fan_out(need.sparkSession), *keys)
    each = need.groupBy(*keys).agg(
        F.array_sort(F.collect_list("step")).alias("steps"), F.first("max_weight").alias("cap"), F.first("turnover_cap").alias("tau"), F.first("cost").alias("cost"))
    rows = walk(F.col("steps"), F.col("cap"), F.col("tau"), F.col("cost"))
    return each.select(*keys, F.inline(rows))


def daily_valuation(ledger: DataFrame, levels: DataFrame) -> DataFrame:
    """(run, series, fold, t, dt, ret, gross, fee, turnover, w) for every day of every run.

    Weights decided at the close of row t earn from t+1 on, so a day belongs to
    the last rebalance strictly before it; a rebalance day closes its segment.
    """
    keys = ["run", "series", "fold"]
    # both are read several times: folds and vectors are made once
    ledger, levels = materialize(ledger, "ledger"), materialize(levels, "levels")
    seg = Window.partitionBy(*keys).orderBy("t")
    spans = ledger.withColumn("next_t", F.lead("t").over(seg)).select(
        *keys, F.col("t").alias("s"), "next_t", F.col("w").alias("w0"), "seq"
    )
    base = levels.select("fold", F.col("t").alias("s"), F.col("lvl").alias("lvl0"), "test_start", "test_end")
    spans = spans.join(base, ["fold", "s"])
    # every segment emits its own days, so the join stays an equality
    last = F.coalesce(F.col("next_t"), F.col("test_end") - 1)
    held = spans.where(last > F.col("s")).select("*", F.explode(F.sequence(F.col("s") + 1, last)).alias("t"))
    d = held.join(levels.select("fold", "t", "dt", "lvl"), ["fold", "t"])
    marks = ledger.select(*keys, "t", F.col("w").alias("w_now"), F.col("fee").alias("fee_now"))
    worth = F.zip_with("w0", F.zip_with("lvl", "lvl0", lambda a, b: F.try_divide(a, b)), lambda w, g: w * g)
    held_days = d.select(*keys, "t", "dt", "s", worth.alias("worth")).withColumn("value", V.total(F.col("worth")))
    held_days = held_days.join(marks, [*keys, "t"], "left").select(
        *keys, "t", "dt", "s", "value", F.coalesce("fee_now", F.lit(0.0)).alias("fee"),
        F.coalesce("w_now", V.scale_to_one(F.col("worth"))).alias("w"),
    )
    # up to the first rebalance nothing is held; the entry itself is free
    first = ledger.where("seq = 0").select(*keys, F.col("t").alias("e"), F.col("w").alias("w_now"))
    idle = levels.select("fold", "t", "dt").join(first, "fold").where("t <= e").select(
        *keys, "t", "dt", F.lit(None).cast("int").alias("s"), F.lit(None).cast("double").alias("value"),
        F.lit(0.0).alias("fee"),
        F.when(F.col("t") == F.col("e"), F.col("w_now"))
        .otherwise(F.transform("w_now", lambda x: F.lit(0.0))).alias("w"),
    )
    chain = Window.partitionBy(*keys).orderBy("t")
    before = F.when(F.lag("s").over(chain) == F.col("s"), F.lag("value").over(chain))
    gross = F.coalesce(F.try_divide("value", F.coalesce(before, F.lit(1.0))) - 1.0, F.lit(0.0))
    x = idle.unionByName(held_days).withColumns({"gross": gross, "_prev": F.lag("w").over(chain)})
    moved = F.coalesce(V.l1(F.col("w"), F.col("_prev")), F.lit(0.0))
    return x.select(
        *keys, "t", "dt", (F.col("gross") + F.col("fee")).alias("ret"), "gross", "fee", moved.alias("turnover"), "w"
    )


def rebalance_diagnostics(ledger: DataFrame, cal: DataFrame, params: DataFrame, folds: DataFrame) -> DataFrame:
    """One diagnostic row per rebalance.  ``effective_from`` is the next day of the
    fold, ``END`` where the fold has none."""
    p = F.broadcast(params.select("run", "max_weight", F.col("turnover_cap").alias("turnover_cap")))
    c = cal.select("t", F.col("dt").alias("decision_date"), F.lead("dt").over(Window.orderBy("t")).alias("effective_from"))
    w, tgt = F.col("w"), F.col("target")
    ends = F.broadcast(folds.select("fold", "test_end"))  # one row per fold
    inside = F.col("t") + 1 < F.col("test_end")
    return ledger.join(p, "run").join(F.broadcast(c), "t").join(ends, "fold").select(
        "run", "series", "fold", "seq", "decision_date",
        F.when(inside & F.col("effective_from").isNotNull(), F.col("effective_from").cast("string")).otherwise("END").alias("effective_from"),
        F.lit(1).alias("execution_lag_days"), F.lit(0).alias("uses_same_day_return"), F.lit(1).alias("weight_drift_applied"),
        "turnover_before_cap", "turnover_after_cap",
        V.l1(tgt, w).alias("projection_l1_target_to_final"),
        V.l2(tgt, w).alias("projection_l2_target_to_final"),
        F.array_max(w).alias("max_weight_final"), V.total(w).alias("sum_weight_final"), F.array_min(w).alias("min_weight_final"),
        (F.abs(V.total(w) - 1.0) <= 1e-6).cast("int").alias("feasible_budget"),
        (F.array_min(w) >= -1e-10).cast("int").alias("feasible_nonnegative"),
        (F.array_max(w) <= F.col("max_weight") + 1e-8).cast("int").alias("feasible_cap"),
        "turnover_cap", F.col("max_weight").alias("max_weight_cap"), "fee", "gross_return_before_fee",
    )


def tidy_equity(daily: DataFrame, universe_name: str = "NA") -> DataFrame:
    """Fold overlays and stitched curves in one table."""
    r = F.coalesce("ret", F.lit(0.0))
    fold_w = Window.partitionBy("run", "series", "fold").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    all_w = Window.partitionBy("run", "series").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    cols = ["run", "series", "dt"]
    overlay = daily.select(*cols, "fold", F.lit("fold_oos").alias("segment"), F.product(1.0 + r).over(fold_w).alias("equity"))
    stitched = daily.select(
        *cols, F.lit(0).alias("fold"), F.lit("stitched_oos").alias("segment"), F.product(1.0 + r).over(all_w).alias("equity")
    )
    return overlay.unionByName(stitched).withColumns({"is_oos": F.lit(1), "universe": F.lit(universe_name)})
