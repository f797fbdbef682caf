"""Decision calendars, folds and stress windows, as small tables keyed by ``t``."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weightloom.functions.draws import shuffle_rank_key


def split_point(n, ratio: float = 0.7):
    """Holdout split, rounding half to even like the usual float rounding."""
    n = F.col(n) if isinstance(n, str) else n
    return F.greatest(F.lit(1), F.least(n - 1, F.bround(n * F.lit(ratio)).cast("int")))


def decision_dates(cal: DataFrame, every: int = 42, warmup: int = 252, first: int | None = None) -> DataFrame:
    """Every ``every``-th row from row ``warmup`` on; ``first`` keeps the earliest."""
    start = F.least(F.lit(warmup), F.greatest(F.lit(0), F.col("n_dates") - 1))
    out = cal.where((F.col("t") >= start) & ((F.col("t") - start) % max(int(every), 1) == 0))
    out = out.withColumn("decision", ((F.col("t") - start) / every).cast("int"))
    return out if first is None else out.where(F.col("decision") < first)


def regime_sample(decisions: DataFrame, cross_vol: DataFrame, per_regime: int, seed: int = 42) -> DataFrame:
    """Terciles of cross_vol over the calendar; at most n dates of each, by a
    seeded permutation."""
    d = decisions.join(cross_vol, "t")
    cut = d.agg(F.percentile("cross_vol", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"))
    d = d.join(F.broadcast(cut))  # one row
    regime = (
        F.when(F.col("cross_vol") <= F.col("q")[0], "low")
        .when(F.col("cross_vol") <= F.col("q")[1], "mid")
        .otherwise("high")
    )
    d = d.withColumn("regime", regime).drop("q")
    order = Window.partitionBy("regime").orderBy(shuffle_rank_key(seed, F.col("t")), "t")
    return d.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_regime).drop("_k")


def folds(cal: DataFrame, train: int, test: int, rolling: bool = False) -> DataFrame:
    """Walk-forward folds (fold, train_start, train_end, test_start, test_end).

    The last fold is clipped; a fold of fewer than two rows is not opened.
    """
    n = cal.agg(F.max("n_dates").alias("n"))
    starts = n.where(F.col("n") - 2 >= train).select(
        "n", F.posexplode(F.sequence(F.lit(train), F.col("n") - 2, F.lit(test))).alias("k", "test_start")
    )
    return starts.select(
        (F.col("k") + 1).alias("fold"),
        (F.greatest(F.lit(0), F.col("test_start") - train) if rolling else F.lit(0)).alias("train_start"),
        F.col("test_start").alias("train_end"),
        "test_start",
        F.least(F.col("n"), F.col("test_start") + test).alias("test_end"),
    ).where("test_end - test_start >= 2")


def adaptive_folds(cal: DataFrame, rebalance: int = 42) -> DataFrame:
    """Expanding folds whose length follows the history length."""
    n = F.col("n")
    min_test = max(21, rebalance)
    floor_ = max(126, 3 * rebalance)
    base = F.greatest(F.lit(floor_), F.least(F.lit(252), F.floor(n * 0.70).cast("int")))
    relaxed = F.greatest(F.lit(floor_), F.floor(n * 0.50).cast("int"))
    train = F.when(n <= base + min_test, relaxed).otherwise(base)
    p = cal.agg(F.max("n_dates").alias("n")).withColumn("train", train)
    p = p.where(n > F.col("train") + min_test).withColumn("oos", n - F.col("train"))
    p = p.withColumn("k", F.greatest(F.lit(2), F.least(F.lit(5), F.floor(F.col("oos") / min_test).cast("int"))))
    p = p.withColumn("step", F.greatest(F.lit(min_test), F.floor(F.col("oos") / F.col("k")).cast("int")))
    p = p.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
    start = F.col("train") + F.col("i") * F.col("step")
    p = p.select(
        F.lit(0).alias("train_start"), start.alias("train_end"), start.alias("test_start"),
        F.least(start + F.col("step"), n).alias("test_end"),
    ).where(F.col("test_end") - F.col("test_start") >= min_test)
    return p.select(F.row_number().over(Window.orderBy("test_start")).alias("fold"), "*")


def rows_in_folds(rows: DataFrame, fold_table: DataFrame) -> DataFrame:
    """Assign calendar rows to test ranges [test_start, test_end)."""
    f = F.broadcast(fold_table.select("fold", "test_start", "test_end"))  # one row per fold
    return rows.join(f, (F.col("t") >= F.col("test_start")) & (F.col("t") < F.col("test_end")))


def evenly_spaced(fold_table: DataFrame, cal: DataFrame, rebalance: int, n_dates: int) -> DataFrame:
    """n dates spread evenly over all rebalance positions of the folds."""
    cand = fold_table.select(
        "fold", "train_start", "train_end",
        F.explode(F.sequence(F.col("test_start"), F.col("test_end") - 1, F.lit(rebalance))).alias("t"),
    )
    ix = Window.orderBy("t")
    cand = cand.withColumn("i", F.row_number().over(ix) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    step = (F.col("n") - 1) / F.lit(float(max(n_dates - 1, 1)))
    want = F.transform(F.sequence(F.lit(0), F.lit(n_dates - 1)), lambda k: F.floor(k * step).cast("int"))
    return (
        cand.where((F.col("n") >= n_dates) & F.array_contains(want, F.col("i")))
        .join(cal.select("t", "dt"), "t")
        .select("fold", F.col("t").alias("position"), F.col("dt").alias("decision_date"), "train_start", "train_end")
    )


def rebalance_flags(rows: DataFrame, every: int, start: str = "test_start") -> DataFrame:
    """Schedule flag: every k-th row of the range, counted from its first row."""
    step = max(int(every), 1)
    return rows.withColumn("is_rebalance", ((F.col("t") - F.col(start)) % step == 0).cast("int"))


def warm_start(folds: DataFrame, lookback: int) -> DataFrame:
    """Folds whose first one starts behind the warm-up, if it would start with the first row.

    A run from row 0 has no history to look back on; later folds see the whole panel before them.
    """
    start = F.when(F.col("test_start") == 0, F.least(F.col("test_end"), F.lit(max(0, lookback)))).otherwise(F.col("test_start"))
    return folds.withColumn("test_start", start)


def period_table(spark: SparkSession, periods: dict[str, tuple[str, str]]) -> DataFrame:
    """(period, period_start, period_end), inclusive at both ends; may overlap."""
    rows = [(k, a, b) for k, (a, b) in periods.items()]
    return spark.createDataFrame(rows, "period string, s string, e string").select(
        "period", F.to_date("s").alias("period_start"), F.to_date("e").alias("period_end")
    )


def in_periods(rows: DataFrame, periods: DataFrame) -> DataFrame:
    """Overlapping stress windows: a row may match several.  The period side is a
    handful of literal rows, hence broadcast."""
    p = F.broadcast(periods)
    return rows.join(p, (F.col("dt") >= F.col("period_start")) & (F.col("dt") <= F.col("period_end")))


# ---- fixed values: named stress periods ------------------------------------
STRESS_PERIODS = {
    "COVID_crash_2020": ("2020-02-01", "2020-06-30"),
    "Inflation_rate_shock_2022": ("2022-01-01", "2022-12-31"),
    "High_rate_regime_2022_2023": ("2022-01-01", "2023-12-31"),
    "AI_tech_led_regime_2023_2025": ("2023-01-01", "2025-12-29"),
}
# ----------------------------------------------------------------------------


def sensitivity_grid(spark: SparkSession, base: dict, axes: dict[str, list[float]]) -> DataFrame:
    """One-at-a-time parameter grid: (axis, value, tcost, max_weight, turnover_cap, rebalance)."""
    rows = []
    for axis, values in axes.items():
        for v in values:
            p = {**base, axis: v}
            rows.append((axis, float(v), float(p["tcost"]), float(p["max_weight"]), float(p["turnover_cap"]), int(p["rebalance"])))
    return spark.createDataFrame(
        rows, "axis string, value double, tcost double, max_weight double, turnover_cap double, rebalance int"
    )
