"""Performance metrics of return series ``(series, t|dt, ret)``.

Every definition is one running product per series plus one aggregation.  A
series has at most one row per trading day, whatever the size of its sources.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weightloom.functions.scalars import finite, series_group, series_model, series_persona

YEAR = 252.0


def _curve(returns: DataFrame, keys: list[str], order: str) -> DataFrame:
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    r = returns.where(F.col("ret").isNotNull())
    r = r.withColumn("eq", F.product(1.0 + F.col("ret")).over(so_far))
    return r.withColumn("dd", F.try_divide("eq", F.max("eq").over(so_far)) - 1.0)


def _ratio(mean: Column, sd: Column, otherwise, floor: float = 0.0) -> Column:
    return F.when(sd > floor, F.try_divide(math.sqrt(YEAR) * mean, sd)).otherwise(otherwise)


def summary(returns: DataFrame, keys: list[str], order: str = "t") -> DataFrame:
    """CAGR, Sharpe, Sortino, volatility, drawdown, Calmar, terminal value.

    The growth rate divides by the first equity value, so the first return does
    not count, while years are n/252; zero variance gives a ratio of 0; Calmar
    is infinite without drawdown.  A daily ``turnover`` column, 0 on the first
    day, gives the average turnover in the same pass.
    """
    c = _curve(returns, keys, order)
    extra = [F.avg("turnover").alias("avg_turnover")] if "turnover" in returns.columns else []
    neg = F.least("ret", F.lit(0.0))
    a = c.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("ret").alias("mu"),
        F.stddev_samp("ret").alias("sd"),
        F.stddev_samp(neg).alias("dsd"),
        F.min("dd").alias("mdd"),
        F.min_by("eq", order).alias("eq0"),
        F.max_by("eq", order).alias("eq1"),
        *extra,
    )
    total = F.when(F.col("eq0") != 0, F.try_divide("eq1", "eq0")).otherwise(0.0)
    years = F.greatest(F.col("n") / YEAR, F.lit(1e-9))
    cagr = F.when(total > 0, F.pow(total, 1.0 / years) - 1.0).otherwise(0.0)
    return a.withColumn("cagr", cagr).select(
        *keys, "n", "cagr",
        _ratio(F.col("mu"), F.col("sd"), 0.0).alias("sharpe"),
        _ratio(F.col("mu"), F.col("dsd"), 0.0).alias("sortino"),
        (F.col("sd") * math.sqrt(YEAR)).alias("vol"),
        "mdd",
        F.when(F.col("mdd") < 0, F.try_divide(F.col("cagr"), F.abs("mdd"))).otherwise(F.lit(float("inf"))).alias("calmar"),
        F.col("eq1").alias("terminal"),
        *(["avg_turnover"] if extra else []),
    )


def fold_summary(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics per fold and for the stitched run ("ALL") in one pass.

    Every day counts once for its fold and once for ALL; the ALL turnover is the
    mean of the fold means.
    """
    day = daily.drop("w").select("*", F.explode(F.array(F.col("fold").cast("string"), F.lit("ALL"))).alias("scope"))
    out = summary(day.drop("fold"), [*keys, "scope"])
    mean_of_folds = F.avg(F.when(F.col("scope") != "ALL", F.col("avg_turnover"))).over(Window.partitionBy(*keys))
    return out.withColumn("avg_turnover", F.when(F.col("scope") == "ALL", mean_of_folds).otherwise(F.col("avg_turnover")))


def whole_sample(returns: DataFrame, keys: list[str], order: str = "t") -> DataFrame:
    """Second definition: all returns enter; NULL where it is undefined."""
    a = _curve(returns, keys, order).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("ret").alias("mu"), F.stddev_samp("ret").alias("sd"),
        F.min("dd").alias("mdd"), F.min("ret").alias("worst"), F.max_by("eq", order).alias("eq1"),
    )
    some = F.col("n") >= 2
    return a.select(
        *keys, "n",
        F.when(some & (F.col("worst") > -1), F.pow("eq1", YEAR / F.col("n")) - 1.0).alias("ann_return"),
        F.when(some, F.col("sd") * math.sqrt(YEAR)).alias("ann_vol"),
        F.when(some, _ratio(F.col("mu"), F.col("sd"), None)).alias("sharpe"),
        F.when(some, F.col("mdd")).alias("mdd"),
    )


def stress_performance(returns: DataFrame, keys: list[str], order: str = "t") -> DataFrame:
    """Third definition, used per stress window: n_days and cumulative return."""
    down = F.when(F.col("ret") < 0, F.col("ret")).otherwise(0.0)
    a = _curve(returns, keys, order).groupBy(*keys).agg(
        F.count("*").alias("n_days"), F.avg("ret").alias("mu"), F.stddev_samp("ret").alias("sd"),
        F.stddev_samp(down).alias("dsd"), F.min("dd").alias("mdd"), F.max_by("eq", order).alias("eq1"),
    )
    n = F.col("n_days")
    return a.select(
        *keys, "n_days",
        F.when(n > 1, _ratio(F.col("mu"), F.col("sd"), None, 1e-12)).alias("sharpe"),
        F.when(n > 1, _ratio(F.col("mu"), F.col("dsd"), None, 1e-12)).alias("sortino"),
        F.when(F.col("eq1") > 0, F.pow("eq1", YEAR / n) - 1.0).alias("cagr"),
        F.when(n > 1, F.col("sd") * math.sqrt(YEAR)).otherwise(0.0).alias("vol"),
        "mdd",
        (F.col("eq1") - 1.0).alias("cum_return"),
    )


def robust_returns(returns: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulative and annualised return with unusable days counted as 0 %."""
    a = returns.withColumn("_r", F.coalesce(finite("ret"), F.lit(0.0))).groupBy(*keys).agg(
        F.product(1.0 + F.col("_r")).alias("total"), F.count("*").alias("n")
    )
    return a.select(
        *keys,
        (F.col("total") - 1.0).alias("cum_return"),
        F.when(F.col("total") > 0, F.pow("total", YEAR / F.col("n")) - 1.0).alias("ann_return"),
    )


def turnover_by_day(weights: DataFrame, keys: list[str], order: str = "t") -> DataFrame:
    """(keys, order, turnover): sum of absolute weight changes, 0 on the first day.

    ``weights`` holds one array per day in universe order.
    """
    prev = F.lag("w").over(Window.partitionBy(*keys).orderBy(order))
    change = F.aggregate(
        F.zip_with("w", prev, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))
    )
    return weights.select(*keys, order, F.when(prev.isNull(), 0.0).otherwise(change).alias("turnover"))


def metrics_table(summary_rows: DataFrame, robust: DataFrame, keys: list[str]) -> DataFrame:
    """Main comparison table, best Sharpe first."""
    return summary_rows.join(robust, keys).orderBy(F.desc("sharpe"), *keys)


def with_series_parts(df: DataFrame, col: str = "series") -> DataFrame:
    return df.withColumns(
        {"method_group": series_group(col), "model": series_model(col), "persona": series_persona(col)}
    )


def returns_from_equity(equity: DataFrame, key: str = "series", order: str = "dt") -> DataFrame:
    """Daily returns recovered from stitched equity; the first day has none."""
    w = Window.partitionBy(key).orderBy(order)
    r = equity.withColumn("ret", F.try_divide("equity", F.lag("equity").over(w)) - 1.0)
    return r.where(F.col("ret").isNotNull())


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their multiplicity."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def display_rows(summary_rows: DataFrame) -> DataFrame:
    """Report names: CUM = terminal - 1, ANN = growth rate, TO = turnover."""
    return summary_rows.select(
        F.col("series").alias("name"), "sharpe", "sortino", "vol", "cagr", "mdd",
        (F.col("terminal") - 1.0).alias("cum"), F.col("cagr").alias("ann"), F.col("avg_turnover").alias("to"),
    )


def model_report(summary_rows: DataFrame, model: str, benchmarks: list[str]) -> DataFrame:
    """All policies of one model, then the selected benchmarks."""
    parts = with_series_parts(summary_rows)
    mine = (F.col("method_group") == "Policy") & (F.col("model") == model)
    kept = parts.where(mine | F.col("series").isin(*benchmarks))
    return kept.withColumn("section", F.when(F.col("method_group") == "Policy", 0).otherwise(1)).orderBy("section", "series")


def select_series(table: DataFrame, names: DataFrame, col: str = "series") -> DataFrame:
    """Comparison subset: only the listed series."""
    return table.join(names, col, "left_semi")
