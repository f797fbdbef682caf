"""Price panels: calendar, dense grid, rolling features, audits.

A price table is long and may be sparse: ``asset, ord, dt, px``.  ``ord`` is the
position of the asset in its universe and decides every tie.  Time arithmetic is
in rows of the trading calendar, so ``t`` is the calendar position from 0.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weightloom.functions.scalars import finite

YEAR = 252
ROLL = {"r1m": 21, "r3m": 63, "r12m": 252}
FEATURES = ("r1m", "r3m", "r12m", "vol3m", "mdd")


def by_asset():
    return Window.partitionBy("asset").orderBy("t")


def so_far():
    return by_asset().rowsBetween(Window.unboundedPreceding, 0)


def calendar(prices: DataFrame) -> DataFrame:
    """(dt, t, n_dates) over the dates with at least one price.

    The unpartitioned window sees only the distinct dates, a table bounded by
    the length of the trading history.
    """
    days = prices.where(finite("px").isNotNull()).select("dt").distinct()
    every = Window.partitionBy()
    return days.select(
        "dt",
        (F.row_number().over(Window.orderBy("dt")) - 1).alias("t"),
        F.count("*").over(every).cast("int").alias("n_dates"),
    )


def panel_grid(prices: DataFrame, cal: DataFrame | None = None) -> DataFrame:
    """Every (asset, calendar date) once, with raw and forward-filled price.

    Each observed price emits the rows up to the next observation, which fills
    forward without a calendar-by-universe join.  Leading rows, before the first
    price of an asset, carry NULL.  Columns: asset, ord, t, dt, n_dates, px
    (NULL where unobserved), px_ff, and r (0 on unobserved days) if supplied.

    The calendar (one row per trading day, so bounded by the history length and
    not by the universe) is broadcast; the panel itself keeps its partitioning
    by asset through every later per-asset window.
    """
    cal = F.broadcast(calendar(prices) if cal is None else cal)
    seen = prices.withColumn("px", finite("px")).where("px IS NOT NULL").join(cal, "dt")
    first = F.lag("t").over(by_asset()).isNull()
    nxt = F.lead("t").over(by_asset())
    spans = seen.select(
        *[c for c in seen.columns if c not in ("dt", "t")],
        F.col("t").alias("at"),
        F.when(first, 0).otherwise(F.col("t")).alias("lo"),
        (F.coalesce(nxt, F.col("n_dates")) - 1).alias("hi"),
    )
    dense = spans.select("*", F.explode(F.sequence("lo", "hi")).alias("t"))
    here = F.col("t") == F.col("at")
    out = [
        "asset", "ord", "t", "n_dates",
        F.when(here, F.col("px")).alias("px"),
        F.when(F.col("t") >= F.col("at"), F.col("px")).alias("px_ff"),
    ]
    if "r" in prices.columns:
        out.append(F.when(here, F.col("r")).otherwise(0.0).alias("r"))
    return dense.select(*out).join(cal.select("t", "dt"), "t")


def simple_returns(grid: DataFrame, zero_fill: bool = False) -> DataFrame:
    """``ret`` = px_ff[t] / px_ff[t-1] - 1; infinities NULL, optionally 0."""
    ret = finite(F.try_divide("px_ff", F.lag("px_ff").over(by_asset())) - 1.0)
    return grid.withColumn("ret", F.coalesce(ret, F.lit(0.0)) if zero_fill else ret)


def rolling_features(grid: DataFrame, fill: bool = True) -> DataFrame:
    """r1m, r3m, r12m, vol3m, mdd per asset and cross_vol per date.

    A rolling product of 1 + return is NULL as soon as one return in the frame
    is, so a full frame telescopes to a price ratio L rows apart: a lag instead
    of a 252-row frame.  The running count of valid returns is the guard.
    """
    g = simple_returns(grid)
    valid = F.count("ret").over(so_far())
    g = g.withColumn("_valid", valid)
    cols = {}
    for name, rows in ROLL.items():
        whole = (F.col("_valid") - F.lag("_valid", rows).over(by_asset())) == rows
        cols[name] = F.when(whole, F.try_divide("px_ff", F.lag("px_ff", rows).over(by_asset())) - 1.0)
    w63 = by_asset().rowsBetween(-62, 0)
    cols["vol3m"] = F.when(
        F.count("ret").over(w63) >= 21, F.stddev_samp("ret").over(w63) * F.lit(math.sqrt(YEAR))
    )
    cols["mdd"] = finite(F.try_divide("px", F.max("px").over(so_far())) - 1.0)
    g = g.withColumns(cols).drop("_valid")
    # one row per date comes back by broadcast; the wide table is not reshuffled
    per_date = g.groupBy("t").agg(F.avg("vol3m").alias("cross_vol"))
    g = g.join(F.broadcast(per_date), "t")
    return carry_forward(g) if fill else g


def carry_forward(feats: DataFrame) -> DataFrame:
    """Residual fill: last known value per asset (never from the future), then 0."""
    cols = {
        c: F.coalesce(F.last(c, ignorenulls=True).over(so_far()), F.lit(0.0))
        for c in (*FEATURES, "cross_vol")
    }
    return feats.withColumns(cols)


def price_audit(grid: DataFrame) -> DataFrame:
    """First and last valid date, missing rate and observation count per asset."""
    seen = F.col("px").isNotNull()
    return grid.groupBy("asset").agg(
        F.min(F.when(seen, F.col("dt"))).alias("first_valid"),
        F.max(F.when(seen, F.col("dt"))).alias("last_valid"),
        F.avg(F.when(seen, 0.0).otherwise(1.0)).alias("missing_rate"),
        F.count("px").alias("n_obs"),
    )


def with_provenance(audit: DataFrame, **tags: str) -> DataFrame:
    return audit.withColumns({k: F.lit(v) for k, v in tags.items()})


def describe_returns(returns: DataFrame, key: str = "asset", value: str = "ret") -> DataFrame:
    """count, mean, std, min, quartiles, max, bias-corrected skew and kurtosis.

    Spark's skewness and kurtosis are population forms; the sample corrections
    are applied on top.
    """
    x = F.col(value)
    agg = returns.groupBy(key).agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
        F.max(x).alias("max"),
        F.skewness(x).alias("g1"),
        F.kurtosis(x).alias("g2"),
    )
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1"))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6.0))
    return agg.select(
        key, "n", "mean", "std", "min",
        F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"),
        "max", skew.alias("skew"), kurt.alias("kurt"),
    )


def clip_dates(prices: DataFrame, start: str, end: str, assets: list[str] | None = None) -> DataFrame:
    """Half-open date range [start, end); both predicates reach the scan."""
    out = prices.where((F.col("dt") >= F.lit(start).cast("date")) & (F.col("dt") < F.lit(end).cast("date")))
    return out.where(F.col("asset").isin(*assets)) if assets else out


def swap_feature(feats: DataFrame, swaps: DataFrame, feature: str = "vol3m") -> DataFrame:
    """Counterfactual: on given dates exchange one feature between two assets.

    ``swaps`` is (t, asset_a, asset_b).  Adds ``original`` and the verification
    flag ``moved``: the minimum of the date now sits on asset_b.
    """
    per_date = Window.partitionBy("t")
    j = feats.join(swaps, "t")
    a_val = F.max(F.when(F.col("asset") == F.col("asset_a"), F.col(feature))).over(per_date)
    b_val = F.max(F.when(F.col("asset") == F.col("asset_b"), F.col(feature))).over(per_date)
    j = j.withColumns({"_a": a_val, "_b": b_val, "original": F.col(feature)})
    j = j.withColumn(
        feature,
        F.when(F.col("asset") == F.col("asset_a"), F.col("_b"))
        .when(F.col("asset") == F.col("asset_b"), F.col("_a"))
        .otherwise(F.col(feature)),
    )
    best = F.min_by("asset", F.struct(feature, "ord")).over(per_date)
    return j.withColumn("moved", (best == F.col("asset_b")).cast("int")).drop("_a", "_b")
