"""Rolling second moments per decision date and the rules built on them.

The moments of all decisions come from one pass. Days are cut into blocks of ``lookback``
days; within its block, a day gets the sums up to itself and the sums behind itself. The
window that ends on a day is the sum up to it plus what lay behind the day one block
earlier: two disjoint parts, so nothing is subtracted and a far outlier leaves no trace.
A row of the pair table is one product of one day, keyed by the pair, so a wide universe
spreads over its pairs. Returns are centred on the asset's own median first.

Covariance, shrinkage, distances and the diagonal rules are column expressions over these
sums. Only the rules that invert a matrix take it, p x p, into a group per decision.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weightloom.functions import vectors as V
from weightloom.operators.panel import simple_returns
from weightloom.operators.rules import register, register_family
from weightloom.session import materialize

RIDGE = 1e-6
MIN_OBS = 60


def return_vectors(grid: DataFrame, centre: bool = False) -> DataFrame:
    """(t, r): zero-filled daily returns of the universe as one array, less the asset's median if ``centre``."""
    g = grid.withColumn("ret", F.coalesce("ret", F.lit(0.0))) if "ret" in grid.columns else simple_returns(grid, zero_fill=True)
    if centre:
        g = g.withColumn("ret", F.col("ret") - F.median("ret").over(Window.partitionBy("ord")))
    packed = g.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("ord", "ret"))).alias("v"))
    return packed.select("t", F.transform("v", lambda e: e["ret"]).alias("r"))


def window_sums(rows: DataFrame, keys: list[str], values: list[str], lookback: int) -> DataFrame:
    """(keys, t, values): sums of the ``lookback`` days before each t, for keys with a row on every day.

    The first t of a result row is ``lookback``.
    """
    block = [*keys, "_block"]
    upto = Window.partitionBy(*block).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*block).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys).orderBy("_block", "t")  # the order that ``upto`` left
    x = rows.withColumn("_block", F.floor(F.col("t") / lookback))
    x = x.withColumns({f"_b_{v}": F.sum(v).over(behind) for v in values})
    x = x.withColumns({f"_u_{v}": F.sum(v).over(upto) for v in values})
    both = [(F.col(f"_u_{v}") + F.coalesce(F.lag(f"_b_{v}", lookback).over(whole), F.lit(0.0))).alias(v) for v in values]
    return x.select(*keys, (F.col("t") + 1).cast("int").alias("t"), *both).where(F.col("t") >= lookback)


@dataclass
class Moments:
    """Window sums of every decision with a full history, written once.

    ``pairs``: (t, i, j, p, sxy, sx, sy) for i <= j, 1-based; ``lone``: (t, i, sx, az, a, a2) with
    a = |z|^2 of the day's centred vector z.
    """

    lookback: int
    pairs: DataFrame
    lone: DataFrame


def moments(grid: DataFrame, decisions: DataFrame, lookback: int = 60) -> Moments:
    at = decisions.select("t").distinct()
    r = return_vectors(grid, centre=True)
    first = r.select("t", "r", F.size("r").alias("p"), F.explode(F.sequence(F.lit(1), F.size("r"))).alias("i"))
    others = F.slice("r", F.col("i"), F.col("p") - F.col("i") + 1)
    pairs = first.select("t", "p", "i", F.get("r", F.col("i") - 1).alias("x"), F.posexplode(others).alias("k", "y"))
    pairs = pairs.select("t", "p", "i", (F.col("i") + F.col("k")).alias("j"), (F.col("x") * F.col("y")).alias("sxy"))
    z = r.select("t", F.posexplode("r").alias("k", "sx"), V.dot(F.col("r"), F.col("r")).alias("a"))
    z = z.select("t", (F.col("k") + 1).alias("i"), "sx", (F.col("a") * F.col("sx")).alias("az"), "a", (F.col("a") * F.col("a")).alias("a2"))
    lone = materialize(window_sums(z, ["i"], ["sx", "az", "a", "a2"], lookback).join(at, "t"), "moments-of-one")
    both = window_sums(pairs, ["i", "j", "p"], ["sxy"], lookback).join(at, "t")
    both = both.join(lone.select("t", "i", "sx"), ["t", "i"]).join(lone.select("t", F.col("i").alias("j"), F.col("sx").alias("sy")), ["t", "j"])
    return Moments(lookback, materialize(both, "moments-of-two"), lone)


def comoment(n: int) -> Column:
    """Sum of products of the deviations from the window's means."""
    return F.col("sxy") - F.col("sx") * F.col("sy") / float(n)


def shrinkage(m: Moments) -> DataFrame:
    """(t, share, target) of the Ledoit-Wolf shrinkage towards a scaled identity (published closed form).

    With deviations x_t from the window's means, S = X'X/n and m = tr(S)/p, the squared
    distance of S to mI is d2 and the averaged squared distance of x_t x_t' to S is b2.
    sum |x_t|^4 is expanded into window sums of a_t = |z_t|^2, a_t^2, a_t z_t and z_t z_t'
    of the centred returns z.
    """
    n = float(m.lookback)
    both = m.pairs.join(m.lone.drop("sx").withColumn("j", F.col("i")), ["t", "i", "j"], "left")
    twice, diagonal = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0), F.col("i") == F.col("j")
    s, mx, my = comoment(m.lookback) / n, F.col("sx") / n, F.col("sy") / n
    a = both.groupBy("t").agg(
        F.first("p").cast("double").alias("p"), F.sum(F.when(diagonal, s)).alias("tr"), F.sum(twice * s * s).alias("fro"),
        F.sum(twice * mx * my * F.col("sxy")).alias("quad"), F.sum(F.when(diagonal, mx * mx)).alias("mm"),
        F.sum(mx * F.col("az")).alias("maz"), F.max("a").alias("a"), F.max("a2").alias("a2"),
    )
    fourth = F.col("a2") + 4 * F.col("quad") - 4 * F.col("maz") + 2 * F.col("mm") * F.col("a") - 3 * n * F.col("mm") * F.col("mm")
    p, mean = F.col("p"), F.col("tr") / F.col("p")
    d2 = (F.col("fro") - p * mean * mean) / p
    b2 = (fourth / n - F.col("fro")) / (p * n)
    share = F.when(d2 <= 0, 0.0).otherwise(F.least(F.greatest(b2, F.lit(0.0)), d2) / d2)
    return a.select("t", share.alias("share"), mean.alias("target"))


def estimate(m: Moments, method: str = "sample") -> DataFrame:
    """(t, i, j, cov) for i <= j, 1-based positions in the universe.

    ``sample``: divisor n - 1. ``shrunk``: divisor n, shrunk towards a scaled identity.
    ``ridge``: the shrunk form plus a ridge; windows below ``MIN_OBS`` rows give the identity.
    """
    if method not in ("sample", "shrunk", "ridge"):
        raise ValueError(f"unknown covariance: {method}")
    unit = F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)
    if method == "sample":
        return m.pairs.select("t", "i", "j", F.try_divide(comoment(m.lookback), F.lit(m.lookback - 1.0)).alias("cov"))
    if method == "ridge" and m.lookback < max(2, MIN_OBS):
        return m.pairs.select("t", "i", "j", unit.alias("cov"))
    shrunk = (1.0 - F.col("share")) * comoment(m.lookback) / float(m.lookback) + F.col("share") * F.col("target") * unit
    return m.pairs.join(shrinkage(m), "t").select("t", "i", "j", (shrunk + (RIDGE * unit if method == "ridge" else 0.0)).alias("cov"))


def covariance(grid: DataFrame, decisions: DataFrame, lookback: int = 60, method: str = "sample") -> DataFrame:
    """(t, i, j, cov) of each decision with a full history; see ``estimate``."""
    return estimate(moments(grid, decisions, lookback), method)


def _distance(rho: Column) -> Column:
    """sqrt((1 - rho) / 2), 0 on the diagonal."""
    d = F.sqrt(F.greatest(0.5 * (1.0 - rho), F.lit(0.0)))
    return F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.when(rho.isNull(), F.lit(float("nan"))).otherwise(d))


def correlation_distance(grid: DataFrame, decisions: DataFrame, lookback: int = 60, of_columns: bool = False) -> DataFrame:
    """(t, i, j, dist) with dist = sqrt((1 - rho) / 2), 0 on the diagonal; NaN without variance.

    ``of_columns`` correlates the columns of the covariance matrix instead of
    the returns.
    """
    if of_columns:
        c = materialize(covariance(grid, decisions, lookback), "covariance")
        mirrored = c.unionByName(c.where("i < j").select("t", F.col("j").alias("i"), F.col("i").alias("j"), "cov"))
        column = mirrored.groupBy("t", "i").agg(F.array_sort(F.collect_list(F.struct("j", "cov"))).alias("v"))
        column = column.select("t", "i", F.transform("v", lambda e: e["cov"]).alias("v")).withColumn("mean", F.try_divide(V.total(F.col("v")), F.size("v")))
        column = column.select("t", "i", V.bind(F.col("mean"), lambda m: F.transform("v", lambda x: x - m)).alias("v"))
        column = materialize(column.withColumn("norm", F.sqrt(V.dot(F.col("v"), F.col("v")))), "covariance-columns")
        other = column.select("t", F.col("i").alias("j"), F.col("v").alias("v2"), F.col("norm").alias("norm2"))
        both = column.join(other, "t").where("i <= j")
        rho = F.try_divide(V.dot(F.col("v"), F.col("v2")), F.col("norm") * F.col("norm2"))
        return both.select("t", "i", "j", _distance(rho).alias("dist"))
    m = moments(grid, decisions, lookback).pairs.select("t", "i", "j", comoment(lookback).alias("s"))
    spread = m.where("i = j").select("t", "i", F.sqrt("s").alias("d"))
    x = m.join(spread, ["t", "i"]).join(spread.select("t", F.col("i").alias("j"), F.col("d").alias("d2")), ["t", "j"])
    return x.select("t", "i", "j", _distance(F.try_divide(F.col("s"), F.col("d") * F.col("d2"))).alias("dist"))


def universe_cells(grid: DataFrame, decisions: DataFrame) -> DataFrame:
    """(t, pos, asset, ord, n): the universe at each decision; one small row of assets for all."""
    n = grid.select("asset", "ord").distinct().agg(F.array_sort(F.collect_list(F.struct("ord", "asset"))).alias("u"))
    cells = decisions.select("t").join(F.broadcast(n)).select("t", F.posexplode("u").alias("p", "e"), F.size("u").alias("n"))
    return cells.select("t", (F.col("p") + 1).alias("pos"), F.col("e.asset").alias("asset"), F.col("e.ord").alias("ord"), "n")


def _weights(grid: DataFrame, decisions: DataFrame, done: DataFrame) -> DataFrame:
    """(t, asset, ord, w) of weights by position; short histories stay equal."""
    return universe_cells(grid, decisions).join(done, ["t", "pos"], "left").select(
        "t", "asset", "ord", F.coalesce("w", F.lit(1.0) / F.col("n")).alias("w")
    )


def inverse_risk(
    grid: DataFrame, decisions: DataFrame, method: str = "sample", lookback: int = 60, volatility: bool = False, known: Moments | None = None,
) -> DataFrame:
    """(t, asset, ord, w): weights by the inverse of the variance, or of the volatility; from the diagonal alone."""
    c = estimate(known or moments(grid, decisions, lookback), method).where("i = j")
    risk = F.greatest(F.sqrt("cov"), F.lit(1e-12)) if volatility else F.col("cov")
    v = c.select("t", F.col("i").alias("pos"), F.try_divide(F.lit(1.0), risk).alias("v"))
    share = F.try_divide(F.col("v"), F.sum("v").over(Window.partitionBy("t")))
    return _weights(grid, decisions, v.select("t", "pos", share.alias("w")))


def minimum_variance(c: np.ndarray) -> np.ndarray:
    """Sigma^-1 1, negatives cut, normalised; equal where nothing is left."""
    x = np.clip(np.linalg.pinv(c).sum(axis=1), 0.0, None)
    return x / x.sum() if x.sum() > 0 else np.full(len(x), 1.0 / len(x))


def budget_minimum_variance(c: np.ndarray) -> np.ndarray:
    """Sigma^-1 1 divided by its sum, negatives cut; the rest is left to the projection. Equal where the sum is not positive."""
    x = np.linalg.pinv(c).sum(axis=1)
    return np.clip(x / x.sum(), 0.0, None) if x.sum() > 0 else np.full(len(x), 1.0 / len(x))


def black_litterman(
    c: np.ndarray, market: np.ndarray | None = None, views: tuple[np.ndarray, np.ndarray] | None = None,
    delta: float = 2.5, tau: float = 0.05, omega_scale: float = 1.0,
) -> np.ndarray:
    """Posterior mean from equilibrium returns and optional views (P, Q), then
    Sigma^-1 mu with negatives cut.  Left unnormalised for the projection."""
    n = c.shape[0]
    w = np.full(n, 1.0 / n) if market is None or market.sum() <= 0 else np.clip(market, 0.0, None) / market.sum()
    mu = delta * c @ w
    if views is not None and views[0].shape[1] == n and views[0].shape[0] == len(views[1]):
        p, q = views
        prior = np.linalg.pinv(tau * c)
        omega = np.linalg.pinv(np.diag(np.diag(p @ (tau * c) @ p.T)) * max(omega_scale, 1e-12))
        mu = np.linalg.pinv(prior + p.T @ omega @ p) @ (prior @ mu + p.T @ omega @ q)
    return np.clip(np.linalg.pinv(c) @ mu, 0.0, None)


def covariance_rule(
    grid: DataFrame, decisions: DataFrame, weigh: Callable[[np.ndarray], np.ndarray], method: str, lookback: int = 60, known: Moments | None = None,
) -> DataFrame:
    """(t, asset, ord, w) of a rule that maps a covariance matrix to weights."""

    def run(key, group):
        c = np.zeros((group["j"].max(),) * 2)
        i, j = group["i"].to_numpy() - 1, group["j"].to_numpy() - 1
        c[i, j] = c[j, i] = group["cov"].to_numpy()
        w = weigh(c)
        return pd.DataFrame({"t": key[0], "pos": np.arange(1, len(w) + 1), "w": w})

    return _weights(grid, decisions, estimate(known or moments(grid, decisions, lookback), method).groupBy("t").applyInPandas(run, "t int, pos int, w double"))


def risk_parity(grid: DataFrame, decisions: DataFrame, lookback: int = 60, known: Moments | None = None) -> DataFrame:
    return inverse_risk(grid, decisions, "ridge", lookback, volatility=True, known=known)


def min_variance(grid: DataFrame, decisions: DataFrame, method: str = "sample", lookback: int = 60, known: Moments | None = None) -> DataFrame:
    """The ridge form normalises what is left after the cut; the sample and the shrunk form do not."""
    return covariance_rule(grid, decisions, minimum_variance if method == "ridge" else budget_minimum_variance, method, lookback, known)


def bl_rule(
    grid: DataFrame, decisions: DataFrame, method: str = "shrunk", lookback: int = 60,
    market: Sequence[float] | None = None, p: Sequence[Sequence[float]] | None = None, q: Sequence[float] | None = None, known: Moments | None = None, **kw,
) -> DataFrame:
    m = None if market is None else np.asarray(market, dtype=float)
    views = None if p is None or q is None else (np.atleast_2d(np.asarray(p, dtype=float)), np.asarray(q, dtype=float))
    return covariance_rule(grid, decisions, lambda c: black_litterman(c, m, views, **kw), method, lookback, known)


#: Rules over the moments of one window length; built together, they share them.
BY_MOMENTS: dict[str, Callable[..., DataFrame]] = {
    "RiskParity": risk_parity, "ERC": risk_parity, "MVP": min_variance, "BL": bl_rule,
    "MVP-ridge": lambda g, d, **kw: min_variance(g, d, "ridge", **kw), "LW-MVP": lambda g, d, **kw: min_variance(g, d, "shrunk", **kw),
}


def build_by_moments(names: list[str], grid: DataFrame, decisions: DataFrame) -> list[DataFrame]:
    m = moments(grid, decisions)
    return [BY_MOMENTS[n](grid, decisions, known=m).withColumn("series", F.lit(n)) for n in names]


for _name, _rule in BY_MOMENTS.items():
    register(_name, _rule)
register_family(list(BY_MOMENTS), build_by_moments)
