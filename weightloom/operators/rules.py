"""Target-weight rules, evaluated for all decision dates at once.

A rule is a function returning ``(t, asset, ord, w)`` or, for the families,
``(policy, t, asset, ord, w)``.  Cross-sectional windows are keyed by the date;
a group is one date's universe.  Return-window rules read rows [t-L, t), price
and feature rules include row t, and a history shorter than L gives equal
weights.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weightloom.functions import vectors as V
from weightloom.functions.scalars import INF, finite
from weightloom.operators.panel import by_asset, simple_returns


def day():
    """All assets of one decision date."""
    return Window.partitionBy("t")


# ---- fixed values: policy parameters ---------------------------------------
RANKED_TOP = (0.40, 0.25, 0.15)
SOFTMAX_TEMPERATURE = 0.75
DEFENSIVE_TICKERS = ("AGG", "BND", "SHY", "IEF", "TIP", "BIL", "LQD")
DEFENSIVE_SLEEVE = 0.20
SEVERE_DRAWDOWN = -0.20
DEEP_DRAWDOWN = -0.25
CORE_FEATURE = {"P1": ("r12m", "max"), "P2": ("vol3m", "min"), "P3": ("r3m", "min")}
POLICIES = ("P1", "P2", "P3", "P4", "P5", "P6", "L1", "L2", "L3", "L4", "L5", "L6")
# ----------------------------------------------------------------------------


def _n() -> Column:
    return F.count("*").over(day())


def equal_weight() -> Column:
    return F.lit(1.0) / _n()


def _core_rank(feature: str, how: str, missing: str = "worst") -> Column:
    """1 on the arg-max/arg-min of the date; ties to the lower ord."""
    worst = 0.0 if missing == "zero" else (-INF if how == "max" else INF)
    x = F.coalesce(finite(feature), F.lit(worst))
    order = x.desc() if how == "max" else x.asc()
    return F.row_number().over(day().orderBy(order, F.col("ord")))


def core_weight(feature: str, how: str, cap: float, missing: str = "worst") -> Column:
    """``cap`` on the chosen asset, the rest spread equally."""
    cap = min(max(cap, 0.0), 1.0)
    others = (1.0 - cap) / F.greatest(_n() - 1, F.lit(1))
    return F.when(_core_rank(feature, how, missing) == 1, cap).otherwise(others)


def normalised(score: Column) -> Column:
    """Share of a non-negative score within its date; equal if nothing scores."""
    s = F.sum(score).over(day())
    return F.when(s > 1e-12, F.try_divide(score, s)).otherwise(equal_weight())


def reward_to_risk() -> Column:
    r = F.coalesce(finite("r1m"), F.lit(0.0))
    v = F.greatest(F.coalesce(finite("vol3m"), F.lit(1e-12)), F.lit(1e-12))
    return F.greatest(r / v, F.lit(0.0))


def z_score(feature: str) -> Column:
    x = F.coalesce(finite(feature), F.lit(0.0))
    sd = F.stddev_pop(x).over(day())
    return F.when(sd > 1e-12, F.try_divide(x - F.avg(x).over(day()), sd)).otherwise(0.0)


def _ranked(score: str) -> Column:
    rank = F.row_number().over(day().orderBy(F.col(score).desc(), "ord"))
    tops = F.lit(0.0)
    for k, w in enumerate(RANKED_TOP, start=1):
        tops = F.when(rank == k, w).otherwise(tops)
    k = len(RANKED_TOP)
    rest = (1.0 - sum(RANKED_TOP)) / F.greatest(_n() - k, F.lit(1))
    raw = F.when(rank <= k, tops).otherwise(rest)
    used = F.lit(0.0)
    for i, w in enumerate(RANKED_TOP, start=1):
        used = used + F.when(_n() >= i, w).otherwise(0.0)
    return raw / F.when(_n() > k, F.lit(1.0)).otherwise(used)


def policy_weights(
    feats: DataFrame,
    cap: float = 0.60,
    defensive: tuple[str, ...] = DEFENSIVE_TICKERS,
    policies: tuple[str, ...] = POLICIES,
) -> DataFrame:
    """(policy, t, asset, ord, w) for the canonical rules P1-P6 and ladder L1-L6.

    One shuffle by date serves all twelve rules; the result is unpivoted.
    """
    zero = lambda c: F.coalesce(finite(c), F.lit(0.0))
    x = feats.select("t", "asset", "ord", "cross_vol", *[zero(c).alias(c) for c in ("r1m", "r3m", "r12m", "vol3m", "mdd")])
    quant = lambda c, *p: F.percentile(c, F.array(*[F.lit(v) for v in p])).over(day())
    x = x.withColumns(
        {
            "_vol_q": quant("vol3m", 0.25, 0.5, 0.75),
            "_r12_q": quant("r12m", 0.5, 0.75, 0.9),
            "_vol_mean": F.avg("vol3m").over(day()),
            "z12": z_score("r12m"), "z3": z_score("r3m"), "zv": z_score("vol3m"), "zd": z_score("mdd"),
        }
    )
    vol, r12, dd = F.col("vol3m"), F.col("r12m"), F.col("mdd")
    v25, v50, v75 = (F.col("_vol_q")[i] for i in range(3))
    m50, m75, m90 = (F.col("_r12_q")[i] for i in range(3))
    calm = F.when(vol <= v50, True).otherwise(False)
    severe = dd <= SEVERE_DRAWDOWN
    base = F.col("z12") - F.col("zv") + F.col("zd")
    s6 = 0.75 * F.col("z12") - 0.75 * F.col("zv") + 0.50 * F.col("zd")
    fit6 = (r12 >= m50) & (~severe | ((r12 >= m90) & calm))
    x = x.withColumns(
        {
            "s2": base,
            "s3": F.when(F.col("_vol_mean") >= v75, -F.col("zv") + F.col("zd"))
            .when(F.col("_vol_mean") <= v25, F.col("z12") + 0.5 * F.col("z3"))
            .otherwise(base),
            "s4": F.when(~severe | ((r12 >= m75) & calm), base).otherwise(-1e6),
            "s5": -F.col("zv") + 0.5 * F.col("z12") + F.col("zd")
            + F.when((r12 >= m90) & calm, 0.5).otherwise(0.0)
            - F.when(dd <= DEEP_DRAWDOWN, 1.0).otherwise(0.0),
            "s6": F.when(fit6, s6).otherwise(s6 - 1.0),
        }
    )
    soft = {"e5": "s5", "e6": "s6"}
    x = x.withColumns({e: F.exp((F.col(s) - F.max(s).over(day())) / SOFTMAX_TEMPERATURE) for e, s in soft.items()})
    x = x.withColumns(
        {
            "c5": F.least(F.col("e5") / F.sum("e5").over(day()), F.lit(0.30)),
            "c6": F.least(F.col("e6") / F.sum("e6").over(day()), F.lit(0.40)),
            "_safe": F.upper("asset").isin(*[d.upper() for d in defensive]).cast("double"),
        }
    )
    w6 = F.col("c6") / F.sum("c6").over(day())
    n_safe = F.sum("_safe").over(day())
    sleeve = (F.coalesce(F.col("cross_vol"), F.col("_vol_mean")) >= v75) & (n_safe > 0)
    w6 = F.when(
        sleeve, w6 * (1.0 - DEFENSIVE_SLEEVE) + DEFENSIVE_SLEEVE * F.col("_safe") / F.greatest(n_safe, F.lit(1.0))
    ).otherwise(w6)
    by_policy = {
        "P1": core_weight("r12m", "max", cap),
        "P2": core_weight("vol3m", "min", cap),
        "P3": core_weight("r3m", "min", cap),
        "P4": equal_weight(),
        "P5": normalised(reward_to_risk()),
        "P6": w6,
        "L2": _ranked("s2"),
        "L3": _ranked("s3"),
        "L4": _ranked("s4"),
        "L5": F.col("c5") / F.sum("c5").over(day()),
    }
    by_policy["L1"], by_policy["L6"] = by_policy["P2"], by_policy["P6"]
    need = [p for p in POLICIES if p in policies]
    wide = x.withColumns({f"w_{p}": by_policy[p] for p in need})
    pairs = F.array(*[F.struct(F.lit(p).alias("policy"), F.col(f"w_{p}").alias("w")) for p in need])
    return wide.select("t", "asset", "ord", F.inline(pairs)).select("policy", "t", "asset", "ord", "w")


def intended_core(feats: DataFrame) -> DataFrame:
    """(policy, t, core): the asset a single-core policy is meant to favour."""
    picks = [
        F.struct(
            F.lit(p).alias("policy"),
            (F.max_by if how == "max" else F.min_by)(
                "asset", F.struct(F.coalesce(finite(f), F.lit(-INF if how == "max" else INF)),
                                  (-F.col("ord") if how == "max" else F.col("ord")))
            ).alias("core"),
        )
        for p, (f, how) in CORE_FEATURE.items()
    ]
    return feats.groupBy("t").agg(F.array(*picks).alias("p")).select("t", F.inline("p")).select("policy", "t", "core")


# ------------------------------------------------------------ price rules ----


def _short(rows: int) -> Column:
    return F.col("t") < rows


def _decided(df: DataFrame, decisions: DataFrame) -> DataFrame:
    # decision dates: bounded by the calendar; the panel keeps its partitioning
    return df.join(F.broadcast(decisions.select("t")), "t", "left_semi")


def _zero_filled(grid: DataFrame) -> DataFrame:
    """Daily returns with gaps as 0; a supplied ``ret`` column is taken as is."""
    if "ret" in grid.columns:
        return grid.withColumn("ret", F.coalesce(finite("ret"), F.lit(0.0)))
    return simple_returns(grid, zero_fill=True)


def momentum(grid: DataFrame, decisions: DataFrame, lookback: int = 126) -> DataFrame:
    """Top half by the L-row price return, equally weighted."""
    gain = F.coalesce(finite(F.try_divide("px", F.lag("px", lookback).over(by_asset())) - 1.0), F.lit(0.0))
    x = _decided(grid.withColumn("gain", gain), decisions)
    rank = F.row_number().over(day().orderBy(F.desc("gain"), "ord"))
    k = F.greatest(F.lit(1), F.floor(_n() / 2))
    w = F.when(_short(lookback), equal_weight()).when(rank <= k, F.lit(1.0) / k).otherwise(0.0)
    return x.select("t", "asset", "ord", w.alias("w"))


def trend(grid: DataFrame, decisions: DataFrame, lookback: int = 126) -> DataFrame:
    """Equal weight over assets above their L-row average (full windows only)."""
    frame = by_asset().rowsBetween(-(lookback - 1), 0)
    sma = F.when(F.count("px").over(frame) == lookback, F.avg("px").over(frame))
    x = _decided(grid.withColumn("up", F.coalesce(F.col("px") > sma, F.lit(False)).cast("int")), decisions)
    n_up = F.sum("up").over(day())
    w = F.when(_short(lookback) | (n_up == 0), equal_weight()).otherwise(F.try_divide("up", n_up))
    return x.select("t", "asset", "ord", w.alias("w"))


def ratio_weighted(grid: DataFrame, decisions: DataFrame, lookback: int = 60, downside: bool = False) -> DataFrame:
    """Trailing Sharpe (or Sortino) ratio, negatives cut, normalised."""
    frame = by_asset().rowsBetween(-lookback, -1)
    g = _zero_filled(grid)
    risk = F.least("ret", F.lit(0.0)) if downside else F.col("ret")
    sd = F.stddev_samp(risk).over(frame)
    score = F.coalesce(F.greatest(F.try_divide(F.avg("ret").over(frame), F.when(sd > 0, sd)), F.lit(0.0)), F.lit(0.0))
    x = _decided(g.withColumn("score", score), decisions)
    s = F.sum("score").over(day())
    w = F.when(s > 0, F.try_divide("score", s)).otherwise(equal_weight())
    return x.select("t", "asset", "ord", w.alias("w"))


def min_cvar(grid: DataFrame, decisions: DataFrame, lookback: int = 126, alpha: float = 0.05) -> DataFrame:
    """Inverse historical CVaR of the trailing losses.

    The trailing losses travel as one array of at most ``lookback`` values along the rows. They
    are rounded to 12 digits: equal returns stay equal, however their prices came about, and
    the percentile does not fall between them.
    """
    losses = F.sort_array(F.collect_list(F.round(-F.col("ret"), 12)).over(by_asset().rowsBetween(-lookback, -1)))
    x = _decided(_zero_filled(grid).withColumn("losses", losses), decisions)
    # between the two ranks around the percentile, as usual
    place = (F.size("losses") - 1) * (1.0 - alpha)
    low = F.get("losses", F.floor(place).cast("int"))
    cut = low + (place - F.floor(place)) * (F.get("losses", F.ceil(place).cast("int")) - low)
    x = x.withColumn("rows", F.size("losses")).select("t", "asset", "ord", "rows", V.bind(cut, lambda q: F.filter("losses", lambda y: y >= q)).alias("tail"))
    # a decision on the first row has no window at all, and every asset its equal share
    x = x.withColumn("inv", 1.0 / F.greatest(F.try_divide(V.total(F.col("tail")), F.size("tail")), F.lit(1e-6)))
    w = F.when(F.coalesce("rows", F.lit(0)) < 20, equal_weight()).otherwise(normalised(F.col("inv")))
    return x.select("t", "asset", "ord", w.alias("w"))


def vol_scaled_trend(grid: DataFrame, decisions: DataFrame, ret_rows: int = 126, vol_rows: int = 63) -> DataFrame:
    """Inverse volatility over assets with a positive trailing return."""
    g = _zero_filled(grid)
    vol = F.stddev_samp("ret").over(by_asset().rowsBetween(-vol_rows, -1))
    gain = F.product(1.0 + F.col("ret")).over(by_asset().rowsBetween(-ret_rows, -1)) - 1.0
    score = F.when((F.col("gain") > 0) & (F.col("vol") > 0), 1.0 / F.greatest("vol", F.lit(1e-6))).otherwise(0.0)
    x = _decided(g.withColumns({"vol": vol, "gain": gain}), decisions).withColumn("score", score)
    w = F.when(_short(max(ret_rows, vol_rows)), equal_weight()).otherwise(normalised(F.col("score")))
    return x.select("t", "asset", "ord", w.alias("w"))


def equal(grid: DataFrame, decisions: DataFrame) -> DataFrame:
    return _decided(grid, decisions).select("t", "asset", "ord", equal_weight().alias("w"))


def coded_policies(feats: DataFrame, decisions: DataFrame, policies: list[str], cap: float = 0.60) -> DataFrame:
    """(policy, t, asset, ord, w) of several coded personas in one pass."""
    def weight(p: str) -> Column:
        if p in CORE_FEATURE:
            return core_weight(*CORE_FEATURE[p], cap, missing="zero")
        return normalised(reward_to_risk()) if p == "P5" else equal_weight()

    x = _decided(feats, decisions)
    wide = x.select("t", "asset", "ord", *[weight(p).alias(f"w_{p}") for p in policies])
    pairs = F.array(*[F.struct(F.lit(p).alias("policy"), F.col(f"w_{p}").alias("w")) for p in policies])
    return wide.select("t", "asset", "ord", F.inline(pairs)).select("policy", "t", "asset", "ord", "w")


def coded_policy(feats: DataFrame, decisions: DataFrame, policy: str, cap: float = 0.60) -> DataFrame:
    """Deterministic executor of one persona; missing features count as 0."""
    return coded_policies(feats, decisions, [policy], cap).drop("policy")


Rule = Callable[[DataFrame, DataFrame], DataFrame]

#: name -> rule over (features grid, decisions); covariance rules add themselves.
REGISTRY: dict[str, Rule] = {
    "EQUAL": equal,
    "MOM6": momentum,
    "MOM12": lambda g, d: momentum(g, d, 252),
    "TRND6": trend,
    "TRND10": lambda g, d: trend(g, d, 210),
    "SHARPE": ratio_weighted,
    "SORTINO": lambda g, d: ratio_weighted(g, d, downside=True),
    "MinCVaR": min_cvar,
    "VOLT_TRND6": vol_scaled_trend,
    **{f"CODED_P{k}": (lambda g, d, p=f"P{k}": coded_policy(g, d, p)) for k in range(1, 6)},
}


def register(name: str, rule: Rule) -> None:
    """Extension point: a rule maps (features grid, decisions) to (t, asset, ord, w)."""
    REGISTRY[name] = rule


Family = Callable[[list[str], DataFrame, DataFrame], list[DataFrame]]
FAMILIES: list[tuple[set[str], Family]] = []


def register_family(names: list[str], build: Family) -> None:
    """Rules that share work when they are built together: ``build`` returns tables with a ``series`` column."""
    FAMILIES.append((set(names), build))


def _build_coded(names: list[str], feats: DataFrame, decisions: DataFrame) -> list[DataFrame]:
    c = coded_policies(feats, decisions, [n.removeprefix("CODED_") for n in names])
    return [c.withColumn("series", F.concat(F.lit("CODED_"), "policy")).drop("policy")]


register_family([f"CODED_P{k}" for k in range(1, 6)], _build_coded)


def build_targets(names: list[str], feats: DataFrame, decisions: DataFrame) -> DataFrame:
    """(series, t, asset, ord, w) of several rules; unknown names are skipped."""
    parts, left = [], [n for n in names if n in REGISTRY]
    for members, build in FAMILIES:
        if shared := [n for n in left if n in members]:
            parts += build(shared, feats, decisions)
            left = [n for n in left if n not in members]
    parts += [REGISTRY[n](feats, decisions).withColumn("series", F.lit(n)) for n in left]
    if not parts:
        raise ValueError("no known rule among " + ", ".join(names))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("series", "t", "asset", "ord", "w")
