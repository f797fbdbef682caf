"""Scalar column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")

# ---- fixed values: asset-class vocabulary and cost multipliers -------------
CRYPTO_TOKENS = ("BTC", "ETH", "SOL", "BNB", "DOGE", "XRP", "ADA", "-USD")
COMMODITY_TICKERS = ("GLD", "SLV", "DBC", "USO")
BOND_TICKERS = ("AGG", "BND", "SHY", "IEF", "TLT", "TIP", "LQD", "HYG", "BIL")
REAL_ESTATE_TICKERS = ("VNQ",)
CURRENCY_TICKERS = ("UUP",)
CRYPTO_MULTIPLIER = 5.0
COMMODITY_MULTIPLIER = 1.5
# ----------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """NaN and infinities become NULL, so that aggregates skip them."""
    c = _c(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(INF)), c)


def to_number(c) -> Column:
    """Lenient numeric coercion: unparsable text and non-finite values are NULL."""
    return finite(_c(c).try_cast("double"))


def safe_t(mu, sd, eps: float = 1e-12) -> Column:
    """Finite t-like ratio: 0 for 0/0, +-1e6 where only the spread vanishes."""
    mu, sd = _c(mu), _c(sd)
    degenerate = sd.isNull() | F.isnan(sd) | (F.abs(sd) == INF) | (sd <= eps)
    return (
        F.when(finite(mu).isNull(), None)
        .when(degenerate & (F.abs(mu) <= eps), 0.0)
        .when(degenerate, F.signum(mu) * 1e6)
        .otherwise(mu / sd)
    )


def stars(p) -> Column:
    p = _c(p)
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("")


def asset_class(ticker) -> Column:
    t = F.upper(_c(ticker))
    return (
        F.when(t.rlike("|".join(CRYPTO_TOKENS)), "Crypto")
        .when(t.isin(*COMMODITY_TICKERS), "Commodity")
        .when(t.isin(*BOND_TICKERS), "Bond")
        .when(t.isin(*REAL_ESTATE_TICKERS), "RealEstate")
        .when(t.isin(*CURRENCY_TICKERS), "Currency")
        .otherwise("EquityETF")
    )


def asset_cost(
    ticker,
    base,
    crypto: float = CRYPTO_MULTIPLIER,
    commodity: float = COMMODITY_MULTIPLIER,
) -> Column:
    label = asset_class(ticker)
    mult = F.when(label == "Crypto", crypto).when(label == "Commodity", commodity).otherwise(1.0)
    return F.lit(base) * mult


def _bind(value: Column, body) -> Column:
    """body(value) with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def log_gamma(a: Column) -> Column:
    """ln Gamma(a) for a > 0: Stirling's series 16 steps up, and the way back."""
    z = a + 16.0
    up = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3.0))) + 1 / (1260 * F.pow(z, F.lit(5.0))) - 1 / (1680 * F.pow(z, F.lit(7.0)))
    down = a
    for i in range(1, 16):
        down = down * (a + float(i))
    return up - F.ln(down)


def upper_gamma(a: Column, y: Column) -> Column:
    """Regularised upper incomplete gamma function: a series below the mean, a continued fraction above.

    Both have a length that depends on a alone and suffices for doubles.
    """
    def body(v: Column) -> Column:
        a, y = v["a"], v["y"]
        front = F.exp(a * F.ln(y) - y - log_gamma(a))
        steps = F.sequence(F.lit(1), F.ceil(40 + 8 * F.sqrt(a)).cast("int"))

        def term(acc: Column, k: Column) -> Column:
            t = acc["t"] * y / (a + k)
            return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

        series = F.aggregate(steps, F.struct((1.0 / a).alias("t"), (1.0 / a).alias("s")), term, lambda acc: acc["s"])
        # from the inner end outwards: y + 2k + 1 - a - (k + 1)(k + 1 - a) / ...
        inward = F.sequence(F.ceil(120 + 8 * F.sqrt(a)).cast("int"), F.lit(1))
        tail = F.aggregate(inward, F.lit(0.0), lambda acc, k: k * (k - a) / (y + 2 * k + 1 - a - acc))
        return F.when(y < a + 1.0, F.greatest(1.0 - front * series, F.lit(0.0))).otherwise(front / (y + 1.0 - a - tail))

    return F.when(y <= 0, 1.0).when(y == INF, 0.0).otherwise(_bind(F.struct(a.alias("a"), y.alias("y")), body))


def two_sided_p(t) -> Column:
    """2(1 - Phi(|t|)); NULL for NULL and NaN."""
    t = _c(t).cast("double")
    return F.when(~F.isnan(t), upper_gamma(F.lit(0.5), t * t / 2.0))


def chi2_upper_p(x, df) -> Column:
    """Upper tail of chi-square; NULL for NULL and NaN, NaN without degrees of freedom."""
    x, df = _c(x).cast("double"), _c(df).cast("double")
    known = ~F.isnan(x) & ~F.isnan(df)
    return F.when(known & (df <= 0), float("nan")).when(known, upper_gamma(df / 2.0, x / 2.0))


# ---- series keys -----------------------------------------------------------
# Recorded-policy series are written  <tag>[<model>|P<k>]  (any alphabetic tag),
# coded policies  CODED_P<k>, everything else is a baseline.
POLICY_KEY = r"^([A-Za-z]+)\[([^|\]]+)\|P([0-9]+)\]$"
DASH_KEY = r"^([A-Za-z]+)-P([0-9]+)$"


def series_group(key) -> Column:
    k = _c(key)
    return (
        F.when(k.rlike(POLICY_KEY) | k.rlike(DASH_KEY), "Policy")
        .when(k.startswith("CODED_P"), "CodedPolicy")
        .otherwise("Baseline")
    )


def series_model(key) -> Column:
    return F.trim(F.regexp_extract(_c(key), POLICY_KEY, 2))


def series_persona(key) -> Column:
    k = _c(key)
    return (
        F.when(k.rlike(POLICY_KEY), F.concat(F.lit("P"), F.regexp_extract(k, POLICY_KEY, 3)))
        .when(k.rlike(DASH_KEY), F.concat(F.lit("P"), F.regexp_extract(k, DASH_KEY, 2)))
        .when(k.startswith("CODED_P"), F.regexp_replace(k, "CODED_", ""))
        .otherwise("")
    )


def series_key(strategy, model, persona, policy_tags: tuple[str, ...]) -> Column:
    """Composite key for policy strategies (those whose name is one of the tags)."""
    s, m, p = (F.coalesce(_c(x).cast("string"), F.lit("NA")) for x in (strategy, model, persona))
    blank = ["", "NA", "nan"]
    return F.when(
        s.isin(*policy_tags) & ~m.isin(*blank) & ~p.isin(*blank),
        F.format_string("%s[%s|%s]", s, m, p),
    ).otherwise(s)


# Language target inside a conflict id: (aligned|conflict)_60/70/90 or a lone number.
CAP_TARGET = r"(?:aligned|conflict)[_-]?(60|70|90)|\b(60|70|90)\b"


def cap_target(conflict_id) -> Column:
    c = _c(conflict_id).cast("string")
    token = F.concat(F.regexp_extract(c, CAP_TARGET, 1), F.regexp_extract(c, CAP_TARGET, 2))
    return token.try_cast("double") / 100.0


def short_hash(text) -> Column:
    """Prompt hash: first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(_c(text), 256), 1, 16)


def record_id(*cols) -> Column:
    """24 hex digits of SHA-256 over a JSON object with sorted keys."""
    ordered = sorted(cols)
    return F.substring(F.sha2(F.to_json(F.struct(*ordered)), 256), 1, 24)
