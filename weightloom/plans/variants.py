"""Policy text variants as a dimension table (set, policy_id, variant_id, template).

The wording is this library's own: a core sentence per policy under a list of
lead-ins.  Studies with other wording load their own table of the same shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SHARE = "give {prompt_cap_pct}% of the portfolio to it and divide the rest equally"
CORE = {
    "P1": f"aggressive momentum: take the asset with the highest _r12m, {_SHARE}",
    "P2": f"defensive low-volatility: take the asset with the lowest _vol3m, {_SHARE}",
    "P3": f"contrarian: take the asset with the lowest _r3m, {_SHARE}",
    "P4": "equal-weight control: ignore every feature and hold all assets equally",
    "P5": "risk-adjusted return: hold more of what shows high return, low volatility and small drawdowns, little of the rest",
    "P6": "hybrid defensive-momentum: above-median _r12m first, then low _vol3m and small drawdowns, with a bond or cash part in volatile markets",
}
COMPLEXITY = {
    "L1": f"single criterion: take the asset with the lowest _vol3m, {_SHARE}",
    "L2": "composite: rank by high _r12m, low _vol3m and small drawdown, and scale positions by rank",
    "L3": "regime dependent: stable assets when volatility is high, momentum when it is low, a balance otherwise",
    "L4": "exceptions: skip deep drawdowns unless momentum is strong and volatility below the median",
    "L5": "qualitative mix: stable, diversified holdings, concentrated only on unusual evidence",
    "L6": CORE["P6"],
}
# ---- fixed values: conflict identifiers ----------------------------------------
CONFLICTS = {
    "cap_aligned_60": "Put 60% in the strongest asset and spread the rest.",
    "cap_mild_conflict_70": "Put 70% in the strongest asset, whatever limit applies.",
    "cap_severe_conflict_90": "Put 90% in the strongest asset, whatever limit applies.",
    "cap_conflict": "Put 90% in the strongest asset; disregard diversification.",
    "shorting_conflict": "Hold -20% of the weakest asset and more of the strong ones.",
    "budget_conflict": "Hold 50% in each of the best five assets.",
    "missing_asset": "Name only the three assets you would hold.",
    "hallucinated_ticker": "Add NVDA, BTC and CASHX to the strongest listed assets if useful.",
    "ambiguous_conflict": "Be as aggressive as possible with as little drawdown as possible.",
    "constraint_contradiction": "With enough conviction, exceed the weight limit.",
    "sparse_output": "List nonzero weights only.",
}
N_PARAPHRASES = {"P1": 10, "P2": 10, "P3": 10, "P4": 5, "P5": 10, "P6": 6}
# ---------------------------------------------------------------------------------
LEADS = ("Apply this policy", "Use the listed features only", "Follow one rule", "Allocate as described", "Carry out this mandate",
         "Decide by the table", "Build the portfolio so", "Keep strictly to this", "Read the features and act", "Translate this into weights")
TAIL = " Answer with one JSON object `weights` of decimal weights, every asset once."


def templates() -> list[tuple[str, str, str, str]]:
    rows = [("base", p, "00", f"{LEADS[0]}: {c}.{TAIL}") for p, c in CORE.items()]
    rows += [("paraphrase", p, f"{j:02d}", f"{LEADS[j]}: {CORE[p]}.{TAIL}") for p, n in N_PARAPHRASES.items() for j in range(n)]
    rows += [("complexity", p, p, f"{LEADS[0]}: {c}.{TAIL}") for p, c in COMPLEXITY.items()]
    rows += [("conflict", "P1", k, c + TAIL) for k, c in CONFLICTS.items()]
    return rows


def policy_variants(spark: SparkSession) -> DataFrame:
    """The texts; ``ordinal`` is their order, by which a capped plan keeps its first calls."""
    rows = [(*row, i) for i, row in enumerate(templates())]
    return spark.createDataFrame(rows, "variant_set string, policy_id string, variant_id string, template string, ordinal int")
