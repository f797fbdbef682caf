"""Response parsing, policy text classification and prompt rendering."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weightloom.functions import vectors as V
from weightloom.functions.scalars import finite

# ---- fixed values: patterns --------------------------------------------------
FENCED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
# matches at the end too: a long rest without a brace is then read only once
TO_BRACE = r"[^{}]*+(?:[{}]|\z)"
TRAILING_COMMA = r",\s*([}\]])"
BARE_KEY = r"([{,]\s*)([A-Za-z_][A-Za-z0-9_\-]*)(\s*:\s*)"
NOT_TICKER = r"[^A-Za-z0-9._\-]"
TOKEN = r"[a-z0-9_]+"
# asset letters and digits only: tickers with a hyphen and masked labels never match
FEATURE_LINE = r"(?m)^-\s*([A-Za-z0-9]+)_(r1m|r3m|r12m|vol3m|mdd):\s*([-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?)\s*$"
STRICT = {"allowUnquotedFieldNames": "false", "allowSingleQuotes": "false", "mode": "PERMISSIVE"}
# ---- fixed values: keyword rules, in order of precedence -----------------------
KEYWORD_RULES = (
    ("P6", ("hybrid defensive-momentum", "hybrid defensive momentum", "above-median", "above median")),
    ("P4", ("equal-weight control", "equal weight control", "1/n", "one over n")),
    ("P5", ("risk-adjusted", "risk adjusted", "sharpe-like", "sharpe like")),
    ("P3", ("contrarian", "mean-reversion", "mean reversion")),
    ("P2", ("low-volatility", "low volatility", "lowest volatility")),
    ("P1", ("aggressive momentum",)),
)
# words that select a policy only together
JOINT_RULES = {
    "P4": (("ignore", "feature", "equal"),),
    "P2": (("lowest", "vol3m"),),
    "P1": (("highest", "r12m"),),
}
DEFAULT_POLICY = "P4"
# ---- fixed values: retrieval corpus --------------------------------------------
POLICY_WORDS = {
    "P1": "aggressive momentum highest twelve month return winner r12m",
    "P2": "defensive low volatility lowest three month volatility safest vol3m",
    "P3": "contrarian mean reversion lowest three month return weakest underperformer r3m",
    "P4": "equal weight control ignore features uniform one over n diversification",
    "P5": "risk adjusted return stronger returns lower volatility smaller drawdowns selective allocation",
    "P6": "hybrid defensive momentum above median r12m lower vol3m smaller drawdowns defensive bond cash sleeve",
}
# ---------------------------------------------------------------------------------


def _json_map(text: Column) -> Column:
    """Map of JSON values as text; NULL unless the whole object parses strictly."""
    return F.from_json(text, "map<string,string>", STRICT)


def first_object(text: Column) -> Column:
    """The text from the first brace to the one that closes it, at any depth; else empty."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"))

    def step(a: Column, part: Column) -> Column:
        more = F.struct((a["depth"] + F.when(part.endswith("{"), 1).when(part.endswith("}"), -1).otherwise(0)).alias("depth"), (a["size"] + F.length(part)).alias("size"))
        return F.when((a["size"] > 0) & (a["depth"] == 0), a).otherwise(more)

    def closed(rest: Column) -> Column:
        end = F.aggregate(F.regexp_extract_all(rest, F.lit(TO_BRACE), F.lit(0)), start, step)
        return V.bind(end, lambda e: F.when(e["depth"] == 0, F.substring(rest, F.lit(1), e["size"])).otherwise(""))

    found = lambda s, at: F.when(at > 0, V.bind(F.substring(s, at, F.length(s)), closed)).otherwise("")
    return V.bind(text, lambda s: V.bind(F.instr(s, "{"), lambda at: found(s, at)))


def extract_weights(df: DataFrame, text: str) -> DataFrame:
    """Adds ``parsed`` (ticker -> text value), ``json_valid`` and ``repair_used``.

    A fenced block wins, otherwise the first balanced object; repairs (trailing
    commas, single quotes, bare keys) are tried only where the strict parse fails.
    """
    def body(t: Column) -> Column:
        return V.bind(F.regexp_extract(t, FENCED, 1), lambda fenced: first_object(F.when(fenced != "", fenced).otherwise(t)))

    def mended(b: Column) -> Column:
        quoted = lambda x: F.when(x.contains("'") & ~x.contains('"'), F.replace(x, F.lit("'"), F.lit('"'))).otherwise(x)
        return F.regexp_replace(V.bind(F.regexp_replace(b, TRAILING_COMMA, "$1"), quoted), BARE_KEY, '$1"$2"$3')

    def weights(got: Column) -> Column:
        # an empty answer is none, and neither are weights that are no object
        inner = _json_map(F.element_at(got, F.lit("weights")))
        return F.when(F.size(got) > 0, F.when(F.map_contains_key(got, F.lit("weights")), inner).otherwise(got))

    def result(strict: Column, loose: Column) -> Column:
        return F.struct(V.bind(F.coalesce(strict, loose), weights).alias("parsed"), (strict.isNull() & loose.isNotNull()).alias("repaired"))

    def read(b: Column) -> Column:
        return V.bind(_json_map(b), lambda strict: V.bind(F.when(strict.isNull(), _json_map(mended(b))), lambda loose: result(strict, loose)))

    # every step is bound: a step that the next ones name several times would be evaluated as often
    found = V.bind(body(F.trim(F.coalesce(F.col(text), F.lit("")))), lambda b: V.bind(F.when(b != "", b), read))
    x = df.withColumn("_found", found).withColumn("parsed", F.col("_found.parsed"))
    return x.withColumns(
        {
            "json_valid": F.col("_found.parsed").isNotNull().cast("int"),
            "repair_used": F.col("_found.repaired").cast("int"),
        }
    ).drop("_found")


def canonical_ticker(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, NOT_TICKER, ""))


def clean_weights(df: DataFrame, allowed: Column, policy: str | None = None) -> DataFrame:
    """Universe-ordered weights from ``parsed`` with the usual counts.

    Unknown tickers are dropped, unusable numbers become 0, nothing left means
    equal weights; the equal-weight policy is overwritten with its exact answer
    and the risk-adjusted policy loses its negatives before normalisation.
    """
    canon = F.transform(allowed, canonical_ticker)
    got = F.transform(F.map_entries("parsed"), lambda e: F.struct(canonical_ticker(e["key"]).alias("k"), e["value"].alias("v")))
    x = df.withColumn("_allowed", canon).withColumn("_got", F.coalesce(got, F.array().cast("array<struct<k:string,v:string>>")))
    keys = F.array_distinct(F.transform("_got", lambda e: e["k"]))
    x = x.withColumns(
        {
            "unknown_count": F.size(F.array_except(keys, F.col("_allowed"))),
            "missing_count": F.size(F.array_except(F.col("_allowed"), keys)),
            "_known": F.filter("_got", lambda e: F.array_contains("_allowed", e["k"])),
        }
    )
    num = lambda e: finite(e["v"].try_cast("double"))
    x = x.withColumns(
        {
            "invalid_count": F.size(F.filter("_known", lambda e: num(e).isNull())),
            "negative_count": F.size(F.filter("_known", lambda e: num(e) < 0)),
        }
    )
    empty = F.size("_known") == 0
    # the last of several spellings of one ticker counts
    def value(k):
        hits = F.filter("_known", lambda e: e["k"] == k)
        return V.bind(hits, lambda h: F.when(F.size(h) > 0, F.coalesce(num(F.element_at(h, -1)), F.lit(0.0))))

    raw = F.transform("_allowed", value)
    n = F.size("_allowed")
    p = F.col(policy) if policy else F.lit("")
    x = x.withColumn("_raw", raw)
    chosen = F.when(empty | (p == "P4"), F.transform("_allowed", lambda k: F.lit(1.0))).when(
        p == "P5", F.transform("_raw", lambda v: F.when(v.isNotNull(), F.greatest(v, F.lit(0.0))))
    ).otherwise(F.col("_raw"))
    x = x.withColumn("_chosen", chosen).withColumn(
        "_sum", F.aggregate("_chosen", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    )
    named = F.size(F.filter("_chosen", lambda v: v.isNotNull()))
    # validation after normalising: negatives to 0, then to one again
    share = lambda v: F.when(
        F.col("_sum") > 0, F.greatest(F.coalesce(F.try_divide(v, F.col("_sum")), F.lit(0.0)), F.lit(0.0))
    ).otherwise(F.when(v.isNotNull(), F.lit(1.0) / named).otherwise(0.0))
    w = V.scale_to_one(F.transform("_chosen", share))
    fallback = empty | (p == "P4") | (F.col("_sum") <= 0)
    if "repair_used" in df.columns:  # an answer without any known ticker counts as repaired
        x = x.withColumn("repair_used", F.when(empty & F.col("parsed").isNotNull(), 1).otherwise(F.col("repair_used")))
    return x.withColumns({"weights": w, "equal_fallback": fallback.cast("int"), "_n": n}).drop(
        "_allowed", "_got", "_known", "_raw", "_chosen", "_sum", "_n"
    )


def repair_rows(df: DataFrame, allowed: Column, cap: float = 0.60) -> DataFrame:
    """Repair walk-through of ``parsed`` responses, one row per allowed ticker.

    Unknown tickers are dropped, missing or unusable ones are 0, and the raw
    vector goes to the projection as it is, without normalising.
    """
    def cells(raw: Column, w: Column) -> Column:
        total, top, least = V.total(w), F.array_max(w), F.array_min(w)
        totals = F.struct(total.alias("sum_projected"), top.alias("max_projected"), least.alias("min_projected"))
        return V.bind(totals, lambda t: F.transform(F.arrays_zip(allowed.alias("ticker"), raw.alias("raw"), w.alias("w")), lambda e: F.struct(
            t["sum_projected"], t["max_projected"], t["min_projected"], e["ticker"].alias("ticker"), e["raw"].alias("raw_weight"), e["w"].alias("projected_weight"))))

    def usable(parsed: Column) -> Column:
        number = lambda a: V.bind(parsed[a].try_cast("double"), lambda v: F.coalesce(finite(v), F.lit(0.0)))
        return F.when(parsed.isNotNull(), F.transform(allowed, number))

    # without a usable object there are no cells; a filter on them would evaluate all of it once more
    found = V.bind(usable(F.col("parsed")), lambda raw: F.when(raw.isNotNull(), V.bind(V.project_capped(raw, cap), lambda w: cells(raw, w))))
    return df.select(*df.columns, F.inline(found))


def keyword_policy(text: Column) -> Column:
    """Ordered keyword classifier; nothing matched gives the control policy."""
    def choose(s: Column) -> Column:
        has = lambda words, join: reduce(join, [s.contains(w) for w in words])
        out = F.lit(DEFAULT_POLICY)
        for policy, words in reversed(KEYWORD_RULES):
            hit = has(words, lambda a, b: a | b)
            for together in JOINT_RULES.get(policy, ()):
                hit = hit | has(together, lambda a, b: a & b)
            out = F.when(hit, policy).otherwise(out)
        return out

    # lower-cased once per text; plain substring search beats a pattern here
    return V.bind(F.lower(text), choose)


def tfidf_policy(df: DataFrame, key: str, text: str, corpus: dict[str, str] = POLICY_WORDS) -> DataFrame:
    """(key, policy, score): cosine best match against a small policy corpus.

    Document frequencies include the query itself, so a corpus word seen in the
    query has df + 1.  Everything happens inside the row: tokens are sorted, runs
    of equal ones are counted, and the counts meet literal maps of the corpus, so
    no token is shuffled.  Ties go to the larger id.
    """
    import math
    from collections import Counter

    split = {p: re.findall(TOKEN, w.lower()) for p, w in corpus.items()}
    total = len(corpus) + 1
    base_df = Counter(w for toks in split.values() for w in set(toks))
    idf = lambda d: math.log((1 + total) / (1 + d)) + 1.0
    literal = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    seen = literal({w: idf(d + 1) for w, d in base_df.items()})

    def run_lengths(toks: Column) -> Column:
        """(token, c) of the sorted tokens: where a run begins, and where the next one does."""
        begins = F.filter(F.sequence(F.lit(0), F.size(toks) - 1), lambda i: (i == 0) | (F.get(toks, i) != F.get(toks, i - 1)))
        return V.bind(begins, lambda b: F.zip_with(b, F.concat(F.slice(b, F.lit(2), F.size(b)), F.array(F.size(toks))), lambda x, y: F.struct(
            F.get(toks, x).alias("token"), (y - x).cast("double").alias("c"))))

    def scored(runs: Column, n: Column) -> Column:
        weighed = F.transform(runs, lambda e: F.struct(e["token"].alias("token"), (e["c"] / n).alias("tf"), seen[e["token"]].alias("idf")))
        return V.bind(weighed, lambda v: V.bind(V.total(F.transform(v, lambda e: F.pow(e["tf"] * F.coalesce(e["idf"], F.lit(idf(1))), F.lit(2.0)))), lambda norm: V.bind(
            F.filter(v, lambda e: e["idf"].isNotNull()), lambda known: F.array(*[cosine(p, known, norm) for p in corpus]))))

    def cosine(p: str, known: Column, norm: Column) -> Column:
        tf = {w: c / len(split[p]) for w, c in Counter(split[p]).items()}
        weight = literal({w: f * idf(base_df[w] + 1) for w, f in tf.items()})
        extra = literal({w: (f * idf(base_df[w] + 1)) ** 2 - (f * idf(base_df[w])) ** 2 for w, f in tf.items()})
        base = sum((f * idf(base_df[w])) ** 2 for w, f in tf.items())
        dot = V.total(F.transform(known, lambda e: F.coalesce(weight[e["token"]], F.lit(0.0)) * e["tf"] * e["idf"]))
        norm2 = F.lit(base) + V.total(F.transform(known, lambda e: F.coalesce(extra[e["token"]], F.lit(0.0))))
        score = F.round(F.try_divide(dot, F.sqrt(norm * norm2)), 12)
        return V.bind(dot, lambda d: F.when(d > 0, F.struct(score.alias("score"), F.lit(p).alias("policy"))))

    toks = F.sort_array(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN), F.lit(0)))
    met = V.bind(toks, lambda t: F.when(F.size(t) > 0, scored(run_lengths(t), F.size(t).cast("double"))))
    best = df.select(key, F.array_max(met).alias("m"))
    return best.select(key, F.coalesce("m.policy", F.lit(max(corpus))).alias("policy"), F.coalesce("m.score", F.lit(0.0)).alias("score"))


def parse_features(text: Column) -> Column:
    """(asset, feature) values written in a prompt, as an array of structs.

    Of repeated lines only the last counts."""
    pat = F.lit(FEATURE_LINE)
    parts = F.arrays_zip(
        F.regexp_extract_all(text, pat, F.lit(1)).alias("asset"),
        F.regexp_extract_all(text, pat, F.lit(2)).alias("feature"),
        F.transform(F.regexp_extract_all(text, pat, F.lit(3)), lambda v: v.cast("double")).alias("value"),
    )
    named = F.transform(parts, lambda e, i: F.struct(e["asset"].alias("asset"), e["feature"].alias("feature"), (-i).alias("later"), e["value"].alias("value")))
    # the last line of each name comes first among its own
    last = V.bind(F.array_sort(named), lambda v: F.filter(v, lambda e, i: (i == 0) | (F.get(v, i - 1)["asset"] != e["asset"]) | (F.get(v, i - 1)["feature"] != e["feature"])))
    return F.transform(last, lambda e: F.struct(e["asset"].alias("asset"), e["feature"].alias("feature"), e["value"].alias("value")))


# feature on which a single-core policy decides, and in which direction
RELEVANT = {"P1": ("r12m", "max"), "P2": ("vol3m", "min"), "P3": ("r3m", "min")}


def zero_feature_calls(calls: DataFrame, text: str = "prompt_text") -> DataFrame:
    """Which exact zeros reached the decision, per call, without a shuffle."""
    x = calls.withColumn("_f", parse_features(F.col(text)))
    zero = F.filter("_f", lambda e: e["value"] == 0.0)
    rel = F.lit("")
    for p, (f, _) in RELEVANT.items():
        rel = F.when(F.col("policy_id") == p, f).otherwise(rel)
    x = x.withColumns({"relevant_feature": rel, "_zero": zero})
    vals = F.filter("_f", lambda e: e["feature"] == F.col("relevant_feature"))
    x = x.withColumn("_vals", vals)
    target = F.exists("_vals", lambda e: (e["asset"] == F.col("target_asset")) & (e["value"] == 0.0))
    nums = F.transform("_vals", lambda e: e["value"])
    best = F.when(F.col("policy_id") == "P1", F.array_max(nums)).otherwise(F.array_min(nums))
    return x.withColumns(
        {
            "parsed_feature_count": F.size("_f"),
            "exact_zero_feature_count": F.size("_zero"),
            "has_exact_zero_feature": (F.size("_zero") > 0).cast("int"),
            "target_relevant_feature_is_zero": F.coalesce(target.cast("int"), F.lit(0)),
            "policy_optimum_selected_from_zero": F.coalesce((target & (best == 0.0)).cast("int"), F.lit(0)),
        }
    ).drop("_f", "_zero", "_vals")


def zero_feature_detail(calls: DataFrame, keys: list[str], text: str = "prompt_text") -> DataFrame:
    zero = F.filter(parse_features(F.col(text)), lambda e: e["value"] == 0.0)
    return calls.select(*keys, F.inline(zero))


def zero_feature_summary(call_rows: DataFrame) -> DataFrame:
    return call_rows.groupBy("policy_id").agg(
        F.count("*").alias("calls"), F.sum("has_exact_zero_feature").alias("calls_with_any_exact_zero"),
        F.avg("exact_zero_feature_count").alias("mean_exact_zero_features"),
        F.sum("target_relevant_feature_is_zero").alias("target_relevant_feature_zero"),
        F.sum("policy_optimum_selected_from_zero").alias("optimum_selected_from_zero"),
    )


def mask_labels(universe: DataFrame, condition: str, seed: int = 42) -> DataFrame:
    """(asset, ord, label): real names, numbered, shuffled or symbolic labels."""
    from weightloom.functions.draws import shuffle_rank_key

    i = F.row_number().over(Window.orderBy("ord"))
    numbered = F.format_string("Asset_%02d", i)
    if condition == "real_ticker":
        return universe.withColumn("label", F.col("asset"))
    if condition == "shuffled_masked":
        i = F.row_number().over(Window.orderBy(shuffle_rank_key(seed, F.col("asset"))))
        return universe.withColumn("label", F.format_string("Asset_%02d", i))
    if condition == "symbolic_masked":
        return universe.withColumn("label", F.format_string("X%02d", (i - 1) * 7 + 3))
    return universe.withColumn("label", numbered)


def unmask(weights: DataFrame, labels: DataFrame) -> DataFrame:
    """(key..., label, w) back to real assets; unknown labels drop out."""
    return weights.join(labels, "label").drop("label")


def feature_blocks(feats: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """One prompt feature block per key: five lines per asset, then cross_vol."""
    names = ("r1m", "r3m", "r12m", "vol3m", "mdd")
    x = feats.join(labels.select("asset", "label"), "asset")
    line = F.concat_ws("\n", *[
        F.concat(F.lit("- "), F.col("label"), F.lit(f"_{f}: "), F.format_string("%.8f", F.coalesce(f, F.lit(0.0)))) for f in names
    ])
    b = x.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("ord", line.alias("line"), "label"))).alias("v"), F.max("cross_vol").alias("cv")
    )
    last = F.format_string("- cross_vol: %.8f", F.coalesce("cv", F.lit(0.0)))
    return b.select(
        *keys, F.concat_ws("\n", F.transform("v", lambda e: e["line"]), last).alias("block"),
        F.concat_ws(", ", F.transform("v", lambda e: e["label"])).alias("assets"),
    )


def render_prompts(plan: DataFrame, blocks: DataFrame, keys: list[str], max_weight: float = 0.6, turnover_cap: float = 0.25, prompt_cap: float = 60.0) -> DataFrame:
    """Prompt text per planned call: policy template, optional constraint
    reminder, feature block, asset list and an optional worked-example block."""
    text = F.replace("template", F.lit("{prompt_cap_pct}"), F.lit(f"{prompt_cap:g}"))
    text = F.replace(text, F.lit("{max_weight}"), F.lit(f"{max_weight:.2f}"))
    reminder = F.lit(
        f"\nExecution limits: no short positions, weights add to one, at most {max_weight:.2f} per asset, "
        f"turnover at most {turnover_cap:.2f}; your proposal is projected onto them."
    )
    examples = F.coalesce(F.concat(F.lit("\n\n"), F.col("examples")), F.lit("")) if "examples" in plan.columns else F.lit("")
    body = F.concat(
        text, F.when(F.col("reminder"), reminder).otherwise(""), examples,
        F.lit("\n\nCurrent Features:\n"), F.col("block"), F.lit("\n\nAssets: "), F.col("assets"),
    )
    return plan.join(blocks, keys).withColumn("prompt_text", body).drop("block", "assets", "template")
