"""Significance tests on paired return differences ``(series, t, diff)`` and on
blocked model scores.

A series has one row per trading day; windows are keyed by series (or by block),
so the group size is the calendar length, not the number of source records.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weightloom.functions.scalars import chi2_upper_p, finite, safe_t, stars, two_sided_p
from weightloom.operators.resample import block_bootstrap_p, mean_interval, positions, run_replicates
from weightloom.session import materialize


def paired_diffs(returns: DataFrame, baseline: str, key: str = "series", order: str = "t") -> DataFrame:
    """Difference to the baseline on the dates where both exist."""
    base = returns.where(F.col(key) == baseline).select(order, F.col("ret").alias("_b"))
    both = returns.where(F.col(key) != baseline).join(base, order)
    both = both.where(finite("ret").isNotNull() & finite("_b").isNotNull())
    return both.select(key, order, (F.col("ret") - F.col("_b")).alias("diff"))


def _bartlett(gammas: list[Column], n: Column, lags: int) -> Column:
    """gamma_0 + 2 sum w_k gamma_k with L = min(lags, n - 1), floored at 0."""
    top = F.least(F.lit(lags), n - 1)
    var = gammas[0]
    for k in range(1, lags + 1):
        weight = F.when(F.lit(k) <= top, 1.0 - F.lit(float(k)) / (top + 1)).otherwise(0.0)
        var = var + 2.0 * weight * gammas[k]
    return F.greatest(var, F.lit(0.0))


def _autocovariances(x: str, n: Column, lagged: list[str], t: str, lags: int) -> list[Column]:
    """Biased autocovariances as sums over one pass: products, heads and tails."""
    mu = F.avg(x)
    total = F.sum(x)
    out = [F.sum(F.col(x) * F.col(x)) / n - mu * mu]
    for k in range(1, lags + 1):
        cross = F.coalesce(F.sum(F.col(x) * F.col(lagged[k - 1])), F.lit(0.0))
        without_tail = total - F.coalesce(F.sum(F.when(F.col(t) >= F.col("n") - k, F.col(x))), F.lit(0.0))
        without_head = total - F.coalesce(F.sum(F.when(F.col(t) < k, F.col(x))), F.lit(0.0))
        out.append((cross - mu * (without_tail + without_head) + (n - k) * mu * mu) / n)
    return out


def hac_test(diffs: DataFrame, lags: int = 5, key: str = "series", value: str = "diff", order: str = "t") -> DataFrame:
    """Newey-West test of mean zero: (key, n, mean, hac_var, t_hac, p_hac)."""
    pos = positions(diffs, value, key, order)
    mu = F.avg("x").over(Window.partitionBy(key))
    c = pos.withColumn("mu", mu).withColumn("x", F.col("x") - F.col("mu"))
    w = Window.partitionBy(key).orderBy("pos")
    c = c.withColumns({f"_l{k}": F.lag("x", k).over(w) for k in range(1, lags + 1)})
    n = F.count("*")
    g = _autocovariances("x", n, [f"_l{k}" for k in range(1, lags + 1)], "pos", lags)
    a = c.groupBy(key).agg(n.alias("n"), F.first("mu").alias("mean"), *[e.alias(f"g{k}") for k, e in enumerate(g)])
    var = _bartlett([F.col(f"g{k}") for k in range(lags + 1)], F.col("n"), lags)
    a = a.withColumn("hac_var", F.when(F.col("n") >= 3, var))
    # no variance: an infinite standard error, hence t = 0
    t = F.when(F.col("hac_var") > 0, F.try_divide("mean", F.sqrt(F.col("hac_var") / F.col("n")))).when(
        F.col("hac_var").isNotNull(), 0.0
    )
    a = a.withColumn("t_hac", t)
    return a.select(key, "n", "mean", "hac_var", "t_hac", two_sided_p("t_hac").alias("p_hac"))


def excess_regression(diffs: DataFrame, lags: int = 5) -> DataFrame:
    """Constant regression of excess returns with HAC errors, annualised.
    Zero-variance series are not testable and give NULL."""
    h = hac_test(diffs, lags)
    ok = F.col("hac_var") > 0
    return h.select(
        "series", "n", F.col("mean").alias("mean_daily_excess"), (F.col("mean") * 252.0).alias("annualized_excess"),
        F.when(ok, F.col("t_hac")).alias("hac_t"), F.when(ok, F.col("p_hac")).alias("hac_p"),
    )


def diebold_mariano(pairs: DataFrame, h: int = 1, power: int = 1, lags: int | None = None) -> DataFrame:
    """Loss-differential test on (series, t, x, y) returns."""
    loss = {1: lambda r: -r, 2: lambda r: -(r * r)}.get(power, lambda r: -F.abs(r))
    d = pairs.select("series", "t", (loss(F.col("x")) - loss(F.col("y"))).alias("diff"))
    return hac_test(d, max(h - 1, 0) if lags is None else lags)


def _tied_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Average-tie rank ``rk`` and tie size ``ties`` of a value within keys."""
    w = Window.partitionBy(*keys)
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    rank = F.rank().over(w.orderBy(value))
    return df.withColumns({"ties": ties, "rk": rank + (ties - 1) / 2.0})


def wilcoxon(diffs: DataFrame, keys: list[str], value: str = "diff", pratt: bool = False, min_n: int = 10) -> DataFrame:
    """Signed-rank test by the tie-corrected normal approximation.

    Default: zeros are dropped, n < min_n gives NULL, equal magnitudes give 1.
    ``pratt``: zeros take part in the ranking and are then removed; all-zero
    differences are reported as not testable.
    """
    x = diffs.where(finite(value).isNotNull()).withColumn("_a", F.abs(value))
    if not pratt:
        x = x.where(F.col(value) != 0.0)
    r = _tied_ranks(x, keys, "_a")
    nz = F.col(value) != 0
    a = r.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum((~nz).cast("int")).alias("z"),
        F.sum(F.when(F.col(value) > 0, F.col("rk")).otherwise(0.0)).alias("r_plus"),
        F.sum(F.when(F.col(value) < 0, F.col("rk")).otherwise(0.0)).alias("r_minus"),
        F.sum(F.when(nz, F.col("ties") * F.col("ties") - 1).otherwise(0)).alias("tie_term"),
        F.stddev_samp("_a").alias("spread"), F.avg(value).alias("mean_diff"),
    )
    n, z = F.col("n").cast("double"), F.col("z").cast("double")
    mean = n * (n + 1) / 4 - z * (z + 1) / 4
    var = (n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1) - F.col("tie_term") / 2.0) / 24
    w = F.least("r_plus", "r_minus")
    a = a.withColumn("w", w).withColumn("zstat", F.when(var > 0, F.try_divide(w - mean, F.sqrt(var))))
    p = two_sided_p("zstat")
    if pratt:
        tested = F.col("n") > F.col("z")
        return a.select(*keys, "n", "mean_diff", F.when(tested, F.col("w")).alias("w"), F.when(tested, p).alias("p"),
                        F.when(tested, "tested").otherwise("not_testable_all_zero").alias("status"))
    p = F.when(F.col("n") < min_n, None).when(F.col("spread") == 0.0, 1.0).otherwise(F.coalesce(p, F.lit(1.0)))
    return a.select(*keys, "n", "w", p.alias("p"))


def jackknife_sharpe(diffs: DataFrame, key: str = "series", value: str = "diff") -> DataFrame:
    """Annualised Sharpe ratio and its delete-1 jackknife z in closed form.

    Leaving observation i out shifts mean and squared deviations by known
    amounts, so n ratios need one pass instead of n.
    """
    w = Window.partitionBy(key)
    x = diffs.where(finite(value).isNotNull()).withColumns(
        {"n": F.count("*").over(w), "mu": F.avg(value).over(w), "ss": (F.var_pop(value).over(w))}
    )
    n = F.col("n")
    dev = F.col(value) - F.col("mu")
    mean_i = F.col("mu") - dev / (n - 1)
    ss_i = F.col("ss") * n - dev * dev * n / (n - 1)
    root = math.sqrt(252.0)
    x = x.where("n >= 10 AND ss > 1e-16").withColumn(
        "theta", F.when(ss_i > 0, F.try_divide(mean_i * root, F.sqrt(ss_i / (n - 2))))
    )
    a = x.groupBy(key).agg(
        F.first("n").alias("n"), F.avg(value).alias("mu"), F.stddev_samp(value).alias("sd"), F.var_pop("theta").alias("v")
    )
    sharpe = F.try_divide(F.col("mu") * root, F.col("sd"))
    se = F.sqrt((F.col("n") - 1) * F.col("v"))
    return a.select(key, "n", sharpe.alias("sharpe"), F.when(se > 0, F.try_divide(sharpe, se)).alias("jk_z"))


def comparison_table(
    returns: DataFrame, baseline: str, group: str = "Default", algo: str = "Strategy", hac_lags: int = 5,
    block: int = 7, reps: int = 2000, seed: int = 42,
) -> DataFrame:
    """One row per comparator with all pairwise tests on its difference series."""
    d = materialize(paired_diffs(returns, baseline), "diffs")
    h = hac_test(d, hac_lags)
    out = (
        h.join(wilcoxon(d, ["series"]).select("series", F.col("p").alias("wilcoxon_p")), "series", "left")
        .join(jackknife_sharpe(d).select("series", "jk_z"), "series", "left")
        .join(block_bootstrap_p(d, block, reps, seed).select("series", "mbb_p"), "series", "left")
    )
    return out.select(
        F.lit(group).alias("grp"), F.lit(algo).alias("algo"), F.col("series").alias("comparator"), "n",
        (F.col("mean") * 252.0).alias("mean_diff_ann"), "t_hac", "p_hac", "wilcoxon_p", "jk_z", "mbb_p",
        stars("p_hac").alias("stars"),
    )


def reality_check(
    diffs: DataFrame, reps: int = 2000, p: float = 0.1, lags: int = 5, seed: int = 42, spa: bool = False, studentise: bool = True,
) -> DataFrame:
    """Data-snooping test: the largest t-like mean over strategies per stationary resample.

    ``spa`` clips the statistics at 0. Without ``studentise`` the spread is the plain standard
    error instead of the autocorrelation-robust one. Series of one length share a resample.
    """
    d = materialize(diffs.select("series", "t", "diff"), "diffs")
    lags = lags if studentise else 0
    n = F.col("n").cast("double")
    if studentise:
        obs = hac_test(d, lags).withColumn("sd", F.when(F.col("hac_var") > 0, F.sqrt(F.col("hac_var") / n)))
    else:
        obs = positions(d, "diff").groupBy("series").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
        obs = obs.withColumn("sd", F.col("sd") / F.sqrt(n))
    stat = safe_t("mean", "sd")
    obs = obs.select("series", F.col("mean").alias("mean_diff"), (F.greatest(stat, F.lit(0.0)) if spa else stat).alias("t_like"))
    pos = positions(d, "diff").withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy("series")))
    b = run_replicates(pos, reps, p, lags, seed).withColumn("mu", F.col("s") / n)
    mu, g0 = F.col("mu"), F.col("c0") / n - F.col("mu") * F.col("mu")
    if studentise:
        inner = lambda k: (F.col("s") - F.col(f"tail{k}")) + (F.col("s") - F.col(f"head{k}"))
        gammas = [g0, *[(F.col(f"c{k}") - mu * inner(k) + (n - k) * mu * mu) / n for k in range(1, lags + 1)]]
        var = _bartlett(gammas, n, lags)
    else:
        var = F.greatest(g0, F.lit(0.0)) * n / (n - 1)
    tb = F.when(var > 0, F.try_divide("mu", F.sqrt(var / n))).otherwise(0.0)
    top = b.select("rep", (F.greatest(tb, F.lit(0.0)) if spa else tb).alias("tb")).groupBy("rep").agg(F.max("tb").alias("top"))
    # one array of replicate maxima: its length is the number of replicates
    tops = top.agg(F.collect_list("top").alias("tops"))
    j = obs.join(F.broadcast(tops))
    pv = F.size(F.filter("tops", lambda v: v >= F.col("t_like"))) / F.size("tops")
    return j.withColumn("p", pv).select("series", "mean_diff", "t_like", "p", stars("p").alias("stars"))


# ------------------------------------------------------- blocked comparisons --


def complete_blocks(scores: DataFrame, keys: list[str], block: str, treatment: str, value: str) -> DataFrame:
    """Rows of the blocks in which every treatment of the group has a value."""
    x = scores.where(finite(value).isNotNull())
    k = x.groupBy(*keys).agg(F.countDistinct(treatment).alias("k"))
    full = x.groupBy(*keys, block).agg(F.countDistinct(treatment).alias("_c")).join(k, keys).where("_c = k")
    return x.join(full.select(*keys, block, "k"), [*keys, block])


def friedman(scores: DataFrame, keys: list[str], block: str, treatment: str, value: str) -> DataFrame:
    """Tie-corrected Friedman chi-square, its p and Kendall's W per group."""
    x = complete_blocks(scores, keys, block, treatment, value)
    r = _tied_ranks(x, [*keys, block], value)
    per = r.groupBy(*keys, treatment).agg(
        F.sum("rk").alias("s"), F.count("*").alias("n"), F.first("k").alias("k"),
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum(F.col("ties") * F.col("ties") - 1).alias("tie"),
    )
    a = per.groupBy(*keys).agg(
        F.first("n").alias("n_blocks"), F.first("k").alias("n_models"), F.sum(F.col("s") * F.col("s")).alias("ssq"),
        F.sum("tie").alias("tie"), (F.max("hi") - F.min("lo")).alias("span"),
    )
    n, k = F.col("n_blocks").cast("double"), F.col("n_models").cast("double")
    c = 1.0 - F.try_divide(F.col("tie"), k * (k * k - 1) * n)
    chi = F.try_divide(12.0 / (k * n * (k + 1)) * F.col("ssq") - 3.0 * n * (k + 1), c)
    ok = (n >= 2) & (k >= 3) & (F.col("span") > 1e-12)
    a = a.withColumn("chi2", F.when(ok, chi))
    return a.select(
        *keys, "n_blocks", "n_models", "chi2", chi2_upper_p("chi2", k - 1).alias("p"),
        F.try_divide(F.col("chi2"), n * (k - 1)).alias("kendalls_w"), F.col("chi2").isNull().cast("int").alias("untestable"),
    )


def treatment_pairs(scores: DataFrame, keys: list[str], block: str, treatment: str, value: str) -> DataFrame:
    """Paired differences of every two treatments over the complete blocks.

    The self-join meets on (group, block); a block holds one value per treatment.
    """
    x = complete_blocks(scores, keys, block, treatment, value)
    a = x.select(*keys, block, F.col(treatment).alias("a"), F.col(value).alias("_x"))
    b = x.select(*keys, block, F.col(treatment).alias("b"), F.col(value).alias("_y"))
    return a.join(b, [*keys, block]).where("a < b").select(*keys, "a", "b", block, (F.col("_x") - F.col("_y")).alias("diff"))


def holm(tests: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """Holm step-down adjustment within keys; untestable rows stay NULL."""
    w = Window.partitionBy(*keys).orderBy(F.col(p).asc_nulls_last(), *[c for c in tests.columns if c not in keys and c != p][:2])
    m = F.count(p).over(Window.partitionBy(*keys))
    raw = (m - F.row_number().over(w) + 1) * F.col(p)
    x = tests.withColumn("_h", raw)
    run = F.max("_h").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("p_holm", F.when(F.col(p).isNotNull(), F.least(run, F.lit(1.0)))).drop("_h")


def posthoc(scores: DataFrame, keys: list[str], block: str, treatment: str, value: str, alpha: float = 0.05) -> DataFrame:
    """Pairwise signed-rank tests, only where the omnibus test rejects."""
    sig = friedman(scores, keys, block, treatment, value).where(F.col("p") < alpha).select(*keys)
    d = treatment_pairs(scores.join(sig, keys, "left_semi"), keys, block, treatment, value)
    return holm(wilcoxon(d, [*keys, "a", "b"], pratt=True), keys)


def descriptives(scores: DataFrame, keys: list[str], row_id: list[str], value: str, reps: int = 2000, seed: int = 42) -> DataFrame:
    """n, mean, sd, median and bootstrap interval of the mean."""
    from weightloom.functions.quantiles import exact_percentiles, join_groups

    x = scores.where(finite(value).isNotNull())
    a = x.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    ci = mean_interval(x, keys, row_id, value, reps, seed).select(*keys, "ci95_lower", "ci95_upper")
    return join_groups(join_groups(a, exact_percentiles(x, keys, value, {"median": 0.5}), keys), ci, keys, "left")


def varying_cells(df: DataFrame, cell: str, success: str) -> DataFrame:
    """Rows whose cell shows both outcomes; constant cells carry no information."""
    keep = df.groupBy(cell).agg(F.min(success).alias("_a"), F.max(success).alias("_b")).where("_a < _b").select(cell)
    return df.join(keep, cell, "left_semi")


def clustered_logit(df: DataFrame, success: str, factors: list[str], cluster: str) -> DataFrame:
    """Logistic model of success on dummy-coded factors with cluster-robust errors.

    Working independence: the coefficients come from Spark ML's generalized
    linear regression, the errors from the score sums of each cluster.  Only
    moments of the parameter dimension reach the driver.
    """
    import numpy as np
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import GeneralizedLinearRegression

    spark = df.sparkSession
    x = df.select(F.col(success).cast("double").alias("label"), F.col(cluster).alias("_cluster"), *factors)
    x = materialize(x, "logit-input")
    ix = StringIndexer(inputCols=factors, outputCols=[f"{f}_ix" for f in factors], stringOrderType="alphabetDesc").fit(x)
    x = ix.transform(x)
    enc = OneHotEncoder(inputCols=[f"{f}_ix" for f in factors], outputCols=[f"{f}_oh" for f in factors], dropLast=True).fit(x)
    x = VectorAssembler(inputCols=[f"{f}_oh" for f in factors], outputCol="features").transform(enc.transform(x))
    model = GeneralizedLinearRegression(family="binomial", link="logit", maxIter=50).fit(x)
    names = ["(Intercept)"] + [
        f"{f}={lab}" for f, labels in zip(factors, ix.labelsArray) for lab in list(labels)[:-1]
    ]
    p = len(names)
    s = model.transform(x).select(
        "_cluster", "label", "prediction", F.concat(F.array(F.lit(1.0)), vector_to_array("features")).alias("z")
    )
    w = F.col("prediction") * (1.0 - F.col("prediction"))
    resid = F.col("label") - F.col("prediction")
    zi = lambda i: F.col("z")[i]
    bread = s.agg(*[F.sum(w * zi(i) * zi(j)).alias(f"b{i}_{j}") for i in range(p) for j in range(i, p)]).first()
    score = s.groupBy("_cluster").agg(*[F.sum(resid * zi(i)).alias(f"u{i}") for i in range(p)])
    meat = score.agg(
        F.count("*").alias("g"), *[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i in range(p) for j in range(i, p)]
    ).first()
    full = lambda row, c: np.array([[row[f"{c}{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    inv = np.linalg.pinv(full(bread, "b"))
    cov = inv @ full(meat, "m") @ inv
    beta = np.concatenate([[model.intercept], model.coefficients.toArray()])
    se = np.sqrt(np.clip(np.diag(cov), 0.0, None))
    rows = [(nm, float(b), float(e), int(meat["g"])) for nm, b, e in zip(names, beta, se)]
    out = spark.createDataFrame(rows, "term string, coefficient double, se double, clusters int")
    z = F.try_divide("coefficient", "se")
    return out.withColumn("zstat", z).select(
        "term", "coefficient", F.exp("coefficient").alias("odds_ratio"), "se", two_sided_p("zstat").alias("p_value"),
        (F.col("coefficient") - 1.959963984540054 * F.col("se")).alias("ci_low"),
        (F.col("coefficient") + 1.959963984540054 * F.col("se")).alias("ci_high"), "clusters",
    )
