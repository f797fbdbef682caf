"""Bootstraps as joins on reproducible draws.

Draws are digests of (seed, replicate, slot), see functions/draws.py.  The
replicate key carries the parallelism: generator rows are spread over the
cluster before they expand, and what is resampled is first reduced to
sufficient statistics (cluster sums, block sums), never the raw records.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weightloom.functions import draws as R
from weightloom.functions.vectors import bind, total
from weightloom.session import fan_out, materialize

CHUNK = 1024  # digests per generator row
SLICE = 1 << 16  # clusters of a scope in one row, where they are broadcast
BROADCAST = 1 << 21  # clusters that are broadcast at most: 16 bytes each
CI = (0.025, 0.975)


def spread_index(df: DataFrame, scope: list[str], keys: list[str]) -> DataFrame:
    """Dense 0-based ``idx`` per scope in the order (digest prefix, keys).

    Numbering runs inside 256 digest buckets plus the bucket's offset, so no
    window ever holds all clusters of a scope.
    """
    x = df.withColumn("_b", F.substring(R.digest(*keys), 1, 2))
    counts = x.groupBy(*scope, "_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*scope).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*scope, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*scope, "_b").orderBy(*keys)
    x = x.withColumn("_r", F.row_number().over(inside) - 1)
    return x.join(offs, [*scope, "_b"]).withColumn("idx", F.col("_r") + F.col("_o")).drop("_b", "_r", "_o")


def slots(sizes: DataFrame, reps: int, seed: int, count: str | Column, modulus: str, keys: list[str]) -> DataFrame:
    """(keys, rep, slot, draw) with draw in [0, modulus): ``count`` slots per replicate."""
    n = F.col(count) if isinstance(count, str) else count
    digests = F.floor((n - 1) / R.LANES)
    r = sizes.withColumn("_n", n).select("*", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    r = r.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(digests / CHUNK))).alias("_chunk"))
    r = r.repartition(fan_out(sizes.sparkSession), *keys, "rep", "_chunk")
    lo = F.col("_chunk") * CHUNK
    r = r.select("*", F.explode(F.sequence(lo, F.least(lo + CHUNK - 1, F.floor((F.col("_n") - 1) / R.LANES)))).alias("_blk"))
    r = r.withColumn("_h", R.digest(F.lit(seed), "rep", "_blk"))
    r = r.select("*", F.posexplode(F.array(*[R.lane(F.col("_h"), k) for k in range(R.LANES)])).alias("_lane", "_u"))
    slot = F.col("_blk") * R.LANES + F.col("_lane")
    r = r.withColumn("slot", slot).where(F.col("slot") < F.col("_n"))
    return r.select(*keys, "rep", "slot", F.pmod(F.col("_u"), F.col(modulus)).alias("draw"))


def with_size(g: DataFrame, sizes: DataFrame, scope: list[str]) -> DataFrame:
    """``g`` with the number of clusters of its scope as ``_n``; a scope may be NULL."""
    n = sizes.select(*[F.col(k).alias(f"_s_{k}") for k in scope], F.col("clusters").alias("_n"))
    if not scope:
        return g.join(F.broadcast(n))  # one row
    cond = F.lit(True)
    for k in scope:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
    return g.join(n, cond).drop(*[f"_s_{k}" for k in scope])


def cluster_draws(d: DataFrame, g: DataFrame, sizes: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, rep, _sum, _cnt): the cluster that each of the draws ``d`` hits, in every scope of its size.

    Draws are many times the rows that they are made from, which Spark's estimate of their size
    does not show, so the join is named. Up to ``BROADCAST`` clusters travel as arrays of ``SLICE``
    clusters and the draws stay where they are made; more are hashed, a part of them in each task.
    """
    if g.count() > BROADCAST:
        right = with_size(g, sizes, scope)
        found = d.join(right.hint("shuffle_hash"), (d["clusters"] == right["_n"]) & (d["draw"] == right["idx"]))
        return found.select(*scope, "rep", "_sum", "_cnt")
    cells = F.array_sort(F.collect_list(F.struct("idx", "_sum", "_cnt")))
    packed = g.groupBy(*scope, F.floor(F.col("idx") / SLICE).alias("_slice")).agg(cells.alias("_v"))
    packed = packed.select(*scope, "_slice", F.col("_v._sum").alias("_sums"), F.col("_v._cnt").alias("_cnts"))
    right = materialize(with_size(packed, sizes, scope), "cluster-slices")
    d = d.withColumn("_part", F.floor(F.col("draw") / SLICE))
    at = F.pmod("draw", F.lit(SLICE)).cast("int")
    found = d.join(F.broadcast(right), (d["clusters"] == right["_n"]) & (d["_part"] == right["_slice"]))
    return found.select(*scope, "rep", F.get("_sums", at).alias("_sum"), F.get("_cnts", at).alias("_cnt"))


def cluster_bootstrap(
    df: DataFrame, scope: list[str], cluster_keys: list[str], metric: str, reps: int = 10_000, seed: int = 42
) -> DataFrame:
    """Whole-cluster percentile bootstrap of a ratio of sums, per scope.

    Scopes with fewer than two clusters keep their estimate with a NULL interval.
    """
    usable = df.where(F.col(metric).isNotNull())
    for k in cluster_keys:
        usable = usable.where(F.col(k).isNotNull())
    g = usable.groupBy(*scope, *cluster_keys).agg(F.sum(metric).cast("double").alias("_sum"), F.count(metric).alias("_cnt"))
    g = materialize(spread_index(g, scope, cluster_keys).select(*scope, F.col("idx"), "_sum", "_cnt"), "clusters")
    sizes = g.groupBy(*scope).agg(
        F.count("*").alias("clusters"), F.sum("_cnt").alias("records"), (F.sum("_sum") / F.sum("_cnt")).alias("estimate")
    )
    # draws depend on the number of clusters alone: scopes of one size share them
    d = slots(sizes.where("clusters >= 2").select("clusters").distinct(), reps, seed, "clusters", "clusters", ["clusters"])
    boot = cluster_draws(d, g, sizes, scope).groupBy(*scope, "rep").agg((F.sum("_sum") / F.sum("_cnt")).alias("value"))
    ci = boot.groupBy(*scope).agg(F.percentile("value", F.array(*[F.lit(p) for p in CI])).alias("q"))
    out = sizes.join(ci, scope, "left") if scope else sizes.join(F.broadcast(ci))
    return out.select(*scope, "estimate", F.col("q")[0].alias("ci95_lower"), F.col("q")[1].alias("ci95_upper"), "records", "clusters")


def scoped_bootstrap(
    df: DataFrame, scopes: dict[str, Column], each: str | None, cluster_keys: list[str], metrics: list[str], reps: int = 10_000, seed: int = 42,
) -> DataFrame:
    """Whole-cluster bootstrap of several metrics over several scopes in one job.

    ``scopes`` names conditions on rows; ``each`` adds a scope for every value of a column. A row
    counts once for each of its scopes; rows are reduced to cluster sums before anything is drawn.
    """
    named = [F.when(cond, F.lit(name)) for name, cond in scopes.items()]
    own = [F.col(each).cast("string")] if each else []
    x = df.withColumn("scope", F.explode(F.filter(F.array(*named, *own), lambda v: v.isNotNull())))
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    x = x.select("scope", *cluster_keys, F.inline(pairs))
    return cluster_bootstrap(x, ["scope", "metric"], cluster_keys, "value", reps, seed)


def mean_interval(df: DataFrame, scope: list[str], row_id: list[str], metric: str, reps: int = 2000, seed: int = 42) -> DataFrame:
    """IID bootstrap interval of a mean: every record is its own cluster."""
    return cluster_bootstrap(df, scope, row_id, metric, reps, seed)


def positions(df: DataFrame, value: str, key: str = "series", order: str = "t") -> DataFrame:
    """(key, pos, n, x): 0-based position inside each series (one row per day)."""
    w = Window.partitionBy(key)
    x = df.where(F.col(value).isNotNull())
    return x.select(
        key, (F.row_number().over(w.orderBy(order)) - 1).alias("pos"), F.count("*").over(w).cast("int").alias("n"),
        F.col(value).alias("x"),
    )


def block_sums(pos: DataFrame, block: int, key: str = "series") -> DataFrame:
    """(key, n, start, s1, s2, p1, p2): circular sums and square sums of the block
    from ``start``; p* cover the shortened last block of a resample."""
    tail = F.col("n") - (F.ceil(F.col("n") / block) - 1) * block
    wrapped = pos.where(F.col("pos") < block - 1).withColumn("pos", F.col("pos") + F.col("n"))
    ext = pos.unionByName(wrapped).withColumn("_tail", tail)
    w = Window.partitionBy(key).orderBy("pos")
    full = w.rowsBetween(0, block - 1)
    x2 = F.col("x") * F.col("x")
    ext = ext.withColumns(
        {"s1": F.sum("x").over(full), "s2": F.sum(x2).over(full), "_xs": F.collect_list("x").over(full)}
    ).where("pos < n")
    part = F.slice("_xs", 1, F.col("_tail").cast("int"))
    add = lambda f: F.aggregate(part, F.lit(0.0), lambda a, v: a + f(v))
    return ext.select(key, "n", F.col("pos").alias("start"), "s1", "s2", add(lambda v: v).alias("p1"), add(lambda v: v * v).alias("p2"))


def block_replicates(pos: DataFrame, block: int, reps: int, seed: int, key: str = "series") -> DataFrame:
    """(key, n, rep, s1, s2): sums and square sums of circular-block resamples.

    A block contributes its precomputed sums, so a replicate costs n/block rows
    instead of n.
    """
    sums = materialize(block_sums(pos, block, key), "blocks")
    # one set of draws per series length, shared by all series of that length
    sizes = sums.select("n").distinct()
    d = slots(sizes, reps, seed, F.ceil(F.col("n") / block), "n", ["n"])
    d = d.select(F.col("n").alias("_n"), "rep", "slot", F.col("draw").cast("int").alias("_s"))
    # named, as the size of the draws would be taken for that of the lengths, and they be broadcast
    j = d.join(sums.hint("merge"), (d["_n"] == sums["n"]) & (d["_s"] == sums["start"]))
    last = F.col("slot") == F.ceil(F.col("n") / block) - 1
    pick = lambda full, part: F.sum(F.when(last, F.col(part)).otherwise(F.col(full)))
    return j.groupBy(key, "n", "rep").agg(pick("s1", "p1").alias("s1"), pick("s2", "p2").alias("s2"))


def block_bootstrap_p(
    diffs: DataFrame, block: int = 7, reps: int = 2000, seed: int = 42, key: str = "series", value: str = "diff", two_sided: bool = True,
) -> DataFrame:
    """p of mean zero from centred circular-block resamples, two-sided or against a greater mean.

    NULL for fewer than 5 values, fewer than 200 draws or blocks of one value.
    """
    pos = positions(diffs, value, key)
    w = Window.partitionBy(key)
    c = pos.withColumn("mu", F.avg("x").over(w)).withColumn("x", F.col("x") - F.col("mu"))
    mu = pos.groupBy(key).agg(F.avg("x").alias("mu"))
    boot = block_replicates(c.drop("mu"), block, reps, seed, key)
    j = boot.join(mu, key)
    mean = F.col("s1") / F.col("n")
    hit = ((F.abs(mean) >= F.abs("mu")) if two_sided else (mean >= F.col("mu"))).cast("double")
    ok = (F.col("n") >= 5) & F.lit(block >= 2 and reps >= 200)
    return j.groupBy(key, "n").agg(F.avg(hit).alias("p")).select(key, "n", F.when(ok, F.col("p")).alias("mbb_p"))


def block_sharpe_interval(diffs: DataFrame, block: int = 20, reps: int = 2000, seed: int = 42, key: str = "series", value: str = "diff") -> DataFrame:
    """Circular-block percentile interval of the annualised Sharpe ratio."""
    pos = positions(diffs, value, key)
    b = block_replicates(pos, block, reps, seed, key)
    n = F.col("n")
    var = (F.col("s2") - F.col("s1") * F.col("s1") / n) / (n - 1)
    b = b.withColumn("sharpe", F.when(var > 0, F.try_divide(F.col("s1") / n, F.sqrt(var)) * math.sqrt(252.0)))
    ci = b.groupBy(key).agg(F.percentile("sharpe", F.array(*[F.lit(p) for p in CI])).alias("q"))
    est = pos.groupBy(key).agg(
        F.count("*").alias("n"), (F.try_divide(F.avg("x"), F.stddev_samp("x")) * math.sqrt(252.0)).alias("estimate")
    )
    return est.join(ci, key).select(key, "n", "estimate", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


def stationary_index(sizes: DataFrame, reps: int, p: float = 0.1, seed: int = 42) -> DataFrame:
    """(n, rep, t, idx) of the stationary bootstrap for each series length n.

    A restart at t draws a new start; between restarts the index advances by
    one.  Carrying the last restart forward replaces the sequential loop.
    """
    r = sizes.select("n", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    r = r.repartition(fan_out(sizes.sparkSession), "n", "rep")
    r = r.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("t"))
    h = R.digest(F.lit(seed), "rep", "t")
    fresh = (F.col("t") == 0) | (R.uniform(F.col("_h"), 0) < p)
    r = r.withColumn("_h", h).withColumn("_start", F.when(fresh, F.pmod(R.lane(F.col("_h"), 1), F.col("n"))))
    r = r.withColumn("_at", F.when(F.col("_start").isNotNull(), F.col("t")))
    w = Window.partitionBy("n", "rep").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    start, at = F.last("_start", ignorenulls=True).over(w), F.last("_at", ignorenulls=True).over(w)
    return r.select("n", "rep", "t", F.pmod(start + F.col("t") - at, F.col("n")).cast("int").alias("idx"))


def stationary_runs(sizes: DataFrame, reps: int, p: float = 0.1, seed: int = 42, lags: int = 0) -> DataFrame:
    """(n, rep, start, len, head, tail, here, before): the stationary bootstrap as its runs.

    The same draws as ``stationary_index``, but a replicate is one row with about n * p runs:
    source position and length of each, in order. ``head`` and ``tail`` are the first and last
    ``lags`` resampled source positions; ``here[k - 1]`` and ``before[k - 1]`` the pairs of
    source positions that lie k apart in the resample with a restart between them.
    """
    r = sizes.select(F.col("n").cast("int").alias("n"), F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    r = r.repartition(fan_out(sizes.sparkSession), "n", "rep")
    r = r.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at")).withColumn("_h", R.digest(F.lit(seed), "rep", "at"))
    fresh = r.where((F.col("at") == 0) | (R.uniform(F.col("_h"), 0) < p))
    fresh = fresh.select("n", "rep", "at", F.pmod(R.lane(F.col("_h"), 1), F.col("n")).cast("int").alias("start"))
    v = fresh.groupBy("n", "rep").agg(F.array_sort(F.collect_list(F.struct("at", "start"))).alias("v"))
    v = v.select("n", "rep", F.transform("v", lambda e: e["at"]).alias("at"), F.transform("v", lambda e: e["start"]).alias("start"))
    after = F.concat(F.slice("at", 2, F.size("at")), F.array("n"))
    v = v.withColumn("len", F.zip_with("at", after, lambda a, b: b - a))
    index = F.flatten(F.zip_with("start", "len", lambda s, m: F.transform(F.sequence(F.lit(0), m - 1), lambda o: F.pmod(s + o, F.col("n")))))

    def crossing(ix: Column, k: int, back: int) -> Column:
        inner = lambda e: F.filter(F.sequence(F.lit(0), F.least(F.lit(k), e["len"]) - 1), lambda o: e["at"] + o >= k)
        runs = F.filter(F.arrays_zip("at", "len"), lambda e: e["at"] > 0)
        return F.flatten(F.transform(runs, lambda e: F.transform(inner(e), lambda o: F.get(ix, e["at"] + o - back))))

    def parts(ix: Column) -> Column:
        none = F.array().cast("array<array<int>>")
        return F.struct(
            F.slice(ix, 1, max(lags, 1)).alias("head"), F.reverse(F.slice(F.reverse(ix), 1, max(lags, 1))).alias("tail"),
            (F.array(*[crossing(ix, k, 0) for k in range(1, lags + 1)]) if lags else none).alias("here"),
            (F.array(*[crossing(ix, k, k) for k in range(1, lags + 1)]) if lags else none).alias("before"),
        )

    return v.withColumn("_p", bind(index, parts)).select("n", "rep", "start", "len", "_p.*")


def prefix_vectors(pos: DataFrame, lags: int, key: str = "series") -> DataFrame:
    """(key, n, x, total, cross): a series as an array, and prefix sums over two rounds of it of the
    values and, in ``cross[k]``, of the products with the value k positions before (around the end)."""
    before = pos.where(F.col("pos") >= F.col("n") - lags).withColumn("pos", F.col("pos") - F.col("n"))
    again = pos.withColumn("pos", F.col("pos") + F.col("n"))
    w = Window.partitionBy(key, "n").orderBy("pos")
    ext = before.unionByName(pos).unionByName(again)
    ext = ext.withColumns({f"q{k}": F.col("x") * (F.lag("x", k).over(w) if k else F.col("x")) for k in range(lags + 1)}).where("pos >= 0")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    names = ["s", *[f"p{k}" for k in range(lags + 1)]]
    sums = [F.sum(F.coalesce(c, F.lit(0.0))).over(up) for c in ("x", *[f"q{k}" for k in range(lags + 1)])]
    ext = ext.select(key, "n", "pos", "x", *[c.alias(name) for name, c in zip(names, sums)])
    a = ext.groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct("pos", "x", *names))).alias("v"))
    column = lambda name: F.transform("v", lambda e: e[name])
    prefix = lambda name: F.concat(F.array(F.lit(0.0)), column(name))
    return a.select(key, F.col("n").cast("int").alias("n"), F.slice(column("x"), F.lit(1), F.col("n").cast("int")).alias("x"), prefix("s").alias("total"), F.array(*[prefix(name) for name in names[1:]]).alias("cross"))


def run_replicates(pos: DataFrame, reps: int, p: float = 0.1, lags: int = 5, seed: int = 42, key: str = "series") -> DataFrame:
    """(key, n, rep, s, c0 .. c<lags>, head1 .., tail1 ..): sums of stationary resamples of (key, pos, n, x).

    ``c<k>`` sums the products of values k apart; ``head<k>`` and ``tail<k>`` the first and last k
    values. A replicate of a series costs its runs and their borders, not its days, and nothing
    is sorted. Replicates meet the series of their length in blocks: a block of series is a salt
    of the replicates, so that one length, which all series may share, is no single key.
    """
    spark = pos.sparkSession
    blocks, rounds = fan_out(spark), 4
    series = materialize(prefix_vectors(pos, lags, key), "prefix-sums")
    series = series.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    runs = materialize(stationary_runs(pos.select("n").distinct(), reps, p, seed, lags), "stationary-runs")
    runs = runs.withColumn("_r", F.col("rep") % rounds).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    j = series.join(runs, ["n", "_b", "_r"])

    def within(k: int) -> Column:
        q = F.get("cross", F.lit(k))
        return bind(q, lambda c: total(F.zip_with("start", "len", lambda s, m: F.when(m > k, F.get(c, s + m) - F.get(c, s + k)).otherwise(0.0))))

    def across(k: int) -> Column:
        return total(F.zip_with(F.get("here", F.lit(k - 1)), F.get("before", F.lit(k - 1)), lambda a, b: F.get("x", a) * F.get("x", b)))

    pick = lambda at: total(F.transform(at, lambda i: F.get("x", i)))
    back = lambda k: F.slice(F.reverse("tail"), 1, k)
    s = total(F.zip_with("start", "len", lambda a, m: F.get("total", a + m) - F.get("total", a)))
    return j.select(
        key, "n", "rep", s.alias("s"), *[(within(k) + across(k) if k else within(0)).alias(f"c{k}") for k in range(lags + 1)],
        *[pick(F.slice("head", 1, k)).alias(f"head{k}") for k in range(1, lags + 1)], *[pick(back(k)).alias(f"tail{k}") for k in range(1, lags + 1)],
    )
