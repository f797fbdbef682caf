"""Exact, linearly interpolated percentiles that survive a hot key.

Spark's ``percentile`` keeps every distinct value of a group in one task.  Here
a mergeable sketch only brackets the wanted rank; the values inside the bracket
(a few rank-error widths) are counted exactly, everything below is one count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` in which NULL meets NULL; the keys of ``left`` are kept."""
    r = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(r, on, how).drop(*(f"__r_{k}" for k in keys))


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], accuracy: int = 10000
) -> DataFrame:
    """(keys, <name>...) for each name -> probability; NULL and NaN values do not count.

    The exact counts verify that the wanted ranks lie in their bracket; a bracket that
    misses them is an error, never a silent value.
    """
    names, ps = list(probs), list(probs.values())
    eps = 2.0 / accuracy
    x = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    edges = [max(p - eps, 0.0) for p in ps] + [min(p + eps, 1.0) for p in ps]
    b = x.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.percentile_approx("_v", edges, accuracy).alias("_q")
    )
    k = len(ps)
    # the bracket must cover the sketch's rank error; small groups need none
    small = F.col("_n") < 4 * accuracy
    lo = lambda i: F.when(small, F.lit(float("-inf"))).otherwise(F.col("_q")[i])
    hi = lambda i: F.when(small, F.lit(float("inf"))).otherwise(F.col("_q")[k + i])
    marks = F.array(
        *[
            F.struct(F.lit(i).alias("_i"), F.lit(p).alias("_p"), lo(i).alias("_lo"), hi(i).alias("_hi"))
            for i, p in enumerate(ps)
        ]
    )
    b = b.select(*keys, "_n", F.inline(marks))
    # values below the bracket collapse into the NULL group before the shuffle
    inside = join_groups(x, b, keys).where("_v <= _hi").withColumn("_v", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")))
    c = inside.groupBy(*keys, "_i", "_p", "_n", "_v").agg(F.count("*").alias("_c"))
    up = Window.partitionBy(*keys, "_i").orderBy(F.col("_v").asc_nulls_first())
    c = c.withColumn("_cum", F.sum("_c").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    pos = F.col("_p") * (F.col("_n") - 1)
    at = lambda r: F.min(F.when(F.col("_cum") > r, F.col("_v")))
    out = c.groupBy(*keys, "_i", "_p", "_n").agg(
        at(F.floor(pos)).alias("_a"), at(F.ceil(pos)).alias("_b"),
        (F.coalesce(F.max(F.when(F.col("_v").isNull(), F.col("_cum"))), F.lit(0)) <= F.min(F.floor(pos))).alias("_above"),
        (F.max("_cum") > F.max(F.ceil(pos))).alias("_below"),
    )
    val = F.col("_a") + (pos - F.floor(pos)) * (F.col("_b") - F.col("_a"))
    missed = F.raise_error(F.lit("a percentile lies outside its bracket")).cast("double")
    out = out.withColumn("_x", F.when(F.col("_above") & F.col("_below"), val).otherwise(missed))
    return out.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, F.col("_x"))).alias(n) for i, n in enumerate(names)])
