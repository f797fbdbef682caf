"""Derivations from the provided star-schema tables to the engine's inputs.

``lineitem`` joined to ``part`` gives a daily return panel per brand; ``orders``
joined to ``customer`` a second, small panel; ``documents``/``labels`` a call
log with 0/1 outcomes; ``events`` a timed status log; ``embeddings`` raw weight
vectors.  The derivations aggregate before anything is shuffled by asset, so a
hot brand costs at most one row per trading day downstream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weightloom.operators.panel import calendar
from weightloom.session import fan_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cells(priced: DataFrame, asset: str, day: str, cents: str) -> DataFrame:
    """(asset, dt, r): bounded daily returns from integer-exact averages."""
    return (
        priced.groupBy(F.col(asset).alias("asset"), F.to_date(day).alias("dt"))
        .agg(F.sum(cents).alias("cents"), F.count(cents).alias("n"))
        .where("n > 0")
        .select("asset", "dt", (F.lit(0.2) * (F.col("cents") / (F.lit(100.0) * F.col("n")) - F.lit(0.05))).alias("r"))
    )


def brand_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the null filters are spelled out so that the calendar and the panel read the
    # very same exchange instead of two that differ by an inferred predicate
    li = table(spark, sf_dir, "lineitem").where(
        "l_partkey IS NOT NULL AND l_shipdate IS NOT NULL AND l_discount IS NOT NULL"
    ).select("l_partkey", "l_shipdate", F.round(F.col("l_discount") * 100).cast("bigint").alias("cents"))
    part = table(spark, sf_dir, "part").where("p_partkey IS NOT NULL AND p_brand IS NOT NULL").select("p_partkey", "p_brand")
    return _cells(li.join(part, li.l_partkey == part.p_partkey), "p_brand", "l_shipdate", "cents")


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, ord) in plain string order of the brand."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("asset")).distinct()
    return brands.withColumn("ord", F.row_number().over(Window.orderBy("asset")))


def brand_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, ord, dt, r, px): level 100 compounded over the observed days."""
    w = Window.partitionBy("asset").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    # an explicit count: the panel is widened to every calendar day afterwards,
    # which an adaptively coalesced shuffle would do in one or two tasks
    cells = brand_returns(spark, sf_dir).repartition(fan_out(spark), "asset").withColumn("px", 100.0 * F.product(1.0 + F.col("r")).over(w))
    return cells.join(universe(spark, sf_dir), "asset").select("asset", "ord", "dt", "r", "px")


def brand_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading calendar straight from the return cells, without compounding."""
    return calendar(brand_returns(spark, sf_dir).withColumnRenamed("r", "px"))


def segment_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small universe: market segments, with returns from order-price cents."""
    o = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderdate", (F.round(F.col("o_totalprice") * 100).cast("bigint") % 11).alias("cents")
    )
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    cells = _cells(o.join(c, o.o_custkey == c.c_custkey), "c_mktsegment", "o_orderdate", "cents")
    w = Window.partitionBy("asset").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("asset")).distinct()
        .withColumn("ord", F.row_number().over(Window.orderBy("asset")))
    )
    return (
        cells.withColumn("px", 100.0 * F.product(1.0 + F.col("r")).over(w))
        .join(ranked, "asset")
        .select("asset", "ord", "dt", "r", "px")
    )
