"""Feature archive: the one materialisation boundary of a study.

Panel, features and calendar are derived once, written to the shared folder and
read back by every rule, ledger and test, which keeps their plans short and
makes a lost executor cost a file read instead of a recomputation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weightloom.operators.panel import panel_grid, rolling_features
from weightloom.session import shared_dir
from weightloom.sources import testbed

_written: dict[tuple[str, str], str] = {}


def write_features(feats: DataFrame, path: str, universe: str = "default", mode: str = "append") -> None:
    """Archive a feature table, partitioned by universe; other universes stay."""
    feats.withColumn("universe", F.lit(universe)).write.mode(mode).partitionBy("universe").parquet(path)


def read_features(spark: SparkSession, path: str, universe: str = "default") -> DataFrame:
    """One universe of the archive; the predicate prunes partitions."""
    return spark.read.parquet(path).where(F.col("universe") == universe).drop("universe")


def _base(spark: SparkSession, sf_dir: str) -> str:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        path = shared_dir(spark, "features")
        grid = panel_grid(testbed.brand_prices(spark, sf_dir), testbed.brand_calendar(spark, sf_dir))
        write_features(rolling_features(grid), path, "brands")
        days = read_features(spark, path, "brands").groupBy("t", "dt").agg(F.max("n_dates").alias("n_dates"))
        days.coalesce(1).write.parquet(path + "-calendar")
        _written[key] = path
    return _written[key]


def brand_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset, ord, t, dt, n_dates, px, px_ff, r, ret, the features and cross_vol.

    Derived once per session and input folder."""
    return read_features(spark, _base(spark, sf_dir), "brands")


def brand_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, dt, n_dates) of the archived panel: one row per trading day."""
    return spark.read.parquet(_base(spark, sf_dir) + "-calendar")


def stored(spark: SparkSession, name: str, sf_dir: str, build) -> DataFrame:
    """A derived table written once per session and input folder, then read.

    A study keeps its scored call log as a table; rollups scan it instead of
    scoring every call again.
    """
    key = (spark.sparkContext.applicationId, f"{name}@{sf_dir}")
    if key not in _written:
        path = shared_dir(spark, name)
        build().write.parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])
