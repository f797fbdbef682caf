"""Call logs, return tables and tidy equity: readers, coercion, sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weightloom.functions.scalars import series_key, to_number

# ---- fixed values: schema of the call log ----------------------------------
_STRINGS = """call_id run_id experiment_id condition_id model_id policy_id complexity_level paraphrase_id mask_condition
conflict_type prompt_hash prompt_text raw_output done_reason attempt_diagnostics target_asset top_asset_raw
top_asset_projected raw_weights projected_weights reference_weights""".split()
_INTS = """rebalance_days json_valid parse_fail repair_used output_length attempt_count parse_retry_count
network_retry_count timeout_retry_count eval_count prompt_eval_count missing_asset_count hallucinated_asset_count
negative_weight_count invalid_weight_count dry_run collapse_flag raw_fidelity projected_fidelity raw_cap_violation
raw_longonly_violation post_feasible_budget post_feasible_cap post_feasible_longonly""".split()
_DOUBLES = """cost_bps wmax tau latency_sec eval_duration_sec top3_overlap allocation_l1_to_reference
allocation_l2_to_reference projection_l1 projection_l2 ew_l1_distance raw_sum raw_max_weight raw_min_weight
raw_budget_violation post_sum post_max_weight post_min_weight""".split()
# ----------------------------------------------------------------------------
CALL_SCHEMA = ", ".join(
    [f"{c} string" for c in _STRINGS] + ["decision_date date"] + [f"{c} int" for c in _INTS] + [f"{c} double" for c in _DOUBLES]
)


def read_calls_json(spark: SparkSession, path: str, schema: str = CALL_SCHEMA, multi_line: bool = False) -> DataFrame:
    """JSON lines (or one object per file); a fixed schema avoids an inference pass."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def read_calls_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV log: everything arrives as text and is coerced leniently."""
    return spark.read.option("header", True).option("escape", '"').csv(path)


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def combine_logs(logs: dict[str, DataFrame], required: list[str], numeric: list[str], tag: str = "source_log") -> DataFrame:
    """Union of several logs with a source tag, lenient dates and numbers."""
    tagged = [require_columns(df, required).withColumn(tag, F.lit(name)) for name, df in logs.items()]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    cols = {c: to_number(F.col(c).cast("string")) for c in numeric if c in out.columns}
    if "decision_date" in out.columns:
        cols["decision_date"] = F.col("decision_date").cast("string").try_cast("date")
    return out.withColumns(cols)


def row_count_check(df: DataFrame, expected: int, tag: str = "source_log") -> DataFrame:
    """Counts per source with the grand total compared to the expectation."""
    by = df.groupBy(tag).agg(F.count("*").alias("n"))
    total = by.agg(F.lit("ALL").alias(tag), F.sum("n").alias("n"))
    return by.unionByName(total).withColumn("as_expected", F.when(F.col(tag) == "ALL", (F.col("n") == expected).cast("int")))


def tidy_returns(df: DataFrame, date_names: tuple[str, ...] = ("date", "Date", "timestamp", "time")) -> DataFrame:
    """(date, strategy, ret) from a tidy or a wide table; unusable returns are 0."""
    date = next((c for c in date_names if c in df.columns), None)
    if date is None:
        raise ValueError("a return table needs a date column")
    df = df.withColumnRenamed(date, "date")
    if {"strategy", "return"} <= set(df.columns):
        long = df.select("date", "strategy", F.col("return").cast("string").alias("ret"))
    else:
        cols = [c for c in df.columns if c != "date"]
        long = df.select("date", *[F.col(c).cast("string") for c in cols]).unpivot(["date"], cols, "strategy", "ret")
    return long.select(F.to_date("date").alias("date"), "strategy", F.coalesce(to_number("ret"), F.lit(0.0)).alias("ret"))


def tidy_oos(df: DataFrame, policy_tags: tuple[str, ...]) -> DataFrame:
    """Out-of-sample curves with coerced columns, "NA" labels and a series key."""
    require_columns(df, ["date", "strategy", "model", "persona", "fold", "segment", "equity"])
    labels = {c: F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in ("strategy", "model", "persona", "segment")}
    x = df.withColumns(
        {
            **labels,
            "date": F.col("date").cast("string").try_cast("date"),
            "equity": to_number(F.col("equity").cast("string")),
            "fold": F.coalesce(to_number(F.col("fold").cast("string")), F.lit(0.0)).cast("int"),
        }
    ).where("date IS NOT NULL AND equity IS NOT NULL")
    return x.withColumn("series_key", series_key("strategy", "model", "persona", policy_tags))


def append_calls(calls: DataFrame, json_path: str, table_path: str) -> None:
    """Append results as JSON lines and as Parquet, partitioned by experiment."""
    calls.write.mode("append").json(json_path)
    calls.write.mode("append").partitionBy("experiment_id").parquet(table_path)


def upsert_batches(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write a stream of reports so that a replayed batch changes nothing.

    Every batch owns the folder of its number and replaces it whole: a batch that is run again
    after a failure, or after its checkpoint is lost, leaves the same files.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upserted(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """The latest report of each call over all batches, and ``reports``, how many there are."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(path).drop("batch")
    rest = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_s"), F.count("*").alias("reports"))
    return last.select(key, *[F.col(f"_s.{c}").alias(c) for c in rest], "reports")


def rebuild_exports(status: DataFrame, schema: str = CALL_SCHEMA) -> DataFrame:
    """Completed results as rows, in completion order."""
    done = status.where("status = 'completed' AND result_json IS NOT NULL")
    x = done.select("completed_at", F.col("call_id").alias("_id"), F.from_json("result_json", schema).alias("r"))
    return x.orderBy("completed_at", "_id").select("r.*")


def file_inventory(df: DataFrame) -> DataFrame:
    """Rows, columns and bytes of every file behind a file-based table."""
    n_cols = len(df.columns)
    x = df.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return x.groupBy("file").agg(F.count("*").alias("rows"), F.lit(n_cols).alias("columns"), F.max("bytes").alias("bytes"))


def write_artefacts(curves: DataFrame, path: str) -> None:
    """Per-strategy curves as one table partitioned by series, not many files."""
    curves.write.mode("overwrite").partitionBy("series").parquet(path)
