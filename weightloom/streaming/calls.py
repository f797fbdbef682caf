"""Following an append-only call log with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weightloom.session import shared_dir


def read_log(spark: SparkSession, path: str, schema: str, fmt: str = "json", pattern: str | None = None, per_trigger: int = 100) -> DataFrame:
    """File stream of a growing log; a fixed schema and a bounded intake per trigger."""
    r = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r.load(path)


def first_reports(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Each call once: repeats within the watermark are dropped, state expires."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def window_counts(stream: DataFrame, ts: str, keys: list[str], width: str) -> DataFrame:
    """Tumbling counts by status; a window appears once the watermark passes it."""
    g = stream.groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def sliding_latency(stream: DataFrame, ts: str, keys: list[str], value: str, width: str, slide: str) -> DataFrame:
    """Mean and maximum latency by key over sliding windows."""
    g = stream.groupBy(F.window(ts, width, slide), *keys).agg(F.avg(value).alias("mean_latency"), F.max(value).alias("max_latency"), F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), *keys, "mean_latency", "max_latency", "n")


STALE_OUT = "key string, last_seen timestamp, next_seen timestamp, gap_sec double, kind string"
_STATE = "last_us long"


def stale_gaps(stream: DataFrame, key: str, ts: str, threshold_sec: float, delay: str = "0 seconds") -> DataFrame:
    """Silences longer than the threshold, per key.

    The state is one timestamp per key.  A gap between two reports is emitted
    when its end arrives (kind "gap"); a key that stays silent until the
    watermark passes its deadline is emitted once by the event-time timer
    (kind "silent").
    """
    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def rows(pairs, kind):
            return pd.DataFrame({
                "key": [str(k[0])] * len(pairs), "last_seen": pd.to_datetime([a for a, _ in pairs], unit="us"),
                "next_seen": pd.to_datetime([b for _, b in pairs], unit="us"),
                "gap_sec": [(b - a) / 1e6 if b is not None else None for a, b in pairs], "kind": [kind] * len(pairs),
            })

        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield rows([(last, None)], "silent")
            return
        times = np.sort(np.concatenate([b["_us"].to_numpy(dtype="int64") for b in batches]))
        if state.exists:
            # a report older than the last one seen opens no gap and does not move it back
            times = np.concatenate([[state.get[0]], times[times > state.get[0]]])
        steps = np.diff(times)
        far = np.flatnonzero(steps / 1e6 > threshold_sec)
        out = [(int(times[i]), int(times[i + 1])) for i in far]
        prev = int(times.max())
        state.update((prev,))
        deadline = prev // 1000 + int(threshold_sec * 1000)
        state.setTimeoutTimestamp(max(deadline, state.getCurrentWatermarkMs() + 1))
        yield rows(out, "gap")

    x = stream.withWatermark(ts, delay).select(F.col(key).cast("string").alias("key"), ts, F.unix_micros(ts).alias("_us"))
    return x.groupBy("key").applyInPandasWithState(run, STALE_OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_available(out: DataFrame, name: str) -> DataFrame:
    """Process what is there, write Parquet in the shared folder, read it back.

    The checkpoint lives next to the output, so a restarted driver resumes.
    """
    spark = out.sparkSession
    base = shared_dir(spark, name)
    q = (
        out.writeStream.format("parquet").outputMode("append").option("path", f"{base}/data")
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/data")
