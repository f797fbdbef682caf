"""URL filters: rules first, then a logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from weightloom.llm.common import bounded_batches, flat, mix, slices

UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIZES = (3, 4, 5)
BUCKETS = 1 << 16
#: Labelled URLs used to fit at most, taken in order of their hash.
MAX_LABELLED = 5000


@dataclass(frozen=True)
class Rule:
    """A host (with all its subdomains), a path prefix, and block or allow."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The parts of a URL; both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOW), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_match(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def grams(part: pa.RecordBatch, columns: tuple[str, ...] = ("host", "path")) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram and the row it belongs to; each part is set between marks."""
    buckets, rows = [], []
    for tag, name in enumerate(columns):
        data, offsets = flat(part, name)
        n = len(offsets) - 1
        text = np.zeros(len(data) + 2 * n, np.uint64)
        size = np.diff(offsets)
        owner = np.repeat(np.arange(n), size + 2)
        text[np.arange(len(data)) + 2 * np.repeat(np.arange(n), size) + 1] = data
        text[np.cumsum(size + 2) - 1] = 1
        for k in SIZES:
            if len(text) < k:
                continue
            value = np.full(len(text) - k + 1, 31 * tag + k, np.uint64)
            for j in range(k):
                value = value * np.uint64(0x100000001B3) + text[j : len(text) - k + 1 + j]
            inside = owner[: len(value)] == owner[k - 1 :]
            buckets.append((mix(value[inside]) % np.uint64(BUCKETS)).astype(np.int64))
            rows.append(owner[: len(value)][inside])
    return (np.concatenate(buckets), np.concatenate(rows)) if buckets else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _scores(buckets: np.ndarray, rows: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    count = np.bincount(rows, minlength=n)
    return np.bincount(rows, weights[buckets], n) / np.sqrt(np.maximum(count, 1)) + weights[-1]


def fit(part: pa.RecordBatch, blocked: np.ndarray, steps: int = 300, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights of the n-gram buckets and a bias, by Adam on the whole labelled table."""
    buckets, rows = grams(part)
    n = len(blocked)
    weights, first, second = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
    rate /= 10
    for step in range(1, steps + 1):
        error = (1 / (1 + np.exp(-_scores(buckets, rows, n, weights))) - blocked) / max(n, 1)
        gradient = np.append(np.bincount(buckets, (error * scale)[rows], BUCKETS), error.sum()) + decay * weights
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights


def train(labelled: DataFrame) -> np.ndarray:
    """Fits on a small table (host, path, verdict), at most ``MAX_LABELLED`` distinct rows in hash order."""
    rows = labelled.filter("verdict IS NOT NULL").select("host", "path", "verdict").distinct().orderBy(F.xxhash64("host", "path"), "host", "path", "verdict").limit(MAX_LABELLED).toPandas()
    part = pa.RecordBatch.from_arrays([pa.array(rows[c], pa.string()) for c in ("host", "path")], ["host", "path"])
    return fit(part, (rows["verdict"] == "block").to_numpy(float))


def url_verdicts(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's ``p_block``; one row per row of ``pages``.

    The model learns from ``labelled`` (host, path, verdict), else from the URLs of
    ``pages`` that a rule decides. Null URLs and those without ``://`` have empty host
    and path and are judged by the model. Without any label the model says 0.5 (block
    at ``threshold`` or above). Null and repeated ids and rows stay row by row; an empty
    table gives an empty table; other columns are not read.
    """
    bounded_batches(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rule, verdict = rule_match(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumns({"rule": rule, "verdict": verdict})
    weights = pages.sparkSession.sparkContext.broadcast(train(ruled if labelled is None else labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "path", 1 << 20):
            score = _scores(*grams(part), part.num_rows, weights.value)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(score, -500, 500))))], [*part.schema.names, "p_block"])

    scored = ruled.mapInArrow(run, T.StructType([*ruled.schema.fields, T.StructField("p_block", T.DoubleType())]))
    return scored.withColumn("verdict", F.coalesce("verdict", F.when(F.col("p_block") >= threshold, "block").otherwise("allow")))
