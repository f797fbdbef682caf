"""Hard negatives by segment summaries.

A vector is cut into 1, 4, 16, ... nested segments. A segment of L components with mean m
and deviation d (root of the mean square distance to m) bounds the inner product of two
vectors over it: L * m * m' - L * d * d' <= x.x' <= L * m * m' + L * d * d'. Summed over the
segments, this bounds the score of a pair without its components, and the bounds tighten
with each level. The summaries are stored with the vectors once. Pairs that can still matter
go from level to level, and what is left is scored exactly.

Anchors are taken in blocks. Each block meets all rows twice: the first pass keeps the best
rows of the anchor's label, which give its positives; the second keeps, for each positive,
the best rows of other labels within the positive's limits. A task keeps a few rows for each
anchor; the thresholds of those rows prune what it reads later.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from weightloom.session import materialize, shared_dir

#: Anchors of a block (its vectors and summaries are broadcast, its positives come to the driver) and rows compared at once.
ANCHORS, ROWS = 2048, 1024
BLOCK_BYTES = 16 << 20
#: Below this share of pairs that are left, the next level looks at single pairs.
SPARSE = 0.1
POSITIVES, NEGATIVES = 5, 3
#: A negative's score s and its positive's score p: LOW * p <= 100 * s <= HIGH * p.
LOW, HIGH = 50, 95
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def segments(width: int) -> list[np.ndarray]:
    """Begins of the segments of each level, nested: 1, 4, 16, ... but fewer than the components."""
    out, n = [], 1
    while n < width or n == 1:
        out.append(np.arange(n) * width // n)
        n *= 4
    return out if width else []


def summary(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level: means and deviations of all segments, both times the root of the segment's length."""
    out = []
    for begin in segments(x.shape[1]):
        size = np.diff(np.append(begin, x.shape[1]))
        mean = np.add.reduceat(x, begin, axis=1) / size
        rest = x - np.repeat(mean, size, axis=1)
        out.append((mean * np.sqrt(size), np.sqrt(np.add.reduceat(rest * rest, begin, axis=1))))
    return out


@dataclass
class Side:
    """Vectors of one width: identity, label, integer components, and the summaries as stored."""

    key: np.ndarray
    known: np.ndarray
    label: np.ndarray
    vector: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]

    @property
    def norm(self) -> np.ndarray:
        mean, spread = self.levels[0] if self.levels else (np.zeros((len(self.key), 1)),) * 2
        return np.sqrt(mean[:, 0] ** 2 + spread[:, 0] ** 2)


def sides(part: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, np.ndarray, Side]]:
    """The rows (id, label, vector, summary) by the width of their vectors: width, row numbers, side."""
    part = pa.Table.from_batches([part]).combine_chunks() if isinstance(part, pa.RecordBatch) else part.combine_chunks()
    if not part.num_rows:
        return
    column = lambda name: part.column(name).chunk(0)
    widths = np.asarray(column("vector").value_lengths())
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        pick = pa.array(at)
        key = column("id").take(pick)
        flat = np.asarray(column("summary").take(pick).flatten(), np.float64).reshape(len(at), -1)
        levels, k = [], 0
        for begin in segments(width):
            levels.append((flat[:, k : k + len(begin)], flat[:, k + len(begin) : k + 2 * len(begin)]))
            k += 2 * len(begin)
        yield width, at, Side(np.asarray(key.fill_null(MOST), np.int64), np.asarray(key.is_valid()), np.asarray(column("label").take(pick), np.int64),
                              np.asarray(column("vector").take(pick).flatten(), np.int64).reshape(len(at), width), levels)


def part_of(side: Side, rows: slice) -> Side:
    return Side(side.key[rows], side.known[rows], side.label[rows], side.vector[rows], [(m[rows], d[rows]) for m, d in side.levels])


def scored(a: Side, b: Side, allowed: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row) of ``allowed`` whose score can lie between the anchor's ``low`` and ``high``, with their exact scores."""
    slack = 1e-6 * a.norm[:, None] * b.norm[None, :] + 1e-6  # summaries are stored with 24 bits
    mask, pairs = allowed, None
    for (mean, spread), (mean_b, spread_b) in zip(a.levels, b.levels):
        if pairs is None:
            centre, reach = mean @ mean_b.T, spread @ spread_b.T + slack
            mask &= (centre + reach >= low[:, None]) & (centre - reach <= high[:, None])
            if mask.mean() < SPARSE:
                pairs = np.nonzero(mask)
        else:
            i, j = pairs
            centre = np.einsum("ij,ij->i", mean[i], mean_b[j])
            reach = np.einsum("ij,ij->i", spread[i], spread_b[j]) + slack[i, j]
            keep = (centre + reach >= low[i]) & (centre - reach <= high[i])
            pairs = i[keep], j[keep]
    i, j = np.nonzero(mask) if pairs is None else pairs
    if not len(i):
        return i, j, np.zeros(0, np.int64)
    if a.norm.max() * b.norm.max() >= 2**52:  # not exact as doubles
        exact = [sum(x * y for x, y in zip(a.vector[p].tolist(), b.vector[q].tolist())) for p, q in zip(i.tolist(), j.tolist())]
        return i, j, np.array([min(max(x, LEAST), MOST) for x in exact], np.int64)
    if pairs is None:
        return i, j, (a.vector.astype(float) @ b.vector.astype(float).T)[i, j].astype(np.int64)
    return i, j, np.concatenate([np.einsum("ij,ij->i", a.vector[i[k : k + 65536]], b.vector[j[k : k + 65536]]) for k in range(0, len(i), 65536)])


class Best:
    """The best ``size`` rows of each group by (score descending, id ascending, null last)."""

    def __init__(self, groups: int, size: int):
        self.size = size
        self.score, self.key, self.known = np.full((groups, size), LEAST), np.full((groups, size), MOST), np.zeros((groups, size), bool)
        self.filled = np.zeros(groups, np.int64)

    def least(self) -> np.ndarray:
        """The score that a row must reach to matter."""
        return np.where(self.filled == self.size, self.score[:, -1], LEAST)

    def add(self, group: np.ndarray, score: np.ndarray, key: np.ndarray, known: np.ndarray) -> None:
        if not len(group):
            return
        hit = np.unique(group)
        old = np.arange(self.size)[None, :] < self.filled[hit][:, None]
        group = np.concatenate([np.repeat(hit, self.filled[hit]), group])
        score, key, known = (np.concatenate([x[hit][old], y]) for x, y in ((self.score, score), (self.key, key), (self.known, known)))
        order = np.lexsort((key, ~known, ~score, group))  # ~score falls as the score rises
        group, score, key, known = group[order], score[order], key[order], known[order]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        top = place < self.size
        for mine, found in ((self.score, score), (self.key, key), (self.known, known)):
            mine[group[top], place[top]] = found[top]
        self.filled[hit] = np.minimum(np.diff(np.append(first, len(group))), self.size)

    def rows(self, names: dict[str, np.ndarray]) -> pa.RecordBatch:
        """All kept rows, with the group's values of ``names``."""
        group, place = np.nonzero(np.arange(self.size)[None, :] < self.filled[:, None])
        return pa.RecordBatch.from_arrays(
            [*(pa.array(v[group]) for v in names.values()), pa.array(self.key[group, place], mask=~self.known[group, place]), pa.array(self.score[group, place])],
            [*names, "id", "score"],
        )


@dataclass
class Block:
    """Anchors of one width, their numbers in the block, and for each of them the scores of its positives (rows; -1: none)."""

    anchors: Side
    number: np.ndarray
    low: np.ndarray
    high: np.ndarray


def summarised(vectors: DataFrame) -> DataFrame:
    """id, label, vector, summary; written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 8 * ROWS):
                part = batch.slice(k, 8 * ROWS)
                vector = part.column(2)
                widths = np.asarray(vector.value_lengths())
                found: list[list[float]] = [[]] * part.num_rows
                for width in np.unique(widths).tolist():
                    at = np.flatnonzero(widths == width)
                    x = np.asarray(vector.take(pa.array(at)).flatten(), np.float64).reshape(len(at), width)
                    both = np.concatenate([np.concatenate(level, axis=1) for level in summary(x)], axis=1) if width else np.zeros((len(at), 0))
                    for r, values in zip(at.tolist(), both.tolist()):
                        found[r] = values
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.float32()))], ["id", "label", "vector", "summary"])

    return materialize(vectors.mapInArrow(run, "id long, label long, vector array<long>, summary array<float>"), "segment-summaries")


def _pass(rows: DataFrame, blocks: list[Block], size: int, same: bool, number: int) -> DataFrame:
    """anchor, place, id, score: the best rows that each task finds for each anchor and each of its limits."""
    sent = rows.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [[Best(len(x.number), size) for _ in range(x.low.shape[1])] for x in sent.value]
        for batch in batches:
            for width, _, whole in sides(batch):
                for block, tops in zip(sent.value, best):
                    a = block.anchors
                    if a.vector.shape[1] != width:
                        continue
                    for k in range(0, len(whole.key), ROWS):
                        b = part_of(whole, slice(k, k + ROWS))
                        allowed = (a.label[:, None] == b.label[None, :]) == same
                        allowed &= ~((a.key[:, None] == b.key[None, :]) & b.known[None, :])
                        need = np.stack([np.maximum(block.low[:, p], top.least()) for p, top in enumerate(tops)], axis=1)
                        i, j, score = scored(a, b, allowed, need.min(axis=1), block.high.max(axis=1))
                        for p, top in enumerate(tops):
                            keep = (score >= need[i, p]) & (score <= block.high[i, p])
                            top.add(i[keep], score[keep], b.key[j[keep]], b.known[j[keep]])
        for block, tops in zip(sent.value, best):
            for p, top in enumerate(tops):
                yield top.rows({"anchor": block.number, "place": np.full(len(block.number), p)})

    found = rows.mapInArrow(run, "anchor long, place long, id long, score long")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def limits(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of a negative whose positive has ``score``; an empty range below a negative one."""
    each = [(-(-LOW * int(p) // 100), HIGH * int(p) // 100) for p in score.ravel()]
    return tuple(np.array([x[k] for x in each], np.int64).reshape(score.shape) for k in (0, 1))  # type: ignore[return-value]


def mine(vectors: DataFrame, is_anchor: Callable[[Column], Column], positives: int = POSITIVES, negatives: int = NEGATIVES, anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for all anchors of ``vectors``
    (id long, label long, vector array<long>), without an index that could miss any.

    Scores are inner products; higher ones come first, ties by smaller id, a null id last.
    Rows of an anchor's own id are the anchor itself and neither its positives nor its
    negatives. Other repeated rows count as rows of their own; an anchor that is repeated
    wholly is one anchor. Vectors are compared with those of equal length only. Products
    beyond the range of a long count as its ends. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    rows = summarised(vectors)
    chosen = materialize(rows.filter(F.coalesce(is_anchor(F.col("id")), F.lit(False))).distinct(), "anchors")
    count, longest = chosen.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    size = max(1, min(anchors, BLOCK_BYTES // (16 * max(1, longest or 1))))
    blocks = -(-count // size)
    out = shared_dir(spark, "hard-negatives")
    paths = []
    for k in range(blocks):
        table = chosen.filter(F.pmod(F.xxhash64("id", "label", "vector"), F.lit(blocks)) == k).toArrow()
        if not table.num_rows:
            continue
        by_width = list(sides(table))
        everything = lambda n: (np.full((n, 1), LEAST), np.full((n, 1), MOST))
        first = [Block(side, at, *everything(len(at))) for _, at, side in by_width]
        best = materialize(_pass(rows, first, positives, True, k), "positives")
        # at most ``positives`` rows of each anchor of the block
        found = best.toArrow()
        score, key, known = np.zeros((table.num_rows, positives), np.int64), np.zeros((table.num_rows, positives), np.int64), np.zeros((table.num_rows, positives), bool)
        at = np.asarray(found.column("anchor")), np.asarray(found.column("rank")) - 1
        score[at], known[at] = np.asarray(found.column("score")), True
        low, high = limits(score)
        low, high = np.where(known, low, MOST), np.where(known, high, LEAST)
        second = [Block(side, at, low[at], high[at]) for _, at, side in by_width]
        names = spark.createDataFrame(pa.table({"anchor": pa.array(np.arange(table.num_rows)), "anchor_id": table.column("id")}))
        positive = best.join(names, "anchor").select("anchor", "anchor_id", (F.col("rank") - 1).cast("long").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        path = f"{out}/block-{k}"
        _pass(rows, second, negatives, False, k).select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(positive, ["anchor", "place"]).select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.parquet(path)
        paths.append(path)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def quantised(embeddings: DataFrame, labels: int = 10, every: int = 7, scale: float = 256.0) -> DataFrame:
    """id, label, vector of ``embeddings`` (vec_id, label, embedding): components times ``scale``, rounded down;
    the label of each ``every``-th id moves on by one. Rows with a null label or vector, or with a component
    that is null or not finite, take no part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(F.exists("embedding", bad), F.lit(False))
    moved = F.when(F.coalesce(F.col("vec_id") % every == 0, F.lit(False)), (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return embeddings.filter(sound).select(
        F.col("vec_id").cast("long").alias("id"), moved.cast("long").alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("vector"),
    )


def hard_negatives(embeddings: DataFrame, every: int = 50) -> DataFrame:
    """Hard negatives of each ``every``-th row by its vec_id; see ``mine`` and ``quantised`` for nulls, ties and repeats."""
    return mine(quantised(embeddings), lambda i: i % every == 0)
