"""Periodic runs of words, found by uniting suffix classes in the order of decreasing common prefixes.

A run of period q is a maximal stretch of words in which words q apart are equal; here it has
at least ``LEAST_LENGTH`` words and ``LEAST_TIMES`` periods, so two suffixes that start one
period apart in it share at least ``floor_prefix()`` words. For each slice of texts:

1. Suffixes whose first ``floor_prefix()`` words occur again in their text are sorted by
   prefix doubling; all others can start no run.
2. Neighbours in that order are united by decreasing length of their common prefix. Each
   class keeps its start positions ordered; the smaller class is dealt into the larger one.
3. Two positions that become neighbours at a distance d, within their common prefix l, seed
   the run of period d from the first to l words behind the second. A run's first two
   periods always meet in this way: a position between them would give a smaller period.
4. Seeds that go on to the left are not a run's start; of seeds over one stretch the least
   period is the run's.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from weightloom.llm.common import ODD, SPACE_SEPARATED, bounded_batches, flat, mix, slices, word_hashes, words

LEAST_LENGTH, LEAST_TIMES = 24, 3
RUNS = "array<struct<start: long, length: long, period: long>>"


def floor_prefix(least: int = LEAST_LENGTH, times: int = LEAST_TIMES) -> int:
    """The least common prefix of the starts of a run's first two periods."""
    return -(-least * (times - 1) // times)


def _behind(at: np.ndarray, step: int, end: np.ndarray, value: np.ndarray) -> np.ndarray:
    """``value`` ``step`` words on, 0 behind the end of the text."""
    there = at + step
    return np.where(there < end, value[np.minimum(there, len(value) - 1)], 0)


def window_ranks(number: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of the ``width`` words from each position on (from 1), in word order, and how often each rank occurs."""
    at, have = np.arange(len(number)), 1
    rank, times = number, np.bincount(number)
    while have < width:
        bits = int(rank.max()).bit_length()
        steps = sorted({min(have * j, width - have) for j in range(63 // bits)})
        key = np.zeros(len(number), np.int64)
        for s in steps:
            key = (key << bits) | _behind(at, s, end, rank)
        _, rank, times = np.unique(key, return_inverse=True, return_counts=True)
        rank, times, have = rank + 1, np.concatenate([[0], times]), have + steps[-1]
    return rank, times


def suffix_neighbours(number: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First, second and common prefix of neighbours in suffix order that share ``width`` words or more.

    ``number``: the words, from 1 on, of which no two texts share one; ``end``: where the
    text of each word ends.
    """
    none = np.zeros(0, np.int64)
    if len(number) < 2:
        return none, none, none
    rank, times = window_ranks(number, end, width)
    place = (np.cumsum(times) - times)[rank]  # the first place of the class in the order of all positions
    alive = np.flatnonzero(times[rank] > 1)
    repeated, levels, step = alive, [], width
    while len(alive):
        levels.append((step, alive, place[alive]))
        second = np.where(alive + step < end[alive], place[np.minimum(alive + step, len(number) - 1)] + 1, 0)
        order = np.lexsort((second, place[alive]))
        at, second = alive[order], second[order]
        group, inner = place[at], np.arange(len(at))
        new = np.concatenate([[True], group[1:] != group[:-1]])
        split = new | np.concatenate([[True], second[1:] != second[:-1]])
        head = np.maximum.accumulate(np.where(split, inner, 0))
        place[at] = group + head - np.maximum.accumulate(np.where(new, inner, 0))
        size = np.diff(np.append(np.flatnonzero(split), len(at)))
        alive = np.sort(at[np.repeat(size, size) > 1])
        step *= 2
    if not len(repeated):
        return none, none, none
    order = repeated[np.argsort(place[repeated], kind="stable")]
    a, b = order[:-1], order[1:]
    shared = np.zeros(len(a), np.int64)
    for step, at, group in reversed(levels):
        def of(position: np.ndarray, missing: int) -> np.ndarray:
            k = np.minimum(np.searchsorted(at, position), len(at) - 1)
            return np.where(at[k] == position, group[k], missing)

        shared += step * (of(a + shared, -1) == of(b + shared, -2))
    keep = shared >= width
    a, b, shared = a[keep], b[keep], shared[keep]
    going = np.arange(len(a))
    while len(going):
        x, y = a[going] + shared[going], b[going] + shared[going]
        inside = (x < end[a[going]]) & (y < end[b[going]])
        x, y, going = x[inside], y[inside], going[inside]
        going = going[number[x] == number[y]]
        shared[going] += 1
    return a, b, shared


def unite(a: np.ndarray, b: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds (position, distance, common prefix) with a distance of at most the common prefix:
    classes are united by decreasing ``shared``, and positions that become neighbours are looked at."""
    at, which = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = which[: len(a)].tolist(), which[len(a) :].tolist()
    parent, members = list(range(len(at))), [[x] for x in at.tolist()]
    depth, seeds = shared.tolist(), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k in np.argsort(-shared, kind="stable").tolist():
        x, y, most = root(left[k]), root(right[k]), depth[k]
        if len(members[x]) > len(members[y]):
            x, y = y, x
        into, last = members[y], -1
        for p in members[x]:
            i = bisect_left(into, p)
            # the one dealt in last was its neighbour already
            if i and into[i - 1] != last and p - into[i - 1] <= most:
                seeds.append((into[i - 1], p - into[i - 1], most))
            if i < len(into) and into[i] - p <= most:
                seeds.append((p, into[i] - p, most))
            into.insert(i, p)
            last = p
        parent[x], members[x] = y, []
    found = np.array(seeds, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def find_runs(number: np.ndarray, rows: np.ndarray, least: int = LEAST_LENGTH, times: int = LEAST_TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start within the row, length and period of all runs, in this order."""
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    start, period, shared = unite(*suffix_neighbours(number, rows[owner + 1], floor_prefix(least, times)))
    length = period + shared
    before = np.maximum(start - 1, 0)
    first = (start == rows[owner[start]]) | (number[before] != number[before + period]) if len(start) else np.zeros(0, bool)
    keep = first & (length >= least) & (length >= times * period)
    start, period, length = start[keep], period[keep], length[keep]
    order = np.lexsort((period, length, start))
    start, period, length = start[order], period[order], length[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, period, length = start[new], period[new], length[new]
    order = np.lexsort((period, start))
    start, period, length = start[order], period[order], length[order]
    row = owner[start]
    return row, start - rows[row], length, period


def word_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", least: int = LEAST_LENGTH, times: int = LEAST_TIMES) -> DataFrame:
    """``docs`` with two more columns: ``runs``, the runs of its words by start and period, and
    ``collapsed``, its words joined by one space without those that lie in a run behind its
    first period. Columns of these names are replaced.

    A null or empty text has no words: no runs, an empty ``collapsed``. Rows are handled one by
    one, so repeated rows and ids get equal results; an empty table gives an empty table. Texts
    are cut into slices by bytes; a very long one forms a slice of its own. Words are told
    apart within a slice by 64-bit hashes.
    """
    bounded_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in (runs, collapsed)]
    schema = T.StructType([*kept, T.StructField(runs, T._parse_datatype_string(RUNS)), T.StructField(collapsed, T.StringType())])
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            data, offsets = flat(part, "__text")
            starts, ends, rows = words(data, offsets, SPACE_SEPARATED)
            owner = np.repeat(np.arange(part.num_rows), np.diff(rows))
            number = np.unique(mix(word_hashes(data, starts, ends) ^ mix(owner.astype(np.uint64) * ODD)), return_inverse=True)[1] + 1
            row, start, length, period = find_runs(number, rows, least, times)
            edge = np.zeros(len(number) + 1, np.int64)
            np.add.at(edge, rows[row] + start + period, 1)
            np.add.at(edge, rows[row] + start + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            left = []
            for r, hit in enumerate(np.isin(np.arange(part.num_rows), row).tolist()):
                found = data[offsets[r] : offsets[r + 1]].tobytes().split()
                left.append(b" ".join([x for x, g in zip(found, gone[rows[r] : rows[r + 1]].tolist()) if not g] if hit else found))
            bounds = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))]).astype(np.int32))
            spans = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(bounds, spans), pa.array(left, pa.binary()).cast(pa.string())], [*part.schema.names[:-1], runs, collapsed])

    # the text comes last under a name of its own; where a replaced column is the text, it is still read
    return docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)


def tiled(text: str = "text", key: str = "doc_id", every: int = 10) -> Column:
    """The text, of which one in ``every`` (by the checksum h of its key) becomes periodic behind a place of its own.

    With g = floor(h / every) and n words, words from a = g % n on repeat the p = 1 + floor((n - a) /
    (3 + g % 8)) words from there. Null texts, texts without a word and rows with a null key stay.
    """
    h = F.crc32(F.col(f"`{key}`").cast("string").cast("binary"))
    cells = F.filter(F.split(F.col(f"`{text}`"), "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")

    def repeat(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / every)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        times = F.ceil((n - a) / p).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(w, (a + 1).cast("int"), p.cast("int")), times))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int"))), " ")

    made = F.transform(F.filter(F.array(cells), lambda w: F.size(w) > 0), repeat)
    return F.when(F.pmod(h, F.lit(every)) == 0, F.coalesce(F.get(made, F.lit(0)), F.col(f"`{text}`"))).otherwise(F.col(f"`{text}`"))


def run_digest(found: DataFrame, key: str = "doc_id", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """Per row of ``word_runs``: the number of runs, the run of the greatest exact length / period
    (ties: smallest start, then period) and checksums of all runs and of the collapsed text."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    best = F.aggregate(runs, none, lambda top, r: F.when(top.isNull() | (r.length * top.period > top.length * r.period), r).otherwise(top))
    lines = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    listed = F.when(F.size(runs) > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.select(key, F.size(runs).cast("long").alias("n_runs"), best.alias("__best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col(collapsed), 256).alias("collapsed_sha256")).select(
        key, "n_runs", *(F.col(f"__best.{x}").alias(x) for x in ("start", "length", "period")),
        F.floor(1000 * F.col("__best.length") / F.col("__best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
