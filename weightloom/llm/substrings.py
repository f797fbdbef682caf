"""Removal of repeated word sequences by compaction of a de Bruijn graph.

The edges are the windows of ``WINDOW`` words. A window's anchor is its least-hashed
run of ``ANCHOR`` words; successive windows with one anchor form a piece, a path that
is compact from the start and equal wherever its words are equal. So:

1. Pieces of each document meet on their anchor, once. In a slice of texts only the
   earliest of equal pieces takes part; the others are repeats already. Anchors with a
   large share of all pieces are found first: their pieces meet on their content, and
   step 3 compares their windows whatever else the anchor has.
2. Repeated pieces are nodes. Two are joined if one follows the other at every
   occurrence, which a fingerprint of all their source coordinates verifies; paths
   without branches compact by pointer doubling. One occurrence of a path stands for
   all its pieces.
3. Where one anchor has several different pieces (at the borders of repeats), the
   windows of each piece's earliest occurrence are compared one by one.
4. Spans return to their documents; repeats inside a document are found there.

A window is earlier than another if its doc_id is smaller, or if it is in the same row
and starts earlier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from weightloom.llm.common import ODD, SPACE_SEPARATED, Rolling, bounded_batches, flat, mix, signed, slices, word_hashes, words
from weightloom.session import materialize

WINDOW = 20
ANCHOR = 4
FIRST, SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
PIECES_BYTES = 8 << 20
#: Each slice reports the anchors it holds twice or more and above this share of its pieces; those above it in all
#: pieces are hot, at most 1 / HOT_SHARE anchors.
HOT_SHARE = 5e-5
#: Order of a null doc_id.
LEAST = -(1 << 63)


class Tokens:
    """Words of a slice of texts: places, hashes, owners, and the first windows of every row."""

    def __init__(self, part: pa.RecordBatch, window: int, text: str = "text"):
        self.data, self.offsets = flat(part, text)
        self.starts, self.ends, self.rows = words(self.data, self.offsets, SPACE_SEPARATED)
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        self.owner = np.repeat(np.arange(part.num_rows), np.diff(self.rows))
        begin = np.arange(max(0, len(self.hashes) - window + 1))
        self.windows = begin[self.owner[begin] == self.owner[begin + window - 1]] if len(begin) else begin


def pieces(t: Tokens, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, anchor hash and content hash of each piece."""
    begin = t.windows
    if not len(begin):
        return begin, begin, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    first = np.arange(len(t.hashes) - anchor + 1)
    hashes = Rolling(t.hashes, FIRST).of(first, first + anchor)
    low = np.uint64((1 << 24) - 1)
    least = (hashes & ~low) | (first.astype(np.uint64) & low)
    span, have = window - anchor + 1, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    least = least[begin]
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (np.diff(begin) != 1) | (t.owner[begin[1:]] != t.owner[begin[:-1]])])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(begin)))
    start = begin[at]
    place = start + (((least[at] & low).astype(np.int64) - start) % (1 << 24))
    value = hashes[place]
    return start, count, value, mix(Rolling(t.hashes, SECOND).of(start, start + count + window - 1) ^ value)


PIECE = "anchor long, content long, key long, row long, start int, n int, repeat boolean, more boolean, hot boolean"


def _repeats(content: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Is there an equal piece of a smaller key in this slice; is there any equal piece."""
    order = np.lexsort((keys, content))
    c, k = content[order], keys[order]
    head = np.concatenate([[True], c[1:] != c[:-1]])
    group = np.cumsum(head) - 1
    repeat, more = np.zeros(len(c), bool), np.zeros(len(c), bool)
    repeat[order] = k > k[np.flatnonzero(head)][group]
    more[order] = (np.bincount(group) > 1)[group]
    return repeat, more


def hot_anchors(docs: DataFrame, window: int, anchor: int, share: float) -> list[int]:
    """Anchors that hold more than ``share`` of the pieces, counted over all documents.

    A slice leaves out at most ``share`` of its pieces of one anchor, or a single piece, so
    an anchor that is missed has twice the share or a row per slice at most. The reported counts exceed ``share`` of all pieces for
    fewer than 1 / share anchors: that bounds what comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=PIECES_BYTES):
            t = Tokens(part, window)
            start, _, value, content = pieces(t, window, anchor)
            if not len(start):
                continue
            repeat, _ = _repeats(content, np.asarray(part.column(0))[t.owner[start]])
            found, times = np.unique(value[~repeat], return_counts=True)
            big = times > max(1.0, share * len(start))
            # the row without an anchor carries the number of pieces
            yield pa.RecordBatch.from_arrays([pa.array([None, *signed(found[big]).tolist()], pa.int64()), pa.array([len(start), *times[big].tolist()], pa.int64())], ["anchor", "n"])

    counts = materialize(docs.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")), "anchor-counts")
    total = counts.filter("anchor IS NULL").first()
    return [r.anchor for r in counts.filter(F.col("anchor").isNotNull() & (F.col("n") > share * total.n)).select("anchor").toLocalIterator()] if total else []


def piece_rows(docs: DataFrame, window: int, anchor: int, share: float = HOT_SHARE) -> DataFrame:
    """Pieces of all documents; per slice, later equal pieces are ``repeat`` and spread by chance,
    and the earliest knows by ``more`` that there are some. ``hot`` pieces are spread by their content."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(np.array(sorted(hot_anchors(docs, window, anchor, share)), np.int64).view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=PIECES_BYTES):
            t = Tokens(part, window)
            start, count, value, content = pieces(t, window, anchor)
            if not len(start):
                continue
            owner = t.owner[start]
            keys, ids = np.asarray(part.column(0))[owner], np.asarray(part.column(1))[owner]
            repeat, more = _repeats(content, keys)
            hot = np.isin(value, sent.value)
            value = np.where(hot, mix(value ^ content), value)
            value = np.where(repeat, mix(value ^ mix(keys.view(np.uint64) + start.astype(np.uint64) * ODD)), value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(value)), pa.array(signed(content)), pa.array(keys), pa.array(ids), pa.array((start - t.rows[owner]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(repeat), pa.array(more), pa.array(hot)],
                [x.split()[0] for x in PIECE.split(", ")],
            )

    return docs.mapInArrow(run, PIECE)


def meet(rows: DataFrame) -> DataFrame:
    """Pieces that occur more than once (``shared``), and earliest occurrences of pieces whose
    anchor has other pieces too or is hot (``border``). One shuffle; a group holds at most a row
    per slice, or twice ``HOT_SHARE`` of the pieces."""
    same, anchor = Window.partitionBy("anchor", "content"), Window.partitionBy("anchor")
    seen = rows.repartition("anchor").select(
        "*", F.min("key").over(same).alias("least"), F.count(F.lit(1)).over(same).alias("times"),
        (F.min("content").over(anchor) != F.max("content").over(anchor)).alias("several"),
    )
    shared = F.col("repeat") | F.col("more") | (F.col("times") > 1)
    border = (F.col("several") | F.col("hot")) & ~F.col("repeat") & (F.col("key") == F.col("least"))
    return seen.select("content", "key", "row", "start", "n", shared.alias("shared"), border.alias("border")).filter("shared OR border")


def compact(shared: DataFrame) -> DataFrame:
    """Heads of the unbranched paths of repeated pieces: content, ``least`` key, ``n`` windows of the path."""
    def places(at: Column) -> list[Column]:
        """Two sums over the hashes of all source coordinates; neither order nor repeated rows matter."""
        h = F.xxhash64("key", "row", at)
        return [F.sum(F.shiftrightunsigned(h, 33)), F.sum(h.bitwiseAND(F.lit((1 << 31) - 1)))]

    sums = {f"s{i}": x for i, x in enumerate(places(F.col("start")) + places(F.col("start") + F.col("n")))}
    nodes = shared.groupBy("content").agg(F.count(F.lit(1)).alias("times"), F.min("key").alias("least"), F.min("n").cast("long").alias("n"), *(x.alias(k) for k, x in sums.items()))
    nodes = materialize(nodes.select("content", "least", "n", F.xxhash64("times", "s0", "s1").alias("enter"), F.xxhash64("times", "s2", "s3").alias("leave")), "pieces")
    links = nodes.select(F.col("content").alias("up"), F.col("leave").alias("at")).join(nodes.select(F.col("content").alias("down"), F.col("enter").alias("at")), "at")
    # a path goes on only where both sides have one continuation
    one = links.groupBy("up").agg(F.min("down").alias("down"), F.count(F.lit(1)).alias("c")).filter("c = 1").groupBy("down").agg(F.min("up").alias("up"), F.count(F.lit(1)).alias("c")).filter("c = 1 AND up <> down")
    pointers = materialize(one.select(F.col("down").alias("content"), F.col("up").alias("head"), F.lit(True).alias("open")), "paths")
    while True:
        jump = pointers.select(F.col("content").alias("at"), F.col("head").alias("next"))
        going = pointers.filter("open").join(jump, F.col("head") == F.col("at"), "left")
        moved = going.select("content", F.coalesce("next", "head").alias("head"), F.col("next").isNotNull().alias("open"))
        pointers = materialize(pointers.filter("NOT open").union(moved), "paths")
        if not pointers.filter("open").limit(1).count():
            break
    path = nodes.join(pointers.select("content", "head"), "content", "left").select(F.coalesce("head", "content").alias("head"), "n")
    length = path.groupBy("head").agg(F.sum("n").alias("n"))
    return nodes.drop("n").join(length, F.col("content") == F.col("head")).select("content", "least", "n")


def _grouped(spans: DataFrame) -> DataFrame:
    """Spans by document: two arrays, of at most as many entries as the document has windows."""
    return spans.groupBy(F.col("key").alias("__k"), F.col("row").alias("__r")).agg(F.collect_list(F.struct(F.col("start"), F.col("n").cast("int").alias("n"))).alias("__spans"))


def _with_spans(keyed: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    g = _grouped(spans)
    return keyed.join(g, (keyed["__key"] == g["__k"]) & (keyed["__row"] == g["__r"]), how).drop("__k", "__r")


def _span_arrays(part: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and length of every span."""
    col = part.column(part.schema.get_field_index(name))
    size = np.array([len(x) if x.is_valid else 0 for x in col], np.int64)
    inner = col.flatten()
    return np.repeat(np.arange(len(col)), size), np.asarray(inner.field(0), np.int64), np.asarray(inner.field(1), np.int64)


def border_windows(keyed: DataFrame, border: DataFrame, window: int) -> DataFrame:
    """The windows of the border pieces: two hashes and source coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            t = Tokens(part, window, "__text")
            row, start, n = _span_arrays(part, "__spans")
            if not len(row):
                continue
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(start + t.rows[row], n) + inner
            row = np.repeat(row, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(Rolling(t.hashes, b).of(at, at + window))) for b in (FIRST, SECOND)]
                + [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array((at - t.rows[row]).astype(np.int32))],
                ["h1", "h2", "key", "row", "start"],
            )

    asked = _with_spans(keyed.select("__key", "__row", "__text"), border, "inner").select("__key", "__row", "__text", "__spans")
    return asked.mapInArrow(run, "h1 long, h2 long, key long, row long, start int")


def repeated_spans(keyed: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, share: float | None = None) -> DataFrame:
    """key, row, start, n: runs of windows that a document of smaller key also holds."""
    narrow = keyed.select("__key", "__row", F.col("__text").alias("text"))
    met = materialize(meet(piece_rows(narrow, window, anchor, HOT_SHARE if share is None else share)), "met-pieces")
    shared = met.filter("shared")
    heads = materialize(compact(shared), "unitigs")
    long = shared.join(heads.withColumnRenamed("n", "path_n"), "content").filter("key > least").select("key", "row", "start", F.col("path_n").alias("n"))
    edges = materialize(border_windows(keyed, met.filter("border").select("key", "row", "start", "n"), window), "border-windows")
    first = edges.groupBy("h1", "h2").agg(F.min("key").alias("least"), F.max("key").alias("most")).filter("least < most").drop("most")
    short = edges.join(first, ["h1", "h2"]).filter("key > least").select("key", "row", "start", F.lit(1).cast("long").alias("n"))
    return long.union(short)


def gone_words(t: Tokens, row: np.ndarray, start: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Words covered by the given window runs, or by a window that its own row holds earlier."""
    edge = np.zeros(len(t.hashes) + 1, np.int64)
    at = start + t.rows[row]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n + window - 1, -1)
    begin = t.windows
    if len(begin):
        value, owner = Rolling(t.hashes, FIRST).of(begin, begin + window), t.owner[begin]
        order = np.lexsort((value, owner))  # stable: equal windows of a row stay in order
        again = order[1:][(value[order][1:] == value[order][:-1]) & (owner[order][1:] == owner[order][:-1])]
        np.add.at(edge, begin[again], 1)
        np.add.at(edge, begin[again] + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__key": F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)), "__row": F.xxhash64("text"), "__text": F.col("text")})


def _apply(docs: DataFrame, window: int, clean: bool) -> DataFrame:
    bounded_batches(docs.sparkSession)
    keyed = _keyed(docs)
    joined = _with_spans(keyed, repeated_spans(keyed, window), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            t = Tokens(part, window, "__text")
            gone = gone_words(t, *_span_arrays(part, "__spans"), window)
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[t.rows[1:]] - total[t.rows[:-1]]
            if clean:
                at = part.schema.get_field_index("text")
                texts = part.column(at).to_pylist()
                for r in np.flatnonzero(removed).tolist():
                    texts[r] = _kept(t, gone, r, exact=True).decode()
                yield pa.RecordBatch.from_arrays([pa.array(texts, part.schema.field(at).type) if i == at else part.column(i) for i in range(width)], part.schema.names[:width])
                continue
            kept = [hashlib.sha256(_kept(t, gone, r, exact=False)).hexdigest() for r in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(t.rows)), pa.array(removed), pa.array(kept)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    width = len(docs.columns)
    if clean:
        return joined.mapInArrow(run, docs.schema)
    return joined.select("doc_id", "__text", "__spans").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


def _kept(t: Tokens, gone: np.ndarray, r: int, exact: bool) -> bytes:
    """What is left of a row: with the white space between kept words, or one space instead."""
    a, b = int(t.rows[r]), int(t.rows[r + 1])
    raw = t.data[t.offsets[r] : t.offsets[r + 1]].tobytes()
    if not exact:
        parts = raw.split()
        return b" ".join(x for x, g in zip(parts, gone[a:b].tolist()) if not g) if gone[a:b].any() else b" ".join(parts)
    left, at, base = [], 0, int(t.offsets[r])
    flag = np.concatenate([[False], gone[a:b], [False]])
    for x, y in zip(np.flatnonzero(flag[1:] & ~flag[:-1]).tolist(), np.flatnonzero(flag[:-1] & ~flag[1:]).tolist()):
        left.append(raw[at : int(t.starts[a + x]) - base])
        at = int(t.ends[a + y - 1]) - base
    return b"".join([*left, raw[at:]])


def substring_counts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    Null texts have no words. A null doc_id comes before all others. Rows that share a
    doc_id are not earlier than each other, so equal rows get equal results and none removes
    the other. An empty table gives an empty table; other columns are not read.
    """
    return _apply(docs.select("doc_id", "text"), window, clean=False)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated words cut out of ``text`` (and the white space between them); other columns unchanged."""
    return _apply(docs, window, clean=True)
