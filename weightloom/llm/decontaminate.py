"""Benchmark decontamination with one FM-index per shard of training text.

A task cuts its documents into shards of bounded size. Of a shard, the stretches in
which every neighbouring word pair occurs in some test phrase are indexed (no phrase
can lie anywhere else): suffix array, Burrows-Wheeler transform, wavelet matrix with
rank tables, and every eighth text position sampled. All phrases are searched
backwards at once, occurrences are located by walking to a sampled position, and
their spans are merged per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weightloom.llm.common import ALPHANUMERIC, LOWER, Rolling, bounded_batches, flat, slices, word_hashes, words

WINDOW = 10
SAMPLE = 8
#: Test text is searched in blocks of about so many bytes, each broadcast on its own.
BLOCK_BYTES = 8 << 20
#: Text of a shard, which gets an index of its own.
SHARD_BYTES = 8 << 20


@dataclass
class Phrases:
    """Distinct windows as rows of vocabulary symbols (1..V), right-aligned, 0 in front; and the items that hold each."""

    vocabulary: np.ndarray
    pairs: np.ndarray
    single: np.ndarray
    table: np.ndarray
    length: np.ndarray
    item_at: np.ndarray
    items: np.ndarray
    names: list[str]


def phrases(rows: list[tuple[str, bytes]], window: int = WINDOW) -> Phrases:
    """Windows of ``rows`` (item name, text); an item shorter than a window is one window."""
    names = sorted({n for n, _ in rows})
    number = {n: i for i, n in enumerate(names)}
    data = LOWER[np.frombuffer(b"".join(t for _, t in rows), np.uint8)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in rows])]).astype(np.int64)
    starts, ends, first = words(data, offsets, ALPHANUMERIC)
    vocabulary, symbol = np.unique(word_hashes(data, starts, ends), return_inverse=True)
    symbol = symbol.astype(np.int64) + 1
    found: dict[bytes, set[int]] = {}
    for (name, _), a, b in zip(rows, first[:-1], first[1:]):
        for i in range(a, max(b - window, a) + 1 if b > a else a):
            row = np.zeros(window, np.int64)
            part = symbol[i : min(i + window, b)]
            row[window - len(part) :] = part
            found.setdefault(row.tobytes(), set()).add(number[name])
    table = np.frombuffer(b"".join(found), np.int64).reshape(-1, window)
    size = np.fromiter(map(len, found.values()), np.int64, len(found))
    inside = (table[:, :-1] > 0) & (table[:, 1:] > 0)
    pairs = np.unique((table[:, :-1] << 32 | table[:, 1:])[inside])
    length = (table > 0).sum(axis=1)
    return Phrases(vocabulary, pairs, np.unique(table[length == 1, -1]), table, length, np.concatenate([[0], np.cumsum(size)]), np.array([i for s in found.values() for i in sorted(s)], np.int64), names)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling on symbols of which 0 and 1 are marks: every mark differs from
    all others, so no comparison runs past the end of a stretch."""
    mark = text <= 1
    rank = text + len(text)
    rank[mark] = np.arange(1, int(mark.sum()) + 1)
    rank[-1] = 0
    k = 1
    while True:
        key = (rank << 32) + np.concatenate([rank[k:] + 1, np.zeros(min(k, len(rank)), np.int64)])
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty_like(step)
        rank[order] = step
        k *= 2
        if step[-1] == len(text) - 1:
            return order


class FMIndex:
    """Backward search and locate over one text of symbols, in which 0 ends a stretch.

    Symbols are renumbered from 2; 1 is the end of a stretch, 0 that of the text. A stretch's
    first position is always sampled, so locating never steps over a mark.
    """

    def __init__(self, text: np.ndarray):
        self.symbols, coded = np.unique(text[text > 0], return_inverse=True)
        whole = np.ones(len(text) + 1, np.int64)
        whole[:-1][text > 0] = coded + 2
        whole[-1] = 0
        coded = whole
        order = suffix_array(coded)
        last = coded[order - 1]
        self.n = len(coded)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(coded, minlength=len(self.symbols) + 2))])
        self.levels: list[tuple[int, np.ndarray, int]] = []
        seq = last
        for bit in range((len(self.symbols) + 1).bit_length() - 1, -1, -1):
            ones = (seq >> bit) & 1
            ranks = np.concatenate([[0], np.cumsum(ones)]).astype(np.int32)
            self.levels.append((bit, ranks, self.n - int(ranks[-1])))
            seq = np.concatenate([seq[ones == 0], seq[ones == 1]])
        chosen = (order % SAMPLE == 0) | (last <= 1)
        self.sampled = np.concatenate([[0], np.cumsum(chosen)]).astype(np.int32)
        self.places = order[chosen]
        self.last = last

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs in the first ``at`` places of the transform."""
        low, high = np.zeros_like(at), at
        for bit, ranks, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            a, b = ranks[low], ranks[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def search(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``table`` that occur (0 in front of shorter ones), and their suffix ranges."""
        at = np.minimum(np.searchsorted(self.symbols, table), len(self.symbols) - 1)
        coded = np.where(table == 0, 0, np.where(self.symbols[at] == table, at + 2, -1))
        live = np.flatnonzero((coded >= 0).all(axis=1))
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        for column in range(table.shape[1] - 1, -1, -1):
            symbol = coded[live, column]
            more = symbol > 0
            ask = np.where(more, symbol, 1)
            base = self.before[ask]
            low, high = np.where(more, base + self.rank(ask, low), low), np.where(more, base + self.rank(ask, high), high)
            keep = high > low
            live, low, high = live[keep], low[keep], high[keep]
        return live, low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back in the text until a sampled one."""
        out = np.empty(len(row), np.int64)
        open_ = np.arange(len(row))
        steps = 0
        while len(open_):
            hit = self.sampled[row + 1] > self.sampled[row]
            out[open_[hit]] = self.places[self.sampled[row[hit]]] + steps
            open_, row = open_[~hit], row[~hit]
            symbol = self.last[row]
            row = self.before[symbol] + self.rank(symbol, row)
            steps += 1
        return out


def find(hashes: np.ndarray, rows: np.ndarray, query: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """First word and phrase number of every occurrence in the words of a shard."""
    none = np.zeros(0, np.int64)
    if not len(hashes) or not len(query.table):
        return none, none
    at = np.minimum(np.searchsorted(query.vocabulary, hashes), len(query.vocabulary) - 1)
    symbol = np.where(query.vocabulary[at] == hashes, at + 1, 0)
    joined = np.zeros(len(symbol), bool)  # a phrase may run on from this word to the next
    if len(query.pairs):
        pair = symbol[:-1] << 32 | symbol[1:]
        at = np.minimum(np.searchsorted(query.pairs, pair), len(query.pairs) - 1)
        joined[:-1] = (query.pairs[at] == pair) & (symbol[:-1] > 0) & (symbol[1:] > 0)
        last = rows[1:][(rows[1:] > 0)] - 1
        joined[last] = False
    kept = joined | np.concatenate([[False], joined[:-1]]) | np.isin(symbol, query.single)
    where = np.flatnonzero(kept)
    if not len(where):
        return none, none
    # a mark of its own kind (0) stands after every stretch
    closed = ~joined[where]
    place = np.arange(len(where)) + np.concatenate([[0], np.cumsum(closed)[:-1]])
    text = np.zeros(len(where) + int(closed.sum()), np.int64)
    text[place] = symbol[where]
    source = np.zeros(len(text), np.int64)
    source[place] = where
    index = FMIndex(text)
    phrase, low, high = index.search(query.table)
    count = high - low
    row = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(count) else none
    return source[index.locate(row)], np.repeat(phrase, count)


def read_blocks(benchmark: DataFrame, window: int) -> list:
    """The test phrases, in broadcast blocks of bounded size."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // BLOCK_BYTES))
    blocks = []
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == k)
        got = [(r.item, bytes(r.text)) for r in part.toLocalIterator()]
        if got:
            blocks.append(benchmark.sparkSession.sparkContext.broadcast(phrases(got, window)))
    return blocks


def _cover(n: int, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _apply(docs: DataFrame, benchmark: DataFrame, window: int, clean: bool) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    blocks = read_blocks(benchmark, window)
    source = docs.withColumn("__text", F.col("text"))
    digest = lambda names: hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text", SHARD_BYTES):
            data, offsets = flat(part, "__text")
            lower = LOWER[data]
            starts, ends, rows = words(lower, offsets, ALPHANUMERIC)
            hashes = word_hashes(lower, starts, ends)
            hit = np.zeros(len(starts), bool)
            items: list[set[str]] = [set() for _ in range(part.num_rows)]
            for block in blocks:
                query = block.value
                first, phrase = find(hashes, rows, query)
                hit |= _cover(len(starts), first, query.length[phrase])
                owner = np.searchsorted(rows, first, "right") - 1
                for pair in np.unique(owner << 32 | phrase).tolist():
                    at = pair & 0xFFFFFFFF
                    items[pair >> 32].update(query.names[i] for i in query.items[query.item_at[at] : query.item_at[at + 1]])
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[rows[1:]] - total[rows[:-1]]
            if not clean:
                cols = [part.column(0), np.diff(rows), n_hit, [len(x) for x in items], [digest(x) for x in items], n_hit > 0]
                kinds = [part.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, kinds)], list(OUT))
                continue
            gone = _spans(hit, rows)
            texts = part.column(part.num_columns - 1).to_pylist()
            for r in np.flatnonzero(n_hit).tolist():
                raw, left, at = data[offsets[r] : offsets[r + 1]].tobytes(), [], 0
                for a, b in gone[r]:
                    left.append(raw[at : starts[a] - offsets[r]])
                    at = ends[b - 1] - offsets[r]
                texts[r] = b"".join([*left, raw[at:]]).decode()
            yield pa.RecordBatch.from_arrays([*(pa.array(texts, f.type) if f.name == "text" else c for c, f in zip(part.columns[:-1], part.schema)), ], part.schema.names[:-1])

    if clean:
        return source.mapInArrow(run, docs.schema)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return source.select("doc_id", "__text").mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


OUT = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _spans(hit: np.ndarray, rows: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Merged runs of hit words, per row."""
    begin = hit.copy()
    begin[1:] &= ~hit[:-1]
    edges = rows[:-1][rows[:-1] < len(hit)]
    begin[edges] = hit[edges]
    out: dict[int, list[tuple[int, int]]] = {}
    a = np.flatnonzero(begin)
    stop = np.flatnonzero(np.append(~hit, True))
    b = np.minimum(stop[np.searchsorted(stop, a)], np.append(a[1:], len(hit)))
    for r, x, y in zip((np.searchsorted(rows, a, "right") - 1).tolist(), a.tolist(), b.tolist()):
        y = min(y, int(rows[r + 1]))
        out.setdefault(r, []).append((x, y))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null texts have no words; a null item_id counts as an item named by the empty string;
    items that repeat an id are one item. Repeated documents are judged row by row; an empty
    table on either side gives no hits; other columns are not read.
    """
    return _apply(docs.select("doc_id", "text"), benchmark, window, clean=False)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the hit spans cut out of ``text``, from the first hit word to the last; other rows unchanged."""
    return _apply(docs, benchmark, window, clean=True)
