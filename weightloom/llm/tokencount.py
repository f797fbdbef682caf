"""Token counts by rank-synchronous merging of ragged arrays.

A batch's distinct pre-tokens lie in one symbol array. In each round every
sequence finds its lowest-rank pair, all its occurrences merge at once, and
sequences without a pair leave with the number of their symbols.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from weightloom.llm.common import bounded_batches, slices

NONE = np.iinfo(np.int64).max
#: The byte-level split, with white space as Unicode defines it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Distinct pre-tokens a task remembers before it starts anew.
REMEMBERED = 400_000


@dataclass
class Merges:
    """A byte-level vocabulary: first symbol of each byte, sorted pair keys, ranks, merged symbols, special strings."""

    first: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    special: list[str]


def load(path: str) -> Merges:
    """Reads a byte-level BPE file in the ``tokenizers`` JSON format."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
    order = np.argsort(keys)
    return Merges(
        np.array([vocab[letter[b]] for b in range(256)], np.int64), keys[order], order.astype(np.int64),
        np.array([vocab[a + b] for a, b in pairs], np.int64)[order], [t["content"] for t in spec["added_tokens"]],
    )


def merged_sizes(pieces: list[bytes], model: Merges) -> np.ndarray:
    """How many symbols remain of each piece."""
    out = np.fromiter(map(len, pieces), np.int64, len(pieces))
    symbols = model.first[np.frombuffer(b"".join(pieces), np.uint8)]
    owner = np.repeat(np.arange(len(pieces)), out)
    while len(symbols) > 1:
        begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        key = symbols[:-1] << 32 | symbols[1:]
        at = np.minimum(np.searchsorted(model.keys, key), len(model.keys) - 1)
        rank = np.full(len(symbols), NONE)
        known = (model.keys[at] == key) & (owner[1:] == owner[:-1])
        rank[:-1][known] = model.ranks[at[known]]
        size = np.diff(np.append(begin, len(symbols)))
        low = np.minimum.reduceat(rank, begin)
        done = low == NONE
        out[owner[begin[done]]] = size[done]
        hit = (rank == np.repeat(low, size)) & (rank != NONE)
        index = np.arange(len(symbols))
        run = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), index, 0))
        hit &= (index - run) % 2 == 0  # of overlapping pairs, as in a run of one symbol, every second one
        where = np.flatnonzero(hit)
        symbols[where] = model.merged[at[where]]
        keep = np.repeat(~done, size)
        keep[where + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    out[owner] = np.minimum(out[owner], 1) if len(symbols) == 1 else out[owner]
    return out


def count_texts(texts: list[str], model: Merges, cache: dict[str, int]) -> list[int]:
    """Tokens of each text; ``cache`` holds the sizes of pre-tokens seen before."""
    split, special = regex.compile(SPLIT), regex.compile("|".join(map(regex.escape, sorted(model.special, key=len, reverse=True))) or r"(?!)")
    if len(cache) > REMEMBERED:
        cache.clear()
    found: list[tuple[int, list[str]]] = []
    for text in texts:
        parts = special.split(text)
        found.append((len(parts) - 1, [p for part in parts for p in split.findall(part)]))
    new = list({p for _, pieces in found for p in pieces} - cache.keys())
    cache.update(zip(new, merged_sizes([p.encode() for p in new], model).tolist()))
    size = cache.__getitem__
    return [extra + sum(map(size, pieces)) for extra, pieces in found]


def token_counts(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, ``n_bytes``, ``n_tokens``, ``over_limit``.

    A null text is empty: 0 bytes, 0 tokens. Null and repeated keys and repeated
    rows stay as they are, row for row; an empty table gives an empty table;
    other columns are not read. ``path`` must exist on the driver only.
    """
    bounded_batches(docs.sparkSession)
    model = load(path)
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for part in slices(batches):
            texts = [t or "" for t in part.column(1).to_pylist()]
            n = count_texts(texts, model, cache)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["key", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)
