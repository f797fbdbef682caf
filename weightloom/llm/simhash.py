"""SimHash near-duplicates by ball hashing.

Two fingerprints differ in at most r bits if and only if some value lies within
r / 2 bits of both. Every distinct fingerprint emits all its variants within that
half radius; fingerprints that meet on a variant are verified and linked, and
links become components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from weightloom.llm.common import bounded_batches, column_bytes, slices
from weightloom.session import materialize

SEED = 42


def fingerprint(text: bytes, width: int = 3) -> int:
    """64 bits, each set where more than half of the shingle hashes have it."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = max(1, len(parts) - width + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start[:n].tolist(), end[min(width, len(parts)) - 1 :].tolist())), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the fingerprint ``fp`` as a signed long, row by row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            got = np.array([fingerprint(t, width) for t in column_bytes(part, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got.view(np.int64))], ["key", "fp"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, fp long").withColumnRenamed("key", key)


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (a < b) of distinct fingerprints ``fp`` that keep every component together.

    For an even radius all who meet on a variant are within ``radius`` of each other, so
    linking each to the least of them loses no component; a variant meets at most as
    many fingerprints as its ball holds (65 for radius 2), so no group can grow.
    """
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even: half of it is hashed")
    flips = [sum(1 << b for b in bits) for k in range(radius // 2 + 1) for bits in combinations(range(64), k)]
    masks = F.array(*(F.lit(x - (1 << 64) if x >> 63 else x) for x in flips))
    met = distinct.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    groups = met.groupBy("variant").agg(F.collect_list("fp").alias("met")).filter(F.size("met") > 1)
    pairs = groups.select(F.array_min("met").alias("a"), F.explode("met").alias("b")).filter("a < b").distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Nodes of ``edges`` (a, b: longs) with ``root``, the least node they reach.

    Alternating large-star and small-star steps; every round is written to the shared
    folder and only its numbers of edges and its fingerprint come to the driver.
    """
    current = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), name)
    last = None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        current = materialize(small, name)
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``fp`` (signed long) and ``component_id``, the least key reachable by links.

    Null and empty texts have fingerprint zero and link like any other. Null keys stay as
    rows; a component of null keys alone has a null id. Repeated rows are each returned;
    an empty table gives an empty table; other columns are not read.
    """
    prints = materialize(fingerprints(docs, width, key, text), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min(key).alias("least")), "fingerprint-classes")
    found = materialize(links(distinct, radius), "fingerprint-links")
    root = components(found.select("a", "b"))
    classes = distinct.join(root, distinct.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = materialize(classes.groupBy("root").agg(F.min("least").alias("component_id")).join(classes, "root").select("fp", "component_id"), "fingerprint-components")
    return prints.join(ids, "fp", "left").select(key, "fp", "component_id")


def identity(key: str, text: str) -> dict[str, Column]:
    """What names a document: its ``id``, a ``hash`` of its text, which gives the order, and the text's SHA-256 as
    ``digest``, as different texts of one id (or of none) can share a hash of 64 bits."""
    return {"id": F.col(key), "hash": F.xxhash64(text), "digest": F.unhex(F.sha2(text, 256))}


def named(names: dict[str, Column], by: DataFrame, columns: list[str]) -> Column:
    """Whether ``names`` equal those of ``by`` in all ``columns``, null as null."""
    return reduce(and_, (names[c].eqNullSafe(by[c]) for c in columns))


def keep_one(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """One row of each component, all columns as they are: that of the least doc_id (null
    first), of rows with this id the one of the least text hash (then digest), and of rows equal
    in text the one whose columns are least. Equal rows are combined before the shuffle."""
    name = F.struct(*(c.alias(n) for n, c in identity("doc_id", "text").items()))
    near = near_duplicates(docs.select(name.alias("__key"), "text"), radius, width, key="__key")
    keep = materialize(near.filter("__key = component_id").select("component_id.*").distinct(), "simhash-kept")
    return one_row(docs, keep)


def one_row(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``keep`` names by columns of ``identity``, of rows equal in id and text the least.

    With the ``digest`` that is one row for each name. Without it, texts that share an id and a hash cannot be told apart: none is dropped."""
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    best = docs.groupBy(F.col("doc_id").alias("__id"), F.col("text").alias("__text")).agg(F.min(rest).alias("__row"))
    same = named(identity("__id", "__text"), keep, keep.columns)
    return best.join(keep, same, "left_semi").select(*(F.col("__text").alias("text") if c == "text" else F.col(f"__row.`{c}`") for c in docs.columns))
