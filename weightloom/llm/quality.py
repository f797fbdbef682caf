"""Quality rules with adaptive thresholds.

Each feature gets its fences from mergeable KLL sketches of the documents of one
language and source. The fewer documents a group has, the more its fences lean on those
of its language, and these on those of all documents: a group of n takes n parts of its
own and ``LEAN`` parts of the wider one. Documents join their group's fences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from weightloom.llm.common import SPACE_SEPARATED, Rolling, bounded_batches, column_bytes, flat, slices, word_hashes, words
from weightloom.session import materialize

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\r\x0b\x0c"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Sketch size (rank error about 1 / SKETCH), and the weight, in documents, of the wider group's fences.
SKETCH = 2048
LEAN = 100.0
#: Fences lie FENCE spreads beyond the quartiles; a spread is the quartile distance, at least the feature's own least.
FENCE = 3.0
#: Feature: (is there a lower fence, is there an upper fence, least spread).
FEATURES = {
    "word_length": (True, True, 0.5),
    "symbol_share": (False, True, 0.02),
    "dup_line_share": (False, True, 0.2),
    "repeat_share": (False, True, 0.06),
}


def repeated_words(hashes: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """Words of each row in a window of ``width`` words that its row holds twice or more."""
    n = len(hashes)
    out = np.zeros(len(rows) - 1, np.int64)
    if n < width:
        return out
    begin = np.arange(n - width + 1)
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    begin = begin[owner[begin] == owner[begin + width - 1]]
    value = Rolling(hashes, 0x9E3779B97F4A7C15).of(begin, begin + width)
    order = np.lexsort((owner[begin], value))
    v, o = value[order], owner[begin[order]]
    equal = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= equal
    twice[:-1] |= equal
    edge = np.zeros(n + 1, np.int64)
    hit = begin[order[twice]]
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return covered[rows[1:]] - covered[rows[:-1]]


def counted(part: pa.RecordBatch, text: str, width: int = 5) -> dict[str, list]:
    """The counts of each row."""
    data, offsets = flat(part, text)
    starts, ends, rows = words(data, offsets, SPACE_SEPARATED)
    letters = np.concatenate([[0], np.cumsum((data & 0xC0 != 0x80) & SPACE_SEPARATED[data])])
    symbols = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))])
    dup, filled = [], []
    for raw in column_bytes(part, text):
        lines = [x for x in raw.split(b"\n") if x.strip(WHITE)]
        dup.append(len(lines) - len(set(lines)))
        filled.append(len(lines))
    a, b = offsets[:-1], offsets[1:]
    return dict(zip(COUNTS, (np.diff(rows), letters[b] - letters[a], symbols[b] - symbols[a], dup, repeated_words(word_hashes(data, starts, ends), rows, width), filled)))


def with_counts(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the counts as long columns, named behind ``prefix``."""
    bounded_batches(docs.sparkSession)
    source = docs.withColumn("__text", F.col(f"`{text}`"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            got = counted(part, "__text")
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], *(pa.array(got[c], pa.int64()) for c in COUNTS)], [*part.schema.names[:-1], *(prefix + c for c in COUNTS)],
            )

    return source.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(prefix + c, T.LongType()) for c in COUNTS)]))


def _ratios(prefix: str) -> dict[str, Column]:
    n = {c: F.col(prefix + c).cast("double") for c in COUNTS}
    per_word = lambda x: F.when(n["n_words"] > 0, x / n["n_words"]).otherwise(0.0)
    return {
        "word_length": per_word(n["word_chars"]),
        "symbol_share": F.when(n["word_chars"] > 0, n["n_symbols"] / n["word_chars"]).otherwise(0.0),
        "dup_line_share": F.when(n["n_lines"] > 0, n["n_dup_lines"] / n["n_lines"]).otherwise(0.0),
        "repeat_share": per_word(n["n_repeat_words"]),
    }


def fences(counts: DataFrame, prefix: str = "") -> DataFrame:
    """One row per (lang, source): a lower and an upper fence of every feature.

    One aggregation builds the sketches per group; those of a language and of all
    documents are merges of them, so no document is read twice.
    """
    ratio = _ratios(prefix)
    groups = materialize(
        counts.select("lang", "source", *(v.alias(k) for k, v in ratio.items())).groupBy("lang", "source")
        .agg(F.count(F.lit(1)).alias("n"), *(F.kll_sketch_agg_double(k, F.lit(SKETCH)).alias(k) for k in FEATURES)),
        "quality-sketches",
    )

    def merged(*keys: str) -> DataFrame:
        return groups.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(k, F.lit(SKETCH)).alias(k) for k in FEATURES))

    quartile = lambda k, p: F.kll_sketch_get_quantile_double(k, F.lit(p))

    def fenced(level: DataFrame, keys: list[str], mark: str) -> DataFrame:
        """The fences that a level's own quartiles give, and its size."""
        ends = {}
        for k, (_, _, least) in FEATURES.items():
            spread = F.greatest(quartile(k, 0.75) - quartile(k, 0.25), F.lit(least))
            ends |= {f"{k}_low": quartile(k, 0.25) - FENCE * spread, f"{k}_high": quartile(k, 0.75) + FENCE * spread}
        # no documents at all: no sketch
        return level.filter("n > 0").select(*(F.col(x).alias(f"{mark}_{x}") for x in keys), F.col("n").cast("double").alias(f"{mark}_n"), *(v.alias(f"{mark}_{x}") for x, v in ends.items()))

    g, l, a = fenced(groups, ["lang", "source"], "g"), fenced(merged("lang"), ["lang"], "l"), fenced(merged(), [], "a")
    lean = lambda n, own, wider: (n * own + LEAN * wider) / (n + LEAN)
    joined = g.join(l, F.col("g_lang").eqNullSafe(F.col("l_lang")), "left").withColumn("one", F.lit(1)).join(a.withColumn("one", F.lit(1)), "one", "left")
    names = [f"{k}_{end}" for k in FEATURES for end in ("low", "high")]
    return materialize(joined.select(
        F.col("g_lang").alias("lang"), F.col("g_source").alias("source"),
        *(F.round(lean(F.col("g_n"), F.col(f"g_{x}"), lean(F.col("l_n"), F.col(f"l_{x}"), F.col(f"a_{x}"))), 2).alias(x) for x in names),
    ), "quality-fences")


def base_failed(prefix: str = "") -> Column:
    return (F.col(f"{prefix}n_words") < MIN_WORDS) | (100 * F.col(f"{prefix}n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{prefix}n_words"))


def judged(counts: DataFrame, limits: DataFrame, prefix: str = "", verdict: str = "kept") -> DataFrame:
    """``counts`` with ``verdict``: inside all fences of its group and not ``base_failed``.

    The fences have one row per group; Spark broadcasts them if their files are
    small and otherwise splits a hot group's rows in the join.
    """
    ratio = _ratios(prefix)
    inside = ~base_failed(prefix)
    for k, (low, high, _) in FEATURES.items():
        inside &= (ratio[k] >= F.col(f"__f.{k}_low")) if low else F.lit(True)
        inside &= (ratio[k] <= F.col(f"__f.{k}_high")) if high else F.lit(True)
    joined = counts.alias("__c").join(limits.alias("__f"), F.col("__c.lang").eqNullSafe(F.col("__f.lang")) & F.col("__c.source").eqNullSafe(F.col("__f.source")), "left")
    return joined.select("__c.*", inside.alias(verdict))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts, ``base_failed``, ``kept``, ``n_lines`` (those with a word); one row per row of ``docs``.

    A null text has no words, so it fails the base rule. Null lang or source form
    groups of their own; repeated rows and ids are judged row by row; ties at a
    fence are kept; an empty table gives an empty table. Other columns are not read.
    """
    counts = materialize(with_counts(docs.select("doc_id", "lang", "source", "text")).drop("text"), "quality-counts")
    return judged(counts, fences(counts)).select("doc_id", *COUNTS[:5], base_failed().alias("base_failed"), "kept", "n_lines")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are.

    Nulls, ties, repeated rows and empty tables as in ``quality_rules``. Texts are counted twice,
    slice by slice, so that no text, however long, is written or shuffled; columns that are named
    like a count stay, as the counts have a prefix here.
    """
    prefix = "__quality_"
    narrow = materialize(with_counts(docs.select("lang", "source", "text"), prefix=prefix).drop("text"), "quality-counts")
    return judged(with_counts(docs, prefix=prefix), fences(narrow, prefix), prefix, "__kept").filter("__kept").select(*(f"`{c}`" for c in docs.columns))
