"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ``ORDER`` bytes. A byte that was seen
behind the longest known context takes its share there; otherwise the escape share is paid
and the next shorter context is asked, down to one of 256 equal shares. A context with n
bytes of t kinds gives a byte seen c times c / (n + t), and t / (n + t) to the escape. The
statistics stay as learned while a text is scored, so its code length is a sum over its bytes.

The trees of all languages are kept as one sorted table of byte sequences for each order, with
one resolved cost per language, so most bytes take a single look-up for all languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weightloom.llm.common import bounded_batches, flat, slices
from weightloom.session import materialize

ORDER = 4
#: Bounds of the fitted sample: about so many documents of each language, chosen by hash, and so many costs
#: (byte sequences of the longest order times languages) in the model that tasks get.
DOCUMENTS = 1000
MAX_COSTS = 4_000_000
UNKNOWN = "und"


def grams(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Each byte with the ``order`` bytes before it in its row (zeros before the row's begin), as one number."""
    value = data.astype(np.uint64)
    # how many bytes of its own row stand before each byte
    have = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, order + 1):
        value[k:] |= np.where(have[k:] >= k, data[:-k], 0).astype(np.uint64) << np.uint64(8 * k) if k < len(data) else np.uint64(0)
    return value


@dataclass
class Model:
    """``keys[k]``: sequences of k + 1 bytes; ``cost[k]``: bits of the last byte behind the others, per language.
    ``contexts[k]``, ``escape[k]``: contexts of k bytes, and bits of their escape (0 for a language without them)."""

    languages: list[str]
    keys: list[np.ndarray]
    cost: list[np.ndarray]
    contexts: list[np.ndarray]
    escape: list[np.ndarray]


def build(languages: list[str], which: np.ndarray, gram: np.ndarray, times: np.ndarray, order: int = ORDER) -> Model:
    """The trees from counts of the longest sequences: language number, sequence, how often."""
    n = len(languages)
    if n and not len(gram):
        which, gram, times = np.zeros(1, np.int64), np.zeros(1, np.uint64), np.zeros(1, np.int64)
    model = Model(languages, [], [], [], [])
    below: np.ndarray | None = None
    for k in range(order + 1):
        low = np.uint64((1 << (8 * (k + 1))) - 1)
        keys, at = np.unique(gram & low, return_inverse=True)
        count = np.zeros((len(keys), n))
        np.add.at(count, (at, which), times)
        contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
        total, kinds = np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
        np.add.at(total, of, count)
        np.add.at(kinds, of, count > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, np.log2(total + kinds) - np.log2(kinds), 0.0)
            seen = np.log2(total + kinds)[of] - np.log2(count)
        shorter = np.full((len(keys), n), 8.0) if below is None else below[np.searchsorted(model.keys[-1], keys & np.uint64((1 << (8 * k)) - 1))]
        cost = np.where(count > 0, seen, escape[of] + shorter)
        model.keys.append(keys)
        model.cost.append(cost.astype(np.float32))
        model.contexts.append(contexts)
        model.escape.append(escape.astype(np.float32))
        below = cost
    return model


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
    return at, keys[at] == asked


def byte_costs(model: Model, gram: np.ndarray) -> np.ndarray:
    """Bits of each byte under each language, in the order of ``model.languages``."""
    order = len(model.keys) - 1
    at, known = _find(model.keys[order], gram)
    out = model.cost[order][at]
    left = np.flatnonzero(~known)
    out[left] = 0
    for k in range(order, -1, -1):
        if not len(left):
            return out
        # an unseen byte: the escape of this context, then the next shorter one
        at, known = _find(model.contexts[k], (gram[left] >> np.uint64(8)) & np.uint64((1 << (8 * k)) - 1))
        out[left[known]] += model.escape[k][at[known]]
        if not k:
            break
        at, known = _find(model.keys[k - 1], gram[left] & np.uint64((1 << (8 * k)) - 1))
        out[left[known]] += model.cost[k - 1][at[known]]
        left = left[~known]
    out[left] += 8
    return out


def code_lengths(model: Model, part: pa.RecordBatch, text: str, order: int = ORDER, chunk: int = 1 << 20) -> np.ndarray:
    """Bits of each whole text under each language; a long text is summed chunk by chunk."""
    data, offsets = flat(part, text)
    out = np.zeros((part.num_rows, len(model.languages)))
    owner = np.repeat(np.arange(part.num_rows), np.diff(offsets))
    gram = grams(data, offsets, order)
    for a in range(0, len(gram), chunk):
        cost, own = byte_costs(model, gram[a : a + chunk]), owner[a : a + chunk]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[own[first]] += np.add.reduceat(cost, first, axis=0, dtype=np.float64)
    return out


def has_letter(text: str = "text") -> Column:
    return F.coalesce(F.col(f"`{text}`").rlike("\\p{L}"), F.lit(False))


def sample(docs: DataFrame, most: int = DOCUMENTS) -> DataFrame:
    """text, lang of about ``most`` documents of each language: all that come below the language's share of the hashes.

    Only counts per language are gathered; a language with a third of all rows is spread like the others.
    Rows with one id and text have one hash, and are one row of the sample.
    """
    found = docs.filter(F.col("lang").isNotNull() & has_letter())
    share = materialize(found.groupBy(F.col("lang").alias("__lang")).agg((F.lit(float(most)) / F.count(F.lit(1))).alias("__share")), "languages")
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    return found.join(share, F.col("lang") == F.col("__lang")).filter(chance < F.col("__share")).select("doc_id", "text", "lang").distinct().select("text", "lang")


def train(docs: DataFrame, most: int = DOCUMENTS, order: int = ORDER, costs: int = MAX_COSTS) -> Model:
    """A model of the languages of ``docs`` (doc_id, text, lang).

    Spark counts the sequences of the sample by language. Where there are more than ``costs``
    allow, the rare ones go: those below the least power of two that leaves few enough.
    """
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            names = part.column(1).dictionary_encode()
            data, offsets = flat(part, "text")
            gram = grams(data, offsets, order)
            owner = np.repeat(np.asarray(names.indices), np.diff(offsets))
            for k, name in enumerate(names.dictionary.to_pylist()):
                found, times = np.unique(gram[owner == k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(times)], ["lang", "gram", "n"])

    counts = materialize(sample(docs, most).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "byte-contexts")
    languages = sorted(r.lang for r in counts.select("lang").distinct().toLocalIterator())
    sizes = {r.power: r["count"] for r in counts.groupBy(F.floor(F.log2("n")).alias("power")).count().toLocalIterator()}
    power, room = 0, costs // max(1, len(languages))
    while sum(v for k, v in sizes.items() if k >= power) > room:
        power += 1
    table = counts.filter(F.col("n") >= (1 << power)).toArrow()
    number = {x: i for i, x in enumerate(languages)}
    which = np.array([number[x] for x in table.column("lang").to_pylist()], np.int64)
    return build(languages, which, np.asarray(table.column("gram"), np.int64).view(np.uint64), np.asarray(table.column("n"), np.int64), order)


def held_out(key: str = "doc_id") -> Column:
    """Documents that nothing is learned from; a null key is not among them."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def languages(docs: DataFrame, most: int = DOCUMENTS, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits (code length in the predicted language); one row per row of ``docs``.

    The language of the least code length is predicted; ties go to the first by name. ``score``
    is its probability if all learned languages are equally likely beforehand. Null and empty
    texts, texts without a letter, and all texts where no language is learned get ``und``, 0
    and null. Null languages teach nothing; null ids are not held out; repeated rows are scored
    one by one; an empty table gives an empty table; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", held_out().alias("held_out"), has_letter().alias("letter"), "text", "lang")
    sent = docs.sparkSession.sparkContext.broadcast(train(rows.filter("NOT held_out").select("doc_id", "text", "lang"), most, order))
    names = ["doc_id", "held_out", "lang_pred", "score", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for part in slices(batches):
            n = part.num_rows
            if not model.languages:
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([UNKNOWN] * n, pa.string()), pa.array(np.zeros(n)), pa.nulls(n, pa.float64())], names)
                continue
            bits, known = code_lengths(model, part, "text", order), np.asarray(part.column(2))
            best = np.argmin(bits, axis=1)
            least = bits[np.arange(n), best]
            score = np.where(known, 1 / np.exp2(least[:, None] - bits).sum(axis=1), 0.0)
            lang = [model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(least, mask=~known)], names)

    return rows.select("doc_id", "held_out", "letter", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, bits double")
