"""Language-model scoring with a hidden Markov model.

Latent states emit classes of tokens (buckets of their hash), and a class emits its
tokens by their counts, so that the model's tables are bounded whatever the vocabulary:

    P(text) = P_hmm(class sequence) * product of p(token | its class)

Baum-Welch expectations are computed per partition and summed by Spark; the exact
likelihood of a text comes from the scaled forward recursion over all its tokens. Token
counts are shuffled; only tokens above a share of the corpus, which bounds their number,
travel to the tasks, and the others are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weightloom.llm.common import LOWER, SPACE_SEPARATED, bounded_batches, column_bytes, flat, mix, slices, word_hashes, words
from weightloom.session import materialize

STATES = 6
CLASSES = 4096
ROUNDS = 3
SMOOTH = 0.1
STAY = 0.97
#: Baum-Welch cuts training texts into stretches of so many tokens.
STRETCH = 128
#: Tokens with at least 1 / FREQUENT of all occurrences are sent to the tasks: FREQUENT of them at most.
FREQUENT = 2_000_000
#: The end of a text as a token; the byte 32 is in no word.
END = b" "


@dataclass
class Model:
    """Initial, transition and emission probabilities; the emission has a row per class."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def held_out(column: str = "doc_id", parts: int = 10):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts == 0, F.lit(False))


def class_of(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(CLASSES)).astype(np.int64)


def _end_class() -> int:
    data = np.frombuffer(END, np.uint8)
    return int(class_of(word_hashes(data, np.array([0]), np.array([1])))[0])


def sequences(part: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Token classes of all rows, each closed by the end, and where each row begins."""
    data, offsets = flat(part, text)
    data = LOWER[data]
    starts, ends, rows = words(data, offsets, SPACE_SEPARATED)
    n = len(rows) - 1
    out = np.full(len(starts) + n, _end_class(), np.int64)
    out[np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(rows))] = class_of(word_hashes(data, starts, ends))
    return out, rows + np.arange(n + 1)


def log_likelihoods(classes: np.ndarray, rows: np.ndarray, model: Model) -> np.ndarray:
    """log10 P of each class sequence, by forward recursion over all of them side by side."""
    size = np.diff(rows)
    order = np.argsort(-size, kind="stable")
    first, size = rows[:-1][order], size[order]
    active = len(size) - np.searchsorted(size[::-1], np.arange(size[0] if len(size) else 0), "right")
    total = np.zeros(len(size))
    state = None
    for t, k in enumerate(active.tolist()):
        step = model.emit[classes[first[:k] + t]]
        state = step * model.start if t == 0 else (state[:k] @ model.move) * step
        scale = state.sum(axis=1)
        state /= scale[:, None]
        total[:k] += np.log10(scale)
    out = np.empty(len(size))
    out[order] = total
    return out


def expectations(classes: np.ndarray, rows: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions (class, state); stretches of a text begin anew."""
    k = len(model.start)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((CLASSES, k))
    size = np.diff(rows)
    parts = -(-size // STRETCH)
    inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(rows[:-1], parts) + inner * STRETCH
    length = np.minimum(STRETCH, np.repeat(rows[1:], parts) - first)
    opens = inner == 0
    for a in range(0, len(first), 4096):
        order = a + np.argsort(-length[a : a + 4096], kind="stable")
        f, n, o = first[order], length[order], opens[order]
        active = [int((n > t).sum()) for t in range(n[0])]
        forward, emitted = [], []
        for t, m in enumerate(active):
            step = model.emit[classes[f[:m] + t]]
            state = step * model.start if t == 0 else (forward[-1][:m] @ model.move) * step
            forward.append(state / state.sum(axis=1, keepdims=True))
            emitted.append(step)
        back = np.ones((active[-1], k))
        for t in range(len(active) - 1, -1, -1):
            m = active[t]
            if m > len(back):
                back = np.concatenate([back, np.ones((m - len(back), k))])
            gamma = forward[t] * back
            gamma /= gamma.sum(axis=1, keepdims=True)
            symbol = classes[f[:m] + t]
            for s in range(k):
                emit[:, s] += np.bincount(symbol, gamma[:, s], CLASSES)
            if t == 0:
                start += gamma[o].sum(axis=0)
            else:
                ahead = emitted[t] * back
                before = forward[t - 1][:m]
                weight = 1 / np.einsum("ij,ij->i", before @ model.move, ahead)
                move += model.move * (before.T @ (ahead * weight[:, None]))
                back = ahead @ model.move.T
                back /= back.sum(axis=1, keepdims=True)
    return start, move, emit


def initial_model(counts: np.ndarray, states: int = STATES) -> Model:
    """Class frequencies, each state's tilted by a fixed pseudo-random factor; states tend to stay."""
    chance = mix(np.arange(CLASSES * states, dtype=np.uint64)).reshape(CLASSES, states).astype(float) / 2.0**64
    emit = (counts[:, None] + 1) * np.exp(2 * chance - 1)
    return Model(np.full(states, 1 / states), np.full((states, states), (1 - STAY) / states) + STAY * np.eye(states), emit / emit.sum(axis=0))


def token_table(train: DataFrame) -> DataFrame:
    """token (binary), class, count over the training texts; written to the shared folder."""
    kind = "token binary, class int, count long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            keys = list(seen)
            data = np.frombuffer(b"".join(keys), np.uint8)
            ends = np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys)))
            starts = np.concatenate([[0], ends[:-1]])
            got = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(class_of(word_hashes(data, starts, ends)).astype(np.int32)), pa.array(list(seen.values()), pa.int64())], ["token", "class", "count"])
            seen.clear()
            return got

        for part in slices(batches):
            for text in column_bytes(part, "text"):
                seen.update(text.lower().split())
                seen[END] += 1
            if len(seen) > 300_000:
                yield out()
        if seen:
            yield out()

    return materialize(train.select("text").mapInArrow(run, kind).groupBy("token", "class").agg(F.sum("count").alias("count")), "token-counts")


def train_model(train: DataFrame, counts: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all training texts; each round brings states * (classes + states + 1) sums to the driver."""
    model = initial_model(counts, states)
    spark = train.sparkSession
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros((CLASSES + states + 1, states))
            for part in slices(batches):
                start, move, emit = expectations(*sequences(part, "text"), sent.value)
                total += np.concatenate([emit, move, start[None]])
            row, state = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(state.astype(np.int32)), pa.array(total[row, state])], ["row", "state", "value"])

        got = train.select("text").mapInArrow(run, "row int, state int, value double").groupBy("row", "state").agg(F.sum("value").alias("value")).toPandas()
        total = np.zeros((CLASSES + states + 1, states))
        total[got["row"], got["state"]] = got["value"]
        emit, move, start = total[:CLASSES] + SMOOTH / CLASSES, total[CLASSES:-1] + SMOOTH, total[-1] + SMOOTH
        # every class keeps some probability in every state, unseen ones too
        emit = emit / emit.sum(axis=0) * (1 - 1e-4) + 1e-4 / CLASSES
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit)
    return model


def score_texts(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per row of ``docs``.

    A null or empty text is the end alone. A row with a null id trains the model. Unknown
    tokens take the smoothed share of their class. Repeated rows count as often as they
    occur; an empty table gives an empty table; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select("doc_id", "text", held_out().alias("held_out"))
    train = source.filter("NOT held_out")
    table = token_table(train)
    by_class = table.groupBy("class").agg(F.sum("count").alias("c"), F.count(F.lit(1)).alias("v")).toPandas()
    count, size = np.zeros(CLASSES), np.zeros(CLASSES)
    count[by_class["class"]], size[by_class["class"]] = by_class["c"], by_class["v"]
    n, v = int(count.sum()), int(size.sum())
    whole, of_class = n + SMOOTH * (v + 1), count + SMOOTH * (size + 1)
    model = spark.sparkContext.broadcast(train_model(train, count, states, rounds))
    often = table.filter(F.col("count") >= F.lit(max(1.0, n / FREQUENT))).select("token", "count").toPandas()
    known = spark.sparkContext.broadcast(dict(zip(map(bytes, often["token"]), often["count"].tolist())))
    log = np.log10

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text with what frequent tokens and the class sequence give, and its other tokens."""
        frequent = known.value
        value = {t: (float(log((c + SMOOTH) / whole)), 0.0) for t, c in frequent.items()}
        if frequent:
            keys = list(frequent)
            ends = np.cumsum([len(k) for k in keys])
            cls = class_of(word_hashes(np.frombuffer(b"".join(keys), np.uint8), np.concatenate([[0], ends[:-1]]), ends))
            value = {t: (float(log((frequent[t] + SMOOTH) / whole)), float(log((frequent[t] + SMOOTH) / of_class[c]))) for t, c in zip(keys, cls.tolist())}
        for part in slices(batches):
            classes, rows = sequences(part, "text")
            hmm = log_likelihoods(classes, rows, model.value)
            cols: list[list] = [[], [], [], [], []]
            for text in column_bytes(part, "text"):
                seen = Counter(text.lower().split())
                seen[END] += 1
                base = inner = 0.0
                found, rare, times = 0, [], []
                for token, k in seen.items():
                    if (got := value.get(token)) is not None:
                        base += k * got[0]
                        inner += k * got[1]
                        found += k
                    else:
                        rare.append(token)
                        times.append(k)
                for c, x in zip(cols, (base, inner, found, rare, times)):
                    c.append(x)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(np.diff(rows)), pa.array(cols[2], pa.int64()), pa.array(cols[0]), pa.array(np.array(cols[1]) + hmm), pa.array(cols[3], pa.list_(pa.binary())), pa.array(cols[4], pa.list_(pa.int32()))],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "times"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    scanned = materialize(source.mapInArrow(scan, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<binary>, times array<int>").withColumn("uid", F.monotonically_increasing_id()), "scored-texts")
    rare = scanned.filter(F.size("rare") > 0).select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("token"), F.col("x.times").alias("k"))
    sums = spark.sparkContext.broadcast(of_class)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch, "token")
            cls = class_of(word_hashes(data, offsets[:-1], offsets[1:]))
            c = np.asarray(batch.column(2).fill_null(0)).astype(float)
            k = np.asarray(batch.column(1)).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(k * log((c + SMOOTH) / whole)), pa.array(k * log((c + SMOOTH) / sums.value[cls])), pa.array(np.where(c > 0, k, 0).astype(np.int64))], ["uid", "b", "s", "n"])

    tail = table.filter(F.col("count") < F.lit(max(1.0, n / FREQUENT))).select("token", "count")
    met = rare.join(tail, "token", "left").select("token", "k", "count", "uid").mapInArrow(classed, "uid long, b double, s double, n long")
    more = met.groupBy("uid").agg(F.sum("b").alias("b"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scanned.drop("rare", "times").join(more, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("n")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero("b")).alias("base_score"), (F.col("score") + zero("s")).alias("score"),
    )
