"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its hashed word vector and the mean of its hashed character n-gram
vectors. Two gated recurrent layers read a window of words in both directions, attention
pools their states, and a linear layer gives the window's logit. All windows of a text
(``WIDTH`` words, every ``STRIDE``) are scored; the largest logit and the number of
windows, calibrated on labelled documents, give the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weightloom.llm.common import ALPHANUMERIC, LOWER, bounded_batches, flat, mix, slices, word_hashes, words
from weightloom.session import materialize

WIDTH, STRIDE = 32, 16
WORDS, BUCKETS, DIM, HIDDEN = 1 << 15, 1 << 15, 8, 8
GRAMS = (3, 5)
#: Bounds of the fitted sample: labelled documents and windows of each label, in the order of their hash.
MAX_DOCUMENTS, MAX_WINDOWS = 2000, 12_000
EPOCHS, BATCH, RATE = 6, 256, 0.01
THRESHOLD = 0.3
Weights = dict[str, np.ndarray]


def cut(part: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words as (bytes, starts, ends), word numbers of all windows (-1 behind the end), and each window's row."""
    data, offsets = flat(part, text)
    data = LOWER[data]
    starts, ends, rows = words(data, offsets, ALPHANUMERIC)
    _, first, number = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    size = np.diff(rows)
    count = np.where(size > 0, np.maximum(-(-(size - WIDTH) // STRIDE), 0) + 1, 0)
    owner = np.repeat(np.arange(len(size)), count)
    begin = rows[owner] + STRIDE * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
    at = begin[:, None] + np.arange(WIDTH)
    inside = at < rows[owner + 1][:, None]
    table = np.where(inside, number[np.minimum(at, max(len(number) - 1, 0))] if len(number) else 0, -1)
    return data, starts[first], ends[first], table, owner


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket of each word; buckets of the character n-grams of all words (each word between
    two marks) and where each word's begin."""
    n = len(starts)
    word = (mix(word_hashes(data, starts, ends)) % np.uint64(WORDS)).astype(np.int64)
    size = ends - starts
    total = size + 2
    begin = np.cumsum(total) - total
    text = np.ones(int(total.sum()), np.uint64)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(begin + 1, size) + inner] = data[np.repeat(starts, size) + inner]
    owner = np.repeat(np.arange(n), total)
    grams, owners = [], []
    for k in GRAMS:
        if len(text) < k:
            continue
        value = np.full(len(text) - k + 1, k, np.uint64)
        for j in range(k):
            value = value * np.uint64(0x100000001B3) + text[j : len(text) - k + 1 + j]
        inside = owner[: len(value)] == owner[k - 1 :]
        grams.append((mix(value[inside]) % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[: len(value)][inside])
    if not grams:
        return word, np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return word, np.concatenate(grams)[order], np.searchsorted(owner[order], np.arange(n + 1))


def inputs(w: Weights, word: np.ndarray, gram: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The network's input for each word: word vector and mean character n-gram vector."""
    if not len(word):
        return np.zeros((0, 2 * DIM), np.float32)
    chars = np.add.reduceat(w["gram"][gram], at[:-1], axis=0) / np.diff(at)[:, None]
    return np.concatenate([w["word"][word], chars.astype(np.float32)], axis=1)


def initial() -> Weights:
    rng = np.random.default_rng(7)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    w = {"word": draw(WORDS, DIM, scale=0.1), "gram": draw(BUCKETS, DIM, scale=0.1)}
    for d in "fb":
        w |= {f"in_{d}": draw(2 * DIM, 3 * HIDDEN, scale=0.3), f"own_{d}": draw(HIDDEN, 3 * HIDDEN, scale=0.3), f"bias_{d}": np.zeros(3 * HIDDEN, np.float32)}
    return w | {"att": draw(2 * HIDDEN, HIDDEN, scale=0.3), "ask": draw(HIDDEN, scale=0.3), "out": draw(2 * HIDDEN, scale=0.3), "base": np.zeros(1, np.float32)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def recur(w: Weights, d: str, table: np.ndarray, projected: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (time, window, HIDDEN) of one direction; ``projected`` has a row per word and one of zeros at the end."""
    own = w[f"own_{d}"]
    h = np.zeros((len(table), HIDDEN), np.float32)
    states = np.empty((WIDTH, len(table), HIDDEN), np.float32)
    for t in range(WIDTH) if d == "f" else range(WIDTH - 1, -1, -1):
        x = projected[table[:, t]]
        u = h @ own
        zr = sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        new = np.tanh(x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
        live = (table[:, t] >= 0)[:, None]
        after = np.where(live, new + z * (h - new), h)
        if keep is not None:
            keep.append((t, h, z, r, new, u[:, 2 * HIDDEN :], live))
        h = states[t] = after
    return states


def project(w: Weights, d: str, x: np.ndarray) -> np.ndarray:
    return np.concatenate([x @ w[f"in_{d}"] + w[f"bias_{d}"], np.zeros((1, 3 * HIDDEN), np.float32)])


def pool(w: Weights, table: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Attention over the words of each window: weights, inner layer, pooled state."""
    inner = np.tanh(states @ w["att"])
    score = np.where(table.T >= 0, inner @ w["ask"], -1e9)
    alpha = np.exp(score - score.max(axis=0))
    alpha = (alpha / alpha.sum(axis=0)).astype(np.float32)
    return alpha, inner, np.einsum("tn,tnh->nh", alpha, states)


def logits(w: Weights, x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Logit of each window."""
    both = [project(w, d, x) for d in "fb"]
    out = np.empty(len(table), np.float32)
    for a in range(0, len(table), 4096):
        part = table[a : a + 4096]
        states = np.concatenate([recur(w, d, part, p) for d, p in zip("fb", both)], axis=2)
        out[a : a + 4096] = pool(w, part, states)[2] @ w["out"] + w["base"][0]
    return out


def gathered(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by row number."""
    return np.stack([np.bincount(rows, values[:, j], n) for j in range(values.shape[1])], axis=1).astype(np.float32)


def gradients(w: Weights, features: tuple, table: np.ndarray, target: np.ndarray) -> tuple[Weights, np.ndarray]:
    """Gradient of the mean cross-entropy of a batch of windows, and the windows' probabilities."""
    word, gram, at = features
    used, small = np.unique(table, return_inverse=True)
    small = small.reshape(table.shape) - (used[0] < 0)
    used = used[used >= 0]
    size = np.diff(at)[used]
    inner_at = np.append(np.cumsum(size) - size, size.sum())
    grams = gram[np.repeat(at[used], size) + np.arange(size.sum()) - np.repeat(inner_at[:-1], size)]
    x = inputs(w, word[used], grams, inner_at)
    kept: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate([recur(w, d, small, project(w, d, x), kept[d]) for d in "fb"], axis=2)
    alpha, inner, pooled = pool(w, small, states)
    p = sigmoid(pooled @ w["out"] + w["base"][0])
    g = {k: np.zeros_like(v) for k, v in w.items()}
    error = ((p - target) / len(target)).astype(np.float32)
    g["out"], g["base"] = pooled.T @ error, np.array([error.sum()], np.float32)
    d_pool = error[:, None] * w["out"]
    d_states = alpha[:, :, None] * d_pool
    d_alpha = np.einsum("nh,tnh->tn", d_pool, states)
    d_score = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
    g["ask"] = np.einsum("tn,tnh->h", d_score, inner)
    d_inner = d_score[:, :, None] * w["ask"] * (1 - inner**2)
    g["att"] = np.einsum("tnh,tnk->hk", states, d_inner)
    d_states = d_states + d_inner @ w["att"].T
    d_x = np.zeros_like(x)
    for i, d in enumerate("fb"):
        own, back = w[f"own_{d}"], np.zeros((len(small), HIDDEN), np.float32)
        steps = np.empty((WIDTH, len(small), 3 * HIDDEN), np.float32)
        for t, h, z, r, new, u, live in reversed(kept[d]):
            d_h = back + d_states[t][:, i * HIDDEN : (i + 1) * HIDDEN]
            through = np.where(live, d_h, 0)
            d_new = through * (1 - z) * (1 - new**2)
            d_in = np.concatenate([through * (h - new) * z * (1 - z), d_new * u * r * (1 - r), d_new], axis=1)
            d_u = np.concatenate([d_in[:, : 2 * HIDDEN], d_new * r], axis=1)
            g[f"own_{d}"] += h.T @ d_u
            back = np.where(live, through * z, d_h) + d_u @ own.T
            steps[t] = d_in
        d_proj = gathered(small.T.ravel() % (len(x) + 1), steps.reshape(-1, 3 * HIDDEN), len(x) + 1)[:-1]
        g[f"in_{d}"], g[f"bias_{d}"] = x.T @ d_proj, d_proj.sum(axis=0)
        d_x += d_proj @ w[f"in_{d}"].T
    g["word"] = gathered(word[used], d_x[:, :DIM], WORDS)
    g["gram"] = gathered(grams, np.repeat(d_x[:, DIM:] / size[:, None], size, axis=0), BUCKETS)
    return g, p


def fit(features: tuple, table: np.ndarray, target: np.ndarray, epochs: int = EPOCHS) -> Weights:
    """Adam over shuffled batches. After half the epochs, windows of toxic documents that score
    like those of other documents leave: the label is a document's, not each window's."""
    w, rng = initial(), np.random.default_rng(11)
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    use = np.arange(len(table))
    for epoch in range(epochs):
        if epoch == epochs // 2:
            x = inputs(w, *features)
            score = logits(w, x, table)
            clean = score[target == 0]
            if len(clean) and (target == 1).any():
                use = np.flatnonzero((target == 0) | (score > np.quantile(clean, 0.95)))
        order = rng.permutation(use)
        for a in range(0, len(order), BATCH):
            batch = order[a : a + BATCH]
            g, _ = gradients(w, features, table[batch], target[batch])
            step += 1
            for k in w:
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.001 * (g[k] ** 2 - second[k])
                w[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return w


def calibrate(x: np.ndarray, target: np.ndarray, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps, slightly drawn to zero."""
    beta, penalty = np.zeros(x.shape[1]), 1e-2 * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta = beta - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - target) + penalty @ beta)
    return beta


def _evidence(best: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(best)), np.clip(best, -15, 15), np.log1p(count)], axis=1)


def document_logits(part: pa.RecordBatch, text: str, w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Largest window logit of each row (that of no window at all for empty texts), and its number of windows."""
    data, starts, ends, table, owner = cut(part, text)
    best = np.full(part.num_rows, -np.inf)
    np.maximum.at(best, owner, logits(w, inputs(w, *word_features(data, starts, ends)), table))
    return np.where(np.isinf(best), w["base"][0], best), np.bincount(owner, minlength=part.num_rows)


def is_held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> tuple[Weights, np.ndarray]:
    """Network and calibration from at most ``MAX_DOCUMENTS`` documents of each label outside the held-out fold."""
    spark = docs.sparkSession
    marked = labels.filter(~is_held_out()).filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = [marked.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_DOCUMENTS) for y in (0, 1)]
    chosen = materialize(docs.select("doc_id", "text").join(F.broadcast(sample[0].union(sample[1])), "doc_id"), "toxicity-sample")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, starts, ends, table, owner = cut(part, "text")
            text = [b" ".join(data[starts[i] : ends[i]].tobytes() for i in row if i >= 0).decode(errors="replace") for row in table]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), part.column(2).take(pa.array(owner))], ["window", "toxic"])

    cuts = chosen.select("doc_id", "text", "toxic").mapInArrow(windows, "window string, toxic int")
    got = [cuts.filter(F.col("toxic") == y).distinct().orderBy(F.xxhash64("window"), "window").limit(MAX_WINDOWS).toPandas() for y in (0, 1)]
    text = pa.RecordBatch.from_arrays([pa.array([*got[0]["window"], *got[1]["window"]], pa.string())], ["text"])
    target = np.repeat([0.0, 1.0], [len(got[0]), len(got[1])]).astype(np.float32)
    data, starts, ends, table, owner = cut(text, "text")
    weights = fit(word_features(data, starts, ends), table, target[owner]) if len(table) else initial()
    sent = spark.sparkContext.broadcast(weights)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            best, count = document_logits(part, "text", sent.value)
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.float64()), pa.array(count, pa.int64()), part.column(1)], ["best", "count", "toxic"])

    seen = chosen.select("text", "toxic").mapInArrow(judge, "best double, count long, toxic int").toPandas()
    share = marked.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    if not len(seen) or not 0 < share < 1 or seen["toxic"].nunique() < 2:
        return weights, np.array([np.log((share + 1e-3) / (1 - share + 1e-3)), 0.0, 0.0])
    y = (seen["toxic"] == 1).to_numpy(float)
    beta = calibrate(_evidence(seen["best"].to_numpy(), seen["count"].to_numpy()), y)
    mean = y.mean()
    beta[0] += np.log(share / (1 - share)) - np.log(mean / (1 - mean))  # from the sample's share of toxic texts to that of all labels
    return weights, beta


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per row of ``docs``.

    Null and empty texts, and texts without a word, have no window and get one common low
    score. Without labels of both kinds every score is the share of toxic labels. Null ids
    are not held out; repeated rows are scored row by row; labels that repeat an id count
    once, as the largest; an empty table gives an empty table; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, beta = model.value
        for part in slices(batches):
            best, count = document_logits(part, "text", weights)
            score = 1 / (1 + np.exp(-_evidence(best, count) @ beta))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", is_held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
