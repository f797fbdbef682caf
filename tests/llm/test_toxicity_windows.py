"""Scores of whole texts against a plain network that reads window by window, word by word."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from weightloom.llm import toxicity as T
from weightloom.llm.common import mix, word_hashes

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_input(w, word):
    """Word vector and mean vector of the character n-grams of the word between two marks."""
    raw = np.frombuffer(word.encode(), np.uint8)
    bucket = int(mix(word_hashes(raw, np.array([0]), np.array([len(raw)])))[0] % np.uint64(T.WORDS))
    marked = [1, *raw.tolist(), 1]
    grams = []
    for k in T.GRAMS:
        for i in range(len(marked) - k + 1):
            value = k
            for byte in marked[i : i + k]:
                value = (value * 0x100000001B3 + byte) % 2**64
            grams.append(w["gram"][int(mix(np.array([value], np.uint64))[0] % np.uint64(T.BUCKETS))])
    return np.concatenate([w["word"][bucket], np.mean(grams, axis=0)]).astype(float)


def squash(x):
    return 1 / (1 + np.exp(-x))


def plain_states(w, d, words):
    h, out, n = np.zeros(T.HIDDEN), {}, T.HIDDEN
    for t in range(len(words)) if d == "f" else reversed(range(len(words))):
        x = plain_input(w, words[t]) @ w[f"in_{d}"] + w[f"bias_{d}"]
        u = h @ w[f"own_{d}"]
        z, r = squash(x[:n] + u[:n]), squash(x[n : 2 * n] + u[n : 2 * n])
        new = np.tanh(x[2 * n :] + r * u[2 * n :])
        h = out[t] = (1 - z) * new + z * h
    return [out[t] for t in range(len(words))]


def plain_logit(w, words):
    both = [np.concatenate(s) for s in zip(plain_states(w, "f", words), plain_states(w, "b", words))]
    score = [np.tanh(s @ w["att"]) @ w["ask"] for s in both]
    alpha = np.exp(np.array(score) - max(score))
    return float(sum(a * s for a, s in zip(alpha / alpha.sum(), both)) @ w["out"] + w["base"][0])


def windows(words):
    """All windows of WIDTH words, every STRIDE, up to the first that reaches the end."""
    out, a = [], 0
    while words:
        out.append(words[a : a + T.WIDTH])
        if a + T.WIDTH >= len(words):
            break
        a += T.STRIDE
    return out


@pytest.fixture(scope="module")
def weights():
    rng = np.random.default_rng(3)
    w = T.initial()
    return {k: (v + rng.normal(0, 0.4, v.shape)).astype(np.float32) for k, v in w.items()}


def test_whole_texts(weights):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("abcdeéß日")) for _ in range(rng.integers(1, 9))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    texts = [None, "", " \n!?", "one", "TWO Words", prose(31), prose(32), prose(33), prose(48), prose(49), prose(200), "x" * 3000, prose(40) + "\u0085 " + prose(3)]
    best, count = T.document_logits(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]), "text", weights)
    for t, b, c in zip(texts, best.tolist(), count.tolist()):
        cuts = windows(ALNUM.findall(lowered(t)))
        assert c == len(cuts)
        assert math.isclose(b, max((plain_logit(weights, x) for x in cuts), default=float(weights["base"][0])), rel_tol=2e-3, abs_tol=2e-3), t


def test_every_word_lies_in_a_window():
    for n in range(1, 200):
        cuts = windows(list(range(n)))
        assert set().union(*cuts) == set(range(n)) and all(len(x) <= T.WIDTH for x in cuts)
