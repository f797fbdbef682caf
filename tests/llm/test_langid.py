"""Language identification: code lengths against a plain recursion, held-out texts, awkward rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from weightloom.llm import langid

SYLLABLES = {"aa": ["ka", "lo", "mi", "ñe"], "bb": ["tri", "bö", "nal", "st"], "cc": ["ka", "nal", "que", "ss"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def plain_bits(texts, text, order):
    """Code length of ``text`` behind statistics of ``texts``, byte by byte."""
    seen = defaultdict(Counter)
    for t in texts:
        padded = bytes(order) + t.encode()
        for i in range(order, len(padded)):
            for k in range(order + 1):
                seen[padded[i - k : i]][padded[i]] += 1

    def share(context, byte):
        if context not in seen:
            return share(context[1:], byte) if context else 1 / 256
        c = seen[context]
        n, t = sum(c.values()), len(c)
        if c[byte]:
            return c[byte] / (n + t)
        return t / (n + t) * (share(context[1:], byte) if context else 1 / 256)

    padded = bytes(order) + text.encode()
    return -sum(math.log2(share(padded[i - order : i], padded[i])) for i in range(order, len(padded)))


@pytest.mark.parametrize("order", [0, 2, 4])
def test_code_lengths_follow_the_recursion(order):
    rng = random.Random(order)
    taught = {lang: [prose(rng, lang, 30) for _ in range(4)] for lang in SYLLABLES}
    which, found, times = [], [], []
    for k, lang in enumerate(taught):
        batch = pa.RecordBatch.from_arrays([pa.array(taught[lang])], ["text"])
        g, n = np.unique(langid.grams(*langid.flat(batch, "text"), order), return_counts=True)
        which.append(np.full(len(g), k))
        found.append(g)
        times.append(n)
    model = langid.build(list(taught), np.concatenate(which), np.concatenate(found), np.concatenate(times), order)
    asked = ["", "x", "日本", prose(rng, "aa", 20), prose(rng, "cc", 50) + " zzz\x00", "kalo kalo " * 40]
    got = langid.code_lengths(model, pa.RecordBatch.from_arrays([pa.array(asked)], ["text"]), "text", order, chunk=37)
    want = [[plain_bits(taught[lang], t, order) for lang in taught] for t in asked]
    assert np.allclose(got, want, rtol=1e-5, atol=1e-3)


def test_nothing_learned_costs_eight_bits():
    model = langid.build(["a"], *[np.zeros(0, x) for x in (np.int64, np.uint64, np.int64)])
    assert langid.code_lengths(model, pa.RecordBatch.from_arrays([pa.array(["abc", "", None])], ["text"]), "text").tolist() == [[24.0], [0.0], [0.0]]


def test_held_out_texts(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, lang, rng.randint(4, 60)), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), [8, 1, 1], k=400))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.languages(frame).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    held = [(got[i].lang_pred, lang) for i, _, lang in rows if got[i].held_out]
    assert len(held) > 80 and sum(a == b for a, b in held) >= 0.97 * len(held)
    # what held-out rows say about their language is never used
    other = frame.selectExpr("doc_id", "text", "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 'zz' ELSE lang END AS lang")
    assert {r.doc_id: (r.lang_pred, r.score) for r in langid.languages(other).collect()} == {i: (r.lang_pred, r.score) for i, r in got.items()}


def test_awkward_texts(spark, docs, empty):
    found = langid.languages(docs)
    assert found.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and found.count() == docs.count()
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    none = {i for i, t in texts if t is None or not any(c.isalpha() for c in t)}
    got = found.collect()
    assert all((r.lang_pred == "und") == (r.bits is None) for r in got)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == none and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert {r.lang_pred for r in got} <= {"de", "en", "und"} and all(0 <= r.score <= 1 for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert langid.languages(empty).count() == 0
    unlabelled = docs.selectExpr("doc_id", "text", "cast(NULL AS string) AS lang")
    assert {r.lang_pred for r in langid.languages(unlabelled).collect()} == {"und"}


def test_a_small_model_keeps_the_frequent_sequences(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, lang, 30), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=300))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(frame, costs=600)
    assert 0 < len(model.keys[-1]) * len(model.languages) <= 600
    assert {r[0] for r in langid.sample(frame, 20).select("lang").distinct().collect()} == set(SYLLABLES)
