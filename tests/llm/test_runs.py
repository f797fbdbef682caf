"""Periodic runs of words against a plain search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from weightloom.llm import runs

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, least=24, times=3):
    """Maximal stretches of each period, without those that have a smaller one."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q) and (i, length) not in found:
                found[i, length] = q
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_tiled(doc_id, text):
    w = SPACED.findall(text or "")
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def plain_row(doc_id, w):
    found = plain_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = None
    for s, n, q in found:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def key(r):
    return tuple((x is not None, str(x)) for x in r)


@given(st.lists(st.lists(st.integers(0, 2), max_size=9).flatmap(lambda b: st.integers(1, 12).map(lambda k: b * k)), max_size=8), st.integers(2, 9), st.integers(2, 4))
@settings(max_examples=300, deadline=None)
def test_runs_of_small_alphabets(blocks, least, times):
    w = [x + 1 for b in blocks for x in b]
    row, start, length, period = runs.find_runs(np.array(w, np.int64), np.array([0, len(w)]), least, times)
    assert list(zip(start.tolist(), length.tolist(), period.tolist())) == plain_runs(w, least, times) and not row.any()


def test_digest_on_awkward_texts(spark, docs, empty):
    rng = random.Random(2)
    more = [(1000 + i, " ".join(([rng.choice("ab") for _ in range(rng.randint(1, 6))] * rng.randint(1, 20) + [rng.choice("abc") for _ in range(30)]) * rng.randint(1, 3))) for i in range(60)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = runs.run_digest(runs.word_runs(both.withColumn("text", runs.tiled()))).collect()
    want = [plain_row(r.doc_id, plain_tiled(r.doc_id, r.text)) for r in both.collect()]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(r.n_runs > 0 for r in got) > 20
    assert runs.word_runs(empty).count() == 0 and runs.run_digest(runs.word_runs(empty)).count() == 0


def test_other_columns_stay(spark, docs):
    found = runs.word_runs(docs.withColumn("runs", F.lit("mine")).withColumn("__note", F.lit(1)))
    assert set(found.columns) == {*docs.columns, "__note", "runs", "collapsed"}
    a = sorted(map(tuple, docs.collect()), key=key)
    assert sorted(map(tuple, found.select(docs.columns).collect()), key=key) == a


def test_long_periodic_text(spark):
    rng = random.Random(9)
    block = [f"w{rng.randrange(50)}" for _ in range(700)]
    text = ["x"] * 30000 + [f"u{i}" for i in range(50)] + block * 20
    got = runs.word_runs(spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string")).first()
    assert (0, 30000, 1) in [tuple(r) for r in got.runs] and (30050, 14000, 700) in [tuple(r) for r in got.runs]
    assert got.collapsed.split() == ["x"] + text[30000:30050] + block
