"""The pipeline's near-duplicate stage against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from weightloom.llm import neardup, simhash


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_kept(rows):
    """Least doc_id of each component over all pairs, null as None."""
    sets = [shingles(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or len(x & y) >= 0.8 * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        k = (r.doc_id is not None, r.doc_id or 0)
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted(v if known else None for known, v in least.values() if known) + [None] * sum(not known for known, _ in least.values())


def kept_ids(found):
    ids = [r.doc_id for r in found.select("doc_id").collect()]
    return sorted(x for x in ids if x is not None) + [None] * ids.count(None)


def test_stage_on_awkward_texts(spark, docs, empty):
    found = corpus_pipeline.near_duplicates(spark, docs, "")
    assert found.columns == docs.columns and kept_ids(found) == plain_kept(docs.collect())
    assert corpus_pipeline.near_duplicates(spark, empty, "").count() == 0


def near_copies():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    out = []
    for _ in range(40):
        text = [word() for _ in range(120)]
        out.append(text)
        for changes in (1, 2, 3, 4, 6):
            copy = list(text)
            for k in rng.sample(range(len(copy)), changes):
                copy[k] = word()
            out.append(copy)
    return [(i, " ".join(t)) for i, t in enumerate(out)]


def test_near_copies_go_by_similarity(spark):
    frame = spark.createDataFrame(near_copies(), "doc_id long, text string")
    assert kept_ids(corpus_pipeline.near_duplicates(spark, frame, "")) == plain_kept(frame.collect())


def test_large_buckets_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(neardup, "DEAL", 20)
    monkeypatch.setattr(neardup, "NEIGHBOURS", 4)
    rng = random.Random(7)
    text = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(150):
        copy = list(text)
        copy[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    rows.append((900, " ".join(text[:100])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept_ids(neardup.keep_one(frame)) == plain_kept(frame.collect()) == [0, 900]


def test_links_beyond_the_neighbours_are_found(spark, monkeypatch):
    monkeypatch.setattr(neardup, "DEAL", 3)
    monkeypatch.setattr(neardup, "NEIGHBOURS", 1)
    monkeypatch.setattr(neardup, "TILE", 7)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(60):  # a chain of texts: each is near those a few steps away, far from the others
        base[2 * i : 2 * i + 2] = [f"x{i}-{rng.randrange(9)}", f"y{i}"]
        rows.append((i, " ".join(base)))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept_ids(neardup.keep_one(frame)) == plain_kept(frame.collect())


def test_all_members_of_a_large_bucket_meet(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 5)
    rows = [(i, 7, 23, i % 4, bytes([i // 2]) * 125) for i in range(23)]
    frame = spark.createDataFrame(rows, "sid long, bucket long, n long, root long, sketch binary")
    assert sorted(map(tuple, neardup.crossing(frame).collect())) == [(i, i + 1) for i in range(0, 22, 2)]


def star(n, words=150, changes=6):
    """Texts of one base: few pairs are links, nearly all are close to it."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(words)]
    out = []
    for i in range(n):
        copy = list(base)
        for k in rng.sample(range(words), changes if i % 3 else 1 + i % 2):
            copy[k] = f"x{i}-{k}"
        out.append(" ".join(copy))
    return out


def similarity(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_a_large_bucket_gives_rows_in_proportion_to_its_members(spark):
    texts = star(200)
    frame = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    prints = neardup.signatures(frame).select(F.col("key").alias("sid"), "sketch")
    marked = neardup.marks(frame.withColumnRenamed("key", "sid"), 5)
    members = prints.join(marked, "sid").selectExpr("*", "7L as bucket", "200L as n", "sid as root")
    found = {tuple(r) for r in neardup.crossing(members, 0.8).collect()}
    links = {(i, j) for j in range(200) for i in range(j) if similarity(texts[i], texts[j]) >= 0.8}
    rest = {(i, j) for i, j in found if i < j} - links
    assert len(found) <= neardup.TURN * 200 + 1 and all(similarity(texts[i], texts[j]) > 0.78 for i, j in rest)
    joined = members.withColumn("now", F.lit(1).cast("long"))  # once all are of one component, nothing is left
    assert neardup.crossing(joined, 0.8).isEmpty() and neardup.crossing(joined, 0.8, 1).isEmpty()
    every = set()
    for turn in range(200):
        more = {tuple(r) for r in neardup.crossing(members, 0.8, turn).collect()}
        every |= {(i, j) for i, j in more if i < j}
        if all(i < j for i, j in more):
            break
    assert links <= every


def test_marks_never_rule_out_a_link(spark, monkeypatch):
    rng = random.Random(9)
    texts = ["one", "one two", *star(12), *star(6, 1200, 30), *(" ".join(f"v{rng.randrange(40)}" for _ in range(n)) for n in (3, 30, 300, 3000))]
    texts += [texts[3] + " " + " ".join(f"t{k}" for k in range(n)) for n in (1, 20, 40, 200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "sid long, text string")
    for bits in (64, 1 << 14):
        monkeypatch.setattr(neardup, "MARK_BITS", bits)
        rows = neardup.marks(frame, 5).orderBy("sid").collect()
        assert [r.size for r in rows] == [len(shingles(t)) for t in texts]
        pairs = np.array([(i, j) for j in range(len(texts)) for i in range(j)])
        most = neardup.at_most(np.array([r.size for r in rows]), [bytes(r.mark) for r in rows], pairs[:, 0], pairs[:, 1])
        exact = np.array([similarity(texts[i], texts[j]) for i, j in pairs])
        assert (most >= exact).all()
        assert bits == 64 or (most - exact)[exact > 0.7].max() < 0.03


def test_turns_go_on_until_no_pair_is_left(spark, monkeypatch):
    for name, value in (("DEAL", 3), ("NEIGHBOURS", 1), ("TILE", 1000), ("TURN", 1), ("MARK_BITS", 64)):
        monkeypatch.setattr(neardup, name, value)
    turns, crossing = [], neardup.crossing
    monkeypatch.setattr(neardup, "crossing", lambda members, least, turn: turns.append(turn) or crossing(members, least, turn))
    rows = list(enumerate(star(45, 150, 7)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept_ids(neardup.keep_one(frame)) == plain_kept(frame.collect())
    assert turns == list(range(len(turns))) and len(turns) > 1


def test_texts_of_one_id_and_hash_are_not_one(spark, monkeypatch):
    monkeypatch.setattr(simhash.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    rows = [(1, "one", "b"), (1, "one", "a"), (1, "two", "c"), (2, "one", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keep = spark.createDataFrame([(1, 1)], "id long, hash long")
    assert sorted(map(tuple, simhash.one_row(docs, keep).collect())) == [(1, "one", "a"), (1, "two", "c")]


def same_hash(a, b):
    """The texts, padded with spaces and a last word of 64 characters each, for which their XXH64 with seed 42 are equal."""
    p1, p2, whole, rng = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, (1 << 64) - 1, random.Random(2)

    def turned(lane, piece):
        x = (lane + int.from_bytes(piece, "little") * p2) & whole
        return (x << 31 | x >> 33) * p1 & whole

    size = max(len(a), len(b)) // 32 * 32 + 32
    out, lanes = [a.ljust(size).encode(), b.ljust(size).encode()], []
    for text in out:
        lanes.append([(42 + p1 + p2) & whole, 42 + p2, 42, (42 - p1) & whole])
        for k in range(0, size, 8):
            lanes[-1][k // 8 % 4] = turned(lanes[-1][k // 8 % 4], text[k : k + 8])
    ends = []
    for u, v in zip(*lanes):
        v = turned(v, b"a" * 8)
        while True:
            first, last = (bytes(rng.choices(range(97, 123), k=8)) for _ in range(2))
            other = (int.from_bytes(last, "little") + (turned(u, first) - v) * pow(p2, -1, 1 << 64) & whole).to_bytes(8, "little")
            if all(33 <= c <= 126 for c in other):
                break
        ends.append((first, last, other))
    out = [out[0] + b"".join(e[0] for e in ends) + b"".join(e[1] for e in ends), out[1] + b"a" * 32 + b"".join(e[2] for e in ends)]
    assert xxhash.xxh64_intdigest(out[0], 42) == xxhash.xxh64_intdigest(out[1], 42) and out[0] != out[1]
    return [x.decode() for x in out]


def changed(text, k):
    return " ".join(f"changed{k}" if i == k else w for i, w in enumerate(text.split(" ")))


@pytest.mark.parametrize("case", ["one goes", "both stay", "copies", "one component", "no id"])
def test_texts_that_share_an_id_and_a_hash_are_told_apart(spark, case):
    rng = random.Random(1)
    prose = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(120))
    base = prose()
    a, b = same_hash(prose(), prose())
    c, d = same_hash(base, changed(base, 60))
    rows, want = {
        "one goes": ([(5, a), (5, b), (1, changed(a, 60))], [(1, changed(a, 60)), (5, b)]),
        "both stay": ([(5, a), (5, b), (7, changed(a, 60)), (8, changed(b, 40)), (9, changed(b, 60))], [(5, a), (5, b)]),
        "copies": ([(5, a), (5, b), (5, a), (1, a.title()), (5, b)], [(1, a.title()), (5, b)]),
        "one component": ([(5, c), (5, d), (5, c), (6, changed(c, 20))], None),  # either of the two
        "no id": ([(None, a), (None, b), (None, None), (1, changed(b, 60)), (2, "")], [(None, None), (None, a), (None, b)]),
    }[case]
    frame = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    found = corpus_pipeline.near_duplicates(spark, frame, "")
    got = sorted(((r.doc_id, r.text) for r in found.collect()), key=repr)
    assert kept_ids(found) == plain_kept(frame.collect())
    assert got in ([[(5, c)], [(5, d)]] if want is None else [sorted(want, key=repr)])
    if case == "copies":
        assert sorted((r.doc_id, r.text) for r in simhash.keep_one(frame).collect()) == want
