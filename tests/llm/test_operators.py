"""Each operator against a plain version of its contract, on texts with awkward cases."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from weightloom.llm import decontaminate, hmm, packing, quality, queries, simhash, substrings, tokencount, toxicity, urlfilter, warc
from weightloom.session import shared_dir

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def same(found, want):
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)


def test_token_counts(spark, docs, empty):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(900, "a<|endoftext|>b  <|endoftext|><|endoftext|>"), (901, "a" * 5000), (902, "don't\u0085 \x1c x\u200b")], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(extra)
    want = [(r.doc_id, len((r.text or "").encode()), n := len(whole.encode(r.text or "", add_special_tokens=False).ids), n > 1024) for r in both.collect()]
    same(tokencount.token_counts(both, path).collect(), want)
    assert tokencount.token_counts(empty, path).count() == 0


def plain_counts(text):
    words = SPACED.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_and_verdict(docs, empty):
    found = quality.quality_rules(docs).collect()
    want = []
    for r in docs.collect():
        n = plain_counts(r.text)
        want.append((r.doc_id, *n, n[0] < 10 or 100 * n[4] > 20 * n[0]))
    same([r[:7] for r in found], want)
    assert not any(r.kept and r.base_failed for r in found) and any(r.kept for r in found)
    assert all(r.n_dup_lines < r.n_lines or r.n_lines == 0 for r in found)
    assert quality.quality_rules(empty).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in found)


def plain_fence(values, name):
    low, high = np.quantile(values, [0.25, 0.75], method="inverted_cdf")
    spread = max(high - low, quality.FEATURES[name][2])
    return low - 3 * spread, high + 3 * spread


def test_quality_fences_follow_exact_quartiles(spark):
    """Groups of 1 to 300 documents: their own quartiles, leaning on the language's and on those of all."""
    rows = []
    for lang, source, n, least in (("en", "a", 300, 3), ("en", "b", 99, 5), ("en", "c", 101, 5), ("de", "a", 1, 9), (None, None, 20, 4)):
        for i in range(n):
            words = [chr(97 + (i * j) % 26) * (least + i % 3) for j in range(1, 40)]
            lines = [" ".join(words[k : k + 5]) for k in range(0, 40, 5)] + ["again and again"] * (i % 4)
            rows.append((len(rows), "\n".join(lines), lang, source))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    counts = quality.with_counts(frame).drop("text").cache()
    ratios = {
        "word_length": lambda r: r.word_chars / r.n_words, "dup_line_share": lambda r: r.n_dup_lines / r.n_lines,
        "repeat_share": lambda r: r.n_repeat_words / r.n_words,
    }
    seen, lean = counts.collect(), quality.LEAN
    got = quality.fences(counts).collect()
    assert len(got) == 5
    for f in got:
        own = [r for r in seen if (r.lang, r.source) == (f.lang, f.source)]
        wide = [r for r in seen if r.lang == f.lang]
        for name, of in ratios.items():
            three = [plain_fence([of(r) for r in x], name) for x in (own, wide, seen)]
            for end, k in (("low", 0), ("high", 1)):
                wider = (len(wide) * three[1][k] + lean * three[2][k]) / (len(wide) + lean)
                want = (len(own) * three[0][k] + lean * wider) / (len(own) + lean)
                assert math.isclose(f[f"{name}_{end}"], want, abs_tol=0.02), (f.lang, f.source, name, end)


def plain_fingerprint(text):
    words = SPACED.findall(lower(text))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    votes = Counter(b for s in parts for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(parts))


def test_simhash(spark, docs, empty):
    rows = docs.collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)].append(r.doc_id)
    want = [(r.doc_id, f"{p:016x}", min(least[find(i)], default=None)) for i, (r, p) in enumerate(zip(rows, prints))]
    same([(r.doc_id, f"{r.fp % (1 << 64):016x}", r.component_id) for r in simhash.near_duplicates(docs).collect()], want)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({find(i) for i in range(len(rows))})
    assert simhash.near_duplicates(empty).count() == simhash.keep_one(empty).count() == 0


def test_links_keep_all_components(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    chain = [int(b) ^ (1 << a) ^ (1 << c) for b in base for a, c in rng.integers(0, 63, (4, 2)).tolist()]
    prints = sorted({*map(int, base), *chain, *(x ^ 3 for x in chain)})
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {(r.a, r.b) for r in simhash.links(frame).collect()}
    assert all(a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in got)
    root = {r.node: r.root for r in simhash.components(simhash.links(frame)).collect()}
    plain = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 2 and plain[b] < plain[a]:
                    plain[a], changed = plain[b], True
    assert {p: root.get(p, p) for p in prints} == plain


def plain_repeats(rows, width=20):
    seen, out = {}, []
    words = [SPACED.findall(r.text or "") for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i].doc_id is not None, rows[i].doc_id or 0))
    least = {}
    for i in order:
        for a in range(len(words[i]) - width + 1):
            least.setdefault(tuple(words[i][a : a + width]), (rows[i].doc_id is not None, rows[i].doc_id or 0))
    for i, r in enumerate(rows):
        seen, gone = set(), set()
        for a in range(len(words[i]) - width + 1):
            w = tuple(words[i][a : a + width])
            if w in seen or least[w] < (r.doc_id is not None, r.doc_id or 0):
                gone.update(range(a, a + width))
            seen.add(w)
        kept = " ".join(w for j, w in enumerate(words[i]) if j not in gone)
        out.append((r.doc_id, len(words[i]), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substrings(docs, empty):
    rows = docs.collect()
    want = plain_repeats(rows)
    assert sum(w[2] > 0 for w in want) > 10
    same(substrings.substring_counts(docs).collect(), want)
    cleaned = substrings.remove_repeats(docs)
    assert cleaned.columns == docs.columns
    same([(r.doc_id, len(SPACED.findall(r.text or ""))) for r in cleaned.collect()], [(w[0], w[1] - w[2]) for w in want])
    assert substrings.substring_counts(empty).count() == substrings.remove_repeats(empty).count() == 0


def test_substrings_with_hot_anchors(docs, monkeypatch):
    """Every anchor hot, many hot, none: the same rows."""
    whole = [tuple(r) for r in substrings.substring_counts(docs).collect()]
    keyed = substrings._keyed(docs.select("doc_id", "text")).select("__key", "__row", F.col("__text").alias("text"))
    everything = len(substrings.hot_anchors(keyed, 20, 4, 0.0))
    assert 0 < len(substrings.hot_anchors(keyed, 20, 4, 2e-3)) < everything
    assert substrings.hot_anchors(keyed.limit(0), 20, 4, 0.0) == []
    for share in (0.0, 2e-3, 1.0):
        monkeypatch.setattr(substrings, "HOT_SHARE", share)
        same([tuple(r) for r in substrings.substring_counts(docs).collect()], whole)


@pytest.fixture(scope="module")
def bench(spark, docs):
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None and r.doc_id != 3}
    cut = lambda i, a, b: " ".join(ALNUM.findall(text[i])[a:b])
    items = [(1, cut(20, 3, 25)), (2, cut(33, 0, 12).upper()), (3, "word"), (4, None), (5, "..."), (6, cut(40, 2, 8)), (10, cut(20, 10, 24)), (2, cut(21, 1, 30)), (None, cut(24, 0, 11)), (7, "not in any text of these at all I believe so")]
    return spark.createDataFrame(items, "item_id long, text string")


def test_decontamination(spark, docs, empty, bench):
    items = defaultdict(set)
    for r in bench.collect():
        w = ALNUM.findall(lower(r.text))
        if w:
            items["" if r.item_id is None else str(r.item_id)].update([tuple(w)] if len(w) < 10 else [tuple(w[i : i + 10]) for i in range(len(w) - 9)])
    want, left = [], []
    for r in docs.collect():
        w = ALNUM.findall(lower(r.text))
        hit, names = set(), set()
        for name, windows in items.items():
            for x in windows:
                for a in range(len(w) - len(x) + 1):
                    if tuple(w[a : a + len(x)]) == x:
                        hit.update(range(a, a + len(x)))
                        names.add(name)
        want.append((r.doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
        left.append((r.doc_id, " ".join(x for i, x in enumerate(w) if i not in hit)))
    assert sum(w[5] for w in want) > 5
    same(decontaminate.contamination(docs, bench).collect(), want)
    cleaned = decontaminate.decontaminate(docs, bench)
    assert cleaned.columns == docs.columns
    same([(r.doc_id, " ".join(ALNUM.findall(lower(r.text)))) for r in cleaned.collect()], left)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0)).collect())


def test_benchmark_in_several_blocks(docs, bench, monkeypatch):
    whole = decontaminate.contamination(docs, bench).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    same(decontaminate.contamination(docs, bench).collect(), list(map(tuple, whole)))


def test_fm_index():
    rng = np.random.default_rng(1)
    for size, symbols in ((1, 1), (50, 2), (400, 5), (700, 90)):
        text = rng.integers(0, symbols + 1, size)
        text[-1] = 0
        table = np.concatenate([rng.integers(1, symbols + 1, (40, 3)), [[0, 0, 1], [0, 1, 1]]])
        index = decontaminate.FMIndex(np.where(text == 0, 0, text * 7)) if (text > 0).any() else None
        if index is None:
            continue
        row, low, high = index.search(table * 7)
        found = {(int(r), int(p)) for r, a, b in zip(row, low, high) for p in index.locate(np.arange(a, b))}
        want = set()
        for i, t in enumerate(table):
            t = t[t > 0]
            want |= {(i, p) for p in range(size - len(t) + 1) if (text[p : p + len(t)] == t).all()}
        assert found == want


def test_packing(docs, empty):
    found = packing.pack_documents(docs).collect()
    total = Counter()
    for r in docs.collect():
        total[r.doc_id] += len((r.text or "").encode().split()) + 1
    got, bins = Counter(), defaultdict(list)
    for r in found:
        got[r.doc_id] += r.length
        bins[r.bin, r.capacity].append((r.offset, r.length))
    assert got == total and len({b for b, _ in bins}) == len(bins)
    for (_, capacity), inside in bins.items():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= capacity and capacity in packing.CAPACITIES and not any(at <= c < capacity for c in packing.CAPACITIES)
    assert packing.pack_documents(empty).count() == 0


def plain_pack(lengths, capacities):
    where, bins, rest = [0] * len(lengths), [], sum(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        rest -= n
        fits = [b for b in bins if b["room"] >= n]
        if fits:
            b = min(fits, key=lambda b: (b["room"], -b["since"]))
        else:
            c = min((c for c in capacities if c >= n), key=lambda c: packing.cost(c) / min(c, n + rest))
            b = {"id": len(bins), "room": c, "used": 0}
            bins.append(b)
        b["room"] -= n
        b["used"] += n
        b["since"] = sum(x.get("since", 0) >= 0 for x in bins) + max((x.get("since", 0) for x in bins), default=0)
        where[i] = b["id"]
    return where, [min(c for c in capacities if c >= b["used"]) for b in bins]


def test_best_fit_is_best_fit():
    rng = np.random.default_rng(4)
    for capacities in ((16,), (8, 16, 64), packing.CAPACITIES):
        lengths = rng.integers(1, max(capacities) + 1, 300).tolist()
        where, _, size = packing.pack(lengths, capacities)
        assert (where, size) == plain_pack(lengths, capacities)


def test_long_documents_are_split(spark):
    frame = spark.createDataFrame([(1, 20_000), (2, 8192), (None, 5), (3, 0), (4, None)], "doc_id long, length long")
    got = sorted((r.doc_id or 0, r.piece, r.start, r.length) for r in packing.pack_lengths(frame).collect())
    assert got == [(0, 0, 0, 5), (1, 0, 0, 8192), (1, 1, 8192, 8192), (1, 2, 16384, 3616), (2, 0, 0, 8192)]


def pages(spark):
    big = "<html>é\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" + "x" * 1200
    rows = [(1, "http://a.net/x", big), (2, "http://b.org/fr/y?q#f", big), (3, "https://User@C.Example.COM:80/de/z", "short"), (4, None, "short"), (5, "no scheme", None), (6, "http://x.example.net/en/", ""), (7, "http://x.net", big), (7, "http://x.net", big), (None, "http://e.com/a\r\nX: y", big), (8, "http://EXAMPLE.NET/en/q", "y" * 999), (9, "http://example.net/en", "y" * 999), (10, "://", "z" * 1000), (11, "http://n.com", "z" * 1000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_id", __import__("pyspark").sql.functions.lit("clash"))


def test_warc_round_trip(spark):
    frame = pages(spark)
    rows = frame.collect()
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[(r.html or "").encode()].append((r.page_id if r.page_id is not None else -1, i))
    want = []
    for i, r in enumerate(rows):
        payload = (r.html or "").encode()
        top = max(groups[payload])
        revisit = len(payload) >= 1000 and top[1] != i
        want.append((r.page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", top[0] if revisit else None))
    path = shared_dir(spark, "warc-test")
    same([r[:5] for r in warc.archived_pages(frame, path).collect()], want)
    kept = warc.captures(warc.read_records(spark, path)).collect()
    assert len(kept) == len(rows) and all(r.request and r.metadata for r in kept)
    assert Counter(bytes(r.response.payload) for r in kept if r.response.type == "response") == Counter((r.html or "").encode() for r, w in zip(rows, want) if w[3] == "response")
    assert warc.archived_pages(frame.limit(0), shared_dir(spark, "warc-none")).count() == 0


def plain_rule(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best[0] + best[1] if best else None, best[2] if best else None


def test_url_rules(spark):
    frame = pages(spark)
    got = urlfilter.url_verdicts(frame, queries.RULES).collect()
    same([r[:4] for r in got], [(r.page_id, *plain_rule(r.url)[:3]) for r in frame.collect()])
    assert all(r.verdict == (plain_rule(f"x://{r.host}{r.path}")[3] or ("block" if r.p_block >= 0.5 else "allow")) for r in got)
    assert urlfilter.url_verdicts(frame.limit(0), queries.RULES).count() == 0


def test_url_model_learns_from_labels(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    make = lambda bad: (f"{word()}.{'casino' if bad else 'news'}{word()}.com", f"/{word()}", "block" if bad else "allow")
    rows = [make(i % 2) for i in range(600)]
    labelled = spark.createDataFrame(rows[:400], "host string, path string, verdict string")
    seen = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p, _) in enumerate(rows[400:])], "page_id long, url string")
    got = urlfilter.url_verdicts(seen, [], labelled).collect()
    assert sum(r.verdict == rows[400 + r.page_id][2] for r in got) > 0.95 * len(got)


def test_language_model(docs, empty):
    found = hmm.score_texts(docs).collect()
    rows = docs.collect()
    out = lambda i: i is not None and __import__("zlib").crc32(str(i).encode()) % 10 == 0
    tokens = [[*SPACED.findall(lower(r.text)), " "] for r in rows]
    c = Counter(t for r, w in zip(rows, tokens) if not out(r.doc_id) for t in w)
    n, v = sum(c.values()), len(c)
    want = [(r.doc_id, out(r.doc_id), len(w), sum(c[t] > 0 for t in w), n, round(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w), 5)) for r, w in zip(rows, tokens)]
    same([(*r[:5], round(r.base_score, 5)) for r in found], want)
    assert hmm.score_texts(empty).count() == 0


def test_rare_tokens_are_joined(docs, monkeypatch):
    whole = hmm.score_texts(docs).collect()
    monkeypatch.setattr(hmm, "FREQUENT", 50)
    got = hmm.score_texts(docs).collect()
    rounded = lambda rows: [(*r[:5], round(r.base_score, 6), round(r.score, 6)) for r in rows]
    same(rounded(got), rounded(whole))


def tiny_model(states=3):
    rng = np.random.default_rng(8)
    emit = rng.random((hmm.CLASSES, states)) + 0.01
    move = rng.random((states, states)) + 0.1
    return hmm.Model(np.array([0.5, 0.3, 0.2]), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def test_forward_recursion_sums_over_all_paths():
    from itertools import product

    model, rng = tiny_model(), np.random.default_rng(9)
    sizes = [5, 1, 4, 6]
    classes, rows = rng.integers(0, hmm.CLASSES, sum(sizes)), np.concatenate([[0], np.cumsum(sizes)])
    got = hmm.log_likelihoods(classes, rows, model)
    for i, n in enumerate(sizes):
        seq, total = classes[rows[i] : rows[i + 1]], 0.0
        for path in product(range(3), repeat=n):
            p = model.start[path[0]] * model.emit[seq[0], path[0]]
            for t in range(1, n):
                p *= model.move[path[t - 1], path[t]] * model.emit[seq[t], path[t]]
            total += p
        assert math.isclose(got[i], math.log10(total), rel_tol=1e-9)


def test_expectations_sum_over_all_paths():
    from itertools import product

    model, rng = tiny_model(), np.random.default_rng(10)
    sizes = [4, 1, 5]
    classes, rows = rng.integers(0, 6, sum(sizes)), np.concatenate([[0], np.cumsum(sizes)])
    start, move, emit = hmm.expectations(classes, rows, model)
    w_start, w_move, w_emit = np.zeros(3), np.zeros((3, 3)), np.zeros((hmm.CLASSES, 3))
    for i, n in enumerate(sizes):
        seq, weights = classes[rows[i] : rows[i + 1]], {}
        for path in product(range(3), repeat=n):
            p = model.start[path[0]] * model.emit[seq[0], path[0]]
            for t in range(1, n):
                p *= model.move[path[t - 1], path[t]] * model.emit[seq[t], path[t]]
            weights[path] = p
        total = sum(weights.values())
        for path, p in weights.items():
            w_start[path[0]] += p / total
            for t in range(n):
                w_emit[seq[t], path[t]] += p / total
                if t:
                    w_move[path[t - 1], path[t]] += p / total
    assert np.allclose(start, w_start) and np.allclose(move, w_move) and np.allclose(emit, w_emit)


def test_language_model_beats_the_base_on_held_out_texts(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = hmm.score_texts(frame).filter("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert got.s > got.b


def test_toxicity_network_gradients():
    rng = np.random.default_rng(6)
    w = {k: v.astype(np.float64) for k, v in toxicity.initial().items()}
    text = b"alpha beta gamma delta epsilon zeta"
    starts = np.array([0, 6, 11, 17, 23, 31])
    ends = np.array([5, 10, 16, 22, 30, 35])
    features = toxicity.word_features(np.frombuffer(text, np.uint8), starts, ends)
    table = rng.integers(0, 6, (5, toxicity.WIDTH))
    table[2, 7:] = -1
    table[4, 1:] = -1
    target = np.array([1.0, 0, 1, 0, 1])

    def loss(w):
        p = toxicity.sigmoid(toxicity.logits(w, toxicity.inputs(w, *features), table).astype(float))
        return -np.mean(target * np.log(p) + (1 - target) * np.log(1 - p))

    g, _ = toxicity.gradients({k: v.astype(np.float32) for k, v in w.items()}, features, table, target)
    for k in w:
        direction = rng.normal(size=w[k].shape)
        if k in ("word", "gram"):
            direction *= np.abs(g[k]) > 0
        step = 3e-3
        up, down = ({**w, k: w[k] + s * direction} for s in (step, -step))
        up, down = ({n: v.astype(np.float32) for n, v in x.items()} for x in (up, down))
        numeric = (loss(up) - loss(down)) / (2 * step)
        assert math.isclose(numeric, float((g[k] * direction).sum()), rel_tol=0.05, abs_tol=2e-4), k


def test_toxicity_on_held_out_documents(spark):
    frame, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(frame, labels).filter("held_out").join(labels, "doc_id").select("score", "toxic", "predicted").collect()
    good, bad = [r.score for r in got if r.toxic == 0], [r.score for r in got if r.toxic == 1]
    auc = np.mean([(np.array(good) < s).mean() + 0.5 * (np.array(good) == s).mean() for s in bad])
    right = sum(r.predicted == r.toxic for r in got) / len(got)
    print("AUC", auc, "accuracy", right, "recall", np.mean([r.predicted for r in got if r.toxic]), "false alarms", np.mean([r.predicted for r in got if not r.toxic]))
    assert auc > 0.93


def test_toxicity_of_awkward_texts(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert toxicity.toxicity(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.toxicity(empty, labels).count() == 0


def test_pipeline_stages_compose(spark, docs, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, current, str(tmp_path))
        assert after.columns == docs.columns, name
        path = str(tmp_path / name.replace(" ", "-"))
        after.write.parquet(path)
        current = spark.read.parquet(path)
    want = sum(len((r.text or "").encode().split()) + 1 for r in current.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).agg({"length": "sum"}).first()[0] == want
