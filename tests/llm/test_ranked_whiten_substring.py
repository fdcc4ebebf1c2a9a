"""Ranked search, whitening and substring dedup against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from candleframe.llm import queries, ranked, substring, whiten

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def terms(text):
    return TERM.findall((text or "").encode().translate(LOWER))


def brute_ranking(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_all, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        weight = {t: math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) for t in own if df[t]}
        found = []
        for i, c, n in held:
            m = 100 - 50 + (50 * n * n_all) // total
            score = sum(w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in weight.items() if c[t])
            if score > 0:
                found.append((-score, i is None, i, score))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(item, r + 1, f[2], f[3]) for r, f in enumerate(found[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "window", "short", "step"), [(1 << 24, 128, 1024, 4096), (3000, 2, 6, 8), (12000, 4, 0, 16)])
def test_ranked_search(spark, odd_texts, monkeypatch, block, window, short, step):
    for name, value in (("BLOCK", block), ("WINDOW", window), ("SHORT", short), ("STEP", step)):
        monkeypatch.setattr(ranked, name, value)
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    texts = [" ".join(rng.choices(vocab, weights, k=rng.randrange(1, 60))) for _ in range(300)]
    docs = [(k * 7 % 1009, t) for k, t in enumerate(texts + odd_texts + texts[:20] + [" ".join(vocab) * 300, None, "", "..."])]
    docs += [(None, texts[0]), (5, texts[1]), (5, texts[1])]
    items = [(k, " ".join(rng.choices(vocab, weights, k=rng.randrange(1, 15)))) for k in range(40)]
    items += [(1, "w59 W58"), (None, "w1"), (90, None), (91, "..."), (92, "nowhere"), (93, odd_texts[7]), (94, " ".join(vocab))]
    monkeypatch.setattr(ranked, "SHARD", 1 << 20 if block == 3000 else 64)
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "50")
    try:
        d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, term int").repartition(3)
        q = spark.createDataFrame(items, "item_id long, text string")
        got = ranked.search(ranked.build(d, "doc_id", "text"), q, "item_id", "text", 10).collect()
    finally:
        spark.conf.set(conf, before)
    assert sorted(map(tuple, got), key=repr) == brute_ranking(docs, items, 10)


def test_ranked_search_empty(spark):
    d = spark.createDataFrame([], "doc_id string, text string")
    q = spark.createDataFrame([("a", "x y")], "item_id string, text string")
    assert ranked.search(ranked.build(d, "doc_id", "text"), q, "item_id", "text", 5).collect() == []
    d = spark.createDataFrame([("b", "x"), ("a", "X"), (None, "x y")], "doc_id string, text string")
    assert ranked.search(ranked.build(d, "doc_id", "text"), q.limit(0), "item_id", "text", 5).collect() == []
    found = ranked.search(ranked.build(d, "doc_id", "text"), q, "item_id", "text", 5).orderBy("rank").collect()
    assert [r.id for r in found] == [None, "a", "b"]


def test_window_bounds_skip(monkeypatch):
    """Windows that cannot reach the best scores are not opened."""
    monkeypatch.setattr(ranked, "WINDOW", 4)
    monkeypatch.setattr(ranked, "SHORT", 0)
    import pyarrow as pa

    n = 400
    tf = np.where(np.arange(n) < 8, 50, 1).astype(np.int32)
    pair = (np.arange(n, dtype=np.int32).tobytes(), tf.tobytes())
    asked = ranked.Queries(pa.array([1]), np.array([3, 9]), np.array([700, 900]), np.array([0, 1]), np.array([0, 2]))
    block = ranked.Block(pa.array(range(n)), np.full(n, 60, np.int32), np.array([9, 3]), [pair, pair], asked, n, 60 * n)
    opened = []
    was = ranked.spans
    monkeypatch.setattr(ranked, "STEP", 16)
    monkeypatch.setattr(ranked, "spans", lambda a, b: opened.append(int((b - a).sum())) or was(a, b))
    docs, score = block.search(np.array([0, 1]), 5, 1)
    assert docs.tolist() == [0, 1, 2, 3, 4] and len(set(score.tolist())) == 1
    assert sum(opened) < n  # of 800 postings


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_inertia(d):
    rng = np.random.default_rng(d)
    for _ in range(20):
        a = rng.standard_normal((d, d))
        a = a + a.T - np.diag(np.diag(a)) * rng.integers(0, 3)
        assert whiten.positive_pivots(a) == (np.linalg.eigvalsh(a) > 0).sum()


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [5, 5, 5, 3, 1, 1, 0, 0], [2, 2 - 1e-9, 1, 1 - 1e-12, 0.5], [1e-8, 1e-9], [7] * 6])
def test_leading(values):
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    v = (q * np.array(values, float)) @ q.T
    v = (v + v.T) / 2
    for wanted in (1, 3, 16):
        e, x = whiten.leading(v, wanted)
        assert np.allclose(e, sorted(values, reverse=True)[:wanted], rtol=1e-12, atol=1e-13 * max(values))
        assert np.abs(x.T @ x - np.eye(len(e))).max() < 1e-12
        assert np.abs(v @ x - x * e).max() < 1e-12 * max(values)


def brute_whitening(rows, wanted):
    x = {k: np.floor(64 * np.array(v, dtype=float)) + 1_000_000 for k, v in rows}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    mean = fit.mean(axis=0)
    cov = (fit - mean).T @ (fit - mean) / len(fit)
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:wanted], q[:, ::-1][:, :wanted]
    sums = [sum(int(c) for c in fit[:, j]) for j in range(fit.shape[1])]
    dev = {k: sum((len(fit) * int(c) - s) ** 2 for c, s in zip(v, sums, strict=True)) for k, v in x.items()}
    return len(fit), dev, {k: (v - mean) @ q / np.sqrt(e) for k, v in x.items()}, e / np.trace(cov)


def test_whitening(spark):
    rng = np.random.default_rng(4)
    good = [(k, (rng.standard_normal(20) * np.arange(1, 21) + 300).astype(float).tolist()) for k in range(300)]
    good += [(1000 + k, good[k][1]) for k in range(100)]
    odd = [(5000, None), (5001, [None] + [1.0] * 19), (5002, [float("nan")] * 20), (5003, [float("inf")] * 20), (5004, [1.0] * 19), (5005, []), (5006, [1e300] * 20)]
    df = spark.createDataFrame([(k, v, "x") for k, v in good + odd], "vec_id long, v array<double>, component string").repartition(5)
    got = whiten.whiten(df, "vec_id", "v", 6).collect()
    n, dev, white, share = brute_whitening(good, 6)
    assert len(got) == 400 * 6 and {r.n for r in got} == {n} == {300}
    mine = {(r.vec_id, r.component): r for r in got}
    sign = [np.sign(mine[0, c + 1].whitened * white[0][c]) for c in range(6)]
    for k, _ in good:
        for c in range(6):
            r = mine[k, c + 1]
            assert r.deviation == dev[k]
            assert abs(r.whitened - sign[c] * white[k][c]) < 1e-8
            assert abs(r.explained - share[c]) < 1e-10 and r.identity_error < 1e-9


def test_whitening_degenerate(spark):
    df = spark.createDataFrame([], "vec_id long, v array<float>")
    assert whiten.whiten(df, "vec_id", "v").collect() == []
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, v array<float>")
    assert whiten.whiten(same, "vec_id", "v").collect() == []
    line = spark.createDataFrame([(1, [1.0, 2.0, 7.0]), (2, [3.0, 4.0, 7.0]), (None, [3.0, 4.0, 7.0])], "vec_id long, v array<float>")
    got = whiten.whiten(line, "vec_id", "v").collect()
    assert {(r.vec_id, r.component) for r in got} == {(1, 1), (2, 1), (None, 1)}
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and abs(r.explained - 1) < 1e-12 for r in got)


def test_deviation_beyond_64_bits():
    model = whiten.Whitening(10**6, [10**6 * 10**6 + 3], np.ones(1), np.ones((1, 1)), np.ones(1))
    x = np.array([[10**6 + 2], [10**6 + 10**6]])
    assert model.deviations(x) == [(10**6 * (10**6 + 2) - (10**12 + 3)) ** 2, None]


def brute_repeats(texts, n):
    rows = [WORD.findall((t or "").encode()) for t in texts]
    seen = Counter(tuple(w[k : k + n]) for w in rows for k in range(len(w) - n + 1))
    out = []
    for w in rows:
        gone = {j for k in range(len(w) - n + 1) if seen[tuple(w[k : k + n])] > 1 for j in range(k, k + n)}
        out.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


@pytest.mark.parametrize(("n", "group", "least", "longest"), [(35, 1 << 15, 32, 64), (6, 1 << 15, 3, 64), (6, 4, 1 << 20, 2), (3, 2, 1 << 20, 64), (1, 1 << 15, 1 << 20, 64)])
def test_substring(spark, odd_texts, monkeypatch, n, group, least, longest):
    for name, value in (("GROUP", group), ("LEAST", least), ("LONGEST", longest)):
        monkeypatch.setattr(substring, name, value)
    rng = random.Random(n)
    vocab = [f"v{k}" for k in range(3000)]
    say = lambda k: [rng.choice(vocab) for _ in range(k)]
    shared = [say(k) for k in (34, 35, 36, 60, 120)]
    texts = [" ".join(say(rng.randrange(0, 90)) + rng.choice(shared) + say(rng.randrange(0, 50)) + rng.choice([[], rng.choice(shared)])) for _ in range(90)]
    texts += texts[:7] + ["a " * 200, "b " * 34, "b " * 35, "c " * 36, "A " * 36, None, "", " \n ", None] + odd_texts
    texts += [" ".join(shared[2]) + "\n\n" + "  ".join(shared[3]), " ".join(say(3000)), "word join " * 40]
    rows = [(k, t, "k", k) for k, t in enumerate(texts)]
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "20")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string, key string, n_words int").repartition(4)
        got = substring.remove_repeats(df, "text", n).collect()
        assert got[0].__fields__ == ["doc_id", "text", "key", "n_words", "n_words_", "n_removed"]
    finally:
        spark.conf.set(conf, before)
    mine = {r.doc_id: (r.n_words_, r.n_removed, r.text) for r in got}
    assert [mine[k] for k in range(len(texts))] == brute_repeats(texts, n)


def test_substring_empty(spark):
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), "text").collect() == []


def test_new_queries_are_registered():
    assert {"op11_ranked_search", "op12_embedding_whitening", "op13_substring_dedup"} <= set(queries.QUERIES)
    assert len(queries.QUERIES) == 13
