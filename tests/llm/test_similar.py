"""Near-duplicates, line de-duplication, decontamination and nearest neighbours against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from candleframe.llm import ann, decontam, linededup, minhash, textkit

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text, pattern=WORD):
    return pattern.findall((text or "").encode().translate(LOWER))


def shingle_set(w, n):
    return {tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, 1))} if w else set()


def brute_components(rows, n, percent):
    """{id: component} and sizes; rows that share an id are one document."""
    sets = [(i, shingle_set(words(t), n)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is None or j is None or not x or not y:
                continue
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                i, j = sorted((root(i), root(j)))
                up[j] = i
    return {i: root(i) for i in up}


def near_texts(rng, groups=12, copies=9):
    vocab = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randrange(20, 120))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [3, 256])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(block)
    texts = near_texts(rng) + ["", None, "  \n", "One two", "one TWO", "a b c d", "a b c d", "é Ü", "x " * 5000]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [*zip(ids, texts, strict=True), (None, "a b c d"), (ids[0], texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1))
    got = minhash.near_duplicates(df, "doc_id", "text", words=4, percent=80).collect()
    want = brute_components(rows, 4, 80)
    assert len(got) == len(rows)
    for r in got:
        if r.id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.id] and r.kept == (r.id == want[r.id])
    sizes = {i: len(shingle_set(words(t), 4)) for i, t in rows}
    assert all(r.n_shingles == sizes[r.id] for r in got if r.id is not None)


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(df, "doc_id", "text").count() == 0


def brute_lines(rows, percent):
    """[(id, text, n_lines, n_removed)] by comparing every line with all earlier ones."""
    found, texts, done = [], {}, {}
    order = sorted({(i, t) for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in order:
        lines, keep, n = (t or "").split("\n"), [], 0
        for line in lines:
            s = frozenset(words(line))
            hit = False
            if s:
                n += 1
                hit = any(100 * len(s & o) >= percent * len(s | o) for o in found)
                found.append(s)
            if not hit:
                keep.append(line)
        texts[i, t] = ("\n".join(keep) if t is not None else None, n, len(lines) - len(keep))
    return [(i, *texts[i, t]) for i, t in rows]


@pytest.mark.parametrize("frequent", [3, 20_000])
def test_lines(spark, frequent):
    rng = random.Random(frequent)
    pool = near_texts(rng, 10, 6) + ["", "the", "The", "the of", "of the", "a b c d", "a b c d e", "Ü é"]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 7)))) for k in range(40)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (None, "only once here"), (53, "only once here"), (39, rows[39][1]), (54, " ".join(f"v{k}" for k in range(5000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit("kept"))
    got = linededup.dedup_lines(df, "doc_id", "text", 80, frequent=frequent).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    assert sorted([(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got], key=key) == sorted(brute_lines(rows, 80), key=key)
    assert {r["class"] for r in got} == {"kept"}


def test_small_groups_are_verified_together():
    rng = np.random.default_rng(4)
    count = rng.integers(1, 9, 200)
    start = np.cumsum(count) - count
    few = np.flatnonzero(np.repeat(count > 1, count))
    cls = rng.integers(0, 3000, count.sum())
    role = np.concatenate([np.zeros(n) if k % 2 else rng.integers(1, 3, n) for k, n in enumerate(count)]).astype(np.int8)
    sets = [np.sort(rng.choice(14, rng.integers(6, 14), replace=False).astype(np.uint64)) for _ in cls]
    got = linededup.together(start, count, few, cls, role, pa.array([sets[k].tobytes() for k in few], pa.binary()), 70)
    match = lambda a, b: cls[a] != cls[b] and role[a] + role[b] in (0, 3) and 100 * len(np.intersect1d(sets[a], sets[b])) >= 70 * len(np.union1d(sets[a], sets[b]))
    want = [y for s, n in zip(start, count, strict=True) for y in range(s, s + n) if any(match(x, y) for x in range(s, y))]
    assert few[got].tolist() == want and 100 < len(want) < len(few)


def test_word_keys_are_those_of_words():
    """Equal for the same word (A-Z in either case) wherever it stands, different for any two others."""
    rng = random.Random(6)
    pool = sorted({"".join(rng.choice("aAzZ@[`{é0") for _ in range(n)) for n in [*range(1, 20), 63, 64, 65, 66, 200] for _ in range(12)})
    text = " ".join(rng.choice(pool) for _ in range(3000)).encode()
    raw = np.frombuffer(text, dtype=np.uint8)
    a, b = textkit.words(raw, np.array([0, len(raw)]))
    assert [text[x:y] for x, y in zip(a, b, strict=True)] == text.split(b" ")
    named = {}
    for x, y, key in zip(a, b, textkit.word_keys(raw, a, b).tolist(), strict=True):
        named.setdefault(text[x:y].lower(), set()).add(key)
    assert all(len(k) == 1 for k in named.values()) and len(set.union(*named.values())) == len(named) > 150


def test_values_of_lines_are_sorted():
    rng = np.random.default_rng(8)
    line = np.sort(rng.integers(0, 300, 5000))
    value = rng.integers(0, 1 << 18, 5000).astype(np.uint64)  # most differ in their last 16 bits alone
    for shift in (0, 40):
        order = linededup._sorted_in(line, value << np.uint64(shift))
        assert (line[order] == line).all() and (value[order] == value[np.lexsort((value, line))]).all()
    many = np.arange(1 << 17)
    assert (linededup._sorted_in(many, many.astype(np.uint64)[::-1].copy()) == many).all()


def test_listing_leaves_out_what_one_line_has(spark):
    """A word of a single line is shared by none; a pair is given once, however many words it shares."""
    own = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(20)]
    pairs = [" ".join(f"p{k}x{j}" for j in range(30)) for k in range(20)]
    docs = [(k, f"{own[k]}\n{pairs[k]}") for k in range(20)] + [(20 + k, pairs[k] + " more") for k in range(20)]
    work = spark.createDataFrame(docs, "id long, text string").withColumn("doc", F.col("id"))
    lines, counts = linededup.line_table(work)
    assert lines.count() == 60 and counts.sum() == 20 * 30 * 3 + 20
    listed = linededup.listing(work, counts, 80, 20_000)
    shared = {r["class"] for r in lines.join(work.select("id", "text"), "id").filter("line = 1 OR id >= 20").collect()}
    few = {r["class"] for r in listed.select("class").distinct().collect()} - shared  # by chance, in a bucket of other words
    assert len(few) <= 2
    groups = linededup.candidates(listed, 80).collect()
    assert len([r for r in groups if r["class"] in shared]) == 40 and all(r.block == -1 for r in groups)


def test_rows_that_are_one_document(spark):
    """Rows equal in id and text give their lines once: as many lines, and the same ones go."""
    text = "a b c d e f\nq r s t u v\na b c d e f"
    df = spark.createDataFrame([(1, text), (1, text), (1, "q r s t u v"), (2, text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_lines, r.n_removed) for r in linededup.dedup_lines(df, "doc_id", "text").collect())
    assert got[1:] in ([(1, 3, 1), (1, 3, 1), (2, 3, 3)], [(1, 3, 2), (1, 3, 2), (2, 3, 3)])  # by which text of id 1 is the earlier
    assert got[0] == (1, 1, 1 if got[1] == (1, 3, 1) else 0)


def test_lines_of_nothing(spark):
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


WORD2 = re.compile(rb"[A-Za-z0-9\x80-\xff]+")


def brute_leaks(docs, items):
    out = set()
    for i, q, a in items:
        parts = [words(f"{q or ''} {a or ''}", WORD2), words(q, WORD2), words(a, WORD2)]
        if not parts[0]:
            continue
        for d, t in docs:
            w = words(t, WORD2)
            share = [len(s & shingle_set(w, min(5, len(p)))) / len(s) if (s := shingle_set(p, 5)) else 1.0 for p in parts] if w else [0.0]
            if share[0] >= 0.8 and min(share) >= 0.5:
                out.add((d, i))
    return out


@pytest.mark.parametrize("shard", [1 << 24, 400])
def test_leaks(spark, monkeypatch, shard):
    monkeypatch.setattr(decontam, "SHARD_BYTES", shard)
    rng = random.Random(8)
    vocab = [f"t{k}" for k in range(300)]
    some = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, some(rng.randrange(6, 25)), some(rng.randrange(3, 20))) for k in range(20)] + [(20, None, None), (21, "", "?!"), (22, "two words", None)]
    docs = [(k, some(rng.randrange(1, 300))) for k in range(30)] + [(100, None), (101, ""), (102, "say TWO, words now")]
    for k, (_, q, a) in enumerate(items[:15]):
        text = f"{some(50)} {q.upper()}. {a}, {some(rng.randrange(400))}".split(" ")
        if k % 3 == 0:
            text[55] = "changed"
        docs.append((200 + k, " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    its = spark.createDataFrame(items, "item_id long, question string, answer string")
    got = decontam.contaminated(df, "doc_id", "text", its, "item_id", "question", "answer").collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_leaks(docs, items) and len(got) >= 10
    assert decontam.contaminated(df.limit(0), "doc_id", "text", its, "item_id", "question", "answer").count() == 0
    assert decontam.contaminated(df, "doc_id", "text", its.limit(0), "item_id", "question", "answer").count() == 0


def test_item_split_over_a_document(spark):
    item = [(1, " ".join(f"q{k}" for k in range(16)), " ".join(f"a{k}" for k in range(14)))]
    filler = " ".join(f"f{k}" for k in range(300))  # more than a window of three times the item
    docs = [(1, f"{item[0][1]} {filler} {item[0][2]}"), (2, f"{filler} {item[0][2]} {filler} {item[0][1]} {filler}"), (3, f"{item[0][1]} {filler}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    its = spark.createDataFrame(item, "item_id long, question string, answer string")
    got = decontam.contaminated(df, "doc_id", "text", its, "item_id", "question", "answer").collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_leaks(docs, item) == {(1, 1), (2, 1)}
    assert all(r.score >= 1 and r.question_overlap == r.answer_overlap == 1 for r in got)


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 16))
    x = np.concatenate([centres[rng.integers(0, 6, 900)] + 0.1 * rng.standard_normal((900, 16)), rng.standard_normal((300, 16)) * 2]).astype(np.float32)
    x[5] = x[6] = x[7]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None]), (2004, [1.0, 2.0]), (None, x[0].tolist()), (2020, [float("inf")] * 16), (0, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect()
    hit = total = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 1200, 20))
    for q, own in by.items():
        own.sort(key=lambda r: r["rank"])
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        assert [r["rank"] for r in own] == list(range(1, 21)) and all(abs(r.score - s[r.vec_id]) < 1e-9 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hit += len({r.vec_id for r in own} & set(np.lexsort((np.arange(len(s)), -s))[:20].tolist()))
        total += 20
    assert hit / total >= 0.9


def test_neighbours_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (21, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"], r.vec_id) for r in ann.search(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect()}
    assert got == {(0, 1, 20), (0, 2, 21), (20, 1, 0), (20, 2, 21)}
    assert ann.search(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 20 == 0).count() == 0


def test_hilbert_steps_are_neighbours():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    place = ann.hilbert(cells, 3)
    assert sorted(place.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_frequent_words_are_compared_in_parts(spark):
    """A word in all lines: results as without parts, and no group holds more than two of them."""
    rng = random.Random(9)
    vocab = [f"u{k}" for k in range(40)]
    docs = [(k, "\n".join(" ".join(["hot", *rng.sample(vocab, rng.randrange(1, 5))]) for _ in range(6))) for k in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    whole = {r.doc_id: r.text for r in linededup.dedup_lines(df, "doc_id", "text", frequent=10**6).collect()}
    split = {r.doc_id: r.text for r in linededup.dedup_lines(df, "doc_id", "text", frequent=40).collect()}
    assert whole == split
    work = df.select("doc_id", "text").withColumn("id", F.col("doc_id")).withColumn("doc", F.col("doc_id"))
    _, counts = linededup.line_table(work)
    listed = linededup.listing(work, counts, 80, 40)
    groups = listed.groupBy(F.shiftrightunsigned("word", 24).alias("w"), "block").agg(F.countDistinct("class").alias("n"), F.collect_set("role").alias("roles")).collect()
    assert max(r.n for r in groups) <= 4 * 40
    assert {tuple(sorted(r.roles)) for r in groups} <= {(0,), (1,), (2,), (1, 2)}
