"""Language ID and toxicity: held-out accuracy, exact neighbours, odd rows."""

import numpy as np

from candleframe.llm import langid, toxicity
from candleframe.llm.queries import QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    r = QUERIES["op5_language_id"](spark, SF).join(docs, "doc_id").filter("held_out AND lang IS NOT NULL AND NOT rejected")
    good, n = r.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 200 and good > 0.97


def test_language_odd_rows(spark):
    rows = [(1, "the cat and the dog"), (2, None), (3, ""), (4, "123 !?"), (5, "le chat et le chien"), (5, "le chat et le chien"), (6, "é" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = df.filter("doc_id in (1, 5)").withColumn("lang", F.when(F.col("doc_id") == 1, "en").otherwise("fr"))
    model = langid.fit(labelled, "text", "lang", F.col("doc_id"))
    got = sorted(tuple(r)[0:1] + tuple(r)[2:] for r in langid.predict(df, "text", model).collect())
    by = {r[0]: r[1:] for r in got}
    assert len(got) == 7 and by[1][0] == "en" and by[5][0] == "fr" and by[6][0] in ("en", "fr")
    assert all(by[k] == ("und", 0.0, True) for k in (2, 3, 4)) and 0 <= by[1][1] <= 1
    nothing = langid.fit(labelled.withColumn("lang", F.lit(None).cast("string")), "text", "lang", F.col("doc_id"))
    assert {r.rejected for r in langid.predict(df, "text", nothing).filter("doc_id in (1, 5)").collect()} == {False}
    assert langid.predict(df.limit(0), "text", model).count() == 0


def test_long_text_is_counted_whole():
    text = "ab" * 30
    whole = langid.bucket_counts(text)
    old, langid.PIECE = langid.PIECE, 7
    try:
        assert (langid.bucket_counts(text) == whole).all()
    finally:
        langid.PIECE = old


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    r = QUERIES["op6_toxicity"](spark, sf).join(labels, "doc_id").filter("held_out")
    t = {(x.toxic, x.predicted): x["count"] for x in r.groupBy("toxic", "predicted").count().collect()}
    assert t[1, 1] / (t[1, 1] + t.get((1, 0), 0)) > 0.85 and t.get((0, 1), 0) / (t[0, 0] + t.get((0, 1), 0)) < 0.03


def small_index(n=300, terms=12, seed=2):
    rng = np.random.default_rng(seed)
    dense = rng.random((n, terms)) * (rng.random((n, terms)) < 0.3)
    dense = dense[dense.sum(axis=1) > 0]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    term, example = np.nonzero(dense.T)
    largest = np.zeros((terms, (len(dense) + toxicity.BLOCK - 1) // toxicity.BLOCK))
    np.maximum.at(largest, (term, example // toxicity.BLOCK), dense[example, term])
    labels = (dense[:, 0] > 0).astype(float)
    return dense, toxicity.Index({}, np.ones(terms), np.arange(len(dense)), labels, np.searchsorted(term, np.arange(terms + 1)), example, dense[example, term], largest, 0.1, 0.1, (np.zeros(0), np.zeros(0)))


def test_neighbours_are_exact():
    dense, index = small_index()
    for q in dense[:60]:
        ids = np.flatnonzero(q)
        got = index.nearest(ids, q[ids])
        cosine = dense @ q
        want = np.sort(cosine[cosine > 0])[::-1][: toxicity.NEIGHBOURS]
        assert np.allclose([c for _, c in got], want) and np.allclose([cosine[e] for e, _ in got], want)


def test_few_whole_vectors_are_read(monkeypatch):
    # Four large groups by the heaviest term, small ones by the next, and many light terms that all share.
    rng = np.random.default_rng(8)
    n, terms = 20_000, 600
    dense = np.where(rng.random((n, terms)) < 0.5, 0.002, 0)
    dense[:, 200:] = 0
    dense[np.arange(n), 200 + np.arange(n) % 400] = 0.5
    dense[np.arange(n), 196 + np.arange(n) % 4] = 0.8
    term, example = np.nonzero(dense.T)
    largest = np.zeros((terms, -(-n // toxicity.BLOCK)))
    np.maximum.at(largest, (term, example // toxicity.BLOCK), dense[example, term])
    at = np.searchsorted(term, np.arange(terms + 1))
    index = toxicity.Index({}, np.ones(terms), np.arange(n), np.zeros(n), at, example, dense[example, term], largest, 0.1, 0.1, (np.zeros(0), np.zeros(0)))
    read, ranges = [], toxicity.ranges

    def counted(*args):
        got = ranges(*args)
        read.append(int(got[1].sum()))
        return got

    monkeypatch.setattr(toxicity, "ranges", counted)
    for q in dense[:40]:
        ids = np.flatnonzero(q)
        got = index.nearest(ids, q[ids])
        assert np.allclose([c for _, c in got], np.sort(dense @ q)[::-1][: toxicity.NEIGHBOURS])
    assert sum(read) < 40 * 50_000  # 17,664 for each; 519,675 where the whole vectors of a large group are read


def test_toxicity_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello"), (3, "hello")], "doc_id long, text string")
    none = df.limit(0).withColumn("toxic", F.lit(1))
    index = toxicity.fit(none, "doc_id", "text", "toxic")
    assert [r.score for r in toxicity.score(df, "text", index).collect()] == [0.0] * 4
    rows = [(k, "fine words here" if k % 4 else "bad words here", int(k % 4 == 0)) for k in range(200)]
    index = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), "doc_id", "text", "toxic")
    more = df.union(spark.createDataFrame([(9, "so bad"), (10, "so fine")], df.schema))
    got = {r.doc_id: r.score for r in toxicity.score(more, "text", index).collect()}
    assert got[9] > 0.5 > toxicity.CUT > got[10] and got[1] == got[2] == got[3]


def test_toxicity_of_a_rare_word_and_of_benign_words(spark):
    rng = np.random.default_rng(6)
    plain = [f"plain{k}x" for k in range(400)]
    some = lambda n: " ".join(rng.choice(plain, n))
    rows = [(k, f"{some(12)} vile {some(12)}", 1) for k in range(400)]
    rows += [(k, f"{some(12)} rareslur {some(12)}", 1) for k in range(400, 406)]  # 6 of 4,006 texts: 0.15 %
    rows += [(k, some(25), 0) for k in range(406, 3706)]
    rows += [(k, f"{some(12)} vile weather report {some(12)}", 0) for k in range(3706, 4006)]
    index = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), "doc_id", "text", "toxic")
    asked = [(1, f"{some(12)} rareslur {some(12)}"), (2, f"{some(12)} rareslurs"), (3, some(25)), (4, f"{some(12)} vile weather report {some(12)}"), (5, f"{some(12)} vile {some(12)}")]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(asked, "doc_id long, text string"), "text", index).collect()}
    assert all(len(r.evidence) == toxicity.NEIGHBOURS for r in got.values())
    assert min(got[k].score for k in (1, 2, 5)) > toxicity.CUT > max(got[k].score for k in (3, 4))
