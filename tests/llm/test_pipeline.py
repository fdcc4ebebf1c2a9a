"""The pipeline against a brute-force version, and odd tables through every stage."""

import base64
import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from test_similar import brute_components, brute_leaks, brute_lines

SF = "/root/testdata/sf0.001"


def test_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = [(i, t) for i, t in docs if t and any(map(str.isalpha, t))]
    docs = [(i, t) for i, t, n, gone in brute_lines(docs, 80) if not gone or n > gone]
    component = brute_components(docs, 5, 80)
    docs = [(i, t) for i, t in docs if component[i] == i]
    items = []
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        half = len(r.text) // 2
        cut = r.text.find(" ", half) + 1 or len(r.text)
        items.append((r.item_id, r.text[:cut], r.text[cut:]))
    leaked = {d for d, _ in brute_leaks(docs, items)}
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for i, t in docs:
        if i not in leaked:
            ids = codec.encode_ordinary(t)
            want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(want)


def test_odd_rows_through_every_stage(spark):
    rows = [(1, "hello there my good friend", "en", "a"), (1, "hello there my good friend", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (4, "12 34", "en", "b"), (None, "a text without an id", None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.lit(1).cast("long"))
    docs = docs.withColumns({c: F.lit("x") for c in ("kept", "rejected", "score", "n_lines", "id", "lines")})
    for frame, n in ((docs, 2), (docs.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SF)
            assert out.columns == docs.columns
            frame = spark.createDataFrame(out.collect(), docs.schema)
        last = corpus_pipeline.STAGES[-1][1](spark, frame, SF)
        assert last.count() == n and "decoded_sha256" in last.columns


def test_rows_are_judged_by_their_own_text(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    own = " ".join(f"word{k}" for k in range(60))
    near = own.replace("word30", "other")
    rows = [(1, "a clean text of its own"), (1, item), (None, item), (None, near), (None, own), (7, own), (9, own), (9, "another clean text"), (None, "no id and clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = corpus_pipeline.decontaminate(spark, docs, SF)
    assert {(r.doc_id, r.text) for r in clean.collect()} == {r for r in rows if r[1] != item} and clean.count() == 7
    left = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, clean, SF).collect()), key=str)
    assert left == sorted([(1, "a clean text of its own"), (7, own), (9, "another clean text"), (None, "no id and clean")], key=str)


def test_language_rejects_noise_and_keeps_the_rest(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = np.random.default_rng(5)
    noise = "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 400)))
    odd = docs.limit(1).withColumns({"doc_id": F.lit(-1).cast("long"), "text": F.lit(noise), "lang": F.lit(None).cast("string")})
    kept = corpus_pipeline.identify_language(spark, docs.unionByName(odd), SF).select("doc_id")
    lettered = [r.doc_id for r in docs.collect() if r.text and any(map(str.isalpha, r.text))]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(lettered)
