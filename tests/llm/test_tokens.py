"""BPE codec and token counts against the libraries that define them."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from candleframe.llm import bpe, tokencount

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def encoding():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec_equals_library(spark, encoding, odd_texts):
    rows = [(k, t, "mine") for k, t in enumerate([*odd_texts, None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, token string")
    got = bpe.decode(bpe.encode(df, "text", PATH, PATTERN), "ids", PATH, PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        want = encoding.encode_ordinary(r.text or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == want
        assert r.n_tokens == len(want) and bytes(r.decoded) == (r.text or "").encode() and r.token == "mine"


def test_codec_empty_table_and_clash(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(df, "text", PATH, PATTERN).count() == 0
    with pytest.raises(ValueError, match="already has a column"):
        bpe.encode(df.withColumn("IDS", F.lit(1)), "text", PATH, PATTERN)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_equal_library(spark, tmp_path, odd_texts, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lambda t: len(model.encode(t, num_threads=1))
    else:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        size = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*odd_texts, None, odd_texts[5]])], "doc_id long, text string").withColumn("content_digest", F.lit("x"))
    got = tokencount.count_tokens(df, "text", path, str(tmp_path / "cache")).collect()
    assert len(got) == len(odd_texts) + 2
    assert all(r.n_tokens == size(r.text or "") and r.content_digest == "x" for r in got)


def test_cache_grows_by_misses_only(spark, tmp_path):
    path, cache = public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "cache")
    frame = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string")
    tokencount.count_tokens(frame(["one two", "one  two\n", "three", None]), "text", path, cache).collect()
    stored = lambda: spark.read.parquet(cache).count()
    assert stored() == 3  # "one two" twice over, "three", empty
    tokencount.count_tokens(frame(["three", "four", "four"]), "text", path, cache).collect()
    assert stored() == 4
    tokencount.count_tokens(frame(["three"]), "text", public_tokenizers.path("byte_bpe_50k.json"), cache).collect()
    assert stored() == 5  # another tokenizer shares nothing
    assert hashlib.sha256(b"").digest() in {bytes(r.content_digest) for r in spark.read.parquet(cache).collect()}


def test_round_trip_equals_encode_then_decode(spark, odd_texts):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*odd_texts, None])], "doc_id long, text string")
    two = bpe.decode(bpe.encode(df, "text", path, pattern), "ids", path, pattern)
    assert sorted(bpe.round_trip(df, "text", path, pattern).collect()) == sorted(two.collect())
