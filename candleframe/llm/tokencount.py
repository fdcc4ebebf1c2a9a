"""Token counts through a digest cache.

The cache is a Parquet table of (content digest, tokenizer digest, token count). Content is
normalised only in ways that cannot change the count, then digested in the JVM; the
tokenizer digest covers the vocabulary file, the library's version and the normalisation.
Digests are joined to the stored counts, only distinct misses are encoded, and their counts
are appended to the cache. The texts are shuffled once, after copies have met in their map
tasks; all other joins carry digests only.

Defined results: a null text counts as empty and has no tokens; whole texts of any length
are counted; each row, repeated or not, gets the count of its text; other columns pass
through. Two writers may append the same digest; readers then still see one count.
"""

from __future__ import annotations

import hashlib
import json
import os
from importlib import metadata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candleframe.llm.common import distinct_misses, free_name, read_or_empty

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"
#: Words whose counts one Python worker keeps, for a tokenizer that drops white space, and words in one call of the library.
KNOWN_WORDS, BATCH = 500_000, 10_000


def drops_space(kind: str, spec: bytes) -> bool:
    """Whether runs of white space only separate words for this tokenizer."""
    if kind != "tokenizers":
        return False
    tok = json.loads(spec)
    steps = lambda part, key: (part or {}).get(key) or ([part] if part else [])
    one_space = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps(tok["normalizer"], "normalizers"))
    first = (steps(tok["pre_tokenizer"], "pretokenizers") or [{}])[0]
    removed = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and "\\s\\p{L}" in first["pattern"].get("Regex", "")
    return bool(one_space and removed and not any(" " in a["content"] or a["lstrip"] or a["rstrip"] for a in tok["added_tokens"]))


def counter(kind: str, spec: bytes):
    """A function from texts to their token counts, by the library for this kind of file."""
    if kind == "sentencepiece":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=spec)
        return lambda texts: [len(model.encode(t, num_threads=1)) for t in texts]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(spec.decode("utf-8"))
    tok.no_truncation()
    tok.no_padding()
    if not drops_space(kind, spec):
        return lambda texts: [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    known: dict[str, int] = {}

    def by_word(texts: list[str]) -> list[int]:
        # No token, normalisation or special string reaches across a space, so counts of the parts add up.
        out = []
        for t in texts:
            words = t.split(" ")
            new = [w for w in set(words) if w not in known]
            if len(known) + len(new) > KNOWN_WORDS:
                known.clear()
                new = list(set(words))
            for k in range(0, len(new), BATCH):
                part = new[k : k + BATCH]
                known.update(zip(part, (len(e.ids) for e in tok.encode_batch(part, add_special_tokens=False)), strict=True))
            out.append(sum(map(known.__getitem__, words)))
        return out

    return by_word


_COUNTERS: dict[str, object] = {}


def count_tokens(df: DataFrame, text: str, tokenizer_path: str, cache_path: str, n_tokens: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of each whole text, without begin, end or added special tokens.

    ``cache_path`` is a Parquet folder that all executors share; it grows by the misses.
    """
    spark = df.sparkSession
    with open(tokenizer_path, "rb") as f:
        spec = f.read()
    kind = "sentencepiece" if tokenizer_path.endswith(".model") else "tokenizers"
    collapse = drops_space(kind, spec)
    version = hashlib.sha256(b"\0".join([spec, metadata.version(kind).encode(), b"spaces collapsed" if collapse else b"as is"])).hexdigest()
    digest, content = free_name(df, "content_digest"), free_name(df, "content")
    normal = F.coalesce(F.col(text), F.lit(""))
    if collapse:
        normal = F.trim(F.regexp_replace(normal, "[\\t-\\r ]+", " "))
    key = F.unhex(F.sha2(normal.cast("binary"), 256))

    def stored() -> DataFrame:
        rows = read_or_empty(spark, cache_path, CACHE_SCHEMA).filter(F.col("tokenizer_digest") == version)
        return rows.groupBy(F.col("content_digest").alias(digest)).agg(F.max("n_tokens").alias(n_tokens))

    held = spark.sparkContext.broadcast(spec)

    def run(batches):
        if version not in _COUNTERS:
            _COUNTERS[version] = counter(kind, held.value)
        size = _COUNTERS[version]
        for batch in batches:
            counts = [n for k in range(0, batch.num_rows, 100) for n in size(batch.column(1).slice(k, 100).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], names=["content_digest", "tokenizer_digest", "n_tokens"])

    texts = df.select(normal.alias(content)).withColumn(digest, F.unhex(F.sha2(F.col(content).cast("binary"), 256)))
    misses = distinct_misses(texts, digest, content, stored()).select(digest, content)
    misses.mapInArrow(run, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    return df.withColumn(digest, key).join(stored(), digest, "left").drop(digest)
