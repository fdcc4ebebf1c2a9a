"""Corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, BPE codec.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and calls one operator of
``candleframe.llm`` on all rows that the stage before kept. All but the last return the
columns of ``docs``; ``run`` writes each result as Parquet to the shared folder and reads it
again for the next stage.

Filtering rules, on each stage's own input: texts without a letter go, and texts that are less
likely in every learned language than as noise (language ID); later matching lines go, and with
them a document that has no word left (line dedup); of each group of near-duplicates the
document with the smallest id stays, once (near-dedup, five words, 0.8); documents that hold a
test item go (decontamination). Near-dedup and decontamination judge rows, not ids: rows that
share an id or have none are told apart, and a row without an id comes after all others.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candleframe.llm import bpe, decontam, langid, linededup, minhash
from candleframe.llm.common import free_name, ship, written
from candleframe.llm.queries import RANKS, held_out, test_items


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that language ID rejects: without a letter, or in no language it knows."""
    ship(spark)
    lang, score, rejected = (free_name(docs, c) for c in ("lang_pred", "score", "rejected"))
    learn = docs.select("doc_id", "text", "lang").filter(~held_out("doc_id", 3, 1))
    model = langid.fit(learn, "text", "lang", F.col("doc_id"))
    return langid.predict(docs, "text", model, lang, score, rejected).filter(~F.col(rejected)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that an earlier line matches; a document that loses all its lines goes."""
    ship(spark)
    n_lines, n_removed = free_name(docs, "n_lines"), free_name(docs, "n_removed")
    out = linededup.dedup_lines(docs, "doc_id", "text", 80, n_lines, n_removed)
    return out.filter((F.col(n_removed) == 0) | (F.col(n_lines) > F.col(n_removed))).select(*docs.columns)


def row_keys(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a long column that tells its rows apart and sorts as ``doc_id`` does, and its name.

    That is ``doc_id`` itself where no id is null or repeated. Otherwise the rows are sorted by id,
    nulls last, and numbered; a row's place in the input makes every sort key different, so an id
    that many rows share is spread over the sort's partitions.
    """
    ids = docs.groupBy("doc_id").count()
    if ids.filter("doc_id IS NULL OR count > 1").isEmpty():
        return docs, "doc_id"
    at, row = free_name(docs, "at"), free_name(docs, "row")
    placed = docs.withColumn(at, F.monotonically_increasing_id())
    ordered = placed.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), at).drop(at)
    return written(ordered.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    ship(spark)
    rows, key = row_keys(docs)
    found = minhash.near_duplicates(rows.select(key, "text"), key, "text", words=5, percent=80)
    away = found.filter(~F.col("kept")).select(F.col("id").alias(key))
    return rows.join(away, key, "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which a test item is found."""
    ship(spark)
    return decontam.without_items(docs, "text", test_items(spark, sf_dir), "item_id", "question", "answer")


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes they decode to, for each document."""
    ship(spark)
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    back = bpe.round_trip(docs.select("doc_id", "source", "lang", "text"), "text", path, pattern)
    return back.select("doc_id", "source", "lang", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("bpe_codec", encode_and_decode),
]

#: Learned models and byte-level merges are beyond SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
