"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training sums n-gram counts for each language over a bounded sample of labelled rows
(``fit_rows``, chosen by a hash of the row's key); the sums are made by Spark, and only the
table of languages x buckets comes to the driver. The log-probability matrix, of the same
bounded size, is broadcast. Scoring takes whole texts: each text becomes sparse bucket
counts, multiplied with the matrix in numpy. No shuffle is needed for scoring.

A text is rejected if it has no letter, or if the model finds it likelier that its n-grams were
drawn from all buckets alike than from any language it has learned (noise, or an unknown script).

Defined results: a null text, an empty one and one without any letter are rejected, with
language ``und`` and score 0. Ties go to the language that sorts first. With no labelled row
nothing is learned: every text gets ``und`` and score 0, but only letterless texts are
rejected. Repeated rows give repeated results; other columns pass through. A column named as
a result raises ValueError.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows that a model is fitted on, at most (about; the sample is taken by hash).
FIT_ROWS = 20_000
#: log2 of the number of hashed buckets.
BITS = 15
#: n-gram lengths in characters.
GRAMS = (1, 2, 3)
#: Weight of the add-alpha smoothing.
ALPHA = 0.5
#: A text longer than this is hashed in pieces (with overlap, so that no n-gram is lost).
PIECE = 1 << 20

_MULTIPLIERS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))


@dataclass(frozen=True)
class Model:
    """Languages in sorted order; log-probabilities as buckets x languages; log priors."""

    languages: tuple[str, ...]
    log_p: np.ndarray
    log_prior: np.ndarray


def bucket_counts(text: str, bits: int = BITS) -> np.ndarray:
    """How often each bucket occurs among the n-grams of the whole text, lower-cased."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    total = np.zeros(1 << bits, dtype=np.int64)
    shift = np.uint32(32 - bits)
    for start in range(0, max(len(points), 1), PIECE):
        for n in GRAMS:
            part = points[start : start + PIECE + n - 1]
            width = len(part) - n + 1
            if width <= 0:
                continue
            h = np.full(width, n, dtype=np.uint32)
            for k in range(n):
                h ^= part[k : k + width]
                h *= _MULTIPLIERS[k]
                h ^= h >> np.uint32(15)
            total += np.bincount((h * _MULTIPLIERS[0]) >> shift, minlength=1 << bits)
    return total


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def sample_of(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df``, the same ones each time, chosen by a hash of ``key``; all, if there are no more."""
    there = df.count()
    if there <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * (rows / there)))


def fit(labelled: DataFrame, text: str, label: str, key: Column, fit_rows: int = FIT_ROWS) -> Model:
    """A model from the rows of ``labelled`` with a text and a label."""
    rows = sample_of(labelled.filter(F.col(label).isNotNull() & F.col(text).isNotNull()), key, fit_rows)

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for t, lang in zip(batch.column(0), batch.column(1), strict=True):
                t, lang = t.as_py(), lang.as_py()
                if has_letter(t):
                    sums[lang] = sums.get(lang, 0) + bucket_counts(t)
                    docs[lang] = docs.get(lang, 0) + 1
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1), pa.string()), pa.array([-1, *at.tolist()], pa.int32()), pa.array([docs[lang], *total[at].tolist()], pa.int64())], names=["label", "bucket", "n"])

    sums = rows.select(text, label).mapInArrow(run, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    found = sums.toPandas()  # languages x buckets at most
    languages = tuple(sorted(found["label"].unique().tolist()))
    counts = np.zeros((1 << BITS, len(languages)))
    docs = np.zeros(len(languages))
    for k, lang in enumerate(languages):
        own = found[found["label"] == lang]
        grams = own[own["bucket"] >= 0]
        counts[grams["bucket"].to_numpy(), k] = grams["n"].to_numpy()
        docs[k] = own.loc[own["bucket"] < 0, "n"].sum()
    log_p = np.log(counts + ALPHA) - np.log(counts.sum(axis=0) + ALPHA * (1 << BITS)) if languages else counts
    return Model(languages, log_p, np.log(docs / docs.sum()) if languages else docs)


def predict(df: DataFrame, text: str, model: Model, lang: str = "lang_pred", score: str = "score", rejected: str = "rejected") -> DataFrame:
    """Add the language of each whole text, its posterior probability, and whether the text is rejected."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text)
    alike = -BITS * np.log(2.0)  # log-probability of an n-gram if all buckets are alike
    schema = T.StructType([*df.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(rejected, T.BooleanType())])
    if len({c.lower() for c in schema.names}) < len(schema.names):
        raise ValueError("the input already has a column named as a result; name another")

    def run(batches):
        m = shared.value
        for batch in batches:
            names, scores, out = [], [], []
            for value in batch.column(place):
                t = value.as_py()
                bad = not has_letter(t)
                if bad or not m.languages:
                    out.append(bad)
                    names.append("und")
                    scores.append(0.0)
                    continue
                counts = bucket_counts(t)
                at = np.flatnonzero(counts)
                like = counts[at] @ m.log_p[at]
                out.append(bool(like.max() < counts.sum() * alike))
                log_odds = m.log_prior + like
                best = int(np.argmax(log_odds))
                names.append(m.languages[best])
                scores.append(float(1.0 / np.exp(log_odds - log_odds[best]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], names=schema.names)

    return df.mapInArrow(run, schema)
