"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine.

Fitting takes a bounded sample of labelled texts (``FIT_ROWS``, by hash). Spark counts in how
many of them each term (a word, or its first four or five characters) occurs, by label. All
terms span the vectors; a term's TF-IDF is weighted by the square of how far the label's
log-odds among its texts, drawn to the base rate by ``DRAW`` texts, lie from it, in either
direction, so that the many words without bearing on the label do not drown the few with.
The examples' vectors make an inverted index; examples lie in blocks by the length of their
unscaled vectors, each block with the largest weight of a term. A query takes its terms by
falling bound and adds their postings until the bounds that its blocks have left keep all but
a few examples below the k-th best cosine so far; those few are scored on their whole
vectors, so the k nearest are exact. Votes weigh 1 / (distance + 0.05), are drawn to the base rate, and are
calibrated by isotonic regression on the examples themselves, each scored without itself.

Defined results: a null, empty or termless text, or one of unseen terms, has no neighbours and gets the rate of
label 1 among examples without neighbours; with no labelled rows every score is 0; ties go
to the smaller example id; repeated rows give repeated results; other columns pass through.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candleframe.llm.langid import sample_of

#: Labelled rows that the index is fitted on, at most (about; the sample is taken by hash).
FIT_ROWS = 20_000
#: Texts at the base rate that a term's own are drawn by, and the least learned weight of a term.
DRAW, LEAST_WEIGHT = 2.0, 0.01
#: Neighbours that vote, examples in one block, and postings read before the first look at what is left.
NEIGHBOURS, BLOCK, LOOK = 25, 1024, 20_000
#: A row is predicted 1 from this score on.
CUT = 0.3

_WORD = re.compile(r"\w+")


def word_terms(word: str) -> tuple[str, ...]:
    """A word, and each first part of a longer word."""
    return (word, *(word[:k] + "*" for k in (4, 5) if len(word) > k))


def text_terms(text: str | None) -> Counter:
    """How often each word, and each first part of a longer word, occurs in the whole text."""
    out: Counter = Counter()
    for w, n in Counter(_WORD.findall((text or "").lower())).items():
        for t in word_terms(w):
            out[t] += n
    return out


def ranges(at: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions from ``at[k]`` to ``at[k + 1]``, for each of ``numbers``, and how many each has."""
    low = at[numbers]
    run = at[numbers + 1] - low
    return np.repeat(low - (np.cumsum(run) - run), run) + np.arange(run.sum()), run


@dataclass
class Index:
    """Postings of term t at ``at[t]:at[t + 1]``, by example; ``idf`` holds the learned weight as well."""

    terms: pa.Array
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    at: np.ndarray
    examples: np.ndarray
    weights: np.ndarray
    largest: np.ndarray  # terms x blocks
    base: float
    alone: float
    steps: tuple[np.ndarray, np.ndarray]
    tf: np.ndarray | None = None  # of the postings, from which a worker makes their weights
    norms: np.ndarray | None = None
    held: Broadcast | None = None  # the index as ``fit`` has sent it

    def __getstate__(self) -> tuple[int, bytes]:
        """What the rest can be made from, compressed."""
        kept = {k: getattr(self, k) for k in ("idf", "ids", "labels", "base", "alone", "steps", "examples", "tf", "norms")}
        state = pickle.dumps(kept | {"terms": self.terms, "run": np.diff(self.at)})
        return len(state), pa.compress(state, codec="zstd", asbytes=True)

    def __setstate__(self, state: tuple[int, bytes]) -> None:
        kept = pickle.loads(pa.decompress(state[1], state[0], codec="zstd", asbytes=True))
        run = kept.pop("run")
        self.__dict__ |= kept
        self.at = np.concatenate(([0], np.cumsum(run)))
        self.weights = ((1 + np.log(self.tf)) * np.repeat(self.idf, run) / self.norms[self.examples]).astype(np.float32)
        self.largest = np.zeros((len(run), (len(self.ids) + BLOCK - 1) // BLOCK), dtype=np.float32)
        block = self.examples // BLOCK
        first = np.flatnonzero(np.diff(np.repeat(np.arange(len(run)), run) * self.largest.shape[1] + block, prepend=-1))
        if len(first):
            term = np.searchsorted(self.at, first, side="right") - 1
            self.largest[term, block[first]] = np.maximum.reduceat(self.weights, first)

    @cached_property
    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The examples' own vectors: where each starts, terms, weights; and room for a query by term."""
        order = np.argsort(self.examples, kind="stable")
        term = np.repeat(np.arange(len(self.at) - 1, dtype=np.int32), np.diff(self.at))[order]
        start = np.concatenate(([0], np.cumsum(np.bincount(self.examples, minlength=len(self.ids)))))
        return start, term, self.weights[order], np.zeros(len(self.at) - 1)

    @cached_property
    def peak(self) -> np.ndarray:
        """The largest weight of each term."""
        return self.largest.max(axis=1)

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the terms of each whole text start, their numbers (ascending in a text), and how often each occurs."""
        words = [pa.array(_WORD.findall((t.as_py() or "").lower()), pa.string()) for t in texts]
        number = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        coded = pa.concat_arrays([pa.array([], pa.string()), *words]).dictionary_encode()
        known = coded.dictionary
        size = pc.utf8_length(known)
        parts = [known]  # as in ``word_terms``
        for k in (4, 5):
            first = pc.binary_join_element_wise(pc.utf8_slice_codeunits(known, 0, k), "*", "")
            parts.append(pc.if_else(pc.greater(size, k), first, None))
        own = np.stack([pc.fill_null(pc.index_in(w, value_set=self.terms, skip_nulls=True), -1).to_numpy(zero_copy_only=False) for w in parts], axis=1)
        word, n = np.unique(number * len(own) + coded.indices.to_numpy(), return_counts=True)
        number, term = word // max(len(own), 1), own[word % max(len(own), 1)]
        at, part = np.nonzero(term >= 0)
        wide = max(len(self.terms), 1)
        key = number[at] * wide + term[at, part]
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[at][order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        start = np.searchsorted(key[first], np.arange(len(words) + 1) * wide)
        return start, key[first] % wide, np.add.reduceat(n, first) if len(first) else n

    def vectors(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Term numbers and unit weights of each whole text."""
        start, ids, tf = self.counts(texts)
        weights = (1 + np.log(tf)) * self.idf[ids]
        for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
            norm = np.sqrt((weights[a:b] ** 2).sum())
            yield ids[a:b], weights[a:b] / norm if norm else weights[a:b]

    def left_over(self, ids: np.ndarray, weight: np.ndarray, but: int | None = None) -> np.ndarray:
        """The examples that may be among the nearest by their blocks' bounds and the postings read."""
        n = len(self.ids)
        postings = np.cumsum(self.at[ids + 1] - self.at[ids])
        out = np.flatnonzero(self.ids == but) if but is not None else ()
        cosine, done, look = np.zeros((0, BLOCK)), 0, LOOK
        while True:
            stop = min(max(int(np.searchsorted(postings, look, side="right")), done + 1), len(ids))
            at, run = ranges(self.at, ids[done:stop])
            more = np.bincount(self.examples[at], np.repeat(weight[done:stop], run) * self.weights[at], minlength=BLOCK * self.largest.shape[1])
            cosine = more.reshape(-1, BLOCK) + cosine if done else more.reshape(-1, BLOCK)
            if len(out):
                cosine.ravel()[out] = -np.inf
            done, look = stop, 4 * max(look, int(postings[stop - 1]))
            left = weight[done:] @ self.largest[ids[done:]]  # by block, what the terms not read can add
            some = cosine[cosine > 0]
            kth = np.partition(some, -NEIGHBOURS)[-NEIGHBOURS] if len(some) >= NEIGHBOURS else 0.0
            few = np.flatnonzero(cosine >= (kth - 1e-6 - left)[:, None] if kth > 1e-6 else cosine + left[:, None] > 0)
            # Look again as long as that reads less than the whole vectors of the few.
            if done == len(ids) or len(few) <= NEIGHBOURS or len(few) * len(self.examples) / n < min(look, postings[-1]) - postings[done - 1]:
                return few[few < n]

    def nearest(self, ids: np.ndarray, weight: np.ndarray, but: int | None = None) -> list[tuple[int, float]]:
        """(example, cosine) of the nearest examples with a cosine above 0, nearest first."""
        if not len(ids) or not len(self.ids):
            return []
        order = np.argsort(-weight * self.peak[ids], kind="stable")
        few = self.left_over(ids[order], weight[order], but)
        start, term, own, room = self.rows
        at, run = ranges(start, few)
        room[ids] = weight
        exact = np.bincount(np.repeat(np.arange(len(few)), run), room[term[at]] * own[at], minlength=len(few))
        room[ids] = 0
        few, exact = few[exact > 0], exact[exact > 0]
        best = np.lexsort((few, self.ids[few], -np.round(exact, 12)))[:NEIGHBOURS]
        return list(zip(few[best].tolist(), exact[best].tolist(), strict=True))

    def vote(self, near: list[tuple[int, float]]) -> float | None:
        """Share of label 1 among the neighbours, weighted by closeness, before calibration."""
        if not near:
            return None
        pull = np.array([1 / (1.05 - min(c, 1.0)) for _, c in near])
        return float((pull @ self.labels[[e for e, _ in near]] + self.base) / (pull.sum() + 1))

    def score(self, near: list[tuple[int, float]]) -> float:
        raw = self.vote(near)
        if raw is None:
            return self.alone
        return float(np.interp(raw, *self.steps)) if len(self.steps[0]) else raw


def isotonic(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and means of the blocks of a monotone least-squares fit."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for x, y in zip(raw[order].tolist(), label[order].tolist(), strict=True):
        blocks.append([x, y, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks).reshape(-1, 3)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def sample_labels(labels: DataFrame, key: Column, label: str, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The bounded sample of labelled rows to fit on, by a hash of ``key``."""
    return sample_of(labels.filter(F.col(label).isNotNull()), key, fit_rows)


def fit(labelled: DataFrame, key: str, text: str, label: str) -> Index:
    """The index of a labelled sample of bounded size (see ``sample_labels``) with its texts."""
    spark = labelled.sparkSession
    rows = labelled.filter(F.col(label).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), (F.col(label) == 1).cast("int").alias("label"))

    def tally(batches):
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for t, y in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                for term in text_terms(t.as_py()):
                    n = seen.setdefault(term, [0, 0])
                    n[y] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([n[0] for n in seen.values()], pa.int64()), pa.array([n[1] for n in seen.values()], pa.int64())], names=["term", "n0", "n1"])

    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("n1")).first()
    p = min(max(total.n1 / max(total.n, 1), 1e-6), 1 - 1e-6)
    terms = rows.mapInArrow(tally, "term string, n0 long, n1 long").groupBy("term").agg((F.sum("n0") + F.sum("n1")).alias("n"), F.sum("n1").alias("n1"))
    counted = terms.orderBy(F.desc("n"), "term").toArrow()  # all terms of fit_rows texts; those read often lie together
    number = counted.column("term").cast(pa.string()).combine_chunks()
    n, n1 = (counted.column(c).to_numpy().astype(float) for c in ("n", "n1"))
    rate = (n1 + DRAW * p) / (n + DRAW)
    lean = np.log(rate / (1 - rate)) - np.log(p / (1 - p))
    idf = np.log(1 + total.n / np.maximum(n, 1)) * (lean**2 + LEAST_WEIGHT)
    index = Index(number, idf, np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(len(number) + 1, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros((0, 0)), p if total.n else 0.0, 0.0, (np.zeros(0), np.zeros(0)), np.zeros(0), np.zeros(0))
    held = spark.sparkContext.broadcast(index)

    def vectors(batches):
        index = held.value
        for batch in batches:
            start, ids, tf = index.counts(batch.column(1))
            own = [(ids[a:b], tf[a:b]) for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
            norms = [float(np.sqrt((((1 + np.log(tf)) * index.idf[ids]) ** 2).sum())) for ids, tf in own]
            packed = [pa.array([v[k].astype("<i4").tobytes() for v in own], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(norms, pa.float64()), *packed], names=["id", "label", "norm", "terms", "tf"])

    got = rows.mapInArrow(vectors, "id long, label int, norm double, terms binary, tf binary").filter("norm > 0").toArrow()  # fit_rows sparse vectors
    held.destroy()
    got = got.set_column(0, "id", pc.fill_null(got.column("id"), -1)).sort_by([(c, "ascending") for c in ("norm", "id", "label", "terms", "tf")])
    index.ids, index.labels, index.norms = got.column("id").to_numpy(), got.column("label").to_numpy().astype(float), got.column("norm").to_numpy()
    lengths = pc.binary_length(got.column("terms")).to_numpy() // 4
    term, tf = (np.frombuffer(b"".join(x.as_buffer() for x in got.column(c)), dtype="<i4") for c in ("terms", "tf"))
    del got
    least = lambda x: x.astype(np.uint16 if x.max(initial=0) < 1 << 16 else np.int32)
    order = np.argsort(term, kind="stable")
    index.examples = least(np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[order])
    index.tf = least(tf[order])
    index.at = np.searchsorted(term[order], np.arange(len(number) + 1))
    del term, tf, order
    index.held = spark.sparkContext.broadcast(index)
    held2 = index.held

    def without_itself(batches):
        for batch in batches:
            index, raws = held2.value, []
            for i, vector in zip(batch.column(0).to_pylist(), index.vectors(batch.column(1)), strict=True):
                raws.append(index.vote(index.nearest(*vector, -1 if i is None else i)))
            yield pa.RecordBatch.from_arrays([pa.array(raws, pa.float64()), batch.column(2)], names=["raw", "label"])

    raw = rows.mapInArrow(without_itself, "raw double, label int").toPandas()
    alone = raw["label"][raw["raw"].isna()]
    index.alone = float((alone.sum() + index.base) / (len(alone) + 1)) if total.n else 0.0
    near = raw[raw["raw"].notna()].sort_values(["raw", "label"])
    if len(near):
        index.steps = isotonic(near["raw"].to_numpy(float), near["label"].to_numpy(float))
    return index


def score(df: DataFrame, text: str, index: Index, score: str = "score", evidence: str = "evidence") -> DataFrame:
    """Add the score of each whole text and its evidence: ids, labels and cosines of the neighbours."""
    held, alone, steps = index.held, index.alone, index.steps  # the two are learned after the rest was sent
    place = df.columns.index(text)
    item = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("cosine", T.DoubleType())])
    schema = T.StructType([*df.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(evidence, T.ArrayType(item))])
    if len({c.lower() for c in schema.names}) < len(schema.names):
        raise ValueError("the input already has a column named as a result; name another")
    kind = pa.list_(pa.struct([("id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches):
        index = held.value
        index.alone, index.steps = alone, steps
        for batch in batches:
            near = [index.nearest(*vector) for vector in index.vectors(batch.column(place))]
            scores = pa.array([index.score(n) for n in near], pa.float64())
            example = np.array([e for n in near for e, _ in n], dtype=np.int64)
            cosine = pa.array([c for n in near for _, c in n], pa.float64())
            each = pa.StructArray.from_arrays([pa.array(index.ids[example]), pa.array(index.labels[example].astype(np.int32)), cosine], fields=list(kind.value_type))
            why = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, near)]), pa.int32()), each).cast(kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, scores, why], names=schema.names)

    return df.mapInArrow(run, schema)
