"""Benchmark decontamination: BM25 retrieval of test items for every training passage.

The test items make a BM25 inverted index. An item's threshold is what a passage must score
if it holds enough of the item to be verified: all its weight but that of its heaviest terms,
as many as the shingles that may be missing, for each word lost costs a shingle at least.
Weights are divided by it, so that every item's threshold is 1. Postings lie in blocks of items with the largest weight of each term in a block.
Every passage of every document (windows of three times the longest item, moved on by one
length, so that no run of twice that length is cut everywhere) is a query: block-max WAND
leaves out whatever cannot reach the threshold by the terms' largest weights, then by their
largest weights in each block, and scores the items of the remaining blocks exactly. All
items above the threshold are retrieved; there is no top-k. The document as a whole is a query too,
so that an item whose parts lie in different passages is also found.

Retrieved items are verified on the whole document: the share of the item's distinct word
shingles (five words) that occur in it, over the whole item and for its question and answer
alone.

Words are runs of bytes other than ASCII punctuation and white space, A-Z lower-cased. The
index is broadcast in shards of at most ``SHARD_BYTES`` of item text; a larger benchmark
takes one pass over the documents for each shard. Documents are not shuffled.

Defined results: items without a word match nothing; an item, question or answer shorter
than a shingle is one shingle; a missing question or answer does not count against the
other; null or empty documents match nothing; items that share an id are separate items;
each pair of a document row and an item gives one row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candleframe.llm import textkit

#: Text of test items that one broadcast index may hold.
SHARD_BYTES = 16 << 20
#: Items in one block of postings.
BLOCK = 64
#: Words in a shingle; least share of an item's shingles; least share of each of its two parts.
WORDS, LEAST_OVERLAP, LEAST_PART = 5, 0.8, 0.5
_K1, _B = 1.2, 0.75


@dataclass(frozen=True)
class Index:
    """Postings by term (``term_at``): items and weights; blocks by term (``block_at``): block numbers and largest weights."""

    terms: np.ndarray
    largest: np.ndarray
    term_at: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    block_at: np.ndarray
    blocks: np.ndarray
    block_largest: np.ndarray
    n_items: int
    longest: int
    ids: list
    parts: list[tuple[np.ndarray, ...]]  # distinct shingles of the item, its question, its answer
    sizes: list[tuple[int, ...]]  # words in those shingles

    def retrieve(self, terms: np.ndarray, least: float) -> list[tuple[int, float]]:
        """Items whose score for a passage with these distinct terms reaches ``least``."""
        if self.largest[terms].sum() < least:
            return []
        at = _ranges(self.block_at, terms)
        alive = np.bincount(self.blocks[at], self.block_largest[at], minlength=(self.n_items - 1) // BLOCK + 1) >= least
        if not alive.any():
            return []
        at = _ranges(self.term_at, terms)
        if not alive.all():
            at = at[alive[self.items[at] // BLOCK]]
        score = np.bincount(self.items[at], self.weights[at], minlength=self.n_items)
        hits = np.flatnonzero(score >= least)
        return list(zip(hits.tolist(), score[hits].tolist(), strict=True))


def _ranges(at: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """All positions from ``at[t]`` to ``at[t + 1]``, for each of ``terms``."""
    low = at[terms]
    run = at[terms + 1] - low
    return np.repeat(low - (np.cumsum(run) - run), run) + np.arange(run.sum())


def _hashes(texts: list[str | None]) -> list[np.ndarray]:
    return [h.copy() for _, h in textkit.each_text(pa.array(texts, pa.string()), textkit.PUNCTUATION)]


def build(ids: list, questions: list[str | None], answers: list[str | None]) -> Index | None:
    """The index of test items; None if none has a word."""
    q, a = _hashes(questions), _hashes(answers)
    rows = [(i, x, y, np.concatenate((x, y))) for i, x, y in zip(ids, q, a, strict=True) if len(x) + len(y)]
    if not rows:
        return None
    length = np.array([len(r[3]) for r in rows])
    counted = [np.unique(r[3], return_counts=True) for r in rows]
    word = np.concatenate([c[0] for c in counted])
    tf = np.concatenate([c[1] for c in counted]).astype(float)
    item = np.repeat(np.arange(len(rows)), [len(c[0]) for c in counted])
    terms, term, df = np.unique(word, return_inverse=True, return_counts=True)
    idf = np.log(1 + (len(rows) - df + 0.5) / (df + 0.5))
    weight = idf[term] * tf * (_K1 + 1) / (tf + _K1 * (1 - _B + _B * length[item] / length.mean()))
    lost = ((1 - LEAST_OVERLAP) * np.maximum(length - WORDS + 1, 1) + 1e-9).astype(int)  # shingles that may be missing
    heaviest = np.lexsort((-weight, item))
    nth = np.arange(len(item)) - np.searchsorted(item[heaviest], item[heaviest])
    heavy = np.bincount(item[heaviest], weight[heaviest] * (nth < lost[item[heaviest]]))
    weight /= (np.bincount(item, weight) - heavy)[item] * (1 - 1e-9)
    order = np.lexsort((item, term))
    term, item, weight = term[order], item[order], weight[order]
    term_at = np.searchsorted(term, np.arange(len(terms) + 1))
    largest = np.maximum.reduceat(weight, term_at[:-1])
    first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (item[1:] // BLOCK != item[:-1] // BLOCK))))
    parts = [tuple(np.unique(textkit.ordered_shingles(x, WORDS)) for x in (r[3], r[1], r[2])) for r in rows]
    sizes = [tuple(min(WORDS, len(x)) for x in (r[3], r[1], r[2])) for r in rows]
    return Index(terms, largest, term_at, item, weight, np.searchsorted(term[first], np.arange(len(terms) + 1)), item[first] // BLOCK, np.maximum.reduceat(weight, first), len(rows), int(length.max()), [r[0] for r in rows], parts, sizes)


def passages(n_words: int, longest: int) -> list[tuple[int, int]]:
    """Windows over a document's words; each run of up to twice ``longest`` words lies in one."""
    return [(s, s + 3 * longest) for s in range(0, max(n_words - 2 * longest, 1), longest)]


def match(hashes: np.ndarray, index: Index) -> list[tuple[int, float, float, float, float]]:
    """(item, score as a multiple of its threshold, overlap, question overlap, answer overlap) of the items found in a document.

    The score is that of the best passage, or of the whole document where no passage reaches the threshold.
    """
    at = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    term = np.where(index.terms[at] == hashes, at, -1)
    whole = np.unique(term)
    # No passage scores more for an item than the whole document: these are all the items to verify, and most documents need one look.
    found = dict(index.retrieve(whole[whole >= 0], 1.0))
    if not found:
        return []
    best: dict[int, float] = {}
    for start, stop in passages(len(hashes), index.longest):
        own = np.unique(term[start:stop])
        for item, score in index.retrieve(own[own >= 0], 1.0):
            best[item] = max(score, best.get(item, 0.0))
    there = np.unique(textkit.ordered_shingles(hashes, WORDS))
    sizes: dict[int, np.ndarray] = {WORDS: there}

    def share(part: np.ndarray, size: int) -> float:
        if not len(part):
            return 1.0
        if size not in sizes:  # the part is one shingle of fewer words
            sizes[size] = np.unique(textkit.ordered_shingles(hashes, size))
        own = sizes[size]
        return float((own[np.minimum(np.searchsorted(own, part), len(own) - 1)] == part).mean())

    out = []
    for item, score in sorted((found | best).items()):
        whole, question, answer = (share(p, n) for p, n in zip(index.parts[item], index.sizes[item], strict=True))
        if whole >= LEAST_OVERLAP and min(question, answer) >= LEAST_PART:
            out.append((item, score, whole, question, answer))
    return out


def shards(items: DataFrame, item: str, question: str, answer: str):
    """Collected items of about ``SHARD_BYTES`` of text a time; each row is in one shard."""
    rows = items.select(F.col(item).alias("i"), F.col(question).alias("q"), F.col(answer).alias("a"))
    size = F.coalesce(F.octet_length("q"), F.lit(0)) + F.coalesce(F.octet_length("a"), F.lit(0))
    total = rows.agg(F.sum(size)).first()[0] or 0
    n = int(total // (SHARD_BYTES // 2)) + 1
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("i", "q", "a"), F.lit(n)) == k)
        got = part.orderBy("i", "q", "a").collect()  # SHARD_BYTES of text, but for chance
        yield build([r.i for r in got], [r.q for r in got], [r.a for r in got])


def contaminated(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, question: str, answer: str) -> DataFrame:
    """(key, item, score, overlap, question_overlap, answer_overlap) for each test item found in a document."""
    names = [key, item, "score", "overlap", "question_overlap", "answer_overlap"]
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField(item, items.schema[item].dataType), *(T.StructField(n, T.DoubleType()) for n in names[2:])])
    out = docs.sparkSession.createDataFrame([], schema)
    for index in shards(items, item, question, answer):
        if index is None:
            continue
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, held=held):
            index = held.value
            kind = pa.array(index.ids).type
            for batch in batches:
                keys, rows = [], []
                own = batch.column(0)
                for k, hashes in textkit.each_text(batch.column(1), textkit.PUNCTUATION):
                    if len(hashes):
                        for row in match(hashes, index):
                            keys.append(k)
                            rows.append(row)
                columns = [own.take(pa.array(keys, pa.int64())), pa.array([index.ids[r[0]] for r in rows], kind)]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([r[k] for r in rows], pa.float64()) for k in range(1, 5))], names=names)

        out = out.unionByName(docs.select(key, text).mapInArrow(run, schema))
    return out


def without_items(docs: DataFrame, text: str, items: DataFrame, item: str, question: str, answer: str) -> DataFrame:
    """The rows of ``docs`` whose text holds no test item, with all their columns.

    Each row is judged by its own text, whatever its id; nothing is joined or shuffled.
    """
    place, schema = docs.columns.index(text), docs.schema
    for index in shards(items, item, question, answer):
        if index is None:
            continue
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, held=held):
            index = held.value
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for k, hashes in textkit.each_text(batch.column(place), textkit.PUNCTUATION):
                    clean[k] = not len(hashes) or not match(hashes, index)
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
    return docs
