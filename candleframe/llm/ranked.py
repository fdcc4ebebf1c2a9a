"""Ranked lexical search: a hybrid of term-at-a-time and document-at-a-time evaluation.

``build`` cuts the documents into index blocks of about ``BLOCK`` bytes of text. A block has
one list for each of its terms (documents of the block in ascending id, with counts) and one
header row (ids, lengths). ``search`` keeps the lists of terms that a query asks for, takes
the counts of the collection from them, and deals the lists out by block.

In a block a query's shortest lists, up to ``SHORT`` postings together, are summed term at a
time into accumulators. These then stand as one more iterator, with its own maxima, beside
the long lists, which are read document at a time: every list has its largest score in each
window of ``WINDOW`` documents, windows whose maxima cannot reach the k-th best score so far
are skipped, and within a window only lists are opened whose maxima together could reach it;
the others are probed at the documents found there that still can. The k-th best score is
carried from block to block within a task; each task returns its k best of each query.

A score sums w * ((1000000000 * tf) div (1000 * tf + 20 * m)) over a query's distinct terms
in the document, with m = 50 + (50 * n * N) div L, w = floor(1000 * ln((2N + 2) / (2df + 1))),
all in 64-bit integers but for w. Terms are compared as 64-bit hashes.

Defined results: null and empty texts, and texts without a term, are never returned and do not
count in N; a query without a term, or whose terms are in no document, has no rows; rows of
``docs`` that share an id are ranked one by one; query rows that share an id make one query of all
their terms, those without an id make none; equal scores go by ascending id, a null id last;
other columns of the inputs do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candleframe.llm import textkit
from candleframe.llm.common import written

#: Bytes of text, and documents, of one index block, at most (but for a longer single batch).
BLOCK, BLOCK_DOCS = 1 << 24, 1 << 16
#: Documents of one window of block maxima.
WINDOW = 128
#: Postings that a query's short lists may hold together in a block.
SHORT = 1024
#: Postings that are opened before the k-th best score is looked at again; doubled each time.
STEP = 4096
#: (query, term) pairs of the queries that are searched, and broadcast, at once.
SHARD = 1 << 20


def spans(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """All positions of the ranges [start, stop), one range after the other."""
    size = stops - starts
    return np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _binary(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """Binary values of ``size`` items each, cut from ``data`` one after the other."""
    ends = np.zeros(len(size) + 1, dtype=np.int32)
    np.cumsum(size * data.itemsize, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def _term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, times) for each distinct term of each row, and the terms with repeats of each row."""
    rows, found = [], []
    size = np.zeros(len(texts), dtype=np.int64)
    for k, hashes in textkit.each_text(texts, textkit.PUNCTUATION):
        size[k] = len(hashes)
        if len(hashes):
            terms, times = np.unique(hashes, return_counts=True)
            rows.append(np.full(len(terms), k, dtype=np.int64))
            found.append((terms.view(np.int64), times))
    if not rows:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, size
    return np.concatenate(rows), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), size


def build(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The index of ``docs``, one row for each (block, term); the header of a block has no term.

    Columns: block, term, n (documents), docs and tfs (32-bit integers), ids, total (terms with
    repeats); a header holds the lengths of its documents in ``tfs``.
    """
    ids = docs.schema[key].dataType
    schema = T.StructType().add("block", "long").add("term", "long").add("n", "integer").add("docs", "binary").add("tfs", "binary").add("ids", T.ArrayType(ids)).add("total", "long")

    def index(number: int, held: list[tuple]) -> pa.RecordBatch:
        base = np.cumsum([0] + [len(h[0]) for h in held])
        own = pa.concat_arrays([h[0] for h in held])
        size = np.concatenate([h[4] for h in held])
        order = pc.sort_indices(own, null_placement="at_end").to_numpy()
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        doc = place[np.concatenate([h[1] + b for h, b in zip(held, base[:-1], strict=True)])]
        term, times = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
        at = np.lexsort((doc, term))
        doc, term, times = doc[at].astype(np.int32), term[at], times[at].astype(np.int32)
        first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
        width = np.diff(np.append(first, len(term)))
        n = len(first)
        header = pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([None], pa.int64()), pa.array([int((size > 0).sum())], pa.int32()), pa.array([None], pa.binary()), pa.array([size[order].astype(np.int32).tobytes()], pa.binary()), pa.ListArray.from_arrays([0, len(own)], own.take(pa.array(order))), pa.array([int(size.sum())], pa.int64())],
            names=schema.names,
        )
        lists = pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, number)), pa.array(term[first]), pa.array(width.astype(np.int32)), _binary(doc, width), _binary(times, width), pa.nulls(n, pa.list_(own.type)), pa.nulls(n, pa.int64())],
            names=schema.names,
        )
        return pa.Table.from_batches([header, lists.cast(header.schema)]).combine_chunks().to_batches()[0]

    def run(batches):
        number, held, n_bytes, n_docs = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            held.append((batch.column(0), *_term_counts(batch.column(1))))
            n_bytes, n_docs = n_bytes + batch.column(1).nbytes, n_docs + batch.num_rows
            if n_bytes >= BLOCK or n_docs >= BLOCK_DOCS:
                yield index(number, held)
                number, held, n_bytes, n_docs = number + 1, [], 0, 0
        if n_docs:
            yield index(number, held)

    return docs.select(key, text).mapInArrow(run, schema)


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(item, term): the distinct terms of each query."""
    schema = T.StructType().add("item", queries.schema[key].dataType).add("term", "long")

    def run(batches):
        for batch in batches:
            row, term, _, _ = _term_counts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(term)], names=["item", "term"])

    return queries.filter(F.col(key).isNotNull()).select(key, text).mapInArrow(run, schema).distinct()


@dataclass
class Queries:
    """Weighted queries: terms (sorted) with weights, and the term numbers of each query."""

    ids: pa.Array
    terms: np.ndarray
    weight: np.ndarray
    term: np.ndarray
    at: np.ndarray


class Block:
    """The lists of one index block with their scores and window maxima."""

    def __init__(self, ids: pa.Array, size: np.ndarray, term: np.ndarray, lists: list[tuple[bytes, bytes]], queries: Queries, n_all: int, total: int):
        order = np.argsort(term)
        number = np.searchsorted(queries.terms, term[order])
        width = np.array([len(lists[k][0]) // 4 for k in order], dtype=np.int64)
        self.ids = ids
        self.doc = np.frombuffer(b"".join(lists[k][0] for k in order), dtype=np.int32).astype(np.int64)
        tf = np.frombuffer(b"".join(lists[k][1] for k in order), dtype=np.int32).astype(np.int64)
        m = 100 - 50 + (50 * size.astype(np.int64) * n_all) // total
        self.score = (1_000_000_000 * tf) // (1000 * tf + 20 * m[self.doc]) * np.repeat(queries.weight[number], width)
        self.start = np.concatenate(([0], np.cumsum(width)))
        self.list_of = np.full(len(queries.terms), -1, dtype=np.int64)
        self.list_of[number] = np.arange(len(order))
        window = self.doc // WINDOW
        own = np.repeat(np.arange(len(order)), width)
        cut = np.flatnonzero(np.concatenate(([True], (window[1:] != window[:-1]) | (own[1:] != own[:-1]))))
        self.window, self.cut = window[cut], np.append(cut, len(self.doc))
        self.most = np.maximum.reduceat(self.score, cut)
        self.cut_at = np.searchsorted(own[cut], np.arange(len(order) + 1))
        self.windows = int(len(size) // WINDOW) + 1

    def maxima(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest score and range of postings for each of ``lists`` in each window."""
        most, start, stop = (np.zeros((len(lists), self.windows), dtype=np.int64) for _ in range(3))
        at = spans(self.cut_at[lists], self.cut_at[lists + 1])
        row = np.repeat(np.arange(len(lists)), self.cut_at[lists + 1] - self.cut_at[lists])
        most[row, self.window[at]], start[row, self.window[at]], stop[row, self.window[at]] = self.most[at], self.cut[at], self.cut[at + 1]
        return most, start, stop

    def search(self, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that reach ``least``, above 0, the k best of the block among them."""
        lists = self.list_of[terms]
        lists = lists[lists >= 0]
        none = np.zeros(0, dtype=np.int64)
        if not len(lists):
            return none, none
        least = max(least, 1)
        width = self.start[lists + 1] - self.start[lists]
        order = np.argsort(width, kind="stable")
        lists, width = lists[order], width[order]
        n_short = int(np.searchsorted(np.cumsum(width), SHORT, side="right"))

        # Term at a time: the short lists become one iterator of summed accumulators.
        at = spans(self.start[lists[:n_short]], self.start[lists[:n_short] + 1])
        docs, sums = summed(self.doc[at], self.score[at])
        if len(lists) == n_short:
            return cut_to(docs, sums, k, least)
        if len(sums) >= k:
            least = max(least, int(np.partition(sums, len(sums) - k)[len(sums) - k]))
        long = lists[n_short:]
        most, start, stop = self.maxima(long)
        head = np.zeros(self.windows, dtype=np.int64)
        np.maximum.at(head, docs // WINDOW, sums)
        edge = np.searchsorted(docs, np.arange(self.windows + 1) * WINDOW)
        # One table of postings for all iterators: the accumulators stand behind the long lists.
        most = np.vstack((most, head))
        start, stop = np.vstack((start, len(self.doc) + edge[:-1])), np.vstack((stop, len(self.doc) + edge[1:]))

        def opened(pairs: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            row, column = np.nonzero(pairs)
            low, high = start[row, windows[column]], stop[row, windows[column]]
            tail = row == len(long)
            a, b = spans(low[~tail], high[~tail]), spans(low[tail] - len(self.doc), high[tail] - len(self.doc))
            return np.concatenate((self.doc[a], docs[b])), np.concatenate((self.score[a], sums[b]))

        # Document at a time, window after window, in order of the documents.
        bound = most.sum(axis=0)
        postings = np.cumsum((stop - start).sum(axis=0))
        best, score = none, none
        now, step = 0, STEP
        while now < self.windows:
            upto = max(int(np.searchsorted(postings, (postings[now - 1] if now else 0) + step, side="right")), now + 1)
            windows = now + np.flatnonzero(bound[now:upto] >= least)
            now, step = upto, step * 2
            if not len(windows):
                continue
            rank = np.argsort(most[:, windows], axis=0)
            total = np.cumsum(np.take_along_axis(most[:, windows], rank, axis=0), axis=0)
            essential = np.zeros(rank.shape, dtype=bool)
            np.put_along_axis(essential, rank, total >= least, axis=0)
            found, part = summed(*opened(essential, windows))
            place = np.searchsorted(windows, found // WINDOW)
            rest = np.where(essential, 0, most[:, windows]).sum(axis=0)
            can = part + rest[place] >= least
            found, part, place = found[can], part[can], place[can]
            others = ~essential & (stop[:, windows] > start[:, windows])
            others &= np.bincount(place, minlength=len(windows)) > 0
            if others.any():
                doc, more = opened(others, windows)
                to = np.searchsorted(found, doc)
                hit = (to < len(found)) & (found[np.minimum(to, len(found) - 1)] == doc)
                np.add.at(part, to[hit], more[hit])
            best, score = cut_to(np.concatenate((best, found)), np.concatenate((score, part)), k, least)
            if len(score) >= k:
                least = max(least, int(score.min()))
        return best, score


def summed(docs: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents in ascending order, each once, with the sums of their scores."""
    if not len(docs):
        return docs, scores
    order = np.argsort(docs, kind="stable")
    docs = docs[order]
    first = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
    return docs[first], np.add.reduceat(scores[order], first)


def cut_to(docs: np.ndarray, scores: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Those that reach ``least``; of more than k the k best, ties by place in the block."""
    keep = scores >= least
    docs, scores = docs[keep], scores[keep]
    if len(docs) > k:
        best = np.lexsort((docs, -scores))[:k]
        docs, scores = docs[best], scores[best]
    return docs, scores


def _blocks(batches) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, list]]:
    """(ids, lengths, terms, lists) of one block after the other; the header comes first."""
    now, ids, size, terms, lists = None, None, None, [], []
    for batch in batches:
        block, term, docs, tfs = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
        for r in range(batch.num_rows):
            if block[r] != now:
                if lists:
                    yield ids, size, np.array(terms, dtype=np.int64), lists
                now, terms, lists = block[r], [], []
            if term[r] is None:
                ids, size = batch.column(5)[r].values, np.frombuffer(tfs[r], dtype=np.int32)
            else:
                terms.append(term[r])
                lists.append((docs[r], tfs[r]))
    if lists:
        yield ids, size, np.array(terms, dtype=np.int64), lists


def _best_of(batches, queries: Queries, k: int, n_all: int, total: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The k best documents of each query over all blocks of a task."""
    held: dict[int, tuple[pa.Array, np.ndarray]] = {}
    for ids, size, terms, lists in _blocks(batches):
        asked = np.flatnonzero(np.isin(terms, queries.terms))  # other shards' terms have lists here too
        if not len(asked):
            continue
        terms, lists = terms[asked], [lists[k] for k in asked]
        block = Block(ids, size, terms, lists, queries, n_all, total)
        for q in range(len(queries.ids)):
            own = held.get(q)
            least = int(own[1].min()) if own is not None and len(own[1]) >= k else 1
            docs, score = block.search(queries.term[queries.at[q] : queries.at[q + 1]], k, least)
            if not len(docs):
                continue
            found = ids.take(pa.array(docs))
            if own is not None:
                found, score = pa.concat_arrays([own[0], found]), np.concatenate((own[1], score))
            if len(score) > k:
                rows = pa.RecordBatch.from_arrays([pa.array(-score), found], names=["score", "id"])
                best = pc.sort_indices(rows, sort_keys=[("score", "ascending"), ("id", "ascending")], null_placement="at_end")[:k]
                found, score = found.take(best), score[best.to_numpy()]
            held[q] = found, score
    if held:
        query = np.repeat(list(held), [len(h[1]) for h in held.values()])
        found = pa.concat_arrays([h[0] for h in held.values()])
        yield pa.RecordBatch.from_arrays([queries.ids.take(pa.array(query)), found, pa.array(np.concatenate([h[1] for h in held.values()]))], names=names)


def search(lists: DataFrame, queries: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(item, rank, id, score): the k best documents of an index (see ``build``) for each query."""
    spark = lists.sparkSession
    schema = T.StructType().add("item", queries.schema[key].dataType).add("id", lists.schema["ids"].dataType.elementType).add("score", "long")
    asked = written(query_terms(queries, key, text), "ranked-queries")
    wanted = asked.select("term").distinct().withColumn("wanted", F.lit(True))
    # A left join keeps the headers, which have no term; Spark broadcasts the terms if they are small enough.
    kept = lists.join(wanted, "term", "left").filter(F.col("term").isNull() | F.col("wanted")).select(*lists.columns)
    kept = written(kept, "ranked-lists")
    n_all, total = kept.filter("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long"), F.coalesce(F.sum("total"), F.lit(0))).first()
    df = kept.filter("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
    weighted = written(asked.join(df, "term"), "ranked-weights")
    shards = weighted.count() // (SHARD // 2) + 1
    dealt = kept.select("block", "term", "n", "docs", "tfs", "ids").repartition("block").sortWithinPartitions("block", F.col("term").asc_nulls_first())
    out = spark.createDataFrame([], schema)
    for shard in range(shards if total else 0):
        part = weighted if shards == 1 else weighted.filter(F.pmod(F.xxhash64("item"), F.lit(shards)) == shard)
        got = part.toArrow()  # about SHARD pairs at most, but for chance
        if not got.num_rows:
            continue
        items, item = np.unique(got["item"].combine_chunks().dictionary_encode().indices.to_numpy(), return_inverse=True)
        own = got["item"].combine_chunks().dictionary_encode().dictionary.take(pa.array(items))
        terms, term = np.unique(got["term"].to_numpy(), return_inverse=True)
        count = np.zeros(len(terms), dtype=np.int64)
        count[term] = got["df"].to_numpy()
        weight = np.floor(1000 * np.log((2 * n_all + 2) / (2 * count + 1))).astype(np.int64)
        order = np.argsort(item, kind="stable")
        held = spark.sparkContext.broadcast(Queries(own, terms, weight, term[order], np.searchsorted(item[order], np.arange(len(items) + 1))))

        def run(batches, held=held):
            yield from _best_of(batches, held.value, k, n_all, total, schema.names)

        found = written(dealt.mapInArrow(run, schema), "ranked-found")
        held.destroy()
        out = out.unionByName(found)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item", "rank", "id", "score")
