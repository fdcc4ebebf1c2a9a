"""Substring dedup by relative Lempel-Ziv parsing: runs of words that occur twice are removed.

A text's factors are looked for in reference blocks. So that a text need not be parsed against
every block, blocks are made by content: a window of ``words`` words belongs to the block of
its anchor, the smallest 64-bit hash of ``ANCHOR`` words in it. Equal windows have equal
anchors, so in all blocks but one a window can only yield a factor that is too short.
Consecutive windows with one anchor travel as one passage, a row of window hashes, and
passages that agree within a batch of texts travel once, with the places they stand at.

Spark deals the passages out by anchor, sorted. A task indexes the windows of a block of them and
factors each passage greedily against the block: from the first window that stands
elsewhere too the factor goes on for as long as the source goes on in the same way; where it ends,
the windows across the boundary are looked up again, and a new factor starts at the first that
is found. Every factor has at least ``words`` words and is a duplicate span of all the places of
its passage, the source's own places included. Spans meet their texts by digest; a word in any
span is removed.

An anchor that many texts share with different words around it would make a large group. Anchors
that are frequent in a bounded sample (``SAMPLE_ROWS``) are therefore refined: their windows
travel alone, dealt out by the window's own hash; a group of more than ``GROUP`` passages that
the sample did not show goes through a second round in the same way. Both change the route only,
never the result. Windows are compared as 64-bit hashes within equal 64-bit anchors.

Defined results: null and empty texts and texts without a word have no words and keep the empty
text; texts with fewer words than a window lose nothing; rows with equal texts, whatever
their ids, are each other's copies, so with at least ``words`` words they lose all of them; kept
words are joined by single spaces; other columns pass through, and result columns whose names are
taken get underscores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candleframe.llm import textkit
from candleframe.llm.common import free_name, written
from candleframe.llm.langid import sample_of

#: Words of an anchor, and windows of one passage at most.
ANCHOR, LONGEST = 8, 64
#: Rows, at most (about), of the sample that shows frequent anchors; texts in it, of 1,000 and at least, that make an anchor frequent; anchors refined at most.
SAMPLE_ROWS, FREQUENT, LEAST, REFINED = 20_000, 2, 32, 1 << 16
#: Passages of one anchor that a task holds at once.
GROUP = 1 << 15

_U = np.uint64
_PLACE = np.dtype([("key", "V16"), ("start", "<i4")])
_PASSAGES = "anchor long, hashes binary, places binary"
_SPANS = "key binary, start int, stop int"


def keyed(df: DataFrame, text: str, key: str) -> DataFrame:
    """``df`` with 16 bytes of its texts' SHA-256 as column ``key``; null counts as empty."""
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    return df.withColumn(key, F.substring(digest, 1, 16))


def _after(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return textkit.mix(a * _U(0x9E3779B97F4A7C15) + b)


def runs_of(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words, put together from runs of powers of two."""
    count = len(h) - n + 1
    if count < 1:
        return h[:0]
    out, at, size, run = None, 0, 1, h
    while at < n:
        if n & size:
            part = run[at : at + count]
            out = part if out is None else _after(out, part)
            at += size
        if at < n:
            run, size = _after(run[:-size], run[size:]), size * 2
    return out


def least_of(a: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each ``n`` consecutive values."""
    count, size = len(a) - n + 1, 1
    while size * 2 <= n:
        a, size = np.minimum(a[:-size], a[size:]), size * 2
    return np.minimum(a[:count], a[n - size : n - size + count])


def spans(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """All positions of the ranges [start, stop), one range after the other."""
    size = stops - starts
    return np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column, as they are written, and where each text begins and ends in them."""
    found, bounds = [], [0]
    for start, stop, raw, offsets in textkit.chunks(texts):
        a, b = textkit.words(raw, offsets)
        found.append(textkit.word_hashes(raw, a, b, textkit.AS_IS))
        bounds.extend((bounds[start] + np.searchsorted(a, offsets[1:])).tolist())
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.array(bounds, dtype=np.int64)


def windows(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, anchor, hash) of every window of a text column, in order."""
    h, bounds = _hashes(texts)
    count = np.maximum(np.diff(bounds) - words + 1, 0)
    at = spans(bounds[:-1], bounds[:-1] + count)
    row = np.repeat(np.arange(len(count)), count)
    if not len(at):
        return row, at, at, at.astype(np.uint64)
    size = min(ANCHOR, words)
    anchor = least_of(runs_of(h, size), words - size + 1)
    return row, at - bounds[row], anchor[at].view(np.int64), runs_of(h, words)[at]


def passages_of(texts: pa.Array, keys: pa.Array, words: int, refined: np.ndarray) -> pa.RecordBatch | None:
    """The passages of a batch of texts, those that agree once, with all their places."""
    row, start, anchor, window = windows(texts, words)
    if not len(row):
        return None
    alone = np.isin(anchor, refined) if len(refined) else np.zeros(len(row), bool)
    anchor = np.where(alone, textkit.mix(anchor.view(np.uint64) ^ window).view(np.int64), anchor)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1]) | alone[1:] | alone[:-1]
    nth = np.arange(len(row)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    new |= nth % LONGEST == 0
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(row)))
    nth = (nth % LONGEST).astype(np.uint64)
    look = np.add.reduceat(textkit.mix(window + nth * _U(0x9E3779B97F4A7C15)), first)
    look = textkit.mix(look ^ anchor[first].view(np.uint64) ^ size.astype(np.uint64))
    order = np.argsort(look, kind="stable")
    fresh = np.ones(len(order), bool)
    same = lambda a: a[order[1:]] == a[order[:-1]]
    fresh[1:] = ~(same(look) & same(anchor[first]) & same(size))
    kept = order[fresh]
    copies = np.diff(np.append(np.flatnonzero(fresh), len(order)))
    place = np.zeros(len(order), dtype=_PLACE)
    place["key"] = np.frombuffer(b"".join(keys.to_pylist()), dtype="V16")[row[first[order]]]
    place["start"] = start[first[order]]
    hashes = window[spans(first[kept], first[kept] + size[kept])]
    return pa.RecordBatch.from_arrays([pa.array(anchor[first[kept]]), _binary(hashes.tobytes(), size[kept] * 8), _binary(place.tobytes(), copies * _PLACE.itemsize)], names=["anchor", "hashes", "places"])


def _binary(data: bytes, size: np.ndarray) -> pa.Array:
    ends = np.zeros(len(size) + 1, dtype=np.int32)
    np.cumsum(size, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _content(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column, one after the other, and how many each row has."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]] if column.buffers()[2] else np.zeros(0, np.uint8)
    return data.view(kind), np.diff(ends) // np.dtype(kind).itemsize


def frequent_anchors(texts: DataFrame, key: str, text: str, words: int) -> np.ndarray:
    """Anchors that are frequent in a bounded sample of the texts, sorted."""
    sample = sample_of(texts, F.col(key), SAMPLE_ROWS).select(text)

    def run(batches):
        for batch in batches:
            row, _, anchor, _ = windows(batch.column(0), words)
            one = np.unique(np.rec.fromarrays((anchor, row)))
            yield pa.RecordBatch.from_arrays([pa.array(one.f0.astype(np.int64) if len(one) else np.zeros(0, np.int64)), pa.array(np.ones(len(one), np.int64))], names=["anchor", "n"])

    n = sample.count()
    counts = sample.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    most = counts.filter(F.col("n") >= max(LEAST, n * FREQUENT // 1000)).orderBy(F.desc("n"), "anchor").limit(REFINED)
    return np.sort(most.toArrow()["anchor"].to_numpy())


def passages(texts: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(anchor, hashes, places) of all windows of all texts."""
    held = texts.sparkSession.sparkContext.broadcast(frequent_anchors(texts, key, text, words))

    def run(batches):
        for batch in batches:
            out = passages_of(batch.column(1), batch.column(0), words, held.value)
            if out is not None:
                yield out

    return texts.select(key, text).mapInArrow(run, _PASSAGES)


def factors(anchor: np.ndarray, size: np.ndarray, window: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, first window, windows) of the factors of a block's passages against the block.

    The index is the order of the windows by hash. A window's source is the next equal one in that
    order, the last one's the first; a passage with several places is its own source.
    """
    row = np.repeat(np.arange(len(size)), size)
    begin = np.cumsum(size) - size
    mark = textkit.mix(window ^ textkit.mix(anchor.view(np.uint64))[row])
    order = np.argsort(mark, kind="stable")
    equal = (mark[order][1:] == mark[order][:-1]) & (window[order][1:] == window[order][:-1]) & (anchor[row[order]][1:] == anchor[row[order]][:-1])
    fresh = np.concatenate(([True], ~equal))
    head = np.flatnonzero(fresh)
    last = np.append(head[1:], len(order)) - 1
    source = np.empty(len(order), dtype=np.int64)
    source[order[:-1]] = order[1:]
    source[order[last]] = order[head]
    here = np.arange(len(order))
    source = np.where((source == here) & (copies[row] < 2), -1, source)
    # A factor goes on while its source does, in one passage; else the next window's lookup starts a new one.
    goes_on = np.zeros(len(order), bool)
    goes_on[1:] = (source[1:] >= 0) & (source[:-1] >= 0) & (row[1:] == row[:-1]) & (source[1:] == source[:-1] + 1)
    start = np.flatnonzero((source >= 0) & ~goes_on)
    length = np.diff(np.append(np.flatnonzero(~goes_on), len(order)))[np.searchsorted(np.flatnonzero(~goes_on), start)]
    return row[start], start - begin[row[start]], length


def _found(rows: pa.Table, words: int) -> pa.RecordBatch:
    """Duplicate spans (key, start, stop) of all places of the factors of complete anchor groups."""
    rows = rows.combine_chunks()
    column = lambda k: rows.column(k).chunk(0) if rows.num_rows else pa.array([], rows.schema[k].type)
    window, size = _content(column(1), "<u8")
    place, copies = _content(column(2), _PLACE)
    at, first, length = factors(column(0).to_numpy(), size, window, copies)
    begin = np.cumsum(copies) - copies
    each = spans(begin[at], begin[at] + copies[at])
    start = place["start"][each] + np.repeat(first, copies[at])
    stop = start + np.repeat(length, copies[at]) + words - 1
    key = _binary(place["key"][each].tobytes(), np.full(len(each), 16))
    return pa.RecordBatch.from_arrays([key, pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], names=["key", "start", "stop"])


def _alone(rows: pa.Table) -> pa.RecordBatch:
    """The windows of passages, each as a passage of its own, to be dealt out by their own hashes."""
    rows = rows.combine_chunks()
    window, size = _content(rows.column(1).chunk(0), "<u8")
    place, copies = _content(rows.column(2).chunk(0), _PLACE)
    row = np.repeat(np.arange(len(size)), size)
    nth = np.arange(len(row)) - (np.cumsum(size) - size)[row]
    begin = np.cumsum(copies) - copies
    own = place[spans(begin[row], begin[row] + copies[row])]
    own["start"] += np.repeat(nth, copies[row]).astype(np.int32)
    anchor = rows.column(0).chunk(0).to_numpy()[row].view(np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(textkit.mix(anchor ^ window).view(np.int64)), _binary(window.tobytes(), np.full(len(row), 8)), _binary(own.tobytes(), copies[row] * _PLACE.itemsize)], names=["anchor", "hashes", "places"])


def _groups(batches, limit: int) -> Iterator[tuple[bool, pa.Table]]:
    """Complete groups of rows with one anchor, many at a time; a group of more than ``limit`` rows in parts, marked."""
    held, large = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        anchor = held.column(0).to_numpy()
        if large is not None:
            n = int(np.searchsorted(anchor != large, True)) if (anchor != large).any() else len(anchor)
            if n:
                yield True, held.slice(0, n)
                held, anchor = held.slice(n), anchor[n:]
            if not len(anchor):
                continue
            large = None
        cut = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1 if anchor[0] != anchor[-1] else 0
        if cut:
            yield False, held.slice(0, cut)
            held = held.slice(cut)
        if held.num_rows > limit:
            large = anchor[-1]
            yield True, held
            held = held.slice(held.num_rows)
    if held is not None and held.num_rows:
        yield large is not None, held


def duplicate_spans(found: DataFrame, words: int) -> DataFrame:
    """(key, start, stop): words of texts that are covered by windows standing elsewhere too."""
    names = ["anchor", "hashes", "places", "key", "start", "stop"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]

    def wide(part: pa.RecordBatch) -> pa.RecordBatch:
        own = dict(zip(part.schema.names, part.columns, strict=True))
        return pa.RecordBatch.from_arrays([own.get(n, pa.nulls(part.num_rows, t)) for n, t in zip(names, kinds, strict=True)], names=names)

    def parse(batches):
        for large, rows in _groups(batches, GROUP):
            yield wide(_alone(rows) if large else _found(rows, words))

    def parse_alone(batches):
        for large, rows in _groups(batches, GROUP):
            if large:  # equal windows, more than one of them: each place is a factor
                rows = pa.table([rows.column(0), rows.column(1), rows.column(2)], names=names[:3])
                yield _every_place(rows, words)
            else:
                yield _found(rows, words)

    dealt = lambda rows: rows.repartition("anchor").sortWithinPartitions("anchor")
    first = written(dealt(found).mapInArrow(parse, f"{_PASSAGES}, {_SPANS}"), "substring-factors")
    once = first.filter("key is not null").select("key", "start", "stop")
    again = first.filter("key is null").select("anchor", "hashes", "places")
    if again.isEmpty():
        return once
    return once.unionByName(dealt(again).mapInArrow(parse_alone, _SPANS))


def _every_place(rows: pa.Table, words: int) -> pa.RecordBatch:
    place, _ = _content(rows.combine_chunks().column(2).chunk(0), _PLACE)
    start = place["start"].astype(np.int32)
    return pa.RecordBatch.from_arrays([_binary(place["key"].tobytes(), np.full(len(place), 16)), pa.array(start), pa.array(start + np.int32(words))], names=["key", "start", "stop"])


def without(texts: pa.Array, listed: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(words, removed words, kept words joined by single spaces) of each text, given its spans."""
    lists = listed.fill_null([]) if listed.null_count else listed
    ends = lists.offsets.to_numpy()
    flat = lists.values
    begin, end = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    n_words, n_removed, size, parts = [], [], [], []
    for start, stop, raw, offsets in textkit.chunks(texts):
        a, b = textkit.words(raw, offsets)
        bounds = np.searchsorted(a, offsets)
        count = np.diff(bounds)
        own = slice(ends[start], ends[stop])
        base = np.repeat(bounds[:-1], np.diff(ends[start : stop + 1]))
        depth = np.zeros(len(a) + 1, dtype=np.int64)
        np.add.at(depth, base + begin[own], 1)
        np.add.at(depth, base + end[own], -1)
        keep = np.flatnonzero(np.cumsum(depth)[:-1] == 0)
        row = np.repeat(np.arange(stop - start), count)[keep]
        last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
        length = b[keep] - a[keep]
        to = np.cumsum(length + ~last) - (length + ~last)
        out = np.full(int((length + ~last).sum()), 32, dtype=np.uint8)
        out[spans(to, to + length)] = raw[spans(a[keep], b[keep])]
        n_words.append(count)
        n_removed.append(count - np.bincount(row, minlength=stop - start))
        size.append(np.bincount(row, length + ~last, minlength=stop - start).astype(np.int64))
        parts.append(out.tobytes())
    none = [np.zeros(0, np.int64)]
    kept = _binary(b"".join(parts), np.concatenate(size or none)).cast(pa.string())
    return np.concatenate(n_words or none), np.concatenate(n_removed or none), kept


def clean_texts(df: DataFrame, key: str, text: str, words: int = 35) -> DataFrame:
    """(key, n_words, n_removed, kept) for each distinct text of ``df``; ``key`` is its digest (see ``keyed``)."""
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = duplicate_spans(passages(rows, "key", "text", words), words)
    # Places of copies name their common digest: equal spans meet in the map tasks.
    lists = found.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    texts = rows.groupBy("key").agg(F.first("text").alias("text")).join(lists, "key", "left")

    def run(batches):
        for batch in batches:
            n_words, n_removed, kept = without(batch.column(1), batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), kept], names=["key", "n_words", "n_removed", "kept"])

    return texts.select("key", "text", "spans").mapInArrow(run, "key binary, n_words long, n_removed long, kept string")


def remove_repeats(df: DataFrame, text: str, words: int = 35) -> DataFrame:
    """``df`` with repeated runs of words taken out of ``text``, and the columns n_words and n_removed."""
    key, n_words, n_removed, kept = (free_name(df, c) for c in ("key", "n_words", "n_removed", "kept"))
    rows = keyed(df, text, key)
    clean = clean_texts(rows, key, text, words).toDF(key, n_words, n_removed, kept)
    out = rows.join(clean, key).select(*(F.col(kept).alias(c) if c == text else F.col(c) for c in df.columns), n_words, n_removed)
    return out
