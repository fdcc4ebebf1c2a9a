"""Line de-duplication by an exact set-similarity join.

A line's set holds its distinct words (as in ``textkit``). Two lines match if the Jaccard
similarity of their sets reaches the threshold; a line goes if an earlier line matches it,
earlier by document id, then row, then line number. Lines with equal sets are one class,
named by its earliest line, so exact repeats never meet in pairs.

The join of classes: words are ordered by rarity (how often the word's hash bucket, of
2,097,152, occurs in all lines; ties by hash), and a class is listed under the first
n - ceil(t n) + 1 of its words only, which any two matching classes share, but not under
words that a single line has. Under each word a length filter, a positional filter and
bitmaps of the sets rule out what cannot match; nothing that can match is lost. Words give
the pairs that are left, each once for all the words it shares; words with many pairs for
their classes give the classes instead, which are compared in one block. The words of the
classes that are left are read from the texts again, and the similarity is verified on the
full sets; a block reports classes that have an earlier match. Words whose bucket is
frequent are split into parts of classes; a group holds two parts, or one, and compares the
classes of one part with those of the other, so no task holds a whole frequent word.

Defined results: lines end at newlines; lines without a word are kept, and match nothing;
null and empty texts have no lines; rows equal in id and text are one document and lose the
same lines; a null id sorts first; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candleframe.llm import textkit
from candleframe.llm.common import release, written

BITS = 21
BUCKETS = 1 << BITS
#: Buckets whose occurrences travel in one row.
SLICE = 1 << 14
#: Occurrences of a bucket from which its words are split into blocks of about so many lines.
FREQUENT = 20_000
#: Pairs for each class of a word up to which it gives pairs; classes under a word up to which the words of a task are compared together.
PAIRS, SMALL = 4, 64
#: Rows of the listing that are compared at once, at least, if a task has so many.
AT_ONCE = 1 << 16
#: Rows of a group up to which it is verified together with other groups.
SMALL_GROUP = 32
#: Classes that a task remembers as listed, at most.
SEEN = 1 << 20
#: Lengths and positions are packed in 12 bits; a longer line counts as this long, and its filters are left out.
MOST = 4095
#: Lines of more words than this get two 64-bit bitmaps.
LONG = 48

_U = np.uint64


class Lines(NamedTuple):
    """The lines with a word of some texts: row, number in the row, first word, number of words; sorted distinct words by line."""

    row: np.ndarray
    number: np.ndarray
    start: np.ndarray
    size: np.ndarray
    words: np.ndarray

    def of_line(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size)), self.size)

    def of(self, at: np.ndarray) -> Lines:
        """The lines ``at`` (ascending) alone."""
        size = self.size[at]
        start = np.cumsum(size) - size
        words = self.words[np.repeat(self.start[at] - start, size) + np.arange(size.sum())]
        return Lines(self.row[at], self.number[at], start, size, words)


def _by_line(line: np.ndarray) -> np.ndarray:
    small = line.astype(np.uint16) if len(line) and line.max() < 1 << 16 else line  # radix sort
    return np.argsort(small, kind="stable")


def _sorted_in(line: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The order of 64-bit values by line, lines being numbers that ascend."""
    if len(line) and line[-1] < 1 << 16:
        order = np.argsort((line.astype(np.uint64) << _U(48)) | (value >> _U(16)))
        v = value[order]
        if not ((v[1:] < v[:-1]) & (line[1:] == line[:-1])).any():  # values may differ in their last 16 bits alone
            return order
    return np.lexsort((value, line))


def line_sets(texts: pa.Array) -> Iterator[Lines]:
    """Lines of chunks of a text column."""
    for first, _, raw, offsets in textkit.chunks(texts):
        a, b = textkit.words(raw, offsets)
        if not len(a):
            continue
        h = textkit.word_keys(raw, a, b)
        newline = np.flatnonzero(raw == 10)
        begin = np.concatenate((offsets[:-1], newline + 1))
        row = np.concatenate((np.arange(len(offsets) - 1), np.searchsorted(offsets, newline, side="right") - 1))
        order = np.lexsort((row, begin))
        begin, row = begin[order], row[order]
        number = np.arange(len(row)) - np.searchsorted(row, row)
        size = np.diff(np.append(np.searchsorted(a, begin), len(a)))
        own = np.flatnonzero(size)
        line = np.repeat(np.arange(len(own)), size[own])
        h = h[_sorted_in(line, h)]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (line[1:] != line[:-1])))
        h, line = h[new], line[new]
        start = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
        yield Lines(first + row[own], number[own], start, np.diff(np.append(start, len(h))), h)


def set_keys(lines: Lines) -> np.ndarray:
    """A 64-bit name of the set of each line."""
    place = (np.arange(len(lines.words)) - np.repeat(lines.start, lines.size)).astype(np.uint64)
    total = np.add.reduceat(textkit.mix(lines.words) * (_U(2) * place + _U(1)), lines.start)
    return textkit.mix(total + lines.size.astype(np.uint64)).view(np.int64)


def line_table(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Lines (id, doc, line, class, number of lines of the row) and the occurrences of each word bucket in them, from one pass.

    Rows equal in id and text are not told apart here: each gives the same lines, under the same doc.
    """

    def run(batches):
        names = ["id", "doc", "line", "class", "n", "counts"]
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for lines in line_sets(batch.column(2)):
                total += np.bincount((lines.words & _U(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                at = pa.array(lines.row)
                n = np.bincount(lines.row)[lines.row]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(lines.number, pa.int32()), pa.array(set_keys(lines)), pa.array(n), pa.nulls(len(at), pa.binary())], names=names)
        part, counts = [], []
        for k in range(BUCKETS // SLICE):  # bucket and number of those that occur
            own = total[k * SLICE : (k + 1) * SLICE]
            at = np.flatnonzero(own)
            if len(at):
                part.append(k)
                counts.append(np.stack((at, own[at])).tobytes())
        none = pa.nulls(len(part), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(part), pa.int32()), pa.array(part, pa.int64()), none, pa.array(counts, pa.binary())], names=names)

    def summed(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, n = np.frombuffer(counts, dtype=np.int64).reshape(2, -1)
                total.setdefault(k, np.zeros(SLICE, dtype=np.int64))[at] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([t.tobytes() for t in total.values()], pa.binary())], names=["class", "counts"])

    table = written(docs.select("id", "doc", "text").mapInArrow(run, "id long, doc long, line int, class long, n long, counts binary"), "lines")
    sums = table.filter("counts IS NOT NULL").select("class", "counts").repartition("class").mapInArrow(summed, "class long, counts binary")
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for r in sums.collect():  # 128 rows of 128 KB
        counts[r["class"] * SLICE : (r["class"] + 1) * SLICE] = np.frombuffer(r["counts"], dtype=np.int64)
    return table.filter("counts IS NULL").drop("counts"), counts


def listing(docs: DataFrame, counts: np.ndarray, percent: int, frequent: int) -> DataFrame:
    """Classes under their prefix words.

    ``word`` packs 40 bits of the word, the class's length and the word's position; ``block``
    names the two parts of a frequent word that meet, ``role`` the side of the class (1 or 2, 0
    where a part meets itself); a class is listed once by a task, or again where ``SEEN`` are
    held; ``low`` and
    ``high`` are bitmaps of the set's words by their first bit, in ``low`` alone for short lines.
    """
    rank = np.empty(BUCKETS, dtype=np.uint32)
    order = np.argsort(counts, kind="stable")
    rank[order] = np.arange(BUCKETS)
    ones, hot = np.searchsorted(counts[order], [1, frequent], "right")  # ranks from which words are in two lines or more, and split
    held = docs.sparkSession.sparkContext.broadcast((rank, int(ones), int(hot), counts[order[hot:]] // frequent + 1))

    def rows(lines: Lines, key: np.ndarray) -> list[np.ndarray]:
        rank, ones, hot, n_parts = held.value
        ranks = rank[(lines.words & _U(BUCKETS - 1)).astype(np.int64)]
        of = lines.of_line()
        order = _sorted_in(of, (ranks.astype(np.uint64) << _U(64 - BITS)) | (lines.words >> _U(BITS)))
        place = np.arange(len(of)) - lines.start[of]
        ranks = ranks[order]
        keep = (place < (lines.size - (percent * lines.size + 99) // 100 + 1)[of]) & (ranks >= ones)
        of, place, word, ranks = of[keep], place[keep], lines.words[order[keep]], ranks[keep]
        packed = (word & ~_U((1 << 24) - 1)) | (np.minimum(lines.size, MOST)[of].astype(np.uint64) << _U(12)) | np.minimum(place, MOST).astype(np.uint64)
        bit = _U(1) << ((lines.words >> _U(57)) & _U(63))
        upper = (lines.words >> _U(63)).astype(bool) & np.repeat(lines.size > LONG, lines.size)
        low = np.bitwise_or.reduceat(np.where(upper, _U(0), bit), lines.start)
        high = np.bitwise_or.reduceat(np.where(upper, bit, _U(0)), lines.start)
        block, role = np.zeros(len(of), dtype=np.int64), np.zeros(len(of), dtype=np.int8)
        split = np.flatnonzero(ranks >= hot)
        if len(split):
            parts = n_parts[ranks[split] - hot]
            again = np.repeat(split, parts)
            own = np.repeat((key[of[split]] & 0x7FFFFFFF) % parts, parts)
            other = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
            rest = np.flatnonzero(ranks < hot)
            meet = np.minimum(own, other) * np.repeat(parts, parts) + np.maximum(own, other)
            block = np.concatenate((block[rest], meet))
            role = np.concatenate((role[rest], np.where(own == other, 0, np.where(own < other, 1, 2)).astype(np.int8)))
            of, packed = np.concatenate((of[rest], of[again])), np.concatenate((packed[rest], packed[again]))
        return [packed.view(np.int64), key[of], block, role, low.view(np.int64)[of], high.view(np.int64)[of]]

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for lines in line_sets(batch.column(0)):
                key, at = np.unique(set_keys(lines), return_index=True)
                new = np.array([k not in seen for k in key.tolist()])
                if not new.any():
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.update(key[new].tolist())
                lines, key = lines.of(np.sort(at[new])), key[new][np.argsort(at[new])]
                columns = rows(lines, key)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["word", "class", "block", "role", "low", "high"])

    return docs.select("text").mapInArrow(run, "word long, class long, block long, role byte, low long, high long")


class Listed(NamedTuple):
    """A part of the listing by group (word and block) and class, unpacked; whole groups only."""

    group: np.ndarray
    cls: np.ndarray
    role: np.ndarray
    size: np.ndarray
    place: np.ndarray
    low: np.ndarray
    high: np.ndarray


def unpack(columns: list[np.ndarray]) -> Listed:
    """``columns`` (group, class, info, low, high), sorted by group."""
    group = columns[0]
    number = np.cumsum(np.concatenate(([0], group[1:] != group[:-1])))
    order = _sorted_in(number, columns[1].view(np.uint64))
    group, cls, info, low, high = (c[order] for c in columns)
    one = np.concatenate(([True], (group[1:] != group[:-1]) | (cls[1:] != cls[:-1])))  # a class listed by several tasks counts once
    value = info[one].astype(np.int64)
    return Listed(group[one], cls[one], (value >> 24).astype(np.int8), (value >> 12) & MOST, value & MOST, low[one].view(np.uint64), high[one].view(np.uint64))


def can_match(t: Listed, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether rows x and y may match if their word is the first that they share."""
    roles = t.role[x] + t.role[y]
    good = (t.cls[x] != t.cls[y]) & ((roles == 0) | (roles == 3))  # one is a member, one a probe
    nx, ny = t.size[x], t.size[y]
    need = -(-percent * (nx + ny) // (100 + percent))  # least overlap at the threshold
    fits = (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) & (np.minimum(nx - t.place[x], ny - t.place[y]) >= need)
    fits |= (nx >= MOST) | (ny >= MOST)  # their true lengths and places are not known here
    at = np.flatnonzero(good & fits)
    x, y, nx, ny = x[at], y[at], nx[at], ny[at]
    two = (nx > LONG) & (ny > LONG)
    la, lb = np.where(two, t.low[x], t.low[x] | t.high[x]), np.where(two, t.low[y], t.low[y] | t.high[y])
    ha, hb = np.where(two, t.high[x], _U(0)), np.where(two, t.high[y], _U(0))
    only = lambda p, q, r, s: np.bitwise_count(p & ~q).astype(np.int64) + np.bitwise_count(r & ~s)
    most = np.minimum(nx - only(la, lb, ha, hb), ny - only(lb, la, hb, ha))
    capped = (nx >= MOST) | (ny >= MOST)
    out = np.zeros(len(good), dtype=bool)
    out[at] = (most >= need[at]) | capped
    return out


def near(columns: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, Listed, np.ndarray]:
    """Pairs of rows under words with few pairs, and rows with a partner under the other words."""
    t = unpack(columns)
    keep = np.zeros(len(t.group), dtype=bool)
    start = np.flatnonzero(np.concatenate(([True], t.group[1:] != t.group[:-1])))
    count = np.diff(np.append(start, len(t.group)))
    left, right = [], []
    each, number = np.repeat(count, count), np.repeat(np.arange(len(count)), count)
    offset = np.arange(len(t.group)) - np.repeat(start, count)
    small = np.flatnonzero((each > 1) & (each <= SMALL))
    step = 1
    while len(small):
        small = small[offset[small] + step < each[small]]
        x = small[can_match(t, small, small + step, percent)]
        left.append(x)
        right.append(x + step)
        step += 1
    cat = lambda p: np.concatenate(p) if p else np.zeros(0, dtype=np.int64)
    x, y = cat(left), cat(right)
    keep[x] = keep[y] = True
    pairs, classes = np.bincount(number[x], minlength=len(count)), np.bincount(number[keep], minlength=len(count))
    few = pairs <= PAIRS * classes
    keep &= ~few[number]
    x, y = x[few[number[x]]], y[few[number[x]]]
    for begin, n in zip(start[count > SMALL].tolist(), count[count > SMALL].tolist(), strict=True):
        rows = np.arange(begin, begin + n)
        one, two = (rows, rows) if not t.role[begin] else (rows[t.role[rows] == 1], rows[t.role[rows] == 2])
        two = two[np.argsort(t.size[two], kind="stable")]
        # Lengths that can match: the second at least the threshold's share of the first, and the other way.
        # A length that is cut to MOST stands for itself or more, which this does not rule out.
        low = np.searchsorted(t.size[two], -(-percent * t.size[one] // 100), "left")
        high = np.searchsorted(t.size[two], t.size[one] * 100 // percent, "right")
        if one is rows:  # each pair once
            one = two
            low = np.arange(n) + 1
            high = np.maximum(np.searchsorted(t.size[two], t.size[two] * 100 // percent, "right"), low)
        upto = np.cumsum(high - low)
        k = 0
        while k < len(one):
            to = max(int(np.searchsorted(upto, (upto[k - 1] if k else 0) + (1 << 19), "right")), k + 1)
            wide = high[k:to] - low[k:to]
            p = np.repeat(one[k:to], wide)
            q = two[np.repeat(low[k:to] - (np.cumsum(wide) - wide), wide) + np.arange(wide.sum())]
            good = can_match(t, p, q, percent)
            keep[p[good]] = True
            keep[q[good]] = True
            k = to
    return x, y, t, keep


def candidates(listed: DataFrame, percent: int) -> DataFrame:
    """Groups to verify: (group, block, role, class); the pairs of a class make a group of its name, with block -1."""
    group = F.xxhash64(F.shiftrightunsigned("word", 24), "block").alias("group")  # one number, which Spark sorts by its digits
    info = (F.col("word").bitwiseAND(0xFFFFFF) + F.shiftleft(F.col("role").cast("long"), 24)).cast("int").alias("info")
    dealt = listed.select(group, "class", info, "low", "high").repartition("group").sortWithinPartitions("group")

    def run(batches):
        held: list[list[np.ndarray]] = []  # of which the last group may go on
        n_held = 0

        def out(columns):
            x, y, t, keep = near([np.ascontiguousarray(c) for c in columns], percent)
            a, b = np.minimum(t.cls[x], t.cls[y]), np.maximum(t.cls[x], t.cls[y])
            pair = np.unique(np.stack((a, b)), axis=1) if len(a) else np.zeros((2, 0), dtype=np.int64)
            own = np.unique(pair[0])  # a class and those above it that it is paired with are one group
            n = len(own) + pair.shape[1]
            columns = [np.concatenate((own, pair[0], t.group[keep])), np.concatenate((np.full(n, -1, dtype=np.int8), np.zeros(keep.sum(), dtype=np.int8))), np.concatenate((np.zeros(n, dtype=np.int8), t.role[keep])), np.concatenate((own, pair[1], t.cls[keep]))]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["group", "block", "role", "class"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n_held += batch.num_rows
            if n_held < AT_ONCE:
                continue
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = np.flatnonzero(columns[0] != columns[0][-1])
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield out([c[:cut] for c in columns])
            held, n_held = [[c[cut:] for c in columns]], n_held - cut
        if n_held:
            yield out([np.concatenate(x) for x in zip(*held, strict=True)])

    return dealt.mapInArrow(run, "group long, block byte, role byte, class long").distinct()


def class_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, payload: sorted word hashes) of the lines that ``wanted`` (doc, lines) lists."""
    joined = docs.select("doc", "text").join(wanted, "doc")
    text, listed = joined.columns.index("text"), joined.columns.index("lines")

    def run(batches):
        for batch in batches:
            asked = [set(x) for x in batch.column(listed).to_pylist()]
            for lines in line_sets(batch.column(text)):
                at = np.array([n in asked[r] for r, n in zip(lines.row.tolist(), lines.number.tolist(), strict=True)])
                if at.any():
                    key = set_keys(lines)[at]
                    payload = [lines.words[s : s + n].tobytes() for s, n in zip(lines.start[at].tolist(), lines.size[at].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(payload, pa.binary())], names=["class", "payload"])

    return joined.mapInArrow(run, "class long, payload binary")


def together(start: np.ndarray, count: np.ndarray, few: np.ndarray, cls: np.ndarray, role: np.ndarray, payload: pa.Array, percent: int) -> np.ndarray:
    """Which rows ``few`` (of whole groups, each in order of age) an earlier row of their group matches, all groups at once."""
    size = pc.binary_length(payload).to_numpy() // 8
    value = np.frombuffer(b"".join(payload.to_pylist()), dtype=np.uint64)
    of_row = np.searchsorted(start, few, "right") - 1
    at = few - start[of_row]
    row = np.repeat(np.arange(len(few)), size)
    name = np.cumsum(np.diff(of_row, prepend=-1) > 0) - 1  # groups by number, without those left out
    order = np.argsort(value)
    order = order[_by_line(name[row[order]])]
    value, row = value[order], row[order]
    ends = np.flatnonzero(np.concatenate(((value[1:] != value[:-1]) | (name[row[1:]] != name[row[:-1]]), [True]))) + 1
    end = np.repeat(ends, np.diff(ends, prepend=0))
    n = count[of_row]
    base = np.concatenate(([0], np.cumsum(n)))  # of a row's counts, one for each row of its group
    shared = np.zeros(base[-1], dtype=np.int64)
    i, step = np.arange(len(row)), 1
    while len(i):
        i = i[i + step < end[i]]
        x, y = np.minimum(row[i], row[i + step]), np.maximum(row[i], row[i + step])
        shared += np.bincount(base[y] + at[x], minlength=len(shared))
        step += 1
    pair = np.flatnonzero(shared)
    y = np.searchsorted(base, pair, "right") - 1
    x = y - at[y] + pair - base[y]
    roles = role[few[x]] + role[few[y]]
    hit = (cls[few[x]] != cls[few[y]]) & ((roles == 0) | (roles == 3)) & (100 * shared[pair] >= percent * (size[x] + size[y] - shared[pair]))
    return np.unique(y[hit])


def matched(rows: DataFrame, percent: int) -> DataFrame:
    """Classes with an earlier match, from candidate rows (group, block, role, class, id, doc, line, payload)."""
    dealt = rows.repartition("group", "block").sortWithinPartitions("group", "block", "id", "doc", "line")

    def group(held: list[tuple]) -> list[int]:
        member = [h for h in held if h[1] != 2]
        if not member or len({h[0] for h in held}) < 2:
            return []
        rank: dict[int, int] = {}
        for h in held:
            rank.setdefault(h[0], len(rank))  # the earlier a class, the smaller
        size = np.array([len(h[2]) // 8 for h in member])
        value = np.frombuffer(b"".join(h[2] for h in member), dtype=np.uint64)
        order = np.argsort(value, kind="stable")
        value, owner = value[order], np.repeat(np.arange(len(member)), size)[order]
        place = np.array([rank[h[0]] for h in member])
        names = np.array([h[0] for h in member], dtype=np.int64)
        found: set[int] = set()
        for key, role, payload in held:
            if role == 1:
                continue
            p = np.frombuffer(payload, dtype=np.uint64)
            low, high = np.searchsorted(value, p, "left"), np.searchsorted(value, p, "right")
            run = high - low
            at = np.repeat(low - (np.cumsum(run) - run), run) + np.arange(run.sum())
            shared = np.bincount(owner[at], minlength=len(member))
            hit = 100 * shared >= percent * (size + len(p) - shared)
            if (hit & (place < rank[key])).any():
                found.add(key)
            found.update(names[hit & (place > rank[key])].tolist())
        return sorted(found)

    def judged(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        name, block, role, cls = (t.column(c).to_numpy() for c in ("group", "block", "role", "class"))
        start = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (block[1:] != block[:-1]))))
        count = np.diff(np.append(start, len(name)))
        few = np.flatnonzero(np.repeat((count > 1) & (count <= SMALL_GROUP), count))
        out = [cls[few[together(start, count, few, cls, role, t.column("payload").take(pa.array(few)).combine_chunks(), percent)]]] if len(few) else []
        for s, n in zip(start[count > SMALL_GROUP].tolist(), count[count > SMALL_GROUP].tolist(), strict=True):
            rows = zip(cls[s : s + n].tolist(), role[s : s + n].tolist(), t.column("payload").slice(s, n).to_pylist(), strict=True)
            out.append(np.array(group(list(rows)), dtype=np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)) if out else [], pa.int64())], names=["class"])

    def run(batches):
        held: list[pa.RecordBatch] = []  # of which the last group may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            name, block = (batch.column(c).to_numpy() for c in (0, 1))
            last = np.flatnonzero((name != name[-1]) | (block != block[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if held and (cut or (held[-1].column(0)[-1], held[-1].column(1)[-1]) != (batch.column(0)[0], batch.column(1)[0])):
                yield judged([*held, batch.slice(0, cut)])
                held = []
            elif cut:
                yield judged([batch.slice(0, cut)])
            held.append(batch.slice(cut))
        if held:
            yield judged(held)

    return dealt.select("group", "block", "role", "class", "payload").mapInArrow(run, "class long").distinct()


def later_lines(docs: DataFrame, percent: int, frequent: int = FREQUENT) -> DataFrame:
    """(doc, n, gone): number of lines with a word of each document, and those that an earlier line matches.

    ``docs`` holds id, text, doc (a number for each distinct id and text) and any others.
    """
    lines, counts = line_table(docs)
    groups = written(candidates(listing(docs, counts, percent, frequent), percent), "line-candidates")
    release(docs.sparkSession)  # the listing's shuffle, the largest of all, is done with
    first = lines.groupBy("class").agg(F.min(F.struct("id", "doc", "line")).alias("first"), F.count("*").alias("n"))
    some = groups.select("class").distinct().withColumn("near", F.lit(True))
    classes = first.join(some, "class", "left").filter("near OR n > 1").select("class", "first.*", F.coalesce("near", F.lit(False)).alias("near"))
    classes = written(classes, "line-classes")

    wanted = classes.filter("near").groupBy("doc").agg(F.collect_list("line").alias("lines"))  # lines of one document
    payload = written(class_words(docs, wanted), "line-words")
    release(docs.sparkSession)  # as is the shuffle of the texts
    rows = groups.join(classes.select("class", "id", "doc", "line"), "class").join(payload, "class")
    later = matched(rows, percent).withColumn("later", F.lit(True))
    gone = classes.select("class", F.col("doc").alias("first_doc"), F.col("line").alias("first_line")).join(later, "class", "left")
    away = F.col("first_doc").isNotNull() & (F.col("later").isNotNull() | (F.col("doc") != F.col("first_doc")) | (F.col("line") != F.col("first_line")))
    own = lines.drop("id").join(gone, "class", "left")
    return own.groupBy("doc").agg(F.max("n").alias("n"), F.sort_array(F.collect_set(F.when(away, F.col("line")))).alias("gone"))


def doc_number(key: str, text: str):
    """A number for each distinct pair of id and text."""
    return F.coalesce(F.xxhash64(key, text), F.lit(0))


def dedup_lines(df: DataFrame, key: str, text: str, percent: int = 80, n_lines: str = "n_lines", n_removed: str = "n_removed", frequent: int = FREQUENT) -> DataFrame:
    """``df`` with later matching lines taken out of ``text``, and the numbers of lines with a word and of lines removed."""
    shape = df.columns
    others = {c: f"in_{k}" for k, c in enumerate(shape) if c != text}
    work = df.select(*(F.col(c).alias(n) for c, n in others.items()), F.col(key).cast("long").alias("id"), F.col(text).alias("text"), doc_number(key, text).alias("doc"))
    marked = later_lines(work, percent, frequent)

    @F.pandas_udf(T.StringType())
    def strip(texts: pd.Series, gone: pd.Series) -> pd.Series:
        def one(t, away):
            if t is None:
                return None
            away = set(away.tolist())
            return "\n".join(line for k, line in enumerate(t.split("\n")) if k not in away)

        return pd.Series([one(t, g) for t, g in zip(texts, gone, strict=True)])

    out = work.join(marked, "doc", "left")
    touched = F.coalesce(F.size("gone") > 0, F.lit(False))
    whole = F.when(touched, strip(F.when(touched, F.col("text")), F.when(touched, F.col("gone")))).otherwise(F.col("text"))
    columns = [whole.alias(c) if c == text else F.col(others[c]).alias(c) for c in shape]
    return out.select(*columns, F.coalesce("n", F.lit(0)).alias(n_lines), F.when(touched, F.size("gone")).otherwise(0).cast("long").alias(n_removed))
