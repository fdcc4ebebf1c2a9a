"""Byte-level BPE encoding and decoding.

Each match of the pre-token pattern is encoded by itself. A segment tree over the byte
positions of a match holds, at its root, the leftmost pair of live neighbours with the
smallest rank; a merge changes at most three leaves (the merged pair, the pair on its left
and the pair that vanished) and repairs their paths to the root. The trees of many matches
lie side by side in numpy arrays, so one step merges once in each of them.

Encoding needs no shuffle. Each worker keeps the ids of matches it has met, up to
``CACHE_WORDS``; a full cache is emptied, which costs time only.

Defined results: a null text counts as empty, an empty text has no ids; texts of any length
are encoded whole; ids are little-endian unsigned 32-bit integers in one binary value. Rows
are taken one by one, so repeated rows give repeated results; other columns pass through.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Matches kept by one Python worker before its cache is emptied.
CACHE_WORDS = 100_000
#: Leaves that one numpy batch of segment trees may hold.
BATCH_LEAVES = 1 << 17
#: Characters up to this code point are split by ``re`` with classes made from ``unicodedata``; a text that goes beyond is split by ``regex``.
FAST_LIMIT = 0x24F

_NONE = np.iinfo(np.int64).max
_SHIFT = 32


def _char_class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(FAST_LIMIT + 1) if unicodedata.category(chr(c)).startswith(kind))


class Splitter:
    """``findall`` of the pre-token pattern; plain Latin texts take a faster equal pattern."""

    def __init__(self, pattern: str) -> None:
        import regex

        self.full = regex.compile(pattern)
        letters, numbers = _char_class("L"), _char_class("N")
        space = "\\t-\\r \\x85\\xa0"
        fast = pattern.replace(r"\p{L}", "\0").replace(r"\p{N}", "\1")
        fast = fast.replace("[^\\s\0\1]", f"[^{space}{letters}{numbers}]")
        fast = fast.replace(r"\s+(?!\S)", f"[{space}]+(?![^{space}])").replace(r"\s+", f"[{space}]+")
        fast = fast.replace("\0", f"[{letters}]").replace("\1", f"[{numbers}]")
        self.fast = re.compile(fast)
        self.beyond = re.compile(f"[^\\x00-{chr(FAST_LIMIT)}]")

    def __call__(self, text: str) -> list[str]:
        return (self.full if self.beyond.search(text) else self.fast).findall(text)


class Codec:
    """Merge tables of one rank file and a bounded cache of encoded matches."""

    def __init__(self, rank_file: bytes, pattern: str) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}
        top = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * top
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, merged = [], []
        get = self.ranks.get
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = get(token[:cut]), get(token[cut:])
                if left is not None and right is not None:
                    keys.append((left << _SHIFT) | right)
                    merged.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.pair_keys = np.array(keys, dtype=np.int64)[order]
        self.pair_ranks = np.array(merged, dtype=np.int64)[order]
        self.split = Splitter(pattern)
        self.cache: dict[str, bytes] = {}

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two neighbours make, ``_NONE`` where there is none."""
        key = (left << _SHIFT) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def merge_all(self, words: list[bytes], leaves: int) -> list[bytes]:
        """Encode ``words`` of 2 to ``leaves`` bytes; ``leaves`` is a power of two."""
        count = len(words)
        size = np.array([len(w) for w in words], dtype=np.int64)
        raw = np.zeros((count, leaves), dtype=np.uint8)
        raw[np.arange(leaves) < size[:, None]] = np.frombuffer(b"".join(words), dtype=np.uint8)
        token = self.single[raw]
        after = np.tile(np.arange(1, leaves + 1), (count, 1))
        before = np.tile(np.arange(-1, leaves - 1), (count, 1))
        live = np.arange(leaves) < size[:, None]
        tree = np.full((count, 2 * leaves), _NONE, dtype=np.int64)
        if leaves > 1:
            rank = self.pair_rank(token[:, :-1], token[:, 1:])
            rank[np.arange(1, leaves) >= size[:, None]] = _NONE
            where = np.arange(leaves - 1)
            tree[:, leaves : 2 * leaves - 1] = np.where(rank == _NONE, _NONE, (rank << _SHIFT) | where)
        level = leaves
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        flat, rows = tree.reshape(-1), np.arange(count)
        while True:
            best = tree[rows, 1]
            open_ = best != _NONE
            rows, best = rows[open_], best[open_]
            if not len(rows):
                break
            at = best & ((1 << _SHIFT) - 1)
            gone = after[rows, at]
            behind = after[rows, gone]
            ahead = before[rows, at]
            merged = best >> _SHIFT
            token[rows, at] = merged
            live[rows, gone] = False
            after[rows, at] = behind
            has_behind, has_ahead = behind < size[rows], ahead >= 0
            before[rows[has_behind], behind[has_behind]] = at[has_behind]
            right = np.full(len(rows), _NONE)
            r = self.pair_rank(merged[has_behind], token[rows[has_behind], behind[has_behind]])
            right[has_behind] = np.where(r == _NONE, _NONE, (r << _SHIFT) | at[has_behind])
            left_rows, left_at = rows[has_ahead], ahead[has_ahead]
            r = self.pair_rank(token[left_rows, left_at], merged[has_ahead])
            left = np.where(r == _NONE, _NONE, (r << _SHIFT) | left_at)
            base = np.concatenate((rows, rows, left_rows)) * (2 * leaves)
            node = leaves + np.concatenate((at, gone, left_at))
            flat[base + node] = np.concatenate((right, np.full(len(rows), _NONE), left))
            while node[0] > 1:
                node = node >> 1
                child = base + 2 * node
                flat[base + node] = np.minimum(flat[child], flat[child + 1])
        ids, many = token[live].astype("<u4").tobytes(), np.cumsum(live.sum(axis=1)) * 4
        return [ids[a:b] for a, b in zip([0, *many[:-1].tolist()], many.tolist(), strict=True)]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of ``words``; a word that is itself a token is that token."""
        out: list[bytes] = [b""] * len(words)
        groups: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            rank = self.ranks.get(word)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif word:
                groups.setdefault(1 << (len(word) - 1).bit_length(), []).append(i)
        for leaves, members in groups.items():
            step = max(1, BATCH_LEAVES // leaves)
            for start in range(0, len(members), step):
                part = members[start : start + step]
                for i, ids in zip(part, self.merge_all([words[i] for i in part], leaves), strict=True):
                    out[i] = ids
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        split = [self.split(t) if t else [] for t in texts]
        new = list({w for words in split for w in words if w not in self.cache})
        self.cache.update(zip(new, self.encode_words([w.encode("utf-8") for w in new]), strict=True))
        look = self.cache.__getitem__
        return [b"".join(map(look, words)) for words in split]

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids or b"", dtype="<u4").tolist()))


_CODECS: dict[str, Codec] = {}


def _codec(rank_file: bytes, pattern: str) -> Codec:
    key = hashlib.sha256(rank_file + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(rank_file, pattern)
    return _CODECS[key]


def _pieces(texts: pa.Array, limit: int = 1 << 20):
    """Slices of a text column of about ``limit`` bytes, one text at least."""
    start, held = 0, 0
    sizes = pc.binary_length(texts).fill_null(0).to_pylist()
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield start, texts.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, texts.slice(start)


def _added(df: DataFrame, *names: tuple[str, T.DataType]) -> T.StructType:
    for name, _ in names:
        if name.lower() in {c.lower() for c in df.columns}:
            raise ValueError(f"the input already has a column {name}; name another")
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in names)])


def encode(df: DataFrame, text: str, rank_path: str, pattern: str, ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """Add the ids (binary, little-endian unsigned 32-bit) and the token count of column ``text``.

    The rank file (a vocabulary, so of bounded size) is read by the driver and broadcast.
    """
    with open(rank_path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    place = df.columns.index(text)

    def run(batches):
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            column = batch.column(place)
            for start, part in _pieces(column):
                encoded = codec.encode(part.to_pylist())
                count = pa.array([len(x) // 4 for x in encoded], pa.int64())
                rows = batch.slice(start, len(part))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(encoded, pa.binary()), count], names=[*batch.schema.names, ids, n_tokens])

    return df.mapInArrow(run, _added(df, (ids, T.BinaryType()), (n_tokens, T.LongType())))


def round_trip(df: DataFrame, text: str, rank_path: str, pattern: str, ids: str = "ids", n_tokens: str = "n_tokens", out: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass: one Python worker and one codec for each task, not two."""
    with open(rank_path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    place = df.columns.index(text)

    def run(batches):
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            for start, part in _pieces(batch.column(place)):
                encoded = codec.encode(part.to_pylist())
                count = pa.array([len(x) // 4 for x in encoded], pa.int64())
                decoded = pa.array([codec.decode(x) for x in encoded], pa.binary())
                rows = batch.slice(start, len(part))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(encoded, pa.binary()), count, decoded], names=[*batch.schema.names, ids, n_tokens, out])
        codec.cache.clear()  # a worker that is used again keeps the ranks only

    return df.mapInArrow(run, _added(df, (ids, T.BinaryType()), (n_tokens, T.LongType()), (out, T.BinaryType())))


def decode(df: DataFrame, ids: str, rank_path: str, pattern: str, out: str = "decoded") -> DataFrame:
    """Add the bytes (binary) that the ids in column ``ids`` stand for."""
    with open(rank_path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    place = df.columns.index(ids)

    def run(batches):
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            for start, part in _pieces(batch.column(place)):
                rows = batch.slice(start, len(part))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([codec.decode(x) for x in part.to_pylist()], pa.binary())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, _added(df, (out, T.BinaryType())))
