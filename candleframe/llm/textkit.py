"""Words, lines and shingles of whole Arrow text columns as 64-bit hashes in numpy.

Words are runs of bytes other than ASCII white space, with A-Z lower-cased. A word's hash is
a sum of random byte values times powers of an odd number, taken from prefix sums, so that
one pass over the bytes hashes all words; it is mixed afterwards. Texts are taken in chunks
of whole texts, which keeps the tables of powers small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes in a chunk of texts, unless one text is longer.
CHUNK = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63 - 1, size=256, dtype=np.uint64)
#: Values of bytes as they are; word hashes take A-Z like a-z unless these are asked for.
AS_IS = _VALUE.copy()
for _b in range(65, 91):
    _VALUE[_b] = _VALUE[_b + 32]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
#: White space, and with it all other ASCII characters that are not letters or digits.
SPACE, PUNCTUATION = _SPACE, np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
#: Masks of the first bytes of eight, by their number.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that near ones differ in all bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, ``n`` of each at least."""
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS[0], _POWERS[1]


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them); nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()) if len(texts) else texts
    if not len(texts):
        return
    if texts.null_count:
        texts = texts.fill_null("")
    _, offset_buffer, data = texts.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), len(texts))
        yield start, stop, raw[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop


def words(raw: np.ndarray, breaks: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; ``breaks`` are positions at which a new text begins, ``between`` marks bytes outside words."""
    if not len(raw):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = (raw != 32) & (raw - np.uint8(9) > 4) if between is SPACE else ~between[raw]
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[breaks] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray = _VALUE) -> np.ndarray:
    """A 64-bit hash of each word."""
    power, inverse = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(value[raw] * power[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def word_keys(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, taken eight bytes at a time; not the one of ``word_hashes``, but of the same words."""
    lower = np.zeros(len(raw) + 8, dtype=np.uint8)
    lower[: len(raw)] = raw | ((raw - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))
    eight = np.ndarray((len(raw) + 1,), "<u8", lower, 0, (1,))  # the eight bytes from each position
    size = ends - starts
    at, step, out = np.arange(len(size)), 0, size.astype(np.uint64)
    while len(at):
        part = eight[starts[at] + step] & _FIRST[np.minimum(size[at] - step, 8)]
        out[at] = mix(out[at] * _U(0x9E3779B97F4A7C15) + part)
        step += 8
        at = at[(size[at] > step) & (size[at] <= 64)]
    long = np.flatnonzero(size > 64)
    if len(long):
        out[long] = word_hashes(raw, starts[long], ends[long])
    return out


def ordered_shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words in order; of the whole sequence, if it is shorter."""
    if not len(hashes):
        return hashes
    width = len(hashes) - n + 1
    size = n
    if width < 1:
        width, size = 1, len(hashes)
    total = np.full(width, size, dtype=np.uint64)
    for k in range(size):
        total = mix(total * _U(0x9E3779B97F4A7C15) + hashes[k : k + width])
    return total


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``n`` words; of the whole sequence, if it is shorter."""
    return np.unique(ordered_shingles(hashes, n))


def each_text(texts: pa.Array, between: np.ndarray = SPACE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words in order) for each row of a text column."""
    for start, stop, raw, offsets in chunks(texts):
        a, b = words(raw, offsets, between)
        h = word_hashes(raw, a, b)
        at = np.searchsorted(a, offsets)
        for k in range(stop - start):
            yield start + k, h[at[k] : at[k + 1]]


def each_line(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, starts of its lines in the chunk's words, ends, the chunk's word hashes) for each row.

    Lines end at newlines (byte 10), which are white space, so no word spans two lines.
    """
    for start, stop, raw, offsets in chunks(texts):
        a, b = words(raw, offsets)
        h = word_hashes(raw, a, b)
        newline = np.flatnonzero(raw == 10)
        for k in range(stop - start):
            inner = newline[np.searchsorted(newline, offsets[k]) : np.searchsorted(newline, offsets[k + 1])]
            edges = np.searchsorted(a, np.concatenate(([offsets[k]], inner, [offsets[k + 1]])))
            yield start + k, edges[:-1], edges[1:], h
