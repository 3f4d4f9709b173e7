"""Vectorised words and word hashes over Arrow text columns.

The operators on words (near duplicates, quality rules, substring dedup) look
at every word of every text.  Here a text column is taken as the byte buffer
that Arrow already holds, cut into slices of bounded size, and words, word
hashes and n-gram hashes come out as numpy arrays; no Python object is made
per word.

Words are maximal runs of bytes outside the six ASCII blanks, which for UTF-8
is the same as the pattern ``[^\\x20\\x09-\\x0D]+`` over code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text handled at once; working arrays are about 40 times as large.
SLICE_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

LONG_SPAN = 128
_SEED = np.uint64(0xD6E8FEB86659FD93)
_LOW_BYTES = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)

BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def _pow(base: np.uint64, n: int, key: str) -> np.ndarray:
    """``base ** 0 .. n`` modulo 2**64, kept between calls."""
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * SLICE_BYTES:  # a very long text does not leave its table behind
            _powers[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, byte buffer, row offsets) over a string column; nulls are
    empty texts. A slice holds whole texts, at most ``limit`` bytes of them
    unless one text alone is longer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset:column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    offsets = offsets.astype(np.int64)
    if column.null_count:  # a null slot may still point at bytes
        column = column.fill_null("")
        yield from text_slices(column, limit)
        return
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each word, and for each text the index of
    its first word (one more entry at the end). ``inside`` flags the bytes of
    words, if they are others than those outside blanks."""
    inside = ~BLANK[data] if inside is None else inside
    n = len(data)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    start[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(start)
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span ``[start, end)``: its length and eight
    bytes at a time through :func:`mix`, a bijection, so that spans of one
    length of at most eight bytes never collide. Spans of over ``LONG_SPAN``
    bytes are hashed by BLAKE2b."""
    size = ends - starts
    out = mix(size.astype(np.uint64) + _SEED)
    if len(starts) == 0:
        return out
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ascontiguousarray(np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,)))
    out = mix(out ^ (eight[starts] & _LOW_BYTES[np.minimum(size, 8)]))
    live = np.flatnonzero((size > 8) & (size <= LONG_SPAN))
    done = 8
    while len(live):
        part = eight[starts[live] + done] & _LOW_BYTES[np.minimum(size[live] - done, 8)]
        out[live] = mix(out[live] ^ part)
        done += 8
        live = live[size[live] > done]
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        digest = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
        out[i] = np.frombuffer(digest, dtype="<u8")[0]
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each word's bytes (A-Z as a-z if ``lower``)."""
    return span_hashes(_LOWER[data] if lower else data, starts, ends)


def lowered(data: np.ndarray) -> np.ndarray:
    """The buffer with A-Z as a-z."""
    return _LOWER[data]


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between consecutive ``bounds``."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def gram_hashes(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` consecutive entries (runs over text borders
    included: callers keep those whose start lies in the text)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    return range_hashes(prefix_hashes(words, salt), np.arange(n), np.arange(n) + k)


def prefix_hashes(words: np.ndarray, salt: int = 0) -> np.ndarray:
    """Prefix sums from which :func:`range_hashes` hashes any run of words."""
    prefix = np.empty(len(words) + 1, dtype=np.uint64)
    prefix[0] = 0
    w = mix(words ^ np.uint64(salt)) if salt else words
    np.cumsum(w * _pow(_BASE, len(words), "up"), out=prefix[1:])
    return prefix


def range_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the word runs ``[start, end)``; equal runs hash equally wherever
    they stand."""
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64)
    h = (prefix[ends] - prefix[starts]) * _pow(_BASE_INV, len(prefix), "down")[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` entries, by doubling."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:n], out[rest:rest + n]) if rest else out[:n]
