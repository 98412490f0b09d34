"""Vectorised word hashing over whole Arrow string columns.

A word is a maximal run of bytes that are ASCII letters or digits, or part of a non-ASCII character; every other ASCII
byte separates. Callers lower-case first with Spark's ``lower`` so that case rules stay those of SQL. All hashing is
done on the concatenated bytes of a batch with numpy, so no Python code runs per document, word or byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Odd, hence invertible modulo 2**64: prefix sums of value * BASE**i give the hash of any range by one subtraction.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)

_seq = np.arange(256, dtype=np.uint64)
IS_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    IS_WORD[_lo:_hi] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64's), so that low bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = mix(_seq + np.uint64(0x632BE59BD9B4E019))


class _Powers:
    """Powers of BASE and of its inverse, grown when a longer batch comes."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", BASE), ("down", INVERSE)):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                setattr(cls, name, np.multiply.accumulate(a))
        return cls.up[:n], cls.down[:n]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; a null is as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(offs):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start byte, end byte and 64-bit hash of each word, and the n + 1 word offsets of the rows."""
    n = len(data)
    is_word = IS_WORD[data]
    starts = is_word.copy()
    starts[1:] &= ~is_word[:-1]
    inner = offs[1:-1]
    inner = inner[inner < n]
    starts[inner] = is_word[inner]
    ends = is_word.copy()  # the last byte of a word
    ends[:-1] &= ~is_word[1:]
    before = inner[inner > 0] - 1
    ends[before] = is_word[before]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    del starts, ends, is_word
    up, down = _Powers.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[:n], out=sums[1:])
    hashes = mix((sums[last] - sums[first]) * down[first])
    return first, last, hashes, np.searchsorted(first, offs)


def grams(hashes: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on; NEVER where they would leave the row. ``bounds``: word offsets of rows."""
    total = len(hashes)
    out = np.full(total, NEVER, np.uint64)
    if total >= n:
        up, down = _Powers.get(total + 1)
        sums = np.zeros(total + 1, np.uint64)
        np.cumsum(hashes * up[:total], out=sums[1:])
        out[: total - n + 1] = mix((sums[n:] - sums[: total - n + 1]) * down[: total - n + 1] + np.uint64(n))
        out[out == NEVER] = NEVER - np.uint64(1)
    out[leaves(bounds, n)] = NEVER
    return out


def leaves(bounds: np.ndarray, n: int) -> np.ndarray:
    """True at the words from which n words would leave the row."""
    total = int(bounds[-1])
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(total)
    return left < n


def sliding(x: np.ndarray, w: int, pick=np.minimum) -> np.ndarray:
    """``pick`` over x[i : i + w], for each i up to len(x) - w; in log2(w) passes."""
    if len(x) < w:
        return x[:0]
    span = 1
    while span * 2 <= w:
        x = pick(x[:-span], x[span:])
        span *= 2
    rest = w - span
    return pick(x[: len(x) - rest], x[rest:]) if rest else x
