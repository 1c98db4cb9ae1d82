"""Whole-batch text primitives on the raw UTF-8 buffers of Arrow columns.

No Python string is made: words are byte ranges, and their hashes come from one
running polynomial sum over the buffer (mod 2**64), so the cost is a handful of
numpy passes a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is one piece of its own.
PIECE = 1 << 20

_R = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

#: Byte classes: 0 separates.  SPACES cuts at ASCII white space and controls.
SPACES = np.array([0 if b <= 0x20 else 1 for b in range(256)], np.uint8)
#: Letters, digits and all bytes of non-ASCII characters form words.
ALNUM = np.array([1 if b >= 0x80 or chr(b).isalnum() else 0 for b in range(256)], np.uint8)
#: As ALNUM, with runs of other printable bytes as tokens of class 2.
MIXED = np.array([1 if b >= 0x80 or chr(b).isalnum() else 2 if b > 0x20 and b != 0x7F else 0 for b in range(256)], np.uint8)
#: ASCII capitals to small letters.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(r: int) -> np.ndarray:
        out = np.ones(n + 1, np.uint64)
        out[1:] = np.uint64(r)
        return np.multiply.accumulate(out)

    return run(_R), run(pow(_R, -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i for i in 0..n at least."""
    size = PIECE
    while size < n:
        size *= 2
    return _powers(size)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # zero chunks
        column = pa.array([], pa.string())
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes, at least one text each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def tokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of each maximal run of one non-zero class within a text."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    c = classes[data]
    s = c != 0
    e = s.copy()
    same = c[1:] == c[:-1]
    s[1:] &= ~same
    e[:-1] &= ~same
    first = offsets[:-1]
    first = first[first < n]
    s[first] = c[first] != 0
    last = offsets[1:]
    last = last[last > 0] - 1
    e[last] = c[last] != 0
    start = np.flatnonzero(s)
    end = np.flatnonzero(e) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; equal bytes give equal hashes everywhere."""
    p, q = powers(len(data))
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=run[1:])
    return mix((run[end] - run[start]) * q[start])


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values (len - k + 1 of them)."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    p, q = powers(n)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(h * p[:n], out=run[1:])
    return mix((run[k:] - run[:-k]) * q[: n - k + 1])
