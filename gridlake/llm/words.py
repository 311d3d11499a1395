"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column.

A word is a run of bytes other than space and ``\\t\\n\\v\\f\\r``.  All hashes are 64-bit
polynomials over odd random bases, finished by a bijective mixer.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: bytes hashed at a time
SPAN = 1 << 20
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its texts; null is empty."""
    binary = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    data = binary.buffers()[2]
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(binary) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word."""
    white = WHITE[data]
    filled = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    begins = ~white
    begins[1:] &= white[:-1]
    begins[first] = ~white[first]
    finishes = ~white
    finishes[:-1] &= white[1:]
    finishes[last] = ~white[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finishes) + 1, np.searchsorted(offsets[1:], starts, "right")


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``data[start:end]`` for rising, disjoint spans."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SPAN, "right")))
        low, high = starts[i], ends[j - 1]
        up = powers(BYTE_BASE, int(high - low))
        sums = np.zeros(len(up) + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        down = powers(inverse(BYTE_BASE), len(up) + 1)
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[e] - sums[s]) * down[s] ^ (ends[i:j] - starts[i:j]).astype(np.uint64))
        i = j
    return out


def hash_windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` neighbouring word hashes, whatever text they are in."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    up = powers(WORD_BASE, len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up, out=sums[1:])
    down = powers(inverse(WORD_BASE), len(words))
    n = len(words) - size + 1
    return mix((sums[size:] - sums[:-size]) * down[:n] + np.uint64(size))


def pack_planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of unsigned values, one plane after the other."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack_planes(data, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T
    return out.view("<u8").ravel().astype(np.uint64)
