"""Vectorized text helpers on Arrow string columns: blocks of bytes, words, rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240607)
#: A random 64-bit value for each byte.
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_powers = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    if _powers.get("n", 0) < n:
        n = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(n, base, U64)
            table[0] = 1
            _powers[key] = np.multiply.accumulate(table)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of values[j] * BASE**j over j < i, modulo 2**64."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever the values stand."""
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def gram_hash(prefix: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of n values."""
    _, down = powers(len(prefix))
    k = max(len(prefix) - n, 0)
    return (prefix[n : n + k] - prefix[:k]) * down[:k]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def blocks(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) with a space after each text; of at most ``most`` bytes unless one text has more."""
    data, offsets = column_bytes(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, rows, first + 4096)
        own = offsets[first : last + 1] - offsets[first]
        sizes = np.diff(own)
        out = np.full(int(own[-1]) + len(sizes), 0x20, np.uint8)
        starts = own + np.arange(len(own))
        keep = np.ones(len(out), bool)
        keep[starts[1:] - 1] = False
        out[keep] = data[offsets[first] : offsets[last]]
        yield first, last, out, starts
        first = last


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space in a block that ends with a space."""
    inside = ~SPACE[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
    return edge[::2], edge[1::2]


def code_points(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block of UTF-8 and the rows' offsets in code points."""
    first = (data & 0xC0) != 0x80
    count = np.zeros(len(data) + 1, np.int64)
    np.cumsum(first, out=count[1:])
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4")
    return chars, count[starts]


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each range, one range after the other."""
    upto = np.cumsum(size)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(begin - upto + size, size)


_SHORT = 15
_LOW_MASK = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(_SHORT + 1)], U64)
_HIGH_MASK = np.array([(1 << 8 * max(n - 8, 0)) - 1 for n in range(_SHORT + 1)], U64)


def packed(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two numbers that hold the bytes and the size of each range of up to 15 bytes, and which ranges are so short; of others they say nothing."""
    padded = np.append(data, np.zeros(16, np.uint8))
    words = np.ndarray(len(data) + 9, "<u8", padded.data, strides=(1,))
    short = size <= _SHORT
    own = np.where(short, size, 0)
    low = words[begin] & _LOW_MASK[own]
    high = words[np.minimum(begin + 8, len(data))] & _HIGH_MASK[own] | own.astype(U64) << U64(56)
    return low, high, short
