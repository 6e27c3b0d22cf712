"""Numpy views of Arrow text and 64-bit hashing, shared by the operators that work on whole batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text handled at once inside a task; a single longer text is a chunk of its own.
CHUNK_BYTES = 1 << 18


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n + 1 offsets of its rows. NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[where[0] : where[-1]] if len(column) else raw[:0], where - where[0] if len(column) else np.zeros(1, np.int64)


def spans_of(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges [a, b) of about ``size`` bytes each."""
    rows, a = len(offsets) - 1, 0
    while a < rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (splitmix64), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Start of every run of equal values, and the length at the end."""
    n = len(sorted_keys)
    if n == 0:
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [n]))


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Texts as Python strings. NULL is empty; bytes that are not UTF-8 are replaced."""
    column = column.fill_null("")
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [bytes(v.as_buffer()).decode("utf-8", "replace") for v in column]


def text_chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list[str]]]:
    """Consecutive row ranges with their texts, about ``size`` bytes at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets = utf8(column)
    for a, b in spans_of(offsets, size):
        yield a, b, strings(column.slice(a, b - a))
