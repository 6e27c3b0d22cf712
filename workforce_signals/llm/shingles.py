"""Distinct word shingles of texts as sorted 64-bit hashes, computed on byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from workforce_signals.llm.arrays import constants, mix, spans_of, utf8

WORDS = 5

# The bytes that separate words, [\x20\x09-\x0D].
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SEED = constants(2, 11)
# Bits of the first 0 to 8 bytes of a block.
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_PLACE = constants(8, 37)

# Words of more bytes are hashed one by one, shorter ones all at once, eight bytes at a time.
_LONG_WORD = 256


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and, per row, the offset of its first word (n + 1 offsets). A-Z count as a-z."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    inner = offsets[:-1][offsets[:-1] < n]
    first[inner] = ~space[inner]
    last = ~space
    last[:-1] &= space[1:]
    ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    last[ends] = ~space[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return _hashed(_LOWER[data], starts, stops), np.searchsorted(starts, offsets)


def _hashed(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each slice, in which every byte goes through the mixing function with all that came before it."""
    length = stops - starts
    out = mix(length.astype(np.uint64) * _SEED[0])
    blocks = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(8, np.uint8))), 8)
    some, at = np.flatnonzero(length <= _LONG_WORD), 0
    while len(some):
        block = blocks[starts[some] + at].view("<u8").ravel()
        out[some] = mix(out[some] ^ (block & _FIRST_BYTES[np.minimum(length[some] - at, 8)]))
        at += 8
        some = some[length[some] > at]
    for i in np.flatnonzero(length > _LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : stops[i]].tobytes(), int(_SEED[1]))
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its shingles of ``size`` words; of the whole sequence, if it has fewer."""
    words, first = word_hashes(data, offsets)
    counts = np.diff(first)
    wide = np.zeros(0, np.uint64)
    if len(words) >= size:
        wide = words[: len(words) - size + 1] * _PLACE[0]
        for k in range(1, size):
            wide += words[k : len(words) - size + 1 + k] * _PLACE[k]
        wide = mix(wide)
    out = []
    for a, n in zip(first[:-1].tolist(), counts.tolist(), strict=True):
        if n >= size:
            s = np.sort(wide[a : a + n - size + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s)
        elif n:
            out.append(mix((words[a : a + n] * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + _PLACE[5] * np.uint64(n)))
        else:
            out.append(wide[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash per set; equal sets have equal ones."""
    sums = np.array([mix(s ^ _PLACE[6]).sum(dtype=np.uint64) for s in sets], np.uint64)
    return mix(sums + np.array([len(s) for s in sets], np.uint64) * _PLACE[7])


def batch_sets(batch: pa.RecordBatch, text: str, size: int = WORDS) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Row ranges of a batch with the sets of their texts, a bounded number of bytes at a time."""
    data, offsets = utf8(batch.column(text))
    for a, b in spans_of(offsets):
        yield a, b, shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
