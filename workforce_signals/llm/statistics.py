"""Numbers that describe a text, computed on byte arrays, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workforce_signals.llm.arrays import constants, spans_of, utf8
from workforce_signals.llm.shingles import word_hashes
from workforce_signals.llm.workers import map_batches

STATISTICS = (
    "n_bytes", "n_words", "n_lines", "word_length", "upper", "lower", "other_script", "digits", "spaces", "stops", "marks",
    "symbols", "rare_symbols", "words_ending_in_symbols", "words_without_letters", "shouted_words", "capital_words",
    "distinct_words", "top_word", "distinct_lines", "lines_ending_in_stops", "line_length", "long_words",
)

_UPPER, _LOWER, _HIGH, _DIGIT, _SPACE, _STOP, _MARK, _SYMBOL = range(8)


def _kinds() -> np.ndarray:
    table = np.full(256, _SYMBOL, np.uint8)
    table[ord("A") : ord("Z") + 1] = _UPPER
    table[ord("a") : ord("z") + 1] = _LOWER
    table[ord("0") : ord("9") + 1] = _DIGIT
    table[0x80:] = _HIGH
    table[list(b" \t\n\v\f\r")] = _SPACE
    table[list(b".!?")] = _STOP
    table[list(b",;:'\"-()")] = _MARK
    return table


_KIND = _kinds()
_PLACE = constants(4, 53)


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _pieces(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside``, cut where a text ends."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the number of distinct values and the count of the most frequent."""
    distinct, most = np.zeros(len(first) - 1), np.zeros(len(first) - 1)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b > a:
            s = np.sort(values[a:b])
            cut = np.concatenate(([0], np.flatnonzero(s[1:] != s[:-1]) + 1, [b - a]))
            distinct[i], most[i] = len(cut) - 1, np.diff(cut).max()
    return distinct, most


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS per text. Shares of nothing are 0."""
    n = len(offsets) - 1
    if len(data) == 0:
        return np.zeros((n, len(STATISTICS)))
    kind = _KIND[data]
    count = [_sums(kind == k, offsets) for k in range(8)]
    size = np.diff(offsets)
    starts, ends = _pieces(kind != _SPACE, offsets)
    first = np.searchsorted(starts, offsets)
    words, length = np.diff(first), ends - starts
    hashes, _ = word_hashes(data, offsets)

    def per_word(flag):
        return _sums(flag, first)

    total_letters = np.concatenate(([0], np.cumsum(kind <= _HIGH, dtype=np.int64)))
    total_lower = np.concatenate(([0], np.cumsum(kind == _LOWER, dtype=np.int64)))
    total_upper = np.concatenate(([0], np.cumsum(kind == _UPPER, dtype=np.int64)))
    letters, low, up = (t[ends] - t[starts] for t in (total_letters, total_lower, total_upper))
    last = kind[ends - 1]
    distinct, most = _distinct(hashes, first)

    line_starts, line_ends = _pieces(data != 10, offsets)
    line_first = np.searchsorted(line_starts, offsets)
    lines = np.diff(line_first)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * (np.arange(len(hashes), dtype=np.uint64) + _PLACE[0]))))
    plain = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes)))
    a, b = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    # A line's hash: its words weighted by their place in it.
    line_hash = (total[b] - total[a]) - (plain[b] - plain[a]) * a.astype(np.uint64)
    distinct_lines, _ = _distinct(line_hash, line_first)
    line_stops = _sums(kind[line_ends - 1] == _STOP, line_first)

    def share(part, whole):
        return np.divide(part, whole, out=np.zeros(n), where=whole > 0)

    columns = [
        size, words, lines, share(per_word(length), words), share(count[_UPPER], size), share(count[_LOWER], size),
        share(count[_HIGH], size), share(count[_DIGIT], size), share(count[_SPACE], size), share(count[_STOP], size),
        share(count[_MARK], size), share(count[_SYMBOL], size), share(count[_SYMBOL] + count[_STOP], words),
        share(per_word((last == _SYMBOL) | (last == _STOP)), words), share(per_word(letters == 0), words),
        share(per_word((up > 1) & (low == 0)), words), share(per_word(up > 0), words), share(distinct, words),
        share(most, words), share(distinct_lines, lines), share(line_stops, lines), share(size, lines),
        share(per_word(length > 20), words),
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], axis=1)


def _batches(text: str, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            for a, b in spans_of(offsets):
                found = text_statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                kept = [batch.column(n).slice(a, b - a) for n in keep]
                yield pa.record_batch([*kept, *(pa.array(c) for c in found.T)], names=[*keep, *STATISTICS])

    return run


def with_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the STATISTICS of every whole text; NULL counts as empty."""
    narrow = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys((*keep, text))))
    kinds = [f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep]
    return map_batches(narrow, _batches(text, keep), ", ".join([*kinds, *(f"{s} double" for s in STATISTICS)]))
