"""Byte-level BPE encoding and decoding with a file of public ranks.

Pre-tokens are found without regular expressions: every code point becomes a symbol, every symbol a function on the
states of a small automaton, and since composing such functions is associative, the state before each code point comes
from a blocked prefix scan over function codes. The pre-tokens are cut from the text, merged by pair ranks once
each, many at a time, and cached. The ends of the tokens in the text's bytes are kept beside the ids.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workforce_signals.llm.arrays import text_chunks
from workforce_signals.llm.id_cache import IdCache
from workforce_signals.llm.workers import map_batches

# Pre-tokens kept with their ids in a worker.
CACHED = 200_000
# Pre-tokens merged side by side.
MERGED = 20_000
# Texts decoded at once.
DECODED = 512
# Pre-tokens with more bytes are merged one at a time, with a heap.
WIDE = 64
_BLOCK = 128
_NONE = np.int32(1 << 30)

# Symbols of code points. ONE and TWO are apostrophes that begin a contraction with one or two letters.
LETTER, NUMBER, OTHER, SPACE, WHITE, ONE, TWO = range(7)
# States: what the code point before belongs to. REST1 and REST2 lack so many letters of a contraction, DONE has all.
BEGIN, IN_WHITE, IN_SPACE, IN_WORD, IN_NUMBER, IN_OTHER, REST1, REST2, DONE = range(9)

# Code points with the property White_Space, contractions of the public pattern.
WHITE_SPACE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000
)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _next(state: int, symbol: int) -> int:
    if symbol in (ONE, TWO):
        if state in (IN_SPACE, IN_OTHER):
            return IN_OTHER
        return REST1 if symbol == ONE else REST2
    if symbol == LETTER and state in (REST1, REST2):
        return DONE if state == REST1 else REST1
    return {LETTER: IN_WORD, NUMBER: IN_NUMBER, OTHER: IN_OTHER, SPACE: IN_SPACE, WHITE: IN_WHITE}[symbol]


def _starts(state: int, symbol: int) -> bool:
    """Whether a pre-token starts at ``symbol``; white space is decided by what follows, too."""
    if symbol in (SPACE, WHITE):
        return state not in (IN_SPACE, IN_WHITE)
    goes_on = {LETTER: (IN_WORD, IN_SPACE, REST1, REST2), NUMBER: (IN_NUMBER, IN_SPACE)}
    return state not in goes_on.get(symbol, (IN_OTHER, IN_SPACE))


@cache
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the symbols' functions and of those that restart first, the composition table, the state that a
    function makes of BEGIN, and where pre-tokens start."""
    states, symbols = range(9), range(7)
    functions = [tuple(_next(s, x) for s in states) for x in symbols]
    functions += [tuple(f[BEGIN] for _ in states) for f in functions[:7]]
    functions.append(tuple(states))
    code = {f: i for i, f in reversed(list(enumerate(functions)))}
    known = list(code)
    for f in known:  # grows until closed under composition
        for g in list(known):
            for h in (tuple(g[s] for s in f), tuple(f[s] for s in g)):
                if h not in code:
                    code[h] = len(functions)
                    functions.append(h)
                    known.append(h)
    size = len(functions)
    compose = np.array([[code[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint8).ravel()
    own = np.array([code[f] for f in functions[:7]], np.uint8)
    fresh = np.array([code[f] for f in functions[7:14]], np.uint8)
    start = np.array([[_starts(s, x) for x in symbols] for s in states]).ravel()
    assert size < 256
    return own, fresh, compose, np.array([f[BEGIN] for f in functions], np.uint8), start


@cache
def _symbols() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[list(WHITE_SPACE)] = WHITE
    table[0x20] = SPACE
    return table


def _scan(codes: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Prefix compositions of function codes: blocks side by side, then the scan of the blocks' totals."""
    n, size = len(codes), int(len(compose) ** 0.5)
    if n <= 1:
        return codes.astype(np.int64)
    width = _BLOCK if n > 4 * _BLOCK else max(2, int(n**0.5))
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.int64)
    grid[:n] = codes
    grid = grid.reshape(rows, width).T.copy()
    for t in range(1, width):
        grid[t] = compose[grid[t - 1] * size + grid[t]]
    if rows > 1:
        before = _scan(grid[-1, :-1], compose)
        grid[:, 1:] = compose[before[None, :] * size + grid[:, 1:]]
    return grid.T.reshape(-1)[:n]


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in code points; ``first`` has the starts of the texts that are not empty."""
    own, fresh, compose, state_of, start = _automaton()
    symbols = _symbols()[points]
    is_first = np.zeros(len(points) + 1, bool)
    is_first[first] = True
    is_first[-1] = True
    marks = np.flatnonzero(points[:-1] == ord("'"))
    if len(marks):
        after = np.where(is_first[marks + 1], 0, points[marks + 1])
        third = np.zeros(len(marks), points.dtype)
        more = marks + 2 < len(points)
        third[more] = np.where(is_first[marks[more] + 2], 0, points[marks[more] + 2])
        for word in CONTRACTIONS:
            fits = after == ord(word[0])
            if len(word) == 2:
                fits &= third == ord(word[1])
            symbols[marks[fits]] = ONE if len(word) == 1 else TWO
    codes = own[symbols]
    codes[first] = fresh[symbols[first]]
    state = np.empty(len(points), np.uint8)
    state[0] = BEGIN
    state[1:] = state_of[_scan(codes, compose)[:-1]]
    state[first] = BEGIN
    starts = start[state.astype(np.int64) * 7 + symbols]
    white = (symbols == SPACE) | (symbols == WHITE)
    starts[:-1] |= white[:-1] & ~white[1:] & ~is_first[1:-1]
    return np.flatnonzero(starts)


class Ranks:
    """A vocabulary: bytes of every token, and the merges its ranks allow."""

    def __init__(self, raw: bytes):
        """``raw``: lines of a base64 token and its rank."""
        pairs = (line.split() for line in raw.splitlines() if line.strip())
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        size = max(self.rank.values()) + 1
        self.token = [b""] * size
        for token, r in self.rank.items():
            self.token[r] = token
        self.length = np.array([len(t) for t in self.token], np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.length)))
        self.flat = np.frombuffer(b"".join(self.token), np.uint8)
        self.size = size

    def prepare(self) -> Ranks:
        """What encoding needs besides: the merges of two tokens, by dictionary and by sorted keys."""
        get, size = self.rank.get, self.size
        merges = {
            get(token[:k]) * size + get(token[k:]): r
            for token, r in self.rank.items()
            for k in range(1, len(token))
            if token[:k] in self.rank and token[k:] in self.rank
        }
        self.merge = merges
        self.keys = np.array(sorted(merges), np.int64)
        self.results = np.array([merges[k] for k in self.keys.tolist()], np.int32)
        self.byte = np.array([get(bytes([b])) for b in range(256)], np.int32)
        both = self.byte.astype(np.int64)
        self.byte_pairs = self.pair(np.repeat(both, 256), np.tile(both, 256)).reshape(256, 256)
        self.cache = IdCache(self._learn, CACHED)
        return self

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that two adjacent ones make, or _NONE."""
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.results[at], _NONE)

    def merge_long(self, piece: bytes) -> list[int]:
        """Tokens of one long piece: a linked list of parts and a heap of (rank, place)."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get, size = self.merge.get, self.size
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] * size + ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (s := get(r * size + ids[after[i]])) is not None:
                    heappush(heap, (s, i, r, ids[after[i]]))
            if before[i] >= 0 and (s := get(ids[before[i]] * size + r)) is not None:
                heappush(heap, (s, before[i], ids[before[i]], r))
        return [x for x in ids if x >= 0]

    def merge_many(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of many short pieces, each step merging the best pair of every piece; flat ids and counts."""
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        column = np.arange(width)
        ids = np.where(column < length[:, None], self.byte[raw], -1)
        ranks = np.where(column[1:] < length[:, None], self.byte_pairs[raw[:, :-1], raw[:, 1:]], _NONE)
        ranks = np.concatenate((ranks, np.full((len(pieces), 1), _NONE, ranks.dtype)), axis=1)
        done, live = ids.copy(), np.arange(len(pieces))
        while len(live):
            j = ranks.argmin(axis=1)
            rows = np.arange(len(live))
            best = ranks[rows, j]
            on = best < _NONE
            if not on.all():
                done[live[~on]] = ids[~on]
                live, ids, ranks, j, best = live[on], ids[on], ranks[on], j[on], best[on]
                rows = np.arange(len(live))
                if not len(live):
                    break
            source = np.minimum(column + (column > j[:, None]), width - 1)
            ids, ranks = np.take_along_axis(ids, source, 1), np.take_along_axis(ranks, source, 1)
            ids[:, -1], ranks[:, -1] = -1, _NONE
            ids[rows, j] = best
            right = ids[rows, np.minimum(j + 1, width - 1)]
            ranks[rows, j] = np.where((right >= 0) & (j + 1 < width), self.pair(best, right), _NONE)
            some = j > 0
            ranks[rows[some], j[some] - 1] = self.pair(ids[rows[some], j[some] - 1], best[some])
        kept = done >= 0
        return done[kept].astype(np.int32), kept.sum(axis=1)

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of new pieces: those in the vocabulary at once, the others merged by width."""
        raw = [p.encode() for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        known = np.fromiter(map(self.rank.get, raw, repeat(-1)), np.int32, len(raw))
        places, found, counts = [np.flatnonzero(known >= 0)], [known[known >= 0]], [np.ones((known >= 0).sum(), np.int64)]
        low = 0
        for width in (8, 16, 32, WIDE):
            some = np.flatnonzero((known < 0) & (size > low) & (size <= width))
            low = width
            for a in range(0, len(some), MERGED):
                part = some[a : a + MERGED]
                ids, n = self.merge_many([raw[i] for i in part.tolist()], width)
                places.append(part)
                found.append(ids)
                counts.append(n)
        for i in np.flatnonzero((known < 0) & (size > WIDE)).tolist():
            ids = np.array(self.merge_long(raw[i]), np.int32)
            places.append(np.array([i]))
            found.append(ids)
            counts.append(np.array([len(ids)]))
        place, count = np.concatenate(places), np.concatenate(counts)
        out = np.zeros(len(raw), np.int64)
        out[place] = count
        ends = np.cumsum(out)
        to = np.repeat((ends - out)[place] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        flat = np.empty(ends[-1], np.int32)
        flat[to] = np.concatenate(found)
        return flat, out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the n + 1 offsets of the texts in them."""
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.concatenate(([0], np.cumsum(length)))
        starts = piece_starts(points, offsets[:-1][length > 0])
        cuts = starts.tolist()
        pieces = [joined[a:b] for a, b in zip(cuts, [*cuts[1:], len(joined)], strict=True)]
        ids, count = self.cache.encode(pieces)
        return ids, np.concatenate(([0], np.cumsum(count)))[np.searchsorted(starts, offsets)]

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of tokens."""
        if not len(ids):
            return np.zeros(0, np.uint8)
        size = self.length[ids]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.at[ids] - (ends - size), size) + np.arange(ends[-1])]


_loaded: dict[tuple[int, bool], Ranks] = {}


def _ranks(raw: bytes, encoding: bool) -> Ranks:
    """One vocabulary per worker, which keeps its cache from task to task."""
    key = hash(raw), encoding
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Ranks(raw).prepare() if encoding else Ranks(raw)
    return _loaded[key]


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def _encode(vocabulary, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _ranks(vocabulary.value, True)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for a, b, texts in text_chunks(batch.column(text)):
                ids, offsets = ranks.encode(texts)
                ends = np.cumsum(ranks.length[ids])
                before = np.concatenate(([0], ends))[offsets[:-1]]
                ends = ends - np.repeat(before, np.diff(offsets))
                kept = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns) if i != at]
                names = [n for i, n in enumerate(batch.schema.names) if i != at]
                yield pa.record_batch([*kept, _lists(offsets, ids), _lists(offsets, ends)], names=[*names, "ids", "ends"])

    return run


def _decode(vocabulary, out: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _ranks(vocabulary.value, False)
        for batch in batches:
            names = [n for n in batch.schema.names if keep_ids or n != "ids"]
            for a in range(0, batch.num_rows, DECODED):
                some = batch.slice(a, DECODED)
                texts = [
                    ranks.bytes_of(v.values.to_numpy(zero_copy_only=False)).tobytes() if v.is_valid else None
                    for v in some.column("ids")
                ]
                yield pa.record_batch([*(some.column(n) for n in names), pa.array(texts, pa.binary())], names=[*names, out])

    return run


def _vocabulary(spark, path: str):
    """The rank file, read by the driver; workers need no copy of it."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ids, ends): the tokens of every whole text and where each ends in its bytes.

    Ids are those of the tiktoken library with the ranks at ``path`` and the public pattern, without special
    tokens. NULL and empty texts have no tokens; bytes that are not UTF-8 are read as U+FFFD. Rows are neither
    merged nor dropped, whatever their key. Other columns are left out.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(key), F.col(text).alias("_text"))
    kind = narrow.schema[0].dataType.simpleString()
    return map_batches(narrow, _encode(_vocabulary(spark, path), "_text"), f"`{key}` {kind}, ids array<int>, ends array<int>")


def decode(tokens: DataFrame, path: str, out: str = "decoded", keep_ids: bool = False) -> DataFrame:
    """Adds the bytes of the tokens in place of ``ends`` and, unless ``keep_ids``, of ``ids``.

    NULL ids stay NULL. Other columns are kept, but for one named like ``out``, which is replaced.
    """
    spark = tokens.sparkSession
    kept = [f for f in tokens.schema if f.name not in ("ids", "ends", out)]
    ids = ["ids array<int>"] if keep_ids else []
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *ids, f"`{out}` binary"])
    narrow = tokens.select(*(f"`{f.name}`" for f in kept), "ids")
    return map_batches(narrow, _decode(_vocabulary(spark, path), out, keep_ids), schema)


def _round_trip(vocabulary, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _ranks(vocabulary.value, True)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            for a, b, texts in text_chunks(batch.column(text)):
                ids, offsets = ranks.encode(texts)
                ends = np.concatenate(([0], np.cumsum(ranks.length[ids])))[offsets].astype(np.int32)
                buffers = [None, pa.py_buffer(ends), pa.py_buffer(ranks.bytes_of(ids))]
                decoded = pa.Array.from_buffers(pa.binary(), len(texts), buffers)
                kept = [batch.column(n).slice(a, b - a) for n in names]
                yield pa.record_batch([*kept, _lists(offsets, ids), decoded], names=[*names, "ids", "decoded"])

    return run


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ids, decoded): the tokens of every whole text and the bytes they stand for, from one pass in a worker.

    As ``encode`` followed by ``decode``, without sending the ids to another worker in between.
    """
    narrow = docs.select(F.col(key), F.col(text).alias("_text"))
    kind = narrow.schema[0].dataType.simpleString()
    return map_batches(narrow, _round_trip(_vocabulary(docs.sparkSession, path), "_text"), f"`{key}` {kind}, ids array<int>, decoded binary")


def token_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and decoded again; and the ids, if asked for."""
    found = round_trip(docs, path, key, text)
    return found.select(
        key,
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *(["ids"] if keep_ids else []),
    )
