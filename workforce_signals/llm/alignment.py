"""Alignment of the tokens of two tokenizers by pointer jumping.

Both cut the same bytes. Every token points to the token of the other side that reaches farthest right of those it
overlaps; a token of the second side that ends where one of the first ends points to itself. Replacing all pointers by
those of their targets halves the way that is left, so after a logarithmic number of rounds over whole arrays each
token points to the last token of its group.

A pair of ids is linked wherever tokens with these ids share a group. In how many documents that is so is counted over the
corpus: partial counts per task, then sums. The counts then go back to the documents: a bounded number of the most
frequent pairs is known to all tasks, the other ones are joined.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workforce_signals.llm.arrays import group_starts, spans_of, text_chunks
from workforce_signals.llm.workers import map_batches
from workforce_signals.plans.stored import Stored, new_path, store

# Pairs known to all tasks: nine bytes each, so at most 9 MB.
FREQUENT = 1_000_000
# Pairs that a task counts before it sends them on, and links handled at once.
HELD, LINKS = 2_000_000, 1_000_000
# Letters or spaces in a row from which on a text goes to the slower library, whose time doesn't grow with their square.
UNBROKEN = 2_000
# Bytes of text encoded at once.
CHUNK = 1 << 19

_DIGITS = 5  # of an id, which takes two bytes
_RUN = re.compile(rf"\S{{{UNBROKEN}}}|\s{{{UNBROKEN}}}")


def _byte_of_letter() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, others for letters from 256 on in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class _Bytes:
    """The bytes of every token of a vocabulary in one array."""

    def __init__(self, tokens: list[bytes]):
        if len(tokens) > 1 << 16:
            raise ValueError("ids must fit two bytes")
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        size = self.length[ids]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.at[ids] - (ends - size), size) + np.arange(ends[-1])] if len(ids) else self.flat[:0]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64)))
    return np.fromiter((i for x in lists for i in x), np.int64, offsets[-1]), offsets


class ByteLevel:
    """A byte-level BPE tokenizer file. Where ids follow the merges, they are ranks, and a faster library gives the same ids."""

    def __init__(self, raw: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(raw)
        self.slow.encode_special_tokens = True
        model = json.loads(raw)["model"]
        names, letters = model["vocab"], _byte_of_letter()
        tokens = [b""] * (max(self.slow.get_vocab().values()) + 1)
        for name, i in self.slow.get_vocab().items():
            tokens[i] = bytes(letters[c] for c in name) if name in names and all(c in letters for c in name) else name.encode()
        self.bytes, self.fast = _Bytes(tokens), None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if [names.get(a + b) for a, b in merges] == list(range(256, 256 + len(merges))):
            ranks = {tokens[i]: i for i in range(256 + len(merges))}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _slowly(self, text: str) -> bool:
        return self.fast is None or (len(text) > UNBROKEN and _RUN.search(text) is not None)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [
            self.slow.encode(t, add_special_tokens=False).ids if self._slowly(t) else self.fast.encode_ordinary(t) for t in texts
        ]
        return _flat(lists)


class Pieces:
    """A sentencepiece model file."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        tokens = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            tokens.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        self.bytes = _Bytes(tokens)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat(self.model.encode(texts, num_threads=1) if texts else [])


_loaded: dict[int, tuple[ByteLevel, Pieces]] = {}


def _tokenizers(raw: tuple[str, bytes]) -> tuple[ByteLevel, Pieces]:
    """The two tokenizers of a worker, kept from task to task."""
    key = hash(raw)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteLevel(raw[0]), Pieces(raw[1])
    return _loaded[key]


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """For every token of A, then of B, the token of B that ends its group. Ends are offsets in the same bytes."""
    n = len(a_ends)
    to_b = n + np.searchsorted(b_ends, a_ends)
    to_a = np.searchsorted(a_ends, b_ends)
    to_a = np.where(a_ends[np.minimum(to_a, max(n - 1, 0))] == b_ends, n + np.arange(len(b_ends)), to_a) if n else to_a
    pointer = np.concatenate((to_b, to_a))
    while True:
        farther = pointer[pointer]
        if np.array_equal(farther, pointer):
            return pointer - n
        pointer = farther


class Groups:
    """Tokens of several documents in groups: for every token its group, for every group its first tokens and sizes."""

    def __init__(self, a_sizes: np.ndarray, b_sizes: np.ndarray):
        """Sizes of tokens in bytes; documents follow each other, and both sides have the same bytes in each."""
        last = terminals(np.cumsum(a_sizes), np.cumsum(b_sizes))
        ends = np.zeros(len(b_sizes), bool)
        ends[last] = True
        number = np.cumsum(ends) - 1
        self.a, self.b = number[last[: len(a_sizes)]], number[last[len(a_sizes) :]]
        self.n = int(ends.sum())
        self.a_count, self.b_count = np.bincount(self.a, minlength=self.n), np.bincount(self.b, minlength=self.n)
        self.a_first, self.b_first = np.cumsum(self.a_count) - self.a_count, np.cumsum(self.b_count) - self.b_count

    def text(self, a_ids: np.ndarray, b_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3;`` as bytes, and where the text of every group ends."""
        both = self.a_count + self.b_count
        first = np.cumsum(both) - both
        ids, mark = np.empty(both.sum(), np.int64), np.full(both.sum(), ord(","), np.uint8)
        ids[first[self.a] + np.arange(len(a_ids)) - self.a_first[self.a]] = a_ids
        ids[first[self.b] + self.a_count[self.b] + np.arange(len(b_ids)) - self.b_first[self.b]] = b_ids
        mark[first + self.a_count - 1], mark[first + both - 1] = ord("|"), ord(";")
        wide = np.empty((len(ids), _DIGITS + 1), np.uint8)
        rest, shown = ids.copy(), np.ones((len(ids), _DIGITS + 1), bool)
        for k in range(_DIGITS - 1, -1, -1):
            wide[:, k] = ord("0") + rest % 10
            shown[:, k] = (rest > 0) | (k == _DIGITS - 1)
            rest //= 10
        wide[:, _DIGITS] = mark
        return wide[shown], np.cumsum(shown.sum(axis=1))[first + both - 1]

    def pairs(self, a_ids: np.ndarray, b_ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct (document, id of A, id of B) as one number each, and how often each is linked. ``doc``: that of every group."""
        keys, times = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        links = self.a_count * self.b_count
        # Of a large group the ids are made distinct on both sides before they meet.
        large = links > LINKS // 16
        small = np.flatnonzero(~large)
        cuts = [*np.searchsorted(np.cumsum(links[small]), np.arange(0, links[small].sum(), LINKS)), len(small)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            met = _counted(self._met(small[x:y], a_ids, b_ids, doc))
            keys.append(met[0])
            times.append(met[1])
        for g in np.flatnonzero(large).tolist():
            a, na = np.unique(a_ids[self.a_first[g] : self.a_first[g] + self.a_count[g]], return_counts=True)
            b, nb = np.unique(b_ids[self.b_first[g] : self.b_first[g] + self.b_count[g]], return_counts=True)
            ids = (a[:, None] << 16 | b[None, :]).ravel().astype(np.uint64)
            keys.append(ids | np.uint64(int(doc[g]) << 32))
            times.append((na[:, None] * nb[None, :]).ravel())
        if len(keys) == 2:
            return keys[1], times[1]
        every, n = np.concatenate(keys), np.concatenate(times)
        order = np.argsort(every, kind="stable")
        every, n = every[order], n[order]
        cut = group_starts(every)[:-1]
        return every[cut], np.add.reduceat(n, cut) if len(cut) else n

    def _met(self, some: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
        links = self.a_count[some] * self.b_count[some]
        which = np.repeat(np.arange(len(some)), links)
        step = np.arange(len(which)) - (np.cumsum(links) - links)[which]
        group = some[which]
        i, k = np.divmod(step, self.b_count[group])
        a, b = a_ids[self.a_first[group] + i], b_ids[self.b_first[group] + k]
        return (doc[group].astype(np.uint64) << np.uint64(32)) | (a << 16 | b).astype(np.uint64)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    cut = group_starts(keys)
    return keys[cut[:-1]], np.diff(cut)


def _same_bytes(texts: list[str], ids: np.ndarray, offsets: np.ndarray, vocabulary: _Bytes) -> np.ndarray:
    """Which texts the bytes of their tokens make, with a space before them."""
    raw = vocabulary.of(ids)
    ends = np.concatenate(([0], np.cumsum(vocabulary.length[ids])))[offsets].tolist()
    held = raw.tobytes()
    return np.array([held[a:b] == b" " + t.encode() for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True)], bool)


def _of_rows(ids: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some rows only, and their offsets."""
    size = np.where(rows, np.diff(offsets), 0)
    return ids[np.repeat(rows, np.diff(offsets))], np.concatenate(([0], np.cumsum(size)))


def _doc_of(groups: Groups, a_offsets: np.ndarray) -> np.ndarray:
    """The document of every group, by its first token."""
    return np.searchsorted(a_offsets, groups.a_first, "right") - 1


_SCAN = "doc_id {key}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a binary, b binary, pair array<long>, docs array<long>"


def _binary(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    raw = ids.astype("<u2").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((2 * offsets).astype(np.int32)), pa.py_buffer(raw)])


class _Counts:
    """How many documents hold a pair, over what a task has seen since it last sent them on."""

    def __init__(self):
        self.keys, self.docs, self.new, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.new.append(keys)
        self.held += len(keys)
        if self.held > HELD:
            self.merge()

    def merge(self) -> None:
        if not self.new:
            return
        keys, docs = _counted(np.concatenate(self.new))
        every, n = np.concatenate((self.keys, keys.astype(np.int64))), np.concatenate((self.docs, docs))
        order = np.argsort(every, kind="stable")
        every, n = every[order], n[order]
        cut = group_starts(every)[:-1]
        self.keys, self.docs, self.new, self.held = every[cut], np.add.reduceat(n, cut) if len(cut) else n, [], 0


def _scan(raw, schema: pa.Schema):
    """Tokens and groups of every document; and rows of pairs with this task's numbers of documents."""

    def partial(counts: _Counts) -> Iterator[pa.RecordBatch]:
        counts.merge()
        for i in range(0, len(counts.keys), 100_000):
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in (counts.keys[i : i + 100_000], counts.docs[i : i + 100_000])]
            yield pa.record_batch([*(pa.nulls(1, f.type) for f in list(schema)[:-2]), *lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = _tokenizers(raw.value)
        counts = _Counts()
        for batch in batches:
            for at, to, texts in text_chunks(batch.column("_text"), CHUNK):
                a, a_at = first.encode([f" {t}" for t in texts])
                b, b_at = second.encode(texts)
                told = np.array([t != "" for t in texts]) & _same_bytes(texts, a, a_at, first.bytes) & _same_bytes(texts, b, b_at, second.bytes)
                (a, a_at), (b, b_at) = _of_rows(a, a_at, told), _of_rows(b, b_at, told)
                groups = Groups(first.bytes.length[a], second.bytes.length[b])
                doc = _doc_of(groups, a_at)
                n_groups = np.bincount(doc, minlength=to - at)
                links = np.bincount(doc, weights=groups.a_count * groups.b_count, minlength=to - at).astype(np.int64)
                written, ends = groups.text(a, b)
                held, ends = written.tobytes(), np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(n_groups)))].tolist()
                digests = [hashlib.sha256(held[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends[:-1], ends[1:], strict=True)]
                keys, _ = groups.pairs(a, b, doc)
                counts.add(keys & np.uint64(0xFFFFFFFF))
                columns = [batch.column("doc_id").slice(at, to - at), *(pa.array(v) for v in (np.diff(a_at), np.diff(b_at), n_groups, links))]
                columns += [pa.array(digests), _binary(a, a_at), _binary(b, b_at)]
                yield pa.record_batch([*columns, *(pa.nulls(to - at, f.type) for f in list(schema)[-2:])], schema=schema)
            if len(counts.keys) > HELD:
                yield from partial(counts)
                counts = _Counts()
        yield from partial(counts)

    return run


def _frequent(counts: Stored, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to FREQUENT pairs, those of most documents, sorted: pairs, documents, whether a pair is the best of its first id."""
    level = F.floor(8 * F.log2("docs"))
    held, least = 0, None
    for row in counts.df.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # 8 rows a doubling
        held += row["count"]
        if held > FREQUENT:
            break
        least = row["level"]
    rows = counts.df.where(level >= F.lit(least)).toArrow()
    keys, docs = rows.column("pair").to_numpy(), rows.column("docs").to_numpy()
    order = np.argsort(keys)
    keys, docs = keys[order], docs[order]
    return keys.astype(np.uint32), docs, docs == best[keys >> 16]


_ROW = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "row")


def _weigh(raw, known):
    """Every row with the sums over its links of known pairs, and rows (row, pair, times) for other pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = _tokenizers(raw.value)
        keys, docs, best = known.value
        names = [*_ROW, "n_best", "count_sum", "pair", "times"]
        for batch in batches:
            offsets = np.frombuffer(batch.column("a").buffers()[1], np.int32)[batch.column("a").offset :][: batch.num_rows + 1]
            for at, to in spans_of(offsets, CHUNK):
                a, a_at = _ids(batch.column("a").slice(at, to - at))
                b, _ = _ids(batch.column("b").slice(at, to - at))
                groups = Groups(first.bytes.length[a], second.bytes.length[b])
                found, times = groups.pairs(a, b, _doc_of(groups, a_at))
                doc, pair = (found >> np.uint64(32)).astype(np.int64), (found & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                place = np.searchsorted(keys, pair)
                place[place == len(keys)] = 0
                here = keys[place] == pair if len(keys) else np.zeros(len(pair), bool)
                of, place, n = doc[here], place[here], times[here]
                sums = [np.zeros(to - at, np.int64), np.zeros(to - at, np.int64)]
                np.add.at(sums[0], of, n * best[place])
                np.add.at(sums[1], of, n * docs[place])
                none = pa.nulls(to - at, pa.int64())
                rows = [batch.column(c).slice(at, to - at) for c in _ROW]
                yield pa.record_batch([*rows, *(pa.array(s) for s in sums), none, none], names=names)
                other = np.flatnonzero(~here)
                if len(other):
                    none = pa.nulls(len(other), pa.int64())
                    empty = [pa.nulls(len(other), c.type) for c in rows[:-1]]
                    columns = [*empty, rows[-1].take(pa.array(doc[other])), none, none, pa.array(pair[other].astype(np.int64)), pa.array(times[other])]
                    yield pa.record_batch(columns, names=names)

    return run


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    ids = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]].view("<u2") if raw is not None else np.zeros(0, "<u2")
    return ids.astype(np.int64), (offsets - offsets[0]) // 2


def tokens(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, Stored, object]:
    """The documents with their tokens and groups, and (pair, docs): in how many of them a pair of ids is linked."""
    spark = docs.sparkSession
    with open(first, encoding="utf-8") as one, open(second, "rb") as two:
        raw = spark.sparkContext.broadcast((one.read(), two.read()))
    narrow = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    lists = pa.list_(pa.int64())
    numbers = [(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    schema = pa.schema([*numbers, ("groups_sha256", pa.string()), ("a", pa.binary()), ("b", pa.binary()), ("pair", lists), ("docs", lists)])
    path = new_path(spark, "alignment-tokens")
    scanned = map_batches(narrow, _scan(raw, schema), _SCAN.format(key="bigint")).withColumn("row", F.monotonically_increasing_id())
    scanned.write.option("compression", "zstd").parquet(path)
    both = spark.read.schema(scanned.schema).parquet(path)
    some = both.where("pair IS NOT NULL").select(F.explode(F.arrays_zip("pair", "docs")).alias("p")).select("p.pair", "p.docs")
    counts = store(some.groupBy("pair").agg(F.sum("docs").alias("docs")), "alignment-counts")
    return both.where("pair IS NULL").drop("pair", "docs"), counts, raw


def align(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``.

    ``first`` is a byte-level BPE file that gets each text with a space before it, ``second`` a sentencepiece file that adds
    the space itself. Places where tokens of both end cut a text into groups; every pair of tokens of a group is a link. The
    count of a pair of ids is the number of rows that hold it linked; ``n_best`` counts the links of a row whose pair has the
    highest count of its first id, ties included, and ``count_sum`` adds the counts up over all links.

    NULL and empty texts, and those whose tokens do not make up the space and the text, have zeros and an empty digest. The
    texts of special tokens are plain text. Rows are neither merged nor dropped, whatever their key; rows with equal texts count
    each. Other columns are ignored, whatever their names. No pair, group or text is capped.
    """
    spark = docs.sparkSession
    rows, counts, raw = tokens(docs, first, second, key, text)
    # One number for each id of the first vocabulary, which has fewer than 2^16.
    highest = counts.df.groupBy(F.shiftright("pair", 16).alias("id")).agg(F.max("docs").alias("most")).toArrow()
    best = np.zeros(1 << 16, np.int64)
    best[highest.column("id").to_numpy()] = highest.column("most").to_numpy()
    known = spark.sparkContext.broadcast(_frequent(counts, best))
    numbers = "n_best long, count_sum long, pair long, times long"
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in _ROW)
    weighed = map_batches(rows.select(*_ROW, "a", "b"), _weigh(raw, known), f"{kinds}, {numbers}")
    if counts.rows > len(known.value[0]):
        weighed = store(weighed, "alignment-weighed").df
        most = F.broadcast(spark.createDataFrame(highest))
        others = weighed.where("pair IS NOT NULL").select("row", "pair", "times").join(counts.df, "pair").withColumn("id", F.shiftright("pair", 16))
        share = F.sum(F.when(F.col("docs") == F.col("most"), F.col("times")).otherwise(0)).alias("best_of_others")
        others = others.join(most, "id").groupBy("row").agg(share, F.sum(F.col("times") * F.col("docs")).alias("sum_of_others"))
        weighed = weighed.where("pair IS NULL").join(others, "row", "left")
        weighed = weighed.withColumn("n_best", F.col("n_best") + F.coalesce("best_of_others", F.lit(0)))
        weighed = weighed.withColumn("count_sum", F.col("count_sum") + F.coalesce("sum_of_others", F.lit(0)))
    return weighed.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
