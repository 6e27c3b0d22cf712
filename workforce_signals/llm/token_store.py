"""Token ids as compact files: one zstandard frame per document, compressed with a dictionary all frames share.

A store is a folder of two Parquet tables, so that Spark's writers commit it and its readers find it on any file system:

* ``dictionary``: one row with the trained dictionary, its SHA-256, the width of an id in bytes and the end id;
* ``segments``: runs of documents in ascending id order. A segment has the ids, token counts and byte offsets of its
  documents, one block of frames and the hash of the dictionary they need.

A short document is read by picking its segment (first and last id are columns) and cutting one frame out of it.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from workforce_signals.llm.arrays import text_chunks
from workforce_signals.llm.id_cache import IdCache
from workforce_signals.llm.workers import map_batches

# Documents that the dictionary is trained on, one an id and by hash of the id, and how much of each: a bounded sample.
SAMPLE_DOCS, SAMPLE_BYTES = 1_000, 16_384
DICTIONARY_BYTES = 65_536
LEVEL = 3
# A segment ends after so many documents or bytes; a larger document is a segment of its own.
SEGMENT_DOCS, SEGMENT_BYTES = 1_024, 4 << 20
# Words kept with their ids in a worker.
CACHED = 600_000
# ASCII signs that are never one token with a letter before them. An apostrophe may be.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# Lower-case letters that the tokenizer's rules leave as they are and never cut between, and the signs that
# byte-level vocabularies write for bytes (those that can be seen stand for themselves, the others follow from 256 on).
_LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff\u0101\u0103\u0105\u0107\u010d\u0119\u011b\u0142\u0144\u0153\u0159\u015b\u0161\u017a\u017c\u017e]+")
# Signs among which lower-casing before normalising could make a difference.
_COMPOSING = re.compile("[\u0130\u0300-\U0010ffff]")
_SEEN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SEEN)}

_loaded: dict[int, Words] = {}


class Words:
    """The tokenizer over words: its rules never reach across a space or a line end, so each word is encoded once."""

    def __init__(self, raw: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.raw, self.library = raw.decode(), None
        self.special = [t["content"] for t in json.loads(raw).get("added_tokens") or () if t["special"]]
        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.tokenizer.encode_special_tokens = True
        self.stems = IdCache(self._encode, CACHED)
        self.cache = IdCache(self._learn, CACHED)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words: Latin letters in lower case go straight to the model, others through all of the tokenizer."""
        found, rest, tokenize = [], [], self.tokenizer.model.tokenize
        for i, word in enumerate(words):
            if _LATIN.fullmatch(word):
                signs = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
                found.append([t.id for t in tokenize(signs)])
            else:
                found.append(None)
                rest.append(i)
        if rest:
            whole = self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)
            for i, encoded in zip(rest, whole, strict=True):
                found[i] = encoded.ids
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, counts.sum()), counts

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words. Signs after a last letter are tokens of their own, so words share what is before them."""
        parts, first = [], []
        for word in words:
            first.append(len(parts))
            stem = word.rstrip(_SIGNS)
            low = stem.lower()
            if _LATIN.fullmatch(low):  # lower-casing these letters is what the tokenizer does
                parts.append(low)
                if len(stem) < len(word):
                    parts.append(word[len(stem) :])
            elif len(stem) < len(word) and stem and unicodedata.normalize("NFC", stem[-1]).lower()[-1].isalpha():
                parts += stem, word[len(stem) :]
            else:
                parts.append(word)
        ids, counts = self.stems.encode(parts)
        return ids, np.add.reduceat(counts, first)

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, ``end_id`` after each, and the n + 1 offsets of the texts in them.

        A special token that a text spells out is that token, as in the library, which encodes such texts itself.
        """
        joined = " ".join(texts)
        if any(s in joined for s in self.special):
            spelled = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
            if spelled:
                return self._with_special(texts, spelled, end_id)
        joined = joined.replace("\n", " ")
        if not _COMPOSING.search(joined):
            joined = joined.lower()  # as the tokenizer does to these letters; fewer words are then distinct
        words = joined.split(" ")
        per_text = np.fromiter((t.count(" ") + t.count("\n") + 1 for t in texts), np.int64, len(texts))
        ids, counts = self.cache.encode(words)
        sizes = np.add.reduceat(counts, np.cumsum(per_text) - per_text) if len(texts) else np.zeros(0, np.int64)
        offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
        out = np.full(offsets[-1], end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), sizes)] = ids
        return out, offsets


    def _with_special(self, texts: list[str], spelled: list[int], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.raw)
        whole = self.library.encode_batch_fast([texts[i] for i in spelled], add_special_tokens=False)
        ids, offsets = self.encode([t for i, t in enumerate(texts) if i not in set(spelled)], end_id)
        others = iter(np.split(ids, offsets[1:-1]) if len(offsets) > 1 else [])
        own = {i: np.array([*e.ids, end_id], np.uint32) for i, e in zip(spelled, whole, strict=True)}
        parts = [own[i] if i in own else next(others) for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def _words(raw: bytes) -> Words:
    key = hash(raw)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Words(raw)
    return _loaded[key]


def _serialized(vocabulary, end_id: int, width: int) -> Iterator:
    """Serialized ids of every document: little-endian, ``width`` bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
        words = _words(vocabulary.value)
        for batch in batches:
            for a, b, texts in text_chunks(batch.column("_text")):
                ids, offsets = words.encode(texts, end_id)
                raw = ids.astype(f"<u{width}").tobytes()
                yield batch.column("_key").slice(a, b - a), [
                    raw[width * i : width * j] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
                ]

    return run


def _samples(vocabulary, end_id: int, width: int):
    serialized = _serialized(vocabulary, end_id, width)

    def run(batches):
        for keys, found in serialized(batches):
            yield pa.record_batch([keys, pa.array([f[:SAMPLE_BYTES] for f in found], pa.binary())], names=["key", "ids"])

    return run


def _frames(vocabulary, dictionary, end_id: int, width: int):
    serialized = _serialized(vocabulary, end_id, width)

    def run(batches):
        raw = dictionary.value
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw)).compress
        for keys, found in serialized(batches):
            frames = pa.array([pack(f) for f in found], pa.binary())
            yield pa.record_batch([keys, pa.array([len(f) // width for f in found], pa.int64()), frames], names=["doc_id", "n_tokens", "frame"])

    return run


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from serialized ids; the samples themselves, cut to size, where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _segments(digest: str):
    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        keys, counts, frames, size = [], [], [], 0

        def close():
            known = [k for k in keys if k is not None]
            return pa.record_batch(
                [
                    pa.array([part], pa.int32()),
                    pa.array([seq], pa.int32()),
                    pa.array([known[0] if known else None], pa.int64()),
                    pa.array([known[-1] if known else None], pa.int64()),
                    pa.array([sum(counts)], pa.int64()),
                    pa.array([keys], pa.list_(pa.int64())),
                    pa.array([counts], pa.list_(pa.int64())),
                    pa.array([np.cumsum([0, *map(len, frames)])], pa.list_(pa.int64())),
                    pa.array([b"".join(frames)], pa.binary()),
                    pa.array([digest]),
                ],
                names=["part", "seq", "first_id", "last_id", "tokens", "doc_ids", "counts", "offsets", "frames", "dictionary"],
            )

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "frame")), strict=True)
            for key, count, frame in rows:
                if keys and (len(keys) >= SEGMENT_DOCS or size + len(frame) > SEGMENT_BYTES):
                    yield close()
                    keys, counts, frames, size, seq = [], [], [], 0, seq + 1
                keys.append(key)
                counts.append(count)
                frames.append(frame)
                size += len(frame)
        if keys:
            yield close()

    return run


_SEGMENT = (
    "part int, seq int, first_id bigint, last_id bigint, tokens bigint, doc_ids array<bigint>, counts array<bigint>, "
    "offsets array<bigint>, frames binary, dictionary string"
)


def write_tokens(docs: DataFrame, vocabulary_path: str, out: str, end_id: int = 1, key: str = "doc_id", text: str = "text") -> None:
    """Encodes every whole text, adds ``end_id`` and writes the store ``out`` in ascending id order.

    NULL and empty texts hold the end id alone. Rows without an id come first; rows that share an id are all kept, in
    the order of their content. Other columns are left out. An empty table makes a store without segments.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, "rb") as file:
        raw = file.read()
    size = Words(raw).tokenizer.get_vocab_size()
    width = 2 if max(size - 1, end_id) < 1 << 16 else 4
    vocabulary = spark.sparkContext.broadcast(raw)
    narrow = docs.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text"))
    chosen = narrow.select("_key").where("_key IS NOT NULL").distinct().orderBy(F.xxhash64("_key"), "_key").limit(SAMPLE_DOCS)
    least = F.min(F.struct(F.xxhash64("_text"), "_text")).alias("least")
    texts = narrow.join(F.broadcast(chosen), "_key", "left_semi").groupBy("_key").agg(least).select("_key", "least._text")
    sample = map_batches(texts, _samples(vocabulary, end_id, width), "key bigint, ids binary")
    trained = train_dictionary([bytes(r["ids"]) for r in sample.orderBy("key").collect()])  # SAMPLE_DOCS at most
    digest = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(digest, bytearray(trained), width, end_id)], "sha256 string, data binary, width int, end_id int").write.parquet(f"{out}/dictionary")
    shared = spark.sparkContext.broadcast(trained)
    staged = f"{out}/staged"
    frames = map_batches(narrow, _frames(vocabulary, shared, end_id, width), "doc_id bigint, n_tokens bigint, frame binary")
    frames.write.option("compression", "none").parquet(staged)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = ["doc_id", F.xxhash64("frame")]
    rows = spark.read.parquet(staged).repartitionByRange(tasks, *order).sortWithinPartitions(*order, "frame")
    map_batches(rows, _segments(digest), _SEGMENT).write.option("compression", "none").parquet(f"{out}/segments")


def _unpack(dictionary: bytes, width: int):
    digest = hashlib.sha256(dictionary).hexdigest()

    def run(batches):
        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != digest:
                    raise ValueError(f"a segment needs the dictionary {row['dictionary']}, the store has {digest}")
                pick = row["pick"] if "pick" in row else range(len(row["doc_ids"]))
                starts = np.cumsum([row["base"], *row["counts"]])
                cut = row["offsets"]
                ids = [
                    np.frombuffer(unpack(row["frames"][cut[i] : cut[i + 1]]), f"<u{width}").astype("<u4").tobytes() for i in pick
                ]
                yield pa.record_batch(
                    [
                        pa.array([row["doc_ids"][i] for i in pick], pa.int64()),
                        pa.array([starts[i] for i in pick], pa.int64()),
                        pa.array([row["counts"][i] for i in pick], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return run


def _with_base(segments: DataFrame) -> DataFrame:
    """Each segment with the number of ids before it: sums per part first, so that only those are ordered as a whole."""
    narrow = segments.select("part", "seq", "tokens")
    parts = narrow.groupBy("part").agg(F.sum("tokens").alias("sum"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    base = narrow.withColumn("inner", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(F.broadcast(parts), "part")
    return segments.join(F.broadcast(base.select("part", "seq", (F.col("ahead") + F.col("inner")).alias("base"))), ["part", "seq"])


_READ = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of a store; ``ids`` are little-endian unsigned 32-bit integers."""
    head = spark.read.parquet(f"{path}/dictionary").first()
    segments = _with_base(spark.read.schema(_SEGMENT).parquet(f"{path}/segments"))
    return map_batches(segments, _unpack(bytes(head["data"]), head["width"]), _READ)


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents: their segments are found by id, and no other frame is unpacked."""
    head = spark.read.parquet(f"{path}/dictionary").first()
    if not doc_ids:
        return spark.createDataFrame([], _READ)
    segments = spark.read.schema(_SEGMENT).parquet(f"{path}/segments")
    near = None
    for i in doc_ids:
        here = (F.col("first_id") <= i) & (F.col("last_id") >= i)
        near = here if near is None else near | here
    wanted = F.array(*[F.lit(i).cast("bigint") for i in doc_ids])
    at = F.filter(F.sequence(F.lit(0), F.size("doc_ids") - 1), lambda i: F.array_contains(wanted, F.get("doc_ids", i)))
    picked = _with_base(segments).where(near).withColumn("pick", at)
    return map_batches(picked, _unpack(bytes(head["data"]), head["width"]), _READ)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a store, read from its files."""
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
