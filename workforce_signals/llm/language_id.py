"""Language of texts by segmentation-marginalised unigrams.

Every language has a probability for each piece of one fixed public vocabulary. The probability of a word is the sum over
all ways to cut it into pieces, which a forward pass over its letters adds up; a text's is the product over its words.
Piece probabilities come from expectation maximisation over words of labelled texts.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workforce_signals.llm.arrays import constants, mix, strings, text_chunks
from workforce_signals.llm.workers import map_batches
from workforce_signals.plans.stored import store

# Labelled texts that a language is learned from: a bounded sample, those with the smallest hashes of their ids.
SAMPLE_DOCS, MOST_LANGUAGES = 300, 400
ROUNDS, SMOOTHING = 4, 0.05
# Letters per word; longer runs of letters are read as several words.
LONGEST = 40
# Words kept with their scores in a worker; beyond it the cache starts anew.
CACHED = 300_000
# Bytes of text scored at once; new words are then looked up many at a time.
CHUNK = 4 << 20
UNKNOWN = "und"
# Keeps products of many small probabilities within range: every letter counts this much more.
_LIFT = 12.0
_EDGE = "▁"

_WORD = re.compile(r"[^\W\d_]+")
_BASE = int(constants(1, 71)[0])


def vocabulary_pieces(path: str) -> list[str]:
    """Distinct lower-case pieces of letters in a sentencepiece model, with its mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i)))
    return sorted({p for p in pieces if p.removeprefix(_EDGE).isalpha() or p == _EDGE})


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case, LONGEST letters each at most. Other signs separate."""
    return _WORD.findall(text.lower())


def _letters(word: str) -> list[str]:
    word = word if word.isalpha() else "".join(c for c in word if c.isalpha())
    return [word[i : i + LONGEST] for i in range(0, len(word), LONGEST)]


class Lattice:
    """Finds the pieces inside words, by hashes of their letters, many words of one length at a time.

    From every letter of the words the search goes on only as long as some piece begins with what it has read.
    """

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        beginnings = sorted({p[:n] for p in pieces for n in range(1, len(p) + 1)})
        number = {p: i for i, p in enumerate(pieces)}
        self.piece_of = np.array([*(number.get(b, len(pieces)) for b in beginnings), len(pieces)], np.int32)
        self.powers = np.full(LONGEST + 2, _BASE, np.uint64)
        self.powers[0] = 1
        self.powers = np.multiply.accumulate(self.powers)
        self.inverse = np.full(LONGEST + 2, pow(_BASE, -1, 1 << 64), np.uint64)
        self.inverse[0] = 1
        self.inverse = np.multiply.accumulate(self.inverse)
        hashes = np.array([self._hash(b) for b in beginnings], np.uint64)
        # Two tables of slots; what the first cannot place goes to the second, the rest is searched.
        self.slots, left = [], np.arange(len(beginnings))
        for shift in (44, 24):
            slot = ((hashes[left] >> np.uint64(shift)) & np.uint64((1 << 20) - 1)).astype(np.int64)
            table = np.full(1 << 20, len(beginnings), np.int32)
            table[slot[::-1]] = left[::-1]
            self.slots.append((np.uint64(shift), table))
            left = left[table[slot] != left]
        self.left = left
        self.hashes = np.concatenate((hashes, np.zeros(1, np.uint64)))

    def _hash(self, piece: str) -> np.uint64:
        points = np.array([[ord(c) for c in piece]], np.uint64)
        return mix(self._prefix(points)[:, -1])[0]

    def _prefix(self, points: np.ndarray) -> np.ndarray:
        total = np.zeros((len(points), points.shape[1] + 1), np.uint64)
        np.cumsum(mix(points) * self.powers[: points.shape[1]], axis=1, out=total[:, 1:])
        return total

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash, or the number of pieces if there is none."""
        return self.piece_of[self.beginning(hashes)]

    def beginning(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the beginning of a piece with each hash, or the number of beginnings if there is none."""
        none = len(self.hashes) - 1
        out = np.full(len(hashes), none, np.int32)
        for shift, table in self.slots:
            got = table[((hashes >> shift) & np.uint64((1 << 20) - 1)).astype(np.int64)]
            same = self.hashes[got] == hashes
            out[same & (got < none)] = got[same & (got < none)]
        for i in self.left.tolist():
            out[hashes == self.hashes[i]] = i
        return out

    def arcs(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, piece) for words of one length, starts ascending; letters without a piece count as unknown."""
        size = len(words[0]) + 1
        points = np.frombuffer("".join(_EDGE + w for w in words).encode("utf-32-le"), np.uint32).reshape(-1, size)
        total = self._prefix(points.astype(np.uint64))
        every, none = np.arange(len(words)), len(self.hashes) - 1
        for a in range(size):
            rows, before = every, total[:, a]
            for end in range(a + 1, min(size, a + self.longest) + 1):
                begun = self.beginning(mix((total[rows, end] - before[rows]) * self.inverse[a]))
                piece, more = self.piece_of[begun], begun < none
                if end == a + 1:
                    yield a, end, rows, piece
                else:
                    whole = piece < len(self.pieces)
                    if whole.any():
                        yield a, end, rows[whole], piece[whole]
                rows = rows[more]
                if not len(rows):
                    break


def by_length(words: list[str], most: int = 5_000) -> Iterator[list[int]]:
    """Places of words of equal length, a bounded number at a time."""
    groups = defaultdict(list)
    for i, w in enumerate(words):
        groups[len(w)].append(i)
    for some in groups.values():
        for a in range(0, len(some), most):
            yield some[a : a + most]


@dataclass
class LanguageModel:
    """Languages, pieces and the probabilities of the pieces; the last row is for a letter without a piece."""

    languages: list[str]
    pieces: list[str]
    probability: np.ndarray
    lattice: Lattice | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"languages": self.languages, "pieces": self.pieces, "probability": self.probability, "lattice": None}

    def _lifted(self) -> np.ndarray:
        if self.lattice is None:
            self.lattice = Lattice(self.pieces)
        length = np.array([*map(len, self.pieces), 1])
        return self.probability * _LIFT ** length[:, None]

    def log_words(self, words: list[str]) -> np.ndarray:
        """Logarithm of each word's probability in each language, less a constant that all share."""
        out, lifted = np.zeros((len(words), len(self.languages))), self._lifted()
        for some in by_length(words):
            group = [words[i] for i in some]
            forward = np.zeros((len(group[0]) + 2, len(group), len(self.languages)))
            forward[0] = 1
            for a, b, rows, piece in self.lattice.arcs(group):
                if len(rows) == len(group):
                    forward[b] += forward[a] * lifted[piece]
                else:
                    forward[b, rows] += forward[a, rows] * lifted[piece]
            out[some] = np.log(np.maximum(forward[-1], 1e-300))
        return out


def fit(counts: dict[str, Counter], pieces: list[str]) -> LanguageModel:
    """Piece probabilities of every language from its words' counts, by expectation maximisation."""
    languages = sorted(counts)
    words = sorted({w for c in counts.values() for w in c})
    weight = np.array([[counts[name][w] for name in languages] for w in words], np.float64).reshape(len(words), len(languages))
    n = len(pieces) + 1
    model = LanguageModel(languages, pieces, np.full((n, len(languages)), 1.0 / n))
    for _ in range(ROUNDS):
        expected, lifted = np.full((n, len(languages)), SMOOTHING), model._lifted()
        for some in by_length(words):
            group, w = [words[i] for i in some], weight[some]
            size = len(group[0]) + 1
            arcs = list(model.lattice.arcs(group))
            forward = np.zeros((size + 1, len(group), len(languages)))
            backward = np.zeros_like(forward)
            forward[0], backward[size] = 1, 1
            for a, b, rows, piece in arcs:
                forward[b, rows] += forward[a, rows] * lifted[piece]
            for a, b, rows, piece in reversed(arcs):
                backward[a, rows] += backward[b, rows] * lifted[piece]
            share = w / np.maximum(forward[size], 1e-300)
            for a, b, rows, piece in arcs:
                np.add.at(expected, piece, forward[a, rows] * lifted[piece] * backward[b, rows] * share[rows])
        model.probability = expected / expected.sum(axis=0)
    return model


class Scorer:
    """Scores texts with a cache of words."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.cache: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)))
        self.known = np.zeros(0, bool)

    def learn(self, words: list[str]) -> None:
        parts = [_letters(w) for w in words]
        owner = np.repeat(np.arange(len(words)), [len(p) for p in parts])
        flat = [x for p in parts for x in p]
        fresh = np.zeros((len(words), len(self.model.languages)))
        if flat:
            np.add.at(fresh, owner, self.model.log_words(flat))
        self.cache.update(zip(words, range(len(self.cache), len(self.cache) + len(words)), strict=True))
        self.scores = np.concatenate((self.scores, fresh))
        self.known = np.concatenate((self.known, np.array([bool(p) for p in parts], bool)))

    def texts(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and its posterior of every text; the first in alphabetical order of equal ones."""
        found = [words_of(t) for t in texts]
        every = [w for ws in found for w in ws]
        if len(self.cache) > CACHED:
            self.forget()
        if new := [w for w in set(every) if w not in self.cache]:
            self.learn(new)
        at = np.fromiter(map(self.cache.__getitem__, every), np.int64, len(every))
        offsets = np.concatenate(([0], np.cumsum([len(ws) for ws in found])))
        # Summed text by text: a text's score must not depend on what is scored beside it.
        filled = offsets[1:] > offsets[:-1]
        sums = np.zeros((len(texts), self.scores.shape[1]))
        if filled.any():
            sums[filled] = np.add.reduceat(self.scores[at], offsets[:-1][filled], axis=0)
        letters = np.concatenate(([0], np.cumsum(self.known[at])))
        some = letters[offsets[1:]] > letters[offsets[:-1]]
        if not self.model.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = sums.argmax(axis=1)
        share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        names = [self.model.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)]
        return names, np.where(some, share, 0.0)


_scorers: dict[str, Scorer] = {}


def _predict(shared, mark: str):
    """``mark`` names the model; a worker keeps one with its cache from task to task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mark not in _scorers:
            _scorers.clear()
            _scorers[mark] = Scorer(shared.value)
        scorer = _scorers[mark]
        for batch in batches:
            for a, b, texts in text_chunks(batch.column("_text"), CHUNK):
                names, share = scorer.texts(texts)
                keys = batch.column("_id").slice(a, b - a)
                yield pa.record_batch([keys, pa.array(names, pa.string()), pa.array(share)], names=["_id", "lang_pred", "score"])

    return run


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of a batch by language."""
    for batch in batches:
        counts: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column("_lang").to_pylist(), strings(batch.column("_text")), strict=True):
            counts[lang].update(x for w in words_of(text) for x in _letters(w))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        yield pa.record_batch(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))],
            names=["lang", "word", "n"],
        )


def held_out(key: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``; not so without an id."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))


def train(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learns the languages that label texts which are not held out: of SAMPLE_DOCS ids a language at most, those of least hash, one
    text each, so that no id weighs more than another. Beyond MOST_LANGUAGES the rarer ones, by number of ids, are not learned.

    ``path`` is a sentencepiece model, of which only the pieces are used. Rows without id, text or language
    teach nothing.
    """
    narrow = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    known = narrow.where("_id IS NOT NULL AND _text IS NOT NULL AND _lang IS NOT NULL").where(~held_out("_id"))
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    pairs = store(known.select("_id", "_lang").distinct(), "language-ids").df
    learned = pairs.groupBy("_lang").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_lang").limit(MOST_LANGUAGES)
    chosen = pairs.join(F.broadcast(learned.select("_lang")), "_lang", "left_semi")
    chosen = chosen.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= SAMPLE_DOCS).select("_id", "_lang")
    chosen = store(chosen, "language-sample").df  # SAMPLE_DOCS * MOST_LANGUAGES rows at most
    texts = known.join(F.broadcast(chosen), ["_id", "_lang"], "left_semi").groupBy("_id", "_lang")
    texts = texts.agg(F.min(F.struct(F.xxhash64("_text"), "_text")).alias("least")).select("_lang", "least._text")
    found = map_batches(texts.select("_lang", "_text"), _count_words, "lang string, word string, n bigint")
    counts: dict[str, Counter] = defaultdict(Counter)
    for row in found.groupBy("lang", "word").agg(F.sum("n").alias("n")).collect():  # the words of the sample
        counts[row["lang"]][row["word"]] = row["n"]
    return fit(counts, vocabulary_pieces(path))


def predict(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, held_out, lang_pred, score) of every whole text.

    ``und`` with score 0 for NULL texts and texts without a letter, and where no language was learned. Rows are
    neither merged nor dropped; other columns are left out, whatever their names.
    """
    narrow = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    kind = narrow.schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = map_batches(narrow, _predict(shared, uuid.uuid4().hex), f"_id {kind}, lang_pred string, score double")
    return found.select(F.col("_id").alias(key), held_out("_id").alias("held_out"), "lang_pred", "score")
