"""Personal data in texts: fixed patterns and a skip-chain conditional random field.

Patterns give the base spans. The field then labels the tokens that hold a digit or an at sign (all others cannot be
personal data of these kinds, which keeps their label fixed). Neighbouring tokens share a chain potential, and tokens
of one document that repeat each other, or end in the same digits, share a skip potential however far apart they are.
Loopy message passing brings the labels of a document into line, so that a number that stands once with its country code and
once without is found both times: tokens of base spans are evidence, whose label is fixed and passed on.

The weights are learned by pseudo-likelihood from texts with their base spans. What the patterns need is held out there: every text
gets second mentions of its numbers without the country code or the first digit, which have the label of the number, and
other numbers of the same form, which have none. So it takes a repeat, and not the form alone, to make a label likely. Repeats that
a text has by itself teach nothing, since their label is not known.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workforce_signals.llm.arrays import strings, text_chunks
from workforce_signals.llm.workers import map_batches

# The kinds in their order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SOME = r"[0-9@]"

# Documents that the field is trained on, a bounded sample by hash of the id, and tokens that one may add.
SAMPLE_DOCS, SAMPLE_TOKENS = 4_000, 2_000
STEPS, RATE, DECAY = 200, 0.5, 1e-3
# Rounds of message passing, damping, and the certainty from which a label counts.
ROUNDS, DAMPING, CERTAIN = 12, 0.3, 0.9
LABELS = 1 + len(KINDS)
# Numbers of a text that get a second mention in training, and the log-odds of a base span's label.
MENTIONED, EVIDENCE = 16, 30.0
# The label of tokens that teach nothing.
UNKNOWN = -1
# Digits that tokens which are alike end in.
ALIKE = 7

_HINTS = (
    frozenset("mail email e-mail contact".split()),
    frozenset("call phone tel telephone fax mobile".split()),
    frozenset("card visa credit mastercard".split()),
    frozenset("ip host server address".split()),
)

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _at_most_255(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) < 3 or len(short) == 3 and short <= "255"


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start and kind: leftmost and apart within a kind; those that fail a test are dropped."""
    spans = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_at_most_255, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        spans += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(spans)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


@dataclass
class Graph:
    """Tokens of one document that may hold personal data, their features and the pairs that share potentials."""

    starts: list[int]
    ends: list[int]
    features: np.ndarray
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


_TOKEN = re.compile(r"\S+")
_HAS = re.compile(_SOME)
_FIGURES = re.compile(r"[0-9 ().+-]+")
_EDGES = ".,;:!?\"'#$%&*|<>[]{}"
FEATURES = 29


def graph(text: str) -> Graph:
    starts, ends, tokens, places, words = [], [], [], [], []
    before = ""
    for place, m in enumerate(_TOKEN.finditer(text)):
        if _HAS.search(m[0]):
            tokens.append(m[0])
            starts.append(m.start())
            ends.append(m.end())
            places.append(place)
            words.append(before)
        before = m[0]
    n = len(tokens)
    x = np.zeros((n, FEATURES), np.float32)
    bare = [t.strip(_EDGES) for t in tokens]
    digits = [_digits(t) for t in bare]
    plain = [bool(b) and _FIGURES.fullmatch(b) is not None for b in bare]
    chain = [(i, i + 1) for i in range(n - 1) if places[i + 1] == places[i] + 1]
    run = np.arange(n)
    for i, j in chain:
        if plain[i] and plain[j] and not bare[j].startswith("+"):
            run[j] = run[i]
    total = np.bincount(run, [len(d) for d in digits], n) if n else np.zeros(0)
    linked_before, linked_after = {j for _, j in chain}, {i for i, _ in chain}
    for i, (t, d) in enumerate(zip(bare, digits, strict=True)):
        groups = t.split(".")
        four = len(groups) == 4 and all(g.isascii() and g.isdigit() for g in groups)
        letters = sum(c.isalpha() for c in t)
        at = t.find("@")
        size, whole = len(d), total[run[i]]
        hint = words[i].strip(_EDGES).lower()
        x[i] = (
            1, at >= 0, at > 0 and "." in t[at + 1 :], t.startswith("+"), "(" in t or ")" in t, four,
            four and all(map(_at_most_255, groups)), 1 <= size <= 2, size == 3, 4 <= size <= 6, 7 <= size <= 9, 10 <= size <= 13,
            14 <= size <= 19, size > 19, plain[i], letters > 0, "-" in t, 14 <= size <= 19 and luhn(d), "=" in t or '"' in t,
            i in linked_before, i in linked_after, i in linked_before and tokens[i - 1].startswith("+"), 10 <= whole <= 15,
            14 <= whole <= 19, letters >= max(1, size), *(hint in h for h in _HINTS),
        )
    skip, last = [], {}
    for i, (t, d) in enumerate(zip(bare, digits, strict=True)):
        # Each token is linked to the one before that repeats it or ends alike, so links grow with the tokens.
        for key in {("same", t.lower()), *([("alike", d[-ALIKE:])] if len(d) >= ALIKE and letters_few(t) else [])}:
            if key in last and (last[key], i) not in skip[-2:]:
                skip.append((last[key], i))
            last[key] = i
    return Graph(starts, ends, x, chain, skip)


def letters_few(token: str) -> bool:
    return not any(c.isalpha() for c in token)


def labels_of(g: Graph, spans: list[Span]) -> np.ndarray:
    """1 + kind for tokens that meet a span, 0 for others; the first span counts."""
    out = np.zeros(len(g.starts), np.int64)
    i = 0
    for a, kind, b in spans:
        i = int(np.searchsorted(g.ends, a, "right"))
        while i < len(out) and g.starts[i] < b:
            out[i] = out[i] or kind + 1
            i += 1
    return out


@dataclass(frozen=True)
class Field:
    """Weights: of features by label, of pairs in the chain, of pairs that are alike."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def fit_field(graphs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Field | None:
    """Weights that make every token's label likely given its features and its neighbours' labels.

    ``graphs``: features, labels, chain pairs, skip pairs. Tokens labelled UNKNOWN teach nothing, nor do pairs with them. None without
    tokens.
    """
    if not graphs or not sum(len(g[1]) for g in graphs):
        return None
    offsets = np.cumsum([0, *(len(g[1]) for g in graphs)])
    x, y = np.concatenate([g[0] for g in graphs]).astype(np.float64), np.concatenate([g[1] for g in graphs])
    pairs = [np.concatenate([g[k].reshape(-1, 2) + o for g, o in zip(graphs, offsets, strict=False)]).astype(np.int64) for k in (2, 3)]
    known = y != UNKNOWN
    pairs, y = [p[known[p].all(axis=1)] for p in pairs], np.maximum(y, 0)
    n, one = len(y), np.eye(LABELS)
    unary, tables = np.zeros((x.shape[1], LABELS)), [np.zeros((LABELS, LABELS)) for _ in pairs]
    first, second = [np.zeros_like(unary), *map(np.zeros_like, tables)], [np.zeros_like(unary), *map(np.zeros_like, tables)]
    for step in range(1, STEPS + 1):
        score = x @ unary
        for (i, j), t in zip((p.T for p in pairs), tables, strict=True):
            np.add.at(score, i, t[:, y[j]].T)
            np.add.at(score, j, t[y[i], :])
        miss = (one[y] - _softmax(score)) * known[:, None]
        slopes = [x.T @ miss / n - DECAY * unary]
        for (i, j), t in zip((p.T for p in pairs), tables, strict=True):
            g = np.zeros_like(t)
            np.add.at(g.T, y[j], miss[i])
            np.add.at(g, y[i], miss[j])
            slopes.append(g / n - DECAY * t)
        for k, (w, g) in enumerate(zip([unary, *tables], slopes, strict=True)):  # Adam
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            w += RATE * 0.2 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    # Alike tokens count both ways.
    return Field(unary, tables[0], (tables[1] + tables[1].T) / 2)


def marginals(field: Field, features: np.ndarray, chain: np.ndarray, skip: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """Label probabilities of every token by loopy message passing over chain and skip pairs. ``known``: labels that are evidence,
    where not 0."""
    own = features @ field.unary
    if known is not None:
        given = np.flatnonzero(known)
        own[given] = 0.0
        own[given, known[given]] = EVIDENCE
    i = np.concatenate((chain[:, 0], skip[:, 0])).astype(np.int64)
    j = np.concatenate((chain[:, 1], skip[:, 1])).astype(np.int64)
    if not len(i):
        return _softmax(own)
    table = np.concatenate((np.repeat(field.chain[None], len(chain), 0), np.repeat(field.skip[None], len(skip), 0)))
    forth, back = np.zeros((len(i), LABELS)), np.zeros((len(i), LABELS))

    def told(belief, against, by):
        x = (belief - against)[:, :, None] + by
        top = x.max(axis=1, keepdims=True)
        out = np.log(np.exp(x - top).sum(axis=1)) + top[:, 0]
        return out - out.max(axis=1, keepdims=True)

    for _ in range(ROUNDS):
        belief = own.copy()
        np.add.at(belief, j, forth)
        np.add.at(belief, i, back)
        new_forth = told(belief[i], back, table)
        new_back = told(belief[j], forth, table.transpose(0, 2, 1))
        forth = DAMPING * forth + (1 - DAMPING) * new_forth
        back = DAMPING * back + (1 - DAMPING) * new_back
    belief = own.copy()
    np.add.at(belief, j, forth)
    np.add.at(belief, i, back)
    return _softmax(belief)


def _pairs(found: list[tuple[int, int]]) -> np.ndarray:
    return np.array(found, np.int64).reshape(-1, 2)


def _admissible(kind: int, text: str) -> bool:
    """What a span of a kind must hold at least, whatever the field says."""
    size = len(_digits(text))
    if kind == 0:
        name, _, domain = text.partition("@")
        return bool(name) and "." in domain.strip(".")
    if kind == 1:
        return len(text.split(".")) == 4 and all(g.isdigit() for g in text.split("."))
    return 13 <= size <= 19 if kind == 2 else 7 <= size <= 15


def _runs(label: np.ndarray, g: Graph) -> Iterator[tuple[int, int, int]]:
    i, after = 0, set(g.chain)
    while i < len(label):
        j = i
        while label[i] > 2 and j + 1 < len(label) and label[j + 1] == label[i] and (j, j + 1) in after:
            j += 1
        if label[i]:
            yield int(label[i]) - 1, g.starts[i], g.ends[j]
        i = j + 1


def all_spans(text: str, base: list[Span], field: Field | None) -> list[Span]:
    """The base spans and those that the field adds where no base span is."""
    if field is None:
        return base
    g = graph(text)
    if not g.starts:
        return base
    known = labels_of(g, base)
    if not known.any():
        return base  # nothing is certain, so there is nothing to pass on
    p = marginals(field, g.features, _pairs(g.chain), _pairs(g.skip), known)
    label = np.where(p.max(axis=1) >= CERTAIN, p.argmax(axis=1), 0)
    label[known > 0] = 0
    added = []
    for kind, a, b in _runs(label, g):
        inner = text[a:b].strip(_EDGES + ("()=" if kind < 3 else "="))
        a += text[a:b].find(inner)
        if _admissible(kind, inner):
            added.append((a, kind, a + len(inner)))
    return sorted({*base, *added})


_CODE = re.compile(r"\+[0-9]{1,3}[ .-]*")
_OTHER = str.maketrans("0123456789", "1234567890")


def second_mention(text: str, kind: int) -> str | None:
    """A card or phone number without what its pattern goes by; None for other kinds and where too little would be left."""
    rest = text[1:].lstrip(" -") if kind == 2 else _CODE.sub("", text, count=1) if kind == 3 else ""
    return rest if rest and _admissible(kind, rest) and not base_spans(rest) else None


def taught(text: str) -> tuple[Graph, np.ndarray]:
    """A training text with second mentions of its numbers, and other numbers of their form, before it; and its labels."""
    base, before, marks = base_spans(text), "", []
    for a, kind, b in base[:MENTIONED]:
        rest = second_mention(text[a:b], kind)
        if rest is not None:
            marks.append((len(before) + len("also "), kind, len(before) + len("also ") + len(rest)))
            before += f"also {rest} and {rest.translate(_OTHER)} "
    g = graph(before + text)
    y = labels_of(g, sorted([*marks, *((a + len(before), kind, b + len(before)) for a, kind, b in base)]))
    own = np.array(g.starts, np.int64) >= len(before)
    unsure = {k for i, j in g.skip for k, other in ((i, j), (j, i)) if own[k] and y[k] == 0 and y[other] > 0}
    y[list(unsure)] = UNKNOWN
    return g, y


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in strings(batch.column("_text")):
            g, y = taught(text)
            if g.starts:
                y = y[:SAMPLE_TOKENS]
                chain, skip = (_pairs([p for p in pairs if max(p) < SAMPLE_TOKENS]) for pairs in (g.chain, g.skip))
                rows.append((g.features[:SAMPLE_TOKENS].tobytes(), y.astype(np.int8).tobytes(), chain.tobytes(), skip.tobytes()))
        yield pa.record_batch([pa.array([r[k] for r in rows], pa.binary()) for k in range(4)], names=["x", "y", "chain", "skip"])


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Field | None:
    """Learns a field from the texts with digits or at signs of SAMPLE_DOCS ids at most, those of least hash, one text each, up to
    SAMPLE_TOKENS tokens of a text; None if there are none."""
    narrow = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).where(F.col("_text").rlike(_SOME) & F.col("_id").isNotNull())
    chosen = narrow.select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_DOCS)
    least = F.min(F.struct(F.xxhash64("_text"), "_text")).alias("least")
    texts = narrow.join(F.broadcast(chosen), "_id", "left_semi").groupBy("_id").agg(least).select("least._text")
    found = map_batches(texts, _training, "x binary, y binary, chain binary, skip binary")
    rows = sorted(tuple(bytes(v) for v in r) for r in found.collect())  # SAMPLE_DOCS at most
    return fit_field(
        [
            (
                np.frombuffer(x, np.float32).reshape(-1, FEATURES),
                np.frombuffer(y, np.int8).astype(np.int64),
                np.frombuffer(chain, np.int64).reshape(-1, 2),
                np.frombuffer(skip, np.int64).reshape(-1, 2),
            )
            for x, y, chain, skip in rows
        ]
    )


def _find(field: Field | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, some in text_chunks(batch.column("_text")):
                base = [base_spans(text) if _HAS.search(text) else [] for text in some]
                every = [all_spans(text, found, field) if _HAS.search(text) else found for text, found in zip(some, base, strict=True)]
                counts = [pa.array([sum(s[1] == k for s in found) for found in base], pa.int64()) for k in range(len(KINDS))]
                texts = [pa.array([joined(f) for f in found], pa.string()) for found in (base, every)]
                names = ["_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans"]
                yield pa.record_batch([batch.column("_id").slice(a, b - a), *counts, *texts], names=names)

    return run


def find(docs: DataFrame, field: Field | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_email, n_ip, n_card, n_phone, base_spans, spans) of every whole text.

    Spans are written as ``kind:start:end`` in code points, end exclusive, by start and kind and joined by commas; the
    counts are of base spans. NULL and empty texts have none. Rows are neither merged nor dropped; other
    columns are left out, whatever their names.
    """
    narrow = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    kind = narrow.schema[0].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return map_batches(narrow, _find(field), f"_id {kind}, {counts}, base_spans string, spans string").withColumnRenamed("_id", key)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first counts, to the end of all."""
    out, done = [], 0
    for a, kind, b in spans:
        if a >= done:
            out.append(text[done:a])
            out.append(f"[{KINDS[kind].upper()}]")
        done = max(done, b)
    out.append(text[done:])
    return "".join(out)


def _redact(field: Field | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            for a, b, texts in text_chunks(batch.column("_text")):
                some = batch.slice(a, b - a)
                valid = some.column("_text").is_valid().to_pylist()
                for i, t in enumerate(texts):
                    if _HAS.search(t):
                        texts[i] = redacted(t, all_spans(t, base_spans(t), field))
                new = pa.array([t if v else None for t, v in zip(texts, valid, strict=True)], pa.string())
                columns = [new if i == at else some.column(i) for i in range(some.num_columns)]
                yield pa.record_batch(columns, names=batch.schema.names)

    return run


def redact(docs: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced by its kinds; NULL stays NULL, other columns stay as they are."""
    names = {c: "_text" if c == text else f"_c{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in renamed.schema)
    return map_batches(renamed, _redact(field), schema).select(*(F.col(n).alias(c) for c, n in names.items()))
