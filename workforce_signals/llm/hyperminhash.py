"""Near-duplicate groups by HyperMinHash.

The shingles of a text are dealt into buckets by the low bits of their hashes. A bucket keeps its smallest hash, compressed
to the number of leading zeros and the mantissa bits that follow. An empty bucket borrows from another one, chosen by
an order of its own, so that small sets fill all buckets and two sets still agree in a bucket about as often as they are
similar. Registers are banded: texts that agree in all registers of a band share a key.

Per key the texts are compared with one of them, the hub; the number of equal registers, less the collisions to be
expected of sets of those sizes, estimates the similarity. Whoever is far from the hub is then compared with all others of
the key, block by block. What is near is joined into clusters, and a cluster goes through the same two steps on the full
shingle sets, which confirms every link. Thus no step makes a row for each pair, and copies of one text, which are one
class from the start, are never paired.

Two sets with a similarity of 0.8 miss each other's keys with a probability of about 1e-11; an estimate is passed on from 0.5,
some six standard errors below. Confirmed links are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workforce_signals.llm.arrays import constants
from workforce_signals.llm.components import components
from workforce_signals.llm.connect import connect
from workforce_signals.llm.shingles import batch_sets, signatures
from workforce_signals.llm.workers import map_batches
from workforce_signals.plans.stored import Stored, store

# Links: PERCENT * union <= 100 * intersection, over runs of WORDS words.
PERCENT, WORDS = 80, 2
# 2^BUCKET_BITS registers, each of 6 bits for leading zeros and MANTISSA bits.
BUCKET_BITS, MANTISSA = 8, 10
# Bands and registers of a band.
BANDS, BAND = 48, 4
# Least estimate that is verified.
PASSED = 0.5
# Sets of fewer shingles link with equal sets only: 3 of 4 are less than PERCENT.
LEAST = 4

_BUCKETS = 1 << BUCKET_BITS
_EMPTY = np.uint16(0xFFFF)
# For every bucket an order of all buckets, by rank.
_ORDER = constants(_BUCKETS * _BUCKETS, 53).reshape(_BUCKETS, _BUCKETS).argsort(axis=1).argsort(axis=1).astype(np.uint8)


def compressed(hashes: np.ndarray) -> np.ndarray:
    """Leading zeros and the bits after the leading one of 64-bit hashes, as one 16-bit number each."""
    high = hashes >> np.uint64(11)  # exact as a double
    zeros = 53 - np.frexp(high.astype(np.float64))[1].astype(np.uint64)
    rest = np.where(zeros < 63, hashes << np.minimum(zeros + np.uint64(1), np.uint64(63)), np.uint64(0))
    return ((zeros << np.uint64(MANTISSA)) | (rest >> np.uint64(64 - MANTISSA))).astype(np.uint16)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers for every set (sorted hashes); all empty for empty sets."""
    out = np.full((len(sets), _BUCKETS), _EMPTY, np.uint16)
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    if not len(every):
        return out
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    place = owner * _BUCKETS + (every & np.uint64(_BUCKETS - 1)).astype(np.int64)
    # Sets are sorted, so the first hash in a bucket is its smallest; of several values put in one place the last stays.
    out.ravel()[place[::-1]] = compressed(every)[::-1]
    filled = out != _EMPTY
    for i in np.flatnonzero(filled.any(axis=1) & ~filled.all(axis=1)).tolist():
        full, empty = np.flatnonzero(filled[i]), np.flatnonzero(~filled[i])
        out[i, empty] = out[i, full[_ORDER[np.ix_(empty, full)].argmin(axis=1)]]
    return out


@lru_cache(4096)
def _collision(log_a: int, log_b: int) -> float:
    """Probability that a bucket of two sets without a common shingle holds the same register; sizes in quarter powers of two."""
    zeros = np.arange(53)[:, None]
    width = np.ldexp(1.0, -(zeros + 1 + MANTISSA))
    low = np.ldexp(1.0, -(zeros + 1)) + np.arange(1 << MANTISSA)[None, :] * width

    def chance(log: int) -> np.ndarray:
        n = max(1.0, 2.0 ** (log / 4) / _BUCKETS)  # hashes in a bucket, of which the smallest is kept
        return np.exp(n * np.log1p(-low)) - np.exp(n * np.log1p(-np.minimum(low + width, 1 - 1e-16)))

    return float((chance(log_a) * chance(log_b)).sum())


def estimates(one: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Similarity of a set with others by their registers, corrected for accidental collisions."""
    equal = (others == one).sum(axis=1)
    mine = int(round(4 * np.log2(size)))
    logs = np.rint(4 * np.log2(sizes)).astype(np.int64)
    accidental = np.zeros(len(sizes))
    for log in np.unique(logs).tolist():
        accidental[logs == log] = _BUCKETS * _collision(mine, log)
    return (equal - accidental) / (_BUCKETS - accidental)


def near(one: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of the others may link."""
    alike = (PERCENT * sizes <= 100 * size) & (PERCENT * size <= 100 * sizes)
    alike[alike] = estimates(one, size, others[alike], sizes[alike]) >= PASSED
    return alike


class Registers:
    """Registers of a block's classes, to be asked for those that may link with one more."""

    def __init__(self, values: list[bytes], sizes: np.ndarray):
        self.all, self.sizes = np.frombuffer(b"".join(values), np.uint16).reshape(-1, _BUCKETS), sizes

    def linked(self, value: bytes, size: int, some: np.ndarray) -> np.ndarray:
        return some[near(np.frombuffer(value, np.uint16), size, self.all[some], self.sizes[some])]


class Sets:
    """Shingle sets of a block's classes, to be asked for those that link with one more."""

    def __init__(self, values: list[bytes], sizes: np.ndarray):
        self.sizes = sizes
        every = np.frombuffer(b"".join(values), np.uint64)
        order = np.argsort(every, kind="stable")
        self.terms, self.holders = every[order], np.repeat(np.arange(len(sizes)), sizes)[order]

    def linked(self, value: bytes, size: int, some: np.ndarray) -> np.ndarray:
        terms = np.frombuffer(value, np.uint64)
        a, b = np.searchsorted(self.terms, terms), np.searchsorted(self.terms, terms, "right")
        count = b - a
        ends = np.cumsum(count)
        held = self.holders[np.repeat(a - (ends - count), count) + np.arange(ends[-1])] if len(terms) else self.holders[:0]
        both = np.bincount(held, minlength=len(self.sizes))[some]
        return some[100 * both >= PERCENT * (size + self.sizes[some] - both)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row with its number of shingles and class; the registers of a class once a task."""
    seen: set[int] = set()
    for batch in batches:
        for a, b, sets in batch_sets(batch, "text", WORDS):
            classes, n = signatures(sets).view(np.int64), [len(s) for s in sets]
            new = []
            for i, c in enumerate(classes.tolist()):
                if n[i] >= LEAST and c not in seen:
                    new.append(i)
                    if len(seen) < 200_000:  # only saves work: registers that come twice are merged
                        seen.add(c)
            kept: list[bytes | None] = [None] * (b - a)
            for i, row in zip(new, registers([sets[i] for i in new]), strict=True):
                kept[i] = row.tobytes()
            columns = [batch.column("doc_id").slice(a, b - a), batch.column("content").slice(a, b - a), pa.array(n, pa.int64())]
            columns += [pa.array(classes), pa.array(kept, pa.binary())]
            yield pa.record_batch(columns, names=["doc_id", "content", "size", "class", "packed"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        for _, _, sets in batch_sets(batch, "text", WORDS):
            new = []
            for s, c in zip(sets, signatures(sets).view(np.int64).tolist(), strict=True):
                if c not in seen:
                    new.append((c, len(s), s.tobytes()))
                    if len(seen) < 200_000:
                        seen.add(c)
            columns = [pa.array([r[k] for r in new], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]
            yield pa.record_batch(columns, names=["class", "size", "packed"])


def band_keys(rows: DataFrame) -> DataFrame:
    """(key, class): one row for each band of a class's registers."""
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    cut = F.expr(f"substring(packed, {2 * BAND} * band + 1, {2 * BAND})")
    return rows.withColumn("band", band).select(F.xxhash64(F.col("band"), cut).alias("key"), "class")


def _near(rows: DataFrame) -> Stored:
    """Edges between classes whose registers allow a link."""
    bands = band_keys(rows)
    hubs = bands.groupBy("key").agg(F.min("class").alias("hub"), F.max("class").alias("_most")).where("hub <> _most").drop("_most")
    members = store(bands.join(hubs, "key").distinct(), "hyperminhash-members")
    some = rows.join(members.df.select("class").distinct(), "class", "left_semi").dropDuplicates(["class"])
    payload = store(some.select("class", "size", "packed"), "hyperminhash-registers")
    return connect(members.df, payload.df, Registers, "hyperminhash-near")


def _confirmed(docs: DataFrame, classes: DataFrame, edges: Stored) -> Stored:
    """Edges between classes whose full sets link, from clusters of near ones."""
    near_roots = components(edges, "hyperminhash-clusters")
    clusters = near_roots.select(F.col("root").alias("key"), F.col("node").alias("class"))
    clusters = clusters.unionAll(near_roots.select(F.col("root").alias("key"), F.col("root").alias("class")).distinct())
    clusters = store(clusters.withColumn("hub", F.col("key")), "hyperminhash-clusters-of").df
    # One text of every class, by its hash.
    wanted = store(clusters.join(classes, "class").select(F.col("text_hash").alias("_wanted")), "hyperminhash-wanted")
    texts = docs.join(wanted.for_join(), F.col("content") == F.col("_wanted"), "left_semi").select("text")
    sets = map_batches(texts, _sets, "class bigint, size bigint, packed binary").dropDuplicates(["class"])
    return connect(clusters, store(sets, "hyperminhash-sets").df, Sets, "hyperminhash-links")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for every row of ``docs``.

    Words are runs of anything but ASCII white space, A-Z read as a-z; the set of a text holds its distinct runs of two
    words, or its only word. Texts link when 100 * intersection >= 80 * union of the full sets; ``component_id`` is the smallest
    id that links lead to, the own one included, and ``kept`` tells the rows that have it.

    NULL, empty and blank texts have an empty set, link with nothing and are kept. Rows without an id are compared like others;
    their component_id is the smallest id of their component, or NULL if it has none, and then they are kept, since none of them
    can be named. Rows that repeat an id are separate; those with the smallest id of their component are all kept. Other columns
    are ignored, whatever their names. No group, text or number of partners is capped. Sets and classes are 64-bit hashes.
    """
    narrow = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("content"))
    schema = "doc_id bigint, content bigint, size bigint, class bigint, packed binary"
    rows = store(map_batches(narrow, _scan, schema), "hyperminhash-scan").df
    classes = rows.where("size > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.min("content").alias("text_hash"), F.count("*").alias("n"))
    edges = _near(rows.where("packed IS NOT NULL").select("class", "size", "packed"))
    if not edges.is_empty:
        edges = _confirmed(narrow, classes, edges)
    grouped = classes.withColumn("root", F.col("class"))
    if not edges.is_empty:
        roots = store(components(edges, "hyperminhash-roots"), "hyperminhash-nodes").for_join().withColumnRenamed("node", "class")
        grouped = classes.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    grouped = store(grouped.select("class", "least", "n", "root"), "hyperminhash-classes").df
    least = grouped.groupBy("root").agg(F.min("least").alias("component"), F.sum("n").alias("all")).where("all > 1")
    shared = store(grouped.join(least, "root").select("class", "component"), "hyperminhash-components")
    component = F.when(F.col("size") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    found = rows.join(shared.for_join(), "class", "left").select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


# The same rows by brute force: all pairs of distinct sets with a common shingle, then everything that links reach.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), s AS (
    SELECT r, doc_id, CASE
        WHEN len(w) >= 2 THEN list_distinct([array_to_string(w[i:i + 1], ' ') FOR i IN range(1, len(w))])
        ELSE w END AS sh
    FROM w
), x AS (
    SELECT r, len(sh) AS n, unnest(sh) AS g FROM s
), p AS (
    SELECT a.r AS u, b.r AS v, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS common
    FROM x a JOIN x b ON a.g = b.g AND a.r < b.r AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
    GROUP BY a.r, b.r
), l AS (
    SELECT u, v FROM p WHERE 100 * common >= 80 * (n + m - common)
), e AS (
    SELECT u, v FROM l UNION ALL SELECT v, u FROM l
), c AS (
    SELECT r, r AS reached FROM s
    UNION SELECT c.r, e.v FROM c JOIN e ON e.u = c.reached
), least AS (
    SELECT c.r, min(s.doc_id) AS component_id FROM c JOIN s ON s.r = c.reached GROUP BY c.r
)
SELECT s.doc_id, len(s.sh) AS n_shingles, least.component_id, s.doc_id IS NOT DISTINCT FROM least.component_id AS kept
FROM s JOIN least USING (r)
"""
