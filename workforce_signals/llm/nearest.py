"""Approximate nearest neighbours by cosine: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample of unit vectors and broadcast; every row of the table descends to its leaf. A query
keeps a priority queue of the branches it passed by, nearest first, and opens leaf after leaf. How many it opens is
calibrated on the sample against brute force. Rows and queries then meet by leaf, in blocks of bounded size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workforce_signals.llm.workers import map_batches
from workforce_signals.plans.stored import store

# Vectors that the tree is fitted on, a bounded sample by hash of the id, and how many components they may have in all.
SAMPLE_ROWS, SAMPLE_VALUES = 20_000, 8_000_000
# Children of a node, sample vectors that make a leaf, rounds of k-means.
BRANCHES, LEAF, ROUNDS = 8, 64, 8
# Calibration: queries, share of true neighbours to be found in the sample, leaves more than that takes.
TRIALS, RECALL, MARGIN = 256, 0.97, 1.15
# Rows and queries that meet in one block.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 2_048
NEIGHBOURS, ONE_IN = 5, 50

_loaded: dict[str, Tree] = {}


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Tree:
    """Centres of the nodes; a leaf has no children. Node 0 is the root."""

    def __init__(self, sample: np.ndarray):
        """``sample``: unit vectors. Equal inputs make equal trees."""
        self.children: list[np.ndarray] = []
        self.centres: list[np.ndarray | None] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self._grow(sample)

    def _node(self) -> int:
        self.children.append(np.zeros(0, np.int64))
        self.centres.append(None)
        self.leaf.append(-1)
        return len(self.children) - 1

    def _grow(self, sample: np.ndarray) -> None:
        todo = [(self._node(), np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop()
            part = self._split(sample[rows]) if len(rows) > LEAF else None
            if part is None:
                self.leaf[node], self.leaves = self.leaves, self.leaves + 1
                continue
            centres, owner = part
            ids = [self._node() for _ in centres]
            self.children[node], self.centres[node] = np.array(ids), centres
            todo += [(i, rows[owner == k]) for k, i in enumerate(ids)]

    @staticmethod
    def _split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """k-means on unit vectors from far apart beginnings; None if they do not come apart."""
        first = [int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax())]
        near = x @ x[first[0]]
        while len(first) < BRANCHES and near.min() < 1 - 1e-9:
            first.append(int(near.argmin()))
            near = np.maximum(near, x @ x[first[-1]])
        if len(first) < 2:
            return None
        centres = x[first]
        for _ in range(ROUNDS):
            owner = (x @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, owner, x)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
        owner = (x @ centres.T).argmax(axis=1)
        used = np.unique(owner)
        return (centres[used], np.searchsorted(used, owner)) if len(used) > 1 else None

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every unit vector: at each node the child with the nearest centre."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            owner = (x[rows] @ self.centres[node].T).argmax(axis=1)
            todo += [(int(c), rows[owner == k]) for k, c in enumerate(self.children[node])]
        return out

    def visit(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in the order in which the nearest open branch leads to them."""
        heap = [(-2.0, 0)]
        while heap:
            _, node = heappop(heap)
            while self.leaf[node] < 0:
                near = self.centres[node] @ q
                best = int(near.argmax())
                for k, c in enumerate(self.children[node].tolist()):
                    if k != best:
                        heappush(heap, (-float(near[k]), c))
                node = int(self.children[node][best])
            yield self.leaf[node]


def calibrated(tree: Tree, sample: np.ndarray) -> int:
    """Leaves to open so that the sample's own nearest neighbours are found."""
    some = np.linspace(0, len(sample) - 1, min(TRIALS, len(sample))).astype(int)
    owner, needed = tree.assign(sample), []
    for i in np.unique(some).tolist():
        near = sample @ sample[i]
        near[i] = -2
        order = np.full(tree.leaves, tree.leaves, np.int64)
        for place, leaf in enumerate(tree.visit(sample[i])):
            order[leaf] = place + 1
        needed.append(order[owner[np.argsort(-near, kind="stable")[:NEIGHBOURS]]])
    if not needed:
        return 1
    every = np.sort(np.concatenate(needed))
    most = every[min(len(every) - 1, int(np.ceil(RECALL * len(every))) - 1)]
    return min(tree.leaves, int(np.ceil(most * MARGIN)))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(-1, size)


def _tree(shared, mark: str):
    if mark not in _loaded:
        _loaded.clear()
        _loaded[mark] = shared.value
    return _loaded[mark]


def _assign(shared, mark: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, *_ = _tree(shared, mark)
        for batch in batches:
            if batch.num_rows:
                leaf = tree.assign(unit(_matrix(batch.column("vector"), size)))
                yield pa.record_batch([batch.column("vec_id"), batch.column("vector"), pa.array(leaf.astype(np.int32))], names=["vec_id", "vector", "leaf"])

    return run


def _route(shared, mark: str, size: int):
    """The leaves that each query opens: as many as calibrated, and on until they hold ids enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, leaves, counts = _tree(shared, mark)
        for batch in batches:
            vectors = unit(_matrix(batch.column("vector"), size)) if batch.num_rows else []
            opened = []
            for q in vectors:
                found, held = [], 0
                for leaf in tree.visit(q):
                    found.append(leaf)
                    held += counts.get(leaf, 0)
                    if len(found) >= leaves and held > 8 * NEIGHBOURS:
                        break
                opened.append(found)
            kept = [batch.column(n) for n in batch.schema.names]
            yield pa.record_batch([*kept, pa.array(opened, pa.list_(pa.int32()))], names=[*batch.schema.names, "leaves"])

    return run


def best_of(query: np.ndarray, query_id: int, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and cosines of the nearest ids, exactly in double precision; ties to smaller ids, each id once by its nearest row.

    Rows come in ascending order of their ids.
    """
    near = vectors @ query / (norms * np.linalg.norm(query))
    near[ids == query_id] = -np.inf
    at = np.arange(len(ids))
    most = np.maximum.reduceat(near, np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))))
    if len(most) > NEIGHBOURS:
        at = np.flatnonzero(near >= np.partition(most, -NEIGHBOURS)[-NEIGHBOURS] - 1e-9)
    at = at[near[at] > -np.inf]
    exact = (vectors[at] * query).sum(axis=1) / (norms[at] * np.linalg.norm(query))
    order = np.lexsort((ids[at], -exact))
    _, first = np.unique(ids[at][order], return_index=True)
    order = order[np.sort(first)[:NEIGHBOURS]]
    return ids[at][order], exact[order]


def _search(size: int):
    """Rows sorted by (leaf, row_block, query_block, kind): the queries of a block first, then its rows."""

    def close(queries, rows, out):
        if not queries or not rows:
            return
        ids = np.concatenate([i for i, _ in rows])
        vectors = np.concatenate([v for _, v in rows])
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        norms = np.linalg.norm(vectors, axis=1)
        for qids, qvectors in queries:
            for query_id, q in zip(qids.tolist(), qvectors, strict=True):
                found, scores = best_of(q, query_id, ids, vectors, norms)
                out.extend((query_id, int(i), float(s)) for i, s in zip(found, scores, strict=True))

    def told(out):
        return pa.record_batch(
            [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))],
            names=["query_id", "vec_id", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, queries, rows, out = None, [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("leaf", "row_block", "query_block", "kind")], axis=1)
            ids, vectors = batch.column("vec_id").to_numpy(), _matrix(batch.column("vector"), size)
            cut = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                block = tuple(keys[a, :3].tolist())
                if block != at:
                    close(queries, rows, out)
                    at, queries, rows = block, [], []
                    if len(out) > 50_000:
                        yield told(out)
                        out = []
                (rows if keys[a, 3] else queries).append((ids[a:b], vectors[a:b]))
        close(queries, rows, out)
        yield told(out)

    return run


def _valid(vector: Column) -> Column:
    """A vector of finite components that are not all zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0)


def fit_tree(rows: DataFrame, size: int) -> tuple[Tree, int]:
    """A tree from a sample of rows (vec_id, vector), and the leaves to open: SAMPLE_ROWS ids at most, those of least hash, one
    vector each, so that an id with very many vectors does not fill it."""
    most = max(1_000, min(SAMPLE_ROWS, SAMPLE_VALUES // size))
    chosen = rows.select("vec_id").distinct().orderBy(F.xxhash64("vec_id"), "vec_id").limit(most)
    one = F.min(F.struct(F.xxhash64("vector").alias("hash"), "vector")).alias("one")
    found = rows.join(F.broadcast(chosen), "vec_id", "left_semi").groupBy("vec_id").agg(one).select("vec_id", "one.vector")
    found = found.orderBy(F.xxhash64("vec_id"), "vec_id").collect()  # ``most`` at most
    if not found:
        return Tree(np.zeros((0, size))), 1
    sample = unit(np.array([r["vector"] for r in found], np.float64))
    # Repeated vectors would fill leaves without teaching anything.
    _, first = np.unique(sample, axis=0, return_index=True)
    sample = sample[np.sort(first)]
    tree = Tree(sample)
    return tree, calibrated(tree, sample)


def nearest(table: DataFrame, key: str = "vec_id", vector: str = "embedding", one_in: int = ONE_IN) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for every id divisible by ``one_in`` its 5 nearest others that were found.

    ``score`` is the cosine of the original vectors in double precision; equal ones go to the smaller id.

    Rows without an id and vectors that are NULL, zero or hold a NULL or non-finite component take no part, nor do
    vectors of another length than most (of equally frequent lengths the larger counts). Repeated ids: an id is
    listed once, by its nearest vector, and never for itself; a query id with several vectors gets the nearest to any of
    them. With five candidates or fewer all are returned. Other columns are ignored, whatever their names.
    """
    spark = table.sparkSession
    clean = table.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    clean = clean.where(F.col("vec_id").isNotNull() & _valid(F.col("vector")))
    lengths = clean.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if lengths is None:
        return spark.createDataFrame([], result)
    size = lengths["length"]
    clean = clean.where(F.size("vector") == size)
    tree, leaves = fit_tree(clean, size)

    first = spark.sparkContext.broadcast((tree, leaves, {}))
    placed = map_batches(clean, _assign(first, uuid.uuid4().hex, size), "vec_id bigint, vector array<double>, leaf int")
    placed = store(placed, "nearest-rows").df
    # One row for each leaf of the tree, whose number the sample bounds. An id in several leaves counts in one of them.
    counts = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}
    distinct = placed.groupBy("vec_id").agg(F.min("leaf").alias("leaf")).groupBy("leaf").count().collect()
    second = spark.sparkContext.broadcast((tree, leaves, {r["leaf"]: r["count"] for r in distinct}))
    queries = placed.where(F.col("vec_id") % one_in == 0).select("vec_id", "vector").distinct()
    opened = map_batches(queries, _route(second, uuid.uuid4().hex, size), "vec_id bigint, vector array<double>, leaves array<int>")
    opened = store(opened.select("vec_id", "vector", F.explode("leaves").alias("leaf")), "nearest-queries").df
    asked = {r["leaf"]: r["count"] for r in opened.groupBy("leaf").count().collect()}

    plan = [(leaf, -(-n // BLOCK_ROWS), -(-asked[leaf] // BLOCK_QUERIES)) for leaf, n in counts.items() if leaf in asked]
    blocks = F.broadcast(spark.createDataFrame(plan, "leaf int, row_blocks int, query_blocks int"))
    spread = F.pmod(F.xxhash64("vec_id"), F.col("row_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1))
    rows = placed.join(blocks, "leaf").select("leaf", spread.alias("row_block"), other.alias("query_block"), F.lit(1).alias("kind"), "vec_id", "vector")
    spread = F.pmod(F.xxhash64("vec_id"), F.col("query_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1))
    asks = opened.join(blocks, "leaf").select("leaf", other.alias("row_block"), spread.alias("query_block"), F.lit(0).alias("kind"), "vec_id", "vector")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(r * q for _, r, q in plan) // 64)
    both = rows.unionByName(asks).repartition(tasks, "leaf", "row_block", "query_block")
    both = both.sortWithinPartitions("leaf", "row_block", "query_block", "kind")
    found = map_batches(both, _search(size), "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEIGHBOURS)
    return ranked.select("query_id", "rank", "vec_id", "score")


def brute_force(ids: np.ndarray, vectors: np.ndarray, one_in: int = ONE_IN) -> dict[int, list[int]]:
    """The true neighbours, for measuring recall on tables that fit into memory."""
    units, out = unit(vectors), {}
    for query_id in sorted({i for i in ids.tolist() if i % one_in == 0}):
        best: dict[int, float] = {}
        for k in np.flatnonzero(ids == query_id):
            for i, score in zip(ids.tolist(), (units @ units[k]).tolist(), strict=True):
                if i != query_id:
                    best[i] = max(score, best.get(i, score))
        out[int(query_id)] = sorted(best, key=lambda i: (-best[i], i))[:NEIGHBOURS]
    return out
