"""Connecting the members of groups that pass a test, without a row for each pair.

A test is given as a class that holds the members of a block and is asked which of them pass with one more. Groups may have any
size: each member meets one of its group first, the hub, and only those that did not come to the hub are then asked for against
all others, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workforce_signals.llm.components import components
from workforce_signals.llm.workers import map_batches
from workforce_signals.plans.stored import Stored, store

# Classes per block, and what their sizes may add up to.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000


class Judge(Protocol):
    """A block of classes, made from their values and sizes."""

    def linked(self, value: bytes, size: int, some: np.ndarray) -> np.ndarray:
        """Those of ``some`` places in the block that pass with a class of that value and size."""


_EDGES = "a bigint, b bigint"


def _edge_rows(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _with_hubs(judge: type):
    """Edges between classes and their hubs that pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, one = [], np.zeros(1, np.int64)
            mine, sizes, hubs, hub_sizes = (batch.column(c).to_pylist() for c in ("class", "size", "hub", "hub_size"))
            for i, (value, other) in enumerate(zip(batch.column("packed"), batch.column("hub_packed"), strict=True)):
                block = judge([other.as_py()], np.array(hub_sizes[i : i + 1], np.int64))
                if len(block.linked(value.as_py(), sizes[i], one)):
                    found.append((mine[i], hubs[i]))
            yield _edge_rows(found)

    return run


def _joined(judge: type, rows: list[tuple]) -> Iterator[tuple[int, int]]:
    """Edges of one block that join what its links join: rows (class, root, asked, size, packed), sorted by class."""
    others = [r for r in rows if not r[2]]
    if not others:
        return
    owner, root, sizes = (np.array([r[k] for r in others], np.int64) for k in (0, 1, 3))
    block = judge([r[4] for r in others], sizes)
    merged: dict[int, int] = {}
    for c, mine, asked, size, value in rows:
        while mine in merged:
            mine = merged[mine]
        some = np.flatnonzero(root != mine) if asked else ()
        if not len(some):
            continue
        for j in block.linked(value, size, some).tolist():
            if root[j] != mine:
                yield c, int(owner[j])
                merged[mine] = int(root[j])
                root[root == mine] = root[j]
                mine = int(root[j])


def _in_blocks(judge: type):
    """Edges of blocks, whose rows come sorted by (key, x, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, found = None, [], []
        for batch in batches:
            names = ("key", "x", "y", "class", "root", "asked", "size")
            for (*of, c, root, asked, size), value in zip(zip(*(batch.column(n).to_pylist() for n in names), strict=True), batch.column("packed"), strict=True):
                if of != block:
                    found.extend(_joined(judge, rows))
                    block, rows = of, []
                rows.append((c, root, asked, size, value.as_py()))
            if len(found) > 4096:
                yield _edge_rows(found)
                found = []
        found.extend(_joined(judge, rows))
        yield _edge_rows(found)

    return run


def connect(members: DataFrame, payload: DataFrame, judge: type, name: str) -> Stored:
    """Edges (a, b) that connect all classes of one key that pass the test, directly or by way of others.

    ``members`` (key, class, hub): every class of a key, without repeats, and one of them as its hub; ``payload`` (class, size, packed).
    First each class meets its hub. Those that did not come to the hub are then asked for against all classes of the key; both
    sides are cut into tiles, so that a key of any size is many tasks.
    """
    hubs = payload.select(F.col("class").alias("hub"), F.col("size").alias("hub_size"), F.col("packed").alias("hub_packed"))
    star = members.where("class <> hub").select("class", "hub").distinct().join(payload, "class").join(hubs, "hub")
    edges = store(map_batches(star, _with_hubs(judge), _EDGES), f"{name}-star")
    roots = store(components(edges, f"{name}-roots"), f"{name}-nodes")
    # Two classes of a key have met already.
    several = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 2")
    tagged = members.join(several, "key")
    for column in ("class", "hub"):
        named = roots.for_join().select(F.col("node").alias(column), F.col("root").alias(f"{column}_root"))
        tagged = tagged.join(named, column, "left").withColumn(f"{column}_root", F.coalesce(f"{column}_root", column))
    tagged = store(tagged.join(payload.select("class", "size"), "class"), f"{name}-tagged").df
    asked = F.col("class_root") != F.col("hub_root")
    tiles = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    counts = tagged.groupBy("key").agg(
        tiles(F.count("*"), F.sum("size")).alias("all_tiles"),
        tiles(F.count_if(asked), F.sum(F.when(asked, F.col("size")))).alias("asked_tiles"),
    )
    opened = store(tagged.join(counts.where("asked_tiles > 0"), "key").withColumn("asked", asked), f"{name}-open")
    if opened.is_empty:
        return edges
    mine = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["key", "x", "y", "class", F.col("class_root").alias("root"), "asked"]
    other = opened.df.withColumn("y", mine("all_tiles")).withColumn("x", every("asked_tiles")).withColumn("asked", F.lit(False))
    asking = opened.df.where("asked").withColumn("x", mine("asked_tiles")).withColumn("y", every("all_tiles"))
    blocks = other.select(*columns).unionByName(asking.select(*columns)).join(payload, "class")
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks.repartition(tasks, "key", "x", "y").sortWithinPartitions("key", "x", "y", "class")
    more = store(map_batches(blocks, _in_blocks(judge), _EDGES), f"{name}-blocks")
    return edges if more.is_empty else store(edges.df.unionAll(more.df), f"{name}-edges")
