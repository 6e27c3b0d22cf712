"""Connected components of an edge table, by alternating star contractions, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workforce_signals.plans.stored import Stored, store


def _stars(edges: DataFrame) -> DataFrame:
    """Large stars, then small stars: every edge (a, b) with a > b ends nearer to the smallest node of its component."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
    large = large.unionAll(least.where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
    down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    small = down.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b"))
    return small.unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node that is not the smallest of its component has one edge, and that leads to the smallest."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("up")).unionAll(edges.select("b", F.lit(0)))
    counts = ends.groupBy("u").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return counts.agg(F.count_if(F.expr("up > 1 OR up = 1 AND least = 0"))).first()[0] == 0


def components(edges: DataFrame | Stored, name: str = "links") -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (a, b) that is not the smallest of its component.

    Each round is written to the shared folder, which cuts the lineage; nothing is collected but a row count and
    a checksum per round. Rounds end as soon as all edges are stars, without one more that would change nothing. The number of rounds is logarithmic in the longest path.
    Self-links are ignored; an empty table has no rows.
    """
    if isinstance(edges, Stored):
        edges = edges.df
    clean = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = store(clean, f"{name}-0")
    seen, k = None, 0
    while not now.is_empty and not _are_stars(now.df):
        mark = now.df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen, k = mark, k + 1
        now = store(_stars(now.df), f"{name}-{k}")
    return now.df.select(F.col("a").alias("node"), F.col("b").alias("root"))
