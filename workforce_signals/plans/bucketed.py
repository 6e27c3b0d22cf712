"""Profiles and descriptions stored in buckets of their id, which meet again without a shuffle.

Both are dealt into the same number of buckets by the same hash when they are written, so a join on the id reads bucket
against bucket, as often as it is made. An id that very many rows carry would make one bucket, and one task, very large: rows of
such ids are stored apart on both sides and joined as plain tables, where Spark may split an id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workforce_signals.operators.spells import merge_profiles
from workforce_signals.plans.stored import Stored, new_path, store

# Rows of one id, on either side, from which on it is stored apart.
FREQUENT_ROWS = 1_000_000


@dataclass(frozen=True)
class Bucketed:
    """A table in buckets, and the rows of frequent ids as a plain one."""

    usual: DataFrame
    frequent: Stored
    path: str


def write_bucketed(df: DataFrame, path: str, name: str, key: str, buckets: int) -> DataFrame:
    """Write a table in buckets of ``key``, each one sorted file, and name it for this session."""
    dealt = df.repartition(buckets, key)
    dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def open_bucketed(spark: SparkSession, path: str, schema: str, name: str, key: str, buckets: int) -> DataFrame:
    """A table that another session wrote in buckets. ``schema`` is its columns as DDL text."""
    spark.sql(
        f"CREATE TABLE `{name}` ({schema}) USING parquet OPTIONS (path '{path}') "
        f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS"
    )
    return spark.table(name)


def bucket_pair(
    profiles: DataFrame, descriptions: DataFrame, buckets: int, *, key: str = "id", frequent_rows: int = FREQUENT_ROWS
) -> tuple[Bucketed, Bucketed]:
    """Both tables in buckets of their id. Rows without an id meet nothing and are left out."""
    counts = [df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")) for df in (profiles, descriptions)]
    many = [c.where(F.col("n") > frequent_rows).select(F.col(key).alias("_key")) for c in counts]
    frequent = store(many[0].unionAll(many[1]).distinct(), "frequent-ids")
    return tuple(_bucketed(df, frequent, buckets, key, name) for df, name in ((profiles, "profiles"), (descriptions, "descriptions")))


def _bucketed(df: DataFrame, frequent: Stored, buckets: int, key: str, name: str) -> Bucketed:
    path, rows = new_path(df.sparkSession, name), df.where(F.col(key).isNotNull())
    usual, apart = rows, rows.limit(0)
    if not frequent.is_empty:
        same = F.col(key) == F.col("_key")
        usual, apart = rows.join(frequent.for_join(), same, "left_anti"), rows.join(frequent.for_join(), same, "left_semi")
    table = write_bucketed(usual, path, path.rsplit("/", 1)[1].replace("-", "_"), key, buckets)
    return Bucketed(table, store(apart, f"{name}-frequent"), path)


def merge_bucketed(profiles: Bucketed, descriptions: Bucketed) -> DataFrame:
    """``merge_profiles`` of two tables from ``bucket_pair``: no shuffle, but for the rows of frequent ids if there are any."""
    merged = merge_profiles(profiles.usual, descriptions.usual)
    if profiles.frequent.is_empty or descriptions.frequent.is_empty:
        return merged
    return merged.unionByName(merge_profiles(profiles.frequent.df, descriptions.frequent.df))
