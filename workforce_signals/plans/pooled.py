"""Pooled skill scores that are kept up to date year by year.

A table of pooled counts lies beside versioned year partitions. When a year is replaced, its former rows are taken from the
pooled counts and its new ones are added, so the other years are not read. A version is complete once its list of years is
written, which happens last: a run that dies before that leaves the former version in force, and its left-over files are in no
list. Former versions stay readable.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from workforce_signals.functions.text import norm_token
from workforce_signals.operators.skills import scored
from workforce_signals.plans.stored import store
from workforce_signals.sources import schemas
from workforce_signals.sources.read import glob_paths

_TOTALS = StructType().add("skill", StringType()).add("total_cnt", LongType()).add("total_co", LongType())
_YEARS = StructType().add("year", IntegerType()).add("version", LongType())


def latest_version(spark: SparkSession, root: str) -> int | None:
    """The last complete version, or None."""
    done = glob_paths(spark, f"{root}/state/version=*/_SUCCESS")
    return max((int(p.split("version=")[1].split("/")[0]) for p in done), default=None)


def _state(spark: SparkSession, root: str, version: int) -> dict[int, int]:
    """Which version's files hold each year."""
    rows = spark.read.schema(_YEARS).parquet(f"{root}/state/version={version}").collect()  # a row for each year
    return {r["year"]: r["version"] for r in rows}


def _year_rows(spark: SparkSession, root: str, years: dict[int, int]) -> DataFrame:
    """The counts of some years, each from the files of its version."""
    schema = StructType([*schemas.SKILL_YEAR.fields]).add("year", IntegerType())
    found = spark.createDataFrame([], schema)
    for version in sorted(set(years.values())):
        mine = [f"{root}/years/version={version}/year={y}" for y, v in years.items() if v == version]
        mine = [path for path in mine if glob_paths(spark, path)]
        if mine:
            table = spark.read.schema(schema).option("basePath", f"{root}/years/version={version}").parquet(*mine)
            found = found.unionByName(table.select(*schema.names))
    return found


def _totals(counts: DataFrame, sign: int = 1) -> DataFrame:
    cnt, co = (sign * F.col(c).cast("bigint") for c in ("cnt", "co_jobs_with_ai"))
    return counts.select(norm_token(F.col("skill")).alias("skill"), cnt.alias("total_cnt"), co.alias("total_co"))


def replace_years(spark: SparkSession, root: str, counts: DataFrame, years: Iterable[int] | None = None) -> int:
    """Put in the counts (year, skill, cnt, co_jobs_with_ai) of some years for what was there; returns the new version.

    ``years`` are the years replaced, those of ``counts`` if not given; one that has no rows in ``counts`` is emptied. The first
    call on a folder makes version 0. Only the former rows of these years and the pooled counts are read.
    """
    new = store(counts.select(F.col("year").cast("int").alias("year"), *schemas.SKILL_YEAR.names), "pooled-years").df
    if years is None:
        years = [r["year"] for r in new.select("year").distinct().collect()]
    years, former = sorted({int(y) for y in years}), latest_version(spark, root)
    new = new.where(F.col("year").isin(years)) if years else new.limit(0)
    version = 0 if former is None else former + 1
    held = {} if former is None else _state(spark, root, former)
    # Static overwriting also clears what a run that died may have left in this version.
    writer = new.hint("rebalance", F.col("year")).write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.partitionBy("year").parquet(f"{root}/years/version={version}")
    changed = _totals(new)
    if former is not None:
        changed = changed.unionAll(_totals(_year_rows(spark, root, {y: held[y] for y in years if y in held}), -1))
        changed = changed.unionAll(spark.read.schema(_TOTALS).parquet(f"{root}/pooled/version={former}"))
    pooled = changed.groupBy("skill").agg(F.sum("total_cnt").alias("total_cnt"), F.sum("total_co").alias("total_co"))
    pooled.where("total_cnt <> 0").write.mode("overwrite").parquet(f"{root}/pooled/version={version}")
    state = sorted((held | dict.fromkeys(years, version)).items())
    spark.createDataFrame(state, _YEARS).coalesce(1).write.mode("overwrite").parquet(f"{root}/state/version={version}")
    return version


def pooled_scores(spark: SparkSession, root: str, min_jobs: int = 50, version: int | None = None) -> DataFrame:
    """Scores of all years as ``skill_scores`` gives them, from the pooled counts of the latest or another version."""
    version = _wanted(spark, root, version)
    return scored(spark.read.schema(_TOTALS).parquet(f"{root}/pooled/version={version}"), min_jobs)


def pooled_years(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The counts of all years (year, skill, cnt, co_jobs_with_ai) of the latest or another version."""
    return _year_rows(spark, root, _state(spark, root, _wanted(spark, root, version))).select("year", *schemas.SKILL_YEAR.names)


def _wanted(spark: SparkSession, root: str, version: int | None) -> int:
    version = latest_version(spark, root) if version is None else version
    if version is None:
        raise FileNotFoundError(f"no complete version in {root}")
    return version
