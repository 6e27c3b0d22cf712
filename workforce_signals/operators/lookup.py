"""Point lookup and output order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(df: DataFrame, id_value, *, id_col: str = "id") -> DataFrame:
    """Rows with one id. The filter reaches the file scan, which skips row groups of a table from ``write_clustered``."""
    return df.where(F.col(id_col) == F.lit(id_value))


def write_clustered(
    df: DataFrame,
    path: str,
    by: str = "id",
    *,
    bloom: Sequence[str] | None = None,
    group_bytes: int = 16 << 20,
    group_values: int = 200_000,
) -> None:
    """Write Parquet files that each hold a range of ``by``, sorted, in row groups that a lookup can skip.

    The least and greatest value of a row group rule most of them out; bloom filters on the columns ``bloom`` (``by`` itself unless
    others are named) rule out those whose range holds the value by chance, and all columns by which the files are not sorted.
    ``group_bytes`` bounds a row group and ``group_values`` is the number of distinct values that a filter is laid out for. Rows of one
    frequent value are spread over several files by a hash of the row.
    """
    order = F.col(by).asc_nulls_last()
    ranged = df.repartitionByRange(order, F.xxhash64(*df.columns)).sortWithinPartitions(order)
    writer = ranged.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", str(group_bytes))
    for column in (by,) if bloom is None else bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{column}", str(group_values))
    writer.parquet(path)


def order_output(df: DataFrame, *cols: str | Column) -> DataFrame:
    """Sort for writing. Plain names sort upwards; a leading ``-`` sorts downwards; NULLs go last.

    Rows with equal sort columns are spread by a hash of the whole row, so that one frequent
    value does not fill a single output file.
    """
    order = [c if isinstance(c, Column) else _direction(c) for c in cols]
    return df.orderBy(*order, F.xxhash64(*df.columns))


def with_position(df: DataFrame, name: str = "position") -> DataFrame:
    """Add the place of each row, from 1, in the files of a Parquet table; apply directly to a file scan.

    Files go by name, as the parts of a sorted write do. Only one count per file is brought together and sent to all tasks; the rows
    stay where they are read.
    """
    spot = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = spot.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    files = files.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return spot.join(F.broadcast(files), "_file").withColumn(name, F.col("_before") + F.col("_row") + 1).drop("_file", "_row", "_before")


def _direction(name: str) -> Column:
    return F.col(name[1:]).desc_nulls_last() if name.startswith("-") else F.col(name).asc_nulls_last()


# The order in which each result table is written.
SKILL_YEAR_ORDER = ("-co_jobs_with_ai", "-cnt", "skill")
SKILL_ORDER = ("-ai_score", "-total_cnt", "skill")
JOB_ORDER = ("-job_ai_score", "-n_matched_skills", "job_id")
COMPANY_ORDER = ("-ai_job_share", "-n_postings", "company_name")
SPELL_YEAR_ORDER = ("id", "title_name", "year")
COMPANY_YEAR_ORDER = ("company_name", "year")
