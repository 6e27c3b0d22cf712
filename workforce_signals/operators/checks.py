"""Row audits of inputs and outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_count(df: DataFrame) -> DataFrame:
    """The number of rows, as ``n_rows``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def file_row_counts(df: DataFrame, total_label: str, *, file_col: str = "filename") -> DataFrame:
    """Rows per source file, and a row ``total_label`` for all of them, in name order."""
    is_total = F.grouping(file_col).alias("is_total")
    counts = df.rollup(file_col).agg(F.count(F.lit(1)).alias("nrows"), is_total)
    name = F.when(F.col("is_total") == 1, F.lit(total_label)).otherwise(F.col(file_col))
    return counts.select(name.alias("filename"), "nrows").orderBy(F.col("filename").asc_nulls_last())


def file_count_totals(counts: DataFrame, total_label: str, *, file_col: str = "filename") -> DataFrame:
    """``file_row_counts`` from counts (``file_col``, ``nrows``) that were taken before, such as those of an audited ingest."""
    is_total = F.grouping(file_col).alias("is_total")
    sums = counts.rollup(file_col).agg(F.coalesce(F.sum("nrows"), F.lit(0)).alias("nrows"), is_total)
    name = F.when(F.col("is_total") == 1, F.lit(total_label)).otherwise(F.col(file_col))
    return sums.select(name.alias("filename"), "nrows").orderBy(F.col("filename").asc_nulls_last())


def reconcile_counts(before: DataFrame, after: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Row counts of two tables side by side with their difference, overall or per ``by``."""
    sides = [
        df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).select(*by, "n", F.lit(side).alias("side"))
        for side, df in (("before", before), ("after", after))
    ]
    count = {
        side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("n"))), F.lit(0)) for side in ("before", "after")
    }
    return (
        sides[0]
        .unionByName(sides[1])
        .groupBy(*by)
        .agg(count["before"].alias("rows_before"), count["after"].alias("rows_after"))
        .withColumn("difference", F.col("rows_after") - F.col("rows_before"))
    )
