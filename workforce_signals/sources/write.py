"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from workforce_signals.plans.stored import shuffles_removed

# The CSV writer strips blanks around values unless told not to.
CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    compression: str | None = "zstd",
    *,
    mode: str = "overwrite",
) -> None:
    """Write Parquet (ZSTD, or the session's codec with ``compression=None``) or CSV with a header."""
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"fmt must be 'parquet' or 'csv', not {fmt!r}")
    writer = df.write.mode(mode)
    with shuffles_removed(df.sparkSession):
        if fmt == "csv":
            writer.options(**CSV_OPTIONS).csv(path)
        else:
            (writer.option("compression", compression) if compression else writer).parquet(path)


def write_counted(df: DataFrame, path: str, fmt: str = "parquet", compression: str | None = "zstd") -> int:
    """Write a table and return its number of rows, counted by the write itself."""
    seen = Observation()
    write_table(df.observe(seen, F.count(F.lit(1)).alias("n")), path, fmt, compression)
    return seen.get["n"]


def write_year(df: DataFrame, path: str, compression: str | None = "zstd", *, by: tuple[str, ...] = ("year",)) -> None:
    """Write the years present in ``df`` into a table partitioned by year; other years stay untouched.

    Rows are rebalanced on the year first: few files per year, and a year that holds a large
    part of the rows is split over several tasks.
    """
    writer = df.hint("rebalance", *(F.col(c) for c in by)).write.mode("overwrite")
    writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    (writer.option("compression", compression) if compression else writer).parquet(path)
