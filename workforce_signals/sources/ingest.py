"""Raw extracts to Parquet."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from workforce_signals.sources import schemas
from workforce_signals.sources.read import conform, csv_parts, member_parts
from workforce_signals.sources.write import write_table

# Texts that stand for a missing value in raw extracts.
MISSING_TEXTS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

_ROWS_PER_FILE = 5_000_000


def _present(column: Column, missing: Iterable[str]) -> Column:
    return F.when(~column.isin(list(missing)), column)


def _clean(df: DataFrame, missing: Iterable[str], file: Column | None = None) -> DataFrame:
    return df.select(
        *(_present(F.col(f"`{c}`"), missing).alias(c) for c in df.columns),
        (F.col("_metadata.file_path") if file is None else file).alias("filename"),
    )


def read_raw_postings(
    spark: SparkSession,
    root: str,
    years: Iterable[int] | None = None,
    *,
    schema: StructType = schemas.RAW_POSTING,
    missing: Iterable[str] = MISSING_TEXTS,
    same_headers: bool = False,
    split_members: bool | int = False,
) -> DataFrame:
    """The kept columns of all extracts ``root/{year}/{month}/*.csv.gz``.

    Adds ``year`` and ``month`` (the folder names) and ``filename``. Extracts need not agree on
    the order of their columns, but each must have all the kept ones. ``same_headers`` states that
    those of one month agree, so that planning opens one file a month; one that differs raises.
    ``split_members`` lets several tasks read a file that is made of many gzip members, see ``members``; a number is
    the compressed bytes that a task takes.
    """
    folder = "[0-9][0-9][0-9][0-9]" if years is None else "{" + ",".join(str(y) for y in years) + "}"
    pattern = f"{root}/{folder}/*/*.csv.gz"
    if split_members:
        size = None if split_members is True else split_members
        parts = member_parts(spark, pattern, same_headers=same_headers, range_bytes=size)
    else:
        parts = csv_parts(spark, pattern, same_headers=same_headers)
    for part in parts:
        lacking = [c for c in schema.names if c not in part.columns]
        if lacking:
            raise ValueError(f"extracts without columns {lacking}")
    keep = [F.col("filename")]
    table = reduce(
        DataFrame.unionByName,
        [
            conform(
                _clean(p.select(*schema.names, "_file"), missing, F.col("_file")) if split_members else _clean(p.select(*schema.names), missing),
                schema,
                keep=keep,
            )
            for p in parts
        ],
    )
    place = r"/([0-9]{4})/([^/]+)/[^/]+$"
    month = F.url_decode(F.replace(F.regexp_extract("filename", place, 2), F.lit("+"), F.lit("%2B")))
    return table.withColumns(
        {"year": F.regexp_extract("filename", place, 1).cast("int"), "month": month}
    )


def ingest_postings(
    spark: SparkSession,
    root: str,
    dst: str,
    years: Iterable[int] | None = None,
    *,
    missing: Iterable[str] = MISSING_TEXTS,
    same_headers: bool = False,
    split_members: bool | int = False,
) -> None:
    """Prune all extracts to the kept columns and write them partitioned by year and month.

    One pass without a shuffle: a gzip file of one member cannot be split, so each is one task, and each lies in
    one month, so each task writes to one partition. Months present replace their former content.
    ``split_members`` reads files of many members by several tasks, in two passes.
    """
    table = read_raw_postings(spark, root, years, missing=missing, same_headers=same_headers, split_members=split_members).drop("filename")
    _write_months(table, dst)


def _write_months(table: DataFrame, dst: str) -> None:
    (
        table.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", _ROWS_PER_FILE)
        .partitionBy("year", "month")
        .parquet(dst)
    )


@dataclass(frozen=True)
class IngestAudit:
    """What an ingest counted on its way: nothing here reads an extract again."""

    file_rows: DataFrame  # year, month, filename, nrows of every extract that has rows
    rows_read: dict[int, int]  # by year, counted where the extracts were read
    written: DataFrame  # the rows that now lie there, of the years read

    def reconcile(self) -> DataFrame:
        """(year, rows_before, rows_after, difference): rows read from the extracts against rows in the written files."""
        read = sorted(self.rows_read.items())
        before = self.written.sparkSession.createDataFrame(read, "year int, rows_before bigint")
        after = self.written.groupBy("year").agg(F.count(F.lit(1)).alias("rows_after"))
        both = before.join(after, "year", "left").withColumn("rows_after", F.coalesce("rows_after", F.lit(0).cast("bigint")))
        return both.withColumn("difference", F.col("rows_after") - F.col("rows_before"))


def ingest_audited(
    spark: SparkSession,
    root: str,
    dst: str,
    years: Iterable[int] | None = None,
    *,
    missing: Iterable[str] = MISSING_TEXTS,
    same_headers: bool = False,
) -> IngestAudit:
    """``ingest_postings`` that also counts, so that each extract is read once.

    Rows are counted by year as they are read, and every written row keeps the name of its extract (``filename``, which costs next to
    nothing in sorted runs). Counts by extract are taken from that column of the written files alone. Extracts
    without rows are in no count by file, but their year is.
    """
    table = read_raw_postings(spark, root, years, missing=missing, same_headers=same_headers)
    found = sorted({int(f.split("/")[-3]) for f in table.inputFiles()})
    counted, seen = [F.count_if(F.col("year") == y).alias(str(y)) for y in found], Observation()
    _write_months(table.observe(seen, *counted), dst)
    rows_read = {int(y): n for y, n in seen.get.items()}
    written = spark.read.parquet(dst).where(F.col("year").isin(found))
    file_rows = written.groupBy("year", "month", "filename").agg(F.count(F.lit(1)).alias("nrows"))
    return IngestAudit(file_rows, rows_read, written)


def csv_to_parquet(
    spark: SparkSession,
    src: str,
    dst: str,
    schema: StructType | None = None,
    *,
    missing: Iterable[str] = MISSING_TEXTS,
    multi_line: bool = True,
) -> None:
    """Convert every CSV of a folder, also gzip ones, to Parquet (ZSTD), columns by name: as text, or as ``schema`` says.

    ``multi_line=False`` lets Spark split large files whose values hold no line breaks.
    """
    parts = [_clean(p, missing).drop("filename") for p in csv_parts(spark, f"{src}/*.{{csv,csv.gz}}", multi_line=multi_line)]
    if schema is None:
        names = list(dict.fromkeys(c for p in parts for c in p.columns))
        schema = StructType()
        for name in names:
            schema = schema.add(name, StringType())
    table = reduce(DataFrame.unionByName, [conform(p, schema) for p in parts])
    write_table(table, dst)
