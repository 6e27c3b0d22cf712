"""Readers. Files of one table are united by column name and conformed to a known schema."""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DataType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from workforce_signals.functions.text import double_text, nan_to_null, whole_number
from workforce_signals.sources import schemas
from workforce_signals.sources.members import member_records
from workforce_signals.sources.peek import first_line, parquet_shape, shapes
from workforce_signals.sources.workbook import read_workbook, workbook_parts

# Quotes are doubled inside quoted values, and quoted values may hold line breaks.
CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}

_SKILL_YEAR_FILES = "[0-9][0-9][0-9][0-9]_skills_counts_co"
_PEEK_THREADS = 32


def glob_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Files and folders matching a path or glob, by one listing of the file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(status.getPath().toString() for status in found or ())


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Data files matching a path or glob, those inside matching folders too; sorted."""
    if not glob_paths(spark, pattern):
        return []
    return sorted(unquote(f) for f in spark.read.format("binaryFile").load(pattern).inputFiles())


def require_input(spark: SparkSession, pattern: str) -> list[str]:
    """Files matching ``pattern``; raises before anything is computed when there are none."""
    files = list_files(spark, pattern)
    if not files:
        raise FileNotFoundError(f"no input files at {pattern}")
    return files


def with_source_file(df: DataFrame, name: str = "filename") -> DataFrame:
    """Add the path of the file each row was read from. Apply directly to a file scan."""
    return df.select("*", F.col("_metadata.file_path").alias(name))


def conform(df: DataFrame, schema: StructType, *, keep: Iterable[str] = ()) -> DataFrame:
    """Pick the columns of ``schema`` by name, cast to its types; absent ones are NULL."""
    present = {f.name.lower(): f for f in df.schema}
    columns = []
    for field in schema:
        source = present.get(field.name.lower())
        column = F.lit(None).cast(field.dataType) if source is None else _cast(source, field.dataType)
        columns.append(column.alias(field.name))
    return df.select(*columns, *keep)


def _cast(source: StructField, target: DataType) -> Column:
    column, whole = F.col(f"`{source.name}`"), isinstance(target, (LongType, IntegerType))
    kind = source.dataType.typeName()
    if source.dataType == target:
        return column
    if kind in ("double", "float"):
        if whole:
            return whole_number(nan_to_null(column), target)
        if isinstance(target, StringType):
            return double_text(column)
    if kind == "string" and whole:
        return whole_number(column.cast("decimal(38,6)"), target)
    if kind == "decimal" and whole:
        return whole_number(column, target)
    return column.cast(target)


def _grouped(
    spark: SparkSession, files: list[str], look: Callable[[str], str], shape_of: Callable[[SparkSession, str], str]
) -> list[list[str]]:
    """Group files by their shape. Only file headers are looked at: very many by tasks with ``look``, the rest, and what tasks cannot
    open, by the driver with ``shape_of``."""
    found = shapes(spark, files, look)
    rest = [f for f in files if f not in found]
    with ThreadPoolExecutor(_PEEK_THREADS) as pool:
        mine = dict(zip(rest, pool.map(lambda f: shape_of(spark, f), rest), strict=True))
    groups: dict[tuple[bool, str], list[str]] = {}
    for file in files:
        groups.setdefault((file in found, found.get(file, mine.get(file, ""))), []).append(file)
    return list(groups.values())


def _footer(spark: SparkSession, file: str) -> str:
    """The schema in a Parquet file's footer; no Spark job."""
    settings, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path(file)
    parquet = spark._jvm.org.apache.parquet.hadoop
    reader = parquet.ParquetFileReader.open(parquet.util.HadoopInputFile.fromPath(path, settings))
    try:
        return reader.getFileMetaData().getSchema().toString()
    finally:
        reader.close()


def parquet_parts(spark: SparkSession, pattern: str) -> list[DataFrame]:
    """Parquet files as one scan, or as one scan per schema where column types disagree.

    Where they disagree, footers are read by one Spark job, those of a few files by the driver, so planning
    takes a fixed number of jobs and one more for each distinct schema, however many files there are.
    """
    try:
        return [spark.read.option("mergeSchema", True).parquet(pattern)]
    except (PySparkException, Py4JJavaError) as error:
        if "CANNOT_MERGE_SCHEMAS" not in str(error):
            raise
    groups = _grouped(spark, require_input(spark, pattern), parquet_shape, _footer)
    return [spark.read.parquet(*group) for group in groups]


def _first_line(spark: SparkSession, file: str) -> str:
    """The first line of a plain or compressed text file; no Spark job, and only its first block is read."""
    hadoop, java = spark._jvm.org.apache.hadoop, spark._jvm.java.io
    settings, path = spark._jsc.hadoopConfiguration(), hadoop.fs.Path(file)
    stream = path.getFileSystem(settings).open(path)
    try:
        codec = hadoop.io.compress.CompressionCodecFactory(settings).getCodec(path)
        text = stream if codec is None else codec.createInputStream(stream)
        return java.BufferedReader(java.InputStreamReader(text, "UTF-8")).readLine() or ""
    finally:
        stream.close()


def _csv_groups(spark: SparkSession, pattern: str, same_headers: bool = False) -> list[tuple[list[str], list[str]]]:
    """Column names and files for every distinct header; with ``same_headers`` one file of a folder speaks for all."""
    files, found = require_input(spark, pattern), []
    folders: dict[str, list[str]] = {}
    for file in files:
        folders.setdefault(file.rsplit("/", 1)[0] if same_headers else file, []).append(file)
    of_file = {group[0]: group for group in folders.values()}
    for ones in _grouped(spark, list(of_file), first_line, _first_line):
        names = next(csv.reader([_first_line(spark, ones[0]).removeprefix("\ufeff")]), [])
        if names:
            found.append(([name or f"_c{i}" for i, name in enumerate(names)], [f for one in ones for f in of_file[one]]))
    if not found:
        raise FileNotFoundError(f"only empty files at {pattern}")
    return found


def csv_parts(
    spark: SparkSession, pattern: str, *, multi_line: bool = True, same_headers: bool = False
) -> list[DataFrame]:
    """CSV files as all-string tables, one scan per distinct header, so columns go by name.

    ``same_headers`` states that the files of a folder agree: one of each folder is opened to plan, and
    the task that reads a file raises if its header differs.
    """
    options = CSV_OPTIONS | {"multiLine": multi_line, "enforceSchema": not same_headers}
    return [
        spark.read.options(**options).schema(StructType([StructField(n, StringType()) for n in names])).csv(files)
        for names, files in _csv_groups(spark, pattern, same_headers)
    ]


def member_parts(
    spark: SparkSession, pattern: str, *, same_headers: bool = False, range_bytes: int | None = None
) -> list[DataFrame]:
    """``csv_parts`` of gzip files, of which large ones made of many members are read by several tasks.

    Each table has a further column ``_file``. With ``same_headers`` headers that differ are not noticed.
    """
    options = {k: str(v) for k, v in CSV_OPTIONS.items() if k not in ("header", "multiLine")}
    parts = []
    for names, files in _csv_groups(spark, pattern, same_headers):
        schema = StructType([StructField(n, StringType()) for n in names])
        row = F.from_csv("record", schema.toDDL(), options).alias("row")
        parts.append(member_records(spark, files, range_bytes).select(F.col("filename").alias("_file"), row).select("row.*", "_file"))
    return parts


def _united(parts: list[DataFrame]) -> DataFrame:
    """Tables one below the other by column name; columns a table lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _wider(a: DataType, b: DataType) -> DataType:
    """A type that holds the values of both: the larger of two numbers or times, else text."""
    order = (IntegerType(), LongType(), DoubleType()), (DateType(), TimestampType())
    for kinds in order:
        if a in kinds and b in kinds:
            return kinds[max(kinds.index(a), kinds.index(b))]
    return a if a == b else StringType()


def _inferred_csv(spark: SparkSession, pattern: str, multi_line: bool) -> DataFrame:
    """CSV files united by name, with types inferred over all files."""
    options, groups, kinds = CSV_OPTIONS | {"multiLine": multi_line}, _csv_groups(spark, pattern), {}
    for names, files in groups:
        found = spark.read.options(**options, inferSchema=True).csv(files).schema
        for name, field in zip(names, found, strict=True):
            kinds[name] = _wider(kinds[name], field.dataType) if name in kinds else field.dataType
    return _united(
        [
            spark.read.options(**options).schema(StructType([StructField(n, kinds[n]) for n in names])).csv(files)
            for names, files in groups
        ]
    )


def read_united(
    spark: SparkSession,
    pattern: str,
    schema: StructType,
    fmt: str = "parquet",
    *,
    with_file: bool = False,
    multi_line: bool = True,
) -> DataFrame:
    """All files of ``pattern`` as one table of ``schema``, united by column name."""
    if fmt == "csv":
        parts = csv_parts(spark, pattern, multi_line=multi_line)
    else:
        parts = parquet_parts(spark, pattern)
    keep = [F.col("_metadata.file_path").alias("filename")] if with_file else []
    return reduce(DataFrame.unionByName, [conform(p, schema, keep=keep) for p in parts])


def _locate(spark: SparkSession, path: str) -> tuple[str, str]:
    known = ((".parquet", "parquet"), (".csv", "csv"), (".xlsx", "workbook"))
    for suffix, fmt in known:
        if path.endswith(suffix):
            return path, fmt
    for suffix, fmt in (*known, ("", "parquet")):
        if list_files(spark, path + suffix):
            return path + suffix, fmt
    raise FileNotFoundError(f"neither {path}.parquet nor {path}.csv nor {path}.xlsx exists")


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str = "auto",
    schema: StructType | None = None,
    *,
    multi_line: bool = True,
) -> DataFrame:
    """A Parquet or CSV table or a workbook. ``auto`` prefers ``path.parquet`` over ``path.csv`` over ``path.xlsx``.

    CSV types are taken from ``schema``, or inferred by a second pass when there is none. Columns go
    by name either way; those a file lacks are NULL.
    ``multi_line=False`` lets Spark split large CSV files that hold no quoted line breaks.
    """
    if fmt == "auto":
        path, fmt = _locate(spark, path)
    if fmt == "workbook":
        table = read_workbook(spark, path)
        return table if schema is None else conform(table, schema)
    if schema is not None:
        require_input(spark, path)
        return read_united(spark, path, schema, fmt, multi_line=multi_line)
    if fmt == "csv":
        return _inferred_csv(spark, path, multi_line)
    return spark.read.parquet(path)


def _by_year(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A ``year=...`` table of this library. Its schema is known, so no file footer is read to plan."""
    return spark.read.schema(StructType([*schema.fields, StructField("year", IntegerType())])).parquet(path)


def read_postings(
    spark: SparkSession,
    root: str,
    years: Iterable[int] | None = None,
    schema: StructType = schemas.POSTING,
) -> DataFrame:
    """Postings of all years with a ``year`` column.

    ``root`` holds either one folder per year (``2010/parquet/*.parquet``) or the
    ``year=...`` partitions that ``ingest_postings`` writes. A filter on ``year`` skips the rest.
    """
    if glob_paths(spark, f"{root}/year=*"):
        table = _by_year(spark, root, schema).select(*schema.names, "year")
        return table if years is None else table.where(F.col("year").isin(list(years)))
    if years is None:
        years = [int(p.split("/")[-2]) for p in glob_paths(spark, f"{root}/[0-9][0-9][0-9][0-9]/parquet")]
        if not years:
            raise FileNotFoundError(f"no year folders in {root}")
    parts = []
    for year in sorted(years):
        pattern = f"{root}/{year}/parquet/*.parquet"
        require_input(spark, pattern)
        parts.append(read_united(spark, pattern, schema).withColumn("year", F.lit(int(year))))
    return reduce(DataFrame.unionByName, parts)


def read_skill_years(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """Skill counts of all years: yearly files, Parquet before CSV, or ``year=...`` partitions."""
    for fmt in ("parquet", "csv"):
        pattern = f"{path}/{_SKILL_YEAR_FILES}.{fmt}"
        if glob_paths(spark, pattern):
            table = read_united(spark, pattern, schemas.SKILL_YEAR, fmt, with_file=True, multi_line=multi_line)
            year = F.regexp_extract("filename", rf"/([0-9]{{4}})_skills_counts_co\.{fmt}(?:/[^/]*)?$", 1)
            return table.select(year.cast("int").alias("year"), *schemas.SKILL_YEAR.names)
    if not glob_paths(spark, f"{path}/year=*"):
        raise FileNotFoundError(f"no yearly skill counts in {path}")
    return _by_year(spark, path, schemas.SKILL_YEAR).select("year", *schemas.SKILL_YEAR.names)


def read_profiles_csv(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """CSV files with headers, every column as text and by name; empty values, quoted or not, are NULL.

    ``multi_line=False`` lets Spark split large files whose texts hold no line breaks.
    """
    return _united(csv_parts(spark, path, multi_line=multi_line))


def read_link(
    spark: SparkSession, path: str, *, index_col: int | None = None, multi_line: bool = True, sheet: str | int = 0
) -> DataFrame:
    """The firm identifier table, CSV, Parquet or workbooks, with ``ID``, ``NAME``, ``GVKEY`` and what else it has.

    ``index_col`` is the position of a column of row numbers, which is left out whatever its name is. ``sheet`` names the sheet
    of a workbook, or its place.
    """
    path, fmt = _locate(spark, path)
    if fmt == "workbook":
        parts = workbook_parts(spark, path, sheet)
    else:
        parts = csv_parts(spark, path, multi_line=multi_line) if fmt == "csv" else [spark.read.parquet(path)]
    if index_col is not None:
        parts = [p.select(*(f"`{c}`" for i, c in enumerate(p.columns) if i != index_col)) for p in parts]
    table = _united(parts)
    known = {name.lower() for name in schemas.LINK.names}
    others = [c for c in table.columns if c.lower() not in known]
    return conform(table, schemas.LINK, keep=[F.col(f"`{c}`") for c in others])
