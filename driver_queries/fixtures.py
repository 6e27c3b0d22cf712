"""Posting, profile, description and link tables as views over the driver's tables.

The view text is portable SQL: Spark builds the inputs of the queries from it, and the
reference SQL starts with it. Only lists in order are written differently, see ``DUCK_VIEWS``.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workforce_signals.plans.stored import new_path
from workforce_signals.plans.workers import importable
from workforce_signals.sources.read import glob_paths
from workforce_signals.sources.write import CSV_OPTIONS, write_table, write_year

BASE_TABLES = ("customer", "documents", "lineitem", "orders", "part")

AS_OF = 2003
FIRST_YEAR, END_YEAR = 1995, 2005

FX_POSTINGS = """
SELECT o.o_orderkey AS id, year(o.o_orderdate) AS year,
  cast(cast(cast(floor(o.o_custkey / 4) AS bigint) AS double) AS string) AS company,
  CASE WHEN o.o_custkey % 50 = 7 THEN NULL ELSE 'Firm ' || cast(cast(floor(o.o_custkey / 4) AS bigint) AS string) END AS company_name,
  CASE WHEN o.o_orderkey % 97 = 0 THEN NULL WHEN o.o_orderkey % 97 = 1 THEN ''
       ELSE t.toks || CASE WHEN o.o_orderkey % 89 = 0 THEN '||' ELSE '' END
                   || CASE WHEN o.o_orderkey % 101 = 0 THEN '|  ' ELSE '' END END AS skills_name
FROM orders o LEFT JOIN (
  SELECT k.l_orderkey, listagg(k.tok, '|') WITHIN GROUP (ORDER BY k.place) AS toks
  FROM (SELECT j.*, cast(j.l_linenumber AS string) || j.tok AS place FROM (SELECT l.l_orderkey, l.l_linenumber,
    CASE WHEN q.o_orderpriority = '1-URGENT' AND l.l_linenumber = 1 THEN 'Machine Learning'
         WHEN q.o_orderpriority = '1-URGENT' AND l.l_linenumber = 2 THEN ' NLP '
         WHEN l.l_linenumber = 7 THEN p.p_name || ' ' || p.p_brand
         WHEN l.l_linenumber = 3 THEN '  ' || upper(split_part(p.p_name, ' ', 2)) || ' '
         WHEN l.l_linenumber % 2 = 1 THEN split_part(p.p_name, ' ', 2) || ' ' || q.o_orderpriority
         ELSE split_part(p.p_name, ' ', 2) END AS tok
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN orders q ON q.o_orderkey = l.l_orderkey) j) k
  GROUP BY k.l_orderkey) t ON t.l_orderkey = o.o_orderkey
"""

FX_PROFILE = """
SELECT o.o_custkey AS id, cast(cast(floor(o.o_custkey / 4) AS bigint) AS string) AS company,
  CASE WHEN o.o_orderkey % 83 = 0 THEN NULL
       WHEN o.o_orderkey % 7 = 0 THEN ' firm ' || cast(cast(floor(o.o_custkey / 4) AS bigint) AS string)
       ELSE 'Firm ' || cast(cast(floor(o.o_custkey / 4) AS bigint) AS string) END AS company_name,
  CASE o.o_orderkey % 20 WHEN 0 THEN 'Machine Learning Engineer' WHEN 1 THEN NULL ELSE 'Clerk ' || o.o_orderpriority END AS title_raw,
  CASE WHEN o.o_orderkey % 53 = 0 THEN '  ' WHEN o.o_orderkey % 59 = 0 THEN '2000-7' WHEN o.o_orderkey % 61 = 0 THEN '1999-13'
       WHEN o.o_orderkey % 67 = 0 THEN NULL
       ELSE substr(cast(o.o_orderdate AS string), 1, 7) END AS most_recent_company_start_month,
  CASE o.o_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'n/a' WHEN 3 THEN '1994-01'
       ELSE cast(year(o.o_orderdate) + o.o_orderkey % 4 AS string) || '-06' END AS most_recent_company_end_month,
  CASE o.o_orderkey % 3 WHEN 0 THEN '1' WHEN 1 THEN '0' ELSE '' END AS is_current
FROM orders o
"""

FX_DESCRIPTION = """
SELECT doc_id AS id, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE text END AS description_raw FROM documents
"""

# Every customer; a third of the numbers and names belong to no firm.
FX_LINK = """
SELECT cast(CASE WHEN c_custkey % 3 = 0 THEN -c_custkey ELSE c_custkey END AS double) AS ID,
  'Firm ' || cast(CASE WHEN c_custkey % 3 = 0 THEN -c_custkey ELSE c_custkey END AS string) AS NAME,
  lpad(cast(1000 + c_custkey AS string), 6, '0') AS GVKEY
FROM customer
UNION ALL SELECT cast(NULL AS double), cast(NULL AS string), '999999'
"""

# The older sample's layout, all text.
FX_SAMPLE = """
SELECT cast(p.id AS string) AS ID, p.title_raw AS TITLE_NAME, p.company_name AS COMPANY_NAME_RAW, p.is_current AS IS_CURRENT,
  p.most_recent_company_start_month AS JOB_START_YM, p.most_recent_company_end_month AS JOB_END_YM,
  d.description_raw AS DESCRIPTION_RAW
FROM fx_profile p LEFT JOIN fx_description d ON d.id = p.id
"""

VIEWS = {
    "fx_postings": FX_POSTINGS,
    "fx_profile": FX_PROFILE,
    "fx_description": FX_DESCRIPTION,
    "fx_link": FX_LINK,
    "fx_sample": FX_SAMPLE,
}

ROWS_PER_WORKBOOK = 50_000
ROWS_PER_CSV = 50_000

# The least parts of a workbook of one sheet.
_BOOK = {
    "[Content_Types].xml": """<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">
<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>
<Default Extension="xml" ContentType="application/xml"/>
<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>
<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>
<Override PartName="/xl/sharedStrings.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sharedStrings+xml"/></Types>""",
    "_rels/.rels": """<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">
<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>""",
    "xl/workbook.xml": """<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"
xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>""",
    "xl/_rels/workbook.xml.rels": """<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">
<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/>
<Relationship Id="rId2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/sharedStrings" Target="sharedStrings.xml"/></Relationships>""",
}


def _workbook(rows: Iterable[tuple]) -> bytes:
    """A workbook whose sheet has these rows, numbers as numbers and texts as shared strings, row numbers in front."""
    strings: dict[str, int] = {}

    def cell(value) -> str:
        if value is None:
            return "<c/>"
        if isinstance(value, str):
            return f'<c t="s"><v>{strings.setdefault(value, len(strings))}</v></c>'
        return f"<c><v>{value!r}</v></c>"

    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    lines = [f"<row>{''.join(map(cell, (None if i == 0 else i - 1, *row)))}</row>" for i, row in enumerate(rows)]
    texts = "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in strings)
    parts = _BOOK | {
        "xl/worksheets/sheet1.xml": f"<worksheet {space}><sheetData>{''.join(lines)}</sheetData></worksheet>",
        "xl/sharedStrings.xml": f"<sst {space}>{texts}</sst>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in parts.items():
            archive.writestr(name, text)
    return out.getvalue()


def _write_workbooks(df: DataFrame, path: str) -> None:
    """The table as workbooks of a bounded number of rows, as spreadsheets are given."""
    spark = df.sparkSession
    importable(spark)
    names = tuple(df.columns)

    def packed(batches):
        rows = [row for batch in batches for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None)]
        yield pd.DataFrame({"content": [_workbook([names, *rows])] if rows else []}, dtype=object)

    files = df.repartition(1 + df.count() // ROWS_PER_WORKBOOK, F.xxhash64(*names)).mapInPandas(packed, "content binary")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    for i, row in enumerate(files.toLocalIterator()):
        stream = system.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{i}.xlsx"))
        stream.write(row["content"])
        stream.close()


def link_workbooks(spark: SparkSession, sf_dir: str) -> str:
    """The link table as a folder of workbooks."""
    return built(spark, sf_dir, "link-workbooks", lambda path: _write_workbooks(link(spark, sf_dir), path))


# An ordered list is spelled otherwise in DuckDB.
_IN_ORDER = "listagg(k.tok, '|') WITHIN GROUP (ORDER BY k.place)", "string_agg(k.tok, '|' ORDER BY k.place)"
DUCK_VIEWS = {name: text.replace(*_IN_ORDER) for name, text in VIEWS.items()}

_built: dict[tuple[str, str, str], str] = {}


def built(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """Path of an input written once per application to the shared folder, as input files would lie there."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built or not glob_paths(spark, _built[key]):
        path = new_path(spark, name)
        write(path)
        _built[key] = path
    return _built[key]


# Views over one table. The others join, so their rows come in pieces that the join makes.
_OVER = {"fx_profile": "orders", "fx_description": "documents", "fx_link": "customer"}

# Bytes of a table's files for each core, up to which a view of it is dealt out anew.
_SMALL_BYTES = 16 << 20


def _file_bytes(spark: SparkSession, path: str) -> int:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def _view(spark: SparkSession, sf_dir: str, name: str, deal: bool = True) -> DataFrame:
    """A view, in many pieces: inputs are folders of files.

    Only a small table, whose files are few, is dealt out to as many pieces as there are cores. A larger one stays in the pieces
    it is read in, and a join in those that it makes: their number grows with the rows, and no text is sent around for it. Without
    ``deal`` a small one does too, since what follows sends its rows around anyway.
    """
    for table in BASE_TABLES:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    if name == "fx_sample":
        for other in ("fx_profile", "fx_description"):
            spark.sql(VIEWS[other]).createOrReplaceTempView(other)
    rows, cores = spark.sql(VIEWS[name]), spark.sparkContext.defaultParallelism
    if deal and name in _OVER and _file_bytes(spark, f"{sf_dir}/{_OVER[name]}.parquet") <= cores * _SMALL_BYTES:
        return rows.repartition(cores)
    return rows


def postings_path(spark: SparkSession, sf_dir: str) -> str:
    return built(spark, sf_dir, "fx_postings", lambda path: write_year(_view(spark, sf_dir, "fx_postings"), path))


def table_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    return built(spark, sf_dir, name, lambda path: write_table(_view(spark, sf_dir, name), path))


def _table(spark: SparkSession, sf_dir: str, name: str, deal: bool = False) -> DataFrame:
    """The view itself: a query that reads it once needs no copy in the shared folder. A copy that is there already is read."""
    if (spark.sparkContext.applicationId, sf_dir, name) in _built:
        return stored(spark, sf_dir, name)
    return _view(spark, sf_dir, name, deal)


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a table of files."""
    return spark.read.parquet(table_path(spark, sf_dir, name))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "fx_profile")


def descriptions(spark: SparkSession, sf_dir: str, searched: bool = True) -> DataFrame:
    """Texts; those to be searched before they meet anything are dealt out first if they are few."""
    return _table(spark, sf_dir, "fx_description", searched)


def link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "fx_link")


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "fx_sample")


def _write_sample(df: DataFrame, path: str) -> None:
    """Gzip CSV files of a bounded number of rows: a file whose values may hold line breaks is read by one task."""
    writer = df.write.options(**CSV_OPTIONS, compression="gzip", maxRecordsPerFile=ROWS_PER_CSV)
    writer.csv(path)


def sample_csv(spark: SparkSession, sf_dir: str) -> str:
    """The older sample as a CSV folder, written from the view itself."""
    return built(spark, sf_dir, "sample", lambda path: _write_sample(_view(spark, sf_dir, "fx_sample"), path))
