"""Schemas of the known inputs. Columns a file lacks are read as NULL."""

from __future__ import annotations

from pyspark.sql.types import DataType, DoubleType, IntegerType, LongType, StringType, StructType

_STRING, _LONG, _INT, _DOUBLE = StringType(), LongType(), IntegerType(), DoubleType()


def _schema(columns: dict[str, DataType]) -> StructType:
    schema = StructType()
    for name, kind in columns.items():
        schema = schema.add(name, kind)
    return schema


# The columns kept of a raw posting extract.
RAW_POSTING = _schema(
    {
        "id": _LONG,
        "last_updated_date": _STRING,
        "duplicates": _STRING,
        "posted": _STRING,
        "expired": _STRING,
        "company": _STRING,
        "company_name": _STRING,
        "title_name": _STRING,
        "title_clean": _STRING,
        "skills_name": _STRING,
        "specialized_skills_name": _STRING,
    }
)

POSTING = _schema({"id": _LONG, "company": _STRING, "company_name": _STRING, "skills_name": _STRING})

SKILL_YEAR = _schema({"skill": _STRING, "cnt": _LONG, "co_jobs_with_ai": _LONG})

SKILL_SCORE = _schema({"skill": _STRING, "total_cnt": _LONG, "total_co": _LONG, "ai_score": _DOUBLE})

JOB_SCORE = _schema(
    {
        "job_id": _STRING,
        "company": _STRING,
        "company_name": _STRING,
        "job_ai_score": _DOUBLE,
        "n_skills": _LONG,
        "n_matched_skills": _LONG,
        "ai_job": _INT,
    }
)

PROFILE = _schema(
    {
        "id": _LONG,
        "company": _STRING,
        "company_name": _STRING,
        "title_raw": _STRING,
        "most_recent_company_start_month": _STRING,
        "most_recent_company_end_month": _STRING,
    }
)

DESCRIPTION = _schema({"id": _LONG, "description_raw": _STRING})

LINK = _schema({"ID": _DOUBLE, "NAME": _STRING, "GVKEY": _STRING})
