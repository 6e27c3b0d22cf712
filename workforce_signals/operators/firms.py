"""Firm-year measure: distinct persons and those with a keyword hit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workforce_signals.functions.text import norm_token


def company_year_person(flagged: DataFrame) -> DataFrame:
    """One row per firm, year and person; a hit in any of the person's spells counts.

    The normalised firm key follows from the name, so it takes no part in the grouping. The
    person is grouped on as a struct: a plain id would let Spark count on the partitions of an
    earlier join on ids, and then it could no longer split an id that holds many rows there.
    """
    rows = flagged.select(
        F.col("company_name_raw").alias("company_name"), "year", F.struct("id").alias("id"), "ai_related"
    )
    persons = rows.groupBy("company_name", "year", "id").agg(F.max("ai_related").alias("ai_related_any"))
    return persons.select(
        norm_token(F.col("company_name")).alias("company_key"),
        "company_name",
        "year",
        F.col("id.id").alias("id"),
        "ai_related_any",
    )


def company_year_share(flagged: DataFrame) -> DataFrame:
    """Persons, persons with a hit and their ratio per firm name and year.

    Persons are collapsed on (firm, year, person) first, so that a firm holding a large part of
    all rows is spread over the cluster and reaches its own group as partial sums only.
    """
    measure = company_year_person(flagged).groupBy("company_name", "year").agg(
        F.count(F.lit(1)).alias("employees"), F.sum("ai_related_any").cast("bigint").alias("ai_employees")
    )
    ratio = F.col("ai_employees").cast("double") / F.col("employees").cast("double")
    return measure.withColumn("ai_measure", F.when(F.col("employees") > 0, ratio))
