"""Skills of postings: explode, count per year, score over all years, rank."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workforce_signals.functions.text import (
    CORE_TERMS,
    holds_any,
    id_text,
    norm_token,
    skill_tokens,
)
from workforce_signals.plans.stored import Stored, store

ID = "id"
SKILLS = "skills_name"


def terms_df(spark: SparkSession, terms: Iterable[str] = CORE_TERMS) -> DataFrame:
    """The core terms as a one-column table."""
    return spark.createDataFrame([(t,) for t in terms], "term string")


def job_key(postings: DataFrame) -> list[str]:
    """Columns that identify a job: its id within a year, when the table has a year."""
    return ["year", "job_id"] if "year" in postings.columns else ["job_id"]


def with_job_id(postings: DataFrame, id_col: str = ID) -> DataFrame:
    """Add ``job_id``, the id as text."""
    kind = postings.schema[id_col].dataType.typeName()
    return postings.withColumn("job_id", id_text(F.col(id_col), kind))


def listed(postings: DataFrame, id_col: str = ID, skills_col: str = SKILLS) -> DataFrame:
    """Postings that list skills, with ``job_id`` and the list as ``skills``."""
    text = F.col(skills_col).cast("string")
    return with_job_id(postings, id_col).where(text.isNotNull() & (text != "")).withColumn("skills", text)


def explode_skills(
    postings: DataFrame,
    sep: str = "|",
    keep: Sequence[str] = ("company", "company_name"),
    *,
    id_col: str = ID,
    skills_col: str = SKILLS,
) -> DataFrame:
    """One row per (posting, listed skill). Repeated skills give repeated rows."""
    jobs = listed(postings, id_col, skills_col)
    return jobs.select(
        *job_key(jobs),
        *(F.col(c).cast("string").alias(c) for c in keep),
        F.explode(skill_tokens(F.col("skills"), sep)).alias("skill"),
    )


def core_jobs(
    postings: DataFrame,
    terms: DataFrame | Iterable[str] = CORE_TERMS,
    *,
    sep: str = "|",
    id_col: str = ID,
    skills_col: str = SKILLS,
) -> DataFrame:
    """Distinct jobs listing a core term. The list is tested as it stands, without exploding it.

    Terms may also come as a table with a column ``term``, of any length; the skills then meet it by a join.
    """
    if isinstance(terms, DataFrame):
        rows = explode_skills(postings, sep, (), id_col=id_col, skills_col=skills_col)
        found = rows.join(terms.select(F.col("term").alias("skill")), "skill", "left_semi")
        return found.drop("skill").distinct()
    jobs = listed(postings, id_col, skills_col)
    core = jobs.where(holds_any(skill_tokens(F.col("skills"), sep), terms))
    return core.select(*job_key(jobs)).distinct()


def repeated_ids(postings: DataFrame, *, id_col: str = ID) -> Stored:
    """Ids that more than one posting row of a year carries, stored and measured.

    Job ids are nearly always unique, and where they are a job can be counted and scored
    inside its own row. This check reads the id column only; what it finds tells the
    skill and job operators which rows need to be brought together at all.

    Ids are counted by a hash of eight bytes first, so an id that occurs once does not cross the
    network itself, unless another one has its hash. Ids whose hash repeats are then counted as they are.
    """
    jobs = with_job_id(postings, id_col)
    key = job_key(jobs)
    jobs = jobs.select(*key, F.xxhash64(*key).alias("id_hash"))
    hashes = jobs.groupBy("id_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("id_hash")
    marked = store(hashes, "repeated_hashes")
    if marked.is_empty:
        return store(jobs.select(*key).limit(0), "repeated_ids")
    counts = jobs.join(marked.for_join(), "id_hash", "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return store(counts.where(F.col("n") > 1).select(*key), "repeated_ids")


def skill_year_counts(
    postings: DataFrame,
    terms: Iterable[str] = CORE_TERMS,
    drop_core: bool = False,
    *,
    sep: str = "|",
    id_col: str = ID,
    skills_col: str = SKILLS,
    unique_ids: bool = False,
    repeated: Stored | None = None,
) -> DataFrame:
    """Rows listing each skill per year (``cnt``) and those whose job lists a core term.

    A job is its id within a year: a core term in one row of a repeated id counts for all
    rows of that id. A NULL id is no job and never co-occurs. ``unique_ids=True`` states
    that ids do not repeat and skips the check for it.
    """
    terms = list(terms)
    jobs = listed(postings, id_col, skills_col)
    key = job_key(jobs)
    jobs = jobs.select(*key, skill_tokens(F.col("skills"), sep).alias("tokens"))
    jobs = jobs.withColumn("has_core", holds_any(F.col("tokens"), terms))
    is_core: Column = F.col("has_core")
    if not unique_ids:
        repeated = repeated or repeated_ids(postings, id_col=id_col)
        if not repeated.is_empty:
            mixed = _partly_core(jobs, key, repeated)
            if not mixed.is_empty:
                jobs = jobs.join(mixed.for_join(), key, "left")
                is_core = is_core | F.coalesce(F.col("id_has_core"), F.lit(False))
    co = F.when(F.col("job_id").isNotNull() & is_core, 1).otherwise(0)
    rows = jobs.select(*key[:-1], co.alias("co"), F.explode("tokens").alias("skill"))
    if drop_core:
        rows = rows.where(~F.col("skill").isin(terms))
    return rows.groupBy(*key[:-1], "skill").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("co").alias("co_jobs_with_ai")
    )


def _partly_core(jobs: DataFrame, key: list[str], repeated: Stored) -> Stored:
    """Repeated ids with a core term in some of their rows but not in all."""
    rows = jobs.where(F.col("job_id").isNotNull()).select(*key, "has_core")
    rows = rows.join(repeated.for_join(), key, "left_semi")
    some, every = F.max("has_core"), F.min("has_core")
    mixed = rows.groupBy(*key).agg(some.alias("some"), every.alias("every"))
    mixed = mixed.where(F.col("some") & ~F.col("every"))
    return store(mixed.select(*key, F.lit(True).alias("id_has_core")), "partly_core_ids")


def skill_scores(
    skill_years: DataFrame, min_jobs: int = 50, years: tuple[int, int] | None = None
) -> DataFrame:
    """Pool the yearly counts and score each skill by its co-occurrence ratio.

    ``min_jobs <= 0`` keeps rare skills. ``years`` is an inclusive range.
    """
    if years is not None:
        skill_years = skill_years.where(F.col("year").between(*years))
    pooled = skill_years.groupBy(norm_token(F.col("skill")).alias("skill")).agg(
        F.sum(F.col("cnt").cast("bigint")).alias("total_cnt"),
        F.sum(F.col("co_jobs_with_ai").cast("bigint")).alias("total_co"),
    )
    return scored(pooled, min_jobs)


def scored(pooled: DataFrame, min_jobs: int = 50) -> DataFrame:
    """Pooled counts (skill, total_cnt, total_co) of skills that are frequent enough, with their ratio as ``ai_score``."""
    if min_jobs > 0:
        pooled = pooled.where(F.col("total_cnt") >= min_jobs)
    ratio = F.col("total_co").cast("double") / F.col("total_cnt").cast("double")
    return pooled.withColumn("ai_score", F.when(F.col("total_cnt") > 0, ratio).otherwise(0.0))


def top_skills(scores: DataFrame, k: int = 100) -> DataFrame:
    """The ``k`` best-scored skills; ties go to the more frequent, then by name."""
    order = [
        F.col("ai_score").desc_nulls_last(),
        F.col("total_cnt").desc_nulls_last(),
        F.col("skill").asc_nulls_last(),
    ]
    return scores.orderBy(*order).limit(k)
