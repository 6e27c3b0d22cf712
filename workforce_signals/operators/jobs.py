"""Job scores, job flags, and their firm and yearly shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workforce_signals.functions.text import skill_tokens
from workforce_signals.operators.skills import ID, SKILLS, job_key, listed, repeated_ids
from workforce_signals.plans.stored import Stored, store

THRESHOLD = 0.1

# Scores are summed as two whole numbers, of 2^-30 and 2^-60: exactly, so in any order alike.
_UNIT = float(1 << 30)


def _parts(score: Column) -> tuple[Column, Column]:
    high = F.floor(score * _UNIT)
    return high, F.floor((score * _UNIT - high) * _UNIT)


def _total(high: Column, low: Column) -> Column:
    return high / F.lit(_UNIT) + low / F.lit(_UNIT * _UNIT)


def flag_jobs(df: DataFrame, threshold: float = THRESHOLD, *, score_col: str = "job_ai_score") -> DataFrame:
    """Add ``ai_job``: 1 where the score exceeds ``threshold``, else 0, also for a NULL score."""
    return df.withColumn("ai_job", F.when(F.col(score_col) > F.lit(float(threshold)), 1).otherwise(0))


def job_scores(
    postings: DataFrame,
    scores: DataFrame | Stored,
    threshold: float = THRESHOLD,
    dedup: bool = True,
    unmatched_as_zero: bool = False,
    require_match: bool = False,
    *,
    sep: str = "|",
    id_col: str = ID,
    skills_col: str = SKILLS,
    unique_ids: bool = False,
    repeated: Stored | None = None,
) -> DataFrame:
    """Mean skill score per job, over the job's distinct skills that have a score.

    A row's own repeats go inside the row. Skills have to be compared across rows only for
    ids that occur more than once, so all other jobs collapse to one narrow row before the
    shuffle instead of shuffling a row per skill.
    """
    scores = store(scores.select("skill", "ai_score") if isinstance(scores, DataFrame) else scores, "scores")
    jobs = listed(postings, id_col, skills_col)
    job = [*job_key(jobs), "company", "company_name"]
    for column in ("company", "company_name"):
        jobs = jobs.withColumn(column, F.col(column).cast("string"))
    jobs = jobs.select(*job, "skills")
    skills = skill_tokens(F.col("skills"), sep)
    if dedup:
        skills = F.array_distinct(skills)

    shared = None
    if dedup and not unique_ids:
        repeated = repeated or repeated_ids(postings, id_col=id_col)
        if not repeated.is_empty:
            marked = _mark_repeated(jobs, job[:-2], repeated)
            jobs, shared = marked.where(~F.col("is_repeated")), marked.where("is_repeated")

    def totals(rows: DataFrame) -> DataFrame:
        rows = rows.join(scores.for_join(), "skill", "left")
        score = F.coalesce(F.col("ai_score"), F.lit(0.0)) if unmatched_as_zero else F.col("ai_score")
        high, low = _parts(score)
        rows = rows.withColumns({"high": high, "low": low})
        n, matched = F.count(F.lit(1)), F.count("ai_score")
        return rows.groupBy(*job).agg(n.alias("n"), matched.alias("m"), F.sum("high").alias("t"), F.sum("low").alias("u"))

    per_job = totals(jobs.select(*job, F.explode(skills).alias("skill")))
    if shared is not None:
        # Tasks of a bounded number of rows: each keeps the distinct skills it meets before they are brought together.
        pairs = shared.select(*job, F.explode(skills).alias("skill")).hint("rebalance")
        per_job = per_job.unionByName(totals(pairs.distinct()))
    divisor = F.col("n") if unmatched_as_zero else F.col("m")
    result = per_job.select(
        *job,
        F.try_divide(_total(F.col("t"), F.col("u")), divisor.cast("double")).alias("job_ai_score"),
        F.col("n").alias("n_skills"),
        F.col("m").alias("n_matched_skills"),
    )
    if require_match:
        result = result.where(F.col("n_matched_skills") > 0)
    return flag_jobs(result, threshold)


def _mark_repeated(jobs: DataFrame, key: list[str], repeated: Stored) -> DataFrame:
    """Add ``is_repeated``, true in rows of repeated ids. A set too large to broadcast meets the rows by a shuffle on the id.

    Rows of an id are not grouped above that join, so Spark may split an id that very many rows share.
    """
    ids = repeated.for_join().select(*(F.col(c).alias(f"_{c}") for c in key), F.lit(True).alias("found"))
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return jobs.join(ids, same, "left").withColumn("is_repeated", F.coalesce(F.col("found"), F.lit(False)))


def company_share(jobs: DataFrame) -> DataFrame:
    """Postings, flagged postings and their share per firm id and name, by year where there is one."""
    by = [c for c in ("year",) if c in jobs.columns]
    return jobs.groupBy(*by, "company", "company_name").agg(
        F.count(F.lit(1)).alias("n_postings"),
        F.sum("ai_job").alias("n_ai_jobs"),
        F.avg(F.col("ai_job").cast("double")).alias("ai_job_share"),
    )


def yearly_share(jobs: DataFrame, years: tuple[int, int] | None = None) -> DataFrame:
    """Share of flagged jobs per year. ``years`` is an inclusive range."""
    if years is not None:
        jobs = jobs.where(F.col("year").between(*years))
    return jobs.groupBy("year").agg(F.avg(F.col("ai_job").cast("double")).alias("share"))
