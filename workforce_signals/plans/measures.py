"""The two end-to-end measures and the flagged spell-year table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workforce_signals.functions.patterns import keyword_patterns
from workforce_signals.functions.text import CORE_TERMS, id_text, lower_text
from workforce_signals.operators.firms import company_year_share
from workforce_signals.operators.jobs import THRESHOLD, company_share, job_scores
from workforce_signals.operators.keywords import (
    cuts,
    ending,
    first_keyword_hit,
    flag_keyword,
    literal_keywords,
    opening,
    search_descriptions,
    with_joint_hit,
)
from workforce_signals.operators.gram_search import GramIndex
from workforce_signals.operators.linking import link_by_id, link_by_name
from workforce_signals.operators.skills import repeated_ids, skill_scores, skill_year_counts
from workforce_signals.operators.spells import (
    PROFILE_NAMES,
    expand_years,
    merge_profiles,
    parse_spells,
    usable_profiles,
)
from workforce_signals.plans.stored import store


def posting_measure(
    postings: DataFrame,
    link: DataFrame | None = None,
    *,
    terms: Iterable[str] = CORE_TERMS,
    min_jobs: int = 50,
    years: tuple[int, int] | None = None,
    threshold: float = THRESHOLD,
    dedup: bool = True,
    unmatched_as_zero: bool = False,
    require_match: bool = False,
    unique_ids: bool = False,
    null_keys_match: bool = False,
) -> DataFrame:
    """Postings to the share of flagged postings per firm and year, linked when ``link`` is given.

    Skill scores are stored: they are vocabulary-sized, and their measured size decides how
    they meet the postings again.
    """
    repeated = None if unique_ids else repeated_ids(postings)
    counts = skill_year_counts(postings, terms, unique_ids=unique_ids, repeated=repeated)
    scores = skill_scores(counts, min_jobs, years).select("skill", "ai_score")
    jobs = job_scores(
        postings,
        store(scores, "skill_scores"),
        threshold,
        dedup,
        unmatched_as_zero,
        require_match,
        unique_ids=unique_ids,
        repeated=repeated,
    )
    share = company_share(jobs)
    return share if link is None else link_by_id(share, link, null_keys_match)


def merge_with_hits(
    profiles: DataFrame, descriptions: DataFrame, keywords: DataFrame | Iterable[str]
) -> DataFrame:
    """``merge_profiles`` with ``first_hit_skill``, each description searched once, before the join.

    However many profile rows share a description, its text is read a single time, and where only
    the hit is used later no text passes the join.
    """
    words = literal_keywords(keywords)
    found = ("text_hit", "text_opening")
    merged = merge_profiles(profiles, search_descriptions(descriptions, words), keep=found)
    return with_joint_hit(merged, F.col("title_raw"), words).drop(*found)


def flag_years(
    spells: DataFrame,
    keywords: DataFrame | Iterable[str] | None = None,
    as_of: int | Column | None = None,
    open_end: str = "current",
) -> DataFrame:
    """Spell-years with ``ai_related`` and ``first_hit_skill``. A spell is searched once, not every year.

    Without ``keywords`` the spells already have ``first_hit_skill``.
    """
    if keywords is not None:
        spells = first_keyword_hit(spells, keywords)
    years = expand_years(spells, as_of, open_end)
    return flag_keyword(years).select(
        "id", "title_name", "company_name_raw", "description_raw", "year", "ai_related", "first_hit_skill"
    )


def resume_measure(
    profiles: DataFrame,
    descriptions: DataFrame | None,
    keywords: DataFrame | Iterable[str],
    link: DataFrame | None = None,
    *,
    as_of: int | Column | None = None,
    first_year: int = 2010,
    end_year: int = 2025,
    open_end: str = "current",
    names: dict[str, str] = PROFILE_NAMES,
    null_keys_match: bool = False,
) -> DataFrame:
    """Profiles and descriptions to the share of persons with a keyword per firm and year.

    With ``link`` the result is linked by name and limited to ``first_year <= year < end_year``.
    ``names`` maps the roles of the profiles' columns, and ``open_end`` says how long a spell without an
    end lasts, see ``expand_years``. ``descriptions=None``: the profiles have their texts themselves.
    """
    words = literal_keywords(keywords)
    window = None if link is None else (first_year, end_year)
    with_current = open_end == "flag"
    if descriptions is None:
        spells = parse_spells(profiles, with_current, names=names)
        flagged = flag_keyword(first_keyword_hit(spells, words)).drop("description_raw", "first_hit_skill")
    else:
        flagged = _flagged_spells(profiles, descriptions, words, with_current, names)
    measure = company_year_share(expand_years(flagged, as_of, open_end, window=window))
    if link is None:
        return measure
    return link_by_name(measure, link, first_year, end_year, null_keys_match)


def _flagged_spells(
    profiles: DataFrame,
    descriptions: DataFrame,
    words: Sequence[str] | GramIndex,
    with_current: bool = False,
    names: dict[str, str] = PROFILE_NAMES,
) -> DataFrame:
    """Spells with ``ai_related``, found without moving any text through the join.

    Keywords in the title or in the description are found where each is read, over the whole
    text. For keywords across the space between them, a title keeps the first part of a cut
    keyword if it ends with one, and a description the second part if it begins with one. A
    row enters the shuffle as an id, a flag and, rarely, such a part; flags of one id are
    combined before it. With a list too long for a pattern, a row keeps as much of the description's
    beginning as a keyword can cover.
    """
    bare = usable_profiles(profiles.withColumn(names["description"], F.lit(None).cast("string")), names)
    spells = parse_spells(bare, with_current, names=names).where(F.col("job_start_ym").isNotNull())
    kept = ["id", "company_name_raw", "job_start_ym", "job_end_ym", *(["is_current"] if with_current else [])]
    id_kind = descriptions.schema["id"].dataType.typeName()
    if isinstance(words, GramIndex):
        texts = search_descriptions(descriptions.where(F.col("description_raw").isNotNull()), words)
        texts = texts.select(id_text(F.col("id"), id_kind).alias("id"), "text_opening", "text_hit")
        texts = texts.groupBy("id", "text_opening").agg(F.max("text_hit").alias("text_hit"))
        joined = with_joint_hit(spells.select(*kept, "title_name").join(texts, "id"), F.col("title_name"), words)
        return joined.select(*kept, F.when(F.col("first_hit_skill").isNotNull(), 1).otherwise(0).alias("ai_related"))
    patterns, cut = keyword_patterns(words), cuts(words)

    def found(text: Column) -> Column:
        result = F.lit(False)
        for pattern in patterns:
            result = result | text.rlike(pattern)
        return result

    text = lower_text(F.col("description_raw"))
    texts = (
        descriptions.where(F.col("description_raw").isNotNull())
        .select(
            id_text(F.col("id"), id_kind).alias("id"),
            found(text).alias("in_text"),
            opening(text, (tail for _, tail in cut)).alias("opening"),
        )
        .groupBy("id", "opening")
        .agg(F.max("in_text").alias("in_text"))
    )
    title = lower_text(F.coalesce(F.col("title_name"), F.lit("")))
    spells = spells.select(
        *kept,
        found(title).alias("in_title"),
        ending(title, (head for head, _ in cut)).alias("ending"),
    )
    across = found(F.concat("ending", F.lit(" "), "opening"))
    related = F.col("in_text") | F.col("in_title") | F.coalesce(across, F.lit(False))
    return spells.join(texts, "id").select(*kept, F.when(related, 1).otherwise(0).alias("ai_related"))
