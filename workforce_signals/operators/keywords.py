"""Keyword search in titles and descriptions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workforce_signals.functions.patterns import PATTERN_KEYWORDS, first_match, keyword_patterns, longest_pattern
from workforce_signals.functions.text import lower_text, norm_token, trim_spaces
from workforce_signals.operators.gram_search import GramIndex, gram_index, with_first_hit
from workforce_signals.plans.stored import store

# Bytes, uncompressed, of a list that becomes a pattern.
PATTERN_BYTES = 1 << 20


def keyword_list(top_skills: DataFrame) -> DataFrame:
    """Distinct normalised keywords; NULL and blank ones are left out."""
    skill = F.col("skill")
    kept = top_skills.where(skill.isNotNull() & (trim_spaces(skill) != ""))
    return kept.select(norm_token(skill).alias("skill")).distinct()


def literal_keywords(keywords: DataFrame | Iterable[str | None] | GramIndex) -> list[str] | GramIndex:
    """The keywords in a form that texts can be searched for, normalised alike whether they come as a table or as a list.

    Up to ``PATTERN_KEYWORDS`` keywords of a bounded total size are read as plain values and make one pattern. More stay a table
    and are indexed by letter grams; no list passes through the driver then, other than one that began there.
    """
    if isinstance(keywords, GramIndex):
        return keywords
    if not isinstance(keywords, DataFrame):
        rows = [(k,) for k in keywords]
        if not rows:
            return []
        keywords = SparkSession.active().createDataFrame(rows, "skill string")
    kept = keyword_list(keywords)
    some = [r["skill"] for r in kept.limit(PATTERN_KEYWORDS + 1).collect()]
    if len(some) > PATTERN_KEYWORDS or sum(len(w.encode()) for w in some) > PATTERN_BYTES:
        return gram_index(store(kept, "keywords"))
    return sorted(some)


def search_text(title: Column, description: Column) -> Column:
    """What is searched: both parts in lower case, a space between, NULL parts empty."""
    empty = F.lit("")
    return F.concat(
        lower_text(F.coalesce(title, empty)), F.lit(" "), lower_text(F.coalesce(description, empty))
    )


def first_keyword_hit(
    df: DataFrame,
    keywords: DataFrame | Iterable[str],
    title: str = "title_name",
    description: str = "description_raw",
) -> DataFrame:
    """Add ``first_hit_skill``: the keyword that starts earliest in title and description.

    Keywords match anywhere, also inside words. Of keywords starting at the same place
    the shortest is reported. With a list that fits a pattern the text is read in place: no join,
    no shuffle. With a longer one it meets the list by a join, see ``gram_search``.
    """
    text, words = search_text(F.col(title), F.col(description)), literal_keywords(keywords)
    if isinstance(words, GramIndex):
        return with_first_hit(df, text, words, "first_hit_skill")
    return df.withColumn("first_hit_skill", first_match(text, keyword_patterns(words)))


def opening(text: Column, pieces: Iterable[str]) -> Column:
    """The longest of ``pieces`` that ``text`` begins with, else NULL."""
    pieces = set(pieces)
    if not pieces:
        return F.lit(None).cast("string")
    return F.nullif(F.regexp_extract(text, longest_pattern(pieces), 0), F.lit(""))


def ending(text: Column, pieces: Iterable[str]) -> Column:
    """The longest of ``pieces`` that ``text`` ends with, else NULL."""
    return F.reverse(opening(F.reverse(text), (p[::-1] for p in pieces)))


def cuts(words: Iterable[str]) -> list[tuple[str, str]]:
    """What stands before and after each space of each keyword.

    Title and description are searched with a space between them. A keyword lies in the
    title, in the description, or across that space; in the last case it is cut there: the
    title ends with the first part and the description begins with the second.
    """
    return [(w[:i], w[i + 1 :]) for w in words for i, ch in enumerate(w) if ch == " "]


def search_descriptions(descriptions: DataFrame, words: Iterable[str] | GramIndex) -> DataFrame:
    """Add what a later join with titles needs to know of each text, reading it once.

    ``text_hit`` is the text's first keyword; ``text_opening`` is the longest end of a cut
    keyword it begins with, or with a long list as much of it as a keyword can cover.
    """
    text = lower_text(F.col("description_raw"))
    if isinstance(words, GramIndex):
        found = with_first_hit(descriptions, text, words, "text_hit")
        return found.withColumn("text_opening", F.substring(text, 1, words.longest))
    words = list(words)
    return descriptions.select(
        "*",
        first_match(text, keyword_patterns(words)).alias("text_hit"),
        opening(text, (tail for _, tail in cuts(words))).alias("text_opening"),
    )


def with_joint_hit(df: DataFrame, title: Column, words: Iterable[str] | GramIndex, name: str = "first_hit_skill") -> DataFrame:
    """Add the first keyword of title and searched description: one that starts in the title, else the text's."""
    title = lower_text(F.coalesce(title, F.lit("")))
    start = F.concat(title, F.lit(" "), F.coalesce("text_opening", F.lit("")))
    if isinstance(words, GramIndex):
        found = with_first_hit(df, start, words, "_hit", "_start")
        hit = F.when(F.col("_start") <= F.octet_length(title), F.col("_hit")).otherwise(F.col("text_hit"))
        return found.withColumn(name, hit).drop("_hit", "_start")
    hit = first_match(start, keyword_patterns(words))
    return df.withColumn(name, F.when(F.instr(start, hit) <= F.length(title), hit).otherwise(F.col("text_hit")))


def flag_keyword(df: DataFrame) -> DataFrame:
    """Add ``ai_related``: 1 where a keyword was found, else 0."""
    return df.withColumn("ai_related", F.when(F.col("first_hit_skill").isNotNull(), 1).otherwise(0))
