"""Employment spells: merge with descriptions, parse months, expand into years."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workforce_signals.functions.text import blank_to_null, flag_or_zero, id_text, month_start, trim_spaces

PROFILE_NAMES = {
    "id": "id",
    "title": "title_raw",
    "company": "company_name",
    "description": "description_raw",
    "start": "most_recent_company_start_month",
    "end": "most_recent_company_end_month",
    "current": "is_current",
}

SAMPLE_NAMES = {
    "id": "ID",
    "title": "TITLE_NAME",
    "company": "COMPANY_NAME_RAW",
    "description": "DESCRIPTION_RAW",
    "start": "JOB_START_YM",
    "end": "JOB_END_YM",
    "current": "IS_CURRENT",
}


def usable_profiles(profiles: DataFrame, names: dict[str, str] = PROFILE_NAMES) -> DataFrame:
    return profiles.where(F.col(names["start"]).isNotNull() & F.col(names["company"]).isNotNull())


def merge_profiles(
    profiles: DataFrame, descriptions: DataFrame, *, keep: Sequence[str] = ()
) -> DataFrame:
    """Profiles with their description, keeping rows that have a start month, a firm and a text.

    Ids that repeat on either side give every combination. Columns of the descriptions in
    ``keep`` are carried along.
    """
    merged = profiles.join(descriptions.select("id", "description_raw", *keep), "id", "left")
    return usable_profiles(merged).where(F.col("description_raw").isNotNull()).select(
        "id",
        "company",
        "company_name",
        "title_raw",
        "most_recent_company_start_month",
        "most_recent_company_end_month",
        "description_raw",
        *keep,
    )


def parse_spells(
    df: DataFrame,
    with_current: bool = False,
    *,
    names: dict[str, str] = PROFILE_NAMES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Ids to text and months to dates; months that cannot be read become NULL.

    ``names`` maps the roles of columns to their names in ``df``; ``with_current`` adds the
    0/1 flag of a job that is still held; columns in ``keep`` are carried along.
    """
    columns = {
        "id": id_text(F.col(names["id"]), df.schema[names["id"]].dataType.typeName()),
        "title_name": F.col(names["title"]),
        "company_name_raw": F.col(names["company"]),
        "description_raw": F.col(names["description"]),
        "job_start_ym": trim_spaces(F.col(names["start"])),
        "job_end_ym": trim_spaces(F.col(names["end"])),
    }
    parsed = {name: F.col(name) for name in columns}
    parsed |= {name: month_start(F.col(name)) for name in ("job_start_ym", "job_end_ym")}
    if with_current:
        columns["is_current"] = blank_to_null(F.col(names["current"]))
        parsed["is_current"] = flag_or_zero(F.col("is_current"))
    # Two steps, so that a text that is used several times is trimmed once.
    trimmed = df.select(*(c.alias(name) for name, c in columns.items()), *keep)
    return trimmed.select(*(c.alias(name) for name, c in parsed.items()), *keep)


def expand_years(
    spells: DataFrame,
    as_of: int | Column | None = None,
    open_end: str = "current",
    *,
    window: tuple[int, int] | None = None,
) -> DataFrame:
    """One row per spell and calendar year, both ends included.

    A spell without a readable end runs to the ``as_of`` year (default: this year); under
    ``open_end="flag"`` only where ``is_current`` is 1, and it is dropped otherwise. An end
    before the start counts as the start. ``window=(first, end)`` keeps first <= year < end
    and never creates the other years. Further columns are carried along.
    """
    if open_end not in ("current", "flag"):
        raise ValueError(f"open_end must be 'current' or 'flag', not {open_end!r}")
    if as_of is None:
        as_of = F.year(F.current_date())
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    if open_end == "flag":
        now = F.when(F.col("is_current") == 1, now)
    start = F.year("job_start_ym")
    end = F.coalesce(F.year("job_end_ym"), now)
    spells = spells.where(start.isNotNull() & end.isNotNull())
    first, last = start, F.greatest(end, start)
    if window is not None:
        first, last = F.greatest(first, F.lit(window[0])), F.least(last, F.lit(window[1] - 1))
        spells = spells.where(first <= last)
    dropped = ("job_start_ym", "job_end_ym", "is_current")
    carried = [c for c in spells.columns if c not in dropped]
    return spells.select(*carried, F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("year"))
