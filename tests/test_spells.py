import datetime

import pytest
from conftest import rows

import workforce_signals as ws
from workforce_signals.operators.spells import SAMPLE_NAMES

PROFILE = (
    "id bigint, company string, company_name string, title_raw string, "
    "most_recent_company_start_month string, most_recent_company_end_month string"
)
SPELL = "id string, job_start_ym date, job_end_ym date, is_current int"


def profile(spark, *values):
    return spark.createDataFrame(list(values), PROFILE)


def spells(spark, *values):
    def day(month):
        return month and datetime.date.fromisoformat(month + "-01")

    return spark.createDataFrame([(i, day(s), day(e), c) for i, s, e, c in values], SPELL)


def expanded(spark, *values, **options):
    return rows(ws.expand_years(spells(spark, *values), **options), "id", "year")


def test_merge_keeps_complete_rows_and_fans_out(spark):
    profiles = profile(
        spark,
        (1, "1", "F", "t", "2000-01", None),
        (1, "1", "G", "t", "2001-01", None),
        (2, "1", None, "t", "2000-01", None),
        (3, "1", "F", "t", None, None),
        (4, "1", "F", "t", "2000-01", None),
        (5, "1", "F", "t", "2000-01", None),
        (None, "1", "F", "t", "2000-01", None),
    )
    texts = [(1, "a"), (1, "b"), (2, "a"), (3, "a"), (4, None), (None, "a")]
    merged = ws.merge_profiles(profiles, spark.createDataFrame(texts, "id bigint, description_raw string"))
    assert rows(merged, "id", "company_name", "description_raw") == [
        (1, "F", "a"),
        (1, "F", "b"),
        (1, "G", "a"),
        (1, "G", "b"),
    ]
    assert merged.columns == [*profiles.columns, "description_raw"]


def test_parse_spells(spark):
    months = ["2022-08", "2022-8", "", "   ", "n/a", "2022-13", "2022-08-15"]
    values = [(i, "1", "F", "t", m, m) for i, m in enumerate(months)]
    merged = profile(spark, *values).selectExpr("*", "'d' AS description_raw")
    parsed = ws.parse_spells(merged)
    day = datetime.date(2022, 8, 1)
    assert rows(parsed, "id", "job_start_ym", "job_end_ym") == [
        ("0", day, day),
        ("1", day, day),
        *((str(i), None, None) for i in range(2, 7)),
    ]
    assert parsed.columns == [
        "id",
        "title_name",
        "company_name_raw",
        "description_raw",
        "job_start_ym",
        "job_end_ym",
    ]


def test_parse_spells_of_the_older_layout(spark):
    columns = ", ".join(f"{c} string" for c in SAMPLE_NAMES.values())
    sample = spark.createDataFrame([("7", "t", "F", "d", "2000-01", None, "1")], columns)
    parsed = ws.parse_spells(sample, with_current=True, names=SAMPLE_NAMES)
    assert rows(parsed) == [("7", "t", "F", "d", datetime.date(2000, 1, 1), None, 1)]


def test_expand_worked_example(spark):
    assert expanded(spark, ("1", "2022-08", "2024-05", 0)) == [("1", 2022), ("1", 2023), ("1", 2024)]


def test_open_end_current(spark):
    found = expanded(spark, ("1", "2001-05", None, 0), ("2", None, "2001-05", 0), as_of=2003)
    assert found == [("1", 2001), ("1", 2002), ("1", 2003)]


def test_open_end_flag(spark):
    values = [("1", "2002-05", None, 0), ("2", "2002-05", None, 1), ("3", "2002-05", "2002-06", 0)]
    found = expanded(spark, *values, as_of=2003, open_end="flag")
    assert found == [("2", 2002), ("2", 2003), ("3", 2002)]
    with pytest.raises(ValueError):
        expanded(spark, *values, open_end="both")


def test_end_before_start_and_start_after_as_of(spark):
    found = expanded(spark, ("1", "2002-05", "2000-01", 0), ("2", "2010-05", None, 0), as_of=2003)
    assert found == [("1", 2002), ("2", 2010)]


def test_as_of_defaults_to_this_year(spark):
    this_year = datetime.datetime.now(datetime.timezone.utc).year
    assert expanded(spark, ("1", f"{this_year}-01", None, 0)) == [("1", this_year)]


def test_window_equals_a_filter_afterwards(spark):
    values = [("1", "1999-05", "2004-01", 0), ("2", "2006-05", None, 0), ("3", "1990-01", "1991-01", 0)]
    everything = expanded(spark, *values, as_of=2003)
    assert expanded(spark, *values, as_of=2003, window=(2000, 2003)) == [
        r for r in everything if 2000 <= r[1] < 2003
    ]


def test_number_of_year_rows(spark):
    values = [(str(i), f"{1990 + i % 7}-03", f"{1992 + i % 5}-01", 0) for i in range(40)]
    expected = sum(max(1992 + i % 5, 1990 + i % 7) - (1990 + i % 7) + 1 for i in range(40))
    assert len(expanded(spark, *values)) == expected
