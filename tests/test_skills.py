import pytest
from conftest import rows

import workforce_signals as ws

POSTING = "id bigint, year int, company string, company_name string, skills_name string"


def postings(spark, *values):
    return spark.createDataFrame([(i, y, "1", "F", s) for i, y, s in values], POSTING)


def counts(spark, *values, **options):
    found = ws.skill_year_counts(postings(spark, *values), **options)
    return rows(found, "year", "skill", "cnt", "co_jobs_with_ai")


def test_explode_worked_example(spark):
    found = ws.explode_skills(postings(spark, (12345, 2010, "Python|Stata|C++")))
    assert rows(found, "job_id", "skill") == [("12345", "c++"), ("12345", "python"), ("12345", "stata")]
    assert found.columns == ["year", "job_id", "company", "company_name", "skill"]


def test_explode_edge_rows(spark):
    found = ws.explode_skills(
        postings(spark, (1, 2010, None), (2, 2010, ""), (3, 2010, "A||a |"), (4, 2010, "A|  "), (5, 2010, "||"))
    )
    assert rows(found, "job_id", "skill") == [("3", "a"), ("3", "a"), ("4", ""), ("4", "a")]


def test_explode_without_year(spark):
    found = ws.explode_skills(postings(spark, (1, 2010, "a")).drop("year"), keep=())
    assert rows(found) == [("1", "a")]


def test_ids_stored_as_double_print_as_whole_numbers(spark):
    df = spark.createDataFrame([(1005022350469.0, "a")], "id double, skills_name string")
    assert rows(ws.explode_skills(df, keep=())) == [("1005022350469", "a")]


def test_core_jobs(spark):
    found = ws.core_jobs(postings(spark, (1, 2010, "x|AI"), (1, 2010, "nlp"), (2, 2010, "x"), (None, 2011, "cv")))
    assert rows(found) == [(2010, "1"), (2011, None)]


def test_repeated_token_counts_again(spark):
    assert counts(spark, (1, 2010, "a|A")) == [(2010, "a", 2, 0)]


def test_null_id_never_co_occurs(spark):
    assert counts(spark, (None, 2010, "ai"), (None, 2010, "ai")) == [(2010, "ai", 2, 0)]


@pytest.mark.parametrize("unique_ids", [False, True])
def test_counts_of_unique_ids(spark, unique_ids):
    found = counts(spark, (1, 2010, "ai|x"), (2, 2010, "x"), (2, 2011, "x"), unique_ids=unique_ids)
    assert found == [(2010, "ai", 1, 1), (2010, "x", 2, 1), (2011, "x", 1, 0)]


def test_core_term_counts_for_all_rows_of_an_id_within_the_year(spark):
    found = counts(spark, (1, 2010, "ai"), (1, 2010, "x"), (1, 2011, "x"), (2, 2010, "x"), (3, 2010, "ml|x"))
    assert found == [(2010, "ai", 1, 1), (2010, "ml", 1, 1), (2010, "x", 3, 2), (2011, "x", 1, 0)]


def test_drop_core(spark):
    assert counts(spark, (1, 2010, "ai|x"), drop_core=True) == [(2010, "x", 1, 1)]


def test_own_terms(spark):
    assert counts(spark, (1, 2010, "sql|x"), terms=["sql"]) == [(2010, "sql", 1, 1), (2010, "x", 1, 1)]


def test_large_sets_of_repeated_ids_are_not_broadcast(spark, monkeypatch):
    from workforce_signals.plans import stored

    values = [(1, 2010, "ai"), (1, 2010, "x"), (2, 2010, "x"), (2, 2010, "x|y"), (None, 2010, "ai")]
    expected = counts(spark, *values)
    monkeypatch.setattr(stored, "BROADCAST_BYTES", 0)
    assert not ws.repeated_ids(postings(spark, *values)).is_small
    assert counts(spark, *values) == expected


def test_repeated_ids(spark):
    found = ws.repeated_ids(postings(spark, (1, 2010, "a"), (1, 2011, "a"), (2, 2010, None), (2, 2010, "")))
    assert rows(found.df) == [(2010, "2")]
    assert found.rows == 1 and found.is_small


def years(spark, *values):
    return spark.createDataFrame(list(values), "year int, skill string, cnt bigint, co_jobs_with_ai bigint")


def test_minimum_support(spark):
    table = years(spark, (2010, "a", 49, 1), (2010, "b", 25, 5), (2011, " B ", 25, 5))
    assert rows(ws.skill_scores(table)) == [("b", 50, 10, 0.2)]
    assert [r[0] for r in rows(ws.skill_scores(table, min_jobs=0))] == ["a", "b"]


def test_scores_of_some_years(spark):
    table = years(spark, (2010, "a", 4, 1), (2011, "a", 4, 3), (2012, "a", 0, 0))
    assert rows(ws.skill_scores(table, 0, (2010, 2010))) == [("a", 4, 1, 0.25)]
    assert rows(ws.skill_scores(table, 0, (2012, 2012))) == [("a", 0, 0, 0.0)]


def test_top_skills_order(spark):
    table = spark.createDataFrame(
        [("c", 5, 5, 1.0), ("a", 5, 5, 1.0), ("b", 9, 9, 1.0), ("d", 9, 1, 0.1)],
        "skill string, total_cnt bigint, total_co bigint, ai_score double",
    )
    assert [r["skill"] for r in ws.top_skills(table, 3).collect()] == ["b", "a", "c"]


def test_terms_table(spark):
    assert len(rows(ws.terms_df(spark))) == 8
