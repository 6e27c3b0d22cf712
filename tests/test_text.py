import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from workforce_signals.functions import text as t


def apply(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


def test_norm_token_strips_space_separators_only(spark):
    values = [" AI　", "\tAI", "  Deep  Learning ", "   ", None]
    assert apply(spark, t.norm_token, values) == ["ai", "\tai", "deep  learning", "", None]


def test_lower_text_is_letter_by_letter(spark):
    assert apply(spark, t.lower_text, ["ΑΣ", "İX", "ÀÉ", "ßẞ", "plain"]) == ["ασ", "ix", "àé", "ßß", "plain"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("A||a |", ["a", "a"]),
        ("A|  ", ["a", ""]),
        ("||", []),
        ("Python|Stata|C++", ["python", "stata", "c++"]),
    ],
)
def test_skill_tokens(spark, text, expected):
    assert apply(spark, t.skill_tokens, [text]) == [expected]


def test_skill_tokens_take_the_separator_literally(spark):
    assert apply(spark, lambda c: t.skill_tokens(c, "."), ["a.b|c"]) == [["a", "b|c"]]


def holds(terms):
    return lambda c: t.holds_any(t.skill_tokens(c), terms)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("AI", True),
        ("x| Machine Learning\u3000|y", True),
        ("x|\u00a0nlp", True),
        ("maintain", False),
        ("ai engineer", False),
        ("x|ai\n", False),
        ("x||ml", True),
        ("", False),
        (None, None),
    ],
)
def test_holds_any_matches_whole_skills(spark, text, expected):
    assert apply(spark, holds(t.CORE_TERMS), [text]) == [expected]


def test_holds_any_odd_terms(spark):
    assert apply(spark, holds([]), ["a"]) == [False]
    assert apply(spark, holds(["c++", "a.b"]), ["c++", "x|A.B", "axb", "c"]) == [True, True, False, False]
    assert apply(spark, holds([""]), ["a||b", "a| |b"]) == [False, True]
    assert apply(spark, holds([" a", "a|b", "A"]), [" a|b", "a"]) == [False, False]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2022-08", (2022, 8)),
        ("2022-8", (2022, 8)),
        ("22-08", (22, 8)),
        ("\t2022-08", (2022, 8)),
        ("2022-13", None),
        ("2022-00", None),
        ("2022-08-15", None),
        ("02022-08", None),
        ("2022-008", None),
        ("+2022-08", None),
        ("-2022-08", None),
        ("n/a", None),
        ("2022-1\n", None),
        (None, None),
    ],
)
def test_month_start(spark, text, expected):
    found = apply(spark, t.month_start, [text])[0]
    assert found == (expected and datetime.date(*expected, 1))


def test_flag_or_zero(spark):
    values = ["1", "1.0", "0.5", "0.4", " 1 ", "1e0", "1d", "true", "", "9999999999", None, "-1"]
    assert apply(spark, t.flag_or_zero, values) == [1, 1, 1, 0, 1, 1, 0, 0, 0, 0, 0, -1]


def test_number_or_null(spark):
    values = ["12.0", " 12 ", "1e3", "12d", "12f", "0x10", "1_000", "nan", "", "1e400", "abc", ".5", None]
    expected = [12.0, 12.0, 1000.0, None, None, None, None, None, None, None, None, 0.5, None]
    assert apply(spark, t.number_or_null, values) == expected
    assert apply(spark, t.number_or_null, ["inf", "-Infinity"]) == [float("inf"), float("-inf")]


def test_double_text_and_id_text(spark):
    assert apply(spark, t.double_text, [12.0, 12000000.0, 0.5, None], "double") == ["12.0", "12000000.0", "0.5", None]
    assert apply(spark, lambda c: t.id_text(c, "double"), [1005022350469.0, None], "double") == ["1005022350469", None]


def test_blank_to_null(spark):
    assert apply(spark, t.blank_to_null, ["", "  ", " ", " x "]) == [None, None, None, "x"]


def test_rows_helper_orders_nulls(spark):
    assert rows(spark.createDataFrame([(2,), (None,)], "x int")) == [(None,), (2,)]


def test_one_text_form_of_doubles(spark):
    values = (1e15, 1.23456785e7, 1.5, -0.25, 12000000.0, 1e-4, float("inf"), None)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    found = [r["t"] for r in df.select("i", t.double_text(F.col("v")).alias("t")).orderBy("i").collect()]
    assert found == ["1000000000000000.0", "12345678.5", "1.5", "-0.25", "12000000.0", "0.0001", "Infinity", None]


def test_a_separator_with_capitals_splits(spark):
    df = spark.createDataFrame([("Python AND SQL and R",)], "s string")
    assert df.select(t.skill_tokens(F.col("s"), " AND ").alias("t")).first()["t"] == ["python", "sql and r"]
