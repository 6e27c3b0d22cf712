"""Column helpers for text, months and numbers.

Each helper pins down a rule on which SQL engines differ, so that results do not depend
on Spark's own defaults. All of them stay JVM-side.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

# The core technology terms a posting is matched against. A term matches a
# whole normalised skill, never a part of one.
CORE_TERMS = (
    "ai",
    "artificial intelligence",
    "ml",
    "machine learning",
    "nlp",
    "natural language processing",
    "cv",
    "computer vision",
)

# The Unicode space separators (category Zs). Tabs and newlines are not in it.
ZS_CHARS = (
    "\u0020\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u202f\u205f\u3000"
)

_NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def regex_quote(text: str) -> str:
    """Escape ``text`` for use as a literal inside a Java regular expression."""
    special = (ch.isascii() and not ch.isalnum() and not ch.isspace() for ch in text)
    return "".join("\\" + ch if quote else ch for ch, quote in zip(text, special, strict=True))


def trim_spaces(col: Column) -> Column:
    """Strip every Unicode space separator from both ends.

    Spark's plain trim takes U+0020 only. It is also the faster one, and it is enough for
    texts without multi-byte characters.
    """
    return F.when(F.length(col) == F.octet_length(col), F.trim(col)).otherwise(F.trim(col, F.lit(ZS_CHARS)))


def lower_text(col: Column) -> Column:
    """Lower-case letter by letter, whatever the neighbouring letters are.

    The JVM maps a capital sigma by its position in the word and a dotted capital I to two
    characters. Both are rare, so the rewrite is paid only by texts that hold one.
    """
    special = col.contains("Σ") | col.contains("İ")
    return F.when(special, F.lower(F.translate(col, "Σİ", "σi"))).otherwise(F.lower(col))


def norm_token(col: Column) -> Column:
    """Normalised form of a skill, keyword or firm name."""
    return lower_text(trim_spaces(col))


def skill_tokens(col: Column, sep: str = "|") -> Column:
    """Normalised skills of a delimited list, in list order, repeats kept.

    The separator is taken as it is written, so a list is split before it is lower-cased if the
    separator has letters. Empty pieces are dropped before trimming, so a piece of blanks stays
    as ``''``. Lists without blanks around their pieces are not trimmed piece by piece.
    """
    if sep.lower() == sep.upper():
        pieces = F.split(lower_text(col), regex_quote(sep))
    else:
        pieces = F.transform(F.split(col, regex_quote(sep)), lower_text)
    pieces = F.array_remove(pieces, "")
    padded = col.startswith(" ") | col.endswith(" ") | col.contains(" " + sep) | col.contains(sep + " ")
    multi_byte = F.length(col) != F.octet_length(col)
    return F.when(padded | multi_byte, F.transform(pieces, trim_spaces)).otherwise(pieces)


def holds_any(tokens: Column, terms: Iterable[str]) -> Column:
    """True where an array of normalised skills holds one of ``terms``."""
    terms = [F.lit(t) for t in terms]
    return F.arrays_overlap(tokens, F.array(*terms)) if terms else F.lit(False)


def blank_to_null(col: Column) -> Column:
    return F.nullif(trim_spaces(col), F.lit(""))


def month_start(col: Column) -> Column:
    """First day of a ``YYYY-MM`` month; NULL when the text is not one. Never raises."""
    month = r"\A[\t\n\x0B\f\r ]*[0-9]{1,4}-(?:0?[1-9]|1[0-2])\z"
    year, number = F.substring_index(col, "-", 1), F.substring_index(col, "-", -1)
    return F.when(col.rlike(month), F.make_date(year.try_cast("int"), number.try_cast("int"), F.lit(1)))


def flag_or_zero(col: Column) -> Column:
    """Text to INT, fractions rounded half away from zero; anything unreadable is 0."""
    number = F.when(col.rlike(rf"\A\s*{_NUMBER}\s*\z"), col.try_cast("double"))
    return F.coalesce(F.round(number).try_cast("int"), F.lit(0))


def number_or_null(col: Column) -> Column:
    """Text to DOUBLE; unreadable text, NaN and overflow become NULL."""
    number = col.try_cast("double")
    signed_infinity = col.rlike(r"(?i)\A\s*[+-]?inf(inity)?\s*\z")
    finite = col.rlike(rf"\A\s*{_NUMBER}\s*\z") & (F.abs(number) < F.lit(float("inf")))
    return F.when(signed_infinity | finite, number)


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def double_text(col: Column) -> Column:
    """A DOUBLE as text in one form for all sizes: digits with a point, never in scientific notation.

    Whole numbers end in ``.0`` (``'12000000.0'``). Only numbers beyond 37 digits, or with digits
    beyond the 18th after the point, keep the notation of the JVM.
    """
    text = col.cast("string")
    whole, exact = text.try_cast("decimal(38,1)"), text.try_cast("decimal(38,18)")
    plain = F.when(col == F.floor(col), whole.cast("string")).when(
        exact.cast("double") == col, F.regexp_replace(exact.cast("string"), "0+$", "")
    )
    finite = F.abs(col) < F.lit(float("inf"))
    return F.when(finite, F.coalesce(plain, text)).otherwise(text)


def whole_number(col: Column, target: DataType) -> Column:
    """A number as an integer type; a fraction raises, as it would be cut. NaN is NULL."""
    cut = F.raise_error(F.concat(F.lit("not a whole number: "), col.cast("string")))
    return F.when(col == F.floor(col), col.cast(target)).when(col.isNotNull(), cut.cast(target))


def id_text(col: Column, type_name: str) -> Column:
    """An identifier as text. Whole ids that arrive as DOUBLE print without a point, others as they are."""
    if type_name in ("double", "float"):
        return F.regexp_replace(double_text(nan_to_null(col.cast("double"))), r"\.0$", "")
    return col.cast("string")
