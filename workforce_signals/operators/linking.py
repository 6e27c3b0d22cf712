"""Link firm measures to an external identifier table (``ID``, ``NAME``, ``GVKEY``).

Both are plain inner joins: Spark broadcasts the link table when its files are below the
broadcast threshold and splits skewed keys otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workforce_signals.functions.text import nan_to_null, number_or_null


def _matches(left: Column, right: Column, null_keys_match: bool) -> Column:
    return left.eqNullSafe(right) if null_keys_match else left == right


def _suffixed(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Columns that both sides have, in any case, end in ``_x`` on the left and ``_y`` on the right."""
    both = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}

    def renamed(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(*(F.col(f"`{c}`").alias(c + suffix if c.lower() in both else c) for c in df.columns))

    return renamed(left, "_x"), renamed(right, "_y")


def _linked(left: DataFrame, right: DataFrame, on: tuple[str, str], null_keys_match: bool) -> DataFrame:
    """Inner join on two columns, which keep telling names where both sides have them."""
    left = left.withColumn("_left", F.col(on[0]))
    right = right.withColumn("_right", F.col(on[1]))
    left, right = _suffixed(left, right)
    return left.join(right, _matches(F.col("_left"), F.col("_right"), null_keys_match), "inner").drop("_left", "_right")


def _as_double(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.typeName()
    if kind == "string":
        return number_or_null(F.col(name))
    return nan_to_null(F.col(name).cast("double"))


def link_by_id(share: DataFrame, link: DataFrame, null_keys_match: bool = False) -> DataFrame:
    """Join on the firm id read as a number (added as ``company_num``).

    Ids that are no numbers link to nothing, or with ``null_keys_match`` to link rows without id.
    Columns that both tables have are told apart by the endings ``_x`` and ``_y``.
    """
    share = share.withColumn("company_num", _as_double(share, "company"))
    link = link.withColumn("ID", _as_double(link, "ID"))
    return _linked(share, link, ("company_num", "ID"), null_keys_match)


def link_by_name(
    measure: DataFrame,
    link: DataFrame,
    first_year: int = 2010,
    end_year: int = 2025,
    null_keys_match: bool = False,
) -> DataFrame:
    """Join on the exact firm name, for ``first_year <= year < end_year``.

    Columns that both tables have are told apart by the endings ``_x`` and ``_y``.
    """
    year = F.col("year")
    measure = measure.where((year >= first_year) & (year < end_year))
    return _linked(measure, link, ("company_name", "NAME"), null_keys_match)
