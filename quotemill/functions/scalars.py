"""Column functions for dirty numbers and dates. None of them can raise on bad input."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Fixed value: everything the original number scrub deletes.
NOT_DIGIT_OR_POINT = "[^0-9.]"

POSITIVE_NUMBER = r"^(\d+\.?\d*|\.\d+)$"
NEGATIVE_NUMBER = r"^((\d+\.?\d*|\.\d+)-|\((\d+\.?\d*|\.\d+)\))$"
RATIO = r"^(\d+\.?\d*|\.\d+):(\d+\.?\d*|\.\d+)$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def finite(value: Column) -> Column:
    """Null for NaN and for both infinities. ``value`` should be a plain column."""
    return F.when((value < float("inf")) & (value > float("-inf")), value)


def scrub_number_compat(text: Column) -> Column:
    """Keep digits and points of the printed value: signs and exponents are lost."""
    digits = F.regexp_replace(text, NOT_DIGIT_OR_POINT, "")
    return F.when(digits.rlike(POSITIVE_NUMBER), digits.try_cast("double"))


def strip_number(text: Column) -> Column:
    """Text without currency signs, thousands commas and blanks, nor a currency code before or behind it."""
    bare = F.regexp_replace(text, r"[$€£¥,\s]", "")
    return F.regexp_replace(bare, "^([+-]?)[A-Z]{3}|[A-Z]{3}$", "$1")


def number_in(stripped: Column) -> Column:
    """Number in a stripped text, perhaps infinite; null for what is none.

    A minus may stand behind the number, accounting parentheses mean a negative one, and ``a:b`` is a ratio.
    """
    plain = stripped.try_cast("double")
    inner = F.regexp_extract(stripped, r"^\(?([0-9.]+)[)-]$", 1)
    ratio = F.try_divide(
        F.split_part(stripped, F.lit(":"), F.lit(1)).try_cast("double"),
        F.split_part(stripped, F.lit(":"), F.lit(2)).try_cast("double"),
    )
    return (
        F.when(stripped.rlike(NUMBER), plain)
        .when(stripped.rlike(NEGATIVE_NUMBER), -inner.try_cast("double"))
        .when(stripped.rlike(RATIO), ratio)
    )


def parse_date(value: Column, dtype: T.DataType) -> Column:
    """Date of a text, date or timestamp; null where there is none."""
    return value.try_cast("date") if isinstance(dtype, T.StringType) else value.cast("date")


def date_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def run_id(moment: Column) -> Column:
    """Version id of a run, sortable as text."""
    return F.date_format(moment, "yyyyMMdd_HHmmss")
