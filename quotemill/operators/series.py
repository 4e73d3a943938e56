"""Training series, their ranges and their date axes.

A series holds one row per ticker and day, so no ticker is longer than the calendar.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quotemill.functions.scalars import finite
from quotemill.schemas import DATE, TICKER_ID


def stack(*tables: DataFrame) -> DataFrame:
    """All rows of all tables, columns matched by name, null where a table lacks one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def most_common_ticker(df: DataFrame) -> DataFrame:
    """One row: the id with the most rows, the smallest on a tie; rows without an id do not count."""
    sizes = df.where(F.col(TICKER_ID).isNotNull()).groupBy(TICKER_ID).agg(F.count("*").alias("n"))
    return sizes.orderBy(F.col("n").desc(), F.col(TICKER_ID)).limit(1)


def keep_most_common(df: DataFrame) -> DataFrame:
    """Rows of the most common ticker. The broadcast side is one row."""
    return df.join(F.broadcast(most_common_ticker(df).select(TICKER_ID)), TICKER_ID, "left_semi")


def training_series(cleaned: DataFrame) -> DataFrame:
    """``(ticker_id, ds, y)`` with one row per day: of several closes the smallest. A close must be finite."""
    usable = F.col(TICKER_ID).isNotNull() & F.col(DATE).isNotNull() & finite(F.col("Close")).isNotNull()
    return (
        cleaned.where(usable)
        .groupBy(TICKER_ID, F.col(DATE).alias("ds"))
        .agg(F.min("Close").alias("y"))
    )


def series_range(series: DataFrame) -> DataFrame:
    return series.groupBy(TICKER_ID).agg(
        F.count("*").alias("n"), F.min("ds").alias("first_day"), F.max("ds").alias("last_day")
    )


def days_between(first: Column, last: Column) -> Column:
    """One row per day of a closed range, weekends included."""
    return F.explode(F.sequence(first, last, F.expr("interval 1 day")))


def explode_days(ranges: DataFrame, first: str, last: str) -> DataFrame:
    """``ranges`` with one row per day ``ds`` of each closed range; year by year, so that no array is longer than that."""
    years = F.sequence(F.trunc(first, "year"), F.trunc(last, "year"), F.expr("interval 1 year"))
    begin = F.greatest(F.col(first), F.col("_year"))
    end = F.least(F.col(last), F.make_date(F.year("_year"), F.lit(12), F.lit(31)))
    return ranges.withColumn("_year", F.explode(years)).withColumn("ds", days_between(begin, end)).drop("_year")


def future_spine(series: DataFrame, periods: int = 365) -> DataFrame:
    """The next ``periods`` calendar days after each ticker's last day."""
    last = series.groupBy(TICKER_ID).agg(F.max("ds").alias("last_day"))
    return last.select(
        TICKER_ID, days_between(F.date_add("last_day", 1), F.date_add("last_day", periods)).alias("ds")
    )


def forecast_axis(series: DataFrame, periods: int = 365) -> DataFrame:
    """All observed days and the future ones."""
    return series.select(TICKER_ID, "ds").unionByName(future_spine(series, periods))
