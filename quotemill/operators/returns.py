"""Daily return: change against the previous row of the same ticker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quotemill.schemas import DATE, TICKER_ID
from quotemill.session import settle

def percent_change(value: Column, previous: Column) -> Column:
    """Null without a previous value, and for a previous value of 0."""
    return F.try_divide(value - previous, previous) * 100


def daily_return(df: DataFrame, one_row_per_day: bool = False, partitions: int | None = None) -> DataFrame:
    """Append ``Daily_Return``, in percent, null on a ticker's first row.

    Rows follow each other by ``Date``; rows of one day by ``Close``, then by the other columns. Rows
    without a ticker form one series. One plan serves every size: the rows are laid out by range over
    this complete order and written once, so that a ticker, a month or a day with very many rows is spread
    over several ranges like any other run of rows. A window finds the previous close within a range; the first row
    of a ticker in a range takes its last close of the nearest earlier range that holds the ticker.

    ``one_row_per_day`` states that ``(ticker_id, Date)`` is unique and every row has a ticker: a ticker is then no
    longer than the calendar, and one window does.
    """
    if "Close" not in df.columns:
        return df
    if one_row_per_day:
        df = df.withColumn("_previous", F.lag("Close").over(Window.partitionBy(TICKER_ID).orderBy(*_row_order(df))))
    else:
        df = _previous_by_range(df, partitions)
    return df.withColumn("Daily_Return", percent_change(F.col("Close"), F.col("_previous"))).drop("_previous")


def _row_order(df: DataFrame) -> list[str]:
    rest = [f"`{name}`" for name in df.columns if name not in (DATE, "Close", TICKER_ID)]
    return [DATE, "Close", *rest]


def placed_by_range(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """``df`` written in ranges of the complete row order, with the number of the range in ``_range``."""
    number = [partitions] if partitions else []
    series = F.coalesce(F.col(TICKER_ID), F.lit(-1))
    ranged = df.withColumn("_series", series).repartitionByRange(*number, "_series", *_row_order(df))
    return settle(ranged.withColumn("_range", F.spark_partition_id()), "returns")


def _previous_by_range(df: DataFrame, partitions: int | None) -> DataFrame:
    columns = [f"`{name}`" for name in df.columns]
    placed = placed_by_range(df, partitions)
    # one row per range and ticker: its last close, and the last close of the ticker's range before
    ends = placed.groupBy("_series", "_range").agg(F.max(F.struct(DATE, "Close")).alias("_end"))
    before = Window.partitionBy("_series").orderBy("_range")
    carried = ends.select("_series", "_range", F.lag("_end.Close").over(before).alias("_carried"))
    rows = Window.partitionBy("_series", "_range").orderBy(*_row_order(df))
    return (
        placed.withColumns({"_at": F.row_number().over(rows), "_lagged": F.lag("Close").over(rows)})
        .join(carried, ["_series", "_range"], "left")
        .withColumn("_previous", F.when(F.col("_at") == 1, F.col("_carried")).otherwise(F.col("_lagged")))
        .select(*columns, "_previous")
    )
