"""Price tables and request tables derived from the given test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _priced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as trades: the brand is the ticker, the ship day the date."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("Ticker"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).withColumns(
        {
            "Date": F.col("l_shipdate").cast("date"),
            "price": F.col("l_extendedprice") / F.col("l_quantity"),
        }
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line as a price row of its own: many rows per ticker and day."""
    return _priced_lines(spark, sf_dir).select(
        "Ticker",
        "Date",
        F.col("price").alias("Close"),
        F.col("l_quantity").alias("Volume"),
        "l_orderkey",
        "l_linenumber",
    )


def price_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per ticker and day."""
    # (l_orderkey, l_linenumber) is not unique
    place = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    lines = _priced_lines(spark, sf_dir).withColumn("place", place)

    def price(line: Column) -> Column:
        return line["l_extendedprice"] / line["l_quantity"]

    return lines.groupBy("Ticker", "Date").agg(
        price(F.min("place")).alias("Open"),
        F.max("price").alias("High"),
        F.min("price").alias("Low"),
        price(F.max("place")).alias("Close"),
        F.sum("l_quantity").alias("Volume"),
        F.lit(0.0).alias("Dividends"),
        F.lit(0.0).alias("Stock Splits"),
    )


def _money(value: Column) -> Column:
    """Price cut to whole cents, as text."""
    return (F.floor(value * 100) / 100).cast("decimal(18,2)").cast("string")


def raw_prices(bars: DataFrame) -> DataFrame:
    """The bars made dirty by day of month: lost tickers, bad dates, junk numbers, copies."""
    day = F.dayofmonth("Date")
    close = _money(F.col("Close"))
    dirty = bars.select(
        F.when(day == 3, None).otherwise(F.col("Ticker")).alias("Ticker"),
        F.when(day == 7, "n/a").when(day != 8, F.col("Date").cast("string")).alias("Date"),
        F.concat(F.lit("USD "), _money(F.col("Open"))).alias("Open"),
        _money(F.col("High")).alias("High"),
        _money(F.col("Low")).alias("Low"),
        F.when(day == 13, None)
        .when(day == 14, "N/A")
        .when(day == 15, F.concat(F.lit("-"), close))
        .when(day == 16, F.concat(F.lit("1.5."), close))
        .when(day == 17, F.concat(F.lit("("), close, F.lit(")")))
        .when(day == 18, F.concat(close, F.lit("-")))
        .when(day == 19, F.concat(close, F.lit(" EUR")))
        .when(day == 21, F.concat(close, F.lit(" (2024)")))
        .otherwise(F.concat(F.lit("$"), close))
        .alias("Close"),
        F.col("Volume").cast("bigint").alias("Volume"),
        F.lit("0").alias("Dividends"),
        F.when(day == 22, "3:2").when(day == 23, "10-15").otherwise("1:1").alias("Stock Splits"),
        day.alias("day"),
    )
    copies = dirty.where(F.col("day").isin(5, 10, 15, 20, 25, 30))
    return dirty.unionByName(copies).drop("day")


def point_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per order: the customer's nation picks the ticker, the order day the date.

    Urgent orders ask ten years later; some orders ask for no date or an unknown ticker.
    """
    return _request_days(spark, sf_dir).select(
        F.col("o_orderkey").alias("request_id"),
        "ticker_id",
        F.when(F.dayofmonth("day") == 7, "n/a").otherwise(F.col("day").cast("string")).alias("date"),
    )


def range_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per order, from the order day over as many days as the nation's number.

    High-priority orders ask around the end of the forecast, low-priority ones with the ends
    swapped, urgent ones ten years later; some orders ask for no date or an unknown ticker.
    """
    days = _request_days(spark, sf_dir).withColumn(
        "first",
        F.when(F.col("o_orderpriority") == "2-HIGH", F.date_add("day", 450)).otherwise(F.col("day")),
    )
    first = F.col("first").cast("string")
    last = F.date_add("first", F.col("c_nationkey")).cast("string")
    swapped = F.col("o_orderpriority") == "5-LOW"
    return days.select(
        F.col("o_orderkey").alias("request_id"),
        "ticker_id",
        F.when(F.dayofmonth("day") == 7, "n/a").when(swapped, last).otherwise(first).alias("start_date"),
        F.when(swapped, first).otherwise(last).alias("end_date"),
    )


def _request_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey",
        "o_orderpriority",
        "c_nationkey",
        F.when(F.dayofmonth("o_orderdate") == 9, F.lit(99))
        .otherwise(F.col("c_nationkey") + 1)
        .alias("ticker_id"),
        F.when(urgent, F.add_months("o_orderdate", 120)).otherwise(F.col("o_orderdate")).alias("day"),
    )
