"""Cleaning of raw price rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from quotemill.functions.scalars import finite, number_in, parse_date, scrub_number_compat, strip_number
from quotemill.schemas import CRITICAL_COLUMNS, DATE, NUMERIC_COLUMNS, TICKER, TICKER_ID
from quotemill.session import settle


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """One of each group of identical rows. Copies are merged before the shuffle."""
    return df.dropDuplicates()


def distinct_tickers(df: DataFrame) -> DataFrame:
    return df.select(TICKER).distinct()


def ticker_dictionary(df: DataFrame) -> DataFrame:
    """``(Ticker, ticker_id)``: ids from 1 in ticker order, a null ticker first.

    The distinct names are sorted over the cluster and numbered from per-partition offsets.
    """
    names = distinct_tickers(df)
    in_order = F.col(TICKER).asc_nulls_first()
    # monotonically_increasing_id: partition number in the upper bits, position in the lower 33
    placed = settle(
        names.orderBy(in_order)
        .withColumn("place", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("place", 33)),
        "tickers-placed",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("part")
        .agg(F.min("place").alias("first_place"), F.count("*").alias("names"))
        .withColumn("offset", F.coalesce(F.sum("names").over(before), F.lit(0)))
    )
    ids = placed.join(offsets, "part").select(
        TICKER, (F.col("offset") + F.col("place") - F.col("first_place") + 1).cast("int").alias(TICKER_ID)
    )
    return settle(ids, "ticker-dictionary")


def new_tickers(df: DataFrame, known: DataFrame) -> DataFrame:
    """``(Ticker, ticker_id)`` of the tickers that ``known`` lacks, numbered in ticker order after its largest id.

    Ids once given never change, so rows written under an older dictionary stay right under the two together.
    """
    names = distinct_tickers(df).alias("names")
    known = known.alias("known")
    unknown = names.join(known, F.col(f"names.{TICKER}").eqNullSafe(F.col(f"known.{TICKER}")), "left_anti")
    last = known.agg(F.max(TICKER_ID)).first()[0] or 0
    return ticker_dictionary(unknown).select(TICKER, (F.col(TICKER_ID) + F.lit(last)).cast("int").alias(TICKER_ID))


def encode_ticker(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Replace ``Ticker`` by its id. Rows without a ticker stay, with a null id.

    The dictionary's names are a written table, so their true size decides between a broadcast
    and a shuffled join, and the latter splits hot tickers at run time.
    """
    return df.join(dictionary, TICKER, "left").drop(TICKER)


def drop_null_rows(df: DataFrame) -> DataFrame:
    """Drop rows where a critical column that exists is null (NaN is kept)."""
    for name in CRITICAL_COLUMNS:
        if name in df.columns:
            df = df.where(F.col(name).isNotNull())
    return df


def parse_dates(df: DataFrame) -> DataFrame:
    """``Date`` as a date, without the rows where it cannot be read."""
    if DATE not in df.columns:
        return df
    day = parse_date(F.col(DATE), df.schema[DATE].dataType)
    return df.withColumn(DATE, day).where(F.col(DATE).isNotNull())


def scrub_numbers(df: DataFrame, compat: bool = False) -> DataFrame:
    """All numeric columns that exist as doubles; what cannot be read becomes null.

    ``compat`` repeats the original scrub, which loses signs and exponents.
    """
    present = {name: F.col(f"`{name}`") for name in NUMERIC_COLUMNS if name in df.columns}
    if compat:
        return df.withColumns({name: scrub_number_compat(c.cast("string")) for name, c in present.items()})
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    # one projection per step, so that no step is worked out twice
    df = df.withColumns({name: strip_number(c) for name, c in present.items() if name in texts})
    df = df.withColumns(
        {name: number_in(c) if name in texts else c.try_cast("double") for name, c in present.items()}
    )
    return df.withColumns({name: finite(c) for name, c in present.items()})
