"""Table schemas and column names."""

from __future__ import annotations

from pyspark.sql import types as T

TICKER = "Ticker"
TICKER_ID = "ticker_id"
DATE = "Date"

# The column names the cleaning rules apply to.
CRITICAL_COLUMNS = ["Date", "Close", "Volume"]
NUMERIC_COLUMNS = ["Open", "High", "Low", "Close", "Dividends", "Volume", "Stock Splits"]

# Provenance added when a file is landed; never part of a row's identity.
PROVENANCE_COLUMNS = ["original_filename", "uploaded_by"]


def table_schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in columns.items()])


TICKER_DICTIONARY = table_schema(Ticker=T.StringType(), ticker_id=T.IntegerType())
CLEAN_COUNTS = table_schema(
    rows_read=T.LongType(),
    rows_clean=T.LongType(),
    rows_without_ticker=T.LongType(),
    rows_close_unread=T.LongType(),
    tickers=T.LongType(),
    new_tickers=T.LongType(),
)

FORECAST = table_schema(
    ticker_id=T.IntegerType(),
    ds=T.DateType(),
    trend=T.DoubleType(),
    yhat=T.DoubleType(),
    yhat_lower=T.DoubleType(),
    yhat_upper=T.DoubleType(),
)

METRICS = table_schema(
    ticker_id=T.IntegerType(),
    n=T.LongType(),
    n_zero_y=T.LongType(),
    mae=T.DoubleType(),
    mse=T.DoubleType(),
    rmse=T.DoubleType(),
    r2=T.DoubleType(),
    mape=T.DoubleType(),
)

POINT_REQUESTS = table_schema(request_id=T.LongType(), ticker_id=T.IntegerType(), date=T.StringType())
RANGE_REQUESTS = table_schema(
    request_id=T.LongType(), ticker_id=T.IntegerType(), start_date=T.StringType(), end_date=T.StringType()
)
