from __future__ import annotations

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quotemill.operators import clean
from quotemill.plans import cleaning

D = dt.date


def scrubbed(spark, values, dtype, compat=False):
    df = spark.createDataFrame([(v,) for v in values], f"Close {dtype}")
    return [row.Close for row in clean.scrub_numbers(df, compat).collect()]


@pytest.mark.parametrize(
    ("text", "number", "compat"),
    [
        ("$1,234.50", 1234.5, 1234.5),
        ("-5", -5.0, 5.0),
        ("$-5.25", -5.25, 5.25),
        ("USD 12.50", 12.5, 12.5),
        ("USD -3", -3.0, 3.0),
        ("1.5E7", 1.5e7, 1.57),
        ("-1.2e-3", -0.0012, 1.23),
        ("  7 ", 7.0, 7.0),
        ("1.5d", None, 1.5),
        ("N/A", None, None),
        ("1.2.3", None, None),
        ("NaN", None, None),
        ("Infinity", None, None),
        ("1e999", None, 1999.0),
        ("", None, None),
        (None, None, None),
        ("1:1", 1.0, 11.0),
        ("3:2", 1.5, 32.0),
        ("2:0", None, 20.0),
        ("10-15", None, 1015.0),
        ("(12.50)", -12.5, 12.5),
        ("12.50-", -12.5, 12.5),
        ("12.50 (2024)", None, 12.502024),
        ("1,5e3x", None, 153.0),
        ("12.50 EUR", 12.5, 12.5),
        ("€3", 3.0, 3.0),
    ],
)
def test_scrub_text(spark, text, number, compat):
    assert scrubbed(spark, [text], "string") == [number]
    assert scrubbed(spark, [text], "string", compat=True) == [1999.0 if text == "1e999" else compat]


def test_scrub_random_text(spark):
    """Any mix of characters: never an error, the original's digits with ``compat``, and never a made-up number."""
    rng = random.Random(5)
    texts = ["".join(rng.choices("0123456789..--+$, eEUSDx:()", k=rng.randrange(12))) for _ in range(2000)]

    def original(text):
        try:
            return float(re.sub("[^0-9.]", "", text))
        except ValueError:
            return None

    def plain(text):
        bare = re.sub("^([+-]?)[A-Z]{3}|[A-Z]{3}$", r"\1", re.sub(r"[$,\s]", "", text))
        one = r"(\d+\.?\d*|\.\d+)"
        if re.fullmatch(rf"[+-]?{one}([eE][+-]?\d+)?", bare):
            return float(bare) if math.isfinite(float(bare)) else None
        if found := re.fullmatch(rf"{one}-|\({one}\)", bare):
            return -float(found[1] or found[2])
        if found := re.fullmatch(f"{one}:{one}", bare):
            return float(found[1]) / float(found[2]) if float(found[2]) else None
        return None

    assert scrubbed(spark, texts, "string", compat=True) == [original(t) for t in texts]
    assert scrubbed(spark, texts, "string") == [plain(t) for t in texts]


def test_scrub_numeric_input(spark):
    assert scrubbed(spark, [12345678.0, -1.5, float("nan"), float("inf")], "double") == [12345678.0, -1.5, None, None]
    assert scrubbed(spark, [12345678.0, -1.5], "double", compat=True) == [1.23456787, 1.5]
    assert scrubbed(spark, [123456789012], "bigint") == [123456789012.0]
    assert scrubbed(spark, [123456789012], "bigint", compat=True) == [123456789012.0]


def test_scrub_touches_only_present_numeric_columns(spark):
    df = spark.createDataFrame([("x", "$1", "$2")], "Note string, Close string, `Stock Splits` string")
    out = clean.scrub_numbers(df)
    assert out.columns == df.columns
    assert out.first() == ("x", 1.0, 2.0)


def test_dictionary_numbers_nulls_first_and_covers_filtered_tickers(spark):
    df = spark.createDataFrame([("B", None), (None, 1.0), ("A", 2.0), ("A", 3.0)], "Ticker string, Close double")
    found = {r.Ticker: r.ticker_id for r in clean.ticker_dictionary(df).collect()}
    assert found == {None: 1, "A": 2, "B": 3}


def test_dictionary_of_a_long_list_is_numbered_over_the_cluster(spark):
    names = [f"T{i * 7919 % 1000:03d}" for i in range(1000)] + [None]
    df = spark.createDataFrame([(n,) for n in names], "Ticker string").repartition(7)
    found = clean.ticker_dictionary(df)
    expected = {n: i for i, n in enumerate([None, *sorted(n for n in names if n)], start=1)}
    assert {r.Ticker: r.ticker_id for r in found.collect()} == expected
    assert found.schema["ticker_id"].dataType.typeName() == "integer"


def test_encode_keeps_all_rows_and_the_column_order(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "A", 1.0, "x"), ("2024-01-01", None, 2.0, "y")],
        "Date string, Ticker string, Close double, Note string",
    )
    out = clean.encode_ticker(df, clean.ticker_dictionary(df))
    assert out.columns == ["Date", "Close", "Note", "ticker_id"]
    assert sorted((r.Note, r.ticker_id) for r in out.collect()) == [("x", 2), ("y", None)]


def test_null_filter_keeps_nan_and_ignores_missing_columns(spark):
    df = spark.createDataFrame([(float("nan"), "a"), (None, "b"), (1.0, None)], "Close double, Note string")
    assert {r.Note for r in clean.drop_null_rows(df).collect()} == {"a", None}
    other = df.drop("Close")
    assert clean.drop_null_rows(other).count() == 3
    assert clean.parse_dates(other).count() == 3
    assert clean.scrub_numbers(other).columns == ["Note"]


def test_dates_from_text_timestamp_and_date(spark):
    text = spark.createDataFrame([("2024-02-30",), ("2024-02-29",), ("n/a",), (None,)], "Date string")
    assert [r.Date for r in clean.parse_dates(text).collect()] == [D(2024, 2, 29)]
    for dtype in ("timestamp", "timestamp_ntz"):
        moment = spark.createDataFrame([(dt.datetime(2024, 2, 29, 17, 5),)], f"Date {dtype}")
        assert [r.Date for r in clean.parse_dates(moment).collect()] == [D(2024, 2, 29)]


RAW = [
    ("A", "2024-01-02", "$10.00", 5),
    ("A", "2024-01-02", "$10.00", 5),
    ("A", "2024-01-03", "N/A", 5),
    ("A", "2024-01-04", "11", 5),
    ("B", "2024-01-02", "-4", 5),
    ("B", "2024-01-03", "-5", None),
    ("B", "bad", "-5", 5),
    (None, "2024-01-02", "7", 5),
    ("C", "2024-01-02", None, 5),
]
RAW_SCHEMA = "Ticker string, Date string, Close string, Volume bigint"


def test_clean_prices_end_to_end(spark):
    raw = spark.createDataFrame(RAW, RAW_SCHEMA)
    out = cleaning.clean_prices(raw)
    assert out.columns == ["Date", "Close", "Volume", "ticker_id", "Daily_Return"]
    assert sorted((r.ticker_id or 0, r.Date.day, r.Close, r.Daily_Return) for r in out.collect()) == [
        (0, 2, 7.0, None),
        (2, 2, 10.0, None),
        (2, 3, None, None),
        (2, 4, 11.0, None),
        (3, 2, -4.0, None),
    ]
    kept = cleaning.clean_prices(raw, drop_unparsed=True)
    assert {r.Daily_Return for r in kept.where("ticker_id = 2").collect()} == {None, 10.0}


def test_clean_prices_at_any_partition_count(spark):
    rng = random.Random(6)
    rows = [
        (rng.choice(["A", "A", "B", None]), f"2024-01-{rng.randrange(1, 29):02d}", str(rng.randrange(1, 9)), rng.randrange(9))
        for _ in range(400)
    ]
    results = []
    for partitions in (1, 7):
        out = cleaning.clean_prices(spark.createDataFrame(rows, RAW_SCHEMA).repartition(partitions))
        results.append(sorted(map(str, out.collect())))
    assert results[0] == results[1]


def test_clean_report_counts_every_step(spark):
    report = cleaning.clean_report(spark.createDataFrame(RAW, RAW_SCHEMA)).first().asDict()
    assert report == {
        "rows_read": 9,
        "rows_distinct": 8,
        "rows_complete": 6,
        "rows_clean": 5,
        "rows_without_ticker": 1,
        "rows_close_unread": 1,
    }


def test_clean_without_optional_columns(spark):
    raw = spark.createDataFrame([("A", "x"), ("A", "x"), ("B", "y")], "Ticker string, Note string")
    out = cleaning.clean_prices(raw)
    assert out.columns == ["Note", "ticker_id"]
    assert out.count() == 2
    assert cleaning.clean_report(raw).first().rows_distinct == 2


def test_pushdown_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "raw")
    spark.createDataFrame(RAW, RAW_SCHEMA).write.parquet(path)
    rows = clean.drop_null_rows(clean.drop_duplicate_rows(spark.read.parquet(path)))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(Date), IsNotNull(Close), IsNotNull(Volume)" in plan


def test_dictionary_scan_reads_one_column(spark, tmp_path):
    path = str(tmp_path / "raw")
    spark.createDataFrame(RAW, RAW_SCHEMA).write.parquet(path)
    plan = clean.distinct_tickers(clean.drop_duplicate_rows(spark.read.parquet(path)))
    assert "ReadSchema: struct<Ticker:string>" in plan._jdf.queryExecution().executedPlan().toString()


def test_sample_is_the_first_rows_by_date(spark):
    df = spark.range(100).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (99 - F.col("id")).cast("int")).alias("Date"),
        F.lit(1).alias("ticker_id"),
        F.col("id").cast("double").alias("Close"),
    )
    assert [r.Close for r in cleaning.clean_sample(df).collect()] == [float(99 - i) for i in range(10)]
