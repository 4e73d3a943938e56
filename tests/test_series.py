from __future__ import annotations

import datetime as dt

from quotemill.operators import series as ops

D = dt.date
CLEANED = "ticker_id int, Date date, Close double, Volume double"


def test_mode_takes_the_smallest_id_on_a_tie_and_skips_nulls(spark):
    ids = [2, 2, 1, 1, 3, None, None, None]
    df = spark.createDataFrame([(i,) for i in ids], "ticker_id int")
    assert ops.most_common_ticker(df).collect() == [(1, 2)]
    assert ops.keep_most_common(df).collect() == [(1,), (1,)]


def test_one_row_per_day_at_any_partition_count(spark):
    rows = [(1, D(2024, 1, 1), c, 1.0) for c in (9.0, 7.0, None, 8.0)]
    rows += [(None, D(2024, 1, 1), 1.0, 1.0), (1, None, 1.0, 1.0), (1, D(2024, 1, 2), None, 1.0)]
    for partitions in (1, 3, 8):
        df = spark.createDataFrame(rows, CLEANED).repartition(partitions)
        assert ops.training_series(df).collect() == [(1, D(2024, 1, 1), 7.0)]


def test_future_spine_includes_weekends_and_leap_days(spark):
    series = spark.createDataFrame([(1, D(2024, 2, 27), 1.0), (2, D(2023, 12, 30), 1.0)], "ticker_id int, ds date, y double")
    days = sorted((r.ticker_id, r.ds) for r in ops.future_spine(series, 3).collect())
    assert days == [
        (1, D(2024, 2, 28)), (1, D(2024, 2, 29)), (1, D(2024, 3, 1)),
        (2, D(2023, 12, 31)), (2, D(2024, 1, 1)), (2, D(2024, 1, 2)),
    ]
    assert ops.future_spine(series).count() == 730
    assert ops.forecast_axis(series, 3).count() == 8


def test_stack_fills_missing_columns_and_keeps_copies(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([("x", 2.0), ("x", 2.0)], "b string, c double")
    out = ops.stack(a, b)
    assert out.columns == ["a", "b", "c"]
    assert sorted(map(str, map(tuple, out.collect()))) == ["(1, 'x', None)", "(None, 'x', 2.0)", "(None, 'x', 2.0)"]
