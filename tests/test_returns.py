from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest

from quotemill.operators import returns
from quotemill.operators.returns import daily_return

START = dt.date(2020, 1, 30)
SCHEMA = "Date date, Close double, Volume bigint, ticker_id int"


def frame(spark, rows, partitions=5):
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def expected(rows):
    """Brute force: walk each ticker in order."""
    found = Counter()
    low = float("-inf")
    by_ticker = {}
    for row in rows:
        by_ticker.setdefault(row[3], []).append(row)
    for group in by_ticker.values():
        previous = None
        for row in sorted(group, key=lambda r: (r[0], low if r[1] is None else r[1], r[2])):
            change = None
            if row[1] is not None and previous not in (None, 0.0):
                change = round((row[1] - previous) / previous * 100, 9)
            found[(*row, change)] += 1
            previous = row[1]
    return found


def collected(df):
    return Counter(
        (r.Date, r.Close, r.Volume, r.ticker_id, None if r.Daily_Return is None else round(r.Daily_Return, 9))
        for r in df.collect()
    )


def skewed_rows(seed, days_unique):
    """One ticker, and rows without a ticker, hold a third of all rows each."""
    rng = random.Random(seed)
    rows, taken = [], set()
    while len(rows) < 600:
        ticker = rng.choice([1, 1, 1, 1, None, None, None, None, 2, 3, 4, 5])
        day = START + dt.timedelta(days=rng.randrange(400 if days_unique else 60))
        if days_unique and (ticker, day) in taken:
            continue
        taken.add((ticker, day))
        close = rng.choice([None, 0.0, round(rng.uniform(-5, 50), 2), round(rng.uniform(1, 50), 2)])
        row = (day, close, rng.randrange(10**6), ticker)
        rows.append(row)
    return rows


def test_interleaved_tickers(spark):
    rows = [(START, 10.0, 1, 1), (START, 100.0, 1, 2)]
    rows += [(START + dt.timedelta(1), 11.0, 1, 1), (START + dt.timedelta(1), 90.0, 1, 2)]
    out = daily_return(frame(spark, rows))
    assert sorted((r.ticker_id, r.Daily_Return) for r in out.collect() if r.Daily_Return) == [(1, 10.0), (2, -10.0)]
    assert out.where("Daily_Return is null").count() == 2


def test_previous_close_zero_gives_null(spark):
    rows = [(START, 0.0, 1, 1), (START + dt.timedelta(1), 5.0, 1, 1)]
    assert [r.Daily_Return for r in daily_return(frame(spark, rows)).collect()] == [None, None]


@pytest.mark.parametrize("partitions", [1, 2, 7, 40, None])
@pytest.mark.parametrize("days_unique", [True, False])
def test_any_number_of_ranges_gives_the_same(spark, partitions, days_unique):
    rows = skewed_rows(1, days_unique)
    assert collected(daily_return(frame(spark, rows), partitions=partitions)) == expected(rows)


def test_one_window_per_ticker_agrees(spark):
    rows = [r for r in skewed_rows(2, days_unique=True) if r[3] is not None]
    assert collected(daily_return(frame(spark, rows), one_row_per_day=True)) == expected(rows)


def test_many_rows_per_day(spark):
    rows = skewed_rows(3, days_unique=False)
    assert collected(daily_return(frame(spark, rows, 3))) == expected(rows)
    assert collected(daily_return(frame(spark, rows, 11))) == expected(rows)


def test_a_day_with_half_of_all_rows_is_spread(spark):
    rng = random.Random(4)
    rows = [(START, round(rng.uniform(1, 9), 3), i, 1) for i in range(500)]
    rows += [(START + dt.timedelta(rng.randrange(300)), round(rng.uniform(1, 9), 3), i, rng.choice([1, 2, None])) for i in range(500)]
    for partitions in (3, 16):
        assert collected(daily_return(frame(spark, rows), partitions=partitions)) == expected(rows)
    sizes = returns.placed_by_range(frame(spark, rows), 16).groupBy("_range").count().collect()
    assert len(sizes) > 10 and max(r["count"] for r in sizes) < 200


def test_without_close_nothing_is_added(spark):
    df = spark.createDataFrame([(1,)], "ticker_id int")
    assert daily_return(df).columns == ["ticker_id"]
