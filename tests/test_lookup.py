from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quotemill.operators import lookup
from quotemill.schemas import POINT_REQUESTS, RANGE_REQUESTS

D = dt.date
FORECAST = "ticker_id int, ds date, yhat double, yhat_lower double, yhat_upper double, trend double"


@pytest.fixture(scope="module")
def forecast(spark):
    """Ten days in January and, after a gap, five in March; ticker 2 has February 1 only."""
    days = [D(2024, 1, d) for d in range(20, 30)] + [D(2024, 3, d) for d in range(1, 6)]
    rows = [(1, d, 100.0 + d.day, 90.0, 110.0, 1.0) for d in days] + [(2, D(2024, 2, 1), 7.0, 6.0, 8.0, 2.0)]
    return spark.createDataFrame(rows, FORECAST)


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame([(1,), (2,)], "ticker_id int")


def score(days):
    """Stands for a model: recognisable values."""
    values = {"trend": 0.0, "yhat": -1.0, "yhat_lower": -2.0, "yhat_upper": 0.0}
    return days.withColumns({name: F.lit(value) for name, value in values.items()})


def points(spark, forecast, known, rows):
    out = lookup.predict_points(spark.createDataFrame(rows, POINT_REQUESTS), forecast, score, known)
    return {r.request_id: (r.ticker_id, r.date, r.predicted_price, r.lower_bound, r.upper_bound, r.trend) for r in out.collect()}


def ranges(spark, forecast, known, rows, **options):
    requests = spark.createDataFrame(rows, RANGE_REQUESTS)
    out = lookup.predict_ranges(requests, forecast, score, known, **options)
    found: dict[int, list] = {}
    for r in sorted(out.collect(), key=lambda r: (r.request_id, r.date)):
        found.setdefault(r.request_id, []).append((r.date, r.predicted_price))
    return found


def test_point_hit_and_miss(spark, forecast, known):
    asked = [(1, 1, "2024-01-20"), (2, 1, "2024-02-01"), (3, 2, "2024-02-01")]
    refused = [(4, 9, "2024-01-20"), (5, 1, "2024-13-40"), (6, None, "2024-01-20")]
    found = points(spark, forecast, known, asked + refused)
    assert found == {
        1: (1, "2024-01-20", 120.0, 90.0, 110.0, 1.0),
        2: (1, "2024-02-01", -1.0, -2.0, 0.0, 0.0),
        3: (2, "2024-02-01", 7.0, 6.0, 8.0, 2.0),
    }


def test_reasons(spark, known):
    rows = [
        (1, 1, "2024-01-01", "2024-01-01"),
        (2, 1, "2024-02-01", "2024-01-01"),
        (3, 1, "2024-13-40", "2024-01-01"),
        (4, 1, "2024-01-01", None),
        (5, 9, "2024-02-01", "2024-01-01"),
    ]
    checked = lookup.check_ranges(spark.createDataFrame(rows, RANGE_REQUESTS), known)
    assert {r.request_id: r.reason for r in checked.collect()} == {
        1: None, 2: lookup.REVERSED, 3: lookup.BAD_DATE, 4: lookup.BAD_DATE, 5: lookup.NO_MODEL,
    }
    assert sorted(r.request_id for r in lookup.rejects(checked).collect()) == [2, 3, 4, 5]


def test_partly_covered_range_gives_only_stored_days(spark, forecast, known):
    request = [(1, 1, "2024-01-28", "2024-02-01")]
    assert ranges(spark, forecast, known, request) == {1: [("2024-01-28", 128.0), ("2024-01-29", 129.0)]}


def test_fill_gaps_evaluates_the_missing_days(spark, forecast, known):
    request = [(1, 1, "2024-01-28", "2024-02-01")]
    assert ranges(spark, forecast, known, request, fill_gaps=True) == {
        1: [("2024-01-28", 128.0), ("2024-01-29", 129.0), ("2024-01-30", -1.0), ("2024-01-31", -1.0), ("2024-02-01", -1.0)]
    }


def test_uncovered_ranges_are_evaluated_day_by_day(spark, forecast, known):
    asked = [
        (1, 1, "2030-12-31", "2031-01-02"),
        (2, 1, "1990-01-01", "1990-01-01"),
        (3, 1, "2024-02-02", "2024-02-03"),
        (4, 2, "2024-02-02", "2024-02-02"),
    ]
    found = ranges(spark, forecast, known, asked)
    assert found == {
        1: [("2030-12-31", -1.0), ("2031-01-01", -1.0), ("2031-01-02", -1.0)],
        2: [("1990-01-01", -1.0)],
        3: [("2024-02-02", -1.0), ("2024-02-03", -1.0)],
        4: [("2024-02-02", -1.0)],
    }


def test_wide_range_over_several_months_and_beyond(spark, forecast, known):
    found = ranges(spark, forecast, known, [(1, 1, "2000-01-01", "2050-12-31"), (2, 2, "2024-01-31", "2024-02-01")])
    assert len(found[1]) == 15 and len({d for d, _ in found[1]}) == 15
    assert found[2] == [("2024-02-01", 7.0)]


def test_hot_ticker_and_repeated_request_ids(spark, forecast, known):
    rows = [(i % 50, 1, "2024-01-20", "2024-01-21") for i in range(300)] + [(0, 2, "2024-02-01", "2024-02-01")]
    requests = spark.createDataFrame(rows, RANGE_REQUESTS)
    out = lookup.predict_ranges(requests, forecast, score, known)
    assert out.count() == 601
    assert out.where("predicted_price < 0").count() == 0


def test_hot_ticker_in_a_shuffled_range_lookup(spark, known):
    """No broadcast, and nine requests of ten for one ticker: each request still gets exactly its stored days."""
    days = [(t, D(2024, 1, 1) + dt.timedelta(7 * i), float(i), 0.0, 0.0, 0.0) for t in (1, 2) for i in range(40)]
    stored = spark.createDataFrame(days, FORECAST)
    rows = [
        (i, 1 if i % 10 else 2, str(D(2023, 12, 1) + dt.timedelta(i)), str(D(2023, 12, 1) + dt.timedelta(i + i % 23)))
        for i in range(360)
    ]
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        found = ranges(spark, stored, known, rows)
    finally:
        spark.conf.set(setting, before)
    of_ticker = {t: {str(d): y for k, d, y, *_ in days if k == t} for t in (1, 2)}
    for request, ticker, first, last in rows:
        inside = [(d, y) for d, y in sorted(of_ticker[ticker].items()) if first <= d <= last]
        span = (D.fromisoformat(last) - D.fromisoformat(first)).days + 1
        every = [(str(D.fromisoformat(first) + dt.timedelta(k)), -1.0) for k in range(span)]
        assert found[request] == (inside or every)


def test_days_between_far_ends_are_complete(spark, forecast, known):
    found = ranges(spark, forecast, known, [(1, 1, "2030-02-27", "2034-03-02"), (2, 2, "9999-12-30", "9999-12-31")])
    assert len(found[1]) == (D(2034, 3, 2) - D(2030, 2, 27)).days + 1
    assert [d for d, _ in found[2]] == ["9999-12-30", "9999-12-31"]


def test_info(spark, forecast):
    rows = lookup.forecast_info(forecast.withColumn("run_ts", F.lit("v1"))).orderBy("ticker_id").collect()
    assert rows[0] == ("v1", 1, "2024-01-20", "2024-03-05", 15)
