"""Closed-form model: least-squares trend times a day-of-week factor.

``yhat = (intercept + slope * t) * weekly[weekday]`` with ``t`` in days since the ticker's
first day and weekdays from Sunday on.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

from quotemill.schemas import TICKER_ID
from quotemill.session import settle

WEEKDAYS = range(1, 8)


def z_score(level: float) -> float:
    """Half width, in standard deviations, of the central ``level`` of a normal distribution."""
    return NormalDist().inv_cdf((1 + level) / 2)


def _trend() -> Column:
    return F.col("intercept") + F.col("slope") * F.datediff("ds", "t0")


def _factor() -> Column:
    return F.get("weekly", F.dayofweek("ds") - 1)


def fit_trend_weekly(series: DataFrame) -> DataFrame:
    """Coefficients per ticker: ``n, t0, t1, intercept, slope, weekly, sigma``.

    The factor of a weekday is the least-squares one, ``sum(y * trend) / sum(trend²)``, which stays bounded where the
    trend crosses zero. Three aggregations over the series. The per-ticker results are written out in between, so
    that their true size decides how they are joined. A ticker with one day gets no model, a
    weekday without data the factor 1.
    """
    day = F.unix_date("ds").cast("double")
    slope = F.regr_slope("y", day)
    trend = series.groupBy(TICKER_ID).agg(
        F.count("*").alias("n"),
        F.min("ds").alias("t0"),
        F.max("ds").alias("t1"),
        (F.regr_intercept("y", day) + slope * F.unix_date(F.min("ds"))).alias("intercept"),
        slope.alias("slope"),
    )
    trend = settle(trend.where("n >= 2"), "trend")

    def total(value: Column, weekday: int) -> Column:
        return F.sum(F.when(F.dayofweek("ds") == weekday, value))

    by_weekday = [
        F.coalesce(F.try_divide(total(F.col("y") * _trend(), d), total(_trend() * _trend(), d)), F.lit(1.0))
        for d in WEEKDAYS
    ]
    weekly = (
        series.join(trend, TICKER_ID)
        .groupBy(TICKER_ID, "n", "t0", "t1", "intercept", "slope")
        .agg(F.array(*by_weekday).alias("weekly"))
    )
    weekly = settle(weekly, "weekly")

    error = F.col("y") - _trend() * _factor()
    keys = [TICKER_ID, "n", "t0", "t1", "intercept", "slope", "weekly"]
    spread = (
        series.join(weekly, TICKER_ID).groupBy(TICKER_ID).agg(F.sqrt(F.avg(error * error)).alias("sigma"))
    )
    return settle(weekly.join(spread, TICKER_ID).select(*keys, "sigma"), "trend-weekly")


def score_trend_weekly(days: DataFrame, coefficients: DataFrame, level: float = 0.8) -> DataFrame:
    """Append ``trend, yhat, yhat_lower, yhat_upper`` to rows of ``(ticker_id, ds, …)``.

    Rows of a ticker without a model are left out.
    """
    names = days.columns
    model = coefficients.select(TICKER_ID, "t0", "intercept", "slope", "weekly", "sigma")
    half = z_score(level) * F.col("sigma")
    return (
        days.join(model, TICKER_ID)
        .withColumn("trend", _trend())
        .withColumn("yhat", F.col("trend") * _factor())
        .withColumn("yhat_lower", F.col("yhat") - half)
        .withColumn("yhat_upper", F.col("yhat") + half)
        .select(*names, "trend", "yhat", "yhat_lower", "yhat_upper")
    )


def weekly_profile(coefficients: DataFrame) -> DataFrame:
    """The weekly effect, relative to the trend, on each weekday (1 = Sunday)."""
    return coefficients.select(TICKER_ID, F.posexplode("weekly").alias("place", "factor")).select(
        TICKER_ID, (F.col("place") + 1).alias("weekday"), (F.col("factor") - 1).alias("effect")
    )
