"""Errors of the fit, and the distribution of the predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quotemill.schemas import TICKER_ID


def error_metrics(scored: DataFrame) -> DataFrame:
    """MAE, MSE, RMSE, R² and MAPE per ticker from rows with ``y`` and ``yhat``, in one pass.

    Days with ``y = 0`` have no percentage error; they are counted. R² of a constant series is
    1 for a perfect fit and 0 otherwise, of a single day null.
    """
    error = F.col("y") - F.col("yhat")
    squares = F.sum(error * error)
    total = F.regr_syy("y", "y")
    r2 = (
        F.when(F.count("*") < 2, None)
        .when(total == 0, F.when(squares == 0, 1.0).otherwise(0.0))
        .otherwise(1 - F.try_divide(squares, total))
    )
    share = F.when(F.col("y") != 0, F.abs(error / F.nullif(F.col("y"), F.lit(0.0))))
    return scored.groupBy(TICKER_ID).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("y") == 0).alias("n_zero_y"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        r2.alias("r2"),
        (F.avg(share) * 100).alias("mape"),
    )


def actual_vs_predicted(forecast: DataFrame, series: DataFrame) -> DataFrame:
    """Every forecast day with the observed value where there is one."""
    return forecast.join(series, [TICKER_ID, "ds"], "left")


def _bin(value: Column, bins: int) -> Column:
    """Number of the equal-width bin from ``lo`` to ``hi``; the top edge belongs to the last."""
    place = F.try_divide(value - F.col("lo"), F.col("hi") - F.col("lo")) * bins
    return F.least(F.coalesce(F.floor(place), F.lit(0)), F.lit(bins - 1)).cast("int")


def value_range(forecast: DataFrame) -> DataFrame:
    """Per ticker what the distribution needs: number, smallest, largest, spread."""
    return forecast.groupBy(TICKER_ID).agg(
        F.count("yhat").alias("n"),
        F.min("yhat").alias("lo"),
        F.max("yhat").alias("hi"),
        F.stddev_samp("yhat").alias("spread"),
    )


def histogram(forecast: DataFrame, ranges: DataFrame, bins: int = 50) -> DataFrame:
    """Counts of ``yhat`` per ticker in equal bins, empty ones included.

    If all values are equal they are in bin 0.
    """
    filled = (
        forecast.join(ranges, TICKER_ID)
        .groupBy(TICKER_ID, _bin(F.col("yhat"), bins).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    every = ranges.select(
        TICKER_ID,
        "lo",
        ((F.col("hi") - F.col("lo")) / bins).alias("width"),
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
    )
    return every.join(filled, [TICKER_ID, "bin"], "left").select(
        TICKER_ID,
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def density(forecast: DataFrame, ranges: DataFrame, points: int = 200) -> DataFrame:
    """Gaussian kernel density of ``yhat`` on an even grid from the smallest to the largest value.

    The bandwidth is Scott's rule. The rows of a ticker, at most its calendar, are brought together before each
    adds to ``points`` sums, so that rows are shuffled and not their products. A ticker whose values are all equal has
    no density.
    """
    usable = ranges.where("n >= 2 and spread > 0").select(
        TICKER_ID,
        "lo",
        "n",
        ((F.col("hi") - F.col("lo")) / (points - 1)).alias("step"),
        (F.pow(F.col("n").cast("double"), F.lit(-0.2)) * F.col("spread")).alias("bandwidth"),
    )
    at = F.col("lo") + F.col("point") * F.col("step")
    u = (at - F.col("yhat")) / F.col("bandwidth")
    sums = (
        forecast.select(TICKER_ID, "yhat")
        .repartition(TICKER_ID)
        .join(usable, TICKER_ID)
        .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .groupBy(TICKER_ID, "point")
        .agg(F.sum(F.exp(-u * u / 2)).alias("mass"))
        .join(usable, TICKER_ID)
    )
    scale = F.col("n") * F.col("bandwidth") * F.sqrt(2 * F.pi())
    return sums.select(TICKER_ID, "point", at.alias("at"), (F.col("mass") / scale).alias("density"))
