"""Train job: cleaned prices to a stored run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from quotemill.functions.scalars import run_id
from quotemill.operators.decomposable import fit_decomposable, score_decomposable, seasonal_profiles
from quotemill.operators.metrics import actual_vs_predicted, density, error_metrics, histogram, value_range
from quotemill.operators.series import forecast_axis, keep_most_common, series_range, training_series
from quotemill.operators.trend_weekly import fit_trend_weekly, score_trend_weekly, weekly_profile
from quotemill.schemas import TICKER_ID
from quotemill.session import settle
from quotemill.sources.runs import Run, load_run, write_run


@dataclass(frozen=True)
class Model:
    """``score`` gives the four predicted columns, ``full`` all there are, ``profiles`` the seasonal effects."""

    name: str
    fit: Callable[[DataFrame], DataFrame]
    score: Callable[[DataFrame, DataFrame], DataFrame]
    full: Callable[[DataFrame, DataFrame], DataFrame]
    profiles: Callable[[DataFrame], DataFrame]

    def scorer(self, coefficients: DataFrame) -> Callable[[DataFrame], DataFrame]:
        return partial(self.score, coefficients=coefficients)


DECOMPOSABLE = Model(
    "decomposable", fit_decomposable, score_decomposable, partial(score_decomposable, components=True), seasonal_profiles
)
TREND_WEEKLY = Model("trend_weekly", fit_trend_weekly, score_trend_weekly, score_trend_weekly, weekly_profile)
MODELS = {model.name: model for model in (DECOMPOSABLE, TREND_WEEKLY)}


def forecast(series: DataFrame, coefficients: DataFrame, model: Model, periods: int = 365) -> DataFrame:
    """Predictions, with all columns of the model, for all observed days and the ``periods`` days after them."""
    return model.full(forecast_axis(series, periods), coefficients)


def metrics(series: DataFrame, coefficients: DataFrame, model: Model) -> DataFrame:
    """Errors on the training rows themselves, scored in place."""
    return error_metrics(model.score(series, coefficients))


def fit_report(coefficients: DataFrame) -> DataFrame:
    """Tickers with a model, and how many of them did not converge and are therefore not served: one row."""
    ended = F.coalesce("converged", F.lit(False)) if "converged" in coefficients.columns else F.lit(True)
    return coefficients.agg(F.count("*").alias("tickers"), F.count_if(~ended).alias("not_converged"))


def train_all(
    cleaned: DataFrame,
    root: str,
    run_ts: str | None = None,
    model: Model = DECOMPOSABLE,
    periods: int = 365,
    only_most_common: bool = False,
    tickers: DataFrame | None = None,
) -> Run:
    """Fit, forecast, measure and store all tickers, or only the most common one.

    The run also holds ``series_range`` (days and dates per ticker), ``fit_report`` (how many fits converged) and the tables behind the plots:
    ``actual_vs_predicted``, ``profiles``, ``histogram``, ``density``. With ``tickers`` it holds the names of its ids, so that it can be asked by name
    however the ids move later. ``run_ts`` defaults to the time of the call.
    """
    spark: SparkSession = cleaned.sparkSession
    if run_ts is None:
        run_ts = spark.range(1).select(run_id(F.current_timestamp()).alias("run_ts")).first()["run_ts"]
    if only_most_common:
        cleaned = keep_most_common(cleaned)
    series = settle(training_series(cleaned), "series")
    coefficients = model.fit(series)
    predicted = settle(forecast(series, coefficients, model, periods), "forecast")
    ranges = settle(value_range(predicted), "ranges")
    write_run(
        root,
        run_ts,
        coefficients,
        predicted,
        metrics(series, coefficients, model),
        model=model.name,
        tables={
            "series_range": series_range(series),
            "fit_report": fit_report(coefficients),
            "actual_vs_predicted": actual_vs_predicted(predicted, series),
            "profiles": model.profiles(coefficients),
            "histogram": histogram(predicted, ranges),
            "density": density(predicted, ranges),
            **({} if tickers is None else {"tickers": tickers.join(coefficients, TICKER_ID, "left_semi")}),
        },
    )
    return load_run(spark, root)
