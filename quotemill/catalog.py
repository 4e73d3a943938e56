"""One named query per operator, over the given test tables.

Model outputs are rounded here, not in the library: the two engines that are compared add
floating-point numbers in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quotemill import testtables
from quotemill.operators import clean, decomposable, lookup, metrics, series as series_ops, trend_weekly
from quotemill.operators.returns import daily_return
from quotemill.plans import cleaning, training
from quotemill.schemas import FORECAST, TICKER_ID
from quotemill.session import scratch_path, settle
from quotemill.sources import cleans, runs, tables

Query = Callable[[SparkSession, str], DataFrame]

RUN_TS = "20240101_000000"
LATER_RUN_TS = "20250101_000000"
PREDICTED = ["trend", "yhat", "yhat_lower", "yhat_upper"]


def _rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, places) for name in names})


# ------------------------------------------------------------------- inputs


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(testtables.price_bars(spark, sf_dir), "bars")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testtables.raw_prices(_bars(spark, sf_dir))


def _encoded_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _bars(spark, sf_dir)
    return clean.encode_ticker(bars, clean.ticker_dictionary(bars))


def _encoded_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = settle(testtables.trades(spark, sf_dir), "trades")
    return clean.encode_ticker(trades, clean.ticker_dictionary(trades))


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(series_ops.training_series(_encoded_bars(spark, sf_dir)), "series")


def _weekly_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    series = _series(spark, sf_dir)
    return series, trend_weekly.fit_trend_weekly(series)


def _weekly_forecast(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Series, coefficients and the forecast, rounded as if it had been stored that way."""
    series, coefficients = _weekly_model(spark, sf_dir)
    forecast = training.forecast(series, coefficients, training.TREND_WEEKLY)
    return series, coefficients, _rounded(forecast, 3, *PREDICTED)


def _decomposable_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    series = _series(spark, sf_dir)
    return series, decomposable.fit_decomposable(series)


# ----------------------------------------------------------- scans and stacks


def scan_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.read_raw(spark, f"{sf_dir}/lineitem.parquet")
    return lines.withColumn("l_shipdate", F.col("l_shipdate").cast("date"))


def scan_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_parquet_files(spark, sf_dir, "{customer,supplier}.parquet")


def union_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = testtables.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderstatus").alias("status"),
    )
    lines = testtables.table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_shipdate").cast("date").alias("day"),
        F.col("l_orderkey").alias("order_key"),
    )
    return series_ops.stack(orders, lines)


# ------------------------------------------------------------------- cleaning


def dedup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_duplicate_rows(_raw(spark, sf_dir))


def distinct_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.distinct_tickers(_raw(spark, sf_dir))


def encode_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    return clean.encode_ticker(raw, clean.ticker_dictionary(raw))


def drop_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_null_rows(_raw(spark, sf_dir))


def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.parse_dates(_raw(spark, sf_dir))


def scrub_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.scrub_numbers(_raw(spark, sf_dir))


def scrub_numeric_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.scrub_numbers(_raw(spark, sf_dir), compat=True)


def daily_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _encoded_bars(spark, sf_dir)
    return _rounded(daily_return(bars, one_row_per_day=True), 6, "Daily_Return").select(
        TICKER_ID, "Date", "Close", "Daily_Return"
    )


def daily_return_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = _encoded_trades(spark, sf_dir)
    return _rounded(daily_return(trades), 6, "Daily_Return")


def clean_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cleaning.clean_prices(_raw(spark, sf_dir)), 6, "Daily_Return")


def clean_prices_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = cleaning.clean_prices(_raw(spark, sf_dir), compat=True, drop_unparsed=True)
    return _rounded(cleaned, 6, "Daily_Return")


def clean_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_sample(clean_prices(spark, sf_dir))


def clean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_report(_raw(spark, sf_dir))


# --------------------------------------------------------------------- series


def most_common_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_ops.most_common_ticker(_encoded_trades(spark, sf_dir))


def keep_most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_ops.keep_most_common(settle(_encoded_bars(spark, sf_dir), "encoded"))


def training_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_ops.training_series(_encoded_trades(spark, sf_dir))


def series_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_ops.series_range(_series(spark, sf_dir))


def future_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_ops.future_spine(_series(spark, sf_dir))


# --------------------------------------------------- trend and weekday model


def _weekly_coefficients(coefficients: DataFrame) -> DataFrame:
    factors = {f"factor_{d}": F.round(F.get("weekly", F.lit(d - 1)), 6) for d in trend_weekly.WEEKDAYS}
    return (
        _rounded(coefficients, 3, "intercept", "sigma")
        .withColumn("slope", F.round("slope", 6))
        .withColumns(factors)
        .drop("weekly")
    )


def fit_trend_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weekly_coefficients(_weekly_model(spark, sf_dir)[1])


def score_trend_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    series, coefficients = _weekly_model(spark, sf_dir)
    scored = trend_weekly.score_trend_weekly(series, coefficients)
    return _rounded(scored, 3, *PREDICTED).select(TICKER_ID, "ds", "trend", "yhat")


def components_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, coefficients = _weekly_model(spark, sf_dir)
    return _rounded(trend_weekly.weekly_profile(coefficients), 6, "effect")


def forecast_interval_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    series, coefficients = _weekly_model(spark, sf_dir)
    future = series_ops.future_spine(series)
    scored = trend_weekly.score_trend_weekly(future, coefficients, level=0.95)
    return _rounded(scored, 3, *PREDICTED).drop("trend")


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weekly_forecast(spark, sf_dir)[2]


def fit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    series, coefficients = _weekly_model(spark, sf_dir)
    found = training.metrics(series, coefficients, training.TREND_WEEKLY)
    return _rounded(found, 4, "mae", "mse", "rmse", "r2", "mape")


def actual_vs_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    series, _, predicted = _weekly_forecast(spark, sf_dir)
    return metrics.actual_vs_predicted(predicted, series)


def yhat_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = settle(_weekly_forecast(spark, sf_dir)[2], "forecast")
    ranges = settle(metrics.value_range(predicted), "ranges")
    return _rounded(metrics.histogram(predicted, ranges), 4, "bin_start", "bin_end")


def yhat_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = settle(_weekly_forecast(spark, sf_dir)[2], "forecast")
    ranges = settle(metrics.value_range(predicted), "ranges")
    found = metrics.density(predicted, ranges)
    return found.withColumns({"at": F.round("at", 4), "density": F.round("density", 9)})


def forecast_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = _weekly_forecast(spark, sf_dir)[2]
    return lookup.forecast_info(predicted.withColumn("run_ts", F.lit(RUN_TS)))


# -------------------------------------------------------------------- lookups


def validate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, known = _weekly_model(spark, sf_dir)
    points = lookup.check_points(testtables.point_requests(spark, sf_dir), known)
    ranges = lookup.check_ranges(testtables.range_requests(spark, sf_dir), known)
    return points.select(F.lit("point").alias("kind"), "request_id", "reason").unionByName(
        ranges.select(F.lit("range").alias("kind"), "request_id", "reason")
    )


def predict_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, coefficients, predicted = _weekly_forecast(spark, sf_dir)
    answers = lookup.predict_points(
        testtables.point_requests(spark, sf_dir),
        settle(predicted, "forecast"),
        training.TREND_WEEKLY.scorer(coefficients),
        coefficients,
    )
    return _rounded(answers, 3, "predicted_price", "lower_bound", "upper_bound", "trend")


def _range_answers(spark: SparkSession, sf_dir: str, fill_gaps: bool) -> DataFrame:
    _, coefficients, predicted = _weekly_forecast(spark, sf_dir)
    answers = lookup.predict_ranges(
        testtables.range_requests(spark, sf_dir),
        settle(predicted, "forecast"),
        training.TREND_WEEKLY.scorer(coefficients),
        coefficients,
        fill_gaps,
    )
    return _rounded(answers, 3, "predicted_price", "lower_bound", "upper_bound", "trend")


def predict_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _range_answers(spark, sf_dir, fill_gaps=False)


def predict_range_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _range_answers(spark, sf_dir, fill_gaps=True)


# ---------------------------------------------------------- decomposable model


def start_decomposable(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = decomposable.starting_state(_series(spark, sf_dir))
    return state.select(
        TICKER_ID,
        "n",
        "t0",
        "t1",
        F.round("y_scale", 6).alias("y_scale"),
        F.round(F.get("theta", F.lit(0)), 6).alias("slope"),
        F.round(F.get("theta", F.lit(1)), 6).alias("offset"),
        F.posexplode("knots").alias("place", "knot"),
    ).withColumn("knot", F.round("knot", 9))


def gram_decomposable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summed Gram matrix of the first pass, entry by entry."""
    series = _series(spark, sf_dir)
    state = settle(decomposable.starting_state(series), "model-state")
    partials = decomposable.gram_partials(decomposable.year_blocks(series), state)
    return (
        partials.select(TICKER_ID, F.posexplode("gram").alias("place", "value"))
        .groupBy(TICKER_ID, "place")
        .agg(F.round(F.sum("value"), 4).alias("value"))
    )


def _given_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Series, and coefficients both engines can state: the straight-line start with a bend at
    every changepoint and a share of every wave."""
    series = _series(spark, sf_dir)
    state = settle(decomposable.starting_state(series), "model-state")
    spec = decomposable.DEFAULT_SPEC
    bends = F.transform(F.sequence(F.lit(1), F.lit(spec.changepoints)), lambda j: (j - 13) / 100)
    waves = F.transform(F.sequence(F.lit(1), F.lit(spec.terms - spec.trend_terms)), lambda j: 1 / (100.0 + j))
    given = decomposable.with_segments(
        state.withColumn("theta", F.concat(F.slice("theta", 1, 2), bends, waves))
    ).withColumn("sigma", F.col("y_scale") / 100)
    return series, given


def score_decomposable(spark: SparkSession, sf_dir: str) -> DataFrame:
    series, given = _given_model(spark, sf_dir)
    axis = series_ops.forecast_axis(series)
    scored = decomposable.score_decomposable(axis, given, components=True)
    scored = _rounded(scored, 2, *PREDICTED, "trend_lower", "trend_upper")
    return _rounded(scored, 8, *decomposable.COMPONENTS)


def forecast_interval_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    series, given = _given_model(spark, sf_dir)
    scored = decomposable.score_decomposable(series_ops.future_spine(series), given, level=0.95)
    return _rounded(scored, 2, *PREDICTED).drop("trend")


def components_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(decomposable.seasonal_profiles(_given_model(spark, sf_dir)[1]), 8, "effect")


def fit_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and error of the straight line per ticker, and whether the fit is no worse than that line."""
    series, coefficients = _decomposable_model(spark, sf_dir)
    day = F.unix_date("ds").cast("double")
    line = series.groupBy(TICKER_ID).agg(
        F.sqrt((F.regr_syy("y", day) - F.regr_sxy("y", day) * F.regr_slope("y", day)) / F.count("*")).alias("rmse_line")
    )
    return coefficients.join(line, TICKER_ID).select(
        TICKER_ID,
        "n",
        F.round("rmse_line", 3).alias("rmse_line"),
        (F.col("objective") <= F.col("objective_start")).alias("objective_no_worse"),
        (F.col("sigma") <= F.col("rmse_line")).alias("rmse_no_worse"),
    )


def fit_decomposable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decomposable_model(spark, sf_dir)[1]


def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    series, coefficients = _decomposable_model(spark, sf_dir)
    return decomposable.score_decomposable(series, coefficients)


def forecast_decomposable(spark: SparkSession, sf_dir: str) -> DataFrame:
    series, coefficients = _decomposable_model(spark, sf_dir)
    axis = series_ops.forecast_axis(series)
    return decomposable.score_decomposable(axis, coefficients, components=True)


def forecast_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    series, coefficients = _decomposable_model(spark, sf_dir)
    future = series_ops.future_spine(series)
    return decomposable.score_decomposable(future, coefficients, level=0.95).drop("trend")


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decomposable.seasonal_profiles(_decomposable_model(spark, sf_dir)[1])


def train_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "runs")
    run = training.train_all(_encoded_bars(spark, sf_dir), root, RUN_TS)
    return run.metrics.withColumn("run_ts", F.lit(run.run_ts))


def train_all_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the stored run: its tickers, counts and dates."""
    root = scratch_path(spark, "runs")
    run = training.train_all(_encoded_bars(spark, sf_dir), root, RUN_TS)
    stored = lookup.forecast_info(run.forecast.withColumn("run_ts", F.lit(run.run_ts)))
    return stored.join(run.metrics.select(TICKER_ID, "n", "n_zero_y"), TICKER_ID)


# ------------------------------------------- sinks, read back from the shared folder


def land_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.land_raw(spark, sf_dir, scratch_path(spark, "raw"), files="{customer,supplier}.parquet")


def write_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole clean job: raw table to dictionary and cleaned table."""
    paths = [scratch_path(spark, name) for name in ("raw", "cleaned", "tickers")]
    _raw(spark, sf_dir).write.parquet(paths[0])
    return _rounded(cleaning.run_clean(spark, *paths), 6, "Daily_Return")


def _second_clean(spark: SparkSession, sf_dir: str) -> cleans.CleanVersion:
    """A version of the later tickers alone, then one of all: the earlier ones come as new."""
    some, every, root = (scratch_path(spark, name) for name in ("raw-some", "raw-every", "cleans"))
    raw = _raw(spark, sf_dir)
    raw.where("Ticker >= 'J'").write.parquet(some)
    raw.write.parquet(every)
    cleaning.clean_version(spark, some, root, "20240101_000000")
    return cleaning.clean_version(spark, every, root, "20240102_000000")


def clean_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned rows of a second version, with the names of their ids."""
    second = _second_clean(spark, sf_dir)
    return _rounded(second.cleaned.join(second.tickers, TICKER_ID, "left"), 6, "Daily_Return")


def stable_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _second_clean(spark, sf_dir).tickers


def clean_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _second_clean(spark, sf_dir).counts


def forecast_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "forecast-csv")
    runs.write_forecast_csv(_weekly_forecast(spark, sf_dir)[2].select(*FORECAST.fieldNames()), path)
    return runs.read_forecast_csv(spark, path)


def metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "metrics-json")
    runs.write_metrics_json(fit_metrics(spark, sf_dir), path)
    return runs.read_metrics_json(spark, path)


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole train job with the trend and weekday model, and the stored forecast."""
    root = scratch_path(spark, "runs")
    training.train_all(_encoded_bars(spark, sf_dir), root, RUN_TS, training.TREND_WEEKLY)
    run = runs.load_run(spark, root)
    return _rounded(run.forecast.withColumn("run_ts", F.lit(run.run_ts)), 3, *PREDICTED)


def load_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients through write, pointer and read, after a second run took the place of the first."""
    root = scratch_path(spark, "runs")
    bars = settle(_encoded_bars(spark, sf_dir), "encoded")
    training.train_all(series_ops.keep_most_common(bars), root, RUN_TS, training.TREND_WEEKLY)
    training.train_all(bars, root, LATER_RUN_TS, training.TREND_WEEKLY)
    run = runs.load_run(spark, root)
    return _weekly_coefficients(run.coefficients).withColumn("run_ts", F.lit(run.run_ts))


QUERIES: dict[str, Query] = {
    "scan_raw": scan_raw,
    "scan_cleaned": scan_cleaned,
    "union_files": union_files,
    "dedup_rows": dedup_rows,
    "distinct_tickers": distinct_tickers,
    "encode_ticker": encode_ticker,
    "drop_nulls": drop_nulls,
    "parse_dates": parse_dates,
    "scrub_numeric_compat": scrub_numeric_compat,
    "scrub_numeric": scrub_numeric,
    "daily_return": daily_returns,
    "daily_return_trades": daily_return_trades,
    "clean_prices": clean_prices,
    "clean_prices_compat": clean_prices_compat,
    "clean_sample": clean_sample,
    "clean_report": clean_report,
    "most_common_ticker": most_common_ticker,
    "keep_most_common": keep_most_common,
    "training_series": training_series,
    "series_range": series_range,
    "future_spine": future_spine,
    "fit_trend_weekly": fit_trend_weekly,
    "score_trend_weekly": score_trend_weekly,
    "components_weekly": components_weekly,
    "forecast_interval_weekly": forecast_interval_weekly,
    "forecast": forecast,
    "metrics": fit_metrics,
    "actual_vs_predicted": actual_vs_predicted,
    "yhat_histogram": yhat_histogram,
    "yhat_density": yhat_density,
    "forecast_info": forecast_info,
    "validate_requests": validate_requests,
    "predict_point": predict_point,
    "predict_range": predict_range,
    "predict_range_filled": predict_range_filled,
    "start_decomposable": start_decomposable,
    "gram_decomposable": gram_decomposable,
    "score_decomposable": score_decomposable,
    "forecast_interval_given": forecast_interval_given,
    "components_given": components_given,
    "fit_quality": fit_quality,
    "fit_decomposable": fit_decomposable,
    "score": score,
    "forecast_decomposable": forecast_decomposable,
    "forecast_interval": forecast_interval,
    "components": components,
    "train_all": train_all,
    "train_all_keys": train_all_keys,
    "load_model": load_model,
    "land_raw": land_raw,
    "write_cleaned": write_cleaned,
    "clean_version": clean_version,
    "stable_tickers": stable_tickers,
    "clean_counts": clean_counts,
    "forecast_csv_roundtrip": forecast_csv_roundtrip,
    "metrics_json": metrics_json,
    "latest_run": latest_run,
}
