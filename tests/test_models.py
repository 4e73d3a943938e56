from __future__ import annotations

import datetime as dt
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.functions import gram
from quotemill.functions.gram import ModelSpec
from quotemill.operators import decomposable, series as series_ops, trend_weekly

START = dt.date(2015, 1, 1)
SERIES = "ticker_id int, ds date, y double"
EPOCH = dt.date(1970, 1, 1)


def day_numbers(n: int) -> np.ndarray:
    return np.arange(n) + (START - EPOCH).days


def series_of(spark, **tickers):
    rows = []
    for name, values in tickers.items():
        rows += [(int(name[1:]), START + dt.timedelta(i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["ticker_id", "ds", "y"]), SERIES)


def known_series(n=2500, seed=7) -> np.ndarray:
    """Trend with one bend, a yearly and a weekly wave, noise of spread 1."""
    t, day = np.arange(n) / (n - 1), day_numbers(n)
    level = 100 + 40 * t - 90 * np.maximum(t - 0.4, 0)
    season = 0.05 * np.sin(2 * np.pi * day / 365.25) + 0.02 * np.sin(4 * np.pi * day / 7)
    return level * (1 + season) + np.random.default_rng(seed).normal(0, 1, n)


@pytest.fixture(scope="module")
def fitted(spark):
    series = series_of(spark, t1=known_series(), t2=known_series(1200, seed=8) * 3, t3=[5.0, 6.0], t4=[5.0])
    series = series.repartition(5).cache()
    return series, decomposable.fit_decomposable(series)


# ------------------------------------------------------- trend and weekday model


def test_weekly_fit_is_least_squares(spark):
    n = 400
    y = known_series(n)
    series = series_of(spark, t1=y, t2=[3.0])
    (row,) = trend_weekly.fit_trend_weekly(series).collect()
    slope, intercept = np.polyfit(np.arange(n), y, 1)
    assert (row.ticker_id, row.n, row.t0) == (1, n, START)
    assert (row.slope, row.intercept) == (pytest.approx(slope), pytest.approx(intercept))
    trend = intercept + slope * np.arange(n)
    weekday = np.array([(START + dt.timedelta(i)).isoweekday() % 7 for i in range(n)])
    factors = [(y * trend)[weekday == d].sum() / (trend * trend)[weekday == d].sum() for d in range(7)]
    np.testing.assert_allclose(row.weekly, factors, rtol=1e-9)
    assert row.sigma == pytest.approx(np.sqrt(np.mean((y - trend * np.array(factors)[weekday]) ** 2)))


def test_factors_stay_bounded_where_the_trend_crosses_zero(spark):
    series = series_of(spark, t1=[100.0] * 30 + [2.0] * 60)
    (row,) = trend_weekly.fit_trend_weekly(series).collect()
    assert row.intercept + row.slope * 89 < 0 < row.intercept
    assert all(0.5 < factor < 1.5 for factor in row.weekly)


def test_weekday_without_data_has_factor_one(spark):
    series = series_of(spark, t1=[1.0, 2.0, 3.0])
    (row,) = trend_weekly.fit_trend_weekly(series).collect()
    assert sorted(row.weekly)[:4] == [pytest.approx(1.0)] * 4 and len(row.weekly) == 7


def test_weekly_bounds_hold_the_level(spark):
    series = series_of(spark, t1=known_series(300))
    scored = trend_weekly.score_trend_weekly(series, trend_weekly.fit_trend_weekly(series), level=0.8)
    rows = scored.collect()
    assert all(r.yhat_lower < r.yhat < r.yhat_upper for r in rows)
    assert (rows[0].yhat_upper - rows[0].yhat) / trend_weekly.z_score(0.8) == pytest.approx(
        np.sqrt(np.mean([(r.y - r.yhat) ** 2 for r in rows]))
    )


# ---------------------------------------------------------- decomposable model


def test_known_series_is_recovered(fitted):
    _, coefficients = fitted
    found = {r.ticker_id: r for r in coefficients.collect()}
    assert set(found) == {1, 2, 3}
    assert 0.95 < found[1].sigma < 1.05
    assert 2.85 < found[2].sigma < 3.15
    bend = sum(found[1].theta[2:27])
    assert bend == pytest.approx(-90 / found[1].y_scale, abs=0.15)


def test_a_ticker_alone_equals_the_ticker_in_the_batch(spark, fitted):
    series, coefficients = fitted
    alone = decomposable.fit_decomposable(series.where("ticker_id = 2")).first()
    batch = coefficients.where("ticker_id = 2").first()
    np.testing.assert_allclose(alone.theta, batch.theta, rtol=1e-6, atol=1e-9)
    assert alone.sigma == pytest.approx(batch.sigma)


def design(n, knots, spec=ModelSpec()):
    t, day = np.arange(n) / (n - 1), day_numbers(n)
    trend = [t, np.ones(n), *(np.maximum(t - k, 0) for k in knots)]
    waves = []
    for period, order in ((7, spec.weekly_order), (365.25, spec.yearly_order)):
        for wave in (np.sin, np.cos):
            waves += [wave(2 * np.pi * k * day / period) for k in range(1, order + 1)]
    return np.array(trend).T, np.array(waves).T


def test_gram_of_all_partials_equals_one_matrix_product(spark, fitted):
    series, coefficients = fitted
    state = coefficients.select(*decomposable.STATE.fieldNames()).where("ticker_id = 1")
    parts = decomposable.gram_partials(decomposable.year_blocks(series), state).toPandas()
    row = state.first()
    trend, waves = design(2500, row.knots)
    theta = np.array(row.theta)
    level, season = trend @ theta[:27], waves @ theta[27:]
    jacobian = np.hstack([trend * (1 + season)[:, None], waves * level[:, None]])
    residual = known_series() / row.y_scale - level * (1 + season)
    np.testing.assert_allclose(np.sum(parts["gram"].to_list(), axis=0).reshape(53, 53), jacobian.T @ jacobian, rtol=1e-8, atol=1e-7)
    np.testing.assert_allclose(np.sum(parts["moment"].to_list(), axis=0), jacobian.T @ residual, rtol=1e-6, atol=1e-7)
    assert parts["sse"].sum() == pytest.approx(residual @ residual)


def test_scoring_columns_equal_the_matrix_form(fitted):
    series, coefficients = fitted
    row = coefficients.where("ticker_id = 1").first()
    trend, waves = design(2500, row.knots)
    theta = np.array(row.theta)
    level, season = trend @ theta[:27] * row.y_scale, waves @ theta[27:]
    scored = decomposable.score_decomposable(series.where("ticker_id = 1"), coefficients, components=True)
    scored = scored.orderBy("ds").toPandas()
    np.testing.assert_allclose(scored["trend"], level, rtol=1e-9)
    np.testing.assert_allclose(scored["multiplicative_terms"], season, rtol=1e-7, atol=1e-9)
    np.testing.assert_allclose(scored["yhat"], level * (1 + season), rtol=1e-9)


@pytest.mark.parametrize("days", [2, 20, 60, 120, 250, 365, 730])
def test_the_fit_never_ends_worse_than_the_line(days):
    rng = np.random.default_rng(days)
    spec = ModelSpec()
    for walk in range(6):
        y = 100 * np.exp(np.cumsum(rng.normal(0, 0.01 + 0.01 * walk, days)))
        y /= y.max()
        t = np.arange(days) / (days - 1)
        part = int(days * 0.8)
        used = max(0, min(25, part - 1))
        knots = np.array([round(j * (part - 1) / used) / (days - 1) if j <= used else 1.0 for j in range(1, 26)])
        trend, waves = gram._design(day_numbers(days).astype(float), t, knots, spec)
        line = np.zeros(spec.terms)
        line[:2] = np.polyfit(t, y, 1)
        theta, _, converged, value, start = gram.descend(trend, waves, y, line, spec)
        assert converged and value <= start and np.isfinite(theta).all()
        fitted = (trend @ theta[:27]) * (1 + waves @ theta[27:])
        assert np.sqrt(np.mean((y - fitted) ** 2)) <= np.sqrt(np.mean((y - trend @ line[:27]) ** 2)) * 1.02 + 1e-9
        # no small step in any direction leads further down by more than the tolerance of the descent
        for step in rng.normal(0, 1e-4, (40, spec.terms)) * (np.abs(theta) + 1e-3):
            moved = theta + step
            residual = y - (trend @ moved[:27]) * (1 + waves @ moved[27:])
            assert gram._objective(moved, float(residual @ residual), days, spec) >= value - 1e-3 * (1 + abs(value))


def test_how_the_descent_ended_is_stored(fitted):
    _, coefficients = fitted
    for row in coefficients.collect():
        assert row.converged and row.objective <= row.objective_start


def test_changepoints_sit_on_observed_days(fitted):
    _, coefficients = fitted
    row = coefficients.where("ticker_id = 1").first()
    places = np.linspace(0, int(2500 * 0.8) - 1, 26).round()[1:]
    np.testing.assert_allclose(row.knots, places / 2499)
    short = coefficients.where("ticker_id = 3").first()
    assert short.knots == [1.0] * 25 and short.rate == 0


def test_bounds_widen_after_the_history_by_the_closed_form(spark, fitted):
    series, coefficients = fitted
    one = series.where("ticker_id = 1")
    future = series_ops.future_spine(one, 365)
    rows = decomposable.score_decomposable(future, coefficients, components=True).orderBy("ds").collect()
    row = coefficients.where("ticker_id = 1").first()
    widths = [r.yhat_upper - r.yhat_lower for r in rows]
    assert widths == sorted(widths) or widths[-1] > widths[0]
    last = rows[-1]
    ahead = 365 / 2499
    drift = 2 * row.rate_change**2 * row.rate * ahead**3 / 3 * row.y_scale**2
    half = trend_weekly.z_score(0.8) * np.sqrt(row.sigma**2 + (1 + last.multiplicative_terms) ** 2 * drift)
    assert last.yhat_upper - last.yhat == pytest.approx(half)
    inside = decomposable.score_decomposable(one, coefficients).first()
    assert inside.yhat_upper - inside.yhat == pytest.approx(trend_weekly.z_score(0.8) * row.sigma)


def test_drift_variance_agrees_with_simulated_paths():
    """Rate changes at random times with double-exponential sizes, as the bounds assume."""
    rng = np.random.default_rng(3)
    rate, size, ahead = 25.0, 0.04, 0.3
    paths = []
    for _ in range(40_000):
        times = rng.uniform(0, ahead, rng.poisson(rate * ahead))
        paths.append(np.sum(rng.laplace(0, size, times.size) * (ahead - times)))
    assert np.var(paths) == pytest.approx(2 * size**2 * rate * ahead**3 / 3, rel=0.06)


def test_profiles_repeat_the_scored_effects(fitted):
    series, coefficients = fitted
    profiles = decomposable.seasonal_profiles(coefficients).where("ticker_id = 1")
    assert profiles.groupBy("component").count().orderBy("component").collect() == [("weekly", 7), ("yearly", 365)]
    sunday = profiles.where("component = 'weekly' and place = 0").first().effect
    scored = decomposable.score_decomposable(series.where("ticker_id = 1"), coefficients, components=True)
    effects = scored.where(F.dayofweek("ds") == 1).select("weekly").distinct().collect()
    assert all(r.weekly == pytest.approx(sunday) for r in effects)


def test_workers_need_no_installed_package(tmp_path):
    """The fit runs from a folder where the package cannot be imported."""
    root = Path(__file__).resolve().parents[1]
    script = tmp_path / "fit.py"
    script.write_text(
        f"import sys; sys.path.insert(0, {str(root)!r})\n"
        "from pyspark.sql import SparkSession, functions as F\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
        ".config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "from quotemill.operators.decomposable import fit_decomposable\n"
        "days = spark.range(100).select(F.lit(1).alias('ticker_id'),"
        " F.date_add(F.lit('2020-01-01').cast('date'), F.col('id').cast('int')).alias('ds'),"
        " (F.col('id') + 10.0).alias('y'))\n"
        "print('rows', fit_decomposable(days).count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 1" in done.stdout, done.stderr[-2000:]


def test_degenerate_series_get_finite_predictions(spark):
    """Constant, zero, negative and two-day histories, gaps, and days far from 1970."""
    rows = []
    for day in range(40):
        rows += [(1, START + dt.timedelta(day), 5.0), (2, START + dt.timedelta(day), 0.0)]
        rows += [(3, START + dt.timedelta(day), -7.0 - day), (4, dt.date(1901, 1, 1) + dt.timedelta(day * 97), 3.0 + day % 5)]
        rows += [(5, dt.date(2400, 1, 1) + dt.timedelta(day), 1e9 + day)]
    rows += [(6, START, 1e-6), (6, START + dt.timedelta(400), 2e-6)]
    series = spark.createDataFrame(rows, SERIES)
    axis = series_ops.forecast_axis(series, 30)
    for scored in (
        decomposable.score_decomposable(axis, decomposable.fit_decomposable(series)),
        trend_weekly.score_trend_weekly(axis, trend_weekly.fit_trend_weekly(series)),
    ):
        found = scored.toPandas()
        assert len(found) == len(rows) + 6 * 30
        values = found[["trend", "yhat", "yhat_lower", "yhat_upper"]].to_numpy(dtype=float)
        assert np.isfinite(values).all()
        assert (found["yhat_lower"] <= found["yhat"]).all() and (found["yhat"] <= found["yhat_upper"]).all()
        flat = found[found["ticker_id"] == 1]
        np.testing.assert_allclose(flat["yhat"], 5.0, atol=0.05)
