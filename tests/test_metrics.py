from __future__ import annotations

import math

import numpy as np
import pytest

from quotemill.operators import metrics


def scored(spark, rows):
    return spark.createDataFrame([(t, float(y), float(p)) for t, y, p in rows], "ticker_id int, y double, yhat double")


def test_metrics_by_hand(spark):
    rows = [(1, 1, 1), (1, 2, 4), (1, 3, 3), (2, 0, 1), (2, 4, 3), (3, 5, 5), (3, 5, 5), (4, 5, 6), (4, 5, 4), (5, 1, 2)]
    found = {r.ticker_id: r for r in metrics.error_metrics(scored(spark, rows)).collect()}
    one = found[1]
    assert (one.n, one.n_zero_y, one.r2) == (3, 0, -1.0)
    assert one.mae == pytest.approx(2 / 3)
    assert one.mse == pytest.approx(4 / 3)
    assert one.rmse == pytest.approx(math.sqrt(4 / 3))
    assert one.mape == pytest.approx(100 / 3)
    assert (found[2].n_zero_y, found[2].mape) == (1, 25.0)
    assert (found[3].r2, found[4].r2, found[5].r2) == (1.0, 0.0, None)


def predictions(spark, values):
    return spark.createDataFrame([(t, float(v)) for t, vs in values.items() for v in vs], "ticker_id int, yhat double")


def test_histogram_matches_numpy_and_keeps_every_row(spark):
    rng = np.random.default_rng(1)
    values = {1: rng.normal(100, 10, 500), 2: rng.uniform(-3, 7, 77)}
    forecast = predictions(spark, values)
    out = metrics.histogram(forecast, metrics.value_range(forecast)).collect()
    for ticker, data in values.items():
        counts = [r.n for r in sorted((r for r in out if r.ticker_id == ticker), key=lambda r: r.bin)]
        assert counts == list(np.histogram(data, bins=50)[0])


def test_histogram_of_equal_values_fills_bin_zero(spark):
    forecast = predictions(spark, {1: [4, 4, 4]})
    out = metrics.histogram(forecast, metrics.value_range(forecast)).collect()
    assert {r.bin: r.n for r in out if r.n} == {0: 3}
    assert len(out) == 50


def test_density_matches_the_formula(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(5, 2, 300)
    forecast = predictions(spark, {1: data, 2: [1, 1]})
    out = metrics.density(forecast, metrics.value_range(forecast)).collect()
    assert {r.ticker_id for r in out} == {1}
    grid = np.linspace(data.min(), data.max(), 200)
    width = len(data) ** -0.2 * data.std(ddof=1)
    expected = np.exp(-(((grid[:, None] - data) / width) ** 2) / 2).sum(axis=1) / (len(data) * width * np.sqrt(2 * np.pi))
    found = [r.density for r in sorted(out, key=lambda r: r.point)]
    np.testing.assert_allclose(found, expected, rtol=1e-9)
