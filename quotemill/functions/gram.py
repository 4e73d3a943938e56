"""Matrix work of the decomposable model inside the Python workers.

Two functions over pandas batches: blocks of days to partial Gram matrices, and a ticker's blocks,
bounded by the calendar, to its coefficients.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date

import numpy as np
import pandas as pd
from pyspark import cloudpickle

# workers get these functions whole, and need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WEEK = 7.0
YEAR = 365.25


@dataclass(frozen=True)
class ModelSpec:
    """The reference's settings and the published defaults behind them."""

    changepoints: int = 25
    changepoint_range: float = 0.8
    changepoint_prior: float = 0.05
    seasonality_prior: float = 10.0
    trend_prior: float = 5.0
    weekly_order: int = 3
    yearly_order: int = 10
    tolerance: float = 1e-9
    # a ticker that needs more is stored with ``converged`` false, counted in the run, and not served
    most_passes: int = 2000

    @property
    def trend_terms(self) -> int:
        return 2 + self.changepoints

    @property
    def terms(self) -> int:
        return self.trend_terms + 2 * (self.weekly_order + self.yearly_order)


_EPOCH = date(1970, 1, 1)
_PERFECT = 1e-14  # mean squared error, with the largest value at 1
_LEAST_VARIANCE = 1e-8
_STATE = ["ticker_id", "n", "t0", "t1", "y_scale", "knots", "theta"]
_PARTIAL = [*_STATE, "gram", "moment", "sse"]


def _design(days: np.ndarray, t: np.ndarray, knots: np.ndarray, spec: ModelSpec) -> tuple[np.ndarray, np.ndarray]:
    """Trend columns and seasonal columns of a block of days."""
    trend = np.column_stack([t, np.ones_like(t), np.maximum(t[:, None] - knots[None, :], 0.0)])
    waves = []
    for period, order in ((WEEK, spec.weekly_order), (YEAR, spec.yearly_order)):
        angle = 2 * np.pi * days[:, None] * np.arange(1, order + 1)[None, :] / period
        waves += [np.sin(angle), np.cos(angle)]
    return trend, np.column_stack(waves)


def _block_partial(block, spec: ModelSpec) -> tuple[np.ndarray, np.ndarray, float]:
    """JᵀJ, Jᵀr and rᵀr of one block at the current coefficients."""
    days = np.asarray(block.days, dtype=float)
    first, last = ((day - _EPOCH).days for day in (block.t0, block.t1))
    theta = np.asarray(block.theta)
    trend, waves = _design(days, (days - first) / (last - first), np.asarray(block.knots), spec)
    level = trend @ theta[: spec.trend_terms]
    season = waves @ theta[spec.trend_terms :]
    residual = np.asarray(block.values, dtype=float) / block.y_scale - level * (1 + season)
    jacobian = np.column_stack([trend * (1 + season)[:, None], waves * level[:, None]])
    return jacobian.T @ jacobian, jacobian.T @ residual, float(residual @ residual)


def block_partials(spec: ModelSpec) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Batches of blocks to one partial per ticker of the batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = {}
            for block in batch.itertuples(index=False):
                gram, moment, sse = _block_partial(block, spec)
                row = rows.get(block.ticker_id)
                if row is None:
                    rows[block.ticker_id] = [*(getattr(block, name) for name in _STATE), gram, moment, sse]
                else:
                    row[-3] += gram
                    row[-2] += moment
                    row[-1] += sse
            for row in rows.values():
                row[-3] = row[-3].ravel()
            yield pd.DataFrame(list(rows.values()), columns=_PARTIAL)

    return run


def _objective(theta: np.ndarray, sse: float, n: int, spec: ModelSpec) -> float:
    """Negative log posterior with the residual variance profiled out."""
    rates, seasons = theta[2 : spec.trend_terms], theta[spec.trend_terms :]
    priors = theta[:2] @ theta[:2] / (2 * spec.trend_prior**2) + seasons @ seasons / (2 * spec.seasonality_prior**2)
    return n / 2 * np.log(max(sse / n, _LEAST_VARIANCE)) + priors + np.abs(rates).sum() / spec.changepoint_prior


def descend(
    trend: np.ndarray, waves: np.ndarray, y: np.ndarray, theta: np.ndarray, spec: ModelSpec
) -> tuple[np.ndarray, int, bool, float, float]:
    """Damped Gauss-Newton: coefficients, passes, whether it converged, the objective at the end and at the start.

    A ridge meets the normal priors, a reweighted ridge the double-exponential one of the rate changes. A step counts
    only if the objective falls; otherwise the damping grows and the step is tried again, shorter. It ends when
    no step helps or helps by less than ``spec.tolerance``.
    """
    n, k = len(y), spec.trend_terms

    def state(theta: np.ndarray):
        level, season = trend @ theta[:k], waves @ theta[k:]
        residual = y - level * (1 + season)
        return level, season, residual, _objective(theta, float(residual @ residual), n, spec)

    level, season, residual, value = state(theta)
    start, damping, passes, small = value, 1e-3, 0, 0
    penalty = np.full(spec.terms, 1 / spec.seasonality_prior**2)
    penalty[:2] = 1 / spec.trend_prior**2
    while residual @ residual / n >= _PERFECT and passes < spec.most_passes:
        passes += 1
        jacobian = np.column_stack([trend * (1 + season)[:, None], waves * level[:, None]])
        variance = max(float(residual @ residual) / n, _LEAST_VARIANCE)
        penalty[2:k] = 1 / (spec.changepoint_prior * np.maximum(np.abs(theta[2:k]), 1e-4))
        matrix = jacobian.T @ jacobian + variance * np.diag(penalty)
        down = jacobian.T @ residual - variance * penalty * theta
        moved = False
        while damping < 1e12:
            new = theta + np.linalg.solve(matrix + damping * np.diag(np.diag(matrix) + 1e-12), down)
            tried = state(new)
            if np.isfinite(tried[3]) and tried[3] < value:
                moved = True
                break
            damping *= 10
        if not moved:
            return theta, passes, True, value, start
        gain = value - tried[3]
        theta, (level, season, residual, value) = new, tried
        damping = max(damping / 10, 1e-12)
        small = small + 1 if gain < spec.tolerance * (1 + abs(value)) else 0
        if small == 3:
            return theta, passes, True, value, start
    return theta, passes, bool(residual @ residual / n < _PERFECT), value, start


def fit_ticker(spec: ModelSpec) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """All year blocks of a ticker, with its starting state, to its fitted state."""

    def run(blocks: pd.DataFrame) -> pd.DataFrame:
        first = blocks.iloc[0]
        days = np.concatenate([np.asarray(d, dtype=float) for d in blocks["days"]])
        y = np.concatenate([np.asarray(v, dtype=float) for v in blocks["values"]]) / first["y_scale"]
        order = np.argsort(days, kind="stable")
        days, y = days[order], y[order]
        low, high = ((day - _EPOCH).days for day in (first["t0"], first["t1"]))
        trend, waves = _design(days, (days - low) / (high - low), np.asarray(first["knots"]), spec)
        theta, passes, converged, value, start = descend(trend, waves, y, np.asarray(first["theta"], dtype=float), spec)
        found = {name: [first[name]] for name in _STATE}
        found |= {"theta": [theta], "passes": [passes], "converged": [converged], "objective": [value], "objective_start": [start]}
        return pd.DataFrame(found)

    return run
