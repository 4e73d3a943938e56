"""Lookup jobs: request tables against a stored run."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quotemill.operators import lookup
from quotemill.plans.training import MODELS, Model
from quotemill.schemas import TICKER
from quotemill.sources.runs import Run


def _scorer(run: Run, model: Model | None) -> lookup.Score:
    """The scoring of the given model, or else of the one the run was fitted with."""
    return (model or MODELS[run.model]).scorer(run.coefficients)


def by_ticker_id(requests: DataFrame, run: Run) -> DataFrame:
    """Requests that give a ``Ticker`` name, with the id it has in this run; an unknown name has none and is rejected.

    The names are a stored table, so their size decides the join; a hot name is split at run time.
    """
    if run.tickers is None:
        raise ValueError(f"run {run.run_ts} was stored without ticker names")
    return requests.join(run.tickers, TICKER, "left").drop(TICKER)


def answer_points(requests: DataFrame, run: Run, model: Model | None = None) -> tuple[DataFrame, DataFrame]:
    """Predictions and rejects of a table of point requests."""
    answers = lookup.predict_points(
        requests, run.forecast, _scorer(run, model), run.coefficients
    )
    return answers, lookup.rejects(lookup.check_points(requests, run.coefficients))


def answer_ranges(
    requests: DataFrame, run: Run, model: Model | None = None, fill_gaps: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Predictions and rejects of a table of range requests."""
    answers = lookup.predict_ranges(
        requests, run.forecast, _scorer(run, model), run.coefficients, fill_gaps
    )
    return answers, lookup.rejects(lookup.check_ranges(requests, run.coefficients))
