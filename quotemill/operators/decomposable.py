"""Decomposable model ``yhat = g(t) * (1 + s(t))``, fitted for every ticker at once.

``g`` is a piecewise-linear trend with changepoints, ``s`` the sum of a weekly and a yearly
Fourier series (Taylor & Letham, "Forecasting at Scale", The American Statistician 72(1), 2018).
``t`` runs from 0 to 1 over a ticker's history and ``y`` is divided by its largest absolute
value while fitting.

The series is kept as one row per ticker and calendar year. These rows, at most a calendar's days, are brought
together per ticker and fitted by damped Gauss-Newton steps. Scoring is column arithmetic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

from quotemill.functions.gram import WEEK, YEAR, ModelSpec, block_partials, fit_ticker
from quotemill.operators.trend_weekly import z_score
from quotemill.schemas import TICKER_ID, table_schema
from quotemill.session import settle

DEFAULT_SPEC = ModelSpec()

_doubles = T.ArrayType(T.DoubleType())


# theta: slope, offset, one rate change per changepoint, then weekly and yearly terms
STATE = table_schema(
    ticker_id=T.IntegerType(),
    n=T.LongType(),
    t0=T.DateType(),
    t1=T.DateType(),
    y_scale=T.DoubleType(),
    knots=_doubles,
    theta=_doubles,
)
FITTED = T.StructType(
    STATE.fields
    + table_schema(
        passes=T.IntegerType(), converged=T.BooleanType(), objective=T.DoubleType(), objective_start=T.DoubleType()
    ).fields
)
PARTIAL = T.StructType(
    STATE.fields + table_schema(gram=_doubles, moment=_doubles, sse=T.DoubleType()).fields
)


# ---------------------------------------------------------------- preparation


def year_blocks(series: DataFrame) -> DataFrame:
    """One row per ticker and calendar year with arrays of at most 366 days and values.

    Tickers are kept together on disk, so that their partials merge before the shuffle.
    """
    point = F.struct(F.unix_date("ds").alias("day"), "y")
    blocks = (
        series.groupBy(TICKER_ID, F.year("ds").alias("year"))
        .agg(F.sort_array(F.collect_list(point)).alias("points"))
        .select(TICKER_ID, "year", F.col("points.day").alias("days"), F.col("points.y").alias("values"))
    )
    return settle(blocks.repartition(TICKER_ID).sortWithinPartitions(TICKER_ID, "year"), "year-blocks")


def starting_state(series: DataFrame, spec: ModelSpec = DEFAULT_SPEC) -> DataFrame:
    """Scales, changepoints and a straight-line start per ticker. One day gives no model.

    Changepoints sit evenly over the first part of the observed days. A history with fewer
    days than changepoints has fewer of them; the rest are placed at 1, where they do nothing.
    """
    scaled_day = F.unix_date("ds").cast("double")
    base = series.groupBy(TICKER_ID).agg(
        F.count("*").alias("n"),
        F.min("ds").alias("t0"),
        F.max("ds").alias("t1"),
        F.max(F.abs("y")).alias("top"),
        F.regr_slope("y", scaled_day).alias("per_day"),
        F.regr_intercept("y", scaled_day).alias("at_zero"),
        F.sort_array(F.collect_list(F.unix_date("ds"))).alias("days"),
    )
    base = base.where("n >= 2").withColumns(
        {
            "y_scale": F.when(F.col("top") > 0, F.col("top")).otherwise(1.0),
            "length": F.datediff("t1", "t0").cast("double"),
            "part": F.floor(F.col("n") * spec.changepoint_range),
        }
    )
    base = base.withColumn("used", F.greatest(F.least(F.lit(spec.changepoints), F.col("part") - 1), F.lit(0)))

    def knot(j: Column) -> Column:
        place = F.bround(F.try_divide(j * (F.col("part") - 1), F.col("used"))).cast("int")
        return (F.get("days", place) - F.unix_date("t0")) / F.col("length")

    knots = F.transform(
        F.sequence(F.lit(1), F.lit(spec.changepoints)),
        lambda j: F.when(j <= F.col("used"), knot(j)).otherwise(1.0).cast("double"),
    )
    slope = F.col("per_day") * F.col("length") / F.col("y_scale")
    offset = (F.col("at_zero") + F.col("per_day") * F.unix_date("t0")) / F.col("y_scale")
    theta = F.concat(F.array(slope, offset), F.array_repeat(F.lit(0.0), spec.terms - 2))
    return base.select(
        TICKER_ID, "n", "t0", "t1", "y_scale", knots.alias("knots"), theta.cast(_doubles).alias("theta")
    )


# ------------------------------------------------------------------ one pass


def gram_partials(blocks: DataFrame, state: DataFrame, spec: ModelSpec = DEFAULT_SPEC) -> DataFrame:
    """Partial Gram matrices, about one per ticker and partition."""
    return blocks.join(state, TICKER_ID).mapInPandas(block_partials(spec), PARTIAL)


def fit_decomposable(series: DataFrame, spec: ModelSpec = DEFAULT_SPEC) -> DataFrame:
    """Coefficients per ticker, its segments, the residual spread ``sigma``, and how the descent ended:
    ``passes``, ``converged``, ``objective`` and ``objective_start`` (that of the straight line).

    The fit is one task per ticker, not a distributed loop: one shuffle brings the year blocks of a ticker together, at most
    its calendar (a row a day, some 11,000 in 30 years), and all passes run there. A pass over Spark costs a job for each
    step of the descent and ships a matrix of ``terms`` squared numbers per ticker where the days themselves are fewer bytes.
    ``gram_partials`` gives the same matrices distributed; a test compares them.
    """
    blocks = year_blocks(series).join(starting_state(series, spec), TICKER_ID)
    state = settle(blocks.groupBy(TICKER_ID).applyInPandas(fit_ticker(spec), FITTED), "model-state")

    state = with_segments(state, spec)
    error = F.col("y") - F.col("yhat")
    fitted = _with_components(series.join(state, TICKER_ID), spec)
    spread = fitted.groupBy(TICKER_ID).agg(F.sqrt(F.avg(error * error)).alias("sigma"))
    return settle(state.join(spread, TICKER_ID), "decomposable")


# -------------------------------------------------------------------- scoring


def with_segments(state: DataFrame, spec: ModelSpec = DEFAULT_SPEC) -> DataFrame:
    """Append what scoring needs instead of the rate changes.

    ``slopes`` and ``offsets`` describe the trend's straight pieces, so that a day costs one
    lookup and not a term per changepoint. ``rate`` is the number of changepoints per unit of
    ``t`` and ``rate_change`` their mean absolute size.
    """
    rates = F.slice("theta", 3, spec.changepoints)
    turns = F.zip_with(rates, "knots", lambda rate, knot: -rate * knot)
    pieces = F.sequence(F.lit(0), F.lit(spec.changepoints))

    def total(values: Column, first: Column, number: Column) -> Column:
        return F.aggregate(F.slice(values, 1, number), first, lambda a, b: a + b)

    used = F.size(F.filter("knots", lambda knot: knot < 1))
    sizes = F.transform(rates, F.abs)
    return state.withColumns(
        {
            "slopes": F.transform(pieces, lambda i: total(rates, F.get("theta", F.lit(0)), i)),
            "offsets": F.transform(pieces, lambda i: total(turns, F.get("theta", F.lit(1)), i)),
            "rate": used.cast("double"),
            "rate_change": F.coalesce(
                F.try_divide(total(sizes, F.lit(0.0), F.lit(spec.changepoints)), used), F.lit(0.0)
            ),
        }
    )


def _trend(t: Column) -> Column:
    piece = F.size(F.filter("knots", lambda knot: knot < t))
    return F.get("slopes", piece) * t + F.get("offsets", piece)


def _waves(day: Column, period: float, order: int, start: int) -> Column:
    """Fourier series over days since 1970: the sines' coefficients, then the cosines'."""
    total = F.lit(0.0)
    for k in range(order):
        angle = day * (2 * math.pi * (k + 1) / period)
        total = total + F.get("theta", F.lit(start + k)) * F.sin(angle)
        total = total + F.get("theta", F.lit(start + order + k)) * F.cos(angle)
    return total


def _weekly(day: Column, spec: ModelSpec) -> Column:
    return _waves(day, WEEK, spec.weekly_order, spec.trend_terms)


def _yearly(day: Column, spec: ModelSpec) -> Column:
    return _waves(day, YEAR, spec.yearly_order, spec.trend_terms + 2 * spec.weekly_order)


def _with_components(rows: DataFrame, spec: ModelSpec) -> DataFrame:
    day = F.unix_date("ds").cast("double")
    return (
        rows.withColumn("t", F.datediff("ds", "t0") / F.datediff("t1", "t0"))
        .withColumn("trend", _trend(F.col("t")) * F.col("y_scale"))
        .withColumn("weekly", _weekly(day, spec))
        .withColumn("yearly", _yearly(day, spec))
        .withColumn("multiplicative_terms", F.col("weekly") + F.col("yearly"))
        .withColumn("yhat", F.col("trend") * (1 + F.col("multiplicative_terms")))
    )


COMPONENTS = ["weekly", "yearly", "multiplicative_terms"]


def score_decomposable(
    days: DataFrame,
    coefficients: DataFrame,
    level: float = 0.8,
    spec: ModelSpec = DEFAULT_SPEC,
    components: bool = False,
) -> DataFrame:
    """Append ``trend, yhat, yhat_lower, yhat_upper`` to rows of ``(ticker_id, ds, …)``.

    The bounds combine the residual spread with the variance of future rate changes, which
    come at the historical rate and size: after a time ``h`` past the history the trend has
    variance ``2 * rate_change² * rate * h³ / 3``. ``components`` adds the seasonal terms and
    the trend's own bounds. Rows of a ticker without a model are left out.
    """
    ahead = F.greatest(F.col("t") - 1, F.lit(0.0))
    drift = 2 * F.pow("rate_change", F.lit(2.0)) * F.col("rate") * F.pow(ahead, F.lit(3.0)) / 3
    drift = drift * F.pow("y_scale", F.lit(2.0))
    z = z_score(level)
    scored = (
        _with_components(days.join(coefficients, TICKER_ID), spec)
        .withColumn("_drift", F.sqrt(drift))
        .withColumn(
            "_half",
            z * F.hypot(F.col("sigma"), (1 + F.col("multiplicative_terms")) * F.col("_drift")),
        )
        .withColumn("yhat_lower", F.col("yhat") - F.col("_half"))
        .withColumn("yhat_upper", F.col("yhat") + F.col("_half"))
        .withColumn("trend_lower", F.col("trend") - z * F.col("_drift"))
        .withColumn("trend_upper", F.col("trend") + z * F.col("_drift"))
    )
    names = [*days.columns, "trend", "yhat", "yhat_lower", "yhat_upper"]
    return scored.select(*names, *(["trend_lower", "trend_upper", *COMPONENTS] if components else []))


def seasonal_profiles(coefficients: DataFrame, spec: ModelSpec = DEFAULT_SPEC) -> DataFrame:
    """Weekly effect on the 7 days from a Sunday, yearly effect on 365 days from January 1."""
    start = F.unix_date(F.lit("2017-01-01").cast("date"))  # a Sunday, and a January 1

    def profile(name: str, days: int, effect) -> DataFrame:
        return (
            coefficients.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
            .withColumn("effect", effect((start + F.col("place")).cast("double"), spec))
            .select(TICKER_ID, F.lit(name).alias("component"), "place", "effect")
        )

    return profile("weekly", 7, _weekly).unionByName(profile("yearly", 365, _yearly))
