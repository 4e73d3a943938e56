"""Prediction lookups: tables of point and range requests against a stored forecast.

``score`` is the scoring function of the model, bound to its coefficients: it appends
``trend, yhat, yhat_lower, yhat_upper`` to rows of ``(ticker_id, ds, …)``. ``known`` holds the
ids that have a model; a column ``converged`` there tells whose fit ended at its optimum, and the others are not served.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from quotemill.functions.scalars import date_text
from quotemill.operators.series import explode_days
from quotemill.schemas import TICKER_ID
from quotemill.session import settle

Score = Callable[[DataFrame], DataFrame]

BAD_DATE = "bad date"
REVERSED = "start after end"
NO_MODEL = "model not loaded"
NOT_CONVERGED = "model not converged"

STORED = ["yhat", "yhat_lower", "yhat_upper", "trend"]

# a join key with more requests is dealt over several tasks; no more keys than these are
HOT_ROWS = 100_000
HOT_KEYS = 50_000


def _with_model_flag(requests: DataFrame, known: DataFrame) -> DataFrame:
    """``_known``: null without a model, false for one whose fit did not converge."""
    flag = F.coalesce("converged", F.lit(False)) if "converged" in known.columns else F.lit(True)
    return requests.join(known.select(TICKER_ID, flag.alias("_known")), TICKER_ID, "left")


def _unserved() -> Column:
    return F.when(F.col("_known").isNull(), NO_MODEL).when(~F.col("_known"), NOT_CONVERGED)


def check_points(requests: DataFrame, known: DataFrame) -> DataFrame:
    """Requests with the parsed day and the reason of rejection, null when accepted."""
    reason = _unserved().when(F.col("ds").isNull(), BAD_DATE)
    return (
        _with_model_flag(requests, known)
        .withColumn("ds", F.col("date").try_cast("date"))
        .withColumn("reason", reason)
        .select("request_id", TICKER_ID, "ds", "reason")
    )


def check_ranges(requests: DataFrame, known: DataFrame) -> DataFrame:
    """Requests with the parsed ends and the reason of rejection, null when accepted."""
    reason = (
        _unserved()
        .when(F.col("first").isNull() | F.col("last").isNull(), BAD_DATE)
        .when(F.col("first") > F.col("last"), REVERSED)
    )
    return (
        _with_model_flag(requests, known)
        .withColumn("first", F.col("start_date").try_cast("date"))
        .withColumn("last", F.col("end_date").try_cast("date"))
        .withColumn("reason", reason)
        .select("request_id", TICKER_ID, "first", "last", "reason")
    )


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reason").isNull()).drop("reason")


def rejects(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reason").isNotNull()).select("request_id", "reason")


def _answer(rows: DataFrame) -> DataFrame:
    def number(name: str, alias: str) -> Column:
        return F.col(name).cast("double").alias(alias)

    return rows.select(
        "request_id",
        TICKER_ID,
        date_text(F.col("ds")).alias("date"),
        number("yhat", "predicted_price"),
        number("yhat_lower", "lower_bound"),
        number("yhat_upper", "upper_bound"),
        number("trend", "trend"),
    )


def deal_out(
    left: DataFrame, right: DataFrame, keys: list[str], rows: int = HOT_ROWS, most: int = HOT_KEYS
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of an equi-join and its keys, such that no key has many more than ``rows`` rows of ``left`` in a task.

    The keys of ``left`` are counted, copies combining before the shuffle. A key with more than ``rows`` rows is hot: its rows of
    ``left`` are dealt into parts by a hash of the whole row, and its rows of ``right`` (few: stored days of one ticker and one day or
    month) are copied into each part. Where more than ``most`` keys would be hot, only those above the ``most``-th
    part of all rows are, so the list of hot keys never outgrows a broadcast. Rows equal in every column may
    stay together.
    """
    counted = left.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > rows)
    counted = settle(counted, "hot-keys")
    total = counted.agg(F.sum("_n").alias("n"), F.count("*").alias("k")).first()
    if not total["k"]:
        return left, right, keys
    least = rows if total["k"] <= most else total["n"] // most
    # at most ``most`` rows
    hot = F.broadcast(counted.where(F.col("_n") > least).select(*keys, F.ceil(F.col("_n") / least).cast("int").alias("_parts")))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.col("_parts")).cast("int")
    dealt = left.join(hot, keys, "left").withColumn("_part", F.coalesce(spread, F.lit(0))).drop("_parts")
    parts = F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
    copied = right.join(hot, keys, "left").withColumn("_part", F.explode(parts)).drop("_parts")
    return dealt, copied, [*keys, "_part"]


def _stored_or_scored(wanted: DataFrame, forecast: DataFrame, score: Score) -> DataFrame:
    """Rows of ``(request_id, ticker_id, ds)`` with the stored values; the model sees only those without any.

    The three columns of the requests are written once, as they are counted and joined twice; answers are not written.
    """
    answer = ["request_id", TICKER_ID, "ds", *STORED]
    stored = forecast.select(TICKER_ID, "ds", *STORED).where(F.col("yhat").isNotNull())
    wanted = settle(wanted.select("request_id", TICKER_ID, "ds"), "wanted")
    dealt, copied, keys = deal_out(wanted, stored, [TICKER_ID, "ds"])
    hits = dealt.join(copied, keys)
    missing = dealt.join(copied.select(*keys), keys, "left_anti").drop("_part")
    return hits.select(*answer).unionByName(score(missing).select(*answer))


def next_stored_days(forecast: DataFrame) -> DataFrame:
    """``(ticker_id, day, next_day)``: for every day of a ticker's stored span the first stored day from it on."""
    before = F.lag("ds").over(Window.partitionBy(TICKER_ID).orderBy("ds"))
    gaps = forecast.select(TICKER_ID, F.col("ds").alias("next_day"), F.date_add(before, 1).alias("after"))
    begins = gaps.withColumn("after", F.coalesce("after", "next_day")).where(F.col("after") <= F.col("next_day"))
    return explode_days(begins, "after", "next_day").select(TICKER_ID, F.col("ds").alias("day"), "next_day")


def predict_points(requests: DataFrame, forecast: DataFrame, score: Score, known: DataFrame) -> DataFrame:
    """The stored prediction of each accepted request, or the model's where no day is stored."""
    return _answer(_stored_or_scored(accepted(check_points(requests, known)), forecast, score))


def predict_ranges(
    requests: DataFrame, forecast: DataFrame, score: Score, known: DataFrame, fill_gaps: bool = False
) -> DataFrame:
    """Predictions for all stored days of each accepted range.

    A range without a single stored day is evaluated day by day instead; with ``fill_gaps``
    the missing days of the other ranges are too.

    Without ``fill_gaps`` the next stored day from a range's first day on tells whether the range holds any. Ranges that
    do are exploded to months within their ticker's stored span, and a month meets at most 31 stored days: equi-joins
    whose output is hardly larger than the answer, with no request-by-forecast comparison.
    """
    wanted = accepted(check_ranges(requests, known))
    if fill_gaps:
        return _answer(_stored_or_scored(explode_days(wanted, "first", "last"), forecast, score))

    span = forecast.groupBy(TICKER_ID).agg(F.min("ds").alias("from_day"), F.max("ds").alias("to_day"))
    from_span = wanted.join(span, TICKER_ID, "left").withColumn("day", F.greatest("first", "from_day"))
    asked, days, keys = deal_out(from_span, next_stored_days(forecast), [TICKER_ID, "day"])
    placed = settle(asked.join(days, keys, "left").drop("_part"), "placed-ranges")
    holds_any = F.coalesce(F.col("next_day") <= F.col("last"), F.lit(False))

    end = F.least("last", "to_day")
    months = F.sequence(F.trunc("next_day", "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
    by_month = placed.where(holds_any).withColumn("month", F.explode(months))
    stored = forecast.select(TICKER_ID, F.trunc("ds", "month").alias("month"), "ds", *STORED)
    inside = F.col("ds").between(F.col("first"), F.col("last"))
    answer = ["request_id", TICKER_ID, "ds", *STORED]
    by_month, stored, keys = deal_out(by_month, stored, [TICKER_ID, "month"])
    hits = by_month.join(stored, keys).where(inside).select(*answer)

    missing = explode_days(placed.where(~holds_any), "first", "last").select("request_id", TICKER_ID, "ds")
    return _answer(hits.unionByName(score(missing).select(*answer)))


def forecast_info(forecast: DataFrame) -> DataFrame:
    """First day, last day and number of rows of each stored forecast."""
    return forecast.groupBy("run_ts", TICKER_ID).agg(
        date_text(F.min("ds")).alias("forecast_start"),
        date_text(F.max("ds")).alias("forecast_end"),
        F.count("*").alias("total_predictions"),
    )
