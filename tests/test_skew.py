"""Joins that must shuffle split a hot key at run time and stay complete."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quotemill.operators import clean, lookup
from quotemill.session import settle

SHUFFLED = {
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture
def shuffled(spark):
    before = {key: spark.conf.get(key, None) for key in SHUFFLED}
    for key, value in SHUFFLED.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def hot_rows(spark, rows=200_000):
    """A third of the rows on one ticker, a third without one."""
    kind = F.col("id") % 3
    return spark.range(0, rows, 1, 8).select(
        "id",
        F.when(kind == 0, "HOT").when(kind == 1, F.concat(F.lit("T"), F.col("id") % 997)).alias("Ticker"),
        F.rand(1).alias("Close"),
    )


def test_encoding_splits_a_hot_ticker(shuffled):
    rows = hot_rows(shuffled)
    out = clean.encode_ticker(rows, settle(clean.ticker_dictionary(rows), "dictionary"))
    rows = out.select("id", "ticker_id").toPandas()
    assert len(rows) == 200_000 and rows["ticker_id"].isna().sum() == 66_666
    executed = out.select("id", "Close", "ticker_id")
    executed.collect()
    assert "skew=true" in final_plan(executed)


def shares(joined) -> tuple[int, float]:
    """Rows of a shuffled join, and the share of them that its largest task holds."""
    rows = [r["n"] for r in joined.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()]
    return sum(rows), max(rows) / sum(rows)


@pytest.fixture
def unsplit(shuffled):
    """Neither Spark's own splitting of partitions nor their coalescing, so that a task is what the keys make it."""
    names = ("spark.sql.adaptive.skewJoin.enabled", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {name: shuffled.conf.get(name) for name in names}
    for name in names:
        shuffled.conf.set(name, "false")
    yield shuffled
    for name, value in before.items():
        shuffled.conf.set(name, value)


def stored_days(spark):
    return settle(
        spark.range(1, 998).select(
            F.col("id").cast("int").alias("ticker_id"),
            F.lit("2024-01-01").cast("date").alias("ds"),
            *[F.col("id").cast("double").alias(c) for c in lookup.STORED],
        ),
        "forecast",
    )


def hot_days(spark):
    """A third of the requests ask for one day of one ticker, a third of those that have no stored day for another."""
    hot = F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, 5000).otherwise(F.col("id") % 997 + 1)
    return spark.range(0, 150_000, 1, 8).select(
        F.col("id").alias("request_id"), hot.cast("int").alias("ticker_id"), F.lit("2024-01-01").cast("date").alias("ds")
    )


def test_a_hot_key_is_dealt_over_the_tasks_of_the_join(unsplit):
    wanted, stored, keys = hot_days(unsplit), stored_days(unsplit), ["ticker_id", "ds"]
    plain = wanted.join(stored, keys, "left")
    assert "SortMergeJoin" in plain._jdf.queryExecution().executedPlan().toString()
    rows, share = shares(plain)
    assert rows == 150_000 and share > 1 / 3
    dealt, copied, by = lookup.deal_out(wanted, stored, keys, rows=500)
    for kind in ("left", "left_anti", "inner"):
        rows, share = shares(dealt.join(copied.select(*by), by, kind))
        assert rows == {"left": 150_000, "left_anti": 50_000, "inner": 100_000}[kind] and share < 0.16, kind
    assert dealt.where("_part > 0").select("ticker_id").distinct().count() == 2
    # more hot keys than may be listed: only the hottest are dealt
    few, _, _ = lookup.deal_out(wanted, stored, keys, rows=10, most=3)
    assert few.where("_part > 0").select("ticker_id").distinct().count() == 1
    same, _, by = lookup.deal_out(wanted, stored, keys, rows=10**6)
    assert same is wanted and by == keys


def test_a_hot_month_of_ranges_is_dealt_out(unsplit):
    month = F.lit("2024-01-01").cast("date").alias("month")
    asked = hot_days(unsplit).select("request_id", "ticker_id", month)
    stored = stored_days(unsplit).select("ticker_id", month, "ds")
    dealt, copied, by = lookup.deal_out(asked, stored, ["ticker_id", "month"], rows=500)
    rows, share = shares(dealt.join(copied, by))
    assert rows == 100_000 and share < 0.16


def test_points_on_hot_days_are_complete(unsplit, monkeypatch):
    spark = unsplit
    requests = hot_days(spark).withColumn("date", F.col("ds").cast("string")).drop("ds")
    known = settle(spark.range(1, 6000).select(F.col("id").cast("int").alias("ticker_id")), "known")

    def score(days):
        return days.withColumns({c: F.lit(-1.0) for c in lookup.STORED})

    monkeypatch.setattr(lookup, "HOT_ROWS", 500)
    monkeypatch.setattr(lookup.deal_out, "__defaults__", (500, lookup.HOT_KEYS))
    rows = lookup.predict_points(requests, stored_days(spark), score, known).toPandas()
    assert len(rows) == 150_000 and rows["request_id"].nunique() == 150_000
    assert (rows["predicted_price"] == rows["ticker_id"].where(rows["ticker_id"] < 998, -1)).all()
