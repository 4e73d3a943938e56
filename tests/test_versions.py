"""Versions of the clean job: ids that stay, one swap for rows and names, counts of committed files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quotemill.operators import clean
from quotemill.plans import cleaning, serving, training
from quotemill.sources import cleans, tables
from tests.test_runs import RAW_SCHEMA, raw_frame, rows_of


def put(spark, path, *tickers, days=3):
    rows = [(t, f"2024-01-{d:02d}", f"${10 * n + d}", 5) for n, t in enumerate(tickers) for d in range(1, days + 1)]
    spark.createDataFrame(rows, RAW_SCHEMA).write.mode("overwrite").parquet(path)
    return path


def test_new_tickers_move_no_id(spark, tmp_path):
    root, raw = str(tmp_path / "root"), str(tmp_path / "raw")
    first = cleaning.clean_version(spark, put(spark, raw, "M", "Z"), root, "v1")
    assert rows_of(first.tickers) == [("M", 1), ("Z", 2)]
    second = cleaning.clean_version(spark, put(spark, raw, "A", "M", None, "Q"), root, "v2")
    assert rows_of(second.tickers) == [("A", 4), ("M", 1), ("Q", 5), ("Z", 2), (None, 3)]
    named = second.cleaned.join(second.tickers, "ticker_id", "left")
    assert {(r.Ticker, r.ticker_id) for r in named.collect()} == {("A", 4), ("M", 1), ("Q", 5), (None, None)}
    again = cleaning.clean_version(spark, raw, root, "v3", renumber=True)
    assert rows_of(again.tickers) == [("A", 2), ("M", 3), ("Q", 4), (None, 1)]
    assert rows_of(cleans.load_clean(spark, root, "v1").tickers) == [("M", 1), ("Z", 2)]


def test_a_table_of_known_tickers_adds_none(spark):
    known = spark.createDataFrame([("A", 7), (None, 9)], "Ticker string, ticker_id int")
    rows = spark.createDataFrame([("A",), (None,), ("A",)], "Ticker string")
    assert clean.new_tickers(rows, known).collect() == []
    assert rows_of(clean.new_tickers(rows, known.limit(0))) == [("A", 2), (None, 1)]


def test_a_failed_clean_leaves_the_pair_before(spark, tmp_path, monkeypatch):
    root, raw = str(tmp_path / "root"), str(tmp_path / "raw")
    before = cleaning.clean_version(spark, put(spark, raw, "M", "Z"), root, "v1")
    rows, names = rows_of(before.cleaned), rows_of(before.tickers)
    put(spark, raw, "A", "M")

    def broken(df, path, like):
        df.limit(1).write.parquet(path)
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(cleaning, "write_cleaned", broken)
        with pytest.raises(RuntimeError, match="lost"):
            cleaning.clean_version(spark, raw, root, "v2")
    now = cleans.load_clean(spark, root)
    assert (now.version, rows_of(now.cleaned), rows_of(now.tickers)) == ("v1", rows, names)
    after = cleaning.clean_version(spark, raw, root, "v2")
    assert (after.version, after.cleaned.count()) == ("v2", 6)
    with pytest.raises(ValueError, match="current"):
        cleaning.clean_version(spark, raw, root, "v2")


def test_counts_are_those_of_the_stored_rows(spark, tmp_path):
    rows = [
        ("A", "2024-01-01", "$1", 5),
        ("A", "2024-01-01", "$1", 5),
        ("A", "2024-01-02", "N/A", 5),
        (None, "2024-01-02", "$2", 5),
        ("B", "never", "$2", 5),
        ("B", "2024-01-02", None, 5),
    ]
    raw = str(tmp_path / "raw")
    spark.createDataFrame(rows, RAW_SCHEMA).write.parquet(raw)
    done = cleaning.clean_version(spark, raw, str(tmp_path / "root"))
    report = cleaning.clean_report(spark.read.parquet(raw)).first()
    counts = done.counts.first()
    assert tuple(counts) == (6, 3, 1, 1, 3, 3)
    assert all(counts[name] == report[name] for name in ("rows_read", "rows_clean", "rows_without_ticker", "rows_close_unread"))
    assert len(done.version) == len("20240101_000000")


def test_the_job_with_plain_paths_keeps_ids(spark, tmp_path):
    paths = [str(tmp_path / name) for name in ("raw", "cleaned", "tickers")]
    put(spark, paths[0], "M", "Z")
    cleaning.run_clean(spark, *paths)
    put(spark, paths[0], "A", "M")
    cleaned = cleaning.run_clean(spark, *paths)
    assert rows_of(spark.read.parquet(paths[2])) == [("A", 3), ("M", 1), ("Z", 2)]
    assert {r.ticker_id for r in cleaned.collect()} == {1, 3}


def test_a_run_is_asked_by_name(spark, tmp_path):
    raw, root, models = (str(tmp_path / name) for name in ("raw", "root", "models"))
    raw_frame(spark).write.parquet(raw)
    done = cleaning.clean_version(spark, raw, root, "v1")
    run = training.train_all(done.cleaned, models, "20240101_000000", training.TREND_WEEKLY, tickers=done.tickers)
    assert rows_of(run.tickers) == [("A", 1), ("B", 2)]
    asked = spark.createDataFrame(
        [(1, "B", "2024-01-05"), (2, "A", "2024-01-05"), (3, "nobody", "2024-01-05"), (4, None, "2024-01-05")],
        "request_id long, Ticker string, date string",
    )
    answers, rejected = serving.answer_points(serving.by_ticker_id(asked, run), run)
    stored = {r.ticker_id: r.yhat for r in run.forecast.where("ds = '2024-01-05'").collect()}
    assert {r.request_id: r.predicted_price for r in answers.collect()} == {1: stored[2], 2: stored[1]}
    assert rows_of(rejected) == [(3, "model not loaded"), (4, "model not loaded")]
    unnamed = training.train_all(done.cleaned, models, "20240102_000000", training.TREND_WEEKLY)
    assert unnamed.tickers is None
    with pytest.raises(ValueError, match="without ticker names"):
        serving.by_ticker_id(asked, unnamed)


def test_files_are_chosen_by_day_counts(spark, tmp_path):
    """A day with half of the rows is dealt over files; files follow the days; nothing is lost or doubled."""
    rows = spark.range(4000).selectExpr(
        "CASE WHEN id % 2 = 0 THEN DATE '2024-01-15' WHEN id % 401 = 1 THEN NULL ELSE DATE '2024-01-01' + CAST(id % 30 AS INT) END AS Date",
        "CAST(id % 3 AS INT) AS ticker_id",
        "CAST(id AS DOUBLE) AS Close",
    )
    path = str(tmp_path / "t")
    tables.write_cleaned(rows, path, like=rows, per_file=250)
    out = spark.read.parquet(path)
    assert rows_of(out) == rows_of(rows)
    files = out.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"), F.min("Date").alias("a"), F.max("Date").alias("b"))
    found = sorted(files.collect(), key=lambda r: (r.a, r.b))
    assert len(found) == 16 and max(r.n for r in found) <= 3 * 250
    assert all(before.b <= after.a for before, after in zip(found, found[1:]))
    tables.write_cleaned(rows.limit(0), path, like=rows.limit(0))
    assert spark.read.parquet(path).count() == 0
    tables.write_cleaned(rows.drop("Date"), path, like=rows)
    assert spark.read.parquet(path).count() == 4000
