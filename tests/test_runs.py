"""Sources, sinks and the jobs, in temporary folders."""

from __future__ import annotations

import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quotemill import catalog, session
from quotemill.functions.scalars import run_id
from quotemill.plans import cleaning, serving, training
from quotemill.schemas import FORECAST, METRICS, POINT_REQUESTS, RANGE_REQUESTS
from quotemill.sources import runs, tables

RAW_SCHEMA = "Ticker string, Date string, Close string, Volume bigint"


def raw_frame(spark, days=60):
    start = dt.date(2024, 1, 1)
    rows = [(t, str(start + dt.timedelta(i)), f"${100 + i + n}", 5) for n, t in enumerate("AB") for i in range(days)]
    return spark.createDataFrame(rows, RAW_SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# ----------------------------------------------------------------- tables


def test_landing_keeps_provenance_and_replaces_by_name(spark, tmp_path):
    incoming, landed = tmp_path / "in", str(tmp_path / "raw")
    import pandas as pd

    incoming.mkdir()
    for name, close in (("one", 1.0), ("two", 2.0)):
        pd.DataFrame({"Ticker": ["A"], "Close": [close]}).to_parquet(incoming / f"{name}.parquet")
    tables.land_raw(spark, str(incoming), landed)
    found = tables.read_parquet_files(spark, landed)
    assert {(r.original_filename, r.uploaded_by, r.Close) for r in found.collect()} == {
        ("one.parquet", "upload_script", 1.0),
        ("two.parquet", "upload_script", 2.0),
    }
    again = tmp_path / "again"
    again.mkdir()
    pd.DataFrame({"Ticker": ["A"], "Close": [9.0]}).to_parquet(again / "one.parquet")
    latest = tables.land_raw(spark, str(again), landed, uploaded_by="me")
    assert latest.select("original_filename", "uploaded_by", "Close").collect() == [("one.parquet", "me", 9.0)]
    raw = tables.read_raw(spark, landed)
    assert raw.columns == ["Ticker", "Close"]
    assert sorted(r.Close for r in raw.collect()) == [2.0, 9.0]
    assert tables.read_raw(spark, landed, raw.schema).count() == 2


def test_landing_keeps_each_file_as_it_is(spark, tmp_path):
    """Types that differ, columns of one file only, equal names in two folders, signs that paths escape."""
    import pandas as pd
    import pyarrow.parquet as pq

    given = {
        "a/f.parquet": pd.DataFrame({"Ticker": ["A", "B"], "Volume": pd.array([1, 2], "int32")}),
        "b c/f.parquet": pd.DataFrame({"Ticker": ["C"], "Volume": [1.5], "Note": ["n"]}),
        "1+1=2%.parquet": pd.DataFrame({"Ticker": ["D"], "Volume": pd.array([2**40], "int64")}),
        "text.parquet": pd.DataFrame({"Ticker": ["E"], "Volume": ["7"]}),
    }
    for name, rows in given.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        rows.to_parquet(path)
    target = str(tmp_path / "raw")
    numbers = tables.land_raw(spark, str(tmp_path / "in"), target, files="{f,1*}.parquet")
    assert dict(numbers.dtypes)["Volume"] == "double"
    assert sorted((r.original_filename, r.Ticker, r.Volume, r.Note) for r in numbers.collect()) == [
        ("1+1=2%.parquet", "D", 2.0**40, None),
        ("a/f.parquet", "A", 1.0, None),
        ("a/f.parquet", "B", 2.0, None),
        ("b c/f.parquet", "C", 1.5, "n"),
    ]
    # every landed file has its own columns and types
    stored = {tables.landed_name(p): set(pq.read_schema(p.removeprefix("file:")).names) for p in tables.list_files(spark, target)}
    assert stored == {n: {*given[n].columns, "uploaded_by"} for n in ("a/f.parquet", "b c/f.parquet", "1+1=2%.parquet")}
    # one name is replaced, the others stay, also by a file of another type
    pd.DataFrame({"Ticker": ["Z"], "Volume": ["n/a"]}).to_parquet(tmp_path / "in" / "a" / "f.parquet")
    tables.land_raw(spark, str(tmp_path / "in"), target, files="f.parquet")
    raw = tables.read_raw(spark, target)
    assert dict(raw.dtypes)["Volume"] == "string" and "original_filename" not in raw.columns
    assert sorted((r.Ticker, float(r.Volume) if r.Ticker != "Z" else r.Volume) for r in raw.collect()) == [("C", 1.5), ("D", 2.0**40), ("Z", "n/a")]
    one = tables.land_raw(spark, str(tmp_path / "in" / "text.parquet"), target)
    assert [tuple(r) for r in one.select("Ticker", "Volume", "original_filename").collect()] == [("E", "7", "text.parquet")]


def test_no_files_is_an_error(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    for path in ("empty", "missing"):
        with pytest.raises(FileNotFoundError):
            tables.read_cleaned(spark, str(tmp_path / path))
        with pytest.raises(FileNotFoundError):
            tables.read_raw(spark, str(tmp_path / path), FORECAST)
        with pytest.raises(FileNotFoundError):
            tables.land_raw(spark, str(tmp_path / path), str(tmp_path / "raw"))


def test_files_with_different_columns_are_stacked(spark, tmp_path):
    spark.range(2).toDF("a").write.parquet(str(tmp_path / "t"))
    spark.createDataFrame([("x",)], "b string").write.mode("append").parquet(str(tmp_path / "t"))
    out = tables.read_cleaned(spark, str(tmp_path / "t"))
    assert set(out.columns) == {"a", "b"} and out.count() == 3


def test_cleaned_table_is_replaced_and_laid_out_by_date(spark, tmp_path):
    path = str(tmp_path / "cleaned")
    first = cleaning.clean_prices(raw_frame(spark))
    tables.write_cleaned(first, path)
    tables.write_cleaned(first, path)
    out = tables.read_cleaned(spark, path)
    assert out.columns == first.columns and rows_of(out) == rows_of(first)
    per_file = out.groupBy(F.input_file_name().alias("file")).agg(F.min("Date").alias("a"), F.max("Date").alias("b"))
    spans = sorted((r.a, r.b) for r in per_file.collect())
    assert all(before[1] <= after[0] for before, after in zip(spans, spans[1:]))


# ------------------------------------------------------------------- runs


def forecast_frame(spark):
    rows = [(1, dt.date(2024, 1, d), 1.0 / d, 100.0 / 3, None if d == 2 else -1e-9, 1e300) for d in (1, 2, 3)]
    return spark.createDataFrame(rows, FORECAST)


def test_forecast_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "csv")
    runs.write_forecast_csv(forecast_frame(spark), path)
    assert rows_of(runs.read_forecast_csv(spark, path)) == rows_of(forecast_frame(spark))
    assert spark.read.text(path).first().value == "ticker_id,ds,trend,yhat,yhat_lower,yhat_upper"


def test_metrics_json_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([(1, 3, 0, 0.5, 0.25, 0.5, None, 12.5)], METRICS)
    runs.write_metrics_json(frame, str(tmp_path / "json"))
    assert rows_of(runs.read_metrics_json(spark, str(tmp_path / "json"))) == rows_of(frame)
    assert '"r2":null' in spark.read.text(str(tmp_path / "json")).first().value


def test_pointer_decides_the_version(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        runs.latest_run(spark, root)
    metrics = spark.createDataFrame([(1, 3, 0, 0.5, 0.25, 0.5, 0.1, 12.5)], METRICS)
    coefficients = spark.createDataFrame([(1, [1.0])], "ticker_id int, theta array<double>")
    runs.write_run(root, "20240101_000000", coefficients, forecast_frame(spark), metrics)
    runs.write_run(root, "20240202_000000", coefficients, forecast_frame(spark), metrics, csv_copy=False)
    assert runs.latest_run(spark, root) == "20240202_000000"
    # a newer run that never finished is not seen
    forecast_frame(spark).write.parquet(f"{root}/forecast/run_ts=20250101_000000")
    assert runs.load_run(spark, root).run_ts == "20240202_000000"
    # going back is a matter of the pointer, blanks around it do not count
    runs.point_to(spark, root, " 20240101_000000 ")
    loaded = runs.load_run(spark, root)
    assert loaded.run_ts == "20240101_000000"
    assert rows_of(loaded.forecast) == rows_of(forecast_frame(spark))
    assert rows_of(loaded.metrics) == rows_of(metrics)
    assert loaded.coefficients.first().theta == [1.0]
    # the pointer is only appended to, so no reader ever finds none
    assert spark.read.text(f"{root}/latest").count() == 3


def test_a_run_knows_its_model_and_holds_the_plot_tables(spark, tmp_path):
    cleaned = cleaning.clean_prices(raw_frame(spark))
    run = training.train_all(cleaned, str(tmp_path), model=training.TREND_WEEKLY)
    assert run.model == "trend_weekly" and len(run.run_ts) == len("20240101_000000")
    asked = spark.createDataFrame([(1, 1, "2024-01-05"), (2, 1, "2031-01-01")], POINT_REQUESTS)
    answers, _ = serving.answer_points(asked, run)
    assert {r.request_id for r in answers.collect()} == {1, 2}
    count = lambda table: spark.read.parquet(f"{tmp_path}/{table}/run_ts={run.run_ts}").count()
    assert count("actual_vs_predicted") == 2 * (60 + 365)
    assert (count("profiles"), count("histogram"), count("density"), count("series_range")) == (14, 100, 400, 2)


def test_clean_job_reports_its_counts(spark, tmp_path):
    raw_frame(spark).write.parquet(str(tmp_path / "raw"))
    folders = [str(tmp_path / name) for name in ("raw", "cleaned", "tickers", "report")]
    cleaning.run_clean(spark, *folders)
    (report,) = spark.read.json(folders[-1]).collect()
    assert report.rows_read == report.rows_clean == 120


def test_other_read_errors_are_not_called_missing_files(spark, tmp_path):
    spark.range(2).select(F.col("id").cast("int").alias("a")).write.parquet(str(tmp_path / "t"))
    spark.range(2).select(F.col("id").cast("string").alias("a")).write.mode("append").parquet(str(tmp_path / "t"))
    with pytest.raises(Exception) as caught:
        tables.read_cleaned(spark, str(tmp_path / "t"))
    assert not isinstance(caught.value, FileNotFoundError)


def test_run_id_format(spark):
    moment = spark.createDataFrame([(dt.datetime(2024, 3, 5, 17, 4, 9),)], "t timestamp_ntz")
    assert moment.select(run_id(F.col("t")).alias("id")).first().id == "20240305_170409"


# ------------------------------------------------------------------- jobs


def test_land_clean_train_and_serve(spark, tmp_path):
    folder = lambda name: str(tmp_path / name)
    raw_frame(spark).write.parquet(folder("in"))
    tables.land_raw(spark, folder("in"), folder("raw"))
    cleaned = cleaning.run_clean(spark, folder("raw"), folder("cleaned"), folder("tickers"))
    assert cleaned.count() == 120
    assert rows_of(spark.read.parquet(folder("tickers"))) == [("A", 1), ("B", 2)]
    run = training.train_all(cleaned, folder("models"), "20240101_000000")
    assert run.forecast.count() == 2 * (60 + 365)
    assert {"weekly", "yearly", "trend_lower", "trend_upper"} <= set(run.forecast.columns)
    assert run.forecast.groupBy("ticker_id", "ds").count().where("count > 1").count() == 0
    assert run.forecast.where("yhat < yhat_lower or yhat > yhat_upper").count() == 0
    assert all(r.r2 > 0.99 for r in run.metrics.collect())

    asked = spark.createDataFrame([(1, 1, "2024-01-05"), (2, 1, "2031-01-01"), (3, 7, "2024-01-05")], POINT_REQUESTS)
    answers, rejected = serving.answer_points(asked, run)
    assert {r.request_id for r in answers.collect()} == {1, 2}
    assert rows_of(rejected) == [(3, "model not loaded")]
    wide = spark.createDataFrame([(1, 2, "2024-01-05", "2024-01-07"), (2, 2, "2024-02-01", "2024-01-01")], RANGE_REQUESTS)
    answers, rejected = serving.answer_ranges(wide, run)
    assert [r.date for r in answers.orderBy("date").collect()] == ["2024-01-05", "2024-01-06", "2024-01-07"]
    assert rows_of(rejected) == [(2, "start after end")]


def test_train_only_the_most_common_ticker(spark, tmp_path):
    extra = spark.createDataFrame([("B", "2025-01-01", "5", 1)], RAW_SCHEMA)
    cleaned = cleaning.clean_prices(raw_frame(spark).unionByName(extra))
    run = training.train_all(cleaned, str(tmp_path), "v1", training.TREND_WEEKLY, only_most_common=True)
    assert [r.ticker_id for r in run.metrics.collect()] == [2]


# ---------------------------------------------------------------- session


def fake_session(setting, master):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: setting), sparkContext=context)


def test_shared_folder_follows_the_session():
    assert session.shared_folder(fake_session("hdfs://shared/checkpoints", "yarn")) == "hdfs://shared/checkpoints"
    with pytest.raises(RuntimeError):
        session.shared_folder(fake_session(None, "yarn"))


def test_entry_and_catalog(spark, small):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["ticker_id", "Date", "Close", "Daily_Return"]
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names >= set(catalog.QUERIES)


@pytest.mark.parametrize("name", ["score", "forecast_decomposable", "forecast_interval", "components", "train_all"])
def test_queries_without_twin_run(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_writers_at_once_get_a_number_each(spark, tmp_path):
    """Eight swaps at a time: none takes another's number, and the largest one holds."""
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "models")
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda k: runs.point_to(spark, root, f"v{k}"), range(8)))
    assert sorted(numbers) == list(range(1, 9))
    assert runs.latest_run(spark, root) == f"v{numbers.index(8)}"
    # two that read the same last number, then write
    assert runs._create(spark, f"{root}/latest/swap-{9:012d}.txt", "other\t9\n")
    assert runs.point_to(spark, root, "back") == 10 and runs.latest_run(spark, root) == "back"
    assert not runs._create(spark, f"{root}/latest/swap-{9:012d}.txt", "late\t9\n")
    assert runs.latest_run(spark, root) == "back"


def test_an_unfinished_fit_is_counted_and_not_served(spark):
    from quotemill.operators import lookup
    from quotemill.plans.training import fit_report

    coefficients = spark.createDataFrame([(1, True), (2, False), (3, None)], "ticker_id int, converged boolean")
    assert fit_report(coefficients).first().asDict() == {"tickers": 3, "not_converged": 2}
    assert fit_report(coefficients.drop("converged")).first().asDict() == {"tickers": 3, "not_converged": 0}
    points = spark.createDataFrame([(i, i, "2024-01-02") for i in (1, 2, 3, 4)], "request_id long, ticker_id int, date string")
    reasons = {r["request_id"]: r["reason"] for r in lookup.check_points(points, coefficients).collect()}
    assert reasons == {1: None, 2: lookup.NOT_CONVERGED, 3: lookup.NOT_CONVERGED, 4: lookup.NO_MODEL}
    ranges = points.selectExpr("request_id", "ticker_id", "date AS start_date", "date AS end_date")
    assert {r["request_id"]: r["reason"] for r in lookup.check_ranges(ranges, coefficients).collect()} == reasons
