"""Versioned training runs.

    <root>/coefficients/run_ts=<version>/   Parquet
    <root>/forecast/run_ts=<version>/       Parquet
    <root>/forecast_csv/run_ts=<version>/   CSV with header
    <root>/metrics/run_ts=<version>/        JSON
    <root>/<table>/run_ts=<version>/        Parquet, any further tables of the run
    <root>/model/run_ts=<version>/          name of the model, one line of text
    <root>/latest/swap-<number>.txt         one line of text per swap: a version and the number of the swap

The pointer is written last and only ever appended to; the line of the largest number holds. Readers follow it, so that
an unfinished run is never seen, and there is no moment without a pointer.
"""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from quotemill.schemas import FORECAST, METRICS, TICKER_DICTIONARY
from quotemill.sources.tables import NOTHING_THERE


def _part(root: str, table: str, run_ts: str) -> str:
    return f"{root}/{table}/run_ts={run_ts}"


def write_forecast_csv(forecast: DataFrame, path: str) -> None:
    forecast.write.mode("overwrite").option("header", True).csv(path)


def read_forecast_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FORECAST).option("header", True).csv(path)


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_metrics_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS).json(path)


def write_run(
    root: str,
    run_ts: str,
    coefficients: DataFrame,
    forecast: DataFrame,
    metrics: DataFrame,
    csv_copy: bool = True,
    model: str = "decomposable",
    tables: dict[str, DataFrame] | None = None,
) -> None:
    """Write a run and point to it once all of it is there. All columns of the forecast are kept."""
    spark = metrics.sparkSession
    further = [name for name in forecast.columns if name not in FORECAST.fieldNames()]
    forecast = forecast.select(*FORECAST.fieldNames(), *further)
    coefficients.write.mode("overwrite").parquet(_part(root, "coefficients", run_ts))
    forecast.write.mode("overwrite").parquet(_part(root, "forecast", run_ts))
    if csv_copy:
        stored = spark.read.schema(forecast.schema).parquet(_part(root, "forecast", run_ts))
        write_forecast_csv(stored, _part(root, "forecast_csv", run_ts))
    write_metrics_json(metrics, _part(root, "metrics", run_ts))
    for name, table in (tables or {}).items():
        table.write.mode("overwrite").parquet(_part(root, name, run_ts))
    _write_line(spark, model, _part(root, "model", run_ts), "overwrite")
    point_to(spark, root, run_ts)


def _write_line(spark: SparkSession, line: str, path: str, mode: str) -> None:
    spark.range(1).select(F.lit(line).alias("value")).coalesce(1).write.mode(mode).text(path)


def _pointer(spark: SparkSession, root: str) -> Row | None:
    """``(run_ts, swap)`` of the last swap, null where nothing was written; a line without a number is swap 0."""
    version = F.trim(F.split_part("value", F.lit("\t"), F.lit(1)))
    swap = F.coalesce(F.split_part("value", F.lit("\t"), F.lit(2)).try_cast("long"), F.lit(0))
    try:
        lines = spark.read.text(f"{root}/latest")
    except AnalysisException as problem:
        if problem.getCondition() not in NOTHING_THERE:
            raise
        return None
    named = lines.select(version.alias("run_ts"), swap.alias("swap")).where("run_ts <> ''")
    return named.agg(F.max(F.struct("swap", "run_ts")).alias("last")).first()["last"]


def _create(spark: SparkSession, path: str, line: str) -> bool:
    """Write a new file, unless one of that name is there."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getUri().getScheme() == "file":  # its create looks first and makes the file later; this one is a single step
        file = jvm.java.io.File(place.toUri().getPath())
        file.getParentFile().mkdirs()
        if not file.createNewFile():
            return False
        out = jvm.java.io.FileOutputStream(file)
        out.write(bytearray(line.encode()))
        out.close()
        return True
    try:
        out = system.create(place, False)
    except Py4JJavaError as problem:
        if system.exists(place):
            return False
        raise problem
    out.write(bytearray(line.encode()))
    out.close()
    return True


def point_to(spark: SparkSession, root: str, run_ts: str) -> int:
    """Make ``run_ts`` the current version; an older one goes back to it. Returns the number of the swap.

    A swap is a file named by its number, created only if there is none: of two writers that take the same number at
    once, one gets it and the other takes the next.
    """
    last = _pointer(spark, root)
    swap = last["swap"] + 1 if last else 1
    while not _create(spark, f"{root}/latest/swap-{swap:012d}.txt", f"{run_ts}\t{swap}\n"):
        swap += 1
    return swap


def latest_run(spark: SparkSession, root: str) -> str:
    """Version the pointer names."""
    last = _pointer(spark, root)
    if last is None:
        raise FileNotFoundError(f"no run to load under {root}")
    return last["run_ts"]


@dataclass(frozen=True)
class Run:
    """One loaded version. Loading again after a newer run finished gives that one."""

    run_ts: str
    coefficients: DataFrame
    forecast: DataFrame
    metrics: DataFrame
    model: str
    tickers: DataFrame | None = None


def load_run(spark: SparkSession, root: str, run_ts: str | None = None) -> Run:
    """The version the pointer names, or a given one."""
    version = run_ts or latest_run(spark, root)
    return Run(
        version,
        spark.read.parquet(_part(root, "coefficients", version)),
        spark.read.parquet(_part(root, "forecast", version)),
        read_metrics_json(spark, _part(root, "metrics", version)),
        spark.read.text(_part(root, "model", version)).first()["value"],
        _names(spark, _part(root, "tickers", version)),
    )


def _names(spark: SparkSession, path: str) -> DataFrame | None:
    """The ticker names stored with a run, None if it was trained without."""
    try:
        return spark.read.schema(TICKER_DICTIONARY).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() not in NOTHING_THERE:
            raise
        return None
