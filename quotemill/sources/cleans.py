"""Versions of the clean job: cleaned rows, ticker names and counts that belong together, under one pointer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quotemill.schemas import CLEAN_COUNTS, TICKER_DICTIONARY
from quotemill.sources.runs import latest_run


def part(root: str, table: str, version: str) -> str:
    return f"{root}/{table}/version={version}"


@dataclass(frozen=True)
class CleanVersion:
    """One loaded version: every id of ``cleaned`` has its name in ``tickers``."""

    version: str
    cleaned: DataFrame
    tickers: DataFrame
    counts: DataFrame


def current_version(spark: SparkSession, root: str) -> str | None:
    """Version the pointer names, None before the first."""
    try:
        return latest_run(spark, root)
    except FileNotFoundError:
        return None


def load_clean(spark: SparkSession, root: str, version: str | None = None) -> CleanVersion:
    """The version the pointer names, or a given one."""
    version = version or latest_run(spark, root)
    return CleanVersion(
        version,
        spark.read.parquet(part(root, "cleaned", version)),
        spark.read.schema(TICKER_DICTIONARY).parquet(part(root, "tickers", version)),
        spark.read.schema(CLEAN_COUNTS).json(part(root, "counts", version)),
    )
