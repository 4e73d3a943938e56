"""Clean job: raw price rows to the cleaned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quotemill.functions.scalars import parse_date, run_id
from quotemill.operators import clean
from quotemill.operators.returns import daily_return
from quotemill.schemas import CRITICAL_COLUMNS, DATE, TICKER_DICTIONARY, TICKER_ID
from quotemill.session import settle
from quotemill.sources.cleans import CleanVersion, current_version, load_clean, part
from quotemill.sources.runs import point_to
from quotemill.sources.tables import read_parquet_files, read_raw, write_cleaned


def clean_prices(
    raw: DataFrame,
    dictionary: DataFrame | None = None,
    compat: bool = False,
    drop_unparsed: bool = False,
) -> DataFrame:
    """Deduplicate, encode the ticker, repair nulls, dates and numbers, add the daily return.

    Rows come in no order; ``write_cleaned`` lays them out.
    """
    return daily_return(repaired_rows(raw, dictionary, compat, drop_unparsed))


def repaired_rows(
    raw: DataFrame,
    dictionary: DataFrame | None = None,
    compat: bool = False,
    drop_unparsed: bool = False,
) -> DataFrame:
    """Deduplicate, encode the ticker, repair nulls, dates and numbers.

    ``compat`` repeats the original number scrub, ``drop_unparsed`` also drops the rows whose
    close or volume could not be read.

    The repaired rows are written once: the return reads two or three of their columns
    repeatedly, which would otherwise repeat the deduplication.
    """
    if dictionary is None:
        dictionary = clean.ticker_dictionary(raw)
    rows = clean.encode_ticker(clean.drop_duplicate_rows(raw), dictionary)
    rows = clean.parse_dates(clean.drop_null_rows(rows))
    rows = clean.scrub_numbers(rows, compat)
    if drop_unparsed:
        rows = clean.drop_null_rows(rows)
    return settle(rows, "repaired")


def clean_report(raw: DataFrame) -> DataFrame:
    """Row counts of every cleaning step, in one pass: one row.

    Grouping the copies gives the counts before and after deduplication at once.
    """
    rows = raw.groupBy(*[f"`{c}`" for c in raw.columns]).agg(F.count("*").alias("_copies"))
    present = [c for c in CRITICAL_COLUMNS if c in raw.columns]
    complete = F.lit(True)
    for name in present:
        complete = complete & F.col(name).isNotNull()
    dated = complete
    if DATE in present:
        dated = complete & parse_date(F.col(DATE), raw.schema[DATE].dataType).isNotNull()
    flags = rows.withColumns({"_complete": complete, "_dated": dated})
    parsed = clean.scrub_numbers(flags)
    return parsed.agg(
        F.sum("_copies").alias("rows_read"),
        F.count("*").alias("rows_distinct"),
        F.count_if(F.col("_complete")).alias("rows_complete"),
        F.count_if(F.col("_dated")).alias("rows_clean"),
        F.count_if(F.col("_dated") & F.col("Ticker").isNull()).alias("rows_without_ticker"),
        *(
            [F.count_if(F.col("_dated") & F.col("Close").isNull()).alias("rows_close_unread")]
            if "Close" in raw.columns
            else []
        ),
    )


def clean_sample(cleaned: DataFrame, rows: int = 10) -> DataFrame:
    """The first rows by date and ticker, all columns breaking ties."""
    rest = [c for c in cleaned.columns if c not in ("Date", "ticker_id")]
    return cleaned.orderBy("Date", "ticker_id", *[f"`{c}`" for c in rest]).limit(rows)


def run_clean(
    spark: SparkSession,
    raw_path: str,
    cleaned_path: str,
    dictionary_path: str,
    report_path: str | None = None,
    **options: bool,
) -> DataFrame:
    """Read the raw table, add its new tickers to the dictionary, replace the cleaned table and return it.

    The dictionary only grows, so a job that fails leaves ids that fit the old rows. ``clean_version`` also keeps
    the old rows readable. With ``report_path`` the row counts of every step are written there as JSON.
    """
    raw = read_raw(spark, raw_path)
    try:
        found = clean.new_tickers(raw, read_parquet_files(spark, dictionary_path, merge=False))
    except FileNotFoundError:
        found = clean.ticker_dictionary(raw)
    found.write.mode("append").parquet(dictionary_path)
    dictionary = spark.read.schema(TICKER_DICTIONARY).parquet(dictionary_path)
    rows = repaired_rows(raw, dictionary, **options)
    write_cleaned(daily_return(rows), cleaned_path, like=rows)
    if report_path is not None:
        clean_report(raw).write.mode("overwrite").json(report_path)
    return spark.read.parquet(cleaned_path)


def clean_version(
    spark: SparkSession,
    raw_path: str,
    root: str,
    version: str | None = None,
    renumber: bool = False,
    **options: bool,
) -> CleanVersion:
    """Clean into a new version below ``root``: cleaned rows, ticker names and counts, then one swap of the pointer.

    Until the swap, and so also after a failure, readers get the version before, whole. Tickers keep their ids and new
    ones follow; ``renumber`` numbers all in ticker order, as the original does at every run. The counts are those of
    committed files, so no repeated task can be counted twice: the raw rows and the cleaned rows come from the footers,
    what is missing in the latter from two of its columns. ``version`` defaults to the time of the call.
    """
    if version is None:
        version = spark.range(1).select(run_id(F.current_timestamp()).alias("version")).first()["version"]
    before = current_version(spark, root)
    if version == before:
        raise ValueError(f"version {version} is the current one of {root}")
    raw = read_raw(spark, raw_path)
    if before is None or renumber:
        names = found = clean.ticker_dictionary(raw)
    else:
        known = load_clean(spark, root, before).tickers
        found = clean.new_tickers(raw, known)
        names = known.unionByName(found)
    names.write.mode("overwrite").parquet(part(root, "tickers", version))
    names = spark.read.schema(TICKER_DICTIONARY).parquet(part(root, "tickers", version))
    rows = repaired_rows(raw, names, **options)
    write_cleaned(daily_return(rows), part(root, "cleaned", version), like=rows)
    stored = spark.read.parquet(part(root, "cleaned", version))
    unread = F.col("Close").isNull() if "Close" in stored.columns else F.lit(False)
    counts = stored.agg(
        F.lit(raw.count()).alias("rows_read"),
        F.count("*").alias("rows_clean"),
        F.count_if(F.col(TICKER_ID).isNull()).alias("rows_without_ticker"),
        F.count_if(unread).alias("rows_close_unread"),
        F.lit(names.count()).alias("tickers"),
        F.lit(found.count()).alias("new_tickers"),
    )
    counts.write.mode("overwrite").json(part(root, "counts", version))
    point_to(spark, root, version)
    return load_clean(spark, root, version)
