"""Reading and writing the price tables."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from quotemill.schemas import DATE, PROVENANCE_COLUMNS, TICKER_ID
from quotemill.session import settle


# rows of a file of the cleaned table: about 200 MB
PER_FILE = 4_000_000
NOTHING_THERE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_parquet_files(
    spark: SparkSession, path: str, files: str = "*.parquet", merge: bool = True
) -> DataFrame:
    """All Parquet files under ``path``, stacked over the union of their columns.

    Finding no file is an error of its own; any other trouble is raised as it is.
    """
    try:
        return spark.read.option("mergeSchema", merge).option("pathGlobFilter", files).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() not in NOTHING_THERE:
            raise
        raise FileNotFoundError(f"no files {files} found in {path}") from problem


def _read_merged(spark: SparkSession, path: str) -> DataFrame:
    """Merged schemas, or a read per schema with widened types where a column's types differ."""
    try:
        return read_parquet_files(spark, path)
    except (PySparkException, Py4JJavaError) as problem:
        if "CANNOT_MERGE" not in str(problem):
            raise
        return read_stacked(spark, path)


def read_raw(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Raw price rows, without the provenance that landing adds.

    With a declared ``schema`` one file is opened while planning, to see that there is any;
    otherwise the files' schemas are merged, and types that differ are widened.
    """
    if schema is None:
        return _read_merged(spark, path).drop(*PROVENANCE_COLUMNS)
    read_parquet_files(spark, path, merge=False)
    rows = spark.read.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path)
    return rows.drop(*PROVENANCE_COLUMNS)


def read_cleaned(spark: SparkSession, path: str) -> DataFrame:
    return read_parquet_files(spark, path)


def day_slots(rows: DataFrame, per_file: int) -> tuple[DataFrame, int]:
    """``(Date, slot, width)``: the files each day is dealt over, and how many files there are.

    The files follow the days in order and hold about ``per_file`` rows; a day with more gets several. One row per day: the
    running sum is over the calendar, not over the rows.
    """
    days = settle(rows.groupBy(DATE).agg(F.count("*").alias("n")), "days")
    total = days.agg(F.sum("n")).first()[0] or 0
    files = max(1, -(-total // per_file))
    to_here = F.sum("n").over(Window.orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0))
    at = lambda row: F.floor(row * files / total) if total else F.lit(0)
    placed = days.select(F.col(DATE).alias("_day"), "n", to_here.alias("_sum"))
    first, last = at(F.col("_sum") - F.col("n")), at(F.col("_sum") - 1)
    return placed.select("_day", first.cast("int").alias("_slot"), (last - first + 1).cast("int").alias("_width")), files


def write_cleaned(df: DataFrame, path: str, like: DataFrame | None = None, per_file: int = PER_FILE) -> None:
    """Replace the cleaned table, laid out by date so that date filters skip files.

    The row hash lets the split go through a day or a ticker that holds many rows. Spark's range split works ``df`` out
    a first time to sample it. With ``like``, a written table of the same days, the files are chosen from its counts a
    day instead, and ``df`` is worked out once.
    """
    order = [c for c in (DATE, TICKER_ID) if c in df.columns]
    spread = F.xxhash64(*[F.col(f"`{name}`") for name in df.columns])
    if like is not None and DATE in order:
        slots, files = day_slots(like, per_file)
        slot = F.coalesce(F.col("_slot") + F.pmod(spread, "_width"), F.lit(0)).cast("int")
        dealt = df.join(slots, df[DATE].eqNullSafe(slots["_day"]), "left").withColumn("_file", slot)
        df = dealt.repartitionById(files, "_file").sortWithinPartitions(*order).select(*(f"`{c}`" for c in df.columns))
    elif order:
        df = df.repartitionByRange(*order, spread).sortWithinPartitions(*order)
    df.write.mode("overwrite").parquet(path)


def list_files(spark: SparkSession, path: str, files: str = "*.parquet") -> list[str]:
    """Paths of all files under ``path`` at any depth; none is an error. Only names travel, no content is read."""
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", files).option("recursiveFileLookup", True).load(path)
        names = sorted(r["path"] for r in found.select("path").collect())
    except AnalysisException as problem:
        if problem.getCondition() not in NOTHING_THERE:
            raise
        names = []
    if not names:
        raise FileNotFoundError(f"no files {files} found in {path}")
    return names


def schema_groups(spark: SparkSession, names: list[str], at_once: int = 32) -> list[tuple[T.StructType, list[str]]]:
    """Files by their own schema. Each footer is read by a task of its own; ``at_once`` such jobs run side by side."""
    with ThreadPoolExecutor(at_once) as pool:
        schemas = list(pool.map(lambda name: spark.read.parquet(name).schema, names))
    groups: dict[str, tuple[T.StructType, list[str]]] = {}
    for name, schema in zip(names, schemas, strict=True):
        groups.setdefault(schema.json(), (schema, []))[1].append(name)
    return list(groups.values())


def common_type(types: list[T.DataType]) -> T.DataType:
    """The type all values fit: itself, the wider of whole numbers, double for other numbers, else text."""
    if all(t == types[0] for t in types):
        return types[0]
    whole = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
    if all(t in whole for t in types):
        return max(types, key=whole.index)
    if all(isinstance(t, T.NumericType) for t in types):
        return T.DoubleType()
    if all(isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) for t in types):
        return T.TimestampNTZType()
    return T.StringType()


def stack_widened(parts: list[DataFrame]) -> DataFrame:
    """All rows over the union of the columns; a column whose types differ gets their common type."""
    kinds: dict[str, list[T.DataType]] = {}
    for part in parts:
        for field in part.schema.fields:
            kinds.setdefault(field.name, []).append(field.dataType)
    widest = {name: common_type(types) for name, types in kinds.items()}
    cast = [part.select(*(F.col(f"`{name}`").cast(widest[name]).alias(name) for name in part.columns)) for part in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def read_stacked(spark: SparkSession, path: str, files: str = "*.parquet", only: set[str] | None = None) -> DataFrame:
    """All files under ``path``, read once per schema and stacked with widened types; partition columns as text.

    ``only`` keeps the files landed under these names.
    """
    names = list_files(spark, path, files)
    if only is not None:
        names = [n for n in names if landed_name(n) in only]
    parts = []
    for schema, group in schema_groups(spark, names):
        columns = T.StructType([f for f in schema.fields if f.name != "original_filename"])
        rows = spark.read.schema(columns).parquet(*group)
        if landed_name(group[0]) is not None:
            folder = F.regexp_extract(_file_path(), LANDED, 1)
            rows = rows.withColumn("original_filename", _decoded(folder))
        parts.append(rows)
    return stack_widened(parts)


LANDED = "/original_filename=([^/]+)/"


def landed_name(path: str) -> str | None:
    """The name that a file of the raw table was landed under."""
    found = re.search(LANDED, path)
    return unquote(found.group(1)) if found else None


def _decoded(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def _file_path() -> Column:
    """Path of a row's file as it is listed."""
    return _decoded(F.col("_metadata.file_path"))


def land_raw(
    spark: SparkSession,
    source: str,
    target: str,
    uploaded_by: str = "upload_script",  # fixed value
    files: str = "*.parquet",
) -> DataFrame:
    """Land the files under ``source``, each with its own columns and types under its own name, with its provenance.

    The name is the path below ``source``, so that equal names in two folders stay two files. Files of one schema are read and
    written together, one job a schema; a file gets no column of another. A file landed before under the same
    name is replaced, the others stay. Returns the rows now landed under the names of this call, stacked with widened
    types. No file to land is an error.
    """
    names = list_files(spark, source, files)
    folder = source.split(":", 1)[-1].strip("/")
    above = names[0].split(":", 1)[-1].find(f"{folder}/")
    # from the root of the store to the folder; a source that is itself a file has its own folder instead
    whole = names[0].split(":", 1)[-1]
    top = whole[: above + len(folder)] if above >= 0 else whole.rsplit("/", 1)[0]
    below = F.substr(_file_path(), F.locate(f"{top}/", _file_path()) + F.lit(len(top) + 1))
    landed = set()
    for _, group in schema_groups(spark, names):
        landed |= {name.split(":", 1)[-1][len(top) + 1 :] for name in group}
        rows = spark.read.parquet(*group).select("*", F.lit(uploaded_by).alias("uploaded_by"), below.alias("original_filename"))
        (
            rows.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("original_filename")
            .parquet(target)
        )
    return read_stacked(spark, target, only=landed)
