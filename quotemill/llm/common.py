"""Helpers shared by the operators: batch mapping, a store that lives as long as a worker, components."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quotemill.session import settle


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_schema(schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def map_batches(df: DataFrame, setup: Callable, schema: str, rows: int = 512) -> DataFrame:
    """``setup()`` runs once a task and returns a function from column lists to column lists.

    A task never holds more than ``rows`` rows as Python objects.
    """
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                result = work(*(column.to_pylist() for column in batch.slice(at, rows).columns))
                if len(result[0]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, field.type) for x, field in zip(result, out, strict=True)], schema=out
                    )

    return df.mapInArrow(run, schema)


def filter_batches(df: DataFrame, column: str, setup: Callable, rows: int = 512) -> DataFrame:
    """Keep whole rows by a test of one column: no shuffle, no key, every other column untouched."""
    place = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = setup()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                piece = batch.slice(at, rows)
                yield piece.filter(pa.array(keep(piece.column(place).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def replace_batches(df: DataFrame, column: str, setup: Callable, rows: int = 512) -> DataFrame:
    """Rewrite one text column, every other column untouched."""
    place = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = setup()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                piece = batch.slice(at, rows)
                new = pa.array(rewrite(piece.column(place).to_pylist()), piece.schema.field(place).type)
                yield pa.RecordBatch.from_arrays(
                    [new if i == place else c for i, c in enumerate(piece.columns)], schema=piece.schema
                )

    return df.mapInArrow(run, df.schema)


def once_per_worker(key: tuple, make: Callable):
    """``make()`` once in the life of a Python worker: loaded vocabularies and their caches."""
    name = "quotemill_worker_store"
    store = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """``edges(u, v)`` of longs to ``(node, root)`` where root is the smallest node reachable.

    Rounds of "smallest label of a neighbour" and "label of my label". Each is a grouped minimum, which
    combines before the shuffle, and equi-joins that AQE splits on hot keys; each is written to the
    shared folder, so a lost executor costs one round. Ends when a round changes nothing.
    """
    both = settle(
        edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(),
        f"{name}-edges",
    )
    first = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))
    labels = settle(first.select("node", F.least("node", "low").alias("root"), F.lit(True).alias("moved")), f"{name}-0")
    turn = 0
    while labels.filter("moved").limit(1).count():
        turn += 1
        near = (
            both.join(labels.select(F.col("node").alias("v"), "root"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("root").alias("low"))
        )
        stepped = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "low").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        labels = settle(
            stepped.join(jump, "next", "left").select(
                "node",
                F.least("next", F.coalesce("far", "next")).alias("root"),
                (F.least("next", F.coalesce("far", "next")) < F.col("old")).alias("moved"),
            ),
            f"{name}-{turn}",
        )
    return labels.select("node", "root")
