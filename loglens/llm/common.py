"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.session import checkpoint_root

# ASCII white space of the word contracts: space and \t \n \v \f \r
SPACES = "\t\n\x0b\x0c\r "

# Text bytes that a Python task holds at a time, besides one single longer text.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text without null."""
    return F.array_remove(F.split(F.translate(text, SPACES[:-1], " " * 5), " ", -1), "")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``size`` bytes of text."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        per_row = max(1, batch.column(column).nbytes // n)
        step = max(1, size // per_row)
        if step >= n:
            yield batch
            continue
        start, held = 0, 0
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for i, length in enumerate(lengths):
            if held and held + length > size:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += length
        yield batch.slice(start)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write to the shared checkpoint folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_root(spark), f"{what}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_back(df: DataFrame, facts: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join per-key facts (one row a key, columns named ``_...``) to all rows of df; null keys meet null keys."""
    right = facts.withColumnRenamed(key, "_key")
    return df.join(right, df[key].eqNullSafe(F.col("_key")), how).drop("_key")
