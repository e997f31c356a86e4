"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeflow.session import store  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most rows and bytes of an Arrow batch: documents are long, and a batch is held by a Python worker.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes, so that a worker's memory follows the longest text, not the row count.

    This sets two options of the session, and they stay set: Spark reads them when a plan runs.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` does the same where all characters are ASCII, and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema for a flat DDL string of the types used here."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<float>": pa.list_(pa.float32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.strip().split(" ", 1) for x in ddl.split(","))])


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """A batch from Python lists or numpy arrays, one for each field."""
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(columns, schema)], schema=schema)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every (start, length), one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def row_key(*columns: str) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a row's columns: together they tell rows apart, whatever ids repeat or are null.
    Rows alike in all the columns share a key."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)


def whole_runs(batches: Iterator[pa.RecordBatch], key: str, *others: str) -> Iterator[tuple[np.ndarray, ...]]:
    """Number columns of batches sorted by ``key``, cut so that all rows of one key come together. Reads no batch ahead."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        columns = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in (key, *others))
        keys = columns[0]
        if not len(keys):
            continue
        if held and keys[-1] == held[0][0][0]:  # one key alone, and it may go on
            held.append(columns)
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        done = [*held, tuple(c[:cut] for c in columns)]
        held = [tuple(c[cut:] for c in columns)]
        if sum(len(x[0]) for x in done):
            yield tuple(np.concatenate(x) for x in zip(*done))
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))
