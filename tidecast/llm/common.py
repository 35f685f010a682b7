"""Helpers shared by the corpus operators: task-side text batches, sizes and written stages."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.session import fresh_path, remove

#: Text handled at once inside a task; bounds a Python worker's memory whatever a batch holds.
SLICE_BYTES = 8 << 20


#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are bounded by ``BATCH_BYTES``.

    Texts can be long, and the default of 64 MB a batch is held twice by every task. A smaller
    setting of the session stays.
    """
    conf = df.sparkSession.conf
    if int("".join(c for c in str(conf.get(_BATCH_CONF, "67108864")) if c.isdigit())) > BATCH_BYTES:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return df


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts_of(docs: DataFrame, *extra: str) -> DataFrame:
    """Only the columns an operator needs; a null text becomes an empty one."""
    return bounded(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *[F.col(c) for c in extra],
    )


def written(df: DataFrame, name: str) -> DataFrame:
    """A small intermediate table in the shared folder: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._tidecast_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete ``written`` tables that nothing reads any more, and the shuffles of finished jobs.

    Spark deletes a shuffle's files once the driver has collected the plan it belongs to, which
    with a large heap may not happen before the query's end.
    """
    spark = tables[0].sparkSession
    remove(spark, [t._tidecast_path for t in tables])
    spark.sparkContext._jvm.System.gc()


@cache
def _trim():
    """The C library's call that returns freed pages, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda keep: 0)


def give_back() -> None:
    """Return freed memory to the system: a worker outlives its task, and what it keeps counts against its executor."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return column(batch, name).to_numpy(zero_copy_only=False)


def offsets(array: pa.Array) -> np.ndarray:
    """Start of every value of a string or list array, and the end of the last, from 0."""
    if pa.types.is_string(array.type) or pa.types.is_large_string(array.type):
        lengths = pc.binary_length(array)
    else:
        lengths = pc.list_value_length(array)
    out = np.zeros(len(array) + 1, np.int64)
    np.cumsum(lengths.to_numpy(zero_copy_only=False), out=out[1:])
    return out


def slices(batches: Iterable[pa.RecordBatch], name: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        ends = offsets(column(batch, name))[1:]
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
            give_back()


def coded(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a list array, the code of each occurrence, and each row's offsets."""
    flat = lists.flatten().dictionary_encode()
    return flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets(lists)


def gather(starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Positions of the values of ``codes``, one run after another, in arrays laid end to end."""
    counts = lengths[codes]
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts[codes] - (ends - counts), counts)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive ``bounds``; 0 for empty runs."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[bounds[1:]] - total[bounds[:-1]]


def to_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
