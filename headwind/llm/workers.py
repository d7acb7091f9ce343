"""Runs array code in the executors' Python, and keeps their memory small."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from headwind.session import ship

#: Bytes of the rows that Spark sends to a worker at once. A batch is there several times over, in the executor and in the
#: worker, for each task; Spark's own bounds are 10,000 rows and 64 MB.
SENT_BYTES, _SENT = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def give_back() -> None:
    """Return freed memory to the system: a worker outlives its task, and so would what its allocators keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def send_little(spark: SparkSession) -> None:
    """Bound what is sent to workers at once by SENT_BYTES or one row, unless the session has a lower bound."""
    set_to = spark.conf.get(_SENT, None)
    if set_to is None or not 0 < spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(set_to) <= SENT_BYTES:
        spark.conf.set(_SENT, str(SENT_BYTES))


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) on batches of bounded size, with freed memory given back at the end of each task."""
    ship(df.sparkSession)
    send_little(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)
