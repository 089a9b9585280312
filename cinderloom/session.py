"""Session settings that right results and bounded workers depend on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of rows that Spark sends a Python worker of a search at a time (a single row may be larger); Spark's own bound is 64 MB.
ARROW_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """From now on workers get ``ARROW_BYTES`` at a time: texts as words and blocks of vectors are wide rows, and every step of
    a task has a worker that holds a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def plain_array(x: np.ndarray) -> pa.Array:
    """``x`` as an Arrow array of its type without nulls. ``pa.array`` would load pandas, some 40 MB, into each worker; so would
    ``to_numpy``, for which workers of a search take ``np.from_dlpack``."""
    x = np.ascontiguousarray(x)
    return pa.Array.from_buffers(pa.from_numpy_dtype(x.dtype), len(x), [None, pa.py_buffer(x)])


def settle(spark: SparkSession) -> SparkSession:
    """Turns off what Spark 4.1 assumes of a union's partitioning.

    It takes a union of inputs dealt by the same key for dealt by that key, also where their numbers of partitions or tasks
    differ; a later window or aggregation then skips its exchange and sees a key in several pieces (the query qa_blend
    ranked each question's answers twice over).
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark
