"""Incremental ingest of files, and windows over a stream.

Defined results: an empty source adds nothing; rows without a key count by it like others (a null equals a null). Columns of
``transform``'s result are stored as they are.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ingest_new(spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d, form: str = "parquet") -> None:
    """Appends the rows of files that earlier calls with the same checkpoint have not read, then returns."""
    rows = transform(spark.readStream.schema(schema).format(form).load(source))
    rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def ingest_missing(
    spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str, keys: Sequence[str],
    transform: Callable[[DataFrame], DataFrame] = lambda d: d, form: str = "parquet",
) -> None:
    """Adds the rows of new files whose ``keys`` the output does not hold yet, one row a key, then returns.

    Rows are stored by run (a checkpoint's) and batch, and a batch replaces what an earlier attempt at it wrote; what other
    runs and batches wrote is left out of it by its keys. So neither a batch that is replayed nor a checkpoint that was lost
    adds a row twice.
    """
    rows = transform(spark.readStream.schema(schema).format(form).load(source))
    held_schema = T.StructType([*rows.schema.fields, T.StructField("_run", T.StringType()), T.StructField("_batch", T.LongType())])

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        run = json.loads(session.read.text(f"{checkpoint}/metadata").first()["value"])["id"]
        new = batch.dropDuplicates(list(keys))
        if _there(session, out):
            others = session.read.schema(held_schema).parquet(out).where(~((F.col("_run") == run) & (F.col("_batch") == number)))
            held = others.select(*[F.col(k).alias(f"_held_{k}") for k in keys]).distinct()
            same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_held_{k}")) for k in keys])
            new = new.join(held, same, "left_anti")
        new.withColumn("_run", F.lit(run)).withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_run", "_batch").parquet(out)

    rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def window_counts(rows: DataFrame, ts: str, length: str, slide: str | None = None, late: str = "1 day", keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows and mean value per tumbling or sliding window; works on streams, where rows later than ``late`` drop."""
    held = rows.withWatermark(ts, late) if rows.isStreaming else rows
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    g = held.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), *keys, "n", "total")
