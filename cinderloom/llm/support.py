"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle

#: Runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_RUN = r"[\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return settle(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none (tests)."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="cinderloom-")
        sc.setCheckpointDir(folder)
    return folder


#: A task buffers a row group before it writes it, and decompresses pages before it reads them: small ones keep wide rows in
#: bounds, and zstd needs no buffers outside the heap that only a collection frees.
WRITE = {"compression": "zstd", "parquet.block.size": str(16 << 20), "parquet.compression.codec.zstd.level": "1"}


#: Spark removes a query's shuffle files as it ends, not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Of each thread: for every ``recorded`` block that is open, the paths of the tables written in it.
_open = threading.local()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there, and a lost executor loses nothing. What was
    shuffled for it goes with the write."""
    spark = settle(df.sparkSession)
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.options(**WRITE).parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    if blocks := getattr(_open, "blocks", None):
        blocks[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables that ``materialize`` writes inside the block, for ``drop_paths`` once nothing reads them."""
    _open.blocks = [*getattr(_open, "blocks", []), []]
    try:
        yield _open.blocks[-1]
    finally:
        _open.blocks.pop()


def drop_paths(spark: SparkSession, paths: Sequence[str]) -> None:
    sc = spark.sparkContext
    for p in paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def drop_table(df: DataFrame) -> None:
    """Remove a table that ``materialize`` wrote and nothing reads any more."""
    drop_paths(df.sparkSession, [file.rpartition("/")[0] for file in df.inputFiles()[:1]])


def words(text: Column, pattern: str = SPACE_RUN) -> Column:
    """Words as an array; a null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), pattern)
    return F.filter(parts, lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def document_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Internal row identity: the id (null last) and a hash of the text, for ids that repeat with other texts."""
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("_doc"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(text_col).isNull()).alias("_th"),
    ]
