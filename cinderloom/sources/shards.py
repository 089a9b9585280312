"""Vector shards: ``.npy`` matrices of a row per keyframe, read as a data source of row ranges.

Only headers are read to plan a scan; a range of rows is a partition, so that one large file is many tasks. Paths may be local or of
any store that Arrow's file systems open; ``headers`` lists files by Spark.

Defined results: a file that is no two-dimensional matrix of floats in row order, is shorter than its header says, or has another
width than the others stops a scan; ``shard_issues`` lists such files beforehand. Matrices without rows give none. No
files are an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.text import file_stem

SCHEMA = "path string, row long, embedding array<float>"
RANGE_BYTES, READ_BYTES = 32 << 20, 4 << 20


def _opened(path: str):
    store, at = (pyarrow.fs.LocalFileSystem(), path) if path.startswith("/") else pyarrow.fs.FileSystem.from_uri(path)
    return store, at


def read_header(path: str) -> dict:
    """rows, width, dtype, offset of the data, and what is wrong (null if nothing is)."""
    store, at = _opened(path)
    out = {"rows": None, "width": None, "dtype": None, "offset": None, "code": None}
    with store.open_input_file(at) as f:
        try:
            version = np.lib.format.read_magic(f)
            shape, by_columns, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        except ValueError:
            return out | {"code": "not_a_matrix"}
        out |= {"dtype": dtype.name, "offset": f.tell()}
        if len(shape) != 2:
            return out | {"code": "not_two_dimensional"}
        out |= {"rows": shape[0], "width": shape[1]}
        if dtype.kind != "f":
            return out | {"code": "not_floats"}
        if by_columns and min(shape) > 1:
            return out | {"code": "not_in_row_order"}
        return out | {"code": "too_short" if f.size() < f.tell() + math.prod(shape) * dtype.itemsize else None}


def list_files(path: str) -> list[str]:
    """The ``.npy`` files of a folder, or the one file, in order."""
    store, at = _opened(path)
    head = "" if path.startswith("/") else path[: path.index("://") + 3] if not path.startswith("file:") else "file://"
    found = store.get_file_info(at)
    infos = [found] if found.is_file else store.get_file_info(pyarrow.fs.FileSelector(at, recursive=True)) if found.type == pyarrow.fs.FileType.Directory else []
    return sorted(head + i.path for i in infos if i.is_file and i.path.endswith(".npy"))


@dataclass
class RowRange(InputPartition):
    path: str
    offset: int
    width: int
    dtype: str
    start: int
    stop: int


class NpyReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.range_bytes = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[RowRange]:
        files = list_files(self.path)
        if not files:
            raise ValueError(f"no .npy files in {self.path}")
        with ThreadPoolExecutor(16) as pool:
            heads = list(pool.map(read_header, files))
        out, widths = [], {h["width"] for h in heads}
        if wrong := [f"{f}: {h['code']}" for f, h in zip(files, heads, strict=True) if h["code"]]:
            raise ValueError("; ".join(wrong[:5]))
        if len(widths) > 1:
            raise ValueError(f"vectors of several widths: {sorted(widths)}")
        for path, h in zip(files, heads, strict=True):
            step = max(1, self.range_bytes // max(1, h["width"] * np.dtype(h["dtype"]).itemsize))
            out += [RowRange(path, h["offset"], h["width"], h["dtype"], at, min(h["rows"], at + step)) for at in range(0, h["rows"], step)]
        return out

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        if partition is None:  # matrices without rows
            return
        kind = np.dtype(partition.dtype)
        store, at = _opened(partition.path)
        row_bytes = partition.width * kind.itemsize
        step = max(1, READ_BYTES // max(1, row_bytes))
        with store.open_input_file(at) as f:
            for lo in range(partition.start, partition.stop, step):
                n = min(step, partition.stop - lo)
                flat = np.frombuffer(f.read_at(n * row_bytes, partition.offset + lo * row_bytes), kind).astype(np.float32)
                vectors = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * partition.width, flat)
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n), pa.array(np.arange(lo, lo + n)), vectors], names=["path", "row", "embedding"])


class NpySource(DataSource):
    """``spark.read.format("npy").load(path)``; the option ``rangeBytes`` sets the size of a partition."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(self.options)


def vector_shards(spark: SparkSession, path: str, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, video_id, row, embedding) of all shards under ``path``; the video is the file's name, in capitals."""
    spark.dataSource.register(NpySource)
    rows = spark.read.format("npy").option("rangeBytes", range_bytes).load(path)
    return rows.select("path", F.upper(file_stem(F.col("path"))).alias("video_id"), "row", "embedding")


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, rows, width, dtype, code) of all shards, read by Spark tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(path).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"path": p} | read_header(p.replace("file:/", "/", 1) if p.startswith("file:/") else p) for p in b.column(0).to_pylist()]
            schema = pa.schema([("path", pa.string()), ("rows", pa.int64()), ("width", pa.int64()), ("dtype", pa.string()), ("code", pa.string())])
            yield from pa.Table.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema).to_batches()

    return files.mapInArrow(run, "path string, rows long, width long, dtype string, code string")


def shard_issues(heads: DataFrame) -> DataFrame:
    """(path, code): shards that cannot be read, and those whose width or type is not that of most (ties to the smaller)."""
    usual = heads.where("code IS NULL").agg(*[F.mode(c, True).alias(f"usual_{c}") for c in ("width", "dtype")]).withColumn("_one", F.lit(1))
    both = heads.withColumn("_one", F.lit(1)).join(F.broadcast(usual), "_one")  # one row
    code = F.coalesce("code", F.when(F.col("width") != F.col("usual_width"), "other_width"), F.when(F.col("dtype") != F.col("usual_dtype"), "other_dtype"))
    return both.select("path", code.alias("code")).where("code IS NOT NULL")


def write_shards(vectors: DataFrame, path: str, *, shard_rows: int = 65_536) -> DataFrame:
    """Writes vectors (name, row, v) as float32 matrices of ``shard_rows`` rows at most, a name's rows in order in the files
    ``<name>_<number>.npy``, and returns (path, rows) of what was written. A shard is one task's group; a lost task writes the
    same files again. Vectors of a shard have one length."""
    keyed = vectors.select("name", "row", "v", F.floor(F.col("row") / shard_rows).cast("long").alias("shard"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        matrix = np.stack([np.asarray(v, np.float32) for v in table["v"].to_pylist()])
        target = f"{path}/{table['name'][0].as_py()}_{table['shard'][0].as_py()}.npy"
        store, at = _opened(target.replace("file:/", "/", 1) if target.startswith("file:/") else target)
        store.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(at) as f:
            np.lib.format.write_array(f, matrix, allow_pickle=False)
        return pa.table({"path": [target], "rows": pa.array([len(matrix)], pa.int64())})

    return keyed.groupBy("name", "shard").applyInArrow(run, "path string, rows long")
