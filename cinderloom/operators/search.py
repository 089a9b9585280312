"""Exact nearest-neighbour search.

Defined results: rows whose vector is null, of another length than the queries or not finite are refused with an error;
a null id of either side is refused too; no queries or an empty index give an empty result; equal scores go to the smaller id.
Ids of queries are unique; those of the index may repeat. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import SCORES, is_valid
from ..session import bound_batches, plain_array

#: Bytes of a block of vectors, and of all queries' blocks up to which they are broadcast.
BLOCK_BYTES, BROADCAST_BYTES = 4 << 20, 64 << 20
#: Bytes of scores that a worker has at a time; ranking them takes a few times as much.
SCORE_BYTES = 4 << 20
DIGITS = 9
REFUSED = "a vector is null, of another length than the queries, or not finite"
BLOCK = "ids array<bigint>, width int, matrix binary"


def knn(index: DataFrame, query: list[float], k: int, metric: str = "cosine") -> DataFrame:
    """(vec_id, score): the k best rows for one query vector."""
    if not np.isfinite(query).all():
        raise ValueError("a query has components that are not finite")
    q = F.array(*[F.lit(float(x)) for x in query])
    score = F.when(is_valid(F.col("v"), len(query)), SCORES[metric](F.col("v"), q)).otherwise(F.raise_error(F.lit(REFUSED)).cast("double"))
    return index.select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def packer(block_bytes: int = BLOCK_BYTES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches of (vec_id, v) to rows of ``BLOCK`` with about ``block_bytes`` of doubles each."""

    def packed(ids: list[pa.Array], rows: list[np.ndarray]) -> pa.RecordBatch:
        matrix = np.concatenate(rows)
        one = lambda n: plain_array(np.array([0, n], np.int32))  # noqa: E731 where the one value of a column lies
        held = pa.ListArray.from_arrays(one(len(matrix)), pa.concat_arrays(ids))
        flat = pa.Array.from_buffers(pa.binary(), 1, [None, one(matrix.nbytes).buffers()[1], pa.py_buffer(matrix)])
        return pa.RecordBatch.from_arrays([held, plain_array(np.array([matrix.shape[1]], np.int32)), flat], names=["ids", "width", "matrix"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, size, width = [], [], 0, None
        for b in batches:
            v = b.column(1)
            flat = v.flatten()
            if b.column(0).null_count or v.null_count or flat.null_count:
                raise ValueError(REFUSED)
            lengths = np.unique(np.from_dlpack(v.value_lengths()))
            if len(lengths) > 1 or (len(lengths) and width not in (None, lengths[0])):
                raise ValueError(REFUSED)
            if not len(v):
                continue
            width = int(lengths[0])
            matrix = np.from_dlpack(flat).astype(np.float64).reshape(len(v), width)
            if not np.isfinite(matrix).all():
                raise ValueError(REFUSED)
            step = max(1, block_bytes // max(1, 8 * width))
            for lo in range(0, len(v), step):
                ids.append(b.column(0).slice(lo, step))
                rows.append(matrix[lo : lo + step])
                size += rows[-1].nbytes
                if size >= block_bytes:
                    yield packed(ids, rows)
                    ids, rows, size = [], [], 0
        if ids:
            yield packed(ids, rows)

    return run


def blocks(vectors: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(ids, width, matrix): the rows of ``vectors`` (vec_id, v) packed, about ``block_bytes`` of doubles at a time, where they
    lie; nothing is shuffled. What is packed already stays as it is."""
    if vectors.columns == ["ids", "width", "matrix"]:
        return vectors
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v").mapInArrow(packer(block_bytes), BLOCK)


def _best(rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query (a row of ``scores``), row id and score of the ``k`` best rows of each query."""
    most = min(k, len(rows))
    least = np.partition(scores, len(rows) - most, axis=1)[:, len(rows) - most]
    query, row = np.nonzero(scores >= least[:, None])
    order = np.lexsort((rows[row], -scores[query, row], query))
    query, row = query[order], row[order]
    best = np.arange(len(query)) - np.searchsorted(query, query) < most
    query, row = query[best], row[best]
    return query, rows[row], scores[query, row]


def knn_batch(index: DataFrame, queries: DataFrame, k: int, *, block_bytes: int = BLOCK_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score) by inner product of the rows of ``index`` with those of ``queries`` (both vec_id, v, or blocks).

    Both are packed into blocks. Queries of up to ``broadcast_bytes`` together are broadcast, so that the index is read once
    where it lies. More of them form a grid with the index: a block of queries goes to every row of the grid and a block
    of the index to every column, and each pair of blocks meets in one cell by an equi-join. A pair gives its k best rows
    per query, and one ranking per query follows. Scores are rounded to ``DIGITS`` places before they are compared, so
    that equal vectors tie wherever they lie.
    """
    bound_batches(index.sparkSession)
    n, width = (F.count(F.lit(1)), F.max(F.size("v"))) if "v" in queries.columns else (F.sum(F.size("ids")), F.max("width"))
    sample = queries.agg(n.alias("n"), width.alias("width")).first()
    size = 8 * (sample["n"] or 0) * max(1, sample["width"] or 1)
    asked = blocks(queries, block_bytes).select(F.col("ids").alias("asked"), F.col("width").alias("w"), F.col("matrix").alias("q"))
    held = blocks(index, block_bytes)
    if size <= broadcast_bytes:
        pairs = held.withColumn("cell", F.lit(0)).join(F.broadcast(asked.withColumn("cell", F.lit(0))), "cell")
    else:
        columns = -(-size // broadcast_bytes)
        lines = max(1, 4 * index.sparkSession.sparkContext.defaultParallelism // columns)
        line, column = F.pmod(F.xxhash64("ids"), F.lit(lines)), F.pmod(F.xxhash64("asked"), F.lit(columns))
        spread = F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column")
        held = held.select("*", line.cast("int").alias("line")).select("*", spread)
        asked = asked.select("*", column.cast("int").alias("column")).select("*", F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("line"))
        pairs = held.join(asked, ["line", "column"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                rows, width, matrix, asked, w, q = (b.column(c)[i] for c in range(6))
                if width.as_py() != w.as_py():
                    raise ValueError(REFUSED)
                m, a = (np.frombuffer(x.as_buffer(), np.float64).reshape(-1, width.as_py()) for x in (matrix, q))
                rows, ids = (np.from_dlpack(x.values) for x in (rows, asked))
                step = max(1, SCORE_BYTES // max(1, 8 * len(m)))  # scores of a few queries at a time
                for lo in range(0, len(a), step):
                    scores = a[lo : lo + step] @ m.T
                    query, row, score = _best(rows, np.round(scores, DIGITS, out=scores), k)
                    yield pa.RecordBatch.from_arrays([plain_array(ids[lo + query]), plain_array(row), plain_array(score)], names=["query_id", "vec_id", "score"])

    local = pairs.select("ids", "width", "matrix", "asked", "w", "q").mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
