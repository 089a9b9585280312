"""Exact top-k search by inner product as a Voronoi kNN join.

Inner products become distances by one more coordinate: with R the largest squared norm, |q - (x, sqrt(R - |x|^2))|^2
= |q|^2 + R - 2 q.x. A bounded sample of vectors gives pivots, about as many as the square root of the rows; every vector
belongs to its nearest pivot. Near pivots are put together in groups of ``group_pivots``, at every size of the tables, or of
about ``group_queries`` queries where that is fewer pivots; a group is sent its data once.

First every group is solved against the data of its own cells. That gives each query a k-th score that the true one
cannot be below, so a distance bound. Summaries (per group and cell, the least and the greatest distance from the pivot
that a bound allows, by the triangle inequality; per cell, its rows and radius) then say which rows of other cells can
still matter to a group. Those rows alone are replicated, dealt over as many parts as the counts ask for, and solved
by matrix products; the parts' k best meet in one more ranking.

Vectors are integers floor(scale * x), so scores are exact; bounds are in doubles with a margin. A query id that repeats
asks once, with its smallest vector.

Defined results: null vectors, vectors with null or non-finite components and rows without an id take no part, nor
do vectors of another length than ``dim`` (by default the most frequent one), which have no inner product with the rest.
A query's own row is any row with its id. Ties go to the smaller id. An empty table gives an empty result. Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import materialize

#: Rows of a part of a query cell, at most about: bounds what one task holds.
PART_ROWS, PART_QUERIES = 20_000, 8_000
MIN_PIVOTS, MAX_PIVOTS, GROUP_PIVOTS = 8, 512, 8
MARGIN = 1e-6


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: float, dim: int | None) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    out = df.where(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("v"))
    if dim is None:
        found = out.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = found["d"] if found else 0
    return out.where(F.size("v") == dim)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def top_k_search(
    vectors: DataFrame,
    *,
    k: int = 10,
    query_modulus: int = 100,
    scale: float = 1024.0,
    pivots: int | None = None,
    group_queries: int = PART_QUERIES,
    sample: int = 4096,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    dim: int | None = None,
    group_pivots: int = GROUP_PIVOTS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for every row whose id ``query_modulus`` divides."""
    _, _, local = _plan(vectors, k, query_modulus, scale, pivots, group_queries, sample, id_col, vec_col, dim, group_pivots)
    if local is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def pivot_groups(centre: np.ndarray, queries: dict[int, int], most: int, wide: int) -> list[int]:
    """Group of each pivot: a walk from pivot to nearest pivot, cut where a group has ``wide`` pivots or would have over ``most``
    queries."""
    left, at = set(range(1, len(centre))), 0
    group, held, number, size = [0] * len(centre), queries.get(0, 0), 0, 1
    while left:
        near = np.fromiter(left, np.int64)
        at = int(near[((centre[near] - centre[at]) ** 2).sum(1).argmin()])
        left.discard(at)
        if size >= wide or (held and held + queries.get(at, 0) > most):
            number, held, size = number + 1, 0, 0
        group[at] = number
        held += queries.get(at, 0)
        size += 1
    return group


def _plan(vectors: DataFrame, k: int, query_modulus: int, scale: float, pivots: int | None, group_queries: int, sample: int, id_col: str, vec_col: str, dim: int | None, group_pivots: int = GROUP_PIVOTS):
    """Placed vectors, the rows (cell, grp, lo, hi) that other groups need, and (query_id, vec_id, score) of all parts."""
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_col, vec_col, scale, dim)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("r")).first()
    if not stats["n"]:
        return None, None, None
    pivots = pivots or min(MAX_PIVOTS, max(MIN_PIVOTS, int(stats["n"] ** 0.5)))
    top_norm = float(stats["r"])
    # pivots: the sample's rows of smallest id hash, distinct
    drawn = rows.withColumn("h", F.xxhash64("id", F.lit("pivot"))).orderBy("h", "id").limit(sample).select("v").collect()
    seen = np.unique(np.array([r["v"] for r in drawn]), axis=0)
    centre = seen[np.random.default_rng(0).permutation(len(seen))[:pivots]]
    centre = np.hstack([centre, np.sqrt(np.maximum(0.0, top_norm - (centre**2).sum(1)))[:, None]])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(1))
            if not len(v):
                continue
            ids = b.column(0).to_numpy()
            norm = (v**2).sum(1)
            full = np.hstack([v, np.sqrt(np.maximum(0.0, top_norm - norm))[:, None]])

            def near(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                d = np.sqrt(np.maximum(0.0, (x**2).sum(1)[:, None] + (centre**2).sum(1)[None, :] - 2 * x @ centre.T))
                cell = d.argmin(1)
                return cell, d[np.arange(len(d)), cell]

            cell, dist = near(full)
            q_cell, q_dist = near(np.hstack([v, np.zeros((len(v), 1))]))
            is_query = ids % query_modulus == 0
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(cell.astype("int32")), pa.array(dist), pa.array(is_query), pa.array(q_cell.astype("int32")), pa.array(q_dist)],
                names=["id", "v", "cell", "dist", "is_query", "q_cell", "q_dist"],
            )

    placed = materialize(rows.mapInArrow(assign, "id long, v array<double>, cell int, dist double, is_query boolean, q_cell int, q_dist double"))
    cells = materialize(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("far")))
    asked = {r["q_cell"]: r["n"] for r in placed.where("is_query").groupBy("q_cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a pivot
    if not asked:
        return None, None, None
    of_pivot = pivot_groups(centre, asked, group_queries, group_pivots)
    sizes = [sum(n for c, n in asked.items() if of_pivot[c] == g) for g in range(max(of_pivot) + 1)]
    q_parts = [max(1, -(-n // PART_QUERIES)) for n in sizes]
    number = lambda values, at: F.get(F.array(*[F.lit(x) for x in values]), F.col(at))
    queries = placed.where("is_query").groupBy("id").agg(F.min(F.struct("v", "q_cell")).alias("x"))
    queries = materialize(queries.select("id", "x.v", number(of_pivot, "x.q_cell").alias("grp")))
    by_group = cells.withColumn("grp", number(of_pivot, "cell"))

    def solve(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, "int64"), "vec_id": np.zeros(0, "int64"), "score": np.zeros(0, "int64")})
        if not len(q) or not len(s):
            return none
        s = s.sort_values("id", kind="stable")
        ids, block = s["id"].to_numpy(), np.stack(s["v"].to_numpy())
        out = []
        for start in range(0, len(q), 64):
            some = q.iloc[start : start + 64]
            scores = np.stack(some["qv"].to_numpy()) @ block.T
            for qid, line in zip(some["qid"].to_numpy(), scores, strict=True):
                line[ids == qid] = -np.inf
                best = np.argpartition(-line, k)[: k + 1] if len(line) > k + 1 else np.arange(len(line))
                best = np.flatnonzero(line >= np.sort(line[best])[::-1][min(k, len(best)) - 1])
                best = best[np.lexsort((ids[best], -line[best]))][:k]
                best = best[np.isfinite(line[best])]
                out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[best], "score": line[best].astype("int64")}))
        return pd.concat(out) if out else none

    def solved(data: DataFrame, parts: DataFrame) -> DataFrame:
        """The k best of each part; ``data`` has (grp, id, v), ``parts`` the number of parts (grp, parts)."""
        keys = ["grp", "part", "q_part"]
        split = number(q_parts, "grp")
        data = data.join(parts, "grp").select(
            "grp", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), split - 1)).alias("q_part"), "id", "v"
        )
        asking = queries.join(parts, "grp").select(
            F.col("grp").alias("q_grp"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q_part"), F.pmod(F.xxhash64("id"), split).cast("int").alias("q_q_part"),
            F.col("id").alias("qid"), F.col("v").alias("qv"),
        )
        return asking.groupBy("q_grp", "q_part", "q_q_part").cogroup(data.groupBy(*keys)).applyInPandas(solve, "query_id long, vec_id long, score long")

    in_parts = F.ceil(F.sum("n") / PART_ROWS).cast("int").alias("parts")
    own = materialize(solved(placed.select(number(of_pivot, "cell").alias("grp"), "id", "v"), by_group.groupBy("grp").agg(in_parts)))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    kth = own.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select(F.col("query_id").alias("id"), "score")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per group and cell, between which distances from the pivot a row can be better than a query's k-th."""
        for b in batches:
            v = _matrix(b.column(1))
            if not len(v):
                continue
            norm = (v**2).sum(1)
            score = np.array([-np.inf if x is None else x for x in b.column(3).to_pylist()], float)
            bound = np.sqrt(np.maximum(0.0, norm + top_norm - 2 * score))
            full = np.hstack([v, np.zeros((len(v), 1))])
            d = np.sqrt(np.maximum(0.0, norm[:, None] + (centre**2).sum(1)[None, :] - 2 * full @ centre.T))
            margin = MARGIN * (1 + d + np.where(np.isfinite(bound), bound, 0.0)[:, None])
            lo, hi = d - bound[:, None] - margin, np.minimum(d + bound[:, None] + margin, 1e300)
            grp = b.column(2).to_numpy()
            for g in np.unique(grp):
                mine = grp == g
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(centre), g, "int32")), pa.array(np.arange(len(centre), dtype="int32")), pa.array(np.maximum(lo[mine].min(0), -1e300)), pa.array(hi[mine].max(0))],
                    names=["grp", "cell", "lo", "hi"],
                )

    bounded = queries.join(kth, "id", "left").select("id", "v", "grp", "score")
    need = bounded.mapInArrow(reach, "grp int, cell int, lo double, hi double").groupBy("grp", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    need = need.join(by_group.withColumnRenamed("grp", "home"), "cell").where((F.col("grp") != F.col("home")) & (F.col("far") >= F.col("lo")))
    need = materialize(need.select("cell", "grp", "lo", "hi", "n"))
    other = placed.join(need.drop("n"), "cell").where("dist BETWEEN lo AND hi").select("grp", "id", "v")
    rest = solved(other, need.groupBy("grp").agg(in_parts))
    return placed, need, own.unionByName(rest)
