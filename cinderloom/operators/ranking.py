"""Video aggregation and diversification. Candidates: (query_id, candidate_id, video_id, ts, score)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Allowance for rounding where relevances are compared.
SLACK = 1e-9


def aggregate_by_video(candidates: DataFrame, top_n: int = 3) -> DataFrame:
    """0.65 best + 0.35 mean of the ``top_n`` best + 0.05 share of the modalities seen among them."""
    rows = candidates.where("video_id IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("query_id", "video_id").orderBy(F.desc("score"), "candidate_id"))
    every = rows.groupBy("query_id").agg(F.count_distinct("modality").alias("every"))
    best = rows.withColumn("r", rank).where(F.col("r") <= top_n).groupBy("query_id", "video_id").agg(
        F.max("score").alias("best"), F.avg("score").alias("mean"), F.count_distinct("modality").alias("seen")
    )
    score = 0.65 * F.col("best") + 0.35 * F.col("mean") + 0.05 * F.col("seen") / F.greatest(F.col("every"), F.lit(1))
    return best.join(every, "query_id").select("query_id", "video_id", score.alias("score"))


def diversify(candidates: DataFrame, limit: int = 100, same_video: float = 0.08, temporal: float = 0.35, radius: float = 2.0, max_per_video: int | None = None) -> DataFrame:
    """Greedy choice by relevance less penalties for candidates of the same video that are chosen already.

    Penalties depend on one's own video alone and only grow, so the greedy order inside each (query, video) with the
    utility at each choice, sorted over all videos, is the global greedy order, and no video gives more than ``limit``.
    At any of its choices one of a video's ``limit`` most relevant candidates is still there, at a loss of ``temporal`` at
    most against the others, so candidates that are less relevant by more than that are never chosen: they are left out
    before the choice. The choice takes time in proportion to the rest and ``limit``.

    Defined results: a null video is one video, a null time is near nothing, of equal utilities the higher score and then
    the higher id goes first, candidates without a score are left out; an empty table gives an empty result. Other columns are dropped.
    """
    if min(same_video, temporal) < 0:
        raise ValueError("penalties are not negative")
    if limit < 1 or radius <= 0 or (max_per_video is not None and max_per_video < 1):
        raise ValueError("limits and the radius are positive")
    ends = candidates.groupBy(F.col("query_id").alias("_query")).agg(F.min("score").alias("_low"), F.max("score").alias("_high"))
    low, high = F.col("_low"), F.col("_high")  # joined, as a window would hold a query with all its candidates in one task
    rows = candidates.join(ends, F.col("query_id").eqNullSafe(F.col("_query")))
    rows = rows.withColumn("relevance", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))
    rows = rows.withColumn("video_id", F.coalesce("video_id", F.lit(-1)))
    most = limit if max_per_video is None else min(limit, max_per_video)
    video = Window.partitionBy("query_id", "video_id")
    rows = rows.withColumn("place", F.row_number().over(video.orderBy(F.desc("relevance"))))
    last = F.min(F.when(F.col("place") <= most, F.col("relevance"))).over(video)
    rows = rows.withColumn("last", last).where(F.col("relevance") >= F.col("last") - temporal - SLACK)

    def choose(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values(["score", "candidate_id"], ascending=False, ignore_index=True)
        ts, relevance = pool["ts"].to_numpy(float), pool["relevance"].to_numpy(float)
        near = np.zeros(len(pool))
        left = np.ones(len(pool), bool)
        chosen, utilities = [], []
        while len(chosen) < min(most, len(pool)):
            utility = np.where(left, relevance - same_video * len(chosen) - temporal * near, -np.inf)
            best = int(utility.argmax())
            chosen.append(best)
            utilities.append(utility[best])
            left[best] = False
            near = np.fmax(near, 1 - np.abs(ts - ts[best]) / radius)
        return pool.loc[chosen, ["query_id", "candidate_id", "video_id", "score"]].assign(utility=utilities)

    schema = "query_id long, candidate_id long, video_id long, score double, utility double"
    picked = rows.select("query_id", "candidate_id", "video_id", "ts", "score", "relevance").groupBy("query_id", "video_id").applyInPandas(choose, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("utility"), F.desc("score"), F.desc("candidate_id")))
    return picked.withColumn("rank", rank).where(F.col("rank") <= limit)
