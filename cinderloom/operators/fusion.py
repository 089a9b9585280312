"""Fusion of ranked lists. Hits: (query_id, source, candidate_id, score).

Weights are a mapping from sources, or a table (query_id, source, weight) where they differ by query; a source without one has 1.

Defined results: candidates that a source names twice count with their better score; hits without a score come last in their
source; of equal scores the smaller id ranks first. Empty tables give empty results. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weight_of(weights: Mapping[str, float]) -> Column:
    """The weight of a row's source, 1 for a source without one; negative weights are refused."""
    if any(not w >= 0 for w in weights.values()):
        raise ValueError("weights are not negative")
    out = F.lit(1.0)
    for source, w in weights.items():
        out = F.when(F.col("source") == source, float(w)).otherwise(out)
    return out


def _weighed(ranked: DataFrame, weights: Mapping[str, float] | DataFrame) -> DataFrame:
    """Ranked hits with their ``weight``."""
    if not isinstance(weights, DataFrame):
        return ranked.withColumn("weight", weight_of(weights))
    refused = F.raise_error(F.lit("weights are not negative")).cast("double")
    checked = F.when(F.col("weight") >= 0, F.col("weight").cast("double")).otherwise(F.when(F.col("weight").isNotNull(), refused))
    table = weights.select("query_id", "source", checked.alias("weight"))
    return ranked.join(table, ["query_id", "source"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def best_hits(hits: DataFrame) -> DataFrame:
    """The best score of each candidate in each source, and its rank there."""
    best = hits.groupBy("query_id", "source", "candidate_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "candidate_id"))
    return best.withColumn("rank", rank)


def reciprocal_rank_fusion(hits: DataFrame, weights: Mapping[str, float] | DataFrame, rank_constant: float = 60) -> DataFrame:
    r = _weighed(best_hits(hits), weights)
    r = r.withColumn("part", F.col("weight") / (F.col("rank") + rank_constant))
    ranks = F.map_from_entries(F.collect_list(F.struct("source", "rank")))
    return r.groupBy("query_id", "candidate_id").agg(F.sum("part").alias("score"), F.count(F.lit(1)).alias("n_sources"), ranks.alias("ranks"))


def weighted_score_fusion(hits: DataFrame, weights: Mapping[str, float] | DataFrame, normalization: str = "minmax") -> DataFrame:
    """``minmax`` maps constant scores to 1; ``rank`` takes 1 / rank; ``none`` the scores as they are."""
    r = best_hits(hits)
    w = Window.partitionBy("query_id", "source")
    low, high = F.min("score").over(w), F.max("score").over(w)
    norm = {"none": F.col("score"), "rank": 1.0 / F.col("rank"), "minmax": F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low))}[normalization]
    r = _weighed(r.withColumn("norm", norm), weights).withColumn("part", F.col("norm") * F.col("weight"))
    return r.groupBy("query_id", "candidate_id").agg(F.sum("part").alias("score"), F.count(F.lit(1)).alias("n_sources"))


def top(fused: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate_id"))
    return fused.withColumn("rank", rank).where(F.col("rank") <= k)
