"""Whole searches: many fields, variants and weights by query, down to frames.

A field is searched by a function from texts (vec_id, text) and a number k to their best hits (query_id, candidate_id, score),
whose query_id is the text's vec_id. ``places`` says where candidates are: (candidate_id, video_id, frame, ts).

Defined results: queries with a blank text find nothing; candidates without a place have no video and drop from answers; a null
time is near nothing and is not refined. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions import text as T
from . import fusion, hits, query, ranking, tasks

#: A query has fewer variants than this.
VARIANTS = 1024
Rerank = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Field:
    """A searchable modality with its weight and how deep it is searched."""

    name: str
    search: Callable[[DataFrame, int], DataFrame]
    weight: float = 1.0
    k: int = 500

    def __post_init__(self) -> None:
        if self.weight < 0 or self.k < 1 or ":" in self.name:
            raise ValueError("a field has a name without colons, a weight that is not negative and a depth")


@dataclass(frozen=True)
class Options:
    """Depths, penalties and fusion of a search for known items."""

    pool: int = 1000
    top_k: int = 100
    method: str = "rrf"
    norm: str = "minmax"
    same_video: float = 0.05
    temporal: float = 0.3
    radius: float = 2.0
    max_per_video: int | None = None
    refine_top: int = 0
    rewrites: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if min(self.pool, self.top_k) < 1 or self.refine_top < 0:
            raise ValueError("depths are positive")


def _names(fields: Sequence[Field]) -> None:
    if not fields or len({f.name for f in fields}) != len(fields):
        raise ValueError("fields are needed, each with a name of its own")


def variant_hits(queries: DataFrame, fields: Sequence[Field], **rewrites) -> tuple[DataFrame, DataFrame]:
    """The variants (query_id, variant, kind, text, weight, vec_id) of queries (query_id, text), and every field's hits for each of
    them (query_id, variant, kind, modality, candidate_id, score, weight)."""
    _names(fields)
    v = query.expand(queries.select("query_id", "text"), **rewrites).withColumn("vec_id", F.col("query_id") * VARIANTS + F.col("variant"))
    v = storage.stored(v, "variants")
    of = v.select("vec_id", "query_id", "variant", "kind", "weight")
    found = None
    for f in fields:
        one = f.search(v.select("vec_id", "text"), f.k).select(F.col("query_id").alias("vec_id"), "candidate_id", "score").withColumn("modality", F.lit(f.name))
        found = one if found is None else found.unionByName(one)
    return v, found.join(of, "vec_id").drop("vec_id")


def _hints(queries: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """(query_id, modality, weight): a field's weight times what the query's text hints at."""
    each = F.explode(F.array(*[F.struct(F.lit(f.name).alias("modality"), F.lit(float(f.weight)).alias("base")) for f in fields])).alias("f")
    rows = queries.select("query_id", T.modality_hints(F.col("text")).alias("hints"), each)
    return rows.select("query_id", "f.modality", (F.col("f.base") * F.coalesce(F.try_element_at("hints", F.col("f.modality")), F.lit(1.0))).alias("weight"))


def _placed(fused: DataFrame, places: DataFrame) -> DataFrame:
    return fused.join(places.select("candidate_id", "video_id", "frame", "ts"), "candidate_id", "left")


def search(
    queries: DataFrame, fields: Sequence[Field], places: DataFrame, *, limit: int = 100, rank_constant: float = 60.0, same_video: float = 0.08, temporal: float = 0.35, radius: float = 2.0, **rewrites
) -> tuple[DataFrame, DataFrame]:
    """(query_id, rank, candidate_id, video_id, frame, ts, score, utility) of queries (query_id, text), and how many candidates each
    source gave (query_id, source, n).

    Each field keeps a candidate's best score over all variants, times the variant's weight; fields are fused by rank with
    their weights times the query's hints, and the list is diversified.
    """
    _, found = variant_hits(queries, fields, **rewrites)
    merged = storage.stored(query.merge_variants(found.withColumn("source", F.col("modality"))), "merged")
    counts = merged.groupBy("query_id", "source").agg(F.count(F.lit(1)).alias("n"))
    weights = _hints(queries, fields).withColumnRenamed("modality", "source")
    fused = _placed(fusion.reciprocal_rank_fusion(merged, weights, rank_constant), places)
    best = ranking.diversify(fused, limit, same_video, temporal, radius)
    return best.select("query_id", "rank", "candidate_id", "score", "utility").join(places.select("candidate_id", "video_id", "frame", "ts"), "candidate_id", "left"), counts


def known_items(
    queries: DataFrame, fields: Sequence[Field], places: DataFrame, options: Options | None = None, *,
    frames: DataFrame | None = None, semantic: Column | None = None, rerank: Rerank | None = None,
) -> DataFrame:
    """(query_id, rank, video_id, frame, score, refined): the frames that answer queries (query_id, text), one each.

    Every variant in every field is a source of its own (``modality:kind:number``), with the field's weight, the query's hint
    and the variant's weight; sources are fused, diversified and put in order by ``rerank``, if given (candidates with
    query_id, candidate_id, video_id, frame, ts, score to the same). The best ``refine_top`` of each query that have a
    time are refined among ``frames`` by ``semantic``; those and the others are ranked by score.
    """
    options = options or Options()
    v, found = variant_hits(queries, fields, **options.rewrites)
    source = F.concat_ws(":", "modality", "kind", F.col("variant").cast("string"))
    weights = _hints(queries, fields).join(v.select("query_id", "variant", "kind", F.col("weight").alias("w")), "query_id")
    weights = weights.select("query_id", source.alias("source"), (F.col("weight") * F.col("w")).alias("weight"))
    every = found.select("query_id", source.alias("source"), "candidate_id", "score")
    if options.method == "rrf":
        fused = fusion.reciprocal_rank_fusion(every, weights)
    elif options.method == "weighted":
        fused = fusion.weighted_score_fusion(every, weights, options.norm)
    else:
        raise ValueError(f"no fusion method {options.method}")
    pool = _placed(fusion.top(fused, options.pool), places).select("query_id", "candidate_id", "video_id", "ts", F.round("score", 12).alias("score"))
    best = ranking.diversify(pool, options.pool, options.same_video, options.temporal, options.radius, options.max_per_video)
    c = best.select("query_id", "rank", "candidate_id", "score").join(places.select("candidate_id", "video_id", "frame", "ts"), "candidate_id")
    c = c.where("video_id IS NOT NULL AND frame IS NOT NULL")
    if rerank is not None:
        c = fusion.top(rerank(c.drop("rank")), options.pool)
    if options.refine_top and frames is not None and semantic is not None:
        c = storage.stored(c, "candidates")
        chosen = (F.col("rank") <= options.refine_top) & F.col("ts").isNotNull()
        refined = tasks.refine(c.where(chosen), frames, semantic, radius=options.radius).drop("refined", "ts")
        passed = c.where(~chosen).select("query_id", "video_id", "frame", "score")
        both = hits.merge_refined(refined, passed, order=None)
        c = fusion.top(both.withColumn("candidate_id", F.struct("video_id", "frame")), 2 * options.pool + options.refine_top * 5)
    else:
        c = c.withColumn("refined", F.lit(False))
    return tasks.frame_answers(c, options.top_k).select("query_id", "rank", "video_id", "frame", "score", "refined")
