"""Heads of the three query families: known items, questions, ordered events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from .timeline import align

#: Candidates per model call, and the parts of confidence and retrieval in an answer's score.
BATCH = 4
CONFIDENCE, RETRIEVAL = 0.55, 0.45
REVIEW_STEP = 1e-6


def frame_answers(ranked: DataFrame, top_k: int = 100) -> DataFrame:
    """One answer per (query, video, frame), the first in rank order, ranked anew; hits without video or frame drop."""
    first = F.row_number().over(Window.partitionBy("query_id", "video_id", "frame").orderBy("rank", "candidate_id"))
    once = ranked.where("video_id IS NOT NULL AND frame IS NOT NULL").withColumn("first", first).where("first = 1").drop("first")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "candidate_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= top_k)


def refine(candidates: DataFrame, frames: DataFrame, semantic: Column, *, radius: float = 2.0, keep: int = 5, coarse: float = 0.2, fine: float = 0.8) -> DataFrame:
    """(query_id, video_id, frame, ts, score, refined): frames within ``radius`` seconds of a candidate, scored again.

    Candidates: (query_id, candidate_id, video_id, frame, ts, score); frames: (video_id, frame, ts, ...), over whose columns
    ``semantic`` is written. Each candidate keeps its ``keep`` best frames; a frame keeps its best score; a candidate
    without frames stays as it is. The interval join is an equi-join on time cells two radii wide.
    """
    cell = 2 * radius
    c = candidates.select("query_id", "candidate_id", "video_id", F.col("frame").alias("c_frame"), F.col("ts").alias("c_ts"), F.col("score").alias("c_score"))
    asked = c.withColumn("cell", F.explode(F.sequence(F.floor((F.col("c_ts") - radius) / cell), F.floor((F.col("c_ts") + radius) / cell))))
    scored = frames.withColumn("cell", F.floor(F.col("ts") / cell)).withColumn("semantic", semantic)
    near = asked.join(scored, ["video_id", "cell"]).where(F.abs(F.col("ts") - F.col("c_ts")) <= radius)
    r = F.row_number().over(Window.partitionBy("query_id", "candidate_id").orderBy(F.desc("semantic"), "frame"))
    found = near.withColumn("r", r).where(F.col("r") <= keep)
    fresh = found.select("query_id", "candidate_id", "video_id", "frame", "ts", (coarse * F.col("c_score") + fine * F.col("semantic")).alias("score"), F.lit(True).alias("refined"))
    bare = c.join(found.select("query_id", "candidate_id").distinct(), ["query_id", "candidate_id"], "left_anti")
    stay = bare.select("query_id", "candidate_id", "video_id", F.col("c_frame").alias("frame"), F.col("c_ts").alias("ts"), F.col("c_score").alias("score"), F.lit(False).alias("refined"))
    best = fresh.unionByName(stay).groupBy("query_id", "video_id", "frame").agg(F.max(F.struct("score", "refined", "ts")).alias("b"))
    return best.select("query_id", "video_id", "frame", "b.ts", "b.score", "b.refined")


def trake(candidates: DataFrame, video_scores: DataFrame, events: int, *, per_event: int = 30, top_videos: int = 100, top_k: int = 100, global_weight: float = 0.2, frames: DataFrame | None = None, semantics: Sequence[Column] = (), radius: float = 2.0, **alignment) -> DataFrame:
    """(query_id, rank, video_id, score, frames): the best ordered frames of each video that has all events.

    Candidates: (query_id, event, video_id, ts, frame, score); video_scores: (query_id, video_id, score). The ``top_videos``
    best videos are preferred: others of a query count only if none of them has all events. With ``frames`` and a column
    of ``semantics`` over them for each event, each video's best path is refined within ``radius`` seconds and aligned again.
    """
    key = ["query_id", "video_id"]
    best = F.row_number().over(Window.partitionBy(*key, "event").orderBy(F.desc("score"), "ts", "frame"))
    c = candidates.where(F.col("event") < events).withColumn("r", best).where(F.col("r") <= per_event).drop("r")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "video_id"))
    ranked = video_scores.select(*key, F.col("score").alias("whole"), rank.alias("place"))
    whole = c.groupBy(*key).agg(F.count_distinct("event").alias("n")).where(F.col("n") == events).join(ranked, key, "left")
    top = F.coalesce(F.col("place") <= top_videos, F.lit(False))
    some = F.max(top).over(Window.partitionBy("query_id"))
    chosen = whole.withColumn("top", top).withColumn("some", some).where("top OR NOT some").select(*key, F.coalesce("whole", F.lit(0.0)).alias("whole"))
    held = c.join(chosen.select(*key), key, "left_semi")
    if frames is None:
        aligned = align(held, events, keys=key, **alignment)
    else:
        # events may share a coarse time; the frames around them decide, in strict order
        held = storage.stored(held, "events")
        coarse = align(held, events, keys=key, **alignment | {"strict": False})
        aligned = align(refined_path(coarse, held, frames, semantics, radius=radius), events, keys=key, **alignment)
    out = aligned.join(chosen, key).select(*key, (F.col("score") / events + global_weight * F.col("whole")).alias("score"), F.transform("path", lambda p: p["frame"]).alias("frames"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "video_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top_k)


def refined_path(aligned: DataFrame, candidates: DataFrame, frames: DataFrame, semantics: Sequence[Column], *, radius: float = 2.0, keep: int = 5) -> DataFrame:
    """(query_id, video_id, event, ts, frame, score): the frames around each chosen candidate of an alignment, scored again by the
    event's own column of ``semantics``; an event without frames nearby keeps its candidate."""
    key = ["query_id", "video_id"]
    chosen = aligned.select(*key, F.posexplode("path").alias("event", "p")).select(*key, "event", "p.ts", "p.frame")
    scored = candidates.groupBy(*key, "event", "ts", "frame").agg(F.max("score").alias("score"))
    chosen = chosen.join(scored, [*key, "event", "ts", "frame"])
    out = None
    for event, semantic in enumerate(semantics):
        own = chosen.where(F.col("event") == event).select(*key, F.col("video_id").alias("candidate_id"), "frame", "ts", "score")
        found = refine(own, frames, semantic, radius=radius, keep=keep)
        found = found.select(*key, F.lit(event).alias("event"), "ts", "frame", "score")
        out = found if out is None else out.unionByName(found)
    return out


def qa_requests(candidates: DataFrame, batch: int = BATCH) -> DataFrame:
    """Candidates (query_id, candidate_id, rank, score) with the batch each goes to, its name there (C01, C02, ..) and
    its score between 0 and 1 (1 where all scores are equal)."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    n = F.row_number().over(w.orderBy("rank", "candidate_id"))
    norm = F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low))
    return candidates.withColumn("norm", norm).withColumn("n", n).withColumn("batch", F.floor((F.col("n") - 1) / batch)).withColumn("label", F.format_string("C%02d", F.col("n") - F.col("batch") * batch))


def qa_answers(requests: DataFrame, replies: DataFrame, normalize, top_k: int = 100) -> DataFrame:
    """(query_id, rank, video_id, frame, answer, score): replies resolved to the candidate they name in their own request.

    Replies: (query_id, batch, label, answerable, answer, confidence). Unanswerable ones drop, as do those naming a label
    that their request does not hold; equal answers on a frame appear once, the best.
    """
    held = replies.where("answerable AND trim(answer) <> ''").join(requests, ["query_id", "batch", "label"])
    scored = held.withColumn("blend", CONFIDENCE * F.col("confidence") + RETRIEVAL * F.col("norm")).withColumn("same", normalize(F.col("answer")))
    first = F.row_number().over(Window.partitionBy("query_id", "video_id", "frame", "same").orderBy(F.desc("blend"), "candidate_id"))
    once = scored.withColumn("first", first).where("first = 1")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("blend"), "candidate_id"))
    return once.withColumn("r", rank).where(F.col("r") <= top_k).select("query_id", F.col("r").alias("rank"), "candidate_id", "video_id", "frame", "answer", F.col("blend").alias("score"))


def reply_problems(replies: DataFrame) -> DataFrame:
    """(query_id, batch, code) of replies that break the answer's rules."""
    blank = F.coalesce(F.trim("answer"), F.lit("")) == ""
    rules = {
        "missing_answer": F.col("answerable") & blank,
        "missing_support": F.col("answerable") & F.col("label").isNull(),
        "confidence_range": F.col("confidence").isNull() | ~F.col("confidence").between(0, 1),
        "missing_answerable": F.col("answerable").isNull(),
    }
    codes = F.filter(F.array(*[F.when(rule, code) for code, rule in rules.items()]), lambda x: x.isNotNull())
    return replies.select("query_id", "batch", F.explode(codes).alias("code"))


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """One row of each key that the cache lacks; requests and cache have a column ``key``."""
    return requests.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def reviewed_first(answers: DataFrame, reviewed: DataFrame, limit: int = 100) -> DataFrame:
    """Reviewed frames (query_id, place, video_id, frame) ahead of the answers (query_id, rank, video_id, frame, score),
    which follow unless reviewed too; reviewed ones score just above the best answer, in their order."""
    key = ["query_id", "video_id", "frame"]
    top = answers.groupBy("query_id").agg(F.max("score").alias("top"))
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    at = F.row_number().over(Window.partitionBy("query_id").orderBy("place")) - 1
    ahead = reviewed.withColumn("n", n).withColumn("at", at).join(top, "query_id", "left")
    ahead = ahead.select(*key, (F.coalesce("top", F.lit(0.0)) + (F.col("n") - F.col("at")) * REVIEW_STEP).alias("score"), F.lit(0).alias("part"), F.col("at").cast("long").alias("place"))
    rest = answers.join(reviewed.select(*key).distinct(), key, "left_anti").select(*key, "score", F.lit(1).alias("part"), F.col("rank").cast("long").alias("place"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("part", "place"))
    return ahead.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "rank", "video_id", "frame", "score", (F.col("part") == 0).alias("reviewed"))


def once_per_text(queries: DataFrame) -> DataFrame:
    """(query_id, text, leader, reused): queries of equal text share the search of the one with the least id."""
    first = queries.groupBy("text").agg(F.min("query_id").alias("leader")).withColumnRenamed("text", "_text")
    return queries.join(first, F.col("text").eqNullSafe(F.col("_text"))).drop("_text").withColumn("reused", F.col("leader") != F.col("query_id"))
