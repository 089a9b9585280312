"""Checks and nearest joins on keyframe timelines, and ordered alignment of events.

Defined results: a null time is near nothing and aligns with nothing; a null score cannot be chosen; a video without a
candidate for some event has no alignment. Of equal alignments that with the earlier positions is taken. Empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(keyframes: DataFrame, fps: float) -> DataFrame:
    """Rows out of order (n, time, frame) or whose frame drifts from their time."""
    w = Window.partitionBy("video_id").orderBy("n")
    k = keyframes.withColumn("before", F.lag(F.struct("pts_time", "frame_idx")).over(w)).withColumn("no", F.row_number().over(w))
    drift = F.abs(F.col("pts_time") * fps - F.col("frame_idx")) > F.greatest(F.lit(2.0), F.lit(0.1 * fps))
    code = F.when(F.col("no") != F.col("n"), "sequence").when((F.col("before.pts_time") > F.col("pts_time")) | (F.col("before.frame_idx") > F.col("frame_idx")), "order").when(drift, "drift")
    return k.withColumn("code", code).where("code IS NOT NULL")


def nearest(asked: DataFrame, keyframes: DataFrame) -> DataFrame:
    """(video_id, at, n): the keyframe nearest in time to every asked time, ties to the earlier.

    Both sides are merged in one sort per video: the last keyframe before and the first one from there on.
    """
    frames = keyframes.select("video_id", F.col("pts_time").alias("at"), F.struct("pts_time", "n").alias("k"), F.lit(0).alias("side"))
    both = frames.unionByName(asked.select("video_id", "at", F.lit(1).alias("side")), allowMissingColumns=True)
    w = Window.partitionBy("video_id").orderBy("at", "side")
    both = both.withColumn("left", F.last("k", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    back = Window.partitionBy("video_id").orderBy(F.desc("at"), F.desc("side"))
    both = both.withColumn("right", F.last("k", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    left_near = F.col("at") - F.col("left.pts_time") <= F.col("right.pts_time") - F.col("at")
    return both.where("side = 1").select("video_id", "at", F.when(F.col("right").isNull() | left_near, F.col("left.n")).otherwise(F.col("right.n")).alias("n"))


def align(
    candidates: DataFrame, events: int, min_gap: float = 0.0, max_gap: float | None = None, penalty=None, keys: Sequence[str] = ("video_id",), *, strict: bool = True
) -> DataFrame:
    """(keys, score, path): the best ordered choice of one candidate per event for each value of ``keys``; events follow
    each other strictly, or may fall together if not ``strict``.

    Candidates: (keys, event, ts, frame, score). A chain of joins, one per event; each keeps the best predecessor. ``path``
    holds the (ts, frame) chosen for each event.
    """
    w = Window.partitionBy(*keys, "event").orderBy("ts", F.desc("score"), "frame")
    c = candidates.withColumn("pos", F.row_number().over(w))
    path = c.where("event = 0").select(*keys, F.col("score").alias("total"), "ts", "pos", F.array(F.struct("ts", "frame")).alias("path"))
    for e in range(1, events):
        step = c.where(F.col("event") == e).select(*keys, F.col("ts").alias("t"), F.col("frame").alias("f"), F.col("pos").alias("p"), F.col("score").alias("s"))
        gap: Column = F.col("t") - F.col("ts")
        ok = ((gap > 0) if strict else (gap >= 0)) & (gap >= min_gap)
        if max_gap is not None:
            ok = ok & (gap <= max_gap)
        cost = penalty(gap) if penalty else F.lit(0.0)
        joined = path.join(step, list(keys)).where(ok).withColumn("sum", F.col("total") + F.col("s") - cost)
        best = joined.groupBy(*keys, "t", "f", "p").agg(F.max("sum").alias("total"), F.max_by("path", F.struct("sum", -F.col("pos"))).alias("path"))
        here = F.array(F.struct(F.col("t").alias("ts"), F.col("f").alias("frame")))
        path = best.select(*keys, "total", F.col("t").alias("ts"), F.col("p").alias("pos"), F.concat("path", here).alias("path"))
    return path.groupBy(*keys).agg(F.max("total").alias("score"), F.max_by("path", F.struct("total", -F.col("pos"))).alias("path"))


def viterbi(positions: DataFrame, events: int, min_gap: float = 0.0, max_gap: float | None = None) -> DataFrame:
    """(video_id, score, path): the best strictly ordered positions for scores ``s0``, ``s1``, .. on one timeline.

    Positions: (video_id, ts, s0, ..); a null score cannot be chosen. The best predecessor is a maximum over a range of
    time, in whole microseconds, so each event costs one pass over a sorted video.
    """
    at = F.round(F.col("ts") * 1e6).cast("long")
    rows = positions.withColumn("at", at).withColumn("best", F.when(F.col("s0").isNotNull(), F.struct(F.col("s0").alias("total"), (-F.col("at")).alias("last"), F.array("ts").alias("path"))))
    nearest_end = -max(1, round(min_gap * 1e6))
    farthest = Window.unboundedPreceding if max_gap is None else -round(max_gap * 1e6)
    w = Window.partitionBy("video_id").orderBy("at").rangeBetween(farthest, nearest_end)
    for e in range(1, events):
        rows = rows.withColumn("before", F.max("best").over(w))
        total = F.col("before.total") + F.col(f"s{e}")
        rows = rows.withColumn("best", F.when(total.isNotNull(), F.struct(total.alias("total"), (-F.col("at")).alias("last"), F.concat("before.path", F.array("ts")).alias("path"))))
    top = rows.where("best IS NOT NULL").groupBy("video_id").agg(F.max("best").alias("b"))
    return top.select("video_id", F.col("b.total").alias("score"), F.col("b.path").alias("path"))
