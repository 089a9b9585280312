"""Sliding windows over a video's timeline, and what belongs to them.

Defined results: videos without a positive duration have no windows; keyframes, words and segments without a time lie in none;
a null text counts as empty. Empty tables give empty results. Columns that are not named are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors


def grid(durations: DataFrame, length: float, stride: float) -> DataFrame:
    """(video_id, k, start, end): windows from 0 while they start before ``duration``, clipped at it."""
    if not 0 < stride <= length:
        raise ValueError("0 < stride <= length")
    last = F.ceil(F.col("duration") / stride) - 1
    k = durations.where("duration > 0").select("video_id", "duration", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0)))).alias("k"))
    start = F.col("k") * stride
    return k.select("video_id", "k", start.alias("start"), F.least(start + length, F.col("duration")).alias("end"))


def place(points: DataFrame, at: str, length: float, stride: float) -> DataFrame:
    """Each point with the numbers of the windows that hold it: its own range of k, so the join is an equi-join."""
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col(at) - length) / stride) + 1)
    last = F.floor(F.col(at) / stride)
    return points.withColumn("k", F.explode(F.sequence(first, F.greatest(first, last))))


def windows(keyframes: DataFrame, length: float, stride: float, fps: float) -> DataFrame:
    """Windows with their keyframes, frame range, and the keyframe nearest to the middle (ties to the earlier)."""
    span = keyframes.groupBy("video_id").agg((F.max("pts_time") + 1 / fps).alias("duration"))
    g = grid(span, length, stride)
    members = place(keyframes, "pts_time", length, stride).join(g, ["video_id", "k"]).where("pts_time >= start AND pts_time < end")
    middle = (F.col("start") + F.col("end")) / 2
    return members.groupBy("video_id", "k", "start", "end").agg(
        F.count(F.lit(1)).alias("n_keyframes"),
        F.min_by("n", F.struct(F.abs(F.col("pts_time") - middle), "n")).alias("representative"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
    ).withColumn("start_frame", F.greatest(F.lit(0).cast("long"), F.floor(F.col("start") * fps))).withColumn("end_frame", F.greatest(F.lit(0).cast("long"), F.ceil(F.col("end") * fps) - 1))


def temporal_windows(
    keyframes: DataFrame, length: float, stride: float, *, durations: DataFrame | None = None, include_empty: bool = False, default_fps: float = 25.0
) -> DataFrame:
    """(window_id, video_id, k, start, end, start_frame, end_frame, representative_keyframe_uid, frame_idx, pts_time, fps,
    keyframe_uids) of keyframes (video_id, n, keyframe_uid, pts_time, frame_idx, fps).

    A video lasts as long as ``durations`` (video_id, duration) says, but never ends before its last keyframe does; without an
    entry it ends there. The last window holds a keyframe at its very end. The representative is nearest to the middle,
    of equal ones the first. Windows without keyframes are left out unless ``include_empty``; a negative duration is an error.
    """
    first = F.min(F.struct("pts_time", "n", "fps"))["fps"]
    last = keyframes.groupBy("video_id").agg(F.max("pts_time").alias("last"), first.alias("rate"))
    if durations is not None:
        wrong = F.raise_error(F.concat(F.lit("a negative duration: "), F.col("video_id").cast("string"))).cast("double")
        said = durations.select("video_id", F.when(F.col("duration") < 0, wrong).otherwise(F.col("duration")).alias("said"))
        last = last.join(said, "video_id", "full")
    else:
        last = last.withColumn("said", F.lit(None).cast("double"))
    fps = F.coalesce("rate", F.lit(default_fps))
    span = last.select("video_id", fps.alias("fps"), F.greatest(F.coalesce("said", F.lit(0.0)), F.coalesce(F.col("last") + 1 / fps, F.lit(0.0))).alias("duration"))
    w = grid(span, length, stride).join(span, "video_id")
    points = keyframes.select("video_id", "n", "keyframe_uid", "pts_time", "frame_idx")
    held = place(points, "pts_time", length, stride).join(w.select("video_id", "k", "start", "end", "duration"), ["video_id", "k"])
    held = held.where((F.col("pts_time") >= F.col("start")) & ((F.col("pts_time") < F.col("end")) | ((F.col("end") >= F.col("duration")) & (F.col("pts_time") == F.col("end")))))
    nearest = F.min(F.struct(F.abs(F.col("pts_time") - (F.col("start") + F.col("end")) / 2).alias("d"), "n", F.struct("keyframe_uid", "frame_idx", "pts_time").alias("at")))["at"].alias("best")
    uids = F.transform(F.array_sort(F.collect_list(F.struct("n", "keyframe_uid"))), lambda x: x["keyframe_uid"])
    members = held.groupBy("video_id", "k").agg(uids.alias("keyframe_uids"), nearest)
    rows = w.join(members, ["video_id", "k"], "left" if include_empty else "inner")
    return rows.select(
        F.format_string("%s_W%06d", F.col("video_id").cast("string"), "k").alias("window_id"), "video_id", "k", "start", "end",
        F.greatest(F.lit(0).cast("long"), F.floor(F.col("start") * F.col("fps"))).alias("start_frame"), F.greatest(F.lit(0).cast("long"), F.ceil(F.col("end") * F.col("fps")) - 1).alias("end_frame"),
        F.col("best.keyframe_uid").alias("representative_keyframe_uid"), F.col("best.frame_idx").alias("frame_idx"), F.col("best.pts_time").alias("pts_time"), "fps",
        F.coalesce("keyframe_uids", F.array().cast("array<string>")).alias("keyframe_uids"),
    )


def aligned_text(windows: DataFrame, segments: DataFrame, length: float, stride: float, least: float = 0.2) -> DataFrame:
    """(video_id, k, asr_text, asr_segment_ids) of the windows (video_id, k, start, end) of a grid that segments (video_id, position,
    segment_id, start, end, text, words of text, start and end) speak in.

    Words count where their middle lies, also if that leaves out most of a segment; a segment without a word that is not
    blank counts with its whole text where at least ``least`` of it lies. Texts are joined in order of the segments and
    words. A segment or word that ends before it begins is an error.
    """
    if not 0 <= least <= 1:
        raise ValueError("the least share is between 0 and 1")
    reversed_one = (F.col("end") < F.col("start")) | F.exists(F.coalesce("words", F.array()), lambda w: w["end"] < w["start"])
    stop = F.raise_error(F.concat(F.lit("a segment or word ends before it begins: "), F.col("video_id").cast("string")))
    s = segments.withColumn("video_id", F.when(reversed_one, stop.cast(segments.schema["video_id"].dataType)).otherwise(F.col("video_id")))
    spoken = F.filter(F.coalesce("words", F.array()), lambda w: F.coalesce(F.trim(w["text"]), F.lit("")) != "")
    s = s.withColumn("spoken", F.transform(spoken, lambda w: F.struct(F.trim(w["text"]).alias("text"), ((w["start"] + w["end"]) / 2).alias("middle"))))
    g = windows.select("video_id", "k", F.col("start").alias("w_start"), F.col("end").alias("w_end"))
    words = s.where(F.size("spoken") > 0).select("video_id", "position", "segment_id", F.posexplode("spoken").alias("at", "w")).select("video_id", "position", "segment_id", "at", "w.text", "w.middle")
    said = place(words, "middle", length, stride).join(g, ["video_id", "k"]).where("middle >= w_start AND middle < w_end").select("video_id", "k", "position", "segment_id", "at", "text")
    whole = s.where(F.size("spoken") == 0).select("video_id", "position", "segment_id", F.lit(0).alias("at"), F.trim(F.coalesce("text", F.lit(""))).alias("text"), "start", "end")
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("start") - length) / stride) + 1)
    spread = whole.withColumn("k", F.explode(F.sequence(first, F.greatest(first, F.floor(F.col("end") / stride)))))
    shared = F.least("end", "w_end") - F.greatest("start", "w_start")
    heard = spread.join(g, ["video_id", "k"]).where((shared > 0) & (shared / F.greatest(F.lit(1e-9), F.col("end") - F.col("start")) >= least))
    rows = said.unionByName(heard.select("video_id", "k", "position", "segment_id", "at", "text"))
    ordered = rows.groupBy("video_id", "k").agg(F.array_sort(F.collect_list(F.struct("position", "at", "text", "segment_id"))).alias("p"))
    texts = F.filter(F.transform("p", lambda x: x["text"]), lambda t: t != "")
    return ordered.select("video_id", "k", F.array_join(texts, " ").alias("asr_text"), F.array_distinct(F.transform("p", lambda x: x["segment_id"])).alias("asr_segment_ids"))


def overlapping_text(segments: DataFrame, length: float, stride: float, least: float = 0.2) -> DataFrame:
    """Texts of the segments of which at least ``least`` lies in a window, in order."""
    span = segments.groupBy("video_id").agg(F.max("end").alias("duration"))
    g = grid(span, length, stride).withColumnsRenamed({"start": "w_start", "end": "w_end"})
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("start") - length) / stride) + 1)
    s = segments.withColumn("k", F.explode(F.sequence(first, F.greatest(first, F.floor(F.col("end") / stride)))))
    shared = F.least("end", "w_end") - F.greatest("start", "w_start")
    kept = s.join(g, ["video_id", "k"]).where((shared > 0) & (shared / F.greatest(F.lit(1e-9), F.col("end") - F.col("start")) >= least))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "text"))), lambda x: x["text"]), " ")
    return kept.groupBy("video_id", "k").agg(text.alias("text"), F.count(F.lit(1)).alias("n_segments"))


def timed_words(segments: DataFrame) -> DataFrame:
    """(video_id, segment, i, word, start, end): words of segments without word times, by their share of the characters."""
    w = Window.partitionBy("video_id", "segment").orderBy("i")
    words = segments.select("video_id", "segment", "start", "end", F.posexplode(F.split("text", r"\s+")).alias("i", "word"))
    words = words.withColumn("before", F.coalesce(F.sum(F.length("word")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    words = words.withColumn("chars", F.sum(F.length("word")).over(Window.partitionBy("video_id", "segment"))).where("word <> ''")
    rate = (F.col("end") - F.col("start")) / F.col("chars")
    return words.select("video_id", "segment", "i", "word", (F.col("start") + F.col("before") * rate).alias("w_start"), (F.col("start") + (F.col("before") + F.length("word")) * rate).alias("w_end"))


def words_in_windows(words: DataFrame, durations: DataFrame, length: float, stride: float) -> DataFrame:
    """(video_id, k, text, n_words): the words whose middle lies in a window, in order."""
    g = grid(durations, length, stride)
    placed = place(words.withColumn("middle", (F.col("w_start") + F.col("w_end")) / 2), "middle", length, stride)
    held = placed.join(g, ["video_id", "k"]).where("middle >= start AND middle < end")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "i", "word"))), lambda x: x["word"]), " ")
    return held.groupBy("video_id", "k").agg(text.alias("text"), F.count(F.lit(1)).alias("n_words"))


def attach_text(windows: DataFrame, texts: DataFrame) -> DataFrame:
    """Windows (video_id, k, keyframe_uids) with the texts (keyframe_uid, text) of their keyframes, in order, each once."""
    rows = windows.select("video_id", "k", F.posexplode("keyframe_uids").alias("pos", "keyframe_uid")).join(texts, "keyframe_uid", "left")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    kept = F.array_distinct(F.filter(ordered, lambda x: F.coalesce(F.trim(x), F.lit("")) != ""))
    return rows.groupBy("video_id", "k").agg(F.array_join(kept, "\n").alias("text"))


def mean_pool(rows: DataFrame, *by: str, dim: int) -> DataFrame:
    """(by, v, n_vectors): the normalised mean of the vectors ``v`` of each group, in one aggregate of ``dim`` sums that
    is combined before the shuffle.

    Vectors that are null, of another length or not finite are refused with an error; a mean of length zero stays zero, a
    null key is a group of its own, an empty table gives an empty result. Other columns are dropped.
    """
    refused = F.raise_error(F.lit(f"a vector is null, not of length {dim}, or not finite")).cast("array<double>")
    sound = rows.select(*by, F.when(F.coalesce(vectors.is_valid(F.col("v"), dim), F.lit(False)), F.col("v")).otherwise(refused).alias("v"))
    means = [F.avg(F.get("v", F.lit(i))).alias(f"_mean_{i}") for i in range(dim)]
    found = sound.groupBy(*by).agg(F.count(F.lit(1)).alias("n_vectors"), *means)
    mean = F.array(*[F.col(f"_mean_{i}") for i in range(dim)]).cast("array<double>")
    return found.select(*by, vectors.l2_normalize(mean).alias("v"), "n_vectors")
