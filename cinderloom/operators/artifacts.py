"""Scopes, counts and signatures of stored artifacts.

Defined results: nulls in keys meet nothing; empty tables give empty results, and a count over none is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def selected(configured: DataFrame, requested: DataFrame | None, key: str, limit: int | None = None, *, order: str | None = None) -> DataFrame:
    """(key, place): the configured keys that are asked for, in the order in which they are asked for, at most ``limit``.

    ``order`` names the column that has that order, in both tables; without it keys are in their own order. A key that is
    asked for twice counts once, where it comes first; one that is not configured, or a limit below 1, is an error.
    """
    if limit is not None and limit < 1:
        raise ValueError("the limit must be positive")
    place = F.min(F.struct(order, key) if order else F.struct(F.col(key))).alias("place")
    rows = configured.groupBy(key).agg(place)
    if requested is not None:
        known = configured.select(key).distinct().withColumn("_known", F.lit(True))
        asked = requested.groupBy(key).agg(place).join(known, key, "left")
        stop = F.raise_error(F.concat(F.lit("not configured: "), F.col(key).cast("string")))
        rows = asked.select(F.when(F.col("_known"), F.col(key)).otherwise(stop.cast(configured.schema[key].dataType)).alias(key), "place")
    return rows if limit is None else rows.orderBy("place").limit(limit)


def shards_in_scope(shards: DataFrame, scope: DataFrame) -> DataFrame:
    """(video_id, code): videos of a scope without a shard, or with more than one."""
    counted = shards.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    rows = scope.select("video_id").distinct().join(counted, "video_id", "left")
    code = F.when(F.col("n").isNull(), "missing_shard").when(F.col("n") > 1, "duplicate_shard")
    return rows.select("video_id", code.alias("code")).where("code IS NOT NULL")


def file_counts(files: DataFrame) -> DataFrame:
    """(folder, suffix, n, bytes) of an inventory (path, length)."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.groupBy(folder.alias("folder"), suffix.alias("suffix")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))


def frame_count(duration: Column, fps: Column) -> Column:
    """Frames of a video; halves go to the even number."""
    return F.bround(duration * fps).cast("long")


def source_signature(files: DataFrame, key: str, scope_hash: Column | str | None = None) -> DataFrame:
    """(key, signature): SHA-256 over a line for the scope, if one is given, and a line ``path:size:time`` for each file of
    a key, in order of the path; every line ends in a line feed."""
    line = F.concat(F.concat_ws(":", "path", F.col("length").cast("string"), F.col("mtime").cast("string")), F.lit("\n"))
    rows = files.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("path").alias("path"), line.alias("line")))).alias("f"))
    scope = F.lit("") if scope_hash is None else F.concat(F.lit("scope:"), scope_hash if isinstance(scope_hash, Column) else F.lit(scope_hash), F.lit("\n"))
    return rows.select(key, F.sha2(F.concat(scope, F.array_join(F.transform("f", lambda x: x["line"]), "")), 256).alias("signature"))


def content_digests(files: DataFrame) -> DataFrame:
    """(path, sha256) of files with their ``content``."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def with_media_text(windows: DataFrame, videos: DataFrame) -> DataFrame:
    """Windows with their video's title, description and author as one text; blank parts are left out. The smaller side's
    size decides how they meet, so it is not marked for broadcast."""
    parts = F.filter(F.array("title", "description", "author"), lambda v: F.trim(v) != "")
    return windows.join(videos.select("video_id", F.array_join(parts, " ").alias("media_text")), "video_id", "left")


def matched_frames(rows: DataFrame, images: DataFrame, objects: DataFrame, *, strict: bool = False) -> DataFrame:
    """Keyframe rows with their image and detections by (video_id, n); ``strict`` stops at a row without an image."""
    keys = ["video_id", "n"]
    out = rows.join(images, keys, "left").join(objects, keys, "left")
    if not strict:
        return out
    stop = F.raise_error(F.concat(F.lit("no image: "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys])))
    return out.withColumn("image", F.coalesce("image", stop.cast("string")))


def frames_out_of_bounds(reviewed: DataFrame, counts: DataFrame) -> DataFrame:
    """Reviewed frames (video_id, frame) that their video (video_id, frames) does not have, with why."""
    both = reviewed.join(counts, "video_id", "left")
    code = F.when(F.col("frames").isNull(), "unknown_video").when(F.col("frame") < 0, "negative_frame").when(F.col("frame") >= F.col("frames"), "beyond_end")
    return both.select(*reviewed.columns, code.alias("code")).where("code IS NOT NULL")


def run_counters(runs: DataFrame) -> DataFrame:
    """One row over the runs (text, reused, overridden, reviewed): how many, of how many texts, and of which kind."""
    flag = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return runs.agg(
        F.count(F.lit(1)).alias("queries"), F.count_distinct("text").alias("texts"), flag("reused").alias("reused"), flag("overridden").alias("overridden"), flag("reviewed").alias("reviewed")
    )


def check_target(path: str, canonical: str, *, whole: bool) -> str:
    """``path``, unless a run over a part of the data would write where only whole runs do."""
    if not whole and path.rstrip("/") == canonical.rstrip("/"):
        raise ValueError("a run over a part of the data may not write the canonical path")
    return path


def confident_items(items: Column, least: float) -> Column:
    """Recognised texts (text, confidence) of at least that confidence that are not blank."""
    return F.filter(items, lambda i: (i["confidence"] >= least) & (F.trim(i["text"]) != ""))


def qa_prompt(requests: DataFrame) -> DataFrame:
    """(query_id, prompt): the question with its language and description, then what is known of each candidate (label,
    video_id, frame, at, score, asr, ocr), in order of the label. Blank texts and null scores are said to be missing."""
    said = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("[none]"))
    score = F.when(F.col("score").isNull(), "unknown").otherwise(F.format_string("%.6f", "score"))
    place = F.concat_ws("; ", F.concat(F.lit("video="), "video_id"), F.concat(F.lit("frame="), F.col("frame").cast("string")), F.concat(F.lit("time="), F.format_string("%.3f", "at"), F.lit("s")), F.concat(F.lit("score="), score))
    lines = F.concat_ws("\n", F.concat(F.col("label"), F.lit(": "), place), F.concat(F.lit("speech: "), said("asr")), F.concat(F.lit("text in the frame: "), said("ocr")))
    head = F.concat_ws("\n", F.concat(F.lit("Question ("), "language", F.lit("): "), "question"), F.when(F.trim("description") != "", F.concat(F.lit("Scene: "), F.trim("description"))))
    rows = requests.groupBy("query_id", "question", "language", "description").agg(F.array_sort(F.collect_list(F.struct("label", lines.alias("lines")))).alias("c"))
    return rows.select("query_id", F.concat_ws("\n\n", head, F.array_join(F.transform("c", lambda x: x["lines"]), "\n\n")).alias("prompt"))
