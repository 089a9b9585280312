"""Flat rows of mixed result documents, and the page that shows a few of them."""

from __future__ import annotations

import html
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeline import nearest

PAGE_ROWS = 100
PAYLOAD = "query_id string, task string, results array<struct<video_id: string, frame: long, frames: array<long>, answer: string, score: double>>"


def flatten(documents: Column) -> Column:
    return F.from_json(documents, PAYLOAD)


def rows(documents: DataFrame, column: str = "payload") -> DataFrame:
    """(query_id, task, rank, event, video_id, frame, answer, score): one row per frame of every result; the frames of an
    ordered result follow one another with their event number."""
    d = documents.select(flatten(F.col(column)).alias("d")).select("d.query_id", "d.task", F.posexplode("d.results").alias("rank", "r"))
    frames = F.coalesce(F.col("r.frames"), F.array("r.frame"))
    return d.select("query_id", "task", (F.col("rank") + 1).alias("rank"), F.posexplode(frames).alias("event", "frame"), F.col("r.video_id").alias("video_id"), F.col("r.answer").alias("answer"), F.col("r.score").alias("score"))


def resolve(asked: DataFrame, keyframes: DataFrame) -> DataFrame:
    """(ask_id, n, how): the keyframe of each row (ask_id, video_id, keyframe_uid, frame_idx, ts): by its uid, else by the
    nearest frame, else by the nearest time (ties to the earlier), else none."""
    uid = keyframes.select("video_id", "keyframe_uid", F.col("n").alias("n_uid"))
    out = asked.join(uid, ["video_id", "keyframe_uid"], "left")
    for on, name in (("frame_idx", "n_frame"), ("ts", "n_ts")):
        at = keyframes.select("video_id", F.col("frame_idx" if on == "frame_idx" else "pts_time").cast("double").alias("pts_time"), "n")
        points = asked.where(F.col(on).isNotNull()).select("video_id", F.col(on).cast("double").alias("at")).distinct()
        found = nearest(points, at).select("video_id", F.col("at").alias(f"_{on}"), F.col("n").alias(name))
        out = out.withColumn(f"_{on}", F.col(on).cast("double")).join(found, ["video_id", f"_{on}"], "left")
    how = F.when(F.col("n_uid").isNotNull(), "uid").when(F.col("n_frame").isNotNull(), "frame").when(F.col("n_ts").isNotNull(), "time").otherwise("missing")
    return out.select("ask_id", F.coalesce("n_uid", "n_frame", "n_ts").alias("n"), how.alias("how"))


def page(cards: Sequence[dict], title: str) -> str:
    """A standalone page of at most 100 cards; all values are escaped."""
    if len(cards) > PAGE_ROWS:
        raise ValueError(f"a page holds at most {PAGE_ROWS} rows")
    items = "".join("<li>" + ", ".join(f"<b>{html.escape(str(k))}</b> {html.escape('' if v is None else str(v))}" for k, v in c.items()) + "</li>" for c in cards)
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><ol>{items}</ol>"
