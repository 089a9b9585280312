"""Readers of prediction and ground-truth files, whose JSON comes in several shapes that are told apart row by row.

A prediction file is what a solver wrote (``query_id`` or ``task_type`` beside ``predictions``), a mapping from query ids to
lists of predictions, or a bare list whose query id the caller gives. Ground truth is a mapping from query ids to objects of
one of three tasks.

Defined results: what does not fit is in the second table, with the place where it was found and a code, and leaves the
first one; the other predictions of a file keep their ranks. A query of ground truth counts as a whole or not at all. Null
texts are ``not_json``. Empty tables give empty results. Columns beside ``value`` are carried along; those named like a
result column are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variants as V

SPAN = "struct<event:int,video_id:string,start:bigint,end:bigint>"


def _carried(files: DataFrame, result: tuple[str, ...]) -> list[str]:
    keys = [c for c in files.columns if c not in ("value", "asked_id")]
    if clash := sorted(set(keys) & set(result)):
        raise ValueError(f"columns that the reader makes itself: {', '.join(clash)}")
    return keys


def _named(value: Column) -> Column:
    """A trimmed string or scalar that is not blank."""
    return F.nullif(F.trim(F.try_variant_get(value, "$", "string")), F.lit(""))


def predictions(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(.., query_id, task, rank, video_id, frames, answer, score) of files (.., value and, where the caller knows the query,
    asked_id); and (.., query_id, rank, code) of what does not fit, rank 0 for a whole list or file."""
    keys = _carried(files, ("query_id", "task", "rank", "video_id", "frames", "answer", "score", "code"))
    asked = F.nullif(F.trim("asked_id"), F.lit("")) if "asked_id" in files.columns else F.lit(None).cast("string")
    d = V.computed(files, {"asked": asked, "v": F.try_parse_json("value")}).select(*keys, "asked", "v")
    d = V.computed(d, {"m": V.members(F.col("v")), "own": F.nullif(F.trim(V.string(V.at(F.col("v"), "query_id"))), F.lit(""))})
    wrapper = F.map_contains_key("m", F.lit("predictions")) & (F.map_contains_key("m", F.lit("query_id")) | F.map_contains_key("m", F.lit("task_type")))
    own = F.col("own")
    none = F.lit(None).cast("string")
    entry = lambda q, task, value, code: F.struct(q.alias("query_id"), task.alias("task"), value.alias("value"), code.alias("code"))
    written = F.array(entry(own, F.upper(V.string(V.at(F.col("v"), "task_type"))), V.at(F.col("v"), "predictions"), V.first_code((own.isNull(), "no_query_id"), (F.col("asked") != own, "other_query_id"))))
    mapped = F.transform(F.map_entries("m"), lambda e: entry(F.trim(e["key"]), none, e["value"], V.first_code((F.trim(e["key"]) == "", "no_query_id"))))
    bare = F.array(entry(F.col("asked"), none, F.col("v"), V.first_code((F.col("v").isNull(), "not_json"), (F.col("asked").isNull(), "no_query_id"))))
    lists = d.select(*keys, F.explode(F.when(F.col("m").isNull(), bare).when(wrapper, written).otherwise(mapped)).alias("e")).select(*keys, "e.*")
    lists = V.computed(lists, {"list": V.items(F.col("value"))}).withColumn("code", F.coalesce("code", V.first_code((F.col("list").isNull(), "not_a_list"))))

    rows = lists.where("code IS NULL").select(*keys, "query_id", "task", F.posexplode("list").alias("k", "p"))
    p = F.col("p")
    rows = V.computed(rows, {"several": V.at(p, "frame_ids"), "one": V.at(p, "frame_idx"), "name": _named(V.at(p, "video_id")), "said": V.at(p, "answer"), "points": V.at(p, "score")})
    several, one, said, points = (F.col(c) for c in ("several", "one", "said", "points"))
    raw = F.when(~V.absent(several), V.items(several)).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<variant>"))
    rows = V.computed(rows, {"raw": raw, "answer": V.string(said), "score": F.when(F.schema_of_variant(points) != "VOID", F.try_variant_get(points, "$", "double"))})
    rows = V.computed(rows, {"frames": F.transform("raw", V.loose_integer)})
    code = V.first_code(
        (V.members(p).isNull(), "not_an_object"), (F.col("name").isNull(), "no_video_id"), (F.col("raw").isNull(), "frames_not_a_list"), (F.size("raw") == 0, "no_frames"),
        (F.exists("frames", lambda x: x.isNull() | (x < 0)), "bad_frame"), (~V.absent(said) & F.col("answer").isNull(), "bad_answer"), (~V.absent(points) & F.col("score").isNull(), "bad_score"),
    )
    rows = V.computed(rows, {"code": code}).select(*keys, "query_id", "task", (F.col("k") + 1).alias("rank"), F.col("name").alias("video_id"), "frames", "answer", "score", "code")
    bad = lists.where("code IS NOT NULL").select(*keys, "query_id", F.lit(0).alias("rank"), "code").unionByName(rows.where("code IS NOT NULL").select(*keys, "query_id", "rank", "code"))
    return rows.where("code IS NULL").drop("code"), bad


def _spans(items: Column, event: Column, video) -> Column:
    """Intervals as structs; ``video`` gives the video of an item."""
    return F.transform(items, lambda x: F.struct(event.cast("int").alias("event"), video(x).alias("video_id"), V.loose_integer(V.at(x, "start_frame")).alias("start"), V.loose_integer(V.at(x, "end_frame")).alias("end")))


def ground_truth(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(.., query_id, task, video_id, event, start, end) of files (.., value), one row an interval, events from 0 and null
    for other tasks; (.., query_id, answer) of accepted answers; and (.., query_id, code) of queries that do not fit."""
    keys = _carried(files, ("query_id", "task", "video_id", "event", "start", "end", "answer", "code"))
    d = V.computed(files, {"m": V.members(F.try_parse_json("value"))}).select(*keys, "m")
    unread = d.where("m IS NULL").select(*keys, F.lit(None).cast("string").alias("query_id"), F.lit("not_an_object").alias("code"))
    q = d.select(*keys, F.explode("m").alias("query_id", "v")).withColumn("query_id", F.trim("query_id"))
    v, video = F.col("v"), F.col("video")
    answers = F.transform(V.items(V.at(v, "accepted_answers")), lambda a: F.trim(F.try_variant_get(a, "$", "string")))
    q = V.computed(q, {
        "task": F.upper(F.trim(F.try_variant_get(V.at(v, "task_type"), "$", "string"))), "video": _named(V.at(v, "video_id")), "events": V.items(V.at(v, "events")),
        "answers": F.filter(answers, lambda a: a != ""),
    })
    plain = _spans(V.items(V.at(v, "relevant_intervals")), F.lit(None), lambda x: _named(V.at(x, "video_id")))
    ordered = F.transform("events", lambda e, k: _spans(V.items(V.at(e, "intervals")), k, lambda x: video))
    events = F.col("events")
    q = V.computed(q, {"per_event": F.when(F.col("task") == "TRAKE", ordered).otherwise(F.array(plain))})
    q = V.computed(q, {"spans": F.flatten("per_event").cast(f"array<{SPAN}>")})
    trake = F.col("task") == "TRAKE"
    code = V.first_code(
        (F.col("query_id") == "", "no_query_id"), (V.members(v).isNull(), "not_an_object"), (F.col("task").isNull() | ~F.col("task").isin("KIS", "QA", "TRAKE"), "unknown_task"),
        (trake & video.isNull(), "no_video_id"), (trake & (F.coalesce(F.size(events), F.lit(0)) <= 0), "no_events"),
        (F.exists("per_event", lambda s: s.isNull() | (F.size(s) == 0)), "no_intervals"), (F.exists("spans", lambda s: s["video_id"].isNull()), "no_video_id"),
        (F.exists("spans", lambda s: s["start"].isNull() | s["end"].isNull() | (s["start"] < 0)), "bad_frame"), (F.exists("spans", lambda s: s["end"] < s["start"]), "reversed_interval"),
        ((F.col("task") == "QA") & (F.coalesce(F.size("answers"), F.lit(0)) <= 0), "no_answers"),
    )
    q = V.computed(q, {"code": code})
    good = q.where("code IS NULL")
    truth = good.select(*keys, "query_id", "task", F.explode("spans").alias("s")).select(*keys, "query_id", "task", "s.video_id", "s.event", "s.start", "s.end")
    accepted = good.where("task = 'QA'").select(*keys, "query_id", F.explode("answers").alias("answer"))
    return truth, accepted, unread.unionByName(q.where("code IS NOT NULL").select(*keys, "query_id", "code"))
