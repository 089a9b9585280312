"""Queries over files of the collection's own formats, made from the test tables and read again, and their SQL, which starts
from the tables and knows nothing of the formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evaluate
from ..sources import evaluation, tables, transcripts

NULLS = {"ignoreNullFields": "false"}


def _prediction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each video, of three tasks in turn: its first eight keyframes, in the three shapes of files in turn."""
    k = tables.keyframes(spark, sf_dir)
    later = k.select("video_id", (F.col("n") - 1).alias("n"), F.col("frame_idx").alias("second"))
    rows = k.where("n <= 8").join(later, ["video_id", "n"], "left").withColumn("task", F.col("video_id") % 3)
    video, trake = F.col("video_id").cast("string").alias("video_id"), F.col("task") == 2
    several = F.struct(video, F.filter(F.array(F.col("frame_idx"), F.when(trake, F.col("second"))), lambda x: x.isNotNull()).alias("frame_ids"), F.concat(F.upper("label"), F.lit("!")).alias("answer"), "score")
    one = F.struct(video, "frame_idx", F.lower("label").alias("answer"))
    item = F.when((F.col("n") % 2 == 0) & ~trake, F.to_json(one)).otherwise(F.to_json(several))
    item = F.when((F.col("video_id") % 5 == 0) & (F.col("n") == 2), '{"video_id":" ","frame_ids":[1]}').otherwise(item)
    lists = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("n", item.alias("j")))).alias("l"))
    body = F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["j"]), ","), F.lit("]"))
    query, shape = F.concat(F.lit("Q"), "video_id"), F.floor(F.col("video_id") / 3) % 3
    value = F.when(shape == 0, F.concat(F.lit('{"query_id":" '), query, F.lit(' ","task_type":"kis","predictions":'), body, F.lit("}"))).when(shape == 1, F.concat(F.lit('{"'), query, F.lit('":'), body, F.lit("}"))).otherwise(body)
    return lists.select("video_id", F.when(shape == 2, query).alias("asked_id"), value.alias("value")).withColumnRenamed("video_id", "file")


def _truth_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = tables.keyframes(spark, sf_dir)
    near = F.struct(F.greatest(F.lit(0).cast("long"), F.col("frame_idx") - 10).alias("start_frame"), (F.col("frame_idx") + 10).alias("end_frame"))
    held = k.where("n IN (3, 4, 6)").groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("n", F.col("video_id").cast("string").alias("video_id"), near.alias("s")))).alias("l"))
    query = F.concat(F.lit('{"Q'), "video_id", F.lit('":'))
    placed = F.transform(F.filter("l", lambda x: x["n"] != 4), lambda x: F.struct(x["video_id"].alias("video_id"), x["s"]["start_frame"].alias("start_frame"), x["s"]["end_frame"].alias("end_frame")))
    answers = F.when(F.col("video_id") % 3 == 1, F.array(F.lit(" Click"), F.lit("view?")))
    plain = F.struct(F.when(F.col("video_id") % 3 == 0, " KIS ").otherwise("qa").alias("task_type"), placed.alias("relevant_intervals"), answers.alias("accepted_answers"))
    ordered = F.struct(F.lit("trake").alias("task_type"), F.col("video_id").cast("string").alias("video_id"), F.transform("l", lambda x: F.struct(F.array(x["s"]).alias("intervals"))).alias("events"))
    value = F.concat(query, F.when(F.col("video_id") % 3 == 2, F.to_json(ordered)).otherwise(F.to_json(plain)), F.lit("}"))
    return held.select("video_id", value.alias("value")).withColumnRenamed("video_id", "file")


def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of predictions and of ground truth read and evaluated, query by query."""
    found, _ = evaluation.predictions(_prediction_files(spark, sf_dir))
    truth, accepted, _ = evaluation.ground_truth(_truth_files(spark, sf_dir))
    known = found.join(truth.select("query_id").distinct(), "query_id", "left_semi")
    report = evaluate.evaluate_run(known, truth, accepted, text.normalize_answer)
    return report.select("query_id", "task", *[F.round(f"r{c}", 6).alias(f"r{c}") for c in evaluate.CUTOFFS], F.round("final", 6).alias("final"), "n_predictions")


def prediction_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = evaluation.predictions(_prediction_files(spark, sf_dir))
    return bad.select("query_id", F.col("rank").cast("long").alias("rank"), "code")


def _transcript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts, in the two schemas in turn; a turn begins every ten seconds."""
    c = tables.read(spark, sf_dir, "conversations")
    start = F.col("turn") * 10.0
    end = F.when((F.col("conv_id") + F.col("turn")) % 17 == 0, start - 1).otherwise(start + F.length("text") / 16)
    first = F.substring_index("text", " ", 1)
    no = F.lit(None).cast("double")
    new_word = F.array(F.struct(first.alias("text"), start.alias("start"), (start + 0.5).alias("end"), F.lit(0.5).alias("confidence")))
    old_word = F.array(F.struct(first.alias("word"), start.alias("start"), (start + 0.5).alias("end"), F.lit(0.5).alias("probability")))
    new = F.struct(F.col("turn").alias("segment_id"), start.alias("start"), end.alias("end"), "text", F.lit(-0.25).alias("avg_logprob"), no.alias("no_speech_prob"), F.lit(0.75).alias("confidence"), new_word.alias("words"))
    old = F.struct(
        F.col("turn").alias("segment_id"), F.struct(start.alias("start"), end.alias("end")).alias("time_range"),
        F.struct(F.concat(F.lit(" "), F.col("text")).alias("raw_text"), F.when(F.col("turn") % 2 == 0, " ").otherwise(F.col("text")).alias("clean_text"), F.lit(0.75).alias("confidence"), old_word.alias("words")).alias("audio_metadata"),
    )
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", F.to_json(new, NULLS).alias("new"), F.to_json(old, NULLS).alias("old")))).alias("l"))
    body = lambda name: F.concat(F.lit('"segments":['), F.array_join(F.transform("l", lambda x: x[name]), ","), F.lit("]}"))
    duration = F.when(F.col("conv_id") % 19 == 0, "5.0").otherwise("null")
    legacy = F.concat(
        F.lit('{"source_video":"C:\\\\\\\\clips\\\\\\\\'), "conv_id", F.lit('.v1.mp4","pipeline_config":{"asr_model":"m"},"audio_info":{"duration_sec":'), duration,
        F.lit(',"detected_language":"vi","language_probability":1},'), body("old"),
    )
    canonical = F.concat(F.lit('{"video_id":"'), "conv_id", F.lit('.v1","model_name":"m","language":"vi","language_probability":1,"duration_seconds":'), duration, F.lit(","), body("new"))
    return rows.select("conv_id", F.when(F.col("conv_id") % 2 == 0, legacy).otherwise(canonical).alias("value"))


def transcript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the transcripts that are whole, alike from either schema."""
    _, rows, _ = transcripts.transcripts(_transcript_files(spark, sf_dir))
    word = F.get("words", F.lit(0))
    return rows.select(
        "conv_id", "video_id", "segment_id", F.col("position").cast("long").alias("position"), F.md5(F.trim("text")).alias("text_md5"), "start", F.round("end", 6).alias("end"),
        "avg_logprob", "confidence", word["text"].alias("word"), word["end"].alias("word_end"), word["confidence"].alias("word_confidence"),
    )


def transcript_file_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, bad = transcripts.transcripts(_transcript_files(spark, sf_dir))
    return bad.select("conv_id", F.col("position").cast("long").alias("position"), "code")


QUERIES = {f.__name__: f for f in (evaluation_report, prediction_problems, transcript_files, transcript_file_problems)}

_KEYFRAMES = """k AS (
  SELECT user_id AS video, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type AS label,
    CAST(floor((epoch_us(ts) - 1704067200000000) / 1e6 * 25) AS BIGINT) AS frame
  FROM events
)"""
_SEGMENTS = """seg AS (
  SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS position, turn * 10.0::DOUBLE AS s,
    CASE WHEN (conv_id + turn) % 17 = 0 THEN turn * 10.0::DOUBLE - 1 ELSE turn * 10.0::DOUBLE + length(text) / 16.0::DOUBLE END AS e,
    row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) > 1 AS again
  FROM conversations
), coded AS (
  SELECT *, CASE WHEN e < 0 THEN 'bad_end' WHEN again THEN 'duplicate_segment_id' WHEN e < s THEN 'reversed_time' WHEN s + 0.5 > e + 0.05 THEN 'word_outside'
    WHEN conv_id % 19 = 0 AND e > 5.05 THEN 'beyond_duration' END AS code
  FROM seg
)"""
SOURCES = {
    "evaluation_report": f"""WITH {_KEYFRAMES}, good AS (
  SELECT *, lead(frame) OVER (PARTITION BY video ORDER BY n) AS second FROM k QUALIFY video IN (SELECT video FROM k WHERE n = 3)
), p AS (
  SELECT *, row_number() OVER (PARTITION BY video ORDER BY n) AS rank FROM good WHERE n <= 8 AND NOT (video % 5 = 0 AND n = 2)
), hit AS (
  SELECT p.video, p.rank, CASE
    WHEN p.video % 3 < 2 THEN CAST(bool_or(t.n <> 4 AND p.frame BETWEEN greatest(0, t.frame - 10) AND t.frame + 10) AND (p.video % 3 = 0 OR any_value(p.label) IN ('click', 'view')) AS DOUBLE)
    ELSE (CAST(bool_or(t.n = 3 AND p.frame BETWEEN greatest(0, t.frame - 10) AND t.frame + 10) AS INTEGER)
      + coalesce(CAST(bool_or(t.n = 4 AND p.second BETWEEN greatest(0, t.frame - 10) AND t.frame + 10) AS INTEGER), 0)) / any_value(events)::DOUBLE END AS score
  FROM p JOIN (SELECT *, count(*) OVER (PARTITION BY video) AS events FROM k WHERE n IN (3, 4, 6)) t ON t.video = p.video GROUP BY p.video, p.rank
), r AS (
  SELECT video, max(score) FILTER (rank <= 1) AS r1, max(score) FILTER (rank <= 5) AS r5, max(score) AS r20, count(*) AS n FROM hit GROUP BY video
)
SELECT 'Q' || video AS query_id, ['KIS', 'QA', 'TRAKE'][video % 3 + 1] AS task, round(r1, 6) AS r1, round(r5, 6) AS r5, round(r20, 6) AS r20, round(r20, 6) AS r50, round(r20, 6) AS r100,
  round((r1 + r5 + 3 * r20) / 5, 6) AS final, n AS n_predictions FROM r""",
    "prediction_problems": f"WITH {_KEYFRAMES} SELECT 'Q' || video AS query_id, n AS rank, 'no_video_id' AS code FROM k WHERE n = 2 AND video % 5 = 0",
    "transcript_files": f"""WITH {_SEGMENTS}
SELECT conv_id, conv_id || '.v1' AS video_id, CAST(turn AS BIGINT) AS segment_id, position, md5(trim(text)) AS text_md5, s AS start, round(e, 6) AS end,
  CASE WHEN conv_id % 2 = 1 THEN -0.25::DOUBLE END AS avg_logprob, 0.75::DOUBLE AS confidence, split_part(text, ' ', 1) AS word, s + 0.5 AS word_end, 0.5::DOUBLE AS word_confidence
FROM coded WHERE conv_id NOT IN (SELECT conv_id FROM coded WHERE code IS NOT NULL)""",
    "transcript_file_problems": f"WITH {_SEGMENTS} SELECT conv_id, position, code FROM coded WHERE code IS NOT NULL",
}
