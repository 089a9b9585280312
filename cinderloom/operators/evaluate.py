"""Scores of ranked predictions and their export.

Defined results: a null frame, video or answer hits nothing; of predictions that share a rank the best counts; queries
without predictions score 0, and predictions of unknown queries stop a run. Empty tables give empty results. Columns that
are not named are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS = (1, 5, 20, 50, 100)
MAX_ROWS = 100


def recall_at(predictions: DataFrame, queries: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """Best score within each cutoff and their mean, for every query of ``queries`` (query_id, task); a query without
    predictions has 0. Predictions: (query_id, rank, score)."""
    if not cutoffs or any(c <= 0 for c in cutoffs) or len(set(cutoffs)) != len(cutoffs):
        raise ValueError("cutoffs are different positive numbers")
    best = predictions.groupBy("query_id").agg(*[F.max(F.when(F.col("rank") <= c, F.col("score"))).alias(f"r{c}") for c in cutoffs])
    out = queries.join(best, "query_id", "left").select("query_id", "task", *[F.coalesce(f"r{c}", F.lit(0.0)).alias(f"r{c}") for c in cutoffs])
    total = F.lit(0.0)
    for c in cutoffs:
        total = total + F.col(f"r{c}")
    return out.withColumn("final", total / len(cutoffs))


def macro(recalls: DataFrame) -> DataFrame:
    """Means over all queries and per task."""
    overall = recalls.groupingSets([[F.col("task")], []], F.col("task")).agg(F.avg("final").alias("final"), F.count(F.lit(1)).alias("n"))
    return overall.select(F.coalesce("task", F.lit("all")).alias("task"), "final", "n")


def interval_hits(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """1.0 for predictions (query_id, rank, video_id, frame) inside any interval of their query, both ends included."""
    t = truth.select("query_id", "video_id", "start", "end")
    joined = predictions.join(t, ["query_id", "video_id"], "left")
    hit = F.coalesce(F.max((F.col("frame") >= F.col("start")) & (F.col("frame") <= F.col("end"))), F.lit(False))
    return joined.groupBy("query_id", "rank").agg(hit.cast("double").alias("score"))


def submission_lines(answers: DataFrame) -> DataFrame:
    """(query_id, rank, line): CSV lines in rank order; more than ``MAX_ROWS`` rows of a query are an error."""
    quoted = F.when(F.col("answer").rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace("answer", F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col("answer"))
    line = F.concat_ws(",", F.col("video_id").cast("string"), F.col("frame").cast("string"), quoted)
    return answers.select("query_id", "rank", F.when(F.col("rank") > MAX_ROWS, F.raise_error(F.lit("more than 100 rows for a query"))).otherwise(line).alias("line"))


def ordered_lines(answers: DataFrame) -> DataFrame:
    """(query_id, rank, line): CSV lines of ordered events, a video and its frames (query_id, rank, video_id, frames); a line
    without frames, a null or negative frame, and more than ``MAX_ROWS`` rows of a query are errors."""
    frames = F.col("frames").cast("array<string>")
    wrong = F.coalesce(F.size("frames"), F.lit(0)) <= 0
    bad = F.exists("frames", lambda f: f.isNull() | (f < 0))
    stop = lambda message: F.raise_error(F.lit(message)).cast("string")
    line = F.when(F.col("rank") > MAX_ROWS, stop("more than 100 rows for a query")).when(wrong, stop("an answer without frames")).when(bad, stop("a frame is null or negative"))
    return answers.select("query_id", "rank", line.otherwise(F.concat_ws(",", F.col("video_id").cast("string"), frames)).alias("line"))


def ordered_hits(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of a query's events whose frame lies in one of the event's intervals; 0 in another video.

    Predictions: (query_id, rank, video_id, frames); truth: (query_id, video_id, event, start, end), events from 0.
    """
    n = truth.groupBy("query_id").agg((F.max("event") + 1).alias("n_events"))
    p = predictions.select("query_id", "rank", "video_id", F.posexplode_outer("frames").alias("event", "frame"))
    t = truth.select("query_id", "video_id", "event", "start", "end")
    joined = p.join(t, ["query_id", "video_id", "event"], "left")
    hit = F.coalesce(F.max((F.col("frame") >= F.col("start")) & (F.col("frame") <= F.col("end"))), F.lit(False))
    events = joined.groupBy("query_id", "rank", "event").agg(hit.alias("hit"))
    return events.groupBy("query_id", "rank").agg(F.count_if("hit").alias("hits")).join(n, "query_id").select("query_id", "rank", (F.col("hits") / F.col("n_events")).alias("score"))


def answer_hits(predictions: DataFrame, accepted: DataFrame, normalize) -> DataFrame:
    """Interval scores (query_id, rank, score, answer) that stand only where the normalised answer is an accepted one."""
    a = accepted.select("query_id", normalize(F.col("answer")).alias("same")).distinct().withColumn("ok", F.lit(1.0))
    p = predictions.withColumn("same", normalize(F.col("answer"))).join(a, ["query_id", "same"], "left")
    return p.select("query_id", "rank", (F.col("score") * F.coalesce("ok", F.lit(0.0))).alias("score"))


def evaluate_run(predictions: DataFrame, truth: DataFrame, accepted: DataFrame, normalize, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """(query_id, task, r.., final, n_predictions) of a run over all three tasks.

    Predictions: (query_id, rank, video_id, frames, answer); truth and accepted answers as ``sources.evaluation.ground_truth``
    gives them. The first frame counts but for TRAKE, whose events have a frame each. Ranks are counted anew from 1.
    """
    queries = truth.select("query_id", "task").distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    p = predictions.select("query_id", place.alias("rank"), "video_id", "frames", "answer").join(queries, "query_id", "left")
    stop = F.raise_error(F.concat(F.lit("prediction of an unknown query: "), F.col("query_id"))).cast("string")
    p = p.withColumn("task", F.coalesce("task", stop))
    first = p.where("task <> 'TRAKE'").select("query_id", "rank", "video_id", F.get("frames", F.lit(0)).alias("frame"))
    placed = interval_hits(first, truth.where("task <> 'TRAKE'")).join(p.select("query_id", "rank", "task", "answer"), ["query_id", "rank"])
    scores = placed.where("task = 'KIS'").select("query_id", "rank", "score")
    scores = scores.unionByName(answer_hits(placed.where("task = 'QA'").select("query_id", "rank", "score", "answer"), accepted, normalize))
    scores = scores.unionByName(ordered_hits(p.where("task = 'TRAKE'"), truth.where("task = 'TRAKE'")))
    n = p.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    out = recall_at(scores, queries, cutoffs).join(n, "query_id", "left")
    return out.withColumn("n_predictions", F.coalesce("n", F.lit(0).cast("long"))).drop("n")


def unknown_queries(predictions: DataFrame, queries: DataFrame) -> DataFrame:
    return predictions.select("query_id").distinct().join(queries.select("query_id"), "query_id", "left_anti")
