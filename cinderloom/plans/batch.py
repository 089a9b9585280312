"""A run over a batch of query files: what each is searched with, its reviewed frames, results and submissions a query, and a
manifest of the run.

Defined results: every query file has a retrieval text or none has; texts of queries that are not in the batch, blank ones, and
reviewed frames that are malformed, repeated or outside their video are errors, as is a query without any answer. Queries
with one retrieval text are searched once. Folders of queries that are no longer in the batch are removed; a second run over
the same files leaves the same files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import text as T
from ..functions import variants as V
from ..operators import evaluate, tasks
from ..sources import readers

MOST = evaluate.MAX_ROWS


def _refuse(rows: DataFrame, message: str, *columns: str) -> None:
    """An error that names the first few of ``rows``, if there are any."""
    if found := [", ".join(str(x) for x in r) for r in rows.select(*columns).orderBy(*columns).limit(5).collect()]:
        raise ValueError(f"{message}: {'; '.join(found)}")


def _single(mapping: DataFrame) -> DataFrame:
    """(stem, v) of a file (value) that holds one JSON object."""
    m = V.computed(mapping, {"m": V.members(F.try_parse_json("value"))})
    _refuse(m.where("m IS NULL").select(F.lit("the mapping").alias("what")), "not a JSON object", "what")
    return m.select(F.explode("m").alias("stem", "v"))


def retrieval_texts(mapping: DataFrame, queries: DataFrame) -> DataFrame:
    """(stem, retrieval_text) of a file (value) that maps every query (stem) of the batch, and no other, to a text."""
    rows = _single(mapping)
    _refuse(queries.join(rows, "stem", "left_anti"), "no retrieval text for", "stem")
    _refuse(rows.join(queries, "stem", "left_anti"), "retrieval texts of unknown queries", "stem")
    texts = rows.select("stem", F.nullif(T.collapse(V.string(F.col("v"))), F.lit("")).alias("retrieval_text"))
    _refuse(texts.where("retrieval_text IS NULL"), "retrieval texts that are blank or no texts", "stem")
    return texts


def reviewed_frames(mapping: DataFrame, queries: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """(stem, place, video_id, frame, note) of a file (value) that maps queries of the batch to lists of reviewed frames, in
    their order; ``videos`` (video_id, frames) says how many frames each video has."""
    rows = _single(mapping)
    _refuse(rows.join(queries, "stem", "left_anti"), "reviewed frames of unknown queries", "stem")
    lists = V.computed(rows, {"list": V.items(F.col("v"))})
    _refuse(lists.where("list IS NULL OR size(list) = 0"), "reviewed frames that are no list or an empty one", "stem")
    x = F.col("x")
    items = lists.select("stem", F.posexplode("list").alias("place", "x"))
    note = F.when(V.at(x, "note").isNull(), "").otherwise(F.trim(V.string(V.at(x, "note"))))
    items = V.computed(items, {"video_id": V.string(V.at(x, "video_id")), "frame": V.integer(V.at(x, "frame_id")), "note": note}).drop("x")
    wrong = items.where("video_id IS NULL OR NOT video_id RLIKE '^L[0-9]+_V[0-9]+$' OR frame IS NULL OR frame < 0 OR note IS NULL")
    _refuse(wrong, "malformed reviewed frames", "stem", "place")
    _refuse(items.groupBy("stem", "video_id", "frame").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "reviewed frames that repeat", "stem", "video_id", "frame")
    if videos is not None:
        out = items.join(videos.select("video_id", "frames"), "video_id", "left").where("frames IS NULL OR frame >= frames")
        _refuse(out, "reviewed frames outside their video", "stem", "video_id", "frame")
    return items.select("stem", "place", "video_id", "frame", "note")


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``, none if it does not exist."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in store.listStatus(at) if s.isDirectory()] if store.exists(at) else []


def write_by_query(rows: DataFrame, path: str, key: str, *, as_text: bool = False) -> list[str]:
    """Writes ``rows`` with a folder for each value of ``key``: folders of these values are replaced, those of others are
    removed and their names returned, in order."""
    spark = rows.sparkSession
    sorted_rows = rows.repartition(key).sortWithinPartitions(key, "rank")
    writer = (sorted_rows.select(key, "line") if as_text else sorted_rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key)
    writer.text(path) if as_text else writer.json(path)
    jvm = spark.sparkContext._jvm
    plain = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    kept = {str(r[0]) for r in rows.select(key).distinct().toLocalIterator()}
    stale = sorted(f for f in _folders(spark, path) if f.startswith(f"{key}=") and plain(f.split("=", 1)[1]) not in kept)
    for name in stale:
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return stale


def run(
    queries: DataFrame,
    answer: Callable[[DataFrame], DataFrame],
    path: str,
    *,
    texts: DataFrame | None = None,
    reviewed: DataFrame | None = None,
    limit: int = MOST,
    notes: dict[str, str] | None = None,
) -> DataFrame:
    """Writes ``results`` and ``submissions`` of the query files (stem, text) and a ``manifest`` under ``path``, and returns the
    manifest's rows: one a query, each with the figures of the run.

    ``answer`` gives (text_id, rank, video_id, frame, score) for distinct texts (text_id, text). ``texts`` and ``reviewed`` are
    what ``retrieval_texts`` and ``reviewed_frames`` return; ``notes`` goes into the manifest.
    """
    if not 1 <= limit <= MOST:
        raise ValueError(f"the limit is between 1 and {MOST}")
    spark = queries.sparkSession
    named = readers.submissions(queries.select("stem", "text"))
    if texts is not None:
        named = named.join(texts.select("stem", "retrieval_text"), "stem")
    else:
        named = named.withColumn("retrieval_text", T.collapse(F.col("text")))
    named = storage.stored(named.withColumn("text_id", F.xxhash64("retrieval_text")), "batch")
    found = answer(named.groupBy("text_id").agg(F.min("retrieval_text").alias("text")))
    answers = named.select("stem", "text_id").join(found, "text_id").withColumnRenamed("stem", "query_id").where(F.col("rank") <= limit)
    if reviewed is not None:
        ordered = reviewed.select(F.col("stem").alias("query_id"), "place", "video_id", "frame")
        answers = tasks.reviewed_first(answers.select("query_id", "rank", "video_id", "frame", "score"), ordered, limit)
    else:
        answers = answers.select("query_id", "rank", "video_id", "frame", "score").withColumn("reviewed", F.lit(False))
    answers = storage.stored(answers, "answers")
    _refuse(named.select(F.col("stem").alias("query_id")).join(answers, "query_id", "left_anti"), "no answers for", "query_id")
    submission = answers.join(named.select(F.col("stem").alias("query_id"), "submission"), "query_id")
    stale = write_by_query(answers, f"{path}/results", "query_id")
    lines = evaluate.submission_lines(submission.select(F.col("submission").alias("query_id"), "rank", "video_id", "frame", F.lit(None).cast("string").alias("answer")))
    stale += write_by_query(lines.withColumnRenamed("query_id", "submission"), f"{path}/submissions", "submission", as_text=True)

    per_query = answers.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("predictions"), F.count_if("reviewed").alias("reviewed_predictions"), F.min_by(F.struct("video_id", "frame", "score"), "rank").alias("top")
    )
    shared = named.groupBy("text_id").agg(F.min(F.struct(T.natural_key(F.col("stem")).alias("k"), "stem"))["stem"].alias("leader"))
    same = named.groupBy("text").agg(F.min(F.struct(T.natural_key(F.col("stem")).alias("k"), "stem"))["stem"].alias("first"))
    rows = named.join(shared, "text_id").join(same, "text").join(per_query.withColumnRenamed("query_id", "stem"), "stem")
    changed = T.collapse(F.col("text")) != F.col("retrieval_text")
    rows = rows.select(
        F.col("stem").alias("query_id"), "submission", "retrieval_text", changed.alias("text_replaced"), "predictions", "reviewed_predictions", "top",
        (F.col("first") != F.col("stem")).alias("repeats_query"), (F.col("leader") != F.col("stem")).alias("repeats_text"),
    )
    whole = named.agg(
        F.count(F.lit(1)).alias("queries"), F.count_distinct("text").alias("texts"), F.count_distinct("text_id").alias("searches"),
        F.bit_xor(F.xxhash64("stem", "text")).alias("batch_hash"),
    ).withColumn("_one", F.lit(1))
    run_notes: list[Column] = [F.lit(limit).alias("limit"), F.array(*[F.lit(s) for s in stale]).cast("array<string>").alias("removed"), F.lit(uuid.uuid4().hex).alias("run_id")]
    run_notes += [F.lit(v).alias(k) for k, v in sorted((notes or {}).items())]
    manifest = rows.withColumn("_one", F.lit(1)).join(F.broadcast(whole), "_one").drop("_one").select("*", *run_notes)
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema(manifest.schema).json(f"{path}/manifest")
