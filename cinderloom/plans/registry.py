"""All registered queries and the SQL that checks them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import storage
from ..functions import text, vectors
from ..operators import embed, evaluate, fusion, gallery, objects, penalised, query, ranking, search, tasks, timeline, validate, windows
from ..sources import tables
from ..streaming import ingest
from . import assembly, boundary, formats, searches, stores
from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]
DAY = 86_400.0
TEXT_DIM = 256
VARIANTS = 1024
PER_SOURCE = 500
WEIGHTS = {"visual": 1.0, "asr": 0.8}


def _knn(metric: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = tables.vectors(spark, sf_dir)
        first = v.where("vec_id = 0").select("v").first()["v"]
        return search.knn(v, first, 20, metric).select("vec_id", F.round("score", 6).alias("score"))

    return run


def knn_batch_topk_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector against all."""
    v = tables.vectors(spark, sf_dir)
    return search.knn_batch(v, v.where("vec_id % 100 = 0"), 10).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


def _embedded(rows: DataFrame, key: str) -> DataFrame:
    return embed.hash_embed(rows, key, "text", dim=TEXT_DIM, place=embed.md5_place, packed=True)


def _text_hits(spark: SparkSession, sf_dir: str, asked: DataFrame, k: int) -> DataFrame:
    """Documents nearest to the texts (vec_id, text)."""
    found = search.knn_batch(_embedded(tables.read(spark, sf_dir, "documents"), "doc_id"), _embedded(asked, "vec_id"), k)
    return found.select("query_id", "rank", F.col("vec_id").alias("candidate_id"), "score")


def hash_embed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = tables.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"), "text")
    return _text_hits(spark, sf_dir, asked, 10).select("query_id", F.col("rank").cast("long").alias("rank"), "candidate_id", F.round("score", 6).alias("score"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every benchmark item, the vectors nearest to the one of its id and the documents nearest to its text."""
    v, b = tables.vectors(spark, sf_dir), tables.read(spark, sf_dir, "benchmark")
    visual = search.knn_batch(v, v.join(b, F.col("vec_id") == F.col("item_id"), "left_semi"), PER_SOURCE)
    visual = visual.select("query_id", F.lit("visual").alias("source"), F.col("vec_id").alias("candidate_id"), "score")
    asr = _text_hits(spark, sf_dir, b.select(F.col("item_id").alias("vec_id"), "text"), PER_SOURCE)
    return visual.unionByName(asr.select("query_id", F.lit("asr").alias("source"), "candidate_id", "score"))


def variant_max_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text search with query variants; the paraphrase is the text less its first word."""
    b = tables.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    v = query.expand(b, paraphrases=[lambda x: F.regexp_replace(x, r"^\s*\S+\s+", "")]).withColumn("vec_id", F.col("query_id") * VARIANTS + F.col("variant"))
    found = _text_hits(spark, sf_dir, v.select("vec_id", "text"), 20).withColumnRenamed("query_id", "vec_id")
    merged = query.merge_variants(found.join(v.select("vec_id", "query_id", "weight"), "vec_id").withColumn("source", F.lit("asr")))
    return merged.select("query_id", "candidate_id", F.round("score", 6).alias("score"))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fusion.top(fusion.reciprocal_rank_fusion(hits(spark, sf_dir), WEIGHTS), 50)
    return f.select("query_id", F.col("rank").cast("long").alias("rank"), "candidate_id", F.round("score", 10).alias("score"), "n_sources")


def _weighted(normalization: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = fusion.weighted_score_fusion(hits(spark, sf_dir), WEIGHTS, normalization)
        return f.select("query_id", "candidate_id", F.round("score", 6).alias("score"), "n_sources")

    return run


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = tables.keyframes(spark, sf_dir)
    return k.select(F.lit(0).cast("long").alias("query_id"), F.col("event_id").alias("candidate_id"), "video_id", F.col("pts_time").alias("ts"), "score", F.col("label").alias("modality"))


def video_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.aggregate_by_video(_candidates(spark, sf_dir)).select("video_id", F.round("score", 6).alias("score"))


def diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.diversify(_candidates(spark, sf_dir), limit=50, radius=DAY).select(F.col("rank").cast("long").alias("rank"), "candidate_id", "video_id", F.round("utility", 6).alias("utility"))


def kis_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known-item search end to end: vector and text hits, fused by rank, diversified per source document."""
    fused = fusion.top(fusion.reciprocal_rank_fusion(hits(spark, sf_dir), WEIGHTS), 1000)
    v = tables.vectors(spark, sf_dir).select(F.col("vec_id").alias("candidate_id"), F.col("label").cast("long").alias("video_id"))
    pool = fused.join(v, "candidate_id").select("query_id", "candidate_id", "video_id", F.lit(None).cast("double").alias("ts"), F.round("score", 9).alias("score"))
    best = ranking.diversify(pool, limit=20, same_video=0.05, temporal=0.3)
    return best.select("query_id", F.col("rank").cast("long").alias("rank"), "candidate_id", "video_id")


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.windows(tables.keyframes(spark, sf_dir), DAY, DAY / 2, tables.FPS)
    return w.select("video_id", "k", "start", F.round("end", 6).alias("end"), "n_keyframes", F.col("representative").cast("long").alias("representative"), "labels", "start_frame", "end_frame")


def window_transcript_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.overlapping_text(tables.transcript(spark, sf_dir), 10.0, 5.0)
    return w.select("video_id", "k", F.md5("text").alias("text_md5"), "n_segments")


def window_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of each label, normalised, one row per component."""
    v = tables.vectors(spark, sf_dir)
    first = v.select(F.size("v")).first()
    pooled = windows.mean_pool(v, "label", dim=first[0] if first else 0)
    return pooled.select("label", F.posexplode("v").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def nearest_keyframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = tables.keyframes(spark, sf_dir)
    asked = k.select("video_id").distinct().select("video_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("d")).select("video_id", (F.col("d") * F.lit(DAY)).alias("at"))
    return timeline.nearest(asked, k).select("video_id", "at", F.col("n").cast("long").alias("n"))


def timeline_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = tables.keyframes(spark, sf_dir)
    shifted = k.withColumn("frame_idx", F.when(F.col("n") % 10 == 0, F.col("frame_idx") + 100).otherwise(F.col("frame_idx")))
    return timeline.violations(shifted, tables.FPS).select("video_id", F.col("n").cast("long").alias("n"), "code")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyframes as candidates of three ordered events: those of the first three labels."""
    k = tables.keyframes(spark, sf_dir)
    labels = [r["label"] for r in k.select("label").distinct().orderBy("label").limit(3).collect()]
    event = F.lit(None).cast("int")
    for e, label in enumerate(labels):
        event = F.when(F.col("label") == label, e).otherwise(event)
    return k.select("video_id", event.alias("event"), F.col("pts_time").alias("ts"), F.col("frame_idx").alias("frame"), "score").where("event IS NOT NULL")


def _align(max_gap: float | None, rate: float) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        best = F.row_number().over(Window.partitionBy("video_id", "event").orderBy(F.desc("score"), "ts", "frame"))
        c = _events(spark, sf_dir).withColumn("r", best).where("r <= 30").drop("r")
        cost = (lambda gap: F.log1p(gap) * rate) if rate else None
        return timeline.align(c, 3, max_gap=max_gap, penalty=cost).select("video_id", F.round("score", 6).alias("score"))

    return run


def trake_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = ranking.aggregate_by_video(_candidates(spark, sf_dir))
    c = _events(spark, sf_dir).withColumn("query_id", F.lit(0).cast("long"))
    found = tasks.trake(c, whole, 3)
    return found.select(F.col("rank").cast("long").alias("rank"), "video_id", F.round("score", 6).alias("score"), F.array_join(F.col("frames").cast("array<string>"), ",").alias("frames"))


def ordered_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = tables.keyframes(spark, sf_dir)
    second = F.when(F.col("label") == "click", F.col("score") * 2).otherwise(F.col("score") / 2)
    p = k.select("video_id", F.col("pts_time").alias("ts"), F.col("score").alias("s0"), second.alias("s1"), (F.col("score") + F.col("n") / 100).alias("s2"))
    return timeline.viterbi(p, 3, max_gap=5 * DAY).select("video_id", F.round("score", 6).alias("score"))


def ordered_viterbi_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ordered_viterbi, with a price on the gaps and no upper limit; a slice is five days."""
    k = tables.keyframes(spark, sf_dir)
    second = F.when(F.col("label") == "click", F.col("score") * 2).otherwise(F.col("score") / 2)
    p = k.select("video_id", F.col("pts_time").alias("ts"), F.col("score").alias("s0"), second.alias("s1"), (F.col("score") + F.col("n") / 100).alias("s2"))
    return penalised.viterbi(p, 3, lambda gap: 4 * math.log1p(gap), min_gap=60.0, slice_length=5 * DAY).select("video_id", F.round("score", 6).alias("score"))


def dense_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best keyframes of each video, refined among its keyframes within half a day."""
    k = tables.keyframes(spark, sf_dir)
    r = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("score"), "event_id"))
    c = k.withColumn("r", r).where("r <= 3").select(F.lit(0).alias("query_id"), F.col("event_id").alias("candidate_id"), "video_id", F.col("frame_idx").alias("frame"), F.col("pts_time").alias("ts"), "score")
    frames = k.select("video_id", F.col("frame_idx").alias("frame"), F.col("pts_time").alias("ts"), (F.col("n") % 7 / 7.0).alias("match"))
    out = tasks.refine(c, frames, F.col("match"), radius=DAY / 2)
    return out.select("video_id", "frame", F.round("score", 6).alias("score"), "refined")


def nms_classwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = objects.suppress(tables.detections(spark, sf_dir), most=10_000)
    return kept.select("frame", "label", F.col("pos").cast("long").alias("pos"), F.round("score", 6).alias("score"))


def object_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.counts(tables.detections(spark, sf_dir))


def manifest_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of six components each id has, from one aggregation over the union of their ids."""
    parts = {"customer": "c_custkey", "orders": "o_custkey", "supplier": "s_suppkey", "part": "p_partkey", "nation": "n_nationkey", "region": "r_regionkey"}
    ids = None
    for name, key in parts.items():
        rows = tables.read(spark, sf_dir, name).select(F.col(key).cast("long").alias("id"), F.lit(name).alias("component"))
        ids = rows if ids is None else ids.unionByName(rows)
    present = ids.groupBy("id").agg(*[F.count_if(F.col("component") == name).alias(name) for name in parts])
    missing = F.array_join(F.filter(F.array(*[F.when(F.col(name) == 0, name) for name in sorted(parts)]), lambda x: x.isNotNull()), ",")
    return present.select("id", missing.alias("missing"), F.col("orders").alias("n_orders"))


def scope_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array_sort(F.collect_set(F.upper(F.trim("n_name"))))
    return tables.read(spark, sf_dir, "nation").agg(F.sha2(F.concat(F.array_join(names, "\n"), F.lit("\n")), 256).alias("scope_hash"))


def scope_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations without suppliers, and how many suppliers the others have."""
    n, s = tables.read(spark, sf_dir, "nation"), tables.read(spark, sf_dir, "supplier")
    missing = n.join(s, n["n_nationkey"] == s["s_nationkey"], "left_anti").select(F.col("n_nationkey").cast("long").alias("id"), F.lit("missing").alias("state"))
    present = n.join(s, n["n_nationkey"] == s["s_nationkey"], "left_semi").select(F.col("n_nationkey").cast("long").alias("id"), F.lit("present").alias("state"))
    return missing.unionByName(present)


def parse_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.read(spark, sf_dir, "benchmark")
    return b.select("item_id", text.language(F.col("text")).alias("language"), text.task_type(F.col("text")).alias("task"), F.coalesce(F.size(text.split_events(F.col("text"))), F.lit(0)).cast("long").alias("n_events"))


def normalize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.md5(text.normalize_answer(F.col("text"))).alias("normal_md5"), F.size(text.unicode_tokens(F.col("text"))).cast("long").alias("n_tokens"))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source in order of length, scored by their quality label."""
    d, labels = tables.read(spark, sf_dir, "documents"), tables.read(spark, sf_dir, "labels").select("doc_id", "quality")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    ranked = d.select("source", "doc_id", rank.alias("rank")).where(F.col("rank") <= 100)
    return ranked.join(labels, "doc_id", "left").select(F.col("source").alias("query_id"), "rank", F.coalesce(F.col("quality").cast("double"), F.lit(0.0)).alias("score"))


def eval_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = tables.read(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.lit("KIS").alias("task")).distinct()
    r = evaluate.recall_at(_predictions(spark, sf_dir), q)
    return r.select("query_id", "r1", "r5", "r20", "r50", "r100", F.round("final", 6).alias("final"))


def eval_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    task = F.when(F.length("source") == 4, "KIS").otherwise("QA")
    q = tables.read(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), task.alias("task")).distinct()
    return evaluate.macro(evaluate.recall_at(_predictions(spark, sf_dir), q)).select("task", F.round("final", 6).alias("final"), "n")


def submission_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.read(spark, sf_dir, "conversations").where("role = 'assistant'")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    a = c.select(F.col("conv_id").alias("query_id"), rank.alias("rank"), F.col("conv_id").alias("video_id"), F.col("turn").alias("frame"), F.col("text").alias("answer"))
    return evaluate.submission_lines(a).select("query_id", F.col("rank").cast("long").alias("rank"), "line")


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.read(spark, sf_dir, "events")
    k = F.from_json("props", "k long")["k"]
    return e.select("event_id", k.alias("k"), text.format_timestamp((F.col("event_id") % 100000) / 8).alias("clock"))


def window_word_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.transcript(spark, sf_dir)
    spans = t.groupBy("video_id").agg(F.max("end").alias("duration"))
    w = windows.words_in_windows(windows.timed_words(t), spans, 10.0, 5.0)
    return w.select("video_id", "k", F.md5("text").alias("text_md5"), "n_words")


def window_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of each window's keyframes in order of appearance."""
    k = tables.keyframes(spark, sf_dir)
    span = k.groupBy("video_id").agg((F.max("pts_time") + 1 / tables.FPS).alias("duration"))
    held = windows.place(k, "pts_time", DAY, DAY / 2).join(windows.grid(span, DAY, DAY / 2), ["video_id", "k"]).where("pts_time >= start AND pts_time < end")
    uids = F.transform(F.array_sort(F.collect_list(F.struct("n", "keyframe_uid"))), lambda x: x["keyframe_uid"])
    w = held.groupBy("video_id", "k").agg(uids.alias("keyframe_uids"))
    return windows.attach_text(w, k.select("keyframe_uid", F.col("label").alias("text"))).select("video_id", "k", F.replace("text", F.lit("\n"), F.lit(",")).alias("text"))


def nearest_frame_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = tables.keyframes(spark, sf_dir)
    asked = k.select(
        F.col("event_id").alias("ask_id"), "video_id", F.when(F.col("n") % 3 == 0, F.col("keyframe_uid")).alias("keyframe_uid"),
        F.when(F.col("n") % 3 == 1, F.col("frame_idx") + 40).alias("frame_idx"), F.when(F.col("n") % 4 > 0, F.col("pts_time") + 100).alias("ts"),
    )
    return gallery.resolve(asked, k).select("ask_id", F.col("n").cast("long").alias("n"), "how")


def gallery_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of ordered events as documents, and their rows: the frames of a video by label, in time."""
    k = tables.keyframes(spark, sf_dir)
    g = k.groupBy("video_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "frame_idx"))), lambda x: x["frame_idx"]).alias("frames"))
    one = F.struct(F.col("video_id").cast("string").alias("video_id"), "frames")
    d = g.groupBy("label").agg(F.array_sort(F.collect_list(one)).alias("results"))
    documents = d.select(F.to_json(F.struct(F.col("label").alias("query_id"), F.lit("TRAKE").alias("task"), "results")).alias("payload"))
    return gallery.rows(documents).select("query_id", F.col("rank").cast("long").alias("rank"), F.col("event").cast("long").alias("event"), "video_id", "frame")


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda name, key: tables.read(spark, sf_dir, name).select(F.col(key).cast("long").alias("id"))
    t = validate.manifest({"orders": ids("orders", "o_orderkey"), "lineitem": ids("lineitem", "l_orderkey"), "events": ids("events", "event_id")})
    return validate.manifest_issues(t, ("orders",), ("lineitem", "events"), [("orders", "lineitem")])


def manifest_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(spark, sf_dir)


def issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.summary(_manifest(spark, sf_dir))


def artifact_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda name, key: tables.read(spark, sf_dir, name).select(F.col(key).cast("long").alias("video_id"))
    parts = {"transcripts": ids("supplier", "s_nationkey"), "windows": ids("customer", "c_nationkey"), "ocr": ids("region", "r_regionkey")}
    return validate.artifact_problems(ids("nation", "n_nationkey"), parts, ("transcripts", "windows"))


def index_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, d = tables.vectors(spark, sf_dir), tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"))
    return validate.index_problems(v, d, 64)


def map_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.map_summary(tables.keyframes(spark, sf_dir))


def transcript_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.transcript(spark, sf_dir)
    t = t.withColumn("end", F.when(F.col("segment") % 5 == 0, F.col("start") - 1).otherwise(F.col("end"))).withColumn("start", F.when(F.col("segment") % 3 == 0, F.col("start") - 60).otherwise(F.col("start")))
    return validate.transcript_problems(t)


def submission_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.read(spark, sf_dir, "conversations")
    task = F.element_at(F.array(F.lit("KIS"), F.lit("QA"), F.lit("TRAKE")), (F.col("conv_id") % 3 + 1).cast("int"))
    rows = c.select(F.col("conv_id").alias("query_id"), task.alias("task"), F.col("turn").alias("rank"), (F.col("turn") % 2 + 1).alias("n_frames"), F.when(F.col("role") == "assistant", F.col("text")).alias("answer"))
    return validate.submission_problems(rows)


def record_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat_ws("|", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return validate.records_hash(tables.read(spark, sf_dir, "conversations"), "turn", value, "conv_id")


def normalize_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_ocr(F.col("text"))).alias("normal_md5"))


def eval_interval_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = tables.keyframes(spark, sf_dir)
    p = k.select(F.col("video_id").alias("query_id"), F.col("n").alias("rank"), "video_id", F.col("frame_idx").alias("frame"))
    t = k.where("n IN (3, 6, 10, 12)").groupBy("video_id", (F.col("n") > 6).alias("late")).agg(F.min("frame_idx").alias("start"), F.max("frame_idx").alias("end"))
    return evaluate.interval_hits(p, t.withColumn("query_id", F.col("video_id"))).select("query_id", F.col("rank").cast("long").alias("rank"), "score")


def eval_trake_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five predictions of three frames a video; the first is right, later ones ever less."""
    k = tables.keyframes(spark, sf_dir).withColumn("event", F.floor((F.col("n") - 1) / 10)).withColumn("rank", (F.col("n") - 1) % 10 + 1).where("event < 3")
    frames = F.transform(F.array_sort(F.collect_list(F.struct("event", "frame_idx"))), lambda x: x["frame_idx"])
    p = k.where("rank <= 5").groupBy("video_id", "rank").agg(frames.alias("frames")).withColumn("query_id", F.col("video_id"))
    t = k.where("rank <= event + 1").groupBy("video_id", "event").agg(F.min("frame_idx").alias("start"), F.max("frame_idx").alias("end")).withColumn("query_id", F.col("video_id"))
    return evaluate.ordered_hits(p, t).select("query_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def reviewed_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.col("lang").alias("video_id"), F.col("doc_id").alias("frame"), "n_chars")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "frame"))
    answers = d.withColumn("rank", rank).withColumn("score", 1 / F.col("rank")).drop("n_chars")
    good = tables.read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("frame"))
    reviewed = d.join(good, "frame").select("query_id", F.col("frame").alias("place"), "video_id", "frame")
    return tasks.reviewed_first(answers, reviewed).select("query_id", F.col("rank").cast("long").alias("rank"), "frame", F.round("score", 9).alias("score"), "reviewed")


def _qa_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.top(fusion.reciprocal_rank_fusion(hits(spark, sf_dir), WEIGHTS), 12)
    return tasks.qa_requests(fused.select("query_id", "candidate_id", "rank", F.round("score", 9).alias("score")))


def qa_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _qa_requests(spark, sf_dir).select("query_id", "candidate_id", "batch", "label", F.round("norm", 6).alias("norm"))


def qa_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers from stand-in replies, some of which are unanswerable or name a candidate that is not in the request."""
    r = _qa_requests(spark, sf_dir).withColumn("video_id", F.lit("v")).withColumn("frame", F.col("candidate_id"))
    q, b = F.col("query_id"), F.col("batch")
    replies = r.select("query_id", "batch").distinct().select(
        "query_id", "batch", F.format_string("C%02d", (q + b) % 5 + 1).alias("label"), ((q + b) % 4 != 0).alias("answerable"), F.lit("An answer.").alias("answer"), ((q * 7 + b * 3) % 10 / 10).alias("confidence")
    )
    out = tasks.qa_answers(r, replies, text.normalize_answer)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "candidate_id", F.round("score", 6).alias("score"))


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.read(spark, sf_dir, "conversations").select(tasks.cache_key(F.col("role"), F.col("turn")).alias("key"), "role")
    return tasks.cache_misses(c.select("key"), c.where("role = 'assistant'")).select("key")


def dedup_query_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.read(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return tasks.once_per_text(c).select("query_id", "leader", "reused")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events ingested as a stream, then counted per type in daily windows that start every half day."""
    path = f"{sf_dir}/event[s].parquet"  # a pattern, as the table can be one file
    out, seen = storage.new_path(spark, "events"), storage.new_path(spark, "seen")
    ingest.ingest_new(spark, path, tables.read(spark, sf_dir, "events").schema, out, seen)
    rows = spark.read.parquet(out).withColumn("at", F.col("ts").cast("timestamp"))
    w = ingest.window_counts(rows, "at", "1 day", "12 hours", keys=("event_type",))
    return w.select(F.unix_timestamp("start").alias("start_s"), "event_type", "n", F.round("total", 3).alias("total"))


def queries() -> dict[str, Query]:
    plain = (
        knn_batch_topk_per_query, rrf_fusion, video_aggregate, diversify, kis_topk, sliding_windows, window_transcript_overlap, window_mean_pool, nearest_keyframe, timeline_violations,
        nms_classwise, object_counts, manifest_outer_join, scope_hash, scope_diff, parse_queries, normalize_answer, eval_recall_at_k, eval_macro, submission_rows, json_props,
        hash_embed_search, variant_max_merge, trake_topk, ordered_viterbi, ordered_viterbi_penalty, dense_refine, window_word_midpoint, window_texts, nearest_frame_fallback, gallery_rows, manifest_issues,
        issue_summary, artifact_problems, index_problems, map_summary, transcript_problems, submission_violations, record_hashes, normalize_ocr, eval_interval_hits, eval_trake_partial,
        reviewed_override, qa_batches, qa_blend, cache_misses, dedup_query_reuse, stream_windows,
    )
    out: dict[str, Query] = {f"knn_{m}": _knn(m) for m in vectors.SCORES}
    out |= {"weighted_fusion_minmax": _weighted("minmax"), "weighted_fusion_rank": _weighted("rank")}
    out |= {"ordered_alignment": _align(None, 0.0), "ordered_alignment_gap": _align(5 * DAY, 0.0), "ordered_alignment_penalty": _align(None, 0.5)}
    return out | {f.__name__: f for f in plain} | assembly.QUERIES | formats.QUERIES | stores.QUERIES | boundary.QUERIES | searches.QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES | assembly.SOURCES | formats.SOURCES | stores.SOURCES | boundary.SOURCES | searches.SOURCES
