"""Queries over whole searches and over windows by the whole rule, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators import embed, evaluate, heads, search, tasks, windows
from ..sources import tables
from . import oracles

TEXT_DIM, DEPTH = 256, 50


def _field(spark: SparkSession, rows: DataFrame, name: str, weight: float) -> heads.Field:
    """A text index over (doc_id, text), embedded once."""
    embedded = lambda d, key: embed.hash_embed(d, key, "text", dim=TEXT_DIM, place=embed.md5_place)
    index = storage.stored(embedded(rows, "doc_id"), "field")
    return heads.Field(name, lambda texts, k: search.knn_batch(index, embedded(texts, "vec_id"), k).withColumnRenamed("vec_id", "candidate_id"), weight, DEPTH)


def _setting(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[heads.Field], DataFrame]:
    """Benchmark texts, some of which ask for a logo, and two fields: whole documents and their beginnings. A source is a video
    of fifty frames."""
    b, d = tables.read(spark, sf_dir, "benchmark"), tables.read(spark, sf_dir, "documents")
    queries = b.select(F.col("item_id").alias("query_id"), F.concat("text", F.when(F.col("item_id") % 2 == 0, " Logo?").otherwise("")).alias("text"))
    fields = [_field(spark, d.select("doc_id", "text"), "asr", 0.8), _field(spark, d.select("doc_id", F.substring("text", 1, 300).alias("text")), "ocr", 0.5)]
    places = d.select(F.col("doc_id").alias("candidate_id"), F.substring("source", 4, 9).cast("long").alias("video_id"), (F.col("doc_id") % 50).alias("frame"), (F.col("doc_id") % 50).cast("double").alias("ts"))
    return queries, fields, places


REWRITES = {"paraphrases": [lambda x: F.regexp_replace(x, r"^\s*\S+\s+", "")]}


def engine_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, fields, places = _setting(spark, sf_dir)
    found, _ = heads.search(queries, fields, places.withColumn("ts", F.lit(None).cast("double")), limit=20, **REWRITES)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "candidate_id", "video_id", F.round("score", 9).alias("score"))


def engine_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, fields, places = _setting(spark, sf_dir)
    return heads.search(queries, fields, places, limit=20, **REWRITES)[1]


def known_item_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To frames, the best three of each query refined among the frames within two seconds."""
    queries, fields, places = _setting(spark, sf_dir)
    options = heads.Options(pool=200, top_k=30, temporal=0.0, refine_top=3, rewrites=REWRITES)
    frames = places.select("video_id", "frame", "ts").distinct()
    found = heads.known_items(queries, fields, places, options, frames=frames, semantic=F.col("frame") * 7 % 11 / 11.0)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "video_id", "frame", F.round("score", 9).alias("score"), "refined")


def temporal_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows every half day, empty ones too, of videos that partly last longer than their keyframes say."""
    k = tables.keyframes(spark, sf_dir).withColumn("fps", F.lit(tables.FPS))
    durations = k.select("video_id").distinct().where("video_id % 3 > 0").select("video_id", F.when(F.col("video_id") % 3 == 1, 3_000_000.0).otherwise(1.0).alias("duration"))
    w = windows.temporal_windows(k, 86_400.0, 43_200.0, durations=durations, include_empty=True)
    return w.select(
        "window_id", "video_id", F.round("end", 6).alias("end"), "start_frame", "end_frame", "representative_keyframe_uid", "frame_idx", F.size("keyframe_uids").cast("long").alias("n_keyframes"),
        F.when(F.size("keyframe_uids") > 0, F.get("keyframe_uids", F.lit(0))).alias("first_uid"),
    )


def window_aligned_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts in which every other segment has timed words."""
    t = tables.transcript(spark, sf_dir)
    word = F.struct("i", F.struct(F.col("word").alias("text"), F.col("w_start").alias("start"), F.col("w_end").alias("end")).alias("w"))
    words = windows.timed_words(t.where("segment % 2 = 0")).groupBy("video_id", "segment").agg(F.transform(F.array_sort(F.collect_list(word)), lambda x: x["w"]).alias("words"))
    s = t.join(words, ["video_id", "segment"], "left").withColumn("position", F.col("segment")).withColumn("segment_id", F.col("segment"))
    g = windows.grid(t.groupBy("video_id").agg(F.max("end").alias("duration")), 10.0, 5.0)
    w = windows.aligned_text(g, s, 10.0, 5.0)
    return w.select("video_id", "k", F.md5("asr_text").alias("text_md5"), F.array_join(F.col("asr_segment_ids").cast("array<string>"), ",").alias("segments"))


def trake_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyframes as candidates of three events, their paths refined among keyframes within half a day and aligned again."""
    k = tables.keyframes(spark, sf_dir)
    event = F.when(F.col("label") == "click", 0).when(F.col("label") == "purchase", 1).when(F.col("label") == "view", 2)
    c = k.select(F.lit(0).cast("long").alias("query_id"), "video_id", event.alias("event"), F.floor("pts_time").cast("double").alias("ts"), F.col("frame_idx").alias("frame"), "score").where("event IS NOT NULL")
    whole = k.groupBy("video_id").agg(F.max("score").alias("score")).select(F.lit(0).cast("long").alias("query_id"), "video_id", "score")
    frames = k.select("video_id", F.col("frame_idx").alias("frame"), F.col("pts_time").alias("ts"), "n")
    found = tasks.trake(c, whole, 3, frames=frames, semantics=[F.col("n") * (e + 2) % 7 / 7.0 for e in range(3)], radius=43_200.0)
    return found.select(F.col("rank").cast("long").alias("rank"), "video_id", F.round("score", 6).alias("score"), F.size("frames").cast("long").alias("n_frames"))


def ordered_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first frame of each label in every video, in time, as lines of a submission; a video is a query."""
    k = tables.keyframes(spark, sf_dir)
    first = k.groupBy("video_id", "label").agg(F.min(F.struct("n", "frame_idx")).alias("f"))
    frames = F.transform(F.array_sort(F.collect_list("f")), lambda x: x["frame_idx"])
    answers = first.groupBy("video_id").agg(frames.alias("frames")).select(F.col("video_id").alias("query_id"), F.lit(1).alias("rank"), "video_id", "frames")
    return evaluate.ordered_lines(answers).select("query_id", F.col("rank").cast("long").alias("rank"), "line")


QUERIES = {f.__name__: f for f in (ordered_submission, trake_refined, engine_search, engine_source_counts, known_item_search, temporal_windows, window_aligned_text)}

_FOUND = oracles.VARIANTS.replace(oracles.ITEMS, "SELECT item_id AS id, text || CASE WHEN item_id % 2 = 0 THEN ' Logo?' ELSE '' END AS text FROM benchmark") + f""",
held AS (
  SELECT 'asr' AS m, doc_id, text FROM documents UNION ALL SELECT 'ocr', doc_id, substring(text, 1, 300) FROM documents
), bag AS (
  SELECT 'd' || m AS side, CAST(doc_id AS VARCHAR) AS id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS t FROM held
  UNION ALL SELECT 'q', query_id || '/' || i, unnest(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+')) FROM variants
), part AS (
  SELECT side, id, CAST('0x' || md5(t)[1:8] AS BIGINT) % 256 AS b, sum(CASE WHEN CAST('0x' || md5(t)[9:9] AS BIGINT) % 2 = 1 THEN 1 ELSE -1 END) AS x FROM bag GROUP BY ALL
), unit AS (
  SELECT side, id, b, x / nullif(sqrt(sum(x * x) OVER (PARTITION BY side, id)), 0) AS x FROM part
), dots AS (
  SELECT q.id AS v, d.side, d.id AS doc, round(sum(q.x * d.x), 9) AS score FROM unit q JOIN unit d ON q.side = 'q' AND d.side <> 'q' AND q.b = d.b GROUP BY ALL
), hits AS (
  SELECT v.query_id, v.i, v.w, h.m, h.doc_id, coalesce(d.score, 0) AS score,
    row_number() OVER (PARTITION BY v.query_id, v.i, h.m ORDER BY coalesce(d.score, 0) DESC, h.doc_id) AS r
  FROM variants v CROSS JOIN held h LEFT JOIN dots d ON d.v = v.query_id || '/' || v.i AND d.side = 'd' || h.m AND d.doc = CAST(h.doc_id AS VARCHAR)
  QUALIFY r <= {DEPTH}
), base AS (
  SELECT query_id, m, CASE m WHEN 'asr' THEN 0.8::DOUBLE ELSE CASE WHEN query_id % 2 = 0 THEN 0.5::DOUBLE * 2 ELSE 0.5::DOUBLE END END AS weight FROM (SELECT DISTINCT query_id, m FROM hits)
), merged AS (
  SELECT query_id, m, doc_id, max(score * w) AS score FROM hits GROUP BY ALL
), place AS (
  SELECT doc_id, CAST(substring(source, 4) AS BIGINT) AS video, doc_id % 50 AS frame FROM documents
)"""
_KEYFRAMES = """k AS (
  SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, (epoch_us(ts) - 1704067200000000) / 1e6 AS pts FROM events
)"""
SOURCES = {
    "ordered_submission": """WITH k AS (
  SELECT user_id AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type AS label, CAST(floor((epoch_us(ts) - 1704067200000000) / 1e6 * 25) AS BIGINT) AS frame FROM events
), f AS (
  SELECT v, label, min(n) AS n, arg_min(frame, n) AS frame FROM k GROUP BY v, label
)
SELECT v AS query_id, 1::BIGINT AS rank, v || ',' || string_agg(CAST(frame AS VARCHAR), ',' ORDER BY n) AS line FROM f GROUP BY v""",
    "trake_refined": """WITH k AS (
  SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, (epoch_us(ts) - 1704067200000000) / 1e6 AS pts, event_type AS label, value AS score,
    CAST(floor((epoch_us(ts) - 1704067200000000) / 1e6 * 25) AS BIGINT) AS frame FROM events
), c AS (
  SELECT *, CASE label WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 END AS e, floor(pts) AS near_at FROM k WHERE label IN ('click', 'purchase', 'view')
), best AS (
  SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY video_id, e ORDER BY score DESC, near_at, frame) <= 30
), whole AS (
  SELECT video_id, max(score) AS whole, row_number() OVER (ORDER BY max(score) DESC, video_id) AS place FROM k GROUP BY video_id
), able AS (
  SELECT video_id, whole, place <= 100 AS top FROM (SELECT video_id FROM best GROUP BY video_id HAVING count(DISTINCT e) = 3) JOIN whole USING (video_id)
), chosen AS (
  SELECT * FROM able WHERE top OR NOT (SELECT bool_or(top) FROM able)
), coarse AS (
  SELECT a.video_id, arg_max([{'t': a.near_at, 's': a.score}, {'t': b.near_at, 's': b.score}, {'t': c.near_at, 's': c.score}], a.score + b.score + c.score) AS p
  FROM best a JOIN best b ON a.video_id = b.video_id AND b.near_at >= a.near_at JOIN best c ON c.video_id = b.video_id AND c.near_at >= b.near_at
  WHERE a.e = 0 AND b.e = 1 AND c.e = 2 AND a.video_id IN (SELECT video_id FROM chosen) GROUP BY a.video_id
), events3 AS (
  SELECT video_id, unnest([0, 1, 2]) AS e, unnest(p) AS p FROM coarse
), fine AS (
  SELECT x.video_id, x.e, k.frame, k.pts, 0.2 * x.p.s + 0.8 * (k.n * (x.e + 2) % 7 / 7.0::DOUBLE) AS score
  FROM events3 x JOIN k ON k.video_id = x.video_id AND abs(k.pts - x.p.t) <= 43200
  QUALIFY row_number() OVER (PARTITION BY x.video_id, x.e ORDER BY k.n * (x.e + 2) % 7 DESC, k.frame) <= 5
), again AS (
  SELECT a.video_id, max(a.score + b.score + c.score) / 3 AS s FROM fine a JOIN fine b ON a.video_id = b.video_id AND b.pts > a.pts JOIN fine c ON c.video_id = b.video_id AND c.pts > b.pts
  WHERE a.e = 0 AND b.e = 1 AND c.e = 2 GROUP BY a.video_id
), scored AS (
  SELECT video_id, s + 0.2 * whole AS score FROM again JOIN chosen USING (video_id)
)
SELECT row_number() OVER (ORDER BY score DESC, video_id) AS rank, video_id, round(score, 6) AS score, 3::BIGINT AS n_frames FROM scored QUALIFY rank <= 100""",
    "engine_search": f"""{_FOUND}, fused AS (
  SELECT query_id, doc_id, sum(weight / (60 + r)) AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, m ORDER BY score DESC, doc_id) AS r FROM merged) JOIN base USING (query_id, m) GROUP BY query_id, doc_id
), u AS (
  SELECT *, coalesce((score - min(score) OVER p) / nullif(max(score) OVER p - min(score) OVER p, 0), 1)
    - 0.08::DOUBLE * (row_number() OVER (PARTITION BY query_id, video ORDER BY score DESC, doc_id DESC) - 1) AS utility
  FROM fused JOIN place USING (doc_id) WINDOW p AS (PARTITION BY query_id)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY utility DESC, score DESC, doc_id DESC) AS rank, doc_id AS candidate_id, video AS video_id, round(score, 9) AS score FROM u QUALIFY rank <= 20""",
    "engine_source_counts": f"{_FOUND} SELECT query_id, m AS source, count(*) AS n FROM merged GROUP BY ALL",
    "known_item_search": f"""{_FOUND}, fused AS (
  SELECT h.query_id, doc_id, round(sum(b.weight * h.w / (60 + h.r)), 12) AS score FROM hits h JOIN base b ON b.query_id = h.query_id AND b.m = h.m GROUP BY h.query_id, doc_id
), pool AS (
  SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 200
), u AS (
  SELECT *, coalesce((score - min(score) OVER p) / nullif(max(score) OVER p - min(score) OVER p, 0), 1)
    - 0.05::DOUBLE * (row_number() OVER (PARTITION BY query_id, video ORDER BY score DESC, doc_id DESC) - 1) AS utility
  FROM pool JOIN place USING (doc_id) WINDOW p AS (PARTITION BY query_id)
), c AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY utility DESC, score DESC, doc_id DESC) AS rank FROM u
), near AS (
  SELECT c.query_id, c.video, f.frame, 0.2 * c.score + 0.8 * ((f.frame * 7 % 11) / 11.0::DOUBLE) AS score,
    row_number() OVER (PARTITION BY c.query_id, c.doc_id ORDER BY f.frame * 7 % 11 DESC, f.frame) AS r
  FROM c JOIN (SELECT DISTINCT video, frame FROM place) f ON f.video = c.video AND abs(f.frame - c.frame) <= 2 WHERE c.rank <= 3
), both_kinds AS (
  SELECT query_id, video, frame, max(score) AS score, true AS refined FROM near WHERE r <= 5 GROUP BY ALL
  UNION ALL SELECT query_id, video, frame, score, false FROM c WHERE rank > 3
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, video, frame ORDER BY score DESC) AS again FROM both_kinds
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video, frame) AS rank, video AS video_id, frame, round(score, 9) AS score, refined FROM placed WHERE again = 1 QUALIFY rank <= 30""",
    "temporal_windows": f"""WITH {_KEYFRAMES}, span AS (
  SELECT video_id, greatest(max(pts) + 1 / 25.0::DOUBLE, CASE video_id % 3 WHEN 1 THEN 3000000.0::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 0 END) AS duration FROM k GROUP BY video_id
), w AS (
  SELECT video_id, i, i * 43200.0::DOUBLE AS a, least(i * 43200.0::DOUBLE + 86400, duration) AS z FROM (SELECT *, unnest(range(0, CAST(ceil(duration / 43200) AS BIGINT))) AS i FROM span)
), m AS (
  SELECT w.video_id, w.i, w.a, w.z, count(k.n) AS c, min(k.n) AS first, arg_min(k.n, (abs(k.pts - (w.a + w.z) / 2), k.n)) AS mid, arg_min(k.pts, (abs(k.pts - (w.a + w.z) / 2), k.n)) AS mid_pts
  FROM w LEFT JOIN k ON k.video_id = w.video_id AND k.pts >= w.a AND k.pts < w.z GROUP BY ALL
)
SELECT printf('%d_W%06d', video_id, i) AS window_id, video_id, round(z, 6) AS end, CAST(floor(a * 25) AS BIGINT) AS start_frame, CAST(ceil(z * 25) - 1 AS BIGINT) AS end_frame,
  CASE WHEN c > 0 THEN printf('%d_K%06d', video_id, mid) END AS representative_keyframe_uid, CASE WHEN c > 0 THEN CAST(floor(mid_pts * 25) AS BIGINT) END AS frame_idx, c AS n_keyframes,
  CASE WHEN c > 0 THEN printf('%d_K%06d', video_id, first) END AS first_uid
FROM m""",
    "window_aligned_text": rf"""WITH t AS ({oracles.TRANSCRIPT}), d AS (
  SELECT video_id, max(s + len) AS duration FROM t GROUP BY video_id
), g AS (
  SELECT video_id, i AS k, i * 5.0::DOUBLE AS a, least(i * 5.0::DOUBLE + 10, duration) AS z FROM d, unnest(range(CAST(ceil(duration / 5) AS BIGINT))) AS u(i)
), w AS (
  SELECT video_id, segment, s, s + len AS e, unnest(regexp_split_to_array(text, '\s+')) AS word, generate_subscripts(regexp_split_to_array(text, '\s+'), 1) AS i FROM t WHERE segment % 2 = 0
), b AS (
  SELECT *, coalesce(sum(length(word)) OVER (PARTITION BY video_id, segment ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(length(word)) OVER (PARTITION BY video_id, segment) AS chars FROM w
), m AS (
  SELECT *, ((s + before::DOUBLE * ((e - s) / chars::DOUBLE)) + (s + (before + length(word))::DOUBLE * ((e - s) / chars::DOUBLE))) / 2 AS mid FROM b WHERE word <> ''
), said AS (
  SELECT g.video_id, g.k, segment, i, word AS text FROM g JOIN m ON m.video_id = g.video_id AND mid >= a AND mid < z
  UNION ALL SELECT g.video_id, g.k, segment, 0, trim(text) FROM g JOIN t ON t.video_id = g.video_id
  WHERE (segment % 2 = 1 OR trim(text) = '') AND least(z, s + len) - greatest(a, s) > 0 AND (least(z, s + len) - greatest(a, s)) / greatest(1e-9, (s + len) - s) >= 0.2
)
SELECT video_id, k, md5(coalesce(string_agg(text, ' ' ORDER BY segment, i) FILTER (text <> ''), '')) AS text_md5, string_agg(DISTINCT segment, ',' ORDER BY segment) AS segments FROM said GROUP BY video_id, k""",
}
