"""Queries over what the engine writes and reads again: vector shards, JSON lines, indexes and batch runs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .. import storage
from ..operators import artifact_graph as graph
from ..operators import embed, index_build, search, windows
from ..sources import files, shards, tables
from ..streaming import ingest
from . import batch

DAY = 86_400.0
TEXT_DIM = 256


def _shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.read(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    row = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(F.concat(F.lit("l"), F.col("label").cast("string")).alias("name"), row.cast("long").alias("row"), F.col("embedding").alias("v"))


def vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as matrices of 64 rows a label and read again by ranges of rows."""
    path = storage.new_path(spark, "shards")
    shards.write_shards(_shard_rows(spark, sf_dir), path, shard_rows=64).count()
    rows = shards.vector_shards(spark, path, range_bytes=4096)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    name, number = F.split_part("video_id", F.lit("_"), F.lit(1)), F.split_part("video_id", F.lit("_"), F.lit(2)).cast("long")
    return rows.select(F.lower(name).alias("name"), (number * 64 + F.col("row")).alias("row"), F.size("embedding").cast("long").alias("width"), F.round(total, 4).alias("total"))


def vector_shard_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of which those of one label are narrower."""
    path = storage.new_path(spark, "shards")
    rows = _shard_rows(spark, sf_dir).withColumn("v", F.when(F.col("name") == "l3", F.slice("v", 1, 8)).otherwise(F.col("v")))
    shards.write_shards(rows, path, shard_rows=64).count()
    found = shards.shard_issues(shards.headers(spark, path))
    return found.select(F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("shard"), "code")


def jsonl_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines, some cut short, of the wrong type, without a key, or twice."""
    e = tables.read(spark, sf_dir, "events")
    key = F.when(F.col("event_id") % 13 == 0, " ").otherwise(F.concat(F.lit("w"), (F.col("event_id") - F.col("event_id") % 7 % 2).cast("string")))
    video = F.when(F.col("event_id") % 17 == 0, '"x"').otherwise(F.col("user_id").cast("string"))
    line = F.concat(F.lit('{"window_id":"'), key, F.lit('","video":'), video, F.lit(',"label":"'), "event_type", F.lit('"}'))
    line = F.when(F.col("event_id") % 11 == 0, F.substring(line, 1, 20)).when(F.col("event_id") % 19 == 0, "[1]").otherwise(line)
    path = storage.new_path(spark, "lines")
    e.select(line.alias("value")).write.text(path)
    schema = StructType([StructField("window_id", StringType()), StructField("video", LongType()), StructField("label", StringType())])
    return files.line_counts(files.jsonl(spark, path, schema, required=["window_id"]), "video", "window_id")


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows of each video's keyframes, every half day, with their uids and texts."""
    k = tables.keyframes(spark, sf_dir)
    span = k.groupBy("video_id").agg((F.max("pts_time") + 1 / tables.FPS).alias("duration"))
    held = windows.place(k, "pts_time", DAY, DAY / 2).join(windows.grid(span, DAY, DAY / 2), ["video_id", "k"]).where("pts_time >= start AND pts_time < end")
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("n", F.col(c).alias("x")))), lambda x: x["x"])
    w = held.groupBy("video_id", "k", F.col("start").alias("start_time"), F.col("end").alias("end_time")).agg(in_order("keyframe_uid").alias("keyframe_uids"), F.array_sort(F.collect_set("label")).alias("object_labels"), in_order("label").alias("spoken"))
    asr = F.when(F.col("k") % 3 > 0, F.concat(F.lit(" "), F.array_join("spoken", " "))).otherwise(F.lit("  "))
    texts = {"asr_text": asr, "ocr_text": F.lit(None).cast("string"), "metadata_text": F.concat(F.lit("video "), F.col("video_id").cast("string"))}
    return w.withColumns(texts).withColumn("window_id", F.format_string("%d_W%06d", "video_id", "k")).drop("spoken", "k")


def visual_window_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled vectors of the windows written as an index, opened, and each window's keyframe; an event has the vector whose id
    is its own modulo their number."""
    k, v = tables.keyframes(spark, sf_dir), tables.read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    n = v.agg(F.count(F.lit(1)).alias("c"), F.max(F.size("v")).alias("d")).first()
    features = k.join(v.select("vec_id", "v"), F.col("event_id") % F.lit(n["c"]) == F.col("vec_id")).select("video_id", (F.col("n") - 1).cast("long").alias("row"), "v")
    made = index_build.visual_windows(_windows(spark, sf_dir), features, k.select("video_id", "n", "frame_idx", "pts_time", F.lit(tables.FPS).alias("fps")), dim=n["d"])
    path, made_from = storage.new_path(spark, "index"), {"encoder": "stored"}
    index_build.write(made, path, made_from)
    return index_build.opened(spark, path, made_from).select("window_id", "video_id", "representative_keyframe_uid", "frame_idx", F.round(F.get("v", F.lit(0)), 4).alias("x0"), F.round(F.get("v", F.lit(1)), 4).alias("x1"))


def _text_index(spark: SparkSession, sf_dir: str) -> tuple[str, dict[str, str]]:
    w = _windows(spark, sf_dir)
    path = storage.new_path(spark, "index")
    # as signed tokens "video" and "769" cancel, and no search would find that text
    made_from = {"encoder": "hash", "window_records_hash": index_build.records_hash(w).first()["records_hash"]}
    index_build.build_text_index(w, path, lambda rows, key, text: embed.hash_embed(rows, key, text, dim=TEXT_DIM, place=embed.md5_place, never_zero=True), made_from)
    return path, made_from


def text_window_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the windows, an index for each modality, and the length of each vector."""
    path, made_from = _text_index(spark, sf_dir)
    rows = index_build.opened(spark, path, made_from, by=["modality"])
    return rows.select("modality", "window_id", F.md5("text").alias("text_md5"), "source_field", F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 3).alias("norm"))


def stale_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the same indexes when other windows are asked for."""
    path, made_from = _text_index(spark, sf_dir)
    return index_build.problems(spark, path, made_from | {"window_records_hash": "other"}, by=["modality"])


def records_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.read(spark, sf_dir, "customer").select("c_name", "c_custkey", F.struct(F.col("c_nationkey").alias("z"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("a")).alias("at"), "c_acctbal")
    return index_build.records_hash(c, leave_out=["c_acctbal"])


def batch_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as query files, searched among the documents, and the manifest of the run; the run before had more
    queries, whose folders go."""
    b = tables.read(spark, sf_dir, "benchmark")
    index = storage.stored(embed.hash_embed(tables.read(spark, sf_dir, "documents"), "doc_id", "text", dim=TEXT_DIM, place=embed.md5_place), "index")
    queries = b.select(F.concat(F.lit("query-p1-"), F.col("item_id"), F.lit("-kis")).alias("stem"), F.when(F.col("item_id") % 10 == 1, "the same text").otherwise(F.col("text")).alias("text"))

    def answer(texts: DataFrame) -> DataFrame:
        asked = embed.hash_embed(texts, "text_id", "text", dim=TEXT_DIM, place=embed.md5_place)
        found = search.knn_batch(index, asked, 20)
        return found.select(F.col("query_id").alias("text_id"), "rank", F.lit("v").alias("video_id"), F.col("vec_id").alias("frame"), "score")

    path = storage.new_path(spark, "run")
    more = queries.unionByName(queries.orderBy("stem").limit(1).withColumn("stem", F.lit("query-p1-999999-kis")))
    batch.run(more, answer, path, limit=5)
    made = batch.run(queries, answer, path, limit=5)
    stored = spark.read.json(f"{path}/results").groupBy("query_id").agg(F.count(F.lit(1)).alias("stored"))
    rows = made.join(stored, "query_id", "full")
    return rows.select(
        "query_id", "submission", "predictions", "stored", F.col("top.frame").alias("top"), F.round("top.score", 6).alias("score"), "repeats_text", "queries", "searches", F.array_join("removed", ",").alias("removed")
    )


def ingest_without_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events taken in by the day they happened on, then all again with the checkpoint lost: the first row of each key stays."""
    out = storage.new_path(spark, "events")
    schema, by_user = tables.read(spark, sf_dir, "events").schema, lambda d: d.withColumn("day", F.to_date("ts"))
    for _ in range(2):
        ingest.ingest_missing(spark, f"{sf_dir}/event[s].parquet", schema, out, storage.new_path(spark, "seen"), ["event_id"], by_user)
    rows = spark.read.parquet(out)
    return rows.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_events"), F.round(F.sum("value"), 3).alias("total"))


def artifact_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a scope of videos, and artifacts of which some are missing, wrong, elsewhere or stale."""
    s = tables.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("video_id"))
    one = spark.range(1)
    found = s.where("video_id % 5 > 0").select(F.col("video_id").alias("file_video"), F.when(F.col("video_id") % 7 == 0, F.col("video_id") + 1_000_000).otherwise(F.col("video_id")).alias("video_id"), F.when(F.col("video_id") % 11 == 0, "not_json").alias("code"))
    ocr = s.where("video_id % 4 > 0").select(F.col("video_id").alias("file_video"), "video_id", F.lit(None).cast("string").alias("code"))
    rows = s.select("video_id", F.explode(F.sequence(F.lit(1), (F.col("video_id") % 3 + 1).cast("int"))).alias("k"))
    records = rows.select(F.concat_ws("_", F.col("video_id").cast("string"), F.col("k").cast("string")).alias("window_id"), "video_id").unionByName(one.select(F.lit("1_1").alias("window_id"), F.lit(-1).cast("long").alias("video_id")))
    stated = one.select(F.lit("h").alias("records_hash"), F.lit(3).alias("rows"))
    seen = one.select(F.lit("other").alias("records_hash"), F.lit(3).alias("rows"))
    names = F.when(F.col("id") == 0, "visual_keyframes").when(F.col("id") == 1, "visual_windows").otherwise("asr_windows")
    indexes = spark.range(3).select(names.alias("name"), F.when(F.col("id") == 2, "../x.npy").otherwise(F.concat(names, F.lit(".npy"))).alias("path"), F.lit(64).alias("dimension"))
    probed = indexes.where("name <> 'asr_windows'").select("name", F.when(F.col("name") == "visual_windows", 99).otherwise(64).alias("dimension"))
    inventory = spark.createDataFrame([("indexes/visual_keyframes.npy",), ("indexes/visual_keyframes.manifest.json",), ("indexes/old.npy",), ("captions/a.jsonl",)], "path string")
    return graph.report(
        graph.scope_issues(s), graph.same_videos(s.where("video_id % 9 > 0"), s, "dataset_manifest"), graph.per_video_files(found, s, "transcript"),
        graph.per_video_files(ocr, s, "ocr", severity=graph.WARNING), graph.row_counts(rows.where("NOT (video_id % 13 = 0 AND k = 1)"), s.select("video_id", (F.col("video_id") % 3 + 1).alias("n")), "timeline"),
        graph.rows_in_scope(records, s, "window_id", "window"), graph.stated_values(stated, seen, "window", ["records_hash", "rows"]), graph.stated_values(indexes, probed, "index", ["dimension"], "name"),
        graph.index_paths(indexes, inventory, "indexes"), graph.required_indexes(indexes), graph.forbidden(inventory),
    )


QUERIES = {f.__name__: f for f in (ingest_without_checkpoint, artifact_issues, vector_shards, vector_shard_issues, jsonl_counts, visual_window_index, text_window_indexes, stale_indexes, records_hash, batch_manifest)}

_WINDOWS = """k AS (
  SELECT user_id AS video_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, (epoch_us(ts) - 1704067200000000) / 1e6 AS pts, event_type AS label FROM events
), span AS (
  SELECT video_id, max(pts) + 1 / 25.0::DOUBLE AS duration FROM k GROUP BY video_id
), grid AS (
  SELECT video_id, w, w * 43200.0::DOUBLE AS a, least(w * 43200.0::DOUBLE + 86400, duration) AS z FROM (SELECT *, unnest(range(0, CAST(ceil(duration / 43200) AS BIGINT))) AS w FROM span)
), member AS (
  SELECT g.video_id, g.w, printf('%d_W%06d', g.video_id, g.w) AS window_id, k.n, k.event_id, k.label, k.pts FROM grid g JOIN k ON k.video_id = g.video_id AND k.pts >= g.a AND k.pts < g.z
)"""
_TEXTS = f"""WITH {_WINDOWS}, texts AS (
  SELECT 'asr' AS modality, window_id, string_agg(label, ' ' ORDER BY n) AS text, 'asr_text' AS source_field FROM member WHERE w % 3 > 0 GROUP BY window_id
  UNION ALL SELECT 'objects', window_id, string_agg(DISTINCT label, ', ' ORDER BY label), 'object_labels' FROM member GROUP BY window_id
  UNION ALL SELECT 'metadata', window_id, 'video ' || any_value(video_id), 'metadata_text' FROM member GROUP BY window_id
)"""
_EMBEDDED = """asked AS (
  SELECT DISTINCT CASE WHEN item_id % 10 = 1 THEN 'the same text' ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS text FROM benchmark
), bag AS (
  SELECT 'd' AS side, CAST(doc_id AS VARCHAR) AS id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS t FROM documents
  UNION ALL SELECT 'q', text, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) FROM asked
), part AS (
  SELECT side, id, CAST('0x' || md5(t)[1:8] AS BIGINT) % 256 AS b, sum(CASE WHEN CAST('0x' || md5(t)[9:9] AS BIGINT) % 2 = 1 THEN 1 ELSE -1 END) AS x FROM bag GROUP BY ALL
), unit AS (
  SELECT side, id, b, x / sqrt(sum(x * x) OVER (PARTITION BY side, id)) AS x FROM part
), dots AS (
  SELECT q.id AS text, d.id AS doc, round(sum(q.x * d.x), 9) AS score FROM unit q JOIN unit d ON q.side = 'q' AND d.side = 'd' AND q.b = d.b GROUP BY ALL
), best AS (
  SELECT a.text, CAST(c.doc_id AS BIGINT) AS frame, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY a.text ORDER BY coalesce(score, 0) DESC, c.doc_id) AS rank
  FROM asked a CROSS JOIN documents c LEFT JOIN dots ON dots.text = a.text AND dots.doc = CAST(c.doc_id AS VARCHAR)
)"""
SOURCES = {
    "ingest_without_checkpoint": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT event_id) AS n_events, round(sum(value), 3) AS total FROM events GROUP BY 1",
    "artifact_issues": """WITH s AS (
  SELECT CAST(s_suppkey AS BIGINT) AS v FROM supplier
)
SELECT 'error' AS severity, 'dataset_manifest_scope_mismatch' AS code, CAST(v AS VARCHAR) AS subject, 'missing' AS detail FROM s WHERE v % 9 = 0
UNION ALL SELECT 'error', CASE WHEN v % 5 = 0 THEN 'missing_transcript' WHEN v % 11 = 0 THEN 'invalid_transcript' ELSE 'transcript_video_id_mismatch' END, CAST(v AS VARCHAR),
  CASE WHEN v % 5 = 0 THEN '' WHEN v % 11 = 0 THEN 'not_json' ELSE CAST(v + 1000000 AS VARCHAR) END FROM s WHERE v % 5 = 0 OR v % 7 = 0 OR v % 11 = 0
UNION ALL SELECT 'warning', 'missing_ocr', CAST(v AS VARCHAR), '' FROM s WHERE v % 4 = 0
UNION ALL SELECT 'error', 'timeline_count_mismatch', CAST(v AS VARCHAR), v % 3 || '/' || (v % 3 + 1) FROM s WHERE v % 13 = 0
UNION ALL SELECT * FROM (VALUES
  ('error', 'window_row_scope_mismatch', '1_1', '-1'), ('error', 'duplicate_window_window_id', '1_1', '2'), ('error', 'window_records_hash_mismatch', 'window', 'other/h'),
  ('error', 'missing_index', 'asr_windows', ''), ('error', 'index_dimension_mismatch', 'visual_windows', '99/64'), ('error', 'index_path_escape', 'asr_windows', '../x.npy'),
  ('error', 'missing_index_vectors', 'visual_windows', 'visual_windows.npy'), ('error', 'orphan_index_file', 'indexes/old.npy', ''), ('error', 'missing_required_index', 'objects_windows', ''),
  ('error', 'caption_artifacts_forbidden', 'captions/a.jsonl', ''))""",
    "vector_shards": """SELECT 'l' || label AS name, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row, len(embedding) AS width,
  round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings""",
    "vector_shard_issues": """SELECT DISTINCT 'l3_' || (row_number() OVER (ORDER BY vec_id) - 1) // 64 AS shard, 'other_width' AS code FROM embeddings WHERE label = 3""",
    "jsonl_counts": """WITH e AS (
  SELECT CASE WHEN event_id % 11 = 0 THEN 'not_json' WHEN event_id % 19 = 0 THEN 'not_an_object' WHEN event_id % 17 = 0 THEN 'bad_field' WHEN event_id % 13 = 0 THEN 'no_window_id' END AS code,
    user_id, event_id - event_id % 7 % 2 AS key FROM events
)
SELECT CASE WHEN code IS NULL THEN user_id END AS video, code, count(*) AS n, count(DISTINCT CASE WHEN code IS NULL THEN key END) AS n_keys FROM e GROUP BY 1, 2""",
    "visual_window_index": f"""WITH {_WINDOWS}, v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), own AS (
  SELECT m.*, v.v FROM member m JOIN v ON v.vec_id = m.event_id % (SELECT count(*) FROM embeddings)
), cells AS (
  SELECT window_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM own
), means AS (
  SELECT window_id, i, avg(x) AS x FROM cells GROUP BY window_id, i
), pooled AS (
  SELECT window_id, list(x / greatest(1e-12, n) ORDER BY i) AS p FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY window_id)) AS n FROM means) GROUP BY window_id
), placed AS (
  SELECT o.*, p.p, row_number() OVER (PARTITION BY o.window_id ORDER BY round(list_inner_product(o.v, p.p), 9) DESC, o.n) AS place FROM own o JOIN pooled p USING (window_id)
)
SELECT window_id, video_id, printf('%d_K%06d', video_id, n) AS representative_keyframe_uid, CAST(floor(pts * 25) AS BIGINT) AS frame_idx, round(CAST(CAST(p[1] AS FLOAT) AS DOUBLE), 4) AS x0, round(CAST(CAST(p[2] AS FLOAT) AS DOUBLE), 4) AS x1 FROM placed WHERE place = 1""",
    "text_window_indexes": f"{_TEXTS} SELECT modality, window_id, md5(text) AS text_md5, source_field, 1.0::DOUBLE AS norm FROM texts",
    "stale_indexes": f"{_TEXTS} SELECT DISTINCT modality, 'other_window_records_hash' AS code FROM texts",
    "records_hash": """WITH d AS (
  SELECT sha256('{"at":{"a":' || CASE WHEN c_mktsegment = 'BUILDING' THEN 'null' ELSE '"' || c_mktsegment || '"' END || ',"z":' || c_nationkey || '},"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}') AS h FROM customer
), w AS (
  SELECT i, sum(CAST('0x' || substr(h, 8 * i + 1, 8) AS HUGEINT)) AS s FROM d, range(8) AS t(i) GROUP BY i
)
SELECT sha256((SELECT count(*) FROM d) || ':' || string_agg(CAST(s AS VARCHAR), ':' ORDER BY i)) AS records_hash, (SELECT count(*) FROM d) AS n FROM w""",
    "batch_manifest": f"""WITH {_EMBEDDED}, q AS (
  SELECT item_id, CASE WHEN item_id % 10 = 1 THEN 'the same text' ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS text FROM benchmark
)
SELECT 'query-p1-' || item_id || '-kis' AS query_id, 'query-' || item_id || '-kis' AS submission, 5::BIGINT AS predictions, 5::BIGINT AS stored, frame AS top, round(score, 6) AS score,
  item_id <> min(item_id) OVER (PARTITION BY q.text) AS repeats_text, (SELECT count(*) FROM q) AS queries, (SELECT count(DISTINCT text) FROM q) AS searches,
  'query_id=query-p1-999999-kis,submission=query-999999-kis' AS removed
FROM q JOIN best ON best.text = q.text AND rank = 1""",
}
