"""Queries over readers, search assembly and artifact checks, and their DuckDB SQL, written from the definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import artifacts, hits, objects
from ..sources import readers, tables

MODALITIES = {"visual": 1.0, "asr": 0.8, "ocr": 0.5}


def fusion_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as visual hits: every fifth has a representative, two of three have a keyframe."""
    e = tables.read(spark, sf_dir, "events")
    rows = e.select(
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit(" r"), "user_id")).otherwise("  ").alias("representative"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("keyframe"),
        F.col("event_id").alias("vector_id"), F.col("user_id").alias("window_id"), F.col("props").alias("text"),
    )
    return hits.canonical_hits(rows, "visual")


def search_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variants of every benchmark text against three modalities; the second asks transcripts alone."""
    b = tables.read(spark, sf_dir, "benchmark")
    variants = F.array(
        F.struct(F.lit(0).alias("variant"), F.lit("original").alias("kind"), F.lit(None).cast("string").alias("only"), F.lit(1.0).alias("weight")),
        F.struct(F.lit(1).alias("variant"), F.lit("spoken").alias("kind"), F.lit("asr").alias("only"), F.lit(0.75).alias("weight")),
    )
    asked = F.concat("text", F.when(F.col("item_id") % 2 == 0, F.lit(" Logo?")).otherwise(F.lit("")))
    rows = b.select(F.col("item_id").alias("query_id"), text.modality_hints(asked).alias("hints"), F.explode(variants).alias("v")).select("query_id", "hints", "v.*")
    return hits.weighted_sources(rows, MODALITIES).select("query_id", "source", F.round("weight", 6).alias("weight"))


def _query_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as query files of a batch for each nation, half of them with zeros before the number."""
    c = tables.read(spark, sf_dir, "customer")
    number = F.when(F.col("c_custkey") % 2 == 0, F.lpad(F.col("c_custkey").cast("string"), 9, "0")).otherwise(F.col("c_custkey").cast("string"))
    path = F.concat(F.lit("C:\\queries\\Query-p"), "c_nationkey", F.lit("-"), number, F.lit("-KIS.txt"))
    return c.select("c_custkey", "c_nationkey", text.file_stem(path).alias("stem"))


def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of submissions, and the natural order of the query files of a batch."""
    order = Window.partitionBy("c_nationkey").orderBy(text.natural_key(F.col("stem")), "c_custkey")
    named = readers.submissions(_query_names(spark, sf_dir))
    return named.select("c_custkey", "c_nationkey", F.col("submission").alias("stem"), F.row_number().over(order).cast("long").alias("place"))


def submission_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as query files numbered by their nation in two batches: names that several files would share."""
    s = tables.read(spark, sf_dir, "supplier")
    files = s.select(F.concat(F.lit("query-p"), F.col("s_suppkey") % 2, F.lit("-"), "s_nationkey", F.lit("-kis")).alias("stem"))
    return readers.name_collisions(files).select("submission", F.array_join("stems", ",").alias("stems"))


def _detection_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.detections(spark, sf_dir)
    item = F.struct("pos", "score", "label", "x0", "y0", "x1", "y1")
    rows = d.groupBy("frame").agg(F.array_sort(F.collect_list(item)).alias("d"))
    text_of = lambda name: F.transform("d", lambda x: x[name].cast("string"))
    boxes = F.transform("d", lambda x: F.array(*[x[k].cast("string") for k in ("y0", "x0", "y1", "x1")]))
    mids = F.transform("d", lambda x: F.concat(F.lit("/m/"), F.when(x["label"] == "N", "n").otherwise(x["label"])))
    names = F.when(F.col("frame") % 10 == 0, F.slice(mids, 1, 1)).otherwise(mids)  # some files are not whole
    made = F.struct(text_of("score").alias("detection_scores"), names.alias("detection_class_names"), text_of("label").alias("detection_class_entities"), boxes.alias("detection_boxes"))
    return rows.select("frame", F.to_json(made).alias("value"))


def detection_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items written as detection files and read again; one class has a lower threshold by its id, one by its entity."""
    rows, _ = readers.detections(_detection_files(spark, sf_dir))
    kept = objects.with_aliases(objects.above_threshold(rows, {"/m/n": 0.05, "A": 0.5}), {"/m/R": "retour"})
    return kept.select("frame", F.col("pos").cast("long").alias("pos"), "mid", "label", "alias", *[F.round(c, 6).alias(c) for c in ("score", "x0", "y0", "x1", "y1")])


def detection_file_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.detections(_detection_files(spark, sf_dir))[1].select("frame", "code")


def media_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as windows of the video that a customer is."""
    w = tables.read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("video_id"))
    c = tables.read(spark, sf_dir, "customer")
    v = c.select(F.col("c_custkey").alias("video_id"), F.col("c_name").alias("title"), F.nullif("c_mktsegment", F.lit("FURNITURE")).alias("description"), F.when(F.col("c_custkey") % 2 == 0, " ").otherwise("me").alias("author"))
    return artifacts.with_media_text(w, v)


def frames_out_of_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviewed = tables.read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("video_id"), (F.col("event_id") % 300 - 5).alias("frame"))
    counts = tables.read(spark, sf_dir, "customer").where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("video_id"), artifacts.frame_count(F.abs("c_acctbal") / 64, F.lit(2.5)).alias("frames"))
    return artifacts.frames_out_of_bounds(reviewed, counts).select("event_id", "frame", "code")


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, sf_dir, "documents")
    return artifacts.run_counters(d.select("text", (F.col("doc_id") % 3 == 0).alias("reused"), (F.col("lang") == "fr").alias("overridden"), (F.col("n_chars") > 1000).alias("reviewed")))


def refine_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.read(spark, sf_dir, "events").select(F.col("event_id").alias("candidate_id"), F.col("value").alias("score"))
    return hits.merge_refined(e.where("candidate_id % 4 = 0").withColumn("score", F.col("score") / 2), e.where("candidate_id % 4 > 0"))


def sampling_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.read(spark, sf_dir, "conversations")
    spans = c.select("conv_id", "turn", F.col("turn").cast("double").alias("start"), (F.col("turn") + F.length("text") / 64).alias("end"))
    return hits.sampling_grid(spans, F.when(F.col("conv_id") % 2 == 0, 25.0).otherwise(29.97), 2.0).select("conv_id", "turn", "frame", F.round("at", 6).alias("at"))


def scope_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one nation, asked for from the greatest balance down, a few of them twice; the first ten."""
    c = tables.read(spark, sf_dir, "customer")
    asked = c.where("c_nationkey = 3").select("c_custkey", (-F.col("c_acctbal")).alias("at"))
    asked = asked.unionByName(asked.where("c_custkey % 5 = 0").withColumn("at", F.col("at") + 100_000))
    return artifacts.selected(c.select("c_custkey", F.lit(0.0).alias("at")), asked, "c_custkey", 10, order="at").select("c_custkey", F.round("place.at", 2).alias("at"))


def shard_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = tables.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("video_id"))
    return artifacts.shards_in_scope(shards, tables.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("video_id")))


def source_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by source under their modality, and of two writers the first."""
    p = tables.read(spark, sf_dir, "part")
    size = F.col("p_size").cast("double")
    named = F.create_map(F.lit("visual:original:0"), size, F.lit("asr:original:0"), size * 2, F.lit("visual:event:1"), size * 3)
    modal = hits.by_modality(named)
    first = hits.first_writer(F.array(F.create_map(F.lit("a"), size), F.create_map(F.lit("a"), size + 1, F.lit("b"), size + 2)))
    return p.select("p_partkey", modal["visual"].alias("visual"), modal["asr"].alias("asr"), first["a"].alias("a"), first["b"].alias("b"))


def file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tables.read(spark, sf_dir, "pages").select(F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("/p"), "page_id", F.when(F.col("page_id") % 3 == 0, ".HTM").otherwise(".html")).alias("path"), F.length("html").alias("length"))
    return artifacts.file_counts(files)


def source_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tables.read(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("shard"), F.concat("url", F.lit("#"), "page_id").alias("path"), F.length("html").alias("length"), (F.col("page_id") * 7).alias("mtime"))
    return artifacts.source_signature(files, "shard", F.concat(F.lit("h"), F.col("shard").cast("string")))


def qa_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as candidates of a question, some without speech, text or score."""
    c, turn = tables.read(spark, sf_dir, "conversations"), F.col("turn")
    rows = c.select(
        F.col("conv_id").alias("query_id"), F.concat(F.lit("which "), "conv_id").alias("question"), F.lit("en").alias("language"), F.when(F.col("conv_id") % 2 == 0, " a scene ").alias("description"),
        F.format_string("C%02d", turn).alias("label"), F.col("conv_id").cast("string").alias("video_id"), (turn * 25).alias("frame"), (turn / 4).alias("at"), F.when(turn % 4 > 0, turn / 64).alias("score"),
        F.when(turn % 3 > 0, F.col("text")).alias("asr"), F.when(turn % 2 == 0, " ").otherwise(F.col("role")).alias("ocr"),
    )
    return artifacts.qa_prompt(rows).select("query_id", F.md5("prompt").alias("prompt_md5"))


def recognised_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as recognised texts with a confidence, and their roles as labels."""
    c = tables.read(spark, sf_dir, "conversations")
    item = F.struct("turn", F.concat(F.lit(" "), "role", F.lit("  x ")).alias("role"), F.when(F.col("turn") % 5 == 4, " ").otherwise(F.col("text")).alias("text"), (F.col("turn") % 4 / 4).alias("confidence"))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    rows = rows.withColumn("kept", artifacts.confident_items(F.col("items"), 0.5))
    return rows.select("conv_id", F.size("kept").cast("long").alias("n"), text.normalize_label(text.joined_labels(F.transform("kept", lambda x: x["role"]))).alias("labels"))


def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("attempt")).distinct()
    return rows.select(F.col("attempt").cast("long").alias("attempt"), text.retry_delay(F.col("attempt"), 0.5, 8.0).alias("seconds"))


QUERIES = {
    f.__name__: f
    for f in (
        fusion_ids, search_sources, natural_order, submission_collisions, detection_files, detection_file_problems, media_text, frames_out_of_bounds, run_counters, refine_merge, sampling_grid,
        scope_selected, shard_problems, source_scores, file_counts, source_signatures, qa_prompts, recognised_texts, retry_delays,
    )
}

BOXES = """SELECT l_orderkey AS frame, l_linenumber, l_quantity / 50 AS score, l_returnflag AS label, l_discount * 5 AS x0, (l_extendedprice % 1000) / 2000 AS y0, l_tax FROM lineitem"""
SOURCES = {
    "fusion_ids": """SELECT coalesce(CASE WHEN event_id % 5 = 0 THEN 'r' || user_id END, CASE WHEN event_id % 3 > 0 THEN event_type END, CAST(event_id AS VARCHAR)) AS candidate_id,
  event_id AS visual_vector_id, user_id AS visual_window_id, props AS visual_text FROM events""",
    "search_sources": """WITH q AS (SELECT item_id, lower(text || CASE WHEN item_id % 2 = 0 THEN ' Logo?' ELSE '' END) AS t FROM benchmark),
h AS (SELECT item_id, CASE WHEN regexp_matches(t, 'ghi gì|viết gì|dòng chữ|biển hiệu|logo|ocr') THEN 2.0::DOUBLE ELSE 1 END AS ocr,
  CASE WHEN regexp_matches(t, 'nói gì|phát biểu|nghe thấy|lời thoại|âm thanh') THEN 2.0::DOUBLE ELSE 1 END AS asr FROM q)
SELECT item_id AS query_id, 'visual:original:0' AS source, 1.0::DOUBLE AS weight FROM h UNION ALL SELECT item_id, 'asr:original:0', round(0.8::DOUBLE * asr, 6) FROM h
UNION ALL SELECT item_id, 'ocr:original:0', round(0.5::DOUBLE * ocr, 6) FROM h UNION ALL SELECT item_id, 'asr:spoken:1', round(0.8::DOUBLE * asr * 0.75, 6) FROM h""",
    "natural_order": """SELECT c_custkey, c_nationkey, 'query-' || c_custkey || '-kis' AS stem, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer""",
    "submission_collisions": """SELECT 'query-' || s_nationkey || '-kis' AS submission, string_agg(DISTINCT 'query-p' || s_suppkey % 2 || '-' || s_nationkey || '-kis', ',' ORDER BY 'query-p' || s_suppkey % 2 || '-' || s_nationkey || '-kis') AS stems
FROM supplier GROUP BY s_nationkey HAVING count(DISTINCT s_suppkey % 2) > 1""",
    "detection_file_problems": """SELECT l_orderkey AS frame, 'lengths_differ' AS code FROM lineitem WHERE l_orderkey % 10 = 0 GROUP BY l_orderkey HAVING count(*) > 1""",
    "detection_files": f"""WITH d AS ({BOXES}), n AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY l_linenumber, score, label, x0, y0, l_tax) - 1 AS pos, count(*) OVER (PARTITION BY frame) AS c FROM d)
SELECT frame, pos, '/m/' || CASE label WHEN 'N' THEN 'n' ELSE label END AS mid, lower(label) AS label, CASE WHEN label = 'R' THEN 'retour' END AS alias, round(score, 6) AS score,
  round(least(1, x0), 6) AS x0, round(least(1, y0), 6) AS y0, round(least(1, x0 + 0.25 + l_tax), 6) AS x1, round(least(1, y0 + 0.3), 6) AS y1
FROM n WHERE score >= CASE label WHEN 'N' THEN 0.05 WHEN 'A' THEN 0.5 ELSE 0.2 END AND (frame % 10 > 0 OR c = 1)""",
    "media_text": """SELECT user_id AS video_id, event_id, CASE WHEN c_custkey IS NOT NULL THEN concat_ws(' ', c_name, nullif(c_mktsegment, 'FURNITURE'), CASE WHEN c_custkey % 2 = 1 THEN 'me' END) END AS media_text
FROM events LEFT JOIN customer ON c_custkey = user_id""",
    "frames_out_of_bounds": """WITH r AS (SELECT event_id, user_id, event_id % 300 - 5 AS frame FROM events), c AS (SELECT c_custkey, CAST(round_even(abs(c_acctbal) / 64 * 2.5, 0) AS BIGINT) AS frames FROM customer WHERE c_custkey % 4 > 0)
SELECT event_id, frame, CASE WHEN frames IS NULL THEN 'unknown_video' WHEN frame < 0 THEN 'negative_frame' ELSE 'beyond_end' END AS code FROM r LEFT JOIN c ON c_custkey = user_id WHERE frames IS NULL OR frame < 0 OR frame >= frames""",
    "run_counters": """SELECT count(*) AS queries, count(DISTINCT text) AS texts, count_if(doc_id % 3 = 0) AS reused, count_if(lang = 'fr') AS overridden, count_if(n_chars > 1000) AS reviewed FROM documents""",
    "refine_merge": """SELECT event_id AS candidate_id, CASE WHEN event_id % 4 = 0 THEN value / 2 ELSE value END AS score, event_id % 4 = 0 AS refined FROM events""",
    "sampling_grid": """WITH s AS (
  SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 25.0::DOUBLE ELSE 29.97::DOUBLE END AS fps, turn::DOUBLE AS a, turn + length(text) / 64.0::DOUBLE AS z FROM conversations
), f AS (
  SELECT conv_id, turn, fps, CAST(round_even(a * fps, 0) AS BIGINT) AS first, unnest(range(CAST(round_even(a * fps, 0) AS BIGINT), CAST(round_even(z * fps, 0) AS BIGINT) + 1)) AS frame FROM s
)
SELECT conv_id, turn, frame, round(frame / fps, 6) AS at FROM f WHERE (frame - first) % CASE fps WHEN 25 THEN 12 ELSE 15 END = 0""",
    "scope_selected": """SELECT c_custkey, round(-max(c_acctbal), 2) AS at FROM customer WHERE c_nationkey = 3 GROUP BY c_custkey ORDER BY max(c_acctbal) DESC, c_custkey LIMIT 10""",
    "shard_problems": """SELECT CAST(n_nationkey AS BIGINT) AS video_id, CASE WHEN count(s_suppkey) = 0 THEN 'missing_shard' ELSE 'duplicate_shard' END AS code FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1 HAVING count(s_suppkey) <> 1""",
    "source_scores": """SELECT p_partkey, p_size * 3.0::DOUBLE AS visual, p_size * 2.0::DOUBLE AS asr, p_size::DOUBLE AS a, p_size + 2.0::DOUBLE AS b FROM part""",
    "file_counts": """SELECT regexp_replace(url, '[?#].*$', '') AS folder, CASE WHEN page_id % 3 = 0 THEN 'htm' ELSE 'html' END AS suffix, count(*) AS n, CAST(sum(length(html)) AS BIGINT) AS bytes FROM pages GROUP BY ALL""",
    "source_signatures": """SELECT page_id % 10 AS shard, sha256('scope:h' || page_id % 10 || chr(10) || string_agg(url || '#' || page_id || ':' || length(html) || ':' || page_id * 7 || chr(10), '' ORDER BY url || '#' || page_id)) AS signature
FROM pages GROUP BY page_id % 10""",
    "qa_prompts": """WITH c AS (
  SELECT conv_id, printf('C%02d', turn) AS label, printf('C%02d', turn) || ': video=' || conv_id || '; frame=' || turn * 25 || printf('; time=%.3fs', turn / 4.0::DOUBLE) || '; score='
    || CASE WHEN turn % 4 > 0 THEN printf('%.6f', turn / 64.0::DOUBLE) ELSE 'unknown' END || chr(10) || 'speech: ' || CASE WHEN turn % 3 > 0 AND trim(text) <> '' THEN trim(text) ELSE '[none]' END || chr(10)
    || 'text in the frame: ' || CASE WHEN turn % 2 = 1 THEN role ELSE '[none]' END AS lines
  FROM conversations
)
SELECT conv_id AS query_id, md5('Question (en): which ' || conv_id || CASE WHEN conv_id % 2 = 0 THEN chr(10) || 'Scene: a scene' ELSE '' END || chr(10) || chr(10) || string_agg(lines, chr(10) || chr(10) ORDER BY label, lines)) AS prompt_md5
FROM c GROUP BY conv_id""",
    "recognised_texts": """SELECT conv_id, count_if(ok) AS n, coalesce(string_agg(role || ' x', ' , ' ORDER BY turn) FILTER (ok), '') AS labels FROM (SELECT *, turn % 4 >= 2 AND turn % 5 <> 4 AND trim(text) <> '' AS ok FROM conversations) GROUP BY conv_id""",
    "retry_delays": """SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS attempt, least(8.0::DOUBLE, 0.5 * pow(2, l_linenumber - 1)) AS seconds FROM lineitem""",
}
