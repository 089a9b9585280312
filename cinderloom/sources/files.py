"""Readers of the artifact formats: keyframe maps, JSON lines, directory trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import variants as V

VIDEO_ID = r"(?i)(L\d+_V\d+)"


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, video_id, suffix) of every file under ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return files.select("path", "length", F.upper(F.regexp_extract("path", VIDEO_ID, 1)).alias("video_id"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"))


def keyframe_map(spark: SparkSession, path: str) -> DataFrame:
    """Rows of keyframe map CSVs with their video and whether n runs 1, 2, .. in file order."""
    schema = "n int, pts_time double, fps double, frame_idx long"
    rows = spark.read.csv(path, schema=schema, header=True, mode="FAILFAST").withColumn("video_id", F.upper(F.regexp_extract(F.input_file_name(), VIDEO_ID, 1)))
    order = Window.partitionBy("video_id").orderBy("n", "frame_idx")
    return rows.withColumn("sequential", F.row_number().over(order) == F.col("n"))


def jsonl(spark: SparkSession, path: str, schema: T.StructType, *, required: Sequence[str] = (), observation: Observation | None = None) -> DataFrame:
    """Every line of JSON lines that is not blank, in one scan: the fields of ``schema``, and for lines that do not fit a ``_code`` and
    the ``_line`` itself (both null otherwise). Names of ``required`` must be there and not blank.

    With an ``observation`` the scan also counts its ``lines`` and ``bad`` ones, known once an action has run.
    """
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).where("trim(value) <> ''")
    d = V.computed(lines, {"v": F.try_parse_json("value"), "r": F.from_json("value", full, {"columnNameOfCorruptRecord": "_bad"})})
    d = V.computed(d, {"m": V.members(F.col("v"))})
    lacking = [(F.coalesce(F.trim(F.try_variant_get(F.try_element_at("m", F.lit(n)), "$", "string")), F.lit("")) == "", f"no_{n}") for n in required]
    code = V.first_code((F.col("v").isNull(), "not_json"), (F.col("m").isNull(), "not_an_object"), (F.col("r._bad").isNotNull(), "bad_field"), *lacking)
    d = V.computed(d, {"_code": code})
    out = d.select(*[F.col(f"r.`{f.name}`").alias(f.name) for f in schema.fields], "_code", F.when(F.col("_code").isNotNull(), F.col("value")).alias("_line"))
    return out if observation is None else out.observe(observation, F.count(F.lit(1)).alias("lines"), F.count_if(F.col("_code").isNotNull()).alias("bad"))


def good_lines(rows: DataFrame, *, strict: bool = False) -> DataFrame:
    """The lines of ``jsonl`` that fit; with ``strict`` one that does not is an error."""
    stop = F.raise_error(F.concat(F.lit("a line does not fit ("), "_code", F.lit("): "), F.substring("_line", 1, 200))).cast("boolean")
    kept = F.when(F.col("_code").isNull(), True).otherwise(stop if strict else F.lit(False))
    return rows.where(kept).drop("_code", "_line")


def line_counts(rows: DataFrame, group: str, key: str) -> DataFrame:
    """(group, code, n, n_keys) of the lines of ``jsonl``: how many rows each group has and how many different keys, rows
    without keys among them; lines that do not fit are counted by their code, without a group."""
    grouped = F.when(F.col("_code").isNull(), F.col(group)).alias(group)
    return rows.groupBy(grouped, F.col("_code").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("_code").isNull(), F.col(key))).alias("n_keys"))
