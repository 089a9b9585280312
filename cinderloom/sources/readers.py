"""Readers of the collection's JSON and text files. Each takes rows with the files' text, so that it works on any store that
Spark reads; ``whole_files`` makes them.

Defined results: a text that does not parse gives no rows, and ``problems`` of the reader says why; null texts count as
such. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import variants as V


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem, value): files as one text each, without a byte order mark."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    return rows.select("path", T.file_stem(F.col("path")).alias("stem"), "value")


def media_info(files: DataFrame) -> DataFrame:
    """Files with title, description, author, keywords and length; null where the text is no such object."""
    schema = "title string, description string, author string, keywords array<string>, length double"
    return files.withColumn("m", F.from_json("value", schema)).select(*files.columns, "m.*")


DETECTIONS = "detection_scores array<string>, detection_class_names array<string>, detection_class_entities array<string>, detection_boxes array<array<string>>"


def detections(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(.., pos, mid, entity, label, score, x0, y0, x1, y1) from four parallel arrays of strings, boxes as y0, x0, y1, x1: all
    of them, as they are; ``objects.above_threshold`` chooses and clamps. The entity is the class id where it is blank, the
    label its folded form. And (.., code) of files that are not whole: those give no rows."""
    keys = [c for c in files.columns if c != "value"]
    d = V.computed(files, {"d": F.from_json("value", DETECTIONS), "_m": V.members(F.try_parse_json("value"))})
    names = ("detection_scores", "detection_class_names", "detection_class_entities", "detection_boxes")
    scores, mids, entities, boxes = (F.coalesce(F.col(f"d.{n}"), F.array()) for n in names)
    read = F.transform(F.arrays_zip(scores.alias("score"), mids.alias("mid"), entities.alias("entity"), boxes.alias("box")), lambda x: F.struct(
        x["score"].try_cast("double").alias("score"), F.trim(x["mid"]).alias("mid"), T.collapse(x["entity"]).alias("entity"), F.transform(x["box"], lambda v: v.try_cast("double")).alias("box")
    ))
    d = d.select(*keys, "_m", read.alias("r"), *[F.size(c).alias(f"_n{k}") for k, c in enumerate((scores, mids, entities, boxes))])
    wrong = F.exists("r", lambda x: x["score"].isNull() | (F.coalesce(F.size(x["box"]), F.lit(0)) != 4) | F.exists(x["box"], lambda v: v.isNull()))
    code = F.when(F.col("_m").isNull(), "not_json").when((F.col("_n0") != F.col("_n1")) | (F.col("_n0") != F.col("_n2")) | (F.col("_n0") != F.col("_n3")), "lengths_differ").when(wrong, "bad_number")
    d = d.withColumn("code", code)
    rows = d.where("code IS NULL").select(*keys, F.posexplode("r").alias("pos", "x"))
    box = [F.get("x.box", F.lit(k)).alias(n) for k, n in ((1, "x0"), (0, "y0"), (3, "x1"), (2, "y1"))]
    rows = rows.select(*keys, "pos", "x.mid", F.coalesce(F.nullif(F.col("x.entity"), F.lit("")), F.col("x.mid")).alias("entity"), F.col("x.score").alias("score"), *box)
    return rows.withColumn("label", T.fold(F.col("entity"))), d.where("code IS NOT NULL").select(*keys, "code")


def query_files(files: DataFrame, suffix: str = "-kis") -> DataFrame:
    """(stem, text, position): query files in natural order of their names; an empty one is an error."""
    rows = files.where(F.lower("stem").endswith(suffix)).withColumn("text", F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")))
    text = F.when(F.col("text") == "", F.raise_error(F.concat(F.lit("empty query file: "), "stem")).cast("string")).otherwise(F.col("text"))
    return rows.select("stem", text.alias("text"), T.natural_key(F.col("stem")).alias("position")).orderBy("position")


def name_collisions(files: DataFrame) -> DataFrame:
    """(submission, stems): names of submissions that more than one query file would be written under."""
    named = files.select("stem", T.submission_stem(F.col("stem")).alias("submission")).distinct()
    many = named.groupBy("submission").agg(F.array_sort(F.collect_list("stem")).alias("stems"))
    return many.where(F.size("stems") > 1)


def submissions(queries: DataFrame) -> DataFrame:
    """Query files (stem, ..) with the name of their ``submission``; two files with one name are an error."""
    known = name_collisions(queries).select("submission", F.lit(True).alias("_many"))
    named = queries.withColumn("submission", T.submission_stem(F.col("stem"))).join(known, "submission", "left")
    stop = F.raise_error(F.concat(F.lit("several query files for the submission "), F.col("submission"))).cast("string")
    return named.withColumn("submission", F.when(F.col("_many"), stop).otherwise(F.col("submission"))).drop("_many")


def sidecar(rows: DataFrame, key: str, value: Column, order: str) -> DataFrame:
    """(key, value): the last row of a key counts."""
    return rows.groupBy(key).agg(F.max_by(value, F.col(order)).alias("value"))
