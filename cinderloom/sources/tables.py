"""Tables of the domain read from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FPS = 25.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, n, pts_time, frame_idx, label, score, keyframe_uid) from events; a user is a video."""
    e = read(spark, sf_dir, "events")
    at = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pts = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / 1e6
    k = e.select(F.col("user_id").alias("video_id"), "event_id", F.row_number().over(at).alias("n"), pts.alias("pts_time"), F.col("event_type").alias("label"), F.col("value").alias("score"))
    return k.withColumn("frame_idx", F.floor(F.col("pts_time") * FPS).cast("long")).withColumn("keyframe_uid", F.format_string("%d_K%06d", "video_id", "n"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from line items: one frame per order, one class per return flag."""
    d = read(spark, sf_dir, "lineitem")
    x, y = F.col("l_discount") * 5, F.pmod(F.col("l_extendedprice"), F.lit(1000.0)) / 2000
    return d.select(
        F.col("l_orderkey").alias("frame"), F.col("l_returnflag").alias("label"), F.col("l_linenumber").alias("pos"), (F.col("l_quantity") / 50).alias("score"),
        x.alias("x0"), y.alias("y0"), (x + F.lit(0.25) + F.col("l_tax")).alias("x1"), (y + F.lit(0.3)).alias("y1"),
    )


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, segment, text, start, end) from conversations: a character lasts 1/15 s."""
    c = read(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)) / 15
    return c.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("segment"), "text", start.alias("start"), (start + F.length("text") / 15).alias("end"))
