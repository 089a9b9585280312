"""Object detections: thresholds, class-wise suppression, counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IOU = """(greatest(0D, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0D, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)))"""
AREA = "(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0))"


def suppress(detections: DataFrame, threshold: float = 0.5, min_score: float = 0.2, most: int = 100) -> DataFrame:
    """Per frame and class, in order of score (ties in input order), keeps a box that overlaps no kept one by more than
    ``threshold``; a frame keeps its ``most`` best boxes."""
    box = F.struct((-F.col("score")).alias("neg"), "pos", "x0", "y0", "x1", "y1")
    grouped = detections.where(F.col("score") >= min_score).groupBy("frame", "label").agg(F.array_sort(F.collect_list(box)).alias("b"))
    overlap = IOU.format(a="c", b="k")
    union = f"({AREA.format(a='c')} + {AREA.format(a='k')} - {overlap})"
    fold = f"aggregate(b, slice(b, 1, 0), (kept, c) -> IF(exists(kept, k -> {union} > 0 AND {overlap} / {union} > {threshold}), kept, concat(kept, array(c))))"
    kept = grouped.select("frame", "label", F.explode(F.expr(fold)).alias("d")).select("frame", "label", (-F.col("d.neg")).alias("score"), "d.pos")
    per_frame = kept.groupBy("frame").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "pos", "label"))), 1, most).alias("d"))
    return per_frame.select("frame", F.explode("d").alias("d")).select("frame", "d.label", "d.pos", (-F.col("d.neg")).alias("score"))


def counts(detections: DataFrame) -> DataFrame:
    """Labels of a frame with their counts, and the phrase that a text index holds."""
    c = detections.groupBy("frame", "label").agg(F.count(F.lit(1)).alias("n"))
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", "n"))), lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["label"])), ", ")
    return c.groupBy("frame").agg(phrase.alias("phrase"), F.sum("n").alias("total"))


def above_threshold(detections: DataFrame, thresholds: Mapping[str, float], default: float = 0.2) -> DataFrame:
    """Detections at or above the threshold of their class id, else of their entity, else of their label, else the
    default; boxes clamped to the unit square."""
    table = F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(float(v)))]) if thresholds else F.create_map().cast("map<string,double>")
    least = F.coalesce(F.try_element_at(table, "mid"), F.try_element_at(table, "entity"), F.try_element_at(table, "label"), F.try_element_at(table, F.lower("label")), F.lit(default))
    clamp = {c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) for c in ("x0", "y0", "x1", "y1")}
    return detections.where(F.col("score") >= least).withColumns(clamp)


def with_aliases(detections: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Detections with ``alias``: the name in another language of their class id, else of their entity, else of their label."""
    table = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.lit(v))]) if aliases else F.create_map().cast("map<string,string>")
    return detections.withColumn("alias", F.coalesce(F.try_element_at(table, "mid"), F.try_element_at(table, "entity"), F.try_element_at(table, "label")))
