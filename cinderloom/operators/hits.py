"""Hits of several sources on their way to fusion: one id, one weight per source, one candidate row.

Defined results: null or blank ids fall through to the next; a hit without any id keeps a null. Empty tables give empty
results. Columns other than those named are carried along.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fusion


def fusion_id(representative: Column, keyframe: Column, vector: Column) -> Column:
    """The id under which hits of different sources meet: the representative keyframe, else the keyframe, else the vector."""
    blank = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    return F.coalesce(blank(representative), blank(keyframe), F.trim(vector.cast("string")))


def canonical_hits(hits: DataFrame, modality: str) -> DataFrame:
    """Hits (vector_id, representative, keyframe, window_id, text, ...) under their fusion id, with where they came from."""
    out = hits.withColumn("candidate_id", fusion_id(F.col("representative"), F.col("keyframe"), F.col("vector_id")))
    return out.withColumnsRenamed({"vector_id": f"{modality}_vector_id", "window_id": f"{modality}_window_id", "text": f"{modality}_text"}).drop("representative", "keyframe")


def to_candidates(hits: DataFrame) -> DataFrame:
    """Fused hits as candidates: the frame is ``frame_idx`` or else ``frame_id``, the time ``timestamp`` or else ``pts_time``;
    hits without a video are left out as they name no frame."""
    return hits.where(F.col("video_id").isNotNull()).select("*", F.coalesce("frame_idx", "frame_id").alias("frame"), F.coalesce("timestamp", "pts_time").alias("at"))


def weighted_sources(variants: DataFrame, modalities: Mapping[str, float]) -> DataFrame:
    """(query_id, variant, kind, modality, source, weight): one search per variant and modality. ``variants`` has query_id,
    variant (its number), kind, only (a modality, or null for all), weight and hints (a map of factors by modality)."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("modality"), F.lit(float(w)).alias("base")) for m, w in modalities.items()]))
    rows = variants.select("*", each.alias("m")).select("*", "m.modality", "m.base").drop("m")
    rows = rows.where(F.col("only").isNull() | (F.col("only") == F.col("modality")))
    hint = F.coalesce(F.element_at("hints", F.col("modality")), F.lit(1.0))
    source = F.concat_ws(":", "modality", "kind", F.col("variant").cast("string"))
    return rows.select("query_id", "variant", "kind", "modality", source.alias("source"), (F.col("base") * hint * F.col("weight")).alias("weight"))


def fuse(hits: DataFrame, weights: Mapping[str, float], *, method: str = "rrf", norm: str = "minmax") -> DataFrame:
    """Fusion by name: ``rrf`` or ``weighted``."""
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights are not negative")
    if method == "rrf":
        return fusion.reciprocal_rank_fusion(hits, weights)
    if method == "weighted":
        return fusion.weighted_score_fusion(hits, weights, norm)
    raise ValueError(f"no fusion method {method}")


def by_modality(scores: Column) -> Column:
    """A map of scores by source under the names of their modalities; a later source overwrites an earlier one."""
    entries = F.transform(F.map_entries(scores), lambda e: F.struct(F.split_part(e["key"], F.lit(":"), F.lit(1)).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def first_writer(maps: Column) -> Column:
    """One map of an array of maps: of equal keys the first one's value stays."""
    entries = F.flatten(F.transform(maps, lambda m: F.coalesce(F.map_entries(m), F.map_entries(F.create_map().cast("map<string,double>")))))
    first = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda before: before["key"] == e["key"]))
    return F.map_from_entries(first)


def merge_refined(refined: DataFrame, passed: DataFrame, *, order: str | None = "candidate_id") -> DataFrame:
    """Refined candidates and those that were not refined; ``refined`` tells them apart. In order of score and then ``order``,
    or in none where a ranking follows."""
    both = refined.withColumn("refined", F.lit(True)).unionByName(passed.withColumn("refined", F.lit(False)))
    return both.orderBy(F.desc("score"), order) if order else both


def sampling_grid(spans: DataFrame, fps: Column | float, sample_fps: float) -> DataFrame:
    """(.., frame, at): the frames that are looked at in each span (start, end), about ``sample_fps`` a second.

    Start and end are rounded to frames (halves to the even one) and every ``fps / sample_fps``th frame, rounded too, is
    taken from the first on; ``at`` is the time of the frame. A span that begins before 0 or ends before it begins, and a
    rate that is not positive, are errors; a null in any of them gives no rows.
    """
    if sample_fps <= 0:
        raise ValueError("sample_fps must be positive")
    rate = (fps if isinstance(fps, Column) else F.lit(fps)).cast("double")
    wrong = (F.col("start") < 0) | (F.col("end") < F.col("start")) | (rate <= 0)
    checked = F.when(wrong, F.raise_error(F.lit("a span is reversed or begins before 0, or its rate is not positive")).cast("double")).otherwise(rate)
    first = F.rint(F.col("start") * checked).cast("long")
    last, step = F.greatest(first, F.rint(F.col("end") * checked).cast("long")), F.greatest(F.lit(1).cast("long"), F.rint(checked / sample_fps).cast("long"))
    return spans.select("*", F.explode(F.sequence(first, last, step)).alias("frame")).withColumn("at", F.col("frame") / rate)
