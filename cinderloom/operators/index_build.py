"""Builds of the search indexes over windows: pooled vectors with a keyframe that stands for the window, and texts by
modality; each is written with a manifest that says what it was built from.

Defined results: windows without keyframes are left out; a keyframe uid that names another video or is no uid, a keyframe
without a vector or a place on the timeline, and vectors of unequal lengths are errors. Blank texts have no row; lists of
texts are joined. Building from no rows at all is an error. Windows are told apart by ``window_id``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import storage
from ..functions import vectors

BUILDER_VERSION = 2
UID = r"(?i)^(.+)_K(\d+)$"
TEXTS = ("asr_text", "ocr_text", "object_labels", "metadata_text")
#: What a text index keeps of its window.
CARRIED = ("video_id", "start_time", "end_time", "start_frame", "end_frame", "representative_keyframe_uid", "frame_idx", "pts_time", "fps")
Encoder = Callable[[DataFrame, str, str], DataFrame]


def _stop(message: Column, kind: str) -> Column:
    return F.raise_error(message).cast(kind)


def members(windows: DataFrame) -> DataFrame:
    """(window_id, video_id, at, row): the keyframes of each window in order, as rows (from 0) of their video's vectors."""
    one = windows.select("window_id", "video_id", F.posexplode("keyframe_uids").alias("at", "uid"))
    number, video = F.regexp_extract("uid", UID, 2), F.regexp_extract("uid", UID, 1)
    right = (number != "") & (F.upper(video) == F.upper(F.col("video_id").cast("string")))
    wrong = _stop(F.concat(F.lit("not a keyframe of the window's video: "), F.coalesce("uid", F.lit("null"))), "long")
    return one.select("window_id", "video_id", "at", F.when(right, number.try_cast("long") - 1).otherwise(wrong).alias("row"))


def visual_windows(windows: DataFrame, features: DataFrame, keyframes: DataFrame, *, dim: int) -> DataFrame:
    """Windows (window_id, video_id, keyframe_uids, ..) without their texts, with ``vector_id``, the keyframe that stands for
    them (representative_keyframe_uid, frame_idx, pts_time, fps) and the normalised mean ``v`` of their keyframes' vectors.

    Features: (video_id, row, v); keyframes: (video_id, n, frame_idx, pts_time, fps), n from 1. The keyframe is the one
    whose vector has the greatest inner product with the mean, to nine digits; of equal ones the first.
    """
    kind = "array<float>" if features.schema["v"].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    shots = keyframes.select("video_id", (F.col("n") - 1).alias("row"), F.struct("frame_idx", "pts_time", "fps").alias("place"))
    shots = shots.groupBy("video_id", "row").agg(F.collect_list("place").alias("places"))
    m = members(windows).join(features.select("video_id", "row", F.col("v").cast(kind).alias("own")), ["video_id", "row"], "left").join(shots, ["video_id", "row"], "left")
    missing = _stop(F.concat(F.lit("no vector for row "), F.col("row").cast("string"), F.lit(" of "), F.col("video_id").cast("string")), kind)
    refused = _stop(F.lit(f"a vector is null, not of length {dim}, or not finite"), kind)
    own = F.when(F.col("own").isNull(), missing).when(vectors.is_valid(F.col("own"), dim), F.col("own")).otherwise(refused)
    # vectors go to their windows once; the mean and the nearest keyframe are both found where they then lie, in that order
    ordered = Window.partitionBy("window_id").orderBy("video_id", "at")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dealt = m.select("window_id", "video_id", "at", "row", "places", own.alias("own")).repartition("window_id").sortWithinPartitions("window_id", "video_id", "at")
    parts = dealt.select("*", *[F.get("own", F.lit(i)).cast("double").alias(f"_x{i}") for i in range(dim)])  # these are not exchanged
    means = [F.avg(f"_x{i}").over(whole).alias(f"_mean_{i}") for i in range(dim)]
    both = parts.select("window_id", "video_id", "row", "places", "own", F.row_number().over(ordered).alias("i"), *means)
    mean = F.array(*[F.col(f"_mean_{i}") for i in range(dim)]).cast("array<double>")

    def against(v: Column) -> Column:
        return F.struct(v.alias("v"), (-F.round(vectors.dot(F.col("own").cast("array<double>"), v), 9)).alias("d"))

    found = F.transform(F.array(mean), lambda m: F.transform(F.array(F.greatest(vectors.norm(m), F.lit(vectors.EPSILON))), lambda n: F.transform(m, lambda x: x / n))[0])
    both = both.select("window_id", "video_id", "i", "row", "places", F.inline(F.transform(found, against)))
    nearest = F.min(F.struct("d", "i")).over(Window.partitionBy("window_id", "video_id"))
    chosen = both.withColumn("best", nearest).where(F.col("i") == F.col("best.i"))
    placed = chosen.select("window_id", "video_id", "v", (F.col("row") + 1).alias("n"), F.explode_outer("places").alias("place"))
    placed = placed.select("window_id", "video_id", "v", "n", "place.*")
    off = _stop(F.concat(F.lit("no keyframe "), F.col("n").cast("string"), F.lit(" of "), F.col("video_id").cast("string")), "long")
    uid = F.format_string("%s_K%06d", F.col("video_id").cast("string"), "n")
    rows = placed.select("window_id", uid.alias("representative_keyframe_uid"), F.coalesce("frame_idx", off).alias("frame_idx"), "pts_time", "fps", "v")
    kept = windows.drop("asr_text", "ocr_text", "metadata_text", *[c for c in rows.columns if c != "window_id"])
    return kept.join(rows, "window_id").withColumn("vector_id", F.col("window_id").cast("string"))


def text_rows(windows: DataFrame, fields: Sequence[str] = TEXTS) -> DataFrame:
    """(modality, window_id, vector_id, text, source_field, ..): the texts of all ``fields`` that windows have, one row each."""
    held = [f for f in fields if f in windows.columns]

    def said(field: str) -> Column:
        if isinstance(windows.schema[field].dataType, T.ArrayType):
            return F.array_join(F.filter(F.transform(field, lambda x: x.cast("string")), lambda x: F.trim(x) != ""), ", ")
        return F.col(field).cast("string")

    modality = lambda f: "objects" if f == "object_labels" else f.removesuffix("_text")
    every = F.array(*[F.struct(F.lit(modality(f)).alias("modality"), F.lit(f).alias("source_field"), F.trim(said(f)).alias("text")) for f in held])
    carried = [c for c in CARRIED if c in windows.columns]
    rows = windows.select("window_id", *carried, F.explode(every).alias("t")).where("t.text <> ''")
    return rows.select("t.modality", "window_id", F.col("window_id").cast("string").alias("vector_id"), "t.text", "t.source_field", *carried)


def _plain(value: Column, kind: T.DataType) -> Column:
    """A value with the fields of its structs in order of their names and its maps in order of their keys."""
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_plain(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _plain(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), _plain(e["value"], kind.valueType).alias("value")))))
    if isinstance(kind, (T.FloatType, T.DecimalType)):
        return value.cast("double")
    return value


def canonical_json(rows: DataFrame, leave_out: Sequence[str] = ()) -> Column:
    """A row as JSON with sorted names, nulls included and numbers with a fraction in one form."""
    fields = sorted((f for f in rows.schema.fields if f.name not in leave_out), key=lambda f: f.name)
    return F.to_json(F.struct(*[_plain(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields]), {"ignoreNullFields": "false"})


def records_hash(rows: DataFrame, *, leave_out: Sequence[str] = ("metadata_text",)) -> DataFrame:
    """(records_hash, n): a hash of a set of records that does not depend on where they lie or in which order: SHA-256 over
    their number and the sums of the eight words of the SHA-256 of each one's canonical JSON. One aggregate that is
    combined before the shuffle, at any number of rows; of no rows it is the hash of zeros."""
    digest = F.sha2(canonical_json(rows, leave_out), 256)
    words = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("decimal(38,0)") for k in range(8)]
    sums = rows.select(*[w.alias(f"w{k}") for k, w in enumerate(words)]).agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(f"w{k}"), F.lit(0)).cast("string").alias(f"w{k}") for k in range(8)])
    return sums.select(F.sha2(F.concat_ws(":", F.col("n").cast("string"), *[F.col(f"w{k}") for k in range(8)]), 256).alias("records_hash"), "n")


def write(index: DataFrame, path: str, made_from: Mapping[str, str], *, by: Sequence[str] = ()) -> None:
    """Vectors as 32-bit floats under ``path``, a folder for each value of ``by``, and a manifest beside them: a row for each
    value with the number of rows, the dimension, and ``made_from`` (encoder, scope, hashes). No rows are an error."""
    spark = index.sparkSession
    rows = index.withColumn("v", F.col("v").cast("array<float>"))
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(f"{path}/vectors")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/vectors")
    made = stored.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.min(F.size("v")).alias("dimension"), F.max(F.size("v")).alias("_most"))
    checked = F.when((F.col("rows") == 0) | (F.col("dimension") != F.col("_most")), F.raise_error(F.lit("an index has no rows, or vectors of several lengths")).cast("int")).otherwise(F.col("dimension"))
    notes = [F.lit(v).alias(k) for k, v in sorted(made_from.items())]
    manifest = made.withColumn("dimension", checked).drop("_most").select("*", F.lit(BUILDER_VERSION).alias("version"), *notes, F.current_timestamp().alias("created_at"))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    if by and spark.read.schema(manifest.schema).json(f"{path}/manifest").isEmpty():
        raise ValueError("an index has no rows")


def problems(spark: SparkSession, path: str, made_from: Mapping[str, str], *, by: Sequence[str] = ()) -> DataFrame:
    """(by, code): what keeps an index from being used: another version, other sources, or other rows than its manifest says."""
    manifest, stored = spark.read.json(f"{path}/manifest"), spark.read.parquet(f"{path}/vectors")
    found = stored.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), F.max(F.size("v")).alias("_dimension"))
    key = list(by) or ["_all"]
    if not by:
        manifest, found = manifest.withColumn("_all", F.lit(1)), found.withColumn("_all", F.lit(1))
    both = manifest.join(found, key, "full")
    cases = [("missing_manifest", F.col("version").isNull()), ("missing_vectors", F.col("_rows").isNull()), ("other_version", F.col("version") != BUILDER_VERSION)]
    cases += [(f"other_{k}", F.lit(True) if k not in manifest.columns else ~F.col(k).eqNullSafe(F.lit(v))) for k, v in sorted(made_from.items())]
    cases += [("other_rows", F.col("rows") != F.col("_rows")), ("other_dimension", F.col("dimension") != F.col("_dimension"))]
    codes = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in cases]), lambda x: x.isNotNull())
    return both.select(*by, F.explode(codes).alias("code"))


def opened(spark: SparkSession, path: str, made_from: Mapping[str, str], *, by: Sequence[str] = ()) -> DataFrame:
    """The rows of an index, vectors in doubles; an error if anything is wrong with it."""
    wrong = [tuple(r) for r in problems(spark, path, made_from, by=by).limit(5).collect()]
    if wrong:
        raise ValueError(f"{path}: build the index anew: {wrong}")
    return spark.read.parquet(f"{path}/vectors").withColumn("v", F.col("v").cast("array<double>"))


def build_text_index(windows: DataFrame, path: str, encoder: Encoder, made_from: Mapping[str, str], *, fields: Sequence[str] = TEXTS) -> None:
    """One text index, a folder a modality. ``encoder`` gives (vec_id, v) for rows with a key and a text.

    Vectors are many times as large as Spark guesses from the texts that they are made of, so both sides are merged; left
    to the guess, it broadcasts them.
    """
    rows = storage.stored(text_rows(windows, fields).withColumn("_key", F.monotonically_increasing_id()), "texts")
    encoded = encoder(rows, "_key", "text").select(F.col("vec_id").alias("_key"), F.col("v").cast("array<float>").alias("v"))
    write(rows.join(encoded.hint("merge"), "_key").drop("_key"), path, made_from, by=["modality"])
