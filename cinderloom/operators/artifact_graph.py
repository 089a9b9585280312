"""Checks of a whole set of artifacts against the scope that it was made for: one table of issues.

Every check takes tables and returns rows (severity, code, subject, detail); ``report`` puts them together. What a check is not
given is not checked. Counts and digests that an artifact states are held against what is found.

Defined results: null ids belong to no scope; a null among stated values differs from anything found. Empty tables are
checked like others: an empty scope is an issue, and an artifact without rows lacks every video.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR, WARNING = "error", "warning"
#: Indexes that a strict check asks for.
REQUIRED_INDEXES = ("visual_keyframes", "visual_windows", "asr_windows", "objects_windows")


def _issue(rows: DataFrame, code: Column | str, subject: Column, detail: Column | None = None, severity: str = ERROR) -> DataFrame:
    named = F.lit(code) if isinstance(code, str) else code
    more = F.lit("") if detail is None else detail
    return rows.select(F.lit(severity).alias("severity"), named.alias("code"), subject.cast("string").alias("subject"), F.coalesce(more.cast("string"), F.lit("")).alias("detail")).where("code IS NOT NULL")


def _ids(rows: DataFrame) -> DataFrame:
    return rows.select("video_id").where("video_id IS NOT NULL").distinct()


def report(*issues: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, issues)


def same_videos(found: DataFrame, scope: DataFrame, component: str) -> DataFrame:
    """Videos (video_id) of the scope that an artifact lacks, and those that it has besides."""
    have, want = _ids(found), _ids(scope)
    missing = _issue(want.join(have, "video_id", "left_anti"), f"{component}_scope_mismatch", F.col("video_id"), F.lit("missing"))
    return missing.unionByName(_issue(have.join(want, "video_id", "left_anti"), f"{component}_scope_mismatch", F.col("video_id"), F.lit("outside the scope")))


def scope_issues(scope: DataFrame) -> DataFrame:
    return _issue(_ids(scope).agg(F.count(F.lit(1)).alias("n")).where("n = 0"), "empty_configured_scope", F.lit("scope"))


def per_video_files(found: DataFrame, scope: DataFrame, component: str, *, severity: str = ERROR) -> DataFrame:
    """Videos of the scope without a file of ``component``, files that could not be read, and files that say to be of another
    video. Found: (file_video, video_id, code), code null for files that were read."""
    want, name = _ids(scope), F.lit(component)
    have = found.select(F.col("file_video").alias("video_id")).distinct()
    missing = _issue(want.join(have, "video_id", "left_anti"), F.concat(F.lit("missing_"), name), F.col("video_id"), severity=severity)
    mine = found.join(want.withColumnRenamed("video_id", "file_video"), "file_video", "left_semi")
    code = F.when(F.col("code").isNotNull(), F.concat(F.lit("invalid_"), name)).when(~F.col("video_id").eqNullSafe(F.col("file_video")), F.concat(name, F.lit("_video_id_mismatch")))
    detail = F.when(F.col("code").isNotNull(), F.col("code")).otherwise(F.col("video_id").cast("string"))
    return missing.unionByName(_issue(mine, code, F.col("file_video"), detail))


def row_counts(found: DataFrame, stated: DataFrame, component: str) -> DataFrame:
    """Videos whose rows (video_id) are not as many as stated (video_id, n); those that neither side names are not told."""
    have = found.where("video_id IS NOT NULL").groupBy("video_id").agg(F.count(F.lit(1)).alias("have"))
    both = stated.select("video_id", "n").join(have, "video_id", "full")
    wrong = both.where(~F.coalesce("n", F.lit(0)).eqNullSafe(F.coalesce("have", F.lit(0))))
    return _issue(wrong, f"{component}_count_mismatch", F.col("video_id"), F.concat_ws("/", F.coalesce("have", F.lit(0)).cast("string"), F.coalesce("n", F.lit(0)).cast("string")))


def rows_in_scope(rows: DataFrame, scope: DataFrame, key: str, component: str) -> DataFrame:
    """Rows (key, video_id) of videos outside the scope, and keys that repeat or are blank."""
    outside = _issue(rows.join(_ids(scope), "video_id", "left_anti"), f"{component}_row_scope_mismatch", F.col(key), F.col("video_id"))
    again = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    blank = F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == ""
    code = F.when(blank, f"{component}_without_{key}").when(F.col("n") > 1, f"duplicate_{component}_{key}")
    return outside.unionByName(_issue(again, code, F.col(key), F.col("n")))


def stated_values(stated: DataFrame, found: DataFrame, component: str, values: Sequence[str], key: str | None = None) -> DataFrame:
    """Values that an artifact's manifest states otherwise than they are found: ``<component>_<value>_mismatch``.

    Both tables have the ``values``, one row for each value of ``key`` (one row in all without it). A manifest that lacks
    is ``missing_<component>_manifest``, an artifact that lacks ``missing_<component>``."""
    keys = [key] if key else ["_one"]
    left, right = (t if key else t.withColumn("_one", F.lit(component)) for t in (stated, found))
    both = left.select(*keys, F.struct(*values).alias("stated")).join(right.select(*keys, F.struct(*values).alias("found")), keys, "full")
    codes = [F.when(F.col("stated").isNull(), f"missing_{component}_manifest").when(F.col("found").isNull(), f"missing_{component}")]
    codes += [F.when(F.col("stated").isNotNull() & F.col("found").isNotNull() & ~F.col(f"stated.{v}").cast("string").eqNullSafe(F.col(f"found.{v}").cast("string")), f"{component}_{v}_mismatch") for v in values]
    detail = [F.lit("")] + [F.concat_ws("/", F.coalesce(F.col(f"found.{v}").cast("string"), F.lit("null")), F.coalesce(F.col(f"stated.{v}").cast("string"), F.lit("null"))) for v in values]
    every = F.array(*[F.struct(c.alias("code"), d.alias("detail")) for c, d in zip(codes, detail, strict=True)])
    rows = both.select(*keys, F.explode(every).alias("x"))
    return _issue(rows, F.col("x.code"), F.col(keys[0]), F.col("x.detail"))


def index_paths(indexes: DataFrame, inventory: DataFrame, folder: str) -> DataFrame:
    """Of indexes (name, path): paths that leave their folder or are not there; and files (path) of the folder that no index
    names, but for the manifests ``<name>.manifest.json`` of known indexes. Paths are relative, with slashes."""
    steps = F.split(F.regexp_replace("path", r"\\", "/"), "/")
    escapes = F.col("path").rlike(r"^(/|[A-Za-z]:)") | F.array_contains(steps, "..")
    inside = indexes.withColumn("full", F.concat(F.lit(f"{folder}/"), F.col("path"))).withColumn("escapes", F.coalesce(escapes, F.lit(True)))
    out = _issue(inside.where("escapes"), "index_path_escape", F.col("name"), F.col("path"))
    files = inventory.select(F.col("path").alias("full")).distinct()
    gone = _issue(inside.where("NOT escapes").join(files, "full", "left_anti"), "missing_index_vectors", F.col("name"), F.col("path"))
    named = inside.where("NOT escapes").select("full").unionByName(indexes.select(F.concat(F.lit(f"{folder}/"), "name", F.lit(".manifest.json")).alias("full")))
    orphans = files.where(F.col("full").startswith(f"{folder}/")).join(named, "full", "left_anti")
    return out.unionByName(gone).unionByName(_issue(orphans, "orphan_index_file", F.col("full")))


def required_indexes(indexes: DataFrame, names: Sequence[str] = REQUIRED_INDEXES) -> DataFrame:
    asked = indexes.sparkSession.createDataFrame([(n,) for n in names], "name string")
    return _issue(asked.join(indexes.select("name"), "name", "left_anti"), "missing_required_index", F.col("name"))


def forbidden(inventory: DataFrame, folders: Sequence[str] = ("captions",)) -> DataFrame:
    """Files (path) in folders that may hold none."""
    inside = reduce(lambda a, b: a | b, [F.col("path").startswith(f"{f}/") for f in folders])
    folder = F.split_part("path", F.lit("/"), F.lit(1))
    return _issue(inventory.where(inside), F.concat(F.regexp_replace(folder, "s$", ""), F.lit("_artifacts_forbidden")), F.col("path"))


def passed(issues: DataFrame) -> DataFrame:
    """(errors, warnings, ok) of a report."""
    counted = issues.agg(F.count_if(F.col("severity") == ERROR).alias("errors"), F.count_if(F.col("severity") == WARNING).alias("warnings"))
    return counted.withColumn("ok", F.col("errors") == 0)
