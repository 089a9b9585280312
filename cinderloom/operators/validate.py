"""Checks that return their findings as rows; an empty result means that all is well."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least drift of a word or segment that counts, and the farthest a map may pass its video's end, in seconds.
SLACK = 0.05
PAST_END = 2.0


def manifest(components: Mapping[str, DataFrame]) -> DataFrame:
    """(id, one count per component) over all ids; each component has a column ``id``. One aggregation of the union."""
    ids = None
    for name, rows in components.items():
        part = rows.select("id", F.lit(name).alias("component"))
        ids = part if ids is None else ids.unionByName(part)
    return ids.where("id IS NOT NULL").groupBy("id").agg(*[F.count_if(F.col("component") == name).alias(name) for name in components])


def manifest_issues(table: DataFrame, core: Sequence[str], other: Sequence[str], equal: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(id, severity, code, detail): components that an id lacks (an error for ``core``), and pairs of counts that differ."""
    issue = lambda severity, code, detail: F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(detail).alias("detail"))
    found = [F.when(F.col(c) == 0, issue("error" if c in core else "warning", "missing_component", c)) for c in (*core, *other)]
    found += [F.when((F.col(a) > 0) & (F.col(b) > 0) & (F.col(a) != F.col(b)), issue("error", "component_count_mismatch", f"{a}/{b}")) for a, b in equal]
    return table.select("id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("i")).select("id", "i.*")


def summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


def in_scope(rows: DataFrame, scope: Sequence[str], column: str) -> DataFrame:
    """Rows of the ids in ``scope`` with their place in it; an id that no row has is an error of the query."""
    listed = rows.sparkSession.createDataFrame([(i, x.strip().upper()) for i, x in enumerate(dict.fromkeys(scope))], "place long, _id string")
    joined = F.broadcast(listed).join(rows, F.col("_id") == F.upper(F.trim(column)), "left")
    return joined.where(F.when(F.col(column).isNull(), F.raise_error(F.concat(F.lit("not in the data: "), "_id"))).otherwise(F.lit(True))).drop("_id")


def scope_difference(wanted: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """(id, state): ids on one side alone."""
    a, b = wanted.select(F.col(column).alias("id")).distinct(), found.select(F.col(column).alias("id")).distinct()
    return a.join(b, "id", "left_anti").withColumn("state", F.lit("missing")).unionByName(b.join(a, "id", "left_anti").withColumn("state", F.lit("extra")))


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def map_summary(keyframes: DataFrame) -> DataFrame:
    """Rows, first and last time and frame count of each video's map."""
    g = keyframes.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_keyframes"), F.min_by("pts_time", "n").alias("first_pts"), F.max_by("pts_time", "n").alias("last_pts"))
    return g


def past_end(keyframes: DataFrame, durations: DataFrame) -> DataFrame:
    """(video_id, over): maps whose last time passes the video's end by more than two seconds."""
    g = map_summary(keyframes).join(durations, "video_id").withColumn("over", F.col("last_pts") - F.col("duration"))
    return g.where(F.col("over") > PAST_END).select("video_id", "over")


def transcript_problems(segments: DataFrame) -> DataFrame:
    """(video_id, segment, code): segments that end before they start, start before the one ahead, or have no text."""
    w = Window.partitionBy("video_id").orderBy("segment")
    s = segments.withColumn("before", F.lag("start").over(w))
    rules = {"negative_length": F.col("end") < F.col("start"), "out_of_order": F.col("before") > F.col("start") + SLACK, "blank_text": F.coalesce(F.trim("text"), F.lit("")) == ""}
    codes = F.filter(F.array(*[F.when(rule, code) for code, rule in rules.items()]), lambda x: x.isNotNull())
    return s.select("video_id", "segment", F.explode(codes).alias("code"))


def submission_problems(rows: DataFrame) -> DataFrame:
    """(query_id, code) for (query_id, task, rank, n_frames, answer): frames and answers by task, equal event counts, at
    most 100 rows."""
    one = F.col("task").isin("KIS", "QA") & (F.col("n_frames") != 1)
    answer = F.coalesce(F.trim("answer"), F.lit("")) != ""
    g = rows.groupBy("query_id", "task").agg(
        F.max(one).alias("frames"), F.max((F.col("task") == "QA") & ~answer).alias("no_answer"), F.max((F.col("task") != "QA") & answer).alias("answer"),
        (F.count_distinct("n_frames") > 1).alias("uneven"), (F.count(F.lit(1)) > 100).alias("many"),
    )
    rules = {"one_frame": "frames", "answer_missing": "no_answer", "answer_unexpected": "answer", "too_many_rows": "many"}
    codes = [F.when(F.col(c), code) for code, c in rules.items()] + [F.when((F.col("task") == "TRAKE") & F.col("uneven"), "event_count")]
    return g.select("query_id", F.explode(F.filter(F.array(*codes), lambda x: x.isNotNull())).alias("code"))


def records_hash(rows: DataFrame, order: str, value: Column, group: str) -> DataFrame:
    """(group, n, sha): SHA-256 over each group's records in order, one per line."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: F.concat(x["v"], F.lit("\n")))
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(lines, ""), 256).alias("sha"))


def index_problems(index: DataFrame, metadata: DataFrame, dim: int) -> DataFrame:
    """(vec_id, code): vectors of another size or with components that are not finite, and rows that one side lacks."""
    i = index.select("vec_id", "v").withColumn("_i", F.lit(True))
    m = metadata.select("vec_id").distinct().withColumn("_m", F.lit(True))
    both = i.join(m, "vec_id", "full_outer")
    code = (
        F.when(F.col("_m").isNull(), "metadata_missing").when(F.col("_i").isNull(), "vector_missing").when(F.coalesce(F.size("v"), F.lit(-1)) != dim, "dimension")
        .when(F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite")
    )
    return both.select("vec_id", code.alias("code")).where("code IS NOT NULL")


def artifact_problems(scope: DataFrame, artifacts: Mapping[str, DataFrame], required: Sequence[str]) -> DataFrame:
    """(artifact, video_id, code, severity): for each artifact table with a column ``video_id``, the videos of the scope that
    it lacks and those that the scope lacks. What an optional artifact lacks is a warning."""
    out = None
    for name, rows in artifacts.items():
        d = scope_difference(scope, rows, "video_id").select(
            F.lit(name).alias("artifact"), F.col("id").alias("video_id"), F.when(F.col("state") == "missing", "missing").otherwise("outside_scope").alias("code"),
            F.when((F.col("state") == "extra") | F.lit(name in required), "error").otherwise("warning").alias("severity"),
        )
        out = d if out is None else out.unionByName(d)
    return out
