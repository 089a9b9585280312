"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time [0, 1], piecewise linear. Its integral, scaled to the
source's token target, is the source's cumulative demand; inverting the demand at the token offset of a document
gives the document's training position. Documents are then range-sorted by position.

Sources are ordered by code point, null last. Targets share the corpus size by weight and stop at ``max_epochs``
times a source's size; what is cut off is shared by weight among the rest (water filling, in closed form).

Defined results: a null or empty text has size 0 and is never taken. A null source is a source of its own. Rows that
repeat are documents of their own. An empty table gives an empty result. Columns other than id, text and source
are not looked at.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import WORD, let

#: Weights of sources by rank, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Schedules (time, weight) by rank, repeating: fading, steady, rising.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
Schedule = Sequence[tuple[float, float]]


def cumulative(schedule: Schedule) -> list[tuple[float, float, float, float, float]]:
    """Pieces (area before, start, width, weight at start, slope) of a schedule scaled to area 1."""
    if len(schedule) < 2 or schedule[0][0] != 0 or schedule[-1][0] != 1:
        raise ValueError("a schedule runs from time 0 to time 1")
    if any(b[0] <= a[0] for a, b in zip(schedule, schedule[1:], strict=False)) or any(w < 0 for _, w in schedule):
        raise ValueError("schedule times rise and weights are not negative")
    total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:], strict=False))
    if total <= 0:
        raise ValueError("a schedule needs some weight")
    pieces, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        pieces.append((area, t0, t1 - t0, w0 / total, (w1 - w0) / (t1 - t0) / total))
        area += (t1 - t0) * (w0 + w1) / 2 / total
    return pieces


def position(share: Column, schedule: Schedule) -> Column:
    """Time at which the cumulative demand of ``schedule`` reaches ``share`` of its whole."""
    out = None
    for area, start, width, weight, slope in reversed(cumulative(schedule)):
        d = F.greatest(share - area, F.lit(0.0))
        root = weight + F.sqrt(F.greatest(F.lit(weight * weight) + 2 * slope * d, F.lit(0.0)))
        at = start + F.least(F.lit(width), F.when(root > 0, 2 * d / root).otherwise(0.0))
        out = at if out is None else F.when(share >= after, out).otherwise(at)
        after = area
    return F.least(F.lit(1.0), out)


def source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = 3.0) -> DataFrame:
    """Token target of every source; ``sizes`` has one row (skey, source, source_size) per source.

    With weight w and cap c the target is least(c, x * w); x is the greatest of (total - caps of the sources before)
    / (weights of the others) over the sources in order of c / w.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    w = sizes.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("rank"), F.lit(len(weights))).cast("int") + 1))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    w = w.withColumn("level", (F.sum("source_size").over(every) - before) / rest)
    return w.select("skey", "rank", "source_size", F.least("cap", F.max("level").over(every) * F.col("weight")).alias("target"))


def plan_mix(
    docs: DataFrame,
    *,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Schedule] = SCHEDULES,
    max_epochs: float = 3.0,
    buckets: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per document with its size, target of its source, copies taken and their training positions.

    A source is a stream of its documents in hash order, repeated. A copy is taken if its middle lies before the
    target. Offsets in the stream are prefix sums on two levels (sums of hash buckets, then inside a bucket), so that
    no task sees a whole source.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        *[F.col(c).alias(f"_keep_{c}") for c in keep],
        source_key(source_col).alias("skey"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("ord"),
    )
    sized = sized.withColumn("bucket", F.pmod(F.shiftrightunsigned("ord", 40), F.lit(buckets)))
    sums = sized.groupBy("skey", "source", "bucket").agg(F.sum("size").alias("bucket_size"))
    goal = targets(sums.groupBy("skey", "source").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs)
    order = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("skey", "bucket", F.coalesce(F.sum("bucket_size").over(order), F.lit(0)).alias("bucket_start"))
    starts = starts.join(goal, "skey")
    inside = Window.partitionBy("skey", "bucket").orderBy("ord", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["skey", "bucket"])
    middle = F.col("bucket_start") + F.col("inner") + F.col("size") / 2
    placed = placed.withColumn("middle", middle).withColumn(
        "copies",
        F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.greatest(F.lit(0), F.ceil((F.col("target") - F.col("middle")) / F.col("source_size")))).otherwise(0).cast("int"),
    )

    def inverse_of(schedule: Schedule):
        return lambda share: position(share, schedule)

    inverses = [inverse_of(s) for s in schedules]

    def at(epoch: Column) -> Column:
        share = (F.col("middle") + epoch * F.col("source_size")) / F.col("target")
        out = F.lit(None).cast("double")
        for k, inverse in enumerate(inverses):
            out = F.when(F.pmod(F.col("rank"), F.lit(len(schedules))) == k, let(share, inverse)).otherwise(out)
        return out

    none = F.array().cast("array<double>")
    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("copies") - 1, F.lit(0))), at)).otherwise(none)
    return placed.select(
        "doc_id", *[F.col(f"_keep_{c}").alias(f"_keep_{c}") for c in keep], "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"), "copies", positions.alias("positions"), "ord",
    )


def mixed_documents(docs: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    """The training order itself: every copy of every document, range-sorted by training position."""
    rows = plan_mix(docs, keep=columns, **options)
    rows = rows.select(*[F.col(f"_keep_{c}").alias(c) for c in columns], "ord", F.explode("positions").alias("_position"))
    return rows.orderBy("_position", "ord").select(*columns)
