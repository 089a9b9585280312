"""Variants of a query, and the merge of what they find."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, split_events

Rewrite = Callable[[Column], Column]
#: Weight of each kind of variant, and how many paraphrases count.
WEIGHTS = {"original": 1.0, "translation": 0.9, "paraphrase": 0.8, "event": 0.85}
PARAPHRASES = 3


def expand(queries: DataFrame, translation: Rewrite | None = None, paraphrases: Sequence[Rewrite] = ()) -> DataFrame:
    """(query_id, variant, kind, text, weight) from (query_id, text): the text, its translation, up to three paraphrases
    and its events. Variants equal but for case and white space appear once, the first of them; blank ones do not."""
    text = F.col("text")

    def variant(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("text"), F.lit(WEIGHTS[kind]).alias("weight"), F.lower(collapse(value)).alias("key"))

    fixed = [variant("original", text)]
    if translation is not None:
        fixed.append(variant("translation", translation(text)))
    fixed += [variant("paraphrase", p(text)) for p in paraphrases[:PARAPHRASES]]
    events = F.transform(F.coalesce(split_events(text), F.array().cast("array<string>")), lambda e: variant("event", e))
    every = F.filter(F.concat(F.array(*fixed), events), lambda v: F.coalesce(v["key"], F.lit("")) != "")
    rows = queries.withColumn("every", every)
    first = F.filter("every", lambda v, i: ~F.exists(F.slice("every", F.lit(1), i), lambda u: u["key"] == v["key"]))
    return rows.select("query_id", F.posexplode(first).alias("variant", "v")).select("query_id", "variant", "v.kind", "v.text", "v.weight")


def merge_variants(hits: DataFrame) -> DataFrame:
    """The best weighted score of each candidate over all variants; hits: (query_id, source, candidate_id, score, weight).
    A negative score times a weight below one rises."""
    return hits.groupBy("query_id", "source", "candidate_id").agg(F.max(F.col("score") * F.col("weight")).alias("score"))
