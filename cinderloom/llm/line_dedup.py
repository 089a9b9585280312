"""Near-duplicate lines by a deletion-neighbourhood join, DataFrame operations only.

Lines are the ``\\n``-split parts of a text; their words are runs of characters other than ASCII white space. Of equal
lines with at least ``min_words`` words the earliest stays. Of lines with at least ``near_min_words`` words that
differ by at most one word put in, left out or replaced (or in white space alone), a later one goes if any earlier one exists in the input
(whether or not that one stays). Earlier means smaller document id, then smaller line number.

How: every distinct line has a hash of its words and, for each word, a hash of the line without it (the deletion
neighbourhood of bound 1), made from XOR prefix and suffix sums, so a line of n words costs n rows, not n * n. Two
lines within the bound share a half of their words at equal length; only lines that share such a half with another
line emit variants. Equal variants meet in aggregations that keep the earliest line of each kind, so no group ever
emits pairs; each line's earliest partner is then verified word by word.

Defined results: a null text stays null and has no lines; an empty text has one empty line; short lines always stay;
null ids sort last; rows that repeat id and text are one document, and each gets the same result. An empty table
gives an empty result. Extra columns are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import SPACE_RUN, document_key, drop_paths, drop_table, materialize, recorded

MIN_WORDS = 3
SPACES = " \t\n\x0b\x0c\r"
NEAR_MIN_WORDS = 10


def line_words(line: Column) -> Column:
    """The words of a line."""
    inner = F.btrim(line, F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_RUN))


def _half_keys(w: Column, n: Column) -> Column:
    """Four keys: with ``longer`` (n or n + 1) the length of the longer of two lines, a line's first
    (longer - 1) div 2 words and its last words up to longer - 1 in all. One edit leaves one of the two halves as it is."""
    keys = []
    for longer in (n, n + 1):
        first = ((longer - 1) / 2).cast("int")
        last = longer - 1 - first
        keys += [F.xxhash64(longer, F.lit("first"), F.slice(w, F.lit(1), first)), F.xxhash64(longer, F.lit("last"), F.slice(w, n - last + 1, last))]
    return F.array(*keys)


def line_table(docs: DataFrame, min_words: int, near_min_words: int) -> DataFrame:
    """One row per line of at least ``min_words`` words: where it is, its 128-bit hash, and its half keys."""
    # the words are made inside the generator: a column of its own would be computed by the filter and once more after it; they
    # are cut at single blanks, without a pattern for each line, and are those of line_words
    blanks = F.when(F.col("text").rlike(r"[\t\x0B\f\r]"), F.translate("text", "\t\x0b\x0c\r", " " * 4)).otherwise(F.col("text"))
    with_words = F.zip_with(F.split("text", "\n"), F.split(blanks, "\n"), lambda line, b: F.struct(line.alias("line"), F.array_remove(F.split(b, " "), "").alias("w")))
    lines = docs.where("text is not null").select(*document_key(docs), F.posexplode(with_words).alias("no", "x"))
    lines = lines.where(F.size("x.w") >= min_words).select("_doc", "_th", "no", "x.line", "x.w", F.size("x.w").alias("n"))
    return lines.select(
        "_doc", "_th", "no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), F.col("line")).alias("h2"),
        F.when(F.col("n") >= near_min_words, _half_keys(F.col("w"), F.col("n"))).alias("keys"),
    )


def near_partners(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(h1, h2) of the distinct lines that have an earlier line within one word edit."""
    keyed = firsts.where("keys is not null").select("h1", "h2", F.explode(F.array_distinct("keys")).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    near = keyed.join(shared, "key").select("h1", "h2").distinct()
    wanted = firsts.join(near, ["h1", "h2"]).select("at._doc", "at._th", "h1", "h2", "at")
    per_doc = wanted.groupBy("_doc", "_th").agg(F.collect_list(F.struct("h1", "h2", "at")).alias("wanted"))
    texts = docs.select(*document_key(docs), "text")
    found = per_doc.join(texts, ["_doc", "_th"]).select(F.split("text", "\n").alias("lines"), "wanted")
    found = found.select(F.explode(F.expr("transform(wanted, x -> struct(x.h1 AS h1, x.h2 AS h2, x.at AS at, element_at(lines, x.at.no + 1) AS line))")).alias("x")).select("x.*")
    lines = materialize(found.dropDuplicates(["h1", "h2"]).select("h1", "h2", "at", line_words(F.col("line")).alias("w")))

    each = lines.select("h1", "h2", "at", F.size("w").alias("n"), F.posexplode("w").alias("i", "word"))
    each = each.select("h1", "h2", "at", "n", "i", F.xxhash64("word", "i").alias("here"), F.xxhash64("word", F.col("i") - 1).alias("shifted"))
    line = Window.partitionBy("h1", "h2").orderBy("i")
    before = F.coalesce(F.bit_xor("here").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole_line = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.bit_xor("shifted").over(whole_line).bitwiseXOR(F.bit_xor("shifted").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    variants = each.select("h1", "h2", "at", F.col("i").alias("p"), F.xxhash64(before.bitwiseXOR(after), F.col("n") - 1).alias("v"))
    whole = each.groupBy("h1", "h2").agg(F.first("at").alias("at"), F.bit_xor("here").alias("x"), F.first("n").alias("n"))
    whole = whole.select("h1", "h2", "at", F.lit(-1).alias("p"), F.xxhash64("x", "n").alias("v"))
    every = materialize(variants.unionByName(whole))
    # a variant that no other equals takes no part in what follows; they are counted without their lines
    met = every.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("v")
    variants = materialize(every.join(met, "v"))
    drop_table(every)

    # same word left out of both: one word replaced
    replaced = variants.where("p >= 0").groupBy("v", "p").agg(F.min("at").alias("other"), F.count(F.lit(1)).alias("c")).where("c > 1")
    claims = variants.join(replaced.drop("c"), ["v", "p"])
    # a line equal to another line without one word
    short = variants.where("p < 0").groupBy("v").agg(F.min("at").alias("other"))
    longer = variants.where("p >= 0").groupBy("v").agg(F.min("at").alias("other"))
    claims = claims.unionByName(variants.where("p >= 0").join(short, "v"))
    claims = claims.unionByName(variants.where("p < 0").join(longer, "v"))
    claims = claims.where("other < at").groupBy("h1", "h2").agg(F.min("other").alias("other"))

    a = claims.join(lines.select("h1", "h2", "w"), ["h1", "h2"])
    pairs = a.join(lines.select(F.col("at").alias("other"), F.col("w").alias("v")), "other")
    # the first place at which they differ (0: nowhere): one word less there must make them equal
    pairs = pairs.withColumn("long", F.when(F.size("w") >= F.size("v"), F.col("w")).otherwise(F.col("v")))
    pairs = pairs.withColumn("short", F.when(F.size("w") >= F.size("v"), F.col("v")).otherwise(F.col("w")))
    pairs = pairs.withColumn("d", F.expr("array_position(zip_with(long, short, (x, y) -> x <=> y), false)")).where("size(long) - size(short) <= 1")
    rest = "slice(long, CAST(d AS INT) + 1, size(long)) = slice(short, CAST(d AS INT) + size(short) - size(long) + 1, size(long))"
    return pairs.where(rest).select("h1", "h2").distinct()


def removed_lines(docs: DataFrame, *, min_words: int = MIN_WORDS, near_min_words: int = NEAR_MIN_WORDS) -> DataFrame:
    """(_doc, _th, exact, near): the numbers of a document's lines that go, from 0."""
    lines = materialize(line_table(docs, min_words, near_min_words))
    firsts = lines.groupBy("h1", "h2").agg(F.min(F.struct("_doc", "_th", "no")).alias("at"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("c"))
    firsts = materialize(firsts)
    with recorded() as made:
        found = near_partners(docs, firsts)
    near = materialize(found)
    drop_paths(docs.sparkSession, made)
    # first occurrences of near lines, and all but the first of repeated ones
    once = firsts.where("c = 1").join(near, ["h1", "h2"], "left_semi").select("at._doc", "at._th", "at.no", F.lit(True).alias("near"))
    many = firsts.where("c > 1").join(near.withColumn("is_near", F.lit(True)), ["h1", "h2"], "left").select("h1", "h2", "at", F.coalesce("is_near", F.lit(False)).alias("is_near"))
    again = lines.drop("keys").join(many, ["h1", "h2"])
    later = F.struct("_doc", "_th", "no") > F.col("at")
    again = again.where(later | F.col("is_near")).select("_doc", "_th", "no", (~later).alias("near"))
    gone = once.unionByName(again).distinct()
    return gone.groupBy("_doc", "_th").agg(
        F.collect_list(F.when(~F.col("near"), F.col("no"))).alias("exact"), F.collect_list(F.when(F.col("near"), F.col("no"))).alias("near")
    )


def dedup_lines(docs: DataFrame, *, columns: Sequence[str] = (), min_words: int = MIN_WORDS, near_min_words: int = NEAR_MIN_WORDS) -> DataFrame:
    """Every document with its text less the lines that go; ``columns`` are carried along."""
    gone = removed_lines(docs, min_words=min_words, near_min_words=near_min_words)
    carried = [F.col(c).alias(f"_keep_{c}") for c in columns]
    rows = docs.select(*document_key(docs), "text", F.col("doc_id").alias("_id"), *carried).join(gone, ["_doc", "_th"], "left")
    none = F.array().cast("array<int>")
    rows = rows.withColumn("exact", F.coalesce("exact", none)).withColumn("near", F.coalesce("near", none))
    # the text is split once for all of its lines
    kept = """CASE WHEN size(exact) + size(near) = 0 THEN text ELSE transform(array(split(text, '\\n')),
        l -> array_join(transform(array_except(sequence(0, size(l) - 1), concat(exact, near)), i -> element_at(l, i + 1)), '\\n'))[0] END"""
    return rows.select(
        F.col("_id").alias("doc_id"), *[F.col(f"_keep_{c}").alias(f"_keep_{c}") for c in columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.size("exact").cast("long").alias("n_exact"), F.size("near").cast("long").alias("n_near"),
        F.expr(kept).alias("kept_text"),
    )
