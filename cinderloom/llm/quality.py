"""Quality rules: word statistics and the divergence of a document from its language, DataFrame operations only.

Base rules follow from word counts alone. The method compares two histograms of a document with references of its
language by Jensen-Shannon distance (base 2, so 0 to 1): character classes (letters, upper-case letters, digits,
punctuation, symbols, white space, and the rest) and the language's common words (a parameter, with one class for
all other words; languages without such a list are judged by characters alone). References are sums over all documents of a language; the characters of a language with fewer than
``min_reference`` documents are held against the sums over all documents, its common words against nothing. Documents under ``min_words`` words are too short for a
histogram and keep their base verdict; the common-word distance also needs ``min_words_for_words``.

Defined results: a null text counts as empty (no words, so it fails the base rules). A null language is a language
of its own. Rows that repeat are judged alike. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import let, materialize, words

CLASSES = ("upper", "digit", "punct", "symbol", "space", "letter")
MIN_WORDS = 50
MIN_WORDS_FOR_WORDS = 100
# The most common words of four languages, for the common-word histogram.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "ist", "ein"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "with"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por"],
    "fr": ["de", "la", "et", "le", "les", "des", "en", "un", "une", "du", "que", "est"],
}
MAX_CLASS_DISTANCE = 0.22
MAX_WORD_DISTANCE = 0.35
MIN_REFERENCE = 100


def _left(text: Column, pattern: str) -> Column:
    """Code points that match no ``pattern``."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def repeated_window_words(hashes: Column, width: int) -> Column:
    """Words in windows that occur twice or more, from the hashes of all windows: equal hashes meet by sorting, and a
    window adds the words that the window before it has not covered."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        n = F.size(s)
        same = lambda a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
        hit = F.filter(F.sequence(F.lit(0), n - 1), lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
        return F.array_sort(F.transform(hit, lambda k: F.get(s, k)["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(
            at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1000).alias("last")),
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(width), i - acc["last"])).alias("n"), i.alias("last")),
        )["n"]

    return let(let(pairs, repeated), covered)


def window_hashes(w: Column, width: int) -> Column:
    last = F.size(w) - width
    each = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
    return F.when(last >= 0, each).otherwise(F.array().cast("array<bigint>"))


def measure(docs: DataFrame, common: Mapping[str, Sequence[str]], keep: Sequence[str] = ()) -> DataFrame:
    """Counts of every document in one pass over the texts; no text comes out unless ``keep`` names it."""
    x = docs.select("doc_id", *[F.col(c).alias(f"_keep_{c}") for c in keep], F.coalesce("text", F.lit("")).alias("t"), "lang")
    listed = F.array().cast("array<string>")
    for lang, those in common.items():
        listed = F.when(F.col("lang") == lang, F.array(*[F.lit(v) for v in those])).otherwise(listed)
    x = x.withColumn("common", listed)
    x = x.withColumn("w", words(F.col("t")))
    x = x.withColumn("hashes", window_hashes(F.col("w"), 5))
    padded = F.concat(F.lit(" "), F.array_join(F.col("w"), "  "), F.lit(" "))
    x = x.withColumn("padded", F.lower(padded))
    lines = F.filter(F.split("t", "\n"), lambda v: v.rlike(r"[^\x20\x09-\x0D]"))
    repeats = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), repeated_window_words(F.col("hashes"), 5)).otherwise(F.lit(0).cast("long"))
    of = lambda v: ((F.octet_length("padded") - F.octet_length(F.replace(F.col("padded"), F.concat(F.lit(" "), v, F.lit(" ")), F.lit("")))) / (F.octet_length(v) + 2)).cast("long")
    return x.select(
        "doc_id", *[f"_keep_{c}" for c in keep], "lang",
        F.size("w").cast("long").alias("n_words"),
        F.length("t").cast("long").alias("chars"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - _left(F.col("t"), r"[#*$%&|<>]+")).alias("n_symbols"),
        let(lines, lambda v: (F.size(v) - F.size(F.array_distinct(v))).cast("long")).alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        (F.length("t") - _left(F.col("t"), r"\p{Lu}+")).alias("upper"),
        (F.length("t") - _left(F.col("t"), r"\p{N}+")).alias("digit"),
        (F.length("t") - _left(F.col("t"), r"""[.,;:!?'"()\-]+""")).alias("punct"),
        F.transform("common", of).alias("common_counts"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts, base 2; null if one has no counts."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    share = lambda a: F.transform(a, lambda v: v / total(a))
    half = lambda a, m: F.when((a > 0) & (m > 0), a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(share(p), share(q), lambda a, b: half(a, (a + b) / 2) + half(b, (a + b) / 2))
    distance = F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v) / 2, F.lit(0.0)))
    return F.when((total(p) > 0) & (total(q) > 0), distance)


def _class_counts() -> Column:
    space = F.col("chars") - F.col("word_chars")
    letter = F.greatest(F.col("word_chars") - F.col("upper") - F.col("digit") - F.col("punct") - F.col("n_symbols"), F.lit(0).cast("long"))
    return F.array(*[c.cast("double") for c in (F.col("upper"), F.col("digit"), F.col("punct"), F.col("n_symbols"), space, letter)])


def _word_counts() -> Column:
    rest = F.col("n_words") - F.aggregate("common_counts", F.lit(0).cast("long"), lambda acc, v: acc + v)
    return F.transform(F.concat(F.col("common_counts"), F.array(rest)), lambda v: v.cast("double"))


def references(measured: DataFrame, listed: int, *by: str) -> DataFrame:
    """(docs, ref_classes, ref_words): sums over all documents, or over those of each value of ``by``."""
    sums = [F.sum(F.col("cc")[k]).alias(f"c{k}") for k in range(len(CLASSES))] + [F.sum(F.get("wc", F.lit(k))).alias(f"w{k}") for k in range(listed + 1)]
    rows = measured.select(*by, _class_counts().alias("cc"), _word_counts().alias("wc"))
    found = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("docs"), *sums)
    present = lambda names: F.filter(F.array(*names), lambda v: v.isNotNull())
    return found.select(*by, "docs", present([f"c{k}" for k in range(len(CLASSES))]).alias("ref_classes"), present([f"w{k}" for k in range(listed + 1)]).alias("ref_words"))


def quality_rules(
    docs: DataFrame,
    *,
    keep: Sequence[str] = (),
    min_words: int = MIN_WORDS,
    min_words_for_words: int = MIN_WORDS_FOR_WORDS,
    common: Mapping[str, Sequence[str]] = COMMON_WORDS,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    min_reference: int = MIN_REFERENCE,
) -> DataFrame:
    """Measures, distances and verdict of every document (columns ``keep`` come along as ``_keep_<name>``)."""
    measured = materialize(measure(docs, common, keep))
    listed = max(map(len, common.values()), default=0)
    pooled = references(measured, listed).first()
    # as many rows as languages: written, so that the join goes by their true size
    by_lang = materialize(references(measured, listed, "lang").where(F.col("docs") >= min_reference).withColumnRenamed("lang", "ref_lang"))
    array = lambda v: F.array(*[F.lit(float(x)) for x in v]).cast("array<double>")
    x = measured.join(by_lang, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    x = x.withColumn("class_distance", js_distance(_class_counts(), F.coalesce("ref_classes", array(pooled["ref_classes"]))))
    x = x.withColumn("word_distance", F.when(F.size("common_counts") > 0, js_distance(_word_counts(), F.col("ref_words"))))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    far_class = (F.col("n_words") >= min_words) & (F.coalesce("class_distance", F.lit(0.0)) > max_class_distance)
    far_words = (F.col("n_words") >= min_words_for_words) & (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance)
    return x.select(
        "doc_id", *[f"_keep_{c}" for c in keep], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & ~far_class & ~far_words).alias("kept"),
        F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"),
    )
