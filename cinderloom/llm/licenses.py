"""License scan by a positional rare-token index, DataFrame operations only.

Templates are word lists with mandatory key phrases. The index posts every indexed template word under (template,
position). Of each template the ``top`` words with the highest inverse document frequency (over all documents), and as
many more as stand in over ``1 - min_coverage`` of its places, so that every match has one of them (at most all that are indexed), are looked up in a
file; of a base phrase it is the rarest. A posting and a place in the file together name a start of the
template in the file, so that hits agreeing on a relative position name the same start. Postings are intersected by that
start: it stands if as many hits agree on it as a match must have (the looked-up places less the places that may
differ), where starts up to the template's slack apart agree: words put in or left out in the middle shift what follows. There
the template's words are looked for at their places, or up to the slack beside them; it counts if ``min_coverage`` of
them are there and all its key phrases stand in that stretch. The slack is a word for every eight of the template, four at
most. Base phrases are templates of their own that must match whole, without slack.

Words are runs of digits, ASCII letters in lower case, and characters beyond ASCII.

Defined results: a null text is empty; files without template words have no label, score 0 and null places. Rows that
repeat give the same result each. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import ascii_lower, let, materialize, words

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]


#: Words of a template for each word of slack, the greatest slack, and words after a template in which a key phrase may end.
WORDS_A_SLACK, MOST_SLACK, AFTER = 8, 4, 4

# Phrases and labels that always count.
BASE = (Template("mit", "mit license", ()), Template("apache", "apache license", ()), Template("gpl", "general public license", ()))

# Opening words of public licences and usual notices, with the phrases that must stand in a match.
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted", "without restriction")),
    Template("apache", "licensed under the apache license version 2 0", ("apache license",)),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",)),
    Template("gpl", "licensed under the gnu general public license version 3", ("general public license",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("free software", "general public license")),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("attribution 4 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "with or without modification")),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
)

# Words too common in any text to be indexed.
STOP_WORDS = frozenset("a and any are at be by can for free fee form files in is it may met not of on or person purpose that the this to under use use v with without you 0 2 3 4 nc".split())


def _array(items: Sequence[str]) -> Column:
    return F.array(*[F.lit(x) for x in items]) if items else F.array().cast("array<string>")


def match_lower(text: Column) -> Column:
    """Lower case for comparing with ASCII words: A-Z become a-z, and no other character becomes ASCII (the Kelvin sign
    and the dotted capital I would in a plain ``lower``)."""
    return F.when(text.contains("K") | text.contains("İ"), ascii_lower(text)).otherwise(F.lower(text))


def scan_licenses(docs: DataFrame, *, templates: Sequence[Template] = TEMPLATES, base: Sequence[Template] = BASE, top: int = 8, min_coverage: float = 0.7) -> DataFrame:
    every = [*base, *templates]
    parts = [t.text.split(" ") for t in every]
    indexed = sorted({w for p in parts for w in p if w not in STOP_WORDS})
    w = words(match_lower(F.coalesce("text", F.lit(""))), GAP)
    split = docs.select("doc_id", w.alias("w"))
    split = split.withColumn("present", F.array_intersect("w", _array(indexed)))
    hits = materialize(split.select("doc_id", F.size("w").cast("long").alias("n_words"), "present", F.when(F.size("present") > 0, F.col("w")).alias("w")))

    counts = hits.select(F.explode("present").alias("word")).groupBy("word").count()
    df = {r["word"]: r["count"] for r in counts.collect()}  # as many rows as the templates have words
    rarest = sorted(indexed, key=lambda x: (df.get(x, 0), x))

    def looked_up(k: int, p: list[str]) -> set[str]:
        """A template's rarest words: without any of them in place less than its least coverage would match."""
        own = [x for x in rarest if x in p]
        if k < len(base):
            return set(own[:1])
        n = min(top, len(own))
        while n < len(own) and len(p) - sum(p.count(x) for x in own[:n]) >= min_coverage * len(p):
            n += 1
        return set(own[:n])

    chosen = [looked_up(k, p) for k, p in enumerate(parts)]
    look = sorted(set().union(*chosen))

    posting = lambda word: F.array(*[F.lit((t << 40) - at + (1 << 20)).cast("long") for t, p in enumerate(parts) for at, x in enumerate(p) if x == word and x in chosen[t]])
    postings = F.create_map(*[x for word in look for x in (F.lit(word), posting(word))])
    slack = [0 if k < len(base) else min(MOST_SLACK, len(p) // WORDS_A_SLACK) for k, p in enumerate(parts)]
    forms = F.array(*[
        F.struct(F.lit(t.label).alias("label"), F.lit(k < len(base)).alias("is_base"), F.lit(slack[k]).alias("slack"), F.lit(1.0 if k < len(base) else min_coverage).alias("least"), _array(parts[k]).alias("words"), _array([f" {x} " for x in t.keys]).alias("keys"))
        for k, t in enumerate(every)
    ])

    # a match has at least so many of its template's looked-up places
    places = [sum(x in c for x in p) for c, p in zip(chosen, parts, strict=True)]
    agree = F.array(*[F.lit(max(1, n - (0 if k < len(base) else len(p) - math.ceil(min_coverage * len(p) - 1e-9)))) for k, (n, p) in enumerate(zip(places, parts, strict=True))])

    x = hits.withColumn("look", F.array_intersect("present", _array(look)))
    at = F.filter(F.transform("w", lambda v, i: F.when(F.array_contains("look", v), i)), lambda i: i.isNotNull())
    named = F.array_sort(F.flatten(F.transform(at, lambda i: F.transform(F.element_at(postings, F.get("w", i)), lambda s: s + i))))

    loose = F.array(*[F.lit(x) for x in slack])

    def agreed(every: Column) -> Column:  # starts that agree lie together: the first of enough of them, each once
        template = lambda s: F.shiftright(s, 40).cast("int")
        enough = lambda s, i: (F.get(every, i + F.get(agree, template(s)) - 1) <= s + F.get(loose, template(s))) & ~F.coalesce(F.get(every, i - 1) == s, F.lit(False))
        return F.filter(F.transform(every, lambda s, i: F.when(enough(s, i), s)), lambda s: s.isNotNull())

    starts = let(named, agreed)
    x = x.withColumn("starts", starts)

    def judged(code: Column) -> Column:
        number, start = F.shiftright(code, 40).cast("int"), (code.bitwiseAND(F.lit((1 << 40) - 1)) - (1 << 20)).cast("int")

        def against(form: Column) -> Column:
            size, beside = F.size(form["words"]), form["slack"]
            there = lambda v, j: F.exists(F.sequence(-beside, beside), lambda d: F.coalesce((start + j + d >= 0) & (F.get("w", start + j + d) == v), F.lit(False)))
            same = F.size(F.filter(F.transform(form["words"], there), lambda ok: ok))
            near = F.concat(F.lit(" "), F.array_join(F.slice("w", F.greatest(start - beside, F.lit(0)) + 1, size + 2 * beside + AFTER), " "), F.lit(" "))
            return F.struct(
                form["label"].alias("label"), form["is_base"].alias("is_base"), start.alias("start"), (same / size).alias("coverage"),
                ((same / size >= form["least"]) & F.forall(form["keys"], lambda key: F.contains(near, key))).alias("ok"),
            )

        return let(F.get(forms, number), against)

    x = x.withColumn("found", F.coalesce(F.filter(F.transform("starts", judged), lambda m: m["ok"]), F.filter(F.transform(F.array().cast("array<bigint>"), judged), lambda m: m["ok"])))
    base_found = F.filter("found", lambda m: m["is_base"])
    labels = lambda those: F.array_join(F.array_sort(F.array_distinct(F.transform(those, lambda m: m["label"]))), ",")
    first = F.array_min(F.transform(base_found, lambda m: m["start"]))
    last = F.array_max(F.transform(base_found, lambda m: m["start"]))
    return x.select(
        "doc_id", "n_words", F.size(base_found).cast("long").alias("n_base"), first.cast("long").alias("first_word"), last.cast("long").alias("last_word"),
        labels(base_found).alias("base_labels"), labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda m: m["coverage"])), F.lit(0.0)).alias("score"),
    )
