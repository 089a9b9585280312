"""Reader of transcript files in two schemas, with strict types.

The canonical schema names a ``video_id`` and a ``model_name`` at its root, the legacy one a ``source_video``, its
``pipeline_config`` and its ``audio_info``; roots tell which it is. Both give the same documents and segments.

Defined results: a document with anything wrong gives no rows but its first problem, and one problem a segment; null texts
are ``not_json``. Texts that only clean to nothing fall back to the raw text; words may be empty. Empty tables give empty
results. Columns beside ``value`` are carried along; those named like a result column are refused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variants as V
from ..functions.text import file_stem

CANONICAL, LEGACY = ("video_id", "model_name"), ("source_video", "pipeline_config", "audio_info")
#: Seconds by which a word may leave its segment, and a segment its file.
TOLERANCE = 0.05
DOCUMENT = ("video_id", "model_name", "language", "language_probability", "duration", "source_path", "created_at")
SEGMENT = ("position", "segment_id", "start", "end", "text", "avg_logprob", "no_speech_prob", "confidence", "words")
Checks = list[tuple[Column, str]]


class Fields:
    """Getters of one schema's objects that note what is wrong with what they get."""

    def __init__(self, value: Column) -> None:
        self.value, self.checks = value, []

    def get(self, path: str, read: Callable[[Column], Column], *, nullable: bool = False, needed: bool = True, ok: Callable[[Column], Column] | None = None) -> Column:
        """The value at ``path``, which must be there if ``needed``, be of the kind that ``read`` takes (or null) and pass ``ok``."""
        raw, name = V.at(self.value, path), path.rsplit(".", 1)[-1]
        got = read(raw)
        if needed:
            self.checks.append((raw.isNull(), f"missing_{name}"))
        wrong = got.isNull() if ok is None else got.isNull() | ~ok(got)
        self.checks.append(((~V.absent(raw) if nullable else raw.isNotNull()) & wrong, f"bad_{name}"))
        return got


def _filled(c: Column) -> Column:
    return F.trim(c) != ""


def _positive(c: Column) -> Column:
    return c >= 0


def _share(c: Column) -> Column:
    return c.between(0, 1)


def _document(v: Column, legacy: bool) -> tuple[Column, Checks]:
    f = Fields(v)
    if legacy:
        source = f.get("source_video", V.string, ok=_filled)
        values = {
            "video_id": F.nullif(file_stem(source), F.lit("")), "model_name": f.get("pipeline_config.asr_model", V.string, ok=_filled),
            "language": f.get("audio_info.detected_language", V.string, nullable=True, ok=_filled), "language_probability": f.get("audio_info.language_probability", V.number, nullable=True, ok=_share),
            "duration": f.get("audio_info.duration_sec", V.number, nullable=True, ok=_positive), "source_path": source, "created_at": f.get("generated_at", V.string, needed=False, ok=_filled),
        }
        f.checks.append((source.isNotNull() & values["video_id"].isNull(), "bad_source_video"))
    else:
        values = {
            "video_id": f.get("video_id", V.string, ok=_filled), "model_name": f.get("model_name", V.string, ok=_filled), "language": f.get("language", V.string, nullable=True, ok=_filled),
            "language_probability": f.get("language_probability", V.number, nullable=True, ok=_share), "duration": f.get("duration_seconds", V.number, nullable=True, ok=_positive),
            "source_path": f.get("source_path", V.string, nullable=True, needed=False, ok=_filled), "created_at": f.get("created_at", V.string, needed=False, ok=_filled),
        }
    f.get("segments", V.items)
    return F.struct(*[c.alias(n) for n, c in values.items()]), f.checks


def _words(raw: Column, legacy: bool) -> Column:
    """Structs (text, start, end, confidence, code) of an array of words; null if it is none."""

    def word(w: Column) -> Column:
        f = Fields(w)
        f.checks.append((V.members(w).isNull(), "bad_word"))
        text, start, end = f.get("word" if legacy else "text", V.string), f.get("start", V.number, ok=_positive), f.get("end", V.number, ok=_positive)
        confidence = f.get("probability" if legacy else "confidence", V.number, nullable=True, needed=False, ok=_share)
        return F.struct(text.alias("text"), start.alias("start"), end.alias("end"), confidence.alias("confidence"), V.first_code(*f.checks).alias("code"))

    return F.transform(V.items(raw), word)


def _segment(s: Column, legacy: bool) -> Column:
    f, none = Fields(s), F.lit(None).cast("double")
    f.checks.append((V.members(s).isNull(), "bad_segment"))
    number = f.get("segment_id", V.integer, ok=_positive)
    inner = "audio_metadata." if legacy else ""
    start, end = (f.get(("time_range." if legacy else "") + x, V.number, ok=_positive) for x in ("start", "end"))
    if legacy:
        clean, raw = f.get("audio_metadata.clean_text", V.string), f.get("audio_metadata.raw_text", V.string)
        text = F.when(F.trim(clean) != "", F.trim(clean)).otherwise(F.trim(raw))
    else:
        text = f.get("text", V.string)
    loose = {c: f.get(inner + c, V.number, nullable=True, needed=False, ok=_share) for c in ("no_speech_prob", "confidence")}
    logprob = none if legacy else f.get("avg_logprob", V.number, nullable=True, needed=False)
    words = V.at(s, inner + "words")
    found = F.when(words.isNull(), F.array().cast("array<struct<text:string,start:double,end:double,confidence:double,code:string>>")).otherwise(_words(words, legacy))
    return F.struct(
        number.alias("segment_id"), start.alias("start"), end.alias("end"), text.alias("text"), logprob.alias("avg_logprob"), loose["no_speech_prob"].alias("no_speech_prob"),
        loose["confidence"].alias("confidence"), found.alias("words"), V.first_code(*f.checks, (words.isNotNull() & found.isNull(), "bad_words")).alias("code"),
    )


def _code_among(segments: Column, ids: Column) -> Callable[[Column, Column], Column]:
    """What is wrong with a segment beside those before it, and with its words."""

    def code(s: Column, k: Column) -> Column:
        before = F.get(segments, k - 1)
        word = F.get(F.filter(s["words"], lambda w: w["code"].isNotNull()), F.lit(0))["code"]
        late = F.array_contains(F.transform(s["words"], lambda w, i: F.get(s["words"], i - 1)["start"] > w["start"]), True)
        outside = F.exists(s["words"], lambda w: (w["start"] < s["start"] - TOLERANCE) | (w["end"] > s["end"] + TOLERANCE))
        same = F.array_position(ids, s["segment_id"]) <= k
        return F.coalesce(s["code"], V.first_code(
            (same, "duplicate_segment_id"), (s["end"] < s["start"], "reversed_time"), (before["start"] > s["start"], "unordered_segment"), (word.isNotNull(), "bad_word"),
            (F.exists(s["words"], lambda w: w["end"] < w["start"]), "reversed_word"), (late, "unordered_words"), (outside, "word_outside"),
        ))

    return code


def transcripts(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (.., schema, video_id, model_name, language, language_probability, duration, source_path, created_at) of files
    (.., value); their segments (.., video_id, position, segment_id, start, end, text, avg_logprob, no_speech_prob,
    confidence, words of text, start, end and confidence); and problems (.., position, code), position -1 for a document's."""
    keys = [c for c in files.columns if c != "value"]
    if clash := sorted(set(keys) & {*DOCUMENT, *SEGMENT, "schema", "code"}):
        raise ValueError(f"columns that the reader makes itself: {', '.join(clash)}")
    d = V.computed(files.select(*keys, "value"), {"v": F.try_parse_json("value")}).drop("value")
    d = V.computed(d, {"m": V.members(F.col("v"))})
    has = lambda names: F.arrays_overlap(F.map_keys("m"), F.array(*[F.lit(n) for n in names]))
    d = d.withColumn("schema", F.when(has(CANONICAL) & has(LEGACY), "mixed").when(has(CANONICAL), "canonical").when(has(LEGACY), "legacy"))
    v, legacy = F.col("v"), F.col("schema") == "legacy"
    (old, old_checks), (new, new_checks) = _document(v, True), _document(v, False)
    code = F.when(v.isNull(), "not_json").when(F.col("m").isNull(), "not_an_object").when(F.col("schema").isNull(), "unsupported_schema").when(F.col("schema") == "mixed", "mixed_schema")
    code = code.when(legacy, V.first_code(*old_checks)).otherwise(V.first_code(*new_checks))
    listed = V.items(V.at(v, "segments"))
    segments = F.when(legacy, F.transform(listed, lambda s: _segment(s, True))).otherwise(F.transform(listed, lambda s: _segment(s, False)))
    d = V.computed(d, {"d": F.when(legacy, old).otherwise(new), "code": code, "s": segments}).drop("v", "m")
    d = V.computed(d, {"ids": F.transform("s", lambda s: s["segment_id"])})
    among = _code_among(F.col("s"), F.col("ids"))
    beyond = lambda s: V.first_code((s["end"] > F.col("d.duration") + TOLERANCE, "beyond_duration"))
    d = V.computed(d, {"codes": F.when(F.col("code").isNull(), F.transform("s", lambda s, k: F.coalesce(among(s, k), beyond(s))))})
    d = V.computed(d, {"whole": F.col("code").isNull() & ~F.exists("codes", lambda c: c.isNotNull())})
    bad = d.where("code IS NOT NULL").select(*keys, F.lit(-1).alias("position"), "code")
    bad = bad.unionByName(d.where("code IS NULL AND NOT whole").select(*keys, F.posexplode("codes").alias("position", "code")).where("code IS NOT NULL"))
    good = d.where("whole")
    rows = good.select(*keys, F.col("d.video_id").alias("video_id"), F.posexplode("s").alias("position", "x"))
    bare = F.transform("x.words", lambda w: w.dropFields("code"))
    rows = rows.select(*keys, "video_id", "position", *[F.col(f"x.{c}").alias(c) for c in SEGMENT[1:-1]], bare.alias("words"))
    return good.select(*keys, "schema", *[F.col(f"d.{c}").alias(c) for c in DOCUMENT]), rows, bad
