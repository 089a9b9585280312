"""Text, time and number expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Markers, separators and rules of the query parser.
VI_MARKERS = ("cảnh", "người", "đang", "sau", "trước", "màu", "bao nhiêu", "ở đâu", "là gì")
SEPARATOR = r"(?i)\s*(?:\s+[-=]>\s+|\b(?:sau đó|sau do|tiếp theo|tiep theo|rồi|roi|kế tiếp|ke tiep|finally|then|next)\b)\s*"
MARKER = r"(?i)\n\s*(?:E(?:VENT)?\s*\d+|\d+[.)]|[-*])[.):\-]?\s+"
ANSWER_TYPES = (
    ("count", ("bao nhiêu", "mấy ", "how many", "number of")),
    ("color", ("màu gì", "màu nào", "what color", "which color")),
    ("person", ("ai ", "là ai", "who ", "whose")),
    ("location", ("ở đâu", "nơi nào", "where ", "which place")),
    ("time", ("khi nào", "lúc nào", "when ", "what time")),
    ("yes_no", ("có phải", "đúng không", "is there", "does ", "did ")),
    ("text", ("ghi gì", "viết gì", "dòng chữ", "what does", "what is written")),
)
HINTS = (
    ("ocr", 2.0, ("ghi gì", "viết gì", "dòng chữ", "biển hiệu", "logo", "ocr")),
    ("asr", 2.0, ("nói gì", "phát biểu", "nghe thấy", "lời thoại", "âm thanh")),
    ("metadata", 1.75, ("tiêu đề", "mô tả video", "kênh", "chương trình")),
    ("objects", 1.5, ("bao nhiêu", "mấy người", "mấy chiếc")),
)


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def _any(x: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(x, F.lit(p))
    return out


def _carriers(marks: str) -> str:
    """The letters whose canonical decomposition has one of ``marks``, and the marks themselves, as a character class."""
    letters = (chr(c) for c in range(0x80, 0x2000) if any(m in unicodedata.normalize("NFD", chr(c)) for m in marks))
    return "[" + "".join(dict.fromkeys((*letters, *marks))) + "]"


#: Fixed value: the marks of Vietnamese vowels (circumflex, breve, horn), alone or under a tone mark, and the letter d with a stroke.
VI_LETTERS = _carriers("\u0302\u0306\u031b")[:-1] + "đĐ]"


def language(x: Column) -> Column:
    low = F.lower(x)
    return F.when(_any(low, VI_MARKERS) | x.rlike(VI_LETTERS), "vi").when(low.rlike("[a-z]"), "en").otherwise("unknown")


def answer_type(x: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, parts in reversed(ANSWER_TYPES):
        out = F.when(_any(F.lower(x), parts), name).otherwise(out)
    return out


def modality_hints(x: Column) -> Column:
    """A map of weight factors by modality: the visual one, and those that the text's words ask for."""
    names, weights = [F.lit("visual")], [F.lit(1.0)]
    for name, weight, parts in HINTS:
        asked = _any(F.lower(x), parts)
        names.append(F.when(asked, F.lit(name)))
        weights.append(F.when(asked, F.lit(weight)))
    present = lambda a: F.filter(F.array(*a), lambda v: v.isNotNull())
    return F.map_from_arrays(present(names), present(weights))


def _trimmed(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^[ ,.;:\n]+|[ ,.;:\n]+$", "")), lambda p: p != "")


def split_events(x: Column) -> Column:
    """Ordered events: the parts that two or more markers at line starts begin, else what lies between connector words;
    null if fewer than two."""
    marked = F.concat(F.lit("\n"), x)
    numbered = F.slice(F.split(marked, MARKER), F.lit(2), F.greatest(F.size(F.split(marked, MARKER)) - 1, F.lit(0)))
    parts = _trimmed(F.when(F.size(numbered) >= 2, numbered).otherwise(F.split(x, SEPARATOR)))
    return F.when(F.size(parts) >= 2, parts)


def qa_parts(x: Column) -> Column:
    """(context, question): the last line if it asks, else the last sentence if it has an answer type, else the text twice."""
    lines = F.filter(F.transform(F.split(x, r"\R"), F.trim), lambda p: p != "")
    sentences = F.split(F.trim(x), r"(?<=[.!?])\s+")
    last_line, last_sentence = F.try_element_at(lines, F.lit(-1)), F.try_element_at(sentences, F.lit(-1))
    before = lambda a, sep: F.array_join(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), sep)
    pair = lambda a, b: F.struct(F.trim(a).alias("context"), F.trim(b).alias("question"))
    asks = F.contains(last_line, F.lit("?")) | answer_type(last_line).isNotNull()
    return F.when((F.size(lines) > 1) & asks, pair(before(lines, " "), last_line)).when((F.size(sentences) > 1) & answer_type(last_sentence).isNotNull(), pair(before(sentences, " "), last_sentence)).otherwise(pair(x, x))


@F.pandas_udf(StringType())
def _compose(texts: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else unicodedata.normalize(f, t) for t, f in zip(texts, form, strict=True)], dtype=object)


def unicode_form(x: Column, form: str = "NFC") -> Column:
    """Unicode normal form, by Arrow batches: Spark has no such function."""
    return _compose(x, F.lit(form))


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


def fold(x: Column) -> Column:
    """Compatibility form and full case folding, by Arrow batches where a text is not ASCII: Spark has no such functions."""
    return F.when(x.rlike(r"^[\x00-\x7F]*$"), F.lower(x)).otherwise(_folded(x))


def normalize_ocr(x: Column) -> Column:
    return F.lower(collapse(unicode_form(x)))


def task_type(x: Column, explicit: Column | None = None) -> Column:
    """The task that is asked for, if any; else what the text suggests."""
    given = F.upper(F.trim(explicit)) if explicit is not None else F.lit(None).cast("string")
    return F.when(given.isin("KIS", "QA", "TRAKE"), given).when(split_events(x).isNotNull(), "TRAKE").when(answer_type(x).isNotNull() | F.contains(x, F.lit("?")), "QA").otherwise("KIS")


def normalize_answer(x: Column) -> Column:
    return collapse(F.regexp_replace(fold(x), r"[\p{P}\p{Z}]", " "))


TOKEN = r"([\p{L}\p{N}_]+)"


def unicode_tokens(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(TOKEN))


def sentence_case(x: Column) -> Column:
    c = collapse(x)
    out = F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2**30))
    return F.when(c == "", "").when(out.rlike("[.!?…]$"), out).otherwise(F.concat(out, F.lit(".")))


def format_timestamp(seconds: Column) -> Column:
    ms = F.round(seconds * 1000).cast("long")
    h, m, s = F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60
    short = F.format_string("%02d:%02d.%03d", m, s, ms % 1000)
    return F.when(h > 0, F.concat(F.format_string("%02d:", h), short)).otherwise(short)


def parse_timestamp(x: Column) -> Column:
    """``HH:MM:SS.fff`` or ``HH:MM:SS:fff`` in seconds to 3 places."""
    part = lambda k: F.regexp_extract(x, r"^(\d+):(\d+):(\d+)(?:[.:](\d+))?$", k)
    fraction = F.when(part(4) != "", part(4).cast("double") / F.pow(F.lit(10.0), F.length(part(4)))).otherwise(0.0)
    return F.when(part(1) != "", F.round(part(1).cast("double") * 3600 + part(2).cast("double") * 60 + part(3).cast("double") + fraction, 3))


def probability(avg_logprob: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(avg_logprob)))


def rational(x: Column) -> Column:
    parts = F.split(x, "/")
    return F.when(F.size(parts) == 2, F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"))).otherwise(x.try_cast("double"))


def normalize_label(x: Column) -> Column:
    """A label in composed form with single spaces."""
    return collapse(unicode_form(x))


def joined_labels(labels: Column) -> Column:
    """Labels that are not blank, joined by a comma and a space."""
    return F.array_join(F.filter(labels, lambda v: F.trim(v) != ""), ", ")


def natural_key(name: Column) -> Column:
    """A sort key that puts numbers inside names in the order of their values: digits without leading zeros, after their count."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"))
    number = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    return F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lit("0"), F.lpad(F.length(number(p)).cast("string"), 6, "0"), number(p))).otherwise(F.concat(F.lit("1"), p)))


def file_stem(path: Column) -> Column:
    """The last part of a path of either kind, without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1), r"(?<=.)\.[^.]*$", "")


def submission_stem(path: Column) -> Column:
    """``query-<number>-kis`` of a query file that is named ``query-<number>-kis`` or, in batches, ``query-p<batch>-<number>-kis``;
    the number without leading zeros. Another name is an error, a null path stays null."""
    stem = file_stem(path)
    number = F.regexp_extract(stem, r"(?i)^query(?:-p\d+)?-(\d+)-kis$", 1)
    stop = F.raise_error(F.concat(F.lit("not the name of a query file: "), stem)).cast("string")
    return F.when(stem.isNull(), F.lit(None)).when(number == "", stop).otherwise(F.concat(F.lit("query-"), F.regexp_replace(number, r"^0+(?=\d)", ""), F.lit("-kis")))


def shifted(spans: Column, offset: Column) -> Column:
    """Spans (text, start, end) of a clip in the time of its video."""
    return F.transform(spans, lambda w: F.struct(w["text"].alias("text"), (w["start"] + offset).alias("start"), (w["end"] + offset).alias("end")))


def retry_delay(attempt: Column, first: float, most: float) -> Column:
    """Seconds to wait before the next attempt: doubled each time, up to ``most``."""
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2.0), attempt - 1))
