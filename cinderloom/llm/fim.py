"""Fill-in-the-middle: texts cut into prefix, middle and suffix at unit boundaries, and put together in another order.

A text is a row of units (runs of ASCII letters, or one other code point each). A byte automaton, held as a table, walks the
UTF-8 bytes once: its state says whether a word runs on and how much of a sentinel has been seen, and each transition emits
what begins or ends there (a code point, a unit, a sentinel). Continuation bytes emit nothing. Texts are dealt into lanes of
equal length that run side by side; a lane starts in the state that the few bytes before it lead to, as no state remembers
more. The first pass counts per lane, the second walks only the lanes that hold a cut.

Defined results: a null text is empty, and an empty text is plain, as is one that holds a sentinel. A null id counts as an
empty string of digits. Rows that repeat are cut alike. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of a lane, and lanes that run side by side.
LANE, LANES = 256, 16_384
#: What transitions emit, added up in one number for a lane.
CHAR, UNIT, MARK = 1, 1 << 10, 1 << 20
PAD = 0xFF  # not a byte of UTF-8: between texts


@cache
def machine(sentinels: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """(next state, emission) by 256 * state + byte, states times 256; and how many bytes a state depends on."""
    marks = [s.encode() for s in sentinels]
    if any(len(m) < 2 or not s.isascii() for m, s in zip(marks, sentinels, strict=True)):
        raise ValueError("sentinels have two ASCII characters or more")
    if len(marks) != 3 or len(set(marks)) != 3 or any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b)) + (a != b))):
        raise ValueError("three sentinels are needed of which none begins as one ends")
    heads = {m[:k] for m in marks for k in range(len(m) + 1)}
    states, following, emitted = [(False, b"")], [], []
    for word, seen in states:  # grows while it is read
        for byte in range(256):
            letter, tail = chr(byte).isascii() and chr(byte).isalpha(), seen + bytes([byte])
            ended = tail in marks
            while tail not in heads or tail in marks:
                tail = tail[1:]
            if (letter, tail) not in states:
                states.append((letter, tail))
            begins = byte != PAD and byte & 0xC0 != 0x80
            following.append(256 * states.index((letter, tail)))
            emitted.append(CHAR * begins + UNIT * (begins and not (letter and word)) + MARK * ended)
    return np.array(following, np.int32), np.array(emitted, np.int32), max(map(len, marks)) - 1


class Lanes:
    """The texts of a batch (one buffer of bytes, with the ends of the texts) as lanes."""

    def __init__(self, flat: np.ndarray, ends: np.ndarray, sentinels: tuple[str, ...]) -> None:
        self.flat, self.ends = flat, ends
        self.following, self.emitted, self.back = machine(sentinels)
        number = -(-np.diff(ends) // LANE)
        self.first = np.concatenate(([0], np.cumsum(number)))  # of each text
        text = np.repeat(np.arange(len(number)), number)
        self.inner = np.arange(self.first[-1]) - self.first[text]
        self.start = ends[text] + LANE * self.inner
        self.length = np.minimum(LANE, ends[text + 1] - self.start)

    def steps(self, lanes: np.ndarray) -> Iterator[np.ndarray]:
        """What each byte of the lanes emits, position by position."""
        lo, span = int(self.start[lanes[0]]), LANE + self.back
        part = np.full(int(self.start[lanes[-1]]) - lo + LANE + self.back, PAD, np.uint8)
        before = min(lo, self.back)
        inside = self.flat[lo - before : lo - self.back + len(part)]
        part[self.back - before : self.back - before + len(inside)] = inside
        rows = np.lib.stride_tricks.sliding_window_view(part, span)[self.start[lanes] - lo]
        rows[self.inner[lanes] == 0, : self.back] = PAD
        short = np.flatnonzero(self.length[lanes] < LANE)
        rows[short] = np.where(np.arange(span) < self.back + self.length[lanes[short], None], rows[short], PAD)
        state = np.zeros(len(lanes), np.int32)
        for k, row in enumerate(np.ascontiguousarray(rows.T)):
            at = state + row
            if k >= self.back:
                yield self.emitted[at]
            state = self.following[at]

    def groups(self, lanes: np.ndarray) -> Iterator[slice]:
        """Lanes in order, so many at once that their bytes stay few, also where they lie far apart."""
        at = 0
        while at < len(lanes):
            far = int(np.searchsorted(self.start[lanes[at : at + LANES]], self.start[lanes[at]] + LANE * LANES))
            yield slice(at, at + max(1, far))
            at += max(1, far)

    def counts(self) -> np.ndarray:
        """First pass: code points, units and sentinels of every lane. Sentinels count where they end."""
        every, out = np.arange(len(self.start)), np.zeros((3, len(self.start)), np.int64)
        for s in self.groups(every):
            total = np.zeros(len(every[s]), np.int32)
            for emitted in self.steps(every[s]):
                total += emitted
            out[:, s] = total & 1023, total >> 10 & 1023, total >> 20
        return out

    def cuts(self, lanes: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Second pass: bytes and code points in each of the lanes before its unit number ``units``."""
        size, chars = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
        for s in self.groups(lanes):
            seen, n, c = (np.zeros(len(lanes[s]), np.int64) for _ in range(3))
            for emitted in self.steps(lanes[s]):
                seen += emitted >> 10 & 1023
                before = seen <= units[s]
                n += before
                c += before & emitted  # a code point is the lowest bit
            size[s], chars[s] = n, c
        return size, chars


def cut_texts(flat: np.ndarray, ends: np.ndarray, one: np.ndarray, two: np.ndarray, sentinels: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Per text: n units, marked (it holds a sentinel), and bytes and code points up to the two cuts, which stand after
    ``one % (n + 1)`` and ``two % (n + 1)`` units, the smaller first."""
    lanes = Lanes(flat, ends, sentinels)
    upto = np.concatenate((np.zeros((3, 1), np.int64), np.cumsum(lanes.counts(), axis=1)), axis=1)
    chars, n, marks = upto[:, lanes.first[1:]] - upto[:, lanes.first[:-1]]
    out = {"n": n, "marked": marks > 0}
    size = np.diff(ends)
    for name, unit in (("a", np.minimum(one % (n + 1), two % (n + 1))), ("b", np.maximum(one % (n + 1), two % (n + 1)))):
        at, count = size.copy(), chars.copy()  # a cut after all units
        inside = np.flatnonzero(unit < n)
        want = upto[1, lanes.first[inside]] + unit[inside]
        lane = np.searchsorted(upto[1], want, side="right") - 1
        more, c = lanes.cuts(lane, want - upto[1, lane])
        at[inside] = LANE * lanes.inner[lane] + more
        count[inside] = upto[0, lane] - upto[0, lanes.first[inside]] + c
        out |= {f"{name}_bytes": at, f"{name}_chars": count}
    return out


def cuts(text: Column, one: Column, two: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """``cut_texts`` of a column of texts: struct of n, marked, a_bytes, a_chars, b_bytes, b_chars."""
    marks = tuple(sentinels)

    @F.arrow_udf("n long, marked boolean, a_bytes long, a_chars long, b_bytes long, b_chars long")
    def run(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_binary())
        offsets, data = texts.buffers()[1:]
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        flat = np.frombuffer(data, np.uint8) if data is not None and len(texts) else np.zeros(0, np.uint8)
        found = cut_texts(flat, ends, one.to_numpy(), two.to_numpy(), marks)
        return pa.StructArray.from_arrays([pa.array(found[k]) for k in COLUMNS], COLUMNS)

    return run(text, one, two)


COLUMNS = ["n", "marked", "a_bytes", "a_chars", "b_bytes", "b_chars"]


def fill_in_middle(
    docs: DataFrame,
    *,
    seed: int = 1,
    plain_percent: int = 10,
    spm_percent: int = 20,
    sentinels: Sequence[str] = SENTINELS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and the output text.

    Cuts and form come from four 32-bit numbers of the SHA-256 of ``seed:doc_id``. Only the cuts come from Python; the pieces
    are cut and joined as bytes by Spark.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = rows.withColumn("_h", F.sha2(name, 256))
    one, two, three, four = (F.conv(F.substring("_h", k, 8), 16, 10).cast("long") for k in (1, 9, 17, 25))
    rows = rows.select("doc_id", "_text", three.alias("_3"), four.alias("_4"), cuts(F.col("_text"), one, two, sentinels).alias("_c"))
    plain = (F.col("_text") == "") | F.col("_c.marked") | (F.col("_3") % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.col("_4") % 100 < spm_percent, "spm").otherwise("psm")
    whole, a, b = F.col("_text").cast("binary"), F.col("_c.a_bytes").cast("int"), F.col("_c.b_bytes").cast("int")
    prefix, middle, suffix = F.substring(whole, F.lit(1), a), F.substring(whole, a + 1, b - a), F.substring(whole, b + 1, F.octet_length("_text") - b)
    p, s, m = (F.lit(x.encode()) for x in sentinels)
    output = (
        F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle))
        .otherwise(whole).cast("string")
    )
    cut = F.col("form") != "plain"
    return rows.withColumn("form", form).select(
        "doc_id", F.col("_c.n").alias("n"), "form", F.when(cut, F.col("_c.a_chars")).alias("prefix_chars"),
        F.when(cut, F.col("_c.b_chars") - F.col("_c.a_chars")).alias("middle_chars"), output.alias("output"),
    )


def restore(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that ``output`` was made of. No piece holds a sentinel, and none can arise where pieces meet."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels))
    first, second, middle = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)
