"""Removal of repeated passages by longest-previous-factor arrays over suffix order.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (smaller document, or same document and
earlier start); what is first stays. The suffix array of the corpus is never in one place. It is cut into pieces that
do not depend on each other:

1. Every string of ``length`` bytes has an anchor, its least ``GRAM``-byte gram by hash. Equal strings have equal
   anchors, so all comparisons stay among strings with the same anchor gram. Neighbouring strings share anchors: a
   document of n bytes has about 2 n / (length - GRAM + 2) of them, each with the stretch of strings that it owns.
2. Stretches that equal each other whole (128 bits: anchor and content) are grouped where they are read, then by anchor: all
   but the first are known to be later copies. Anchors that occur once are done.
3. The different stretches of a common anchor form one group. Its suffixes (to ``length`` bytes) are sorted; from the
   suffix array and the common prefixes of neighbours, the previous and next smaller positions in suffix order give
   each suffix its longest previous factor. Where that reaches ``length``, the string is a later copy.

Anchors with very many different stretches are dealt again by the content of each string. A task reads the stretches of an
anchor, and the strings of a content, in pieces of ``PIECE_ROWS`` rows, so it never holds all of a frequent one.

Defined results: a null text counts as empty; null ids sort last; rows that repeat id and text are one document and
get the same result; other texts with the same id (or without one) are documents of their own, in the order of a 64-bit
hash. Texts of any length are read, in windows. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import materialize

LENGTH, GRAM = 100, 40
#: Bytes of text whose strings are compared at a time where they are read.
BATCH_BYTES = 1 << 21
#: Different stretches of an anchor above which its strings are dealt by content.
WIDE_GROUP = 1_000
_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)
_BYTES = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
#: Rows of one anchor or content that a task holds at a time.
PIECE_ROWS = 1_000_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def suffix_array(strings: Sequence[bytes]) -> tuple[list[int], list[int]]:
    """Order of the suffixes and the common prefix of each with the one before it."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    lcp = [0]
    for a, b in zip(order, order[1:], strict=False):
        x, y = strings[a], strings[b]
        if x == y:
            lcp.append(len(x))
            continue
        n = min(len(x), len(y))
        differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
        lcp.append(n - (differ.bit_length() + 7) // 8)
    return order, lcp


def previous_factors(order: Sequence[int], lcp: Sequence[int]) -> list[int]:
    """Longest previous factor of each position: the greater of the common prefixes with the previous and the next
    smaller position in suffix order, found with one stack."""
    n = len(order)
    lpf = [0] * n
    stack: list[tuple[int, int]] = []  # (position, common prefix with the entry below)
    for rank in range(n + 1):
        at, common = (order[rank], lcp[rank]) if rank < n else (-1, 0)
        while stack and stack[-1][0] > at:
            # below on the stack: previous smaller position; the one that arrives: next smaller position
            top, with_previous = stack.pop()
            lpf[top] = max(with_previous, common)
            common = min(with_previous, common)
        stack.append((at, common))
    for at, common in stack:
        if at >= 0:
            lpf[at] = max(lpf[at], common)
    return lpf


def stretches(texts: Sequence[bytes], length: int) -> dict[str, np.ndarray]:
    """Anchor hash, content hash, text number, start and count of the strings of every stretch."""
    w = length - GRAM + 1
    buf = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    n = len(buf)
    if n < length:
        return {k: np.zeros(0, np.uint64 if k in "hx" else np.int64) for k in "hxtan"}
    start = np.cumsum(size) - size
    inverse = _powers(_INVERSE, n + 1)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[buf] * _powers(_ODD, n))))
    gram = _mix((prefix[GRAM:] - prefix[:-GRAM]) * inverse[: n - GRAM + 1])
    low = np.uint64((1 << 27) - 1)  # more than the bytes of a batch
    least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    have = 1
    while have < w:  # least of w neighbours by doubling
        add = min(have, w - have)
        least = np.minimum(least[:-add], least[add:])
        have += add
    strings = n - length + 1
    ends = np.repeat(start + size, size)[:strings]
    valid = np.arange(strings) + length <= ends
    anchor = (least[:strings] & low).astype(np.int64)
    new = np.ones(strings, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    a = np.flatnonzero(valid & new)
    stop = np.flatnonzero(valid & np.concatenate((new[1:] | ~valid[1:], [True])))
    count = stop - a + 1
    h = gram[anchor[a]]
    x = _mix((prefix[stop + length] - prefix[a]) * inverse[a]) + _mix(h + (count.astype(np.uint64) << np.uint64(32)) + (anchor[a] - a).astype(np.uint64))
    t = np.searchsorted(start, a, side="right") - 1
    # empty texts share their start with the next one
    return {"h": h, "x": _mix(x), "t": t, "a": a - start[t], "n": count}


#: Anchor hash, content hash, document (id, hash of the text), place, number of strings; a negative number is a range to remove.
FLOW = "h long, x long, doc long, th long, pos long, n int"
_FLOW = pa.schema([("h", pa.int64()), ("x", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("pos", pa.int64()), ("n", pa.int32())])


def _flow(h, x, doc, th, pos, n) -> pa.RecordBatch:
    columns = [np.asarray(c).astype(np.int64, copy=False) if np.asarray(c).dtype != np.uint64 else np.asarray(c).view(np.int64) for c in (h, x, doc, th, pos)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.asarray(n).astype(np.int32))], schema=_FLOW)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _merged(doc: np.ndarray, th: np.ndarray, pos: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges (doc, th, pos, size) with overlapping ones of a document joined."""
    if not len(doc):
        return doc, th, pos, size
    order = np.lexsort((pos, th, doc))
    doc, th, pos, size = doc[order], th[order], pos[order], size[order]
    # a running maximum of ends: texts do not meet, as each is shifted by its number
    local = pos + np.cumsum(_changes(doc, th)) * np.int64(1 << 41)
    reach = np.maximum.accumulate(size + local)
    at = np.flatnonzero(np.concatenate(([True], local[1:] > reach[:-1])))
    last = np.concatenate((at[1:] - 1, [len(pos) - 1]))
    return doc[at], th[at], pos[at], reach[last] - local[at]


def _range_rows(doc, th, pos, size) -> pa.RecordBatch:
    """Ranges to remove, as rows with a negative count that travel along under a hash of their own."""
    doc, th, pos, size = _merged(*(np.asarray(c, np.int64) for c in (doc, th, pos, size)))
    return _flow(_mix(doc.view(np.uint64) + th.view(np.uint64) + pos.view(np.uint64)), np.zeros(len(doc), np.int64), doc, th, pos, -size)


def _later(keys: Sequence[np.ndarray], doc: np.ndarray, th: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (keys, doc, th, pos); which rows start a key, and which lie after the first row of their key."""
    order = np.lexsort((pos, th, doc, *reversed(keys)))
    if not len(order):
        return order, np.zeros(0, bool), np.zeros(0, bool)
    first = _changes(*(k[order] for k in keys))
    lead = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    later = np.zeros(len(order), bool)
    for c in (doc[order], th[order], pos[order]):
        later |= c != c[lead]
    return order, first, later


def read_stretches(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            h, x, doc, th, pos, n = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order, first, later = _later((h, x), doc, th, pos)
            keep, gone = order[first], order[later]
            yield _flow(h[keep], x[keep], doc[keep], th[keep], pos[keep], n[keep])
            yield _range_rows(doc[gone], th[gone], pos[gone], n[gone] + length - 1)

        def add(texts: list[tuple[bytes, int, int, int]]) -> int:
            s = stretches([t[0] for t in texts], length)
            doc, th, base = (np.array([t[k] for t in texts], np.int64)[s["t"]] for k in (1, 2, 3))
            held.append((s["h"], s["x"], doc, th, base + s["a"], s["n"]))
            return len(doc)

        rows = 0
        for b in batches:
            texts: list[tuple[bytes, int, int, int]] = []
            size = 0
            for d, th, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                # windows overlap by all but one byte of a string, so that each string starts in one of them
                for at in range(0, len(raw) - length + 1, BATCH_BYTES):
                    window = raw[at : at + BATCH_BYTES + length - 1]
                    texts.append((window, d, th, at))
                    size += len(window)
                    if size > BATCH_BYTES:
                        rows += add(texts)
                        texts, size = [], 0
                        if rows > 4_000_000:
                            yield from flush()
                            rows = 0
            if texts:
                rows += add(texts)
        yield from flush()

    return docs.mapInArrow(run, FLOW)


def _in_groups(batches: Iterator[pa.RecordBatch], least: int, most: int) -> Iterator[tuple[pa.Table, bool]]:
    """Sorted batches dealt again in tables of at least ``least`` rows, which end with a value of the first column; True marks
    a table that ends inside one, since that has more than ``most`` rows."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not len(b):
            continue
        if rows >= least:
            other = b.column(0).to_numpy() != held[-1].column(0)[-1].as_py()
            cut = int(other.argmax()) if other.any() else len(b)
            if cut < len(b):
                held.append(b.slice(0, cut))
                yield pa.Table.from_batches(held), False
                held, rows, b = [], 0, b.slice(cut)
            elif rows >= most:
                yield pa.Table.from_batches(held), True
                held, rows = [], 0
        held.append(b)
        rows += len(b)
    if held:
        yield pa.Table.from_batches(held), False


def group_stretches(read: DataFrame, length: int, wide_group: int, piece_rows: int) -> DataFrame:
    """Ranges of whole copies (n < 0), and the different stretches (x: 1, or 2 in a wide group) of common anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_anchor = None  # of a group that is read in pieces: it counts as wide
        for t, more in _in_groups(batches, min(200_000, piece_rows), piece_rows):
            h, x, doc, th, pos, n = (t.column(k).to_numpy() for k in range(6))
            split = [v for v in (open_anchor, h[-1] if more else None) if v is not None]
            open_anchor = h[-1] if more else None
            ready = n < 0
            yield _flow(h[ready], x[ready] * 0, doc[ready], th[ready], pos[ready], n[ready])
            h, x, doc, th, pos, n = (c[~ready] for c in (h, x, doc, th, pos, n))
            order, first, later = _later((h, x), doc, th, pos)
            gone, keep = order[later], order[first]
            yield _range_rows(doc[gone], th[gone], pos[gone], n[gone] + length - 1)
            h, doc, th, pos, n = h[keep], doc[keep], th[keep], pos[keep], n[keep]
            _, place, count = np.unique(h, return_inverse=True, return_counts=True)
            wide = (count[place] > wide_group) | np.isin(h, split)
            some = (count[place] > 1) | wide
            yield _flow(h[some], np.where(wide[some], 2, 1), doc[some], th[some], pos[some], n[some])

    return read.repartition("h").sortWithinPartitions("h", "x", "doc", "th", "pos").mapInArrow(run, FLOW)


def later_strings(groups: list[tuple[int, int, int, int, bytes]], length: int) -> list[tuple[int, int, int]]:
    """(doc, th, pos) of the strings of one group's stretches (doc, th, pos, n, content) that have an earlier equal string."""
    groups.sort(key=lambda g: g[:3])
    where, strings = [], []
    for doc, th, pos, n, content in groups:
        where += [(doc, th, pos + k) for k in range(n)]
        strings += [content[k : k + length] for k in range(n)]
    return [at for at, factor in zip(where, previous_factors(*suffix_array(strings)), strict=True) if factor >= length]


def remove_repeats(
    docs: DataFrame, *, length: int = LENGTH, wide_group: int = WIDE_GROUP, piece_rows: int = PIECE_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): ``kept`` is what is left of the text, as bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # both joins below read the same columns of rows: then Spark exchanges the texts once for the two
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"), F.col(id_col).alias("doc_id"))
    found = materialize(group_stretches(read_stretches(rows.select("doc", "th", "text"), length), length, wide_group, piece_rows))
    wanted = found.where("n > 0").groupBy("doc", "th").agg(F.collect_list(F.struct("h", "x", "pos", "n")).alias("wanted"))
    joined = rows.join(wanted, ["doc", "th"]).select("doc", "th", "text", "wanted", "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*_FLOW, ("content", pa.binary())])
        for b in batches:
            whole: list[tuple] = []
            wide: list[tuple] = []
            for doc, th, text, wanted in zip(*(c.to_pylist() for c in b.columns[:4]), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for s in wanted:
                    a = s["pos"]
                    content = raw[a : a + s["n"] + length - 1]
                    if s["x"] == 1:
                        whole.append((s["h"], 0, doc, th, a, s["n"], content))
                    else:
                        wide += [(xxhash.xxh3_64_intdigest(x := content[k : k + length], s["h"] & (2**64 - 1)) - (1 << 63), 0, doc, th, a + k, 1, x) for k in range(s["n"])]
            out = whole
            if wide:
                key, doc, th, pos = (np.array([w[k] for w in wide], np.int64) for k in (0, 2, 3, 4))
                order, first, later = _later((key,), doc, th, pos)
                out = whole + [wide[k] for k in order[first]]
                late = order[later]
                gone = _range_rows(doc[late], th[late], pos[late], np.full(len(late), length))
                yield pa.RecordBatch.from_arrays([*gone.columns, pa.nulls(len(gone), pa.binary())], schema=schema)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    content = joined.mapInArrow(cut, FLOW + ", content binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None  # hash and content of the first string of a group that is read in pieces
        for t, more in _in_groups(batches, min(5_000, piece_rows), piece_rows):
            h, _, doc, th, pos, n, text = (t.column(k).to_pylist() for k in range(7))
            gone = [(doc[j], th[j], pos[j], -n[j]) for j in range(len(h)) if n[j] < 0]
            k = 0
            while k < len(h):
                stop = k
                while stop < len(h) and h[stop] == h[k]:
                    stop += 1
                some = [j for j in range(k, stop) if n[j] > 0]
                if some and ((more and stop == len(h)) or (first and first[0] == h[k])):
                    # only equal strings make so large a group; the first one stays
                    begun = first is not None and first[0] == h[k]
                    first = first if begun else (h[k], text[some[0]], (doc[some[0]], th[some[0]], pos[some[0]]))
                    gone += [(doc[j], th[j], pos[j], length) for j in some if text[j] == first[1] and (doc[j], th[j], pos[j]) != first[2]]
                elif len(some) > 1:
                    seen = {(doc[j], th[j], pos[j], n[j], text[j]) for j in some}  # a row that repeats is no earlier copy
                    gone += [(*at, length) for at in later_strings(list(seen), length)]
                k = stop
            yield _range_rows(*(np.array([g[k] for g in gone], np.int64) for k in range(4)))

    ranges = content.repartition("h").sortWithinPartitions("h", "doc", "th", "pos").mapInArrow(compare, FLOW)
    ranges = ranges.select("doc", "th", "pos", "n").unionByName(found.where("n < 0").select("doc", "th", "pos", "n"))
    per_text = ranges.groupBy("doc", "th").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("a"), (-F.col("n")).alias("size")))).alias("gone"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        for b in batches:
            out = []
            for text, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                parts, end, spans, removed = [], 0, 0, 0
                for g in gone or ():
                    a, z = g["a"], g["a"] + g["size"]
                    if a > end or not spans:
                        spans += 1
                        parts.append(raw[end:a])
                        removed += z - a
                    elif z > end:
                        removed += z - end
                    end = max(end, z)
                parts.append(raw[end:])
                kept = b"".join(parts)
                out.append((len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([o[k] for o in out], t) for k, t in enumerate(types)]], names=names)

    last = rows.join(per_text, ["doc", "th"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "gone")
    return last.mapInArrow(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
