"""Byte-level BPE encoding and decoding.

A text is cut before every space that a character other than white space follows; no match of the tokenizer's pattern
crosses such a cut (the pattern lets a word begin with one space). Words are the matches of the pattern in these chunks.
Each distinct word of the corpus is encoded once, by Spark higher-order functions that fold ranked merges over the
word's byte array. The state of the fold is one number a part: its id, and the rank of the pair that it makes with the
next part; a step merges the leftmost pair of least rank and looks up the two new pairs. The rank map is literal: pairs
of ids lie in one array, each in a slot that no other pair has (perfect hashing by shifted buckets), and an entry names
its pair, so that a look-up needs one slot. Its size is the vocabulary's.

Documents then take their words' ids from a word table. The ``table_words`` most frequent words are broadcast (hash,
place, ids: bounded by that parameter and ``TABLE_IDS`` ids a word); a document that holds other words gets them by a
join, and no other document takes part in that. Decoding concatenates the binary pieces of the ids.

Words longer than ``LONG_WORD`` bytes are merged by a heap over linked parts, since the fold copies the parts at every
step; both give the same ids.

Defined results: a null text counts as empty, with no ids. Rows that repeat give the same result each. An empty table
gives an empty result. Extra columns are not read. A text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import let, materialize

LONG_WORD = 256
TABLE_WORDS, TABLE_IDS = 4_000_000, 64
WORDS_A_TASK = 50_000
PLAN_CHARS = 100_000
#: Chunks that a worker counts, and those whose ids it keeps, before it begins anew.
COUNTED, CACHED = 600_000, 500_000
#: A space before white space or the end: there, cutting at every space would cut a match.
UNSAFE = re.compile(r" (?:\s|\Z)")
CUT = regex.compile(r" (?=\S)")
#: Ids have at most so many bits; an entry is left id, right id and merged id.
ID_BITS = 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def perfect_table(entries: dict[int, int]) -> tuple[list[int], list[int], int]:
    """Shifts by bucket (key modulo their number), slots, and ``size``: a key lies at key modulo ``size`` plus the shift of
    its bucket, as (key, value) packed. No two keys share a slot."""
    count, size = _prime(len(entries) // 3 + 11), _prime(len(entries) * 4 // 3 + 101)
    buckets: dict[int, list[int]] = {}
    for key in entries:
        buckets.setdefault(key % count, []).append(key)
    shifts, taken = [0] * count, bytearray(4 * size)
    slots = [(1 << 61)] * len(taken)
    last = 0
    for bucket, keys in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
        places = [k % size for k in keys]
        if len(set(places)) < len(places):
            raise ValueError("two pairs of the vocabulary cannot be told apart")
        shift = 0
        while any(taken[x + shift] for x in places):
            shift += 1
        shifts[bucket] = shift
        for key, x in zip(keys, places, strict=True):
            taken[x + shift] = 1
            slots[x + shift] = (key << ID_BITS) + entries[key]
            last = max(last, x + shift)
    return shifts, slots[: max(last + 1, size + max(shifts))], size


class RankMap:
    """The ranked merges as literal columns."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ids = max(ranks.values()) + 1
        if self.ids >> ID_BITS or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary must hold every byte, and ids below 2 ** 20")
        entries = {}
        for piece, rank in ranks.items():
            for k in range(1, len(piece)):
                left, right = ranks.get(piece[:k]), ranks.get(piece[k:])
                if left is not None and right is not None:
                    entries[(left << ID_BITS) + right] = rank
        shifts, slots, self.size = perfect_table(entries)
        self.buckets = len(shifts)
        literal = lambda items, kind: F.from_json(F.lit("[" + ",".join(map(str, items)) + "]"), f"array<{kind}>")
        # constant expressions: the optimizer folds them into one literal each
        self.tables = F.struct(
            literal(shifts, "int").alias("shifts"), literal(slots, "bigint").alias("slots"), literal([ranks[bytes([b])] << ID_BITS for b in range(256)], "bigint").alias("bytes")
        )
        #: Words that are pieces but that merging does not lead to; they keep their own id.
        self.own = {w: r for w, r in ranks.items() if merge_long(w, ranks, whole=False) != [r]}

    def encode(self, word: Column) -> Column:
        """Ids of a binary word of a byte or more: merges by rank, leftmost first. The tables stand in the plan once."""
        return let(self.tables, lambda tables: self._encode(word, tables))

    def _encode(self, word: Column, tables: Column) -> Column:
        """A part is (rank of its pair with the next part, own id, 0), ``ID_BITS`` bits each. An id beyond all others stands at
        either end, so that every pair has neighbours."""
        no_rank, own_id = 1 << ID_BITS, ((1 << ID_BITS) - 1) << ID_BITS

        def part(own: Column, after: Column) -> Column:  # own: the id, shifted; after: the id that follows
            key = own + after
            entry = F.get(tables["slots"], (key % self.size).cast("int") + F.get(tables["shifts"], (key % self.buckets).cast("int")))
            rank = F.least(entry.bitwiseXOR(F.shiftleft(key, ID_BITS)), F.lit(no_rank))
            return F.shiftleft(rank, 2 * ID_BITS) + own

        letters = F.split(F.decode(word, "ISO-8859-1"), "")
        edge = F.lit(self.ids << ID_BITS)
        ids = F.concat(F.array(edge), F.transform(letters, lambda c: F.get(tables["bytes"], F.ascii(c))), F.array(edge))
        start = let(ids, lambda own: F.transform(own, lambda x, i: part(x, F.shiftright(F.coalesce(F.get(own, i + 1), edge), ID_BITS))))

        def step(parts: Column, _: Column) -> Column:
            def merge(i: Column) -> Column:  # i: place of the part, from 1, whose pair has the least rank
                one = F.shiftright(F.get(parts, i - 1), 2 * ID_BITS)
                before = F.get(parts, i - 2).bitwiseAND(F.lit(own_id))
                after = F.shiftright(F.get(parts, i + 1).bitwiseAND(F.lit(own_id)), ID_BITS)
                merged = F.concat(F.slice(parts, F.lit(1), i - 2), F.array(part(before, one), part(F.shiftleft(one, ID_BITS), after)), F.slice(parts, i + 2, F.size(parts)))
                return F.when(one < no_rank, merged).otherwise(parts)

            return let(F.array_position(parts, F.array_min(parts)).cast("int"), merge)

        steps = F.slice(letters, F.lit(2), F.size(letters))  # n letters merge n - 1 times at most
        merged = let(F.aggregate(steps, start, step), lambda p: F.transform(F.slice(p, F.lit(2), F.size(p) - 2), lambda x: F.shiftright(x.bitwiseAND(F.lit(own_id)), ID_BITS).cast("int")))
        for w, rank in self.own.items():
            merged = F.when(word == F.lit(w), F.array(F.lit(rank))).otherwise(merged)
        return merged


def merge_long(word: bytes, ranks: dict[bytes, int], whole: bool = True) -> list[int]:
    """Ids of a long word in O(n log n): a heap of (rank, place) over linked parts."""
    if whole and word in ranks:
        return [ranks[word]]
    n = len(word)
    end, prev, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or ranks.get(word[i : end[j]]) != r:
            continue
        end[i], after[i], alive[j] = end[j], after[j], False
        if after[i] < n:
            prev[after[i]] = i
            if (x := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (x, i))
        if prev[i] >= 0 and (x := ranks.get(word[prev[i] : end[i]])) is not None:
            heapq.heappush(heap, (x, prev[i]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def chunks(text: str) -> list[str]:
    """The chunks of a text. One that follows a cut stands without its space; the first has a space put before it, which
    tells it from those."""
    out = CUT.split(text) if UNSAFE.search(text) else text.split(" ")
    if out[0]:
        out[0] = " " + out[0]
    else:
        del out[0]
    return out


def text_of(chunk: str) -> str:
    return chunk[1:] if chunk[0] == " " else " " + chunk


def words_of(batch: list[str], find) -> tuple[list[bytes], np.ndarray]:
    """The matches of the pattern in all chunks, one after the other, and how many each chunk has; a list for each chunk would
    keep Python's collector busy. Chunks without a space are searched together: there, a match that begins with a space
    begins a chunk."""
    spaced = [i for i, c in enumerate(batch) if " " in c]
    plain = [c for c in batch if " " not in c] if spaced else batch
    found = [w.encode("utf-8", "surrogatepass") for w in find(" " + " ".join(plain))] if plain else []
    begins = np.append(np.flatnonzero(np.fromiter((w[0] == 32 for w in found), bool, len(found))), len(found))
    if not spaced:
        return found, np.diff(begins)
    words, sizes, done = [], np.zeros(len(batch), np.int64), 0
    sizes[np.delete(np.arange(len(batch)), spaced)] = np.diff(begins)
    for k, i in enumerate(spaced):  # i - k plain chunks stand before
        own = [w.encode("utf-8", "surrogatepass") for w in find(text_of(batch[i]))]
        words += found[done : begins[i - k]]
        words += own
        sizes[i], done = len(own), begins[i - k]
    return words + found[done:], sizes


def distinct_words(docs: DataFrame, text_col: str, pattern: str) -> DataFrame:
    """(word binary, c): every match of the pattern in all documents, counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        counted: Counter[str] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            found: dict[bytes, int] = {}
            keys, counts = list(counted), list(counted.values())
            counted.clear()
            for at in range(0, len(keys), 50_000):
                group, sizes = words_of(keys[at : at + 50_000], find)
                for word, c in zip(group, np.repeat(counts[at : at + 50_000], sizes).tolist(), strict=True):
                    found[word] = found.get(word, 0) + c
            del keys, counts
            words, counts = list(found), list(found.values())
            for at in range(0, len(words), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 100_000], pa.binary()), pa.array(counts[at : at + 100_000], pa.int64())], names=["word", "c"])

        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    counted.update(chunks(text))
                    if len(counted) > COUNTED:
                        yield from flush()
        yield from flush()

    return docs.select(F.col(text_col)).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def word_table(docs: DataFrame, text_col: str, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(word, c, ids) of every distinct word, written to the shared folder."""
    spark = docs.sparkSession
    # the literal rank map would stand in the description of every plan, which the driver keeps
    if spark.conf.get("spark.sql.maxPlanStringLength", None) is None:
        spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_CHARS))
    words = materialize(distinct_words(docs, text_col, pattern))
    short = words.where(F.length("word") <= LONG_WORD)
    parts = max(spark.sparkContext.defaultParallelism * 2, words.count() // WORDS_A_TASK)
    encoded = short.repartition(parts, "word").withColumn("ids", RankMap(ranks).encode(F.col("word")))
    shared = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [merge_long(w, shared.value) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["word", "c", "ids"])

    long = words.where(F.length("word") > LONG_WORD).mapInArrow(run, "word binary, c long, ids array<int>")
    return materialize(encoded.select("word", "c", "ids").unionByName(long))


def pack(table: DataFrame, kind: str) -> DataFrame:
    """Words and their ids as (hashes, sizes, ids) bytes per batch, in order of the hashes."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, b.column(0).to_pylist()), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([pa.array((h ^ np.uint64(1 << 63)).view(np.int64)), b.column(1)], names=["h", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = b.column(0).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
            sizes = np.diff(b.column(1).offsets.to_numpy()).astype(np.uint8)
            parts = [hashes.tobytes(), sizes.tobytes(), b.column(1).flatten().to_numpy().astype(kind).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], names=["hashes", "sizes", "ids"])

    return table.select("word", "ids").mapInArrow(hashed, "h long, ids array<int>").orderBy("h").mapInArrow(run, "hashes binary, sizes binary, ids binary")


class PackedTable:
    """Words by hash: sorted hashes, and where each word's ids end."""

    def __init__(self, packed: DataFrame, kind: str) -> None:
        hashes, sizes, ids = bytearray(), bytearray(), bytearray()
        for r in packed.toLocalIterator():
            hashes += r["hashes"]
            sizes += r["sizes"]
            ids += r["ids"]
        self.hashes, self.ids = np.frombuffer(hashes, np.uint64), np.frombuffer(ids, kind)
        self.end = np.cumsum(np.frombuffer(sizes, np.uint8), dtype=np.uint32)

    def get(self, words: list[bytes], sizes: np.ndarray) -> list[bytes | None]:
        """Ids of each group of words (``sizes``: how many words each has) as little-endian 32-bit integers, None for groups with
        a word that is not here."""
        if not len(self.hashes):
            return [None] * len(sizes)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        last = np.cumsum(sizes)
        k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        end = self.end[k].astype(np.int64)
        size = end - np.where(k > 0, self.end[k - 1], 0)
        absent = np.concatenate(([0], np.cumsum(self.hashes[k] != h)))[np.concatenate(([0], last))]
        # the ids of all words in one string of bytes, then cut
        stop = np.cumsum(size)
        flat = self.ids[np.repeat(end - stop, size) + np.arange(int(stop[-1]) if len(stop) else 0)].astype("<u4").tobytes()
        cuts = np.concatenate(([0], stop))[np.concatenate(([0], last))] * 4
        return [flat[a:z] if whole else None for a, z, whole in zip(cuts[:-1].tolist(), cuts[1:].tolist(), (np.diff(absent) == 0).tolist(), strict=True)]


def encode_documents(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    *,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    with_ids: bool = False,
    table_words: int = TABLE_WORDS,
) -> DataFrame:
    """Per document the columns ``keep``, n_tokens, ids_sha256 and decoded_sha256; with ``with_ids`` also the ids
    (little-endian 32-bit integers) as binary ``ids`` and the decoded text as binary ``decoded``."""
    spark: SparkSession = docs.sparkSession
    ranks = load_ranks(ranks_path)
    kind = "<u2" if max(ranks.values()) < 1 << 16 else "<u4"
    table = word_table(docs, text_col, ranks, pattern)
    shared = table.where(F.size("ids") <= TABLE_IDS)
    held, every = shared.count(), table.count()
    if held > table_words:
        shared = shared.orderBy(F.desc("c"), "word").limit(table_words)
    packed = spark.sparkContext.broadcast(PackedTable(pack(shared, kind), kind))
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    vocabulary = spark.sparkContext.broadcast(pieces)
    at = len(keep)
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(("ids", "decoded") if with_ids else ())]
    types = [pa.int64(), pa.string(), pa.string(), *((pa.binary(), pa.binary()) if with_ids else ())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (keep.., text, more); words that neither the table nor ``more`` has come out as ``_missing``."""
        find, known, vocab = regex.compile(pattern).findall, packed.value, pa.array(vocabulary.value, pa.binary())
        cache: dict[str, bytes] = {}  # ids of chunks
        one = np.ones(1, np.int64)

        def row(ids: bytes) -> tuple:
            numbers = np.frombuffer(ids, "<u4")
            spelled = hashlib.sha256()
            decoded = []
            for k in range(0, len(numbers), 1 << 20):
                found = vocab.take(pa.array(numbers[k : k + (1 << 20)]))
                if len(found):  # the pieces lie one after the other in the array's buffer
                    text = memoryview(found.buffers()[2])[: int(np.frombuffer(found.buffers()[1], np.int32)[len(found)])]
                    spelled.update(text)
                    if with_ids:
                        decoded.append(bytes(text))
            return len(numbers), hashlib.sha256(ids).hexdigest(), spelled.hexdigest(), *((ids, b"".join(decoded)) if with_ids else ())

        for whole in batches:
            for lo in range(0, len(whole), 256):
                b = whole.slice(lo, 256)
                cut = [chunks(t) if t else [] for t in b.column(at).to_pylist()]
                taken = [list(map(cache.get, parts)) for parts in cut]
                gaps = [[i for i, ids in enumerate(row_ids) if ids is None] for row_ids in taken]
                new = list({parts[i] for parts, at_gaps in zip(cut, gaps, strict=True) for i in at_gaps})
                if len(cache) + len(new) > CACHED:
                    cache.clear()
                words, sizes = words_of(new, find)
                found = known.get(words, sizes)
                cache.update((c, ids) for c, ids in zip(new, found, strict=True) if ids is not None)
                ends = np.cumsum(sizes)
                rare = {new[i]: words[ends[i] - sizes[i] : ends[i]] for i, ids in enumerate(found) if ids is None}
                made, missing = [], []
                for parts, ids, at_gaps, more in zip(cut, taken, gaps, b.column(at + 1).to_pylist(), strict=True):
                    extra = {x["word"]: np.array(x["ids"], dtype="<u4").tobytes() for x in more or ()}
                    absent = {}
                    for i in at_gaps:
                        c = parts[i]
                        if c not in rare:
                            ids[i] = cache[c]
                            continue
                        if c not in absent:
                            absent[c] = b"".join(known.get([w], one)[0] or extra.get(w, b"") for w in rare[c])
                        ids[i] = absent[c]
                    if absent and more is None:
                        made.append((None,) * len(types))
                        missing.append(list(dict.fromkeys(w for c in absent for w in rare[c])))
                    else:
                        made.append(row(b"".join(ids)))
                        missing.append(None)
                columns = [pa.array([m[k] for m in made], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*b.columns[:at], *columns, pa.array(missing, pa.list_(pa.binary())), b.column(at + 2)], names=[*keep, *names, "_missing", "_key"])

    rows = docs.select(*keep, F.coalesce(text_col, F.lit("")).alias("_text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    tail = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded binary" if with_ids else "")
    schema = f"{head}, {tail}, _missing array<binary>, _key string"
    no_more = F.lit(None).cast("array<struct<word:binary,ids:array<int>>>").alias("_more")
    if every == held and held <= table_words:
        return rows.select(*keep, "_text", no_more, F.lit(None).cast("string").alias("_key")).mapInArrow(run, schema).drop("_missing", "_key")
    # documents with words that are not broadcast get those by a join
    first = materialize(rows.select(*keep, "_text", no_more, F.sha2("_text", 256).alias("_key")).mapInArrow(run, schema))
    asked = first.where("_missing IS NOT NULL").select("_key", F.explode("_missing").alias("word")).distinct()
    more = asked.join(table.select("word", "ids"), "word").groupBy("_key").agg(F.collect_list(F.struct("word", "ids")).alias("_more"))
    again = rows.withColumn("_key", F.sha2("_text", 256)).join(more, "_key").select(*keep, "_text", "_more", "_key").mapInArrow(run, schema)
    return first.where("_missing IS NULL").unionByName(again).drop("_missing", "_key")
