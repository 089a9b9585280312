"""Language-model scoring with a log-frequency Bloom filter.

Word and bigram counts of the training documents are quantised on a log scale (level q for counts from 2^(q-1) to
2^q - 1). The filter holds (n-gram, 1) .. (n-gram, q); a lookup probes levels 1, 2, .. until the first miss, at most to
the highest level stored. The filter lies in blocks by n-gram hash. Their number grows with the training text (one per
``BLOCK_BYTES``) and a block has ``LEVEL_BITS`` bits for each level that it holds, so the error rate is the same at every
size, and a task that builds blocks holds one at a time.

Workers get the filter by broadcast if it can be expected to have at most ``broadcast_bytes``. A larger one stays where it
is built: documents are packed where they are read into chunks of about ``CHUNK_BYTES``, which are stored compressed; a
chunk sends its distinct n-grams, in order and with their training counts, to the blocks they belong to, once. Where a block's
n-grams meet, it is built, and every chunk gets back a level (and a word its count) for each n-gram it sent, in the same
order. Both ways give the same levels. Texts are exchanged once, as packed, when they meet the answers.

The probability of word w after v is (low(v w) + k * p(w)) / (high(v) + k), where low and high are the ends of a
level and p(w) = (low(w) + 0.5) / (N + 0.5 (V + 1)); sums over w stay at or below one but for the filter's errors. A
text begins after an end token and ends with one.

The base score needs exact word counts. Beside a filter that is broadcast, the ``table_words`` most frequent words are
broadcast with their counts; the rest reach their documents by a join. Words are told apart by 64-bit hashes.

Defined results: a null text is empty and scores its end token; a null id has crc32 0, so it trains. Rows that repeat
count as often as they occur and score alike. Without training documents all counts are 0. An empty table gives an
empty result. Extra columns are not read. A long text is counted and scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import drop_table, materialize

#: Training text per block of the filter; bits per stored level; probes per level.
BLOCK_BYTES, LEVEL_BITS, PROBES = 1 << 19, 10, 4
BROADCAST_BYTES = 1 << 27
#: Bytes of a filter for a byte of training text (0.17 and 0.18 on sf0.1 and twice as much); decides which way to try first.
FILTER_SHARE = 0.25
#: Text of a chunk, and blocks of the filter (as a power of two) that are built together; tasks take four such sets, or two chunks.
CHUNK_BYTES, SHARD_BLOCKS = 8 << 20, 3
ZSTD = pa.Codec("zstd", 1)
#: Tokens that are counted, n-grams that are held, and bytes of text that are scored at a time.
COUNT_TOKENS, HELD_NGRAMS, SCORE_BYTES, CACHED_WORDS = 1_000_000, 3_000_000, 2_000_000, 200_000
END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def bigram(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a bigram; its lowest bit is 1, that of a single word 0."""
    return _mix(before * _A + (word ^ (word >> np.uint64(17)))) | np.uint64(1)


def single(word: np.ndarray) -> np.ndarray:
    return word & ~np.uint64(1)


class Words(dict):
    """Number of each word, given as it is first met; hashes by number in ``list``. Number 0 is the end token."""

    def __init__(self) -> None:
        self.list: list[int] = []
        self.empty()

    def empty(self) -> None:
        self.clear()
        self["\n"] = 0
        self.list[:] = [int(END) & ~1]

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self.list)
        self.list.append(xxhash.xxh3_64_intdigest(word) & ~1)
        return at

    def numbers(self, text: str | None) -> np.ndarray:
        """Numbers of a text's tokens, the end token last."""
        t = tokens(text)
        t.append("\n")
        return np.fromiter(map(self.__getitem__, t), np.int64, len(t))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts added."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(h, c): partial counts of words and bigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, texts = Words(), []
        runs: list[tuple[np.ndarray, np.ndarray]] = []

        def count() -> None:
            h = np.array(words.list, dtype=np.uint64)[np.concatenate(texts)]
            before = np.concatenate(([END & ~np.uint64(1)], h[:-1]))
            runs.append(np.unique(np.concatenate((single(h), bigram(before, h))), return_counts=True))
            texts.clear()
            words.empty()

        def flush() -> Iterator[pa.RecordBatch]:
            keys, counts = summed(*map(np.concatenate, zip(*runs, strict=True))) if len(runs) > 1 else runs[0]
            runs.clear()
            for at in range(0, len(keys), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 18)].view(np.int64)), pa.array(counts[at : at + (1 << 18)])], names=["h", "c"])

        held = 0
        for b in batches:
            for text in b.column(0).to_pylist():
                texts.append(words.numbers(text))
                held += len(texts[-1])
                if held > COUNT_TOKENS:
                    count()
                    held = 0
                    if sum(len(k) for k, _ in runs) > HELD_NGRAMS:
                        yield from flush()
        if texts:
            count()
        if runs:
            yield from flush()

    return docs.select("text").mapInArrow(run, "h long, c long")


def positions(h: np.ndarray, level: int, bits: np.ndarray) -> Iterator[np.ndarray]:
    """Places of (n-gram, level) in its block of ``bits`` bits (below 2 ** 32)."""
    g = _mix(h + np.uint64(level * int(_A) & 0xFFFFFFFFFFFFFFFF))
    step = (g >> np.uint64(32)) | np.uint64(1)
    for _ in range(PROBES):
        yield (g & np.uint64(0xFFFFFFFF)) * bits >> np.uint64(32)
        g = g + step


def levels(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1]  # 1 for 1, 2 for 2 and 3, 3 for 4 to 7


def build_block(h: np.ndarray, counts: np.ndarray) -> tuple[bytes, int]:
    """A block's bits, ``LEVEL_BITS`` for each level of its n-grams, and its highest level."""
    q = levels(counts)
    bits = 8 * -(-max(64, int(q.sum()) * LEVEL_BITS) // 8)
    flags = np.zeros(bits, bool)
    top = int(q.max(initial=0))
    for level in range(1, top + 1):
        for at in positions(h[q >= level], level, np.uint64(bits)):
            flags[at.astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes(), top


class LogFrequencyFilter:
    """Blocks (number, bits, highest level) by the highest bits of an n-gram's hash, one after the other in ``data``."""

    def __init__(self, blocks: Iterator[tuple[int, bytes, int]], shift: int) -> None:
        self.shift = np.uint64(shift)
        self.top = np.zeros(1 << (64 - shift), dtype=np.uint8)
        self.size = np.full(1 << (64 - shift), 64, dtype=np.uint64)
        self.start = np.zeros(1 << (64 - shift), dtype=np.uint64)
        data = bytearray(8)  # blocks that are not there share eight empty bytes
        for k, part, top in blocks:
            self.size[k], self.start[k], self.top[k] = len(part) * 8, len(data), top
            data += part
        self.data = np.frombuffer(data, np.uint8)

    def level(self, h: np.ndarray) -> np.ndarray:
        """Level of each n-gram hash, 0 if it is not there."""
        block = (h >> self.shift).astype(np.int64) if self.shift < 64 else np.zeros(len(h), np.int64)
        out, alive = np.zeros(len(h), np.int64), np.arange(len(h))
        for level in range(1, int(self.top.max()) + 1):
            alive = alive[self.top[block[alive]] >= level]
            if not len(alive):
                break
            bits, start = self.size[block[alive]], self.start[block[alive]]
            keep = np.ones(len(alive), bool)
            for at in positions(h[alive], level, bits):
                byte = self.data[(start + (at >> np.uint64(3))).astype(np.int64)]
                keep &= (byte >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            alive = alive[keep]
            out[alive] = level
        return out


def _block(shift: int):
    return F.shiftrightunsigned("h", shift).alias("block")


def train(docs: DataFrame, shift: int) -> DataFrame:
    """The written model: rows (block, bits, top) of the filter, and rows (h, c) of the words."""
    counts = count_ngrams(docs)
    names = ["block", "bits", "top", "h", "c"]

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        kinds = {"block": pa.int64(), "bits": pa.binary(), "top": pa.int32(), "h": pa.int64(), "c": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in kinds.items()], names=names)

    def build(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The rows of one block, from its partial counts in order of the hash."""
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        h, c = keys[first], np.add.reduceat(counts, first)
        word = h & np.uint64(1) == 0
        if word.any():
            yield rows(h=h[word].view(np.int64), c=c[word])
        bits, top = build_block(h, c)
        yield rows(block=[int(h[0] >> np.uint64(shift))], bits=[bits], top=[top])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of the block that is being read
        for b in batches:
            h, c = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            block = h >> np.uint64(shift)
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(h)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if held and held[-1][0][-1] >> np.uint64(shift) != block[lo]:
                    yield from build(*map(np.concatenate, zip(*held, strict=True)))
                    held = []
                held.append((h[lo:hi].copy(), c[lo:hi].copy()))
        if held:
            yield from build(*map(np.concatenate, zip(*held, strict=True)))

    dealt = counts.repartition(_block(shift)).sortWithinPartitions("h")  # blocks lie together, as they are the highest bits
    return materialize(dealt.mapInArrow(run, "block long, bits binary, top int, h long, c long"))


def _planes(x: np.ndarray) -> np.ndarray:
    """64-bit numbers as eight planes of bytes: the high bytes of small numbers are runs of zeros, which shuffles compress."""
    return np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).ravel()


def _numbers(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel()


def pack(h: np.ndarray, counts: np.ndarray) -> bytes:
    """Hashes in order, as differences, and their counts, compressed after their number."""
    planes = np.concatenate((_planes(np.diff(h, prepend=np.uint64(0))), _planes(counts))).tobytes()
    return len(h).to_bytes(8, "little") + ZSTD.compress(planes, asbytes=True)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = ZSTD.decompress(data[8:], 16 * int.from_bytes(data[:8], "little"))
    steps, counts = np.frombuffer(planes, np.uint8).reshape(2, -1)
    return np.cumsum(_numbers(steps), dtype=np.uint64), _numbers(counts).astype(np.int64)


def packed(docs: DataFrame) -> DataFrame:
    """(chunk, docs): the rows (doc_id, held_out, text) in chunks of about ``CHUNK_BYTES`` of text, each an Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId() << 32

        def chunk() -> pa.RecordBatch:
            with pa.BufferOutputStream() as out:
                with pa.ipc.new_stream(out, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as stream:
                    for rows in held:
                        stream.write_batch(rows)
                return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["chunk", "docs"])

        part = min(SCORE_BYTES, CHUNK_BYTES)
        for b in in_parts(batches, 2, part):
            held.append(b)
            size += pc.sum(pc.binary_length(b.column(2))).as_py()
            if size >= CHUNK_BYTES - part // 2:
                yield chunk()
                held, size, number = [], 0, number + 1
        if held:
            yield chunk()

    return materialize(docs.select("doc_id", "held_out", "text").mapInArrow(run, "chunk long, docs binary"))


def in_parts(batches: Iterator[pa.RecordBatch], text: int, most: int = SCORE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows with about ``most`` bytes of text at a time."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // most
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(b)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                yield b.slice(lo, hi - lo)


def by_value(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows in order of their first column, cut where it changes: (value, rows); a value's rows may come in several pieces."""
    for b in batches:
        key = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(b)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                yield int(key[lo]), b.slice(lo, hi - lo)


def ngrams(h: np.ndarray) -> np.ndarray:
    """The words and then the bigrams of texts that each end with the end token."""
    return np.concatenate((single(h), bigram(np.concatenate(([END & ~np.uint64(1)], h[:-1])), h)))


def hashes_of(texts: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the texts' tokens, and the number of tokens of each text."""
    numbers = [words.numbers(text) for text in texts]
    h = np.array(words.list, dtype=np.uint64)[np.concatenate(numbers)]
    if len(words) > CACHED_WORDS:
        words.empty()
    return h, np.fromiter(map(len, numbers), np.int64, len(numbers))


def requests(chunks: DataFrame, shard_shift: int) -> DataFrame:
    """(shard, chunk, data): each chunk's distinct n-grams with how often training texts in it have them, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            for chunk, docs in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                runs = []
                for rows in in_parts(pa.ipc.open_stream(docs.as_buffer()), 2):
                    h, size = hashes_of(rows.column(2).to_pylist(), words)
                    weight = np.repeat((~rows.column(1).to_numpy(zero_copy_only=False).astype(bool)).astype(np.int64), size)
                    runs.append(summed(ngrams(h), np.concatenate((weight, weight))))
                    if sum(len(k) for k, _ in runs) > HELD_NGRAMS:
                        runs = [summed(*map(np.concatenate, zip(*runs, strict=True)))]
                keys, counts = summed(*map(np.concatenate, zip(*runs, strict=True)))
                shard = (keys >> np.uint64(shard_shift)).astype(np.int64)
                cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(keys)]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    yield pa.RecordBatch.from_arrays([pa.array([int(shard[lo])]), pa.array([chunk]), pa.array([pack(keys[lo:hi], counts[lo:hi])], pa.binary())], names=["shard", "chunk", "data"])

    return chunks.mapInArrow(run, "shard long, chunk long, data binary")


def answers(asked: DataFrame, shift: int, shards: int) -> DataFrame:
    """(chunk, shard, data, n, v): for each request its n-grams' levels and its words' counts, in order; and for each shard, without
    a chunk, the number of its training tokens and of their distinct words."""
    names = ["chunk", "shard", "data", "n", "v"]

    def answer(shard: int, messages: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        sent = [unpack(data) for _, data in messages]
        h, c = map(np.concatenate, zip(*sent, strict=True))
        ends = np.cumsum([len(k) for k, _ in sent])
        keys, counts = summed(h, c)
        level = np.zeros(len(keys), np.uint8)
        block = (keys >> np.uint64(shift)).astype(np.int64)
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            seen = counts[lo:hi] > 0
            if seen.any():
                held = LogFrequencyFilter(iter([(0, *build_block(keys[lo:hi][seen], counts[lo:hi][seen]))]), 64)
                level[lo:hi] = held.level(keys[lo:hi])
        at = np.searchsorted(keys, h)
        for (chunk, _), lo, hi in zip(messages, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            mine = at[lo:hi]
            data = level[mine].tobytes() + _planes(counts[mine[h[lo:hi] & np.uint64(1) == 0]]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([shard]), pa.array([data], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names=names)
        word = (keys & np.uint64(1) == 0) & (counts > 0)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([shard]), pa.nulls(1, pa.binary()), pa.array([int(counts[word].sum())]), pa.array([int(word.sum())])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, messages = None, []
        for shard, rows in by_value(batches):
            if messages and shard != own:
                yield from answer(own, messages)
                messages = []
            own = shard
            messages += zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True)
        if messages:
            yield from answer(own, messages)

    return asked.repartition(-(-shards // 4), "shard").sortWithinPartitions("shard").mapInArrow(run, "chunk long, shard long, data binary, n long, v long")


def score_by_exchange(keyed: DataFrame, shift: int, prior: float) -> DataFrame:
    """The scores of ``keyed`` (doc_id, text, held_out) where the filter stays in its blocks."""
    total_bytes = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shard_shift = shift + SHARD_BLOCKS
    tasks = max(1, -(-total_bytes // (2 * CHUNK_BYTES)))
    chunks = packed(keyed.coalesce(tasks))
    got = materialize(answers(requests(chunks, shard_shift), shift, 1 << (64 - shard_shift)))
    total = got.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    n, v = int(total["n"]), int(total["v"])
    scale = n + 0.5 * (v + 1)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(replies: list[bytes], docs: pa.BinaryScalar) -> pa.RecordBatch:
        """The documents of one chunk, from the replies to its requests in order of the shards."""
        words, rows = Words(), list(pa.ipc.open_stream(docs.as_buffer()))
        numbers = [words.numbers(text) for b in rows for text in b.column(2).to_pylist()]
        size, t = np.fromiter(map(len, numbers), np.int64, len(numbers)), np.concatenate(numbers)
        hashes = np.array(words.list, dtype=np.uint64)
        h = hashes[t]
        pairs, pair = np.unique(ngrams(h)[len(h) :], return_inverse=True)
        keys = np.sort(np.concatenate((np.unique(hashes), pairs)))
        at_word, at_pair = np.searchsorted(keys, hashes), np.searchsorted(keys, pairs)
        level, counts, at = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), 0
        word = keys & np.uint64(1) == 0
        shard = keys >> np.uint64(shard_shift)
        ends = [*(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(keys)]
        for end, data in zip(ends, replies, strict=True):
            raw = np.frombuffer(data, np.uint8)
            level[at:end] = raw[: end - at]
            counts[at:end][word[at:end]] = _numbers(raw[end - at :]).astype(np.int64)
            at = end
        q, q2, c = level[at_word][t], level[at_pair][pair], counts[at_word][t]
        base, p = token_scores(q, q2, c, q[-1:], scale, prior)  # a text's last token is the end token
        first = np.cumsum(size) - size
        sums = [np.add.reduceat(x, first) for x in ((c > 0).astype(np.int64), base, np.log10(p))]
        doc, held = (pa.concat_arrays([b.column(k) for b in rows]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([doc, held, pa.array(size), pa.array(sums[0]), pa.array(np.full(len(size), n)), *map(pa.array, sums[1:])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replies: list[bytes] = []
        for b in batches:
            for data, docs in zip(b.column(2), b.column(3), strict=True):
                if data.is_valid:
                    replies.append(data.as_py())
                else:  # the documents lie after the replies to their chunk
                    yield score(replies, docs)
                    replies = []

    none = lambda kind: F.lit(None).cast(kind)
    replies = got.where("chunk IS NOT NULL").select("chunk", "shard", "data", none("binary").alias("docs"))
    both = replies.unionByName(chunks.select("chunk", none("long").alias("shard"), none("binary").alias("data"), "docs"))
    both = both.repartition(tasks, "chunk").sortWithinPartitions("chunk", F.col("shard").asc_nulls_last())
    return both.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def token_scores(q: np.ndarray, q2: np.ndarray, c: np.ndarray, after_end: np.ndarray, scale: float, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Each token's base score and probability, from the levels of words and of bigrams, the words' counts and the end token's level."""
    low = lambda x: np.where(x > 0, np.exp2(x - 1.0), 0.0)
    before = np.concatenate((after_end, q[:-1]))
    high = np.where(before > 0, np.exp2(before.astype(float)) - 1, 0.0)
    p = (np.minimum(low(q2), high) + prior * (low(q) + 0.5) / scale) / (high + prior)
    return np.log10((c + 0.5) / scale), p


def score_documents(
    docs: DataFrame, *, held_out: int = 1, modulus: int = 5, broadcast_bytes: int = BROADCAST_BYTES, table_words: int = 1_000_000, prior: float = 40.0, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = docs.sparkSession
    is_held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus, F.lit(0)) == held_out
    text_bytes = docs.where(~is_held).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shift = 64 - max(6, (text_bytes // block_bytes).bit_length())
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), is_held.alias("held_out"))
    if text_bytes * FILTER_SHARE + (16 << (64 - shift)) > broadcast_bytes:
        return score_by_exchange(keyed, shift, prior)
    model = train(docs.where(~is_held), shift)
    words = model.where("h IS NOT NULL").select("h", "c")
    total = model.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("h").alias("v"), F.coalesce(F.sum(F.length("bits")), F.lit(0)).alias("size")).first()
    if total["size"] + (16 << (64 - shift)) > broadcast_bytes:
        drop_table(model)
        return score_by_exchange(keyed, shift, prior)
    n, v = int(total["n"]), int(total["v"])
    scale = n + 0.5 * (v + 1)
    parts = ((r["block"], bytes(r["bits"]), r["top"]) for r in model.where("block IS NOT NULL").select("block", "bits", "top").toLocalIterator())
    lfbf = LogFrequencyFilter(parts, shift)
    most = (words.orderBy(F.desc("c"), "h").limit(table_words) if v > table_words else words).toArrow()
    keys, counts = most.column(0).to_numpy().view(np.uint64), most.column(1).to_numpy()
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((lfbf, keys[order], counts[order]))
    whole = v <= table_words
    del most, lfbf

    def lookup(known: np.ndarray, values: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Value of each hash, 0 for those that are not among the sorted ``known``."""
        if not len(known):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return np.where(known[at] == h, values[at], 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lfbf, known, counts = shared.value
        words = Words()
        hashes, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in in_parts(batches, 3):
            numbers = [words.numbers(text) for text in b.column(3).to_pylist()]
            new = np.array(words.list[len(hashes) :], dtype=np.uint64)
            hashes, count = np.concatenate((hashes, new)), np.concatenate((count, lookup(known, counts, new)))
            size = np.fromiter(map(len, numbers), np.int64, len(numbers))
            first = np.cumsum(size) - size
            t = np.concatenate(numbers)
            h, c = hashes[t], count[t]
            pair = bigram(np.concatenate(([END & ~np.uint64(1)], h[:-1])), h)
            some, place = np.unique(t, return_inverse=True)
            q, q2 = lfbf.level(single(hashes[some]))[place], lfbf.level(pair)
            base, p = token_scores(q, q2, c, lfbf.level(np.array([END & ~np.uint64(1)])), scale, prior)
            base = np.where((c > 0) | whole, base, 0.0)
            sums = [np.add.reduceat(x, first) for x in ((c > 0).astype(np.int64), base, np.log10(p))]
            # words that are not in the table of counts, with how often each text has them
            absent = [np.unique(h[a : a + z][c[a : a + z] == 0], return_counts=True) if not whole else ((), ()) for a, z in zip(first.tolist(), size.tolist(), strict=True)]
            ends = np.cumsum([0, *(len(a) for a, _ in absent)]).astype(np.int32)
            join = lambda k, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind), *(np.asarray(x[k], kind) for x in absent)]).view(np.int64)))  # noqa: E731, B023
            made = [pa.array(size), *map(pa.array, sums), join(0, np.uint64), join(1, np.int64)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *made], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "absent", "times"])
            if len(words.list) > CACHED_WORDS:
                words.empty()
                hashes, count = hashes[:0], count[:0]

    rows = keyed.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    scored = rows.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, absent array<long>, times array<long>")
    out = ["doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"]
    if whole:
        return scored.select(*out)
    scored = materialize(scored)
    rare = scored.select("row", F.explode(F.arrays_zip("absent", "times")).alias("x")).select("row", F.col("x.absent").alias("h"), "x.times")
    found = rare.join(words, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    part = found.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.log10((F.col("c") + 0.5) / F.lit(scale))).alias("more")
    )
    both = scored.drop("absent", "times").join(part, "row", "left")
    both = both.withColumn("n_known", F.col("n_known") + F.coalesce("more_known", F.lit(0))).withColumn("base_score", F.col("base_score") + F.coalesce("more", F.lit(0.0)))
    return both.select(*out)
