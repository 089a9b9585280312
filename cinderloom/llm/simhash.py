"""SimHash near-duplicates with BK-trees.

A fingerprint has bit i set if over half of a document's shingle hashes (XXH64, seed 42) have it. Distinct fingerprints
are dealt to shards, one BK-tree each: children hang on their integer Hamming distance to the parent, and a search
with radius r follows only edges from d - r to d + r. A link between fingerprints r bits apart survives in at least
one shard, because the 64 bits are cut into r + 3 blocks and a shard holds the fingerprints that agree on r + 3 - r
= 3 of the blocks. So a search never leaves its shard, and a shard's tree is built and searched where the shard
lies; trees of the whole corpus would have to pass through the driver to be broadcast.

A tree takes each fingerprint once (copies are grouped before) and the search that precedes an insertion gives its
links to the fingerprints already there; a shard returns a spanning forest of its links, never all pairs.

Shards of more than ``shard_rows`` fingerprints are dealt again by blocks of their free bits (two fingerprints that
agree on the shard's blocks still agree on one of r + 1 blocks of the free bits).

``one_of_each`` looks for a stated similarity of shingle sets instead, which differ by about 10 bits at 0.8: far too many
for blocks of bits. Its shards are documents that agree on a band of min-hashes (a pair at 0.8 misses all bands once in
20,000 times); in a shard each set of linked documents has a BK-tree, a document follows the edges within the radius,
and the first neighbour of the similarity links it to that set; if there is none, the set's other documents are compared
too, so that fingerprints only say which come first. Similarities are those of whole shingle sets, shingles
being told apart by 32 bits of their hashes (at 20,000 shingles a similarity is wrong by about 0.000005). Documents of equal shingle sets count as one. Shards of more than ``shard_rows`` are dealt out in blocks, each
with the same few hundred leaders of the shard, so dense groups are joined without a task holding all of one; then all
pairs of blocks of such a shard are compared, less those of one component, each pair as a shard of its own.

Defined results: a null text or one without words has fingerprint zero, linked like any other; a null id is never
the smallest id of a component unless all its ids are null. Rows that repeat give the same result each. An empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .support import document_key, materialize

SEED = 42
BANDS, BAND_ROWS, LEADERS = 14, 3, 100
#: Shingle sets up to so many are held as Python sets, longer ones as arrays.
SET = 512
MASK = 0xFFFFFFFFFFFFFFFF
#: A document of a shard: its id, the number of its shingles, and these as a set (short documents) and in order.
Document = tuple[int, int, frozenset[int] | None, np.ndarray]
#: Odd multipliers: each orders 64-bit hashes anew.
MULTIPLIERS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Unsigned hashes of a text's ``width``-word shingles, repeats included, A-Z in lower case."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, dtype="<u8")
    if len(w) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], dtype="<u8")
    line = b" ".join(w)
    size = np.fromiter(map(len, w), dtype=np.int64, count=len(w))
    start = np.concatenate(([0], np.cumsum(size[:-1] + 1)))
    n = len(w) - width + 1
    stop = start[width - 1 :] + size[width - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(start[:n].tolist(), stop.tolist(), strict=True)), dtype="<u8", count=n)


def majority(h: np.ndarray) -> int:
    """Signed 64-bit fingerprint: the bits that over half the hashes have."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, width: int) -> int:
    """Signed fingerprint of a text; zero without words."""
    return majority(shingle_hashes(text, width))


def band_keys(distinct: np.ndarray) -> list[int]:
    """One signed key per band of min-hashes of a set of hashes; none for an empty set."""
    if not len(distinct):
        return []
    least = np.full(len(MULTIPLIERS), 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(distinct), 4096):
        np.minimum(least, (MULTIPLIERS[:, None] * distinct[None, at : at + 4096]).min(axis=1), out=least)
    return [int.from_bytes(xxhash.xxh64_digest(row.tobytes(), SEED), "big", signed=True) for row in least.reshape(BANDS, BAND_ROWS)]


class BKTree:
    """Fingerprints by Hamming distance. Nodes are (value, children by distance)."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def search(self, value: int, radius: int) -> Iterator[int]:
        stack = [self.root] if self.root else []
        while stack:
            own, children = stack.pop()
            d = (own ^ value).bit_count()
            if d <= radius:
                yield own
            if len(children) <= 2 * radius + 1:
                stack += [c for k, c in children.items() if d - radius <= k <= d + radius]
            else:
                stack += [children[k] for k in range(d - radius, d + radius + 1) if k in children]

    def insert(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            if d == 0:
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = (value, {})
                return
            node = child


def forest(values: Sequence[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct unsigned values, found while a BK-tree grows."""
    tree, parent, out = BKTree(), {}, []

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for v in values:
        parent[v] = v
        for other in tree.search(v, radius):
            a, b = top(other), top(v)
            if a != b:
                parent[b] = a
                out.append((v, other))
        tree.insert(v)
    return out


def _blocks(bits: Sequence[int], n: int) -> list[list[int]]:
    return [list(b) for b in np.array_split(np.array(bits), n)]


def _mask(bits: Sequence[int]) -> int:
    m = sum(1 << int(b) for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def links(prints: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """(a, b): links that join all fingerprints (column ``fp``, distinct) within ``radius`` bits."""
    blocks = _blocks(range(64), radius + 3)
    masks = [(k, [b for i in chosen for b in blocks[i]]) for k, chosen in enumerate(combinations(range(radius + 3), 3))]
    shards = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("part")) for k, bits in masks])
    dealt = materialize(prints.select("fp", F.explode(shards).alias("s")).select("fp", "s.k", "s.part"))
    sizes = dealt.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = dealt.join(sizes, ["k", "part"])
    # large shards go on by blocks of the bits on which they may differ
    finer = F.lit(None).cast("array<struct<j:int,sub:bigint>>")
    for k, bits in masks:
        free = _blocks([b for b in range(64) if b not in set(bits)], radius + 1)
        parts = F.array(*[F.struct(F.lit(j).alias("j"), F.col("fp").bitwiseAND(F.lit(_mask(b))).alias("sub")) for j, b in enumerate(free)])
        finer = F.when(F.col("k") == k, parts).otherwise(finer)
    whole = F.array(F.struct(F.lit(-1).alias("j"), F.lit(0).cast("long").alias("sub")))
    dealt = dealt.withColumn("f", F.explode(F.when(F.col("n") > shard_rows, finer).otherwise(whole))).select("fp", "k", "part", "f.j", "f.sub")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(shard: list[int]) -> pa.RecordBatch | None:
            found = forest(shard, radius) if len(shard) > 1 else []
            if not found:
                return None
            signed = np.array(found, dtype=np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(signed[:, 0]), pa.array(signed[:, 1])], names=["a", "b"])

        last, shard = None, []
        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True))
            for key, fp in zip(keys, b.column(0).to_pylist(), strict=True):
                if key != last:
                    if (out := flush(shard)) is not None:
                        yield out
                    last, shard = key, []
                shard.append(fp & 0xFFFFFFFFFFFFFFFF)
        if (out := flush(shard)) is not None:
            yield out

    keys = ["k", "part", "j", "sub"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(search, "a long, b long")


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t, width) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fp, pa.int64())], names=["doc_id", "_doc", "_th", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *document_key(docs), "text")
    return rows.mapInArrow(run, "doc_id long, _doc long, _th long, fp long")


def members(prints: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """(fp, component, least): every distinct fingerprint, its component's least fingerprint, its first document."""
    nodes = materialize(prints.groupBy("fp").agg(F.min(F.struct("_doc", "_th", "doc_id")).alias("least")))
    found = components(links(nodes.select("fp"), radius, shard_rows))
    joined = nodes.join(found, F.col("fp") == F.col("node"), "left")
    return materialize(joined.select("fp", F.coalesce("component", "fp").alias("component"), "least"))


def near_duplicates(docs: DataFrame, *, width: int = 3, radius: int = 2, shard_rows: int = 1_000) -> DataFrame:
    """(doc_id, fp, component_id) of every document; ``fp`` signed."""
    prints = materialize(fingerprints(docs, width))
    member = members(prints, radius, shard_rows)
    ids = member.groupBy("component").agg(F.min("least").alias("first"))
    ids = member.select("fp", "component").join(ids, "component").select("fp", F.col("first.doc_id").alias("component_id"))
    return prints.select("doc_id", "fp").join(ids, "fp").select("doc_id", "fp", "component_id")


class Linked:
    """A set of linked documents: a BK-tree of their fingerprints, and the documents of each fingerprint."""

    def __init__(self) -> None:
        self.tree, self.documents = BKTree(), {}
        self.size = 0

    def add(self, fp: int, document: Document) -> None:
        self.documents.setdefault(fp, []).append(document)
        self.tree.insert(fp)
        self.size += 1

    def match(self, fp: int, document: Document, radius: int, least: float) -> int | None:
        """Id of some document at ``least`` as similar: those within ``radius`` bits first, then all others."""
        seen = set()
        for near in self.tree.search(fp, radius):
            seen.add(near)
            for other in self.documents[near]:
                if similarity(document, other, least) >= least:
                    return other[0]
        for far, documents in self.documents.items():
            if far not in seen:
                for other in documents:
                    if similarity(document, other, least) >= least:
                        return other[0]
        return None


def document_of(key: int, shingles: bytes) -> Document:
    hashes = np.frombuffer(shingles, "<u4")
    return key, len(hashes), frozenset(hashes.tolist()) if len(hashes) <= SET else None, hashes


def similarity(a: Document, b: Document, least: float = 0.0) -> float:
    """Jaccard similarity of two whole shingle sets; 0 if their sizes alone keep it under ``least``."""
    if min(a[1], b[1]) < least * max(a[1], b[1]):
        return 0.0
    if a[2] is not None and b[2] is not None:
        both = len(a[2] & b[2])
    else:
        both = len(np.intersect1d(a[3], b[3], assume_unique=True))
    return both / max(1, a[1] + b[1] - both)


def similar_forest(shard: Sequence[tuple[int, int, bytes]], radius: int, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the links among (id, unsigned fingerprint, shingles). Each set is searched up to its first link
    alone, so a dense group costs about one comparison a document."""
    sets: list[Linked] = []
    out = []
    for key, fp, shingles in shard:
        document = document_of(key, shingles)
        home, apart = None, []
        for s in sets:
            other = s.match(fp, document, radius, least)
            if other is None:
                apart.append(s)
                continue
            out.append((key, other))
            if home is None:
                home = s
                continue
            home, less = (home, s) if home.size >= s.size else (s, home)
            for value, documents in less.documents.items():
                for x in documents:
                    home.add(value, x)
        home = home or Linked()
        home.add(fp, document)
        sets = [*apart, home]
    return out


def pair_links(shard: Sequence[tuple[int, int, bytes, int]], least: float) -> list[tuple[int, int]]:
    """Links among (id, component, shingles, side) that join components; documents of side 0 and 1
    are compared across, those of side 2 with each other."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sides: list[list[tuple]] = [[], [], []]
    for key, component, shingles, side in shard:
        sides[side].append((component, document_of(key, shingles)))
    out = []
    for k, (component, document) in enumerate(sides[0] or sides[2]):
        for other, earlier in sides[1] if sides[0] else sides[2][:k]:
            if top(component) != top(other) and similarity(document, earlier, least) >= least:
                parent[top(component)] = top(other)
                out.append((document[0], earlier[0]))
    return out


def _searched(dealt: DataFrame, keys: Sequence[str], find: Callable[[list[tuple]], list[tuple[int, int]]]) -> DataFrame:
    """(a, b): what ``find`` returns for the rows of each shard; ``dealt`` has the rows' columns, then ``keys``."""
    width = len(dealt.columns) - len(keys)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(shard: list[tuple]) -> Iterator[pa.RecordBatch]:
            if found := find(shard) if len(shard) > 1 else []:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

        last, shard = None, []
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            rows = zip(*columns[:width], strict=True)
            for row, key in zip(rows, zip(*columns[width:], strict=True), strict=True):
                if key != last:
                    yield from flush(shard)
                    last, shard = key, []
                shard.append(row)
        yield from flush(shard)

    return dealt.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(search, "a long, b long")


def similar_links(nodes: DataFrame, least: float, radius: int, shard_rows: int) -> DataFrame:
    """(a, b): links that join all shingle sets (columns ``node``, ``fp``, ``bands``, ``shingles``) of similarity ``least``."""
    dealt = nodes.select("node", F.posexplode("bands").alias("k", "part"))
    sizes = materialize(dealt.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    blocks = F.ceil(F.col("n") / shard_rows).cast("int")
    own = F.pmod(F.xxhash64("node", "k"), blocks).cast("int")
    leader = F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("n")) < LEADERS
    block = F.when(F.col("n") <= shard_rows, F.array(F.lit(0))).when(leader, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))
    blocked = dealt.join(sizes, ["k", "part"]).select("node", "k", "part", F.explode(block).alias("block"))
    blocked = blocked.join(nodes.select("node", "fp", "shingles"), "node").select("node", "fp", "shingles", "k", "part", "block")
    found = _searched(blocked, ["k", "part", "block"], lambda shard: similar_forest([(n, fp & MASK, s) for n, fp, s in shard], radius, least))
    crowded = sizes.where(F.col("n") > shard_rows)
    if crowded.isEmpty():
        return found
    found = materialize(found)
    return found.unionByName(links_across(nodes, dealt.join(crowded, ["k", "part"]), components(found), least, shard_rows))


def links_across(nodes: DataFrame, crowded: DataFrame, member: DataFrame, least: float, shard_rows: int) -> DataFrame:
    """(a, b): links in the shards ``crowded`` (node, k, part) between documents that are not of one component yet.
    Components of a shard lie in blocks, those of more than ``shard_rows`` in blocks of their own; all pairs of blocks
    are compared, each as a shard, but for two blocks of one component."""
    rows = crowded.select("node", "k", "part").join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = materialize(rows)
    held = materialize(rows.groupBy("k", "part", "component").agg(F.count(F.lit(1)).alias("n")))
    small = held.where(F.col("n") <= shard_rows).groupBy("k", "part").agg(F.sum("n").alias("rest"))
    cuts = F.when(F.col("n") > shard_rows, F.ceil(F.col("n") / shard_rows)).otherwise(F.ceil(F.col("rest") / shard_rows)).cast("long")
    held = materialize(held.join(small, ["k", "part"], "left").select("k", "part", "component", (F.col("n") > shard_rows).alias("large"), cuts.alias("cuts")))
    number = F.pmod(F.xxhash64(F.when(F.col("large"), F.col("node")).otherwise(F.col("component"))), F.col("cuts"))
    rows = rows.join(held, ["k", "part", "component"])
    rows = materialize(rows.select("node", "k", "part", "component", F.struct(F.when(F.col("large"), F.col("component")).alias("of"), number.alias("no")).alias("block")))
    blocks = rows.select("k", "part", "block").distinct()
    pairs = blocks.withColumnRenamed("block", "x").join(blocks.withColumnRenamed("block", "y"), ["k", "part"])
    one = F.coalesce(F.col("x.of") == F.col("y.of"), F.lit(False))
    pairs = materialize(pairs.where((F.col("x") <= F.col("y")) & ~one))
    same = F.array(F.struct(F.col("x").alias("block"), F.lit(2).alias("side")))
    both = F.array(F.struct(F.col("x").alias("block"), F.lit(0).alias("side")), F.struct(F.col("y").alias("block"), F.lit(1).alias("side")))
    asked = pairs.select("k", "part", "x", "y", F.explode(F.when(F.col("x") == F.col("y"), same).otherwise(both)).alias("s")).select("k", "part", "x", "y", "s.block", "s.side")
    dealt = rows.join(asked, ["k", "part", "block"]).join(nodes.select("node", "shingles"), "node")
    keys = ["k", "part", "xo", "xn", "yo", "yn"]
    dealt = dealt.select("node", "component", "shingles", "side", "k", "part", F.col("x.of").alias("xo"), F.col("x.no").alias("xn"), F.col("y.of").alias("yo"), F.col("y.no").alias("yn"))
    return _searched(dealt, keys, lambda shard: pair_links(shard, least))


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(node, least, fp, bands, shingles): every distinct shingle set, by its hash, with its first document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for text in b.column(2).to_pylist():
                h = shingle_hashes(text, width)
                distinct = np.unique(h)
                shingles = np.unique((distinct >> np.uint64(32)).astype("<u4")).tobytes()
                node = int.from_bytes(xxhash.xxh64_digest(distinct.tobytes(), SEED), "big", signed=True)
                rows.append((node, majority(distinct), band_keys(distinct), shingles))
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *made], names=["_doc", "_th", "node", "fp", "bands", "shingles"])

    rows = docs.select(*document_key(docs), "text").mapInArrow(run, "_doc long, _th long, node long, fp long, bands array<long>, shingles binary")
    first = rows.groupBy("node").agg(F.min(F.struct("_doc", "_th", "fp", "bands", "shingles")).alias("x"))
    return first.select("node", F.struct("x._doc", "x._th").alias("least"), "x.fp", "x.bands", "x.shingles")


def one_of_each(docs: DataFrame, *, width: int = 5, least: float = 0.8, radius: int = 20, shard_rows: int = 1_000) -> DataFrame:
    """The documents less all but the first of every component of documents linked by a similarity of ``least``; columns
    stay as they are."""
    nodes = materialize(shingle_sets(docs, width))
    found = components(similar_links(nodes, least, radius, shard_rows))
    member = nodes.select("node", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = member.groupBy("component").agg(F.min("least").alias("first")).select(F.col("first._doc").alias("_doc"), F.col("first._th").alias("_th"))
    rows = docs.select(*document_key(docs), *[F.col(c).alias(f"_keep_{c}") for c in docs.columns])
    kept = rows.join(first, ["_doc", "_th"], "left_semi").dropDuplicates(["_doc", "_th"])
    return kept.select(*[F.col(f"_keep_{c}").alias(c) for c in docs.columns])
