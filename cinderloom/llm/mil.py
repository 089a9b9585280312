"""Quality classifier by attention-based multiple-instance learning: a document is a bag of passages with one label.

A text is cut into passages of about ``PASSAGE`` bytes, as equal as they come. Every passage is encoded by counts of byte classes,
shapes and lengths of its words and repetition; a learned layer turns that into its representation. Gated attention (the
product of a tanh and a sigmoid layer) weighs the passages of a document, and the score is read off the weighted sum.

The model is fitted on a bounded sample: about ``max_docs`` labelled documents that are not held out, of ``max_bytes`` bytes at most,
chosen by a hash of their id. Labels of an id that contradict each other, and null labels, are not used. Labels, languages,
sources and ids are no inputs of a score. All documents are scored, whole.

Defined results: a null or empty text is one passage without words. Rows that repeat get the same score. A null id is not held
out and has no label. Without labels of both kinds every score is 0.5. An empty table gives an empty result. Other columns
are not looked at.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a passage; a longer text is worked off in blocks of ``BLOCK`` passages.
PASSAGE, BLOCK = 512, 2048
HIDDEN, GATE = 32, 16
#: Byte classes: each ASCII sign by itself, then lower case, upper case, digits, spaces, line ends, control, lead and continuation bytes.
SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]
LOW, HIGH, DIGIT, SPACE, LINE, CONTROL, LEAD, MORE = range(len(SIGNS), len(SIGNS) + 8)
CLASSES = len(SIGNS) + 8
WORD_STATS = 10
FEATURES = CLASSES + WORD_STATS + 3


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind, space = np.full(256, CONTROL, np.int64), np.zeros(256, bool)
    for b in range(256):
        letter = chr(b) if b < 128 else ""
        kind[b] = SIGNS.index(b) if b in SIGNS else LOW if letter.islower() else HIGH if letter.isupper() else DIGIT if letter.isdigit() else kind[b]
    kind[[32, 9]], kind[[10, 13]], kind[128:192], kind[192:] = SPACE, LINE, MORE, LEAD
    space[[32, 9, 10, 11, 12, 13]] = True
    odd = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return kind, space, odd


KIND, IS_SPACE, ODD = _tables()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _seen(keys: np.ndarray) -> np.ndarray:
    """Which keys came before."""
    out = np.ones(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = False
    return out


def encode_bytes(flat: np.ndarray, text: np.ndarray, passage: np.ndarray, number: int) -> np.ndarray:
    """Features of ``number`` passages but for the last three; ``text`` and ``passage`` name those of each byte, both ascending."""
    out = np.zeros((number, FEATURES), np.float32)
    size = np.maximum(np.bincount(passage, minlength=number), 1)
    out[:, :CLASSES] = np.bincount(passage * CLASSES + KIND[flat], minlength=number * CLASSES).reshape(number, CLASSES) / size[:, None]
    inside = ~IS_SPACE[flat]
    if not inside.any():
        return out
    fresh = np.concatenate(([True], text[1:] != text[:-1]))
    begins = inside & (fresh | ~np.concatenate(([False], inside[:-1])))
    start = np.flatnonzero(begins)
    at = np.flatnonzero(inside)
    word = np.cumsum(begins[at]) - 1
    inner = at - start[word]
    letters = flat[at].astype(np.uint64) + np.uint64(1)
    h = _mixed(np.add.reduceat(letters * ODD[inner & 255] + (inner >> 8).astype(np.uint64), np.flatnonzero(begins[at])))
    length = np.bincount(word)
    upper = np.bincount(word, weights=KIND[flat[at]] == HIGH)
    lower = np.bincount(word, weights=KIND[flat[at]] == LOW)
    of, doc = passage[start], text[start]
    words = np.bincount(of, minlength=number)
    same = np.concatenate(([False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])))
    salt = _mixed(doc.astype(np.uint64) + np.uint64(1))
    three = h.copy()
    three[2:] = _mixed(_mixed(h[2:] + np.uint64(3) * h[1:-1]) + np.uint64(5) * h[:-2])
    stats = [
        length / 10, (length / 10) ** 2, length <= 3, length >= 13, KIND[flat[start]] == HIGH, (upper > 1) & (lower == 0), same,
        _seen(h ^ _mixed(of.astype(np.uint64))), _seen(h ^ salt), _seen(three ^ salt),
    ]
    for k, s in enumerate(stats):
        out[:, CLASSES + k] = np.bincount(of, weights=s, minlength=number) / np.maximum(words, 1)
    out[:, -3] = np.log1p(words)
    return out


def encode(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(texts so far, features of the passages of the next ones), by groups of texts of together about a block; a longer
    text comes alone. What is told to repeat came earlier in the text, in the same block."""
    at = 0
    while at < len(texts):
        upto, room = at + 1, PASSAGE * BLOCK - len(texts[at])
        while upto < len(texts) and len(texts[upto]) <= room:
            room -= len(texts[upto])
            upto += 1
        size = np.array([len(t) for t in texts[at:upto]])
        number = np.maximum(1, -(-size // PASSAGE))
        width = np.maximum(1, -(-size // number))
        number = np.maximum(1, -(-size // width))
        first = np.concatenate(([0], np.cumsum(number)))
        if len(size) == 1:
            step, parts = int(width[0]) * BLOCK, []
            for lo in range(0, max(1, int(size[0])), step):
                flat = np.frombuffer(texts[at], np.uint8)[lo : lo + step]
                passage = np.arange(len(flat)) // int(width[0])
                parts.append(encode_bytes(flat, np.zeros(len(flat), np.int64), passage, max(1, -(-len(flat) // int(width[0])))))
            out = np.concatenate(parts)
        else:
            text = np.repeat(np.arange(len(size)), size)
            inner = np.arange(len(text)) - (np.cumsum(size) - size)[text]
            out = encode_bytes(np.frombuffer(b"".join(texts[at:upto]), np.uint8), text, first[text] + inner // width[text], int(first[-1]))
        owner = np.repeat(np.arange(len(size)), number)
        out[:, -2] = np.log1p(size)[owner]
        out[:, -1] = (np.arange(len(owner)) - first[owner]) / number[owner]
        yield number, out
        at = upto


class GatedAttention:
    """The network; parameters are named as in the formulas of ``forward``."""

    def __init__(self, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        shapes = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": ()}
        self.p = {k: (rng.standard_normal(s) * (0.0 if k in "bd" else 1 / np.sqrt(s[0]))).astype(np.float64) for k, s in shapes.items()}
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)

    def forward(self, x: np.ndarray, first: np.ndarray, owner: np.ndarray) -> dict[str, np.ndarray]:
        """Bags are consecutive rows of ``x``; ``first`` has where each begins, ``owner`` the bag of each row."""
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, first)[owner])
        a = e / np.add.reduceat(e, first)[owner]
        z = np.add.reduceat(a[:, None] * h, first)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "score": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))}

    def gradient(self, f: dict[str, np.ndarray], y: np.ndarray, first: np.ndarray, owner: np.ndarray) -> dict[str, np.ndarray]:
        p, h, t, s, a = self.p, f["h"], f["t"], f["s"], f["a"]
        dl = (f["score"] - y) / len(y)
        dz = (dl[:, None] * p["c"])[owner]
        da = (dz * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, first)[owner])
        dg = de[:, None] * p["w"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"W": f["x"].T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": f["z"].T @ dl, "d": dl.sum()}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, *, epochs: int = 60, batch: int = 64, rate: float = 4e-3, decay: float = 1e-3, seed: int = 1) -> GatedAttention:
        """Adam over shuffled batches of bags, with decaying steps and weights."""
        rows = np.concatenate(bags)
        self.mean, self.scale = rows.mean(axis=0), np.maximum(rows.std(axis=0), 1e-3)
        rng, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        total = epochs * -(-len(bags) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for lo in range(0, len(order), batch):
                chosen, step = order[lo : lo + batch], step + 1
                number = np.array([len(bags[k]) for k in chosen])
                first, owner = np.cumsum(number) - number, np.repeat(np.arange(len(number)), number)
                g = self.gradient(self.forward(np.concatenate([bags[k] for k in chosen]), first, owner), labels[chosen], first, owner)
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    change = m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8) + decay * self.p[k] * (k not in "bd")
                    self.p[k] = self.p[k] - rate * (1 - step / total) * change
        return self


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def _bags(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(first row, rows, passages of each, features) by groups of rows of a batch."""
    for b in batches:
        at = 0
        for number, x in encode([t or b"" for t in b.column(column).cast(pa.large_binary()).to_pylist()]):
            yield at, len(number), number, x, b
            at += len(number)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_docs: int = 4000,
    max_bytes: int = 1 << 16,
) -> GatedAttention:
    """The model of a bounded sample of the labelled documents that are not held out, fitted in one task."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
    known = known.agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_most")).where((F.col("_y") == F.col("_most")) & ~held_out(F.col("_id")))
    share = min(1.0, max_docs / max(1, known.count()))
    chosen = known.where((F.xxhash64("_id") / 2.0**64 + 0.5) < share).select("_id", "_y").limit(2 * max_docs)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).where(F.octet_length("_text") <= max_bytes)
    rows = rows.join(F.broadcast(chosen), "_id").select("_id", F.col("_y").cast("int").alias("y"), "_text")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, n, number, x, b in _bags(batches, 2):
            parts = np.split(x, np.cumsum(number)[:-1])
            yield pa.RecordBatch.from_arrays([*(c.slice(at, n) for c in b.columns[:2]), pa.array([p.tobytes() for p in parts], pa.binary())], names=["id", "y", "x"])

    def neutral() -> GatedAttention:
        model = GatedAttention()
        model.p["c"] = np.zeros(HIDDEN)
        return model

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({(r["id"], r["x"], r["y"]) for b in batches for r in b.to_pylist()})
        y = np.array([r[2] for r in rows], np.float64)
        model = GatedAttention().fit([np.frombuffer(r[1], np.float32).reshape(-1, FEATURES) for r in rows], y) if len(set(y)) == 2 else neutral()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    sample = rows.mapInArrow(encoded, "id long, y int, x binary").limit(2 * max_docs)
    made = sample.repartition(1).mapInArrow(fitted, "model binary").first()  # none if there is no row at all
    return pickle.loads(made["model"]) if made else neutral()


def score_documents(docs: DataFrame, model: GatedAttention, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, and the passage of the greatest weight: its number and weight."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, n, number, x, b in _bags(batches, 2):
            first, owner = np.cumsum(number) - number, np.repeat(np.arange(n), number)
            f = shared.value.forward(x, first, owner)
            best = np.lexsort((np.arange(len(owner)), -f["a"], owner))[first]
            made = [f["score"], (f["score"] >= threshold).astype(np.int32), number.astype(np.int64), (best - first).astype(np.int64), f["a"][best]]
            yield pa.RecordBatch.from_arrays([*(c.slice(at, n) for c in b.columns[:2]), *map(pa.array, made)], names=names)

    names = ["doc_id", "held_out", "score", "predicted", "n_passages", "top_passage", "top_weight"]
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_passages long, top_passage long, top_weight double")
