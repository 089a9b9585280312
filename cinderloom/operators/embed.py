"""Signed feature hashing of texts, a dependency-free stand-in for a text tower."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import EPSILON
from ..session import bound_batches, plain_array
from .search import BLOCK, packer

DIMENSION = 512
#: Tokens of a batch that are taken at a time, and tokens whose places are remembered.
PART_TOKENS, KNOWN_TOKENS = 50_000, 50_000


def blake2b_place(token: str, dim: int) -> tuple[int, int]:
    d = hashlib.blake2b(token.encode(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little") % dim, 1 if d[8] & 1 else -1


def md5_place(token: str, dim: int) -> tuple[int, int]:
    """Bucket from the first eight hex digits, sign from the ninth: a form that SQL engines share."""
    d = hashlib.md5(token.encode()).digest()
    return int.from_bytes(d[:4], "big") % dim, 1 if d[4] & 16 else -1


def hash_embed(rows: DataFrame, key: str, text: str, *, dim: int = DIMENSION, place: Callable[[str, int], tuple[int, int]] = blake2b_place, packed: bool = False, never_zero: bool = False) -> DataFrame:
    """(vec_id, v), or with ``packed`` the blocks of a search, made by the same worker: unit vectors of the texts' tokens; a text without tokens, or whose tokens cancel each other,
    has the zero vector. With ``never_zero`` only a blank text has it: tokens that cancel count without their signs, and a text without tokens is one itself. Tokens are cut in the
    JVM; Python only hashes each new one. A batch is taken ``PART_TOKENS`` tokens at a time, and only the distinct ones of
    a part become Python strings."""

    from ..functions.text import TOKEN, unicode_tokens  # workers import this module, and need no pandas

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int]] = {}
        for b in batches:
            for ids, lists in parts(b, dim):
                coded = lists.flatten().dictionary_encode()
                distinct = coded.dictionary.to_pylist()
                if len(known) + len(distinct) > KNOWN_TOKENS:
                    known.clear()
                places = np.zeros((len(distinct), 2), np.int64)
                for i, token in enumerate(distinct):
                    if (at := known.get(token)) is None:
                        at = known[token] = place(token, dim)
                    places[i] = at
                row, token = np.repeat(np.arange(len(lists)), np.from_dlpack(lists.value_lengths())), np.from_dlpack(coded.indices)
                cell = row * dim + places[token, 0]
                out = np.bincount(cell, places[token, 1], len(lists) * dim).astype(float).reshape(len(lists), dim)
                if never_zero and (gone := ~out.any(axis=1)).any():
                    out[gone] = np.bincount(cell, minlength=len(lists) * dim).reshape(len(lists), dim)[gone]
                out /= np.maximum(np.sqrt((out * out).sum(axis=1)), EPSILON)[:, None]
                v = pa.ListArray.from_arrays(plain_array(np.arange(len(lists) + 1, dtype=np.int32) * dim), plain_array(out.ravel()))
                yield pa.RecordBatch.from_arrays([ids, v], names=["vec_id", "v"])

    bound_batches(rows.sparkSession)
    asked = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.lower(F.col(text)).alias("text"))
    tokens = unicode_tokens(F.col("text"))
    if never_zero:
        tokens = F.when((F.trim("text") != "") & ~F.col("text").rlike(TOKEN), F.array("text")).otherwise(tokens)
    asked = asked.select("vec_id", F.coalesce(tokens, F.array()).alias("tokens"))
    if packed:
        pack = packer()
        return asked.mapInArrow(lambda batches: pack(run(batches)), BLOCK)
    return asked.mapInArrow(run, "vec_id long, v array<double>")


def parts(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """A batch of (key, tokens) in runs of rows with about ``PART_TOKENS`` tokens and as many components of vectors at most; null
    counts as no tokens."""
    weight = np.cumsum(np.diff(np.from_dlpack(batch.column(1).offsets)).astype(np.int64) + dim)
    lo = 0
    while lo < len(batch):
        before = weight[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(weight, before + PART_TOKENS, "right")))
        yield batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)
        lo = hi
