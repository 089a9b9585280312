"""The corpus pipeline as a chain against plain Python, and the targets of the mix against their SQL."""

import collections
import hashlib
import math
import unicodedata

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from cinderloom.llm import bpe, mixing, quality, sql

from near_texts import similar_firsts

SF = "/root/testdata/sf0.001"
BIG = 1 << 62


def words(t):
    return (t or "").encode().split()


def distance(p, q):
    if not sum(p) or not sum(q):
        return 0.0
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    half = lambda a, m: a * math.log2(a / m) if a > 0 else 0.0
    return math.sqrt(max(0.0, sum(half(a, (a + b) / 2) + half(b, (a + b) / 2) for a, b in zip(p, q, strict=True)) / 2))


def good_documents(docs):
    measured = []
    for d in docs:
        t, w = d["text"] or "", words(d["text"])
        kind = lambda test: sum(map(test, t))  # noqa: E731, B023
        upper, digit = kind(lambda c: unicodedata.category(c) == "Lu"), kind(lambda c: unicodedata.category(c)[0] == "N")
        punct, symbol, inner = kind(lambda c: c in ".,;:!?'\"()-"), kind(lambda c: c in "#*$%&|<>"), sum(len(x.decode()) for x in w)
        classes = [upper, digit, punct, symbol, len(t) - inner, max(0, inner - upper - digit - punct - symbol)]
        common = quality.COMMON_WORDS.get(d["lang"], [])
        low = [x.decode().lower() for x in w]
        counts = [low.count(c) for c in common]
        measured.append((classes, [*counts, len(w) - sum(counts)] if common else None))
    out = []
    by_lang = collections.defaultdict(list)
    for d, m in zip(docs, measured, strict=True):
        by_lang[d["lang"]].append(m)
    total = lambda rows: [sum(x) for x in zip(*rows, strict=True)]
    for d, (classes, common) in zip(docs, measured, strict=True):
        w, own = words(d["text"]), by_lang[d["lang"]]
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
        if len(w) < 10 or 100 * len(covered) > 20 * len(w):
            continue
        enough = len(own) >= quality.MIN_REFERENCE
        reference = total([m[0] for m in (own if enough else measured)])
        if len(w) >= quality.MIN_WORDS and distance(classes, reference) > quality.MAX_CLASS_DISTANCE:
            continue
        if enough and common and len(w) >= quality.MIN_WORDS_FOR_WORDS and distance(common, total([m[1] for m in own])) > quality.MAX_WORD_DISTANCE:
            continue
        out.append(d)
    return out


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    return a[k + 1 :] == b[k + len(b) - len(a) + 1 :]


def without_lines(docs):
    first = {}
    for at, d in enumerate(docs):
        for no, line in enumerate(d["text"].split("\n")):
            if len(words(line)) >= 3:
                first.setdefault(line, (at, no))
    split = {x: words(x) for x in first}
    long = [x for x in first if len(split[x]) >= 10]
    gone = {x for i, x in enumerate(long) if any(near(split[x], split[y]) for y in long[:i])}
    out = []
    for at, d in enumerate(docs):
        lines = enumerate(d["text"].split("\n"))
        out.append(d | {"text": "\n".join(x for no, x in lines if x not in first or (x not in gone and first[x] == (at, no)))})
    return out


def mixed(spark, docs):
    rows = spark.createDataFrame([(k, d["doc_id"], d["text"]) for k, d in enumerate(docs)], "k int, doc_id long, text string")
    place = {r["k"]: r["o"] for r in rows.select("k", F.xxhash64("doc_id", "text").alias("o")).collect()}
    key = lambda s: (s is None, s or "")
    sources = sorted({d["source"] for d in docs}, key=key)
    size = {s: sum(len(words(d["text"])) for d in docs if d["source"] == s) for s in sources}
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sources)}
    target, open_, left = {}, set(sources), float(sum(size.values()))
    while open_:  # fill, cut what is above its cap, and share the rest again
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * size[s]}
        for s in over or open_:
            target[s] = 3.0 * size[s] if over else level * weight[s]
        left -= sum(target[s] for s in over or open_)
        open_ -= over or open_
    out = []
    for s in sources:
        at = 0
        stream = sorted((((place[k] & (1 << 64) - 1) >> 40) % 4096, place[k], BIG if d["doc_id"] is None else d["doc_id"], k) for k, d in enumerate(docs) if d["source"] == s)
        for *_, k in stream:
            n = len(words(docs[k]["text"]))
            copies = max(0, math.ceil((target[s] - (at + n / 2)) / size[s])) if n else 0
            out += [docs[k]] * copies
            at += n
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    base = spark.read.parquet(f"{SF}/documents.parquet")
    long = " ".join(f"word{k}" for k in range(3000))
    few = [
        (9001, None, None, None), (9002, "", "en", "src1"), (9003, "much too short", "en", "src1"), (9004, long, "en", "src2"), (9005, long + " end", "en", "src2"), (9006, long, "de", "src1"),
        (9007, "A line of ten words or more that stands in two documents.\n" + " ".join(f"own{k}" for k in range(60)), "en", None),
        (9008, "A line of ten words or more that stands in two papers.\n" + " ".join(f"other{k}" for k in range(60)), "en", None),
        (9009, " ".join(["same words"] * 40), "en", "src1"),
    ]
    more = spark.createDataFrame(few, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    base.unionByName(more).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_chain(spark, folder):
    rows = [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    docs = sorted(rows, key=lambda d: BIG if d["doc_id"] is None else d["doc_id"])
    good = good_documents(docs)
    assert 20 < len(good) < len(docs) - 3
    cut = without_lines(good)
    assert sum(len(a["text"]) > len(b["text"]) for a, b in zip(good, cut, strict=True)) > 1
    single = [cut[k] for k in similar_firsts([d["text"] for d in cut])]
    assert len(single) <= len(cut) - 2
    tok = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(corpus_pipeline.RANKS)), special_tokens={})
    want = []
    for d in mixed(spark, single):
        ids = np.array(tok.encode_ordinary(d["text"]), dtype="<u4").tobytes()
        want.append((d["doc_id"], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(d["text"].encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got) == sorted(want) and len(got) > 20


def test_empty_chain(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_targets_are_those_of_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {r[2]: r[3] for r in con.execute(sql.OP1_MIXING).fetchall()}
    got = {r["source_size"]: r["target"] for r in mixing.plan_mix(spark.read.parquet(f"{SF}/documents.parquet")).select("source_size", "target").distinct().collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * want[k] for k in want)
