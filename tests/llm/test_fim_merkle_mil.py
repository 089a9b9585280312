"""Fill-in-the-middle, manifest and passage classifier against plain Python, with nulls, ties, repeated rows and long texts."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderloom.llm import fim, merkle, mil

SF = "/root/testdata/sf0.001"
LONG = "Ab é日 <P 𝒳." * 40_000
ODD = [
    (9001, None, None, None, None), (9002, "", "en", "src1", 0), (None, "a lonely text", "en", None, 13), (None, "a lonely text", None, "", 13),
    (9003, "same", "en", "s", 4), (9003, "same", "en", "s", 4), (9003, "other", "en", "s", None), (9004, LONG, "", "s", 1),
    (9005, "has <S> inside", "fr", "s", 14), (9006, "<<P P> <", "fr", "s", 8), (9007, "xx", "zz", "s", 2), (-5, "é" * 300, "en", "s", 300),
]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    both = base.unionByName(odd)
    for name in ("n", "h", "form", "output", "root", "leaf", "path", "rank", "grp", "score", "held_out", "_text", "_id", "_c", "bucket"):
        both = both.withColumn(name, F.lit("clash"))
    return both.repartition(5).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def fim_of(doc_id, text, sentinels=fim.SENTINELS):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = [int(sha(f"1:{'' if doc_id is None else doc_id}")[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = sentinels
    if text == "" or any(x in text for x in sentinels) or h[2] % 100 >= 90:
        return (doc_id, len(units), "plain", None, None, text)
    spm = h[3] % 100 < 20
    return (doc_id, len(units), "spm" if spm else "psm", len(pre), len(mid), f"{s}{suf}{p}{pre}{m}{mid}" if spm else f"{p}{pre}{s}{suf}{m}{mid}")


@pytest.mark.parametrize("sentinels", [fim.SENTINELS, ("<|pre|>", "<|suf|>", "<|mid|>")])
def test_fill_in_middle(docs, none, sentinels):
    made = fim.fill_in_middle(docs, sentinels=sentinels).withColumn("back", fim.restore(F.col("output"), F.col("form"), sentinels))
    got = made.collect()
    want = [fim_of(r["doc_id"], r["text"], sentinels) for r in docs.collect()]
    assert sorted(map(repr, (tuple(r)[:-1] for r in got))) == sorted(map(repr, want))
    texts = sorted(r["text"] or "" for r in docs.select("text").collect())
    assert sorted(r["back"] for r in got) == texts and {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(none).count() == 0


def test_fim_lanes():
    """Cuts and sentinels at every place of a lane and of a group of lanes, and no matter where lanes begin."""
    rng = np.random.default_rng(3)
    letters = np.array(list("aZé日𝒳<P>S \n9M"))
    texts = ["", "<", "<M", "<<M>", "x" * 254 + "<M>", "x" * 255 + "<M>", "x" * 256 + "<M>", *("".join(rng.choice(letters, rng.integers(0, 900))) for _ in range(150))]
    raw = [t.encode() for t in texts]
    ends = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    one, two = (rng.integers(0, 1 << 32, len(raw)) for _ in range(2))
    for group in (fim.LANES, 2):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(fim, "LANES", group)
            found = fim.cut_texts(np.frombuffer(b"".join(raw), np.uint8), ends, one, two, fim.SENTINELS)
        for k, t in enumerate(texts):
            units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
            a, b = sorted((one[k] % (len(units) + 1), two[k] % (len(units) + 1)))
            assert found["n"][k] == len(units) and found["marked"][k] == any(s in t for s in fim.SENTINELS)
            for name, cut in (("a", a), ("b", b)):
                head = "".join(units[:cut])
                assert (found[f"{name}_chars"][k], found[f"{name}_bytes"][k]) == (len(head), len(head.encode()))


@pytest.mark.parametrize("wrong", [("<P>", "<S>"), ("<P>", "><", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "<P>", "<M>"), ("<é>", "<S>", "<M>")])
def test_fim_sentinels(wrong):
    with pytest.raises(ValueError):
        fim.machine(wrong)


def tree(hashes, fan_out):
    """(root, path of each) of a list of digests."""
    paths, place = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for k, p in enumerate(place):
            run = range(p - p % fan_out, min(len(hashes), p - p % fan_out + fan_out))
            paths[k].append(("".join(hashes[i] for i in run if i < p), "".join(hashes[i] for i in run if i > p)))
            place[k] = p // fan_out
        hashes = [sha(*hashes[i : i + fan_out]) for i in range(0, len(hashes), fan_out)]
    return hashes[0], paths


def manifest_of(rows, fan_out):
    names = ("doc_id", "source", "lang", "n_chars", "text")
    leaf = lambda r: sha(*("-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in names))
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r["doc_id"]))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    inner = {x: tree([r[2] for r in sorted(groups[x], key=lambda r: r[:3])], fan_out) for x in langs}
    root, outer = tree([inner[x][0] for x in langs], fan_out)
    return [(r[3], r[2], inner[x][0], root, path + up) for x, up in zip(langs, outer, strict=True) for r, path in zip(sorted(groups[x], key=lambda r: r[:3]), inner[x][1], strict=True)]


@pytest.mark.parametrize(("fan_out", "block_levels"), [(2, 12), (2, 2), (3, 1)])
def test_manifest(docs, none, fan_out, block_levels):
    made = merkle.manifest(docs, fan_out=fan_out, block_levels=block_levels, carry=[F.col("n_chars").alias("size")])
    got = made.withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).withColumn("proof", merkle.proof_digest(F.col("path"))).collect()
    want = manifest_of(docs.collect(), fan_out)
    assert sorted(repr((r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["path"]])) for r in got) == sorted(map(repr, want))
    assert all(r["folded"] == r["root"] and r["proof"] == sha(*(x for s in r["path"] for x in s)) for r in got)
    assert sorted(r["size"] or 0 for r in got) == sorted(r["n_chars"] or 0 for r in docs.collect())
    if block_levels == 12:
        assert merkle.manifest(none).count() == 0


def test_manifest_finds_changes(docs):
    changed = docs.withColumn("n_chars", F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    rows = merkle.manifest(docs, carry=[F.col("doc_id").alias("id")])
    leaves = changed.select(F.col("doc_id").alias("id"), merkle.leaf([F.col(c) for c in merkle.COLUMNS]).alias("now"))
    both = rows.where("id < 9000").join(leaves, "id").withColumn("right", merkle.fold(F.col("now"), F.col("path")) == F.col("root"))
    assert all(r["right"] == (r["id"] % 3 != 0) for r in both.collect())


def test_passage_features():
    """Texts in one group and each by itself have the same features; a long one has those of its blocks."""
    texts = [t.encode() for t in ("", "  \n ", "The the THE the", "x" * 5000, "one two three " * 300, "é日 <#!> 12\n" * 60)]
    together = [x for number, rows in mil.encode(texts) for x in np.split(rows, np.cumsum(number)[:-1])]
    alone = [next(iter(mil.encode([t])))[1] for t in texts]
    assert all(np.allclose(a, b) for a, b in zip(together, alone, strict=True))
    assert [len(x) for x in alone] == [max(1, -(-len(t) // mil.PASSAGE)) for t in texts]
    (number, rows), *rest = mil.encode([b"one two three " * 200_000])
    assert not rest and number[0] == len(rows) > 2 * mil.BLOCK and np.isfinite(rows).all()


def test_gradient():
    rng, model = np.random.default_rng(5), mil.GatedAttention(3)
    number = np.array([1, 4, 2])
    first, owner, y = np.cumsum(number) - number, np.repeat(np.arange(3), number), np.array([1.0, 0.0, 1.0])
    x = rng.standard_normal((7, mil.FEATURES)).astype(np.float32)

    def loss():
        s = model.forward(x, first, owner)["score"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    g = model.gradient(model.forward(x, first, owner), y, first, owner)
    for name, at in (("W", (3, 2)), ("b", (1,)), ("V", (0, 5)), ("U", (7, 1)), ("w", (4,)), ("c", (2,)), ("d", ())):
        keep = np.array(model.p[name])
        sides = []
        for step in (1e-5, -1e-5):
            model.p[name] = keep.copy()
            model.p[name][at] = model.p[name][at] + step
            sides.append(loss())
        model.p[name] = keep
        assert abs((sides[0] - sides[1]) / 2e-5 - g[name][at]) < 1e-6


def test_classifier(spark, docs, none):
    """Held-out accuracy, and that labels, sources and languages are no inputs."""
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = mil.fit(big, labels)
    rows = mil.score_documents(big, model).join(labels, "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows) and len(rows) > 800
    right = [r["predicted"] == r["quality"] for r in rows]
    clean, junk = ([r["predicted"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(right) > 0.97 * len(right) and sum(clean) > 0.98 * len(clean) and sum(junk) < 0.1 * len(junk)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    odd = mil.score_documents(docs, model).collect()
    assert len(odd) == docs.count() and all(r["top_passage"] < r["n_passages"] and 0 < r["top_weight"] <= 1 for r in odd)
    same = [r["score"] for r in mil.score_documents(docs.where("doc_id = 9003 and text = 'same'"), model).collect()]
    assert len(same) == 2 and same[0] == same[1] and mil.score_documents(none, model).count() == 0
    flat = mil.fit(docs, labels.where("quality = 1"))  # one kind of label
    assert {r["score"] for r in mil.score_documents(docs, flat).collect()} == {0.5}
    assert {r["score"] for r in mil.score_documents(docs, mil.fit(none, labels.where("false"))).collect()} == {0.5}
