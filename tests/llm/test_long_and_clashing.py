"""One very long text, and columns whose names the operators use themselves, through every operator on documents and vectors."""

import hashlib

import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from cinderloom.llm import bpe, fim, knn, licenses, line_dedup, lm, merkle, mil, mixing, quality, simhash, suffix_dedup

LONG = " ".join(f"word{k % 9973}" + (".\n" if k % 40 == 39 else "") for k in range(120_000))
N = 120_000
CLASHES = "size source_size target taken n_words kept w h pieces tokens ids n c grp rank path score fp component_id labels n_base look found start _text _doc _th _id no line lines keys word bucket".split()
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG, "en", "s", len(LONG)), (2, "short text of a few words mit license", "en", "s", 37), (3, None, None, None, None), (4, LONG + " end", "en", "t", len(LONG) + 4)]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return base.withColumns({c: F.lit("clash") for c in CLASHES}).repartition(2).cache()


def by_id(rows):
    return {r["doc_id"]: r for r in rows.collect()}


def test_long_texts(docs):
    sizes = by_id(mixing.plan_mix(docs))
    assert (sizes[1]["size"], sizes[4]["size"], sizes[3]["size"]) == (N, N + 1, 0)
    rules = by_id(quality.quality_rules(docs))
    assert rules[1]["n_words"] == N and rules[1]["n_repeat_words"] == N - N // 40 and rules[1]["base_failed"]
    kept = by_id(suffix_dedup.remove_repeats(docs))
    assert kept[1]["n_removed"] > 0 and kept[4]["n_bytes"] - kept[4]["n_removed"] < 200
    assert len({by_id(simhash.near_duplicates(docs))[k]["component_id"] for k in (1, 4)}) == 1
    lines = by_id(line_dedup.dedup_lines(docs))
    assert lines[1]["n_lines"] == 3001 and lines[4]["n_exact"] >= 2999
    found = by_id(licenses.scan_licenses(docs))
    assert found[1]["n_words"] == N and found[2]["base_labels"] == "mit" and found[2]["first_word"] == 6
    scores = by_id(lm.score_documents(docs))
    assert scores[1]["n_tokens"] == N + 1 and scores[3]["n_tokens"] == 1


def test_long_texts_in_tokens_and_manifests(docs):
    for r in bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN).collect():
        text = {1: LONG, 4: LONG + " end"}.get(r["doc_id"])
        assert text is None or (r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["n_tokens"] > N)
    made = by_id(fim.fill_in_middle(docs).withColumn("back", fim.restore(F.col("output"), F.col("form"))))
    assert made[1]["back"] == LONG and made[4]["back"] == LONG + " end" and made[3]["form"] == "plain"
    roots = merkle.manifest(docs)
    assert roots.where(merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).count() == 4
    scored = by_id(mil.score_documents(docs, mil.GatedAttention()))
    assert scored[1]["n_passages"] == -(-len(LONG.encode()) // mil.PASSAGE) and scored[3]["n_passages"] == 1


def test_clashing_vectors(spark):
    rows = [(k, [float(k % 7), float(k % 3) - 1.0]) for k in range(250)]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    odd = plain.withColumns({c: F.lit("clash") for c in ("id", "v", "cell", "dist", "grp", "is_query", "score", "rank", "query_id", "x", "lo", "hi", "n", "label")})
    table = lambda d: sorted(tuple(r) for r in knn.top_k_search(d).collect())
    assert table(odd) == table(plain) and len(table(odd)) == 30


def test_words_of_chunks_come_in_order_without_a_list_each():
    find = regex.compile(public_tokenizers.PATTERN).findall
    batch = ["plain", " first", "it's,", "a\n  b", "naïve%%%", "\ud800x", " ", "end."]
    words, sizes = bpe.words_of(batch, find)
    want = [[w.encode("utf-8", "surrogatepass") for w in find(bpe.text_of(c) if " " in c else " " + c)] for c in batch]
    assert words == [w for group in want for w in group]
    assert sizes.tolist() == [len(group) for group in want]
    assert [x.tolist() if hasattr(x, "tolist") else x for x in bpe.words_of([], find)] == [[], []]


def test_fresh_chunks_of_a_full_cache(spark, monkeypatch):
    """The cache is emptied while a batch holds ids from it, and chunks whose words are not in the table stand among them."""
    texts = [" ".join(f"w{i * j % 61}" for i in range(40)) + f" only{j}" for j in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = sorted(bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN).collect())
    monkeypatch.setattr(bpe, "CACHED", 80)
    assert sorted(bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, table_words=30).collect()) == want
    assert [r["decoded_sha256"] for r in want] == [hashlib.sha256(t.encode()).hexdigest() for t in texts]
