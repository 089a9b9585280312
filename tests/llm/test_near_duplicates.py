"""The pipeline's near-duplicate stage against all pairs compared."""

from cinderloom.llm import simhash

from near_texts import similar_firsts


def kept(spark, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r["doc_id"] for r in simhash.one_of_each(rows, **options).collect())


def test_crowded_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEADERS", 1)
    common, dense = [f"c{k}" for k in range(300)], [f"d{k}" for k in range(200)]
    texts = []
    for g in range(40):  # pairs at 0.82 that share 0.78 with all others
        own = [f"g{g}w{k}" for k in range(42)]
        texts += [" ".join(common + own), " ".join(common + own[:8] + [f"h{g}w{k}" for k in range(34)])]
    texts += [" ".join([*dense, f"e{g}"]) for g in range(40)]
    want = similar_firsts(texts)
    assert len(want) == 41 and kept(spark, texts, shard_rows=5) == want


def test_long_texts(spark):
    texts = []
    for g in range(12):
        words = [f"g{g}w{k}" for k in range(1500)]
        for k, share in enumerate((0.79, 0.795, 0.805, 0.81)):  # each pair on its own: share of the union that both have
            own = [f"p{k}{w}" for w in words]
            n = round(len(own) * (1 - share) / (1 + share))
            texts += [" ".join(own), " ".join(own[:-n] + [f"n{k}{w}" for w in words[:n]])]
    want = similar_firsts(texts)
    assert len(want) == 72 and kept(spark, texts) == want


def test_repeated_run(spark):
    texts = []
    for g in range(60):
        words = [f"g{g}w{k}" for k in range(104)]
        texts += [" ".join(words), " ".join(words[:50] + [f"again{g}"] * 20 + words[50:])]
    want = similar_firsts(texts)
    assert len(want) == 60 and kept(spark, texts) == want
