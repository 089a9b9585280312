"""Operators on small hand-made rows."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cinderloom.functions import text
from cinderloom.operators import embed, evaluate, fusion, gallery, objects, query, ranking, search, tasks, timeline, validate, windows
from cinderloom.sources import sinks
from cinderloom.streaming import ingest


def test_expand(spark):
    q = spark.createDataFrame([(1, "A dog runs then a cat sleeps"), (2, "  "), (3, None)], "query_id long, text string")
    rows = query.expand(q, translation=F.upper, paraphrases=[lambda x: F.concat(x, F.lit(" now"))]).orderBy("query_id", "variant").collect()
    assert [(r["query_id"], r["kind"], r["weight"]) for r in rows] == [(1, "original", 1.0), (1, "paraphrase", 0.8), (1, "event", 0.85), (1, "event", 0.85), (2, "paraphrase", 0.8)]


@pytest.mark.parametrize("given, want", [("E1: a red car\nE2: a blue car", ["a red car", "a blue car"]), ("1. one\n2. two. ", ["one", "two"]), ("walks -> sits", ["walks", "sits"]), ("alone", None)])
def test_split_events(spark, given, want):
    assert spark.range(1).select(text.split_events(F.lit(given))).first()[0] == want


@pytest.mark.parametrize("given, want", [("Two men talk.\nHow many?", ("Two men talk.", "How many?")), ("A car stops. Who drives it", ("A car stops.", "Who drives it")), ("A car stops. It is red", ("A car stops. It is red",) * 2), ("A car. What color is it?", ("A car.", "What color is it?"))])
def test_qa_parts(spark, given, want):
    assert tuple(spark.range(1).select(text.qa_parts(F.lit(given)).alias("p")).select("p.*").first()) == want


def test_unicode_and_embedding(spark):
    d = spark.createDataFrame([(1, "Café  au LAIT"), (2, None), (3, "")], "doc_id long, text string")
    assert [r[0] for r in d.orderBy("doc_id").select(text.normalize_ocr(F.col("text"))).collect()] == ["café au lait", None, ""]
    v = {r["vec_id"]: r["v"] for r in embed.hash_embed(d, "doc_id", "text", dim=32).collect()}
    assert abs(sum(x * x for x in v[1]) - 1) < 1e-9 and not any(v[2]) and not any(v[3])


def test_embedding_takes_batches_in_parts(spark):
    texts = [(k, " ".join(f"w{(k * j) % 997}" for j in range(k % 50 * 40))) for k in range(2000)] + [(2000, None), (2001, "x " * 300_000)]
    d = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    got = {r["vec_id"]: r["v"] for r in embed.hash_embed(d, "doc_id", "text", dim=16, place=embed.md5_place).collect()}
    for k, text in texts:
        want = [0.0] * 16
        for token in (text or "").split():
            at, sign = embed.md5_place(token, 16)
            want[at] += sign
        size = math.sqrt(sum(x * x for x in want))
        assert all(abs(x - y / max(size, 1e-12)) < 1e-9 for x, y in zip(got[k], want, strict=True))
    batch = pa.RecordBatch.from_arrays([pa.array(range(2002)), pa.array([t.split() if t is not None else None for _, t in texts], pa.list_(pa.string()))], names=["k", "tokens"])
    cut = list(embed.parts(batch, 16))
    assert pa.concat_arrays([ids for ids, _ in cut]).to_pylist() == list(range(2002)) and len(cut) > 5
    assert all(len(ids) == 1 or len(lists.flatten()) + 16 * len(ids) <= embed.PART_TOKENS for ids, lists in cut)


def test_embedding_that_never_cancels(spark):
    texts = {1: "video 769", 2: "video 768", 3: "!!!", 4: " ", 5: None, 6: "Video 769 video"}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    signed, whole = ({r["vec_id"]: r["v"] for r in embed.hash_embed(d, "doc_id", "text", dim=256, place=embed.md5_place, never_zero=x).collect()} for x in (False, True))
    assert [k for k in texts if not any(signed[k])] == [1, 3, 4, 5] and [k for k in texts if not any(whole[k])] == [4, 5]
    assert all(whole[k] == signed[k] for k in (2, 6)) and whole[1][embed.md5_place("video", 256)[0]] == 1.0
    assert whole[3][embed.md5_place("!!!", 256)[0]] == embed.md5_place("!!!", 256)[1]


def test_viterbi_against_all_paths(spark):
    rng = random.Random(5)
    rows = [(v, float(rng.randrange(12)), *[None if rng.random() < 0.2 else rng.randrange(9) + 0.5 for _ in range(3)]) for v in range(4) for _ in range(10)]
    want = {}
    for v, a, s, _, _ in rows:
        for w, b, _, t, _ in rows:
            for x, c, _, _, u in rows:
                if v == w == x and 1 <= b - a <= 5 and 1 <= c - b <= 5 and None not in (s, t, u):
                    want[v] = max(want.get(v, -1), s + t + u)
    p = spark.createDataFrame(rows, "video_id long, ts double, s0 double, s1 double, s2 double")
    got = timeline.viterbi(p, 3, min_gap=1.0, max_gap=5.0).collect()
    assert {r["video_id"]: r["score"] for r in got} == want and all(r["path"] == sorted(set(r["path"])) for r in got)


def test_answers_and_reviews(spark):
    r = spark.createDataFrame([(1, k, 1, "v", k, 1 - k / 10) for k in range(6)], "query_id long, candidate_id long, rank int, video_id string, frame long, score double")
    q = tasks.qa_requests(r)
    assert [(x["batch"], x["label"]) for x in q.orderBy("candidate_id").collect()] == [(0, "C01"), (0, "C02"), (0, "C03"), (0, "C04"), (1, "C01"), (1, "C02")]
    schema = "query_id long, batch long, label string, answerable boolean, answer string, confidence double"
    replies = spark.createDataFrame([(1, 0, "C02", True, "Blue!", 0.9), (1, 1, "C03", True, "x", 1.0), (1, 1, "C01", False, "", 0.2), (1, 2, None, True, " ", 1.5)], schema)
    got = tasks.qa_answers(q, replies, text.normalize_answer).collect()
    assert [(g["candidate_id"], round(g["score"], 6)) for g in got] == [(1, round(0.55 * 0.9 + 0.45 * 0.8, 6))]
    codes = sorted(x["code"] for x in tasks.reply_problems(replies).collect())
    assert codes == ["confidence_range", "missing_answer", "missing_support"]
    reviewed = spark.createDataFrame([(1, 0, "v", 4), (1, 1, "w", 9)], "query_id long, place long, video_id string, frame long")
    out = tasks.reviewed_first(r.withColumn("rank", (F.col("candidate_id") + 1).cast("int")), reviewed, 4).orderBy("rank").collect()
    assert [(x["video_id"], x["frame"], x["reviewed"]) for x in out] == [("v", 4, True), ("w", 9, True), ("v", 0, False), ("v", 1, False)]
    assert out[0]["score"] > out[1]["score"] > 1.0
    answers = r.withColumn("frame", F.when(F.col("frame") < 5, F.lit(0)).cast("long")).withColumn("rank", (F.col("candidate_id") + 1).cast("int"))
    assert [x["candidate_id"] for x in tasks.frame_answers(answers).collect()] == [0]


def test_scope_and_thresholds(spark):
    rows = spark.createDataFrame([("A1", 1), ("B2", 2)], "video string, x int")
    assert [r["x"] for r in validate.in_scope(rows, [" b2", "a1"], "video").orderBy("place").collect()] == [2, 1]
    with pytest.raises(Exception, match="not in the data"):
        validate.in_scope(rows, ["C3"], "video").collect()
    schema = "mid string, entity string, label string, score double, x0 double, y0 double, x1 double, y1 double"
    d = spark.createDataFrame([("/m/1", "Dog", "dog", 0.3, -1.0, 0.0, 2.0, 1.0), ("/m/2", "Cat", "CAT", 0.3, 0.0, 0.0, 1.0, 1.0), (None, None, "x", 0.3, 0.0, 0.0, 1.0, 1.0)], schema)
    kept = objects.above_threshold(d, {"/m/1": 0.1, "cat": 0.5}).collect()
    assert [(k["label"], k["x0"], k["x1"]) for k in kept] == [("dog", 0.0, 1.0), ("x", 0.0, 1.0)]
    assert validate.duplicates(rows.union(rows.limit(1)), "video").count() == 1
    late = spark.createDataFrame([("A1", 1, 5.0), ("A1", 2, 9.5), ("B2", 1, 3.0)], "video_id string, n int, pts_time double")
    ends = spark.createDataFrame([("A1", 7.0), ("B2", 2.0)], "video_id string, duration double")
    assert [(r["video_id"], r["over"]) for r in validate.past_end(late, ends).collect()] == [("A1", 2.5)]


def test_evaluation_of_answers(spark):
    p = spark.createDataFrame([("q", 1, 1.0, "Blue."), ("q", 2, 1.0, "red")], "query_id string, rank int, score double, answer string")
    a = spark.createDataFrame([("q", "blue")], "query_id string, answer string")
    assert [r["score"] for r in evaluate.answer_hits(p, a, text.normalize_answer).orderBy("rank").collect()] == [1.0, 0.0]
    assert evaluate.unknown_queries(p, a.where("false")).count() == 1


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "k string, n long")
    sinks.write_jsonl(rows, f"{tmp_path}/j")
    sinks.write_jsonl(rows, f"{tmp_path}/j")
    assert [tuple(r) for r in spark.read.schema(rows.schema).json(f"{tmp_path}/j").collect()] == [("a", 1)]
    for _ in range(2):
        sinks.append(rows, f"{tmp_path}/a")
    assert spark.read.parquet(f"{tmp_path}/a").count() == 2
    lines = spark.createDataFrame([(7, 2, "b"), (7, 1, "a")], "query_id long, rank int, line string")
    sinks.write_submissions(lines, f"{tmp_path}/s")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/s/query_id=7").collect()] == ["a", "b"]


def test_ingest_reads_new_files_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "id long, t string")
    for k in (1, 2):
        rows.withColumn("id", F.lit(k).cast("long")).write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2):
            ingest.ingest_new(spark, f"{tmp_path}/in", rows.schema, f"{tmp_path}/out", f"{tmp_path}/seen")
        assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(1, k + 1))


def test_page_escapes():
    assert "<script>" not in gallery.page([{"a": "<script>", "b": None}], "t")
    with pytest.raises(ValueError):
        gallery.page([{}] * 101, "t")


def test_language_and_answers(spark):
    from cinderloom.functions import text

    rows = [("Tiếng Việt", "vi"), ("một chiếc xe", "vi"), ("a red car", "en"), ("12 !", "unknown"), ("nga\u0302n", "vi"), (None, "unknown")]
    got = spark.createDataFrame(rows, "t string, want string").select(text.language(F.col("t")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)
    answers = [("\uff21\uff11", "a1"), ("\ufb01ne, Stra\u00dfe!", "fine strasse"), (" A  B. ", "a b"), (None, None), ("", "")]
    got = spark.createDataFrame(answers, "t string, want string").select(text.normalize_answer(F.col("t")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)
    asked = spark.createDataFrame([("first this then that", "kis", "KIS"), ("first this then that", None, "TRAKE"), ("how many?", "other", "QA")], "t string, task string, want string")
    assert all(r["got"] == r["want"] for r in asked.select(text.task_type(F.col("t"), F.col("task")).alias("got"), "want").collect())


def test_names_and_delays(spark):
    from cinderloom.functions import text

    names = ["/a/query-10-kis.txt", "C:\\b\\query-9-kis.txt", "query-010b.txt", "/x/.hidden", "plain"]
    rows = spark.createDataFrame([(n,) for n in names], "p string")
    got = [r[0] for r in rows.orderBy(text.natural_key(text.file_stem(F.col("p")))).select(text.file_stem(F.col("p"))).collect()]
    assert got == [".hidden", "plain", "query-9-kis", "query-10-kis", "query-010b"]
    spans = spark.sql("SELECT array(struct('a' AS text, 1.0D AS start, 2.0D AS end)) AS s").select(text.shifted(F.col("s"), F.lit(10.0)).alias("s")).first()["s"]
    assert [tuple(x) for x in spans] == [("a", 11.0, 12.0)]


def test_readers(spark, tmp_path):
    from cinderloom.operators import artifacts, hits
    from cinderloom.sources import readers

    for name, body in {"query-10-kis": "\ufeffred car \n", "query-2-kis": "blue", "query-3-qa": "who?"}.items():
        (tmp_path / f"{name}.txt").write_text(body, encoding="utf-8")
    files = readers.whole_files(spark, str(tmp_path))
    assert [(r["stem"], r["text"]) for r in readers.query_files(files).collect()] == [("query-2-kis", "blue"), ("query-10-kis", "red car")]
    media = readers.media_info(spark.createDataFrame([('{"title":"t","keywords":["a"],"length":3}',), ("[",), (None,)], "value string")).collect()
    assert [(r["title"], r["length"]) for r in media] == [("t", 3.0), (None, None), (None, None)]
    side = readers.sidecar(spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "uid string, line int, t string"), "uid", F.col("t"), "line").collect()
    assert [tuple(r) for r in side] == [("k", "b")]
    with pytest.raises(Exception, match="not configured"):
        artifacts.selected(spark.range(3), spark.createDataFrame([(9,)], "id long"), "id").collect()
    with pytest.raises(ValueError, match="canonical"):
        artifacts.check_target("/a/b/", "/a/b", whole=False)
    keys = spark.createDataFrame([("v", 1), ("v", 2)], "video_id string, n int")
    images, objects = spark.createDataFrame([("v", 1, "p")], "video_id string, n int, image string"), spark.createDataFrame([], "video_id string, n int, labels string")
    assert artifacts.matched_frames(keys, images, objects).count() == 2
    with pytest.raises(Exception, match="no image"):
        artifacts.matched_frames(keys, images, objects, strict=True).collect()
    with pytest.raises(ValueError, match="negative"):
        hits.fuse(keys, {"a": -1.0})
    fused = spark.createDataFrame([("v", None, 7, None, 1.5), (None, 1, 2, 0.5, 0.5)], "video_id string, frame_idx int, frame_id int, timestamp double, pts_time double")
    assert [(r["frame"], r["at"]) for r in hits.to_candidates(fused).collect()] == [(7, 1.5)]


def greedy(rows, limit, same, temporal, radius, most):
    """(id, utility) of a pool of (id, video, time, score), by choosing the best of all that is left again and again."""
    low, high = min(r[3] for r in rows), max(r[3] for r in rows)
    rest, chosen, out = list(rows), [], []
    while rest and len(out) < limit:
        keyed = []
        for r in rest:
            own = [c for c in chosen if c[1] == r[1]]
            near = max((max(0.0, 1 - abs(r[2] - c[2]) / radius) for c in own if r[2] is not None and c[2] is not None), default=0.0)
            relevance = 1.0 if high == low else (r[3] - low) / (high - low)
            if most is None or len(own) < most:
                keyed.append((round(relevance - same * len(own) - temporal * near, 9), r[3], r[0], r))
        if not keyed:
            break
        utility, _, key, best = max(keyed, key=lambda x: x[:3])
        rest.remove(best)
        chosen.append(best)
        out.append((key, utility))
    return out


@pytest.mark.parametrize("limit, same, temporal, most", [(10, 0.08, 0.35, None), (40, 0.02, 0.1, None), (12, 0.0, 0.5, 2), (500, 0.08, 0.35, None)])
def test_diversify_against_greedy(spark, limit, same, temporal, most):
    rng = random.Random(limit)
    rows = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, rng.randrange(40) / 2]), float(rng.randrange(30))) for i in range(120)]
    pool = spark.createDataFrame([(7, *r) for r in rows], "query_id long, candidate_id long, video_id long, ts double, score double")
    got = ranking.diversify(pool, limit, same, temporal, 2.0, most).orderBy("rank").collect()
    want = greedy([(i, -1 if v is None else v, t, s) for i, v, t, s in rows], limit, same, temporal, 2.0, most)
    assert [round(r["utility"], 6) for r in got] == [round(u, 6) for _, u in want]
    assert sorted(r["candidate_id"] for r in got) == sorted(i for i, _ in want)
    assert ranking.diversify(pool.limit(0), limit).count() == 0


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 320}, {"block_bytes": 320, "broadcast_bytes": 100}])
def test_knn_batch_ties(spark, sizes):
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(3)) for _ in range(4)]) for i in range(300)]
    index = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(5)
    asked = [(i, v) for i, v in rows if i % 40 == 0]
    queries = spark.createDataFrame(asked, "vec_id long, v array<double>")
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = [(q, rank, i) for q, a in asked for rank, (_, i) in enumerate(sorted((-score(a, b), i) for i, b in rows)[:6], 1)]
    assert sorted((r[0], r[1], r[2]) for r in search.knn_batch(index, queries, 6, **sizes).collect()) == want
    assert search.knn_batch(index.limit(0), queries, 6, **sizes).count() == 0 and search.knn_batch(index, queries.limit(0), 6, **sizes).count() == 0
    plan = search.knn_batch(index, queries, 6, **sizes)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and ("broadcast" in plan) == ("broadcast_bytes" not in sizes)


def test_knn_refusals(spark):
    index = spark.createDataFrame([(i, [float(i), 1.0, 2.0, 3.0]) for i in range(20)], "vec_id long, v array<double>")
    queries = index.limit(2)
    for bad in ((999, None), (999, [1.0]), (999, [1.0, 2.0, 3.0, float("nan")]), (999, [1.0, None, 3.0, 4.0]), (None, [1.0, 2.0, 3.0, 4.0])):
        worse = index.unionByName(spark.createDataFrame([bad], "vec_id long, v array<double>")).coalesce(1)
        for found in (search.knn_batch(worse, queries, 6), search.knn_batch(index, worse, 6)):
            with pytest.raises(Exception, match="not finite"):
                found.collect()
        if bad[0]:
            with pytest.raises(Exception, match="not finite"):
                search.knn(worse, [1.0] * 4, 6).collect()
    with pytest.raises(Exception, match="not finite"):
        search.knn_batch(index, spark.createDataFrame([(1, [1.0])], "vec_id long, v array<double>"), 6).collect()


def test_negative_weights_are_refused(spark):
    hits = spark.createDataFrame([(1, "a", 2, 0.5)], "query_id long, source string, candidate_id long, score double")
    for fuse in (fusion.reciprocal_rank_fusion, fusion.weighted_score_fusion):
        assert fuse(hits, {"a": 0.0}).count() == 1
        with pytest.raises(ValueError):
            fuse(hits, {"a": -0.1})


def test_mean_pool(spark):
    rows = [("a", [3.0, 0.0]), ("a", [3.0, 8.0]), ("b", [0.0, 0.0]), (None, [0.0, 2.0])]
    v = spark.createDataFrame(rows, "w string, v array<double>")
    got = {r["w"]: ([round(x, 9) for x in r["v"]], r["n_vectors"]) for r in windows.mean_pool(v, "w", dim=2).collect()}
    assert got == {"a": ([0.6, 0.8], 2), "b": ([0.0, 0.0], 1), None: ([0.0, 1.0], 1)}
    assert windows.mean_pool(v.limit(0), "w", dim=2).count() == 0 and windows.mean_pool(v.limit(0), "w", dim=0).count() == 0
    for bad in (None, [1.0], [1.0, float("inf")], [None, 1.0]):
        with pytest.raises(Exception, match="not of length 2"):
            windows.mean_pool(v.unionByName(spark.createDataFrame([("c", bad)], "w string, v array<double>")), "w", dim=2).collect()


def test_diversify_holds_no_query_in_one_task(spark):
    pool = spark.createDataFrame([(0, 1, 7, 0.0, 1.0), (0, 2, 7, 50.0, 0.5), (None, 3, 8, 0.0, 2.0), (None, 4, 8, 9.0, 1.0)], "query_id long, candidate_id long, video_id long, ts double, score double")
    best = ranking.diversify(pool, 5)
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Window [" in line and "max(score" in line for line in plan.splitlines())
    assert sorted((r["query_id"] is None, r["rank"], r["candidate_id"]) for r in best.collect()) == [(False, 1, 1), (False, 2, 2), (True, 1, 3), (True, 2, 4)]
