"""What the engine writes and reads again: shards, JSON lines, indexes, batch runs."""

import datetime
import json
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderloom.operators import index_build
from cinderloom.plans import batch, stores
from cinderloom.sources import files, shards


def test_shards_are_read_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    made = {"L01_V001": rng.normal(size=(1000, 16)).astype(np.float32), "L01_V002": rng.normal(size=(7, 16)).astype(np.float16), "L01_V003": np.zeros((0, 16)), "l02_v001": rng.normal(size=(3, 16))}
    for name, m in made.items():
        np.save(tmp_path / f"{name}.npy", m)
    rows = shards.vector_shards(spark, str(tmp_path), range_bytes=16 * 4 * 100)
    assert rows.rdd.getNumPartitions() == 12
    got = {}
    for r in rows.collect():
        got.setdefault(r["video_id"], {})[r["row"]] = r["embedding"]
    assert set(got) == {"L01_V001", "L01_V002", "L02_V001"}
    for name, m in made.items():
        for k, v in enumerate(m.astype(np.float32)):
            assert np.array_equal(np.array(got[name.upper()][k], np.float32), v)
    assert shards.shard_issues(shards.headers(spark, str(tmp_path))).count() == 2  # those whose type is not that of most


def test_shard_issues(spark, tmp_path):
    m = np.ones((4, 8), np.float32)
    for name, value in {"a": m, "b": m, "c": m[:, :3], "d": m.astype(np.float16), "e": m[0], "f": m.astype(int), "g": np.asfortranarray(m)}.items():
        np.save(tmp_path / f"{name}.npy", value)
    (tmp_path / "h.npy").write_bytes(b"no matrix")
    whole = (tmp_path / "a.npy").read_bytes()
    (tmp_path / "i.npy").write_bytes(whole[:-4])
    found = {os.path.basename(r["path"]): r["code"] for r in shards.shard_issues(shards.headers(spark, str(tmp_path))).collect()}
    assert found == {"c.npy": "other_width", "d.npy": "other_dtype", "e.npy": "not_two_dimensional", "f.npy": "not_floats", "g.npy": "not_in_row_order", "h.npy": "not_a_matrix", "i.npy": "too_short"}
    with pytest.raises(Exception, match="not_two_dimensional"):
        shards.vector_shards(spark, str(tmp_path)).count()
    for name in "defghi":
        os.remove(tmp_path / f"{name}.npy")
    with pytest.raises(Exception, match="several widths"):
        shards.vector_shards(spark, str(tmp_path)).count()
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="no .npy files"):
        shards.vector_shards(spark, str(tmp_path / "none")).count()


def test_json_lines_in_one_scan(spark, tmp_path):
    lines = ['{"window_id":"a","video":1}', "", '{"window_id":"a","video":1,"more":[1]}', "{", "[2]", '{"window_id":"b","video":"x"}', '{"window_id":" ","video":2}', '{"video":2}', '{"window_id":"c","video":null}']
    (tmp_path / "rows.jsonl").write_text("\n".join(lines))
    schema = T.StructType([T.StructField("window_id", T.StringType()), T.StructField("video", T.LongType())])
    seen = Observation("lines")
    rows = files.jsonl(spark, str(tmp_path), schema, required=["window_id"], observation=seen)
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = [(r["window_id"], r["video"], r["_code"], r["_line"]) for r in rows.collect()]
    assert [g[2] for g in got] == [None, None, "not_json", "not_an_object", "bad_field", "no_window_id", "no_window_id", None]
    assert seen.get == {"lines": 8, "bad": 5} and got[2][3] == "{" and got[0][3] is None
    plain = files.jsonl(spark, str(tmp_path), schema, required=["window_id"])
    assert sorted((r["window_id"], r["video"]) for r in files.good_lines(plain).collect() if r["video"]) == [("a", 1), ("a", 1)]
    assert {(r["video"], r["code"]): (r["n"], r["n_keys"]) for r in files.line_counts(plain, "video", "window_id").collect()} == {
        (1, None): (2, 1), (None, None): (1, 1), (None, "not_json"): (1, 0), (None, "not_an_object"): (1, 0), (None, "bad_field"): (1, 0), (None, "no_window_id"): (2, 0),
    }
    with pytest.raises(Exception, match="does not fit"):
        files.good_lines(plain, strict=True).collect()


@pytest.fixture
def small(spark):
    features = spark.createDataFrame([("L01_V001", 0, [1.0, 0.0]), ("L01_V001", 1, [0.0, 1.0]), ("L01_V001", 2, [0.0, 1.0])], "video_id string, row long, v array<double>")
    keyframes = spark.createDataFrame([("L01_V001", n + 1, n * 25, float(n), 25.0) for n in range(3)], "video_id string, n long, frame_idx long, pts_time double, fps double")
    rows = [("W0", "L01_V001", ["L01_V001_K000001", "L01_V001_K000002"], "said", None), ("W1", "L01_V001", ["l01_v001_k000001", "L01_V001_K000003", "L01_V001_K000002"], " ", ["car", " ", "dog"]), ("W2", "L01_V001", [], "more", [])]
    return spark.createDataFrame(rows, "window_id string, video_id string, keyframe_uids array<string>, asr_text string, object_labels array<string>"), features, keyframes


def test_visual_windows(spark, small, tmp_path):
    windows, features, keyframes = small
    made = index_build.visual_windows(windows, features, keyframes, dim=2)
    rows = {r["window_id"]: r for r in made.collect()}
    half = 2**-0.5
    assert set(rows) == {"W0", "W1"} and np.allclose(rows["W0"]["v"], [half, half]) and np.allclose(rows["W1"]["v"], np.array([1, 2]) / 5**0.5)
    assert rows["W0"]["frame_idx"] == 0 and rows["W0"]["representative_keyframe_uid"] == "L01_V001_K000001"  # a tie: the first
    assert rows["W1"]["frame_idx"] == 50 and rows["W1"]["vector_id"] == "W1" and "asr_text" not in made.columns  # of equal ones the first in the window
    for uid, message in (("L01_V002_K000001", "not a keyframe"), ("K1", "not a keyframe"), ("L01_V001_K000009", "no vector"), ("L01_V001_K000000", "no vector")):
        with pytest.raises(Exception, match=message):
            index_build.visual_windows(windows.withColumn("keyframe_uids", F.array(F.lit(uid))), features, keyframes, dim=2).collect()
    with pytest.raises(Exception, match="no keyframe"):
        index_build.visual_windows(windows, features, keyframes.where("n = 9"), dim=2).collect()
    with pytest.raises(Exception, match="not of length"):
        index_build.visual_windows(windows, features, keyframes, dim=3).collect()


def test_vectors_are_dealt_to_windows_once(spark, small):
    """32-bit vectors stay so until they lie with their windows, and no sums or pooled vectors are exchanged."""
    windows, features, keyframes = small
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = index_build.visual_windows(windows, features.withColumn("v", F.col("v").cast("array<float>")), keyframes, dim=2)
        plan = made._jdf.queryExecution().executedPlan().toString()
        half = 2**-0.5
        assert np.allclose({r["window_id"]: r["v"] for r in made.collect()}["W0"], [half, half])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "partial_avg" not in plan and "as array<double>) AS own" not in plan and plan.count("Exchange hashpartitioning(window_id") == 2  # vectors, and the windows


def test_index_manifest(spark, small, tmp_path):
    windows, features, keyframes = small
    made_from = {"encoder": "e", "window_records_hash": index_build.records_hash(windows).first()["records_hash"]}
    path = f"{tmp_path}/index"
    index_build.write(index_build.visual_windows(windows, features, keyframes, dim=2), path, made_from)
    assert index_build.opened(spark, path, made_from).count() == 2
    changed = windows.withColumn("asr_text", F.lit("changed"))
    other = made_from | {"window_records_hash": index_build.records_hash(changed).first()["records_hash"]}
    with pytest.raises(ValueError, match="other_window_records_hash"):
        index_build.opened(spark, path, other)
    assert [r["code"] for r in index_build.problems(spark, path, {"scope": "s"}).collect()] == ["other_scope"]
    spark.read.parquet(f"{path}/vectors").limit(1).write.mode("append").parquet(f"{path}/vectors")
    assert [r["code"] for r in index_build.problems(spark, path, made_from).collect()] == ["other_rows"]
    with pytest.raises(Exception, match="no rows"):
        index_build.write(index_build.visual_windows(windows.where("false"), features, keyframes, dim=2), f"{tmp_path}/none", made_from)


def test_text_rows_and_index(spark, small, tmp_path):
    windows, _, _ = small
    rows = {(r["modality"], r["window_id"]): (r["text"], r["source_field"]) for r in index_build.text_rows(windows).collect()}
    assert rows == {("asr", "W0"): ("said", "asr_text"), ("objects", "W1"): ("car, dog", "object_labels"), ("asr", "W2"): ("more", "asr_text")}
    encoder = lambda d, key, text: d.select(F.col(key).alias("vec_id"), F.array(F.length(text).cast("double")).alias("v"))
    index_build.build_text_index(windows, f"{tmp_path}/t", encoder, {"encoder": "length"})
    stored = index_build.opened(spark, f"{tmp_path}/t", {"encoder": "length"}, by=["modality"]).collect()
    assert sorted((r["modality"], r["window_id"], r["v"]) for r in stored) == [("asr", "W0", [4.0]), ("asr", "W2", [4.0]), ("objects", "W1", [8.0])]
    assert os.path.isdir(f"{tmp_path}/t/vectors/modality=objects")
    with pytest.raises(ValueError, match="no rows"):
        index_build.build_text_index(windows.where("false"), f"{tmp_path}/u", encoder, {"encoder": "length"})


def test_vectors_of_a_text_index_are_not_broadcast(spark, small, tmp_path, monkeypatch):
    written = []
    monkeypatch.setattr(index_build, "write", lambda index, *_, **__: written.append(index))
    encoder = lambda d, key, text: d.select(F.col(key).alias("vec_id"), F.array(F.length(text).cast("double")).alias("v"))
    index_build.build_text_index(small[0], str(tmp_path), encoder, {})
    plan = written[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_text_whose_signed_tokens_cancel(spark, tmp_path):
    rows = [(k, datetime.datetime(2024, 1, 1 + k // 3, 5), 768 + k % 2, ("click", "view", "!!!")[k % 3], 1.0, "{}") for k in range(12)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = stores.text_window_indexes(spark, str(tmp_path))
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = sql.execute(f"SELECT {', '.join(got.columns)} FROM ({stores.SOURCES['text_window_indexes']})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and any(r[:2] == ("metadata", "769_W000000") for r in want)


def test_records_hash(spark):
    rows = spark.createDataFrame([("b", 1, {"y": 1.0, "x": 2.0}), ("a", None, None)], "id string, n long, m map<string,double>")
    value = lambda d: d.first()["records_hash"]
    base = value(index_build.records_hash(rows))
    assert value(index_build.records_hash(rows.orderBy("id").repartition(3).select("m", "n", "id"))) == base
    assert value(index_build.records_hash(rows.withColumn("metadata_text", F.lit("x")))) == base
    assert value(index_build.records_hash(rows.withColumn("n", F.coalesce("n", F.lit(0))))) != base and value(index_build.records_hash(rows.union(rows))) != base
    assert [r[0] for r in rows.orderBy("id").select(index_build.canonical_json(rows)).collect()] == ['{"id":"a","m":null,"n":null}', '{"id":"b","m":{"x":2.0,"y":1.0},"n":1}']
    assert index_build.records_hash(rows.where("false")).first()["n"] == 0


def queries_of(spark, **texts):
    return spark.createDataFrame([(k.replace("_", "-"), v) for k, v in texts.items()], "stem string, text string")


def mapping(spark, value):
    return spark.createDataFrame([(value if isinstance(value, str) else json.dumps(value),)], "value string")


def test_retrieval_texts(spark):
    q = queries_of(spark, query_p1_1_kis="a", query_p1_2_kis="b")
    texts = {r["stem"]: r["retrieval_text"] for r in batch.retrieval_texts(mapping(spark, {"query-p1-1-kis": " one \n two ", "query-p1-2-kis": "x"}), q).collect()}
    assert texts == {"query-p1-1-kis": "one two", "query-p1-2-kis": "x"}
    for value, message in (
        ({"query-p1-1-kis": "a"}, "no retrieval text for: query-p1-2-kis"), ({"query-p1-1-kis": "a", "query-p1-2-kis": "b", "z": "c"}, "unknown queries: z"),
        ({"query-p1-1-kis": " ", "query-p1-2-kis": "b"}, "blank"), ({"query-p1-1-kis": 3, "query-p1-2-kis": "b"}, "blank"), ("[]", "not a JSON object"), ("{", "not a JSON object"),
    ):
        with pytest.raises(ValueError, match=message):
            batch.retrieval_texts(mapping(spark, value), q)


def test_reviewed_frames(spark):
    q = queries_of(spark, query_p1_1_kis="a", query_p1_2_kis="b")
    videos = spark.createDataFrame([("L01_V001", 10)], "video_id string, frames long")
    one = {"video_id": "L01_V001", "frame_id": 9}
    rows = batch.reviewed_frames(mapping(spark, {"query-p1-1-kis": [dict(one, note=" good "), dict(one, frame_id=3)]}), q, videos).orderBy("place").collect()
    assert [tuple(r) for r in rows] == [("query-p1-1-kis", 0, "L01_V001", 9, "good"), ("query-p1-1-kis", 1, "L01_V001", 3, "")]
    for value, message in (
        ([one, one], "repeat"), ([], "empty"), ({}, "no list"), ([dict(one, frame_id=True)], "malformed"), ([dict(one, frame_id=-1)], "malformed"), ([dict(one, video_id="V1")], "malformed"),
        ([dict(one, note=3)], "malformed"), ([dict(one, frame_id=10)], "outside"), ([dict(one, video_id="L01_V009")], "outside"),
    ):
        with pytest.raises(ValueError, match=message):
            batch.reviewed_frames(mapping(spark, {"query-p1-1-kis": value}), q, videos)
    with pytest.raises(ValueError, match="unknown queries"):
        batch.reviewed_frames(mapping(spark, {"z": [one]}), q, videos)


def test_batch_run(spark, tmp_path):
    q = queries_of(spark, query_p1_1_kis="a car", query_p1_2_kis="a  car", query_p1_10_kis="a dog")
    asked = []

    def answer(texts):
        asked.append(sorted(r["text"] for r in texts.collect()))
        ranks = texts.select("text_id", F.explode(F.sequence(F.lit(1), F.lit(150))).alias("rank"))
        return ranks.select("text_id", "rank", F.lit("L01_V001").alias("video_id"), (F.col("rank") * 10).cast("long").alias("frame"), (1 / F.col("rank")).alias("score"))

    reviewed = spark.createDataFrame([("query-p1-10-kis", 0, "L01_V002", 5), ("query-p1-10-kis", 1, "L01_V001", 20)], "stem string, place int, video_id string, frame long")
    rows = {r["query_id"]: r for r in batch.run(q, answer, str(tmp_path), reviewed=reviewed, limit=3, notes={"config": "c"}).collect()}
    assert asked == [["a car", "a dog"]] and set(rows) == {"query-p1-1-kis", "query-p1-2-kis", "query-p1-10-kis"}
    first, same, other = (rows[f"query-p1-{k}-kis"] for k in (1, 2, 10))
    assert (first["repeats_text"], same["repeats_text"], same["repeats_query"], other["submission"]) == (False, True, False, "query-10-kis")
    assert (first["queries"], first["texts"], first["searches"], first["predictions"], first["reviewed_predictions"], other["reviewed_predictions"]) == (3, 3, 2, 3, 0, 2)
    assert other["top"]["frame"] == 5 and other["top"]["video_id"] == "L01_V002" and first["config"] == "c" and first["removed"] == []
    lines = lambda name: [r["value"] for r in spark.read.text(f"{tmp_path}/submissions/submission={name}").collect()]
    assert lines("query-10-kis") == ["L01_V002,5", "L01_V001,20", "L01_V001,10"] and lines("query-1-kis") == ["L01_V001,10", "L01_V001,20", "L01_V001,30"]
    again = batch.run(q.where("stem <> 'query-p1-1-kis'"), answer, str(tmp_path), limit=2).collect()
    assert len(again) == 2 and again[0]["removed"] == ["query_id=query-p1-1-kis", "submission=query-1-kis"]
    assert sorted(os.listdir(tmp_path / "submissions"))[-2:] == ["submission=query-10-kis", "submission=query-2-kis"] and len(lines("query-10-kis")) == 2
    with pytest.raises(ValueError, match="between 1 and 100"):
        batch.run(q, answer, str(tmp_path), limit=101)
    with pytest.raises(Exception, match="several query files"):
        batch.run(queries_of(spark, query_p1_1_kis="a", query_p2_1_kis="b"), answer, str(tmp_path))
    with pytest.raises(ValueError, match="no answers for"):
        batch.run(q, lambda texts: answer(texts).where("false"), str(tmp_path))
    replaced = spark.createDataFrame([("query-p1-1-kis", "red"), ("query-p1-2-kis", "a car"), ("query-p1-10-kis", "red")], "stem string, retrieval_text string")
    rows = {r["query_id"]: r for r in batch.run(q, answer, str(tmp_path), texts=replaced).collect()}
    assert asked[-1] == ["a car", "red"] and [rows[f"query-p1-{k}-kis"]["text_replaced"] for k in (1, 2, 10)] == [True, False, True] and rows["query-p1-1-kis"]["predictions"] == 100
