"""Windows by the whole rule and whole searches, on hand-made rows with literal expected values."""

import pytest
from pyspark.sql import functions as F

from cinderloom.operators import fusion, heads, windows


def keyframes(spark, *times, video="L01_V001", fps=25.0):
    rows = [(video, n, f"{video}_K{n:06d}", float(t), int(t * fps), fps) for n, t in enumerate(times, 1)]
    return spark.createDataFrame(rows, "video_id string, n long, keyframe_uid string, pts_time double, frame_idx long, fps double")


def durations(spark, value, video="L01_V001"):
    return spark.createDataFrame([(video, float(value))], "video_id string, duration double")


SEGMENTS = "video_id string, position int, segment_id int, start double, end double, text string, words array<struct<text:string,start:double,end:double>>"


def test_windows_hold_what_spans_their_edge(spark):
    w = windows.temporal_windows(keyframes(spark, 1, 4.5, 6), 5.0, 5.0, durations=durations(spark, 10))
    rows = w.orderBy("k").collect()
    assert [(r["window_id"], r["start"], r["end"], r["start_frame"], r["end_frame"]) for r in rows] == [("L01_V001_W000000", 0.0, 5.0, 0, 124), ("L01_V001_W000001", 5.0, 10.0, 125, 249)]
    assert [r["keyframe_uids"] for r in rows] == [["L01_V001_K000001", "L01_V001_K000002"], ["L01_V001_K000003"]]
    assert [r["representative_keyframe_uid"] for r in rows] == ["L01_V001_K000001", "L01_V001_K000003"]  # 1.5 against 2 from the middle
    s = spark.createDataFrame([("L01_V001", 0, 7, 4.0, 6.0, " qua ranh giới", [])], SEGMENTS)
    got = windows.aligned_text(w, s, 5.0, 5.0, 0.2).orderBy("k").collect()
    assert [(r["k"], r["asr_text"], r["asr_segment_ids"]) for r in got] == [(0, "qua ranh giới", [7]), (1, "qua ranh giới", [7])]


def test_a_rounded_duration_is_extended(spark):
    rows = windows.temporal_windows(keyframes(spark, 0, 10.02), 5.0, 5.0, durations=durations(spark, 10)).orderBy("k").collect()
    assert rows[-1]["keyframe_uids"] == ["L01_V001_K000002"] and rows[-1]["end"] >= 10.02 and [r["k"] for r in rows] == [0, 2]
    every = windows.temporal_windows(keyframes(spark, 0, 10.02), 5.0, 5.0, durations=durations(spark, 10), include_empty=True).orderBy("k").collect()
    assert [(r["k"], len(r["keyframe_uids"]), r["frame_idx"]) for r in every] == [(0, 1, 0), (1, 0, None), (2, 1, 250)]
    longer = windows.temporal_windows(keyframes(spark, 1), 5.0, 5.0, durations=durations(spark, 12), include_empty=True).orderBy("k").collect()
    assert [r["end"] for r in longer] == [5.0, 10.0, 12.0]
    silent = windows.temporal_windows(keyframes(spark, 1).where("false"), 5.0, 5.0, durations=durations(spark, 4), include_empty=True).collect()
    assert [(r["end"], r["fps"], r["end_frame"]) for r in silent] == [(4.0, 25.0, 99)]
    assert windows.temporal_windows(keyframes(spark, 1).where("false"), 5.0, 5.0).count() == 0
    with pytest.raises(Exception, match="negative duration"):
        windows.temporal_windows(keyframes(spark, 1), 5.0, 5.0, durations=durations(spark, -1)).collect()


def test_words_come_before_segments(spark):
    w = windows.temporal_windows(keyframes(spark, 1, 6), 5.0, 5.0, durations=durations(spark, 10))
    words = [("đầu", 1.0, 1.4), (" ", 1.5, 1.6), (" giữa", 4.8, 5.2), ("cuối", 8.0, 8.4)]
    s = spark.createDataFrame([("L01_V001", 0, 9, 0.0, 10.0, "whole", words), ("L01_V001", 1, 3, 9.0, 10.0, "late", [(" ", 9.0, 9.1)]), ("L01_V001", 2, 4, 0.0, 5.0, None, None)], SEGMENTS)
    got = windows.aligned_text(w, s, 5.0, 5.0, 0.9).orderBy("k").collect()
    assert [(r["asr_text"], r["asr_segment_ids"]) for r in got] == [("đầu", [9, 4]), ("giữa cuối late", [9, 3])]
    for wrong in ([("L01_V001", 0, 9, 2.0, 1.0, "x", [])], [("L01_V001", 0, 9, 0.0, 1.0, "x", [("a", 2.0, 1.0)])]):
        with pytest.raises(Exception, match="ends before"):
            windows.aligned_text(w, spark.createDataFrame(wrong, SEGMENTS), 5.0, 5.0).collect()
    with pytest.raises(ValueError):
        windows.aligned_text(w, s, 5.0, 5.0, 1.5)
    assert windows.aligned_text(w, s.where("false"), 5.0, 5.0).count() == 0


def field(spark, name, rows, weight=1.0):
    """A field that finds the same rows (candidate_id, score) for every text that holds a word."""
    table = spark.createDataFrame(rows, "word string, candidate_id long, score double")
    return heads.Field(name, lambda texts, k: texts.join(table, F.contains(F.lower("text"), F.col("word"))).select(F.col("vec_id").alias("query_id"), "candidate_id", "score"), weight, 5)


@pytest.fixture
def setting(spark):
    queries = spark.createDataFrame([(1, "red car"), (2, "blue logo"), (3, " "), (4, "nothing")], "query_id long, text string")
    fields = [field(spark, "asr", [("red", 1, 0.9), ("red", 2, 0.8), ("car", 2, 0.95), ("blue", 3, 0.5)]), field(spark, "ocr", [("blue", 4, 0.4), ("logo", 3, 0.3), ("red", 5, 0.2)], 0.5)]
    places = spark.createDataFrame([(1, 1, 10, 1.0), (2, 1, 30, 3.0), (3, 2, 5, None), (4, 2, 5, None), (5, None, None, None)], "candidate_id long, video_id long, frame long, ts double")
    return queries, fields, places


def test_search_with_variants_and_hints(spark, setting):
    queries, fields, places = setting
    found, counts = heads.search(queries, fields, places, limit=10, same_video=0.0, temporal=0.0, paraphrases=[lambda x: F.regexp_replace(x, "^red ", "")])
    assert {(r["query_id"], r["source"]): r["n"] for r in counts.collect()} == {(1, "asr"): 2, (1, "ocr"): 1, (2, "asr"): 1, (2, "ocr"): 2}
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["candidate_id"], round(r["score"], 9), r["frame"]))
    # the text has 2 at 0.95 and 1 at 0.9; the hint doubles the weight of ocr for a logo
    assert got == {1: [(2, round(1 / 61, 9), 30), (1, round(1 / 62, 9), 10), (5, round(0.5 / 61, 9), None)], 2: [(3, round(1 / 61 + 1 / 62, 9), 5), (4, round(1 / 61, 9), 5)]}
    assert heads.search(queries.where("false"), fields, places)[0].count() == 0
    for wrong in ([], [fields[0], fields[0]]):
        with pytest.raises(ValueError):
            heads.search(queries, wrong, places)


def test_known_items_to_frames(spark, setting):
    queries, fields, places = setting
    plain = heads.known_items(queries, fields, places, heads.Options(temporal=0.0, same_video=0.0, top_k=3))
    got = {(r["query_id"], r["rank"]): (r["video_id"], r["frame"], r["refined"]) for r in plain.collect()}
    assert got == {(1, 1): (1, 30, False), (1, 2): (1, 10, False), (2, 1): (2, 5, False)}  # two candidates of one frame answer once
    frames = spark.createDataFrame([(1, 10, 1.0), (1, 60, 2.5), (1, 30, 3.0), (1, 99, 9.0)], "video_id long, frame long, ts double")
    options = heads.Options(temporal=0.0, same_video=0.0, refine_top=1, radius=1.0)
    fine = heads.known_items(queries, fields, places, options, frames=frames, semantic=F.col("frame") / 100.0)
    rows = [(r["video_id"], r["frame"], round(r["score"], 6), r["refined"]) for r in fine.where("query_id = 1").orderBy("rank").collect()]
    top = 1 / 61  # candidate 2: first in asr
    assert rows == [(1, 60, round(0.2 * top + 0.8 * 0.6, 6), True), (1, 30, round(0.2 * top + 0.8 * 0.3, 6), True), (1, 10, round(1 / 62, 6), False)]
    assert [(r["frame"], r["refined"]) for r in fine.where("query_id = 2").collect()] == [(5, False)]  # no time, not refined
    turned = heads.known_items(queries, fields, places, heads.Options(temporal=0.0), rerank=lambda c: c.withColumn("score", -F.col("score")))
    assert [r["frame"] for r in turned.where("query_id = 1").orderBy("rank").collect()] == [10, 30]
    weighted = heads.known_items(queries, fields, places, heads.Options(method="weighted", temporal=0.0, same_video=0.0))
    assert [r["frame"] for r in weighted.where("query_id = 1").orderBy("rank").collect()] == [30, 10]
    for wrong in ({"pool": 0}, {"top_k": 0}, {"refine_top": -1}):
        with pytest.raises(ValueError):
            heads.Options(**wrong)
    with pytest.raises(ValueError, match="no fusion method"):
        heads.known_items(queries, fields, places, heads.Options(method="other"))


def test_weights_by_query(spark):
    hits = spark.createDataFrame([(1, "a", 7, 0.9), (1, "b", 8, 0.9), (2, "a", 7, 0.9)], "query_id long, source string, candidate_id long, score double")
    weights = spark.createDataFrame([(1, "a", 2.0), (1, "b", 0.0)], "query_id long, source string, weight double")
    got = {(r["query_id"], r["candidate_id"]): round(r["score"], 9) for r in fusion.reciprocal_rank_fusion(hits, weights).collect()}
    assert got == {(1, 7): round(2 / 61, 9), (1, 8): 0.0, (2, 7): round(1 / 61, 9)}
    with pytest.raises(Exception, match="not negative"):
        fusion.weighted_score_fusion(hits, weights.withColumn("weight", -F.col("weight") - 1)).collect()


def test_ordered_events_share_a_coarse_time(spark):
    """Two events in one coarse window are told apart by the frames around it; without that they cannot be in order."""
    from cinderloom.operators import tasks, timeline

    rows = [(1, 0, 7, 10.0, 250, 0.9), (1, 1, 7, 10.0, 250, 0.8), (1, 0, 8, 10.0, 250, 0.5), (1, 1, 8, 20.0, 500, 0.5)]
    c = spark.createDataFrame(rows, "query_id long, event int, video_id long, ts double, frame long, score double")
    whole = spark.createDataFrame([(1, 7, 1.0), (1, 8, 0.5)], "query_id long, video_id long, score double")
    frames = spark.createDataFrame([(7, 225, 9.0, 1.0, 0.0), (7, 250, 10.0, 0.1, 0.2), (7, 275, 11.0, 0.0, 1.0), (7, 999, 40.0, 9.0, 9.0)], "video_id long, frame long, ts double, one double, two double")
    plain = tasks.trake(c, whole, 2).collect()
    assert [(r["video_id"], r["frames"]) for r in plain] == [(8, [250, 500])]
    fine = tasks.trake(c, whole, 2, frames=frames, semantics=[F.col("one"), F.col("two")]).orderBy("rank").collect()
    assert [(r["video_id"], r["frames"]) for r in fine] == [(7, [225, 275]), (8, [250, 500])]
    assert abs(fine[0]["score"] - ((0.2 * 0.9 + 0.8 + 0.2 * 0.8 + 0.8) / 2 + 0.2)) < 1e-9
    swapped = tasks.trake(c, whole, 2, frames=frames, semantics=[F.col("two"), F.col("one")]).collect()
    assert 7 not in {r["video_id"] for r in swapped} or all(a < b for r in swapped for a, b in zip(r["frames"], r["frames"][1:], strict=False))
    assert timeline.align(c, 2, strict=False).where("video_id = 7").count() == 1 and timeline.align(c, 2).where("video_id = 7").count() == 0


def test_lines_of_ordered_events(spark):
    from cinderloom.operators import evaluate

    rows = lambda *r: spark.createDataFrame(list(r), "query_id string, rank int, video_id string, frames array<long>")
    assert [r["line"] for r in evaluate.ordered_lines(rows(("q", 1, "L01_V001", [3, 20]), ("q", 2, "L02_V001", [0]))).orderBy("rank").collect()] == ["L01_V001,3,20", "L02_V001,0"]
    for wrong, message in ((("q", 101, "v", [1]), "more than 100"), (("q", 1, "v", []), "without frames"), (("q", 1, "v", None), "without frames"), (("q", 1, "v", [1, -1]), "negative"), (("q", 1, "v", [None]), "null")):
        with pytest.raises(Exception, match=message):
            evaluate.ordered_lines(rows(wrong)).collect()
