"""Files in the collection's own formats, with literal expected rows."""

import json

import pytest
from pyspark.sql import functions as F

from cinderloom.functions import text
from cinderloom.operators import artifacts, evaluate, hits, objects
from cinderloom.sources import evaluation, readers, transcripts

TRUTH = {
    "KIS001": {"task_type": "kis", "relevant_intervals": [{"video_id": "L01_V001", "start_frame": 500, "end_frame": 510}]},
    "QA001": {"task_type": " QA", "relevant_intervals": [{"video_id": "L05_V005", "start_frame": 800, "end_frame": 900}], "accepted_answers": ["màu xanh", "xanh", " ", "blue"]},
    "TRAKE001": {
        "task_type": "trake", "video_id": "L10_V010",
        "events": [{"intervals": [{"start_frame": 95, "end_frame": 105}]}, {"intervals": [{"start_frame": 145, "end_frame": 155}]}, {"intervals": [{"start_frame": 195, "end_frame": 205}, {"start_frame": 300, "end_frame": 301}]}],
    },
}
RUN = {
    "KIS001": [{"video_id": "L01_V001", "frame_ids": [505], "score": 0.91}],
    "QA001": [{"video_id": "L05_V005", "frame_ids": [888], "answer": "Xanh!", "score": 0.88}],
    "TRAKE001": [{"video_id": "L10_V010", "frame_ids": [101, 156, 300], "score": 0.84}, {"video_id": "L10_V011", "frame_ids": [101, 151, 203]}],
}


def files(spark, *rows):
    return spark.createDataFrame([(k, None if v is None else v if isinstance(v, str) else json.dumps(v), *more) for k, (v, *more) in enumerate(rows)], "file int, value string, asked_id string")


def test_predictions_in_every_shape(spark):
    wrapper = {"query_id": " KIS001 ", "task_type": "kis", "predictions": [{"video_id": " L01_V001", "frame_ids": [15], "score": 0.9}, {"video_id": "L01_V002", "frame_idx": "16", "answer": None}]}
    rows, bad = evaluation.predictions(files(spark, (wrapper, None), (RUN, None), ([{"video_id": "L01_V001", "frame_ids": [15, 16.7]}], "KIS001")))
    got = {(r["file"], r["query_id"], r["rank"]): (r["task"], r["video_id"], r["frames"], r["answer"], r["score"]) for r in rows.collect()}
    assert got == {
        (0, "KIS001", 1): ("KIS", "L01_V001", [15], None, 0.9), (0, "KIS001", 2): ("KIS", "L01_V002", [16], None, None),
        (1, "KIS001", 1): (None, "L01_V001", [505], None, 0.91), (1, "QA001", 1): (None, "L05_V005", [888], "Xanh!", 0.88),
        (1, "TRAKE001", 1): (None, "L10_V010", [101, 156, 300], None, 0.84), (1, "TRAKE001", 2): (None, "L10_V011", [101, 151, 203], None, None),
        (2, "KIS001", 1): (None, "L01_V001", [15, 16], None, None),
    }
    assert bad.count() == 0


def test_prediction_problems(spark):
    item = {"video_id": "v", "frame_ids": [1]}
    cases = [
        (None, None, "not_json"), ("{", None, "not_json"), ([item], None, "no_query_id"), ([item], " ", "no_query_id"), ({"query_id": " ", "predictions": []}, None, "no_query_id"),
        ({"query_id": 5, "predictions": []}, None, "no_query_id"), ({"query_id": "a", "predictions": []}, "b", "other_query_id"), ({" ": []}, None, "no_query_id"), ({"q": {}}, None, "not_a_list"),
        ({"query_id": "a", "predictions": "x"}, None, "not_a_list"), ("3", "q", "not_a_list"), ([7], "q", "not_an_object"), ([{"frame_ids": [1]}], "q", "no_video_id"), ([{"video_id": "v"}], "q", "no_frames"),
        ([{"video_id": "v", "frame_ids": []}], "q", "no_frames"), ([{"video_id": "v", "frame_ids": "12"}], "q", "frames_not_a_list"), ([{"video_id": "v", "frame_ids": [1, -1]}], "q", "bad_frame"),
        ([{"video_id": "v", "frame_idx": "1.5"}], "q", "bad_frame"), ([dict(item, answer=3)], "q", "bad_answer"), ([dict(item, score="high")], "q", "bad_score"),
    ]
    rows, bad = evaluation.predictions(files(spark, *((v, q) for v, q, _ in cases)))
    assert rows.count() == 0 and {r["file"]: r["code"] for r in bad.collect()} == {k: c for k, (_, _, c) in enumerate(cases)}
    rows, bad = evaluation.predictions(files(spark, ([item, {}, item], "q")))
    assert sorted(r["rank"] for r in rows.collect()) == [1, 3] and [(r["rank"], r["code"]) for r in bad.collect()] == [(2, "no_video_id")]
    assert all(d.count() == 0 for d in evaluation.predictions(files(spark, (RUN, None)).where("false")))
    with pytest.raises(ValueError, match="task"):
        evaluation.predictions(files(spark, (RUN, None)).withColumn("task", F.lit(1)))


def test_ground_truth(spark):
    truth, accepted, bad = evaluation.ground_truth(files(spark, (TRUTH, None)).drop("asked_id"))
    assert sorted((r["query_id"], r["task"], r["video_id"], r["event"], r["start"], r["end"]) for r in truth.collect()) == [
        ("KIS001", "KIS", "L01_V001", None, 500, 510), ("QA001", "QA", "L05_V005", None, 800, 900), ("TRAKE001", "TRAKE", "L10_V010", 0, 95, 105), ("TRAKE001", "TRAKE", "L10_V010", 1, 145, 155),
        ("TRAKE001", "TRAKE", "L10_V010", 2, 195, 205), ("TRAKE001", "TRAKE", "L10_V010", 2, 300, 301),
    ]
    assert sorted((r["query_id"], r["answer"]) for r in accepted.collect()) == [("QA001", "blue"), ("QA001", "màu xanh"), ("QA001", "xanh")] and bad.count() == 0
    span = {"video_id": "v", "start_frame": 1, "end_frame": 2}
    wrong = {
        "not_an_object": 3, "unknown_task": {"task_type": "other"}, "no_intervals": {"task_type": "kis"}, "bad_frame": {"task_type": "kis", "relevant_intervals": [dict(span, start_frame=-1)]},
        "reversed_interval": {"task_type": "kis", "relevant_intervals": [span, dict(span, start_frame=3)]}, "no_answers": {"task_type": "qa", "relevant_intervals": [span], "accepted_answers": [" "]},
        "no_events": {"task_type": "trake", "video_id": "v", "events": []}, "no_video_id": {"task_type": "trake", "events": [{"intervals": [span]}]},
    }
    truth, accepted, bad = evaluation.ground_truth(files(spark, (wrong, None), ("[]", None), (None, None)))
    assert truth.count() == 0 and accepted.count() == 0
    assert sorted((r["query_id"] or "", r["code"]) for r in bad.collect()) == sorted([*((k, k) for k in wrong), ("", "not_an_object"), ("", "not_an_object")])


def test_run_against_truth(spark):
    found, _ = evaluation.predictions(files(spark, (RUN, None)))
    truth, accepted, _ = evaluation.ground_truth(files(spark, (dict(TRUTH, KIS002=TRUTH["KIS001"]), None)))
    report = {r["query_id"]: r for r in evaluate.evaluate_run(found, truth, accepted, text.normalize_answer).collect()}
    assert {q: (r["task"], round(r["r1"], 6), round(r["r100"], 6), round(r["final"], 6), r["n_predictions"]) for q, r in report.items()} == {
        "KIS001": ("KIS", 1.0, 1.0, 1.0, 1), "KIS002": ("KIS", 0.0, 0.0, 0.0, 0), "QA001": ("QA", 1.0, 1.0, 1.0, 1), "TRAKE001": ("TRAKE", 0.666667, 0.666667, 0.666667, 2),
    }
    with pytest.raises(Exception, match="unknown query"):
        evaluate.evaluate_run(found, truth.where("task <> 'QA'"), accepted, text.normalize_answer).collect()


LEGACY = {
    "source_video": "C:\\clips\\L21_V001.mp4", "generated_at": "2026-08-04T19:36:00", "pipeline_config": {"asr_model": "m", "device": "cpu"},
    "audio_info": {"duration_sec": 12.0, "detected_language": "vi", "language_probability": 1},
    "segments": [{
        "segment_id": 1, "time_range": {"start": 1.0, "end": 3.0},
        "audio_metadata": {
            "raw_text": "xin chào", "clean_text": "Xin chào.", "confidence": 0.95, "no_speech_prob": 0.01,
            "words": [{"word": "xin", "start": 1.0, "end": 1.4, "probability": 0.9}, {"word": "", "start": 1.4, "end": 2.0, "probability": 0.92}],
        },
    }],
}
CANONICAL = {
    "video_id": "L21_V001", "model_name": "m", "language": None, "language_probability": 0.99, "duration_seconds": 4.0, "source_path": "a/b.mp4",
    "segments": [{"segment_id": 0, "start": 1, "end": 2.0, "text": "xin chào", "avg_logprob": -0.1, "no_speech_prob": 0.01, "confidence": 0.9, "words": [{"text": "xin", "start": 1.0, "end": 1.4, "confidence": 0.9}]}, {"segment_id": 5, "start": 2, "end": 2, "text": ""}],
}


def scripts(spark, *values):
    return spark.createDataFrame([(k, v if v is None or isinstance(v, str) else json.dumps(v)) for k, v in enumerate(values)], "file int, value string")


def test_transcripts_of_both_schemas(spark):
    documents, rows, bad = transcripts.transcripts(scripts(spark, LEGACY, CANONICAL))
    assert bad.count() == 0
    assert sorted(tuple(r) for r in documents.collect()) == [
        (0, "legacy", "L21_V001", "m", "vi", 1.0, 12.0, "C:\\clips\\L21_V001.mp4", "2026-08-04T19:36:00"), (1, "canonical", "L21_V001", "m", None, 0.99, 4.0, "a/b.mp4", None),
    ]
    got = [(*tuple(r)[:-1], [tuple(w) for w in r["words"]]) for r in rows.orderBy("file", "position").collect()]
    assert got == [
        (0, "L21_V001", 0, 1, 1.0, 3.0, "Xin chào.", None, 0.01, 0.95, [("xin", 1.0, 1.4, 0.9), ("", 1.4, 2.0, 0.92)]),
        (1, "L21_V001", 0, 0, 1.0, 2.0, "xin chào", -0.1, 0.01, 0.9, [("xin", 1.0, 1.4, 0.9)]), (1, "L21_V001", 1, 5, 2.0, 2.0, "", None, None, None, []),
    ]


def changed(base, path, value):
    """A copy with the value at a path changed, or removed if it is ``...``."""
    out = json.loads(json.dumps(base))
    *way, last = path
    at = out
    for step in way:
        at = at[step]
    if value is ...:
        del at[last]
    else:
        at[last] = value
    return out


def test_transcript_problems(spark):
    segment = CANONICAL["segments"][0]
    cases = [
        (None, "not_json"), ("{", "not_json"), ("[1]", "not_an_object"), ({"segments": []}, "unsupported_schema"), (dict(CANONICAL, source_video="x"), "mixed_schema"),
        (changed(CANONICAL, ["model_name"], ...), "missing_model_name"), (changed(CANONICAL, ["language"], ...), "missing_language"), (changed(CANONICAL, ["language"], 3), "bad_language"),
        (changed(CANONICAL, ["language_probability"], True), "bad_language_probability"), (changed(CANONICAL, ["duration_seconds"], "4"), "bad_duration_seconds"), (changed(CANONICAL, ["segments"], {}), "bad_segments"),
        (changed(LEGACY, ["source_video"], " "), "bad_source_video"), (changed(LEGACY, ["audio_info", "duration_sec"], -1), "bad_duration_sec"),
        (changed(CANONICAL, ["segments", 0, "segment_id"], True), "bad_segment_id"), (changed(CANONICAL, ["segments", 0, "segment_id"], 1.5), "bad_segment_id"), (changed(CANONICAL, ["segments", 0, "segment_id"], 5), "duplicate_segment_id"),
        (changed(CANONICAL, ["segments", 0, "start"], "1"), "bad_start"), (changed(CANONICAL, ["segments", 0, "start"], ...), "missing_start"), (changed(CANONICAL, ["segments", 0, "end"], 0.5), "reversed_time"),
        (changed(CANONICAL, ["segments"], [segment, dict(segment, segment_id=9, start=0.5)]), "unordered_segment"), (changed(CANONICAL, ["segments", 0, "confidence"], 1.5), "bad_confidence"),
        (changed(CANONICAL, ["segments", 0, "words"], 4), "bad_words"), (changed(CANONICAL, ["segments", 0, "words", 0, "end"], 0.9), "reversed_word"), (changed(CANONICAL, ["segments", 0, "words", 0, "end"], 2.2), "word_outside"),
        (changed(CANONICAL, ["duration_seconds"], 1.9), "beyond_duration"), (changed(LEGACY, ["segments", 0, "audio_metadata", "words", 0, "start"], 0.0), "word_outside"),
        (changed(LEGACY, ["segments", 0, "audio_metadata", "words", 1, "start"], 0.99), "unordered_words"), (changed(LEGACY, ["segments", 0, "audio_metadata", "raw_text"], None), "bad_raw_text"),
    ]
    documents, rows, bad = transcripts.transcripts(scripts(spark, *(v for v, _ in cases)))
    assert documents.count() == 0 and rows.count() == 0
    found = {}
    for r in sorted(bad.collect()):
        found.setdefault(r["file"], r["code"])
    assert found == {k: c for k, (_, c) in enumerate(cases)}
    assert all(d.count() == 0 for d in transcripts.transcripts(scripts(spark, LEGACY).where("false")))


def test_detections(spark):
    value = {
        "detection_scores": ["0.9", "0.8", "0.1", "0.7", "0.15"], "detection_class_names": ["/m/person", "/m/person", "/m/cat", "/m/bike", "/m/x"],
        "detection_class_entities": ["Person", "Person", "Cat", " Bicycle", ""],
        "detection_boxes": [["0.1", "0.1", "0.8", "0.8"], ["0.11", "0.11", "0.79", "0.79"], ["0.2", "0.2", "0.3", "0.3"], ["-0.2", "0.5", "0.6", "1.9"], ["0", "0", "1", "1"]],
    }
    short, wrong = dict(value, detection_scores=["1"]), dict(value, detection_scores=["x"] * 5)
    rows, bad = readers.detections(scripts(spark, value, short, wrong, None, "{"))
    assert {r["file"]: r["code"] for r in bad.collect()} == {1: "lengths_differ", 2: "bad_number", 3: "not_json", 4: "not_json"} and rows.count() == 5
    kept = objects.with_aliases(objects.above_threshold(rows, {"/m/cat": 0.05}), {"Person": "người", "/m/bike": "xe đạp"}).orderBy("pos").collect()
    assert [(r["pos"], r["entity"], r["label"], r["alias"]) for r in kept] == [(0, "Person", "person", "người"), (1, "Person", "person", "người"), (2, "Cat", "cat", None), (3, "Bicycle", "bicycle", "xe đạp")]
    assert [kept[3][c] for c in ("x0", "y0", "x1", "y1")] == [0.5, 0.0, 1.0, 0.6] and kept[0]["x0"] == 0.1
    best = objects.suppress(objects.above_threshold(rows, {}).withColumn("frame", F.lit(1)), min_score=0.0)
    assert sorted(r["label"] for r in best.collect()) == ["bicycle", "person"]


def test_names_of_submissions(spark):
    names = spark.createDataFrame([("/a/query-p1-1-kis.txt", "query-1-kis"), ("C:\\b\\QUERY-p12-0020-KIS.txt", "query-20-kis"), ("query-7-kis", "query-7-kis"), (None, None)], "p string, want string")
    assert all(r["got"] == r["want"] for r in names.select(text.submission_stem(F.col("p")).alias("got"), "want").collect())
    for wrong in ("query-1-qa.txt", "query-p1-kis", "queries-1-kis", "x-query-1-kis", "query-1-kis-2"):
        with pytest.raises(Exception, match="not the name"):
            spark.createDataFrame([(wrong,)], "p string").select(text.submission_stem(F.col("p"))).collect()
    queries = spark.createDataFrame([("query-p1-1-kis",), ("query-p1-2-kis",)], "stem string")
    assert sorted(r["submission"] for r in readers.submissions(queries).collect()) == ["query-1-kis", "query-2-kis"]
    twice = queries.unionByName(spark.createDataFrame([("query-p2-01-kis",)], "stem string"))
    assert [(r["submission"], r["stems"]) for r in readers.name_collisions(twice).collect()] == [("query-1-kis", ["query-p1-1-kis", "query-p2-01-kis"])]
    with pytest.raises(Exception, match="several query files"):
        readers.submissions(twice).collect()


def test_sampled_frames(spark):
    spans = spark.createDataFrame([("a", 0.0, 2.0), ("b", 0.5, 0.5), ("c", 0.02, 0.1)], "clip string, start double, end double")
    got = {}
    for r in hits.sampling_grid(spans, 25.0, 2.0).collect():
        got.setdefault(r["clip"], []).append((r["frame"], r["at"]))
    assert [f for f, _ in got["a"]] == [0, 12, 24, 36, 48] and got["b"] == [(12, 0.48)] and [f for f, _ in got["c"]] == [0]
    assert [r["frame"] for r in hits.sampling_grid(spans.where("clip = 'c'"), 25.0, 100.0).collect()] == [0, 1, 2]
    for wrong in ((-0.1, 1.0), (2.0, 1.0)):
        with pytest.raises(Exception, match="reversed"):
            hits.sampling_grid(spark.createDataFrame([wrong], "start double, end double"), 25.0, 2.0).collect()
    with pytest.raises(ValueError):
        hits.sampling_grid(spans, 25.0, 0.0)


def test_requested_order(spark):
    scope = spark.createDataFrame([("V1", 0), ("V2", 1), ("V3", 2)], "video_id string, at int")
    asked = spark.createDataFrame([("V3", 0), ("V1", 1), ("V3", 2)], "video_id string, at int")
    ordered = lambda d: [r["video_id"] for r in d.orderBy("place").collect()]
    assert ordered(artifacts.selected(scope, asked, "video_id", order="at")) == ["V3", "V1"]
    assert ordered(artifacts.selected(scope, asked, "video_id", 1, order="at")) == ["V3"]
    assert ordered(artifacts.selected(scope, None, "video_id", 2, order="at")) == ["V1", "V2"]
    with pytest.raises(ValueError):
        artifacts.selected(scope, asked, "video_id", 0)


def test_signature_layout(spark):
    import hashlib

    rows = spark.createDataFrame([("v", "b.csv", 2, 20), ("v", "a.npy", 1, 10)], "video_id string, path string, length long, mtime long")
    assert artifacts.source_signature(rows, "video_id", "abc").first()["signature"] == hashlib.sha256(b"scope:abc\na.npy:1:10\nb.csv:2:20\n").hexdigest()
