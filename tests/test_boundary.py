"""Model boundary, artifact graph and ingest on hand-made rows."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from cinderloom.operators import artifact_graph as graph
from cinderloom.operators import model
from cinderloom.streaming import ingest

GOOD = {"answerable": True, "answer": " Blue ", "normalized_answer": "blue", "answer_type": "color", "supporting_candidate_id": "C01", "confidence": 0.75, "evidence": [" a cup "], "uncertainty_reason": None}


def scripted():
    """A stand-in that workers need not import: a prompt is a list of replies in order, each [text, reason] or an error's name."""

    def transport(prompt, attempt, tokens):
        step = json.loads(prompt)[attempt - 1]
        if isinstance(step, str):
            raise {"ValueError": ValueError, "OSError": OSError, "RuntimeError": RuntimeError}[step]("no")
        text = step[0]
        return (text if text is None or isinstance(text, str) else json.dumps(text)), step[1]

    return transport


CASES = {
    "at_once": ([[GOOD, "STOP"]], "success", None, 1, 100),
    "whole_at_the_limit": ([[GOOD, "MAX_TOKENS"]], "success", None, 1, 100),
    "room": ([['{"answer', "MAX_TOKENS"], [None, "MAX_TOKENS"], [GOOD, "STOP"]], "success", None, 3, 300),
    "no_room": ([['{"a', "MAX_TOKENS"]] * 3, "error", "truncated", 3, 300),
    "mixed": ([["not json", "STOP"], ['{"a', "MAX_TOKENS"], [GOOD, "STOP"]], "success", None, 3, 200),
    "busy": (["RuntimeError", "RuntimeError", [GOOD, "STOP"]], "success", None, 3, 100),
    "wrong_input": (["ValueError"], "error", "error", 1, 100),
    "no_file": (["RuntimeError", "OSError"], "error", "error", 2, 100),
    "unsafe": ([[None, "SAFETY"]], "error", "stopped", 1, 100),
    "never_valid": ([[dict(GOOD, confidence=2), None]] * 3, "error", "confidence_range", 3, 100),
    "a_list": ([["[]", "STOP"], ["  ", "STOP"], [GOOD, "STOP"]], "success", None, 3, 100),
    "other_candidate": ([[dict(GOOD, supporting_candidate_id="C09"), "STOP"]], "error", "unknown_support", 1, 100),
    "no_answer": ([[dict(GOOD, answerable=False, answer=None, normalized_answer=" ", supporting_candidate_id=None), "STOP"]], "success", None, 1, 100),
}


def requests_of(spark, rows):
    return spark.createDataFrame(rows, "request_id string, key string, prompt string, labels array<string>")


def test_attempts(spark):
    policy = model.Policy(attempts=3, tokens=100, most_tokens=300)
    requests = requests_of(spark, [(k, f"key-{k}", json.dumps(v[0]), ["C01", "C02"]) for k, v in CASES.items()] + [("twin", "key-at_once", json.dumps(CASES["at_once"][0]), ["C02"])])
    cache = spark.createDataFrame([], "key string, reply string")
    answers, audit, new = model.ask(requests, cache, scripted(), policy, wait=False, parallel=3)
    got = {r["request_id"]: r for r in answers.collect()}
    tries = {}
    for r in audit.collect():
        tries.setdefault(r["key"], []).append((r["attempt"], r["tokens"]))
    for name, (_, status, code, attempts, tokens) in CASES.items():
        r = got[name]
        assert (r["status"], r["code"], r["attempts"], r["cached"], max(tries[f"key-{name}"])) == (status, code, attempts, False, (attempts, tokens)), name
    assert (got["at_once"]["answer"], got["at_once"]["label"], got["at_once"]["evidence"], got["no_answer"]["answer"], got["no_answer"]["answerable"]) == ("Blue", "C01", ["a cup"], None, False)
    assert got["twin"]["code"] == "unknown_support"  # the same reply, of which its request does not hold the candidate
    stored = {r["key"] for r in new.collect()}
    assert stored == {f"key-{k}" for k, v in CASES.items() if v[1] == "success"}
    again, audit, more = model.ask(requests, new, scripted(), policy, wait=False)
    hits = {r["request_id"] for r in again.collect() if r["cached"]}
    assert hits == {k for k, v in CASES.items() if v[1] == "success"} | {"twin"}
    assert {r["key"] for r in audit.collect()} == {f"key-{k}" for k, v in CASES.items() if v[1] == "error"} and more.count() == 0


def test_refused_requests_and_caches(spark):
    one = requests_of(spark, [("r", "k", json.dumps([[GOOD, "STOP"]]), ["C01"])])
    for reply in ("{", json.dumps(dict(GOOD, confidence="1"))):
        with pytest.raises(Exception, match="cached reply"):
            model.ask(one, spark.createDataFrame([("k", reply)], "key string, reply string"), scripted())[0].collect()
    with pytest.raises(Exception, match="no key"):
        model.ask(one.withColumn("key", F.lit(None).cast("string")), one.select("key", F.col("prompt").alias("reply")), scripted())
    none = model.ask(one.where("false"), one.select("key", F.col("prompt").alias("reply")).where("false"), scripted())
    assert [t.count() for t in none] == [0, 0, 0]
    for wrong in ({"attempts": 0}, {"tokens": 0}, {"tokens": 10, "most_tokens": 5}, {"first_delay": -1.0}, {"jitter": 2.0}):
        with pytest.raises(ValueError):
            model.Policy(**wrong)


def test_reply_codes(spark):
    cases = [
        ("{", "not_json"), ("3", "not_an_object"), ({k: v for k, v in GOOD.items() if k != "evidence"}, "missing_evidence"), (dict(GOOD, answerable=1), "bad_answerable"), (dict(GOOD, answer=3), "bad_answer"),
        (dict(GOOD, answer_type=" "), "bad_answer_type"), (dict(GOOD, confidence=True), "bad_confidence"), (dict(GOOD, confidence=-0.1), "confidence_range"), (dict(GOOD, evidence="x"), "bad_evidence"),
        (dict(GOOD, evidence=["a", " "]), "bad_evidence"), (dict(GOOD, uncertainty_reason=4), "bad_uncertainty_reason"), (dict(GOOD, answer=" "), "missing_answer"), (dict(GOOD, supporting_candidate_id=None), "missing_support"), (GOOD, None),
    ]
    rows = spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, (v, _) in enumerate(cases)], "k int, j string").withColumn("v", F.try_parse_json("j"))
    assert {r["k"]: r["code"] for r in rows.select("k", model.reply_code(F.col("v")).alias("code")).collect()} == {k: c for k, (_, c) in enumerate(cases)}


def test_delays(spark):
    policy = model.Policy(first_delay=1.0, most_delay=4.0, jitter=0.25)
    rows = spark.range(200).select(F.col("id").cast("string").alias("key"), F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 4, 5)])).alias("attempt"))
    got = {}
    for r in rows.select("attempt", policy.delay(F.col("attempt"), F.col("key")).alias("d")).collect():
        got.setdefault(r["attempt"], []).append(r["d"])
    assert set(got[1]) == {0.0}
    for attempt, base in ((2, 1.0), (3, 2.0), (4, 4.0), (5, 4.0)):
        assert 0.75 * base <= min(got[attempt]) < 0.8 * base and 1.2 * base < max(got[attempt]) <= 1.25 * base


def codes(issues):
    return sorted((r["code"], r["subject"]) for r in issues.collect())


def test_artifact_graph(spark):
    scope = spark.createDataFrame([("a",), ("b",), (None,)], "video_id string")
    assert graph.scope_issues(scope).count() == 0 and codes(graph.scope_issues(scope.where("false"))) == [("empty_configured_scope", "scope")]
    assert codes(graph.same_videos(spark.createDataFrame([("b",), ("c",)], "video_id string"), scope, "timeline")) == [("timeline_scope_mismatch", "a"), ("timeline_scope_mismatch", "c")]
    files = spark.createDataFrame([("a", "z", None), ("b", None, "not_json"), ("c", "c", None)], "file_video string, video_id string, code string")
    assert codes(graph.per_video_files(files, scope, "transcript")) == [("invalid_transcript", "b"), ("transcript_video_id_mismatch", "a")]
    missing = graph.per_video_files(files.where("false"), scope, "ocr", severity=graph.WARNING)
    assert codes(missing) == [("missing_ocr", "a"), ("missing_ocr", "b")] and {r["severity"] for r in missing.collect()} == {"warning"}
    rows = spark.createDataFrame([("w1", "a"), ("w1", "a"), (" ", "b"), ("w2", "x")], "window_id string, video_id string")
    assert codes(graph.rows_in_scope(rows, scope, "window_id", "window")) == [("duplicate_window_window_id", "w1"), ("window_row_scope_mismatch", "w2"), ("window_without_window_id", " ")]
    assert codes(graph.row_counts(rows, spark.createDataFrame([("a", 2), ("b", 3), ("d", 1)], "video_id string, n int"), "timeline")) == [("timeline_count_mismatch", "b"), ("timeline_count_mismatch", "d"), ("timeline_count_mismatch", "x")]
    stated = spark.createDataFrame([("i", 5, "float16"), ("j", 5, "float16"), ("k", 1, None)], "name string, rows int, dtype string")
    found = spark.createDataFrame([("i", 5, "float32"), ("k", 1, None), ("l", 2, "x")], "name string, rows int, dtype string")
    assert codes(graph.stated_values(stated, found, "index", ["rows", "dtype"], "name")) == [("index_dtype_mismatch", "i"), ("missing_index", "j"), ("missing_index_manifest", "l")]
    assert codes(graph.stated_values(stated.limit(1), found.where("false"), "window", ["rows"])) == [("missing_window", "window")]
    indexes = spark.createDataFrame([("i", "i.npy"), ("j", "/etc/x"), ("k", "a\\..\\..\\x"), ("l", "gone.npy"), ("m", "C:/x"), ("n", None)], "name string, path string")
    inventory = spark.createDataFrame([("indexes/i.npy",), ("indexes/i.manifest.json",), ("indexes/z.jsonl",), ("captions/c",), ("other/x",)], "path string")
    assert codes(graph.index_paths(indexes, inventory, "indexes")) == [
        ("index_path_escape", "j"), ("index_path_escape", "k"), ("index_path_escape", "m"), ("index_path_escape", "n"), ("missing_index_vectors", "l"), ("orphan_index_file", "indexes/z.jsonl"),
    ]
    assert codes(graph.forbidden(inventory)) == [("caption_artifacts_forbidden", "captions/c")]
    assert codes(graph.required_indexes(indexes, ["i", "asr_windows"])) == [("missing_required_index", "asr_windows")]
    issues = graph.report(missing, graph.forbidden(inventory))
    assert tuple(graph.passed(issues).first()) == (1, 2, False) and tuple(graph.passed(missing).first()) == (0, 2, True)


def test_ingest_after_a_lost_checkpoint(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, t string").schema
    take = lambda seen: ingest.ingest_missing(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/{seen}", ["id"])
    held = lambda: sorted((r["id"] if r["id"] is not None else -1, r["t"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    spark.createDataFrame([(1, "a"), (1, "a"), (None, "n")], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        take("one")
    assert held() == [(-1, "n"), (1, "a")]
    spark.createDataFrame([(1, "late"), (2, "b"), (None, "n")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    take("one")
    assert held() == [(-1, "n"), (1, "a"), (2, "b")]
    take("two")  # another checkpoint reads everything again
    assert held() == [(-1, "n"), (1, "a"), (2, "b")]
    shutil.rmtree(f"{tmp_path}/one/commits")  # the last batch counts as not committed and is replayed
    take("one")
    assert held() == [(-1, "n"), (1, "a"), (2, "b")]
