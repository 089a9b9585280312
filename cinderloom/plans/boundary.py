"""Queries over the model boundary, with a stand-in for the model, and their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import model
from ..sources import tables

POLICY = model.Policy(attempts=3, tokens=100, most_tokens=300)


def stand_in(prompt: str, attempt: int, tokens: int) -> tuple[str | None, str | None]:
    """Behaves by the number at the end of the prompt: most replies are good at once, others need room or time or fail."""
    number = int(prompt.rsplit(" ", 1)[1])
    case = number % 10
    reply = {
        "answerable": case != 1, "answer": None if case == 1 else f" blue {number}", "normalized_answer": None if case == 1 else f"blue {number}", "answer_type": "other",
        "supporting_candidate_id": None if case == 1 else "C09" if case == 2 else f"C0{number % 3 + 1}", "confidence": 0.5, "evidence": ["seen"], "uncertainty_reason": None,
    }
    if case == 3 and tokens < 300:
        return json.dumps(reply)[:20], "MAX_TOKENS"
    if case == 4 and attempt < 2:
        raise RuntimeError("busy")
    if case == 5:
        return None, "SAFETY"
    if case == 6:
        raise ValueError("no image")
    if case == 7:
        return json.dumps(reply | {"confidence": 2}), "STOP"
    return json.dumps(reply), "STOP"


def _requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A request for every turn of the conversations, two thirds of them alike, and a cache of some."""
    c = tables.read(spark, sf_dir, "conversations")
    number = F.floor((F.col("conv_id") * 10 + F.col("turn")) / 3)
    r = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.concat(F.lit("k"), number).alias("key"), F.concat(F.lit("what is in "), number).alias("prompt"), F.array(*[F.lit(f"C0{k}") for k in (1, 2, 3)]).alias("labels"), number.alias("number"))
    reply = F.to_json(F.struct(
        F.lit(True).alias("answerable"), F.lit("old").alias("answer"), F.lit("old").alias("normalized_answer"), F.lit("other").alias("answer_type"), F.lit("C01").alias("supporting_candidate_id"),
        F.lit(1).alias("confidence"), F.array(F.lit("x")).alias("evidence"), F.lit(None).cast("string").alias("uncertainty_reason"),
    ), {"ignoreNullFields": "false"})
    return r.drop("number"), r.where("number % 4 = 0").select("key", reply.alias("reply")).distinct()


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, cache = _requests(spark, sf_dir)
    answers, _, _ = model.ask(requests, cache, stand_in, POLICY, wait=False)
    return answers.select("request_id", "status", "code", "cached", F.col("attempts").cast("long").alias("attempts"), "answerable", "answer", "label", "confidence")


def model_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, cache = _requests(spark, sf_dir)
    _, audit, new = model.ask(requests, cache, stand_in, POLICY, wait=False)
    return audit.join(new.select("key", F.lit(True).alias("stored")), "key", "left").select("key", F.col("attempt").cast("long").alias("attempt"), F.col("tokens").cast("long").alias("tokens"), "reason", "error", "code", F.coalesce("stored", F.lit(False)).alias("stored"))


QUERIES = {f.__name__: f for f in (model_answers, model_audit)}

_ASKED = """asked AS (
  SELECT conv_id * 1000 + turn AS request_id, (conv_id * 10 + turn) // 3 AS number FROM conversations
), known AS (
  SELECT request_id, number, number % 4 = 0 AS cached, number % 10 AS kind FROM asked
)"""
SOURCES = {
    "model_answers": f"""WITH {_ASKED}, coded AS (
  SELECT *, CASE WHEN cached THEN NULL WHEN kind = 2 THEN 'unknown_support' WHEN kind = 5 THEN 'stopped' WHEN kind = 6 THEN 'error' WHEN kind = 7 THEN 'confidence_range' END AS code FROM known
)
SELECT request_id, CASE WHEN code IS NULL THEN 'success' ELSE 'error' END AS status, code, cached, CAST(CASE WHEN cached THEN 0 WHEN kind IN (3, 7) THEN 3 WHEN kind = 4 THEN 2 ELSE 1 END AS BIGINT) AS attempts,
  CASE WHEN code IS NULL THEN cached OR kind <> 1 END AS answerable, CASE WHEN code IS NULL THEN CASE WHEN cached THEN 'old' WHEN kind <> 1 THEN 'blue ' || number END END AS answer,
  CASE WHEN code IS NULL THEN CASE WHEN cached THEN 'C01' WHEN kind <> 1 THEN 'C0' || (number % 3 + 1) END END AS label, CASE WHEN code IS NULL THEN CASE WHEN cached THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END END AS confidence
FROM coded""",
    "model_audit": f"""WITH {_ASKED}, tries AS (
  SELECT DISTINCT number, kind, unnest(range(1, CASE WHEN kind IN (3, 7) THEN 4 WHEN kind = 4 THEN 3 ELSE 2 END)) AS attempt FROM known WHERE NOT cached
)
SELECT 'k' || number AS key, attempt, CASE WHEN kind = 3 THEN [100, 200, 300][attempt] ELSE 100 END::BIGINT AS tokens,
  CASE WHEN kind = 3 AND attempt < 3 THEN 'MAX_TOKENS' WHEN kind = 5 THEN 'SAFETY' WHEN kind = 6 OR (kind = 4 AND attempt = 1) THEN NULL ELSE 'STOP' END AS reason,
  CASE WHEN kind = 6 THEN 'ValueError: no image' WHEN kind = 4 AND attempt = 1 THEN 'RuntimeError: busy' END AS error,
  CASE WHEN kind = 3 AND attempt < 3 THEN 'truncated' WHEN kind = 5 THEN 'stopped' WHEN kind = 6 OR (kind = 4 AND attempt = 1) THEN 'error' WHEN kind = 7 THEN 'confidence_range' END AS code,
  kind NOT IN (2, 5, 6, 7) AS stored
FROM tries""",
}
