"""Requests to a model that answers questions about candidates: cache, attempts, checks, audit.

Requests with one key are asked once. What the cache lacks is asked in rounds of one attempt each; after a round only the
requests that may be tried again go into the next, and each round is written, so that a lost executor repeats calls of one
round at most. A reply counts if it is a JSON object with all fields of the right type; whether it names a candidate of its
request is seen after that and not tried again. Only good replies go into the cache, and every attempt into the audit.

Defined results: a cached reply that does not fit is an error, like a request without a key. An answer is null where the
model says that there is none. Empty tables give empty results. Columns of requests that are not named are dropped.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions import text as T
from ..functions import variants as V

# The fields of a reply, and the reasons to stop after which a request is not tried again.
FIELDS = ("answerable", "answer", "normalized_answer", "answer_type", "supporting_candidate_id", "confidence", "evidence", "uncertainty_reason")
FINAL_REASONS = (
    "SAFETY", "RECITATION", "LANGUAGE", "BLOCKLIST", "PROHIBITED_CONTENT", "SPII", "MALFORMED_FUNCTION_CALL", "IMAGE_SAFETY",
    "UNEXPECTED_TOOL_CALL", "IMAGE_PROHIBITED_CONTENT", "NO_IMAGE", "IMAGE_RECITATION",
)
TOO_LONG = "MAX_TOKENS"
#: (prompt, attempt, tokens) -> (text, reason to stop). ValueError, TypeError and OSError end a request, other errors do not.
Transport = Callable[[str, int, int], tuple[str | None, str | None]]


@dataclass(frozen=True)
class Policy:
    """How often and with which room a request is tried, and how long is waited in between."""

    attempts: int = 3
    tokens: int = 2048
    most_tokens: int = 8192
    first_delay: float = 1.0
    most_delay: float = 8.0
    jitter: float = 0.2

    def __post_init__(self) -> None:
        if self.attempts < 1 or not 0 < self.tokens <= self.most_tokens or self.first_delay < 0 or not 0 <= self.jitter <= 1:
            raise ValueError("a policy has an attempt, room, and delays that are not negative")

    def delay(self, attempt: Column, key: Column) -> Column:
        """Seconds before ``attempt``: doubled each time up to the most, give or take a share that the key decides."""
        share = F.pmod(F.xxhash64(key, attempt), F.lit(1 << 20)) / float(1 << 20) * 2 - 1
        return F.when(attempt <= 1, 0.0).otherwise(T.retry_delay(attempt - 1, self.first_delay, self.most_delay) * (1 + self.jitter * share))


def _optional(value: Column) -> tuple[Column, Column]:
    """A trimmed text or null if blank, and whether it is neither text nor null."""
    read = V.string(value)
    return F.nullif(F.trim(read), F.lit("")), ~V.absent(value) & read.isNull()


def reply_code(value: Column) -> Column:
    """What is wrong with a reply (a variant), null if nothing is."""
    m = V.members(value)
    field = {n: V.at(value, n) for n in FIELDS}
    answer, bad_answer = _optional(field["answer"])
    normal, bad_normal = _optional(field["normalized_answer"])
    support, bad_support = _optional(field["supporting_candidate_id"])
    _, bad_reason = _optional(field["uncertainty_reason"])
    confidence, evidence = V.number(field["confidence"]), V.items(field["evidence"])
    answerable = F.when(F.schema_of_variant(field["answerable"]) == "BOOLEAN", F.try_variant_get(field["answerable"], "$", "boolean"))
    return V.first_code(
        (value.isNull(), "not_json"), (m.isNull(), "not_an_object"), *[(field[n].isNull(), f"missing_{n}") for n in FIELDS], (answerable.isNull(), "bad_answerable"), (bad_answer, "bad_answer"),
        (bad_normal, "bad_normalized_answer"), (F.coalesce(F.trim(V.string(field["answer_type"])), F.lit("")) == "", "bad_answer_type"), (bad_support, "bad_supporting_candidate_id"),
        (confidence.isNull(), "bad_confidence"), (~confidence.between(0, 1), "confidence_range"), (evidence.isNull() | F.exists(evidence, lambda e: F.coalesce(F.trim(V.string(e)), F.lit("")) == ""), "bad_evidence"),
        (bad_reason, "bad_uncertainty_reason"), (answerable & (answer.isNull() | normal.isNull()), "missing_answer"), (answerable & support.isNull(), "missing_support"),
    )


def _asked_once(pending: DataFrame, transport: Transport, wait: bool) -> DataFrame:
    """(key, attempt, tokens, reply, reason, error, final): one call a row of (key, prompt, attempt, tokens, delay)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                reply = reason = error = None
                final = False
                if wait and r["delay"]:
                    time.sleep(r["delay"])
                try:
                    reply, reason = transport(r["prompt"], r["attempt"], r["tokens"])
                except (ValueError, TypeError, OSError) as e:
                    error, final = f"{type(e).__name__}: {e}"[:1000], True
                except Exception as e:  # noqa: BLE001 whatever a service raises may pass
                    error = f"{type(e).__name__}: {e}"[:1000]
                values = [r["key"], r["attempt"], r["tokens"], reply, reason, error, final]
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["key", "attempt", "tokens", "reply", "reason", "error", "final"])

    return pending.select("key", "prompt", "attempt", "tokens", "delay").mapInArrow(run, "key string, attempt int, tokens int, reply string, reason string, error string, final boolean")


def ask(
    requests: DataFrame, cache: DataFrame, transport: Transport, policy: Policy | None = None, *, wait: bool = True, parallel: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers, audit and new cache rows for requests (request_id, key, prompt, labels) and a cache (key, reply).

    Answers: (request_id, status, code, cached, attempts, answerable, answer, normalized_answer, answer_type, label,
    confidence, evidence). Audit: (key, attempt, tokens, reason, error, code). Cache rows: (key, reply). ``parallel`` is the
    number of tasks that call at once; with ``wait`` a task waits before it tries again.
    """
    policy = policy or Policy()
    spark = requests.sparkSession
    stop = F.raise_error(F.lit("a request has no key")).cast("string")
    asked = storage.stored(requests.select("request_id", F.coalesce("key", stop).alias("key"), "prompt", "labels"), "requests")
    kept = cache.groupBy("key").agg(F.min("reply").alias("reply"))
    hits = asked.select("key").distinct().join(kept, "key")
    pending = asked.groupBy("key").agg(F.min("prompt").alias("prompt")).join(kept, "key", "left_anti")
    pending = pending.select("key", "prompt", F.lit(1).alias("attempt"), F.lit(policy.tokens).alias("tokens"))
    rounds = None
    for attempt in range(1, policy.attempts + 1):
        pending = pending.withColumn("delay", policy.delay(F.col("attempt"), F.col("key")))
        calls = _asked_once(pending.repartition(parallel or spark.sparkContext.defaultParallelism, "key"), transport, wait)
        value = V.computed(calls, {"v": F.try_parse_json("reply")})
        whole = V.members(F.col("v")).isNotNull()
        code = V.first_code(
            (F.col("error").isNotNull(), "error"), ((F.col("reason") == TOO_LONG) & ~whole, "truncated"), (F.col("reason").isin(*FINAL_REASONS) & ~whole, "stopped"),
            (F.coalesce(F.trim("reply"), F.lit("")) == "", "no_text"),
        )
        value = V.computed(value, {"code": F.coalesce(code, reply_code(F.col("v")))}).drop("v")
        done = storage.stored(value.withColumn("final", F.col("final") | (F.col("code") == "stopped") | F.col("code").isNull() | F.lit(attempt == policy.attempts)), "attempts")
        rounds = done if rounds is None else rounds.unionByName(done)
        if attempt == policy.attempts:
            break
        again = done.where("NOT final").select("key", F.when(F.col("code") == "truncated", F.least(F.col("tokens") * 2, F.lit(policy.most_tokens))).otherwise(F.col("tokens")).alias("tokens"))
        pending = again.join(pending.select("key", "prompt"), "key").select("key", "prompt", F.lit(attempt + 1).alias("attempt"), "tokens")
    last = rounds.where("final").select("key", "reply", "code", "attempt", F.lit(False).alias("cached"))
    both = last.unionByName(hits.select("key", "reply", F.lit(None).cast("string").alias("code"), F.lit(0).alias("attempt"), F.lit(True).alias("cached")))
    a = V.computed(asked.select("request_id", "key", "labels").join(both, "key"), {"v": F.when(F.col("code").isNull(), F.try_parse_json("reply"))})
    stale = F.raise_error(F.concat(F.lit("a cached reply does not fit: "), F.col("key"))).cast("string")
    read = lambda n: F.when(F.col("code").isNull(), F.nullif(F.trim(V.string(V.at(F.col("v"), n))), F.lit("")))
    a = V.computed(a, {
        "code": F.when(F.col("cached") & reply_code(F.col("v")).isNotNull(), stale).otherwise(F.col("code")), "label": read("supporting_candidate_id"), "answer": read("answer"),
        "normalized_answer": read("normalized_answer"), "answer_type": read("answer_type"), "answerable": F.try_variant_get(V.at(F.col("v"), "answerable"), "$", "boolean"),
        "confidence": V.number(V.at(F.col("v"), "confidence")), "evidence": F.transform(V.items(V.at(F.col("v"), "evidence")), lambda e: F.trim(V.string(e))),
    })
    a = a.withColumn("code", F.when(F.col("code").isNull() & F.col("label").isNotNull() & ~F.array_contains("labels", F.col("label")), "unknown_support").otherwise(F.col("code")))
    good = F.col("code").isNull()
    answers = a.select(
        "request_id", F.when(good, "success").otherwise("error").alias("status"), "code", "cached", F.col("attempt").alias("attempts"),
        *[F.when(good, F.col(c)).alias(c) for c in ("answerable", "answer", "normalized_answer", "answer_type", "label", "confidence", "evidence")],
    )
    answers = storage.stored(answers, "answers")
    fitting = asked.select("request_id", "key").join(answers.where("status = 'success' AND NOT cached").select("request_id"), "request_id").select("key").distinct()
    new = last.where("code IS NULL").join(fitting, "key", "left_semi").select("key", "reply")
    return answers, rounds.select("key", "attempt", "tokens", "reason", "error", "code"), new
