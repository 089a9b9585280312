"""Writers: JSON lines, submissions, and an append-only cache."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_submissions(lines: DataFrame, path: str) -> None:
    """One folder of text per query, its lines in rank order."""
    lines.repartition("query_id").sortWithinPartitions("query_id", "rank").select("query_id", "line").write.mode("overwrite").partitionBy("query_id").text(path)


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a cache or an audit trail."""
    rows.write.mode("append").parquet(path)
