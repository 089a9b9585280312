"""What operators leave on disk while they run."""

import glob
import time

from pyspark.sql import functions as F

from cinderloom.llm import suffix_dedup, support


def shuffle_files(spark):
    folders = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    return {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}


def test_materialize_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    kept = support.materialize(spark.range(1000).withColumn("k", F.col("id") % 7).repartition(5, "k"))
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    assert kept.count() == 1000 and kept.agg(F.sum("k")).first()[0] == sum(i % 7 for i in range(1000))


def test_suffix_dedup_exchanges_texts_once(spark):
    passage = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"{i} starts. {passage} and ends {i}") for i in range(20)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = suffix_dedup.remove_repeats(docs)
        rows = {r["doc_id"]: r for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows[0]["n_removed"] == 0 and all(rows[i]["n_removed"] >= len(passage) for i in range(1, 20))
    assert "ReusedExchange" in plan.split("== Initial Plan ==")[0]
