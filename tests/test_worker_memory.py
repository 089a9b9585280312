"""What Spark sends a Python worker of a search at a time."""

import os
import subprocess
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cinderloom.operators import embed, search
from cinderloom.session import ARROW_BYTES

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_texts_arrive_a_few_at_a_time(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    before = spark.conf.get(SETTING)
    spark.conf.set(SETTING, "64m")
    try:
        rows = spark.range(0, 80, 1, 1).select("id", F.repeat(F.lit("xxxxxxx "), 1 << 15).alias("text"))
        assert embed.hash_embed(rows, "id", "text", dim=4).count() == 80
        got = rows.mapInArrow(sizes, "n long, size long").collect()
    finally:
        spark.conf.set(SETTING, before)
    assert sum(r["n"] for r in got) == 80
    assert max(r["size"] for r in got) <= ARROW_BYTES + (1 << 20)


def test_blocks_of_vectors_arrive_a_few_at_a_time(spark):
    matrix = np.round(np.random.default_rng(3).normal(size=(400, 8)), 3)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(matrix)], "vec_id long, v array<double>").coalesce(1)
    before = spark.conf.get(SETTING)
    found = search.knn_batch(rows, rows.where("vec_id % 100 = 0"), 5, block_bytes=1024)
    assert int(spark.conf.get(SETTING)) == ARROW_BYTES
    spark.conf.set(SETTING, "4096")
    try:
        got = found.collect()
    finally:
        spark.conf.set(SETTING, before)
    scores = np.round(matrix @ matrix.T, 9)
    for q in range(0, 400, 100):
        want = sorted(range(400), key=lambda j: (-scores[q, j], j))[:5]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_texts_are_embedded_and_packed_by_one_worker(spark):
    rows = spark.range(0, 300, 1, 2).select("id", F.concat_ws(" ", F.lit("word"), F.col("id") % 7, F.col("id") % 40).alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(300, None)], "id long, text string"))
    packed, plain = (embed.hash_embed(rows, "id", "text", dim=16, place=embed.md5_place, packed=x) for x in (True, False))
    found = search.knn_batch(packed, packed, 5)
    assert sorted(found.collect()) == sorted(search.knn_batch(plain, plain, 5).collect())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3  # texts to blocks on either side, and scores


def test_workers_of_a_search_do_without_pandas():
    code = """
import sys
import numpy as np
import pyarrow as pa
from cinderloom.operators import embed, search
lengths, values = (pa.Array.from_buffers(k, 2, [None, pa.py_buffer(np.array(x))]) for k, x in ((pa.int64(), [7, 8]), (pa.float64(), [0.5, 1.5])))
v = pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), 3, [None, pa.py_buffer(np.arange(3, dtype=np.int32))]), values)
batch = pa.RecordBatch.from_arrays([lengths, v], names=["vec_id", "v"])
assert len(list(embed.parts(batch, 4))) == 1
got = next(iter(search.packer()(iter([batch]))))
assert "pandas" not in sys.modules
assert got.to_pylist() == [{"ids": [7, 8], "width": 1, "matrix": np.array([0.5, 1.5]).tobytes()}]
"""
    subprocess.run([sys.executable, "-c", code], check=True, env=os.environ)


def test_scores_of_many_queries_are_ranked_a_few_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.integers(-3, 4, (300, 4)).astype(float))], "vec_id long, v array<double>")
    want = sorted(search.knn_batch(rows, rows, 7).collect())
    monkeypatch.setattr(search, "SCORE_BYTES", 4096)
    assert sorted(search.knn_batch(rows, rows, 7).collect()) == want
