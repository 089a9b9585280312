"""Alignment with a price on gaps against all pairs and all paths."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from cinderloom.operators import penalised


def all_pairs(sources, scores, targets, price, low, high):
    out = []
    for t in targets:
        gaps = [(t - a, v) for a, v in zip(sources, scores, strict=True) if t > a and t - a >= low and (high is None or t - a <= high)]
        out.append(max((v - price(g) for g, v in gaps), default=-np.inf))
    return np.array(out)


PRICES = [lambda g: 0.5 * math.log1p(g), lambda g: math.sqrt(g), lambda g: 0.3 * g, lambda g: 0.0]


@pytest.mark.parametrize("price", PRICES)
def test_predecessors(price):
    rng = np.random.default_rng(1)
    for k in range(400):
        n, m = rng.integers(0, 16, 2)
        sources, targets = np.sort(rng.integers(0, 20, n) / 2.0), np.sort(rng.integers(0, 24, m) / 2.0)
        scores = rng.integers(0, 6, n) / 2.0 if k % 2 else rng.normal(size=n)
        low, high = float(rng.choice([0, 0, 0.5, 1, 3])), [None, 0.5, 3.0, 4.0, 30.0][k % 5]
        if high is None or high >= low:
            found, gain = penalised.best_predecessors(sources, scores, targets, price, low, high)
            assert np.array_equal(all_pairs(sources, scores, targets, price, low, high), gain)
            assert all((j < 0) == np.isinf(g) for j, g in zip(found, gain, strict=True))


@pytest.mark.parametrize("price", PRICES)
def test_pruning_keeps_the_best(price):
    rng = np.random.default_rng(2)
    for k in range(200):
        n, low = rng.integers(1, 20), float(k % 3)
        times, scores = np.sort(rng.integers(0, 20, n) / 2.0), rng.integers(0, 9, n) / 3.0
        kept = penalised.still_useful(times, scores, 10.0, price, low)
        targets = np.sort(10 + rng.random(30) * 40)
        assert np.allclose(all_pairs(times, scores, targets, price, low, None), all_pairs(times[kept], scores[kept], targets, price, low, None))


def test_few_pairs_are_compared():
    """Prices asked for grow as n log n."""
    rng, asked = np.random.default_rng(3), []

    def price(gap):
        asked[-1] += 1
        return 0.05 * math.log1p(gap)

    for n in (2_000, 16_000):
        asked.append(0)
        times = np.sort(rng.random(n) * n)
        penalised.best_predecessors(times, rng.random(n), times, price, 0.0, n / 10)
    assert asked[0] < 2_000 * 30 and asked[1] < asked[0] * 8 * 1.5


@pytest.mark.parametrize(("low", "high", "length"), [(0.0, None, 4.0), (1.0, None, 2.0), (0.0, 6.0, 3.0), (0.0, None, 1000.0)])
def test_paths(spark, low, high, length):
    rng = random.Random(5)
    rows = [(v, float(rng.randrange(30)) / 2, *[None if rng.random() < 0.2 else rng.randrange(9) + 0.5 for _ in range(3)]) for v in range(4) for _ in range(14)]
    rows += [(9, 1.0, 1.0, 1.0, 1.0), (9, None, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0), (None, 3.0, 1.0, 1.0, 1.0), (None, 5.5, float("nan"), 1.0, 2.0)]
    price = PRICES[0]
    fits = lambda g: g > 0 and g >= low and (high is None or g <= high)
    want = {}
    for v, a, s, _, _ in rows:
        for w, b, _, t, _ in rows:
            for x, c, _, _, u in rows:
                if v == w == x and None not in (a, b, c, s, t, u) and not math.isnan(s) and fits(b - a) and fits(c - b):
                    want[v] = max(want.get(v, -math.inf), s + t + u - price(b - a) - price(c - b))
    p = spark.createDataFrame(rows, "video_id long, ts double, s0 double, s1 double, s2 double")
    got = penalised.viterbi(p, 3, price, min_gap=low, max_gap=high, slice_length=length).collect()
    assert {r["video_id"]: round(r["score"], 9) for r in got } == {k: round(x, 9) for k, x in want.items() if k is not None}
    scores = {(v, t): s for v, t, *s in rows if t is not None}
    assert all(len(r["path"]) == 3 and all(fits(b - a) for a, b in zip(r["path"], r["path"][1:], strict=False)) and (r["video_id"], r["path"][0]) in scores for r in got)
    if length == 4.0:
        assert penalised.viterbi(p.where("false"), 3, price).count() == 0
        with pytest.raises(ValueError):
            penalised.viterbi(p, 3, price, min_gap=2.0, max_gap=1.0)


@pytest.mark.parametrize("price", PRICES)
def test_all_pairs_of_few_positions(price):
    rng = np.random.default_rng(4)
    for k in range(200):
        n, m = rng.integers(0, 12, 2)
        sources, targets, scores = np.sort(rng.integers(0, 20, n) / 2.0), np.sort(rng.integers(0, 24, m) / 2.0), rng.integers(0, 6, n) / 2.0
        low, high = float(rng.choice([0, 0.5, 3])), [None, 3.0, 30.0][k % 3]
        (one, gain), (other, same) = (f(sources, scores, targets, price, low, high) for f in (penalised.of_all_pairs, penalised.best_predecessors))
        assert np.array_equal(gain, same) and np.array_equal(one < 0, other < 0)


def test_slices_are_cut_whole():
    """A slice that lies in several batches is put together; the rows stay as they are."""
    rng = random.Random(6)
    rows = sorted((str(rng.randrange(4)), rng.randrange(3), k) for k in range(200))
    batch = pa.RecordBatch.from_pylist([{"video_id": v, "_slice": s, "k": k} for v, s, k in rows])
    for size in (1, 3, 17, 50, 200):
        cut = list(penalised._whole_slices(batch.slice(at, size) for at in range(0, 200, size)))
        assert [r["k"] for b in cut for r in b.to_pylist()] == [k for *_, k in rows]
        keys = [{(r["video_id"], r["_slice"]) for r in b.to_pylist()} for b in cut]
        assert sum(map(len, keys)) == len(set().union(*keys)) == 12
        assert all(len(penalised._starts(b)) == len(k) + 1 for b, k in zip(cut, keys, strict=True))


def test_slices_share_tasks(spark, monkeypatch):
    """No group of Spark's own for each slice: on short slices its cost is most of the work."""
    plans, keep = [], penalised.storage.stored
    monkeypatch.setattr(penalised.storage, "stored", lambda df, name="table": plans.append(df._jdf.queryExecution().toString()) or keep(df, name))
    p = spark.createDataFrame([(v, float(t), 1.0, 1.0) for v in range(3) for t in range(9)], "video_id long, ts double, s0 double, s1 double")
    assert penalised.viterbi(p, 2, PRICES[0], slice_length=2.0).count() == 3
    assert any("MapInArrow" in x for x in plans) and not any("FlatMap" in x for x in plans)
