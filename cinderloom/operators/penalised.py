"""Ordered alignment on one timeline with a price on the gap between events, in less than all pairs of positions.

The price does not fall with the gap and rises ever more slowly (a concave function, such as a logarithm). Then, of two
predecessors, the older one gains on the newer one as time goes on, so each pair changes places once at most: a stack of
candidates, each with the time at which the one below overtakes it, gives the best predecessor of every position in one
sorted pass. Upper and lower limits of the gap make a sliding window; it is cut where blocks of its own length meet, and
each side only ever gains candidates as it is swept, forwards on one side, backwards on the other.

A timeline is dealt out in slices of time, so that a long video is many tasks. A slice sends later ones only the
predecessors that can still be best there. A task takes its slices one after the other from sorted rows, as most have few
positions; those with up to ``FEW_PAIRS`` pairs are compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage

Price = Callable[[float], float]
#: Pairs of positions of a slice up to which all are compared.
FEW_PAIRS = 1024


def _sweep(value: Callable[[int, int], float], opens: np.ndarray, targets: int, *, newer_wins: bool) -> np.ndarray:
    """The best candidate of each target, -1 if there is none; candidate k counts from target ``opens[k]`` on (not falling).
    Of equal ones the newly added one is best if ``newer_wins``."""
    best, stack, until, k = np.full(targets, -1, np.int64), [], [], 0

    def overtaken(low: int, high: int, at: int) -> bool:
        """Whether ``low``, which lies below ``high`` in the stack, is the better of the two at target ``at``."""
        a, b = value(low, at), value(high, at)
        return a > b if newer_wins else a >= b

    for i in range(targets):
        while stack and until[-1] <= i:
            stack.pop()
            until.pop()
        while k < len(opens) and opens[k] <= i:
            end = targets
            while stack:
                if overtaken(stack[-1], k, i):
                    end = i
                    break
                lo, hi = i + 1, targets
                while lo < hi:
                    middle = (lo + hi) // 2
                    lo, hi = (lo, middle) if overtaken(stack[-1], k, middle) else (middle + 1, hi)
                end = lo
                if len(stack) > 1 and until[-1] <= end:  # what is below is better before this one is again
                    stack.pop()
                    until.pop()
                    continue
                break
            if end > i:
                stack.append(k)
                until.append(end if len(stack) > 1 else targets)
            k += 1
        if stack:
            best[i] = stack[-1]
    return best


def _reached(sources: np.ndarray, targets: np.ndarray, gap: float, *, beyond: bool) -> np.ndarray:
    """For each source the first target whose gap is ``gap`` at least, or more than it if ``beyond``; gaps are compared as
    they are computed, not as sums."""
    at = np.searchsorted(targets, sources + gap, side="right" if beyond else "left")

    def short(k: np.ndarray) -> np.ndarray:
        g = targets[np.clip(k, 0, len(targets) - 1)] - sources
        return (g <= gap) if beyond else (g < gap)

    while len(targets) and (back := (at > 0) & ~short(at - 1)).any():
        at = at - back
    while len(targets) and (on := (at < len(targets)) & short(at)).any():
        at = at + on
    return at


def best_predecessors(
    sources: np.ndarray, scores: np.ndarray, targets: np.ndarray, price: Price, min_gap: float = 0.0, max_gap: float | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(number of the source, its score less the price) for each target; -1 and minus infinity where none lies before it
    within the limits. Times ascend on both sides; a gap of 0 never counts. Of equal sources the earliest is taken."""
    first = _reached(sources, targets, min_gap, beyond=min_gap == 0)
    out, gain = np.full(len(targets), -1, np.int64), np.full(len(targets), -np.inf)

    def worth(j: int, i: int) -> float:
        return scores[j] - price(targets[i] - sources[j])

    def note(found: np.ndarray, at: int) -> None:
        for i in np.flatnonzero(found >= 0):
            if (w := worth(found[i], at + i)) > gain[at + i]:
                out[at + i], gain[at + i] = found[i], w

    if max_gap is None:
        note(_sweep(worth, first, len(targets), newer_wins=False), 0)
    if max_gap is None or not len(sources):
        return out, gain
    last = _reached(sources, targets, max_gap, beyond=True)
    block = np.floor(sources / max(max_gap - min_gap, 1e-9))
    begins = np.flatnonzero(np.diff(block, prepend=-np.inf))
    for lo, hi in zip(begins, np.append(begins[1:], len(sources)), strict=True):
        # forwards up to where the block's first source leaves the window; targets after that see a suffix: backwards
        start, turn, end = int(first[lo]), max(int(first[lo]), int(last[lo])), int(last[hi - 1])
        ahead = _sweep(lambda j, i: worth(lo + j, start + i), first[lo:hi] - start, turn - start, newer_wins=False)
        note(np.where(ahead >= 0, ahead + lo, -1), start)
        back = _sweep(lambda j, i: worth(hi - 1 - j, end - 1 - i), np.maximum(0, end - last[lo:hi][::-1]), max(0, end - turn), newer_wins=True)
        tail = np.where(back >= 0, hi - 1 - back, -1)[::-1]
        note(np.where((tail >= 0) & (first[tail] <= np.arange(end - len(tail), end)), tail, -1), end - len(tail))
    return out, gain


def of_all_pairs(sources: np.ndarray, scores: np.ndarray, targets: np.ndarray, price: Price, min_gap: float = 0.0, max_gap: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """As ``best_predecessors``, by all pairs: less work for a few positions."""
    gap = targets[:, None] - sources
    fits = (gap > 0) & (gap >= min_gap)
    if max_gap is not None:
        fits &= gap <= max_gap
    worth = np.full(gap.shape, -np.inf)
    worth[fits] = np.broadcast_to(scores, gap.shape)[fits] - np.fromiter(map(price, gap[fits].tolist()), float)
    if not len(sources):
        return np.full(len(targets), -1, np.int64), np.full(len(targets), -np.inf)
    found, gain = worth.argmax(axis=1), worth.max(axis=1)
    return np.where(np.isinf(gain), -1, found), gain


def still_useful(times: np.ndarray, scores: np.ndarray, after: float, price: Price, min_gap: float = 0.0) -> np.ndarray:
    """Numbers of the predecessors (times ascending) that can be best for some time from ``after`` on, if no gap is too long."""
    after -= 1e-9 * abs(after)
    open_by_then = np.where(times + min_gap <= after, scores, -np.inf)
    newer = np.append(np.maximum.accumulate(open_by_then[::-1])[::-1][1:], -np.inf)
    kept: list[int] = []
    for j in np.flatnonzero(scores > newer):
        at = max(after, times[j] + min_gap)
        own = scores[j] - price(at - times[j])
        if all(scores[k] - price(at - times[k]) < own for k in reversed(kept)):
            kept.append(int(j))
    return np.array(kept, np.int64)


def _starts(rows: pa.RecordBatch) -> np.ndarray:
    """Where each slice begins in rows that lie in order of their slices, and the end."""
    video, part = (rows.column(k).dictionary_encode().indices.to_numpy() for k in ("video_id", "_slice"))
    return np.concatenate(([0], np.flatnonzero((np.diff(video) != 0) | (np.diff(part) != 0)) + 1, [len(rows)]))


def _whole_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, cut so that no slice lies in two batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        at = int(_starts(b)[-2])  # what is from here on may go on in the next batch
        if held and (at or any(b.column(k)[0] != held[-1].column(k)[-1] for k in ("video_id", "_slice"))):
            yield pa.concat_batches([*held, b.slice(0, at)])
            held = []
        elif at:
            yield b.slice(0, at)
        held.append(b.slice(at))
    if held:
        yield pa.concat_batches(held)


def _with_useful(rows: pa.RecordBatch, price: Price, min_gap: float, length: float | None) -> pa.RecordBatch:
    """``_useful``: whether a position can be a predecessor of one in a later slice; with a ``length`` only those that can be best."""
    useful = rows.column("_total").is_valid().to_numpy(zero_copy_only=False)
    if length is not None:
        ts, total, part = (rows.column(k).to_numpy(zero_copy_only=False) for k in ("ts", "_total", "_slice"))
        starts = _starts(rows)
        for lo, hi in zip(starts, starts[1:], strict=False):
            held = lo + np.flatnonzero(useful[lo:hi])
            useful[lo:hi] = False
            if len(held):
                useful[held[still_useful(ts[held], total[held], (part[lo] + 1) * length, price, min_gap)]] = True
    return rows.set_column(rows.schema.get_field_index("_useful"), "_useful", pa.array(useful))


def _layer(event: int, price: Price, min_gap: float, max_gap: float | None) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """One event's scores and predecessors for the positions of whole slices, from their own and those that earlier slices sent."""

    def step(rows: pa.RecordBatch) -> pa.RecordBatch:
        ts, total, pos = (rows.column(k).to_numpy(zero_copy_only=False) for k in ("ts", "_total", "_pos"))
        own, usable = rows.column("_own").to_numpy(zero_copy_only=False), rows.column("_total").is_valid().to_numpy(zero_copy_only=False)
        best, gain, none = np.zeros(len(rows), np.int64), np.zeros(len(rows)), np.ones(len(rows), bool)
        starts = _starts(rows)
        for lo, hi in zip(starts, starts[1:], strict=False):
            targets, sources = lo + np.flatnonzero(own[lo:hi]), lo + np.flatnonzero(usable[lo:hi])
            search = of_all_pairs if len(targets) * len(sources) <= FEW_PAIRS else best_predecessors
            found, gains = search(ts[sources], total[sources], ts[targets], price, min_gap, max_gap)
            has = found >= 0
            at = targets[has]
            best[at], gain[at], none[at] = pos[sources[found[has]]], gains[has], False
        made = {"_total": pc.add(pa.array(gain, mask=none), rows.column(f"s{event}")), f"_before{event}": pa.array(best, mask=none)}
        for name, column in made.items():
            rows = rows.set_column(rows.schema.get_field_index(name), name, column)
        return rows.filter(pa.array(own))

    return step


def viterbi(
    positions: DataFrame, events: int, price: Price, *, min_gap: float = 0.0, max_gap: float | None = None, slice_length: float = 3600.0
) -> DataFrame:
    """(video_id, score, path): the best strictly ordered positions for scores ``s0``, ``s1``, .. on one timeline, less the
    ``price`` of every gap, which must be a concave function that does not fall.

    Positions: (video_id, ts, s0, ..); a null score cannot be chosen, an infinite one neither; rows without a video or a
    finite time are left out. Of paths with one score that with the earliest predecessors is taken. Videos without a whole
    path give no row, nor does an empty table. Other columns are dropped.
    """
    if min_gap < 0 or (max_gap is not None and max_gap < min_gap) or slice_length <= 0:
        raise ValueError("gap constraints are invalid")
    length = max(slice_length, max_gap or 0.0)
    names = [f"s{e}" for e in range(events)]
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.col(c).cast("double")).alias(c)
    state = positions.select("video_id", finite("ts"), *[finite(n) for n in names]).where("video_id IS NOT NULL AND ts IS NOT NULL")
    state = state.withColumn("_slice", F.floor(F.col("ts") / length).cast("long")).withColumn("_total", F.col("s0")).withColumn("_pos", F.monotonically_increasing_id())
    state = state.withColumns({"_useful": F.lit(None).cast("boolean"), "_own": F.lit(True)} | {f"_before{e}": F.lit(None).cast("long") for e in range(1, events)})
    columns = ["video_id", "_slice", "_pos", "ts", "_total"]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema.fields)
    until = length if max_gap is None else None

    def dealt(rows: DataFrame, *steps: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _whole_slices(batches):
                for step in steps:
                    b = step(b)
                yield b

        return storage.stored(rows.repartition("video_id", "_slice").sortWithinPartitions("video_id", "_slice", "ts", "_pos").mapInArrow(run, kind), "alignment")

    def useful(b: pa.RecordBatch) -> pa.RecordBatch:
        return _with_useful(b, price, min_gap, until)

    state = dealt(state, useful)
    slices = storage.stored(state.select("video_id", F.col("_slice").alias("_to")).distinct(), "slices") if events > 1 else None
    for e in range(1, events):
        sent = state.where("_useful").select(*columns).join(slices, "video_id").where(F.col("_to") > F.col("_slice"))
        if max_gap is not None:
            sent = sent.where(F.col("_to") * length <= F.col("ts") + max_gap)
        sent = sent.withColumn("_slice", F.col("_to")).select(*columns, F.lit(False).alias("_own"))
        state = dealt(state.unionByName(sent, allowMissingColumns=True), _layer(e, price, min_gap, max_gap), useful)
    ends = state.where("_total IS NOT NULL").groupBy("video_id").agg(F.max(F.struct("_total", (-F.col("ts")).alias("_early"), (-F.col("_pos")).alias("_at"))).alias("b"))
    paths = ends.select("video_id", F.col("b._total").alias("score"), (-F.col("b._at")).alias("_at"), F.array().cast("array<double>").alias("path"))
    for e in range(events - 1, -1, -1):
        link = F.col(f"_before{e}") if e else F.lit(None).cast("long")
        here = state.select("video_id", F.col("_pos").alias("_at"), "ts", link.alias("_next"))
        paths = paths.join(here, ["video_id", "_at"]).select("video_id", "score", F.col("_next").alias("_at"), F.concat(F.array("ts"), "path").alias("path"))
    return paths.select("video_id", "score", "path")
