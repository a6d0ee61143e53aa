"""Cuts of long sequences in chunks, and merges with a heap, against plain loops."""

import time

import numpy as np
import pytest

from patchweave.operators import cuts, groups, readiness


def plain_cuts(costs, threshold, least, most):
    out, start = [], 0
    for i, cost in enumerate(costs):
        length = i - start
        if not i:
            continue
        if cost is not None and threshold is not None and cost > threshold and length >= least:
            out.append((start, i, "adaptive_gop_cost", cost))
        elif length >= most:
            out.append((start, i, "adaptive_gop_max_group_frames", cost))
        else:
            continue
        start = i
    return [*out, (start, len(costs), "adaptive_gop_tail", None)]


@pytest.mark.parametrize("chunk, fan", [(1, 1), (3, 2), (64, 1), (4096, 7)])
def test_cuts_in_chunks(spark, monkeypatch, chunk, fan):
    monkeypatch.setattr(cuts, "FAN_BITS", fan)
    rng = np.random.default_rng(chunk)
    rows, want = [], {}
    for v in range(12):
        n = int(rng.integers(1, 260))
        cost = [None if x < 0.05 else float(x) for x in rng.random(n)]
        t = np.sort(rng.choice(3 * n, n, replace=False)) if v % 3 == 0 else range(n)  # rows are counted, whatever their t
        threshold = None if v == 5 else [0.5, 0.9, 2.0][v % 3]
        rows += [(v, int(a), c, threshold) for a, c in zip(t, cost)]
        want[v] = plain_cuts(cost, threshold, 4, 11)
    table = spark.createDataFrame(rows, "video long, t int, cost double, thr double").repartition(5)
    got = {v: [] for v in want}
    for r in cuts.cut_by_cost(table, 4, 11, chunk).orderBy("video", "group_idx").collect():
        assert r.group_idx == len(got[r.video]) and r.frame_count == r.end - r.start
        got[r.video].append((r.start, r.end, r.stop_reason, r.split_cost))
    assert got == want


def test_one_long_video_is_cut_by_many_tasks(spark):
    frames = spark.range(0, 40_000, 1, 4).selectExpr("'v' as video", "cast(id as int) as t", "double(crc32(string(id)) % 1000) as cost")
    got = groups.adaptive_gop(frames, 75, 4, 24).orderBy("group_idx").collect()
    cost = [r.cost for r in frames.orderBy("t").collect()]
    threshold = float(np.percentile(cost, 75))
    assert [(r.start, r.end, r.stop_reason, r.split_cost) for r in got] == plain_cuts(cost, threshold, 4, 24)


def plain_merge(spans, target):
    spans = list(spans)
    while len(spans) > max(1, target):
        i = min(range(len(spans) - 1), key=lambda k: (spans[k][2] or 0.0, k))
        spans[i : i + 2] = [(spans[i][0], spans[i + 1][1], spans[i][2])]
    return spans


def test_merges():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 17, 60):
        for target in (0, 1, 4, 100):
            spans = [(k, k + 1, None if x == 0 else float(x)) for k, x in enumerate(rng.integers(0, 6, n))]
            assert cuts.merge_cheapest(spans, target) == plain_merge(spans, target)
    began = time.perf_counter()
    assert len(cuts.merge_cheapest([(k, k + 1, float(x)) for k, x in enumerate(rng.random(100_000))], 10)) == 10
    assert time.perf_counter() - began < 5


def plain_readiness(frames, threshold, budget, least, most, bins, need, ratio):
    least = max(4, least)
    most, out, start = max(most, least), [], 0
    while len(frames) - start >= least:
        left = len(frames) - start
        n = min(left, most)
        best, prev, reason = None, None, "tail_flush" if left <= most else "max_group_frames"
        for end in range(least, n + 1):
            top = sorted((-round(x, 6), t, b, x) for t in range(1, end) for b, x in enumerate(frames[start + t]) if x is not None)[:budget]
            total = sum(x[3] for x in top)
            edges = [int(1 + k * ((end - 1) / bins)) for k in range(bins)] + [end]
            hit = {next((k for k in range(bins) if edges[k] <= t < max(edges[k + 1], edges[k] + 1)), None) for _, t, _, _ in top} - {None}
            if total >= threshold and len(hit) >= need:
                best, reason = end, "readiness_threshold"
                if prev is not None and (total - prev) / max(abs(prev), 1e-6) < ratio:
                    reason = "readiness_threshold_low_gain"
                    break
            prev = total
        length = best or n
        out.append((start, start + length, reason))
        start += length
    return out


@pytest.mark.parametrize("chunk", [1, 5, 32, 512])
def test_readiness_in_chunks(spark, chunk):
    rng = np.random.default_rng(chunk)
    rows, want = [], {}
    for v in range(7):
        n, threshold = int(rng.integers(1, 120)), float(rng.choice([0.0, 6.0, 14.0, 1e9]))
        # eighths add up exactly in any order; some frames lack blocks, some scores are null
        frames = [[None if rng.random() < 0.05 else float(x) / 8 for x in rng.integers(0, 12, rng.integers(1, 5))] for _ in range(n)]
        t = range(n) if v % 2 else np.sort(rng.choice(5 * n, n, replace=False))
        rows += [(v, int(a), b, x, threshold) for a, f in zip(t, frames) for b, x in enumerate(f)]
        want[v] = plain_readiness(frames, threshold, 9, 5, 14, 3, 2, 0.05)
    table = spark.createDataFrame(rows, "video long, t int, block_idx int, score double, threshold double").repartition(5)
    got = {v: [] for v in want}
    for r in readiness.cut_by_readiness(table, 9, 5, 14, 3, 2, 0.05, chunk).orderBy("video", "group_idx").collect():
        assert r.group_idx == len(got[r.video]) and r.frame_count == r.end - r.start
        got[r.video].append((r.start, r.end, r.stop_reason))
    assert got == want and len({x[2] for v in want.values() for x in v}) >= 3
