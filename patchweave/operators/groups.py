"""Cuts of frame sequences into groups, half-open over ``t``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cuts import cut_by_cost, merge_cheapest
from .quantiles import exact_quantiles
from .readiness import Ready, cut_by_readiness
from .stream import typed

SPEC = "group_idx int, start int, end int, frame_count int, stop_reason string"


def budget(images_per_group: int, patches: int, block: int) -> int:
    """Blocks that fit beside the anchor."""
    return max(0, (images_per_group * patches - patches) // block**2)


def auto_patches(patches, total_frames, fps, cap: int = 30_000):
    """struct(images, patches): how many full canvases a video gets by resolution and duration, a multiple of four.

    Fixed values: tiers of patches a canvas (7000, 2500), of seconds (6, 7, 12) and the images they allow.
    """
    s = F.greatest(F.lit(1), patches)
    rate = F.when(fps > 0, fps).otherwise(30.0)
    sec = F.when(total_frames > 0, total_frames / rate).otherwise(0.0)
    by_time = F.when(sec <= 7, 8).when(sec <= 12, 12).otherwise(F.greatest(F.lit(1), F.ceil(sec * 1.2)))
    tier = lambda short, long: F.when(sec <= 6, short).otherwise(long)
    by_size = F.when(s >= 7000, tier(4, 8)).when(s >= 2500, tier(8, 12)).otherwise(tier(12, 28))
    by_cap = F.greatest(F.lit(1), F.floor(F.greatest(s, F.lit(cap)) / s))
    images = F.greatest(F.lit(4), F.floor(F.least(by_size, by_cap, by_time) / 4) * 4).cast("int")
    return F.struct(images.alias("images"), (images * s).cast("long").alias("patches"))


def fixed_groups(frames: DataFrame, size: int) -> DataFrame:
    """Tumbling groups of ``size`` frames; frames(video, t)."""
    g = F.floor(F.col("t") / size).cast("int")
    return frames.groupBy("video", g.alias("group_idx")).agg(F.min("t").alias("start"), (F.max("t") + 1).alias("end"), F.count("*").alias("frame_count"), F.lit("fixed_group_size").alias("stop_reason"))


def time_bins(length, bins: int):
    """Bin of a relative position from 1 on: edges are the truncated even spacing of [1, max(2, length)]."""
    top = F.greatest(F.lit(2), length)
    edge = lambda k: F.when(F.lit(k) == bins, top).otherwise((1 + F.lit(k) * ((top - 1) / F.lit(float(bins)))).cast("int"))
    out = F.lit(None).cast("int")
    for k in reversed(range(bins)):
        lo = edge(k)
        hi = F.greatest(edge(k + 1), lo + 1)
        out = F.when((F.col("t_rel") >= lo) & (F.col("t_rel") < hi), k).otherwise(out)
    return out


def readiness_stats(blocks: DataFrame, size: int, block_budget: int, bins: int) -> DataFrame:
    """Readiness of fixed windows: top-k sums of candidate blocks (not of the first frame), coverage in time and frames."""
    g = blocks.withColumn("group_idx", F.floor(F.col("t") / size).cast("int")).withColumn("t_rel", F.col("t") - F.col("group_idx") * size)
    spans = g.groupBy("video", "group_idx").agg((F.max("t_rel") + 1).alias("len"), F.count_if(F.col("t_rel") >= 1).alias("candidates"))
    order = W.partitionBy("video", "group_idx").orderBy(F.desc(F.round("score", 6)), "t", "block_idx")
    top = g.filter("t_rel >= 1").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= block_budget)
    top = top.join(spans.select("video", "group_idx", "len"), ["video", "group_idx"]).withColumn("b", time_bins(F.col("len"), bins))
    stats = top.groupBy("video", "group_idx").agg(F.sum("score").alias("s"), F.count("*").alias("k"), F.countDistinct("b").alias("nb"), F.countDistinct("t").alias("nf"))
    out = spans.join(stats, ["video", "group_idx"], "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "video", "group_idx", F.col("candidates").alias("candidate_block_count"), F.round(z(F.col("s")), 6).alias("topk_sum"), F.round(z(F.col("s") / F.col("k")), 6).alias("topk_mean"), F.round(z(F.col("s") / F.col("len")), 6).alias("density"),
        z(F.col("nb")).alias("selected_time_bins"), F.round(z(F.col("nb")) / F.lit(float(bins)), 6).alias("time_bin_ratio"), z(F.col("nf")).alias("unique_frames"), F.round(z(F.col("nf")) / F.greatest(F.col("len") - 1, F.lit(1)), 6).alias("unique_ratio"), F.col("len").alias("frame_count"),
    )


def readiness_threshold(stats: DataFrame, bins: int) -> DataFrame:
    """Mean top-k sum over windows of at least max(4, bins + 1) frames; 0 if none."""
    enough = F.when(F.col("frame_count") >= max(4, bins + 1), F.col("topk_sum"))
    return stats.groupBy("video").agg(F.round(F.coalesce(F.avg(enough), F.lit(0.0)), 6).alias("threshold"))


def frame_limits(sample_fps: float, min_frames: int, max_frames: int, min_sec: float = 0.0, max_sec: float = 0.0) -> tuple[int, int]:
    """The least and most frames of a group: at least four, seconds before frames, the most no less than the least."""
    rate = sample_fps if sample_fps > 0 else 1.0
    least = max(4, round(min_sec * rate) if min_sec > 0 else min_frames)
    return least, max(least, round(max_sec * rate) if max_sec > 0 else max_frames)


def clamped_threshold(videos: DataFrame, norm: float, low: float = 0.015, high: float = 0.09) -> DataFrame:
    """norm * sqrt of bits a pixel and frame, clamped; videos(video, bit_rate, fps, width, height)."""
    bits = F.col("bit_rate") / F.col("fps") / (F.col("width") * F.col("height"))
    return videos.select("video", (norm * F.sqrt(F.greatest(F.lit(low), F.least(F.lit(high), bits)))).alias("threshold"))


def readiness_cuts(scores: np.ndarray, threshold: float, block_budget: int, min_frames: int, max_frames: int, bins: int, need_bins: int, delta_ratio: float) -> list[tuple[int, int, str]]:
    """(start, end, reason) of the groups of one video; ``scores`` is frames x blocks."""
    frames = [np.asarray(f, float) for f in scores]
    found, _ = Ready(frames, threshold, block_budget, min_frames, max_frames, bins, need_bins, delta_ratio).walk(0, len(frames))
    return [(start, start + n, reason) for start, n, reason in found]


def readiness_groups(blocks: DataFrame, thresholds: DataFrame, block_budget: int, min_frames: int, max_frames: int, bins: int, need_bins: int, delta_ratio: float = 0.05) -> DataFrame:
    """Data-driven groups, cut in chunks (``readiness``): every end depends on the one before only through its place."""
    rows = blocks.join(thresholds, "video").select("video", "t", "block_idx", "score", "threshold")
    return cut_by_readiness(rows, block_budget, min_frames, max_frames, bins, need_bins, delta_ratio)


def adaptive_gop(costs: DataFrame, percentile: float, min_len: int, max_len: int, gamma: float = 0.0) -> DataFrame:
    """Groups cut before a frame whose cost exceeds the threshold (``gamma``, or the video's percentile), or at full length.

    costs(video, t, cost), cut in chunks (``cuts``).  split_cost is the cost that cut a group.
    """
    if gamma > 0:
        rows = costs.select("video", "t", "cost", F.lit(float(gamma)).alias("thr"))
    else:
        rows = costs.join(exact_quantiles(costs, ["video"], "cost", {"thr": percentile / 100}, passes=0), "video").select("video", "t", "cost", "thr")
    return cut_by_cost(rows, min_len, max_len)


def merge_gops(groups: DataFrame, target: int) -> DataFrame:
    """Groups of ``adaptive_gop`` merged to ``target`` a video; merged ones say so."""

    def merge(pdf):
        import pandas as pd

        pdf = pdf.sort_values("group_idx")
        own = {(int(a), int(b)): r for a, b, r in zip(pdf["start"], pdf["end"], pdf["stop_reason"])}
        spans = [(*k, None if c != c else c) for k, c in zip(own, pdf["split_cost"])]
        out = merge_cheapest(spans, target)
        return pd.DataFrame([(pdf["video"].iloc[0], i, a, b, b - a, own.get((a, b), "adaptive_gop_target_canvas_merge")) for i, (a, b, _) in enumerate(out)], columns=["video", "group_idx", "start", "end", "frame_count", "stop_reason"])

    return groups.groupBy("video").applyInPandas(merge, f"{typed(groups, 'video')}, {SPEC}")


def variable_gops(energy: np.ndarray, bin_sec: float, target: int, min_sec: float, max_sec: float) -> list[tuple[int, int]]:
    """Inclusive bin spans of about equal energy, cut at quiet bins near the crossing; a short last one joins its neighbour."""
    e = np.maximum(np.asarray(energy, float), 0)
    n = len(e)
    if not n:
        return [(0, 0)]
    if e.sum() <= 1e-12:
        e = np.ones(n)
    lo, hi = max(1, int(np.ceil(min_sec / bin_sec))), max(1, int(np.ceil(max_sec / bin_sec)))
    want, radius = e.sum() / max(1, target), max(1, min(3, hi // 3))
    out, start, acc, b = [], 0, 0.0, 0
    while b < n:
        acc += e[b]
        span = b - start + 1
        if b < n - 1 and (span >= hi or (span >= lo and acc >= want)):
            first, last = max(start + lo - 1, b - radius), min(start + hi - 1, b + radius, n - 2)
            cut = min(range(first, last + 1), key=lambda c: (e[c], abs(c - b), c)) if last >= first else b
            out.append((start, cut))
            start, acc, b = cut + 1, 0.0, cut
        b += 1
    if start < n:
        out.append((start, n - 1))
    if len(out) > 1 and (out[-1][1] - out[-1][0] + 1) * bin_sec < 0.5 * min_sec:
        out[-2:] = [(out[-2][0], out[-1][1])]
    return out


def energy_gops(bins: DataFrame, bin_sec: float, target: int, min_sec: float, max_sec: float) -> DataFrame:
    """video, gop_idx, start_bin, end_bin, anchor_bin, energy_sum; the walk over bins is sequential."""

    def cut(pdf):
        import pandas as pd

        pdf = pdf.sort_values("bin")
        e = pdf["energy"].to_numpy()
        spans = variable_gops(e, bin_sec, target, min_sec, max_sec)
        return pd.DataFrame([(pdf["video"].iloc[0], i, a, b, (a + b) // 2, round(float(e[a : b + 1].sum()), 6)) for i, (a, b) in enumerate(spans)], columns=["video", "gop_idx", "start_bin", "end_bin", "anchor_bin", "energy_sum"])

    return bins.groupBy("video").applyInPandas(cut, f"{typed(bins, 'video')}, gop_idx int, start_bin int, end_bin int, anchor_bin int, energy_sum double")
