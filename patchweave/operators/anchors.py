"""Anchors of buckets: thinning by distance, count and density, and the frame that stands for a bad anchor."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import nearest
from .sampling import line
from .stream import Fold, fold


class _Apart(Fold):
    def __init__(self, gap: int):
        self.gap, self.last = gap, None

    def row(self, t):
        if self.last is not None and t - self.last < self.gap:
            return []
        self.last = t
        return [(t,)]


def spaced(anchors: DataFrame, gap: int) -> DataFrame:
    """Anchors (video, t) in order; one nearer than ``gap`` to the last that was kept goes."""
    rows = anchors.select("video", F.col("t").cast("long").alias("t")).distinct()
    return fold(rows, ["video"], ["t"], lambda: _Apart(gap), "t long")


def evenly(anchors: list[int], n: int) -> list[int]:
    """``n`` of the anchors, spread evenly over their sequence; the first stays."""
    anchors = sorted(set(anchors)) or [0]
    if len(anchors) <= n:
        return anchors
    if n <= 1:
        return anchors[:1]
    kept = {anchors[i] for i in line(0, len(anchors) - 1, n)}
    kept |= set([a for a in anchors if a not in kept][: n - len(kept)])
    return sorted(kept)


def even_spaced(n: int, frames: int, gap: int, latest: int) -> list[int]:
    """``n`` anchors over ``frames`` positions: about equal lengths, at least ``gap`` apart, none after ``latest``."""
    if n <= 1:
        return [0]
    gap, out = max(1, gap), [0]
    for i in range(1, n):
        out.append(min(latest, max(out[-1] + gap, min(latest, round(i * frames / n)))))
    for i in range(n - 2, -1, -1):
        out[i] = min(out[i], out[i + 1] - gap) if out[i + 1] - out[i] < gap else out[i]
    out[0] = 0
    kept: list[int] = []
    for t in out:
        t = min(latest, max(0, t))
        if not kept or t > kept[-1]:
            kept.append(t)
    for t in range(0, latest + 1, gap):
        if len(kept) >= n:
            break
        if t not in kept and t - kept[-1] >= gap:
            kept.append(t)
    return sorted(kept)[:n]


def dense(anchors: list[int], good: np.ndarray, least: int, n: int) -> list[int]:
    """The most anchors, at most ``n``, spread evenly, between which ``least`` good frames lie each."""
    total = np.concatenate([[0], np.cumsum(good)])
    for k in range(max(1, n), 0, -1):
        kept = evenly(anchors, k)
        ends = [*kept[1:], len(good)]
        if len(kept) == 1 or all(total[b] - total[min(a + 1, b)] >= least for a, b in zip(kept, ends)):
            return kept
    return kept


def without_tail(anchors: list[int], frames: int, fps: float, bucket_sec: float) -> list[int]:
    """The last anchor goes if what follows it is shorter than half a bucket (3 s at least)."""
    short = (frames - anchors[-1]) / max(fps, 1e-6) < max(3.0, 0.5 * bucket_sec)
    return anchors[:-1] if len(anchors) >= 2 and short else anchors


def from_seconds(seconds: DataFrame, sampled: DataFrame, videos: DataFrame) -> DataFrame:
    """video, t: the sampled position nearest to each anchor second (video, sec), the first of several, distinct; 0 is always one."""
    rate = F.when(F.col("fps") > 0, F.col("fps")).otherwise(30.0)
    points = seconds.join(videos.select("video", rate.alias("fps")), "video").select("video", F.bround(F.col("sec") * F.col("fps")).alias("x")).distinct().withColumn("id", F.xxhash64("x"))
    first = sampled.groupBy("video", "frame_id").agg(F.min("t").cast("long").alias("t"))
    near = nearest(points, first).select("video", F.col("near").alias("frame_id"))
    found = near.join(first, ["video", "frame_id"]).select("video", "t")
    return found.union(sampled.select("video", F.lit(0).cast("long").alias("t"))).distinct()


class _Thin(Fold):
    def __init__(self, gap, least, buckets, bucket_sec):
        self.gap, self.least, self.buckets, self.bucket_sec = gap, least, buckets, bucket_sec
        self.anchors, self.good, self.fps = [], [], 30.0

    def row(self, t, good, anchor, fps):
        self.good.append(bool(good))
        self.fps = fps
        if anchor and (not self.anchors or t - self.anchors[-1] >= self.gap):
            self.anchors.append(t)
        return []

    def end(self):
        n = len(self.good)
        latest = max(0, n - 1 - self.least)
        anchors = [t for t in self.anchors if t <= latest] or [0]
        kept = dense(anchors, np.array(self.good), self.least, min(len(anchors), latest // max(1, self.gap) + 1, self.buckets))
        return list(enumerate(without_tail(kept, n, self.fps, self.bucket_sec)))


def thinned(frames: DataFrame, gap: int, least: int, buckets: int, bucket_sec: float = 8.0) -> DataFrame:
    """video, bucket, t: the anchors of frames(video, t, good, anchor, fps) that are left after all rules.

    Anchors keep ``gap`` frames apart and ``least`` frames from the end; no more than ``buckets``; every bucket has
    ``least`` good frames besides its anchor; a short tail joins the bucket before.
    """
    rows = frames.select("video", F.col("t").cast("long").alias("t"), "good", "anchor", F.col("fps").cast("double").alias("fps"))
    return fold(rows, ["video"], ["t"], lambda: _Thin(gap, least, buckets, bucket_sec), "bucket int, t long")


def usable_anchor(buckets: DataFrame, chosen: DataFrame, frames: DataFrame) -> DataFrame:
    """Anchor of every bucket(video, bucket, anchor_t): itself if good, else the first good chosen frame (order of ``place``)."""
    good = frames.select("video", "t", "good")
    own = buckets.join(good.withColumnRenamed("t", "anchor_t").withColumnRenamed("good", "own"), ["video", "anchor_t"], "left")
    first = chosen.join(good.filter("good"), ["video", "t"]).groupBy("video", "bucket").agg(F.min_by("t", "place").alias("first"))
    picked = F.when(F.coalesce("own", F.lit(False)), F.col("anchor_t")).otherwise(F.coalesce("first", "anchor_t"))
    return own.join(first, ["video", "bucket"], "left").select("video", "bucket", "anchor_t", picked.alias("used_t"))
