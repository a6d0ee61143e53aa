"""Readiness cuts of long videos in parallel.

A group that begins at a frame ends within ``most`` frames, whatever came before.  A chunk of frames (with the ``most``
frames behind it) therefore knows where every group that begins in it ends, and what it hands on is how far the first
group of the next chunk begins behind its edge.  As table of these offsets chunks compose like those of ``cuts``.
Groups of different offsets soon fall into step, so that a chunk looks at few starts more than once through would.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..ship import ship
from .cuts import TABLE, states
from .stream import typed

#: Frames of a chunk, and values of t within which frames are numbered.
CHUNK, SPAN = 512, 4096


@lru_cache(maxsize=8)
def _bin_of(most: int, bins: int) -> np.ndarray:
    """[length, frame]: the time bin of a frame of a group, -1 if none."""
    out = np.full((most + 1, most + 1), -1)
    for length in range(1, most + 1):
        top = max(2, length)
        edges = [int(1 + k * ((top - 1) / bins)) for k in range(bins)] + [top]
        for k in reversed(range(bins)):
            out[length, edges[k] : max(edges[k + 1], edges[k] + 1)] = k
    return out


class Ready:
    """Where groups end: once the top blocks of their frames are worth enough and spread over enough time bins.

    The longest passing end wins unless an extension gains too little; without one a group has ``most`` frames.  Frames
    are arrays of block scores; a null score (NaN) is no candidate.
    """

    def __init__(self, frames: list[np.ndarray], threshold: float | None, block_budget: int, least: int, most: int, bins: int, need: int, ratio: float):
        self.frames, self.threshold = frames, math.inf if threshold is None else threshold
        self.budget, self.least = block_budget, max(4, least)
        self.most, self.bins, self.need, self.ratio = max(most, self.least), bins, need, ratio
        self.known: dict[int, tuple[int, str] | None] = {}

    def group(self, start: int) -> tuple[int, str] | None:
        """Length and reason of the group that begins at a frame; None if too few frames are left."""
        if start not in self.known:
            left = len(self.frames) - start
            self.known[start] = self._cut(start, min(left, self.most), left <= self.most) if left >= self.least else None
        return self.known[start]

    def _cut(self, start: int, n: int, final: bool) -> tuple[int, str]:
        mine = self.frames[start + 1 : start + n]
        size = [len(x) for x in mine]
        score = np.concatenate(mine) if mine else np.zeros(0)
        t = np.repeat(np.arange(1, n), size)
        block = np.arange(len(t)) - np.repeat(np.cumsum(size) - size, size)
        some = ~np.isnan(score)
        score, t, block = score[some], t[some], block[some]
        order = np.lexsort((-score, block, t, -np.round(score, 6)))
        score, t = score[order], t[order]
        best, prev, reason = None, None, ""
        for end in range(self.least, n + 1):
            top = np.flatnonzero(t < end)[: self.budget]
            total = math.fsum(score[top].tolist())
            if total >= self.threshold:
                hit = np.unique(_bin_of(self.most, self.bins)[end, t[top]])
                if (hit >= 0).sum() >= self.need:
                    best, reason = end, "readiness_threshold"
                    if prev is not None and (total - prev) / max(abs(prev), 1e-6) < self.ratio:
                        return end, "readiness_threshold_low_gain"
            prev = total
        return (best, reason) if best else (n, "tail_flush" if final else "max_group_frames")

    def walk(self, start: int, until: int) -> tuple[list[tuple[int, int, str]], int]:
        """Groups (start, length, reason) that begin before ``until``, and where the next one begins."""
        out = []
        while start < until and (found := self.group(start)):
            out.append((start, *found))
            start += found[0]
        return out, max(start, until)  # too short a tail: what is left belongs to no group

    def table(self, first: bool, until: int) -> tuple[list[int], list[int]]:
        """By the offset of the first group: that in the next chunk, and the groups between.

        A first chunk has no other offset than 0.  One without frames behind it is the last, and no chunk asks for its offsets.
        """
        if len(self.frames) <= until:
            none = [0] * (1 if first else self.most + 1)
            return none, none
        memo: dict[int, tuple[int, int]] = {}
        since, cuts = [], []
        for offset in range(1 if first else self.most + 1):
            at, path = offset, []
            while at < until and at not in memo and (found := self.group(at)):
                path.append(at)
                at += found[0]
            end = memo.get(at, (max(at, until) - until, 0))
            for k, s in enumerate(reversed(path), 1):
                memo[s] = (end[0], end[1] + k)
            since.append(memo[offset][0] if offset in memo else end[0])
            cuts.append(memo[offset][1] if offset in memo else end[1])
        return since, cuts


def _packed(rows: DataFrame, most: int, chunk: int) -> DataFrame:
    """video, chunk, own (its frames), frames (arrays of scores in order of block, ``most`` more frames than its own), threshold."""
    frames = rows.groupBy("video", "t").agg(F.sort_array(F.collect_list(F.struct("block_idx", F.col("score").cast("double").alias("score")))).alias("scores"), F.first("threshold").alias("threshold")).withColumn("scores", F.col("scores.score"))
    # frames are numbered by spans of t and the frames before a span: no task sees a whole video
    span = F.floor(F.col("t") / SPAN).cast("long").alias("span")
    before = frames.groupBy("video", span).agg(F.count("*").alias("n"))
    before = before.select("video", "span", (F.sum("n").over(W.partitionBy("video").orderBy("span")) - F.col("n")).alias("before"))
    at = F.row_number().over(W.partitionBy("video", "span").orderBy("t")) - 1
    placed = frames.withColumn("span", span).withColumn("at", at).join(before, ["video", "span"]).withColumn("pos", F.col("before") + F.col("at"))
    own = F.floor(F.col("pos") / chunk)
    # a frame is seen by its own chunk and by those that end up to ``most`` frames before it
    seen = F.sequence(F.greatest(F.lit(0), F.floor((F.col("pos") - most) / chunk)).cast("long"), own.cast("long"))
    members = placed.withColumn("own", own.cast("long")).withColumn("chunk", F.explode(seen))
    listed = F.sort_array(F.collect_list(F.struct("pos", "scores")))
    packed = members.groupBy("video", "chunk").agg(F.count_if(F.col("own") == F.col("chunk")).alias("own"), listed.alias("frames"), F.first("threshold").alias("threshold"))
    return packed.filter("own > 0").withColumn("frames", F.col("frames.scores"))


def cut_by_readiness(rows: DataFrame, block_budget: int, least: int, most: int, bins: int, need: int, ratio: float, chunk: int = CHUNK) -> DataFrame:
    """video, group_idx, start, end, frame_count, stop_reason of rows(video, t, block_idx, score, threshold).

    Frames are counted in order of t; a tail too short for a group is dropped.  Null scores are no candidates, a null
    threshold is never met.
    """
    ship(rows.sparkSession)
    least = max(4, least)
    most = max(most, least)
    packed = _packed(rows, most, chunk)

    def ready(batch):
        """The chunks of a batch, their scores read off the batch as they lie."""
        frames = batch.column("frames")
        inner = frames.flatten()
        flat, of = inner.flatten().to_numpy(zero_copy_only=False), inner.offsets.to_numpy() - inner.offsets[0].as_py()
        edges = frames.offsets.to_numpy() - frames.offsets[0].as_py()
        for a, b, threshold in zip(edges[:-1], edges[1:], batch.column("threshold").to_pylist()):
            yield Ready(np.split(flat[of[a] : of[b]], of[a + 1 : b] - of[a]), threshold, block_budget, least, most, bins, need, ratio)

    def tables(batches):
        import pyarrow as pa

        for batch in batches:
            found = [one.table(k == 0, chunk) for one, k in zip(ready(batch), batch.column("chunk").to_pylist())]
            since, cuts = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("video"), batch.column("chunk"), batch.column("own"), pa.array(since, pa.list_(pa.int32())), pa.array(cuts, pa.list_(pa.int64()))], ["video", "chunk", "n", "since", "cuts"])

    made = packed.mapInArrow(tables, f"{typed(packed, 'video', 'chunk')}, n long, since array<int>, cuts array<long>")
    entered = states(made.select("video", "chunk", "n", F.arrays_zip(F.col("since"), F.col("cuts")).cast(TABLE).alias("table")))
    joined = packed.join(entered, ["video", "chunk"])

    def emit(batches):
        import pyarrow as pa

        for batch in batches:
            keys, out = [], []
            for place, (one, number, state) in enumerate(zip(ready(batch), batch.column("chunk").to_pylist(), batch.column("state").to_pylist())):
                base, group = number * chunk, state["cuts"]
                for k, (start, length, reason) in enumerate(one.walk(state["since"], chunk)[0]):
                    keys.append(place)
                    out.append((group + k, base + start, base + start + length, length, reason))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("video").take(pa.array(keys, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, [pa.int32()] * 4 + [pa.string()])]], ["video", "group_idx", "start", "end", "frame_count", "stop_reason"])

    return joined.mapInArrow(emit, f"{typed(rows, 'video')}, group_idx int, start int, end int, frame_count int, stop_reason string")
