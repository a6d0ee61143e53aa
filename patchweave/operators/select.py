"""Selection of blocks under a budget; candidates are block rows (video, t, block_idx, bh, bw, score)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stream import typed

GROUP = ["video", "group_idx"]


def grouped(blocks: DataFrame, size: int, min_frames: int = 4) -> DataFrame:
    """Blocks in fixed groups of at least ``min_frames`` frames, with the group's first frame as anchor."""
    g = blocks.withColumn("group_idx", F.floor(F.col("t") / size).cast("int")).withColumn("anchor_t", F.col("group_idx") * size)
    n = F.max("t").over(W.partitionBy(*GROUP)) - F.col("anchor_t") + 1
    return g.withColumn("frame_count", n).filter(F.col("frame_count") >= min_frames)


def _order(*first):
    return W.partitionBy(*GROUP).orderBy(*first, F.desc(F.round("score", 6)), "t", "block_idx")


def candidates(blocks: DataFrame) -> DataFrame:
    """Blocks of frames that may be taken: not the anchor's and, where frames are marked (column ``good``), of good ones."""
    usable = F.col("t") != F.col("anchor_t")
    return blocks.filter(usable & F.col("good") if "good" in blocks.columns else usable)


def topk(blocks: DataFrame, budget: int) -> DataFrame:
    """The ``budget`` best candidate blocks of every group, ties to earlier frames and blocks; column rank from 1."""
    return candidates(blocks).withColumn("rank", F.row_number().over(_order())).filter(F.col("rank") <= budget)


def topk_by_events(blocks: DataFrame, budget: int, bins: int, min_blocks: int) -> DataFrame:
    """Up to ``min_blocks`` of each of ``bins`` stretches of frames first, then the best of the rest."""
    cand = candidates(blocks)
    frames = cand.select(*GROUP, "t").distinct().withColumn("bin", F.ntile(bins).over(W.partitionBy(*GROUP).orderBy("t")))
    binned = cand.join(frames, [*GROUP, "t"])
    local = W.partitionBy(*GROUP, "bin").orderBy(F.desc(F.round("score", 6)), "t", "block_idx")
    ranked = binned.withColumn("in_bin", F.row_number().over(local)).withColumn("reserved", F.col("in_bin") <= min_blocks)
    # reserved blocks bin by bin, then the others by score
    order = W.partitionBy(*GROUP).orderBy(F.when(F.col("reserved"), F.col("bin")).otherwise(bins + 1), F.desc(F.round("score", 6)), "t", "block_idx")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= budget)


def adaptive_anchor(blocks: DataFrame, w_centre: float = 0.7, w_low: float = 0.3) -> DataFrame:
    """The anchor of every group: near its centre and cheap; equal costs count as cheap; the first best wins.

    Where frames are marked (column ``good``), bad ones stand back unless all are bad.
    """
    by = W.partitionBy(*GROUP)
    good = F.bool_or("good") if "good" in blocks.columns else F.lit(True)
    frames = blocks.groupBy(*GROUP, "t", "anchor_t", "frame_count").agg(F.sum("score").alias("c"), good.alias("good"))
    lo, hi = F.min("c").over(by), F.max("c").over(by)
    low = F.when(hi - lo > 1e-12, 1 - (F.col("c") - lo) / (hi - lo)).otherwise(1.0)
    half = (F.col("frame_count") - 1) / 2
    centre = 1 - F.abs(F.col("t") - F.col("anchor_t") - half) / F.greatest(half, F.lit(1e-9))
    scored = frames.withColumn("s", F.round(w_centre * centre + w_low * low, 6)).withColumn("some", F.bool_or("good").over(by)).filter("good or not some")
    return scored.groupBy(*GROUP).agg(F.max_by("t", F.struct("s", -F.col("t"))).alias("anchor_t"), F.max("s").alias("anchor_score"))


def replace_bad_anchor(frames: DataFrame) -> DataFrame:
    """Anchor of every group: the fixed one if good, else the first good frame, else the fixed one; frames(+good)."""
    return frames.groupBy(*GROUP, "anchor_t").agg(F.coalesce(F.max(F.when((F.col("t") == F.col("anchor_t")) & F.col("good"), F.col("t"))), F.min(F.when(F.col("good"), F.col("t"))), F.first("anchor_t")).alias("new_anchor_t"))


def rank01(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """Average-tie rank scaled to [0, 1]; a single row gets 1."""
    n = F.count("*").over(W.partitionBy(*by))
    less = F.rank().over(W.partitionBy(*by).orderBy(value)) - 1
    same = F.count("*").over(W.partitionBy(*by, value))
    return df.withColumn(out, F.when(n > 1, (2 * less + same - 1) / (2.0 * (n - 1))).otherwise(1.0))


def descriptors(grid: DataFrame, factor: int, width: int) -> DataFrame:
    """video, t, block_idx, desc: the cells of each block in raster order."""
    b = F.floor(F.col("i") / factor) * (width // factor) + F.floor(F.col("j") / factor)
    cells = F.array_sort(F.collect_list(F.struct("i", "j", "cost")))
    return grid.groupBy("video", "t", b.alias("block_idx")).agg(F.transform(cells, lambda c: c["cost"]).alias("desc"))


def mad(a, b):
    """Mean absolute difference of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def edge_score(desc, side: int):
    """Half the mean absolute difference along each axis of a side x side descriptor."""
    at = lambda k: F.element_at(desc, k + 1)
    dx = [F.abs(at(r * side + c + 1) - at(r * side + c)) for r in range(side) for c in range(side - 1)]
    dy = [F.abs(at((r + 1) * side + c) - at(r * side + c)) for r in range(side - 1) for c in range(side)]
    mean = lambda xs: sum(xs[1:], xs[0]) / len(xs)
    return 0.5 * mean(dx) + 0.5 * mean(dy)


def diversity(blocks: DataFrame, desc: DataFrame, novelty_weight: float, side: int) -> DataFrame:
    """Candidates with novelty (distance to the anchor's block), edge, their mixed rank, and the difference to t - 1."""
    joined = blocks.join(desc, ["video", "t", "block_idx"])
    before = F.lag("desc").over(W.partitionBy(*GROUP, "block_idx").orderBy("t"))
    first = F.first(F.when(F.col("t") == F.col("anchor_t"), F.col("desc")), True).over(W.partitionBy(*GROUP, "block_idx").orderBy("t").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    measured = joined.withColumn("anchor_desc", first).withColumn("adjacent", mad(F.col("desc"), before)).withColumn("novelty", F.round(mad(F.col("desc"), F.col("anchor_desc")), 6)).withColumn("edge", F.round(edge_score(F.col("desc"), side), 6))
    ranked = rank01(rank01(candidates(measured), "novelty", GROUP, "novelty_rank"), "edge", GROUP, "edge_rank")
    return ranked.withColumn("diversity", F.round(novelty_weight * F.col("novelty_rank") + (1 - novelty_weight) * F.col("edge_rank"), 6)).drop("desc", "anchor_desc")


def diverse_pick(t: np.ndarray, block: np.ndarray, score: np.ndarray, diverse: np.ndarray, adjacent: np.ndarray, anchor: int, budget: int, fraction: float, dedup: bool, threshold: float) -> tuple[np.ndarray, dict]:
    """Origin of every candidate (0: not taken, 1: cost, 2: diversity, 3: back-fill) and counters.

    A candidate is a duplicate if the block at its place one frame before or after is taken and differs by at most the
    threshold; the anchor's blocks count as taken.  ``adjacent`` is the difference to the frame before.
    """
    n = len(t)
    target = min(budget, n)
    quota = int(np.floor(target * fraction + 0.5))
    at = {(int(a), int(b)): k for k, (a, b) in enumerate(zip(t, block))}
    origin, counters = np.zeros(n, np.int8), {"rejected": 0, "unique": set(), "comparisons": 0}
    by_cost = np.lexsort((block, t, -np.round(score, 6)))
    by_diversity = np.lexsort((block, t, -np.round(diverse, 6)))

    def taken(a, b):
        return a == anchor or (((a, b) in at) and origin[at[a, b]] > 0)

    def duplicate(k):
        a, b, hit = int(t[k]), int(block[k]), False
        for other, diff in ((a - 1, adjacent[k]), (a + 1, adjacent[at[a + 1, b]] if (a + 1, b) in at else np.inf)):
            if not hit and taken(other, b):
                counters["comparisons"] += 1
                hit = diff <= threshold
        return hit

    def greedy(order, limit, tag):
        got = 0
        for k in order:
            if got >= limit:
                break
            if origin[k]:
                continue
            if dedup and duplicate(k):
                counters["rejected"] += 1
                counters["unique"].add(int(k))
                continue
            origin[k] = tag
            got += 1
        return got

    got = greedy(by_cost, target - quota, 1)
    if quota:
        got += greedy(by_diversity, target - got, 2)
    for k in by_cost:
        if got >= target:
            break
        if not origin[k]:
            origin[k] = 3
            got += 1
    return origin, counters


def diverse_mixed(candidates: DataFrame, budget: int, fraction: float = 0.10, dedup: bool = True, threshold: float = 0.025) -> DataFrame:
    """Candidates with diversity (see ``diversity``) -> picked rows with origin; greedy within a group, so one group a task."""
    if fraction == 0 and not dedup:
        return topk(candidates, budget).select("video", "group_idx", "t", "block_idx", "score", F.lit("bitcost").alias("origin"))
    return diverse_counted(candidates, budget, fraction, dedup, threshold).select("video", "group_idx", "t", "block_idx", "score", "origin")


def diverse_counted(candidates: DataFrame, budget: int, fraction: float = 0.10, dedup: bool = True, threshold: float = 0.025) -> DataFrame:
    """Picked rows with origin and, the same in all rows of a group, the counters rejected, rejected_unique, comparisons."""

    def pick(pdf):
        pdf = pdf.sort_values(["t", "block_idx"]).reset_index(drop=True)
        adjacent = pdf["adjacent"].fillna(np.inf).to_numpy(float)
        origin, counters = diverse_pick(pdf["t"].to_numpy(), pdf["block_idx"].to_numpy(), pdf["score"].to_numpy(), pdf["diversity"].to_numpy(), adjacent, int(pdf["anchor_t"].iloc[0]), budget, fraction, dedup, threshold)
        pdf["origin"] = np.array(["", "bitcost", "diversity", "backfill"])[origin]
        pdf["rejected"], pdf["rejected_unique"], pdf["comparisons"] = counters["rejected"], len(counters["unique"]), counters["comparisons"]
        return pdf.loc[origin > 0, ["video", "group_idx", "t", "block_idx", "score", "origin", "rejected", "rejected_unique", "comparisons"]]

    rows = candidates.select("video", "group_idx", F.col("t").cast("long").alias("t"), F.col("block_idx").cast("long").alias("block_idx"), "score", "diversity", "adjacent", F.col("anchor_t").cast("long").alias("anchor_t"))
    return rows.groupBy(*GROUP).applyInPandas(pick, f"{typed(rows, *GROUP)}, t long, block_idx long, score double, origin string, rejected long, rejected_unique long, comparisons long")


def penalised(blocks: DataFrame, penalty: float) -> DataFrame:
    """The n-th best block of a frame weighs 1 / sqrt(1 + penalty (n - 1)) of its score."""
    n = F.row_number().over(W.partitionBy("video", "t").orderBy(F.desc(F.round("score", 6)), "block_idx"))
    return blocks.withColumn("nth", n).withColumn("penalised", F.col("score") / F.sqrt(1 + penalty * (F.col("nth") - 1)))


def energy_cdf(frames: DataFrame, by: list[str]) -> DataFrame:
    """frames(.., t, mass, peak) with w = max(1e-6, mass + 0.35 peak) and the running share of it, in order of t."""
    w = F.greatest(F.lit(1e-6), F.col("mass") + 0.35 * F.col("peak"))
    weighed = frames.withColumn("w", w)
    before = F.sum("w").over(W.partitionBy(*by).orderBy("t").rowsBetween(W.unboundedPreceding, 0))
    return weighed.withColumn("cdf", before / F.sum("w").over(W.partitionBy(*by)))


def stratified_pick(t: np.ndarray, block: np.ndarray, score: np.ndarray, images: int, per_image: int) -> list[tuple[int, int]]:
    """(image, row) picks in order: equal slices of the frames' energy, each filled with its best unused blocks, then with
    those around its middle, then with any."""
    frames = np.unique(t)
    gain = np.maximum(score, 0)
    at = np.searchsorted(frames, t)
    mass, peak = np.bincount(at, gain), np.zeros(len(frames))
    np.maximum.at(peak, at, gain)
    w = np.maximum(1e-6, mass + 0.35 * peak)
    cdf = np.cumsum(w) / w.sum()
    order, used, out = np.lexsort((block, t, -np.round(score, 9))), np.zeros(len(t), bool), []
    place = lambda q: min(len(frames) - 1, int(np.searchsorted(cdf, q, "left")))
    for i in range(images):
        lo, mid = place(i / images), place((i + 0.5) / images)
        first, last = frames[lo], frames[max(lo, place((i + 1) / images))] + 1
        radius = max(1, last - first)
        need = per_image
        for a, b in ((first, last), (frames[mid] - radius, frames[mid] + radius + 1), (frames[0], frames[-1] + 1)):
            free = order[(t[order] >= a) & (t[order] < b) & ~used[order]][:need]
            used[free] = True
            out += [(i, int(k)) for k in free]
            need -= len(free)
    return out


def stratified(candidates: DataFrame, images: int, per_image: int, by: list[str] | None = None) -> DataFrame:
    """Candidates(.., t, block_idx, score) that fill ``images`` canvases of ``per_image`` blocks each: columns image and place.

    Greedy within a bucket (columns ``by``, video and bucket if not given): what one slice takes is not there for the next.
    """
    by = by or ["video", "bucket"]

    def pick(pdf):
        pdf = pdf.sort_values(["t", "block_idx"]).reset_index(drop=True)
        found = stratified_pick(pdf["t"].to_numpy(), pdf["block_idx"].to_numpy(), pdf["score"].to_numpy(float), images, per_image)
        out = pdf.loc[[k for _, k in found], [*by, "t", "block_idx", "score"]].copy()
        out["image"], out["place"] = [i for i, _ in found], range(len(found))
        return out

    rows = candidates.select(*by, F.col("t").cast("long").alias("t"), F.col("block_idx").cast("long").alias("block_idx"), F.col("score").cast("double").alias("score"))
    return rows.groupBy(*by).applyInPandas(pick, f"{typed(rows, *by)}, t long, block_idx long, score double, image int, place int")


def reordered(chosen: DataFrame, mode: str, by: list[str] | None = None) -> DataFrame:
    """Chosen blocks with their place (from 0): by time and position (``time``), else strongest first."""
    order = ["t", "bh", "bw", F.desc("score")] if mode.strip().lower() == "time" else [F.desc(F.round("score", 9)), "t", "bh", "bw"]
    return chosen.withColumn("place", F.row_number().over(W.partitionBy(*(by or ["video", "bucket"])).orderBy(*order)) - 1)
