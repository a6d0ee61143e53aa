"""The selection pipeline over tables: grids to canvas placements under one configuration."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import energy, groups, layout, pixels, rollup, sampling, scores, select
from .registry import GROUPERS, PACKERS, SAMPLERS, SCORERS, SELECTORS

ENV = "PATCHWEAVE_"


@dataclass(frozen=True)
class Config:
    selector: str = "topk"
    grouping: str = "fixed"
    anchor: str = "fixed"
    group_size: int = 32
    min_frames: int = 8
    max_frames: int = 64
    min_sec: float = 0.0
    max_sec: float = 0.0
    sample_fps: float = 1.0
    readiness_mode: str = "legacy"
    readiness_norm: float = 2_250_000.0
    readiness_bins: int = 4
    readiness_need: int = 3
    readiness_threshold: float = 0.0
    readiness_delta: float = 0.05
    anchor_centre: float = 0.7
    anchor_low: float = 0.3
    gop_percentile: float = 75.0
    gop_gamma: float = 0.0
    target_groups: int = 0
    images_per_group: int = 4
    patch: int = 1
    block: int = 2
    rows: int = 8
    cols: int = 8
    normalise: bool = True
    event_bins: int = 0
    event_min_blocks: int = 4
    diversity_fraction: float = 0.10
    novelty_weight: float = 0.5
    dedup: bool = True
    dedup_descriptor: str = "pooled4"
    dedup_threshold: float | None = None
    # what a plan from sampling on needs besides (plans/whole.py)
    sampling: str = "fps"
    sample_count: int = 0
    peak_bin_sec: float = 0.5
    peak_smooth: int = 1
    peaks_per_sec: float = 1.0
    peaks_cap: int = 128
    peak_neighbour: int = 0
    avoid_keyframes: bool = False
    avoid_offset: int = 1
    log_scale: bool = True
    score_percentile: float = 99.0
    iframe_clip: str = "none"
    iframe_clip_percentile: float = 95.0
    frame_norm: str = "none"
    frame_norm_floor: float = 0.5
    frame_norm_boost: bool = False
    letterbox: bool = False
    letterbox_threshold: float = 16.0
    order: str = "block_raster"
    pixels: int = 0  # a patch is so many pixels wide; 0: as many as cells

    def normalised(self) -> "Config":
        low = {n: getattr(self, n).strip().lower() for n in ("selector", "grouping", "anchor", "dedup_descriptor", "readiness_mode", "sampling", "iframe_clip", "frame_norm", "order")}
        c = replace(self, **low, group_size=max(1, self.group_size), images_per_group=max(1, self.images_per_group))
        for what, known in (("selector", SELECTORS.names()), ("grouping", GROUPERS.names()), ("anchor", ["adaptive", "fixed"]), ("readiness_mode", ["auto", "clamped_sqrt_bpppf", "fixed", "legacy"]), ("iframe_clip", ["non_i_percentile", "none"]), ("frame_norm", ["frame_mean_floor", "none"]), ("order", ["block_raster", "wh_raster"])):
            if getattr(c, what) not in known:
                raise ValueError(f"unknown {what} {getattr(c, what)!r}")
        for name in ("diversity_fraction", "novelty_weight"):
            if not 0 <= getattr(c, name) <= 1:
                raise ValueError(f"{name} must lie in [0, 1]")
        if c.avoid_offset < 1:
            raise ValueError("avoid_offset must be at least 1")
        if c.dedup_descriptor not in ("pooled4", "full"):
            raise ValueError(f"unknown descriptor {c.dedup_descriptor!r}")
        if c.dedup_threshold is None:
            c = replace(c, dedup_threshold=0.025 if c.dedup_descriptor == "pooled4" else 0.035)
        if c.dedup_threshold < 0:
            raise ValueError("dedup_threshold must not be negative")
        if c.selector == "diverse_mixed" and c.event_bins:
            raise ValueError("diverse_mixed does not go with event bins")
        return c

    @classmethod
    def from_env(cls, **values) -> "Config":
        """Values, overridden by environment variables named after fields with a common prefix."""
        for name, kind in cls.__annotations__.items():
            raw = os.environ.get(ENV + name.upper())
            if raw is not None:
                values[name] = raw.strip().lower() in ("1", "true", "yes", "on") if kind == "bool" else float(raw) if "float" in kind else int(raw) if kind == "int" else raw
        return cls(**values).normalised()

    def budget(self) -> int:
        return groups.budget(self.images_per_group, (self.rows // self.patch) * (self.cols // self.patch), self.block)

    def limits(self) -> tuple[int, int]:
        return groups.frame_limits(self.sample_fps, self.min_frames, self.max_frames, self.min_sec, self.max_sec)

    def key(self) -> str:
        """Of the values that are not the defaults, so that a new field leaves the keys of older output as they are."""
        plain = Config()
        return hashlib.md5(json.dumps({k: v for k, v in asdict(self).items() if v != getattr(plain, k)}, sort_keys=True).encode()).hexdigest()


# samplers: (videos, packets, parameters) -> video, t, frame_id ------------------------------------------------------


@dataclass(frozen=True)
class Sampling:
    """Parameters of all samplers; each takes what it needs."""

    rate: float = 4.0
    count: int = 0
    bin_sec: float = 0.5
    smooth_bins: int = 1
    peaks_per_sec: float = 0.5
    peaks_cap: int = 8
    neighbour: int = 1


def _fps(videos, packets, p):
    return sampling.sample_fps(videos, p.rate)


def _uniform(videos, packets, p):
    if p.count <= 0:
        raise ValueError("uniform_count needs a count above 0")
    return sampling.sample_uniform(videos, p.count)


def _peaks(videos, packets, p):
    bins = energy.energy_bins(packets, p.bin_sec, p.smooth_bins)
    return sampling.numbered(energy.peak_frames(bins, videos, p.peaks_per_sec, p.peaks_cap, p.neighbour))


SAMPLERS.register("fps", _fps)
SAMPLERS.register("uniform_count", _uniform)
SAMPLERS.register("all_frames", lambda videos, packets, p: sampling.sample_all(videos))
SAMPLERS.register("pkt_size_peak", lambda videos, packets, p: sampling.with_fallback(_peaks(videos, packets, p), videos, p.rate))
SAMPLERS.register("fps_plus_pkt_size_peak", lambda videos, packets, p: sampling.with_fallback(sampling.union_distinct(_fps(videos, packets, p), _peaks(videos, packets, p)), videos, p.rate))


def sample(videos: DataFrame, packets: DataFrame | None, mode: str = "fps", **parameters) -> DataFrame:
    """video, t, frame_id by a named sampler; any other name samples by rate."""
    name = mode.strip().lower()
    return SAMPLERS.get(name if name in SAMPLERS.names() else "fps")(videos, packets, Sampling(**parameters))


# groupers: (blocks, config, videos) -> video, group_idx, start, end -------------------------------------------------


def _readiness(blocks: DataFrame, c: Config, videos: DataFrame | None) -> DataFrame:
    budget = c.budget()
    if c.readiness_mode == "clamped_sqrt_bpppf":
        if videos is None:
            raise ValueError("a threshold from bit rates needs the videos table")
        thresholds = groups.clamped_threshold(videos, c.readiness_norm)
    elif c.readiness_mode == "fixed" or (c.readiness_mode == "legacy" and c.readiness_threshold > 0):
        thresholds = blocks.select("video").distinct().withColumn("threshold", F.lit(float(c.readiness_threshold)))
    else:
        thresholds = groups.readiness_threshold(groups.readiness_stats(blocks, c.group_size, budget, c.readiness_bins), c.readiness_bins)
    need = min(c.readiness_need, c.readiness_bins, c.images_per_group - 1)
    return groups.readiness_groups(blocks, thresholds, budget, *c.limits(), c.readiness_bins, need, c.readiness_delta)


def _adaptive(blocks: DataFrame, c: Config, videos: DataFrame | None) -> DataFrame:
    costs = blocks.groupBy("video", "t").agg(F.sum("score").alias("cost"))
    cut = groups.adaptive_gop(costs, c.gop_percentile, *c.limits(), c.gop_gamma)
    return groups.merge_gops(cut, c.target_groups) if c.target_groups > 0 else cut


GROUPERS.register("fixed", lambda blocks, c, videos: groups.fixed_groups(blocks.select("video", "t").distinct(), c.group_size))
GROUPERS.register("readiness", _readiness)
GROUPERS.register("adaptive_gop", _adaptive)

# selectors: (blocks, grid, frames, config) -> picked blocks ---------------------------------------------------------


def _topk(blocks, grid, frames, c):
    budget = c.budget()
    return select.topk_by_events(blocks, budget, c.event_bins, c.event_min_blocks) if c.event_bins else select.topk(blocks, budget)


def _measured(blocks, grid, frames, c):
    side = c.patch * c.block
    if frames is not None:
        return pixels.diversity(blocks, frames, c.rows // side, c.cols // side, c.novelty_weight, c.dedup_descriptor)
    if c.dedup_descriptor == "full":
        raise ValueError("the full descriptor needs pixel frames")
    return select.diversity(blocks, select.descriptors(grid, side, c.cols), c.novelty_weight, side)


def _diverse(blocks, grid, frames, c):
    if c.diversity_fraction == 0 and not c.dedup:
        return select.topk(blocks, c.budget())
    picked = select.diverse_mixed(select.candidates(_measured(blocks, grid, frames, c)), c.budget(), c.diversity_fraction, c.dedup, c.dedup_threshold)
    return picked.join(blocks.select("video", "group_idx", "t", "block_idx", "bh", "bw"), ["video", "group_idx", "t", "block_idx"])


SCORERS.register("bitcost", scores.normalised)
SELECTORS.register("topk", _topk)
SELECTORS.register("diverse_mixed", _diverse)
PACKERS.register("canvas", layout.placements)


def grouped(blocks: DataFrame, specs: DataFrame, min_frames: int = 4) -> DataFrame:
    """Blocks of groups (video, group_idx, start, end) of at least ``min_frames`` frames, with the group's first frame as anchor."""
    frames = specs.filter(F.col("end") - F.col("start") >= min_frames).select("video", "group_idx", F.col("start").cast("long").alias("anchor_t"), (F.col("end") - F.col("start")).cast("long").alias("frame_count"), F.explode(F.sequence(F.col("start").cast("long"), F.col("end").cast("long") - 1)).alias("t"))
    return blocks.join(frames, ["video", "t"])


def _anchored(blocks: DataFrame, c: Config) -> DataFrame:
    """Blocks with the anchor that the configuration asks for; a bad one (column ``good``) is replaced by the first good frame."""
    if c.anchor == "adaptive":
        chosen = select.adaptive_anchor(blocks, c.anchor_centre, c.anchor_low).select("video", "group_idx", F.col("anchor_t").alias("a"))
        blocks = blocks.join(chosen, ["video", "group_idx"]).withColumn("anchor_t", F.col("a")).drop("a")
    elif "good" in blocks.columns:
        frames = blocks.select("video", "group_idx", "t", "anchor_t", "good").distinct()
        moved = select.replace_bad_anchor(frames).select("video", "group_idx", F.col("new_anchor_t").alias("a"))
        blocks = blocks.join(moved, ["video", "group_idx"]).withColumn("anchor_t", F.col("a")).drop("a")
    return blocks


def shaped_blocks(grid: DataFrame, config: Config, kinds: DataFrame | None = None) -> DataFrame:
    """Block scores of costs that are normalised, capped in I frames (kinds(video, t, pict_type)) and levelled by frame, as configured."""
    c = config.normalised()
    shaped = SCORERS.get("bitcost")(grid, c.log_scale, c.score_percentile / 100) if c.normalise else grid
    if c.iframe_clip != "none":
        if kinds is None:
            raise ValueError("capping I frames needs the kinds of frames")
        shaped = scores.clip_iframes(shaped, kinds, min(100.0, max(0.0, c.iframe_clip_percentile)) / 100).drop("changed")
    blocks = scores.block_scores(shaped, c.patch, c.block, c.cols)
    if c.frame_norm != "none":
        blocks = scores.frame_mean_floor(blocks, c.frame_norm_floor, c.frame_norm_boost).select("video", "t", "block_idx", "bh", "bw", "score")
    return blocks


def grouped_blocks(grid: DataFrame, config: Config, good: DataFrame | None = None, videos: DataFrame | None = None, kinds: DataFrame | None = None) -> DataFrame:
    """Scored blocks in the groups and with the anchors of a configuration; good(video, t, good) marks usable frames.

    videos(video, bit_rate, fps, width, height) is needed for readiness thresholds from bit rates.  group_start is the
    group's first frame, wherever its anchor is.
    """
    return in_groups(shaped_blocks(grid, config, kinds), config, good, videos)


def in_groups(blocks: DataFrame, config: Config, good: DataFrame | None = None, videos: DataFrame | None = None) -> DataFrame:
    """Block scores of ``shaped_blocks`` in groups and with anchors, as ``grouped_blocks`` says."""
    c = config.normalised()
    out = grouped(blocks, GROUPERS.get(c.grouping)(blocks, c, videos)).withColumn("group_start", F.col("anchor_t"))
    if good is not None:
        out = out.join(good.select("video", "t", "good"), ["video", "t"], "left").withColumn("good", F.coalesce("good", F.lit(True)))
    return _anchored(out, c)


def pick(blocks: DataFrame, grid: DataFrame, frames: DataFrame | None, config: Config) -> DataFrame:
    """Blocks that the configuration's selector takes."""
    return SELECTORS.get(config.selector)(blocks, grid, frames, config)


def place(blocks: DataFrame, chosen: DataFrame, config: Config) -> DataFrame:
    """Chosen blocks and anchors on canvases."""
    c = config
    return PACKERS.get("canvas")(blocks, chosen, c.block, c.rows // c.patch, c.cols // c.patch, c.order)


def select_patches(grid: DataFrame, config: Config, frames: DataFrame | None = None, good: DataFrame | None = None, videos: DataFrame | None = None, kinds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(selected blocks, placements) of a cost grid; everything is keyed by video and group.

    frames(video, t, h, w, bgr) lets the diverse selector measure pixels instead of costs; good(video, t, good) leaves
    bad frames out.
    """
    c = config.normalised()
    blocks = grouped_blocks(grid, c, good, videos, kinds)
    chosen = pick(blocks, grid, frames, c)
    return chosen, place(blocks, chosen, c)


def diagnostics(grid: DataFrame, config: Config, frames: DataFrame | None = None, good: DataFrame | None = None, videos: DataFrame | None = None) -> DataFrame:
    """One row a group of a diverse selection with all that the summaries need."""
    return diagnosed(grouped_blocks(grid, config, good, videos), grid, config, frames)


def diagnosed(blocks: DataFrame, grid: DataFrame, config: Config, frames: DataFrame | None = None) -> DataFrame:
    """``diagnostics`` of blocks in groups."""
    c = config.normalised()
    cand = select.candidates(_measured(blocks, grid, frames, c))
    picked = select.diverse_counted(cand, c.budget(), c.diversity_fraction, c.dedup, c.dedup_threshold)
    anchors = blocks.filter(F.col("t") == F.col("anchor_t")).select("video", "group_idx", "t", "block_idx", "anchor_t", F.lit(None).cast("double").alias("adjacent"))
    measures = cand.select("video", "group_idx", "t", "block_idx", "anchor_t", "adjacent").unionByName(anchors)
    return rollup.group_diagnostics(picked, cand, measures, c.dedup_threshold)
