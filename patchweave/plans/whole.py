"""One plan from sampling to output: frames are picked, costs shaped, groups cut, blocks selected, laid out and recorded.

Tables keyed by source frame go in (``Inputs``); ``run`` joins them to the sampled frames once, in the order
sample, move off keyframes, refill, mask letterboxes, normalise, cap I frames, level frames, group, anchor, select, place,
and gives every stage's table (``Outputs``).  Samples, shaped blocks, grouped blocks and the choice are each used several times:
``lineage.cut`` writes them once, the other tables are lazy.  Nothing passes through the driver.  ``run_missing`` makes what
is not there yet: a video is finished when its record is written, which is last.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import image
from ..lineage import cut
from ..operators import joins, pixels, rollup, sampling
from .selection import Config, diagnosed, in_groups, pick, place, sample, shaped_blocks

#: One record a video.
META = (
    "config string, video string, settings string, total_frames long, fps double, sampled_frames long, keyframes_found long, num_groups long, tail_frames long, "
    "total_images long, total_patches long, selected_blocks long, selector_summary string"
)
#: One record a group.
GROUPS = "config string, video string, group_idx long, start long, end long, frame_count long, anchor_t long, num_canvases long, global_img_offset long, selected_blocks long, patches long"


@dataclass(frozen=True)
class Inputs:
    """videos(video, total_frames, fps, ..), grid(video, frame_id, i, j, cost), and where a configuration asks for them:

    packets(video, pts_time, size, flags) for energy samplers and keyframes; keyframes(video, frame_id) in place of flags;
    kinds(video, frame_id, pict_type) for caps, I being keyframes where it is not given; frames(video, frame_id, h, w, bgr)
    for bad frames, letterboxes, pixel measures and canvases.
    """

    videos: DataFrame
    grid: DataFrame
    packets: DataFrame | None = None
    keyframes: DataFrame | None = None
    kinds: DataFrame | None = None
    frames: DataFrame | None = None

    def only(self, todo: DataFrame) -> "Inputs":
        """The inputs of some videos (video)."""
        keep = lambda df: df if df is None else df.join(todo.select(F.col("video").alias("_video")), F.col("video").cast("string") == F.col("_video"), "left_semi")
        return Inputs(*(keep(getattr(self, n)) for n in self.__dataclass_fields__))


@dataclass(frozen=True)
class Outputs:
    """sampled(video, t, frame_id), blocks in groups, chosen blocks, placements, records of groups and of videos.

    frames(video, t, h, w, bgr) and canvases(video, n, h, w, rgb) are None without pixels.
    """

    sampled: DataFrame
    blocks: DataFrame
    chosen: DataFrame
    placed: DataFrame
    groups: DataFrame
    meta: DataFrame
    frames: DataFrame | None
    canvases: DataFrame | None


def keyframes_of(inputs: Inputs) -> DataFrame | None:
    if inputs.keyframes is not None:
        return inputs.keyframes.select("video", F.col("frame_id").cast("long").alias("frame_id")).dropDuplicates()
    return None if inputs.packets is None else sampling.keyframe_ids(inputs.packets, inputs.videos)


def sampled_frames(inputs: Inputs, config: Config) -> DataFrame:
    """video, t, frame_id of a configuration; with every frame sampled there is nowhere to move to, so keyframes stay."""
    c = config.normalised()
    settings = {"rate": c.sample_fps, "count": c.sample_count, "bin_sec": c.peak_bin_sec, "smooth_bins": c.peak_smooth, "peaks_per_sec": c.peaks_per_sec, "peaks_cap": c.peaks_cap, "neighbour": c.peak_neighbour}
    out = sample(inputs.videos, inputs.packets, c.sampling, **settings).select("video", F.col("t").cast("long").alias("t"), F.col("frame_id").cast("long").alias("frame_id"))
    if c.avoid_keyframes and c.sampling != "all_frames":
        keys = keyframes_of(inputs)
        if keys is None:
            raise ValueError("avoid_keyframes needs keyframes or packets")
        keys = keys if inputs.keyframes is not None else cut(keys)
        out = sampling.refill(cut(sampling.shift_off_keyframes(cut(out), keys, inputs.videos, c.avoid_offset)), keys, inputs.videos)
    return out.select("video", F.col("t").cast("long").alias("t"), F.col("frame_id").cast("long").alias("frame_id"))


def by_place(rows: DataFrame, sampled: DataFrame) -> DataFrame:
    """Rows of source frames as rows of samples: frame_id becomes t, once for every sample of the frame."""
    return rows.withColumn("frame_id", F.col("frame_id").cast("long")).join(sampled, ["video", "frame_id"]).drop("frame_id")


def pictures(inputs: Inputs, sampled: DataFrame) -> DataFrame:
    """video, t, h, w, bgr of the samples; frames that were not decoded are filled as ``joins.decoded`` says."""
    have = inputs.frames.select("video", "frame_id", F.struct("h", "w", "bgr").alias("picture"))
    found = joins.decoded(sampled, have, inputs.videos.select("video", "total_frames"), "picture").filter("picture is not null")
    return found.select("video", F.col("t").cast("long").alias("t"), "picture.h", "picture.w", "picture.bgr")


def picture_kinds(inputs: Inputs, sampled: DataFrame) -> DataFrame:
    """video, t, pict_type of the samples."""
    if inputs.kinds is not None:
        return by_place(inputs.kinds.select("video", "frame_id", F.upper("pict_type").alias("pict_type")), sampled)
    keys = keyframes_of(inputs)
    if keys is None:
        raise ValueError("capping I frames needs kinds, keyframes or packets")
    return sampled.join(keys.withColumn("pict_type", F.lit("I")), ["video", "frame_id"], "left").select("video", "t", F.coalesce("pict_type", F.lit("P")).alias("pict_type"))


def group_records(blocks: DataFrame, chosen: DataFrame, placed: DataFrame) -> DataFrame:
    """A row a group: its frames, anchor, blocks, patches, canvases and the number of its first canvas in the video."""
    per = blocks.groupBy("video", "group_idx").agg(F.max("frame_count").cast("long").alias("frame_count"), F.max("anchor_t").cast("long").alias("anchor_t"), F.min("group_start").cast("long").alias("start"))
    some = chosen.groupBy("video", "group_idx").agg(F.count("*").alias("selected_blocks"))
    laid = placed.groupBy("video", "group_idx").agg(F.count("*").alias("patches"), (F.max("canvas_idx") + 1).cast("long").alias("num_canvases"))
    rows = per.join(some, ["video", "group_idx"], "left").join(laid, ["video", "group_idx"], "left").na.fill(0, ["selected_blocks", "patches", "num_canvases"])
    before = F.sum("num_canvases").over(W.partitionBy("video").orderBy("group_idx").rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("global_img_offset", F.coalesce(before, F.lit(0))).withColumn("end", F.col("start") + F.col("frame_count"))


def run(inputs: Inputs, config: Config) -> Outputs:
    """The tables of one configuration.

    Videos without a sampled frame that has costs are in ``sampled`` and ``meta`` alone, with no groups.
    """
    c = config.normalised()
    if c.letterbox and inputs.frames is None:
        raise ValueError("letterboxes need pixel frames")
    moves = c.avoid_keyframes and c.sampling != "all_frames"
    if (moves or c.iframe_clip != "none") and (keys := keyframes_of(inputs)) is not None:
        inputs = replace(inputs, keyframes=cut(keys))
    sampled = cut(sampled_frames(inputs, c))
    grid = by_place(inputs.grid.select("video", "frame_id", "i", "j", "cost"), sampled)
    frames = good = None
    if inputs.frames is not None:
        frames = pictures(inputs, sampled)
        good = cut(image.with_stats(frames).select("video", "t", (~image.is_bad()).alias("good")))
        if c.letterbox:
            first = frames.join(frames.groupBy("video").agg(F.min("t").alias("t")), ["video", "t"], "left_semi")
            grid = pixels.content_mask(grid, pixels.letterboxes(first, c.letterbox_threshold))
    kinds = picture_kinds(inputs, sampled) if c.iframe_clip != "none" else None
    rates = inputs.videos if c.readiness_mode == "clamped_sqrt_bpppf" else None
    blocks = cut(in_groups(cut(shaped_blocks(grid, c, kinds)), c, good, rates))
    chosen = cut(pick(blocks, grid, frames, c))
    placed = place(blocks, chosen, c)
    groups = group_records(blocks, chosen, placed)
    key = F.lit(c.key()).alias("config")
    groups_out = groups.select(key, F.col("video").cast("string").alias("video"), *[F.col(n).cast("long").alias(n) for n in ("group_idx", "start", "end", "frame_count", "anchor_t", "num_canvases", "global_img_offset", "selected_blocks", "patches")])
    canvases = None
    if frames is not None:
        drawn = pixels.numbered_canvases(pixels.canvases(frames, placed, c.rows // c.patch, c.cols // c.patch, c.pixels or c.patch))
        canvases = drawn.select("video", "n", "h", "w", "rgb")
    return Outputs(sampled, blocks, chosen, placed, groups_out, _meta(inputs, c, sampled, blocks, groups, grid, frames), frames, canvases)


def _meta(inputs: Inputs, c: Config, sampled: DataFrame, blocks: DataFrame, groups: DataFrame, grid: DataFrame, frames: DataFrame | None) -> DataFrame:
    counts = sampled.groupBy("video").agg(F.count("*").alias("sampled_frames"))
    totals = groups.groupBy("video").agg(F.count("*").alias("num_groups"), F.sum("num_canvases").alias("total_images"), F.sum("patches").alias("total_patches"), F.sum("selected_blocks").alias("selected_blocks"))
    out = inputs.videos.select("video", F.col("total_frames").cast("long").alias("total_frames"), F.col("fps").cast("double").alias("fps")).join(counts, "video", "left").join(totals, "video", "left")
    keys = keyframes_of(inputs) if c.avoid_keyframes and c.sampling != "all_frames" else None
    out = out.join(keys.groupBy("video").agg(F.count("*").alias("keyframes_found")), "video", "left") if keys is not None else out.withColumn("keyframes_found", F.lit(0).cast("long"))
    numbers = ["sampled_frames", "keyframes_found", "num_groups", "total_images", "total_patches", "selected_blocks"]
    out = out.na.fill(0, numbers).withColumn("tail_frames", F.col("sampled_frames") % c.group_size if c.grouping == "fixed" else F.lit(0))
    summary = F.lit(None).cast("string").alias("selector_summary")
    if c.selector == "diverse_mixed" and (c.diversity_fraction > 0 or c.dedup):
        found = rollup.full_summary(diagnosed(blocks, grid, c, frames))
        out = out.join(found.select("video", F.to_json(F.struct(*[n for n in found.columns if n != "video"])).alias("selector_summary")), "video", "left")
        summary = F.col("selector_summary")
    settings = F.lit(json.dumps(asdict(c), sort_keys=True)).alias("settings")
    return out.select(F.lit(c.key()).alias("config"), F.col("video").cast("string").alias("video"), settings, "total_frames", "fps", "sampled_frames", "keyframes_found", "num_groups", F.col("tail_frames").cast("long").alias("tail_frames"), "total_images", "total_patches", "selected_blocks", summary)


def read_meta(spark: SparkSession, path: str, config: Config | None = None) -> DataFrame:
    """Records of finished videos; of runs side by side that made the same video, one."""
    jvm, where = spark.sparkContext._jvm, f"{path}/meta"
    folder = jvm.org.apache.hadoop.fs.Path(where)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], META)
    rows = spark.read.schema(META).parquet(where)
    return (rows.filter(F.col("config") == config.normalised().key()) if config else rows).dropDuplicates(["config", "video"])


def run_missing(inputs: Inputs, path: str, config: Config, kind: str | None = None) -> DataFrame:
    """Makes the videos that have no record for the configuration; the records of all videos of ``inputs``.

    Written are positions, groups and sampled frames, each in ``path``/name with a part for configuration and video, then
    canvas files of ``kind`` (png, jpg) in ``path``/canvases/configuration, then the records.  A run that is cut short is
    made again but for the videos of runs that ended.  A video without placements has a record and is not made again.
    """
    from ..sources import canvases as files

    spark, c = inputs.videos.sparkSession, config.normalised()
    if kind is not None:
        files.encoder(kind)
        if inputs.frames is None:
            raise ValueError("canvas files need pixel frames")
    done = read_meta(spark, path, c).select(F.col("video").alias("_done"))
    todo = inputs.videos.join(done, F.col("video").cast("string") == F.col("_done"), "left_anti").select(F.col("video").cast("string").alias("video")).distinct()
    if todo.limit(1).count():
        out = run(inputs.only(todo), c)
        for name, table in (("src_patch_position", out.placed), ("groups", out.groups.drop("config")), ("frame_ids", out.sampled)):
            keyed = table.withColumn("video", F.col("video").cast("string")).withColumn("config", F.lit(c.key()))
            keyed.repartition("video").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("config", "video").parquet(f"{path}/{name}")
        if kind is not None:
            files.write_files(out.canvases, f"{path}/canvases/{c.key()}", kind)
        out.meta.write.mode("append").partitionBy("config").parquet(f"{path}/meta")
    mine = inputs.videos.select(F.col("video").cast("string").alias("video")).distinct()
    return read_meta(spark, path, c).join(mine, "video", "left_semi")
