"""Queries of the whole plan, from samples to placements, with oracle SQL put together from those of its stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import BUDGET, IPG, PLACED, REFILL, SCORED, SHIFT, SIZE, UNIFORM, query
from .plans import whole
from .plans.selection import Config
from .sources import adapters as src
from .sources.adapters import with_views

#: 20 of 25 frames a second: a keyframe that moves meets a neighbour in every other place, so that samples are refilled.
PLAN = Config(sample_fps=20.0, avoid_keyframes=True, iframe_clip="non_i_percentile", iframe_clip_percentile=90.0, frame_norm="frame_mean_floor", group_size=SIZE, images_per_group=IPG)
FPS = "uni AS (SELECT video, t, greatest(0, least(round_even(t / 20.0::DOUBLE * fps, 0)::BIGINT, total_frames - 1)) AS frame_id FROM (SELECT *, unnest(range(greatest(1, ceil(total_frames / fps * 20.0))::INT)) AS t FROM videos))"
FRAMES = "videos AS (SELECT video, (max(t) + 1)::INT AS total_frames, 25.0::DOUBLE AS fps FROM grid GROUP BY 1)"
KEYS = "keys AS (SELECT DISTINCT video, t AS frame_id FROM grid WHERE t % 12 = 0)"
PICKED = f"{FRAMES}, {REFILL.replace(UNIFORM, FPS).replace(SHIFT.split(', uni AS')[0], KEYS)}, picked AS (SELECT * FROM filled UNION ALL SELECT s.video, t, frame_id FROM shifted s JOIN sz USING (video) WHERE want = have)"
SHAPED = (
    f"{PICKED}, n0 AS (SELECT p.video, p.t, i, j, g.t % 12 = 0 AS is_i, ln(1 + greatest(cost, 0)) AS x FROM picked p JOIN grid g ON g.video = p.video AND g.t = p.frame_id), p99 AS (SELECT video, t, greatest(quantile_cont(x, 0.99), 1e-6) AS p FROM n0 GROUP BY ALL), "
    "nrm AS (SELECT n0.video, n0.t, i, j, is_i, least(1.0, x / p) AS cost FROM n0 JOIN p99 ON p99.video = n0.video AND p99.t = n0.t), cap AS (SELECT video, quantile_cont(cost, 0.9) AS cap FROM nrm WHERE NOT is_i GROUP BY 1), "
    "raw AS (SELECT n.video, t, (i // 2) * 4 + j // 2 AS block_idx, i // 2 AS bh, j // 2 AS bw, sum(CASE WHEN is_i THEN least(cost, coalesce(cap, cost)) ELSE cost END) AS score FROM nrm n LEFT JOIN cap ON cap.video = n.video GROUP BY ALL), "
    "mean AS (SELECT video, t, avg(score) AS m FROM raw GROUP BY ALL), ref AS (SELECT video, quantile_cont(m, 0.5) AS ref FROM mean GROUP BY 1), "
    "block AS (SELECT b.video, b.t, block_idx, bh, bw, score * least(1.0, ref / greatest(m, greatest(1e-6, 0.5 * ref))) AS score FROM raw b JOIN mean ON mean.video = b.video AND mean.t = b.t JOIN ref ON ref.video = b.video)"
)
LAID = PLACED.replace(SCORED, SHAPED)
MADE = (
    f"{LAID}, per AS (SELECT video, group_idx, max(frame_count) AS frame_count, max(anchor_t) AS anchor_t FROM g GROUP BY ALL), picks AS (SELECT video, group_idx, count(*) AS selected_blocks FROM sel GROUP BY ALL), laid AS (SELECT video, group_idx, count(*) AS patches, max(canvas_idx) + 1 AS num_canvases FROM placed GROUP BY ALL), "
    'made AS (SELECT p.video, p.group_idx, anchor_t AS start, anchor_t + frame_count AS "end", frame_count, anchor_t, num_canvases::BIGINT AS num_canvases, coalesce(sum(num_canvases) OVER (PARTITION BY p.video ORDER BY p.group_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS global_img_offset, coalesce(selected_blocks, 0) AS selected_blocks, patches FROM per p LEFT JOIN picks c ON c.video = p.video AND c.group_idx = p.group_idx JOIN laid l ON l.video = p.video AND l.group_idx = p.group_idx)'
)


def inputs(spark, sf, pixels: bool = False) -> whole.Inputs:
    """Grids as videos of 25 frames a second; a packet a frame, every twelfth a key."""
    grid = src.grid(spark, sf).withColumnRenamed("t", "frame_id")
    costs = grid.filter("i = 0 and j = 0").select("video", "frame_id", F.col("cost").alias("size"))
    packets = costs.select("video", F.col("frame_id").alias("pkt_idx"), (F.col("frame_id") / 25.0).alias("pts_time"), "size", F.when(F.col("frame_id") % 12 == 0, "K__").otherwise("___").alias("flags"))
    videos = costs.groupBy("video").agg((F.max("frame_id") + 1).cast("int").alias("total_frames"), F.lit(25.0).alias("fps"))
    frames = src.pixel(spark, sf).withColumnRenamed("t", "frame_id") if pixels else None
    return whole.Inputs(videos, grid, packets, frames=frames)


@query("plan_sample", with_views(f"{PICKED} SELECT video, t, frame_id FROM picked", "grid"))
def plan_sample(spark, sf):
    return whole.sampled_frames(inputs(spark, sf), PLAN)


@query("plan_placements", with_views(f"{LAID} SELECT * FROM placed", "grid"))
def plan_placements(spark, sf):
    return whole.run(inputs(spark, sf), PLAN).placed


@query("plan_groups", with_views(f"{MADE} SELECT * FROM made", "grid"))
def plan_groups(spark, sf):
    return whole.run(inputs(spark, sf), PLAN).groups.drop("config").withColumn("video", F.col("video").cast("long"))


@query("plan_records", with_views(f"{MADE}, t AS (SELECT video, count(*) AS num_groups, sum(num_canvases)::BIGINT AS total_images, sum(patches)::BIGINT AS total_patches, sum(selected_blocks)::BIGINT AS selected_blocks FROM made GROUP BY 1) SELECT v.video, total_frames::BIGINT AS total_frames, fps, s.n AS sampled_frames, k.n AS keyframes_found, num_groups, s.n % {SIZE} AS tail_frames, total_images, total_patches, selected_blocks FROM videos v JOIN (SELECT video, count(*) AS n FROM picked GROUP BY 1) s ON s.video = v.video JOIN (SELECT video, count(*) AS n FROM keys GROUP BY 1) k ON k.video = v.video JOIN t ON t.video = v.video", "grid"))
def plan_records(spark, sf):
    return whole.run(inputs(spark, sf), PLAN).meta.drop("config", "settings", "selector_summary").withColumn("video", F.col("video").cast("long"))
