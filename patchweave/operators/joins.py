"""Lookups of frames: forward fill, nearest, backward as-of, re-alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def forward_fill(requested: DataFrame, decoded: DataFrame, value: str) -> DataFrame:
    """Requested (video, t, frame_id) with the decoded value, else the last good before; leading misses take the last good of all."""
    joined = requested.join(decoded.select("video", "frame_id", value), ["video", "frame_id"], "left")
    order = W.partitionBy("video").orderBy("t")
    filled = F.last(value, True).over(order.rowsBetween(W.unboundedPreceding, 0))
    at_last = F.last(value, True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return joined.select("video", "t", "frame_id", F.coalesce(filled, at_last).alias(value), F.col(value).isNull().alias("was_missing"))


def decoded(requested: DataFrame, frames: DataFrame, videos: DataFrame, value: str, within: int | None = None) -> DataFrame:
    """Requested (video, t, frame_id), ids clamped to the video, with their value; a miss takes the last good one before it,
    or, where none is before, that of the nearest decoded frame (the smaller id of two), no farther than ``within``.
    A frame that was decoded several times has its smallest value."""
    want = requested.join(videos.select("video", F.col("total_frames").cast("long").alias("n")), "video").select("video", "t", F.greatest(F.lit(0), F.least(F.col("frame_id").cast("long"), F.col("n") - 1)).alias("frame_id"))
    have = frames.select("video", F.col("frame_id").cast("long").alias("frame_id"), F.col(value).alias("_value")).groupBy("video", "frame_id").agg(F.min("_value").alias("_value"))
    joined = want.join(have, ["video", "frame_id"], "left")
    before = F.last("_value", True).over(W.partitionBy("video").orderBy("t").rowsBetween(W.unboundedPreceding, 0))
    filled = joined.withColumn("_filled", before).withColumn("was_missing", F.col("_value").isNull())
    # what stands before the first good one is looked up by distance; few rows, so their values come by a join
    early = filled.filter("_filled is null").select("video", F.col("t").cast("long").alias("id"), F.col("frame_id").alias("x"))
    near = nearest(early, have.filter("_value is not null"))
    if within is not None:
        near = near.filter(F.abs(F.col("near") - F.col("x")) <= within)
    near = near.select("video", F.col("id").alias("t"), F.col("near").alias("frame_id"))
    found = near.join(have, ["video", "frame_id"]).select("video", "t", F.col("_value").alias("_near"))
    return filled.join(found, ["video", "t"], "left").select("video", "t", "frame_id", F.coalesce("_filled", "_near").alias(value), "was_missing")


def selected(frames: DataFrame, wanted: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Frames (video, frame_id, ..) in decode order as often as they are wanted; negative ids ask for nothing.

    ``first`` and ``last`` bound the scan of a segment.
    """
    ask = wanted.filter("frame_id >= 0").groupBy("video", "frame_id").agg(F.count("*").alias("_n"))
    inside = frames
    if first is not None:
        inside = inside.filter(F.col("frame_id") >= first)
    if last is not None:
        inside = inside.filter(F.col("frame_id") <= last)
    return inside.join(ask, ["video", "frame_id"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_n")


def _sides(points: DataFrame, frames: DataFrame, point: str, frame: str) -> DataFrame:
    """Points and frames as one ordered set, with the nearest frame at or before each: no pairs."""
    p = points.select("video", F.col(point).cast("double").alias("x"), F.col("id"), F.lit(None).cast("double").alias("f"))
    f = frames.select("video", F.col(frame).cast("double").alias("x"), F.lit(None).cast("long").alias("id"), F.col(frame).cast("double").alias("f")).distinct()
    order = W.partitionBy("video").orderBy("x", F.col("f").isNull())
    return p.unionByName(f).withColumn("before", F.last("f", True).over(order.rowsBetween(W.unboundedPreceding, 0)))


def nearest(points: DataFrame, frames: DataFrame, point: str = "x", frame: str = "frame_id", ties: str = "before") -> DataFrame:
    """video, id, near: the frame nearest to each point (video, id, x); equal distances go to ``ties``."""
    back = W.partitionBy("video").orderBy(F.desc("x"), F.col("f").isNull())
    s = _sides(points, frames, point, frame).withColumn("after", F.last("f", True).over(back.rowsBetween(W.unboundedPreceding, 0))).filter("id is not null")
    a, b = F.col("x") - F.col("before"), F.col("after") - F.col("x")
    first = a <= b if ties == "before" else a < b
    near = F.when(F.col("after").isNull(), F.col("before")).when(F.col("before").isNull(), F.col("after")).when(first, F.col("before")).otherwise(F.col("after"))
    return s.select("video", "id", "x", near.cast("long").alias("near"))


def as_of(points: DataFrame, keys: DataFrame, point: str = "x", key: str = "key") -> DataFrame:
    """The last key at or before each point; the first key of all where there is none."""
    s = _sides(points, keys, point, key).filter("id is not null")
    first = keys.groupBy("video").agg(F.min(key).cast("double").alias("first"))
    return s.join(first, "video", "left").select("video", "id", "x", F.coalesce("before", "first").alias("key"))


def realign(wanted: DataFrame, got: DataFrame) -> DataFrame:
    """Ids whose multiplicities differ between wanted and got; frame 0 may be missing."""
    w = wanted.groupBy("video", "frame_id").agg(F.count("*").alias("n_wanted"))
    g = got.groupBy("video", "frame_id").agg(F.count("*").alias("n_got"))
    both = w.join(g, ["video", "frame_id"], "full").na.fill(0, ["n_wanted", "n_got"])
    return both.filter("n_wanted <> n_got and not (frame_id = 0 and n_got = 0)")
