"""Packet filters and energy timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Times that a stream can have: 31 years.
MAX_SEC = 1e9
STRETCH = 4096


def _usable() -> Column:
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) >= 0) & (F.col(c) != float("inf"))
    return ~F.coalesce(F.contains("flags", F.lit("K")), F.lit(False)) & number("pts_time") & number("size")


def validity_counters(packets: DataFrame) -> DataFrame:
    """Packets in total, dropped for being key, lacking time or size (in this order), and kept."""
    key = F.coalesce(F.contains("flags", F.lit("K")), F.lit(False))
    no_time, no_size = F.col("pts_time").isNull(), F.col("size").isNull()
    return packets.groupBy("video").agg(
        F.count("*").alias("total"),
        F.count_if(key).alias("dropped_key"),
        F.count_if(~key & no_time).alias("dropped_time"),
        F.count_if(~key & ~no_time & no_size).alias("dropped_size"),
        F.count_if(_usable()).alias("kept"),
    )


def energy_bins(packets: DataFrame, bin_sec: float = 0.5, smooth_bins: int = 1, max_sec: float = MAX_SEC) -> DataFrame:
    """video, bin, center_sec, energy: sums of log(1 + size) by time bin, empty bins kept, centred moving average.

    Packets from ``max_sec`` on are left out like other unusable times: one of them would make bins without bound.
    """
    ok = packets.filter(_usable() & (F.col("pts_time") < max_sec)).select("video", "pts_time", "size")
    # the last bin's number follows from the largest time; partial sums come first, so that the later shuffles are small
    raw = ok.withColumn("raw", F.floor(F.col("pts_time") / bin_sec)).groupBy("video", "raw").agg(F.sum(F.log1p("size")).alias("e"), F.max("pts_time").alias("tmax"))
    last = raw.groupBy("video").agg(F.greatest(F.lit(1), F.ceil((F.max("tmax") + 1e-9) / bin_sec)).alias("nb"))
    summed = raw.join(last, "video").groupBy("video", F.least(F.col("nb") - 1, "raw").alias("bin")).agg(F.sum("e").alias("e"))
    # numbers of empty bins in stretches, so that no row holds them all
    frame = last.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("nb") - 1) / STRETCH))))
    frame = frame.select("video", "nb", F.explode(F.sequence(F.col("s") * STRETCH, F.least((F.col("s") + 1) * STRETCH, F.col("nb")) - 1)).alias("bin"))
    dense = frame.join(summed, ["video", "bin"], "left").withColumn("e", F.coalesce("e", F.lit(0.0)))
    if smooth_bins > 0:
        # every bin gives its energy to its neighbours: bins meet by number, so that a long video is many groups
        reach = F.sequence(F.greatest(F.lit(0), F.col("bin") - smooth_bins), F.least(F.col("nb") - 1, F.col("bin") + smooth_bins))
        dense = dense.select("video", F.explode(reach).alias("bin"), "e").groupBy("video", "bin").agg(F.avg("e").alias("e"))
    return dense.select("video", "bin", ((F.col("bin") + 0.5) * bin_sec).alias("center_sec"), F.col("e").alias("energy"))


def window_sizes(packets: DataFrame, windows: DataFrame) -> DataFrame:
    """Sum of sizes of packets in ``[start, start + dur)`` of every window (video, win, start, dur); 0 where none.

    Packets and window ends are one ordered set with a running sum: no pairs of packets and windows, however many overlap.
    """
    size = F.expr("try_cast(size AS DOUBLE)")
    none = F.lit(None)
    p = packets.select("video", F.col("pts_time").cast("double").alias("x"), F.lit(1).alias("o"), F.coalesce(size, F.lit(0.0)).alias("size"), none.cast("long").alias("win"), F.lit(0).alias("sign")).filter("x is not null")
    edge = lambda at, sign: windows.select("video", at.cast("double").alias("x"), F.lit(0).alias("o"), F.lit(0.0).alias("size"), F.col("win").cast("long").alias("win"), F.lit(sign).alias("sign"))
    both = p.union(edge(F.col("start"), -1)).union(edge(F.col("start") + F.greatest(F.col("dur"), F.lit(0.0)), 1))
    # an end stands before the packets of its own time
    running = F.sum("size").over(W.partitionBy("video").orderBy("x", "o").rowsBetween(W.unboundedPreceding, 0))
    ends = both.withColumn("running", running).filter("win is not null")
    return ends.groupBy("video", "win").agg(F.sum(F.col("sign") * F.col("running")).alias("total"))


def _rate() -> Column:
    return F.when(F.col("fps") > 0, F.col("fps")).otherwise(30.0)


def top_bins(bins: DataFrame, videos: DataFrame, per_sec: float, cap: int) -> DataFrame:
    """The ``k`` most energetic bins of every video, ``k = min(cap, max(1, round(duration * per_sec)))``; with its fps and total_frames.

    The duration is that of the frames; fps <= 0 counts as 30.
    """
    order = W.partitionBy("video").orderBy(F.desc(F.round("energy", 6)), "bin")
    # no more than ``cap`` rows of a video and task reach the window
    best = bins.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= cap)
    v = videos.select("video", _rate().alias("fps"), F.col("total_frames").cast("long").alias("total_frames"))
    k = F.greatest(F.lit(1), F.bround(F.greatest(F.lit(0.0), F.col("total_frames") / F.col("fps")) * per_sec))
    return best.join(v, "video").filter(F.col("r") <= k).drop("r")


def peak_frames(bins: DataFrame, videos: DataFrame, per_sec: float, cap: int, neighbour: int = 1) -> DataFrame:
    """video, frame_id: frames at the centres of the top bins, clamped, and beside them, clamped and distinct."""
    top = top_bins(bins, videos, per_sec, cap)
    clamp = lambda x: F.when(F.col("total_frames") > 0, F.greatest(F.lit(0), F.least(x, F.col("total_frames") - 1))).otherwise(x)
    at = clamp(F.bround(F.col("center_sec") * F.col("fps")).cast("long"))
    spread = top.select("video", "total_frames", F.explode(F.transform(F.sequence(F.lit(-neighbour), F.lit(neighbour)), lambda d: at + d)).alias("f"))
    return spread.select("video", clamp(F.col("f")).alias("frame_id")).distinct()
