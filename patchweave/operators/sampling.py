"""Frame samplers: row generators over the videos table (video, total_frames, fps)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry
from . import energy, groups
from .stream import Fold, fold


def sample_fps(videos: DataFrame, rate: float) -> DataFrame:
    """video, t, frame_id at ``rate`` frames a second; fps <= 0 counts as 30, rate <= 0 as 4."""
    rate = rate if rate > 0 else 4.0
    fps = F.when(F.col("fps") > 0, F.col("fps")).otherwise(30.0)
    n = F.greatest(F.lit(1), F.ceil(F.col("total_frames") / fps * rate)).cast("int")
    rows = videos.select("video", "total_frames", fps.alias("fps"), F.explode(F.sequence(F.lit(0), n - 1)).alias("t"))
    at = F.bround(F.col("t") / F.lit(float(rate)) * F.col("fps")).cast("long")
    return rows.select("video", "t", F.greatest(F.lit(0), F.least(at, F.col("total_frames") - 1)).alias("frame_id"))


def _line(i, first, last, n):
    """Truncated ``linspace``: first + i * step toward zero, the last value exact."""
    return F.when(i == n - 1, last).otherwise((first + i * ((last - first) / F.greatest(n - 1, F.lit(1)).cast("double"))).cast("long"))


def _frames():
    """How many frames a video has, one at least."""
    return F.greatest(F.lit(1), F.coalesce(F.col("total_frames"), F.lit(1))).cast("long")


def sample_uniform(videos: DataFrame, k: int) -> DataFrame:
    """``k`` evenly spaced ids; more than there are frames repeat.  A video without frames counts as one of a single frame."""
    rows = videos.select("video", _frames().alias("n"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("t"))
    last = F.col("n") - 1
    return rows.select("video", "t", (F.lit(0).cast("long") if k == 1 else _line(F.col("t"), F.lit(0.0), last, F.lit(k))).cast("long").alias("frame_id"))


def sample_all(videos: DataFrame) -> DataFrame:
    """Every frame; of a video without frames the first."""
    ids = videos.select("video", F.explode(F.sequence(F.lit(0), _frames().cast("int") - 1)).alias("t"))
    return ids.select("video", "t", F.col("t").cast("long").alias("frame_id"))


def union_distinct(*samples: DataFrame) -> DataFrame:
    """Sorted distinct ids of several samples, numbered anew."""
    out = samples[0].select("video", "frame_id")
    for s in samples[1:]:
        out = out.union(s.select("video", "frame_id"))
    return out.distinct().select("video", (F.row_number().over(W.partitionBy("video").orderBy("frame_id")) - 1).alias("t"), "frame_id")


def shift_off_keyframes(sampled: DataFrame, keyframes: DataFrame, videos: DataFrame, step: int = 1) -> DataFrame:
    """A sampled keyframe moves to the first of +d, -d (d = step, 2 step, 3 step, 4 step) that is in range and no keyframe; ids are clamped first."""
    last = F.greatest(F.lit(1), F.col("total_frames")).cast("long") - 1
    sampled = sampled.join(videos.select("video", last.alias("_last")), "video").select("video", "t", F.greatest(F.lit(0), F.least(F.col("frame_id").cast("long"), F.col("_last"))).alias("frame_id"))
    keys = keyframes.select("video", F.col("frame_id").alias("kf")).distinct()
    on_key = sampled.join(keys, (sampled["video"] == keys["video"]) & (sampled["frame_id"] == keys["kf"]), "left").select(sampled["video"], "t", "frame_id", F.col("kf").isNotNull().alias("is_key"))
    offsets = F.array(*[F.lit(s * d) for d in range(step, 4 * step + 1, step) for s in (1, -1)])
    tries = on_key.filter("is_key").select("video", "t", "frame_id", F.posexplode(offsets).alias("o", "d")).withColumn("cand", F.col("frame_id") + F.col("d"))
    tries = tries.join(videos.select("video", "total_frames"), "video").filter("cand >= 0 and cand < total_frames")
    free = tries.join(keys.withColumnRenamed("kf", "cand"), ["video", "cand"], "left_anti").groupBy("video", "t").agg(F.min_by("cand", "o").alias("moved"))
    return on_key.join(free, ["video", "t"], "left").select("video", "t", F.coalesce("moved", "frame_id").alias("frame_id"))


def refill(sampled: DataFrame, keyframes: DataFrame, videos: DataFrame) -> DataFrame:
    """Distinct ids; a video that lost some gets unused non-keyframes back, nearest to kept ids, then to the middle."""
    of = W.partitionBy("video")
    base = sampled.withColumn("r", F.row_number().over(W.partitionBy("video", "frame_id").orderBy("t")))
    base = base.withColumn("want", F.count("*").over(of)).withColumn("have", F.sum((F.col("r") == 1).cast("int")).over(of))
    whole = base.filter("want = have").select("video", "t", F.col("frame_id").cast("long").alias("frame_id"))
    kept = base.filter("want > have and r = 1").select("video", F.col("frame_id").cast("long").alias("frame_id"), "want", "have")
    short = kept.groupBy("video").agg((F.first("want") - F.first("have")).alias("lack"))
    # every frame, kept ids and keyframes as one set of rows: flags meet by one sum instead of two joins
    none, yes, no = F.lit(None).cast("long"), F.lit(True), F.lit(False)
    every = short.join(videos.select("video", "total_frames"), "video").select("video", F.explode(F.sequence(F.lit(0).cast("long"), _frames() - 1)).alias("frame_id"), F.col("lack").cast("long").alias("lack"), F.col("total_frames").cast("long").alias("total_frames"), no.alias("is_kept"), no.alias("is_key"))
    flags = kept.select("video", "frame_id", none.alias("lack"), none.alias("total_frames"), yes.alias("is_kept"), no.alias("is_key"))
    flags = flags.union(keyframes.select("video", F.col("frame_id").cast("long").alias("frame_id"), none.alias("lack"), none.alias("total_frames"), no.alias("is_kept"), yes.alias("is_key")))
    tagged = every.union(flags).groupBy("video", "frame_id").agg(F.max("lack").alias("lack"), F.max("total_frames").alias("total_frames"), F.bool_or("is_kept").alias("is_kept"), F.bool_or("is_key").alias("is_key")).filter("total_frames is not null")
    # the kept ids before and after by running values in both directions: a frame that grows to the end is summed anew for every row
    mine = F.when(F.col("is_kept"), F.col("frame_id"))
    so_far = lambda order: F.last(mine, True).over(of.orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    gap = F.least(F.col("frame_id") - so_far(F.col("frame_id")), so_far(F.desc("frame_id")) - F.col("frame_id"))
    placed = tagged.withColumn("gap", gap).withColumn("mid", F.abs(F.col("frame_id") - F.floor(F.col("total_frames") / 2)))
    free = ~F.col("is_key")
    rank = F.row_number().over(W.partitionBy("video", "is_kept").orderBy("is_key", F.when(free, F.col("gap")), F.when(free, F.col("mid")), "frame_id"))
    filled = placed.withColumn("r", rank).filter(F.col("is_kept") | (F.col("r") <= F.col("lack")))
    return whole.unionByName(filled.select("video", (F.row_number().over(of.orderBy("frame_id")) - 1).alias("t"), "frame_id"))


def split_segments(sampled: DataFrame, parts: int) -> DataFrame:
    """Contiguous parts with bounds round(i n / parts), half to even; empty parts do not appear."""
    n = F.count("*").over(W.partitionBy("video"))
    bound = lambda i: F.bround(i * n / F.lit(float(parts)))
    seg = F.lit(None).cast("int")
    for i in reversed(range(parts)):
        seg = F.when((F.col("t") >= bound(F.lit(i))) & (F.col("t") < bound(F.lit(i + 1))), i).otherwise(seg)
    return sampled.withColumn("segment", seg)


def line(first: float, last: float, n: int) -> np.ndarray:
    """Truncated evenly spaced integers."""
    if n <= 1:
        return np.array([int(first)][:n], np.int64)
    out = (first + np.arange(n) * ((last - first) / (n - 1))).astype(np.int64)
    out[-1] = int(last)
    return out


def sample_energy_cdf(bins: DataFrame, videos: DataFrame, bin_sec: float, k: int, mix: float = 0.3, max_per_bin: int | None = None) -> DataFrame:
    """video, t, frame_id: ``k`` ids dealt to time bins by energy, evenly spaced in a bin, missing ones over the whole video.

    Shares are energy mixed with its mean.  Bins get the whole part of their share (``max_per_bin`` at most), then one by
    largest remainder, then rounds by weight.  Only the ``k`` first bins of an order can get one, so ranks stop there:
    Spark cuts them before the shuffle, and no task holds the bins of a video.
    """
    cap, of = max_per_bin or k, W.partitionBy("video")
    v = videos.select("video", "fps", F.col("total_frames").cast("long").alias("total"))
    e = bins.select("video", "bin", F.greatest(F.coalesce("energy", F.lit(0.0)), F.lit(0.0)).alias("e")).join(v, "video")
    means = e.groupBy("video").agg(F.avg("e").alias("m"))
    mixed = (1 - mix) * F.col("e") + mix * F.when(F.col("m") > 0, F.col("m")).otherwise(1.0)
    w = e.join(means, "video").select("video", "bin", "fps", "total", F.greatest(mixed, F.lit(1e-12)).alias("w"))
    share = w.join(w.groupBy("video").agg(F.sum("w").alias("sum")), "video").withColumn("share", F.col("w") / F.col("sum") * k)
    whole = share.withColumn("c", F.least(F.floor("share"), F.lit(cap)).cast("long")).withColumn("rest", F.round(F.col("share") - F.floor("share"), 9))

    def lacking(dealt: DataFrame) -> DataFrame:
        return dealt.groupBy("video").agg((k - F.sum("c")).alias("lack"))

    def one_more(dealt: DataFrame, takers: DataFrame, order: list, lack: DataFrame) -> DataFrame:
        """The first bins of an order get one, as many as are lacking."""
        first = takers.withColumn("r", F.row_number().over(of.orderBy(*order))).filter(F.col("r") <= k).join(lack, "video").filter(F.col("r") <= F.col("lack"))
        return dealt.join(first.select("video", "bin", F.lit(1).alias("more")), ["video", "bin"], "left").withColumn("c", F.col("c") + F.coalesce("more", F.lit(0))).drop("more")

    dealt = one_more(whole, whole.filter(F.col("c") < cap), [F.desc("rest"), "bin"], lacking(whole))
    if cap < k:
        # rounds: all bins with room get one a round; how many whole rounds there are tells a histogram of rooms (cap rows)
        room = dealt.filter(F.col("c") < cap).groupBy("video", (cap - F.col("c")).alias("room")).agg(F.count("*").alias("n"))
        up = of.orderBy("room").rowsBetween(W.unboundedPreceding, 0)
        wider = F.coalesce(F.sum("n").over(of.orderBy(F.desc("room")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        filled = room.withColumn("wider", wider).withColumn("given", F.sum(F.col("room") * F.col("n")).over(up) + F.col("room") * F.col("wider"))
        level = filled.join(lacking(dealt), "video").groupBy("video", "lack").agg(
            F.max(F.when(F.col("given") <= F.col("lack"), F.struct("room", "given", "wider"))).alias("low"), F.sum("n").alias("open")
        )
        base, given = F.coalesce("low.room", F.lit(0)), F.coalesce("low.given", F.lit(0))
        takers = F.coalesce("low.wider", "open")
        left = F.col("lack") - given
        level = level.select("video", F.when(takers > 0, base + F.floor(left / takers)).otherwise(base).alias("rounds"), F.when(takers > 0, left % takers).otherwise(0).alias("lack"))
        full = dealt.join(level.select("video", "rounds"), "video", "left")
        after = full.withColumn("c", F.least(F.lit(cap), F.col("c") + F.coalesce("rounds", F.lit(0))).cast("long"))
        dealt = one_more(after, after.filter(F.col("c") < cap), [F.desc("w"), "bin"], level.select("video", "lack"))

    inside = lambda c: F.greatest(F.lit(0), F.least(F.col("total") - 1, c.cast("long"))).cast("long")
    low, high = inside(F.floor(F.col("bin") * bin_sec * F.col("fps"))), inside(F.ceil((F.col("bin") + 1) * bin_sec * F.col("fps")) - 1)
    spans = dealt.filter("c > 0").select("video", "total", "c", low.alias("lo"), F.greatest(low, high).alias("hi"))
    single = (F.col("c") == 1) | (F.col("lo") == F.col("hi"))
    spans = spans.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.when(single, 0).otherwise(F.col("c") - 1).cast("long"))).alias("i"))
    ids = spans.select("video", F.when(single, F.bround((F.col("lo") + F.col("hi")) / 2)).otherwise(_even("lo", "hi", "i", F.col("c"))).cast("long").alias("frame_id"))
    short = means.select("video").join(ids.groupBy("video").agg(F.count("*").alias("n")), "video", "left").select("video", (k - F.coalesce("n", F.lit(0))).alias("lack")).filter("lack > 0")
    short = short.join(v, "video").select("video", F.lit(0).cast("long").alias("lo"), (F.col("total") - 1).alias("hi"), "lack", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lack") - 1)).alias("i"))
    fill = short.select("video", F.when(F.col("lack") == 1, F.col("lo")).otherwise(_even("lo", "hi", "i", F.col("lack"))).cast("long").alias("frame_id"))
    return ids.union(fill).select("video", (F.row_number().over(of.orderBy("frame_id")) - 1).cast("int").alias("t"), "frame_id")


def _even(low: str, high: str, i: str, n):
    """The i-th of n truncated evenly spaced numbers; the last is the end itself."""
    at = F.col(low) + F.col(i) * ((F.col(high) - F.col(low)) / (n - 1))
    return F.when(F.col(i) == n - 1, F.col(high)).otherwise(at.cast("long"))


def cover_time(sampled: DataFrame, videos: DataFrame, every_sec: float, k: int) -> DataFrame:
    """Adds the frames at the centres of whole bins (the first ``k``), sorts, cuts to ``k``; shorter ones repeat their last id."""
    every = every_sec if every_sec > 0 else 1.0
    v = videos.select("video", F.when(F.col("fps") > 0, F.col("fps")).otherwise(30.0).alias("fps"), F.col("total_frames").cast("long").alias("total_frames"))
    n = F.least(F.lit(k), F.greatest(F.lit(1), F.floor(F.col("total_frames") / F.col("fps") / every + 1e-9))).cast("int")
    centres = v.filter("total_frames > 0").select("video", "fps", "total_frames", F.explode(F.sequence(F.lit(0), n - 1)).alias("b"))
    at = F.bround((F.col("b") + 0.5) * every * F.col("fps")).cast("long")
    centres = centres.select("video", F.lit(0).alias("t"), F.greatest(F.lit(0), F.least(at, F.col("total_frames") - 1)).cast("long").alias("frame_id"))
    all_ = union_distinct(sampled.select("video", "t", F.col("frame_id").cast("long").alias("frame_id")), centres).filter(F.col("t") < k)
    last = all_.groupBy("video").agg(F.max("frame_id").alias("last"))
    slots = last.select("video", "last", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("t"))
    return slots.join(all_, ["video", "t"], "left").select("video", "t", F.coalesce("frame_id", "last").alias("frame_id"))


def numbered(ids: DataFrame) -> DataFrame:
    """(video, frame_id) in order, numbered by t."""
    return ids.select("video", (F.row_number().over(W.partitionBy("video").orderBy("frame_id")) - 1).alias("t"), F.col("frame_id").cast("long").alias("frame_id"))


def with_fallback(sampled: DataFrame, videos: DataFrame, rate: float) -> DataFrame:
    """Videos without a sample are sampled at ``rate`` frames a second."""
    empty = videos.join(sampled.select("video").distinct(), "video", "left_anti")
    return sampled.select("video", "t", F.col("frame_id").cast("long").alias("frame_id")).unionByName(sample_fps(empty, rate).select("video", "t", F.col("frame_id").cast("long").alias("frame_id")))


def keyframe_ids(packets: DataFrame, videos: DataFrame) -> DataFrame:
    """video, frame_id of key packets: times rounded to frames (half to even), clamped, distinct; frame 0 is always one."""
    v = videos.select("video", F.when(F.col("fps") > 0, F.col("fps")).otherwise(30.0).alias("fps"), F.col("total_frames").cast("long").alias("n"))
    timed = F.col("pts_time").isNotNull() & ~F.isnan("pts_time") & (F.abs("pts_time") < float("inf"))
    at = F.bround(F.col("pts_time") * F.col("fps")).cast("long")
    clamped = F.when(F.col("n") > 0, F.greatest(F.lit(0), F.least(at, F.col("n") - 1))).otherwise(at)
    keys = packets.filter(F.contains("flags", F.lit("K")) & timed).join(v, "video").select("video", clamped.alias("frame_id"))
    first = F.lit(0).cast("long").alias("frame_id")
    return keys.union(v.filter("n > 0").select("video", first)).union(keys.select("video", first)).distinct()


def cap_candidates(sampled: DataFrame, peaks: DataFrame, most: int) -> DataFrame:
    """video, t, frame_id: at most ``most`` distinct ids; peaks are kept first, the others thinned evenly."""
    flagged = sampled.select("video", F.col("frame_id").cast("long").alias("frame_id")).distinct().join(peaks.select("video", F.col("frame_id").cast("long").alias("frame_id"), F.lit(True).alias("peak")).distinct(), ["video", "frame_id"], "left").na.fill(False, ["peak"])
    kind = W.partitionBy("video", "peak")
    rows = flagged.withColumn("r", F.row_number().over(kind.orderBy("frame_id")) - 1).withColumn("n", F.count("*").over(kind)).withColumn("peaks", F.sum(F.col("peak").cast("int")).over(W.partitionBy("video")))
    need, last = F.lit(most) - F.col("peaks"), F.col("n") - 1
    # row r is the truncated i-th of ``need`` even steps for the first i that reaches it
    step = last / F.greatest(need - 1, F.lit(1)).cast("double")
    i = F.ceil(F.col("r") / step)
    even = F.when(need == 1, F.col("r") == 0).otherwise((F.col("r") == last) | ((i < need - 1) & ((i * step).cast("long") == F.col("r"))))
    keep = F.when(F.col("peak"), F.col("r") < most).otherwise((need > 0) & ((F.col("n") <= need) | even))
    return numbered(rows.filter(keep))


def adaptive_parameters(videos: DataFrame, patch: int = 14, min_pixels: int = 3136, max_pixels: int = 150_000, max_patches: int = 0, cap: int = 30_000, multiplier: float = 8.0, max_frames: int = 1024) -> DataFrame:
    """Sampling parameters by duration and size; videos(video, total_frames, fps, height, width).

    num_gops, num_images, seq_len, window_len, num_windows, top_windows.  Fixed values: 8 s a group, windows of 6, 10
    and 12 s up to 15 s, 60 s and beyond.
    """
    total, rate = F.col("total_frames"), F.when(F.col("fps") > 0, F.col("fps")).otherwise(30.0)
    sec = F.when(total > 0, total / rate).otherwise(0.0)
    clamp = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(hi if not isinstance(hi, int) else F.lit(hi), x.cast("int")))
    size = geometry.smart_resize(F.col("height"), F.col("width"), 2 * patch, max_pixels, min_pixels)
    v = videos.withColumn("_s", size).withColumn("num_gops", F.least(clamp(F.bround(sec / 8), 1, 16), F.greatest(F.lit(1), total)))
    patches = F.greatest(F.lit(1), (F.floor(F.col("_s.h") / patch) * F.floor(F.col("_s.w") / patch)).cast("int"))
    budget = F.lit(min(max_patches, cap)) if max_patches > 0 else groups.auto_patches(patches, total, rate, cap)["patches"]
    images = F.greatest(F.lit(4), F.floor(F.greatest(F.lit(1), F.floor(budget / patches)) / 4) * 4, F.col("num_gops") * 4).cast("int")
    v = v.withColumn("num_images", images)
    seq = clamp(F.lit(float(multiplier)) * F.col("num_images"), 64, max_frames)
    window = F.bround(rate * F.when(sec <= 15, 6.0).when(sec <= 60, 10.0).otherwise(12.0) / 16) * 16
    windows = F.greatest(F.lit(5), F.least(F.lit(20), F.ceil(sec / 5))).cast("int")
    top = F.least(F.greatest(F.lit(2), F.least(F.lit(8), F.ceil(sec / 20))).cast("int"), windows)
    return v.select("video", "num_gops", "num_images", F.when(total > 0, F.least(seq, F.greatest(F.lit(16), total))).otherwise(seq).alias("seq_len"), F.greatest(F.lit(32), F.least(window.cast("int"), total)).alias("window_len"), windows.alias("num_windows"), top.alias("top_windows"))


def sampled_count(total_frames, target_canvas: int, images_per_group: int, group_size: int):
    """How many frames fill the canvases asked for, no more than there are."""
    return F.least(F.lit(target_canvas // images_per_group * group_size), F.greatest(F.lit(1), total_frames)).cast("int")


def pick_windows(videos: DataFrame, packets: DataFrame, length: int, candidates: int, top: int) -> DataFrame:
    """video, rank, start, end, score: evenly spaced windows of ``length`` frames with the most bytes, ties to earlier ones.

    A video no longer than a window is one window of score 0; so is a video without frames.
    """
    v = videos.select("video", F.col("total_frames").cast("long").alias("n"), F.when(F.col("fps") > 0, F.col("fps")).otherwise(30.0).alias("fps"))
    whole = v.filter((F.col("n") <= max(0, length)) | F.lit(length <= 0)).select("video", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("start"), F.greatest(F.lit(0), F.col("n") - 1).alias("end"), F.lit(0).cast("long").alias("score"))
    if length <= 0:
        return whole
    many = v.filter(F.col("n") > length).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(max(1, candidates) - 1))))
    many = many.withColumn("start", _line(F.col("i"), F.lit(0.0), F.col("n") - length, F.lit(candidates)).cast("long") if candidates > 1 else F.lit(0).cast("long"))
    windows = many.select("video", F.col("i").alias("win"), (F.col("start") / F.col("fps")).alias("start"), (F.lit(float(length)) / F.col("fps")).alias("dur"))
    scored = many.join(energy.window_sizes(packets, windows).withColumnRenamed("win", "i"), ["video", "i"]).withColumn("score", F.round("total", 6).cast("long"))
    rank = F.row_number().over(W.partitionBy("video").orderBy(F.desc("score"), "i"))
    picked = scored.withColumn("rank", rank).filter(F.col("rank") <= max(1, top))
    return picked.select("video", "rank", "start", F.least(F.col("n") - 1, F.col("start") + length - 1).alias("end"), "score").unionByName(whole)


def allocate_ids(windows: list[tuple[int, int, float]], k: int) -> list[int]:
    """``k`` ids dealt to (start, end, score) by score, one at least each; evenly in a window, repeats dropped, the last one repeated to ``k``."""
    if k <= 0:
        return []
    if len(windows) == 1:
        return line(windows[0][0], windows[0][1], k).tolist()
    w = np.array([max(0.0, s) for _, _, s in windows])
    w = w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))
    count = np.maximum(1, np.floor(w * k).astype(int))
    while count.sum() > k and count.max() > 1:
        count[count.argmax()] -= 1
    count[w.argmax()] += max(0, k - count.sum())
    ids = sorted({int(x) for (a, b, _), c in zip(windows, count) for x in line(a, b, c)})
    return (ids + [ids[-1]] * k)[:k]


def allocate_frames(windows: DataFrame, k: int) -> DataFrame:
    """video, t, frame_id over the windows of ``pick_windows`` (a few rows a video)."""

    class Deal(Fold):
        def __init__(self):
            self.windows = []

        def row(self, rank, start, end, score):
            self.windows.append((start, end, float(score)))
            return []

        def end(self):
            return list(enumerate(allocate_ids(self.windows, k)))

    return fold(windows.select("video", "rank", "start", "end", "score"), ["video"], ["rank"], Deal, "t int, frame_id long")
