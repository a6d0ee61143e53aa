"""Placement of selected blocks on canvases, padding, and position algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def placements(blocks: DataFrame, selected: DataFrame, block: int, hb: int, wb: int, order: str = "block_raster") -> DataFrame:
    """Patches of the anchor's blocks, then of selected blocks by (frame, block row, block column), laid out block by block.

    Patch rank r of a group: canvas r div (hb wb); the block at k div block**2 in raster order, patch k mod block**2 in it.
    With ``wh_raster`` patches follow one another row by row whatever their blocks.
    """
    if order not in ("block_raster", "wh_raster"):
        raise ValueError(f"unknown order {order!r}")
    if order == "block_raster" and (hb % block or wb % block):
        raise ValueError(f"{hb} x {wb} patches cannot be cut into blocks of {block}")
    cols = ["video", "group_idx", "t", "block_idx", "bh", "bw"]
    anchor = blocks.filter(F.col("t") == F.col("anchor_t")).select(*cols, F.lit(0).alias("part"))
    chosen = selected.select(*cols, F.lit(1).alias("part"))
    ranked = anchor.unionByName(chosen).withColumn("r", F.row_number().over(W.partitionBy("video", "group_idx").orderBy("part", "t", "bh", "bw")) - 1)
    per, sq, wide = (hb * wb) // block**2, block * block, wb // block
    patch = ranked.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(sq - 1))))
    slot = F.col("r") % per
    dh, dw = F.floor(F.col("k") / block), F.col("k") % block
    canvas, row, column = F.floor(F.col("r") / per), F.floor(slot / wide) * block + dh, (slot % wide) * block + dw
    if order == "wh_raster":
        rank = F.col("r") * sq + F.col("k")
        canvas, row, column = F.floor(rank / (hb * wb)), F.floor(rank % (hb * wb) / wb), rank % wb
    return patch.select(
        "video", "group_idx", canvas.cast("int").alias("canvas_idx"), row.cast("int").alias("patch_h"), column.cast("int").alias("patch_w"),
        F.col("t").alias("src_frame"), (F.col("bh") * block + dh).cast("int").alias("src_patch_h"), (F.col("bw") * block + dw).cast("int").alias("src_patch_w"),
    )


def bucket_placements(buckets: DataFrame, chosen: DataFrame, frames: DataFrame, block: int, hb: int, wb: int, images: int) -> DataFrame:
    """Canvases of buckets: first the whole anchor frame, then ``images`` of chosen blocks in their order; -1 where nothing is shown.

    buckets(video, bucket, used_t), chosen(video, bucket, t, bh, bw, place), frames(video, t, good, fps).  Chosen blocks of
    bad frames leave their place empty.  seconds is the time of the source frame, -1 for padding.
    """
    per, sq, wide = (hb * wb) // block**2, block * block, wb // block
    rate = F.when(F.col("fps") > 0, F.col("fps")).otherwise(30.0)
    slots = buckets.withColumn("canvas_idx", F.explode(F.sequence(F.lit(0), F.lit(images)))).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))
    usable = chosen.join(frames.filter("good").select("video", "t"), ["video", "t"], "left_semi")
    shown = usable.select("video", "bucket", (F.floor(F.col("place") / per) + 1).cast("int").alias("canvas_idx"), (F.col("place") % per).cast("int").alias("slot"), F.col("t").alias("_t"), F.col("bh").alias("_bh"), F.col("bw").alias("_bw"))
    joined = slots.join(shown, ["video", "bucket", "canvas_idx", "slot"], "left")
    first = F.col("canvas_idx") == 0
    source = joined.select("video", "bucket", "canvas_idx", "slot", F.when(first, F.col("used_t")).otherwise(F.col("_t")).alias("t"), F.when(first, F.floor(F.col("slot") / wide)).otherwise(F.col("_bh")).alias("bh"), F.when(first, F.col("slot") % wide).otherwise(F.col("_bw")).alias("bw"))
    timed = source.join(frames.select("video", "t", rate.alias("fps")), ["video", "t"], "left").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(sq - 1))))
    dh, dw, none = F.floor(F.col("k") / block), F.col("k") % block, F.lit(-1)
    return timed.select(
        "video", "bucket", "canvas_idx", (F.floor(F.col("slot") / wide) * block + dh).cast("int").alias("patch_h"), ((F.col("slot") % wide) * block + dw).cast("int").alias("patch_w"), F.coalesce("t", none).alias("src_frame"),
        F.coalesce((F.col("bh") * block + dh).cast("int"), none).alias("src_patch_h"), F.coalesce((F.col("bw") * block + dw).cast("int"), none).alias("src_patch_w"), F.coalesce(F.col("t") / F.col("fps"), F.lit(-1.0)).alias("seconds"),
    )


def padded(placed: DataFrame, hb: int, wb: int, images: int | None = None) -> DataFrame:
    """Every canvas that is in use filled up: patches without a source hold -1.

    With ``images`` every group has just as many canvases: missing ones are all padding, those beyond are cut.
    """
    used = placed.select("video", "group_idx", "canvas_idx").distinct()
    if images is not None:
        used = used.select("video", "group_idx").distinct().withColumn("canvas_idx", F.explode(F.sequence(F.lit(0), F.lit(images - 1))))
    full = used.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(hb * wb - 1)))).select("video", "group_idx", "canvas_idx", F.floor(F.col("n") / wb).cast("int").alias("patch_h"), (F.col("n") % wb).cast("int").alias("patch_w"))
    keys = ["video", "group_idx", "canvas_idx", "patch_h", "patch_w"]
    joined = full.join(placed, keys, "left")
    return joined.select(*keys, *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("src_frame", "src_patch_h", "src_patch_w")])


def drop_padding(padded_: DataFrame, check: bool = True) -> DataFrame:
    """Canvases with any source; one that is filled in part is an error if ``check``."""
    by = W.partitionBy("video", "group_idx", "canvas_idx")
    some, every = F.bool_or(F.col("src_frame") >= 0).over(by), F.bool_and(F.col("src_frame") >= 0).over(by)
    kept = padded_.withColumn("some", some).withColumn("every", every).filter("some")
    if check:
        kept = kept.filter(F.when(F.col("every"), True).otherwise(F.raise_error(F.lit("canvas with half padding")).cast("boolean")))
    return kept.drop("some", "every")


def block_layout(raster: DataFrame, hb: int, wb: int, block: int) -> DataFrame:
    """Raster patch order of a canvas to block order: position k of each patch in the block layout."""
    bh, bw = F.floor(F.col("patch_h") / block), F.floor(F.col("patch_w") / block)
    k = (bh * (wb // block) + bw) * block * block + (F.col("patch_h") % block) * block + F.col("patch_w") % block
    return raster.withColumn("layout_pos", (F.col("canvas_idx") * hb * wb + k).cast("long"))


def timestamp_runs(positions: DataFrame, fps: float, merge: int, decimals: int = 1) -> DataFrame:
    """Runs of equal frames in layout order as (label, tokens): count div merge**2; runs of padding or no token are skipped."""
    order = W.partitionBy("video", "group_idx").orderBy("layout_pos")
    new = F.coalesce((F.col("src_frame") != F.lag("src_frame").over(order)).cast("int"), F.lit(1))
    runs = positions.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    counted = runs.groupBy("video", "group_idx", "run").agg(F.first("src_frame").alias("src_frame"), F.count("*").alias("n"))
    tokens = F.floor(F.col("n") / merge**2)
    label = F.format_string(f"<%.{decimals}f seconds>", F.col("src_frame") / F.lit(float(fps)))
    return counted.select("video", "group_idx", "run", "src_frame", label.alias("label"), tokens.alias("tokens")).filter("src_frame >= 0 and tokens > 0")


def raster(placed: DataFrame, hb: int, wb: int) -> DataFrame:
    """Placements with their place n in raster order through all canvases of the video (groups one after another)."""
    canvas = F.dense_rank().over(W.partitionBy("video").orderBy("group_idx", "canvas_idx")) - 1
    return placed.withColumn("n", (canvas * hb * wb + F.col("patch_h") * wb + F.col("patch_w")).cast("long"))


def vision_text(messages: DataFrame, runs: DataFrame) -> DataFrame:
    """id, text with its vision stretch replaced by the runs of ``timestamp_runs`` (their video is the id)."""
    from ..functions.text import with_vision_runs

    per = runs.groupBy(F.col("video").alias("id")).agg(F.array_sort(F.collect_list(F.struct("group_idx", "run", "label", "tokens"))).alias("runs"))
    labelled = F.transform("runs", lambda r: F.struct(r["label"].alias("label"), r["tokens"].alias("tokens")))
    return messages.join(per, "id").select("id", with_vision_runs(F.col("text"), labelled).alias("text"))
