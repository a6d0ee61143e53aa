"""Operators on pixel frames (.., h, w, bgr): measures for selection, canvases, masks.  Frames stay binary and are read in Arrow batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import image
from .select import GROUP, candidates, rank01
from .stream import Fold, fold, typed

KEYS = ["video", "group_idx"]


def _array(bgr: bytes, h: int, w: int) -> np.ndarray:
    return np.frombuffer(bgr, np.uint8).reshape(h, w, 3)


class _Measure(Fold):
    """Block measures of a group's frames; the anchor's row comes first, then the others in order."""

    def __init__(self, rows: int, cols: int, descriptor: str):
        self.rows, self.cols, self.full = rows, cols, descriptor == "full"
        self.anchor = self.before = None
        self.waiting = False

    def _difference(self, a, b):
        if a is None or b is None or a[0] != b[0] - 1:
            return None
        if self.full:
            return image.full_difference(a[1], b[1], self.rows, self.cols).ravel()
        return np.abs(a[2] - b[2]).mean((-2, -1)).ravel()

    def _out(self, now, adjacent):
        edge = image.edges(now[2]).ravel()
        novelty = np.zeros(len(edge)) if self.anchor is None else np.abs(now[2] - self.anchor[2]).mean((-2, -1)).ravel()
        none = [None] * len(edge)
        return list(zip([now[0]] * len(edge), range(len(edge)), novelty.tolist(), edge.tolist(), none if adjacent is None else adjacent.tolist()))

    def row(self, t, h, w, bgr, is_anchor):
        if bgr is None:
            return []
        frame = _array(bgr, h, w)
        now = (t, frame, image.block_descriptors(frame, self.rows, self.cols))
        if is_anchor:
            self.anchor, self.waiting = now, True
            return []
        out = []
        if self.waiting and t > self.anchor[0]:  # the frame before the anchor, if any, has passed
            out, self.waiting = self._out(self.anchor, self._difference(self.before, self.anchor)), False
        last = self.anchor if self.anchor is not None and self.anchor[0] == t - 1 else self.before
        out += self._out(now, self._difference(last, now))
        self.before = now
        return out

    def end(self):
        return self._out(self.anchor, self._difference(self.before, self.anchor)) if self.waiting else []


def measured(frames: DataFrame, rows: int, cols: int, descriptor: str = "pooled4") -> DataFrame:
    """video, group_idx, t, block_idx, novelty, edge, adjacent from frames(video, group_idx, t, anchor_t, h, w, bgr).

    novelty: distance of pooled descriptors to the anchor's block; adjacent: to the frame before, of pooled descriptors
    (``pooled4``) or of all pixels (``full``).  A group is read in order; its anchor and one frame are held.
    Frames without pixels have no rows; where the anchor is one of them, nothing is known to be new: novelty is 0.
    """
    if descriptor not in ("pooled4", "full"):
        raise ValueError(f"unknown descriptor {descriptor!r}")
    rows_ = frames.select("video", F.col("group_idx").cast("int").alias("group_idx"), F.col("t").cast("long").alias("t"), "h", "w", "bgr", (F.col("t") == F.col("anchor_t")).alias("is_anchor"))
    schema = "t long, block_idx long, novelty double, edge double, adjacent double"
    return fold(rows_, KEYS, [F.desc("is_anchor"), "t"], lambda: _Measure(rows, cols, descriptor), schema)


def diversity(blocks: DataFrame, frames: DataFrame, rows: int, cols: int, novelty_weight: float = 0.5, descriptor: str = "pooled4") -> DataFrame:
    """Candidates with novelty, edge, their mixed rank and the difference to t - 1, measured on pixels."""
    anchors = blocks.select(*GROUP, "t", "anchor_t").distinct()
    measures = measured(anchors.join(frames.select("video", "t", "h", "w", "bgr"), ["video", "t"]), rows, cols, descriptor)
    joined = blocks.join(measures, [*GROUP, "t", "block_idx"]).withColumn("novelty", F.round("novelty", 6)).withColumn("edge", F.round("edge", 6))
    ranked = rank01(rank01(candidates(joined), "novelty", GROUP, "novelty_rank"), "edge", GROUP, "edge_rank")
    return ranked.withColumn("diversity", F.round(novelty_weight * F.col("novelty_rank") + (1 - novelty_weight) * F.col("edge_rank"), 6))


def letterboxes(frames: DataFrame, threshold: float = 16.0) -> DataFrame:
    """frames without pixels, with top, bottom, left, right of their content."""
    names = ["top", "bottom", "left", "right"]
    kept = [c for c in frames.columns if c != "bgr"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.schema if f.name != "bgr") + "".join(f", {n} int" for n in names)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            boxes = [image.letterbox(_array(x.as_py(), h.as_py(), w.as_py()), threshold) if x.as_py() else (None,) * 4 for x, h, w in zip(batch["bgr"], batch["h"], batch["w"])]
            cols = list(zip(*boxes)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch[c] for c in kept] + [pa.array(c, pa.int32()) for c in cols], [*kept, *names])

    return frames.mapInArrow(run, schema)


def content_mask(grid: DataFrame, boxes: DataFrame) -> DataFrame:
    """Costs outside the content are 0; a cell counts by the pixel it starts at.  grid(video, t, i, j, cost), boxes of ``letterboxes``; cells are square.

    The first frame's box holds for its video.
    """
    first = boxes.groupBy("video").agg(F.min_by(F.struct("h", "w", "top", "bottom", "left", "right"), "t").alias("box"))
    shape = grid.groupBy("video").agg((F.max("i") + 1).alias("rows"), (F.max("j") + 1).alias("cols"))
    joined = grid.join(first.join(shape, "video"), "video", "left")
    y, x = F.col("i") * F.col("box.h") / F.col("rows"), F.col("j") * F.col("box.w") / F.col("cols")
    inside = (y >= F.col("box.top")) & (y < F.col("box.bottom")) & (x >= F.col("box.left")) & (x < F.col("box.right"))
    return joined.select("video", "t", "i", "j", F.when(F.coalesce(inside, F.lit(True)), F.col("cost")).otherwise(0.0).alias("cost"))


def patches(frames: DataFrame, placed: DataFrame, patch: int) -> DataFrame:
    """Placements with the pixels of their patch as RGB; a frame is read once for all its patches."""
    spots = placed.filter("src_frame >= 0").groupBy("video", F.col("src_frame").alias("t")).agg(F.collect_list(F.struct("group_idx", "canvas_idx", "patch_h", "patch_w", "src_patch_h", "src_patch_w")).alias("spots"))
    rows = spots.join(frames.select("video", "t", "h", "w", "bgr"), ["video", "t"]).select("video", "spots", "h", "w", "bgr")
    names = ["video", "group_idx", "canvas_idx", "patch_h", "patch_w", "rgb"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for video, spots_, h, w, bgr in zip(*(c.to_pylist() for c in batch.columns)):
                rgb = _array(bgr, h, w)[..., ::-1]
                at = lambda s: np.ascontiguousarray(rgb[s["src_patch_h"] * patch : (s["src_patch_h"] + 1) * patch, s["src_patch_w"] * patch : (s["src_patch_w"] + 1) * patch]).tobytes()
                cols = [[video] * len(spots_), *([s[k] for s in spots_] for k in names[1:5]), [at(s) for s in spots_]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [batch.schema.field("video").type, *[pa.int32()] * 4, pa.binary()])], names)

    return rows.mapInArrow(run, f"{typed(rows, 'video')}, group_idx int, canvas_idx int, patch_h int, patch_w int, rgb binary")


class _Canvas(Fold):
    def __init__(self, hb: int, wb: int, patch: int):
        self.patch = patch
        self.pixels = np.zeros((hb * patch, wb * patch, 3), np.uint8)

    def row(self, ph, pw, rgb):
        p = self.patch
        self.pixels[ph * p : (ph + 1) * p, pw * p : (pw + 1) * p] = np.frombuffer(rgb, np.uint8).reshape(p, p, 3)
        return []

    def end(self):
        h, w = self.pixels.shape[:2]
        return [(h, w, self.pixels.tobytes())]


def canvases(frames: DataFrame, placed: DataFrame, hb: int, wb: int, patch: int) -> DataFrame:
    """video, group_idx, canvas_idx, h, w, rgb: canvases of hb x wb patches; places without a source are black."""
    return fold(patches(frames, placed, patch), ["video", "group_idx", "canvas_idx"], ["patch_h", "patch_w"], lambda: _Canvas(hb, wb, patch), "h int, w int, rgb binary")


def keep_masks(placed: DataFrame) -> DataFrame:
    """video, t, patch_h, patch_w of every source patch that is shown."""
    return placed.filter("src_frame >= 0").select("video", F.col("src_frame").alias("t"), F.col("src_patch_h").alias("patch_h"), F.col("src_patch_w").alias("patch_w")).distinct()


def masked_frames(frames: DataFrame, placed: DataFrame, patch: int, side_by_side: bool = False) -> DataFrame:
    """video, t, h, w, bgr: frames with only the patches that are shown, beside the whole frame if asked for."""
    masks = keep_masks(placed).groupBy("video", "t").agg(F.collect_list(F.struct("patch_h", "patch_w")).alias("kept"))
    rows = frames.select("video", "t", "h", "w", "bgr").join(masks, ["video", "t"], "left").select("video", F.col("t").cast("long").alias("t"), "h", "w", "bgr", "kept")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for video, t, h, w, bgr, kept in zip(*(c.to_pylist() for c in batch.columns)):
                whole = _array(bgr, h, w)
                part = np.zeros_like(whole)
                for k in kept or []:
                    y, x = k["patch_h"] * patch, k["patch_w"] * patch
                    part[y : y + patch, x : x + patch] = whole[y : y + patch, x : x + patch]
                shown = np.concatenate([whole, part], 1) if side_by_side else part
                out.append((video, t, h, shown.shape[1], shown.tobytes()))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [batch.schema.field("video").type, pa.int64(), pa.int32(), pa.int32(), pa.binary()])], ["video", "t", "h", "w", "bgr"])

    return rows.mapInArrow(run, f"{typed(rows, 'video')}, t long, h int, w int, bgr binary")


def numbered_canvases(canvas: DataFrame) -> DataFrame:
    """Canvases of a video numbered through its groups: column n from 0."""
    return canvas.withColumn("n", F.row_number().over(W.partitionBy("video").orderBy("group_idx", "canvas_idx")) - 1)
