"""Frame geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_RATIO = 200


def smart_resize(h: Column, w: Column, factor: int, max_pixels: int, min_pixels: int = 3136) -> Column:
    """struct(h, w): multiples of ``factor`` with an area within bounds; (0, 0) for non-positive sizes, error beyond a 200:1 ratio."""
    f = float(factor)
    area = (h * w).cast("double")
    shrink, grow = F.sqrt(area / max_pixels), F.sqrt(F.lit(float(min_pixels)) / area)
    near = lambda x: F.greatest(F.lit(f), F.bround(x / f) * f)
    down = lambda x: F.greatest(F.lit(f), F.floor(x / shrink / f) * f)
    up = lambda x: F.greatest(F.lit(f), F.ceil(x * grow / f) * f)
    rounded = near(h) * near(w)
    pick = lambda x: F.when(rounded > max_pixels, down(x)).when(rounded < min_pixels, up(x)).otherwise(near(x)).cast("int")
    good = F.struct(pick(h).alias("h"), pick(w).alias("w"))
    none = F.struct(F.lit(0).alias("h"), F.lit(0).alias("w"))
    too_long = F.greatest(h, w) > MAX_RATIO * F.least(h, w)
    return F.when((h <= 0) | (w <= 0), none).when(too_long, F.raise_error(F.lit("aspect ratio beyond 200")).cast(none_type())).otherwise(good)


def none_type() -> str:
    return "struct<h:int,w:int>"


def within_max_dim(h: Column, w: Column, max_dim: int) -> Column:
    """struct(h, w) scaled down so that the longer side is at most ``max_dim``."""
    scale = F.least(F.lit(1.0), F.lit(float(max_dim)) / F.greatest(h, w))
    side = lambda x: F.greatest(F.lit(1), F.bround(x * scale).cast("int"))
    return F.struct(side(h).alias("h"), side(w).alias("w"))


def padded_side(x: Column, factor: int) -> Column:
    return (F.ceil(x / F.lit(factor)) * factor).cast("int")


def block_budget(patches: Column, images_per_group: Column, block: int) -> Column:
    return F.greatest(F.lit(0), F.floor((images_per_group * patches - patches) / (block * block))).cast("int")


def parse_fps(rate: Column) -> Column:
    """``n/d`` or a number as a double; 0 where it cannot be parsed."""
    parts = F.split(rate, "/")
    top, low = F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")
    return F.coalesce(F.when(F.size(parts) == 1, top).when(low != 0, top / low), F.lit(0.0))
