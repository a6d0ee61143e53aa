"""Score shaping and roll-ups of cost grids (video, t, i, j, cost)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


def normalised(grid: DataFrame, log_scale: bool = True, quantile: float = 0.99) -> DataFrame:
    """Costs clipped at 0, optionally log(1 + x), divided by the frame's quantile (1e-6 at least), clipped to [0, 1]."""
    cost = F.greatest("cost", F.lit(0.0))
    cost = F.log1p(cost) if log_scale else cost
    top = F.percentile(F.col("x"), F.lit(quantile)).over(W.partitionBy("video", "t"))
    return grid.withColumn("x", cost).withColumn("p", F.greatest(top, F.lit(1e-6))).select("video", "t", "i", "j", F.least(F.lit(1.0), F.col("x") / F.col("p")).alias("cost"))


def patch_scores(grid: DataFrame, patch: int) -> DataFrame:
    """video, t, ph, pw, score: sums over patch x patch cells."""
    return grid.groupBy("video", "t", F.floor(F.col("i") / patch).alias("ph"), F.floor(F.col("j") / patch).alias("pw")).agg(F.sum("cost").alias("score"))


def block_scores(grid: DataFrame, patch: int, block: int, width: int) -> DataFrame:
    """video, t, block_idx, bh, bw, score: sums over block x block patches; ``width`` cells a row."""
    f = patch * block
    rolled = grid.groupBy("video", "t", F.floor(F.col("i") / f).alias("bh"), F.floor(F.col("j") / f).alias("bw")).agg(F.sum("cost").alias("score"))
    return rolled.select("video", "t", (F.col("bh") * (width // f) + F.col("bw")).alias("block_idx"), "bh", "bw", "score")


def resized_block_scores(grid: DataFrame, rows: int, cols: int, height: int, width: int, factor: int) -> DataFrame:
    """Block sums of the grid resized to height x width by nearest source index, without making pixels.

    A cell counts in a block as often as the block's rows and columns fall on it: a product of two small tables.
    """
    spark = grid.sparkSession

    def overlap(src: int, dst: int, cell: str, block: str, n: str) -> DataFrame:
        y = spark.range(dst).select(F.col("id").alias("y"))
        return y.select(F.floor(F.col("y") * src / F.lit(dst)).cast("int").alias(cell), F.floor(F.col("y") / factor).cast("int").alias(block)).groupBy(cell, block).agg(F.count("*").alias(n))

    # at most (cells + blocks) rows each, whatever the data
    tall, wide = overlap(rows, height, "i", "bh", "ni"), overlap(cols, width, "j", "bw", "nj")
    joined = grid.join(F.broadcast(tall), "i").join(F.broadcast(wide), "j")
    return joined.groupBy("video", "t", "bh", "bw").agg(F.sum(F.col("cost") * F.col("ni") * F.col("nj")).alias("score")).select("video", "t", (F.col("bh") * (width // factor) + F.col("bw")).alias("block_idx"), "bh", "bw", "score")


def with_pixels(grid: DataFrame, rows: int, cols: int, height: int, width: int) -> DataFrame:
    """Cells with the number of pixels (column weight) that fall on them when the grid is resized to height x width."""
    spark = grid.sparkSession

    def share(src: int, dst: int, cell: str, n: str) -> DataFrame:
        return spark.range(dst).select(F.floor(F.col("id") * src / F.lit(dst)).cast("int").alias(cell)).groupBy(cell).agg(F.count("*").alias(n))

    # at most one row a cell of a side, whatever the data
    tall, wide = share(rows, height, "i", "_ni"), share(cols, width, "j", "_nj")
    joined = grid.join(F.broadcast(tall), "i", "left").join(F.broadcast(wide), "j", "left")
    return joined.select(*grid.columns, F.coalesce(F.col("_ni") * F.col("_nj"), F.lit(0)).alias("weight"))


def clip_iframes(grid: DataFrame, kinds: DataFrame, quantile: float, weight: str | None = None) -> DataFrame:
    """Scores of I frames capped at the quantile over all other frames' cells of the video; kinds(video, t, pict_type)."""
    rows = grid.join(kinds.select("video", "t", "pict_type"), ["video", "t"])
    caps = exact_quantiles(rows.filter("pict_type <> 'I'"), ["video"], "cost", {"cap": quantile}, weight)
    out = rows.join(caps, "video", "left")
    capped = (F.col("pict_type") == "I") & F.col("cap").isNotNull() & (F.col("cost") > F.col("cap"))
    return out.select("video", "t", "i", "j", F.when(capped, F.col("cap")).otherwise(F.col("cost")).alias("cost"), F.coalesce(capped, F.lit(False)).alias("changed"))


def frame_mean_floor(blocks: DataFrame, floor_ratio: float, allow_boost: bool = False) -> DataFrame:
    """Block scores scaled by ref / max(frame mean, floor): ref the median frame mean, floor a share of it."""
    means = blocks.groupBy("video", "t").agg(F.avg("score").alias("m"))
    ref = exact_quantiles(means, ["video"], "m", {"ref": 0.5}, passes=0)
    scale = F.col("ref") / F.greatest("m", F.greatest(F.lit(1e-6), F.lit(floor_ratio) * F.col("ref")))
    scale = scale if allow_boost else F.least(F.lit(1.0), scale)
    scaled = means.join(ref, "video").select("video", "t", scale.alias("scale"))
    return blocks.join(scaled, ["video", "t"]).withColumn("score", F.col("score") * F.col("scale"))


def distribute(units: DataFrame, cells: str, cost: str) -> DataFrame:
    """A unit's cost spread evenly over its cells (unit, cell, share); the remainder of rounding goes with the spread."""
    return units.select("unit", F.explode(F.sequence(F.lit(0), F.col(cells).cast("int") - 1)).alias("cell"), (F.col(cost) / F.col(cells)).alias("share"))


def distribute_parts(units: DataFrame, parts: DataFrame) -> DataFrame:
    """Costs of a unit's cells (unit, cell, share): parts spread evenly over the cells they cover, the rest over all.

    units(unit, cells, total, codec_name), parts(unit, first, count, cost).  The rest counts where it is above 0, with
    hevc where it is not within 1e-3 of 0; vp9 spreads the total evenly whatever its parts.
    """
    codec = F.lower("codec_name")
    assigned = parts.groupBy("unit").agg(F.sum("cost").alias("assigned"))
    whole = units.join(assigned, "unit", "left")
    rest = F.col("total") - F.coalesce("assigned", F.lit(0.0))
    over_all = F.when(codec == "vp9", F.col("total")).when(codec == "hevc", F.when(F.abs(rest) > 1e-3, rest)).otherwise(F.when(rest > 0, rest))
    base = whole.select("unit", F.explode(F.sequence(F.lit(0), F.col("cells").cast("int") - 1)).alias("cell"), (F.coalesce(over_all, F.lit(0.0)) / F.col("cells")).alias("share"))
    own = parts.join(units.filter(~F.coalesce(codec == "vp9", F.lit(False))).select("unit"), "unit", "left_semi")
    spread = own.select("unit", F.explode(F.sequence(F.col("first").cast("int"), (F.col("first") + F.col("count")).cast("int") - 1)).alias("cell"), (F.col("cost") / F.col("count")).alias("share"))
    return base.union(spread).groupBy("unit", "cell").agg(F.sum("share").alias("share"))


#: Fixed names: grids of a frame's costs.
GRIDS = {"sub": "sub_mb_bit_cost", "mb": "mb_bit_cost", "ctu": "ctu_bit_cost"}


def grid_cells(frames: DataFrame, grid: str = "adaptive") -> DataFrame:
    """Cells (video, t, i, j, cost) of frames(video, t, codec_name, bitcost) from the grid asked for, else the first there is.

    ``adaptive``: the large units of codecs that have them, macroblocks otherwise.
    """
    kind = F.when(F.lower("codec_name").isin("hevc", "h265", "vp9"), "ctu").otherwise("mb") if grid in ("adaptive", "auto") else F.lit(grid)
    names = [f.name for f in frames.schema["bitcost"].dataType.fields]
    own = {k: F.col("bitcost")[n].cast("array<array<double>>") for k, n in GRIDS.items() if n in names}
    asked = F.coalesce(*[F.when(kind == k, c) for k, c in own.items()], F.lit(None).cast("array<array<double>>"))
    cells = frames.select("video", "t", F.coalesce(asked, *own.values()).alias("g")).select("video", "t", F.posexplode("g").alias("i", "r"))
    return cells.select("video", "t", "i", F.posexplode("r").alias("j", "cost"))


def fuse_motion(cells: DataFrame, mv_weight: float = 0.5, direction: str = "max", compensate: bool = False, unit: float = 4.0, weights: tuple[float, float] = (1.0, 1.0), quantile: float = 0.95) -> DataFrame:
    """Motion and residual fused: |y - 128| and the size of motion over their frame's quantile, clipped, weighted mean.

    cells(video, t, i, j, residual, vx0, vy0, vx1, vy1); direction: l0, l1, max, sum or biw (by ``weights``);
    ``compensate`` takes the frame's median motion off first.
    """
    by = W.partitionBy("video", "t")
    shift = lambda c: F.col(c) / unit - (F.percentile(F.col(c) / unit, F.lit(0.5)).over(by) if compensate else 0.0)
    moved = cells.select("video", "t", "i", "j", F.abs(F.col("residual") - 128).alias("r"), *[shift(c).alias(c) for c in ("vx0", "vy0", "vx1", "vy1")])
    size = lambda k: F.sqrt(F.col(f"vx{k}") ** 2 + F.col(f"vy{k}") ** 2)
    m = {"l1": size(1), "max": F.greatest(size(0), size(1)), "sum": size(0) + size(1), "biw": weights[0] * size(0) + weights[1] * size(1)}.get(direction, size(0))
    part = lambda c, least: F.least(F.lit(1.0), F.col(c) / F.greatest(F.percentile(F.col(c), F.lit(quantile)).over(by), F.lit(least)))
    return moved.withColumn("m", m).select("video", "t", "i", "j", (mv_weight * part("m", 1e-6) + (1 - mv_weight) * part("r", 1.0)).alias("cost"))
