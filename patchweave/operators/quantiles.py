"""Exact quantiles of groups of any size, by narrowing in on the wanted ranks.

A pass counts rows by cells of values, before the shuffle.  A running sum over a group's cells tells which hold the
wanted ranks, and only the rows of those go on: first cells of a fixed logarithmic scale, in later passes even parts of
what the found cells span.  What is left is counted by value and sorted, with spill.  No buffer holds the values of a
group; a task sorts the cells of a group, or the values of one cell (without passes: of a group).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Cells of the first pass for a factor e, and of each later pass for a cell of the pass before.
PER_E, PARTS = 1024, 4096
#: Beyond every finite value: infinite ones, then NaN, which is the largest value.
BEYOND, NAN = 1_000_000, 1_000_001


def _log_cell(x: Column) -> Column:
    """A cell that never falls as x grows."""
    scaled = F.signum(x) * F.log1p(F.abs(x)) * PER_E
    inside = F.floor(F.greatest(F.lit(-float(BEYOND)), F.least(F.lit(float(BEYOND)), scaled)))
    return F.when(F.isnan(x), F.lit(NAN).cast("long")).otherwise(inside.cast("long"))


def _even_cell(x: Column, low: Column, high: Column) -> Column:
    """Even parts of [low, high], in the order of x; all of it is one part if it is not a finite span."""
    span = high - low
    usable = (high > low) & (span > 0) & (span < float("inf"))
    return F.when(usable, F.least(F.lit(PARTS - 1).cast("long"), F.floor((x - low) / span * PARTS).cast("long"))).otherwise(F.lit(0).cast("long"))


def _place(n: Column, q: float) -> Column:
    """The place of a quantile among n values in order, from 0."""
    return (n - 1) * F.lit(float(q))


def _holds(qs: list[float]) -> Column:
    """Whether ranks [before, before + w) have one of those between which a quantile lies."""
    inside = F.lit(False)
    for q in qs:
        for edge in (F.floor(_place(F.col("n"), q)), F.ceil(_place(F.col("n"), q))):
            inside = inside | ((edge >= F.col("before")) & (edge < F.col("before") + F.col("w")))
    return inside


def exact_quantiles(rows: DataFrame, by: list[str], value: str, quantiles: dict[str, float], weight: str | None = None, passes: int = 1) -> DataFrame:
    """A row a group (``by``; [] for all rows) with the quantiles asked for, {column: quantile}.

    Between two values in order it lies as far as its place (n - 1) q does.  A row counts ``weight`` times (once); null
    values and weights of 0 do not count, a null name is a group.  Groups without a value have no row, and neither has an
    empty table.  A pass reads ``rows`` once more: none for groups whose values one task can sort (a number a frame), one
    leaves a thousandth part of a factor e to be sorted, further ones are for large groups in narrower ranges.
    """
    qs = list(quantiles.values())
    if not qs or any(not 0 <= q <= 1 for q in qs):
        raise ValueError("quantiles must lie in [0, 1]")
    keys = [f"_g{i}" for i in range(len(by))] or ["_g0"]
    named = [F.col(c).alias(k) for c, k in zip(by, keys)] or [F.lit(0).alias("_g0")]
    w = F.coalesce(F.col(weight).cast("long"), F.lit(0).cast("long")) if weight else F.lit(1).cast("long")
    left = rows.select(*named, F.col(value).cast("double").alias("x"), w.alias("w")).filter("x is not null and w > 0")

    def found(counts: DataFrame, inner: list[str], order: str, first: bool) -> DataFrame:
        """Cells that hold a wanted rank; ``before``: the rows of the group before the cell."""
        part = W.partitionBy(*inner)
        counts = counts.withColumn("n", F.sum("w").over(part)).withColumn("base", F.lit(0).cast("long")) if first else counts
        before = F.col("base") + F.sum("w").over(part.orderBy(order).rowsBetween(W.unboundedPreceding, 0)) - F.col("w")
        return counts.withColumn("before", before).filter(_holds(qs))

    inner, cells = keys, None
    for i in range(passes):
        cell, spans = f"cell{i}", [F.sum("w").alias("w"), F.min("x").alias("low"), F.max("x").alias("high")]
        if cells is None:
            left = left.withColumn(cell, _log_cell(F.col("x")))
            counts = left.groupBy(*inner, cell).agg(*spans)
        else:
            left = _meet(left, cells.select(*inner, "low", "high", "n", F.col("before").alias("base")), inner)
            left = left.withColumn(cell, _even_cell(F.col("x"), F.col("low"), F.col("high")))
            counts = left.groupBy(*inner, cell).agg(*spans, F.first("n").alias("n"), F.first("base").alias("base"))
            left = left.drop("n", "base", "low", "high")
        cells = found(counts, inner, cell, cells is None)
        inner = [*inner, cell]
    if cells is None:
        last = found(left.groupBy(*inner, "x").agg(F.sum("w").alias("w")), inner, "x", True)
    else:
        left = _meet(left, cells.select(*inner, "n", F.col("before").alias("base")), inner)
        last = found(left.groupBy(*inner, "x").agg(F.sum("w").alias("w"), F.first("n").alias("n"), F.first("base").alias("base")), inner, "x", False)

    at = lambda edge: F.max(F.when((edge >= F.col("before")) & (edge < F.col("before") + F.col("w")), F.col("x")))
    n = F.max("n")
    picked = []
    for i, q in enumerate(qs):
        place = _place(F.col("n"), q)
        picked += [at(F.floor(place)).alias(f"_a{i}"), at(F.ceil(place)).alias(f"_b{i}")]
    values = last.groupBy(*keys).agg(n.alias("n"), *picked)
    out = []
    for i, (name, q) in enumerate(quantiles.items()):
        a, b, place = F.col(f"_a{i}"), F.col(f"_b{i}"), _place(F.col("n"), q)
        out.append(F.when(a == b, a).otherwise((F.ceil(place) - place) * a + (place - F.floor(place)) * b).alias(name))
    return values.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], *out)


def _meet(rows: DataFrame, cells: DataFrame, on: list[str]) -> DataFrame:
    """Rows of the cells, with their columns; null names meet."""
    cells = cells.select(*[F.col(c).alias(f"_r{c}") if c in on else F.col(c) for c in cells.columns])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_r{c}"))
    return rows.join(cells, same).drop(*[f"_r{c}" for c in on])
