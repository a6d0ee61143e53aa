"""Whitening of embeddings from upper-triangle column aggregates.

Entries become whole numbers ``x = floor(1024 * c) + 100000``.  One aggregation
gives their sums, a second one, whose SQL expressions are generated for every pair
of dimensions i <= j, the sums of products of centred entries.  The covariance is
assembled from this upper triangle on the driver (dimensions squared numbers,
whatever the number of rows) and decomposed by LAPACK; its leading unit vectors go
back into one expression that projects every row.  A last aggregation measures the
covariance of what came out.

More than ``PAIRS`` pairs are summed in several aggregations over the same written
table, so that no plan grows without bound with the dimensions.

Rows whose vector is null or empty, or holds null or non-finite entries, are
dropped, and so are vectors of another length than the commonest (the longest, if
several are).  Rows without id and repeated rows count like others.  Components
whose variance is nil (constant columns, a single row) have no unit variance and
are left out.  Entries of which 1024-fold exceeds 2**52 are no fixed point numbers
and take no part either.  Sums of squares that may exceed 64 bits are exact
decimals.  Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session, stage, table

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Pairs of dimensions that one aggregation sums.
PAIRS = 4096
#: Below this part of the largest variance a component counts as constant.
NIL = 1e-10
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def entries(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, x (array of whole numbers) of the rows that take part."""
    c = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), c.alias("c")).filter(F.size("c") > 0)
    rows = rows.filter(~F.exists("c", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) * SCALE > float(1 << 52))))
    length = rows.groupBy(F.size("c").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.filter(F.size("c") == (length[0].n if length else 0)).select("id", F.transform("c", lambda e: F.floor(e * SCALE) + SHIFT).alias("x"))


def triangle(dims: int) -> list[tuple[int, int]]:
    """The pairs of dimensions i <= j in order."""
    return [(i, j) for i in range(dims) for j in range(i, dims)]


def covariance(rows: DataFrame, column: str, dims: int, n: int, pairs: int = PAIRS) -> np.ndarray:
    """The covariance (divisor ``n``) of an array column of centred entries, from generated SQL sums."""
    out, wanted = np.zeros((dims, dims)), triangle(dims)
    for lo in range(0, len(wanted), pairs):
        part = wanted[lo : lo + pairs]
        sums = ", ".join(f"sum({column}[{i}] * {column}[{j}])" for i, j in part)
        for (i, j), s in zip(part, rows.agg(F.expr(f"array({sums})")).collect()[0][0]):
            out[i, j] = out[j, i] = s / n
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS, pairs: int = PAIRS, **columns) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row and component."""
    spark = session(vectors)
    rows = stage(entries(vectors, **columns), "whiten-entries")
    first = rows.select(F.size("x").alias("d")).first()
    if first is None:
        return spark.createDataFrame([], SCHEMA)
    dims = first.d
    of = lambda f: [F.expr(f"{f}(x[{i}])") for i in range(dims)]
    n, *found = rows.agg(F.count("*"), *of("sum"), *of("min"), *of("max")).first()
    total, low, high = found[:dims], found[dims : 2 * dims], found[2 * dims :]
    array = lambda values, kind: F.array(*[F.lit(v).cast(kind) for v in values])
    centred = rows.select("id", "x", F.zip_with("x", array([s / n for s in total], "double"), lambda x, m: x - m).alias("c"))
    value, vector = np.linalg.eigh(covariance(centred, "c", dims, n, pairs))
    value, vector = value[::-1], vector[:, ::-1]
    keep = [k for k in range(min(components, dims)) if value[k] > NIL * max(value[0], 0.0)]
    if not keep:
        return spark.createDataFrame([], SCHEMA)
    # n x - S of every row, squared and summed: in 64 bits where the largest possible sum fits
    most = sum(max(n * h - s, s - n * lo) ** 2 for s, lo, h in zip(total, low, high))
    kind = "long" if most < 1 << 63 else "decimal(38,0)"
    apart = F.zip_with("x", array(total, kind), lambda x, s: x.cast(kind) * F.lit(n).cast(kind) - s)
    deviation = F.aggregate(apart, F.lit(0).cast(kind), lambda acc, d: (acc + d * d).cast(kind))
    project = lambda k: F.aggregate(F.zip_with("c", array((vector[:, k] / np.sqrt(value[k])).tolist(), "double"), lambda c, v: c * v), F.lit(0.0), lambda acc, p: acc + p)
    out = stage(centred.select("id", deviation.alias("deviation"), F.array(*[project(k) for k in keep]).alias("w")), "whiten-rows")
    means = out.agg(*[F.expr(f"sum(w[{k}])") for k in range(len(keep))]).first()
    again = out.select(F.zip_with("w", array([s / n for s in means], "double"), lambda w, m: w - m).alias("w"))
    error = float(np.abs(covariance(again, "w", len(keep), n) - np.eye(len(keep))).max())
    explained = F.element_at(array([float(value[k] / value.sum()) for k in keep], "double"), F.col("k") + 1)
    flat = out.select(F.col("id").alias("vec_id"), "deviation", F.posexplode("w").alias("k", "whitened"))
    return flat.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
