"""Connected components by alternating large and small stars, one written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import path_of, release, stage


def apart(df: DataFrame, key: str) -> DataFrame:
    """``df`` with its long ``key`` replaced by the key's complement.

    A join by it shuffles both sides anew, as sums by the key are not placed by its complement.  Spark can then split a
    key with very many rows over tasks, which it cannot do to the result of a sum.
    """
    return df.withColumn(key, F.bitwise_not(key))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (the smallest id reachable) for every node of an edge; edges join two different ids.

    A node with very many neighbours is the common case (the centre of a star): sums by node are pre-aggregated, and
    joins by node can be split (``apart``).
    """
    now = stage(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct(), "edges", narrow=True)
    print_ = lambda df: tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
    mark = print_(now)
    while mark[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = apart(both, "u").join(apart(least, "u").hint("merge"), "u").filter("v > ~u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        star = apart(large, "a").join(apart(small, "a").hint("merge"), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        was, now = now, stage(star.distinct(), "edges", narrow=True)
        release({path_of(was)})
        before, mark = mark, print_(now)
        if mark == before:
            break
    roots = now.select(F.col("b").alias("id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots.select("id", F.col("id").alias("component")))
