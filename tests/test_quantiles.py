"""Exact quantiles against NumPy and Spark's own aggregate."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchweave.operators.quantiles import exact_quantiles

QS = {"least": 0.0, "low": 0.1, "mid": 0.5, "high": 0.99, "most": 1.0}


def _frame(spark, groups):
    return spark.createDataFrame([(k, float(x)) for k, xs in groups.items() for x in xs], "video string, x double")


def test_groups_of_all_shapes(spark):
    rng = np.random.default_rng(5)
    groups = {
        "normal": rng.normal(0, 3, 3001), "heavy": rng.lognormal(0, 6, 2000), "narrow": 1000 + rng.random(1500) * 1e-9, "ties": rng.integers(0, 3, 900), "one": [2.5], "two": [1.0, 4.0],
        "same": [7.0] * 50, "signs": np.concatenate([-rng.lognormal(0, 20, 400), rng.lognormal(0, 20, 401), np.zeros(30)]), "tiny": rng.random(300) * 1e-300, "near": np.nextafter(1.0, 2.0) * np.ones(3),
    }
    for passes in (0, 1, 3):
        got = {r.video: r for r in exact_quantiles(_frame(spark, groups).repartition(3), ["video"], "x", QS, passes=passes).collect()}
        assert set(got) == set(groups)
        for name, xs in groups.items():
            for column, q in QS.items():
                assert got[name][column] == pytest.approx(float(np.quantile(np.asarray(xs, float), q)), rel=1e-12, abs=0), (name, column)


def test_nulls_weights_and_no_groups(spark):
    rows = [("a", 1.0, 3), ("a", 5.0, 1), ("a", 9.0, 0), ("a", None, 4), ("a", 7.0, None), (None, 2.0, 2), (None, 6.0, 2), ("none", None, 1)]
    df = spark.createDataFrame(rows, "video string, x double, n int")
    got = {r.video: r.mid for r in exact_quantiles(df, ["video"], "x", {"mid": 0.75}, "n").collect()}
    assert got == {"a": pytest.approx(np.quantile([1, 1, 1, 5], 0.75)), None: pytest.approx(np.quantile([2, 2, 6, 6], 0.75))}
    assert exact_quantiles(df, [], "x", {"mid": 0.5}).first().mid == 5.5
    assert exact_quantiles(df.filter("false"), [], "x", {"mid": 0.5}).collect() == []
    with pytest.raises(ValueError):
        exact_quantiles(df, [], "x", {"mid": 1.5})


def test_infinite_values_and_names_of_its_own(spark):
    df = _frame(spark, {"a": [float("-inf"), 1.0, 2.0, float("inf"), float("inf"), float("nan")]}).select(F.col("video").alias("cell"), F.col("x").alias("w"), F.lit(1).alias("n"))
    got = exact_quantiles(df, ["cell"], "w", {"low": 0.0, "mid": 0.4, "top": 0.8, "last": 1.0}).first()
    want = df.groupBy("cell").agg(*[F.percentile("w", F.lit(q)).alias(k) for k, q in (("low", 0.0), ("mid", 0.4), ("top", 0.8), ("last", 1.0))]).first()
    assert [str(x) for x in got] == [str(x) for x in want]


def test_no_buffer_of_values(spark):
    plan = exact_quantiles(_frame(spark, {"a": [1.0, 2.0]}), ["video"], "x", {"mid": 0.5})._jdf.queryExecution().toString()
    assert "percentile" not in plan and "collect_" not in plan
