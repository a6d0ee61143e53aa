"""Runs that are done once: output is partitioned by a configuration's key and video, and only what is missing is made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .selection import Config, select_patches


def finished(spark: SparkSession, path: str, config: Config) -> DataFrame:
    """Videos whose output for the configuration is there."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/config={config.key()}")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "video string")
    return spark.read.parquet(folder.toString()).select(F.col("video").cast("string").alias("video")).distinct()


def run_missing(grid: DataFrame, path: str, config: Config, frames: DataFrame | None = None, good: DataFrame | None = None, videos: DataFrame | None = None) -> DataFrame:
    """Placements of all videos of ``grid`` for the configuration; those not there yet are made and added.

    A part is written whole or not at all, so a run that was cut short leaves nothing to be taken for finished.
    """
    spark, c = grid.sparkSession, config.normalised()
    done = finished(spark, path, c)
    todo = grid.join(done.withColumnRenamed("video", "_done"), F.col("video").cast("string") == F.col("_done"), "left_anti")
    if todo.limit(1).count():
        _, placed = select_patches(todo, c, frames, good, videos)
        placed.withColumn("config", F.lit(c.key())).repartition("video").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("config", "video").parquet(path)
    return spark.read.parquet(f"{path}/config={c.key()}").join(grid.select(F.col("video").alias("_v")).distinct(), F.col("video").cast("string") == F.col("_v").cast("string"), "left_semi")
