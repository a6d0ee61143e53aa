"""A corpus pipeline of the training-data operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of documents.

What a stage staged for its result is deleted when a later stage of the run begins,
in the same thread, on docs that do not read it: that result is written by then.  Stages
that are called one inside the other, or of several runs in several threads, leave
one another's tables alone.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchweave.llm.common import owned, path_of, release, stage, table
from patchweave.llm.jaccard_join import deduplicate
from patchweave.llm.mixing import take
from patchweave.llm.packing import pack
from patchweave.llm.quality_classifier import accept
from patchweave.llm.secret_scans import redact

_run = threading.local()


def following(step: Callable) -> Callable:
    """A stage that deletes what the stages before it in this thread left, unless its docs still read from there."""

    @wraps(step)
    def run_stage(spark, docs, sf_dir):
        # what stands before the first stage belongs to another run
        left: set[str] = getattr(_run, "left", set()) if step.__name__ != "quality" else set()
        if left:
            read = docs.inputFiles()
            done = {path for path in left if not any(path.rpartition("/")[2] in file for file in read)}
            release(done)
            left = left - done
        with owned() as own:
            out = step(spark, docs, sf_dir)
            own.kept |= own.paths  # the result reads them until it is written
        if step.__name__ != "packing":  # the last result is the caller's
            left = left | own.paths
        _run.left = left
        return out

    return run_stage


@following
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts."""
    return accept(docs, table(spark, sf_dir, "labels"))


@following
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of similar documents."""
    return deduplicate(docs)


@following
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return redact(docs)


@following
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return take(docs)


@following
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their ids."""
    return pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: Fitting, joining and tokenising are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), set()
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        release(before)
        before = {path_of(docs)}
    return STAGES[-1][1](spark, docs, sf_dir)
