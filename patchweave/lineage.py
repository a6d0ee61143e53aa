"""Cuts of long plans by checkpoints in a folder that all machines see."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows of a table, written once: plans that use it several times neither make it again nor grow with it.

    The folder is that of ``spark.checkpoint.dir``; only where none is set one below the warehouse is taken, or in a
    single local process a temporary one.  Files stay until the folder is cleared, or, with
    ``spark.cleaner.referenceTracking.cleanCheckpoints``, until the table is let go.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            folder = tempfile.mkdtemp(prefix="patchweave-cut-") if context.master.startswith("local") else f"{spark.conf.get('spark.sql.warehouse.dir')}/_cuts"
        context.setCheckpointDir(folder)
    return df.checkpoint()
