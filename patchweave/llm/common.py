"""Helpers shared by the operators: staging tables, shipping code, table access."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than these ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"

#: Rows and bytes of a batch that crosses to a Python worker, at most; smaller settings of the session are kept.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20
#: Bytes of a row group of a staged table: what a writing task holds.
ROW_GROUP = 32 << 20
#: Whether shuffle files are deleted when the query that made them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: set[str] = set()
#: Every staged table of the process, to be deleted when it ends.
_staged: dict[str, SparkSession] = {}
#: The innermost ``owned`` block of this thread (or context).
_owner: ContextVar["Owner | None"] = ContextVar("owner", default=None)


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where that is unset, the checkpoint folder of the context; else one of our own: below the warehouse, or a temporary
    one if driver and executors are one process on one machine.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        alone = context.master.startswith("local") and not context.master.startswith("local-cluster")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="patchweave-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_patchweave")
    return context.getCheckpointDir().rstrip("/")


@contextmanager
def ending_shuffles(spark: SparkSession):
    """Shuffle files of what is written within go when it is written: nothing reads them again."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


def stage(df: DataFrame, name: str, narrow: bool = False, codec: str = "snappy", by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and lost executors cost nothing before it.

    A ``narrow`` table (a few numbers a row) goes into an eighth as many files as there are shuffle partitions.  ``by`` is
    a column by which the table lies in folders.
    """
    spark = session(df)
    if narrow:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # no marker file: nobody looks for one, and on a local disk each costs the driver two processes, which for a moment share its memory
    writer = df.write.option("parquet.block.size", ROW_GROUP).option("compression", codec).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    with ending_shuffles(spark):
        (writer.partitionBy(by) if by else writer).parquet(path)
    _staged[path] = spark
    if (owner := _owner.get()) is not None:
        owner.paths.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._patchweave_path = path
    return out


def release_part(df: DataFrame, folder: str) -> None:
    """Delete a folder of a staged table that lies in folders; no frame may read that part any more."""
    _drop(session(df), f"{path_of(df)}/{folder}")


def path_of(df: DataFrame) -> str:
    """Where a frame that ``stage`` gave is written."""
    return df._patchweave_path


class Owner:
    """The tables that one call staged; each call has its own, so that calls side by side never delete one another's."""

    def __init__(self):
        self.paths: set[str] = set()
        self.kept: set[str] = set()

    def keep(self, *frames: DataFrame) -> None:
        """These tables outlive the call: they are handed to the call around it, or to the end of the process."""
        self.kept |= {path_of(f) for f in frames}


@contextmanager
def owned():
    """A call that deletes what it staged when it ends, but for what it keeps; all of it where it fails."""
    above, own = _owner.get(), Owner()
    token = _owner.set(own)
    done = False
    try:
        yield own
        done = True
    finally:
        _owner.reset(token)
        kept = own.kept if done else set()
        release(own.paths - kept)
        if above is not None:
            above.paths |= own.paths & kept


def release(paths) -> None:
    """Delete these staged tables; no frame may read them any more."""
    for path in list(paths):
        spark = _staged.pop(path, None)
        if spark is not None:
            _drop(spark, path)


@atexit.register
def _drop_staged() -> None:
    release(_staged)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; the cluster cleans its checkpoint folder
        return


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers (once per application), so that it need not be installed there."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, str(1 << 30)).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="patchweave-"), "patchweave.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("patchweave", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[Iterator], Iterator]], schema: str) -> DataFrame:
    """``mapInArrow`` of an importable factory ``make(...)``; the factory runs in the worker, so tables are built there."""
    ship(session(df))

    def run(batches):
        yield from make()(batches)

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(col: str = "doc_id", parts: int = 4):
    """crc32 of the id as text, modulo ``parts``; fold 2 is held out."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % parts


def held_out(col: str = "doc_id"):
    return F.coalesce(crc_fold(col) == 2, F.lit(False))
