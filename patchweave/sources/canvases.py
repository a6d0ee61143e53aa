"""Loose canvas files: a folder a video with canvas_NNN.png or .jpg, written by Spark tasks.

``df.write.format("canvasfiles").mode(..).save(path)`` takes canvases (video, n, h, w, rgb) in any order and partitioning;
canvases of one video may come from many tasks.  A task puts every file into the staging folder of its run under a name
of its own and renames it there: a repeated task writes the same files again, one that was lost leaves nothing under a
canvas's name.  The commit closes that folder by a rename, so that late tasks find it gone, moves whole folders of
videos into place, one rename a video, and keeps the run's list of videos in ``_manifest``; an abort removes the staging
folder.  So a folder of a video is there whole or not at all.

A driver that ends between the commit and the last rename leaves a committed staging folder: the next write to ``path``
(or ``recover``) finishes it.  One that ends before the commit leaves a staging folder that nothing reads.

``overwrite`` replaces the videos of the run and leaves others alone; ``append`` makes those only that have no folder.
``path`` is a path or URI that driver and executors see, on a file system that renames folders.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..ship import ship

SCHEMA = "video string, n int, h int, w int, rgb binary"
KINDS = ("png", "jpg")
#: Renames at a time, and names of a list that are held at a time.
MOVERS, NAMES = 16, 1 << 12


def folder_of(video: str) -> str:
    """The folder of a video, which may be named by a path: one level, never hidden; videos that differ do not meet."""
    own = re.sub(r"[^\w.-]+", "_", video, flags=re.ASCII).lstrip("._").rstrip(".")[:150]
    return own if own and own == video else f"{own}-{hashlib.md5(video.encode()).hexdigest()[:12]}"


def encoder(kind: str, quality: int = 95):
    """Pixels to the bytes of a file."""
    kind = str(kind).lower().strip()
    if kind not in KINDS:
        raise ValueError(f"unsupported canvas format {kind!r}")
    if kind == "png":
        from ..functions.image import png

        return png
    from ..functions.jpeg import jpeg

    return lambda rgb: jpeg(rgb, quality)


class Store:
    """The few calls that are needed of a file system, local or by URI."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.root = self.root.rstrip("/")

    def at(self, *names: str) -> str:
        return "/".join((self.root, *names))

    def there(self, path: str) -> bool:
        from pyarrow import fs

        return self.fs.get_file_info(path).type != fs.FileType.NotFound

    def folders(self, path: str) -> list[str]:
        from pyarrow import fs

        return sorted(i.base_name for i in self.fs.get_file_info(fs.FileSelector(path, allow_not_found=True)) if i.type == fs.FileType.Directory)

    def write(self, path: str, data: bytes) -> None:
        with self.fs.open_output_stream(path) as f:
            f.write(data)

    def drop(self, path: str) -> None:
        if self.there(path):
            self.fs.delete_dir(path)


def publish(store: Store, run: str) -> None:
    """Moves the folders of a committed run into place; may be called again where it was cut off."""
    stage = store.at("_staging", run)
    with store.fs.open_input_stream(f"{stage}/_COMMITTED") as f:
        said = json.loads(f.read())
    if not store.there(f"{stage}/closed"):
        store.fs.move(f"{stage}/open", f"{stage}/closed")

    def move(folder: str) -> None:
        source, target = f"{stage}/closed/{folder}", store.at(folder)
        if not store.there(source):
            return  # an earlier call, or another list of this run, has moved it
        if store.there(target):
            if not said["overwrite"]:
                return
            old = f"{stage}/old/{folder}"
            store.drop(old)
            store.fs.create_dir(f"{stage}/old", recursive=True)
            store.fs.move(target, old)
        store.fs.move(source, target)

    with ThreadPoolExecutor(MOVERS) as pool:
        for name in said["lists"]:
            with store.fs.open_input_stream(f"{stage}/lists/{name}") as f:
                folders: set[str] = set()
                for line in _lines(f):
                    folders.add(json.loads(line)["folder"])
                    if len(folders) == NAMES:
                        list(pool.map(move, folders))
                        folders.clear()
                list(pool.map(move, folders))
    store.fs.create_dir(store.at("_manifest", run), recursive=True)
    for name in said["lists"]:
        if store.there(f"{stage}/lists/{name}"):
            store.fs.move(f"{stage}/lists/{name}", store.at("_manifest", run, name))
    store.drop(stage)


def _lines(file, size: int = 1 << 20):
    rest = b""
    while data := file.read(size):
        *whole, rest = (rest + data).split(b"\n")
        yield from whole
    if rest:
        yield rest


def recover(path: str) -> list[str]:
    """Finishes committed runs that were cut off; returns them."""
    store = Store(path)
    found = [run for run in store.folders(store.at("_staging")) if store.there(store.at("_staging", run, "_COMMITTED"))]
    for run in found:
        publish(store, run)
    return found


@dataclass
class Listed(WriterCommitMessage):
    """The list of a task: where it stands, none where the task had no rows."""

    name: str | None


class CanvasWriter(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, quality: int, overwrite: bool):
        encoder(kind, quality)
        self.path, self.kind, self.quality, self.overwrite = path, str(kind).lower().strip(), quality, overwrite
        self.run = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:12]}"

    def write(self, iterator):
        import numpy as np

        store, encode, attempt = Store(self.path), encoder(self.kind, self.quality), uuid.uuid4().hex
        stage, counts, kept = store.at("_staging", self.run), {}, set()
        own = f"{stage}/tasks/{attempt}"
        for batch in iterator:
            for video, n, h, w, rgb in zip(*(batch[c] for c in ("video", "n", "h", "w", "rgb"))):
                video = video.as_py()
                folder = folder_of(video)
                if video not in counts and video not in kept:
                    if not self.overwrite and store.there(store.at(folder)):
                        kept.add(video)
                    else:
                        counts[video] = 0
                        store.fs.create_dir(f"{stage}/open/{folder}", recursive=True)
                        store.fs.create_dir(f"{stage}/tasks", recursive=True)
                if video in kept:
                    continue
                store.write(own, encode(np.frombuffer(rgb.as_buffer(), np.uint8).reshape(h.as_py(), w.as_py(), 3)))
                store.fs.move(own, f"{stage}/open/{folder}/canvas_{n.as_py():03d}.{self.kind}")
                counts[video] += 1
        if not counts:
            return Listed(None)
        store.fs.create_dir(f"{stage}/lists", recursive=True)
        rows = "".join(json.dumps({"video": v, "folder": folder_of(v), "canvases": n}) + "\n" for v, n in counts.items())
        store.write(f"{stage}/lists/{attempt}.json", rows.encode())
        return Listed(f"{attempt}.json")

    def commit(self, messages):
        recover(self.path)
        lists = [m.name for m in messages if m is not None and m.name]
        if not lists:
            return
        store = Store(self.path)
        stage = store.at("_staging", self.run)
        store.write(f"{stage}/_SAYS", json.dumps({"lists": lists, "overwrite": self.overwrite}).encode())
        store.fs.move(f"{stage}/_SAYS", f"{stage}/_COMMITTED")
        publish(store, self.run)

    def abort(self, messages):
        store = Store(self.path)
        store.drop(store.at("_staging", self.run))


class CanvasFiles(DataSource):
    """Options: path, kind (png or jpg), quality (of jpg, 1 to 100)."""

    @classmethod
    def name(cls):
        return "canvasfiles"

    def schema(self):
        return SCHEMA

    def writer(self, schema, overwrite):
        return CanvasWriter(self.options["path"], self.options.get("kind", "jpg"), int(self.options.get("quality", 95)), overwrite)


def write_files(canvas: DataFrame, path: str, kind: str = "jpg", quality: int = 95, overwrite: bool = True) -> None:
    """Writes canvases (video, n, h, w, rgb) to ``path``/video/canvas_NNN.png or .jpg; see the module.

    Rows without a video, number or pixels make no file.  Rows that repeat a canvas of a video write one of its
    versions: number canvases first (``pixels.numbered_canvases``).
    """
    encoder(kind, quality)
    spark = canvas.sparkSession
    ship(spark)
    spark.dataSource.register(CanvasFiles)
    rows = canvas.select(F.col("video").cast("string").alias("video"), F.col("n").cast("int").alias("n"), F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), F.col("rgb").cast("binary").alias("rgb"))
    rows = rows.dropna()
    rows.write.format("canvasfiles").option("kind", kind).option("quality", str(quality)).mode("overwrite" if overwrite else "append").save(path)


def written(spark: SparkSession, path: str) -> DataFrame:
    """video, folder, canvases of each video by its last run that wrote to ``path``; no rows before the first.

    Tasks of a run that share a video count their own canvases; a video is listed when its folder is whole, so that
    ``records.remaining(jobs, written(..), "video")`` are the jobs still to do.
    """
    store, schema = Store(path), "video string, folder string, canvases long"
    if not store.folders(store.at("_manifest")):
        return spark.createDataFrame([], schema)
    lists = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path.rstrip("/") + "/_manifest")
    runs = lists.groupBy("video", "folder", F.regexp_extract(F.input_file_name(), "([^/]+)/[^/]+$", 1).alias("run")).agg(F.sum("canvases").alias("canvases"))
    return runs.groupBy("video", "folder").agg(F.max_by("canvases", "run").alias("canvases"))
