"""Packets and keyframes of MP4 files as a Spark data source that reads sample tables only.

``spark.read.format("mp4packets").load(path)`` plans the files below ``path`` in ranges of ``rangeBytes``; the task of a
range hops over the boxes of its file (sixteen bytes each), reads the sample tables of the first video track, and of
the sizes only those of its own packets.  Media data are never read, so that neither time nor memory follow the size of
a file.  Files are opened through Arrow's file systems by path or URI, as the tasks see them.

A file that is cut short, holds no video track or is not of the container has no rows.  Fragments (``moof``) are not read.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..ship import ship

#: Suffixes of the container.
SUFFIXES = ("mp4", "m4v", "mov", "m4a", "3gp", "3g2")
#: pts and dts are seconds; is_key is null where a track does not list its keyframes.
SCHEMA = "video string, frame_id long, pts_time double, dts_time double, size long, pos long, is_key boolean"
#: Bytes of a file that one task answers for, entries of a table read at a time, and rows of a batch.
RANGE_BYTES, ENTRIES, ROWS = 1 << 30, 1 << 16, 1 << 14
TABLES = (b"stts", b"ctts", b"stsz", b"stsc", b"stco", b"co64", b"stss")


class Ranged:
    """Reads stretches of an open file and counts their bytes."""

    def __init__(self, file, size: int):
        self.file, self.size, self.read_bytes = file, size, 0

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        self.read_bytes += len(data)
        return data

    def numbers(self, at: int, n: int, kind: str) -> np.ndarray:
        """``n`` big-endian numbers, fewer where the file ends."""
        width = np.dtype(kind).itemsize
        data = self.read(at, n * width)
        return np.frombuffer(data[: len(data) // width * width], kind).astype(np.int64)

    def boxes(self, lo: int, hi: int) -> Iterator[tuple[bytes, int, int]]:
        """(type, start, end of the content) of the boxes of a stretch; a size of 1 has 64 bits behind the type, of 0 reaches to the end."""
        while lo + 8 <= hi:
            head = self.read(lo, 16)
            if len(head) < 8:
                return
            (size, kind), skip = struct.unpack_from(">I4s", head), 8
            if size == 1:
                if len(head) < 16:
                    return
                (size,), skip = struct.unpack_from(">Q", head, 8), 16
            elif size == 0:
                size = hi - lo
            if size < skip or lo + size > hi:
                return
            yield kind, lo + skip, lo + size
            lo += size

    def inside(self, lo: int, hi: int, *path: bytes) -> tuple[int, int] | None:
        """The content of the first box along a path of types."""
        for kind in path:
            found = next(((a, b) for k, a, b in self.boxes(lo, hi) if k == kind), None)
            if found is None:
                return None
            lo, hi = found
        return lo, hi


class Track:
    """Sample tables of a track; those that stand for runs are held, offsets and sizes are read as they are needed."""

    def __init__(self, f: Ranged, lo: int, hi: int):
        self.f = f
        mdhd = f.inside(lo, hi, b"mdia", b"mdhd")
        head = f.read(mdhd[0], 32) if mdhd else b""
        wide = head[:1] == b"\1"
        self.scale = struct.unpack_from(">I", head, 20 if wide else 12)[0] if len(head) >= 24 else 0
        stbl = f.inside(lo, hi, b"mdia", b"minf", b"stbl")
        self.at = {k: (a, b) for k, a, b in f.boxes(*stbl) if k in TABLES} if stbl else {}
        self.shift = self._edit(f.inside(lo, hi, b"edts", b"elst"))
        self.whole = self.scale > 0 and {b"stts", b"stsz", b"stsc"} <= set(self.at) and bool({b"stco", b"co64"} & set(self.at))

    def _count(self, kind: bytes, head: int, width: int) -> int:
        """Entries of a table: no more than its box has room for."""
        a, b = self.at[kind]
        data = self.f.read(a + head - 4, 4)
        return min(struct.unpack(">I", data)[0], max(0, b - a - head) // width) if len(data) == 4 else 0

    def _edit(self, found) -> int:
        """Media time at which the presentation begins: that of the first edit that shows media."""
        if not found:
            return 0
        head = self.f.read(found[0], 8)
        wide = head[:1] == b"\1"
        n, width = (struct.unpack_from(">I", head, 4)[0], 20 if wide else 12) if len(head) == 8 else (0, 12)
        for i in range(min(n, (found[1] - found[0] - 8) // width)):
            time = struct.unpack(">q" if wide else ">i", self.f.read(found[0] + 8 + i * width + (8 if wide else 4), 8 if wide else 4))[0]
            if time >= 0:
                return time
        return 0

    def _runs(self, kind: bytes, signed: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(first sample of each run, value) of a table of (count, value); ends with the number of samples."""
        n = self._count(kind, 8, 8)
        raw = self.f.numbers(self.at[kind][0] + 8, 2 * n, ">u4")[: 2 * n // 2 * 2].reshape(-1, 2)
        value = raw[:, 1].astype(np.uint32).astype(np.int32).astype(np.int64) if signed else raw[:, 1]
        return np.concatenate([[0], np.cumsum(raw[:, 0])]), value

    def keys(self) -> np.ndarray | None:
        """Samples (from 0) that the track lists as keys."""
        if b"stss" not in self.at:
            return None
        return self.f.numbers(self.at[b"stss"][0] + 8, self._count(b"stss", 8, 4), ">u4") - 1

    def _sizes(self, first: int, n: int) -> np.ndarray:
        a, b = self.at[b"stsz"]
        same = int(self.f.numbers(a + 4, 1, ">u4")[0])
        total = int(self.f.numbers(a + 8, 1, ">u4")[0])
        n = max(0, min(n, total - first))
        return np.full(n, same) if same else self.f.numbers(a + 12 + 4 * first, min(n, max(0, (b - a - 12) // 4 - first)), ">u4")

    def samples(self, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(sample numbers, offsets, sizes) of the packets that begin in chunks within [lo, hi) of the file."""
        n = self._count(b"stsc", 8, 12)
        runs = self.f.numbers(self.at[b"stsc"][0] + 8, 3 * n, ">u4").reshape(-1, 3)
        kind, width = (b"co64", 8) if b"co64" in self.at else (b"stco", 4)
        chunks = self._count(kind, 8, width)
        if not len(runs) or not chunks:
            return
        first, each = runs[:, 0] - 1, runs[:, 1]
        before = np.concatenate([[0], np.cumsum(np.diff(first) * each[:-1])])  # samples before each run of chunks
        for start in range(0, chunks, ENTRIES):
            offset = self.f.numbers(self.at[kind][0] + 8 + width * start, min(ENTRIES, chunks - start), f">u{width}")
            hit = np.flatnonzero((offset >= lo) & (offset < hi))
            # neighbours are read together, a bounded number of packets at a time
            for part in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1) if len(hit) else ():
                run = np.searchsorted(first, start + part, "right") - 1
                sample = before[run] + (start + part - first[run]) * each[run]
                cut = np.flatnonzero(np.diff((sample - sample[0]) // ROWS)) + 1
                for p, s, k in zip(np.split(part, cut), np.split(sample, cut), np.split(each[run], cut)):
                    size = self._sizes(int(s[0]), int(k.sum()))
                    number = int(s[0]) + np.arange(len(size))
                    of = np.searchsorted(s, number, "right") - 1
                    end = np.cumsum(size)
                    inner = end - size - np.concatenate([[0], end])[s[of] - s[0]]
                    yield number, offset[p][of] + inner, size

    def times(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pts, dts) in seconds."""
        if not hasattr(self, "_clock"):
            first, step = self._runs(b"stts")
            start = np.concatenate([[0], np.cumsum(np.diff(first) * step)])
            self._clock = (first, step, start, self._runs(b"ctts", signed=True) if b"ctts" in self.at else None)
        first, step, start, late = self._clock
        run = np.clip(np.searchsorted(first, number, "right") - 1, 0, max(0, len(step) - 1))
        dts = start[run] + (number - first[run]) * step[run] if len(step) else np.zeros(len(number), np.int64)
        pts = dts
        if late and len(late[1]):
            pts = dts + late[1][np.clip(np.searchsorted(late[0], number, "right") - 1, 0, len(late[1]) - 1)]
        return (pts - self.shift) / self.scale, (dts - self.shift) / self.scale


def video_track(f: Ranged) -> Track | None:
    """The first video track whose tables are there."""
    movie = f.inside(0, f.size, b"moov")
    for kind, a, b in f.boxes(*movie) if movie else ():
        handler = f.inside(a, b, b"mdia", b"hdlr") if kind == b"trak" else None
        if handler and f.read(handler[0] + 8, 4) == b"vide" and (track := Track(f, a, b)).whole:
            return track
    return None


def packets(f: Ranged, lo: int, hi: int) -> Iterator[dict[str, np.ndarray | None]]:
    """Columns of the packets within a range of a file, in stretches."""
    track = video_track(f)
    if track is None:
        return
    keys = track.keys()
    for number, pos, size in track.samples(lo, hi):
        pts, dts = track.times(number)
        yield {"frame_id": number, "pts_time": pts, "dts_time": dts, "size": size, "pos": pos, "is_key": None if keys is None else np.isin(number, keys)}


def listed_keys(f: Ranged) -> list[int] | None:
    """Frames (from 0, in order) that the first video track with a whole list names as keys, 0 among them; None without such a list."""
    movie = f.inside(0, f.size, b"moov")
    for kind, a, b in f.boxes(*movie) if movie else ():
        handler = f.inside(a, b, b"mdia", b"hdlr") if kind == b"trak" else None
        table = f.inside(a, b, b"mdia", b"minf", b"stbl", b"stss") if handler and f.read(handler[0] + 8, 4) == b"vide" else None
        if table is None or table[1] - table[0] < 8:
            continue
        (n,) = struct.unpack(">I", f.read(table[0] + 4, 4))
        if table[1] - table[0] >= 8 + 4 * n:
            frames = set((f.numbers(table[0] + 8, n, ">u4") - 1).tolist())
            return sorted(frames | {0}) if frames else []
    return None


def keyframes(data: bytes) -> list[int] | None:
    """``listed_keys`` of a file in memory."""
    return listed_keys(Ranged(io.BytesIO(data), len(data)))


@dataclass
class FileRange(InputPartition):
    path: str
    size: int
    lo: int
    hi: int


class Mp4Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, max(1, range_bytes)

    def partitions(self):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        self.scheme = self.path.split(root)[0] if "://" in self.path else ""
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.rpartition(".")[2].lower() in SUFFIXES)
        if not files:
            return [FileRange("", 0, 0, 0)]
        step = self.range_bytes
        return [FileRange(self.scheme + p, n, lo, min(n, lo + step)) for p, n in files for lo in range(0, max(n, 1), step)]

    def read(self, part):
        import pyarrow as pa
        from pyarrow import fs

        if not part.path:
            return
        system, path = fs.FileSystem.from_uri(part.path) if "://" in part.path else (fs.LocalFileSystem(), part.path)
        kinds = [pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
        with system.open_input_file(path) as file:
            for c in packets(Ranged(file, part.size), part.lo, part.hi):
                n = len(c["frame_id"])
                columns = [[part.path] * n, *(c[k] for k in ("frame_id", "pts_time", "dts_time", "size", "pos")), [None] * n if c["is_key"] is None else c["is_key"]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], ["video", "frame_id", "pts_time", "dts_time", "size", "pos", "is_key"])


class KeyReader(Mp4Reader):
    """Lists of keyframes: one small table a file, whatever the file's size."""

    def partitions(self):
        return [FileRange(p.path, p.size, 0, p.size) for p in super().partitions() if p.lo == 0]

    def read(self, part):
        from pyarrow import fs

        if not part.path:
            return
        system, path = fs.FileSystem.from_uri(part.path) if "://" in part.path else (fs.LocalFileSystem(), part.path)
        with system.open_input_file(path) as file:
            for frame in listed_keys(Ranged(file, part.size)) or []:
                yield part.path, frame


class Mp4Keyframes(DataSource):
    """Option: path (a file or a folder)."""

    @classmethod
    def name(cls):
        return "mp4keyframes"

    def schema(self):
        return "video string, frame_id long"

    def reader(self, schema):
        return KeyReader(self.options["path"], RANGE_BYTES)


class Mp4Packets(DataSource):
    """Options: path (a file or a folder), rangeBytes."""

    @classmethod
    def name(cls):
        return "mp4packets"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Mp4Reader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))


def read_packets(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Packets (``SCHEMA``) of all files of the container below ``path``; video is the file's path."""
    ship(spark)
    spark.dataSource.register(Mp4Packets)
    return spark.read.format("mp4packets").option("rangeBytes", str(range_bytes)).load(path)


def read_keyframes(spark: SparkSession, path: str) -> DataFrame:
    """video (path), frame_id of the frames listed as keys, 0 among them; files without a list have no rows."""
    ship(spark)
    spark.dataSource.register(Mp4Keyframes)
    return spark.read.format("mp4keyframes").load(path)
