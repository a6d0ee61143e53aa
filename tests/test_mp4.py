"""The MP4 data source against files made by hand."""

import io
import os
import struct

import pytest

from patchweave.sources import mp4


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def numbers(kind, *values, extra=b""):
    return box(kind, bytes(4) + extra + struct.pack(f">{len(values)}I", *values))


def track(handler, sizes, chunks, per_chunk, durations, late=None, keys=None, scale=1000, edit=None, wide=False):
    """chunks: offsets; per_chunk and durations: runs."""
    runs = lambda rows: (len(rows), *(x for r in rows for x in r))
    tables = numbers(b"stts", *runs(durations)) + numbers(b"stsz", 0, len(sizes), *sizes) + numbers(b"stsc", *runs([(a, b, 1) for a, b in per_chunk]))
    tables += box(b"co64", bytes(4) + struct.pack(f">I{len(chunks)}Q", len(chunks), *chunks)) if wide else numbers(b"stco", len(chunks), *chunks)
    if late:
        tables += box(b"ctts", b"\1\0\0\0" + struct.pack(">I", len(late)) + b"".join(struct.pack(">Ii", *x) for x in late))
    if keys is not None:
        tables += numbers(b"stss", len(keys), *keys)
    mdhd = box(b"mdhd", bytes(12) + struct.pack(">II", scale, 0) + bytes(4))
    edits = box(b"edts", box(b"elst", bytes(4) + struct.pack(">I", len(edit)) + b"".join(struct.pack(">Iii", *e) for e in edit))) if edit else b""
    return box(b"trak", edits + box(b"mdia", mdhd + box(b"hdlr", bytes(8) + handler + bytes(12)) + box(b"minf", box(b"stbl", tables))))


SIZES = [100, 10, 20, 30, 200, 11, 12]


def movie(first=1000, **more):
    """Chunks of 2, 2, 1, 1, 1 samples; a sound track before it."""
    at = [first, first + 500, first + 900, first + 2000, first + 3000]
    video = track(b"vide", SIZES, at, [(1, 2), (3, 1)], [(4, 40), (3, 50)], [(1, 80), (2, 0), (4, -40)], [1, 5], edit=[(100, -1, 1), (700, 80, 1)], **more)
    return box(b"moov", track(b"soun", [5], [1000], [(1, 1)], [(1, 1)]) + video), at


def expected(at):
    pos = [at[0], at[0] + 100, at[1], at[1] + 20, at[2], at[3], at[4]]
    dts = [0, 40, 80, 120, 160, 210, 260]
    late = [80, 0, 0, -40, -40, -40, -40]
    return [(i, (d + c - 80) / 1000, (d - 80) / 1000, s, p, i in (0, 4)) for i, (d, c, s, p) in enumerate(zip(dts, late, SIZES, pos))]


def rows(df):
    return sorted(tuple(r)[1:] for r in df.collect())


@pytest.mark.parametrize("range_bytes", [1 << 30, 1500, 300])
def test_packets(spark, tmp_path, range_bytes):
    head, at = movie()
    data = box(b"ftyp", b"isom") + head
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.MP4").write_bytes(data + box(b"mdat", bytes(5000)))
    (tmp_path / "b.txt").write_bytes(data)
    (tmp_path / "cut.mp4").write_bytes(data[:400])
    (tmp_path / "empty.mov").write_bytes(b"")
    (tmp_path / "junk.m4v").write_bytes(b"\0\0\0\2junk" * 30)
    got = mp4.read_packets(spark, str(tmp_path), range_bytes)
    assert rows(got) == expected(at)
    assert {os.path.basename(r.video) for r in got.collect()} == {"a.MP4"}
    assert rows(mp4.read_packets(spark, f"file://{tmp_path}", range_bytes)) == expected(at)
    assert sorted(r.frame_id for r in mp4.read_keyframes(spark, str(tmp_path)).collect()) == [0, 4]


def test_no_files(spark, tmp_path):
    assert mp4.read_packets(spark, str(tmp_path)).count() == 0 and mp4.read_keyframes(spark, str(tmp_path)).count() == 0


def test_large_media_are_passed_over(spark, tmp_path):
    """Tables behind six (sparse) gigabytes of media, with 64-bit sizes and offsets: few bytes are read, by the tasks whose range holds packets."""
    media, path = 6 << 30, tmp_path / "long.mp4"
    head, at = movie(first=5 << 30, wide=True)
    with open(path, "wb") as f:
        f.write(box(b"ftyp", b"isom") + struct.pack(">I4sQ", 1, b"mdat", 16 + media))
        f.seek(media, os.SEEK_CUR)
        f.write(head)
    got = mp4.read_packets(spark, str(path))
    assert got.rdd.getNumPartitions() == 7 and rows(got) == expected(at)
    with open(path, "rb") as f:
        reader = mp4.Ranged(f, os.path.getsize(path))
        found = [c for c in mp4.packets(reader, 0, reader.size)]
        assert sum(len(c["frame_id"]) for c in found) == 7 and reader.read_bytes < 4000


def test_many_packets_in_stretches(monkeypatch):
    """Tables read a few entries at a time give what they give in one go; one size for all samples, no list of keys."""
    n = 997
    chunks = [10_000 + 70 * k for k in range(n)]
    tables = numbers(b"stts", 1, n, 40) + numbers(b"stsz", 7, n) + numbers(b"stsc", 1, 1, 1, 1) + numbers(b"stco", n, *chunks)
    mdhd = box(b"mdhd", bytes(12) + struct.pack(">II", 1000, 0) + bytes(4))
    data = box(b"moov", box(b"trak", box(b"mdia", mdhd + box(b"hdlr", bytes(8) + b"vide") + box(b"minf", box(b"stbl", tables)))))

    def read():
        out = []
        for lo in range(0, 90_000, 9_000):
            for c in mp4.packets(mp4.Ranged(io.BytesIO(data), len(data)), lo, lo + 9_000):
                assert c["is_key"] is None
                out += zip(c["frame_id"].tolist(), c["pts_time"].tolist(), c["size"].tolist(), c["pos"].tolist())
        return out

    whole = read()
    monkeypatch.setattr(mp4, "ENTRIES", 16)
    monkeypatch.setattr(mp4, "ROWS", 5)
    assert read() == whole == [(k, k * 40 / 1000, 7, chunks[k]) for k in range(n)]
