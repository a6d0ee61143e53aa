"""Canvas files: decoded by Spark's image reader, runs repeated and cut off."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from patchweave.functions import jpeg
from patchweave.sources import canvases, records


def _smooth(h, w, seed=0):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    image = np.stack([127 + 100 * np.sin(x / 40 + seed), 127 + 100 * np.cos(y / 30), 127 + 60 * np.sin((x + y) / 50)], -1) + rng.normal(0, 2, (h, w, 3))
    return np.clip(image, 0, 255).astype(np.uint8)


def _rows(spark, videos, seed=0):
    rows = [(v, n, 24, 40, bytearray(_smooth(24, 40, seed + n).tobytes())) for v, count in videos.items() for n in range(count)]
    return spark.createDataFrame(rows, "video string, n int, h int, w int, rgb binary")


def _read(spark, path):
    rows = spark.read.format("image").load(str(path)).select("image.*").collect()
    return {r.origin.rsplit("/", 1)[1]: np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, 3)[..., ::-1].astype(int) for r in rows}


def _files(path):
    return sorted(str(f.relative_to(path)) for f in path.rglob("canvas_*"))


def test_jpeg_decodes(spark, tmp_path):
    rng = np.random.default_rng(1)
    cases = {"smooth": (_smooth(93, 131), 95, False, 3), "full": (_smooth(93, 131), 95, True, 3), "low": (_smooth(64, 64), 10, False, 12), "exact": (rng.integers(0, 256, (40, 24, 3), dtype=np.uint8), 100, True, 1.5), "black": (np.zeros((9, 17, 3), np.uint8), 95, False, 0), "one": (np.full((1, 1, 3), 200, np.uint8), 95, False, 0), "worst": (np.tile(np.indices((8, 8)).sum(0)[..., None] % 2 * 255, (3, 3, 3)).astype(np.uint8), 100, True, 1.5)}
    for name, (pixels, quality, full, _) in cases.items():
        (tmp_path / f"{name}.jpg").write_bytes(jpeg.jpeg(pixels, quality, full))
    got = _read(spark, tmp_path)
    for name, (pixels, _, _, error) in cases.items():
        assert got[f"{name}.jpg"].shape == pixels.shape
        assert np.abs(got[f"{name}.jpg"] - pixels.astype(int)).mean() <= error, name
    with pytest.raises(ValueError):
        jpeg.jpeg(np.zeros((0, 5, 3), np.uint8))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**9), min_size=1, max_size=256).filter(any))
def test_codes_are_prefixes(counts):
    counts = np.array(counts)
    body, codes, sizes = jpeg.code_table(np.pad(counts, (0, 256 - len(counts))))
    used = np.flatnonzero(counts)
    words = sorted(format(codes[s], f"0{sizes[s]}b") for s in used)
    assert all(1 <= sizes[s] <= 16 for s in used) and sum(body[:16]) == len(used) and sorted(body[16:]) == list(used)
    assert not any(b.startswith(a) for a, b in zip(words, words[1:])) and all("0" in w for w in words)


def test_files_of_many_tasks(spark, tmp_path):
    out = tmp_path / "out"
    canvases.write_files(_rows(spark, {"a": 5, "/videos/b.mp4": 2}).repartition(4), str(out), "jpg")
    b = canvases.folder_of("/videos/b.mp4")
    assert _files(out) == sorted([f"a/canvas_{n:03d}.jpg" for n in range(5)] + [f"{b}/canvas_{n:03d}.jpg" for n in range(2)])
    got = _read(spark, out / "a")
    assert all(np.abs(got[f"canvas_{n:03d}.jpg"] - _smooth(24, 40, n).astype(int)).mean() < 4 for n in range(5))
    assert {tuple(r) for r in canvases.written(spark, str(out)).collect()} == {("a", "a", 5), ("/videos/b.mp4", b, 2)}
    # fewer canvases in a repeated run: nothing of the old one stays; other videos do
    canvases.write_files(_rows(spark, {"a": 2}, 9).repartition(2), str(out), "png")
    assert _files(out) == sorted([f"a/canvas_{n:03d}.png" for n in range(2)] + [f"{b}/canvas_{n:03d}.jpg" for n in range(2)])
    assert (_read(spark, out / "a")["canvas_001.png"] == _smooth(24, 40, 10)).all()
    # append makes what is not there
    canvases.write_files(_rows(spark, {"a": 4, "c": 1}), str(out), "png", overwrite=False)
    assert [f for f in _files(out) if f[0] in "ac"] == ["a/canvas_000.png", "a/canvas_001.png", "c/canvas_000.png"]
    assert {(r.video, r.canvases) for r in canvases.written(spark, str(out)).collect()} == {("a", 2), ("/videos/b.mp4", 2), ("c", 1)}
    jobs = spark.createDataFrame([("a",), ("d",)], "video string")
    assert [r.video for r in records.remaining(jobs, canvases.written(spark, str(out)), "video").collect()] == ["d"]
    assert not list((out / "_staging").iterdir())


def test_runs_that_end_badly(spark, tmp_path):
    out = tmp_path / "out"
    assert canvases.written(spark, str(out)).count() == 0
    canvases.write_files(_rows(spark, {"a": 2}), str(out), "png")
    before = {f: (out / f).read_bytes() for f in _files(out)}
    broken = _rows(spark, {"a": 3, "b": 2}, 5).unionByName(spark.createDataFrame([("b", 2, 24, 40, bytearray(b"short"))], "video string, n int, h int, w int, rgb binary"))
    with pytest.raises(Exception, match="reshape"):
        canvases.write_files(broken.repartition(3), str(out), "png")
    assert {f: (out / f).read_bytes() for f in _files(out)} == before and not list((out / "_staging").iterdir())
    # empty tables, rows without pixels, unknown kinds
    canvases.write_files(_rows(spark, {"a": 1}).selectExpr("video", "n", "h", "w", "cast(null as binary) rgb", "1 as extra"), str(out), "png")
    canvases.write_files(_rows(spark, {"a": 1}).limit(0), str(out), "png")
    assert {f: (out / f).read_bytes() for f in _files(out)} == before
    with pytest.raises(ValueError, match="npy"):
        canvases.write_files(_rows(spark, {"a": 1}), str(out), "npy")


@pytest.mark.parametrize("moved", [0, 1, 2])
def test_commit_is_finished_by_the_next_run(spark, tmp_path, moved, monkeypatch):
    """A driver that ends while folders are moved: some are old, some new, none is mixed; the next call ends the work."""
    import pyarrow as pa

    out = str(tmp_path / "out")
    canvases.write_files(_rows(spark, {"a": 3, "b": 3}), out, "png")
    writer = canvases.CanvasWriter(out, "png", 95, True)
    message = writer.write(iter([pa.RecordBatch.from_pandas(_rows(spark, {"a": 1, "b": 1}, 4).toPandas())]))
    late = pa.RecordBatch.from_pandas(_rows(spark, {"a": 2}, 7).toPandas())
    move, seen = canvases.Store, []

    class Cut(move):
        def there(self, path):
            if "/closed/" in path:
                seen.append(path)
                if len(seen) > moved:
                    raise OSError("driver lost")
            return super().there(path)

    with monkeypatch.context() as m:
        m.setattr(canvases, "Store", Cut)
        m.setattr(canvases, "MOVERS", 1)
        if moved < 2:
            with pytest.raises(OSError, match="driver lost"):
                writer.commit([message, None])
        else:
            writer.commit([message])
    counts = [len(list((tmp_path / "out" / v).iterdir())) for v in "ab"]
    assert sorted(counts) == sorted([1] * moved + [3] * (2 - moved))
    writer.write(iter([late]))  # a task that was given up and still runs
    assert canvases.recover(out) == ([writer.run] if moved < 2 else [])
    assert [len(list((tmp_path / "out" / v).iterdir())) for v in "ab"] == [1, 1]
    assert json.loads(canvases.written(spark, out).filter("video = 'a'").toJSON().first())["canvases"] == 1
