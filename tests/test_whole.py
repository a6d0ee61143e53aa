"""The whole plan: stages in order, runs that are done once, videos with nothing to show."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchweave import catalog_plans
from patchweave.plans import whole
from patchweave.plans.selection import Config
from patchweave.sources import canvases

SF = "/root/testdata/sf0.001"


def _inputs(spark, videos={"a": 40, "b/c.mp4": 24, "short": 3}):
    rng = np.random.default_rng(8)
    cells = [(v, t, i, j, float(rng.random())) for v, n in videos.items() for t in range(n) for i in range(4) for j in range(4)]
    frames = [(v, t, 8, 8, bytearray((np.zeros(192, np.uint8) if v == "a" and t in (0, 5) else rng.integers(0, 255, 192, dtype=np.uint8)).tobytes())) for v, n in videos.items() for t in range(n) if t != 7]
    return whole.Inputs(
        spark.createDataFrame([(v, n, 10.0) for v, n in videos.items()] + [("nothing", 20, 10.0)], "video string, total_frames int, fps double"), spark.createDataFrame(cells, "video string, frame_id long, i int, j int, cost double"),
        keyframes=spark.createDataFrame([(v, k) for v in videos for k in (0, 12, 24)], "video string, frame_id long"), frames=spark.createDataFrame(frames, "video string, frame_id long, h int, w int, bgr binary"),
    )


SMALL = Config(sample_fps=10.0, avoid_keyframes=True, iframe_clip="non_i_percentile", frame_norm="frame_mean_floor", letterbox=True, group_size=16, images_per_group=2, rows=4, cols=4, pixels=2)


def test_stages(spark):
    out = whole.run(_inputs(spark), SMALL)
    meta = {r.video: r for r in out.meta.collect()}
    assert {v: (m.sampled_frames, m.num_groups) for v, m in meta.items()} == {"a": (40, 3), "b/c.mp4": (24, 2), "short": (3, 0), "nothing": (20, 0)}
    groups = {(r.video, r.group_idx): r for r in out.groups.collect()}
    # frame 0 of "a" is black and a keyframe: the sample moves to frame 1, which is lost again, and 0 comes back as the last resort
    first = groups["a", 0]
    assert (first.start, first.end, first.frame_count) == (0, 16, 16) and first.anchor_t != 0
    for (v, g), r in groups.items():
        assert r.global_img_offset == sum(groups[v, k].num_canvases for k in range(g)) and r.selected_blocks + 4 == r.patches // 4
    assert meta["a"].total_images == sum(r.num_canvases for (v, _), r in groups.items() if v == "a") and meta["short"].total_images == 0
    drawn = out.canvases.collect()
    assert {v: sorted(r.n for r in drawn if r.video == v) for v in ("a", "b/c.mp4")} == {v: list(range(meta[v].total_images)) for v in ("a", "b/c.mp4")}
    assert all((r.h, r.w, len(r.rgb)) == (8, 8, 192) for r in drawn)
    # a canvas shows the pixels of its placements
    frames = {(r.video, r.t): np.frombuffer(bytes(r.bgr), np.uint8).reshape(8, 8, 3) for r in out.frames.collect()}
    pictures = {(r.video, r.n): np.frombuffer(bytes(r.rgb), np.uint8).reshape(8, 8, 3) for r in drawn}
    for p in out.placed.collect():
        n = groups[p.video, p.group_idx].global_img_offset + p.canvas_idx
        got = pictures[p.video, n][2 * p.patch_h : 2 * p.patch_h + 2, 2 * p.patch_w : 2 * p.patch_w + 2]
        src = frames[p.video, p.src_frame][2 * p.src_patch_h : 2 * p.src_patch_h + 2, 2 * p.src_patch_w : 2 * p.src_patch_w + 2, ::-1]
        assert (got == src).all()


def test_other_configurations(spark):
    inputs = _inputs(spark, {"a": 24})
    diverse = whole.run(inputs, Config(selector="diverse_mixed", sample_fps=10.0, group_size=12, images_per_group=2, rows=4, cols=4))
    record = diverse.meta.filter("video = 'a'").first()
    said = json.loads(record.selector_summary)
    assert said["group_count"] == 2 and said["target_blocks"] == record.selected_blocks and json.loads(record.settings)["selector"] == "diverse_mixed"
    every = whole.run(inputs, Config(sampling="all_frames", avoid_keyframes=True, grouping="adaptive_gop", anchor="adaptive", min_frames=4, max_frames=8, rows=4, cols=4))
    assert [r.frame_id for r in every.sampled.filter("video = 'a'").orderBy("t").collect()] == list(range(24))
    made = every.groups.orderBy("group_idx").collect()
    # groups follow one another; a tail of fewer than four frames makes none
    assert made[0].start == 0 and all(a.end == b.start for a, b in zip(made, made[1:])) and 0 <= 24 - made[-1].end < 4
    assert all(r.start <= r.anchor_t < r.end and 4 <= r.frame_count <= 8 for r in made)
    bare = whole.Inputs(inputs.videos, inputs.grid)
    for wrong in (Config(avoid_keyframes=True), Config(letterbox=True), Config(iframe_clip="non_i_percentile"), Config(frame_norm="median"), Config(avoid_offset=0)):
        with pytest.raises(ValueError):
            whole.run(bare, wrong)
    assert Config().normalised().key() == Config(sampling="FPS").normalised().key() != Config(sampling="all_frames").normalised().key()


def test_empty_tables(spark):
    inputs = _inputs(spark)
    none = whole.Inputs(*(None if t is None else t.limit(0) for t in (inputs.videos, inputs.grid, None, inputs.keyframes, None, inputs.frames)))
    out = whole.run(none, SMALL)
    assert [t.count() for t in (out.sampled, out.placed, out.groups, out.meta, out.canvases)] == [0] * 5


def test_made_once(spark, tmp_path):
    inputs, path = _inputs(spark), str(tmp_path / "out")
    some = inputs.only(spark.createDataFrame([("a",), ("short",)], "video string"))
    assert {r.video for r in whole.run_missing(some, path, SMALL, "jpg").collect()} == {"a", "short"}
    stamp = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*") if p.is_file() and "video=a" in str(p)}
    assert stamp and whole.run_missing(inputs, path, SMALL, "jpg").count() == 4
    assert stamp == {p: p.stat().st_mtime_ns for p in stamp}
    records = sorted(str(p) for p in (tmp_path / "out" / "meta").rglob("*.parquet"))
    # "short" and "nothing" have no placements and are finished all the same
    assert whole.run_missing(inputs, path, SMALL, "jpg").count() == 4 and records == sorted(str(p) for p in (tmp_path / "out" / "meta").rglob("*.parquet"))
    made = tmp_path / "out" / "canvases" / SMALL.normalised().key()
    counts = {r.video: r.canvases for r in canvases.written(spark, str(made)).collect()}
    assert counts == {r.video: r.total_images for r in whole.read_meta(spark, path).collect() if r.total_images}
    assert all(len(list((made / canvases.folder_of(v)).iterdir())) == n for v, n in counts.items())
    placed = spark.read.parquet(f"{path}/src_patch_position")
    assert placed.groupBy(F.col("video").cast("string").alias("video")).count().count() == 2
    with pytest.raises(ValueError):
        whole.run_missing(whole.Inputs(inputs.videos, inputs.grid), path, SMALL, "png")


def test_query_samples_are_refilled(spark):
    """The catalogued plan meets the cases it is there for: moved keyframes, ids that met, samples that came back."""
    inputs = catalog_plans.inputs(spark, SF)
    keys = whole.keyframes_of(inputs)
    plain = whole.sampled_frames(inputs, Config(sample_fps=20.0))
    got = whole.sampled_frames(inputs, catalog_plans.PLAN)
    assert plain.count() == got.count() == got.select("video", "frame_id").distinct().count()
    assert plain.join(keys, ["video", "frame_id"]).count() > got.join(keys, ["video", "frame_id"]).count()
