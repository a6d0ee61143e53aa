"""Anchors without pixels, frames decoded twice."""

import numpy as np

from patchweave.operators import joins, pixels


def test_anchor_without_pixels(spark):
    rng = np.random.default_rng(3)
    image = lambda: bytearray(rng.integers(0, 255, 8 * 8 * 3, dtype=np.uint8).tobytes())
    rows = [("a", 0, 0, 0, 8, 8, None), ("a", 0, 1, 0, 8, 8, image()), ("a", 0, 2, 0, 8, 8, image()), ("b", 0, 1, 0, 8, 8, image()), ("c", 0, 0, 0, 8, 8, image()), ("c", 0, 1, 0, 8, 8, image())]
    frames = spark.createDataFrame(rows, "video string, group_idx int, t long, anchor_t long, h int, w int, bgr binary")
    got = pixels.measured(frames, 2, 2).collect()
    seen = {(r.video, r.t) for r in got}
    assert seen == {("a", 1), ("a", 2), ("b", 1), ("c", 0), ("c", 1)} and len(got) == 4 * len(seen)
    assert all(r.novelty == 0 for r in got if r.video in "ab") and any(r.novelty > 0 for r in got if r.video == "c")
    assert all((r.adjacent is None) == ((r.video, r.t) not in {("a", 2), ("c", 1)}) for r in got)


def test_frame_decoded_twice(spark):
    want = spark.createDataFrame([("a", 0, 3), ("a", 1, 4)], "video string, t int, frame_id long")
    videos = spark.createDataFrame([("a", 10)], "video string, total_frames int")
    frames = spark.createDataFrame([("a", 3, "y"), ("a", 3, "x"), ("a", 3, None), ("a", 4, None)], "video string, frame_id int, v string")
    for parts in (1, 3):
        got = joins.decoded(want, frames.repartition(parts), videos, "v").orderBy("t").collect()
        assert [(r.v, r.was_missing) for r in got] == [("x", False), ("x", True)]
