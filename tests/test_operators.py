"""Operators on hand-made cases."""

import hashlib
import os
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchweave.functions import geometry, image, text
from patchweave.operators import anchors, energy, groups, joins, layout, pixels, rollup, sampling, scores, select
from patchweave.plans import cache, registry, selection
from patchweave.sources import mp4, records


def frame(height=56, width=56, shift=0):
    y, x = np.mgrid[:height, :width]
    return np.stack([(3 * x + y + shift) % 256, (x + 2 * y + 3 * shift) % 256, (2 * x + 3 * y + 5 * shift) % 256], -1).astype(np.uint8)


def test_rank_keeps_ties(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 1.0), (0, 3.0), (0, 5.0), (1, 9.0)], "g int, v double")
    got = sorted((r.g, r.v, round(r.r, 6)) for r in select.rank01(df, "v", ["g"], "r").collect())
    assert got == [(0, 1.0, 0.166667), (0, 1.0, 0.166667), (0, 3.0, 0.666667), (0, 5.0, 1.0), (1, 9.0, 1.0)]


def test_descriptors_tell_native_detail():
    y, x = np.mgrid[:28, :28]
    a = np.repeat((((x + y) % 2) * 255).astype(np.uint8)[..., None], 3, 2)
    b = 255 - a
    assert np.abs(image.block_descriptors(a, 1, 1) - image.block_descriptors(b, 1, 1)).mean() < 0.025
    assert image.full_difference(a, b, 1, 1).max() > 0.9


SCORES = [[[1, 2], [3, 4]], [[20, 19], [18, 17]], [[16, 15], [14, 13]], [[12, 11], [10, 9]]]


def candidates():
    rows = [(t, bh * 2 + bw, float(SCORES[t][bh][bw])) for t in range(1, 4) for bh in range(2) for bw in range(2)]
    t, b, s = map(np.array, zip(*rows))
    return t, b, s


def test_greedy_with_duplicates():
    t, b, s = candidates()
    origin, counters = select.diverse_pick(t, b, s, np.zeros(12), np.zeros(12), 0, 8, 0.25, True, 0.025)
    assert [int((origin == k).sum()) for k in (1, 2, 3)] == [4, 0, 4]
    assert set(t[origin > 0]) == {1, 2} and counters["rejected"] == 16 and len(counters["unique"]) == 8
    assert s[origin > 0].mean() == 16.5


@pytest.mark.parametrize("fraction,dedup", [(0.25, False), (0.0, True), (0.25, True)])
def test_counts_add_up(fraction, dedup):
    t, b, s = candidates()
    rng = np.random.default_rng(0)
    origin, _ = select.diverse_pick(t, b, s, rng.random(12), rng.random(12), 0, 8, fraction, dedup, 0.3)
    assert (origin > 0).sum() == 8


def test_budget():
    assert groups.budget(3, 16, 2) == 8 and groups.budget(1, 16, 2) == 0


def blocks(spark):
    rows = [(7, t, bh * 2 + bw, bh, bw, float(SCORES[t][bh][bw])) for t in range(4) for bh in range(2) for bw in range(2)]
    return select.grouped(spark.createDataFrame(rows, "video long, t long, block_idx long, bh long, bw long, score double"), 4)


def test_selection_and_placement(spark):
    g = blocks(spark)
    chosen = select.topk(g, 8)
    assert sorted(r.score for r in chosen.collect()) == [13.0, 14.0, 15.0, 16.0, 17.0, 18.0, 19.0, 20.0]
    placed = layout.placements(g, chosen, 2, 4, 4).orderBy("canvas_idx", "patch_h", "patch_w").collect()
    assert len(placed) == 48 and {r.canvas_idx for r in placed} == {0, 1, 2}
    assert all(r.src_frame == 0 for r in placed if r.canvas_idx == 0)
    assert len({(r.canvas_idx, r.patch_h, r.patch_w) for r in placed}) == 48
    full = layout.padded(layout.placements(g, chosen.filter("rank < 8"), 2, 4, 4), 4, 4)
    assert full.filter("src_frame = -1").count() == 4
    with pytest.raises(Exception, match="half padding"):
        layout.drop_padding(full).collect()


def test_zero_diversity_is_topk(spark):
    g = blocks(spark).withColumn("diversity", F.lit(0.0)).withColumn("adjacent", F.lit(None).cast("double"))
    a = {(r.t, r.block_idx) for r in select.diverse_mixed(g, 8, 0.0, False).collect()}
    assert a == {(r.t, r.block_idx) for r in select.topk(g, 8).collect()}
    b = select.diverse_mixed(g, 8, 0.0, True, 0.0)
    assert {(r.t, r.block_idx) for r in b.collect()} == a


def test_selection_statistics(spark):
    g = blocks(spark)
    frames = spark.createDataFrame([(7, 0, 3)], "video long, group_idx int, n_good int")
    r = rollup.selection_stats(select.topk(g, 8), frames).first()
    assert (r.selected_blocks, r.mean_score, r.unique_frames, r.unique_positions, r.entropy, r.normalized_entropy) == (8, 16.5, 2, 4, 0.693147, 0.63093)


def test_adaptive_gop_and_merge(spark):
    costs = spark.createDataFrame([(1, t, float(c)) for t, c in enumerate([1, 1, 9, 1, 9, 1])], "video long, t int, cost double")
    got = [(r.start, r.end, r.stop_reason) for r in groups.adaptive_gop(costs, 75, 1, 64).orderBy("group_idx").collect()]
    assert got == [(0, 2, "adaptive_gop_cost"), (2, 4, "adaptive_gop_cost"), (4, 6, "adaptive_gop_tail")]
    assert groups.merge_cheapest([(0, 1, 6.0), (1, 2, 5.0), (2, 3, 9.0), (3, 4, None)], 2) == [(0, 1, 6.0), (1, 4, 5.0)]


def test_readiness_drops_the_tail():
    flat = np.ones((10, 4))
    assert groups.readiness_cuts(flat, 1e9, 8, 4, 4, 2, 1, 0.02) == [(0, 4, "max_group_frames"), (4, 8, "max_group_frames")]
    assert groups.readiness_cuts(flat, 0.0, 4, 4, 8, 2, 1, 0.02)[0] == (0, 5, "readiness_threshold_low_gain")


def test_variable_gops():
    spans = groups.variable_gops([1] * 12, 1.0, 3, 2, 6)
    assert spans[0][0] == 0 and spans[-1][1] == 11 and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))
    assert groups.variable_gops([], 1.0, 3, 2, 6) == [(0, 0)]


def energy_cdf_ids(energy: np.ndarray, bin_sec: float, fps: float, total: int, k: int, mix: float = 0.3, max_per_bin: int | None = None) -> np.ndarray:
    """By loops: ``k`` ids dealt to time bins by energy: floors, largest remainders, round-robin by weight, even spacing in a bin."""
    e = np.maximum(np.asarray(energy, float), 0)
    if not len(e):
        return sampling.line(0, total - 1, k)
    mean = e.mean()
    w = np.maximum((1 - mix) * e + mix * (mean if mean > 0 else 1.0), 1e-12)
    share = w / w.sum() * k
    cap = max_per_bin or k
    count = np.minimum(np.floor(share).astype(int), cap)
    for b in np.lexsort((np.arange(len(w)), -np.round(share - np.floor(share), 9))):
        if count.sum() >= k:
            break
        if count[b] < cap:
            count[b] += 1
    order = np.lexsort((np.arange(len(w)), -w))
    for _ in range(10 * k):
        if count.sum() >= k or (count >= cap).all():
            break
        for b in order:
            if count.sum() < k and count[b] < cap:
                count[b] += 1
    ids: list[int] = []
    for b, c in enumerate(count):
        if c > 0:
            lo, hi = (max(0, min(total - 1, x)) for x in (int(np.floor(b * bin_sec * fps)), int(np.ceil((b + 1) * bin_sec * fps)) - 1))
            hi = max(lo, hi)
            ids += [round((lo + hi) / 2)] if c == 1 or lo == hi else sampling.line(lo, hi, c).tolist()
    ids.sort()
    if len(ids) < k:
        ids = sorted(ids + sampling.line(0, total - 1, k - len(ids)).tolist())
    if len(ids) > k:
        ids = [ids[i] for i in sampling.line(0, len(ids) - 1, k)]
    return np.array(ids, np.int64)


def test_energy_cdf_ids():
    ids = energy_cdf_ids(np.array([0, 0, 10, 0]), 1.0, 10.0, 40, 8, mix=0.0)
    assert len(ids) == 8 and ids.min() >= 20 and ids.max() <= 29
    assert len(energy_cdf_ids(np.zeros(3), 1.0, 10.0, 30, 5)) == 5


@pytest.mark.parametrize("k,mix,most", [(1, 0.3, None), (8, 0.0, None), (16, 0.3, None), (16, 0.3, 2), (12, 0.1, 1), (30, 0.5, 3), (40, 0.0, 2)])
def test_energy_cdf_against_loops(spark, k, mix, most):
    rng = np.random.default_rng(k)
    energies = {"many": rng.integers(0, 9, 60).astype(float), "peak": np.array([0, 0, 1000.0, 0, 1, 0]), "flat": np.ones(7), "none": np.zeros(5), "one": np.array([3.0]), "neg": np.array([-4.0, 2, 2, -1])}
    sizes = {"many": (600, 10.0), "peak": (41, 7.0), "flat": (3, 1.0), "none": (50, 10.0), "one": (1, 1.0), "neg": (400, 29.97)}
    bins = spark.createDataFrame([(v, i, float(x)) for v, e in energies.items() for i, x in enumerate(e)], "video string, bin int, energy double").repartition(3)
    videos = spark.createDataFrame([(v, n, f) for v, (n, f) in sizes.items()], "video string, total_frames int, fps double")
    got = {}
    for r in sampling.sample_energy_cdf(bins, videos, 1.0, k, mix, most).orderBy("video", "t").collect():
        got.setdefault(r.video, []).append(r.frame_id)
    for v, e in energies.items():
        assert got[v] == energy_cdf_ids(e, 1.0, sizes[v][1], sizes[v][0], k, mix, most).tolist(), v


def test_samplers(spark):
    v = spark.createDataFrame([(1, 10, 0.0), (2, 1, 25.0)], "video long, total_frames int, fps double")
    uni = {(r.video, r.t): r.frame_id for r in sampling.sample_uniform(v, 4).collect()}
    assert [uni[1, t] for t in range(4)] == [0, 3, 6, 9] and [uni[2, t] for t in range(4)] == [0] * 4
    assert [r.frame_id for r in sampling.sample_fps(v.filter("video = 1"), 0).orderBy("t").collect()] == [0, 8]
    s = spark.createDataFrame([(1, 0, 4), (1, 1, 4), (1, 2, 9)], "video long, t int, frame_id long")
    none = s.select("video", "frame_id").filter("false")
    assert [r.frame_id for r in sampling.refill(s, none, v).orderBy("t").collect()] == [4, 5, 9]
    keys = spark.createDataFrame([(1, 9), (1, 8), (1, 4)], "video long, frame_id long")
    moved = sampling.shift_off_keyframes(s, keys, v).orderBy("t").collect()
    assert [r.frame_id for r in moved] == [5, 5, 7]


def test_packets(spark):
    rows = [(1, 0.0, 10.0, "K__"), (1, None, 5.0, "___"), (1, 1.0, None, "___"), (1, -1.0, 5.0, "___"), (1, 1.2, 5.0, "___"), (1, 3.0, 7.0, "___")]
    p = spark.createDataFrame(rows, "video long, pts_time double, size double, flags string")
    r = energy.validity_counters(p).first()
    assert (r.total, r.dropped_key, r.dropped_time, r.dropped_size, r.kept) == (6, 1, 1, 1, 2)
    got = [round(x.energy, 6) for x in energy.energy_bins(p, 1.0, 0).orderBy("bin").collect()]
    assert got == [0.0, round(float(np.log1p(5)), 6), 0.0, round(float(np.log1p(7)), 6)]


def test_lookups(spark):
    want = spark.createDataFrame([(1, 0, 5), (1, 1, 7), (1, 2, 8)], "video long, t int, frame_id long")
    have = spark.createDataFrame([(1, 7, "x")], "video long, frame_id long, px string")
    assert [(r.px, r.was_missing) for r in joins.forward_fill(want, have, "px").orderBy("t").collect()] == [("x", True), ("x", False), ("x", True)]
    points = spark.createDataFrame([(1, 0, 5.0), (1, 1, 7.5)], "video long, id long, x double")
    keys = spark.createDataFrame([(1, 4), (1, 6), (1, 9)], "video long, frame_id long")
    assert [r.near for r in joins.nearest(points, keys).orderBy("id").collect()] == [4, 6]
    assert [r.near for r in joins.nearest(points, keys, ties="after").orderBy("id").collect()] == [6, 9]
    assert [r.key for r in joins.as_of(points, keys, key="frame_id").orderBy("id").collect()] == [4.0, 6.0]


def test_mcnemar_and_percentile(spark):
    df = spark.createDataFrame([(8, 5), (23, 21), (0, 0)], "g long, l long")
    assert [round(r.p, 4) for r in df.select(rollup.mcnemar_p(F.col("g"), F.col("l")).alias("p")).collect()] == [0.5811, 0.8804, 1.0]
    audit = spark.createDataFrame([(i, float(x)) for i, x in enumerate([1, 2, 4, 8])] + [(0, 0.5)], "video int, subprocess_ms double")
    assert rollup.preprocess_times(audit).first().p50 == 3.0
    with pytest.raises(Exception, match="different keys"):
        rollup.paired(spark.createDataFrame([("a", 1.0)], "key string, score double"), spark.createDataFrame([("b", 1.0)], "key string, score double")).collect()


def test_resize_equals_pixels(spark):
    rng = np.random.default_rng(2)
    cost = rng.random((3, 5))
    g = spark.createDataFrame([(1, 0, i, j, float(cost[i, j])) for i in range(3) for j in range(5)], "video long, t int, i int, j int, cost double")
    big = cost[np.arange(8) * 3 // 8][:, np.arange(12) * 5 // 12]
    want = big.reshape(2, 4, 3, 4).sum((1, 3)).ravel()
    got = [r.score for r in scores.resized_block_scores(g, 3, 5, 8, 12, 4).orderBy("block_idx").collect()]
    assert np.allclose(got, want)


def test_bad_frames(spark):
    green = np.zeros((8, 8, 3), np.uint8)
    green[..., 1] = 200
    frames = [frame(8, 8), np.zeros((8, 8, 3), np.uint8), np.full((8, 8, 3), 90, np.uint8), green, None]
    df = spark.createDataFrame([(i, 8, 8, None if f is None else f.tobytes()) for i, f in enumerate(frames)], "k int, h int, w int, bgr binary")
    assert [r.bad for r in image.with_stats(df).select("k", image.is_bad().alias("bad")).orderBy("k").collect()] == [False, True, True, True, True]
    boxed = np.zeros((20, 20, 3), np.uint8)
    boxed[4:16] = 200
    assert image.letterbox(boxed) == (4, 16, 0, 20)


def test_geometry(spark):
    df = spark.createDataFrame([(392, 728), (1080, 1920), (10, 10), (0, 5)], "h int, w int")
    got = [tuple(r.s) for r in df.select(geometry.smart_resize(F.col("h"), F.col("w"), 28, 150000).alias("s")).collect()]
    assert got == [(280, 504), (280, 504), (56, 56), (0, 0)]
    fps = spark.createDataFrame([("30000/1001",), ("25",), ("0/0",), ("x",)], "r string").select(geometry.parse_fps(F.col("r")).alias("f")).collect()
    assert [round(r.f, 3) for r in fps] == [29.97, 25.0, 0.0, 0.0]


def test_text(spark):
    r = spark.range(1).select(text.clock(F.lit(3725.9)).alias("a"), text.clock(F.lit(65)).alias("b"), text.image_tags(F.lit(" <image>\n<IMAGE> hi"), F.lit(2)).alias("c"), text.stem(F.lit("/a/b/c.d.mp4")).alias("d"), text.seconds_tag(F.lit(1.25)).alias("e")).first()
    assert (r.a, r.b, r.c, r.d) == ("01:02:05", "01:05", "<image>\n<image>\nhi", "c.d")


def test_records(spark, tmp_path):
    path = tmp_path / "jobs.jsonl"
    path.write_text('{"video": "/x/a.mp4", "id": "1", "response": {"status_code": 200, "body": {"choices": [{"message": {"content": "cap"}}]}}}\n\nnot json\n{"custom": {"path": "/x/b.mp4"}, "id": "2", "exists": false}\n{"images_source": ["/y/c.mp4", "/y/d.mp4"], "id": "3"}\n{"video": "/x/e.mp4", "response": {"status_code": 500}}\n')
    got = records.jobs(records.read_lines(spark, str(path))).orderBy("id", "n").collect()
    made = lambda path, id_: f"{os.path.basename(path)[:-4]}__{hashlib.sha1(path.encode()).hexdigest()[:8]}__{id_}"
    assert [(r.id, r.video, r.caption, r.key) for r in got] == [("1", "/x/a.mp4", "cap", made("/x/a.mp4", "1")), ("3__v0", "/y/c.mp4", "", made("/y/c.mp4", "3")), ("3__v1", "/y/d.mp4", "", made("/y/d.mp4", "3"))]
    lines = records.read_lines(spark, str(path))
    assert [r.video for r in records.jobs(lines, max_jobs=2).collect()] == ["/x/a.mp4", "/y/c.mp4"]
    assert [r.video for r in records.jobs(lines, ok_only=False, max_lines=2).collect()] == ["/x/a.mp4"]
    there = spark.createDataFrame([("/y/d.mp4",)], "video string")
    assert [(r.id, r.key) for r in records.jobs(lines, existing=there, mirror_root="/y").collect()] == [("3", "d")]


def test_keys(spark):
    rows = [("/a/b/c.d.mp4", None, None), ("/a/b/c.mp4", "own", "x"), ("/a/b/.hid", "", "0123456789"), ("a//./b/../c.tar.gz", None, ""), ("/a/b", None, None), ("/ab/c.mp4", None, None)]
    df = spark.createDataFrame(rows, "p string, k string, i string")
    got = df.select(text.key_of(F.col("p"), F.col("k"), F.col("i")).alias("key"), text.mirror_key(F.col("p"), F.lit("/a/b/")).alias("m"), text.mirror_key(F.col("p"), F.lit("a"), False).alias("n")).collect()
    sha = [hashlib.sha1(p.encode()).hexdigest()[:8] for p, _, _ in rows]
    assert [r.key for r in got] == [f"c.d__{sha[0]}", "own", f".hid__{sha[2]}__01234567", f"c.tar__{sha[3]}", f"b__{sha[4]}", f"c__{sha[5]}"]
    assert [r.m for r in got] == ["c.d", "c", ".hid", None, None, None] and [r.n for r in got] == [None, None, None, "c.tar.gz", None, None]


def test_sinks(spark, tmp_path):
    meta = spark.createDataFrame([("c1", "a", 1), ("c1", "b", 2), ("c2", "a", 3)], "config string, video string, n int")
    for _ in range(2):
        records.write_meta(meta.filter("config = 'c1'"), str(tmp_path / "meta"))
    records.write_meta(meta.filter("config = 'c2'"), str(tmp_path / "meta"))
    assert spark.read.json(str(tmp_path / "meta")).count() == 3
    pixels_ = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    canvas = spark.createDataFrame([(7, 0, 2, 3, pixels_.tobytes())], "video long, n int, h int, w int, rgb binary")
    records.write_canvases(canvas, str(tmp_path / "canvas"))
    files = spark.read.parquet(str(tmp_path / "canvas"))
    assert (image.read_png(bytes(files.first().png)) == pixels_).all()
    assert records.export_canvases(files.select(F.col("video").cast("string").alias("video"), "name", "png"), str(tmp_path / "loose")) == 1 and (tmp_path / "loose/7/canvas_000.png").exists()
    with pytest.raises(ValueError):
        records.write_canvases(canvas, str(tmp_path / "x"), "npy")


def test_readers(spark, tmp_path):
    probe = tmp_path / "probe.jsonl"
    probe.write_text('{"streams": [{"codec_name": "h264", "width": 640, "height": 360, "avg_frame_rate": "30000/1001"}], "format": {"filename": "/v/a.mp4", "duration": "10.0", "bit_rate": "-5"}}\n')
    r = records.probe_rows(records.read_lines(spark, str(probe))).first()
    assert (r.video, r.total_frames, r.codec_name, r.width, r.format_bit_rate) == ("/v/a.mp4", 300, "h264", 640, 0.0)
    audit = tmp_path / "audit"
    audit.mkdir()
    (audit / "a.jsonl").write_text('{"video": "a", "subprocess_ms": 5}\n{"video": "a", "subprocess_ms": 7}\n{"subprocess_ms": "x"}\n')
    found = records.read_preprocess(spark, str(audit))
    assert rollup.preprocess_times(found).first().total == 7.0 and rollup.audit_repeats(found).first().duplicate_audit_rows == 1
    for name, body in (("a", '{"selector_summary": {"group_count": 2, "target_blocks": 8}}'), ("b", "{}"), ("c", "no json")):
        (tmp_path / "run" / name).mkdir(parents=True)
        (tmp_path / "run" / name / "meta.json").write_text(body)
    assert [(r.group_count, r.target_blocks) for r in records.read_selector(spark, str(tmp_path / "run")).collect()] == [(2, 8)]
    samples = tmp_path / "x_samples.jsonl"
    samples.write_text('{"doc_id": 1, "videomme_perception_score": {"question_id": "q", "score": 1}}\n{"doc_id": 2, "avg_accuracy": {"video_id": "v", "question": "why", "match_success": true, "dim": "d"}}\n')
    assert [(r.key, r.score, r.duration, r.question_type) for r in records.read_eval_samples(spark, str(samples), "r").collect()] == [("q", 1.0, "unknown", "unknown"), ("v::why", 1.0, "short", "d")]


def test_training_records(spark, tmp_path):
    message = "array<struct<role:string,content:string>>"
    jobs = spark.createDataFrame([("s1", "k1", [("system", "be"), ("user", " <image>\n<IMAGE>look"), ("user", "more")], ""), ("", "k2", [], "a cat"), (None, "k3", None, None), ("s4", "gone", [], "")], f"id string, key string, messages {message}, caption string")
    frames = [(3, 3661.2), (3, 3661.2), (-1, -1.0), (0, 0.0)]
    assets = spark.createDataFrame([("k1", "/v.mp4", ["a.png", "b.png"], "p", 25.0, frames), ("k2", "", ["c.png"], "p", None, []), ("k3", None, [], "p", 1.0, [])], "key string, video string, images array<string>, positions string, fps double, frames array<struct<frame_id:int,seconds:double>>")
    got = {r.id: r for r in records.training_records(jobs, assets).collect()}
    said = {i: [tuple(m) for m in r.messages] for i, r in got.items()}
    assert said == {"s1": [("system", "be"), ("user", "<image>\n<image>\nlook"), ("user", "more")], "k2": [("user", "<image>\n"), ("assistant", "a cat")], "k3": [("user", "")]}
    assert got["s1"].timestamps == {"3": "01:01:01", "0": "00:00"} and got["s1"].images_source == ["/v.mp4"] and got["k2"].images_source == [] and got["k2"].fps == [0.0]
    for _ in range(2):
        records.write_training(records.training_records(jobs, assets).drop("timestamps"), str(tmp_path / "train"), "r1")
    assert spark.read.json(str(tmp_path / "train")).count() == 3
    kinds = spark.createDataFrame([("a", "H264"), ("b", "av1"), ("c", None)], "key string, codec_name string")
    assert sorted(r.key for r in records.unsupported(kinds).collect()) == ["b", "c"]
    assert [r.key for r in records.remaining(kinds, kinds.filter("key = 'x'"), codecs=records.CODECS).collect()] == ["a"]


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def test_mp4_keyframes(spark, tmp_path):
    def movie(handler, numbers):
        table = box(b"stss", struct.pack(f">II{len(numbers)}I", 0, len(numbers), *numbers))
        return box(b"trak", box(b"mdia", box(b"hdlr", bytes(8) + handler) + box(b"minf", box(b"stbl", table))))

    data = box(b"ftyp", b"isom") + box(b"moov", movie(b"soun", [1]) + movie(b"vide", [31, 61, 61]))
    assert mp4.keyframes(data) == [0, 30, 60] and mp4.keyframes(box(b"moov", b"")) is None and mp4.keyframes(b"\0\0\0\2junk") is None
    (tmp_path / "a.MP4").write_bytes(data)
    (tmp_path / "b.txt").write_bytes(data)
    assert [r.frame_id for r in mp4.read_keyframes(spark, str(tmp_path)).orderBy("frame_id").collect()] == [0, 30, 60]


def test_config(monkeypatch):
    c = selection.Config(selector="TopK").normalised()
    assert c.selector == "topk" and c.dedup_threshold == 0.025 and selection.Config(dedup_descriptor="full").normalised().dedup_threshold == 0.035
    for bad in ({"diversity_fraction": -0.1}, {"novelty_weight": 1.1}, {"selector": "diverse_mixed", "event_bins": 4}, {"selector": "x"}, {"dedup_descriptor": "y"}):
        with pytest.raises(ValueError):
            selection.Config(**bad).normalised()
    monkeypatch.setenv("PATCHWEAVE_SELECTOR", "diverse_mixed")
    monkeypatch.setenv("PATCHWEAVE_DEDUP", "off")
    assert selection.Config.from_env(selector="topk").selector == "diverse_mixed" and not selection.Config.from_env().dedup


def test_registry():
    r = registry.Registry("thing")
    r.register("A", len)
    assert r.get("a") is len and r.names() == ["a"]
    with pytest.raises(KeyError, match="known: a"):
        r.get("b")
    with pytest.raises(ValueError):
        r.register(" ", len)


def pixel_frames(spark, shifts=(0, 0, 0, 0)):
    rows = [(7, t, 56, 56, frame(shift=k).tobytes()) for t, k in enumerate(shifts)]
    return spark.createDataFrame(rows, "video long, t long, h int, w int, bgr binary")


def test_diverse_on_pixels(spark):
    """Four equal frames: every block is a duplicate of the anchor's, so that all picks of the diverse phase are refused."""
    g, frames = blocks(spark), pixel_frames(spark)
    for descriptor in ("pooled4", "full"):
        cand = pixels.diversity(g, frames, 2, 2, 0.5, descriptor)
        assert {(r.novelty, r.adjacent) for r in cand.select("novelty", "adjacent").collect()} == {(0.0, 0.0)}
        got = select.diverse_counted(cand, 8, 0.25, True, 0.025).collect()
        assert Counter(r.origin for r in got) == {"bitcost": 4, "backfill": 4} and {(r.rejected, r.rejected_unique, r.comparisons) for r in got} == {(16, 8, 16)}
    moving = pixels.measured(g.select("video", "group_idx", "t", "anchor_t").distinct().join(pixel_frames(spark, (0, 9, 9, 30)), ["video", "t"]), 2, 2, "full")
    got = {(r.t, r.block_idx): (r.adjacent, r.novelty) for r in moving.collect()}
    f = [frame(shift=k) for k in (0, 9, 9, 30)]
    for t in range(1, 4):
        want = image.full_difference(f[t - 1], f[t], 2, 2).ravel()
        far = np.abs(image.block_descriptors(f[t], 2, 2) - image.block_descriptors(f[0], 2, 2)).mean((-2, -1)).ravel()
        assert all(abs(got[t, b][0] - want[b]) < 1e-9 and abs(got[t, b][1] - far[b]) < 1e-9 for b in range(4))
    assert all(got[0, b][0] is None for b in range(4))


def test_measures_around_a_middle_anchor(spark):
    rows = [(7, 0, t, 2, 56, 56, frame(shift=7 * t).tobytes()) for t in range(4)]
    frames = spark.createDataFrame(rows, "video long, group_idx int, t long, anchor_t long, h int, w int, bgr binary")
    got = {(r.t, r.block_idx): r for r in pixels.measured(frames, 1, 1).collect()}
    d = [image.block_descriptors(frame(shift=7 * t), 1, 1) for t in range(4)]
    for t in range(4):
        assert abs(got[t, 0].novelty - np.abs(d[t] - d[2]).mean()) < 1e-12
        assert got[t, 0].adjacent is None if t == 0 else abs(got[t, 0].adjacent - np.abs(d[t] - d[t - 1]).mean()) < 1e-12


def test_canvases(spark):
    g, frames = blocks(spark), pixel_frames(spark, (0, 1, 2, 3))
    placed = layout.placements(g, select.topk(g, 8), 2, 4, 4)
    found = pixels.numbered_canvases(pixels.canvases(frames, placed, 4, 4, 14)).orderBy("n").collect()
    assert [r.n for r in found] == [0, 1, 2]
    first = np.frombuffer(bytes(found[0].rgb), np.uint8).reshape(56, 56, 3)
    assert (first == frame()[..., ::-1]).all()
    second = np.frombuffer(bytes(found[1].rgb), np.uint8).reshape(56, 56, 3)
    assert (second == frame(shift=1)[..., ::-1]).all()
    masked = {r.t: np.frombuffer(bytes(r.bgr), np.uint8).reshape(56, -1, 3) for r in pixels.masked_frames(frames, placed, 14, True).collect()}
    assert (masked[1][:, :56] == frame(shift=1)).all() and (masked[1][:, 56:] == frame(shift=1)).all() and not masked[3][:, 56:].any()
    n = layout.raster(placed, 4, 4).orderBy("n").collect()
    assert [r.n for r in n] == list(range(48)) and n[17].patch_w == 1 and n[17].patch_h == 0
    full = layout.padded(placed.filter("canvas_idx < 1"), 4, 4, 3)
    assert full.count() == 48 and full.filter("src_frame = -1").count() == 32
    rows = layout.placements(g, select.topk(g, 8), 2, 4, 4, "wh_raster").filter("canvas_idx = 0").orderBy("patch_h", "patch_w").collect()
    assert [(r.src_patch_h, r.src_patch_w) for r in rows[:4]] == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_letterbox_masks(spark):
    boxed = np.zeros((20, 20, 3), np.uint8)
    boxed[4:16] = 200
    df = spark.createDataFrame([(1, 0, 20, 20, boxed.tobytes()), (1, 1, 20, 20, None)], "video long, t long, h int, w int, bgr binary")
    boxes = pixels.letterboxes(df)
    assert tuple(boxes.filter("t = 0").select("top", "bottom", "left", "right").first()) == (4, 16, 0, 20)
    grid = spark.createDataFrame([(1, 0, i, j, 1.0) for i in range(5) for j in range(5)], "video long, t long, i int, j int, cost double")
    assert sorted((r.i, r.cost) for r in pixels.content_mask(grid, boxes).filter("j = 0").collect()) == [(0, 0.0), (1, 1.0), (2, 1.0), (3, 1.0), (4, 0.0)]


def test_anchor_rules(spark):
    assert anchors.evenly([0, 5, 9, 14, 20], 3) == [0, 9, 20] and anchors.evenly([4], 3) == [4] and anchors.evenly([], 2) == [0]
    assert anchors.even_spaced(3, 30, 4, 25) == [0, 10, 20]
    assert anchors.dense([0, 2, 10], np.array([True] * 3 + [False] * 5 + [True] * 8), 2, 3) == [0, 10]
    assert anchors.without_tail([0, 40], 60, 10.0, 8.0) == [0] and anchors.without_tail([0, 10], 60, 10.0, 8.0) == [0, 10]
    df = spark.createDataFrame([(1, t) for t in (0, 2, 4, 5, 9)], "video long, t long")
    assert [r.t for r in anchors.spaced(df, 4).orderBy("t").collect()] == [0, 4, 9]
    rows = [(1, t, t != 3, t in (0, 2, 6, 30, 38), 1.0) for t in range(40)]
    frames = spark.createDataFrame(rows, "video long, t long, good boolean, anchor boolean, fps double")
    assert [(r.bucket, r.t) for r in anchors.thinned(frames, 4, 3, 3).orderBy("t").collect()] == [(0, 0), (1, 6), (2, 30)]
    chosen = spark.createDataFrame([(1, 0, 3, 0), (1, 0, 5, 1), (1, 0, 4, 2)], "video long, bucket int, t long, place int")
    buckets = spark.createDataFrame([(1, 0, 3), (1, 1, 6)], "video long, bucket int, anchor_t long")
    assert sorted((r.bucket, r.used_t) for r in anchors.usable_anchor(buckets, chosen, frames).collect()) == [(0, 5), (1, 6)]


def test_stratified_spreads(spark):
    rows = [(1, 0, t, b, 10.0 if t < 2 else 1.0) for t in range(8) for b in range(4)]
    got = select.stratified(spark.createDataFrame(rows, "video long, bucket int, t long, block_idx long, score double"), 2, 6).orderBy("place").collect()
    assert len(got) == 12 and len({(r.t, r.block_idx) for r in got}) == 12 and {r.t for r in got if r.image == 0} == {0, 1}
    assert [r.place for r in select.reordered(spark.createDataFrame([(1, 0, 5, 0, 0, 1.0), (1, 0, 2, 1, 0, 9.0)], "video long, bucket int, t long, bh int, bw int, score double"), "time").orderBy("t").collect()] == [0, 1]


def test_more_samplers(spark):
    assert sampling.allocate_ids([(0, 9, 90), (20, 29, 1), (40, 49, 1)], 6) == [0, 3, 6, 9, 20, 40] and sampling.allocate_ids([(0, 10, 0)], 3) == [0, 5, 10]
    assert sampling.allocate_ids([(0, 1, 5), (0, 1, 5)], 6) == [0, 1, 1, 1, 1, 1]
    s = spark.createDataFrame([(1, i) for i in range(10)], "video long, frame_id long")
    peaks = spark.createDataFrame([(1, 4), (1, 5)], "video long, frame_id long")
    assert [r.frame_id for r in sampling.cap_candidates(s, peaks, 5).orderBy("t").collect()] == [0, 3, 4, 5, 9]
    assert [r.frame_id for r in sampling.cap_candidates(s, peaks, 1).collect()] == [4] and sampling.cap_candidates(s, peaks, 20).count() == 10
    v = spark.createDataFrame([(1, 100, 10.0), (2, 0, 0.0)], "video long, total_frames int, fps double")
    p = spark.createDataFrame([(1, 0.0, 1.0, "K__"), (1, 3.26, 1.0, "K__"), (1, 99.0, 1.0, "K"), (1, None, 1.0, "K"), (2, 1.0, 1.0, "_")], "video long, pts_time double, size double, flags string")
    assert sorted((r.video, r.frame_id) for r in sampling.keyframe_ids(p, v).collect()) == [(1, 0), (1, 33), (1, 99)]
    got = selection.sample(v.filter("video = 1"), p.filter("video = 2"), "PKT_SIZE_PEAK", rate=0.5).orderBy("t").collect()
    assert [r.frame_id for r in got] == [0, 20, 40, 60, 80] and selection.sample(v.filter("video = 1"), None, "pkt_peak", rate=0.5).count() == 5
    with pytest.raises(ValueError):
        selection.sample(v, None, "uniform_count")
    assert v.select(sampling.sampled_count(F.col("total_frames"), 16, 4, 32).alias("n")).collect()[0].n == 100
    size = spark.createDataFrame([(1, 900, 30.0, 720, 1280), (2, 90, 30.0, 360, 640)], "video long, total_frames int, fps double, height int, width int")
    assert [tuple(r)[1:] for r in sampling.adaptive_parameters(size).orderBy("video").collect()] == [(4, 28, 224, 304, 6, 2), (1, 8, 64, 90, 5, 2)]
    w = sampling.pick_windows(v, spark.createDataFrame([(1, 5.0, 10.0, "_"), (1, 5.05, 3.7, "_")], p.schema), 20, 5, 2)
    assert sorted((r.video, r["rank"], r.start, r.end, r.score) for r in w.collect()) == [(1, 1, 40, 59, 13), (1, 2, 0, 19, 0), (2, 1, 0, 0, 0)]


def test_huge_times(spark):
    p = spark.createDataFrame([(1, 1.0, 2.0, "_"), (1, 1e300, 2.0, "_")], "video long, pts_time double, size double, flags string")
    assert energy.energy_bins(p, 1.0, 0).count() == 2


def test_decoded_and_selected(spark):
    v = spark.createDataFrame([(1, 10)], "video long, total_frames int")
    want = spark.createDataFrame([(1, 0, 5), (1, 1, 7), (1, 2, 99), (1, 3, -4)], "video long, t int, frame_id long")
    have = spark.createDataFrame([(1, 7, "x"), (1, 3, "y"), (1, 0, "z")], "video long, frame_id long, px string")
    assert [(r.frame_id, r.px, r.was_missing) for r in joins.decoded(want, have, v, "px").orderBy("t").collect()] == [(5, "y", True), (7, "x", False), (9, "x", True), (0, "z", False)]
    assert [r.px for r in joins.decoded(want, have, v, "px", within=1).orderBy("t").collect()] == [None, "x", "x", "z"]
    twice = spark.createDataFrame([(1, 7), (1, 7), (1, -1), (1, 4)], "video long, frame_id long")
    assert [(r.frame_id, r.copy) for r in joins.selected(have, twice).orderBy("copy").collect()] == [(7, 1), (7, 2)] and joins.selected(have, twice, 0, 6).count() == 0


def test_grid_choice(spark):
    rows = [(1, 0, "h264", ([[1, 2]], None, None)), (2, 0, "HEVC", ([[1, 2]], [[9]], None)), (3, 0, "vp9", (None, None, [[0.5]]))]
    df = spark.createDataFrame(rows, "video long, t int, codec_name string, bitcost struct<mb_bit_cost:array<array<int>>,ctu_bit_cost:array<array<int>>,sub_mb_bit_cost:array<array<float>>>")
    assert sorted((r.video, r.i, r.j, r.cost) for r in scores.grid_cells(df).collect()) == [(1, 0, 0, 1.0), (1, 0, 1, 2.0), (2, 0, 0, 9.0), (3, 0, 0, 0.5)]


def test_motion_fusion(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 256, 40).astype(float)
    v = rng.normal(size=(40, 4)) * 8
    df = spark.createDataFrame([(1, 0, i // 8, i % 8, float(x[i]), *map(float, v[i])) for i in range(40)], "video long, t int, i int, j int, residual double, vx0 double, vy0 double, vx1 double, vy1 double")
    u = v / 4 - np.median(v / 4, axis=0)
    m = np.hypot(u[:, 0], u[:, 1]) + np.hypot(u[:, 2], u[:, 3])
    r = np.abs(x - 128)
    want = 0.5 * np.minimum(1, m / np.percentile(m, 95)) + 0.5 * np.minimum(1, r / max(1, np.percentile(r, 95)))
    got = [c.cost for c in scores.fuse_motion(df, 0.5, "sum", True).orderBy("i", "j").collect()]
    assert np.allclose(got, want)


def test_vision_text(spark):
    runs = spark.createDataFrame([(1, 0, 1, 0, "<0.0 seconds>", 2), (1, 0, 2, 3, "<0.1 seconds>", 1)], "video long, group_idx int, run long, src_frame int, label string, tokens long")
    said = spark.createDataFrame([(1, "hi <|vision_start|>a<|vision_end|>\nx<|vision_start|>b<|vision_end|>\nbye"), (1, "plain")], "id long, text string")
    got = {r.text for r in layout.vision_text(said, runs).collect()}
    assert got == {"hi <0.0 seconds><|vision_start|><|image_pad|><|image_pad|><|vision_end|>\n<0.1 seconds><|vision_start|><|image_pad|><|vision_end|>\nbye", "plain"}


def test_plans(spark, tmp_path):
    rng = np.random.default_rng(6)
    grid = spark.createDataFrame([(v, t, i, j, float(rng.random())) for v in (1, 2) for t in range(24) for i in range(8) for j in range(8)], "video long, t long, i int, j int, cost double").cache()
    for grouping in ("fixed", "readiness", "adaptive_gop"):
        c = selection.Config(grouping=grouping, anchor="adaptive", group_size=12, min_frames=6, max_frames=12)
        good = spark.createDataFrame([(1, 0, False), (1, 1, False)], "video long, t long, good boolean")
        chosen, placed = selection.select_patches(grid, c, good=good)
        assert chosen.filter("video = 1 and t < 2").count() == 0 and placed.count() > 0 and chosen.groupBy("video", "group_idx").count().filter("count > 48").count() == 0
    c = selection.Config(selector="diverse_mixed", group_size=12)
    groups_ = selection.diagnostics(grid, c)
    r = rollup.full_summary(groups_).orderBy("video").collect()
    assert [x.group_count for x in r] == [2, 2] and all(x.bitcost_selected + x.diversity_selected + x.backfill_selected == x.target_blocks == 96 for x in r)
    assert rollup.full_run_summary(rollup.full_summary(groups_)).first().target_blocks == 192
    with pytest.raises(ValueError):
        selection.select_patches(grid, selection.Config(selector="diverse_mixed", dedup_descriptor="full"))
    out = str(tmp_path / "out")
    first = cache.run_missing(grid.filter("video = 1"), out, selection.Config(group_size=12)).count()
    stamp = sorted(p.name for p in (tmp_path / "out").rglob("*.parquet"))
    assert cache.run_missing(grid, out, selection.Config(group_size=12)).count() == 2 * first
    assert set(stamp) < {p.name for p in (tmp_path / "out").rglob("*.parquet")}


def test_limits_and_thresholds(spark):
    assert groups.frame_limits(0, 2, 64) == (4, 64) and groups.frame_limits(2.0, 8, 64, 2.5, 1.0) == (5, 5) and groups.frame_limits(1.0, 16, 8) == (16, 16)
    grid = spark.createDataFrame([(1, t, i, j, 1.0 + (t * i * j) % 5) for t in range(24) for i in range(8) for j in range(8)], "video long, t long, i int, j int, cost double")
    videos = spark.createDataFrame([(1, 1e6, 25.0, 640, 360)], "video long, bit_rate double, fps double, width int, height int")
    c = selection.Config(grouping="readiness", readiness_mode="clamped_sqrt_bpppf", readiness_norm=1e9, max_frames=10)
    assert {r.frame_count for r in selection.grouped_blocks(grid, c, videos=videos).select("group_idx", "frame_count").distinct().collect()} == {10}
    with pytest.raises(ValueError):
        selection.select_patches(grid, c)
    costs = spark.createDataFrame([(1, t, 1.0) for t in range(10)], "video long, t int, cost double")
    cut = groups.adaptive_gop(costs, 50, 2, 3)
    assert [r.stop_reason for r in cut.orderBy("start").collect()] == ["adaptive_gop_max_group_frames"] * 3 + ["adaptive_gop_tail"]
    assert [(r.start, r.end, r.stop_reason) for r in groups.merge_gops(cut, 3).orderBy("start").collect()] == [(0, 6, "adaptive_gop_target_canvas_merge"), (6, 9, "adaptive_gop_max_group_frames"), (9, 10, "adaptive_gop_tail")]


def test_doctor(capsys):
    from patchweave.__main__ import main

    assert main(["doctor"]) == 0 and "pyspark: OK" in capsys.readouterr().out


def test_packet_stream(spark, tmp_path):
    """Windows of a stream that comes in two files equal those of one table."""
    from patchweave.streaming.energy import energy_windows

    rows = [(v, f"2024-01-01 00:00:{s:02}", float(s), "K__" if s == 3 else "___") for v in (1, 2) for s in range(40)]
    whole = spark.createDataFrame(rows, "video long, at string, size double, flags string").select("video", F.col("at").cast("timestamp").alias("ts"), "size", "flags")
    for k in range(2):
        whole.filter(f"second(ts) % 2 = {k}").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = energy_windows(stream, "10 seconds", "1 minute").writeStream.format("memory").queryName("packet_windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.video, r.start): (round(r.energy, 9), r.packets) for r in spark.table("packet_windows").collect()}
    want = {(r.video, r.start): (round(r.energy, 9), r.packets) for r in energy_windows(whole, "10 seconds", "1 minute").collect()}
    assert got == want and len(want) == 8 and sorted(n for _, n in want.values()) == [9, 9, 10, 10, 10, 10, 10, 10]


def test_command_line(spark, tmp_path, capsys):
    from patchweave.__main__ import main

    rng = np.random.default_rng(3)
    grid = [(1, t, i, j, float(rng.random())) for t in range(8) for i in range(8) for j in range(8)]
    spark.createDataFrame(grid, "video long, t long, i int, j int, cost double").write.parquet(str(tmp_path / "grid"))
    args = ["select", "--grid", str(tmp_path / "grid"), "--out", str(tmp_path / "out"), "--group-size", "8", "--selector", "diverse_mixed"]
    assert main(args) == 0 and main(args) == 0
    first, again = capsys.readouterr().out.strip().splitlines()
    assert first == again and '"patches": 256' in first
    for name, scores_ in (("a", (1, 0)), ("b", (1, 1))):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"videomme_perception_score": {{"question_id": "q{k}", "score": {s}, "duration": "short"}}}}\n' for k, s in enumerate(scores_)))
    assert main(["summarize", "--run", f"a={tmp_path}/a.jsonl", "--run", f"b={tmp_path}/b.jsonl"]) == 0
    said = capsys.readouterr().out
    assert "| a | all | all | 2 | 1.0 | 0.5 |" in said and "| b | 2 | 1.0 | 2.0 | 1 | 0 | 1.0 |" in said


def test_cost_parts(spark):
    units = spark.createDataFrame([(1, 4, 12.0, "h264"), (2, 4, 5.0, "h264"), (3, 4, 5.0, "HEVC"), (4, 2, 8.0, "vp9"), (5, 2, 3.0, None)], "unit long, cells int, total double, codec_name string")
    parts = spark.createDataFrame([(1, 0, 2, 8.0), (2, 1, 1, 9.0), (3, 1, 1, 9.0), (4, 0, 1, 5.0)], "unit long, first int, count int, cost double")
    got = {}
    for r in scores.distribute_parts(units, parts).orderBy("unit", "cell").collect():
        got.setdefault(r.unit, []).append(r.share)
    assert got == {1: [5.0, 5.0, 1.0, 1.0], 2: [0.0, 9.0, 0.0, 0.0], 3: [-1.0, 8.0, -1.0, -1.0], 4: [4.0, 4.0], 5: [1.5, 1.5]}


def test_videos_named_by_paths(spark):
    """Everything that passes through Python keeps the type of the key."""
    rng = np.random.default_rng(9)
    cells = [(f"/v/{v}.mp4", t, i, j, float(rng.random())) for v in "ab" for t in range(24) for i in range(8) for j in range(8)]
    grid = spark.createDataFrame(cells, "video string, t long, i int, j int, cost double").cache()
    frames = spark.createDataFrame([(f"/v/{v}.mp4", t, 8, 8, rng.integers(0, 255, 192, dtype=np.uint8).tobytes()) for v in "ab" for t in range(24)], "video string, t long, h int, w int, bgr binary").cache()
    names = {"/v/a.mp4", "/v/b.mp4"}
    for c in (selection.Config(selector="diverse_mixed", dedup_descriptor="full", group_size=12), selection.Config(grouping="readiness", max_frames=12), selection.Config(grouping="adaptive_gop", target_groups=2, max_frames=9)):
        chosen, placed = selection.select_patches(grid, c, frames)
        assert {r.video for r in chosen.select("video").distinct().collect()} == names
    drawn = pixels.numbered_canvases(pixels.canvases(frames, placed, 8, 8, 1))
    assert {r.video for r in records.as_png(drawn).collect()} == names and {r.video for r in pixels.masked_frames(frames, placed, 1).collect()} == names
    packets = spark.createDataFrame([(f"/v/{v}.mp4", float(s), float(s * s % 7), "___") for v in "ab" for s in range(30)], "video string, pts_time double, size double, flags string")
    videos = spark.createDataFrame([(n, 300, 10.0) for n in names], "video string, total_frames int, fps double")
    bins = energy.energy_bins(packets, 1.0, 1)
    for got in (groups.energy_gops(bins, 1.0, 3, 2.0, 9.0), sampling.sample_energy_cdf(bins, videos, 1.0, 8), sampling.allocate_frames(sampling.pick_windows(videos, packets, 50, 5, 2), 8), anchors.spaced(grid.select("video", "t"), 5), anchors.thinned(frames.select("video", "t", F.lit(True).alias("good"), (F.col("t") % 4 == 0).alias("anchor"), F.lit(1.0).alias("fps")), 4, 2, 4), select.stratified(grid.filter("j = 0").select("video", F.lit(0).alias("bucket"), "t", F.col("i").alias("block_idx"), F.col("cost").alias("score")), 2, 4)):
        assert {r.video for r in got.select("video").distinct().collect()} == names
