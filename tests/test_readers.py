"""Readers of runs in nested folders, and exports of videos that are named by paths."""

from patchweave.sources import records


def test_nested_runs(spark, tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    for folder, key in ((tmp_path, "top"), (deep, "deep")):
        (folder / "samples.jsonl").write_text('{"videomme_perception_score": {"question_id": "%s", "score": 1}}\n' % key)
    (deep / "audit.jsonl").write_text('{"video": "v", "subprocess_ms": 3}\n')
    assert sorted(r.key for r in records.read_eval_samples(spark, str(tmp_path), "r").collect()) == ["deep", "top"]
    assert ("v", 3.0) in {tuple(r) for r in records.read_preprocess(spark, str(tmp_path)).collect()}


def test_exports_stay_in_their_folder(spark, tmp_path):
    outside, target = tmp_path / "videos", tmp_path / "out"
    outside.mkdir()
    files = spark.createDataFrame([(f"{outside}/clip.mp4", "canvas_000.png", b"x"), ("../../up", "canvas_000.png", b"y"), ("plain", "canvas_001.png", b"z")], "video string, name string, png binary")
    assert records.export_canvases(files, str(target)) == 3
    assert not list(outside.iterdir()) and len(list(target.rglob("*.png"))) == 3 and (target / "plain" / "canvas_001.png").read_bytes() == b"z"
