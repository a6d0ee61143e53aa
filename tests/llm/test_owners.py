"""Calls side by side own what they stage; learning is bounded and orderly."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from patchweave.llm import chat_format, common, jaccard_join, mixing, quality_classifier, secret_scans, token_counts

SF = "/root/testdata/sf0.001"


def test_three_operators_side_by_side(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    jobs = [lambda: sorted(map(tuple, jaccard_join.similar(docs).collect())), lambda: sorted(tuple(r) for r in mixing.take(docs).select("doc_id", "n_chars").collect()), lambda: sorted(map(tuple, token_counts.token_counts(docs).collect()))]
    alone = [job() for job in jobs]
    with ThreadPoolExecutor(3) as pool:
        for _ in range(2):
            assert [f.result() for f in [pool.submit(job) for job in jobs]] == alone


def test_owner_deletes_its_own(spark):
    outer = common.stage(spark.range(3), "outer")
    with common.owned() as own:
        kept, gone = common.stage(spark.range(4), "kept"), common.stage(spark.range(5), "gone")
        own.keep(kept)
    with pytest.raises(ValueError), common.owned() as failed:
        common.stage(spark.range(6), "failed")
        raise ValueError
    left = set(common._staged)
    assert {common.path_of(outer), common.path_of(kept)} <= left and common.path_of(gone) not in left and not failed.paths & left
    assert outer.count() == 3 and kept.count() == 4
    common.release([common.path_of(outer), common.path_of(kept)])


def test_stages_called_inside_one_another(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    masked = corpus_pipeline.secrets(spark, kept, SF)  # what it reads is not written yet
    assert masked.count() == jaccard_join.deduplicate(docs).count()


def test_quality_sample_is_bounded_by_ids(spark, monkeypatch):
    text = spark.range(0, 3000).selectExpr("7L as doc_id", "concat('word ', id) as text")
    docs = text.union(spark.range(20, 60).selectExpr("id as doc_id", "concat('other text ', id) as text"))
    labels = spark.createDataFrame([(7, 1), *((i, i % 2) for i in range(20, 60))], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_classifier, "fit", lambda xp, xu, prior: seen.append((len(xp), len(xu))) or (xp[0] * 0, 0.0))
    quality_classifier.train(docs, labels, positives=10, unlabelled=10)
    assert seen[0][0] <= 10 and seen[0][1] <= 10


def same(a, b):
    return all((x == y).all() for x, y in zip([a.start, a.step, *a.emit], [b.start, b.step, *b.emit]))


def test_chat_learning_by_order(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"line {c} {t}\nmore" if t else "hi?") for c in range(9) for t in range(4)]
    table = lambda r: spark.createDataFrame(r, "conv_id long, turn long, role string, text string")
    model = chat_format.train(table(rows))
    assert same(model, chat_format.train(table(rows * 3))) and same(model, chat_format.train(table([(c, t + 1, r, x) for c, t, r, x in rows])))
    assert model.start[2] > model.start[4]
    clash = [*rows, (0, 1, "system", "rule"), (0, 1, "user", "other")]
    assert same(chat_format.train(table(clash).repartition(5)), chat_format.train(table(clash[::-1]).repartition(2)))


def test_very_many_secrets(spark):
    """Blocks of matches: every count up to some blocks, and where the last match ends the text."""
    counts = [0, 1, 255, 256, 257, 511, 512, 513, 5000]
    texts = {n: " é ".join(f"token={'a' * (6 + k % 5)}" for k in range(n)) for n in counts} | {-1: "x" + "token=abcdef;" * 600}
    got = {r.doc_id: r.base for r in secret_scans.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for n, text in texts.items():
        want, at = [], 0
        while (at := text.find("token=", at)) >= 0:
            end = at + 6
            while end < len(text) and text[end].isalpha() and text[end] != "é":
                end += 1
            want.append((at, end))
            at = end
        assert [(s["at"], s["end"]) for s in got[n]] == want, n


def test_staged_tables_have_no_marker_files(spark):
    """Each marker file costs the driver two processes on a local disk; the rows are all there without it."""
    import os

    from patchweave.llm import common

    for by in (None, "k"):
        staged = common.stage(spark.range(100).selectExpr("id", "id % 3 as k"), "marker", by=by)
        path = common.path_of(staged)
        assert not [f for f in os.listdir(path.removeprefix("file:")) if "_SUCCESS" in f]
        assert staged.count() == 100
        common.release({path})


def test_scaling_leaves_its_input(spark):
    """The fit's one copy has the values of the plain formula and what was passed in stays as it is."""
    import numpy as np

    from patchweave.llm import quality_classifier

    x = np.random.default_rng(2).standard_normal((50, 4)).astype(np.float32) * 20
    was, mean, scale = x.copy(), x.mean(0), x.std(0) / 9
    assert (quality_classifier._scaled(x, mean, scale) == ((x - mean) / scale).clip(-8, 8).astype(np.float32)).all() and (x == was).all()
