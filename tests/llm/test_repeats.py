"""Null and repeated ids: every row of the mix by itself."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from patchweave.llm import jaccard_join, mixing, quality_rules, secret_scans

DOCS = "doc_id long, text string, source string"


def words(r):
    return len((r.text or "").split())


@pytest.mark.parametrize("key", [0, None])
def test_mix_deals_repeated_rows(spark, key):
    """A key that holds a third of a source at p = 0.5 (and one that repeats an odd number of times)."""
    rows = [(key, "w " * 10, "a")] * 101 + [(i, "w " * 10, "a") for i in range(1, 200)] + [(1000 + i, "w " * 10, "b") for i in range(150)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    mine = [r for r in got if r.source == "a"]
    assert len(got) == len(rows) and mine[0].target == 1500 and abs(sum(r.taken for r in mine) - 1500) <= 10
    assert sum(r.copies for r in mine if r.doc_id == key) in (50, 51)


@pytest.mark.parametrize("stretch", [3, 10_000])
def test_mix_keeps_ids_and_counts_of_a_hot_unit(spark, monkeypatch, stretch):
    """1,001 equal rows near their target, and ids above 2**53 beside a null."""
    monkeypatch.setattr(mixing, "STRETCH", stretch)
    big = [9007199254740993, 9007199254740995, -9007199254740993]
    rows = [(7, "w " * 10, "a")] * 1001 + [(i, "x y", "b") for i in (None, *big, *range(2000, 4000))] + [(None, "solo", None)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    mine = [r for r in got if r.source == "a"]
    assert len(mine) == 1001 and abs(sum(r.taken for r in mine) - mine[0].target) <= 10
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)


def test_mix_of_many_sources(spark):
    """Targets as a plain loop makes them, whatever the number of sources."""
    rows = [(i, "w " * (1 + i * i % 40), f"s{i % 97:02}") for i in range(1500)] + [(5000, "w " * 3000, "s50"), (5001, "w", None)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.targets([size[s] for s in names], [1 + i % 3 for i in range(len(names))])))
    assert all(abs(r.target - want[r.source]) < 1e-6 for r in got)


def test_take_follows_the_mix(spark):
    """Rows that share an id keep their own copies."""
    rows = [(i % 40, f"t{i} " * (1 + i % 7), "ab"[i % 2]) for i in range(300)] + [(None, f"n{i} " * (3 + i % 2), "a") for i in range(60)] + [(5, "same text", "b")] * 21 + [(None, None, None), (6, "", "a")]
    docs = spark.createDataFrame(rows, DOCS)
    plan, got = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        plan[r.source, r.doc_id, r.size] += r.copies
    taken = mixing.take(docs).collect()
    for r in taken:
        got[r.source, r.doc_id, words(r)] += 1
    assert got == +plan and set(map(tuple, taken)) <= set(rows)


def some_words(seed, n=60):
    return " ".join(f"s{seed}x{k}" for k in range(n))


def test_deduplicate_by_text(spark):
    """Rows without id stay; a repeated id leaves only with a similar text."""
    a, b, c = some_words(1), some_words(2), some_words(3)
    near = a + " more"
    stay = [(None, a, "x"), (None, a, "y"), (None, None, "x"), (1, a, "p"), (1, b, "q"), (4, c, "r"), (8, "", "e"), (9, None, "e")]
    leave = [(1, b, "q"), (2, near, "p"), (3, b, "p"), (4, near, "t"), (5, c, "u"), (8, "", "e")]
    for rows in (stay, stay + leave):
        assert sorted(map(tuple, jaccard_join.deduplicate(spark.createDataFrame(rows, DOCS)).collect()), key=str) == sorted(stay, key=str)


def test_redact_masks_each_row(spark):
    """Linked parts are masked without an id, and never at the places of another text with the same id."""
    part = "user = mary77 then Xk29fjQpLmZ81vbTrQ5n"
    rows = [(None, part, "a"), (None, "clean words", "b"), (1, part, "a"), (1, "some other words that hold no secret at all", "b"), (2, None, "c")]
    want = [(None, "[SECRET] then [SECRET]", "a"), (None, "clean words", "b"), (1, "[SECRET] then [SECRET]", "a"), *rows[3:]]
    assert sorted(map(tuple, secret_scans.redact(spark.createDataFrame(rows, DOCS)).collect()), key=str) == sorted(want, key=str)


def test_texts_of_one_id_keep_their_links(spark):
    """A repeated id brings the links of all its texts, in one task and over blocks."""
    a, b, c = some_words(1), some_words(2), some_words(3)
    rows = [(1, a), (3, a + " x"), (3, b), (4, b + " y"), (6, c), (6, ""), (7, c + " z"), (7, some_words(4)), (9, some_words(4)), (8, ""), (None, a)]
    got = {(r.doc_id, r.component_id) for r in jaccard_join.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (3, 1), (4, 1), (6, 6), (7, 6), (9, 6), (8, 8), (None, None)}


def test_more_cells_than_the_bound(spark, monkeypatch):
    """Bins are merged until the cells fit, and every labelled row is still counted."""
    rows = [(i, i / 100, i % 7 / 7, i % 11 / 11, i % 13 / 13, i % 5 + 0.5, 100, 0) for i in range(400)]
    stats = spark.createDataFrame(rows, f"doc_id long, {', '.join(f'{s} double' for s in quality_rules.STATISTICS)}, n_words long, n_repeat_words long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    for most in (50, 4):
        monkeypatch.setattr(quality_rules, "MAX_CELLS", most)
        cells, cuts = quality_rules.contingency(stats, labels)
        assert len(cells) <= most and sum(c["count"] for c in cells) == 400
        assert all(0 <= c[s] <= len(cuts[s]) for c in cells for s in quality_rules.STATISTICS)
        quality_rules.learn(cells, cuts)


def test_vectors_of_one_id(spark):
    """An id with two vectors counts once, with the least of them, in every run."""
    from patchweave.llm import ann

    rows = [(i, [float(i % 5), float(i % 3), 1.0, float(i % 7)]) for i in range(60)] + [(20, [-9.0, 0.0, 1.0, 2.0]), (20, [50.0, 0.0, 1.0, 2.0])]
    for seed in (1, 2):
        got = {(r.query_id, r.vec_id): r.score for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").orderBy(F.rand(seed))).collect()}
        assert got[20, 0] == 1.0 and {q for q, _ in got} == {0, 20, 40}


def test_token_counts_of_long_pieces(spark):
    """Pieces too long for the broadcast are counted by the join."""
    from patchweave.llm import token_counts, tokens

    rows = [(i, "z" * 200 + " and " + "q9" * 60) for i in range(50)] + [(99, None)]
    tok = tokens.PreTokens(tokens.tokenizer_path(token_counts.VOCABULARY)).tok
    n = len(tok.encode(rows[0][1], add_special_tokens=False).ids)
    assert {(r.doc_id, r.n_tokens) for r in token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {(i, n) for i in range(50)} | {(99, 0)}


def test_vectors_of_unequal_length_and_tight_groups(spark, monkeypatch):
    """The nearest are found whatever the codes tell apart: lengths far apart, groups tighter than a code, many equal products; in one block and in several."""
    import numpy as np

    from patchweave.llm import ann

    rng = np.random.default_rng(8)
    spread = rng.standard_normal((1500, 16)) * np.exp(2 * rng.standard_normal((1500, 1)))
    groups = rng.standard_normal((3, 16))[rng.integers(0, 3, 1500)] + 1e-3 * rng.standard_normal((1500, 16))
    sparse = (rng.random((1500, 16)) < 0.2).astype(float) + np.eye(16)[0]
    for x in (spread, groups, sparse):
        for block in (1 << 20, 1 << 16):
            monkeypatch.setattr(ann, "BLOCK", block)
            got = ann.search(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"), keep=64).orderBy("query_id", "rank").collect()
            for q in range(0, len(x), 20):
                score = (x * x[q]).cumsum(1)[:, -1]
                score[q] = -np.inf
                want = np.lexsort((np.arange(len(x)), -score))[:20]
                assert [(r.vec_id, r.score) for r in got[q:][:20]] == [(i, score[i]) for i in want]
