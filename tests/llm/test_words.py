"""Whitening, spelling variants and BPE round trips against plain Python and NumPy."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from patchweave.llm import bpe, registry, spelling, whitening

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def brute_whitening(vectors):
    x = np.floor(np.array(vectors, np.float64) * 1024).astype(np.int64) + 100_000
    n, total = len(x), x.sum(0)
    c = x - total / n
    value, vector = np.linalg.eigh(c.T @ c / n)
    return n, ((n * x - total) ** 2).sum(1), value[::-1], c @ vector[:, ::-1] / np.sqrt(np.maximum(value[::-1], 1e-300))


def hold_whitening(got, ids, vectors, components=8):
    n, deviation, value, white = brute_whitening(vectors)
    by = defaultdict(dict)
    for r in got:
        by[r.component][r.vec_id] = r
    assert set(by) == set(range(1, components + 1))
    for k, found in by.items():
        mine = np.array([found[i].whitened for i in ids])
        want = white[:, k - 1]
        assert np.allclose(mine * np.sign(mine @ want), want, atol=1e-6)
        assert {r.n for r in found.values()} == {n} and [found[i].deviation for i in ids] == deviation.tolist()
        assert all(abs(r.explained / (value[k - 1] / value.sum()) - 1) < 1e-6 and r.identity_error < 1e-9 for r in found.values())


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{SF2}/embeddings.parquet").orderBy("vec_id").collect()
    hold_whitening(registry.QUERIES["op11_whitening"](spark, SF2).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


NAN, INF = float("nan"), float("inf")


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = rng.normal(size=(40, 5)).tolist()
    good += good[:3]
    odd = [None, [], [NAN] * 5, [1.0, INF, 1.0, 1.0, 1.0], [1.0, None, 1.0, 1.0, 1.0], [1.0], [1e300] * 5]
    rows = [(i, v, 1, "c") for i, v in enumerate([*good, *odd])] + [(None, good[0], 2, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long, w string")
    got = whitening.whiten(table, pairs=4).collect()
    assert sum(r.vec_id is None for r in got) == 5
    hold_whitening(got, [*range(43), None], [*good, good[0]], 5)
    assert whitening.whiten(table.filter("false")).count() == 0 and whitening.whiten(table.filter("vec_id = 0")).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}


def test_whitening_wide_sums(spark):
    """Sums of squares beyond 64 bits are exact."""
    rows = [(i, [float(i * 4e9), float(i % 3)]) for i in range(50)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = [[int(a * 1024) + 100_000, int(b * 1024) + 100_000] for _, (a, b) in rows]
    s = [sum(c) for c in zip(*x)]
    assert {(r.vec_id, int(r.deviation)) for r in got} == {(i, sum((50 * a - t) ** 2 for a, t in zip(v, s))) for i, v in enumerate(x)}


def brute_words(docs):
    count = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def one_edit(w):
    return {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}


def brute_variants(known):
    """Words that share a text with one letter left out, told apart by comparing them letter by letter."""
    by = defaultdict(set)
    for w in known:
        for v in one_edit(w):
            by[v].add(w)

    def differ(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return abs(len(a) - len(b)) == 1 and min(a, b, key=len) in one_edit(max(a, b, key=len))

    out = {}
    for w, n in known.items():
        near = {x for v in one_edit(w) for x in by[v] if x != w and differ(w, x)}
        best = min(near, key=lambda x: (-known[x], x), default=None)
        out[w] = (best if best and known[best] >= 10 * n else None, n, len(near))
    result = {}
    for w, (form, n, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        result[w] = (form, root, n, near, known[form] if form else None)
    return result


def found_variants(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_spelling_query(spark):
    rows = spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "text").collect()
    want = brute_variants(brute_words([(r.doc_id, r.text) for r in rows]))
    assert sum(v[0] is not None for v in want.values()) > 10
    assert found_variants(registry.QUERIES["op12_spelling"](spark, SF2)) == want


def test_spelling_oracle(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got = {r[0]: r[1:] for r in con.sql(registry.ORACLES["op12_spelling"]).project("word, form, root, n, n_near, form_n").fetchall()}
    assert got == found_variants(registry.QUERIES["op12_spelling"](spark, SF)) and got


def test_spelling_small_alphabet(spark):
    """Few letters: bigrams repeat within words and tie in frequency, so that prefixes end inside a run of equal bigrams."""
    rng = np.random.default_rng(8)
    made = ["".join(rng.choice(list("abc"), rng.integers(7, 12))) for _ in range(700)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "ababababa", "bababab", "ÀÀÀÀÀÀÀ", "ÀÀÀÀÀÀÀÀ"]
    known = {w: int(rng.integers(2, 400)) for w in made}
    table = spark.createDataFrame(list(known.items()), "word string, n long")
    got = {(r.word, r.n, r.other, r.m) for r in spelling.near(table).collect()}
    pairs = [(a, b) for a in known for b in known if a != b and (b in one_edit(a) or a in one_edit(b) or len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1)]
    assert got == {(a, known[a], b, known[b]) for a, b in pairs} and len(got) > 200


def test_spelling_chains(spark):
    """Roots over several steps, ties to the smaller word, slips, odd rows."""
    words = ["abcdefgh"] * 2000 + ["abcdefg"] * 150 + ["abcdexg"] * 14 + ["abcdeyg"] * 14 + ["abcdezzg"] * 2 + ["Überzügig"] * 3 + ["éÉAbcdefg"] * 2
    docs = [(i, " ".join(words[i::40]), "w", 1) for i in range(40)] + [(7, None, "w", 1), (8, "", "w", 1), (None, "kaleidoscope " * 40_000, "w", 1), (9, "repeated row text", "w", 1), (9, "repeated row text", "w", 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string, word string, n long")
    want = brute_variants(brute_words([d[:2] for d in docs]))
    assert found_variants(spelling.variants(table)) == want
    assert want["abcdeyg"][1] == "abcdefgh" and want["kaleidoscope"][2] >= 38_000
    assert spelling.variants(table.filter("false")).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(table, least=3)


ODD = [None, "", " ", "a<|endoftext|>b  c<|endoftext|>", "<|endoftext|>", " \n\n x  'S it's", "don't DON'T 'LL", "日本語 text 𝔘 🙂", "a\x00b", "x" * 50_000, "word " * 30_000, "    a\u0085b", *[chr(i) + "a" + chr(i) * 2 + "1" + chr(i) + " " + chr(i) for i in range(0x180)]]


def tokenizer():
    from tokenizers import Tokenizer

    from patchweave.llm.tokens import tokenizer_path

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


@pytest.mark.parametrize("limits", [{}, {"characters": 40, "words": 5, "chunk_docs": 3, "hold": 100}])
def test_bpe_odd_texts(spark, limits):
    tok = tokenizer()
    docs = spark.createDataFrame([*((i, t, "c", 1) for i, t in enumerate(ODD)), (5, ODD[5], "c", 1), (None, "no id", "c", 1)], "doc_id long, text string, chunk string, place int").repartition(3)
    got = bpe.decode(bpe.encode(docs, **limits)).collect()
    assert Counter(r.doc_id for r in got) == Counter([*range(len(ODD)), 5, None])
    for r in got:
        ids = tok.encode((ODD[r.doc_id] if r.doc_id is not None else "no id") or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.text == tok.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs.filter("false")).count() == 0 and bpe.decode(bpe.encode(docs.filter("false"))).count() == 0


def test_bpe_decodes_any_ids(spark):
    """Ids that make no UTF-8, and ids outside the vocabulary."""
    tok, rng = tokenizer(), np.random.default_rng(2)
    rows = [(i, rng.integers(0, 60_000 if i % 2 else 256, 30).tolist()) for i in range(60)]
    table = spark.createDataFrame([(i, np.array(x, "<u4").tobytes()) for i, x in rows] + [(99, None)], "doc_id long, ids binary")
    got = {r.doc_id: r.text for r in bpe.decode(table).collect()}
    assert got == {i: tok.decode(x, skip_special_tokens=False) for i, x in rows} | {99: ""}


def test_bpe_query(spark):
    tok = tokenizer()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = registry.QUERIES["op13_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tok.decode(ids, skip_special_tokens=False).encode()))


def test_bpe_in_one_worker(spark):
    """Ids and texts of one pass are those of encoding and decoding one after the other; ids cross to Spark in several batches."""
    import numpy as np
    import pyarrow as pa

    rows = [(i, t) for i, t in enumerate([None, "", "one two three", "éà 日本 ß", "a<|endoftext|>b", *[f"word{k} and more" for k in range(600)]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = {(r.doc_id, bytes(r.ids), r.text) for r in bpe.encode_and_decode(docs, words=50).collect()}
    assert once == {(r.doc_id, bytes(r.ids), r.text) for r in bpe.decode(bpe.encode(docs)).collect()}
    assert {(d, t) for d, _, t in once} == {(d, t or "") for d, t in rows}
    chunk = pa.table({"chunk": [0], "doc_ids": [list(range(600))], "lengths": [bpe.packed(np.ones(600))], "places": [bpe.packed(np.zeros(600))]})
    words = pa.table({"chunk": [0], "places": [bpe.packed([0])], "sizes": [bpe.packed([1])], "ids": [bpe.packed([7])]})
    assert [b.num_rows for b in bpe._documents(chunk, words).to_batches()] == [256, 256, 88]
