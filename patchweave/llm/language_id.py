"""Language identification by rank-order n-gram profiles.

A profile is the list of the most frequent letter n-grams (one to three
characters, words padded with a boundary mark), most frequent first, ties by
character code.  A document's profile is compared to every language's by the
out-of-place distance: the sum over its n-grams of how far their ranks differ,
the length of a profile for an n-gram the language does not list.

Profiles are learned from text and lang of rows whose crc32(doc_id) mod 4 is not
2, ``per_language`` documents of each of the ``languages`` most frequent (those whose
hash of the id lies below the share that gives that many).  Every
whole text is predicted.  Null text or no letter: ``und`` with score 0; so are
all texts if nothing could be learned.  Ties: the language first by code point.
Repeated rows: one result each; empty table: no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc_fold, held_out, map_arrow, table

PROFILE = 300
PER_LANGUAGE = 3_000
#: Languages that are learned: the most frequent ones.
LANGUAGES = 1_000


class Grams:
    """n-grams of a text as integers (21 bits a character) with their counts."""

    def __init__(self):
        self.letter = np.zeros(0x110000, bool)
        self.letter[[c for c in range(0x110000) if chr(c).isalpha()]] = True

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        seq = np.zeros(len(cp) + 2, np.int64)
        seq[1:-1] = np.where(self.letter[cp], cp, 1)
        seq[0] = seq[-1] = 1
        mark = seq == 1
        keep = np.ones(len(seq), bool)
        keep[1:] = ~(mark[1:] & mark[:-1])
        seq = seq[keep]
        mark = seq == 1
        two = (seq[:-1] << 21) | seq[1:]
        three = (two[:-1] << 21) | seq[2:]
        return np.unique(np.concatenate([seq[~mark], two, three[~mark[1:-1]]]), return_counts=True)

    def profile(self, text: str, size: int) -> np.ndarray:
        codes, counts = self(text)
        return codes[np.lexsort((codes, -counts))[:size]]


def _count():
    from collections import defaultdict

    import pyarrow as pa

    grams = Grams()

    def run(batches):
        held: dict = defaultdict(lambda: defaultdict(int))

        def out():
            for lang, counts in held.items():
                keys = list(counts)
                for lo in range(0, len(keys), 20_000):
                    part = keys[lo : lo + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part, pa.int64()), pa.array([counts[k] for k in part], pa.int64())], ["lang", "gram", "n"])

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine = held[lang]
                for k, n in zip(*(a.tolist() for a in grams(text))):
                    mine[k] += n
            if sum(map(len, held.values())) > 300_000:
                yield from out()
                held.clear()
        yield from out()

    return run


def _predict(profiles: dict[str, list[int]], size: int):
    def make():
        import pyarrow as pa

        grams, langs = Grams(), sorted(profiles)
        # for every n-gram the languages that list it and its rank there: as much as the profiles themselves
        listed = np.array([(g, r, j) for j, lang in enumerate(langs) for r, g in enumerate(profiles[lang])], np.int64).reshape(-1, 3)
        listed = listed[np.argsort(listed[:, 0], kind="stable")]
        union, start = np.unique(listed[:, 0], return_index=True)
        end = np.append(start[1:], len(listed))

        def one(text):
            if not text or not len(union):
                return "und", 0.0
            mine = grams.profile(text, size)
            if not len(mine):
                return "und", 0.0
            at = np.searchsorted(union, mine).clip(max=len(union) - 1)
            found = np.flatnonzero(union[at] == mine)
            lo, n = start[at[found]], end[at[found]] - start[at[found]]
            rows = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(found) else np.zeros(0, np.int64)
            apart = np.abs(listed[rows, 1] - np.repeat(found, n))
            total = size * len(mine) - np.bincount(listed[rows, 2], size - apart, len(langs))
            best = int(total.argmin())
            return langs[best], 1 - total[best] / (size * len(mine))

        def letters(text):
            return bool(text) and any(map(str.isalpha, text))

        def run(batches):
            for batch in batches:
                got = [one(t) if letters(t) else ("und", 0.0) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([g[0] for g in got], pa.string()), pa.array([float(g[1]) for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

        return run

    return make


def train(docs: DataFrame, size: int = PROFILE, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> dict[str, list[int]]:
    """Profiles of the (at most ``languages``) languages of the learning folds."""
    learn = F.coalesce(crc_fold() != 2, F.lit(False)) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    known = docs.filter(learn).select("doc_id", "text", "lang")
    # one row a language, as many as there are profiles
    share = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang", (per_language / F.col("n")).alias("share"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 20)) / (1 << 20)
    rows = known.join(F.broadcast(share), "lang").filter(part < F.col("share")).select("text", "lang")
    counts = map_arrow(rows, lambda: _count(), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    profiles: dict[str, list[int]] = {}
    for r in counts.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= size).orderBy("lang", "r").collect():
        profiles.setdefault(r.lang, []).append(r.gram)
    return profiles


def identify(docs: DataFrame, size: int = PROFILE, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    profiles = train(docs, size, per_language, languages)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    return map_arrow(rows, _predict(profiles, size), "doc_id long, held_out boolean, lang_pred string, score double")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
