"""Spelling variants: words one edit apart, found by a rare-first prefix filter on positional bigrams.

Words are runs of Latin letters, A-Z lower-cased, with a known share of slips: of
every 31st occurrence (by crc32 of ``doc_id:run``) one letter is left out.  Words
of ``LEAST`` code points and more that occur twice or more are compared.

The bigrams of a word are put in one global order, rarest first (frequency over
all distinct words, then the bigram).  One edit changes at most two bigrams of a
word, so of the ``PREFIX`` = 3 rarest of the word whose third comes first in that
order at least one stands in the other word as well, among its rarest: near words
meet if only these are joined.  Where the third bigram of a word stands in it more
than once, all its places are joined, as which of them survives is not known.
Positions limit the join: at equal length a bigram that survives keeps its place,
in a word that is longer by one it keeps it or moves by one.  And as one edit
leaves either the first or the second half of the shorter word as it is, the join
asks for one of these to be equal, which keeps every block small however frequent
its bigram.  What meets is verified by edit distance.

Forms: the near word of largest count (ties: the smallest by code point), if it
occurs ``RATIO`` times as often.  Counts grow along forms, so that following them
ends; roots are found by doubling the steps, one written table a round.

Null texts have no words; a null id counts as an empty text.  Repeated rows count
as often as they occur.  Texts may be of any length.  Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import path_of, release, stage, table

RUN = r"[A-Za-zÀ-ÿ]"
SLIP = 31
LEAST, OFTEN = 7, 2
PREFIX = 3
RATIO = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(word: Column) -> Column:
    """A-Z in lower case, and nothing else."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def words(docs: DataFrame, least: int = LEAST, often: int = OFTEN) -> DataFrame:
    """word, n: distinct words of ``least`` code points and more, slips made, that occur ``often`` times or more."""
    # the longest words of a text are all that counts: shorter runs are not even matched
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{least},}}"), F.lit(0))).alias("w")).select("d", lowered(F.col("w")).alias("w"))
    h = F.crc32(F.concat("d", F.lit(":"), "w").cast("binary"))
    runs = runs.select("w", h.alias("h"))
    cut = (F.col("h") % F.length("w")).cast("int")
    slipped = F.concat(F.substring("w", F.lit(1), cut), F.substring("w", cut + 2, F.length("w")))
    word = F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("w"))
    return runs.select(word.alias("word")).filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= often)


def _bigrams(word: str) -> Column:
    """The positional bigrams of a word column: structs (p, g)."""
    return F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda p: F.struct(p.alias("p"), F.substring(F.col(word), p, F.lit(2)).alias("g")))


def rarest(known: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """word, n, g, p: the places of every word's ``prefix`` rarest bigrams, and further places of the last of them."""
    places = known.select("word", "n", F.explode(_bigrams("word")).alias("b")).select("word", "n", "b.p", "b.g")
    frequency = places.groupBy("g").agg(F.count("*").alias("f"))
    # distinct pairs of 90 letters (52 without A-Z's lower-casing): at most 8,100 rows, whatever the input
    ranked = places.join(F.broadcast(frequency), "g").groupBy("word", "n").agg(F.array_sort(F.collect_list(F.struct("f", "g", "p"))).alias("b"))
    last = F.element_at("b", F.least(F.lit(prefix), F.size("b")))
    kept = ranked.select("word", "n", F.filter("b", lambda x: F.struct(x["f"], x["g"]) <= F.struct(last["f"], last["g"])).alias("b"))
    return kept.select("word", "n", F.explode("b").alias("b")).select("word", "n", "b.g", "b.p")


def near(known: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """word, n, other, m: every pair of words exactly one edit apart, in both directions, once each.

    ``known`` has words of more than ``prefix`` code points.
    """
    held = stage(rarest(known, prefix), "spelling-rarest").withColumn("l", F.length("word"))

    def keys(place, length, shorter, longer):
        """By bigram, its place, the longer word's length, whether the other is shorter, and one half of the shorter word."""
        half = F.floor(shorter / 2).cast("int")
        ends = F.array(F.concat(F.lit("<"), F.substring("word", F.lit(1), half)), F.concat(F.lit(">"), F.right("word", shorter - half)))
        return F.transform(ends, lambda e: F.xxhash64("g", place, length, longer, e))

    p, size, same, more = F.col("p"), F.col("l"), F.lit(0), F.lit(1)
    # as a word of the same length, and as one that may be longer by one
    index = held.select(F.explode(F.concat(keys(p, size, size, same), keys(p, size, size - 1, more))).alias("key"), F.col("word").alias("other"), F.col("n").alias("m"))
    probe = held.select("word", "n", F.explode(F.concat(keys(p, size, size, same), keys(p, size + 1, size, more), keys(p + 1, size + 1, size, more))).alias("key"))
    shorter = F.length("word") < F.length("other")
    pairs = probe.join(index.hint("merge"), "key").filter((shorter | (F.col("word") < F.col("other"))) & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other", "m").distinct()
    pairs = stage(pairs, "spelling-pairs")
    return pairs.union(pairs.select("other", "m", "word", "n"))


def forms(near_: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n_near, form, form_n: the near word that occurs ``ratio`` times as often and most often, or null."""
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("w"))).alias("best")
    found = near_.groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    holds = -F.col("best.m") >= ratio * F.col("n")
    return found.select("word", "n_near", F.when(holds, F.col("best.w")).alias("form"), F.when(holds, -F.col("best.m")).alias("form_n"))


def roots(steps: DataFrame) -> DataFrame:
    """word, root: where (word, form) leads to in the end, for every word that has a form."""
    now = stage(steps.select("word", F.col("form").alias("root")), "spelling-roots", narrow=True)
    while True:
        ahead = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        then = stage(now.join(ahead.hint("merge"), F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "spelling-roots", narrow=True)
        more = then.filter("moved").limit(1).count()
        release({path_of(now)})
        now = then
        if not more:
            return now.select("word", "root")


def variants(docs: DataFrame, least: int = LEAST, often: int = OFTEN, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    if least <= PREFIX:
        raise ValueError(f"words of more than {PREFIX} code points are compared")
    known = stage(words(docs, least, often), "spelling-words")
    found = stage(forms(near(known), ratio), "spelling-forms")
    ended = roots(found.filter(F.col("form").isNotNull()))
    out = known.join(found.hint("merge"), "word", "left").join(ended.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
