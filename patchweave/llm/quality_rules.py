"""Quality rules: text statistics, and decision lists learned from them.

Base statistics come from the words of the whole text.  The learned part is an
ordered list of conjunctions of thresholds on shape statistics.  Sequential
covering grows a conjunction on two thirds of the labelled statistics (greatest
FOIL gain), prunes it on the other third, removes what it covers, and repeats;
a rule stands if it is precise enough on the pruning part.  The list becomes one
ordered conditional expression.

Everything the data meet is a Spark expression.  Learning sees only a
contingency table (bins of the statistics by label and part), whose size is
bounded by the bins, not by the data: cut points are the quantiles of the
labelled rows, and all labelled rows are counted.  Where the table would be too
large for the driver, neighbouring bins are merged and all rows counted again.

Null text: no words.  Empty and blank texts: all counts 0 (base_failed).  Texts
may be of any length.  Repeated rows: one result each.  No labels: base rules
alone decide.  Empty table: no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, WORD, stage, table
from .graph import apart

BINS = 16
MAX_RULES = 12
MAX_CONDITIONS = 3
PRECISION = 0.8
MIN_COVER = 5
#: Rows of the contingency table that may come to the driver.
MAX_CELLS = 400_000
STATISTICS = ("symbol_share", "upper_share", "repeat_share", "dup_line_share", "mean_word")


@dataclass(frozen=True)
class Rule:
    """All of ``conditions`` (statistic, above, threshold) hold: label 0."""

    conditions: tuple[tuple[str, bool, float], ...]

    def expression(self) -> Column:
        out = F.lit(True)
        for name, above, cut in self.conditions:
            out = out & ((F.col(name) > cut) if above else (F.col(name) <= cut))
        return out


def _neighbours(ordered: str, key: str) -> Column:
    """The places i of entries (key, i) of an ordered array whose key equals that of the entry before or after."""
    m, keys = F.size(ordered), F.col(f"{ordered}.{key}")
    none = F.array(F.get(F.slice(keys, F.lit(1), F.lit(0)), F.lit(0)))
    before = F.zip_with(ordered, F.concat(none, F.slice(keys, F.lit(1), m - 1)), lambda x, y: F.struct(x["i"].alias("i"), F.coalesce(x[key] == y, F.lit(False)).alias("same")))
    after = F.zip_with(before, F.concat(F.slice(F.transform(before, lambda x: x["same"]), F.lit(2), m - 1), F.array(F.lit(False))), lambda x, y: F.when(x["same"] | y, x["i"]))
    return F.filter(after, lambda i: i.isNotNull())


def statistics(docs: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """doc_id, the base counts and the shares that rules are made of, for every row."""
    keep = ["doc_id", *(extra or [])]
    base = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    # \n-split lines with a word
    parts = base.withColumn("_w", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).withColumn("_l", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)))
    n = F.size("_w")
    parts = parts.select(
        *keep,
        "_w",
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", BLANK, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_x"),
    )
    # three-word windows by hash first: a text whose hashes all differ repeats none, and texts are compared without joining words
    at = lambda k: F.get(F.col("_x"), k)
    hashed = F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))).otherwise(F.array().cast("array<bigint>"))
    parts = parts.withColumn("_h", hashed)
    pairs = F.array_sort(F.arrays_zip(F.col("_h").alias("h"), F.sequence(F.lit(0), F.size("_h") - 1).alias("i")))
    parts = parts.withColumn("_s", F.when(F.size("_h") > F.size(F.array_distinct("_h")), pairs))
    # windows whose hash stands twice; the words themselves decide which of them are equal
    twice = parts.withColumn("_c", _neighbours("_s", "h"))
    texts = F.transform("_c", lambda i: F.struct(F.array_join(F.slice("_w", i + 1, F.lit(3)), " ").alias("t"), i.alias("i")))
    same = twice.withColumn("_s", F.when(F.size("_c") > 0, F.array_sort(texts))).withColumn("_c", _neighbours("_s", "t"))
    repeat = F.size(F.array_distinct(F.flatten(F.array("_c", F.transform("_c", lambda i: i + 1), F.transform("_c", lambda i: i + 2)))))
    counted = same.withColumn("n_repeat_words", F.when(F.col("_c").isNull(), F.lit(0)).otherwise(repeat).cast("long"))
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return counted.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("n_symbols", "n_words").alias("symbol_share"), share("n_upper", "word_chars").alias("upper_share"), share("n_repeat_words", "n_words").alias("repeat_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"), share("word_chars", "n_words").alias("mean_word"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def contingency(stats: DataFrame, labels: DataFrame, bins: int = BINS) -> tuple[list, dict[str, list[float]]]:
    """Counts of labelled rows by binned statistics, label and part (grow or prune), and the cut points."""
    known = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).filter("lo = hi")
    # an id may repeat without bound: its rows can be split over tasks
    joined = apart(stats.filter(~base_failed()).withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").join(apart(known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lo").alias("label")), "doc_id").hint("merge"), "doc_id")
    rows = stage(apart(joined, "doc_id").select("doc_id", "label", *STATISTICS), "rule-statistics", narrow=True)
    at = [i / bins for i in range(1, bins)]
    # label-0 rows are the rarer: their quantiles place cuts where rules are wanted, those of label 1 where they end
    found = rows.groupBy("label").agg(*[F.percentile_approx(s, at, 10_000).alias(s) for s in STATISTICS]).collect()
    cuts = {s: sorted({float(x) for r in found for x in (r[s] or [])}) for s in STATISTICS}
    label, prune = (F.col("label") != 0).cast("int").alias("label"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune")
    while True:
        binned = rows.select(label, prune, *[sum((F.when(F.col(s) > c, 1).otherwise(0) for c in cuts[s]), F.lit(0)).alias(s) for s in STATISTICS])
        cells = binned.groupBy("label", "prune", *STATISTICS).count().limit(MAX_CELLS + 1).collect()
        widest = max(STATISTICS, key=lambda s: len(cuts[s]))
        if len(cells) <= MAX_CELLS or not cuts[widest]:
            return cells, cuts
        cuts[widest] = cuts[widest][1::2]


def learn(cells: list, cuts: dict[str, list[float]], max_rules: int = MAX_RULES, precision: float = PRECISION, min_cover: int = MIN_COVER) -> list[Rule]:
    """Sequential covering over contingency cells; rules for label 0 in order."""
    x = np.array([[c[s] for s in STATISTICS] for c in cells], np.int64).reshape(len(cells), len(STATISTICS))
    n, bad, held = (np.array([c[k] for c in cells], np.int64) for k in ("count", "label", "prune"))
    bad, held = bad == 0, held == 1
    left = np.ones(len(cells), bool)

    def holds(conditions):
        out = left.copy()
        for k, above, b in conditions:
            out &= (x[:, k] > b) if above else (x[:, k] <= b)
        return out

    def tally(rows):
        return int(n[rows & bad].sum()), int(n[rows & ~bad].sum())

    rules: list[Rule] = []
    while len(rules) < max_rules:
        covered, conditions = left & ~held, []
        p0, n0 = tally(covered)
        if p0 < min_cover:
            break
        while n0 and len(conditions) < MAX_CONDITIONS:
            best, base = None, math.log2(p0 / (p0 + n0))
            for k, name in enumerate(STATISTICS):
                bins = len(cuts[name]) + 1
                below = [np.cumsum(np.bincount(x[rows, k], n[rows], bins)) for rows in (covered & bad, covered & ~bad)]
                for b in range(bins - 1):
                    p, q = int(below[0][b]), int(below[1][b])
                    for above, pp, qq in ((False, p, q), (True, p0 - p, n0 - q)):
                        if pp >= min_cover and (pp, qq) != (p0, n0):
                            gain = pp * (math.log2(pp / (pp + qq)) - base)
                            best = max(best or (gain, k, above, b), (gain, k, above, b))
            if best is None or best[0] <= 0:
                break
            conditions.append(best[1:])
            covered = holds(conditions) & ~held
            p0, n0 = tally(covered)
        worth = lambda cs: (lambda p, n: ((p - n) / (p + n) if p + n else -1.0, p + n))(*tally(holds(cs) & held))
        while len(conditions) > 1 and worth(conditions[:-1])[0] >= worth(conditions)[0]:
            conditions = conditions[:-1]
        if not conditions:
            break
        rows = holds(conditions)
        (p, q), (gp, gq) = tally(rows & held), tally(rows & ~held)
        if (p + gp) < precision * (p + q + gp + gq) or p < precision * (p + q):
            break
        rules.append(Rule(tuple((STATISTICS[k], above, cuts[STATISTICS[k]][b]) for k, above, b in conditions)))
        left &= ~rows
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one conditional: the number of the first rule that holds (from 1), 0 if none."""
    out = None
    for i, r in enumerate(rules, 1):
        out = F.when(r.expression(), i) if out is None else out.when(r.expression(), i)
    return F.lit(0) if out is None else out.otherwise(0)


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of every row with base_failed, rule (the first that rejects; 0: none) and kept."""
    stats = stage(statistics(docs), "statistics")
    rules = learn(*contingency(stats, labels))
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
