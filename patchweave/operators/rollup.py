"""Roll-ups of selections, runs and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import exact_quantiles

GROUP = ["video", "group_idx"]
#: Fixed thresholds of the difference distribution.
MAD_THRESHOLDS = (0.005, 0.01, 0.015, 0.02, 0.025, 0.03, 0.035, 0.04, 0.05, 0.075, 0.1)
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def selection_stats(selected: DataFrame, frames: DataFrame) -> DataFrame:
    """Per group: selected blocks, mean score, frames and places, entropy over frames (raw, normalised), largest share.

    frames(video, group_idx, n_good): good frames but the anchor.
    """
    per = selected.groupBy(*GROUP, "t").agg(F.count("*").alias("n"), F.sum("score").alias("s"))
    total = F.sum("n").over(W.partitionBy(*GROUP))
    p = per.withColumn("p", F.col("n") / total)
    agg = p.groupBy(*GROUP).agg(F.sum("n").alias("selected_blocks"), (F.sum("s") / F.sum("n")).alias("mean_score"), F.count("*").alias("unique_frames"), (-F.sum(F.col("p") * F.log("p"))).alias("entropy"), F.max("p").alias("max_frame_share"))
    places = selected.groupBy(*GROUP).agg(F.countDistinct("block_idx").alias("unique_positions"))
    top = F.log(F.greatest(F.lit(1), F.col("n_good")).cast("double"))
    out = agg.join(places, GROUP).join(frames, GROUP)
    return out.select(*GROUP, "selected_blocks", F.round("mean_score", 6).alias("mean_score"), "unique_frames", "unique_positions", F.round("entropy", 6).alias("entropy"), F.round(F.when(top > 0, F.col("entropy") / top).otherwise(0.0), 6).alias("normalized_entropy"), F.round("max_frame_share", 6).alias("max_frame_share"))


def adjacent_pairs(selected: DataFrame, anchor: DataFrame, adjacent: DataFrame, threshold: float) -> DataFrame:
    """Pairs of taken blocks at one place in frames t - 1 and t, and how many differ by at most the threshold."""
    keys = [*GROUP, "t", "block_idx"]
    taken = selected.select(*keys).union(anchor.select(*keys)).distinct()
    before = taken.select(*GROUP, (F.col("t") + 1).alias("t"), "block_idx")
    pairs = taken.join(before, keys).join(adjacent.select(*keys, "adjacent"), keys)
    dup = F.count_if(F.col("adjacent") <= threshold)
    return pairs.groupBy(*GROUP).agg(F.count("*").alias("pairs"), dup.alias("duplicates"), F.round(dup / F.count("*"), 6).alias("duplicate_rate"))


def mad_distribution(adjacent: DataFrame) -> DataFrame:
    """Per group: count, quantiles and distribution values at fixed thresholds of adjacent differences."""
    a = adjacent.filter("adjacent is not null")
    return a.groupBy(*GROUP).agg(F.count("*").alias("n"), *[F.round(F.percentile("adjacent", F.lit(q)), 6).alias(f"p{round(100 * q):02d}") for q in QUANTILES], *[F.round(F.avg((F.col("adjacent") <= t).cast("double")), 6).alias(f"cdf_{round(1000 * t):03d}") for t in MAD_THRESHOLDS])


def weighted_summary(stats: DataFrame) -> DataFrame:
    """Per video: sums, means weighted by selected blocks, plain means of counts; stats of ``selection_stats``."""
    w = F.col("selected_blocks")
    mean = lambda c: F.round(F.sum(F.col(c) * w) / F.nullif(F.sum(w), F.lit(0)), 6).alias(c)
    return stats.groupBy("video").agg(F.count("*").alias("groups"), F.sum("selected_blocks").alias("selected_blocks"), mean("mean_score"), mean("normalized_entropy"), mean("max_frame_share"), F.round(F.avg("unique_frames"), 6).alias("unique_frames"))


def run_summary(videos: DataFrame) -> DataFrame:
    """Over all videos: sums and means weighted by group count."""
    w = F.col("groups")
    mean = lambda c: F.round(F.sum(F.col(c) * w) / F.nullif(F.sum(w), F.lit(0)), 5).alias(c)
    return videos.agg(F.count("*").alias("videos"), F.sum("groups").alias("groups"), F.sum("selected_blocks").alias("selected_blocks"), mean("unique_frames"), mean("normalized_entropy"))


def merged_distribution(dist: DataFrame) -> DataFrame:
    """Per video: distribution values at each threshold, weighted by the counts of the groups."""
    pairs = F.explode(F.map_from_arrays(F.array(*[F.lit(t) for t in MAD_THRESHOLDS]), F.array(*[F.col(f"cdf_{round(1000 * t):03d}") for t in MAD_THRESHOLDS]))).alias("threshold", "cdf")
    return dist.select("video", "n", pairs).groupBy("video", "threshold").agg(F.round(F.sum(F.col("cdf") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0)), 5).alias("cdf"))


def scores_by_sets(samples: DataFrame, score: str) -> DataFrame:
    """n, sum and accuracy overall, by duration and by question type: one pass of grouping sets; missing values are unknown."""
    named = samples.select(F.coalesce("duration", F.lit("unknown")).alias("duration"), F.coalesce("question_type", F.lit("unknown")).alias("question_type"), F.col(score).alias("s"))
    sets = named.groupingSets([[], ["duration"], ["question_type"]], "duration", "question_type")
    agg = sets.agg(F.grouping_id("duration", "question_type").alias("g"), F.count("*").alias("n"), F.sum("s").alias("score_sum"), F.round(F.avg("s"), 6).alias("accuracy"))
    level = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "duration").otherwise("question_type")
    return agg.select(level.alias("level"), F.coalesce("duration", "question_type", F.lit("all")).alias("value"), "n", "score_sum", "accuracy")


def mcnemar_p(gained, lost):
    """Two-sided exact binomial p: min(1, 2 sum_{k <= min} C(n, k) / 2^n); 1 for n = 0.  Terms by recurrence in logs."""
    n, m = gained + lost, F.least(gained, lost)
    zero = F.struct((-n * F.log(F.lit(2.0))).alias("l"), F.exp(-n * F.log(F.lit(2.0))).alias("s"))
    step = lambda a, k: F.struct((a["l"] + F.log((n - k + 1) / k)).alias("l"), (a["s"] + F.exp(a["l"] + F.log((n - k + 1) / k))).alias("s"))
    ks = F.when(m >= 1, F.sequence(F.lit(1).cast("long"), m)).otherwise(F.array().cast("array<bigint>"))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(ks, zero, step, lambda a: a["s"])))


def paired(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Paired comparison of two runs (key, score); keys that do not match are an error."""
    both = baseline.select("key", F.col("score").alias("b")).join(candidate.select("key", F.col("score").alias("c")), "key", "full")
    both = both.filter(F.when(F.col("b").isNotNull() & F.col("c").isNotNull(), True).otherwise(F.raise_error(F.lit("runs have different keys")).cast("boolean")))
    agg = both.agg(F.count("*").alias("n"), F.sum("b").alias("baseline_sum"), F.sum("c").alias("candidate_sum"), F.count_if((F.col("c") > 0.5) & (F.col("b") <= 0.5)).alias("gained"), F.count_if((F.col("c") <= 0.5) & (F.col("b") > 0.5)).alias("lost"))
    return agg.withColumn("p_value", F.round(mcnemar_p(F.col("gained"), F.col("lost")), 6))


def preprocess_times(audit: DataFrame) -> DataFrame:
    """The longest time of every video, then median, 90th percentile, mean and sum."""
    per = audit.groupBy("video").agg(F.max("subprocess_ms").alias("ms"))
    totals = per.agg(F.count("*").alias("videos"), F.round(F.avg("ms"), 4).alias("mean"), F.round(F.sum("ms"), 2).alias("total"))
    # a row each: an empty table has counts but no quantiles
    both = totals.withColumn("_all", F.lit(0)).join(exact_quantiles(per, [], "ms", {"p50": 0.5, "p90": 0.9}).withColumn("_all", F.lit(0)), "_all", "left")
    return both.select("videos", F.round("p50", 4).alias("p50"), F.round("p90", 4).alias("p90"), "mean", "total")


def audit_repeats(audit: DataFrame) -> DataFrame:
    """How many audit rows repeat a video."""
    return audit.agg((F.count("*") - F.countDistinct(F.coalesce(F.col("video").cast("string"), F.lit("unknown")))).alias("duplicate_audit_rows"))


def group_diagnostics(picked: DataFrame, candidates: DataFrame, measures: DataFrame, threshold: float) -> DataFrame:
    """One row a group with everything the summaries are made of.

    picked: rows of ``select.diverse_counted``; candidates: rows they were picked from, with novelty and edge; measures
    (video, group_idx, t, block_idx, anchor_t, adjacent): all blocks of a group, its anchor's too.
    """
    keys = [*GROUP, "t", "block_idx"]
    full = picked.join(candidates.select(*keys, "novelty", "edge"), keys)
    frames = candidates.groupBy(*GROUP).agg(F.countDistinct("t").alias("n_good"))
    origin = lambda o: F.count_if(F.col("origin") == o).alias(f"{o}_selected")
    counted = full.groupBy(*GROUP).agg(
        F.count("*").alias("target_blocks"), origin("bitcost"), origin("diversity"), origin("backfill"), F.first("rejected").alias("dedup_rejected"), F.first("rejected_unique").alias("dedup_rejected_unique"), F.first("comparisons").alias("dedup_comparisons"),
        F.avg("novelty").alias("selected_novelty_mean"), F.avg("edge").alias("selected_edge_mean"),
    )
    stats = selection_stats(picked, frames).drop("selected_blocks")
    anchors = measures.filter(F.col("t") == F.col("anchor_t"))
    pairs = adjacent_pairs(picked, anchors, measures.filter("adjacent is not null"), threshold)
    near = measures.filter("adjacent is not null").groupBy(*GROUP).agg(
        F.count("*").alias("adjacent_mad_count"), F.avg((F.col("adjacent") <= threshold).cast("double")).alias("adjacent_mad_fraction"), F.map_from_arrays(F.array(*[F.lit(f"{t:.3f}") for t in MAD_THRESHOLDS]), F.array(*[F.avg((F.col("adjacent") <= t).cast("double")) for t in MAD_THRESHOLDS])).alias("adjacent_mad_cdf")
    )
    out = counted.join(stats, GROUP).join(pairs, GROUP, "left").join(near, GROUP, "left")
    return out.na.fill(0, ["pairs", "duplicates", "adjacent_mad_count"]).na.fill(0.0, ["duplicate_rate", "adjacent_mad_fraction"])


def _share(a, b):
    return F.coalesce(F.sum(a) / F.nullif(F.sum(b), F.lit(0)), F.lit(0.0))


COUNTS = ("target_blocks", "bitcost_selected", "diversity_selected", "backfill_selected", "dedup_rejected", "dedup_rejected_unique", "dedup_comparisons")


def full_summary(groups: DataFrame) -> DataFrame:
    """A row a video from ``group_diagnostics``: sums, means by blocks, plain means of counts, the difference distribution by its counts."""
    by_blocks = lambda c, name: F.round(_share(F.col(c) * F.col("target_blocks"), F.col("target_blocks")), 6).alias(name)
    n = F.col("adjacent_mad_count")
    cdf = [F.round(_share(F.coalesce(F.col("adjacent_mad_cdf")[f"{t:.3f}"], F.lit(0.0)) * n, n), 6).alias(f"cdf_{round(1000 * t):03d}") for t in MAD_THRESHOLDS]
    return groups.groupBy("video").agg(
        F.count("*").alias("group_count"), *[F.sum(c).alias(c) for c in COUNTS],
        F.round(F.avg("unique_frames"), 6).alias("mean_unique_source_frames"), F.round(F.avg("unique_positions"), 6).alias("mean_unique_spatial_positions"),
        by_blocks("normalized_entropy", "mean_entropy_normalized"), by_blocks("max_frame_share", "mean_max_frame_share"), F.sum("pairs").alias("adjacent_pairs"), F.sum("duplicates").alias("adjacent_duplicates"),
        F.round(_share(F.col("duplicates"), F.col("pairs")), 6).alias("adjacent_duplicate_rate"), F.sum(n).alias("adjacent_mad_count"), F.round(_share(F.col("adjacent_mad_fraction") * n, n), 6).alias("adjacent_mad_fraction"), *cdf,
        by_blocks("mean_score", "selected_bitcost_mean"), by_blocks("selected_novelty_mean", "selected_novelty_mean"), by_blocks("selected_edge_mean", "selected_edge_mean"),
    )


def full_run_summary(videos: DataFrame) -> DataFrame:
    """One row over all videos of ``full_summary``: counts of groups weigh plain means, blocks and differences the others."""
    by = lambda c, w: F.round(_share(F.col(c) * F.col(w), F.col(w)), 5).alias(c)
    names = [f"cdf_{round(1000 * t):03d}" for t in MAD_THRESHOLDS]
    return videos.agg(
        F.count("*").alias("videos"), F.sum("group_count").alias("groups"), *[F.sum(c).alias(c) for c in COUNTS], by("mean_unique_source_frames", "group_count"), by("mean_unique_spatial_positions", "group_count"),
        by("mean_entropy_normalized", "target_blocks"), by("mean_max_frame_share", "target_blocks"), F.sum("adjacent_pairs").alias("adjacent_pairs"), F.sum("adjacent_duplicates").alias("adjacent_duplicates"),
        F.round(_share(F.col("adjacent_duplicates"), F.col("adjacent_pairs")), 5).alias("adjacent_duplicate_rate"), F.sum("adjacent_mad_count").alias("adjacent_mad_count"), by("adjacent_mad_fraction", "adjacent_mad_count"),
        *[by(c, "adjacent_mad_count") for c in names], by("selected_bitcost_mean", "target_blocks"), by("selected_novelty_mean", "target_blocks"), by("selected_edge_mean", "target_blocks"),
    )
