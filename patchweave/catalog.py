"""Every query of the engine, with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import energy, groups, joins, layout, rollup, sampling, scores
from .operators import select as sel
from .sources import adapters as src
from .sources.adapters import with_views

DAY = 86400.0
SIZE, IPG, PATCH, BLOCK, HB, WB = 32, 4, 1, 2, 8, 8
BUDGET = groups.budget(IPG, HB * WB, BLOCK)
TOP_CAP, TOP_RATE = 8, 1 / DAY / 4

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


# shared pieces of oracle SQL -------------------------------------------------------------------------------------

OK = "ok AS (SELECT video, pts_time, size FROM packet WHERE NOT coalesce(contains(flags, 'K'), false) AND pts_time >= 0 AND size >= 0)"
BINS = f"{OK}, lim AS (SELECT video, greatest(1, ceil((max(pts_time) + 1e-9) / {DAY}))::BIGINT AS nb FROM ok GROUP BY 1), hit AS (SELECT video, least(nb - 1, floor(pts_time / {DAY})::BIGINT) AS bin, sum(ln(1 + size)) AS e FROM ok JOIN lim USING (video) GROUP BY ALL), dense AS (SELECT l.video, b.bin, l.nb, coalesce(h.e, 0) AS e FROM (SELECT video, nb, unnest(range(nb)) AS bin FROM lim) b JOIN lim l USING (video) LEFT JOIN hit h ON h.video = b.video AND h.bin = b.bin), bins AS (SELECT video, bin, (bin + 0.5) * {DAY} AS center_sec, CASE WHEN nb > 1 THEN avg(e) OVER (PARTITION BY video ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) ELSE e END AS energy FROM dense)"
# videos whose rate follows from their packets
RATED = "rated AS (SELECT video, total_frames, total_frames / greatest(duration, 1.0) AS fps FROM videos)"
PEAKS = f"{BINS}, {RATED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY round(energy, 6) DESC, bin) AS r FROM bins), top AS (SELECT k.*, fps, total_frames FROM ranked k JOIN rated USING (video) WHERE r <= least({TOP_CAP}, greatest(1, round_even(total_frames / fps * {TOP_RATE!r}, 0)))), peaks AS (SELECT DISTINCT video, greatest(0, least(greatest(0, least(round_even(center_sec * fps, 0)::BIGINT, total_frames - 1)) + d, total_frames - 1)) AS frame_id FROM top, (VALUES (-1), (0), (1)) o(d))"
SCORED = "block AS (SELECT video, t, (i // 2) * 4 + j // 2 AS block_idx, i // 2 AS bh, j // 2 AS bw, sum(cost) AS score FROM grid GROUP BY ALL)"
GROUPED = f"{SCORED}, g0 AS (SELECT *, t // {SIZE} AS group_idx, (t // {SIZE}) * {SIZE} AS anchor_t FROM block), g AS (SELECT * FROM (SELECT *, max(t) OVER (PARTITION BY video, group_idx) - anchor_t + 1 AS frame_count FROM g0) WHERE frame_count >= 4)"
TOPK = f"{GROUPED}, sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video, group_idx ORDER BY round(score, 6) DESC, t, block_idx) AS rank FROM g WHERE t <> anchor_t) WHERE rank <= {BUDGET})"


def _blocks(spark, sf):
    return scores.block_scores(src.grid(spark, sf), PATCH, BLOCK, WB)


def _grouped(spark, sf):
    return sel.grouped(_blocks(spark, sf), SIZE)


def _topk(spark, sf):
    return sel.topk(_grouped(spark, sf), BUDGET)


def _rated(spark, sf):
    return src.videos(spark, sf).select("video", "total_frames", (F.col("total_frames") / F.greatest("duration", F.lit(1.0))).alias("fps"))


def _bins(spark, sf):
    return energy.energy_bins(src.packet(spark, sf), DAY, 1)


# packets and samplers ---------------------------------------------------------------------------------------------


@query("packet_filter_counters", with_views("SELECT video, count(*) AS total, count(*) FILTER (contains(flags, 'K')) AS dropped_key, count(*) FILTER (NOT contains(flags, 'K') AND pts_time IS NULL) AS dropped_time, count(*) FILTER (NOT contains(flags, 'K') AND pts_time IS NOT NULL AND size IS NULL) AS dropped_size, count(*) FILTER (NOT contains(flags, 'K') AND pts_time >= 0 AND size >= 0) AS kept FROM packet GROUP BY video", "packet"))
def packet_filter_counters(spark, sf):
    return energy.validity_counters(src.packet(spark, sf))


@query("packet_energy_bins", with_views(f"{BINS} SELECT video, bin, center_sec, round(energy, 6) AS energy FROM bins", "packet"))
def packet_energy_bins(spark, sf):
    return r6(_bins(spark, sf), "energy")


@query("window_packet_sum", with_views(f"win AS (SELECT video, w AS win, w * 2 * {DAY} AS start FROM (SELECT DISTINCT video FROM packet), range(0, 15) x(w)) SELECT win.video, win.win, round(coalesce(sum(size), 0), 4) AS total FROM win LEFT JOIN packet p ON p.video = win.video AND p.pts_time >= win.start AND p.pts_time < win.start + {DAY} GROUP BY ALL", "packet"))
def window_packet_sum(spark, sf):
    p = src.packet(spark, sf)
    windows = p.select("video").distinct().select("video", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(14).cast("long"))).alias("win")).select("video", "win", (F.col("win") * 2 * DAY).alias("start"), F.lit(DAY).alias("dur"))
    return energy.window_sizes(p, windows).withColumn("total", F.round("total", 4))


@query("peak_frames", with_views(f"{PEAKS} SELECT video, frame_id FROM peaks", "packet", "videos"))
def peak_frames(spark, sf):
    return energy.peak_frames(_bins(spark, sf), _rated(spark, sf), TOP_RATE, TOP_CAP)


FPS_SQL = "fps_s AS (SELECT video, t, greatest(0, least(round_even(t / 2.0::DOUBLE * fps, 0)::BIGINT, total_frames - 1)) AS frame_id FROM (SELECT *, unnest(range(greatest(1, ceil(total_frames / fps * 2.0))::INT)) AS t FROM videos))"


@query("sample_fps", with_views(f"{FPS_SQL} SELECT * FROM fps_s", "packet", "videos"))
def sample_fps(spark, sf):
    return sampling.sample_fps(src.videos(spark, sf), 2.0)


UNIFORM = "uni AS (SELECT video, t, CASE WHEN t = 15 THEN total_frames - 1 ELSE trunc(t * ((total_frames - 1) / 15.0::DOUBLE))::BIGINT END AS frame_id FROM (SELECT *, unnest(range(16)) AS t FROM videos))"


@query("sample_uniform", with_views(f"{UNIFORM} SELECT * FROM uni", "packet", "videos"))
def sample_uniform(spark, sf):
    return sampling.sample_uniform(src.videos(spark, sf), 16)


@query("sample_all", with_views("SELECT video, unnest(range(total_frames)) AS t, unnest(range(total_frames)) AS frame_id FROM videos", "packet", "videos"))
def sample_all(spark, sf):
    return sampling.sample_all(src.videos(spark, sf))


#: Every seventh video has no frames.
SOME_EMPTY = "emptied AS (SELECT video, CASE WHEN video % 7 = 0 THEN 0 ELSE total_frames END AS total_frames FROM videos)"


def _some_empty(spark, sf):
    return src.videos(spark, sf).withColumn("total_frames", F.when(F.col("video") % 7 == 0, 0).otherwise(F.col("total_frames")))


@query("sample_all_without_frames", with_views(f"{SOME_EMPTY} SELECT video, unnest(range(greatest(1, total_frames)))::INT AS t, unnest(range(greatest(1, total_frames))) AS frame_id FROM emptied", "packet", "videos"))
def sample_all_without_frames(spark, sf):
    return sampling.sample_all(_some_empty(spark, sf))


@query("sample_uniform_without_frames", with_views(f"{SOME_EMPTY} SELECT video, t, CASE WHEN t = 15 THEN greatest(1, total_frames) - 1 ELSE trunc(t * ((greatest(1, total_frames) - 1) / 15.0::DOUBLE))::BIGINT END AS frame_id FROM (SELECT *, unnest(range(16)) AS t FROM emptied)", "packet", "videos"))
def sample_uniform_without_frames(spark, sf):
    return sampling.sample_uniform(_some_empty(spark, sf), 16)


@query("sample_fps_plus_peak", with_views(f"{PEAKS}, {FPS_SQL}, both_ AS (SELECT video, frame_id FROM peaks UNION SELECT video, frame_id FROM fps_s) SELECT video, row_number() OVER (PARTITION BY video ORDER BY frame_id) - 1 AS t, frame_id FROM both_", "packet", "videos"))
def sample_fps_plus_peak(spark, sf):
    return sampling.union_distinct(sample_fps(spark, sf), peak_frames(spark, sf))


KEYS = "keys AS (SELECT video, t AS frame_id FROM frame_seq WHERE pict_type = 'I')"
SHIFT = f"{KEYS}, {UNIFORM}, off AS (SELECT * FROM (VALUES (0, 1), (1, -1), (2, 2), (3, -2), (4, 3), (5, -3), (6, 4), (7, -4)) o(o, d)), tries AS (SELECT u.video, u.t, u.frame_id + d AS cand, o FROM uni u JOIN keys k ON k.video = u.video AND k.frame_id = u.frame_id, off), free AS (SELECT t.video, t.t, arg_min(cand, o) AS moved FROM tries t JOIN videos v USING (video) WHERE cand >= 0 AND cand < total_frames AND NOT EXISTS (SELECT 1 FROM keys k WHERE k.video = t.video AND k.frame_id = cand) GROUP BY ALL), shifted AS (SELECT u.video, u.t, coalesce(moved, u.frame_id) AS frame_id FROM uni u LEFT JOIN free f ON f.video = u.video AND f.t = u.t)"


def _keys(spark, sf):
    return src.frame_seq(spark, sf).filter("pict_type = 'I'").select("video", F.col("t").alias("frame_id"))


@query("shift_keyframes", with_views(f"{SHIFT} SELECT * FROM shifted", "packet", "videos", "frame_seq"))
def shift_keyframes(spark, sf):
    return sampling.shift_off_keyframes(sample_uniform(spark, sf), _keys(spark, sf), src.videos(spark, sf))


REFILL = f"{SHIFT}, sz AS (SELECT video, count(*) AS want, count(DISTINCT frame_id) AS have FROM shifted GROUP BY 1), kept AS (SELECT DISTINCT video, frame_id FROM shifted JOIN sz USING (video) WHERE want > have), pool AS (SELECT v.video, f.frame_id, v.total_frames, want - have AS lack, k.frame_id IS NULL AS free, (SELECT min(abs(q.frame_id - f.frame_id)) FROM kept q WHERE q.video = v.video) AS gap FROM videos v JOIN sz USING (video) JOIN (SELECT video, unnest(range(total_frames)) AS frame_id FROM videos) f ON f.video = v.video LEFT JOIN keys k ON k.video = f.video AND k.frame_id = f.frame_id WHERE want > have AND NOT EXISTS (SELECT 1 FROM kept q WHERE q.video = f.video AND q.frame_id = f.frame_id)), added AS (SELECT video, frame_id FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY CASE WHEN free THEN 0 ELSE 1 END, CASE WHEN free THEN gap END, CASE WHEN free THEN abs(frame_id - total_frames // 2) END, frame_id) AS r FROM pool) WHERE r <= lack), filled AS (SELECT video, row_number() OVER (PARTITION BY video ORDER BY frame_id) - 1 AS t, frame_id FROM (SELECT * FROM kept UNION SELECT * FROM added))"


@query("dedup_refill", with_views(f"{REFILL} SELECT * FROM filled UNION ALL SELECT s.video, t, frame_id FROM shifted s JOIN sz USING (video) WHERE want = have", "packet", "videos", "frame_seq"))
def dedup_refill(spark, sf):
    return sampling.refill(shift_keyframes(spark, sf), _keys(spark, sf), src.videos(spark, sf))


@query("split_segments", with_views(f"{UNIFORM}, s AS (SELECT *, unnest(range(3)) AS i FROM uni) SELECT video, t, frame_id, i AS segment FROM s WHERE t >= round_even(i * 16 / 3.0::DOUBLE, 0) AND t < round_even((i + 1) * 16 / 3.0::DOUBLE, 0)", "packet", "videos"))
def split_segments(spark, sf):
    return sampling.split_segments(sample_uniform(spark, sf), 3)


CDF_SAMPLE = f"{BINS}, v AS (SELECT video, count(*)::INT AS n, count(*) / greatest(max(pts_time), 1.0) AS fps FROM packet GROUP BY 1), es AS (SELECT video, CASE WHEN avg(greatest(energy, 0)) > 0 THEN avg(greatest(energy, 0)) ELSE 1.0 END AS m FROM bins GROUP BY 1), w0 AS (SELECT b.video, bin, greatest(0.7::DOUBLE * greatest(energy, 0) + 0.3::DOUBLE * m, 1e-12) AS w FROM bins b JOIN es ON es.video = b.video), w1 AS (SELECT *, w / sum(w) OVER (PARTITION BY video) * 16 AS share FROM w0), w2 AS (SELECT *, least(floor(share)::BIGINT, 16) AS c, row_number() OVER (PARTITION BY video ORDER BY round(share - floor(share), 9) DESC, bin) AS r FROM w1), w3 AS (SELECT *, c + CASE WHEN r <= 16 - sum(c) OVER (PARTITION BY video) THEN 1 ELSE 0 END AS k FROM w2), w4 AS (SELECT w3.video, k, n, greatest(0, least(n - 1, floor(bin * {DAY} * fps)::BIGINT)) AS lo, greatest(0, least(n - 1, ceil((bin + 1) * {DAY} * fps)::BIGINT - 1)) AS hi0 FROM w3 JOIN v ON v.video = w3.video), w5 AS (SELECT *, unnest(range(CASE WHEN hi = lo THEN 1 ELSE k END)) AS i FROM (SELECT *, greatest(lo, hi0) AS hi FROM w4 WHERE k > 0)), dealt AS (SELECT video, CASE WHEN k = 1 OR hi = lo THEN round_even((lo + hi) / 2.0::DOUBLE, 0)::BIGINT WHEN i = k - 1 THEN hi ELSE trunc(lo + i * ((hi - lo) / (k - 1)::DOUBLE))::BIGINT END AS frame_id FROM w5), short AS (SELECT v.video, n, 16 - (SELECT count(*) FROM dealt d WHERE d.video = v.video) AS lack FROM v JOIN es ON es.video = v.video), filled AS (SELECT * FROM dealt UNION ALL SELECT video, CASE WHEN lack = 1 THEN 0 WHEN i = lack - 1 THEN n - 1 ELSE trunc(i * ((n - 1) / (lack - 1)::DOUBLE))::BIGINT END FROM (SELECT *, unnest(range(lack)) AS i FROM short WHERE lack > 0))"


@query("energy_cdf_sample", with_views(f"{CDF_SAMPLE} SELECT video, row_number() OVER (PARTITION BY video ORDER BY frame_id) - 1 AS t, frame_id FROM filled", "packet"))
def energy_cdf_sample(spark, sf):
    v = src.packet(spark, sf).groupBy("video").agg(F.count("*").cast("int").alias("total_frames"), (F.count("*") / F.greatest(F.max("pts_time"), F.lit(1.0))).alias("fps"))
    return sampling.sample_energy_cdf(_bins(spark, sf), v, DAY, 16)


@query("cover_time", with_views(f"{UNIFORM}, c AS (SELECT video, greatest(0, least(round_even((b + 0.5) * 0.5 * fps, 0)::BIGINT, total_frames - 1)) AS frame_id FROM (SELECT *, unnest(range(least(24, greatest(1, floor(total_frames / fps / 0.5 + 1e-9)))::INT)) AS b FROM videos)), u AS (SELECT video, frame_id FROM uni UNION SELECT video, frame_id FROM c), a AS (SELECT x.video, (SELECT count(*) FROM u y WHERE y.video = x.video AND y.frame_id < x.frame_id) AS t, x.frame_id FROM u x), k AS (SELECT * FROM a WHERE t < 24), s AS (SELECT video, last_, x.t FROM (SELECT video, max(frame_id) AS last_ FROM k GROUP BY 1), range(24) x(t)) SELECT s.video, s.t, coalesce(k.frame_id, last_) AS frame_id FROM s LEFT JOIN k ON k.video = s.video AND k.t = s.t", "packet", "videos"))
def cover_time(spark, sf):
    return sampling.cover_time(sample_uniform(spark, sf), src.videos(spark, sf), 0.5, 24)


# scores -----------------------------------------------------------------------------------------------------------


@query("patch_scores", with_views("SELECT video, t, i // 2 AS ph, j // 2 AS pw, round(sum(cost), 6) AS score FROM grid GROUP BY ALL", "grid"))
def patch_scores(spark, sf):
    return r6(scores.patch_scores(src.grid(spark, sf), 2), "score")


@query("block_scores", with_views(f"{SCORED} SELECT video, t, block_idx, bh, bw, round(score, 6) AS score FROM block", "grid"))
def block_scores(spark, sf):
    return r6(_blocks(spark, sf), "score")


RESIZE = "px AS (SELECT unnest(range(14)) AS y), ov AS (SELECT floor(y * 8 / 14.0)::INT AS c, y // 2 AS b, count(*) AS n FROM px GROUP BY ALL) SELECT video, t, a.b * 7 + w.b AS block_idx, a.b AS bh, w.b AS bw, round(sum(cost * a.n * w.n), 6) AS score FROM grid JOIN ov a ON a.c = i JOIN ov w ON w.c = j GROUP BY ALL"


@query("resized_block_scores", with_views(RESIZE, "grid"))
def resized_block_scores(spark, sf):
    return r6(scores.resized_block_scores(src.grid(spark, sf), 8, 8, 14, 14, 2), "score")


NORM = "n0 AS (SELECT video, t, i, j, ln(1 + cost) AS x FROM grid), p AS (SELECT video, t, greatest(quantile_cont(x, 0.99), 1e-6) AS p FROM n0 GROUP BY ALL), norm AS (SELECT n0.video, n0.t, i, j, least(1.0, x / p) AS cost FROM n0 JOIN p ON p.video = n0.video AND p.t = n0.t)"


@query("score_normalize_p99", with_views(f"{NORM} SELECT video, t, i, j, round(cost, 6) AS cost FROM norm", "grid"))
def score_normalize_p99(spark, sf):
    return r6(scores.normalised(src.grid(spark, sf)), "cost")


KIND = "CASE WHEN t % 16 = 0 THEN 'I' ELSE 'P' END"


@query("iframe_clip", with_views(f"cap AS (SELECT video, quantile_cont(cost, 0.9) AS cap FROM grid WHERE {KIND} <> 'I' GROUP BY 1) SELECT g.video, t, i, j, round(CASE WHEN {KIND} = 'I' THEN least(cost, coalesce(cap, cost)) ELSE cost END, 6) AS cost, {KIND} = 'I' AND cap IS NOT NULL AND cost > cap AS changed FROM grid g LEFT JOIN cap ON cap.video = g.video", "grid"))
def iframe_clip(spark, sf):
    g = src.grid(spark, sf)
    kinds = g.select("video", "t").distinct().withColumn("pict_type", F.expr(KIND))
    return r6(scores.clip_iframes(g, kinds, 0.9), "cost")


@query("frame_mean_floor", with_views(f"{SCORED}, m AS (SELECT video, t, avg(score) AS m FROM block GROUP BY ALL), r AS (SELECT video, quantile_cont(m, 0.5) AS ref FROM m GROUP BY 1) SELECT b.video, b.t, block_idx, bh, bw, round(score * least(1.0, ref / greatest(m, greatest(1e-6, 0.5 * ref))), 6) AS score FROM block b JOIN m ON m.video = b.video AND m.t = b.t JOIN r ON r.video = b.video", "grid"))
def frame_mean_floor(spark, sf):
    return r6(scores.frame_mean_floor(_blocks(spark, sf), 0.5), "score").select("video", "t", "block_idx", "bh", "bw", "score")


@query("bitcost_distribute", "SELECT l_orderkey * 10 + l_linenumber AS unit, unnest(range(greatest(1, l_quantity::INT))) AS cell, l_extendedprice / greatest(1, l_quantity::INT) AS share FROM lineitem")
def bitcost_distribute(spark, sf):
    units = src.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("unit"), F.greatest(F.lit(1), F.col("l_quantity").cast("int")).alias("n"), F.col("l_extendedprice").alias("c"))
    return scores.distribute(units, "n", "c")


# groups -----------------------------------------------------------------------------------------------------------


@query("fixed_groups", with_views(f"SELECT video, t // {SIZE} AS group_idx, min(t) AS start, max(t) + 1 AS \"end\", count(*) AS frame_count, 'fixed_group_size' AS stop_reason FROM (SELECT DISTINCT video, t FROM grid) GROUP BY ALL", "grid"))
def fixed_groups(spark, sf):
    return groups.fixed_groups(src.grid(spark, sf).select("video", "t").distinct(), SIZE)


NB = 4
EDGE = "CASE WHEN {k} = 4 THEN greatest(2, len) ELSE trunc(1 + {k} * ((greatest(2, len) - 1) / 4.0::DOUBLE))::INT END"
IN_BIN = " ".join(f"WHEN t_rel >= ({EDGE.format(k=k)}) AND t_rel < greatest(({EDGE.format(k=k + 1)}), ({EDGE.format(k=k)}) + 1) THEN {k}" for k in range(NB))
STATS = f"{SCORED}, s0 AS (SELECT *, t // {SIZE} AS group_idx, t % {SIZE} AS t_rel FROM block), sp AS (SELECT video, group_idx, max(t_rel) + 1 AS len, count(*) FILTER (t_rel >= 1) AS cand FROM s0 GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY video, group_idx ORDER BY round(score, 6) DESC, t, block_idx) AS r FROM s0 WHERE t_rel >= 1), tp AS (SELECT rk.*, len, CASE {IN_BIN} END AS b FROM rk JOIN sp USING (video, group_idx) WHERE r <= {BUDGET}), ag AS (SELECT video, group_idx, sum(score) AS s, count(*) AS k, count(DISTINCT b) AS nb, count(DISTINCT t) AS nf FROM tp GROUP BY ALL), stats AS (SELECT sp.video, sp.group_idx, cand AS candidate_block_count, round(coalesce(s, 0), 6) AS topk_sum, round(coalesce(s / k, 0), 6) AS topk_mean, round(coalesce(s / len, 0), 6) AS density, coalesce(nb, 0) AS selected_time_bins, round(coalesce(nb, 0) / 4.0, 6)::DOUBLE AS time_bin_ratio, coalesce(nf, 0) AS unique_frames, round(coalesce(nf, 0) / greatest(len - 1, 1), 6) AS unique_ratio, len AS frame_count FROM sp LEFT JOIN ag ON ag.video = sp.video AND ag.group_idx = sp.group_idx)"


@query("readiness_stats", with_views(f"{STATS} SELECT * FROM stats", "grid"))
def readiness_stats(spark, sf):
    return groups.readiness_stats(_blocks(spark, sf), SIZE, BUDGET, NB)


@query("readiness_threshold", with_views(f"{STATS} SELECT video, round(coalesce(avg(CASE WHEN frame_count >= 5 THEN topk_sum END), 0), 6) AS threshold FROM stats GROUP BY 1", "grid"))
def readiness_threshold(spark, sf):
    return groups.readiness_threshold(readiness_stats(spark, sf), NB)


SPREAD = ", ".join(f"CASE WHEN count(*) FILTER (t_rel >= ({EDGE.format(k=k)}) AND t_rel < greatest(({EDGE.format(k=k + 1)}), ({EDGE.format(k=k)}) + 1)) > 0 THEN 1 ELSE 0 END AS h{k}" for k in range(NB))
READY = f"{STATS}, th AS (SELECT video, round(coalesce(avg(CASE WHEN frame_count >= 5 THEN topk_sum END), 0), 6) AS threshold FROM stats GROUP BY 1), fc AS (SELECT video, max(t) + 1 AS n FROM block GROUP BY 1), win AS (SELECT video, n, s, unnest(range(least(n, s + 8), least(n, s + 40) + 1)) AS e FROM (SELECT *, unnest(range(0, n - 7)) AS s FROM fc WHERE n >= 8)), wr AS (SELECT w.video, w.n, s, e, b.t - s AS t_rel, e - s AS len, score, row_number() OVER (PARTITION BY w.video, s, e ORDER BY round(score, 6) DESC, b.t, block_idx) AS r FROM win w JOIN block b ON b.video = w.video AND b.t > s AND b.t < e), wt AS (SELECT video, n, s, e, len, sum(score) AS total, {SPREAD} FROM wr WHERE r <= {BUDGET} GROUP BY video, n, s, e, len), wp AS (SELECT wt.*, (total - lag(total) OVER w) / greatest(abs(lag(total) OVER w), 1e-6) AS delta, total >= threshold AND h0 + h1 + h2 + h3 >= 3 AS pass FROM wt JOIN th ON th.video = wt.video WINDOW w AS (PARTITION BY wt.video, s ORDER BY e)), jump AS MATERIALIZED (SELECT video, n, s, coalesce(min(e) FILTER (pass AND delta < 0.02), max(e) FILTER (pass), max(e)) AS e, CASE WHEN bool_or(pass AND delta < 0.02) THEN 'readiness_threshold_low_gain' WHEN bool_or(pass) THEN 'readiness_threshold' WHEN max(e) = n THEN 'tail_flush' ELSE 'max_group_frames' END AS why FROM wp GROUP BY video, n, s), walk AS (SELECT video, 0 AS g, s, e, why FROM jump WHERE s = 0 UNION ALL SELECT w.video, g + 1, j.s, j.e, j.why FROM walk w JOIN jump j ON j.video = w.video AND j.s = w.e)"


@query("readiness_groups", with_views(f"{READY} SELECT video, g AS group_idx, s AS start, e AS \"end\", e - s AS frame_count, why AS stop_reason FROM walk", "grid", recursive=True))
def readiness_groups(spark, sf):
    return groups.readiness_groups(_blocks(spark, sf), readiness_threshold(spark, sf), BUDGET, 8, 40, NB, 3, 0.02)


@query("readiness_groups_default", with_views(f"{READY.replace('delta < 0.02', 'delta < 0.05')} SELECT video, g AS group_idx, s AS start, e AS \"end\", e - s AS frame_count, why AS stop_reason FROM walk", "grid", recursive=True))
def readiness_groups_default(spark, sf):
    return groups.readiness_groups(_blocks(spark, sf), readiness_threshold(spark, sf), BUDGET, 8, 40, NB, 3)


GOP = "thr AS (SELECT video, quantile_cont(cost, 0.75) AS thr FROM frame_seq GROUP BY 1), walk AS (SELECT f.video, f.t, 0 AS start, NULL::INT AS cut_end, NULL::VARCHAR AS why, NULL::DOUBLE AS sc, 0 AS cut_start FROM frame_seq f WHERE t = 0 UNION ALL SELECT w.video, f.t, CASE WHEN (f.cost > thr AND f.t - w.start >= 4) OR f.t - w.start >= 24 THEN f.t ELSE w.start END, CASE WHEN (f.cost > thr AND f.t - w.start >= 4) OR f.t - w.start >= 24 THEN f.t END, CASE WHEN f.cost > thr AND f.t - w.start >= 4 THEN 'adaptive_gop_cost' WHEN f.t - w.start >= 24 THEN 'adaptive_gop_max_group_frames' END, CASE WHEN (f.cost > thr AND f.t - w.start >= 4) OR f.t - w.start >= 24 THEN f.cost END, w.start FROM walk w JOIN frame_seq f ON f.video = w.video AND f.t = w.t + 1 JOIN thr ON thr.video = w.video), cuts AS (SELECT video, cut_start AS start, cut_end AS \"end\", why AS stop_reason, sc AS split_cost FROM walk WHERE cut_end IS NOT NULL UNION ALL SELECT video, max(start), max(t) + 1, 'adaptive_gop_tail', NULL FROM walk GROUP BY video), gop AS (SELECT video, row_number() OVER (PARTITION BY video ORDER BY start) - 1 AS group_idx, start, \"end\", \"end\" - start AS frame_count, stop_reason, round(split_cost, 6) AS split_cost FROM cuts)"


def _gop(spark, sf):
    return groups.adaptive_gop(src.frame_seq(spark, sf).select("video", "t", "cost"), 75, 4, 24)


@query("adaptive_gop", with_views(f"{GOP} SELECT * FROM gop", "frame_seq", recursive=True))
def adaptive_gop(spark, sf):
    return r6(_gop(spark, sf), "split_cost")


MERGED = f"{GOP}, seq AS (SELECT video, list({{'s': start, 'e': \"end\", 'c': split_cost, 'w': stop_reason}} ORDER BY start) AS l FROM gop GROUP BY video), mg AS (SELECT video, l FROM seq UNION ALL SELECT video, l[:k - 1] || [{{'s': l[k].s, 'e': l[k + 1].e, 'c': l[k].c, 'w': 'adaptive_gop_target_canvas_merge'}}] || l[k + 2:] FROM (SELECT video, l, list_position([coalesce(x.c, 0) for x in l[:len(l) - 1]], list_min([coalesce(x.c, 0) for x in l[:len(l) - 1]])) AS k FROM mg WHERE len(l) > 4)), done AS (SELECT video, arg_min(l, len(l)) AS l FROM mg GROUP BY video), parts AS (SELECT video, unnest(l) AS x, unnest(range(len(l))) AS group_idx FROM done)"


@query("adaptive_gop_merge", with_views(f"{MERGED} SELECT video, group_idx, x.s AS start, x.e AS \"end\", x.e - x.s AS frame_count, x.w AS stop_reason FROM parts", "frame_seq", recursive=True))
def adaptive_gop_merge(spark, sf):
    return groups.merge_gops(_gop(spark, sf), 4)


VGOP = f"{BINS}, es AS MATERIALIZED (SELECT video, list(greatest(energy, 0) ORDER BY bin) AS e0 FROM bins GROUP BY 1), ee AS MATERIALIZED (SELECT video, CASE WHEN list_sum(e0) <= 1e-12 THEN [1.0::DOUBLE for x in e0] ELSE e0 END AS e, e0, len(e0) AS n FROM es), walk AS (SELECT video, e, n, 0 AS b, 0 AS start, 0.0::DOUBLE AS acc, NULL::INT AS g0, NULL::INT AS g1 FROM ee UNION ALL SELECT video, e, n, CASE WHEN hit THEN cut + 1 ELSE b + 1 END, CASE WHEN hit THEN cut + 1 ELSE start END, CASE WHEN hit THEN 0.0 ELSE a2 END, CASE WHEN hit THEN start END, CASE WHEN hit THEN cut END FROM (SELECT *, CASE WHEN least(start + 7, b + 2, n - 2) >= greatest(start + 1, b - 2) THEN list_min([{{'e': e[c + 1], 'd': abs(c - b), 'c': c}} for c in range(greatest(start + 1, b - 2), least(start + 7, b + 2, n - 2) + 1)]).c ELSE b END::INT AS cut, b < n - 1 AND (b - start + 1 >= 8 OR (b - start + 1 >= 2 AND a2 >= list_sum(e) / 6)) AS hit FROM (SELECT *, acc + e[b + 1] AS a2 FROM walk WHERE b < n))), cuts AS (SELECT video, g0, g1 FROM walk WHERE g0 IS NOT NULL UNION ALL SELECT video, max(start), any_value(n) - 1 FROM walk GROUP BY video HAVING max(start) < any_value(n)), od AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY g0) AS k, count(*) OVER (PARTITION BY video) AS m FROM cuts), tl AS (SELECT video, g0 FROM od WHERE k = m AND m > 1 AND (g1 - g0 + 1) * {DAY} < {DAY}), fin AS (SELECT od.video, od.g0, CASE WHEN tl.video IS NOT NULL AND k = m - 1 THEN n - 1 ELSE g1 END AS g1, k, m, tl.video IS NOT NULL AND k = m AS gone, e0 FROM od JOIN ee ON ee.video = od.video LEFT JOIN tl ON tl.video = od.video)"


@query("variable_gops", with_views(f"{VGOP} SELECT video, k - 1 AS gop_idx, g0 AS start_bin, g1 AS end_bin, (g0 + g1) // 2 AS anchor_bin, round(list_sum(e0[g0 + 1:g1 + 1]), 6) AS energy_sum FROM fin WHERE NOT gone", "packet", recursive=True))
def variable_gops(spark, sf):
    return groups.energy_gops(_bins(spark, sf), DAY, 6, 2 * DAY, 8 * DAY)


# selection --------------------------------------------------------------------------------------------------------


@query("topk_blocks", with_views(f"{TOPK} SELECT video, group_idx, rank, t, block_idx, bh, bw, round(score, 6) AS score FROM sel", "grid"))
def topk_blocks(spark, sf):
    return r6(_topk(spark, sf).select("video", "group_idx", "rank", "t", "block_idx", "bh", "bw", "score"), "score")


EVENTS = f"{GROUPED}, cand AS (SELECT * FROM g WHERE t <> anchor_t), fr AS (SELECT video, group_idx, t, ntile(4) OVER (PARTITION BY video, group_idx ORDER BY t) AS bin FROM (SELECT DISTINCT video, group_idx, t FROM cand)), bn AS (SELECT c.*, bin, row_number() OVER (PARTITION BY c.video, c.group_idx, bin ORDER BY round(score, 6) DESC, c.t, block_idx) AS in_bin FROM cand c JOIN fr ON fr.video = c.video AND fr.group_idx = c.group_idx AND fr.t = c.t), rk AS (SELECT *, row_number() OVER (PARTITION BY video, group_idx ORDER BY CASE WHEN in_bin <= 5 THEN bin ELSE 5 END, round(score, 6) DESC, t, block_idx) AS rank FROM bn)"


@query("event_aggregation_topk", with_views(f"{EVENTS} SELECT video, group_idx, rank, t, block_idx, bin, in_bin <= 5 AS reserved FROM rk WHERE rank <= {BUDGET}", "grid"))
def event_aggregation_topk(spark, sf):
    return sel.topk_by_events(_grouped(spark, sf), BUDGET, 4, 5).select("video", "group_idx", "rank", "t", "block_idx", "bin", "reserved")


@query("adaptive_anchor", with_views(f"{GROUPED}, c AS (SELECT video, group_idx, t, anchor_t, frame_count, sum(score) AS c FROM g GROUP BY ALL), l AS (SELECT *, min(c) OVER w AS lo, max(c) OVER w AS hi, (frame_count - 1) / 2.0::DOUBLE AS half FROM c WINDOW w AS (PARTITION BY video, group_idx)), s AS (SELECT *, round(0.3 * (1 - abs(t - anchor_t - half) / greatest(half, 1e-9)) + 0.7 * CASE WHEN hi - lo > 1e-12 THEN 1 - (c - lo) / (hi - lo) ELSE 1.0 END, 6) AS s FROM l) SELECT video, group_idx, t AS anchor_t, s AS anchor_score FROM (SELECT *, row_number() OVER (PARTITION BY video, group_idx ORDER BY s DESC, t) AS r FROM s) WHERE r = 1", "grid"))
def adaptive_anchor(spark, sf):
    return sel.adaptive_anchor(_grouped(spark, sf), 0.3, 0.7)


@query("adaptive_anchor_default", with_views(f"{GROUPED}, c AS (SELECT video, group_idx, t, anchor_t, frame_count, sum(score) AS c FROM g GROUP BY ALL), l AS (SELECT *, min(c) OVER w AS lo, max(c) OVER w AS hi, (frame_count - 1) / 2.0::DOUBLE AS half FROM c WINDOW w AS (PARTITION BY video, group_idx)), s AS (SELECT *, round(0.7 * (1 - abs(t - anchor_t - half) / greatest(half, 1e-9)) + 0.3 * CASE WHEN hi - lo > 1e-12 THEN 1 - (c - lo) / (hi - lo) ELSE 1.0 END, 6) AS s FROM l) SELECT video, group_idx, t AS anchor_t, s AS anchor_score FROM (SELECT *, row_number() OVER (PARTITION BY video, group_idx ORDER BY s DESC, t) AS r FROM s) WHERE r = 1", "grid"))
def adaptive_anchor_default(spark, sf):
    return sel.adaptive_anchor(_grouped(spark, sf))


GOOD = "score > 2.0"


@query("replace_bad_anchor", with_views(f"{GROUPED}, f AS (SELECT video, group_idx, t, anchor_t, max(score) > 2.0 AS good FROM g GROUP BY ALL) SELECT video, group_idx, anchor_t, coalesce(max(t) FILTER (t = anchor_t AND good), min(t) FILTER (good), anchor_t) AS new_anchor_t FROM f GROUP BY video, group_idx, anchor_t", "grid"))
def replace_bad_anchor(spark, sf):
    frames = _grouped(spark, sf).groupBy("video", "group_idx", "t", "anchor_t").agg((F.max("score") > 2.0).alias("good"))
    return sel.replace_bad_anchor(frames)


RANK = "CASE WHEN n > 1 THEN (2 * (rank() OVER (PARTITION BY {by} ORDER BY {v}) - 1) + count(*) OVER (PARTITION BY {by}, {v}) - 1) / (2.0::DOUBLE * (n - 1)) ELSE 1.0 END"


@query("rank01", with_views(f"{SCORED}, v AS (SELECT video, t, block_idx, round(score, 1) AS v, count(*) OVER (PARTITION BY video) AS n FROM block) SELECT video, t, block_idx, round({RANK.format(by='video', v='v')}, 6) AS r FROM v", "grid"))
def rank01(spark, sf):
    v = _blocks(spark, sf).withColumn("v", F.round("score", 1))
    return r6(sel.rank01(v, "v", ["video"], "r").select("video", "t", "block_idx", "r"), "r")


DESC = f"{GROUPED}, d0 AS (SELECT video, t, (i // 2) * 4 + j // 2 AS block_idx, max(cost) FILTER (i % 2 = 0 AND j % 2 = 0) AS a, max(cost) FILTER (i % 2 = 0 AND j % 2 = 1) AS b, max(cost) FILTER (i % 2 = 1 AND j % 2 = 0) AS c, max(cost) FILTER (i % 2 = 1 AND j % 2 = 1) AS e FROM grid GROUP BY ALL), dj AS (SELECT g.*, a, b, c, e FROM g JOIN d0 ON d0.video = g.video AND d0.t = g.t AND d0.block_idx = g.block_idx), dm AS (SELECT *, (abs(a - lag(a) OVER w) + abs(b - lag(b) OVER w) + abs(c - lag(c) OVER w) + abs(e - lag(e) OVER w)) / 4 AS adjacent, first_value(a) OVER w AS fa, first_value(b) OVER w AS fb, first_value(c) OVER w AS fc, first_value(e) OVER w AS fe FROM dj WINDOW w AS (PARTITION BY video, group_idx, block_idx ORDER BY t)), dv AS (SELECT *, round((abs(a - fa) + abs(b - fb) + abs(c - fc) + abs(e - fe)) / 4, 6) AS novelty, round(0.5 * (abs(b - a) + abs(e - c)) / 2 + 0.5 * (abs(c - a) + abs(e - b)) / 2, 6) AS edge, count(*) OVER (PARTITION BY video, group_idx) AS n FROM dm WHERE t <> anchor_t), dr AS (SELECT *, {RANK.format(by='video, group_idx', v='novelty')} AS novelty_rank, {RANK.format(by='video, group_idx', v='edge')} AS edge_rank FROM dv)"


def _diverse(spark, sf):
    return sel.diversity(_grouped(spark, sf), sel.descriptors(src.grid(spark, sf), 2, 8), 0.5, 2)


@query("novelty_edge", with_views(f"{DESC} SELECT video, group_idx, t, block_idx, novelty, edge, round(novelty_rank, 6) AS novelty_rank, round(edge_rank, 6) AS edge_rank FROM dr", "grid"))
def novelty_edge(spark, sf):
    return r6(_diverse(spark, sf).select("video", "group_idx", "t", "block_idx", "novelty", "edge", "novelty_rank", "edge_rank"), "novelty_rank", "edge_rank")


@query("diversity_order", with_views(f"{DESC}, o AS (SELECT *, round(0.5 * novelty_rank + 0.5 * edge_rank, 6) AS diversity FROM dr) SELECT video, group_idx, t, block_idx, diversity, row_number() OVER (PARTITION BY video, group_idx ORDER BY diversity DESC, t, block_idx) AS rank FROM o", "grid"))
def diversity_order(spark, sf):
    order = W.partitionBy("video", "group_idx").orderBy(F.desc("diversity"), "t", "block_idx")
    return _diverse(spark, sf).select("video", "group_idx", "t", "block_idx", "diversity", F.row_number().over(order).alias("rank"))


@query("adjacent_mad", with_views(f"{DESC} SELECT video, group_idx, t, block_idx, round(adjacent, 6) AS adjacent FROM dm WHERE t <> anchor_t", "grid"))
def adjacent_mad(spark, sf):
    return r6(_diverse(spark, sf).select("video", "group_idx", "t", "block_idx", "adjacent"), "adjacent")


MAD_SQL = ", ".join([f"round(quantile_cont(adjacent, {q}), 6) AS p{round(100 * q):02d}" for q in rollup.QUANTILES] + [f"round(avg((adjacent <= {t})::INT), 6) AS cdf_{round(1000 * t):03d}" for t in rollup.MAD_THRESHOLDS])
DIST = f"{DESC}, dist AS (SELECT video, group_idx, count(*) AS n, {MAD_SQL} FROM dm WHERE t <> anchor_t AND adjacent IS NOT NULL GROUP BY ALL)"


@query("mad_cdf", with_views(f"{DIST} SELECT * FROM dist", "grid"))
def mad_cdf(spark, sf):
    return rollup.mad_distribution(_diverse(spark, sf))


LONG = " UNION ALL ".join(f"SELECT video, n, {t}::DOUBLE AS threshold, cdf_{round(1000 * t):03d} AS cdf FROM dist" for t in rollup.MAD_THRESHOLDS)


@query("mad_cdf_by_video", with_views(f"{DIST}, l AS ({LONG}) SELECT video, threshold, round(sum(cdf * n) / sum(n), 5) AS cdf FROM l GROUP BY ALL", "grid"))
def mad_cdf_by_video(spark, sf):
    return rollup.merged_distribution(mad_cdf(spark, sf))


def greedy(cand: str, fraction: float, threshold: float) -> str:
    """CTEs that pick from ``cand`` (video, group_idx, t, block_idx, anchor_t, score, diversity, adjacent) one candidate a step; result: picked."""
    return f"""gc AS MATERIALIZED (SELECT *, (t - anchor_t) * 16 + block_idx AS cid, CASE WHEN lead(t) OVER wb = t + 1 THEN lead(adjacent) OVER wb END AS adjacent_next, row_number() OVER (PARTITION BY video, group_idx ORDER BY round(score, 6) DESC, t, block_idx) AS rc, row_number() OVER (PARTITION BY video, group_idx ORDER BY round(diversity, 6) DESC, t, block_idx) AS rd, count(*) OVER (PARTITION BY video, group_idx) AS n FROM {cand} WINDOW wb AS (PARTITION BY video, group_idx, block_idx ORDER BY t)),
gw AS (SELECT DISTINCT video, group_idx, n, least({BUDGET}, n) AS target, floor(least({BUDGET}, n) * {fraction} + 0.5)::INT AS quota, 1 AS phase, 1 AS pos, []::BIGINT[] AS s1, []::BIGINT[] AS s2, []::BIGINT[] AS s3, []::BIGINT[] AS rej, 0 AS cmp FROM gc
UNION ALL SELECT video, group_idx, n, target, quota, CASE WHEN over_ THEN phase + 1 ELSE phase END, CASE WHEN over_ THEN 1 ELSE pos + 1 END, CASE WHEN pick AND phase = 1 THEN s1 || [cid] ELSE s1 END, CASE WHEN pick AND phase = 2 THEN s2 || [cid] ELSE s2 END, CASE WHEN pick AND phase = 3 THEN s3 || [cid] ELSE s3 END, CASE WHEN free AND dup THEN rej || [cid] ELSE rej END, cmp + CASE WHEN free AND phase < 3 THEN before_::INT + CASE WHEN after_ AND NOT (before_ AND near0) THEN 1 ELSE 0 END ELSE 0 END
FROM (SELECT *, free AND NOT dup AS pick FROM (SELECT *, NOT over_ AND NOT list_contains(taken, cid) AS free, phase < 3 AND ((before_ AND near0) OR (after_ AND near1)) AS dup FROM (SELECT *, pos > n OR len(CASE phase WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s3 END) >= CASE phase WHEN 1 THEN target - quota WHEN 2 THEN CASE WHEN quota > 0 THEN target - len(s1) ELSE 0 END ELSE target - len(s1) - len(s2) END AS over_, coalesce(t - 1 = anchor_t, false) OR list_contains(taken, cid - 16) AS before_, list_contains(taken, cid + 16) AS after_, coalesce(adjacent <= {threshold}, false) AS near0, coalesce(adjacent_next <= {threshold}, false) AS near1 FROM (SELECT w.*, s1 || s2 || s3 AS taken, c.cid, c.t, c.anchor_t, c.adjacent, c.adjacent_next FROM gw w LEFT JOIN gc c ON c.video = w.video AND c.group_idx = w.group_idx AND CASE WHEN w.phase = 2 THEN c.rd ELSE c.rc END = w.pos WHERE w.phase < 4))))),
ge AS (SELECT * FROM gw WHERE phase = 4), go AS (SELECT video, group_idx, unnest(s1) AS cid, 'bitcost' AS origin FROM ge UNION ALL SELECT video, group_idx, unnest(s2), 'diversity' FROM ge UNION ALL SELECT video, group_idx, unnest(s3), 'backfill' FROM ge), picked AS (SELECT gc.*, origin, len(rej) AS rejected, len(list_distinct(rej)) AS rejected_unique, cmp AS comparisons FROM go JOIN gc ON gc.video = go.video AND gc.group_idx = go.group_idx AND gc.cid = go.cid JOIN ge ON ge.video = go.video AND ge.group_idx = go.group_idx)"""


MIXED = f"{DESC}, dz AS (SELECT *, round(0.5 * novelty_rank + 0.5 * edge_rank, 6) AS diversity FROM dr), {greedy('dz', 0.10, 0.025)}"


@query("diverse_mixed_select", with_views(f"{MIXED} SELECT video, group_idx, t, block_idx, round(score, 6) AS score, origin FROM picked", "grid", recursive=True))
def diverse_mixed_select(spark, sf):
    return r6(sel.diverse_mixed(_diverse(spark, sf), BUDGET), "score")


@query("penalised_scores", with_views(f"{SCORED}, p AS (SELECT *, row_number() OVER (PARTITION BY video, t ORDER BY round(score, 6) DESC, block_idx) AS nth FROM block) SELECT video, t, block_idx, nth, round(score / sqrt(1 + 0.5 * (nth - 1)), 6) AS penalised FROM p", "grid"))
def penalised_scores(spark, sf):
    return r6(sel.penalised(_blocks(spark, sf), 0.5).select("video", "t", "block_idx", "nth", "penalised"), "penalised")


# layout -----------------------------------------------------------------------------------------------------------

PLACED = f"{TOPK}, allb AS (SELECT video, group_idx, t, bh, bw, 0 AS part FROM g WHERE t = anchor_t UNION ALL SELECT video, group_idx, t, bh, bw, 1 FROM sel), rr AS (SELECT *, row_number() OVER (PARTITION BY video, group_idx ORDER BY part, t, bh, bw) - 1 AS r FROM allb), placed AS (SELECT video, group_idx, r // 16 AS canvas_idx, ((r % 16) // 4) * 2 + k // 2 AS patch_h, ((r % 16) % 4) * 2 + k % 2 AS patch_w, t AS src_frame, bh * 2 + k // 2 AS src_patch_h, bw * 2 + k % 2 AS src_patch_w FROM rr, range(4) x(k))"


def _placed(spark, sf):
    return layout.placements(_grouped(spark, sf), _topk(spark, sf), BLOCK, HB, WB)


@query("canvas_placement", with_views(f"{PLACED} SELECT * FROM placed", "grid"))
def canvas_placement(spark, sf):
    return _placed(spark, sf)


PADDED = f"{PLACED}, fullc AS (SELECT DISTINCT video, group_idx, canvas_idx, n // 8 AS patch_h, n % 8 AS patch_w FROM placed, range(64) x(n)), padded AS (SELECT f.*, coalesce(src_frame, -1) AS src_frame, coalesce(src_patch_h, -1) AS src_patch_h, coalesce(src_patch_w, -1) AS src_patch_w FROM fullc f LEFT JOIN placed USING (video, group_idx, canvas_idx, patch_h, patch_w))"


def _padded(spark, sf):
    return layout.padded(_placed(spark, sf), HB, WB)


@query("canvas_padding", with_views(f"{PADDED} SELECT * FROM padded", "grid"))
def canvas_padding(spark, sf):
    return _padded(spark, sf)


@query("drop_padding", with_views(f"{PADDED} SELECT * FROM padded QUALIFY bool_or(src_frame >= 0) OVER (PARTITION BY video, group_idx, canvas_idx)", "grid"))
def drop_padding(spark, sf):
    return layout.drop_padding(_padded(spark, sf), check=False)


LAYOUT = f"{PADDED}, lay AS (SELECT *, canvas_idx * 64 + ((patch_h // 2) * 4 + patch_w // 2) * 4 + (patch_h % 2) * 2 + patch_w % 2 AS layout_pos FROM padded)"


@query("block_layout", with_views(f"{LAYOUT} SELECT * FROM lay", "grid"))
def block_layout(spark, sf):
    return layout.block_layout(_padded(spark, sf), HB, WB, BLOCK)


@query("timestamp_runs", with_views(f"{LAYOUT}, isl AS (SELECT *, CASE WHEN src_frame <> lag(src_frame) OVER w OR lag(src_frame) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM lay WINDOW w AS (PARTITION BY video, group_idx ORDER BY layout_pos)), rn AS (SELECT *, sum(new) OVER (PARTITION BY video, group_idx ORDER BY layout_pos) AS run FROM isl) SELECT video, group_idx, run::BIGINT AS run, any_value(src_frame) AS src_frame, printf('<%.1f seconds>', any_value(src_frame) / 25.0::DOUBLE) AS label, count(*) // 4 AS tokens FROM rn GROUP BY video, group_idx, run HAVING any_value(src_frame) >= 0 AND count(*) // 4 > 0", "grid"))
def timestamp_runs(spark, sf):
    return layout.timestamp_runs(block_layout(spark, sf), 25.0, 2)


# roll-ups ---------------------------------------------------------------------------------------------------------

ENT = f"{TOPK}, pf AS (SELECT video, group_idx, t, count(*) AS n, sum(score) AS s FROM sel GROUP BY ALL), pp AS (SELECT *, n / sum(n) OVER (PARTITION BY video, group_idx) AS p FROM pf), ae AS (SELECT video, group_idx, sum(n)::BIGINT AS selected_blocks, sum(s) / sum(n) AS ms, count(*) AS unique_frames, -sum(p * ln(p)) AS h, max(p) AS mp FROM pp GROUP BY ALL), pos AS (SELECT video, group_idx, count(DISTINCT block_idx) AS unique_positions FROM sel GROUP BY ALL), ng AS (SELECT video, group_idx, count(DISTINCT t) AS n_good FROM g WHERE t <> anchor_t GROUP BY ALL), est AS (SELECT ae.video, ae.group_idx, selected_blocks, round(ms, 6) AS mean_score, unique_frames, unique_positions, round(h, 6) AS entropy, round(CASE WHEN ln(greatest(1, n_good)) > 0 THEN h / ln(greatest(1, n_good)) ELSE 0.0 END, 6) AS normalized_entropy, round(mp, 6) AS max_frame_share FROM ae JOIN pos USING (video, group_idx) JOIN ng USING (video, group_idx))"


@query("entropy_stats", with_views(f"{ENT} SELECT * FROM est", "grid"))
def entropy_stats(spark, sf):
    frames = _grouped(spark, sf).filter(F.col("t") != F.col("anchor_t")).groupBy("video", "group_idx").agg(F.countDistinct("t").alias("n_good"))
    return rollup.selection_stats(_topk(spark, sf), frames)


SUMMARY = f"{ENT}, summ AS (SELECT video, count(*) AS groups, sum(selected_blocks)::BIGINT AS selected_blocks, round(sum(mean_score * selected_blocks) / sum(selected_blocks), 6) AS mean_score, round(sum(normalized_entropy * selected_blocks) / sum(selected_blocks), 6) AS normalized_entropy, round(sum(max_frame_share * selected_blocks) / sum(selected_blocks), 6) AS max_frame_share, round(avg(unique_frames), 6) AS unique_frames FROM est GROUP BY 1)"


@query("selector_summary", with_views(f"{SUMMARY} SELECT * FROM summ", "grid"))
def selector_summary(spark, sf):
    return rollup.weighted_summary(entropy_stats(spark, sf))


@query("run_summary", with_views(f"{SUMMARY} SELECT count(*) AS videos, sum(groups)::BIGINT AS groups, sum(selected_blocks)::BIGINT AS selected_blocks, round(sum(unique_frames * groups) / sum(groups), 5) AS unique_frames, round(sum(normalized_entropy * groups) / sum(groups), 5) AS normalized_entropy FROM summ", "grid"))
def run_summary(spark, sf):
    return rollup.run_summary(selector_summary(spark, sf))


@query("adjacent_duplicates", with_views(f"{DESC}, sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video, group_idx ORDER BY round(score, 6) DESC, t, block_idx) AS rank FROM g WHERE t <> anchor_t) WHERE rank <= {BUDGET}), tk AS (SELECT video, group_idx, t, block_idx FROM sel UNION SELECT video, group_idx, t, block_idx FROM g WHERE t = anchor_t), pr AS (SELECT a.video, a.group_idx, adjacent FROM tk a JOIN tk b ON b.video = a.video AND b.group_idx = a.group_idx AND b.block_idx = a.block_idx AND b.t = a.t - 1 JOIN dm ON dm.video = a.video AND dm.group_idx = a.group_idx AND dm.t = a.t AND dm.block_idx = a.block_idx) SELECT video, group_idx, count(*) AS pairs, count(*) FILTER (adjacent <= 0.05) AS duplicates, round(count(*) FILTER (adjacent <= 0.05) / count(*), 6) AS duplicate_rate FROM pr GROUP BY ALL", "grid"))
def adjacent_duplicates(spark, sf):
    g = _grouped(spark, sf)
    return rollup.adjacent_pairs(_topk(spark, sf), g.filter(F.col("t") == F.col("anchor_t")), _diverse(spark, sf), 0.05)


@query("eval_grouping_sets", with_views("SELECT CASE grouping_id(duration, question_type) WHEN 3 THEN 'all' WHEN 1 THEN 'duration' ELSE 'question_type' END AS level, coalesce(duration, question_type, 'all') AS value, count(*) AS n, sum(candidate) AS score_sum, round(avg(candidate), 6) AS accuracy FROM eval_sample GROUP BY GROUPING SETS ((), (duration), (question_type))", "eval_sample"))
def eval_grouping_sets(spark, sf):
    return rollup.scores_by_sets(src.eval_sample(spark, sf), "candidate")


MCN = "agg AS (SELECT count(*) AS n, sum(baseline) AS baseline_sum, sum(candidate) AS candidate_sum, count(*) FILTER (candidate > 0.5 AND baseline <= 0.5) AS gained, count(*) FILTER (candidate <= 0.5 AND baseline > 0.5) AS lost FROM eval_sample) SELECT n, baseline_sum, candidate_sum, gained, lost, CASE WHEN gained + lost = 0 THEN 1.0 ELSE round(least(1.0, 2 * (SELECT sum(exp(lgamma(gained + lost + 1) - lgamma(k + 1) - lgamma(gained + lost - k + 1) - (gained + lost) * ln(2.0))) FROM range(0, least(gained, lost) + 1) r(k))), 6) END AS p_value FROM agg"


@query("paired_mcnemar", with_views(MCN, "eval_sample"))
def paired_mcnemar(spark, sf):
    s = src.eval_sample(spark, sf)
    return rollup.paired(s.select("key", F.col("baseline").alias("score")), s.select("key", F.col("candidate").alias("score")))


@query("preprocess_percentiles", "WITH m AS (SELECT o_custkey, max(o_totalprice) AS ms FROM orders GROUP BY 1) SELECT count(*) AS videos, round(quantile_cont(ms, 0.5), 4) AS p50, round(quantile_cont(ms, 0.9), 4) AS p90, round(avg(ms), 4) AS mean, round(sum(ms), 2) AS total FROM m")
def preprocess_percentiles(spark, sf):
    return rollup.preprocess_times(src.audit(spark, sf))


# lookups ----------------------------------------------------------------------------------------------------------


@query("forward_fill", with_views(f"{UNIFORM}, j AS (SELECT u.video, u.t, u.frame_id, f.cost FROM uni u LEFT JOIN frame_seq f ON f.video = u.video AND f.t = u.frame_id AND f.pict_type = 'B'), k AS (SELECT *, last_value(cost IGNORE NULLS) OVER (PARTITION BY video ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, last_value(cost IGNORE NULLS) OVER (PARTITION BY video ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS b FROM j) SELECT video, t, frame_id, round(coalesce(a, b), 6) AS cost, cost IS NULL AS was_missing FROM k", "packet", "videos", "frame_seq"))
def forward_fill(spark, sf):
    decoded = src.frame_seq(spark, sf).filter("pict_type = 'B'").select("video", F.col("t").cast("long").alias("frame_id"), "cost")
    return r6(joins.forward_fill(sample_uniform(spark, sf), decoded, "cost"), "cost")


POINTS = "pts AS (SELECT video, bin AS id, round_even((bin + 0.5) * 5, 0) AS x FROM (SELECT video, unnest(range(12)) AS bin FROM videos))"


def _points(spark, sf):
    return src.videos(spark, sf).select("video", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("id")).withColumn("x", F.bround((F.col("id") + 0.5) * 5))


@query("nearest_anchor", with_views(f"{UNIFORM}, {POINTS} SELECT p.video, p.id, p.x, arg_min(frame_id, (abs(frame_id - x), frame_id)) AS near FROM pts p JOIN uni u ON u.video = p.video GROUP BY ALL", "packet", "videos"))
def nearest_anchor(spark, sf):
    return joins.nearest(_points(spark, sf), sample_uniform(spark, sf))


@query("nearest_keyframe", with_views(f"{KEYS}, {POINTS} SELECT p.video, p.id, p.x, arg_min(frame_id, (abs(frame_id - x), -frame_id)) AS near FROM pts p JOIN keys k ON k.video = p.video GROUP BY ALL", "packet", "videos", "frame_seq"))
def nearest_keyframe(spark, sf):
    keys = _keys(spark, sf)
    return joins.nearest(_points(spark, sf).join(keys.select("video").distinct(), "video", "left_semi"), keys, ties="after")


@query("gop_asof", with_views("k AS (SELECT video, pts_time AS key FROM packet WHERE flags = 'K__'), p AS (SELECT video, pkt_idx AS id, pts_time AS x FROM packet WHERE video IN (SELECT video FROM k)), a AS (SELECT p.*, k.key FROM p ASOF LEFT JOIN k ON p.video = k.video AND p.x >= k.key) SELECT a.video, a.id, round(a.x, 6) AS x, round(coalesce(a.key, f.first_), 6) AS key FROM a JOIN (SELECT video, min(key) AS first_ FROM k GROUP BY 1) f USING (video)", "packet"))
def gop_asof(spark, sf):
    p = src.packet(spark, sf)
    keys = p.filter("flags = 'K__'").select("video", F.col("pts_time").alias("key"))
    points = p.select("video", F.col("pkt_idx").cast("long").alias("id"), F.col("pts_time").alias("x")).join(keys.select("video").distinct(), "video", "left_semi")
    return r6(joins.as_of(points, keys), "x", "key")


@query("realign_check", with_views(f"{UNIFORM}, w AS (SELECT video, frame_id, count(*) AS n_wanted FROM uni GROUP BY ALL), o AS (SELECT video, t AS frame_id, count(*) AS n_got FROM frame_seq WHERE pict_type <> 'I' GROUP BY ALL) SELECT video, frame_id, coalesce(n_wanted, 0) AS n_wanted, coalesce(n_got, 0) AS n_got FROM w FULL JOIN o USING (video, frame_id) WHERE coalesce(n_wanted, 0) <> coalesce(n_got, 0) AND NOT (frame_id = 0 AND coalesce(n_got, 0) = 0)", "packet", "videos", "frame_seq"))
def realign_check(spark, sf):
    got = src.frame_seq(spark, sf).filter("pict_type <> 'I'").select("video", F.col("t").cast("long").alias("frame_id"))
    return joins.realign(sample_uniform(spark, sf).select("video", "frame_id"), got)


# records ----------------------------------------------------------------------------------------------------------


@query("chat_rewrite", r"SELECT conv_id AS id, turn, role, CASE WHEN role = 'user' AND turn <= 1 THEN '<image>' || chr(10) || '<image>' || chr(10) || regexp_replace('<IMAGE> ' || text, '^\s*(?:<image>\s*)+', '', 'i') ELSE text END AS content FROM conversations")
def chat_rewrite(spark, sf):
    c = src.chat(spark, sf)
    tagged = tx.image_tags(F.concat(F.lit("<IMAGE> "), "content"), F.lit(2))
    return c.withColumn("content", F.when((F.col("role") == "user") & (F.col("turn") <= 1), tagged).otherwise(F.col("content")))


JOB = "'/data/' || source || '/' || lang || '/doc ' || doc_id || '.mp4'"


JOBS = f"WITH j AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '/elsewhere/' || doc_id || '.tar.gz' ELSE {JOB} END AS path, CASE WHEN doc_id % 7 = 0 THEN 'given_' || doc_id END AS key, CASE doc_id % 3 WHEN 1 THEN 'sample-' || doc_id WHEN 2 THEN '' END AS id FROM documents), n AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN doc_id || '.tar' ELSE 'doc ' || doc_id END AS stem FROM j)"


@query("key_inference", f"{JOBS} SELECT doc_id, coalesce(key, stem || '__' || substr(sha1(path), 1, 8) || CASE WHEN id <> '' THEN '__' || substr(id, 1, 8) ELSE '' END) AS key, CASE WHEN starts_with(path, '/data/') THEN substr(path, 7, length(path) - 10) END AS mirror, substr(sha1(path), 1, 8) AS sha FROM n")
def key_inference(spark, sf):
    i = F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("/elsewhere/"), i, F.lit(".tar.gz"))).otherwise(F.concat(F.lit("/data/"), "source", F.lit("/"), "lang", F.lit("/doc "), i, F.lit(".mp4")))
    own = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("given_"), i))
    id_ = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("sample-"), i)).when(F.col("doc_id") % 3 == 2, "")
    return src.table(spark, sf, "documents").select("doc_id", tx.key_of(path, own, id_).alias("key"), tx.mirror_key(path, F.lit("/data")).alias("mirror"), tx.sha1_8(path).alias("sha"))


@query("timestamp_format", with_views("f AS (SELECT video, pkt_idx, pts_time, floor(pts_time)::BIGINT AS s FROM packet) SELECT video, pkt_idx, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, (s // 60) % 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS clock, printf('<%d seconds>', s) AS tag FROM f", "packet"))
def timestamp_format(spark, sf):
    p = src.packet(spark, sf)
    return p.select("video", "pkt_idx", tx.clock(F.col("pts_time")).alias("clock"), tx.seconds_tag(F.floor("pts_time"), 0).alias("tag"))


@query("bad_frame_flags", with_views("s AS (SELECT video, t, avg(cost) AS m, stddev_pop(cost) AS sd, max(cost) - min(cost) AS rg FROM grid GROUP BY ALL) SELECT video, t, m <= 0.04 AND sd <= 0.06 AS is_black, sd <= 0.055 AND rg <= 0.2 AS is_solid, (m <= 0.04 AND sd <= 0.06) OR (sd <= 0.055 AND rg <= 0.2) AS is_bad FROM s", "grid"))
def bad_frame_flags(spark, sf):
    s = src.grid(spark, sf).groupBy("video", "t").agg(F.avg("cost").alias("m"), F.stddev_pop("cost").alias("sd"), (F.max("cost") - F.min("cost")).alias("rg"))
    black, solid = (F.col("m") <= 0.04) & (F.col("sd") <= 0.06), (F.col("sd") <= 0.055) & (F.col("rg") <= 0.2)
    return s.select("video", "t", black.alias("is_black"), solid.alias("is_solid"), (black | solid).alias("is_bad"))


from . import catalog_frames, catalog_plans  # noqa: E402, F401  (register their queries)
