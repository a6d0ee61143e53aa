"""More queries: samplers of whole parameter sets, anchors and buckets, pixel frames, full summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import BUDGET, DAY, GROUPED, HB, KEYS, LAYOUT, MIXED, PATCH, PEAKS, PLACED, RANK, RATED, TOP_CAP, TOP_RATE, TOPK, UNIFORM, WB, _diverse, _grouped, _keys, _placed, _rated, _topk, greedy, query, r6, sample_uniform
from .catalog import BLOCK as SIDE
from .functions import image
from .operators import anchors, groups, joins, layout, pixels, rollup, sampling, scores
from .operators import select as sel
from .plans import selection
from .sources import adapters as src
from .sources import records
from .sources.adapters import with_views

# samplers ---------------------------------------------------------------------------------------------------------


RARE = f"{PEAKS}, rare AS (SELECT video, t, greatest(0, least(round_even(t / {2 / DAY!r}::DOUBLE * fps, 0)::BIGINT, total_frames - 1)) AS frame_id FROM (SELECT *, unnest(range(greatest(1, ceil(total_frames / fps * {2 / DAY!r}::DOUBLE))::INT)) AS t FROM rated)), pk AS (SELECT video, row_number() OVER (PARTITION BY video ORDER BY frame_id) - 1 AS t, frame_id FROM peaks WHERE video % 2 = 0)"


@query("sample_dispatch", with_views(f"{RARE} SELECT * FROM pk UNION ALL SELECT video, t, frame_id FROM rare WHERE video NOT IN (SELECT video FROM pk)", "packet", "videos"))
def sample_dispatch(spark, sf):
    """Peaks by name; videos without packets fall back to a rate."""
    packets = src.packet(spark, sf).filter("video % 2 = 0")
    return selection.sample(_rated(spark, sf), packets, "pkt_size_peak", rate=2 / DAY, bin_sec=DAY, peaks_per_sec=TOP_RATE, peaks_cap=TOP_CAP)


@query("keyframe_ids", with_views(f"{RATED}, k AS (SELECT p.video, greatest(0, least(round_even(pts_time * fps, 0)::BIGINT, total_frames - 1)) AS frame_id FROM packet p JOIN rated r ON r.video = p.video WHERE contains(flags, 'K') AND pts_time IS NOT NULL) SELECT * FROM k UNION SELECT video, 0 FROM rated WHERE total_frames > 0", "packet", "videos"))
def keyframe_ids(spark, sf):
    return sampling.keyframe_ids(src.packet(spark, sf), _rated(spark, sf))


@query("cap_candidates", with_views(f"{KEYS}, {UNIFORM}, f AS (SELECT s.video, s.frame_id, k.frame_id IS NOT NULL AS peak FROM (SELECT DISTINCT video, frame_id FROM uni) s LEFT JOIN keys k ON k.video = s.video AND k.frame_id = s.frame_id), r AS (SELECT *, row_number() OVER (PARTITION BY video, peak ORDER BY frame_id) - 1 AS r, count(*) OVER (PARTITION BY video, peak) AS n, 6 - count(*) FILTER (peak) OVER (PARTITION BY video) AS need FROM f), k AS (SELECT video, frame_id FROM r WHERE CASE WHEN peak THEN r < 6 ELSE need > 0 AND (n <= need OR list_contains(CASE WHEN need = 1 THEN [0::BIGINT] ELSE [CASE WHEN i = need - 1 THEN n - 1 ELSE trunc(i * ((n - 1) / (need - 1)::DOUBLE))::BIGINT END for i in range(need)] END, r)) END) SELECT video, row_number() OVER (PARTITION BY video ORDER BY frame_id) - 1 AS t, frame_id FROM k", "packet", "videos", "frame_seq"))
def cap_candidates(spark, sf):
    return sampling.cap_candidates(sample_uniform(spark, sf), _keys(spark, sf), 6)


# orders as videos of three sizes and four rates (one of them unknown)
ORDERED = "ov AS (SELECT o_orderkey AS video, (o_totalprice / 100)::INT AS total_frames, CASE o_orderkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 24.0 WHEN 2 THEN 25.0 ELSE 30.0 END::DOUBLE AS fps, CASE o_orderkey % 3 WHEN 0 THEN 1080 WHEN 1 THEN 720 ELSE 360 END AS height, CASE o_orderkey % 3 WHEN 0 THEN 1920 WHEN 1 THEN 1280 ELSE 640 END AS width FROM orders), od AS (SELECT *, CASE WHEN fps > 0 THEN fps ELSE 30.0 END AS rate, CASE WHEN total_frames > 0 THEN total_frames / CASE WHEN fps > 0 THEN fps ELSE 30.0 END ELSE 0.0 END AS sec FROM ov)"
AUTO = "greatest(4, least(CASE WHEN s >= 7000 THEN CASE WHEN sec <= 6 THEN 4 ELSE 8 END WHEN s >= 2500 THEN CASE WHEN sec <= 6 THEN 8 ELSE 12 END ELSE CASE WHEN sec <= 6 THEN 12 ELSE 28 END END, greatest(1, greatest(s, 30000) // s), CASE WHEN sec <= 7 THEN 8 WHEN sec <= 12 THEN 12 ELSE greatest(1, ceil(sec * 1.2)::INT) END) // 4 * 4)"


def _ordered(spark, sf):
    by3 = lambda a, b, c: F.when(F.col("video") % 3 == 0, a).when(F.col("video") % 3 == 1, b).otherwise(c)
    o = src.table(spark, sf, "orders").select(F.col("o_orderkey").alias("video"), F.bround(F.col("o_totalprice").cast("double") / 100).cast("int").alias("total_frames"))
    rate = F.when(F.col("video") % 4 == 0, 0.0).when(F.col("video") % 4 == 1, 24.0).when(F.col("video") % 4 == 2, 25.0).otherwise(30.0)
    return o.withColumn("fps", rate).withColumn("height", by3(1080, 720, 360)).withColumn("width", by3(1920, 1280, 640))


FIT = "CASE WHEN round_even({x} / 28.0, 0) * round_even({y} / 28.0, 0) * 784 > 150000 THEN greatest(28, floor({x} / sqrt(height * width / 150000.0::DOUBLE) / 28) * 28) ELSE greatest(28, round_even({x} / 28.0, 0) * 28) END"
PARAMETERS = f"{ORDERED}, p1 AS (SELECT *, least(greatest(1, least(16, round_even(sec / 8, 0)::INT)), greatest(1, total_frames)) AS num_gops, greatest(1, ({FIT.format(x='height', y='width')} / 14)::INT * ({FIT.format(x='width', y='height')} / 14)::INT) AS s FROM od), p2 AS (SELECT *, greatest(4, greatest(1, {AUTO} * s // s) // 4 * 4, num_gops * 4)::INT AS num_images FROM p1), p3 AS (SELECT *, greatest(64, least(1024, num_images * 8)) AS sl, greatest(5, least(20, ceil(sec / 5)::INT)) AS num_windows FROM p2)"


@query("adaptive_parameters", f"WITH {PARAMETERS} SELECT video, num_gops, num_images, CASE WHEN total_frames > 0 THEN least(sl, greatest(16, total_frames)) ELSE sl END AS seq_len, greatest(32, least((round_even(rate * CASE WHEN sec <= 15 THEN 6.0 WHEN sec <= 60 THEN 10.0 ELSE 12.0 END / 16, 0) * 16)::INT, total_frames)) AS window_len, num_windows, least(greatest(2, least(8, ceil(sec / 20)::INT)), num_windows) AS top_windows FROM p3")
def adaptive_parameters(spark, sf):
    return sampling.adaptive_parameters(_ordered(spark, sf))


@query("auto_budget", f"WITH {ORDERED}, q AS (SELECT *, CASE video % 3 WHEN 0 THEN 8160 WHEN 1 THEN 3680 ELSE 1456 END AS s FROM od) SELECT video, {AUTO}::INT AS images, {AUTO}::BIGINT * s AS patches, least(128, greatest(1, total_frames))::INT AS frames FROM q")
def auto_budget(spark, sf):
    s = F.when(F.col("video") % 3 == 0, 8160).when(F.col("video") % 3 == 1, 3680).otherwise(1456)
    return _ordered(spark, sf).withColumn("b", groups.auto_patches(s, F.col("total_frames"), F.col("fps"))).select("video", "b.images", "b.patches", sampling.sampled_count(F.col("total_frames"), 16, 4, 32).alias("frames"))


WINDOWS = f"{RATED}, wn AS (SELECT *, CASE WHEN i = 4 THEN total_frames - 10 ELSE trunc(i * ((total_frames - 10) / 4.0::DOUBLE))::BIGINT END AS s FROM (SELECT *, unnest(range(5)) AS i FROM rated WHERE total_frames > 10)), sc AS (SELECT w.video, w.total_frames, i, s, trunc(round(coalesce(sum(p.size), 0), 6))::BIGINT AS score FROM wn w LEFT JOIN packet p ON p.video = w.video AND p.pts_time >= s / fps AND p.pts_time < s / fps + 10.0 / fps GROUP BY ALL), win AS (SELECT video, rank, s AS start, least(total_frames - 1, s + 9) AS \"end\", score FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY score DESC, i) AS rank FROM sc) WHERE rank <= 2 UNION ALL SELECT video, 1, 0, greatest(0, total_frames - 1), 0 FROM rated WHERE total_frames <= 10)"


def _windows(spark, sf):
    return sampling.pick_windows(_rated(spark, sf), src.packet(spark, sf), 10, 5, 2)


@query("pick_windows", with_views(f"{WINDOWS} SELECT * FROM win", "packet", "videos"))
def pick_windows(spark, sf):
    return _windows(spark, sf)


@query("allocate_frames", with_views(f"{WINDOWS}, w0 AS (SELECT *, count(*) OVER (PARTITION BY video) AS m, CASE WHEN sum(score) OVER (PARTITION BY video) > 0 THEN score / sum(score) OVER (PARTITION BY video)::DOUBLE ELSE 1.0 / count(*) OVER (PARTITION BY video) END AS w FROM win), w1 AS (SELECT *, greatest(1, floor(w * 8)::BIGINT) AS c FROM w0), w2 AS (SELECT *, (sum(c) OVER (PARTITION BY video))::BIGINT AS total, row_number() OVER (PARTITION BY video ORDER BY c DESC, rank) AS by_c, row_number() OVER (PARTITION BY video ORDER BY w DESC, rank) AS by_w FROM w1), w3 AS (SELECT *, c - CASE WHEN by_c = 1 AND total > 8 THEN total - 8 ELSE 0 END + CASE WHEN by_w = 1 AND total < 8 THEN 8 - total ELSE 0 END AS k FROM w2), ids AS (SELECT video, m, CASE WHEN k = 1 THEN start WHEN i = k - 1 THEN \"end\" ELSE trunc(start + i * ((\"end\" - start) / (k - 1)::DOUBLE))::BIGINT END AS f FROM (SELECT *, unnest(range(CASE WHEN m = 1 THEN 8 ELSE k END)) AS i FROM (SELECT * REPLACE (CASE WHEN m = 1 THEN 8 ELSE k END AS k) FROM w3))), u AS (SELECT video, f FROM ids WHERE m = 1 UNION ALL SELECT DISTINCT video, f FROM ids WHERE m > 1), n AS (SELECT video, row_number() OVER (PARTITION BY video ORDER BY f) - 1 AS t, f, max(f) OVER (PARTITION BY video) AS last_ FROM u), g AS (SELECT video, any_value(last_) AS last_, unnest(range(8)) AS t FROM n GROUP BY video) SELECT g.video, g.t, coalesce(n.f, g.last_) AS frame_id FROM g LEFT JOIN n ON n.video = g.video AND n.t = g.t", "packet", "videos"))
def allocate_frames(spark, sf):
    return sampling.allocate_frames(_windows(spark, sf), 8)


# decoding as lookups ----------------------------------------------------------------------------------------------


@query("decode_lookup", with_views(f"{UNIFORM}, d AS (SELECT video, t AS f, cost FROM frame_seq WHERE pict_type = 'B'), j AS (SELECT u.video, u.t, u.frame_id, d.cost FROM uni u LEFT JOIN d ON d.video = u.video AND d.f = u.frame_id), k AS (SELECT *, last_value(cost IGNORE NULLS) OVER (PARTITION BY video ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a FROM j), nr AS (SELECT k.video, k.t, arg_min(d.cost, (abs(d.f - k.frame_id), d.f)) AS c FROM k JOIN d ON d.video = k.video WHERE a IS NULL GROUP BY k.video, k.t) SELECT k.video, k.t, k.frame_id, round(coalesce(a, c), 6) AS cost, cost IS NULL AS was_missing FROM k LEFT JOIN nr ON nr.video = k.video AND nr.t = k.t", "packet", "videos", "frame_seq"))
def decode_lookup(spark, sf):
    frames = src.frame_seq(spark, sf).filter("pict_type = 'B'").select("video", F.col("t").cast("long").alias("frame_id"), "cost")
    return r6(joins.decoded(sample_uniform(spark, sf), frames, src.videos(spark, sf), "cost"), "cost")


@query("selected_frames", with_views(f"{UNIFORM}, w AS (SELECT video, frame_id - 5 AS frame_id FROM uni UNION ALL SELECT video, frame_id FROM uni WHERE t % 2 = 0), c AS (SELECT video, frame_id, count(*) AS n FROM w WHERE frame_id >= 0 GROUP BY ALL) SELECT c.video, c.frame_id, unnest(range(1, n + 1)) AS copy, round(f.cost, 6) AS cost FROM c JOIN frame_seq f ON f.video = c.video AND f.t = c.frame_id WHERE f.t BETWEEN 3 AND 50", "packet", "videos", "frame_seq"))
def selected_frames(spark, sf):
    u = sample_uniform(spark, sf)
    wanted = u.select("video", (F.col("frame_id") - 5).alias("frame_id")).union(u.filter("t % 2 = 0").select("video", "frame_id"))
    frames = src.frame_seq(spark, sf).select("video", F.col("t").cast("long").alias("frame_id"), "cost")
    return r6(joins.selected(frames, wanted, 3, 50).select("video", "frame_id", "copy", "cost"), "cost")


@query("grid_choice", with_views("SELECT video, t, i, j, round(cost, 6) AS cost FROM grid WHERE video % 3 <> 0 UNION ALL SELECT video, t, i // 4, j // 4, round(sum(cost), 6) FROM grid WHERE video % 3 = 0 GROUP BY ALL", "grid"))
def grid_choice(spark, sf):
    """Large units of one codec, macroblocks of the other."""

    def nested(g, name):
        row = g.groupBy("video", "t", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "cost"))), lambda c: c["cost"]).alias("r"))
        return row.groupBy("video", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda x: x["r"]).alias(name))

    g = src.grid(spark, sf)
    wide = g.groupBy("video", "t", F.floor(F.col("i") / 4).cast("int").alias("i"), F.floor(F.col("j") / 4).cast("int").alias("j")).agg(F.sum("cost").alias("cost"))
    both = nested(g, "mb").join(nested(wide, "ctu"), ["video", "t"])
    frames = both.select("video", "t", F.when(F.col("video") % 3 == 0, "hevc").otherwise("h264").alias("codec_name"), F.struct(F.col("mb").alias("mb_bit_cost"), F.col("ctu").alias("ctu_bit_cost")).alias("bitcost"))
    return r6(scores.grid_cells(frames), "cost")


FUSE = "c AS (SELECT video, t, i, j, abs(floor(cost * 400) - 128) AS r, (i - j) * cost / 4 AS x0, cost * 3 / 4 AS y0, cost * (j - 3) / 4 AS x1, i * cost / 4 AS y1 FROM grid), md AS (SELECT video, t, median(x0) AS a, median(y0) AS b, median(x1) AS c, median(y1) AS d FROM c GROUP BY ALL), m AS (SELECT c.video, c.t, i, j, r, sqrt((x0 - a) ** 2 + (y0 - b) ** 2) + sqrt((x1 - md.c) ** 2 + (y1 - d) ** 2) AS m FROM c JOIN md ON md.video = c.video AND md.t = c.t), q AS (SELECT video, t, greatest(quantile_cont(r, 0.95), 1.0) AS qr, greatest(quantile_cont(m, 0.95), 1e-6) AS qm FROM m GROUP BY ALL)"


@query("motion_fusion", with_views(f"{FUSE} SELECT m.video, m.t, i, j, round(0.5 * least(1.0, m / qm) + 0.5 * least(1.0, r / qr), 6) AS cost FROM m JOIN q ON q.video = m.video AND q.t = m.t", "grid"))
def motion_fusion(spark, sf):
    g, c = src.grid(spark, sf), F.col("cost")
    cells = g.select("video", "t", "i", "j", F.floor(c * 400).alias("residual"), ((F.col("i") - F.col("j")) * c).alias("vx0"), (c * 3).alias("vy0"), (c * (F.col("j") - 3)).alias("vx1"), (F.col("i") * c).alias("vy1"))
    return r6(scores.fuse_motion(cells, 0.5, "sum", True), "cost")


@query("bitcost_parts", "WITH u AS (SELECT o_orderkey AS unit, o_totalprice::DOUBLE AS total, CASE o_orderkey % 3 WHEN 0 THEN 'h264' WHEN 1 THEN 'hevc' ELSE 'vp9' END AS codec FROM orders), p AS (SELECT l_orderkey AS unit, (l_linenumber - 1) * 2 AS f, 1 + l_linenumber % 3 AS n, l_extendedprice::DOUBLE AS cost FROM lineitem), a AS (SELECT unit, sum(cost) AS assigned FROM p GROUP BY 1), r AS (SELECT u.*, total - coalesce(assigned, 0) AS rest FROM u LEFT JOIN a ON a.unit = u.unit), b AS (SELECT unit, unnest(range(16)) AS cell, CASE WHEN codec = 'vp9' THEN total WHEN codec = 'hevc' THEN CASE WHEN abs(rest) > 1e-3 THEN rest ELSE 0 END WHEN rest > 0 THEN rest ELSE 0 END / 16 AS share FROM r UNION ALL SELECT p.unit, unnest(range(f, f + n)), cost / n FROM p JOIN u ON u.unit = p.unit WHERE codec <> 'vp9') SELECT unit, cell, round(sum(share), 6) AS share FROM b GROUP BY ALL")
def bitcost_parts(spark, sf):
    """Orders as units of sixteen cells, their lines as parts with costs of their own."""
    codec = F.when(F.col("o_orderkey") % 3 == 0, "h264").when(F.col("o_orderkey") % 3 == 1, "hevc").otherwise("vp9")
    units = src.table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit"), F.lit(16).alias("cells"), F.col("o_totalprice").cast("double").alias("total"), codec.alias("codec_name"))
    parts = src.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit"), ((F.col("l_linenumber") - 1) * 2).alias("first"), (1 + F.col("l_linenumber") % 3).alias("count"), F.col("l_extendedprice").cast("double").alias("cost"))
    return scores.distribute_parts(units, parts).withColumn("share", F.round("share", 6))


@query("iframe_clip_by_area", with_views("n AS (SELECT floor(y * 8 / 14.0)::INT AS c, count(*) AS n FROM range(14) r(y) GROUP BY 1), gw AS (SELECT g.*, a.n * b.n AS w, t % 16 = 0 AS key FROM grid g JOIN n a ON a.c = i JOIN n b ON b.c = j), cap AS (SELECT video, quantile_cont(cost, 0.9) AS cap FROM (SELECT video, cost, unnest(range(w)) FROM gw WHERE NOT key) GROUP BY 1) SELECT g.video, t, i, j, round(CASE WHEN key THEN least(cost, coalesce(cap, cost)) ELSE cost END, 6) AS cost, key AND cap IS NOT NULL AND cost > cap AS changed FROM gw g LEFT JOIN cap ON cap.video = g.video", "grid"))
def iframe_clip_by_area(spark, sf):
    """The cap counts a cell as often as it has pixels after resizing to 14 x 14."""
    g = scores.with_pixels(src.grid(spark, sf), 8, 8, 14, 14)
    kinds = g.select("video", "t").distinct().withColumn("pict_type", F.when(F.col("t") % 16 == 0, "I").otherwise("P"))
    return r6(scores.clip_iframes(g, kinds, 0.9, "weight"), "cost")


@query("training_messages", r"WITH m AS (SELECT conv_id AS id, turn, role, coalesce(text, '') AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, min(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS u FROM conversations) SELECT id::VARCHAR AS id, n, role, CASE WHEN turn = u THEN repeat('<image>' || chr(10), id % 3 + 1) || regexp_replace(content, '^\s*(?:<image>\s*)+', '', 'i') ELSE content END AS content FROM m")
def training_messages(spark, sf):
    """Messages of training records, conversations as jobs with one to three canvases."""
    c = src.chat(spark, sf)
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    jobs = c.groupBy("id").agg(turns.alias("messages")).select(F.col("id").cast("string").alias("id"), F.col("id").cast("string").alias("key"), "messages", F.lit("").alias("caption"))
    names = F.transform(F.sequence(F.lit(0), (F.col("id") % 3).cast("int")), lambda i: F.format_string("canvas_%03d.png", i))
    assets = c.select("id").distinct().select(F.col("id").cast("string").alias("key"), F.lit("v").alias("video"), names.alias("images"), F.lit("p").alias("positions"), F.lit(25.0).alias("fps"), F.expr("array(named_struct('frame_id', 0, 'seconds', 0.0D))").alias("frames"))
    made = records.training_records(jobs, assets)
    return made.select("id", F.posexplode("messages").alias("n", "m")).select("id", "n", "m.role", "m.content")


# buckets ----------------------------------------------------------------------------------------------------------

IMAGES, PER_IMAGE = 3, 16
CAND = f"{GROUPED}, pb AS (SELECT *, row_number() OVER (PARTITION BY video, t ORDER BY round(score, 6) DESC, block_idx) AS nth FROM g WHERE t <> anchor_t), cd AS MATERIALIZED (SELECT video, group_idx AS bucket, t, block_idx, bh, bw, score / sqrt(1 + 0.35::DOUBLE * (nth - 1)) AS score FROM pb), fm AS (SELECT video, bucket, t, sum(greatest(score, 0)) AS mass, max(greatest(score, 0)) AS peak FROM cd GROUP BY ALL), fw AS (SELECT *, greatest(1e-6, mass + 0.35::DOUBLE * peak) AS w FROM fm), fc AS MATERIALIZED (SELECT *, sum(w) OVER (PARTITION BY video, bucket ORDER BY t) / sum(w) OVER (PARTITION BY video, bucket) AS cdf, row_number() OVER (PARTITION BY video, bucket ORDER BY t) - 1 AS k, count(*) OVER (PARTITION BY video, bucket) AS n FROM fw)"


def _slices() -> str:
    """CTEs that fill every canvas from its slice, the surroundings of its middle, then from all frames."""
    out, before = [], []
    for i in range(IMAGES):
        at = lambda q: f"least(any_value(n) - 1, count(*) FILTER (cdf < {q}::DOUBLE))"
        out.append(f"b{i} AS MATERIALIZED (SELECT video, bucket, {at(i / IMAGES)} AS lo, {at((i + 0.5) / IMAGES)} AS mid, {at((i + 1) / IMAGES)} AS hi FROM fc GROUP BY ALL)")
        out.append(f"r{i} AS MATERIALIZED (SELECT b.video, b.bucket, a.t AS first_, z.t + 1 AS last_, m.t AS mid_t, greatest(1, z.t + 1 - a.t) AS radius FROM b{i} b JOIN fc a ON a.video = b.video AND a.bucket = b.bucket AND a.k = lo JOIN fc z ON z.video = b.video AND z.bucket = b.bucket AND z.k = greatest(lo, hi) JOIN fc m ON m.video = b.video AND m.bucket = b.bucket AND m.k = mid)")
        for step, inside in enumerate(("c.t >= first_ AND c.t < last_", "c.t >= mid_t - radius AND c.t < mid_t + radius + 1", "true")):
            used = " UNION ALL ".join(f"SELECT video, bucket, t, block_idx FROM {x}" for x in before) or "SELECT NULL AS video, NULL AS bucket, NULL AS t, NULL AS block_idx WHERE false"
            mine = [x for x in before if x.startswith(f"s{i}_")]
            have = "(" + (" + ".join(f"(SELECT count(*) FROM {x} y WHERE y.video = c.video AND y.bucket = c.bucket)" for x in mine) or "0") + ")"
            name = f"s{i}_{step}"
            out.append(f"{name} AS MATERIALIZED (SELECT video, bucket, t, block_idx, score, {i} AS image, {step} AS step, r FROM (SELECT c.*, {PER_IMAGE} - {have} AS need, row_number() OVER (PARTITION BY c.video, c.bucket ORDER BY round(score, 9) DESC, c.t, block_idx) AS r FROM cd c JOIN r{i} q ON q.video = c.video AND q.bucket = c.bucket WHERE {inside} AND NOT EXISTS (SELECT 1 FROM ({used}) u WHERE u.video = c.video AND u.bucket = c.bucket AND u.t = c.t AND u.block_idx = c.block_idx)) WHERE r <= need)")
            before.append(name)
    return ", ".join(out) + ", chosen AS (SELECT *, row_number() OVER (PARTITION BY video, bucket ORDER BY image, step, r) - 1 AS place FROM (" + " UNION ALL ".join(f"SELECT * FROM {x}" for x in before) + "))"


def _bucketed(spark, sf):
    g = _grouped(spark, sf).filter(F.col("t") != F.col("anchor_t"))
    return sel.penalised(g, 0.35).select("video", F.col("group_idx").alias("bucket"), "t", "block_idx", "bh", "bw", F.col("penalised").alias("score"))


@query("energy_cdf", with_views(f"{CAND} SELECT video, bucket, t, round(w, 6) AS w, round(cdf, 6) AS cdf FROM fc", "grid"))
def energy_cdf(spark, sf):
    gain = F.greatest("score", F.lit(0.0))
    frames = _bucketed(spark, sf).groupBy("video", "bucket", "t").agg(F.sum(gain).alias("mass"), F.max(gain).alias("peak"))
    return r6(sel.energy_cdf(frames, ["video", "bucket"]).select("video", "bucket", "t", "w", "cdf"), "w", "cdf")


@query("stratified_blocks", with_views(f"{CAND}, {_slices()} SELECT video, bucket, t, block_idx, round(score, 6) AS score, image, place FROM chosen", "grid"))
def stratified_blocks(spark, sf):
    return r6(sel.stratified(_bucketed(spark, sf), IMAGES, PER_IMAGE), "score")


@query("reordered_blocks", with_views(f"{TOPK} SELECT video, group_idx, t, block_idx, row_number() OVER (PARTITION BY video, group_idx ORDER BY t, bh, bw, score DESC) - 1 AS by_time, row_number() OVER (PARTITION BY video, group_idx ORDER BY round(score, 9) DESC, t, bh, bw) - 1 AS by_score FROM sel", "grid"))
def reordered_blocks(spark, sf):
    by = ["video", "group_idx"]
    timed = sel.reordered(_topk(spark, sf), "time", by).withColumnRenamed("place", "by_time")
    return sel.reordered(timed, "score", by).select("video", "group_idx", "t", "block_idx", "by_time", F.col("place").alias("by_score"))


@query("spaced_anchors", with_views("a AS MATERIALIZED (SELECT DISTINCT video, t FROM frame_seq WHERE pict_type = 'I'), walk AS (SELECT video, min(t) AS t FROM a GROUP BY video UNION ALL SELECT w.video, min(a.t) FROM walk w JOIN a ON a.video = w.video AND a.t >= w.t + 6 GROUP BY w.video) SELECT * FROM walk", "frame_seq", recursive=True))
def spaced_anchors(spark, sf):
    return anchors.spaced(src.frame_seq(spark, sf).filter("pict_type = 'I'").select("video", "t"), 6)


@query("anchor_positions", with_views(f"{UNIFORM}, pts AS (SELECT video, round_even((bin * 0.31::DOUBLE) * 25.0::DOUBLE, 0) AS x FROM (SELECT video, unnest(range(9)) AS bin FROM videos)) SELECT DISTINCT video, arg_min(t, (abs(frame_id - x), frame_id, t))::BIGINT AS t FROM (SELECT p.video, p.x, u.t, u.frame_id FROM pts p JOIN uni u ON u.video = p.video) GROUP BY video, x UNION SELECT video, 0 FROM videos", "packet", "videos"))
def anchor_positions(spark, sf):
    seconds = src.videos(spark, sf).select("video", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("i")).select("video", (F.col("i") * F.lit(0.31)).alias("sec"))
    return anchors.from_seconds(seconds, sample_uniform(spark, sf), src.videos(spark, sf))


THIN = "f AS MATERIALIZED (SELECT video, t, pict_type <> 'B' AS good, pict_type = 'I' AS anchor FROM frame_seq), a AS MATERIALIZED (SELECT video, t FROM f WHERE anchor), walk AS (SELECT video, min(t) AS t FROM a GROUP BY video UNION ALL SELECT w.video, min(a.t) FROM walk w JOIN a ON a.video = w.video AND a.t >= w.t + 5 GROUP BY w.video), lim AS (SELECT video, max(t) + 1 AS n, greatest(0, max(t) - 3) AS latest FROM f GROUP BY 1), an AS (SELECT w.video, list(w.t ORDER BY w.t) AS l FROM walk w JOIN lim ON lim.video = w.video AND w.t <= latest GROUP BY w.video), al AS (SELECT lim.video, n, latest, coalesce(l, [0]) AS l FROM lim LEFT JOIN an ON an.video = lim.video), ks AS (SELECT *, unnest(range(1, least(len(l), latest // 5 + 1, 3) + 1)) AS k FROM al), kept AS (SELECT video, n, k, CASE WHEN len(l) <= k THEN l WHEN k = 1 THEN l[:1] ELSE [l[CASE WHEN i = k - 1 THEN len(l) ELSE trunc(i * ((len(l) - 1) / (k - 1)::DOUBLE))::INT + 1 END] for i in range(k)] END AS s FROM ks), sp AS (SELECT *, unnest(range(1, len(s) + 1)) AS j FROM kept), gaps AS (SELECT video, k, s[j] AS lo, CASE WHEN j < len(s) THEN s[j + 1] ELSE n END AS hi FROM sp), cn AS (SELECT g.video, g.k, g.lo, count(f.t) AS c FROM gaps g LEFT JOIN f ON f.video = g.video AND f.good AND f.t > g.lo AND f.t < g.hi GROUP BY ALL), ok AS (SELECT video, k, bool_and(c >= 3) AS dense FROM cn GROUP BY ALL), best AS (SELECT kept.video, any_value(n) AS n, arg_max(s, kept.k) AS s FROM kept JOIN ok ON ok.video = kept.video AND ok.k = kept.k WHERE dense OR kept.k = 1 GROUP BY kept.video), cut AS (SELECT video, CASE WHEN len(s) >= 2 AND n - s[len(s)] < 4 THEN s[:len(s) - 1] ELSE s END AS s FROM best)"


@query("thinned_anchors", with_views(f"{THIN} SELECT video, unnest(range(len(s))) AS bucket, unnest(s) AS t FROM cut", "frame_seq", recursive=True))
def thinned_anchors(spark, sf):
    kind = F.col("pict_type")
    frames = src.frame_seq(spark, sf).select("video", "t", (kind != "B").alias("good"), (kind == "I").alias("anchor"), F.lit(1.0).alias("fps"))
    return anchors.thinned(frames, 5, 3, 3)


# pixels -----------------------------------------------------------------------------------------------------------

LUMA = "0.114::DOUBLE * b + 0.587::DOUBLE * g + 0.299::DOUBLE * r"
STATS = f"st AS (SELECT video, t, avg({LUMA}) AS ym, stddev_pop({LUMA}) AS ys, stddev_pop(b) AS bs, stddev_pop(g) AS gs, stddev_pop(r) AS rs, greatest(max(b) - min(b), max(g) - min(g), max(r) - min(r)) AS rg, avg((g >= 180 AND r <= 90 AND b <= 90)::INT) AS share, avg(g) AS gm, avg(r) AS rm, avg(b) AS bm FROM pixel GROUP BY ALL), fl AS (SELECT video, t, ym <= 8 AND ys <= 6 AS is_black, greatest(ys, bs, gs, rs) <= 4 AND rg <= 12 AS is_solid, share >= 0.35 OR (gm > 120 AND gm - greatest(rm, bm) > 80 AND gs < 50) AS is_green FROM st), flags AS (SELECT *, is_black OR is_solid OR is_green AS is_bad FROM fl)"


def _flags(spark, sf):
    return image.with_stats(src.pixel(spark, sf)).select("video", "t", image.is_black().alias("is_black"), image.is_solid().alias("is_solid"), image.is_green().alias("is_green"), image.is_bad().alias("is_bad"))


@query("pixel_flags", with_views(f"{STATS} SELECT * FROM flags", "grid", "pixel"))
def pixel_flags(spark, sf):
    return _flags(spark, sf)


BOXES = f"lr AS (SELECT video, t, i, avg({LUMA}) >= 16 AS lit FROM pixel GROUP BY ALL), lc AS (SELECT video, t, j, avg({LUMA}) >= 16 AS lit FROM pixel GROUP BY ALL), br AS (SELECT video, t, least(3, coalesce(min(i) FILTER (lit), 8)) AS top, 8 - least(3, 7 - coalesce(max(i) FILTER (lit), -1)) AS bottom FROM lr GROUP BY ALL), bc AS (SELECT video, t, least(3, coalesce(min(j) FILTER (lit), 8)) AS \"left\", 8 - least(3, 7 - coalesce(max(j) FILTER (lit), -1)) AS \"right\" FROM lc GROUP BY ALL), boxes AS (SELECT * FROM br JOIN bc USING (video, t))"


@query("letterboxes", with_views(f'{BOXES} SELECT video, t, top, bottom, "left", "right" FROM boxes', "grid", "pixel"))
def letterboxes(spark, sf):
    return pixels.letterboxes(src.pixel(spark, sf)).select("video", "t", "top", "bottom", "left", "right")


@query("content_mask", with_views(f'{BOXES} SELECT g.video, g.t, i, j, round(CASE WHEN i >= top AND i < bottom AND j >= "left" AND j < "right" THEN cost ELSE 0 END, 6) AS cost FROM grid g JOIN boxes x ON x.video = g.video AND x.t = 0', "grid", "pixel"))
def content_mask(spark, sf):
    return r6(pixels.content_mask(src.grid(spark, sf), pixels.letterboxes(src.pixel(spark, sf))), "cost")


CELLS = f"gr AS (SELECT video, t, (i // 2) * 4 + j // 2 AS block_idx, max(y) FILTER (i % 2 = 0 AND j % 2 = 0) AS a, max(y) FILTER (i % 2 = 0 AND j % 2 = 1) AS b, max(y) FILTER (i % 2 = 1 AND j % 2 = 0) AS c, max(y) FILTER (i % 2 = 1 AND j % 2 = 1) AS e FROM (SELECT video, t, i, j, ({LUMA}) / 255 AS y FROM pixel) GROUP BY ALL), gj AS (SELECT g.*, a, b, c, e FROM g JOIN gr ON gr.video = g.video AND gr.t = g.t AND gr.block_idx = g.block_idx), px AS (SELECT *, (abs(a - lag(a) OVER w) + abs(b - lag(b) OVER w) + abs(c - lag(c) OVER w) + abs(e - lag(e) OVER w)) / 4 AS adjacent, (abs(a - first_value(a) OVER w) + abs(b - first_value(b) OVER w) + abs(c - first_value(c) OVER w) + abs(e - first_value(e) OVER w)) / 4 AS novelty, (abs(b - a) + abs(e - c) + abs(c - a) + abs(e - b)) / 12 AS edge FROM gj WINDOW w AS (PARTITION BY video, group_idx, block_idx ORDER BY t))"


def _framed(spark, sf):
    spans = _grouped(spark, sf).select("video", "group_idx", "t", "anchor_t").distinct()
    return spans.join(src.pixel(spark, sf), ["video", "t"])


@query("pixel_measures", with_views(f"{GROUPED}, {CELLS} SELECT video, group_idx, t, block_idx, round(novelty, 6) AS novelty, round(edge, 6) AS edge, round(adjacent, 6) AS adjacent FROM px", "grid", "pixel"))
def pixel_measures(spark, sf):
    return r6(pixels.measured(_framed(spark, sf), HB // SIDE, WB // SIDE, "pooled4"), "novelty", "edge", "adjacent")


@query("pixel_differences", with_views(f"{GROUPED}, {CELLS} SELECT video, group_idx, t, block_idx, round(adjacent, 6) AS adjacent FROM px WHERE adjacent IS NOT NULL", "grid", "pixel"))
def pixel_differences(spark, sf):
    return r6(pixels.measured(_framed(spark, sf), HB // SIDE, WB // SIDE, "full").filter("adjacent is not null").select("video", "group_idx", "t", "block_idx", "adjacent"), "adjacent")


ON_PIXELS = f"{GROUPED}, {STATS}, {CELLS}, pv AS (SELECT * REPLACE (round(novelty, 6) AS novelty, round(edge, 6) AS edge), count(*) OVER (PARTITION BY video, group_idx) AS n FROM (SELECT px.* FROM px JOIN flags f ON f.video = px.video AND f.t = px.t WHERE px.t <> anchor_t AND NOT is_bad)), pr AS (SELECT * EXCLUDE (n), {RANK.format(by='video, group_idx', v='novelty')} AS nr, {RANK.format(by='video, group_idx', v='edge')} AS er FROM pv), pz AS (SELECT *, round(0.5 * nr + 0.5 * er, 6) AS diversity FROM pr), {greedy('pz', 0.25, 0.035)}"


@query("diverse_on_pixels", with_views(f"{ON_PIXELS} SELECT video, group_idx, t, block_idx, round(score, 6) AS score, origin, rejected, rejected_unique, comparisons FROM picked", "grid", "pixel", recursive=True))
def diverse_on_pixels(spark, sf):
    """Bad frames are left out before blocks are ranked; duplicates are told by all their pixels."""
    blocks = _grouped(spark, sf).join(_flags(spark, sf).select("video", "t", (~F.col("is_bad")).alias("good")), ["video", "t"])
    cand = pixels.diversity(blocks, src.pixel(spark, sf), HB // SIDE, WB // SIDE, 0.5, "full")
    return r6(sel.diverse_counted(cand, BUDGET, 0.25, True, 0.035), "score")


@query("usable_anchor", with_views(f"{TOPK}, {STATS}, bk AS (SELECT DISTINCT video, group_idx AS bucket, anchor_t + 3 AS anchor_t FROM g), od AS (SELECT s.video, group_idx AS bucket, s.t, row_number() OVER (PARTITION BY s.video, group_idx ORDER BY s.t, bh, bw) AS place FROM sel s), fg AS (SELECT o.video, bucket, arg_min(o.t, place) AS t FROM od o JOIN flags f ON f.video = o.video AND f.t = o.t WHERE NOT is_bad GROUP BY ALL) SELECT bk.video, bk.bucket, bk.anchor_t, CASE WHEN NOT coalesce(a.is_bad, true) THEN bk.anchor_t ELSE coalesce(fg.t, bk.anchor_t) END AS used_t FROM bk LEFT JOIN flags a ON a.video = bk.video AND a.t = bk.anchor_t LEFT JOIN fg ON fg.video = bk.video AND fg.bucket = bk.bucket", "grid", "pixel"))
def usable_anchor(spark, sf):
    buckets = _grouped(spark, sf).select("video", F.col("group_idx").alias("bucket"), (F.col("anchor_t") + 3).alias("anchor_t")).distinct()
    chosen = sel.reordered(_topk(spark, sf), "time", ["video", "group_idx"]).withColumnRenamed("group_idx", "bucket")
    return anchors.usable_anchor(buckets, chosen, _flags(spark, sf).select("video", "t", (~F.col("is_bad")).alias("good")))


@query("canvas_pixels", with_views(f"{PLACED}, fullc AS (SELECT DISTINCT video, group_idx, canvas_idx, n // 8 AS patch_h, n % 8 AS patch_w FROM placed, range(64) x(n)), col AS (SELECT f.*, coalesce(printf('%02X%02X%02X', p.r, p.g, p.b), '000000') AS c FROM fullc f LEFT JOIN placed q USING (video, group_idx, canvas_idx, patch_h, patch_w) LEFT JOIN pixel p ON p.video = f.video AND p.t = q.src_frame AND p.i = q.src_patch_h AND p.j = q.src_patch_w) SELECT video, group_idx, canvas_idx, 8 AS h, 8 AS w, md5(string_agg(c, '' ORDER BY patch_h, patch_w)) AS digest FROM col GROUP BY ALL", "grid", "pixel"))
def canvas_pixels(spark, sf):
    drawn = pixels.canvases(src.pixel(spark, sf), _placed(spark, sf), HB, WB, PATCH)
    return drawn.select("video", "group_idx", "canvas_idx", "h", "w", F.md5(F.hex("rgb").cast("binary")).alias("digest"))


USED = "bk AS (SELECT DISTINCT video, group_idx AS bucket, anchor_t FROM g), bf AS (SELECT video, t FROM flags WHERE is_bad), pl AS (SELECT c.video, c.bucket, c.t, d.bh, d.bw, row_number() OVER (PARTITION BY c.video, c.bucket ORDER BY c.t, d.bh, d.bw) - 1 AS place FROM chosen c JOIN cd d ON d.video = c.video AND d.bucket = c.bucket AND d.t = c.t AND d.block_idx = c.block_idx), fg AS (SELECT video, bucket, arg_min(t, place) AS t FROM pl WHERE NOT EXISTS (SELECT 1 FROM bf WHERE bf.video = pl.video AND bf.t = pl.t) GROUP BY ALL), us AS (SELECT bk.video, bk.bucket, CASE WHEN EXISTS (SELECT 1 FROM bf WHERE bf.video = bk.video AND bf.t = bk.anchor_t) THEN coalesce(fg.t, anchor_t) ELSE anchor_t END AS used_t FROM bk LEFT JOIN fg ON fg.video = bk.video AND fg.bucket = bk.bucket), sl AS (SELECT us.*, c AS canvas_idx, s AS slot FROM us, range(4) x(c), range(16) y(s)), so AS (SELECT sl.video, sl.bucket, canvas_idx, slot, CASE WHEN canvas_idx = 0 THEN used_t ELSE pl.t END AS t, CASE WHEN canvas_idx = 0 THEN slot // 4 ELSE pl.bh END AS bh, CASE WHEN canvas_idx = 0 THEN slot % 4 ELSE pl.bw END AS bw FROM sl LEFT JOIN pl ON pl.video = sl.video AND pl.bucket = sl.bucket AND canvas_idx = 1 + place // 16 AND slot = place % 16 AND NOT EXISTS (SELECT 1 FROM bf WHERE bf.video = pl.video AND bf.t = pl.t))"


@query("bucket_canvases", with_views(f"{CAND}, {_slices()}, {STATS}, {USED} SELECT video, bucket, canvas_idx, (slot // 4) * 2 + k // 2 AS patch_h, (slot % 4) * 2 + k % 2 AS patch_w, coalesce(t, -1) AS src_frame, coalesce(bh * 2 + k // 2, -1) AS src_patch_h, coalesce(bw * 2 + k % 2, -1) AS src_patch_w, round(coalesce(t / 25.0::DOUBLE, -1), 6) AS seconds FROM so, range(4) z(k)", "grid", "pixel"))
def bucket_canvases(spark, sf):
    """Whole anchors and stratified blocks in order of time; bad frames leave gaps."""
    flags = _flags(spark, sf).select("video", "t", (~F.col("is_bad")).alias("good"), F.lit(25.0).alias("fps"))
    blocks = _bucketed(spark, sf)
    picked = sel.stratified(blocks, IMAGES, PER_IMAGE).select("video", "bucket", "t", "block_idx", "score")
    chosen = sel.reordered(picked.join(blocks.select("video", "bucket", "t", "block_idx", "bh", "bw"), ["video", "bucket", "t", "block_idx"]), "time")
    buckets = _grouped(spark, sf).select("video", F.col("group_idx").alias("bucket"), "anchor_t").distinct()
    used = anchors.usable_anchor(buckets, chosen, flags)
    return r6(layout.bucket_placements(used.select("video", "bucket", "used_t"), chosen, flags, SIDE, HB, WB, IMAGES), "seconds")


@query("canvas_wh_raster", with_views(f"{PLACED}, wr AS (SELECT video, group_idx, r * 4 + k AS q, t AS src_frame, bh * 2 + k // 2 AS src_patch_h, bw * 2 + k % 2 AS src_patch_w FROM rr, range(4) x(k)) SELECT video, group_idx, q // 64 AS canvas_idx, (q % 64) // 8 AS patch_h, q % 8 AS patch_w, src_frame, src_patch_h, src_patch_w FROM wr", "grid"))
def canvas_wh_raster(spark, sf):
    return layout.placements(_grouped(spark, sf), _topk(spark, sf), SIDE, HB, WB, "wh_raster")


@query("canvas_total_padding", with_views(f"{PLACED}, fullc AS (SELECT video, group_idx, c AS canvas_idx, n // 8 AS patch_h, n % 8 AS patch_w FROM (SELECT DISTINCT video, group_idx FROM placed), range(6) y(c), range(64) x(n)) SELECT f.*, coalesce(src_frame, -1) AS src_frame, coalesce(src_patch_h, -1) AS src_patch_h, coalesce(src_patch_w, -1) AS src_patch_w FROM fullc f LEFT JOIN placed USING (video, group_idx, canvas_idx, patch_h, patch_w)", "grid"))
def canvas_total_padding(spark, sf):
    """Six canvases a group, whatever is selected."""
    return layout.padded(_placed(spark, sf), HB, WB, 6)


@query("raster_positions", with_views(f"{PLACED}, cn AS (SELECT *, dense_rank() OVER (PARTITION BY video ORDER BY group_idx, canvas_idx) - 1 AS c FROM placed) SELECT video, c * 64 + patch_h * 8 + patch_w AS n, src_frame, src_patch_h, src_patch_w FROM cn", "grid"))
def raster_positions(spark, sf):
    return layout.raster(_placed(spark, sf), HB, WB).select("video", "n", "src_frame", "src_patch_h", "src_patch_w")


@query("vision_text", with_views(f"{LAYOUT}, isl AS (SELECT *, CASE WHEN src_frame <> lag(src_frame) OVER w OR lag(src_frame) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM lay WINDOW w AS (PARTITION BY video, group_idx ORDER BY layout_pos)), rn AS (SELECT *, sum(new) OVER (PARTITION BY video, group_idx ORDER BY layout_pos) AS run FROM isl), ru AS (SELECT video, group_idx, run, printf('<%.1f seconds>', any_value(src_frame) / 25.0::DOUBLE) AS label, count(*) // 4 AS n FROM rn GROUP BY video, group_idx, run HAVING any_value(src_frame) >= 0 AND count(*) // 4 > 0) SELECT video AS id, 'before ' || string_agg(label || '<|vision_start|>' || repeat('<|image_pad|>', n) || '<|vision_end|>' || chr(10), '' ORDER BY group_idx, run) || 'after ' || video AS text FROM ru GROUP BY video", "grid"))
def vision_text(spark, sf):
    """The vision stretch of a message becomes one stretch a run of frames."""
    runs = layout.timestamp_runs(layout.block_layout(layout.padded(_placed(spark, sf), HB, WB), HB, WB, SIDE), 25.0, 2)
    said = src.grid(spark, sf).select(F.col("video").alias("id")).distinct().withColumn("text", F.concat(F.lit("before <|vision_start|>x<|vision_end|>\ny<|vision_start|><|vision_end|>\nafter "), F.col("id").cast("string")))
    return layout.vision_text(said, runs)


@query("keep_masks", with_views(f"{PLACED} SELECT DISTINCT video, src_frame AS t, src_patch_h AS patch_h, src_patch_w AS patch_w FROM placed", "grid"))
def keep_masks(spark, sf):
    return pixels.keep_masks(_placed(spark, sf))


# full summaries of a diverse selection -----------------------------------------------------------------------------

THRESHOLD = 0.025
MADS = ", ".join(f"avg((adjacent <= {t})::INT) AS cdf_{round(1000 * t):03d}" for t in rollup.MAD_THRESHOLDS)
GROUPS = f"""{MIXED}, pf AS (SELECT video, group_idx, t, count(*) AS n, sum(score) AS s FROM picked GROUP BY ALL), pp AS (SELECT *, n / sum(n) OVER (PARTITION BY video, group_idx) AS p FROM pf),
g1 AS (SELECT video, group_idx, round(sum(s) / sum(n), 6) AS mean_score, count(*) AS unique_frames, -sum(p * ln(p)) AS h, round(max(p), 6) AS max_frame_share FROM pp GROUP BY ALL),
g2 AS (SELECT video, group_idx, count(*) AS target_blocks, count(*) FILTER (origin = 'bitcost') AS bitcost_selected, count(*) FILTER (origin = 'diversity') AS diversity_selected, count(*) FILTER (origin = 'backfill') AS backfill_selected, any_value(rejected) AS dedup_rejected, any_value(rejected_unique) AS dedup_rejected_unique, any_value(comparisons) AS dedup_comparisons, avg(novelty) AS nov, avg(edge) AS edg, count(DISTINCT block_idx) AS unique_positions FROM picked GROUP BY ALL),
g3 AS (SELECT video, group_idx, count(DISTINCT t) AS n_good, count(adjacent) AS adjacent_mad_count, avg((adjacent <= {THRESHOLD})::INT) AS mad_fraction, {MADS} FROM dr GROUP BY ALL),
tk AS (SELECT video, group_idx, t, block_idx FROM picked UNION SELECT video, group_idx, t, block_idx FROM g WHERE t = anchor_t), g4 AS (SELECT a.video, a.group_idx, count(*) AS pairs, count(*) FILTER (adjacent <= {THRESHOLD}) AS duplicates FROM tk a JOIN tk b ON b.video = a.video AND b.group_idx = a.group_idx AND b.block_idx = a.block_idx AND b.t = a.t - 1 JOIN dr ON dr.video = a.video AND dr.group_idx = a.group_idx AND dr.t = a.t AND dr.block_idx = a.block_idx GROUP BY ALL),
dg AS (SELECT g2.*, mean_score, unique_frames, round(CASE WHEN ln(greatest(1, n_good)) > 0 THEN h / ln(greatest(1, n_good)) ELSE 0 END, 6) AS ent, max_frame_share, adjacent_mad_count, mad_fraction, {', '.join(f'cdf_{round(1000 * t):03d}' for t in rollup.MAD_THRESHOLDS)}, coalesce(pairs, 0) AS pairs, coalesce(duplicates, 0) AS duplicates FROM g2 JOIN g1 USING (video, group_idx) JOIN g3 USING (video, group_idx) LEFT JOIN g4 USING (video, group_idx))"""
SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in rollup.COUNTS)
CDFS = ", ".join(f"round(sum(cdf_{round(1000 * t):03d} * adjacent_mad_count) / sum(adjacent_mad_count), 6) AS cdf_{round(1000 * t):03d}" for t in rollup.MAD_THRESHOLDS)
VIDEOS = f"{GROUPS}, vs AS (SELECT video, count(*) AS group_count, {SUMS}, round(avg(unique_frames), 6) AS mean_unique_source_frames, round(avg(unique_positions), 6) AS mean_unique_spatial_positions, round(sum(ent * target_blocks) / sum(target_blocks), 6) AS mean_entropy_normalized, round(sum(max_frame_share * target_blocks) / sum(target_blocks), 6) AS mean_max_frame_share, sum(pairs)::BIGINT AS adjacent_pairs, sum(duplicates)::BIGINT AS adjacent_duplicates, round(CASE WHEN sum(pairs) > 0 THEN sum(duplicates) / sum(pairs) ELSE 0 END, 6) AS adjacent_duplicate_rate, sum(adjacent_mad_count)::BIGINT AS adjacent_mad_count, round(sum(mad_fraction * adjacent_mad_count) / sum(adjacent_mad_count), 6) AS adjacent_mad_fraction, {CDFS}, round(sum(mean_score * target_blocks) / sum(target_blocks), 6) AS selected_bitcost_mean, round(sum(nov * target_blocks) / sum(target_blocks), 6) AS selected_novelty_mean, round(sum(edg * target_blocks) / sum(target_blocks), 6) AS selected_edge_mean FROM dg GROUP BY video)"


def _summaries(spark, sf):
    cand = _diverse(spark, sf)
    picked = sel.diverse_counted(cand, BUDGET, 0.10, True, THRESHOLD)
    first = _grouped(spark, sf).filter(F.col("t") == F.col("anchor_t")).select("video", "group_idx", "t", "block_idx", "anchor_t", F.lit(None).cast("double").alias("adjacent"))
    measures = cand.select("video", "group_idx", "t", "block_idx", "anchor_t", "adjacent").unionByName(first)
    return rollup.full_summary(rollup.group_diagnostics(picked, cand, measures, THRESHOLD))


@query("full_selector_summary", with_views(f"{VIDEOS} SELECT * FROM vs", "grid", recursive=True))
def full_selector_summary(spark, sf):
    return _summaries(spark, sf)


def _over(c: str, w: str) -> str:
    return f"round(sum({c} * {w}) / sum({w}), 5) AS {c}"


RUN = ", ".join([_over("mean_unique_source_frames", "group_count"), _over("mean_unique_spatial_positions", "group_count"), _over("mean_entropy_normalized", "target_blocks"), _over("mean_max_frame_share", "target_blocks"), "sum(adjacent_pairs)::BIGINT AS adjacent_pairs", "sum(adjacent_duplicates)::BIGINT AS adjacent_duplicates", "round(CASE WHEN sum(adjacent_pairs) > 0 THEN sum(adjacent_duplicates) / sum(adjacent_pairs) ELSE 0 END, 5) AS adjacent_duplicate_rate", "sum(adjacent_mad_count)::BIGINT AS adjacent_mad_count", _over("adjacent_mad_fraction", "adjacent_mad_count"), *[_over(f"cdf_{round(1000 * t):03d}", "adjacent_mad_count") for t in rollup.MAD_THRESHOLDS], _over("selected_bitcost_mean", "target_blocks"), _over("selected_novelty_mean", "target_blocks"), _over("selected_edge_mean", "target_blocks")])


@query("full_run_summary", with_views(f"{VIDEOS} SELECT count(*) AS videos, sum(group_count)::BIGINT AS groups, {SUMS}, {RUN} FROM vs", "grid", recursive=True))
def full_run_summary(spark, sf):
    return rollup.full_run_summary(_summaries(spark, sf))
