"""Views of plain tables as packets, frame sequences, cost grids and evaluation samples.

Schemas (all keyed by ``video``):

* packet(video, pkt_idx, pts_time, size, flags)
* frame_seq(video, t, pict_type, cost)
* grid(video, t, i, j, cost): one row a cell
* videos(video, total_frames, fps, duration)
* eval_sample(key, baseline, candidate, question_type, duration)
* pixel(video, t, h, w, bgr): frames of 8 x 8 pixels; every seventh is black, every seventh of one grey, every third has a dark top row
* audit(video, subprocess_ms), chat(id, turn, role, content)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FPS = 25.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    pts = (us - F.min(us).over(W.partitionBy("user_id"))) / F.lit(1e6)
    return e.select(F.col("user_id").alias("video"), (F.row_number().over(by) - 1).alias("pkt_idx"), pts.alias("pts_time"), F.col("value").alias("size"), F.when(F.col("event_type") == "signup", "K__").otherwise("___").alias("flags"))


def frame_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "view", "B").otherwise("P")
    return e.select(F.col("user_id").alias("video"), (F.row_number().over(by) - 1).alias("t"), kind.alias("pict_type"), F.log(1 + F.col("value")).alias("cost"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    framed = e.select(F.col("label").alias("video"), (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).alias("t"), "embedding")
    cells = framed.select("video", "t", F.posexplode("embedding").alias("pos", "v"))
    return cells.select("video", "t", F.floor(F.col("pos") / 8).cast("int").alias("i"), (F.col("pos") % 8).alias("j"), F.greatest(F.col("v").cast("double"), F.lit(0.0)).alias("cost"))


def pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    framed = e.select(F.col("label").alias("video"), (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).alias("t"), "embedding")

    def byte(p, times, plus):
        level = F.least(F.lit(255), F.floor(F.abs(F.element_at("embedding", (p * times + plus) % 64 + 1).cast("double")) * 600)).cast("int")
        shown = F.when(F.col("t") % 7 == 3, 0).when(F.col("t") % 7 == 5, 90).when((F.col("t") % 3 == 0) & (p < 8), 0).otherwise(level)
        return F.lpad(F.hex(shown), 2, "0")

    cells = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: F.concat(byte(p, 1, 0), byte(p, 1, 21), byte(p, 3, 7)))
    return framed.select("video", "t", F.lit(8).alias("h"), F.lit(8).alias("w"), F.unhex(F.array_join(cells, "")).alias("bgr"))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("video"))
    return e.agg(F.count("*").cast("int").alias("total_frames"), F.lit(FPS).alias("fps"), ((F.max(us) - F.min(us)) / F.lit(1e6)).alias("duration"))


def eval_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return labels.join(docs, "doc_id").select(F.col("doc_id").alias("key"), F.col("quality").cast("double").alias("baseline"), F.col("toxic").cast("double").alias("candidate"), F.col("lang").alias("question_type"), F.when(F.col("n_chars") < 1000, "short").otherwise("long").alias("duration"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("video"), F.col("o_totalprice").alias("subprocess_ms"))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "turn", "role", F.col("text").alias("content"))


#: The same views for DuckDB.
SQL = {
    "packet": "packet AS (SELECT user_id AS video, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pkt_idx, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6::DOUBLE AS pts_time, value AS size, CASE event_type WHEN 'signup' THEN 'K__' ELSE '___' END AS flags FROM events)",
    "frame_seq": "frame_seq AS (SELECT user_id AS video, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, CASE event_type WHEN 'signup' THEN 'I' WHEN 'view' THEN 'B' ELSE 'P' END AS pict_type, ln(1 + value) AS cost FROM events)",
    "grid": "framed AS (SELECT label AS video, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, embedding FROM embeddings), poses AS (SELECT video, t, embedding, unnest(range(len(embedding))) AS pos FROM framed), grid AS (SELECT video, t, pos // 8 AS i, pos % 8 AS j, greatest(embedding[pos + 1]::DOUBLE, 0.0) AS cost FROM poses)",
    "pixel": "pixel AS (SELECT video, t, pos // 8 AS i, pos % 8 AS j, " + ", ".join(f"CASE WHEN t % 7 = 3 THEN 0 WHEN t % 7 = 5 THEN 90 WHEN t % 3 = 0 AND pos < 8 THEN 0 ELSE least(255, floor(abs(embedding[((pos * {a} + {b}) % 64) + 1]::DOUBLE) * 600)) END::INT AS {c}" for c, a, b in (("b", 1, 0), ("g", 1, 21), ("r", 3, 7))) + " FROM poses)",
    "videos": "videos AS (SELECT video, count(*)::INT AS total_frames, 25.0::DOUBLE AS fps, max(pts_time) AS duration FROM packet GROUP BY video)",
    "eval_sample": "eval_sample AS (SELECT l.doc_id AS key, l.quality::DOUBLE AS baseline, l.toxic::DOUBLE AS candidate, d.lang AS question_type, CASE WHEN d.n_chars < 1000 THEN 'short' ELSE 'long' END AS duration FROM labels l JOIN documents d USING (doc_id))",
}


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` (CTEs allowed: start with ``name AS (...), ... SELECT``) over the named views."""
    views = ", ".join(SQL[n] for n in names)
    joint = ", " if body.lstrip().split(None, 2)[1].upper() == "AS" else " "
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}{joint}{body}"
