"""Readers and writers of job, training and evaluation records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx

MESSAGE = "array<struct<role:string,content:string>>"


def read_lines(spark: SparkSession, path: str, below: bool = False) -> DataFrame:
    """Rows of JSONL files as (at, line, json); blank and malformed lines are skipped.  ``at`` orders them as they stand.

    ``below`` reads the files of all folders below ``path`` too.
    """
    lines = spark.read.option("recursiveFileLookup", str(below).lower()).text(path).select(F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    good = lines.filter((F.trim("line") != "") & F.try_parse_json("line").isNotNull())
    return good.withColumn("json", F.col("line"))


def _first(df: DataFrame, order: list, n: int | None) -> DataFrame:
    """The first ``n`` rows in order: the same rows in every run."""
    return df.orderBy(*order).limit(n) if n else df


def jobs(lines: DataFrame, ok_only: bool = True, max_jobs: int | None = None, max_lines: int | None = None, mirror_root: str | None = None, existing: DataFrame | None = None) -> DataFrame:
    """Jobs of records: usable responses, existing files, one row an image source (or the record's own path).

    id is the record's id, with the number of the video behind it where there are several; key is the path below
    ``mirror_root``, else the record's own or one made of path and id.  ``existing`` (video) lists the paths that exist.
    """
    j, get = F.col("json"), lambda p: F.get_json_object("json", p)
    text = lambda p: F.when(F.schema_of_variant(F.try_variant_get(F.try_parse_json(j), p, "variant")) == "STRING", get(p))
    rows = _first(lines, ["at"], max_lines).select(
        "at", j.alias("json"), F.from_json(get("$.images_source"), "array<string>").alias("sources"), tx.first_path(j).alias("path"), tx.caption(j).alias("caption"), F.coalesce(get("$.exists"), F.lit("true")).alias("exists"),
        get("$.response.status_code").try_cast("int").alias("status"), F.coalesce(get("$.error"), F.lit("null")).alias("error"), text("$.id").alias("id"), text("$.key").alias("own"), F.from_json(get("$.messages"), MESSAGE).alias("messages"),
    )
    if ok_only:
        rows = rows.filter(F.coalesce(F.col("status") == 200, F.lit(True)) & (F.col("error") == "null"))
    rows = rows.filter("exists <> 'false'").withColumn("sources", F.when(F.size("sources") > 0, F.col("sources")).otherwise(F.array("path")))
    rows = rows.withColumn("sources", F.filter("sources", lambda v: v.isNotNull() & (v != "")))
    out = rows.select("at", "id", "own", "caption", "messages", F.posexplode("sources").alias("n", "video"))
    if existing is not None:
        out = out.join(existing.select("video").distinct(), "video", "left_semi")
        out = out.withColumn("n", F.row_number().over(W.partitionBy("at").orderBy("n")) - 1)
    several = F.count("*").over(W.partitionBy("at")) > 1
    sample = F.when(several & (F.coalesce("id", F.lit("")) != ""), F.concat("id", F.lit("__v"), F.col("n").cast("string"))).otherwise(F.col("id"))
    key = tx.key_of(F.col("video"), F.col("own"), F.col("id"))
    key = F.coalesce(tx.mirror_key(F.col("video"), F.lit(mirror_root)), key) if mirror_root else key
    named = out.select("at", "n", sample.alias("id"), "caption", "messages", "video", key.alias("key"))
    return _first(named, ["at", "n"], max_jobs)


#: Codecs whose streams carry costs.
CODECS = ("h264", "hevc")


def unsupported(jobs_: DataFrame, codecs: tuple[str, ...] = CODECS) -> DataFrame:
    """Index records of jobs whose codec carries no costs."""
    return jobs_.filter(~F.coalesce(F.lower("codec_name").isin(*codecs), F.lit(False))).withColumn("kind", F.lit("unsupported_codec"))


def remaining(jobs_: DataFrame, done: DataFrame, key: str = "key", codecs: tuple[str, ...] | None = None) -> DataFrame:
    """Jobs whose key has no finished output; with ``codecs``, those only whose codec_name is one of them."""
    usable = jobs_.filter(F.lower("codec_name").isin(*codecs)) if codecs else jobs_
    return usable.join(done.select(key).distinct(), key, "left_anti")


def training_records(jobs_: DataFrame, assets: DataFrame) -> DataFrame:
    """id, messages, images, patch_positions, fps, images_source, timestamps of finished jobs.

    jobs(id, key, messages, caption); assets(key, video, images, positions, fps, frames), frames an array of
    struct(frame_id, seconds).  The first user message opens with one tag an image; without messages the caption answers
    an empty question.  timestamps: the clock of every source frame.
    """
    rows = jobs_.join(assets, "key")
    message = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    cap = F.coalesce("caption", F.lit(""))
    own = F.transform("messages", lambda m: message(F.coalesce(F.nullif(m["role"], F.lit("")), F.lit("user")), F.coalesce(m["content"], F.lit(""))))
    asked = F.array(message(F.lit("user"), F.lit("")))
    said = F.when(F.size("messages") > 0, own).otherwise(F.when(cap != "", F.concat(asked, F.array(message(F.lit("assistant"), cap)))).otherwise(asked))
    rows = rows.withColumn("_said", said).withColumn("_first", F.array_position(F.transform("_said", lambda m: m["role"]), "user") - 1)
    tags = F.greatest(F.lit(0), F.size("images"))
    tagged = F.transform("_said", lambda m, i: message(m["role"], F.when(i == F.col("_first"), tx.image_tags(m["content"], tags)).otherwise(m["content"])))
    shown = F.array_distinct(F.transform(F.filter("frames", lambda f: f["frame_id"] >= 0), lambda f: F.struct(f["frame_id"].cast("string").alias("k"), tx.clock(f["seconds"]).alias("v"))))
    return rows.select(
        F.coalesce(F.nullif("id", F.lit("")), "key").alias("id"), tagged.alias("messages"), "images", F.array("positions").alias("patch_positions"), F.array(F.coalesce("fps", F.lit(0.0))).alias("fps"),
        F.when(F.coalesce("video", F.lit("")) != "", F.array("video")).otherwise(F.array().cast("array<string>")).alias("images_source"), F.map_from_entries(shown).alias("timestamps"),
    )


def read_eval_samples(spark: SparkSession, path: str, run: str) -> DataFrame:
    """Evaluation samples of every file below ``path`` in either record form: run, key, score, duration, question_type, video_id."""
    lines = read_lines(spark, path, below=True)
    g = lambda p: F.get_json_object("json", p)
    known = lambda p: F.coalesce(g(p), F.lit("unknown"))
    perception = F.struct(g("$.videomme_perception_score.question_id").alias("key"), g("$.videomme_perception_score.score").try_cast("double").alias("score"), known("$.videomme_perception_score.duration").alias("duration"), known("$.videomme_perception_score.task_category").alias("question_type"), known("$.videomme_perception_score.videoID").alias("video_id"))
    rating = F.coalesce(g("$.avg_accuracy.rating"), g("$.avg_accuracy.match_success"))
    number = F.coalesce(rating.try_cast("double"), F.when(F.lower(rating) == "true", 1.0).when(F.lower(rating) == "false", 0.0))
    accuracy = F.struct(F.concat(g("$.avg_accuracy.video_id"), F.lit("::"), g("$.avg_accuracy.question")).alias("key"), number.alias("score"), F.lit("short").alias("duration"), known("$.avg_accuracy.dim").alias("question_type"), known("$.avg_accuracy.video_id").alias("video_id"))
    picked = F.when(g("$.videomme_perception_score").isNotNull(), perception).when(g("$.avg_accuracy").isNotNull(), accuracy)
    return lines.select(F.lit(run).alias("run"), picked.alias("s")).filter("s is not null").select("run", "s.*")


def write_meta(meta: DataFrame, path: str) -> None:
    """One JSON record a video, partitioned by configuration hash: a run rewrites its own parts and leaves the others."""
    meta.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("config").json(path)


def write_training(records: DataFrame, path: str, run: str) -> None:
    """Training records as JSONL, a part for each run; a repeated run replaces its part."""
    records.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").json(path)


def write_result(placed: DataFrame, frames: DataFrame, path: str) -> None:
    """Source positions in raster order and the sampled frames, a part for each video."""
    placed.repartition("video").sortWithinPartitions("video", "group_idx", "canvas_idx", "patch_h", "patch_w").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video").parquet(f"{path}/src_patch_position")
    frames.repartition("video").sortWithinPartitions("video", "t").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video").parquet(f"{path}/frame_ids")


def read_result(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(positions, frames) that ``write_result`` wrote."""
    return spark.read.parquet(f"{path}/src_patch_position"), spark.read.parquet(f"{path}/frame_ids")


def as_png(canvas: DataFrame) -> DataFrame:
    """video, name, png of canvases (video, n, h, w, rgb)."""
    rows = canvas.select(F.col("video").cast("string").alias("video"), F.format_string("canvas_%03d.png", F.col("n").cast("int")).alias("name"), "h", "w", "rgb")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from ..functions import image

        for batch in batches:
            files = [image.png(np.frombuffer(x.as_py(), np.uint8).reshape(h.as_py(), w.as_py(), 3)) for x, h, w in zip(batch["rgb"], batch["h"], batch["w"])]
            yield pa.RecordBatch.from_arrays([batch["video"], batch["name"], pa.array(files, pa.binary())], ["video", "name", "png"])

    return rows.mapInArrow(run, "video string, name string, png binary")


def write_canvases(canvas: DataFrame, path: str, kind: str = "png") -> DataFrame:
    """Writes canvases (video, n, h, w, rgb) as Parquet tables of (name, png), a part for each video; returns (video, name) written.

    ``path`` has to be shared by the executors.  Loose files, JPEG among them, are written by ``canvases.write_files``.
    """
    if kind != "png":
        raise ValueError(f"unsupported canvas format {kind!r}")
    files = as_png(canvas).repartition("video")
    files.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video").parquet(path)
    return canvas.select(F.col("video").cast("string").alias("video"), F.format_string("canvas_%03d.png", F.col("n").cast("int")).alias("name"))


def export_canvases(files: DataFrame, folder: str) -> int:
    """Loose files of (video, name, png) in a folder of this machine, one video's at a time; returns how many."""
    import os

    from .canvases import folder_of

    n = 0
    for r in files.select("video", "name", "png").toLocalIterator():
        # a video may be named by a path: it stays in the folder, and names that differ do not meet
        own = folder_of(r.video)
        os.makedirs(os.path.join(folder, own), exist_ok=True)
        with open(os.path.join(folder, own, os.path.basename(r.name)), "wb") as f:
            f.write(r.png)
        n += 1
    return n


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A small report table."""
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    return head + "".join("\n| " + " | ".join("-" if r.get(c) is None else str(r[c]) for c in columns) + " |" for r in rows) + "\n"


#: Schema of the videos table.
VIDEO = "video string, total_frames int, fps double, height int, width int, codec_name string, stream_bit_rate double, format_bit_rate double, duration double"


def probe_rows(lines: DataFrame) -> DataFrame:
    """Stream and format records (numbers as strings) as the videos table; frame counts fall back to rate times duration.

    The video is the column of that name, or the record's own file name.
    """
    from ..functions.geometry import parse_fps

    g = lambda p: F.get_json_object("json", p)
    num = lambda p: F.greatest(F.lit(0.0), F.coalesce(g(p).try_cast("double"), F.lit(0.0)))
    fps, duration, frames = parse_fps(g("$.streams[0].avg_frame_rate")), num("$.format.duration"), num("$.streams[0].nb_frames")
    video = F.col("video") if "video" in lines.columns else g("$.format.filename")
    return lines.select(
        video.alias("video"), F.when(frames > 0, frames).otherwise(F.bround(fps * duration)).cast("int").alias("total_frames"), fps.alias("fps"), num("$.streams[0].height").cast("int").alias("height"), num("$.streams[0].width").cast("int").alias("width"),
        F.coalesce(g("$.streams[0].codec_name"), F.lit("")).alias("codec_name"), num("$.streams[0].bit_rate").alias("stream_bit_rate"), num("$.format.bit_rate").alias("format_bit_rate"), duration.alias("duration"),
    )


def bit_rate():
    """Of the stream, else of the format."""
    return F.coalesce(F.nullif("stream_bit_rate", F.lit(0.0)), "format_bit_rate")


def read_preprocess(spark: SparkSession, path: str) -> DataFrame:
    """(video, subprocess_ms) of audit records below ``path``."""
    lines = read_lines(spark, path, below=True)
    g = lambda p: F.get_json_object("json", p)
    return lines.select(F.coalesce(g("$.video"), F.lit("unknown")).alias("video"), F.coalesce(g("$.subprocess_ms").try_cast("double"), F.lit(0.0)).alias("subprocess_ms"))


#: The fields of a video's selector summary.
SUMMARY = (
    "mode string, group_count long, target_blocks long, bitcost_selected long, diversity_selected long, backfill_selected long, dedup_rejected long, dedup_rejected_unique long, dedup_comparisons long, "
    "mean_unique_source_frames_per_group double, mean_unique_spatial_positions_per_group double, mean_temporal_distribution_entropy_normalized double, mean_max_blocks_per_frame_fraction double, "
    "adjacent_same_position_pairs long, adjacent_same_position_duplicates long, adjacent_mad_count long, mean_adjacent_mad_fraction_le_threshold double, adjacent_mad_cdf map<string,double>, "
    "selected_bitcost_mean double, selected_novelty_mean double, selected_edge_mean double, timing_sec map<string,double>"
)


def read_selector(spark: SparkSession, path: str) -> DataFrame:
    """Selector summaries of all meta.json files below ``path``; unreadable ones and those without a summary are left out."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "meta.json").text(path, wholetext=True)
    summary = F.from_json(F.get_json_object("value", "$.selector_summary"), SUMMARY)
    return files.select(summary.alias("s")).filter("s is not null and s.group_count is not null").select("s.*")
