"""Extension: energy timelines of packet streams by event time (not part of the batch engine's parity)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def energy_windows(packets: DataFrame, width: str, late: str) -> DataFrame:
    """Sums of log(1 + size) by video and event-time window; packets(video, ts, size, flags) may be a stream."""
    ok = packets.filter(~F.coalesce(F.contains("flags", F.lit("K")), F.lit(False)) & (F.col("size") >= 0))
    return ok.withWatermark("ts", late).groupBy("video", F.window("ts", width)).agg(F.sum(F.log1p("size")).alias("energy"), F.count("*").alias("packets")).select("video", F.col("window.start").alias("start"), "energy", "packets")
