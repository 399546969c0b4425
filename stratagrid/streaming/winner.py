"""Frames as a stream: running winner and extremes of each pixel.

The state of a pixel is its best energy and frame with the least and greatest value so far; all of it is commutative
and ties go to the smaller frame, so late frames need no watermark and give the batch answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running(frames: DataFrame) -> DataFrame:
    """Streaming aggregate by pixel of (stack, frame, y, x, e, v); write it in ``update`` or ``complete`` mode."""
    e = F.when(F.isnan("e"), F.lit(0.0)).otherwise(F.greatest("e", F.lit(0.0)))
    d = frames.withColumn("_e", e)
    # energy and frame as one comparable value; frame 0 where nothing is above 0
    best = F.max(F.struct("_e", (-F.col("frame")).alias("_f")))
    g = d.groupBy("stack", "y", "x").agg(best.alias("_b"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("frames"))
    return g.select("stack", "y", "x", F.col("_b._e").alias("energy"), F.when(F.col("_b._e") > 0, -F.col("_b._f")).otherwise(F.lit(0)).alias("frame"), "lo", "hi", "frames")


def sessions(events: DataFrame, gap: str = "10 seconds", late: str = "1 hour") -> DataFrame:
    """Capture sessions of each folder: folder, start, last, captures (a gap of exactly ``gap`` still joins)."""
    t = events.withColumn("_t", F.col("ts").cast("timestamp")).withWatermark("_t", late)
    g = t.groupBy("folder", F.session_window("_t", gap)).agg(F.count(F.lit(1)).alias("captures"), F.max("_t").alias("last"))
    return g.select("folder", F.col("session_window.start").alias("start"), "last", "captures")


def start(df: DataFrame, name: str, checkpoint: str, mode: str = "complete"):
    """The query into a memory table, with its state in a shared checkpoint folder."""
    return df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
