"""Ordering, sessions, ranks and running sums over frames and rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.views import seconds


def split_by_gap(df: DataFrame, gap_s: float = 10.0) -> DataFrame:
    """folder, name, ts, session: a new session where the step to the next capture is greater than the gap.

    Captures are in order of (ts, name); a folder with any undated capture is one session.
    """
    w = W.partitionBy("folder").orderBy("ts", "name")
    step = seconds("ts") - F.lag(seconds("ts")).over(w)
    undated = F.max(F.col("ts").isNull()).over(W.partitionBy("folder"))
    fresh = F.when(~undated & (step > gap_s), 1).otherwise(0)
    return df.withColumn("_f", fresh).withColumn("session", F.sum("_f").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("_f")


def frame_order(df: DataFrame) -> DataFrame:
    """folder, name, ts, pos: by capture time then name; by name where any capture is undated."""
    undated = F.max(F.col("ts").isNull()).over(W.partitionBy("folder"))
    d = df.withColumn("_k", F.when(undated, F.lit(None).cast(df.schema["ts"].dataType)).otherwise(F.col("ts")))
    return d.withColumn("pos", (F.row_number().over(W.partitionBy("folder").orderBy("_k", "name")) - 1).cast("int")).drop("_k")


def order_issue(df: DataFrame) -> DataFrame:
    """folder, issue: ``undated`` if any capture has no time, ``mismatch`` if order by name differs from order by time, else ``none``."""
    by_name = F.row_number().over(W.partitionBy("folder").orderBy("name"))
    by_time = F.row_number().over(W.partitionBy("folder").orderBy("ts", "name"))
    r = df.withColumn("_n", by_name).withColumn("_t", by_time)
    g = r.groupBy("folder").agg(F.max(F.col("ts").isNull()).alias("u"), F.max(F.col("_n") != F.col("_t")).alias("m"))
    return g.select("folder", F.when(F.col("u"), "undated").when(F.col("m"), "mismatch").otherwise("none").alias("issue"))


def disambiguated(df: DataFrame, name: str, order: str) -> DataFrame:
    """Repeated names get " (2)", " (3)" in order."""
    n = F.row_number().over(W.partitionBy(name).orderBy(order))
    return df.withColumn("label", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), n.cast("string"), F.lit(")"))))


def suspicion(pairs: DataFrame) -> DataFrame:
    """stack, frame, bad_pairs: how many of a frame's pairs (with its predecessor and successor) are bad.

    ``pairs``: stack, frame, other, bad.
    """
    both = pairs.select("stack", "frame", "bad").unionAll(pairs.select("stack", F.col("other").alias("frame"), "bad"))
    return both.groupBy("stack", "frame").agg(F.sum(F.col("bad").cast("int")).alias("bad_pairs"))


def summed_area(df: DataFrame, value: str = "v", key: tuple[str, ...] = ("stack",)) -> DataFrame:
    """Sum of everything up and left of each pixel, itself included: two running sums over the raster of the
    rows and columns in use (absent pixels add nothing and get no row)."""
    rows = W.partitionBy(*key, "y").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    cols = W.partitionBy(*key, "x").orderBy("y").rowsBetween(W.unboundedPreceding, 0)
    grid = df.select(*key, "y").distinct().join(df.select(*key, "x").distinct(), list(key))
    d = grid.join(df.withColumn("_own", F.lit(True)), [*key, "y", "x"], "left")
    d = d.withColumn("_r", F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(rows)).withColumn("sat", F.sum("_r").over(cols))
    return d.where("_own").drop("_r", "_own")


def box_mean(df: DataFrame, radius: int, value: str = "v", key: tuple[str, ...] = ("stack",), out: str = "mean") -> DataFrame:
    """Mean of the box of ``radius``, clipped at the edges (dense rasters)."""
    rows = W.partitionBy(*key, "y").orderBy("x").rowsBetween(-radius, radius)
    cols = W.partitionBy(*key, "x").orderBy("y").rowsBetween(-radius, radius)
    d = df.withColumn("_bs", F.sum(value).over(rows)).withColumn("_bn", F.count(value).over(rows))
    return d.withColumn(out, F.sum("_bs").over(cols) / F.sum("_bn").over(cols)).drop("_bs", "_bn")


def top_frames(depth: DataFrame, mass: str, k: int = 8) -> DataFrame:
    """The ``k`` frames that won the most mass in each stack; ties to the smaller frame."""
    g = depth.groupBy("stack", "frame").agg(F.round(F.sum(mass), 9).alias("mass"))
    r = F.row_number().over(W.partitionBy("stack").orderBy(F.desc("mass"), "frame"))
    return g.withColumn("rank", r).where(F.col("rank") <= k)


def chain(transforms: list[list[float]], anchor: int) -> list[list[float]]:
    """Running products of pair transforms (frame i + 1 -> i), re-based to the anchor frame; a frame table is small."""
    from ..functions.pixel import mat_inverse, mat_mul

    one = [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]
    out = [one]
    for t in transforms:
        out.append(mat_mul(out[-1], t))
    back = mat_inverse(out[anchor])
    return [[v / m[8] for v in m] for m in (mat_mul(back, x) for x in out)]
