"""Incremental edits: brush stamps from an append-only log, picks, merges, staleness, batches."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixel as P
from . import aggregate as A


def brush_alpha(dist: Column, radius: float, hardness: float) -> Column:
    """1 inside the hard core, a smoothstep down to 0 at the radius."""
    core = radius * hardness
    if radius <= core:
        return F.when(dist <= radius, 1.0).otherwise(0.0)
    t = P.clamp((dist - core) / (radius - core))
    return 1 - t * t * (3 - 2 * t)


def stamp(image: DataFrame, source: DataFrame, cy: float, cx: float, radius: float, hardness: float = 0.5, opacity: float = 1.0, values: tuple[str, ...] = ("v",)) -> DataFrame:
    """Blend ``source`` into ``image`` under one stamp; alphas up to 0.003 are skipped."""
    near = (F.col("y") - cy) ** 2 + (F.col("x") - cx) ** 2
    s = source.where(near <= radius * radius).select(*A.PIXEL, *[F.col(c).alias(f"_{c}") for c in values], (brush_alpha(F.sqrt(near), radius, hardness) * opacity).alias("_al"))
    j = image.join(s.where("_al > 0.003"), A.PIXEL, "left")
    return j.select(*A.PIXEL, *[F.when(F.col("_al").isNull(), F.col(c)).otherwise(F.col(c) + (F.col(f"_{c}") - F.col(c)) * F.col("_al")).alias(c) for c in values])


def stroke(points: DataFrame, radius: float) -> DataFrame:
    """Stamps along a stroke: the first point, then one every radius / 3 of path, the rest carried over joints.

    ``points``: stroke, k, y, x in order k. Returns stroke, n, y, x."""
    from pyspark.sql import Window as W

    gap = max(radius / 3, 1e-6)
    w = W.partitionBy("stroke").orderBy("k")
    d = points.withColumn("_py", F.lag("y").over(w)).withColumn("_px", F.lag("x").over(w))
    d = d.withColumn("_l", F.coalesce(F.sqrt((F.col("y") - F.col("_py")) ** 2 + (F.col("x") - F.col("_px")) ** 2), F.lit(0.0)))
    d = d.withColumn("_e", F.sum("_l").over(w)).withColumn("_s", F.col("_e") - F.col("_l"))
    first, last = F.floor(F.col("_s") / gap + 1e-9) + 1, F.floor(F.col("_e") / gap + 1e-9)
    e = d.where("_l > 0").withColumn("n", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    t = (F.col("n") * gap - F.col("_s")) / F.col("_l")
    on = e.select("stroke", "n", (F.col("_py") + (F.col("y") - F.col("_py")) * t).alias("y"), (F.col("_px") + (F.col("x") - F.col("_px")) * t).alias("x"))
    head = d.where(F.col("_py").isNull()).select("stroke", F.lit(0).cast("long").alias("n"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))
    return head.unionAll(on)


def replay(image: DataFrame, log: DataFrame, upto: int | None = None, value: str = "v") -> DataFrame:
    """The image after the edits not undone: the last write of each pixel wins. ``log``: edit, undone, stack, y, x, value."""
    e = log.where(~F.col("undone"))
    if upto is not None:
        e = e.where(F.col("edit") <= upto)
    last = e.groupBy(*A.PIXEL).agg(F.max_by(value, "edit").alias("_v"))
    return image.join(last, A.PIXEL, "left").withColumn(value, F.coalesce("_v", value)).drop("_v")


def undo(log: DataFrame, keep: int = 20) -> DataFrame:
    """The log with its last live edit undone; edits older than the last ``keep`` cannot be."""
    live = log.where(~F.col("undone")).groupBy("stack").agg(F.max("edit").alias("_last"))
    top = log.groupBy("stack").agg(F.max("edit").alias("_top"))
    j = log.join(live.join(top, "stack"), "stack", "left")
    return j.withColumn("undone", F.col("undone") | ((F.col("edit") == F.col("_last")) & (F.col("edit") > F.col("_top") - keep))).select(*log.columns)


def redo(log: DataFrame) -> DataFrame:
    """The log with the edit that was undone last live again: the first of those after the last live one."""
    live = log.groupBy("stack").agg(F.max(F.when(~F.col("undone"), F.col("edit"))).alias("_last"))
    j = log.join(live, "stack")
    after = F.col("undone") & (F.col("edit") > F.coalesce("_last", F.lit(-1)))
    first = j.where(after).groupBy("stack").agg(F.min("edit").alias("_first"))
    return j.join(first, "stack", "left").withColumn("undone", F.col("undone") & F.coalesce(F.col("edit") != F.col("_first"), F.lit(True))).select(*log.columns)


def recorded(log: DataFrame, stroke: DataFrame) -> DataFrame:
    """The log after a new edit, which ends what could be redone: edits undone before it are dropped."""
    return log.where(~F.col("undone")).unionByName(stroke.withColumn("undone", F.lit(False)))


def undoable(log: DataFrame, strokes: int = 20, budget: int = 256 << 20, tile: int = 256, pixel_bytes: int = 16) -> DataFrame:
    """stack, edit, bytes, kept: what each live edit's undo holds (the tiles it touched) and whether it still can be undone.

    From the newest edit on, ``strokes`` are kept and no more than ``budget`` bytes, the newest always: a running sum,
    evicting the oldest. An evicted edit stays in the image."""
    from pyspark.sql import Window as W

    tiles = log.where(~F.col("undone")).select("stack", "edit", F.floor(F.col("y") / tile).alias("_ty"), F.floor(F.col("x") / tile).alias("_tx")).distinct()
    size = tiles.groupBy("stack", "edit").agg((F.count(F.lit(1)) * (tile * tile * pixel_bytes)).cast("long").alias("bytes"))
    back = W.partitionBy("stack").orderBy(F.desc("edit")).rowsBetween(W.unboundedPreceding, 0)  # a row for each edit of a stack
    d = size.withColumn("_n", F.count(F.lit(1)).over(back)).withColumn("_b", F.sum("bytes").over(back))
    return d.select("stack", "edit", "bytes", ((F.col("_n") == 1) | ((F.col("_n") <= strokes) & (F.col("_b") <= budget))).alias("kept"))


def sharpest(energy: DataFrame, cy: float, cx: float, radius: float, value: str = "v") -> DataFrame:
    """stack, frame, score of the sharpest frame under a disk; none where the best score is 0; ties to the first."""
    s = A.region_scores(energy, cy, cx, radius, value).withColumn("score", F.round("score", 12))
    b = s.groupBy("stack").agg(F.max_by(F.struct("frame", "score"), F.struct("score", -F.col("frame"))).alias("b")).select("stack", "b.*")
    return b.where("score > 0")


def merge_depth(base: DataFrame, edited: DataFrame) -> DataFrame:
    """Edited depths over the base's; ``edited`` holds the touched pixels only."""
    return base.join(edited.select(*A.PIXEL, F.col("d").alias("_d")), A.PIXEL, "left").select(*A.PIXEL, F.coalesce("_d", "d").alias("d"))


def revert_depth(edited: DataFrame, region: DataFrame) -> DataFrame:
    """The edits without those inside a region (stack, y, x): merged again, the base shows there."""
    return edited.join(region.select(*A.PIXEL), A.PIXEL, "left_anti")


def settings_hash(settings: dict, frames: list[str]) -> str:
    """Changes whenever a setting or the list of frames does."""
    return hashlib.sha256(json.dumps([settings, frames], sort_keys=True).encode()).hexdigest()


def stale(results: DataFrame, current: DataFrame) -> DataFrame:
    """stack, stale: the stored hash differs from the current one or is missing; both: stack, hash."""
    return current.join(results.select("stack", F.col("hash").alias("_h")), "stack", "left").select("stack", (~F.col("hash").eqNullSafe(F.col("_h"))).alias("stale"))


def status_counts(stacks: DataFrame) -> DataFrame:
    """pending, fused over enabled stacks; ``stacks``: enabled, fused."""
    return stacks.agg(F.count_if(F.col("enabled") & ~F.col("fused")).alias("pending"), F.count_if("fused").alias("fused"))


def batch(px: DataFrame, stacks: DataFrame, fuse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One job over all enabled stacks: the stack is a key of every operator."""
    return fuse(px.join(stacks.where("enabled").select("stack"), "stack", "left_semi"))


def admitted(stacks: DataFrame, memory: int, per_pixel: int = 150, fixed: int = 2 << 30) -> DataFrame:
    """Stacks whose second fuse fits: pixels * per_pixel + fixed <= memory."""
    return stacks.withColumn("admitted", F.col("height").cast("long") * F.col("width") * per_pixel + fixed <= memory)


def cancel(spark: SparkSession, tag: str) -> list[str]:
    """Interrupt the jobs that were started under ``spark.addTag(tag)``."""
    return spark.interruptTag(tag)
