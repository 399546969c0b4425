"""Joins of planes, frames, depths and labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import pixel as P
from .aggregate import PIXEL


def pixel_join(a: DataFrame, b: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Planes on one raster: an equi-join on the pixel."""
    return a.join(b, key or PIXEL)


def with_frame_params(px: DataFrame, params: DataFrame) -> DataFrame:
    """Per-frame parameters on pixels. A frame table has a row for each image, so Spark's size check decides on broadcasting it."""
    return px.join(params, ["stack", "frame"])


def band_join(depth: DataFrame, frames: DataFrame, radius: float) -> DataFrame:
    """Pairs with |frame - depth| < radius, by exploding the few frames of the band and an equi-join."""
    lo, hi = F.ceil(F.col("d") - radius).cast("int"), F.floor(F.col("d") + radius).cast("int")
    near = depth.withColumn("frame", F.explode(F.sequence(lo, F.greatest(lo, hi))))
    return near.where(F.abs(F.col("frame") - F.col("d")) < radius).join(frames, ["stack", "frame"])


#: Side of the blocks of pixels that sampling joins, in rasters that are larger.
BLOCK = 16


def sampled(df: DataFrame, src: DataFrame, at: tuple[Column, Column], reach: tuple[int, int], height: int, width: int, value: str, key: tuple[str, ...], rest: list[str], kernel: Callable[[dict[str, np.ndarray], Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]], tuple[np.ndarray, dict[str, np.ndarray]]], names: list[str]) -> DataFrame:
    """``rest`` of ``df`` and ``names`` (double), by what the kernel reads from ``src``.

    A pixel of ``df`` reads pixels of one block of ``src`` and its rim: from ``reach[0]`` before to ``reach[1]`` after its place ``at``
    (whole numbers), clamped to the raster. Both sides are packed, a row for each block of either (``df``'s pixels by their own
    place too, so that no row holds more than a block of them), so one row a block is joined instead of one for each tap, and a
    batch of blocks is read at once. ``kernel`` gets the columns of ``df`` and a function from places to (values, 0 where nothing is
    known; whether ``src`` has a row there; whether that holds a value); it gives which pixels have a result, and the results,
    NaN for null where masked."""
    before, after = reach
    size = min(BLOCK, max(height, width))
    last = lambda n: F.lit((n - 1) // size)

    def blocks(c: str, n: int) -> Column:
        # the blocks whose rim, clamped to the raster, holds the pixel
        lo = F.greatest(F.floor((F.col(c) - after) / size), F.lit(0)).cast("int")
        return F.sequence(lo, F.least(F.floor((F.col(c) + before) / size), last(n)).cast("int"))

    block = lambda c, n: F.least(F.greatest(F.floor(c / size), F.lit(0)), last(n)).cast("int")
    s = src.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).select(*key, "y", "x", F.col(value).cast("double").alias("_v"))
    s = s.withColumn("_by", F.explode(blocks("y", height))).withColumn("_bx", F.explode(blocks("x", width)))
    side = size + before + after
    place = ((F.col("y") - F.col("_by") * size + before) * side + F.col("x") - F.col("_bx") * size + before).cast("int")
    s = s.groupBy(*key, "_by", "_bx").agg(F.collect_list(F.struct(place.alias("p"), F.col("_v").alias("v"))).alias("_src"))
    d = df.withColumn("_by", block(at[0], height)).withColumn("_bx", block(at[1], width))
    own = [F.floor(F.col(c) / size).alias(f"_o{c}") for c in ("y", "x")]
    d = d.groupBy(*key, "_by", "_bx", *own).agg(F.collect_list(F.struct(*[c for c in df.columns if c not in key])).alias("_at"))
    j = d.join(s, [*key, "_by", "_bx"]).select(*key, "_by", "_bx", "_at", "_src")
    out = StructType([*[df.schema[c] for c in rest], *[StructField(n, DoubleType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pixels, known = batch["_at"], batch["_src"]
            group = np.repeat(np.arange(len(pixels)), pixels.value_lengths().to_numpy())
            flat = pixels.flatten()
            cols = dict(zip([f.name for f in flat.type], flat.flatten())) | {k: batch[k].take(pa.array(group)) for k in key}
            plane, there = np.zeros((len(known), side * side)), np.zeros((len(known), side * side), bool)
            full = there.copy()
            row = np.repeat(np.arange(len(known)), known.value_lengths().to_numpy())
            p, v = known.flatten().flatten()
            p = p.to_numpy()
            there[row, p], full[row, p] = True, v.is_valid().to_numpy(zero_copy_only=False)
            plane[row, p] = v.fill_null(0.0).to_numpy()
            by, bx = (batch[c].to_numpy()[group] * size - before for c in ("_by", "_bx"))
            base = group * (side * side)

            def read(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                i = base + (np.clip(y, 0, height - 1) - by) * side + np.clip(x, 0, width - 1) - bx  # noqa: B023
                return plane.ravel()[i], there.ravel()[i], full.ravel()[i]  # noqa: B023

            keep, got = kernel({n: c.to_numpy(zero_copy_only=False) for n, c in cols.items() if pa.types.is_primitive(c.type)}, read)
            whole = pa.RecordBatch.from_arrays([*[cols[c] for c in rest], *[pa.array(got[n].data, mask=got[n].mask) for n in names]], names=[*rest, *names])
            yield whole if keep.all() else whole.filter(pa.array(keep))

    return j.mapInArrow(run, out)


def gather(df: DataFrame, src: DataFrame, sy: str, sx: str, height: int, width: int, value: str = "v", key: tuple[str, ...] = ("stack",), out: str = "v") -> DataFrame:
    """Bilinear value of ``src`` at (sy, sx), edge-clamped; pixels that ``src`` lacks add nothing, and one that has none of its four is left out."""
    d = df.withColumn("_fy", P.clamp(F.col(sy), 0, height - 1).cast("double")).withColumn("_fx", P.clamp(F.col(sx), 0, width - 1).cast("double"))

    def kernel(c: dict[str, np.ndarray], read: Callable) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        y, x = np.floor(c["_fy"]).astype(int), np.floor(c["_fx"]).astype(int)
        fy, fx = c["_fy"] - y, c["_fx"] - x
        total, any_there, any_full = np.zeros(len(y)), np.zeros(len(y), bool), np.zeros(len(y), bool)
        for i in (0, 1):
            for j in (0, 1):
                v, there, full = read(y + i, x + j)
                total += (fy if i else 1 - fy) * (fx if j else 1 - fx) * v
                any_there |= there
                any_full |= full
        return any_there, {out: np.ma.array(total, mask=~any_full)}

    return sampled(d, src, (F.floor("_fy"), F.floor("_fx")), (0, 1), height, width, value, key, df.columns, kernel, [out])


def lanczos(t: np.ndarray) -> np.ndarray:
    """:func:`pixel.lanczos3` of an array."""
    p = np.pi * np.where(np.abs(t) < 1e-6, 1.0, t)
    return np.where(np.abs(t) < 1e-6, 1.0, np.where(np.abs(t) >= 3, 0.0, 3 * np.sin(p) * np.sin(p / 3) / (p * p)))


def warp_gather(out: DataFrame, src: DataFrame, h: list[float] | list[Column], height: int, width: int, value: str = "v", key: tuple[str, ...] = ("stack", "frame")) -> DataFrame:
    """Lanczos-3 warp: for each output pixel the 6 x 6 source pixels about its mapped place, weights normalised,
    the result held within the least and greatest of the inner 2 x 2; alpha 0 outside by more than half a pixel.
    ``h`` (output place -> source place) may be columns of ``out``."""
    sx, sy = P.project(h, F.col("x").cast("double"), F.col("y").cast("double"))
    d = out.select(*key, "y", "x", sy.alias("_sy"), sx.alias("_sx"))
    inside = (F.col("_sy") >= -0.5) & (F.col("_sy") <= height - 0.5) & (F.col("_sx") >= -0.5) & (F.col("_sx") <= width - 0.5)
    d = d.withColumn("a", F.when(inside, 1.0).otherwise(0.0))

    def kernel(c: dict[str, np.ndarray], read: Callable) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        lost = np.isnan(c["_sy"]) | np.isnan(c["_sx"])  # null too
        sy, sx = np.where(lost, 0.0, c["_sy"]), np.where(lost, 0.0, c["_sx"])
        iy, ix = np.floor(sy), np.floor(sx)
        wy, wx = ([lanczos(s - i - k) for k in range(-2, 4)] for s, i in ((sy, iy), (sx, ix)))
        # beyond the raster's rim all taps are the edge's, so places far off may be drawn near
        iy, ix = np.clip(iy, -4, height + 4).astype(int), np.clip(ix, -4, width + 4).astype(int)
        n, d = np.zeros(len(iy)), np.zeros(len(iy))
        lo, hi = np.full(len(iy), np.inf), np.full(len(iy), -np.inf)
        any_there, inner = np.zeros(len(iy), bool), np.zeros(len(iy), bool)
        for i in range(-2, 4):
            for j in range(-2, 4):
                v, there, full = read(iy + i, ix + j)
                w = wy[i + 2] * wx[j + 2]
                n += w * v
                d += np.where(there, w, 0.0)
                any_there |= there
                if 0 <= i <= 1 and 0 <= j <= 1:
                    lo, hi, inner = np.where(full, np.fmin(lo, v), lo), np.where(full, np.maximum(hi, v), hi), inner | full  # NaN counts as the greatest
        with np.errstate(divide="ignore", invalid="ignore"):
            return any_there, {value: np.ma.array(np.fmin(np.maximum(n / d, lo), hi), mask=lost | ~inner)}

    lost = F.col("_sy").isNull() | F.col("_sx").isNull() | F.isnan("_sy") | F.isnan("_sx")
    at = tuple(F.when(lost, F.lit(0)).otherwise(F.floor(P.clamp(F.col(c), -4, n + 4))) for c, n in (("_sy", height), ("_sx", width)))
    got = sampled(d, src, at, (2, 3), height, width, value, key, [*key, "y", "x", "a"], kernel, [value])
    return got.select(*key, "y", "x", value, "a")


def adjacent_pairs(frames: DataFrame) -> DataFrame:
    """stack, frame, other: neighbours in frame order."""
    return frames.select("stack", "frame", F.lead("frame").over(W.partitionBy("stack").orderBy("frame")).alias("other")).where("other IS NOT NULL")


def nearest_survivor(frames: DataFrame, survivors: DataFrame) -> DataFrame:
    """For each frame the survivor least far away; the first of equals. Two ordered windows instead of a range join."""
    s = survivors.select("stack", "frame").withColumn("_s", F.lit(True))
    f = frames.select("stack", "frame").join(s, ["stack", "frame"], "left")
    at = F.when(F.col("_s"), F.col("frame"))
    before = F.last(at, True).over(W.partitionBy("stack").orderBy("frame").rowsBetween(W.unboundedPreceding, 0))
    after = F.last(at, True).over(W.partitionBy("stack").orderBy(F.desc("frame")).rowsBetween(W.unboundedPreceding, 0))  # a frame that only grows: one that shrinks is read anew for each row
    f = f.withColumn("_b", before).withColumn("_a", after)
    pick = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull(), F.col("_b")).when(F.col("frame") - F.col("_b") <= F.col("_a") - F.col("frame"), F.col("_b")).otherwise(F.col("_a"))
    return f.select("stack", "frame", pick.alias("nearest"))


def from_grid(px: DataFrame, grid: DataFrame, factor: int, rows: int, cols: int, value: str = "v", key: tuple[str, ...] = ("stack",), out: str = "v") -> DataFrame:
    """A grid's value at full resolution, bilinear about cell centres."""
    d = px.withColumn("_gy", (F.col("y") + 0.5) / factor - 0.5).withColumn("_gx", (F.col("x") + 0.5) / factor - 0.5)
    return gather(d, grid, "_gy", "_gx", rows, cols, value, key, out).drop("_gy", "_gx")


def with_label_stats(labels: DataFrame, stats: DataFrame) -> DataFrame:
    return labels.join(stats, ["stack", "label"])


def without_flagged(frames: DataFrame, issues: DataFrame, least: int = 2) -> DataFrame:
    """Frames without an issue, of the stacks that keep at least ``least`` of them."""
    kept = frames.join(issues.select("stack", "frame"), ["stack", "frame"], "left_anti")
    enough = kept.groupBy("stack").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("stack")
    return kept.join(enough, "stack", "left_semi")


def alignment_key(frames: DataFrame, path: str) -> DataFrame:
    """stack, key: hash of its ordered frame paths (an alignment can be looked up by it)."""
    return frames.groupBy("stack").agg(F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("frame", F.col(path).cast("string").alias("p")))), lambda s: s["p"])), 256).alias("key"))
