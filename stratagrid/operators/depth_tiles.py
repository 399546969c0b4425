"""Depth from focus with all its options on tiles: what touches every frame runs on packed squares with a halo.

One pass measures focus of all frames of a square (exposure, both blurs, the quarter grid), keeps the winner of each pixel
and the cell means of energy and light of each frame; another renders about the depth. In between the depth is made
whole by the long form's operators, on planes of one value a pixel and grids of cells (:func:`dmap.regularized`). Results
equal :func:`dmap.fuse` but for rounding. A task's group is bounded by frames * (tile + 2 * halo) ** 2 pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixel as P
from . import aggregate as A
from . import components as C
from . import dmap as D
from . import pyramid_tiles as PT
from . import stencil as S

GAINS = ["gain", "gain_r", "gain_g", "gain_b"]


def halo(o: D.Options) -> int:
    """Places around a square that focus needs, a multiple of 8."""
    reach = lambda s: len(P.gaussian_kernel(s)) // 2 if s > 0.01 else 0
    far = 4 * (reach(o.sharpness_sigma / 4) + 3) if o.sharpness_sigma >= 4 else reach(o.sharpness_sigma)
    return -(-(reach(o.focus_pre_sigma) + 1 + far) // 8) * 8


def gained(tiles: DataFrame, g: PT.Grid, on: bool) -> DataFrame:
    """The tiles with each frame's gains: ``gain`` of its luminance against the first frame's, and those of the render."""
    if not on:
        return tiles.select(*PT.COLUMNS, *[F.lit(1.0).alias(c) for c in GAINS])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch.itertuples(index=False):
                a, b, c, d = g.square(0, t.ty, t.tx)
                own = np.frombuffer(t.px, g.dtype).reshape(4, t.h, t.w)[:, a - t.y0 : b - t.y0, c - t.x0 : d - t.x0].astype(float)
                own = own[:, (np.arange(a, b)[:, None] * g.width + np.arange(c, d)) % 7 == 0]
                out.append((t.stack, t.frame, own.shape[1], float(own[3].sum()), *[float((own[i] * own[3]).sum()) for i in range(3)]))
            yield pd.DataFrame(out, columns=["stack", "frame", "n", "a", "r", "g", "b"])

    s = tiles.mapInPandas(sums, "stack int, frame int, n long, a double, r double, g double, b double").groupBy("stack", "frame").agg(*[F.sum(c).alias(c) for c in ("n", "a", "r", "g", "b")])
    mean = lambda c: F.when(F.col("a") > 0, F.col(c) / F.when(F.col("a") > 0, F.col("a"))).otherwise(F.lit(0.0)).alias(c)
    gain = A.exposure_gain(s.where("n > 0").select("stack", "frame", *[mean(c) for c in "rgb"]))
    both = C.cut(gain.select("stack", "frame", "gain").join(A.render_gains(gain.drop("gain")), ["stack", "frame"]))  # a row for each frame
    return tiles.join(both, ["stack", "frame"], "left").select(*PT.COLUMNS, *[F.coalesce(c, F.lit(1.0)).alias(c) for c in GAINS])


def focus(lum: np.ndarray, o: D.Options, g: PT.Grid, y0: int, x0: int) -> np.ndarray:
    """Focus energy of a region that begins at (y0, x0), multiples of 4; right but for the rim of its halo."""
    d = PT.blurred(lum, o.focus_pre_sigma) if o.focus_pre_sigma > 0.01 else lum
    e = S.kernel_laplacian(d)
    if o.sharpness_sigma <= 0.01:
        return e
    if o.sharpness_sigma < 4:
        return PT.blurred(e, o.sharpness_sigma)
    small = PT.blurred(PT.pooled(e, 4) / PT.pooled(np.ones_like(e), 4), o.sharpness_sigma / 4)

    def places(n: int, first: int, size: int, whole: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower and upper row of ``small`` and the weight of the upper one, for each of ``size`` places."""
        p = np.clip((np.arange(first, first + size) + 0.5) * (n / whole) - 0.5, 0, n - 1) - first // 4
        lo = np.floor(p).astype(int)
        return np.clip(lo, 0, None), np.clip(lo + 1, 0, None), (p - lo).astype(e.dtype)

    h, w = e.shape
    a, b, f = places(-(-g.height // 4), y0, h, g.height)
    rows = small[np.minimum(a, len(small) - 1)] * (1 - f)[:, None] + small[np.minimum(b, len(small) - 1)] * f[:, None]
    a, b, f = places(-(-g.width // 4), x0, w, g.width)
    return rows[:, np.minimum(a, small.shape[1] - 1)] * (1 - f) + rows[:, np.minimum(b, small.shape[1] - 1)] * f


def measured(tiles: DataFrame, g: PT.Grid, o: D.Options) -> DataFrame:
    """Of each square, kind ``best``: planes energy, frame and guide of the winners; kind ``cube``, for each frame: planes of the cell means of
    energy and of luminance. ``tiles``: as :func:`gained` gives them."""
    side = halo(o)

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        stack, ty, tx = (int(v) for v in key)
        y0, y1, x0, x1 = g.square(0, ty, tx, margin=side)
        a, b, c, d = g.square(0, ty, tx)
        own = slice(a - y0, b - y0), slice(c - x0, d - x0)
        f = o.downsample
        n = PT.pooled(np.ones((b - a, d - c)), f)
        out, best = [], None
        for r in p.sort_values("frame").itertuples(index=False):
            px = np.frombuffer(r.px, g.dtype).reshape(4, y1 - y0, x1 - x0)
            lum = PT.luma(px) * px.dtype.type(r.gain)
            e = focus(lum, o, g, y0, x0)[own]
            cells = np.stack([PT.pooled(e, f) / n, PT.pooled(lum[own], f) / n])
            out.append((stack, ty, tx, "cube", 0, r.frame, a // f, c // f, *n.shape, cells.astype(g.dtype).tobytes()))
            score = np.nan_to_num(e * px[3][own], nan=0.0, posinf=np.inf)
            score = np.maximum(score, 0)
            if best is None:
                best, frame, guide = score, np.full(e.shape, float(r.frame)), lum[own].copy()
            else:
                up = score > best
                best, frame, guide = np.where(up, score, best), np.where(up, r.frame, frame), np.where(up, lum[own], guide)
        frame = np.where(best > 0, frame, 0)
        out.append((stack, ty, tx, "best", 0, -1, a, c, b - a, d - c, np.stack([best, frame, guide]).astype(g.dtype).tobytes()))
        return pd.DataFrame(out, columns=PT.COLUMNS)

    return tiles.groupBy("stack", "ty", "tx").applyInPandas(run, PT.TILES)


def rendered(tiles: DataFrame, depth: DataFrame, g: PT.Grid, o: D.Options, floor: float = 1e-6) -> DataFrame:
    """Kind ``base``: planes r, g, b, the tent render of every square. ``depth``: stack, y, x, d."""
    r = max(o.blend_radius, 0.75)
    span = depth.groupBy("stack").agg((F.min("d") - r).alias("l"), (F.max("d") + r).alias("u"))  # a row for each stack
    parts = PT.from_pixels(depth.join(span, "stack").withColumn("frame", F.lit(-1)), g, 0, "dlu")
    parts = parts.select(*PT.COLUMNS, *[F.lit(1.0).alias(c) for c in GAINS])

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        stack, ty, tx = (int(v) for v in key)
        a, b, c, d = g.square(0, ty, tx)
        at = p[p["frame"] < 0]
        if not len(at):
            return pd.DataFrame([], columns=PT.COLUMNS)
        depth, low, high = np.frombuffer(at.iloc[0]["px"], g.dtype).reshape(3, b - a, d - c)
        total, out = np.zeros(depth.shape), np.zeros((3, *depth.shape))
        for t in p[p["frame"] >= 0].sort_values("frame").itertuples(index=False):
            if low.flat[0] < t.frame < high.flat[0]:
                px = np.frombuffer(t.px, g.dtype).reshape(4, t.h, t.w)[:, a - t.y0 : b - t.y0, c - t.x0 : d - t.x0]
                k = (np.maximum(1 - np.abs(t.frame - depth) / r, 0) + floor) * px[3]
                total += k
                for i, gain in enumerate((t.gain_r, t.gain_g, t.gain_b)):
                    out[i] += k * px[i] * gain
        out = np.where(total > 1e-7, out / np.where(total > 1e-7, total, 1), 0)
        return pd.DataFrame([(stack, ty, tx, "base", 0, -1, a, c, b - a, d - c, out.astype(g.dtype).tobytes())], columns=PT.COLUMNS)

    return tiles.unionByName(parts).groupBy("stack", "ty", "tx").applyInPandas(run, PT.TILES)


def dense(tiles: DataFrame) -> DataFrame:
    """The tiles with the frames of each stack numbered from 0 in their order."""
    index = C.cut(A.dense_frames(tiles.select("stack", "frame"))[1])  # a row for each frame
    j = tiles.withColumnRenamed("frame", "kept").join(index, ["stack", "kept"])
    return j.select(*PT.COLUMNS)


def from_pixels(px: DataFrame, g: PT.Grid, o: D.Options) -> DataFrame:
    """Tiles of long-form frames (stack, frame, y, x, r, g, b, a) with the halo that the options need."""
    return PT.from_pixels(px, g, halo(o.resolved(g.width, g.height)), "rgba")


def fuse(tiles: DataFrame, g: PT.Grid, o: D.Options | None = None, regularize: bool = True) -> tuple[DataFrame, DataFrame]:
    """(image in tiles of kind ``base``, depth as stack, y, x, d), as :func:`dmap.fuse` gives them of the same frames.

    ``tiles``: as :func:`from_pixels` makes them; a tile's side is a multiple of 8 and of ``o.downsample``."""
    o = (o or D.Options()).resolved(g.width, g.height)
    if g.tile % 8 or g.tile % o.downsample:
        raise ValueError("a tile's side must be a multiple of 8 and of the grid's factor")
    tiles = gained(dense(tiles), g, o.normalize_exposure)
    seen = C.cut(measured(tiles, g, o))
    win = C.cut(PT.long_form(seen.where("kind = 'best'"), ["energy", "_f", "g"], g.dtype).select(*A.PIXEL, "energy", F.col("_f").cast("int").alias("frame"), "g"))
    depth = win.select(*A.PIXEL, F.col("frame").cast("double").alias("d"))
    if regularize:
        cube = C.cut(PT.long_form(seen.where("kind = 'cube'"), ["e", "l"], g.dtype))
        frames = C.cut(tiles.groupBy("stack").agg(F.countDistinct("frame").alias("n")))
        key = ["stack", "frame", "y", "x"]
        depth = D.regularized(win, cube.select(*key, F.col("e").alias("v")), cube.select(*key, F.col("l").alias("v")), frames, g.height, g.width, o)
    return rendered(tiles, depth, g, o), depth
