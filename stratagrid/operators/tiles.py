"""Depth from focus on tiles: the scale path of the long-form operators.

A tile row holds a frame's colours inside a square and a halo of one pixel, packed as 32-bit floats; the rows of
one square of all frames meet in one task (frames x tile pixels, so a bounded group), and the focus measure, the
sharpest frame and the render about it are a few numpy passes over them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import pixel as P

RGB_TILE = "stack int, frame int, ty int, tx int, y0 int, x0 int, h int, w int, px binary"
FUSED = "stack int, ty int, tx int, y0 int, x0 int, h int, w int, px binary"


def cut_frame(image: np.ndarray, tile: int) -> Iterator[tuple[int, int, int, int, int, int, bytes]]:
    """(ty, tx, y0, x0, h, w, bytes) of a frame's tiles (height x width x 3), with a halo of one pixel inside the raster."""
    height, width = image.shape[:2]
    for ty in range(-(-height // tile)):
        for tx in range(-(-width // tile)):
            y0, x0 = max(0, ty * tile - 1), max(0, tx * tile - 1)
            part = image[y0 : min(height, (ty + 1) * tile + 1), x0 : min(width, (tx + 1) * tile + 1)]
            yield ty, tx, y0, x0, part.shape[0], part.shape[1], part.astype("<f4").tobytes()


def focus(lum: np.ndarray) -> np.ndarray:
    """Squared 4-neighbour Laplacian, the edge repeated (right but for a halo's own rim)."""
    e = lum * np.float32(-4)
    e[1:] += lum[:-1]
    e[:1] += lum[:1]
    e[:-1] += lum[1:]
    e[-1:] += lum[-1:]
    e[:, 1:] += lum[:, :-1]
    e[:, :1] += lum[:, :1]
    e[:, :-1] += lum[:, 1:]
    e[:, -1:] += lum[:, -1:]
    e *= e
    return e


def fuse_tiles(tiles: DataFrame, height: int, width: int, tile: int, radius: float = 1.0, floor: float = 1e-6) -> DataFrame:
    """stack, ty, tx, y0, x0, h, w and px: for each pixel of a tile (without halo) r, g, b and depth, as 32-bit floats.

    The sharpest frame wins (the first of equals, frame 0 where nothing is above 0); colours are the average of
    the frames about it with weight max(1 - |frame - depth| / radius, 0) + floor."""
    luma = [np.float32(v) for v in P.LUMA]
    r = max(radius, 0.75)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("frame")
        h, w = int(p["h"].iloc[0]), int(p["w"].iloc[0])
        frames = [np.frombuffer(b, "<f4").reshape(h, w, 3) for b in p["px"]]
        numbers = p["frame"].to_numpy()
        best, depth = np.zeros((h, w), np.float32), np.zeros((h, w), np.float32)
        for n, f in zip(numbers, frames):
            e = focus(f[..., 0] * luma[0] + f[..., 1] * luma[1] + f[..., 2] * luma[2])
            up = e > best
            best[up], depth[up] = e[up], n
        ty, tx, y0, x0 = (int(p[c].iloc[0]) for c in ("ty", "tx", "y0", "x0"))
        top, left = ty * tile - y0, tx * tile - x0
        own = slice(top, top + min(tile, height - ty * tile)), slice(left, left + min(tile, width - tx * tile))
        d = depth[own]
        total, out = np.zeros(d.shape, np.float32), np.zeros((*d.shape, 3), np.float32)
        lo, hi = d.min() - r, d.max() + r
        for n, f in zip(numbers, frames):
            if lo < n < hi:  # a frame that no pixel of the tile can use adds next to nothing
                k = np.maximum(1 - np.abs(n - d) / np.float32(r), 0) + np.float32(floor)
                total += k
                out += f[own] * k[..., None]
        out = np.concatenate([out / total[..., None], d[..., None]], 2)
        return pd.DataFrame([(int(p["stack"].iloc[0]), ty, tx, ty * tile, tx * tile, *d.shape, out.astype("<f4").tobytes())], columns=["stack", "ty", "tx", "y0", "x0", "h", "w", "px"])

    return tiles.groupBy("stack", "ty", "tx").applyInPandas(run, FUSED)


def pixels(fused: DataFrame) -> DataFrame:
    """stack, y, x, r, g, b, d of fused tiles."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for t in p.itertuples(index=False):
                a = np.frombuffer(t.px, "<f4").reshape(-1, 4).astype(float)
                y, x = np.divmod(np.arange(t.h * t.w), t.w)
                yield pd.DataFrame({"stack": t.stack, "y": (y + t.y0).astype("int32"), "x": (x + t.x0).astype("int32"), "r": a[:, 0], "g": a[:, 1], "b": a[:, 2], "d": a[:, 3]})

    return fused.mapInPandas(run, "stack int, y int, x int, r double, g double, b double, d double")
