"""Synthetic focus stacks with ground truth: five scenes, breathing, jitter, flicker and noise.

The frame count is forced odd, the middle frame is the untransformed reference, frame f focuses at f / (n - 1).
Pixels are made where they are needed: one task for each frame, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCENES = ("plane", "object", "brightObject", "whiteOnWhite", "foreground")


@dataclass(frozen=True)
class Synth:
    scene: str = "plane"
    height: int = 96
    width: int = 128
    frames: int = 9
    blur: float = 6.0
    breathing: float = 0.0
    jitter: float = 0.0
    flicker: float = 0.0
    noise: float = 0.0
    seed: int = 42

    @property
    def n(self) -> int:
        return self.frames | 1


def uniform(seed: int, *keys: np.ndarray) -> np.ndarray:
    """A hash of integer keys to 0..1 (64-bit, wrapping)."""
    h = np.full(np.broadcast_shapes(*[np.shape(k) for k in keys]), np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    for k in keys:
        h = (h ^ np.asarray(k, np.int64).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return (h >> np.uint64(11)).astype(np.float64) / (1 << 53)


def normal(seed: int, *keys: np.ndarray) -> np.ndarray:
    """Box-Muller."""
    u, v = np.maximum(uniform(seed, *keys), 1e-12), uniform(seed + 1, *keys)
    return np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)


def texture(s: Synth, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Value noise of three octaves, h x w x 3, in 0..1."""
    out = np.zeros((*y.shape, 3))
    for o, (cell, weight) in enumerate(((3, 0.5), (7, 0.3), (17, 0.2))):
        gy, gx = y / cell, x / cell
        y0, x0 = np.floor(gy).astype(int), np.floor(gx).astype(int)
        fy, fx = gy - y0, gx - x0
        for c in range(3):
            v = lambda a, b: uniform(s.seed + 31 * o + c, a, b)
            top = v(y0, x0) * (1 - fx) + v(y0, x0 + 1) * fx
            out[..., c] += weight * (top * (1 - fy) + (v(y0 + 1, x0) * (1 - fx) + v(y0 + 1, x0 + 1) * fx) * fy)
    return out


def scene(s: Synth, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Colours (h x w x 3) and depth (0..1) of the scene at any places."""
    depth = 0.75 * x / (s.width - 1) + 0.25 * y / (s.height - 1)
    rgb = 0.15 + 0.7 * texture(s, y, x)
    r = np.hypot((y - s.height / 2) / (0.35 * s.height), (x - s.width / 2) / (0.35 * s.width))
    inside = r < 1
    if s.scene == "object":
        depth = np.where(inside, 0.35 + 0.3 * r, 0.9)
    elif s.scene == "brightObject":
        depth, rgb = np.where(inside, 0.35 + 0.3 * r, 0.9), np.where(inside[..., None], 0.5 + 0.5 * rgb, 0.02)
    elif s.scene == "whiteOnWhite":
        depth, rgb = np.where(inside, 0.35 + 0.3 * r, 0.9), np.where(inside[..., None], 0.8 + 0.15 * rgb, 0.96)
    elif s.scene == "foreground":
        bar = np.abs(x - s.width * 0.3) < s.width * 0.06
        depth, rgb = np.where(bar, 0.1, 0.4 + 0.5 * depth), np.where(bar[..., None], 0.3 * rgb, rgb)
    return rgb, np.clip(depth, 0, 1)


def blurred(a: np.ndarray, sigma: float) -> np.ndarray:
    if sigma < 0.05:
        return a
    r = int(np.ceil(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        p = np.pad(a, [(r, r) if i == axis else (0, 0) for i in range(3)], mode="edge")
        a = sum(w * np.take(p, range(i, i + a.shape[axis]), axis=axis) for i, w in enumerate(k))
    return a


def frame_params(s: Synth) -> pd.DataFrame:
    """frame, focus, scale, jx, jy, gain."""
    f = np.arange(s.n)
    mid = s.n // 2
    still = f == mid
    j = lambda k: np.where(still, 0.0, (uniform(s.seed + k, f) * 2 - 1) * s.jitter)
    return pd.DataFrame({"frame": f.astype("int32"), "focus": f / (s.n - 1), "scale": 1 + s.breathing * (f - mid) / max(1, mid), "jx": j(7), "jy": j(8), "gain": np.where(still, 1.0, 1 + (uniform(s.seed + 9, f) * 2 - 1) * s.flicker)})


def frame_pixels(s: Synth, p) -> np.ndarray:
    """One frame: the scene in layers of equal defocus, seen through the frame's similarity."""
    cy, cx = (s.height - 1) / 2, (s.width - 1) / 2
    yy, xx = np.meshgrid(np.arange(s.height, dtype=float), np.arange(s.width, dtype=float), indexing="ij")
    sy, sx = (yy - cy) / p.scale + cy + p.jy, (xx - cx) / p.scale + cx + p.jx
    rgb, depth = scene(s, sy, sx)
    steps = 9
    out, total = np.zeros_like(rgb), np.zeros(depth.shape)
    defocus = np.abs(depth - p.focus) * s.blur
    grid = np.linspace(0, s.blur, steps)
    stack = [blurred(rgb, g) for g in grid]
    at = defocus / s.blur * (steps - 1) if s.blur > 0 else np.zeros_like(defocus)
    for i, layer in enumerate(stack):
        w = np.maximum(0, 1 - np.abs(at - i))
        out += w[..., None] * layer
        total += w
    out = out / total[..., None] * p.gain
    if s.noise > 0:
        yi, xi = yy.astype(int), xx.astype(int)
        out += np.stack([normal(s.seed + 101 + c, yi, xi, np.full_like(yi, p.frame)) for c in range(3)], -1) * s.noise
    return np.clip(out, 0, 1)


def pixels(spark: SparkSession, scenes: dict[int, Synth]) -> DataFrame:
    """stack, frame, y, x, r, g, b, a of every scene by stack number."""
    rows = [(k, int(p.frame), float(p.focus), float(p.scale), float(p.jx), float(p.jy), float(p.gain)) for k, s in scenes.items() for p in frame_params(s).itertuples()]
    df = spark.createDataFrame(rows, "stack int, frame int, focus double, scale double, jx double, jy double, gain double").repartition(len(rows), "stack", "frame")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p in part.itertuples():
                s = scenes[p.stack]
                v = frame_pixels(s, p)
                yy, xx = np.meshgrid(np.arange(s.height), np.arange(s.width), indexing="ij")
                yield pd.DataFrame({"stack": p.stack, "frame": p.frame, "y": yy.ravel().astype("int32"), "x": xx.ravel().astype("int32"), "r": v[..., 0].ravel(), "g": v[..., 1].ravel(), "b": v[..., 2].ravel(), "a": 1.0})

    return df.mapInPandas(run, "stack int, frame int, y int, x int, r double, g double, b double, a double")


def tiles(spark: SparkSession, scenes: dict[int, Synth], tile: int = 128) -> DataFrame:
    """The frames as packed tiles with a halo of one pixel: see operators.tiles."""
    from ..operators.tiles import RGB_TILE, cut_frame

    rows = [(k, int(p.frame), float(p.focus), float(p.scale), float(p.jx), float(p.jy), float(p.gain)) for k, s in scenes.items() for p in frame_params(s).itertuples()]
    df = spark.createDataFrame(rows, "stack int, frame int, focus double, scale double, jx double, jy double, gain double").repartition(len(rows), "stack", "frame")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p in part.itertuples():
                cuts = list(cut_frame(frame_pixels(scenes[p.stack], p), tile))
                yield pd.DataFrame([(p.stack, p.frame, *c) for c in cuts], columns=["stack", "frame", "ty", "tx", "y0", "x0", "h", "w", "px"])

    return df.mapInPandas(run, RGB_TILE)


def squares(spark: SparkSession, scenes: dict[int, Synth], grid, halo: int | None = None, alpha: bool = False) -> DataFrame:
    """The frames as tiles of planes: see operators.pyramid_tiles."""
    from ..operators.pyramid_tiles import COLUMNS, TILES, cut_frames

    rows = [(k, int(p.frame), float(p.focus), float(p.scale), float(p.jx), float(p.jy), float(p.gain)) for k, s in scenes.items() for p in frame_params(s).itertuples()]
    df = spark.createDataFrame(rows, "stack int, frame int, focus double, scale double, jx double, jy double, gain double").repartition(len(rows), "stack", "frame")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p in part.itertuples():
                a = np.moveaxis(frame_pixels(scenes[p.stack], p), 2, 0)
                a = np.concatenate([a, np.ones((1, *a.shape[1:]))]) if alpha else a
                yield pd.DataFrame(list(cut_frames(a, grid, p.stack, p.frame, halo)), columns=COLUMNS)

    return df.mapInPandas(run, TILES)


def truth(spark: SparkSession, scenes: dict[int, Synth]) -> DataFrame:
    """stack, y, x, r, g, b, d: what a perfect fuse shows, and depth in frames."""
    df = spark.createDataFrame([(k,) for k in scenes], "stack int").repartition(len(scenes), "stack")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k in part["stack"]:
                s = scenes[int(k)]
                yy, xx = np.meshgrid(np.arange(s.height, dtype=float), np.arange(s.width, dtype=float), indexing="ij")
                rgb, d = scene(s, yy, xx)
                yield pd.DataFrame({"stack": k, "y": yy.ravel().astype("int32"), "x": xx.ravel().astype("int32"), "r": rgb[..., 0].ravel(), "g": rgb[..., 1].ravel(), "b": rgb[..., 2].ravel(), "d": (d * (s.n - 1)).ravel()})

    return df.mapInPandas(run, "stack int, y int, x int, r double, g double, b double, d double")
