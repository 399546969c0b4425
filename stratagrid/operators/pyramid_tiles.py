"""Pyramid fusion on tiles: a level-keyed tile table whose halos are exchanged between rounds of levels.

A round takes ``ROUND`` levels at once. All frames of one square of a level's raster meet in one task, with a halo wide
enough for these levels; it keeps the selected bands of its square (with the few places around that collapsing needs)
and hands each frame's low-pass, without halo, to the next round. There the squares are cut anew, each part going to the
squares whose halo it touches. Since a round's raster is an eighth a side of the one before, what is shuffled is little
more than the frames themselves, once. Collapsing goes the other way, with one image instead of frames.

What needs a whole stack (order statistics, components, background) is done on planes of one value a pixel, in long form, by the
operators of :mod:`pmax`; only masks come back to the tiles. Results equal the long form's but for rounding.

The group of a task is bounded by frames * (tile + 2 * halo) ** 2 pixels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixel as P
from . import aggregate as A
from . import components as C
from . import pmax as M
from . import stencil as S

ROUND = 3
#: A tile or a part of one: the square (ty, tx) it belongs to, its place on the level's raster, its planes one after another.
TILES = "stack int, ty int, tx int, kind string, level int, frame int, y0 int, x0 int, h int, w int, px binary"
COLUMNS = [c.split()[0] for c in TILES.split(", ")]
_KEY = ["stack", "ty", "tx"]
GAINS = ["gain_r", "gain_g", "gain_b"]


@dataclass(frozen=True)
class Grid:
    """A raster of ``height`` x ``width`` pixels, fused over ``levels`` levels in squares of ``tile`` pixels."""

    height: int
    width: int
    tile: int
    levels: int
    dtype: str = "<f4"

    def size(self, level: int) -> tuple[int, int]:
        return -(-self.height // (1 << level)), -(-self.width // (1 << level))

    def rounds(self) -> list[tuple[int, int]]:
        """(first level, levels) of each round."""
        return [(a, min(ROUND, self.levels - a)) for a in range(0, self.levels, ROUND)]

    def halo(self, taken: int) -> int:
        """12 places at the last of ``taken`` levels: 6 for two low-passes, 3 for the blur of energies, 2 for collapsing."""
        return 12 << (taken - 1)

    def square(self, level: int, ty: int, tx: int, scale: int = 0, margin: int = 0) -> tuple[int, int, int, int]:
        """y0, y1, x0, x1 of a square of the raster of ``level``, ``scale`` levels further down, with a margin."""
        t, (h, w) = self.tile >> scale, self.size(level + scale)
        return max(0, ty * t - margin), min(h, (ty + 1) * t + margin), max(0, tx * t - margin), min(w, (tx + 1) * t + margin)


def margins(taken: int) -> list[int]:
    """Places around a square that collapsing needs at each of ``taken`` levels, and below them."""
    out = [0]
    for _ in range(taken):
        out.append(-(-out[-1] // 2) + 1)
    return out


def low_pass(a: np.ndarray) -> np.ndarray:
    """Five-tap blur of the last two axes, every second sample, the edge repeated."""
    for axis in (-1, -2):
        p = np.pad(a, [(0, 0)] * (a.ndim + axis) + [(2, 2)] + [(0, 0)] * (-axis - 1), mode="edge").swapaxes(axis, -1)
        n = a.shape[axis]
        s = lambda k: p[..., k : k + n : 2]  # noqa: E731, B023
        a = ((s(0) + s(4)) * a.dtype.type(S.BURT[0]) + (s(1) + s(3)) * a.dtype.type(S.BURT[1]) + s(2) * a.dtype.type(S.BURT[2])).swapaxes(axis, -1)
    return a


def expanded(a: np.ndarray) -> np.ndarray:
    """Twice the places along the last two axes: 1/8, 6/8, 1/8 at even and 1/2, 1/2 at odd ones, the edge repeated."""
    for axis in (-1, -2):
        v = a.swapaxes(axis, -1)
        p = np.concatenate([v[..., :1], v, v[..., -1:]], -1)
        out = np.empty((*v.shape[:-1], 2 * v.shape[-1]), a.dtype)
        out[..., 0::2] = (p[..., :-2] + p[..., 2:]) * a.dtype.type(0.125) + v * a.dtype.type(0.75)
        out[..., 1::2] = (v + p[..., 2:]) * a.dtype.type(0.5)
        a = out.swapaxes(axis, -1)
    return a


def blurred(a: np.ndarray, sigma: float) -> np.ndarray:
    k = [a.dtype.type(v) for v in P.gaussian_kernel(sigma)]
    r = len(k) // 2
    for axis in (1, 0):
        p = np.pad(a, [(r, r) if i == axis else (0, 0) for i in (0, 1)], mode="edge")
        n = a.shape[axis]
        part = lambda i: p[i : i + n] if axis == 0 else p[:, i : i + n]  # noqa: E731, B023
        out = part(r) * k[r]
        for i in range(r):
            out += (part(i) + part(2 * r - i)) * k[i]
        a = out
    return a


def pooled(a: np.ndarray, factor: int) -> np.ndarray:
    """Sums of factor x factor places, clipped at the far edges."""
    h, w = a.shape
    p = np.pad(a, ((0, -h % factor), (0, -w % factor)))
    return p.reshape(p.shape[0] // factor, factor, p.shape[1] // factor, factor).sum((1, 3), dtype=np.float64).astype(a.dtype)


def cells(y: np.ndarray, x: np.ndarray, level: int, height: int, width: int) -> np.ndarray:
    """How many pixels of the whole raster lie in the places (y, x) of a level."""
    f = 1 << level
    return np.multiply.outer(np.minimum(height, (y + 1) * f) - y * f, np.minimum(width, (x + 1) * f) - x * f)


def luma(a: np.ndarray) -> np.ndarray:
    return a[0] * a.dtype.type(P.LUMA[0]) + a[1] * a.dtype.type(P.LUMA[1]) + a[2] * a.dtype.type(P.LUMA[2])


def cut_frames(image: np.ndarray, g: Grid, stack: int, frame: int, halo: int | None = None) -> Iterator[tuple]:
    """Rows of a frame (planes x height x width), with the halo that the first round needs if no other is given."""
    halo = g.halo(g.rounds()[0][1]) if halo is None else halo
    for ty in range(-(-g.height // g.tile)):
        for tx in range(-(-g.width // g.tile)):
            a, b, c, d = g.square(0, ty, tx, margin=halo)
            yield stack, ty, tx, "frame", 0, frame, a, c, b - a, d - c, image[:, a:b, c:d].astype(g.dtype).tobytes()


def from_pixels(px: DataFrame, g: Grid, halo: int | None = None, names: str = "rgb") -> DataFrame:
    """Tiles with halo of long-form frames (stack, frame, y, x and the planes); a pixel goes to the few tiles that hold it."""
    halo = g.halo(g.rounds()[0][1]) if halo is None else halo

    t = S.cut_tiles(px, ("stack", "frame"), g.tile, halo, g.height, g.width, tuple(names), g.dtype)
    return t.withColumns({"kind": F.lit("frame"), "level": F.lit(0)}).select(*COLUMNS)


def exchanged(parts: DataFrame, g: Grid, level: int, halo: int, to_scale: int = 0) -> DataFrame:
    """Each part of a raster cut up for the squares of ``level`` whose halo it touches. With ``to_scale`` the parts lie that many
    levels further down and the squares are ``level``'s, as collapsing needs them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = g.tile >> to_scale
        h, w = g.size(level + to_scale)
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                a = np.frombuffer(r.px, g.dtype).reshape(-1, r.h, r.w)
                for ty in range(max(0, (r.y0 - halo) // t), min((h - 1) // t, (r.y0 + r.h - 1 + halo) // t) + 1):
                    for tx in range(max(0, (r.x0 - halo) // t), min((w - 1) // t, (r.x0 + r.w - 1 + halo) // t) + 1):
                        y0, y1, x0, x1 = g.square(level, ty, tx, to_scale, halo)
                        y0, y1, x0, x1 = max(y0, r.y0), min(y1, r.y0 + r.h), max(x0, r.x0), min(x1, r.x0 + r.w)
                        if y0 < y1 and x0 < x1:
                            out.append((r.stack, ty, tx, r.kind, r.level, r.frame, y0, x0, y1 - y0, x1 - x0, a[:, y0 - r.y0 : y1 - r.y0, x0 - r.x0 : x1 - r.x0].tobytes()))
            yield pd.DataFrame(out, columns=COLUMNS)

    return parts.mapInPandas(run, TILES)


def pasted(p: pd.DataFrame, g: Grid, y0: int, y1: int, x0: int, x1: int) -> np.ndarray:
    """The region of a raster that the parts of ``p`` fill."""
    one = p.iloc[0]
    if len(p) == 1 and (one.y0, one.x0, one.h, one.w) == (y0, x0, y1 - y0, x1 - x0):
        return np.frombuffer(one.px, g.dtype).reshape(-1, one.h, one.w)
    planes = len(one.px) // (np.dtype(g.dtype).itemsize * one.h * one.w)
    out = np.zeros((planes, y1 - y0, x1 - x0), g.dtype)
    for r in p.itertuples(index=False):
        a = np.frombuffer(r.px, g.dtype).reshape(planes, r.h, r.w)
        out[:, r.y0 - y0 : r.y0 - y0 + r.h, r.x0 - x0 : r.x0 - x0 + r.w] = a
    return out


def each_frame(p: pd.DataFrame, g: Grid, y0: int, y1: int, x0: int, x1: int, level: int, taken: int) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """(frame, low-passes of colours, the blurred energy of the finest band of all, summed by place of ``level``)."""
    for frame, own in p[p["kind"] == "frame"].groupby("frame", sort=True):
        a = pasted(own, g, y0, y1, x0, x1)
        low = a[:3]
        if GAINS[0] in own.columns:
            low = low * own[GAINS].iloc[0].to_numpy().astype(a.dtype)[:, None, None]
        lows = [low]
        for _ in range(taken):
            lows.append(low_pass(lows[-1]))
        yield int(frame), lows, a[3] if len(a) > 3 else None


def band_of(lows: list[np.ndarray], k: int) -> np.ndarray:
    h, w = lows[k].shape[1:]
    return lows[k] - expanded(lows[k + 1])[:, :h, :w]


def energy_of(band: np.ndarray) -> np.ndarray:
    return np.abs(band[0]) + np.abs(band[1]) + np.abs(band[2])


class Selected:
    """The band of the frame with the most energy at each place; the first of equals."""

    def __init__(self) -> None:
        self.e = self.band = None

    def add(self, e: np.ndarray, band: np.ndarray) -> None:
        if self.e is None:
            self.e, self.band = e, band.copy()
            return
        up = e > self.e
        np.copyto(self.e, e, where=up)
        np.copyto(self.band, band, where=up)


class Tracked:
    """Four bands of each place: A most energy among frames in focus, B darkest, Q brightest, C most energy of all."""

    def __init__(self, threshold: float) -> None:
        self.threshold, self.c, self.a = threshold, Selected(), Selected()
        self.dark = self.bright = self.b = self.q = self.focused = None

    def add(self, band: np.ndarray, lum: np.ndarray, focus: np.ndarray) -> None:
        e = energy_of(band)
        live = focus > self.threshold
        self.c.add(e.copy(), band)
        self.a.add(np.where(live, e, -1), band)
        if self.dark is None:
            self.dark, self.bright, self.b, self.q, self.focused = lum.copy(), lum.copy(), band.copy(), band.copy(), live
            return
        self.focused = self.focused | live
        for best, kept, up in ((self.dark, self.b, lum < self.dark), (self.bright, self.q, lum > self.bright)):
            np.copyto(best, lum, where=up)
            np.copyto(kept, band, where=up)

    def merged(self, mask: np.ndarray, bg: np.ndarray, clean: np.ndarray) -> np.ndarray:
        bright = (bg > 0.5) & (np.abs(self.bright - clean) < np.abs(self.dark - clean))
        pick = np.where(self.focused, self.a.band, np.where(bright, self.q, self.b))
        return self.c.band + (pick - self.c.band) * mask


def fuse_round(parts: DataFrame, masks: DataFrame | None, g: Grid, level: int, taken: int, o: M.Options) -> DataFrame:
    """One round: rows of kind ``band`` (selected bands, with the margin that collapsing needs) and of kind ``frame`` (each frame's
    low-pass and energy sum below the round), or of kind ``base`` after the last one.

    ``masks``: parts of kind ``mask``, planes mask, bg, clean by level, for the gated levels."""
    last = level + taken == g.levels
    gated = range(max(1, g.levels - o.coarse_levels), g.levels) if o.coarse_levels else range(0)
    keep = margins(taken)
    carry = bool(o.coarse_levels)

    def run(key: tuple, p: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if not len(p):
            return pd.DataFrame([], columns=COLUMNS)
        stack, ty, tx = (int(v) for v in key)
        y0, y1, x0, x1 = g.square(level, ty, tx, margin=g.halo(taken))
        at = [(y0 >> k, x0 >> k) for k in range(taken + 1)]
        best: list = [Tracked(o.threshold) if level + k in gated else Selected() for k in range(taken)]
        out, base = [], Selected() if o.coarse_levels else None
        total, n = None, 0
        for frame, lows, sums in each_frame(p, g, y0, y1, x0, x1, level, taken):
            n += 1
            for k in range(taken):
                band = band_of(lows, k)
                if level == 0 and k == 0 and carry:
                    sums = blurred(energy_of(band), 1.0)
                    best[0].add(sums.copy(), band)
                elif level + k in gated:
                    h, w = band.shape[1:]
                    s = pooled(sums, 1 << k) if k else sums
                    yy, xx = np.arange(at[k][0], at[k][0] + h), np.arange(at[k][1], at[k][1] + w)
                    focus = s[:h, :w] / cells(yy, xx, level + k, g.height, g.width)
                    best[k].add(band, luma(lows[k]), focus)
                else:
                    e = energy_of(band)
                    best[k].add(blurred(e, 1.0) if level + k == 0 or o.smoothed_selection else e, band)
            a, b, c, d = g.square(level, ty, tx, taken)
            own = lows[taken][:, a - at[taken][0] : b - at[taken][0], c - at[taken][1] : d - at[taken][1]]
            if not last:
                planes = [own]
                if carry:
                    planes.append(pooled(sums, 1 << taken)[None, a - at[taken][0] : b - at[taken][0], c - at[taken][1] : d - at[taken][1]])
                out.append((stack, ty, tx, "frame", level + taken, frame, a, c, b - a, d - c, np.concatenate(planes).astype(g.dtype).tobytes()))
            elif base is not None:
                base.add(-luma(own), own)
            else:
                total = own.astype(np.float64) if total is None else total + own
        for k in range(taken):
            a, b, c, d = g.square(level, ty, tx, k, keep[k])
            own = slice(a - at[k][0], b - at[k][0]), slice(c - at[k][1], d - at[k][1])
            if level + k in gated:
                mask, bg, clean = pasted(m[m["level"] == level + k], g, a, b, c, d)
                t = best[k]
                for x in (t, t.a, t.c):
                    for name in ("band", "b", "q", "dark", "bright", "focused"):
                        if getattr(x, name, None) is not None:
                            setattr(x, name, getattr(x, name)[(..., *own)])
                band = t.merged(mask, bg, clean)
            else:
                band = best[k].band[(..., *own)]
            out.append((stack, ty, tx, "band", level + k, -1, a, c, b - a, d - c, band.astype(g.dtype).tobytes()))
        if last:
            a, b, c, d = g.square(level, ty, tx, taken)
            low = base.band if base is not None else total / n
            out.append((stack, ty, tx, "base", level + taken, -1, a, c, b - a, d - c, low.astype(g.dtype).tobytes()))
        return pd.DataFrame(out, columns=COLUMNS)

    if masks is None:
        return parts.groupBy(*_KEY).applyInPandas(lambda key, p: run(key, p, None), TILES)
    return parts.groupBy(*_KEY).cogroup(masks.groupBy(*_KEY)).applyInPandas(run, TILES)


def collapse_round(bands: DataFrame, low: DataFrame, g: Grid, level: int, taken: int) -> DataFrame:
    """The image of the raster of ``level``, of kind ``base``, in its squares; ``low``: the one ``taken`` levels further down."""
    keep = margins(taken)

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        stack, ty, tx = (int(v) for v in key)
        a, b, c, d = g.square(level, ty, tx, taken, keep[taken])
        cur, at = pasted(p[p["kind"] == "base"], g, a, b, c, d), (a, c)
        for k in range(taken - 1, -1, -1):
            a, b, c, d = g.square(level, ty, tx, k, keep[k])
            band = p[(p["kind"] == "band") & (p["level"] == level + k)].iloc[0]
            up = expanded(cur)[:, a - 2 * at[0] : b - 2 * at[0], c - 2 * at[1] : d - 2 * at[1]]
            cur, at = np.frombuffer(band.px, g.dtype).reshape(-1, band.h, band.w) + up, (a, c)
        return pd.DataFrame([(stack, ty, tx, "base", level, -1, a, c, b - a, d - c, cur.astype(g.dtype).tobytes())], columns=COLUMNS)

    return bands.unionByName(exchanged(low, g, level, keep[taken], taken)).groupBy(*_KEY).applyInPandas(run, TILES)


def planes(tiles: DataFrame, g: Grid, cell: int) -> DataFrame:
    """Planes of a stack, by square: of kind ``plane`` hi, lo (blurred energy of the finest band over the frames), least and
    greatest luminance, of kind ``cells`` greatest and least mean squared band of ``cell`` x ``cell`` pixels over the frames."""
    taken = g.rounds()[0][1]

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        stack, ty, tx = (int(v) for v in key)
        y0, y1, x0, x1 = g.square(0, ty, tx, margin=g.halo(taken))
        a, b, c, d = g.square(0, ty, tx)
        own = slice(a - y0, b - y0), slice(c - x0, d - x0)
        hi = lo = low = high = top = least = None
        for _, lows, _ in each_frame(p, g, y0, y1, x0, x1, 0, 1):
            band = band_of(lows, 0)
            e = blurred(energy_of(band), 1.0)[own]
            lum = luma(lows[0])[own]
            sq = pooled((band[(..., *own)].astype(np.float64) ** 2).sum(0), cell) / pooled(np.ones(e.shape), cell)
            hi, lo, low, high = (e, e, lum, lum) if hi is None else (np.maximum(hi, e), np.minimum(lo, e), np.minimum(low, lum), np.maximum(high, lum))
            top, least = (sq, sq) if top is None else (np.maximum(top, sq), np.minimum(least, sq))
        at = (a // cell, c // cell)
        rows = [(stack, ty, tx, "plane", 0, -1, a, c, b - a, d - c, np.stack([hi, lo, low, high]).astype(g.dtype).tobytes()), (stack, ty, tx, "cells", 0, -1, *at, *top.shape, np.stack([top, least]).astype(g.dtype).tobytes())]
        return pd.DataFrame(rows, columns=COLUMNS)

    return tiles.groupBy(*_KEY).applyInPandas(run, TILES)


def long_form(tiles: DataFrame, names: list[str], dtype: str = "<f4") -> DataFrame:
    """stack, frame (-1 where all frames have become one), y, x and a column for each plane of the tiles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch.itertuples(index=False):
                a = np.frombuffer(t.px, dtype).reshape(len(names), -1).astype(float)
                y, x = np.divmod(np.arange(t.h * t.w), t.w)
                yield pd.DataFrame({"stack": t.stack, "frame": t.frame, "y": (y + t.y0).astype("int32"), "x": (x + t.x0).astype("int32")} | dict(zip(names, a)))

    return tiles.mapInPandas(run, "stack int, frame int, y int, x int, " + ", ".join(f"{n} double" for n in names))


def mask_tiles(masks: dict[int, DataFrame], g: Grid) -> DataFrame:
    """Parts of kind ``mask`` for the rounds of the gated levels; ``masks``: by level stack, y, x, mask, bg, clean."""

    def packed(m: DataFrame, level: int, k: int, side: int) -> DataFrame:
        t, (h, w) = g.tile >> k, g.size(level + k)
        span = lambda c, n: F.sequence(F.greatest(F.floor((F.col(c) - side) / t), F.lit(0)).cast("int"), F.least(F.floor((F.col(c) + side) / t), F.lit((n - 1) // t)).cast("int"))

        def pack(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
            stack, ty, tx = (int(v) for v in key)
            a, b, c, d = g.square(level, ty, tx, k, side)
            px = np.zeros((3, b - a, d - c))
            for i, n in enumerate(("mask", "bg", "clean")):
                px[i, p["y"].to_numpy() - a, p["x"].to_numpy() - c] = p[n].to_numpy()
            return pd.DataFrame([(stack, ty, tx, "mask", level + k, -1, a, c, b - a, d - c, px.astype(g.dtype).tobytes())], columns=COLUMNS)

        return m.withColumn("ty", F.explode(span("y", h))).withColumn("tx", F.explode(span("x", w))).groupBy(*_KEY).applyInPandas(pack, TILES)

    parts = [packed(masks[level + k], level, k, margins(taken)[k]) for level, taken in g.rounds() for k in range(taken) if level + k in masks]
    return C.cut(reduce(DataFrame.unionByName, parts))


def levelled(tiles: DataFrame, g: Grid) -> DataFrame:
    """The tiles with the exposure chain's gains of their frame, one for each channel: from channel sums of every seventh pixel
    by square, a row for each frame. Frames count as wholly covered."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch.itertuples(index=False):
                a, b, c, d = g.square(0, t.ty, t.tx)
                own = np.frombuffer(t.px, g.dtype).reshape(-1, t.h, t.w)[:3, a - t.y0 : b - t.y0, c - t.x0 : d - t.x0]
                pick = (np.arange(a, b)[:, None] * g.width + np.arange(c, d)) % 7 == 0
                out.append((t.stack, t.frame, float(pick.sum()), *[float(x) for x in own[:, pick].sum(1, dtype=np.float64)]))
            yield pd.DataFrame(out, columns=["stack", "frame", "n", "r", "g", "b"])

    s = tiles.mapInPandas(sums, "stack int, frame int, n double, r double, g double, b double").groupBy("stack", "frame").agg(*[F.sum(c).alias(c) for c in ("n", "r", "g", "b")])
    gains = C.cut(A.render_gains(A.exposure_gain(s.where("n > 0").select("stack", "frame", *[(F.col(c) / F.col("n")).alias(c) for c in "rgb"])).drop("gain")))
    return tiles.join(gains, ["stack", "frame"], "left").select(*COLUMNS, *[F.coalesce(c, F.lit(1.0)).alias(c) for c in GAINS])


def clamped(image: DataFrame, seen: DataFrame, g: Grid, cell: int) -> DataFrame:
    """The image with its finest band held within the frames' envelope, cell by cell (:func:`pmax.clamped_image`).

    ``seen``: what :func:`planes` gives."""

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        stack, ty, tx = (int(v) for v in key)
        y0, y1, x0, x1 = g.square(0, ty, tx, margin=g.halo(1))
        a, b, c, d = g.square(0, ty, tx)
        own = slice(a - y0, b - y0), slice(c - x0, d - x0)
        image = pasted(p[p["kind"] == "base"], g, y0, y1, x0, x1)
        fine = band_of([image, low_pass(image)], 0)[(..., *own)]
        held = p[p["kind"] == "cells"].iloc[0]
        top = np.frombuffer(held.px, g.dtype).reshape(-1, held.h, held.w)[0]
        mean = pooled((fine.astype(np.float64) ** 2).sum(0), cell) / pooled(np.ones(fine.shape[1:]), cell)
        k = np.where(mean > top, np.sqrt(top / np.maximum(mean, 1e-12)), 1.0).repeat(cell, 0).repeat(cell, 1)[: b - a, : d - c]
        out = image[(..., *own)] + fine * (k - 1)
        return pd.DataFrame([(stack, ty, tx, "base", 0, -1, a, c, b - a, d - c, out.astype(g.dtype).tobytes())], columns=COLUMNS)

    return exchanged(image, g, 0, g.halo(1)).unionByName(seen.where("kind = 'cells'")).groupBy(*_KEY).applyInPandas(run, TILES)


def background(tiles: DataFrame, seen: DataFrame, g: Grid, o: M.Options) -> dict[int, DataFrame]:
    """By gated level stack, y, x, mask, bg, clean: the long form's masks on planes of one value a pixel."""
    px = C.cut(long_form(seen.where("kind = 'plane'"), ["hi", "lo", "v", "_h"], g.dtype).drop("frame"))
    frames = C.cut(M.frame_counts(tiles.select("stack", "frame")))
    lum_min, fx, lx = px.select(*A.PIXEL, "v"), px.select(*A.PIXEL, "hi", "lo"), px.select(*A.PIXEL, F.col("_h").alias("hi"), F.col("v").alias("lo"))
    veto = None
    if o.smoothed_selection:
        sharp = A.box_down(M.sharp_mask(fx, frames).select(*A.PIXEL, F.col("m").cast("double").alias("v")), o.cell, "v", "max", ("stack",)).select(*A.PIXEL, (F.col("v") > 0).alias("sharp"))
        env = long_form(seen.where("kind = 'cells'"), ["env_max", "env_min"], g.dtype).drop("frame")
        v = M.texture_veto(C.cut(env.join(sharp, A.PIXEL)), frames)
        at = px.select(*A.PIXEL, F.floor(F.col("y") / o.cell).cast("int").alias("_cy"), F.floor(F.col("x") / o.cell).cast("int").alias("_cx"))
        veto = at.join(v.select("stack", F.col("y").alias("_cy"), F.col("x").alias("_cx"), "v"), ["stack", "_cy", "_cx"]).select(*A.PIXEL, "v")
    bg, clean = (C.cut(t) for t in M.open_background(fx, lx, frames, g.height, g.width))
    gated = range(max(1, g.levels - o.coarse_levels), g.levels)
    ms, bgs = M.debloom_masks(lum_min, veto, bg, gated)
    out = {}
    for lv in gated:
        h, w = g.size(lv)
        grid = S.resize(clean.withColumn("frame", F.lit(0)), -(-g.height // 8), -(-g.width // 8), h, w).drop("frame").withColumnRenamed("v", "clean")
        out[lv] = ms[lv].withColumnRenamed("m", "mask").join(bgs[lv], A.PIXEL).join(grid, A.PIXEL)
    return out


def fuse(tiles: DataFrame, g: Grid, o: M.Options | None = None) -> DataFrame:
    """The fused image in tiles (kind ``base``, planes r, g, b), as :func:`pmax.fuse` gives it of the same frames, but for governance.

    ``tiles``: as :func:`cut_frames` or :func:`from_pixels` make them; the tile's side is a multiple of 2 ** ROUND (and of ``o.cell``)."""
    o = o or M.Options()
    if g.tile % (1 << ROUND) or (o.coarse_levels and g.tile % o.cell):
        raise ValueError("a tile's side must be a multiple of 8 and of an envelope cell")
    if o.normalize_exposure:
        tiles = levelled(tiles, g)
    seen = C.cut(planes(tiles, g, o.cell)) if o.coarse_levels else None
    masks = mask_tiles(background(tiles, seen, g, o), g) if o.coarse_levels else None
    parts, done = tiles, []
    for level, taken in g.rounds():
        here = masks.where((F.col("level") >= level) & (F.col("level") < level + taken)) if masks is not None else None
        got = C.cut(fuse_round(parts, here, g, level, taken, o))
        done.append((level, taken, got))
        below = level + taken
        if below < g.levels:
            more = next(t for a, t in g.rounds() if a == below)
            parts = exchanged(got.where("kind = 'frame'"), g, below, g.halo(more))
    low = done[-1][2].where("kind = 'base'")
    for level, taken, got in reversed(done):
        low = collapse_round(got.where("kind = 'band'"), low, g, level, taken)
    return clamped(C.cut(low), seen, g, o.cell) if o.coarse_levels and o.smoothed_selection else low


def default_grid(height: int, width: int, tile: int = 256, levels: int | None = None, dtype: str = "<f4") -> Grid:
    n = min(levels or M.levels(height, width), max(1, int(math.log2(max(2, min(height, width))))))
    return Grid(height, width, tile, n, dtype)
