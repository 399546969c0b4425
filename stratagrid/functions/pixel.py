"""Scalar maps on pixels, as column expressions (they stay inside whole-stage codegen)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Luminance weights, sRGB transfer constants.
LUMA = (0.2126, 0.7152, 0.0722)
SRGB_CUT_ENCODED, SRGB_CUT_LINEAR = 0.04045, 0.0031308


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * LUMA[0] + g * LUMA[1] + b * LUMA[2]


def affine(x: Column, scale: Column | float, offset: Column | float = 0.0) -> Column:
    return x * scale + offset


def smoothstep(e0: Column | float, e1: Column | float, x: Column) -> Column:
    """Cubic step between the edges; a hard step at ``e0`` where they don't ascend."""
    hard = F.when(x < e0, F.lit(0.0)).otherwise(F.lit(1.0))
    if isinstance(e0, Column) or isinstance(e1, Column):
        e0, e1 = (e if isinstance(e, Column) else F.lit(e) for e in (e0, e1))
        t = clamp((x - e0) / F.when(e1 > e0, e1 - e0))
        return F.when(e1 > e0, t * t * (3 - 2 * t)).otherwise(hard)
    if e1 <= e0:
        return hard
    t = clamp((x - e0) / (e1 - e0))
    return t * t * (3 - 2 * t)


def srgb_linearize(x: Column) -> Column:
    return F.when(x <= SRGB_CUT_ENCODED, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def srgb_encode(x: Column) -> Column:
    return F.when(x <= SRGB_CUT_LINEAR, x * 12.92).otherwise(1.055 * F.pow(F.greatest(x, F.lit(SRGB_CUT_LINEAR)), F.lit(1 / 2.4)) - 0.055)


@dataclass(frozen=True)
class Tone:
    """Exposure in EV (-5..5), the others from -100 to 100."""

    exposure: float = 0.0
    contrast: float = 0.0
    highlights: float = 0.0
    shadows: float = 0.0
    whites: float = 0.0
    blacks: float = 0.0

    @property
    def neutral(self) -> bool:
        return self == Tone()


def tone(x: Column, s: Tone) -> Column:
    """The tone curve: exposure in linear light, contrast about the middle, then four region masks."""
    v = clamp(x)
    if s.exposure:
        v = clamp(srgb_encode(srgb_linearize(v) * 2.0**s.exposure))
    if s.contrast > 0:
        v = v + (v * v * (3 - 2 * v) - v) * (s.contrast / 100)
    elif s.contrast < 0:
        v = v + (0.5 - v) * (-s.contrast / 200)
    if s.highlights:
        v = v + v * v * (1 - v) * (6.75 * 0.3 * s.highlights / 100)
    if s.shadows:
        v = v + v * (1 - v) * (1 - v) * (6.75 * 0.35 * s.shadows / 100)
    if s.whites:
        v = v + v * v * v * (0.25 * s.whites / 100)
    if s.blacks:
        v = v + (1 - v) * (1 - v) * (1 - v) * (0.25 * s.blacks / 100)
    return clamp(v)


def tone_table(s: Tone, entries: int = 4096) -> list[float]:
    """The curve at ``entries`` even places (a bounded literal)."""

    def clip(v: float) -> float:
        return min(max(v, 0.0), 1.0)

    out = []
    for i in range(entries):
        v = i / (entries - 1)
        if s.exposure:
            lin = v / 12.92 if v <= SRGB_CUT_ENCODED else ((v + 0.055) / 1.055) ** 2.4
            lin *= 2.0**s.exposure
            v = clip(lin * 12.92 if lin <= SRGB_CUT_LINEAR else 1.055 * lin ** (1 / 2.4) - 0.055)
        if s.contrast > 0:
            v += (v * v * (3 - 2 * v) - v) * (s.contrast / 100)
        elif s.contrast < 0:
            v += (0.5 - v) * (-s.contrast / 200)
        v += v * v * (1 - v) * (6.75 * 0.3 * s.highlights / 100)
        v += v * (1 - v) ** 2 * (6.75 * 0.35 * s.shadows / 100)
        v += v**3 * (0.25 * s.whites / 100)
        v += (1 - v) ** 3 * (0.25 * s.blacks / 100)
        out.append(clip(v))
    return out


def lookup(x: Column, table: Column, entries: int) -> Column:
    """Linear interpolation in an array column of ``entries`` values over 0..1."""
    p = clamp(x) * (entries - 1)
    i = F.least(F.floor(p).cast("int"), F.lit(entries - 2))
    f = p - i
    return F.element_at(table, i + 1) * (1 - f) + F.element_at(table, i + 2) * f


def depth_visual(depth: Column, frames: Column) -> Column:
    """Near is white: 1 - depth / (frames - 1); white for a single frame."""
    return F.when(frames > 1, 1 - depth / F.greatest(frames - 1, F.lit(1))).otherwise(F.lit(1.0))


def to_byte(x: Column) -> Column:
    return (clamp(x) * 255 + 0.5).cast("int")


def quantize(x: Column, peak: Column | float, top: int = 65535) -> Column:
    """Fixed point: ``peak`` becomes ``top``; nothing where the peak isn't positive."""
    p = peak if isinstance(peak, Column) else F.lit(float(peak))
    return F.when(p > 0, (F.least(F.greatest(x * top / F.when(p > 0, p), F.lit(0.0)), F.lit(float(top))) + 0.5).cast("int")).otherwise(F.lit(0))


def dequantize(q: Column, peak: Column | float, top: int = 65535) -> Column:
    return q * (peak / top)


def project(h: list[float] | list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a row-major 3x3 homography."""
    w = x * h[6] + y * h[7] + h[8]
    return (x * h[0] + y * h[1] + h[2]) / w, (x * h[3] + y * h[4] + h[5]) / w


def mat_mul(a: list[float], b: list[float]) -> list[float]:
    return [sum(a[3 * i + k] * b[3 * k + j] for k in range(3)) for i in range(3) for j in range(3)]


def adjugate(m: list) -> list:
    """The inverse times the determinant: as a homography, the inverse itself (numbers or columns)."""
    a, b, c, d, e, f, g, h, i = m
    return [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]


def mat_inverse(m: list[float]) -> list[float]:
    adj = adjugate(m)
    det = m[0] * adj[0] + m[1] * adj[3] + m[2] * adj[6]
    if det == 0:
        raise ValueError("singular transform")
    return [v / det for v in adj]


def similarity(scale: float, angle: float, tx: float, ty: float, cx: float = 0.0, cy: float = 0.0) -> list[float]:
    """Scale and turn about (cx, cy), then move."""
    c, s = scale * math.cos(angle), scale * math.sin(angle)
    return [c, -s, cx - c * cx + s * cy + tx, s, c, cy - s * cx - c * cy + ty, 0.0, 0.0, 1.0]


def rescaled(h: list[float], factor: float) -> list[float]:
    """The homography in coordinates ``factor`` times as large: S H S^-1."""
    s, t = [factor, 0, 0, 0, factor, 0, 0, 0, 1.0], [1 / factor, 0, 0, 0, 1 / factor, 0, 0, 0, 1.0]
    return mat_mul(mat_mul(s, h), t)


def gaussian_kernel(sigma: float) -> list[float]:
    """Radius max(1, ceil(3 sigma)), normalised."""
    r = max(1, math.ceil(3 * sigma))
    w = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    t = sum(w)
    return [v / t for v in w]


def lanczos3(x: Column) -> Column:
    px = x * math.pi
    return F.when(F.abs(x) < 1e-6, F.lit(1.0)).when(F.abs(x) >= 3, F.lit(0.0)).otherwise(3 * F.sin(px) * F.sin(px / 3) / F.when(F.abs(x) >= 1e-6, px * px))


def phase(t: Column, path: str) -> tuple[Column, Column]:
    """Where the eye stands at turn ``t`` (0..1): horizontal, vertical or circular."""
    a = t * (2 * math.pi)
    still = F.lit(0.0)
    paths = {"horizontal": (F.sin(a), still), "vertical": (still, F.sin(a)), "circular": (F.sin(a), F.cos(a))}
    return paths[path]


def dof_window(frames: Column) -> Column:
    """Frames that one subject's focus may span: max(2, n div 16)."""
    return F.greatest(F.lit(2), F.floor(frames / 16).cast("int"))
