"""Frame registration and quality: statistics, residuals, outliers, blame and transforms.

Pixel work is joins and aggregates over all frames at once; what is left on a stack's frames (a row for each
image) is ordered logic on small tables, run for each stack in one group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pixel as P
from . import aggregate as A

IDENTITY = [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]


def gray_stats(px: DataFrame, value: str = "v") -> DataFrame:
    """stack, frame, lum_mean (byte units)."""
    return px.groupBy("stack", "frame").agg((F.avg(value) * 255).alias("lum_mean"))


def pair_residual(px: DataFrame, shifts: DataFrame, stride: int = 1, least: int = 100, value: str = "v") -> DataFrame:
    """stack, frame, other, residual: mean |fixed - moved| in byte units over every ``stride``-th pixel; infinite with up
    to ``least`` samples. ``shifts``: stack, frame (fixed), other (moving), dy, dx whole-pixel places in the moving frame."""
    a = px.where((F.col("y") % stride == 0) & (F.col("x") % stride == 0)).join(shifts, ["stack", "frame"])
    a = a.select("stack", "frame", "other", F.col(value).alias("_a"), (F.col("y") + F.col("dy")).cast("int").alias("y"), (F.col("x") + F.col("dx")).cast("int").alias("x"))
    b = px.select("stack", F.col("frame").alias("other"), "y", "x", F.col(value).alias("_b"))
    g = a.join(b, ["stack", "other", "y", "x"]).groupBy("stack", "frame", "other").agg(F.count(F.lit(1)).alias("n"), (F.avg(F.abs(F.col("_a") - F.col("_b"))) * 255).alias("r"))
    return shifts.select("stack", "frame", "other").join(g, ["stack", "frame", "other"], "left").select("stack", "frame", "other", F.when(F.col("n") > least, F.col("r")).otherwise(F.lit(float("inf"))).alias("residual"))


def warp_residual(px: DataFrame, pairs: DataFrame, height: int, width: int, stride: int = 1, least: int = 100, value: str = "v", h: str = "h") -> DataFrame:
    """``pairs`` with residual: mean |fixed - moved| in byte units over every ``stride``-th pixel, the moving frame taken
    bilinearly where ``h`` (fixed place -> moving place) points; infinite with up to ``least`` samples inside.

    ``pairs``: stack, frame (fixed), other (moving), h."""
    from .join import gather

    m = [F.element_at(h, i + 1) for i in range(9)]
    sx, sy = P.project(m, F.col("x").cast("double"), F.col("y").cast("double"))
    a = px.where((F.col("y") % stride == 0) & (F.col("x") % stride == 0)).join(pairs.select("stack", "frame", "other", h), ["stack", "frame"])
    a = a.select("stack", "frame", "other", "y", "x", F.col(value).alias("_a"), sy.alias("_py"), sx.alias("_px"))
    a = a.where((F.col("_py") >= 0) & (F.col("_px") >= 0) & (F.col("_py") < height - 1) & (F.col("_px") < width - 1))
    g = gather(a, px.withColumnRenamed("frame", "other"), "_py", "_px", height, width, value, ("stack", "other"), "_b")
    g = g.groupBy("stack", "frame", "other").agg(F.count(F.lit(1)).alias("_n"), (F.avg(F.abs(F.col("_a") - F.col("_b"))) * 255).alias("_r"))
    return pairs.join(g, ["stack", "frame", "other"], "left").withColumn("residual", F.when(F.col("_n") > least, F.col("_r")).otherwise(F.lit(float("inf")))).drop("_n", "_r")


def exposure_outliers(means: DataFrame) -> DataFrame:
    """stack, frame, kind, magnitude: mean luminance below half or above twice the stack's upper median (at least 0.25)."""
    med = A.upper_median(means, "lum_mean", ["stack"]).select("stack", F.greatest("q", F.lit(0.25)).alias("_m"))
    d = means.join(med, "stack").withColumn("magnitude", F.col("lum_mean") / F.col("_m"))
    return d.where((F.col("magnitude") < 0.5) | (F.col("magnitude") > 2)).select("stack", "frame", F.lit("exposureOutlier").alias("kind"), "magnitude")


def gated(pairs: DataFrame) -> DataFrame:
    """Pairs whose warp is no better than none (residual above 1.02 times that of the identity) take the identity.

    ``pairs``: stack, frame, other, residual, identity_residual, h (null where registration failed)."""
    worse = F.col("residual") > F.col("identity_residual") * 1.02
    one = F.array(*[F.lit(v) for v in IDENTITY])
    return pairs.withColumn("h", F.when(F.col("h").isNull(), F.col("h")).when(worse, one).otherwise(F.col("h"))).withColumn("residual", F.when(F.col("h").isNotNull() & worse, F.col("identity_residual")).otherwise(F.col("residual")))


def residual_outliers(pairs: DataFrame, failed: str | None = None) -> DataFrame:
    """stack, frame, other, ratio: residual above max(3 median, 4), the median (upper, at least 0.25) of the finite ones;
    an infinite ratio for failed pairs."""
    fine = F.col("residual") < float("inf")
    med = A.upper_median(pairs.where(fine), "residual", ["stack"]).select("stack", F.greatest("q", F.lit(0.25)).alias("_m"))
    d = pairs.join(med, "stack")
    lost = F.col(failed) if failed else F.lit(False)
    bad = lost | (F.col("residual") > F.greatest(3 * F.col("_m"), F.lit(4.0)))
    return d.where(bad).select("stack", "frame", "other", F.when(lost, F.lit(float("inf"))).otherwise(F.col("residual") / F.col("_m")).alias("ratio"))


def blame(frames: DataFrame, bad: DataFrame, bridges: DataFrame | None = None) -> DataFrame:
    """stack, frame, kind: a frame with two bad pairs is misaligned; a single bad pair blames the end frame it holds;
    a failed pair inside the stack blames the frame that the chain can bridge around: its later frame if the
    neighbours of that register with each other, else its earlier one. Other lone bad pairs blame nobody (a scene change).

    ``frames``: stack, frame; ``bad``: stack, frame, other, ratio; ``bridges``: stack, frame, other of pairs two places apart
    that register (without it the later frame is blamed)."""
    w = W.partitionBy("stack").orderBy("frame")
    f = frames.select("stack", "frame").withColumn("pos", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("stack")))
    b = bad.join(f.select("stack", "frame", "pos", "n"), ["stack", "frame"])
    hits = b.select("stack", "pos").unionAll(b.select("stack", (F.col("pos") + 1).alias("pos"))).groupBy("stack", "pos").agg(F.count(F.lit(1)).alias("k"))
    twice = hits.where("k >= 2").select("stack", "pos")
    lone = b.join(twice.select("stack", F.col("pos")), ["stack", "pos"], "left_anti").join(twice.select("stack", (F.col("pos") - 1).alias("pos")), ["stack", "pos"], "left_anti").where("n > 2")
    inner = F.col("pos") + 1
    if bridges is not None:
        over = bridges.join(f.select("stack", "frame", F.col("pos").alias("_at")), ["stack", "frame"]).select("stack", "_at").distinct()
        later = over.select("stack", F.col("_at").alias("pos"), F.lit(True).alias("_later"))  # around pos + 1
        earlier = over.select("stack", (F.col("_at") + 1).alias("pos"), F.lit(True).alias("_earlier"))  # around pos
        lone = lone.join(later, ["stack", "pos"], "left").join(earlier, ["stack", "pos"], "left")
        inner = F.when(F.col("_later"), F.col("pos") + 1).when(F.col("_earlier"), F.col("pos"))
    who = F.when(F.col("pos") == 0, F.lit(0)).when(F.col("pos") + 1 == F.col("n") - 1, F.col("n") - 1).when(F.col("ratio") == float("inf"), inner)
    named = lone.select("stack", who.cast("int").alias("pos")).where("pos IS NOT NULL")
    out = twice.select("stack", F.col("pos").cast("int").alias("pos")).unionAll(named).distinct()
    return out.join(f.select("stack", "pos", "frame"), ["stack", "pos"]).select("stack", "frame", F.lit("misaligned").alias("kind"))


def shift_of(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(dy, dx) at which ``b`` shows what ``a`` shows, by phase correlation with a parabola through the peak."""
    win = np.hanning(a.shape[0])[:, None] * np.hanning(a.shape[1])
    fa, fb = np.fft.fft2((a - a.mean()) * win), np.fft.fft2((b - b.mean()) * win)
    c = fb * np.conj(fa)
    r = np.fft.ifft2(c / np.maximum(np.abs(c), 1e-12)).real
    p = np.unravel_index(int(r.argmax()), r.shape)
    out = []
    for k, n in zip(range(2), r.shape):
        i, j = list(p), list(p)
        i[k], j[k] = (p[k] - 1) % n, (p[k] + 1) % n
        lo, mid, hi = r[tuple(i)], r[p], r[tuple(j)]
        den = lo - 2 * mid + hi
        d = p[k] + (0.5 * (lo - hi) / den if den else 0.0)
        out.append(d - n if d > n / 2 else d)
    return out[0], out[1]


def scale_of(a: np.ndarray, b: np.ndarray) -> float:
    """Enlargement of ``b`` against ``a`` about the centre, by correlating log-polar amplitude spectra."""
    n = min(a.shape)
    rad = np.exp(np.linspace(np.log(2.0), np.log(n / 2 - 1), 128))
    ang = np.linspace(0, np.pi, 96, endpoint=False)
    win = np.hanning(a.shape[0])[:, None] * np.hanning(a.shape[1])

    def spec(v: np.ndarray) -> np.ndarray:
        s = np.log1p(np.abs(np.fft.fftshift(np.fft.fft2((v - v.mean()) * win))))
        cy, cx = v.shape[0] // 2, v.shape[1] // 2
        y = np.clip(np.rint(cy + rad[:, None] * np.sin(ang) * v.shape[0] / n).astype(int), 0, v.shape[0] - 1)
        x = np.clip(np.rint(cx + rad[:, None] * np.cos(ang) * v.shape[1] / n).astype(int), 0, v.shape[1] - 1)
        return s[y, x]

    dy, _ = shift_of(spec(a), spec(b))
    return float(np.exp(-dy * (np.log(n / 2 - 1) - np.log(2.0)) / 127))


def register_pairs(px: DataFrame, pairs: DataFrame, height: int, width: int, value: str = "v", scales: bool = False) -> DataFrame:
    """stack, frame, other, h: maps places of the fixed frame to the moving one, for all pairs in parallel.

    A weaker estimator than feature matching with a robust fit: translation, and on request scale about the centre."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        rows = []
        a, b = np.zeros((height, width)), np.zeros((height, width))
        fixed = p["side"] == 0
        a[p["y"][fixed], p["x"][fixed]], b[p["y"][~fixed], p["x"][~fixed]] = p["v"][fixed], p["v"][~fixed]
        s = scale_of(a, b) if scales else 1.0
        if scales and abs(s - 1) > 1e-4:
            cy, cx = (height - 1) / 2, (width - 1) / 2
            yy, xx = np.clip(np.rint(cy + (np.arange(height) - cy) * s).astype(int), 0, height - 1), np.clip(np.rint(cx + (np.arange(width) - cx) * s).astype(int), 0, width - 1)
            dy, dx = shift_of(a, b[yy][:, xx])
        else:
            dy, dx = shift_of(a, b)
        h = P.mat_mul(P.similarity(s, 0, 0, 0, (width - 1) / 2, (height - 1) / 2), [1.0, 0, dx, 0, 1.0, dy, 0, 0, 1.0])
        rows.append((int(p["stack"].iloc[0]), int(p["frame"].iloc[0]), int(p["other"].iloc[0]), h))
        return pd.DataFrame(rows, columns=["stack", "frame", "other", "h"])

    pr = pairs.select("stack", "frame", "other")
    one = px.join(pr, ["stack", "frame"]).select("stack", "frame", "other", F.lit(0).alias("side"), "y", "x", F.col(value).alias("v"))
    two = px.withColumnRenamed("frame", "other").join(pr, ["stack", "other"]).select("stack", "frame", "other", F.lit(1).alias("side"), "y", "x", F.col(value).alias("v"))
    # a group is one pair of registration-size frames
    return one.unionAll(two).groupBy("stack", "frame", "other").applyInPandas(run, "stack int, frame int, other int, h array<double>")


def transforms(frames: DataFrame, pairs: DataFrame, survivors: DataFrame) -> DataFrame:
    """stack, frame, h: chain of the surviving pairs' homographies, re-based to the middle survivor; other frames take the
    nearest survivor's (best effort). ``pairs``: stack, frame, other, h between neighbouring survivors."""
    from .join import nearest_survivor
    from .window import chain

    near = nearest_survivor(frames, survivors)

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("frame")
        own = p[p["frame"] == p["nearest"]]
        steps = [list(x) if x is not None else IDENTITY for x in own["h"]][:-1]
        hs = chain([P.mat_inverse(s) for s in steps], len(own) // 2) if len(own) else []
        by = dict(zip(own["frame"], hs))
        return pd.DataFrame({"stack": p["stack"], "frame": p["frame"], "h": [by.get(f, IDENTITY) for f in p["nearest"]]})

    j = near.join(pairs.select("stack", "frame", "h"), ["stack", "frame"], "left")
    return j.groupBy("stack").applyInPandas(run, "stack int, frame int, h array<double>")  # a row for each frame


def register_stacks(px: DataFrame, height: int, width: int, stride: int = 1, scales: bool = False, value: str = "v", features: bool = False) -> tuple[DataFrame, DataFrame]:
    """(frames: stack, frame, h, nearest; issues: stack, frame, kind) of every stack: exposure outliers go first, neighbours
    of the rest are registered and gated, bad pairs blame frames, the survivors' chain gives the transforms (frame ->
    middle survivor), and a flagged frame is registered onto its nearest survivor as well as that goes.

    With ``features`` pairs are registered by matched keypoints, which finds any homography and loses pairs without enough
    matches, else by phase correlation. All pairs of all stacks are registered in parallel; between the steps only tables with a row for each frame or pair are kept."""
    from .components import cut
    from .join import adjacent_pairs, nearest_survivor
    from .matching import register_features

    px = px.select("stack", "frame", "y", "x", value)
    one = F.array(*[F.lit(float(v)) for v in IDENTITY])
    means = cut(gray_stats(px, value))
    frames = means.select("stack", "frame")
    dark = cut(exposure_outliers(means).select("stack", "frame", "kind"))
    kept = frames.join(dark, ["stack", "frame"], "left_anti")

    def registered(pairs: DataFrame) -> DataFrame:
        """h and residual of pairs, warps that are no better than none replaced by the identity."""
        if features:
            got = pairs.select("stack", "frame", "other").join(register_features(px, pairs, height, width, value), ["stack", "frame", "other"], "left")
            h = cut(got.select("stack", "frame", "other", F.coalesce("h", one).alias("h"), F.col("h").isNull().alias("_lost")))
        else:
            h = cut(register_pairs(px, pairs, height, width, value, scales).withColumn("_lost", F.lit(False)))
        plain = warp_residual(px, h.select("stack", "frame", "other", one.alias("h")), height, width, stride, value=value)
        full = warp_residual(px, h.drop("_lost"), height, width, stride, value=value)
        kept = gated(full.join(plain.select("stack", "frame", "other", F.col("residual").alias("identity_residual")), ["stack", "frame", "other"]))
        lost = h.select("stack", "frame", "other", "_lost")
        return cut(kept.join(lost, ["stack", "frame", "other"]).withColumn("residual", F.when(F.col("_lost"), F.lit(float("inf"))).otherwise(F.col("residual"))).drop("_lost"))

    pairs = registered(cut(adjacent_pairs(kept)))
    bad = cut(residual_outliers(pairs.withColumn("_lost", F.col("residual") == float("inf")), "_lost"))
    w = W.partitionBy("stack").orderBy("frame")
    lost = bad.where(F.col("ratio") == float("inf"))
    two = kept.select("stack", "frame", F.lead("frame", 2).over(w).alias("other"), F.lead("frame", 1).over(w).alias("_m")).where("other IS NOT NULL")
    near = two.join(lost.select("stack", F.col("frame").alias("_f"), F.col("other").alias("_o")), "stack").where((F.col("frame") == F.col("_f")) | (F.col("_m") == F.col("_f")))
    bridges = registered(cut(near.select("stack", "frame", "other").distinct())).where(F.col("residual") < float("inf"))
    off = cut(blame(kept, bad, bridges.select("stack", "frame", "other")))
    issues = dark.unionAll(off)
    survivors = cut(kept.join(off, ["stack", "frame"], "left_anti"))
    chain = cut(adjacent_pairs(survivors))
    have = chain.join(pairs.unionByName(bridges).select("stack", "frame", "other", "h"), ["stack", "frame", "other"], "left")
    fresh = registered(cut(have.where("h IS NULL").select("stack", "frame", "other")))
    steps = cut(have.where("h IS NOT NULL").unionByName(fresh.select("stack", "frame", "other", "h")))
    base = cut(transforms(frames, steps, survivors))
    spurs = nearest_survivor(frames, survivors).where("frame <> nearest")
    spur = registered(cut(spurs.select("stack", F.col("nearest").alias("frame"), F.col("frame").alias("other")))).where(F.col("residual") < float("inf"))

    def onto(h, s) -> list:
        a, b = [h[i] for i in range(9)], P.adjugate([s[i] for i in range(9)])
        m = [a[3 * r] * b[c] + a[3 * r + 1] * b[3 + c] + a[3 * r + 2] * b[6 + c] for r in range(3) for c in range(3)]
        return [v / m[8] for v in m]

    j = base.join(spur.select("stack", F.col("other").alias("frame"), F.col("h").alias("_s")), ["stack", "frame"], "left")
    return j.select("stack", "frame", F.when(F.col("_s").isNull(), F.col("h")).otherwise(F.array(*onto(F.col("h"), F.col("_s")))).alias("h")), issues


def strict(frames: DataFrame, issues: DataFrame) -> DataFrame:
    """The frames, or an error when any of them has an issue."""
    if not issues.isEmpty():
        raise ValueError(f"frames with issues: {[tuple(r) for r in issues.select('stack', 'frame').limit(20).collect()]}")
    return frames


def coverage_crop(frames: DataFrame, height: int, width: int, least: int = 16) -> DataFrame:
    """stack, x0, y0, x1, y1: rectangle inside all warped frames' corners; the whole raster where it would be too small.

    ``frames``: stack, frame, h (frame -> reference)."""
    h = [F.element_at("h", i + 1) for i in range(9)]
    pt = lambda x, y: P.project(h, F.lit(float(x)), F.lit(float(y)))
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = pt(0, 0), pt(width, 0), pt(0, height), pt(width, height)
    g = frames.groupBy("stack").agg(
        F.ceil(F.greatest(F.lit(0.0), F.max(F.greatest(ax, cx)))).alias("x0"), F.ceil(F.greatest(F.lit(0.0), F.max(F.greatest(ay, by)))).alias("y0"),
        F.floor(F.least(F.lit(float(width)), F.min(F.least(bx, dx)))).alias("x1"), F.floor(F.least(F.lit(float(height)), F.min(F.least(cy, dy)))).alias("y1"),
    )
    ok = (F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least)
    return g.select("stack", *[F.when(ok, F.col(n)).otherwise(F.lit(v)).cast("int").alias(n) for n, v in (("x0", 0), ("y0", 0), ("x1", width), ("y1", height))])


def cropped(df: DataFrame, box: DataFrame) -> DataFrame:
    """Pixels inside each stack's rectangle, re-based to its corner."""
    j = df.join(box, "stack").where((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")))
    return j.withColumn("x", (F.col("x") - F.col("x0")).cast("int")).withColumn("y", (F.col("y") - F.col("y0")).cast("int")).select(*df.columns)


def aligned(px: DataFrame, frames: DataFrame, height: int, width: int, channels: tuple[str, ...] = ("r", "g", "b"), crop: bool = True, least: int = 16) -> DataFrame:
    """stack, frame, y, x, the channels and a: every frame as fusion sees it, warped onto the reference and cut to what all frames cover.

    ``frames``: stack, frame, h (frame -> reference); alpha is 0 where a frame has nothing to show."""
    from .join import warp_gather

    back = P.adjugate([F.element_at("h", i + 1) for i in range(9)])
    at = px.select("stack", "frame", "y", "x").join(frames.select("stack", "frame", "h"), ["stack", "frame"])
    out = None
    for c in channels:
        one = warp_gather(at, px, back, height, width, c)
        out = one if out is None else out.join(one.drop("a"), ["stack", "frame", "y", "x"])
    out = out.select("stack", "frame", "y", "x", *channels, "a")
    return cropped(out, coverage_crop(frames, height, width, least)) if crop else out


def rotated_crop(image: DataFrame, height: int, width: int, out_h: int, out_w: int, cy: float, cx: float, angle: float, value: str = "v", nearest: bool = False) -> DataFrame:
    """A turned rectangle about (cy, cx): bilinear for images, nearest for depths; edge-clamped."""
    from math import cos, sin

    from .join import gather

    at = image.select("stack").distinct().select("stack", F.explode(F.sequence(F.lit(0), F.lit(out_h - 1))).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(out_w - 1))))
    u, v = F.col("x") - (out_w - 1) / 2, F.col("y") - (out_h - 1) / 2
    px, py = u * cos(angle) - v * sin(angle) + cx, u * sin(angle) + v * cos(angle) + cy
    if nearest:
        px, py = F.floor(px + 0.5).cast("double"), F.floor(py + 0.5).cast("double")
    return gather(at.withColumn("_py", py).withColumn("_px", px), image, "_py", "_px", height, width, value, ("stack",), value).drop("_py", "_px")
