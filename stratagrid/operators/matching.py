"""Registration by features: keypoints, a ratio-test join of descriptors, and consensus over a table of hypotheses.

* :func:`keypoints`: corners of each frame with a patch descriptor, at most ``most`` of a frame, strongest first;
* :func:`two_nearest`, :func:`ratio_matches`: for each moving descriptor its two nearest fixed ones; a match is one whose
  nearest is nearer than ``ratio`` times the second;
* :func:`hypotheses`, :func:`inliers`, :func:`consensus`: homographies through four matches drawn by a hash, how many matches
  each explains within ``reach`` pixels, and the least-squares homography of the best one's matches.

What meets in one task is a pair's descriptors (``most`` on either side); counting is a group-by over hypotheses, of
which each pair has ``draws``, and fitting merges triangles of batches. Frames without enough corners or matches lose their pair, as no warp can be told.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pixel as P
from . import stencil as S

# The ratio test, the reach of an inlier in pixels, the most keypoints of a frame.
RATIO, REACH, MOST = 0.75, 3.0, 2000
PAIR = ["stack", "frame", "other"]
POINTS = "stack int, frame int, id int, y double, x double, response double, desc array<double>"


def corners(a: np.ndarray, most: int, contrast: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y, x (to a fraction of a pixel) and response of the local maxima of the smaller curvature of the squared gradients."""
    blur = S.kernel_gaussian(1.5)
    gy, gx = np.gradient(S.kernel_gaussian(1.0)(a))
    yy, xx, xy = blur(gy * gy), blur(gx * gx), blur(gx * gy)
    r = (yy + xx) / 2 - np.sqrt(((yy - xx) / 2) ** 2 + xy * xy)
    near = np.pad(r, 1, constant_values=-1)
    around = np.max([near[1 + i : 1 + i + r.shape[0], 1 + j : 1 + j + r.shape[1]] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j], 0)
    rim = np.zeros(r.shape, bool)
    rim[EDGE:-EDGE, EDGE:-EDGE] = True
    y, x = np.nonzero((r > around) & rim & (r > contrast * contrast * max(float(r.max()), 1e-12)))
    order = np.lexsort((x, y, -r[y, x]))[:most]
    y, x = y[order], x[order]
    part = lambda lo, mid, hi: np.clip((lo - hi) / np.where(lo + hi - 2 * mid < 0, 2 * (lo + hi - 2 * mid), -np.inf), -0.5, 0.5)
    return y + part(r[y - 1, x], r[y, x], r[y + 1, x]), x + part(r[y, x - 1], r[y, x], r[y, x + 1]), r[y, x]


SIDE, STEP = 8, 1.5
EDGE = 7  # pixels of the rim whose patch would leave the raster


def patches(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """SIDE x SIDE samples about each place, of mean 0 and length 1."""
    b = S.kernel_gaussian(1.0)(a)
    o = (np.arange(SIDE) - (SIDE - 1) / 2) * STEP
    py, px = np.clip(y[:, None, None] + o[:, None], 0, a.shape[0] - 1.001), np.clip(x[:, None, None] + o, 0, a.shape[1] - 1.001)
    iy, ix = np.floor(py).astype(int), np.floor(px).astype(int)
    fy, fx = py - iy, px - ix
    v = (b[iy, ix] * (1 - fx) + b[iy, ix + 1] * fx) * (1 - fy) + (b[iy + 1, ix] * (1 - fx) + b[iy + 1, ix + 1] * fx) * fy
    v = v.reshape(len(y), SIDE * SIDE)
    v = v - v.mean(1, keepdims=True)
    return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)


def keypoints(frames: DataFrame, most: int = MOST, contrast: float = 0.04, rescue: float = 0.01, few: int = 128) -> DataFrame:
    """Keypoints of packed frames (stack, frame, h, w, px as 64-bit floats); one with fewer than ``few`` at ``contrast`` (a share
    of the frame's strongest) is searched again at ``rescue``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f in batch.itertuples(index=False):
                a = np.frombuffer(f.px).reshape(f.h, f.w)
                if min(a.shape) <= 2 * EDGE:
                    continue
                y, x, r = corners(a, most, contrast)
                if len(y) < few:
                    y, x, r = corners(a, most, rescue)
                if not len(y):
                    continue
                yield pd.DataFrame({"stack": f.stack, "frame": f.frame, "id": np.arange(len(y), dtype=np.int32), "y": y, "x": x, "response": r, "desc": list(patches(a, y, x))})

    return frames.select("stack", "frame", "h", "w", "px").mapInPandas(run, POINTS)


def two_nearest(moving: DataFrame, fixed: DataFrame) -> DataFrame:
    """stack, frame, other, id, nearest, d1, d2: for each descriptor of the moving frame ``other`` its nearest one of the fixed frame
    (the smaller id of equals), and both smallest distances. ``moving`` and ``fixed``: stack, frame, other, id, desc; a pair with fewer
    than two fixed descriptors gives nothing."""

    def run(key: tuple, m: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        names = [*PAIR, "id", "nearest", "d1", "d2"]
        if not len(m) or len(f) < 2:
            return pd.DataFrame([], columns=names)
        m, f = m.sort_values("id"), f.sort_values("id")
        a, b = np.stack(m["desc"].to_list()).astype(float), np.stack(f["desc"].to_list()).astype(float)
        out = []
        for lo in range(0, len(a), 256):
            d = ((a[lo : lo + 256, None, :] - b) ** 2).sum(2) if len(b) <= 512 else np.maximum((a[lo : lo + 256] ** 2).sum(1)[:, None] + (b * b).sum(1) - 2 * a[lo : lo + 256] @ b.T, 0)
            i = d.argmin(1)
            d1 = d[np.arange(len(d)), i].copy()
            d[np.arange(len(d)), i] = np.inf
            out.append((i, np.sqrt(d1), np.sqrt(d.min(1))))
        i, d1, d2 = (np.concatenate([o[k] for o in out]) for k in range(3))
        return pd.DataFrame(dict(zip(PAIR, key)) | {"id": m["id"].to_numpy(), "nearest": f["id"].to_numpy()[i], "d1": d1, "d2": d2})

    return moving.groupBy(*PAIR).cogroup(fixed.groupBy(*PAIR)).applyInPandas(run, "stack int, frame int, other int, id int, nearest int, d1 double, d2 double")


def ratio_matches(near: DataFrame, ratio: float = RATIO) -> DataFrame:
    return near.where(F.col("d1") < F.col("d2") * ratio)


def through_four(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Homographies (k x 9) through four places each (k x 4 x 2, as x, y); NaN where three of them lie on a line."""
    k = len(src)
    a, b = np.zeros((k, 8, 8)), np.zeros((k, 8))
    x, y, u, v = src[..., 0], src[..., 1], dst[..., 0], dst[..., 1]
    for r, (c, t) in enumerate(((0, u), (3, v))):
        a[:, r::2, c], a[:, r::2, c + 1], a[:, r::2, c + 2] = x, y, 1
        a[:, r::2, 6], a[:, r::2, 7] = -x * t, -y * t
        b[:, r::2] = t
    area = lambda d, e: np.abs(d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0])
    flat = lambda p: np.min([area(p[:, j] - p[:, i], p[:, m] - p[:, i]) for i, j, m in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))], 0)
    ok = (flat(src) > 1e-6) & (flat(dst) > 1e-6) & (np.abs(np.linalg.det(a)) > 1e-9)
    out = np.full((k, 9), np.nan)
    if ok.any():
        out[ok] = np.concatenate([np.linalg.solve(a[ok], b[ok][..., None])[..., 0], np.ones((ok.sum(), 1))], 1)
    return out


def moments(p: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre of places and the scale that makes their root mean square distance from it sqrt(2)."""
    c = p.mean(0)
    return c, np.sqrt(2) / max(np.sqrt(((p - c) ** 2).sum(1).mean()), 1e-12)


def triangle(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """At most 9 rows with the same least squares as the two equations of each of the (scaled) places."""
    one, zero = np.ones(len(p)), np.zeros(len(p))
    m = np.concatenate([np.stack([p[:, 0], p[:, 1], one, zero, zero, zero, -p[:, 0] * q[:, 0], -p[:, 1] * q[:, 0], -q[:, 0]], 1), np.stack([zero, zero, zero, p[:, 0], p[:, 1], one, -p[:, 0] * q[:, 1], -p[:, 1] * q[:, 1], -q[:, 1]], 1)])
    return np.linalg.qr(m, "r")


def solution(rows: np.ndarray, src: tuple[np.ndarray, float], dst: tuple[np.ndarray, float]) -> np.ndarray:
    """The homography that the rows of :func:`triangle` fix, back in places as they were before scaling."""
    a, b = (np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]]) for c, s in (src, dst))
    h = np.linalg.inv(b) @ np.linalg.svd(np.linalg.qr(rows, "r"))[2][-1].reshape(3, 3) @ a
    return (h / h[2, 2]).ravel()


def least_squares(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The homography of all places, scaled about their centres first."""
    (c, s), (d, t) = m = moments(src), moments(dst)
    return solution(triangle((src - c) * s, (dst - d) * t), *m)


def fitted(own: DataFrame) -> DataFrame:
    """stack, frame, other, h, n: :func:`least_squares` of each pair's matches, of which there may be any number: the centres and
    scales are aggregates, every batch of matches becomes a triangle of at most 9 rows a pair, and only triangles meet."""
    cols = ("mx", "my", "fx", "fy")
    spread = lambda u, v: F.sqrt(F.lit(2.0)) / F.greatest(F.sqrt(F.var_pop(u) + F.var_pop(v)), F.lit(1e-12))
    at = own.groupBy(*PAIR).agg(*[F.avg(c).alias(f"_{c}") for c in cols], spread("mx", "my").alias("_s"), spread("fx", "fy").alias("_t"), F.count(F.lit(1)).cast("int").alias("n"))
    row = [f"r{k}" for k in range(9)]

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, p in batch.groupby(PAIR, sort=False):
                v = p[list(cols)].to_numpy()
                yield pd.DataFrame(triangle(v[:, :2], v[:, 2:]), columns=row).assign(**dict(zip(PAIR, key)))

    scaled = own.join(at, PAIR).select(*PAIR, *[((F.col(c) - F.col(f"_{c}")) * F.col(s)).alias(c) for c, s in zip(cols, ("_s", "_s", "_t", "_t"))])
    triangles = scaled.mapInPandas(reduced, ", ".join([f"{c} int" for c in PAIR] + [f"{c} double" for c in row]))

    def solved(key: tuple, p: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        m = m.iloc[0]
        h = solution(p[row].to_numpy(), (m[["_mx", "_my"]].to_numpy(float), m["_s"]), (m[["_fx", "_fy"]].to_numpy(float), m["_t"]))
        return pd.DataFrame([(*key, h, int(m["n"]))], columns=[*PAIR, "h", "n"])

    return triangles.groupBy(*PAIR).cogroup(at.groupBy(*PAIR)).applyInPandas(solved, "stack int, frame int, other int, h array<double>, n int")


def hypotheses(matches: DataFrame, draws: int = 500, seed: int = 0) -> DataFrame:
    """stack, frame, other, hyp, h: homographies (moving -> fixed place) through four matches of a pair that a hash draws.

    ``matches``: stack, frame, other, id, my, mx, fy, fx."""
    w = W.partitionBy(*PAIR)  # at most the keypoints of a frame
    m = matches.select(*PAIR, "my", "mx", "fy", "fx", (F.row_number().over(w.orderBy("id")) - 1).alias("_i"), F.count(F.lit(1)).over(w).alias("_n")).where("_n >= 4")
    pick = m.select(*PAIR, "_n").distinct().select(*PAIR, "_n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("hyp")).select(*PAIR, "_n", "hyp", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("k"))
    pick = pick.withColumn("_i", F.pmod(F.xxhash64(F.lit(seed), "hyp", "k"), F.col("_n")).cast("int"))
    four = pick.join(m.drop("_n"), [*PAIR, "_i"]).groupBy(*PAIR, "hyp").agg(F.countDistinct("_i").alias("_d"), F.array_sort(F.collect_list(F.struct("k", "mx", "my", "fx", "fy"))).alias("p")).where("_d = 4")

    @F.pandas_udf("array<double>")
    def solved(p: pd.Series) -> pd.Series:
        v = np.array([[[r["mx"], r["my"], r["fx"], r["fy"]] for r in x] for x in p], float).reshape(-1, 4, 4)
        return pd.Series(list(through_four(v[..., :2], v[..., 2:])))

    return four.select(*PAIR, "hyp", solved("p").alias("h")).where(~F.isnan(F.element_at("h", 1)))


def inliers(matches: DataFrame, hyps: DataFrame, reach: float = REACH) -> DataFrame:
    """``matches`` that a hypothesis carries to within ``reach`` pixels of their fixed place, with hyp and err."""
    h = [F.element_at("h", i + 1) for i in range(9)]
    sx, sy = P.project(h, F.col("mx"), F.col("my"))
    err = F.sqrt((sx - F.col("fx")) ** 2 + (sy - F.col("fy")) ** 2)
    return matches.join(hyps, PAIR).withColumn("err", err).where(F.col("err") < reach).drop("h")


def consensus(matches: DataFrame, draws: int = 500, reach: float = REACH, seed: int = 0) -> DataFrame:
    """stack, frame, other, h (moving -> fixed place), n (inliers): the least-squares homography of the matches of the hypothesis with
    the most inliers (the first of equals)."""
    from .components import cut

    hyps = cut(hypotheses(matches, draws, seed))
    count = inliers(matches, hyps, reach).groupBy(*PAIR, "hyp").agg(F.count(F.lit(1)).alias("n"))
    best = count.groupBy(*PAIR).agg(F.max(F.struct("n", (-F.col("hyp")).alias("hyp"))).alias("b")).where(F.col("b.n") >= 4).select(*PAIR, (-F.col("b.hyp")).alias("hyp"))
    own = cut(inliers(matches, hyps.join(best, [*PAIR, "hyp"]), reach))  # read three times
    return fitted(own)


def register_features(px: DataFrame, pairs: DataFrame, height: int, width: int, value: str = "v", draws: int = 500, most: int = MOST) -> DataFrame:
    """stack, frame, other, h: maps places of the fixed frame to the moving one, by features; pairs that can't be matched are left out.

    ``px``: stack, frame, y, x and a value; ``pairs``: stack, frame (fixed), other (moving)."""
    from .components import cut

    points = cut(keypoints(S.to_tiles(px, max(height, width), 0, height, width, value), most))
    pr = pairs.select(*PAIR)
    names = ["id", "y", "x", "desc"]
    of = lambda side: points.select(*[F.col(a).alias(b) for a, b in (("stack", "stack"), ("frame", side), *zip(names, names))]).join(pr, ["stack", side]).select(*PAIR, *names)
    fixed, moving = of("frame"), of("other")  # each with columns of its own, for both come from one table
    near = ratio_matches(two_nearest(moving.select(*PAIR, "id", "desc"), fixed.select(*PAIR, "id", "desc")))
    m = near.join(moving.select(*PAIR, "id", F.col("y").alias("my"), F.col("x").alias("mx")), [*PAIR, "id"]).join(fixed.select(*PAIR, F.col("id").alias("nearest"), F.col("y").alias("fy"), F.col("x").alias("fx")), [*PAIR, "nearest"])
    got = consensus(cut(m.select(*PAIR, "id", "my", "mx", "fy", "fx")), draws)
    inverse = F.array(*P.adjugate([F.element_at("h", i + 1) for i in range(9)]))
    return got.withColumn("_a", inverse).select(*PAIR, F.transform("_a", lambda v: v / F.element_at("_a", 9)).alias("h"))
