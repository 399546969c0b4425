"""Lit background: walks, peaks, composite and the whole tier in the pyramid fusion."""

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from stratagrid.operators import lit as L
from stratagrid.operators import pmax


def test_walk_equals_breadth_first_search(spark):
    rng = np.random.default_rng(5)
    open_ = rng.random((12, 12)) < 0.55
    arg = rng.integers(0, 6, (12, 12))
    seeds = [(0, 0, 1, 2), (11, 5, 2, 4)]  # y, x, label, ref
    cells = [(0, y, x, int(arg[y, x])) for y in range(12) for x in range(12) if open_[y, x]]
    got = L.walk(
        spark.createDataFrame([(0, *s) for s in seeds], "stack int, y int, x int, label int, ref int"),
        spark.createDataFrame(cells, "stack int, y int, x int, arg int"), F.abs(F.col("arg") - F.col("ref")) <= 2, 4,
    )
    want = set()
    for y0, x0, lab, ref in seeds:
        dist, todo = {(y0, x0): 0}, deque([(y0, x0)])
        while todo:
            y, x = todo.popleft()
            for ny in range(max(y - 1, 0), min(y + 2, 12)):
                for nx in range(max(x - 1, 0), min(x + 2, 12)):
                    if dist[y, x] < 4 and (ny, nx) not in dist and open_[ny, nx] and abs(arg[ny, nx] - ref) <= 2:
                        dist[ny, nx] = dist[y, x] + 1
                        todo.append((ny, nx))
        want |= {(y, x, lab, k) for (y, x), k in dist.items()}
    rows = [(r.y, r.x, r.label, r.steps) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 8


def test_peaks_commit_only_near_the_first_frame(spark):
    n = 20
    shape = {1: {1: 9.0}, 2: {10: 9.0}, 3: {19: 9.0}, 4: {}, 5: {0: 4.0, 7: 3.5, 12: 3.5, 15: 3.5}}  # near, mid, far, flat, not significant
    curve = spark.createDataFrame([(0, k, f, 1.0 + s.get(f, 0.1 * (f % 3))) for k, s in shape.items() for f in range(n)] + [(0, 6, f, 1.0) for f in range(n)], "stack int, label int, frame int, e double")
    p = {r.label: r for r in L.peaks(curve, spark.createDataFrame([(0, n)], "stack int, n long"), L.Lit()).collect()}
    assert {k for k, r in p.items() if r.committed} == {1}
    assert p[2].frame == 10 and p[3].frame == 19 and p[6].z is None and p[2].near in (1, 2)


def test_composite_is_convex_and_stays_inside(spark):
    side = 64
    lit = spark.createDataFrame([(0, y, x, 1, 2, False, 0) for y in range(8) for x in range(4)], "stack int, y int, x int, label int, frame int, veto boolean, steps int")
    blocks = spark.createDataFrame([(0, 0, 0, 2), (0, 1, 0, 2)], "stack int, by int, bx int, frame int")
    px = pd.DataFrame([(k, f, y, x) for k in (0, 1) for f in range(3) for y in range(side) for x in range(side)], columns=["stack", "frame", "y", "x"])
    px["r"] = px["g"] = px["b"] = 0.25 * px["frame"]
    px = spark.createDataFrame(px)
    image = px.where("frame = 0").select("stack", "y", "x", *[F.lit(1.0).alias(c) for c in "rgb"])
    out = L.composite(image, px, lit, blocks, side, side, 8, L.Lit(block=4)).toPandas()
    assert len(out) == 2 * side * side and not out.isna().any().any()
    a = out[out["stack"] == 0].pivot(index="y", columns="x", values="r").to_numpy()
    assert np.allclose(a[:, :16], 0.5) and np.allclose(a[:, 32:], 1.0) and ((a > 0.5 - 1e-12) & (a < 1 + 1e-12)).all()
    assert (np.diff(a, axis=1) > -1e-12).all() and a[30, 31] < 1.0
    assert np.allclose(out[out["stack"] == 1]["r"], 1.0)


def test_fuse_gives_a_lit_region_its_frame(spark):
    side, n = 32, 12
    t = np.random.default_rng(3).normal(0, 0.05, (side, side))
    amp = [2.0] + [1.0 + 0.01 * f for f in range(1, n)]
    rows = [(0, f, y, x, *([float(0.5 + amp[f] * t[y, x])] * 3), 1.0) for f in range(n) for y in range(side) for x in range(side)]
    px = spark.createDataFrame(rows, "stack int, frame int, y int, x int, r double, g double, b double, a double")
    o = pmax.Options(coarse_levels=0, normalize_exposure=False, lit=L.Lit(rim=0, least=4, block=1))
    out = pmax.fuse(px, side, side, o, n_levels=2).toPandas().sort_values(["y", "x"])
    assert np.allclose(out["r"].to_numpy().reshape(side, side), 0.5 + 2 * t, atol=1e-9)
