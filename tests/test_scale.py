"""What large tables need: windows that only grow, mergeable fits, whole batches of planes at once."""

import numpy as np
from pyspark.sql import functions as F

from stratagrid.operators import join as J
from stratagrid.operators import matching as MT
from stratagrid.operators import stencil as S


def test_nearest_survivor_reads_no_window_anew(spark):
    f = spark.range(700).select(F.lit(0).alias("stack"), F.col("id").cast("int").alias("frame"))
    got = J.nearest_survivor(f, f.where("frame % 97 IN (3, 50) AND frame > 60"))
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedfollowing" not in plan
    at = np.array([i for i in range(700) if i % 97 in (3, 50) and i > 60])
    assert {r["frame"]: r["nearest"] for r in got.collect()} == {i: int(at[np.abs(at - i).argmin()]) for i in range(700)}


def test_consensus_fits_many_matches_in_little_memory(spark):
    """40000 inliers: the full left factor of their equations would take 51 GB."""
    q = lambda k: (F.xxhash64(F.lit(k), "id") % 100000) / 1000.0
    m = spark.range(40000).select(F.lit(3).alias("stack"), F.lit(0).alias("frame"), F.lit(1).alias("other"), F.col("id").cast("int").alias("id"), q(1).alias("mx"), q(2).alias("my"))
    m = m.withColumn("fx", F.col("mx") * 1.02 - F.col("my") * 0.01 + 3).withColumn("fy", F.col("mx") * 0.01 + F.col("my") * 0.98 - 2)
    got = MT.consensus(m, 5).collect()
    assert [r["n"] for r in got] == [40000]
    assert np.allclose(got[0]["h"], [1.02, -0.01, 3, 0.01, 0.98, -2, 0, 0, 1], atol=1e-9)


def test_least_squares_of_four_places():
    src = np.array([(0.0, 0), (10, 1), (2, 9), (8, 12)])
    h = np.array([1.1, 0.05, 3, -0.02, 0.9, 1, 0.001, 0.002, 1])
    w = src @ h[6:8] + 1
    dst = np.stack([(src @ h[:2] + h[2]) / w, (src @ h[3:5] + h[5]) / w], 1)
    assert np.allclose(MT.least_squares(src, dst), h, atol=1e-9)


def test_gather_and_warp_read_across_blocks_and_gaps(spark):
    """A raster of several blocks with missing and null pixels, places beyond its rim, a null place; no row for each tap is joined."""
    h, w, rng = 41, 37, np.random.default_rng(5)
    a = rng.normal(size=(h, w))
    there, full = rng.random((h, w)) > 0.2, rng.random((h, w)) > 0.1
    there[:6, :6] = False
    src = spark.createDataFrame([(2, 0, y, x, float(a[y, x]) if full[y, x] else None) for y in range(h) for x in range(w) if there[y, x]], "stack int, frame int, y int, x int, v double")
    at = spark.createDataFrame([(2, 0, i // w, i % w, float(py), float(px), "k") for i, (py, px) in enumerate(rng.uniform(-9, 50, (h * w, 2)))] + [(2, 0, 0, w, None, 3.0, "n")], "stack int, frame int, y int, x int, py double, px double, tag string")
    g = J.gather(at, src, "py", "px", h, w, key=("stack", "frame"), out="o")
    assert g.columns == [*at.columns, "o"]
    want = {}
    for r in at.collect():
        py, px = min(max(r["py"] or 0.0, 0), h - 1), min(max(r["px"], 0), w - 1)
        y, x = int(py), int(px)
        taps = [(min(y + i, h - 1), min(x + j, w - 1), (py - y if i else 1 - py + y) * (px - x if j else 1 - px + x)) for i in (0, 1) for j in (0, 1)]
        if any(there[q[:2]] for q in taps):
            vs = [a[q[:2]] * q[2] for q in taps if there[q[:2]] and full[q[:2]]]
            want[r["y"], r["x"], r["tag"]] = sum(vs) if vs else None
    got = {(r["y"], r["x"], r["tag"]): r["o"] for r in g.collect()}
    assert set(got) == set(want)
    assert all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-12) for k, v in want.items())
    whole = spark.createDataFrame([(2, 0, y, x, float(a[y, x])) for y in range(h) for x in range(w)], "stack int, frame int, y int, x int, v double")
    moved = J.warp_gather(whole, whole, [1.0, 0, 5.0, 0, 1.0, -18.0, 0, 0, 1.0], h, w)
    out = {(r["y"], r["x"]): (r["v"], r["a"]) for r in moved.collect()}
    assert len(out) == h * w and all(abs(out[y, x][0] - a[max(y - 18, 0), min(x + 5, w - 1)]) < 1e-9 and out[y, x][1] == float(y >= 18 and x + 5 < w) for y in range(h) for x in range(w))
    turned = J.warp_gather(whole, whole, [0.98, 0.2, 1.3, -0.2, 0.98, 4.6, 0, 0, 1.0], h, w).where("y = 20 AND x = 15").first()
    sx, sy = 0.98 * 15 + 0.2 * 20 + 1.3, -0.2 * 15 + 0.98 * 20 + 4.6
    ky, kx = (np.sinc(s - np.arange(int(s) - 2, int(s) + 4)) * np.sinc((s - np.arange(int(s) - 2, int(s) + 4)) / 3) for s in (sy, sx))
    part = a[int(sy) - 2 : int(sy) + 4, int(sx) - 2 : int(sx) + 4]
    assert abs(turned["v"] - np.clip((ky[:, None] * kx * part).sum() / (ky.sum() * kx.sum()), part[2:4, 2:4].min(), part[2:4, 2:4].max())) < 1e-9
    plan = J.warp_gather(whole, whole, [1.0] * 9, h, w)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan


def test_tiles_are_cut_in_batches(spark):
    """Blocks of several tiles with halos across them, unlike sides, two planes of two frames; no Python call for each tile."""
    h, w, tile, halo, rng = 45, 71, 12, 5, np.random.default_rng(2)
    a = rng.normal(size=(2, h, w))
    px = spark.createDataFrame([(1, f, y, x, float(a[f, y, x])) for f in (0, 1) for y in range(h) for x in range(w)], "stack int, frame int, y int, x int, v double")
    t = S.to_tiles(px, tile, halo, h, w)
    assert "FlatMapGroupsInPandas" not in t._jdf.queryExecution().optimizedPlan().toString()
    rows = t.collect()
    assert len(rows) == 2 * 4 * 6
    for r in rows:
        y0, x0, y1, x1 = max(0, r["ty"] * tile - halo), max(0, r["tx"] * tile - halo), min(h, (r["ty"] + 1) * tile + halo), min(w, (r["tx"] + 1) * tile + halo)
        assert (r["y0"], r["x0"], r["h"], r["w"]) == (y0, x0, y1 - y0, x1 - x0)
        assert np.array_equal(np.frombuffer(r["px"]).reshape(r["h"], r["w"]), a[r["frame"], y0:y1, x0:x1])
    for kernel in (S.kernel_laplacian, S.kernel_gaussian(1.5)):
        want, seen = [kernel(p) for p in a], S.map_tiles(t, kernel, tile).collect()
        assert len(seen) == 2 * h * w
        assert all(abs(r["v"] - want[r["frame"]][r["y"], r["x"]]) < 1e-12 for r in seen)


def test_colour_tiles_are_cut_in_batches(spark):
    from stratagrid.operators import pyramid_tiles as PT

    g, rng = PT.Grid(40, 28, 16, 1, "<f4"), np.random.default_rng(3)
    a = rng.random((3, 40, 28))
    px = spark.createDataFrame([(4, 2, y, x, *[float(v) for v in a[:, y, x]]) for y in range(40) for x in range(28)], "stack int, frame int, y int, x int, r double, g double, b double")
    t = PT.from_pixels(px, g)
    assert t.columns == PT.COLUMNS and "FlatMapGroupsInPandas" not in t._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((tuple(r) for r in t.collect()), key=str)
    assert got == sorted(PT.cut_frames(a, g, 4, 2), key=str)
