"""Open-background gates, the coarse-to-fine offset search, undo limits and redo."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from stratagrid.operators import aggregate as A
from stratagrid.operators import edits as E
from stratagrid.operators import pmax as M


def plane(spark, arrays, names):
    """Rows of one raster for each stack: arrays[stack] is a tuple of equal arrays."""
    parts = []
    for s, a in arrays.items():
        y, x = np.mgrid[: a[0].shape[0], : a[0].shape[1]]
        parts.append(pd.DataFrame({"stack": s, "y": y.ravel(), "x": x.ravel()} | {n: v.ravel() for n, v in zip(names, a)}))
    d = spark.createDataFrame(pd.concat(parts))
    return d.select(*[F.col(c).cast("int").alias(c) for c in ("stack", "y", "x")], *names)


def test_each_gate_of_open_background_rejects(spark):
    """One stack passes; of each other one thing is wrong: size, border, clean pixels, the ratio, flatness."""
    h = w = 12

    def stack(size=True, border=True, clean=True, ratio=True, flat=True):
        hi, lo = np.full((h, w), 1.0), np.full((h, w), 0.5)
        if not ratio:
            lo[:] = 0.001  # in and out of focus by 10 octaves
        hi[5:8, 5:8] = 100.0  # the subject
        if not size:
            hi[:], hi[0, :3] = 100.0, 1.0
        if not border:
            hi[0], hi[-1], hi[:, 0], hi[:, -1] = (100.0,) * 4
        low = np.full((h, w), 0.4) if flat else np.where((np.arange(h)[:, None] // 2 + np.arange(w) // 2) % 2 == 0, 0.2, 0.6)
        high = low + (0.01 if clean else 0.03)
        return (hi, lo), (low, high)

    wrong = [{}, {"size": False}, {"border": False}, {"clean": False}, {"ratio": False}, {"flat": False}]
    made = [stack(**k) for k in wrong]
    focus = plane(spark, {s: m[0] for s, m in enumerate(made)}, ["hi", "lo"]).cache()
    lum = plane(spark, {s: m[1] for s, m in enumerate(made)}, ["lo", "hi"]).cache()
    frames = spark.createDataFrame([(s, 10) for s in range(6)], "stack int, n int")
    gates = {"radius": 0, "alpha": 0.15, "least": 20, "clean": 20}
    _, st = M.open_field(focus, lum, frames, h, w, **gates)
    ok = {r["stack"]: r["candidate"] for r in st.groupBy("stack").agg(F.max("candidate").alias("candidate")).collect()}
    assert ok == {0: True, 1: False, 2: False, 3: False, 4: False, 5: True}
    bg, clean = M.open_background(focus, lum, frames, h, w, 2, anchors=5, weight=1.0, **gates)
    assert {r["stack"] for r in bg.where("m").select("stack").distinct().collect()} == {0}
    field = {r["stack"]: (r["a"], r["b"]) for r in clean.groupBy("stack").agg(F.min("v").alias("a"), F.max("v").alias("b")).collect()}
    assert abs(field[0][0] - 0.405) < 1e-9 and abs(field[0][1] - 0.405) < 1e-9 and field[5] == (0.0, 0.0)  # filled from the anchors alone; none of a rejected one


def test_offset_search_finds_a_shift(spark):
    rng = np.random.default_rng(4)
    big = rng.random((110, 120))
    big = (big + np.roll(big, 1, 0) + np.roll(big, 1, 1) + np.roll(big, -1, 0) + np.roll(big, -1, 1)) / 5
    a, b = big[10:100, 10:110], big[15:105, 3:103]  # b at (y, x) is a at (y + 5, x - 7)
    pa, pb = (plane(spark, {0: (v, v, v), 1: (v, v * 0.5, v)}, ["r", "g", "b"]) for v in (a, b))
    got = {r["stack"]: r for r in A.intersection_psnr(pa, pb, 90, 100, reach=9, coarse=5, fine=3).collect()}
    assert [(got[s]["dy"], got[s]["dx"]) for s in (0, 1)] == [(5, -7)] * 2 and got[0]["psnr"] == float("inf")
    one = pa.select("stack", "y", "x", F.col("r").alias("v"))
    assert A.searched_offset(one.where("y < 40 AND x < 40"), one.where("y < 40 AND x < 40"), 40, 40, reach=2).count() == 0  # too little overlap to judge


def test_undo_limits_and_redo(spark):
    rows = [(0, e, False, e % 3, x, float(e)) for e in range(1, 8) for x in range(2)] + [(0, 8, False, y, 0, 8.0) for y in range(9)] + [(1, 1, False, y, 0, 1.0) for y in range(99)]
    log = spark.createDataFrame(rows, "stack int, edit int, undone boolean, y int, x int, v double")
    kept = {(r["stack"], r["edit"]): (r["bytes"], r["kept"]) for r in E.undoable(log, 4, 90, 1, 5).collect()}
    assert kept[0, 8] == (45, True) and kept[1, 1] == (495, True)  # the newest stays whatever it weighs
    assert [e for e in range(1, 9) if kept[0, e][1]] == [5, 6, 7, 8]  # four strokes, 75 bytes
    assert [e for e in range(1, 9) if {r["edit"]: r["kept"] for r in E.undoable(log.where("stack = 0"), 9, 70, 1, 5).collect()}[e]] == [6, 7, 8]
    state = lambda d: {r["edit"]: r["undone"] for r in d.where("stack = 0").select("edit", "undone").distinct().collect()}
    twice = E.undo(E.undo(log))
    assert [e for e, u in state(twice).items() if u] in ([7, 8], [8, 7])
    once = E.redo(twice)
    assert [e for e, u in state(once).items() if u] == [8] and not any(state(E.redo(E.redo(once))).values())
    new = spark.createDataFrame([(0, 9, 0, 0, 9.0)], "stack int, edit int, y int, x int, v double")
    assert set(state(E.recorded(twice, new))) == {*range(1, 7), 9} and state(E.redo(E.recorded(twice, new))) == state(E.recorded(twice, new))
