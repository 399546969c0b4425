"""Fusion after exclusions, and pyramid fusion on tiles against the long form."""

import pytest
from pyspark.sql import functions as F

from stratagrid.operators import aggregate as A
from stratagrid.operators import depth_tiles as DT
from stratagrid.operators import dmap as D
from stratagrid.operators import pmax as M
from stratagrid.operators import pyramid_tiles as PT
from stratagrid.sources import synth

KEYS = ["stack", "y", "x"]


def frame(df, cols=("r", "g", "b")):
    return df.select(*KEYS, *cols).toPandas().sort_values(KEYS).reset_index(drop=True)


def scene(spark, height, width, frames, stack=0, blur=3.0):
    return synth.pixels(spark, {stack: synth.Synth(frames=frames, height=height, width=width, blur=blur, seed=42 + stack)})


def test_fuse_numbers_the_kept_frames_by_themselves(spark):
    """Without frame 0 and with gaps, the result is that of the same frames numbered from 0; no stack is lost."""
    px = scene(spark, 16, 16, 9).unionByName(scene(spark, 16, 16, 5, 1)).where("stack = 1 OR frame IN (1, 2, 5, 8)").cache()
    dense, index = A.dense_frames(px)
    assert {(r["frame"], r["kept"]) for r in index.where("stack = 0").collect()} == {(0, 1), (1, 2), (2, 5), (3, 8)}
    o = D.Options(sharpness_sigma=0.0, focus_pre_sigma=0.0, median_radius=0)
    got, depth = D.fuse(px, 16, 16, o, regularize=False)
    want, other = D.fuse(dense, 16, 16, o, regularize=False)
    a, b = frame(got), frame(want)
    assert len(a) == 512 and (a - b).abs().max().max() < 1e-9
    d = frame(depth, ("d",))
    assert (d["d"] - frame(other, ("d",))["d"]).abs().max() < 1e-9 and d["d"].max() > 0
    half = spark.createDataFrame([(0, 0, 0, 1.5), (0, 0, 1, 3.0), (1, 0, 0, 0.0)], "stack int, y int, x int, d double")
    assert [r["d"] for r in A.kept_depth(half, index).orderBy(*KEYS).collect()] == [3.5, 8.0, 0.0]


def test_cuts_follow_each_stacks_own_frames(spark):
    """Frame counts belong to a stack: what is cut in one doesn't depend on how many frames another has."""
    px = spark.createDataFrame([(0, f) for f in range(3)] + [(1, f) for f in range(2, 900, 3)], "stack int, frame int")
    n = M.frame_counts(px)
    assert {r["stack"]: r["n"] for r in n.collect()} == {0: 3, 1: 300}
    fx = spark.createDataFrame([(s, y, 0, 10.0, 1.0) for s in (0, 1) for y in range(4)], "stack int, y int, x int, hi double, lo double")
    sharp = {r["stack"]: r["m"] for r in M.sharp_mask(fx, n, governance=True).collect()}
    assert sharp == {0: True, 1: False}  # 10 is above clamp(3 log2 3) = 6, not above 24.7
    cells = spark.createDataFrame([(s, y, 4 * x, 1.0 if x else 0.5, 0.25, False) for s in (0, 1) for y in range(4) for x in range(3)], "stack int, y int, x int, env_max double, env_min double, sharp boolean")
    both = {tuple(r) for r in M.texture_veto(cells, n).collect()}
    alone = {tuple(r) for s in (0, 1) for r in M.texture_veto(cells.where(F.col("stack") == s), n.where(F.col("stack") == s)).collect()}
    assert both == alone and len({r[3] for r in both if r[2] == 4}) == 2


@pytest.mark.parametrize("o", [M.Options(coarse_levels=0), M.Options(coarse_levels=1, cell=8)])
def test_tiles_equal_the_long_form(spark, monkeypatch, o):
    """Odd sizes, several squares, two rounds of one level, gated tracks, masks and the clamp; another stack beside."""
    h, w = 21, 35
    monkeypatch.setattr(PT, "ROUND", 1)
    px = scene(spark, h, w, 3).unionByName(scene(spark, h, w, 2, 1)).cache()
    g = PT.default_grid(h, w, 8, 2, "<f8")
    assert g.rounds() == [(0, 1), (1, 1)]
    got = frame(PT.long_form(PT.fuse(PT.from_pixels(px, g), g, o), ["r", "g", "b"], "<f8"))
    want = frame(M.fuse(px, h, w, o, 2))
    assert len(got) == 2 * h * w and (got - want).abs().max().max() < 1e-9


def test_rounds_of_several_levels_give_what_rounds_of_one_give(spark, monkeypatch):
    h, w = 37, 50
    px = scene(spark, h, w, 3).cache()
    o = M.Options(coarse_levels=0, normalize_exposure=False)
    out = []
    for step in (1, 3):
        monkeypatch.setattr(PT, "ROUND", step)
        g = PT.default_grid(h, w, 16, 4, "<f8")
        out.append(frame(PT.long_form(PT.fuse(PT.from_pixels(px, g), g, o), ["r", "g", "b"], "<f8")))
    assert len(out[0]) == h * w and (out[0] - out[1]).abs().max().max() < 1e-12


def test_tiles_cut_from_images_and_from_pixels_agree(spark):
    h, w = 20, 26
    px = scene(spark, h, w, 2)
    g = PT.default_grid(h, w, 16, 2, "<f8")
    a = {(r["frame"], r["ty"], r["tx"]): r for r in PT.from_pixels(px, g).collect()}
    p = px.orderBy("frame", "y", "x").toPandas()
    for f, own in p.groupby("frame"):
        image = own[["r", "g", "b"]].to_numpy().T.reshape(3, h, w)
        for row in PT.cut_frames(image, g, 0, f):
            r = a.pop((f, row[1], row[2]))
            assert tuple(r[c] for c in ("y0", "x0", "h", "w")) == row[6:10] and bytes(r["px"]) == row[10]
    assert not a
    with pytest.raises(ValueError, match="multiple"):
        PT.fuse(PT.from_pixels(px, g), PT.Grid(h, w, 12, 2), M.Options())
    assert PT.fuse(PT.from_pixels(px.where(F.lit(False)), g), g, M.Options(coarse_levels=0)).count() == 0


@pytest.mark.parametrize("o,regular", [(D.Options(), False), (D.Options(sharpness_sigma=1.5, downsample=4, median_radius=2, guided_radius=8.0), True)])
def test_depth_tiles_equal_the_long_form(spark, o, regular):
    """Gaps in the frames, uncovered pixels, flicker, odd sizes, several squares; the quarter grid's focus in the first case."""
    h, w = 21, 35
    px = scene(spark, h, w, 5).where("frame <> 1").unionByName(scene(spark, h, w, 3, 1))
    px = px.withColumn("a", F.when((F.col("frame") + F.col("x") + F.col("y")) % 11 == 0, 0.0).otherwise(1.0)).withColumn("r", F.col("r") * (1 + F.col("frame") * 0.01)).cache()
    g = PT.default_grid(h, w, 16, 1, "<f8")
    image, depth = DT.fuse(DT.from_pixels(px, g, o), g, o, regular)
    want, other = D.fuse(px, h, w, o, regular)
    assert (frame(depth, ("d",)) - frame(other, ("d",))).abs().max().max() < 1e-4  # sums are added up in another order, and the grid fit amplifies that
    got = frame(PT.long_form(image, ["r", "g", "b"], "<f8"))
    assert len(got) == 2 * h * w and (got - frame(want)).abs().max().max() < 1e-4
