"""Lit background: bright regions that no frame has in focus take one frame of their own.

All of it happens on the cell grid (8 x 8 pixels a cell), a 64th of the pixels, in joins, group-bys and frontier walks; only
the last composite goes back to pixels. The steps: which cells belong (lit, and energy that hardly moves over the frames),
holes of brighter glints filled, components of some size, each component's energy curve over the frames, a veto of
pockets that do come into focus, the decision whether a curve has one peak near the first frame, and the spread of the
decided regions into their surroundings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixel as P
from . import aggregate as A
from . import components as C
from . import stencil as S
from .window import box_mean

CELL = ["stack", "y", "x"]


@dataclass(frozen=True)
class Lit:
    # Share of the brightest light that counts as lit, energy ratios of a core and of its surroundings, least
    # energy as a share of the 99th percentile, outer ring without members, largest hole and least region in cells, cells of a
    # block's side, share of like neighbours and least cells of a pocket, least significance of a peak, steps of the spread.
    lit: float = 0.05
    core: float = 4.0
    wide: float = 30.0
    floor: float = 0.002
    rim: int = 2
    hole: int = 4096
    least: int = 256
    block: int = 8
    agree: float = 0.6
    pocket: int = 16
    z: float = 2.0
    reach: int = 16


def cells(energy: DataFrame, lum: DataFrame, factor: int = 8) -> DataFrame:
    """stack, frame, y, x, e, lum by cell: mean energy of each frame, and mean of the darkest frame's light.

    ``energy``: stack, frame, y, x, e; ``lum``: stack, y, x, lo (least light over the frames)."""
    dark = A.box_down(lum.select(*CELL, F.col("lo").alias("lum")), factor, "lum", "avg", ("stack",))
    return A.box_down(energy, factor, "e").join(dark, CELL)


def knee(lum: DataFrame, share: float = Lit.lit) -> DataFrame:
    """stack, cut: light above which a cell is lit, a share of the 95th percentile of ``lum``'s greatest light ``hi``."""
    return A.order_statistic(lum, "hi", 0.95, ["stack"]).select("stack", (F.greatest("q", F.lit(1e-6)) * share).alias("cut"))


def membership(grid: DataFrame, cut: DataFrame, rows: int, cols: int, o: Lit) -> DataFrame:
    """stack, y, x, arg, core, wide: the frame of each cell's most energy (ties to the first; null without energy), and whether its energy
    moves by less than the core and the surroundings may. ``grid``: as :func:`cells`; ``cut``: stack, cut."""
    top = F.max(F.struct(F.col("e"), (-F.col("frame")).alias("_f")))
    g = grid.groupBy(*CELL).agg(F.max("e").alias("hi"), F.min("e").alias("lo"), F.first("lum").alias("lum"), top.alias("_t"))
    g = g.withColumn("arg", F.when(F.col("hi") > 0, -F.col("_t._f")).cast("int"))
    q = A.order_statistic(g, "hi", 0.99, ["stack"]).select("stack", (F.greatest("q", F.lit(1e-7)) * o.floor).alias("_f"))
    g = g.join(q, "stack").join(cut, "stack")
    moves = lambda k: (F.col("hi") > F.col("_f")) & (F.col("hi") > F.greatest("lo", F.lit(1e-7)) * k)
    inside = F.col("y").between(o.rim, rows - 1 - o.rim) & F.col("x").between(o.rim, cols - 1 - o.rim)
    lit = F.col("lum") > F.col("cut")
    return g.select(*CELL, "arg", (lit & inside & ~moves(o.core)).alias("core"), (lit & ~moves(o.wide)).alias("wide"))


def regions(member: DataFrame, rows: int, cols: int, o: Lit) -> DataFrame:
    """stack, y, x, label of core cells in components of ``least`` cells or more, holes filled.

    A hole is a component of the other cells that doesn't touch the border and has at most ``hole`` cells; only those of its
    cells that may be surroundings are filled, so what comes into focus stays out."""
    rest = C.settle(C.label(member.select(*CELL, (~F.col("core")).alias("m")), cols))
    hole = A.component_stats(rest, rows, cols).where((~F.col("border")) & (F.col("cells") <= o.hole)).select("stack", "label", F.lit(True).alias("_h"))
    fill = rest.join(hole, ["stack", "label"]).select(*CELL, "_h")
    m = member.join(fill, CELL, "left").select(*CELL, (F.col("core") | (F.coalesce("_h", F.lit(False)) & F.col("wide"))).alias("m"))
    lab = C.settle(C.label(m, cols).where("label > 0"))
    keep = lab.groupBy("stack", "label").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= o.least).select("stack", "label")
    return lab.join(keep, ["stack", "label"]).select(*CELL, "label")


def _block(o: Lit) -> list[Column]:
    return [F.floor(F.col("y") / o.block).cast("int").alias("by"), F.floor(F.col("x") / o.block).cast("int").alias("bx")]


def block_labels(labels: DataFrame, o: Lit) -> DataFrame:
    """stack, by, bx, label: the region with the most cells of a block, if it has half of a whole block's; ties to the smaller label."""
    n = labels.groupBy("stack", *_block(o), "label").agg(F.count(F.lit(1)).alias("_n"))
    best = n.groupBy("stack", "by", "bx").agg(F.max(F.struct(F.col("_n"), (-F.col("label")).alias("_l"))).alias("_b"))
    return best.where(F.col("_b._n") * 2 >= o.block * o.block).select("stack", "by", "bx", (-F.col("_b._l")).cast("int").alias("label"))


def curves(blocks: DataFrame, grid: DataFrame, frames: DataFrame, o: Lit) -> DataFrame:
    """stack, label, frame, e: a region's energy over all frames of its stack (0 where it has none), summed over its whole blocks."""
    own = grid.withColumn("by", _block(o)[0]).withColumn("bx", _block(o)[1]).join(blocks, ["stack", "by", "bx"])
    e = own.groupBy("stack", "label", "frame").agg(F.round(F.sum("e"), 9).alias("e"))
    every = blocks.select("stack", "label").distinct().join(frames.select("stack", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("frame")), "stack")
    return every.join(e, ["stack", "label", "frame"], "left").select("stack", "label", "frame", F.coalesce("e", F.lit(0.0)).alias("e"))


def peaks(curve: DataFrame, frames: DataFrame, o: Lit) -> DataFrame:
    """stack, label, frame, z, near, committed: the peak of a region's curve and its significance (max - median over 90th percentile - median),
    the peak among the first frames, and whether the region takes its peak's frame: one of the first max(2, n div 16) + 1 frames with
    significance of at least ``z``. A peak at any later frame commits nothing: regions beyond the far end peak over many frames."""
    c = curve.groupBy("stack", "label").agg(F.array_sort(F.collect_list(F.struct("frame", "e"))).alias("_c"))  # one entry for each frame
    c = c.join(frames.select("stack", "n"), "stack").withColumn("_s", F.array_sort(F.transform("_c", lambda s: s["e"])))
    first = lambda a: F.element_at(F.filter(a, lambda s: s["e"] == F.array_max(F.transform(a, lambda t: t["e"]))), 1)["frame"]
    win = P.dof_window(F.col("n")).cast("int")
    med = F.element_at("_s", (F.floor(F.col("n") / 2) + 1).cast("int"))
    p90 = F.element_at("_s", (F.least((F.col("n") * F.lit(0.9)).cast("int"), F.col("n") - 1) + 1).cast("int"))
    c = c.withColumn("frame", first(F.col("_c"))).withColumn("near", first(F.slice("_c", F.lit(1), win + 1)))
    c = c.withColumn("z", F.when((p90 > med) & (F.array_max("_s") > med), (F.array_max("_s") - med) / (p90 - med)))
    return c.select("stack", "label", "frame", "z", "near", win.alias("win"), F.coalesce((F.col("frame") <= win) & (F.col("z") >= o.z), F.lit(False)).alias("committed"))


_RING = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def walk(seeds: DataFrame, open_: DataFrame, enter: Column, rounds: int | None = None) -> DataFrame:
    """stack, y, x, label, ref, steps: cells that 8-connected walks from each label's seeds reach, each label by itself.

    ``seeds``: stack, y, x, label, ref; ``open_``: cells by stack, y, x; ``enter``: of ``open_``'s columns and ``ref``. A walk never meets
    a cell again but at its last two frontiers, so a round touches only those and the cells about them."""
    ring = F.explode(F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i, j in _RING]))
    key = ["stack", "label", "y", "x"]
    edge = C.settle(seeds.select(*CELL, "label", "ref", F.lit(0).alias("steps")))
    out, before, k = edge, edge, 0
    while rounds is None or k < rounds:
        k += 1
        near = edge.withColumn("_o", ring).select("stack", (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x"), "label", "ref").distinct()
        nxt = near.join(open_, CELL).where(enter).select(*CELL, "label", "ref")
        nxt = nxt.join(edge.select(*key).unionAll(before.select(*key)), key, "left_anti")
        nxt = C.settle(nxt.select(*CELL, "label", "ref", F.lit(k).alias("steps")))
        if nxt.isEmpty():
            break
        before, edge, out = edge, nxt, out.unionAll(nxt)
    return out


def coherent(member: DataFrame, frames: DataFrame, o: Lit) -> DataFrame:
    """stack, y, x: cells whose frame of most energy lies within max(2, n div 16) of that of more than ``agree`` of the cells with energy in
    their 5 x 5 box, themselves included."""
    own = member.where("arg IS NOT NULL").join(frames.select("stack", P.dof_window(F.col("n")).cast("int").alias("_w")), "stack").select(*CELL, "arg", "_w")
    box = F.explode(F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in range(-2, 3) for j in range(-2, 3)]))
    # neighbours send their frame, so that a box is one group of 25
    near = own.select("stack", F.col("arg").alias("_a"), "y", "x", box.alias("_o")).select("stack", "_a", (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x"))
    g = own.join(near, CELL).groupBy(*CELL).agg(F.sum((F.abs(F.col("arg") - F.col("_a")) <= F.col("_w")).cast("long")).alias("_k"), F.count(F.lit(1)).alias("_n"))
    return g.where(F.col("_k") > F.col("_n") * F.lit(o.agree)).select(*CELL)


def vetoed(labels: DataFrame, member: DataFrame, peak: DataFrame, like: DataFrame, rows: int, cols: int, o: Lit) -> DataFrame:
    """stack, y, x: cells of pockets that come into focus at another frame than their region's: coherent cells inside the region, at least
    ``pocket`` of them together, grown over the region's cells that peak near the pocket's median frame.

    ``like``: the cells of :func:`coherent`; ``peak``: as :func:`peaks`."""
    lab = member.select(*CELL, "arg").join(labels, CELL, "left")
    inner = S.erode(lab.select(*CELL, F.col("label").isNotNull().alias("m")), 2).where("m").select(*CELL)
    far = labels.join(peak.select("stack", "label", "near", "win"), ["stack", "label"]).join(member.select(*CELL, "arg"), CELL)
    cand = far.where(F.abs(F.col("arg") - F.col("near")) > F.col("win")).join(inner, CELL).join(like, CELL).select(*CELL, F.lit(True).alias("_c"))
    m = C.settle(member.select(*CELL, "arg").join(cand, CELL, "left").select(*CELL, "arg", F.coalesce("_c", F.lit(False)).alias("m")))
    if m.where("m").isEmpty():
        return m.where("m").select(*CELL)
    pk = C.settle(C.label(m.select(*CELL, "m"), cols).where("label > 0").join(m.select(*CELL, "arg"), CELL))
    size = pk.groupBy("stack", "label").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= o.pocket)
    at = A.upper_median(pk, "arg", ["stack", "label"]).join(size.select("stack", "label"), ["stack", "label"]).select("stack", "label", F.col("q").alias("ref"))
    seeds = pk.join(at, ["stack", "label"]).select(*CELL, "label", "ref")
    room = C.settle(far.select(*CELL, "arg", "win"))
    return walk(seeds, room, F.abs(F.col("arg") - F.col("ref")) <= F.col("win")).select(*CELL).distinct()


def without_pockets(blocks: DataFrame, labels: DataFrame, veto: DataFrame, o: Lit) -> DataFrame:
    """The blocks of which less than half of the regions' cells is vetoed."""
    v = labels.select(*CELL).join(veto.select(*CELL, F.lit(1).alias("_v")), CELL, "left")
    share = v.groupBy("stack", *_block(o)).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.coalesce("_v", F.lit(0))).alias("_v"))
    return blocks.join(share.where(F.col("_v") * 2 >= F.col("_n")).select("stack", "by", "bx"), ["stack", "by", "bx"], "left_anti")


def lit_cells(grid: DataFrame, cut: DataFrame, frames: DataFrame, rows: int, cols: int, o: Lit | None = None) -> tuple[DataFrame, DataFrame]:
    """(stack, y, x, label, frame, veto, steps of every cell that takes a frame; stack, by, bx, frame of every block that is mostly such cells).

    ``grid``: stack, frame, y, x, e, lum (:func:`cells`); ``cut``: stack, cut (:func:`knee`); ``frames``: stack, n, frames numbered from 0.
    Blocks at the grid's edge have no say in the decision: a coverage rim would look like a peak at an end. Cells that two regions reach
    go to the nearer one, then to the smaller label. Stacks without any such region have no rows."""
    o = o or Lit()
    grid, frames = C.settle(grid), C.settle(frames)
    member = C.settle(membership(grid, cut, rows, cols, o))
    labels = C.settle(regions(member, rows, cols, o))
    blocks = block_labels(labels, o)
    last = F.lit(-(-rows // o.block) - 1), F.lit(-(-cols // o.block) - 1)
    blocks = C.settle(blocks.where((F.col("by") > 0) & (F.col("bx") > 0) & (F.col("by") < last[0]) & (F.col("bx") < last[1])))
    like = C.settle(coherent(member, frames, o))
    veto = C.settle(vetoed(labels, member, C.settle(peaks(curves(blocks, grid, frames, o), frames, o)), like, rows, cols, o))
    left = curves(without_pockets(blocks, labels, veto, o), grid, frames, o)
    own = C.settle(peaks(left, frames, o).where("committed").select("stack", "label", F.col("frame").alias("ref"), "win"))
    seeds = labels.join(own, ["stack", "label"]).select(*CELL, "label", "ref")
    win = frames.select("stack", P.dof_window(F.col("n")).cast("int").alias("win"))
    room = member.where("wide").join(win, "stack").join(like.select(*CELL, F.lit(True).alias("_l")), CELL, "left").select(*CELL, "arg", "win", F.coalesce("_l", F.lit(False)).alias("_l"))
    off = F.col("_l") & F.coalesce(F.abs(F.col("arg") - F.col("ref")) > F.col("win"), F.lit(False))
    w = walk(seeds, C.settle(room), ~off, o.reach)
    near = w.groupBy(*CELL).agg(F.min(F.struct("steps", "label", "ref")).alias("_b")).select(*CELL, F.col("_b.label").alias("label"), F.col("_b.ref").cast("int").alias("frame"), F.col("_b.steps").alias("steps"))
    out = C.settle(near.join(veto.select(*CELL, F.lit(True).alias("_v")), CELL, "left").select(*CELL, "label", "frame", F.coalesce("_v", F.lit(False)).alias("veto"), "steps"))
    by = block_labels(out, o).join(own.select("stack", "label", F.col("ref").cast("int").alias("frame")), ["stack", "label"]).select("stack", "by", "bx", "frame")
    return out, by


def composite(image: DataFrame, px: DataFrame, lit: DataFrame, blocks: DataFrame, height: int, width: int, factor: int = 8, o: Lit | None = None) -> DataFrame:
    """The image with lit regions blended towards their block's frame: stack, y, x, r, g, b.

    The weight is the region's mask blurred (sigma 3) and taken from a half on, so it is 0 outside, times the frame's own share: its blocks'
    cells smoothed 3 x 3 and resized to pixels. Every pixel is a convex mean of its image and its frames.
    ``image``: stack, y, x, r, g, b; ``px``: the aligned frames; ``lit``, ``blocks``: as :func:`lit_cells`."""
    o = o or Lit()
    rows, cols = -(-height // factor), -(-width // factor)
    up = lambda d: d.withColumn("_cy", F.floor(F.col("y") / factor).cast("int")).withColumn("_cx", F.floor(F.col("x") / factor).cast("int"))
    has = lit.where("NOT veto").select("stack", F.col("y").alias("_cy"), F.col("x").alias("_cx"), F.lit(1.0).alias("_m"))
    touched = blocks.select("stack").distinct()
    mask = up(image.join(touched, "stack", "left_semi").select(*CELL)).join(has, ["stack", "_cy", "_cx"], "left").select(F.lit(0).alias("frame"), *CELL, F.coalesce("_m", F.lit(0.0)).alias("v"))
    soft = S.gaussian(mask.withColumn("b", F.col("v")), 3.0, "b").select(*CELL, F.when(F.col("v") > 0, P.clamp(2 * F.col("b") - 1)).otherwise(0.0).alias("_w")).where("_w > 0")
    grid = blocks.select("stack", F.col("frame")).distinct().select("stack", "frame", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    on = grid.withColumn("by", _block(o)[0]).withColumn("bx", _block(o)[1]).join(blocks.withColumn("_o", F.lit(1.0)), ["stack", "by", "bx", "frame"], "left")
    share = box_mean(on.select("stack", "frame", "y", "x", F.coalesce("_o", F.lit(0.0)).alias("v")), 1, "v", ("stack", "frame"), "_s").select("stack", "frame", "y", "x", F.col("_s").alias("v"))
    share = S.resize(share, rows, cols, height, width).where("v > 0")
    w = share.join(soft, CELL).select("stack", "frame", "y", "x", (F.col("v") * F.col("_w")).alias("_w"))
    s = w.join(px, ["stack", "frame", "y", "x"]).groupBy(*CELL).agg(F.sum("_w").alias("_t"), *[F.sum(F.col(c) * F.col("_w")).alias(f"_{c}") for c in "rgb"])
    rest = F.greatest(1 - F.col("_t"), F.lit(0.0))
    j = image.join(s, CELL, "left")
    return j.select(*CELL, *[F.when(F.col("_t").isNull(), F.col(c)).otherwise(F.col(c) * rest + F.col(f"_{c}")).alias(c) for c in "rgb"])
