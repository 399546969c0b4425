"""Pyramid fusion: per level the frame with the most band energy wins; coarse levels are gated by focus.

All state is a commutative maximum, minimum or mean for each (level, pixel), so every level is one aggregate over
all frames.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixel as P
from . import aggregate as A
from . import components as C
from . import lit as L
from . import stencil as S

RGB = ("r", "g", "b")


@dataclass(frozen=True)
class Options:
    coarse_levels: int = 5
    threshold: float = 0.07
    smoothed_selection: bool = True
    textured_base: bool = False
    governance_block: int = 0  # cells of a governed block; 0 is off
    lit: L.Lit | None = None  # lit regions that no frame has in focus take one frame each; none is off
    normalize_exposure: bool = True
    cell: int = 32  # pixels of an envelope cell


def levels(height: int, width: int) -> int:
    return max(3, int(math.log2(min(width, height) / 16))) if min(width, height) >= 16 else 3


def never_focus_cut(frames: Column | str) -> Column:
    """Ratio of greatest to least focus above which a pixel has been in focus: clamp(3 log2 n, 6, 32)."""
    n = F.col(frames) if isinstance(frames, str) else frames
    return F.least(F.greatest(3 * F.log2(F.greatest(n, F.lit(1)).cast("double")), F.lit(6.0)), F.lit(32.0))


def frame_counts(px: DataFrame) -> DataFrame:
    """stack, n: the frames of each stack, whatever other stacks hold."""
    return px.groupBy("stack").agg(F.countDistinct("frame").alias("n"))


def band_energy(band: DataFrame) -> DataFrame:
    return band.withColumn("e", sum((F.abs(F.col(c)) for c in RGB), F.lit(0.0)))


def select(band: DataFrame, sigma: float = 0.0) -> DataFrame:
    """Band of the frame with the most energy |r| + |g| + |b| (blurred by sigma first); starts below 0, so the first
    of equal frames wins even at energy 0. ``band``: stack, frame, y, x, r, g, b."""
    e = band_energy(band)
    if sigma > 0:
        e = S.gaussian(e, sigma, "e")
    best = F.max_by(F.struct("e", "frame", *RGB), F.struct("e", -F.col("frame")))
    return e.groupBy(*A.PIXEL).agg(best.alias("w")).select(*A.PIXEL, "w.e", "w.frame", *[F.col(f"w.{c}").alias(c) for c in RGB])


def tracks(band: DataFrame, threshold: float = 0.07) -> DataFrame:
    """Four winners of each pixel in one aggregate: A most energy among frames in focus (focus > threshold), B darkest,
    B' brightest, C most energy of all; and whether any frame was in focus.

    ``band``: stack, frame, y, x, r, g, b, lum, focus."""
    e = band_energy(band)
    live = F.col("focus") > threshold
    row = F.struct("frame", *RGB)
    out = e.groupBy(*A.PIXEL).agg(
        F.max_by(F.when(live, row), F.when(live, F.struct("e", -F.col("frame")))).alias("A"),
        F.min_by(row, F.struct("lum", "frame")).alias("B"),
        F.max_by(row, F.struct("lum", -F.col("frame"))).alias("Q"),
        F.max_by(row, F.struct("e", -F.col("frame"))).alias("C"),
        F.min("lum").alias("dark"), F.max("lum").alias("bright"), F.max(live).alias("focused"),
    )
    return out


def merge(t: DataFrame, masks: DataFrame) -> DataFrame:
    """A where a frame was in focus; else, over open background, B' if its light is closer to the clean field than B's;
    else B; then from C towards it by the mask. ``masks``: stack, y, x, mask, bg, clean."""
    j = t.join(masks, A.PIXEL)
    bright = (F.col("bg") > 0.5) & (F.abs(F.col("bright") - F.col("clean")) < F.abs(F.col("dark") - F.col("clean")))
    pick = F.when(F.col("focused"), F.col("A")).when(bright, F.col("Q")).otherwise(F.col("B"))
    j = j.withColumn("_p", pick)
    return j.select(*A.PIXEL, *[(F.col(f"C.{c}") + (F.col(f"_p.{c}") - F.col(f"C.{c}")) * F.col("mask")).alias(c) for c in RGB])


def near_black(lum_min: DataFrame, lo: float = 0.15, hi: float = 0.35) -> DataFrame:
    """1 - smoothstep(lo s, hi s, lum_min), s the 99th percentile of the stack's least luminances; ``lum_min``: stack, y, x, v."""
    s = A.order_statistic(lum_min, "v", 0.99, ["stack"]).select("stack", F.greatest("q", F.lit(1e-6)).alias("_s"))
    d = lum_min.join(s, "stack")
    t = P.clamp((F.col("v") - F.col("_s") * lo) / (F.col("_s") * (hi - lo)))
    return d.select(*A.PIXEL, (1 - t * t * (3 - 2 * t)).alias("m"))


def sharp_mask(focus: DataFrame, frames: DataFrame, alpha: float = 0.15, governance: bool = False) -> DataFrame:
    """stack, y, x, m: greatest focus above alpha times its 99th percentile (and, for governance, above the never-focus
    cut times the least). ``focus``: stack, y, x, hi, lo; ``frames``: stack, n."""
    s = A.order_statistic(focus, "hi", 0.99, ["stack"]).select("stack", (F.greatest("q", F.lit(1e-6)) * alpha).alias("_t"))
    d = focus.join(s, "stack")
    m = F.col("hi") > F.col("_t")
    if governance:
        d = d.join(frames.select("stack", F.col("n").alias("_n")), "stack")
        m = m & (F.col("hi") > F.greatest("lo", F.lit(1e-6)) * never_focus_cut("_n"))
    return d.select(*A.PIXEL, m.alias("m"))


def texture_veto(cells: DataFrame, frames: DataFrame) -> DataFrame:
    """stack, y, x, v: 0..1, where the greatest band energy of a cell exceeds the least by more than noise would, away
    from sharp cells. ``cells``: stack, y, x, env_max, env_min, sharp; ``frames``: stack, n."""
    spread = F.sqrt(2 * F.log(F.greatest("n", F.lit(2)).cast("double")))
    ring = F.explode(F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    near = cells.where("sharp").withColumn("o", ring).select("stack", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).distinct()
    el = cells.join(near, A.PIXEL, "left_anti").withColumn("_r", F.sqrt(F.col("env_max") / F.greatest("env_min", F.lit(1e-12))))
    q = A.order_statistic(el, "env_max", 0.9, ["stack"], "gap").select("stack", (F.col("q") * 0.01).alias("_f"))
    ok = (F.col("env_min") > F.col("_f")) & (F.col("env_max") > 5.5e-6)
    v = F.when(ok, P.smoothstep(1 + 0.25 * spread, 1 + 0.45 * spread, F.col("_r"))).otherwise(F.lit(0.0))
    return cells.select(*A.PIXEL).join(el.join(q, "stack").join(frames.select("stack", "n"), "stack").select(*A.PIXEL, v.alias("v")), A.PIXEL, "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


# Least pixels and clean pixels of an open component, the light ranges of clean and of wholly contaminated pixels,
# the greatest flatness, the least weight of an anchor cell.
OPEN_CELLS, OPEN_CLEAN, CLEAN_RANGE, DIRTY_RANGE, FLAT, ANCHOR = 1000, 100, 0.02, 0.04, 0.0035, 8.0
RATIO_BINS, BINS_PER_OCTAVE = 64, 4


def open_field(focus: DataFrame, lum: DataFrame, frames: DataFrame, height: int, width: int, radius: int | None = None, alpha: float = 0.15, least: int = OPEN_CELLS, clean: int = OPEN_CLEAN, clean_range: float = CLEAN_RANGE) -> tuple[DataFrame, DataFrame]:
    """(labels: stack, y, x, label; components: stack, label, cells, border, clean, bin, candidate) of what lies outside the closed sharp mask.

    A component is a candidate for open background if it holds ``least`` pixels, reaches the border, has ``clean`` pixels whose light
    moves by no more than ``clean_range`` over the frames, and the median of its pixels' ratio of greatest to least focus, in bins
    of a quarter octave, is below the never-focus cut. ``focus``, ``lum``: stack, y, x, hi, lo over the frames; ``frames``: stack, n."""
    from pyspark.sql import Window as W

    r = radius if radius is not None else max(4, int(0.0031 * min(width, height) + 0.5))
    closed = S.erode(S.dilate(sharp_mask(focus, frames, alpha), r), r)
    lab = C.cut(C.label(closed.withColumn("m", ~F.col("m")), width))
    ratio = F.col("hi") / F.greatest("lo", F.lit(1e-6))
    bins = F.least(F.floor(F.log2(F.greatest(ratio, F.lit(1.0))) * BINS_PER_OCTAVE), F.lit(RATIO_BINS - 1)).cast("int")
    edge = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == height - 1) | (F.col("x") == width - 1)
    own = lab.where("label > 0").join(focus.select(*A.PIXEL, bins.alias("bin")), A.PIXEL).join(lum.select(*A.PIXEL, (F.col("hi") - F.col("lo") <= clean_range).cast("long").alias("_c")), A.PIXEL)
    # one row for each bin of a component
    h = own.groupBy("stack", "label", "bin").agg(F.count(F.lit(1)).alias("_n"), F.sum("_c").alias("_c"), F.max(edge).alias("_e"))
    w = W.partitionBy("stack", "label")
    h = h.withColumn("_up", F.sum("_n").over(w.orderBy("bin"))).withColumn("_all", F.sum("_n").over(w))
    st = h.groupBy("stack", "label").agg(F.sum("_n").alias("cells"), F.max("_e").alias("border"), F.sum("_c").alias("clean"), F.min(F.when(F.col("_up") * 2 >= F.col("_all"), F.col("bin"))).alias("bin"))
    st = st.join(frames.select("stack", "n"), "stack")
    ok = (F.col("cells") >= least) & F.col("border") & (F.col("clean") >= clean) & (F.col("bin") / BINS_PER_OCTAVE < F.log2(never_focus_cut("n")))
    return lab, st.select("stack", "label", "cells", "border", "clean", "bin", ok.alias("candidate"))


def clean_anchors(lab: DataFrame, components: DataFrame, lum: DataFrame, height: int, width: int, factor: int = 8, ranges: tuple[float, float] = (CLEAN_RANGE, DIRTY_RANGE)) -> DataFrame:
    """stack, y, x, vw, w, label for every cell of ``factor`` pixels: the light of its candidate pixels, in the middle of its range over
    the frames, weighed down as it moves, and the component of the last of them (0: no anchor)."""
    rows, cols = -(-height // factor), -(-width // factor)
    own = lab.join(components.where("candidate").select("stack", "label"), ["stack", "label"]).join(lum, A.PIXEL)
    own = own.withColumn("w", 1 - P.smoothstep(*ranges, F.col("hi") - F.col("lo"))).where("w > 0")
    cell = own.groupBy("stack", F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x"))
    got = cell.agg(F.sum((F.col("lo") + F.col("hi")) * 0.5 * F.col("w")).alias("vw"), F.sum("w").alias("w"), F.max_by("label", F.col("y") * width + F.col("x")).alias("label"))
    grid = lab.select("stack").distinct().select("stack", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    return grid.join(got, A.PIXEL, "left").select(*A.PIXEL, F.coalesce("vw", F.lit(0.0)).alias("vw"), F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("label", F.lit(0)).alias("label"))


def flat_components(anchors: DataFrame, flat: float = FLAT, least: int = 30, weight: float = ANCHOR, radius: int = 4) -> DataFrame:
    """stack, label, anchors, sigma, flat: the deviation of a component's anchor cells from the 9 x 9 box about them (infinite with fewer than
    ``least``), and whether it is below ``flat``. ``anchors``: as :func:`clean_anchors` gives them, every cell."""
    from .window import box_mean

    a = box_mean(anchors, radius, "vw", ("stack",), "_v")
    a = box_mean(a, radius, "w", ("stack",), "_w").where((F.col("label") > 0) & (F.col("w") >= weight))
    a = a.withColumn("_d", F.col("vw") / F.col("w") - F.col("_v") / F.col("_w"))
    st = a.groupBy("stack", "label").agg(F.count(F.lit(1)).alias("anchors"), F.when(F.count(F.lit(1)) >= least, F.stddev_pop("_d")).otherwise(F.lit(float("inf"))).alias("sigma"))
    return st.withColumn("flat", F.col("sigma") < flat)


def open_background(focus: DataFrame, lum: DataFrame, frames: DataFrame, height: int, width: int, factor: int = 8, flat: float = FLAT, anchors: int = 30, weight: float = ANCHOR, ranges: tuple[float, float] = (CLEAN_RANGE, DIRTY_RANGE), **gates) -> tuple[DataFrame, DataFrame]:
    """(stack, y, x, m: open background; stack, y, x, v: the clean field's light by cell): the flat candidates of :func:`open_field`, and
    their anchors alone filled over the rest of the grid."""
    lab, st = open_field(focus, lum, frames, height, width, clean_range=ranges[0], **gates)
    a = C.cut(clean_anchors(lab, C.cut(st), lum, height, width, factor, ranges))
    keep = C.cut(flat_components(a, flat, anchors, weight).where("flat").select("stack", "label", F.lit(True).alias("_k")))
    bg = lab.join(keep, ["stack", "label"], "left").select(*A.PIXEL, F.coalesce("_k", F.lit(False)).alias("m"))
    own = a.join(keep, ["stack", "label"], "left").withColumn("_k", F.coalesce("_k", F.lit(False)))
    field = own.select(*A.PIXEL, F.when(F.col("_k"), F.col("vw")).otherwise(0.0).alias("vw"), F.when(F.col("_k"), F.col("w")).otherwise(0.0).alias("w"))
    return bg, C.push_pull(field, -(-height // factor), -(-width // factor))


def envelope_clamp(out: DataFrame, bands: DataFrame, cell: int, factor: float = 1.0) -> DataFrame:
    """A fused band never holds more energy in a cell than ``factor`` times the most that any frame holds there.

    ``out``: stack, y, x, r, g, b; ``bands``: the frames' bands."""
    pool = lambda d, key: d.groupBy(*key, F.floor(F.col("y") / cell).cast("int").alias("cy"), F.floor(F.col("x") / cell).cast("int").alias("cx")).agg(F.avg(sum((F.col(c) ** 2 for c in RGB), F.lit(0.0))).alias("e"))
    top = pool(bands, ["stack", "frame"]).groupBy("stack", "cy", "cx").agg(F.max("e").alias("_top"))
    own = pool(out, ["stack"]).withColumnRenamed("e", "_own")
    j = out.withColumn("cy", F.floor(F.col("y") / cell).cast("int")).withColumn("cx", F.floor(F.col("x") / cell).cast("int")).join(top.join(own, ["stack", "cy", "cx"]), ["stack", "cy", "cx"])
    k = F.when(F.col("_own") > F.col("_top") * factor, F.sqrt(F.col("_top") * factor / F.greatest("_own", F.lit(1e-12)))).otherwise(F.lit(1.0))
    return j.select(*A.PIXEL, *[(F.col(c) * k).alias(c) for c in RGB])


def debloom_masks(lum_min: DataFrame, veto: DataFrame | None, bg: DataFrame | None, levels_: range) -> tuple[dict[int, DataFrame], dict[int, DataFrame]]:
    """By level: mask (near black, less what the texture veto says is alive, or open background) and bg (open background
    that near black doesn't claim), each the greatest over the pixels of a coarse one: stack, y, x, m and stack, y, x, bg.

    ``veto``: stack, y, x, v by pixel; ``bg``: stack, y, x, m by pixel."""
    m = near_black(lum_min)
    if veto is not None:
        m = m.join(veto, A.PIXEL, "left").select(*A.PIXEL, (F.col("m") * (1 - F.coalesce("v", F.lit(0.0)))).alias("m"))
    open_ = F.lit(False)
    if bg is not None:
        m = m.join(bg.select(*A.PIXEL, F.col("m").alias("_o")), A.PIXEL, "left")
        open_ = F.coalesce("_o", F.lit(False))
    m = C.cut(m.select(*A.PIXEL, F.when(open_, F.lit(1.0)).otherwise(F.col("m")).alias("m"), F.when(open_ & (F.col("m") < 0.5), 1.0).otherwise(0.0).alias("bg")))
    pool = lambda lv, c: A.box_down(m, 1 << lv, c, "max", ("stack",))
    return {lv: pool(lv, "m") for lv in levels_}, {lv: pool(lv, "bg") for lv in levels_}


def clamped_image(image: DataFrame, bands: DataFrame, height: int, width: int, cell: int) -> DataFrame:
    """The fused image with the finest band of it held within the frames' envelope, cell by cell.

    ``bands``: the frames' finest bands."""
    out = None
    fine: DataFrame | None = None
    for c in RGB:
        band = S.pyramid(image.select("stack", F.lit(0).alias("frame"), "y", "x", F.col(c).alias("v")), height, width, 1)[0][0].drop("frame").withColumnRenamed("v", c)
        fine = band if fine is None else fine.join(band, A.PIXEL)
    fine = C.cut(fine)
    held = envelope_clamp(fine, bands, cell).select(*A.PIXEL, *[F.col(c).alias(f"_h{c}") for c in RGB])
    out = image.join(fine.select(*A.PIXEL, *[F.col(c).alias(f"_f{c}") for c in RGB]), A.PIXEL).join(held, A.PIXEL)
    return out.select(*A.PIXEL, *[(F.col(c) + F.col(f"_h{c}") - F.col(f"_f{c}")).alias(c) for c in RGB])


def govern(win: DataFrame, mask: DataFrame, block: int = 8, hysteresis: float = 0.85, k: int = 8) -> DataFrame:
    """Background pixels follow one frame for each block of cells: the dominant frame (of the stack's top ``k``) with the
    most energy there, unless the pixel's own frame holds at least ``hysteresis`` of that; ties to the smaller frame.

    ``win``: stack, y, x, frame, energy; ``mask``: stack, y, x, m."""
    from pyspark.sql import Window as W

    from .window import top_frames

    j = win.join(mask, A.PIXEL)
    top = top_frames(j.where("m"), "energy", k).select("stack", "frame")
    b = j.where("m").join(top, ["stack", "frame"]).groupBy("stack", "frame", F.floor(F.col("y") / block).cast("int").alias("by"), F.floor(F.col("x") / block).cast("int").alias("bx")).agg(F.round(F.sum("energy"), 9).alias("mass"))
    w = W.partitionBy("stack", "by", "bx")
    best = b.withColumn("_r", F.row_number().over(w.orderBy(F.desc("mass"), "frame"))).where("_r = 1").select("stack", "by", "bx", F.col("frame").alias("_bf"), F.col("mass").alias("_bm"))
    j = j.withColumn("by", F.floor(F.col("y") / block).cast("int")).withColumn("bx", F.floor(F.col("x") / block).cast("int"))
    j = j.join(best, ["stack", "by", "bx"], "left").join(b.select("stack", "by", "bx", "frame", F.col("mass").alias("_om")), ["stack", "by", "bx", "frame"], "left")
    stay = ~F.col("m") | F.col("_bf").isNull() | (F.coalesce("_om", F.lit(0.0)) >= F.col("_bm") * hysteresis)
    return j.select(*A.PIXEL, F.when(stay, F.col("frame")).otherwise(F.col("_bf")).alias("frame"))


def texture_winner(px: DataFrame, key: tuple[str, ...] = ("stack", "frame"), value: str = "v") -> DataFrame:
    """The frame with the greatest 5 x 5 luminance variance (clipped box)."""
    from .window import box_mean

    d = box_mean(px, 2, value, key, "_m")
    d = box_mean(d.withColumn("_q", F.col(value) * F.col(value)), 2, "_q", key, "_s")
    return A.winner(d.withColumn("e", F.greatest(F.col("_s") - F.col("_m") * F.col("_m"), F.lit(0.0))), "e")


def fuse(px: DataFrame, height: int, width: int, o: Options | None = None, n_levels: int | None = None) -> DataFrame:
    """The fused image of every stack (stack, y, x, r, g, b); ``px``: stack, frame, y, x, r, g, b, a aligned frames.

    Finest level: energy blurred by sigma 1; other levels: as they are, smoothed if so set. With ``coarse_levels`` the
    coarsest levels keep four tracks, merged by the near-black and open-background masks, and the base is the
    darkest frame's; without, the base is the mean of the frames (or the most textured frame's, if so set). Smoothed selection brings
    the texture veto and the clamp to the frames' envelope with it; governance replaces background by single frames, and its lit
    tier blends lit regions that no frame has in focus towards one of the first frames.
    """
    o = o or Options()
    if o.normalize_exposure:
        px = C.cut(A.normalized(px, width))
    n = min(n_levels or levels(height, width), max(1, int(math.log2(max(2, min(height, width))))))
    per = {c: S.pyramid(px.withColumnRenamed(c, "v"), height, width, n) for c in RGB}
    key = ["stack", "frame", "y", "x"]
    gray = [px.select(*key, P.luminance(F.col("r"), F.col("g"), F.col("b")).alias("v"))]  # luminance by level
    for _ in range(n if o.coarse_levels or o.textured_base else 0):
        gray.append(C.cut(S.decimate(gray[-1])))

    def band(lv: int) -> DataFrame:
        out = per["r"][lv][0].withColumnRenamed("v", "r")
        for c in ("g", "b"):
            out = out.join(per[c][lv][0].withColumnRenamed("v", c), key)
        return out

    finest = band(0)
    gated = range(max(1, n - o.coarse_levels), n) if o.coarse_levels else range(0)
    masks: dict = {}
    bgs: dict = {}
    energy = bg = clean = None
    if o.coarse_levels or o.governance_block or o.lit:
        finest = C.cut(finest)
        energy = C.cut(S.gaussian(band_energy(finest), 1.0, "e").select(*key, "e"))
        lum = gray[0]
        frames = C.cut(frame_counts(px))
        fx = C.cut(A.extremes(energy, "e").select(*A.PIXEL, "hi", "lo"))
        lx = C.cut(A.extremes(lum, "v").select(*A.PIXEL, "hi", "lo"))
    if o.coarse_levels or o.governance_block:
        lum_min = lx.select(*A.PIXEL, F.col("lo").alias("v"))
        veto = None
        if o.smoothed_selection:
            e2 = finest.select(*key, sum((F.col(c) ** 2 for c in RGB), F.lit(0.0)).alias("v"))
            sharp = A.box_down(sharp_mask(fx, frames).select(*A.PIXEL, F.col("m").cast("double").alias("v")), o.cell, "v", "max", ("stack",)).select(*A.PIXEL, (F.col("v") > 0).alias("sharp"))
            cells = A.box_down(e2, o.cell, "v").groupBy(*A.PIXEL).agg(F.max("v").alias("env_max"), F.min("v").alias("env_min")).join(sharp, A.PIXEL)
            v = texture_veto(C.cut(cells), frames)
            at = px.select(*A.PIXEL).distinct().withColumn("_cy", F.floor(F.col("y") / o.cell).cast("int")).withColumn("_cx", F.floor(F.col("x") / o.cell).cast("int"))
            veto = at.join(v.select("stack", F.col("y").alias("_cy"), F.col("x").alias("_cx"), "v"), ["stack", "_cy", "_cx"]).select(*A.PIXEL, "v")
        bg, clean = (C.cut(t) for t in open_background(fx, lx, frames, height, width))
        masks, bgs = debloom_masks(lum_min, veto, bg, gated)
    fused: dict[str, list] = {c: [] for c in RGB}
    for lv in range(n + 1):
        _, h, w = per["r"][lv]
        if lv == n:
            base = band(lv)
            if o.textured_base:
                best = texture_winner(gray[lv]).select(*A.PIXEL, "frame")
                out = base.join(best, key)
            elif o.coarse_levels:
                out = base.groupBy(*A.PIXEL).agg(F.min_by(F.struct(*RGB), F.struct(P.luminance(F.col("r"), F.col("g"), F.col("b")), F.col("frame"))).alias("_w")).select(*A.PIXEL, *[F.col(f"_w.{c}").alias(c) for c in RGB])
            else:
                out = base.groupBy(*A.PIXEL).agg(*[F.avg(c).alias(c) for c in RGB])
        elif lv in gated:
            low = gray[lv].select(*key, F.col("v").alias("lum"))
            focus = A.box_down(energy, 1 << lv, "e").select(*key, F.col("e").alias("focus"))
            t = tracks(band(lv).join(low, key).join(focus, key), o.threshold)
            where = masks[lv].join(bgs[lv], A.PIXEL).withColumnRenamed("m", "mask")
            gh, gw = -(-height // 8), -(-width // 8)
            grid = S.resize(clean.withColumn("frame", F.lit(0)), gh, gw, h, w).drop("frame").withColumnRenamed("v", "clean")
            out = merge(t, where.join(grid, A.PIXEL))
        else:
            out = select(finest if lv == 0 else band(lv), 1.0 if lv == 0 or o.smoothed_selection else 0.0)
        for c in RGB:
            fused[c].append((out.select(*A.PIXEL, F.col(c).alias("v")), h, w))
    image = None
    for c in RGB:
        plane = S.collapse(fused[c], "v", ("stack",)).withColumnRenamed("v", c)
        image = plane if image is None else image.join(plane, A.PIXEL)
    if o.coarse_levels and o.smoothed_selection:
        image = clamped_image(C.cut(image), finest, height, width, o.cell)
    if o.governance_block:
        win = A.winner(energy, "e")
        frame = govern(win, bg, o.governance_block * 8).withColumnRenamed("frame", "_f")
        own = px.join(frame.join(bg, A.PIXEL).where("m"), A.PIXEL).where("frame = _f").select(*A.PIXEL, *[F.col(c).alias(f"_g{c}") for c in RGB])
        image = image.join(own, A.PIXEL, "left").select(*A.PIXEL, *[F.coalesce(f"_g{c}", c).alias(c) for c in RGB])
    if o.lit:
        rows, cols = -(-height // 8), -(-width // 8)
        lit, blocks = L.lit_cells(L.cells(A.dense_frames(energy)[0], lx), L.knee(lx), frames, rows, cols, o.lit)
        image = L.composite(C.cut(image), A.dense_frames(px)[0], lit, blocks, height, width, 8, o.lit)
    return image
