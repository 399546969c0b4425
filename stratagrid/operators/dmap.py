"""Depth from focus: winner, confidence, regularised depth, render.

Every stage is a DataFrame of (stack, y, x, ...); the stack is a key everywhere, so all stacks run in one job.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixel as P
from . import aggregate as A
from . import components as C
from . import join as J
from . import stencil as S
from .window import box_mean


@dataclass(frozen=True)
class Options:
    sharpness_sigma: float = 10.0
    focus_pre_sigma: float = 1.0
    blend_radius: float = 1.0
    noise_floor: float = 0.05
    median_radius: int = 20
    peak_concentration: float = 0.5
    guided_radius: float = 128.0
    guided_eps: float = 1e-3
    normalize_exposure: bool = True
    downsample: int = 8

    def resolved(self, width: int, height: int) -> Options:
        """Radii scaled to the raster's diagonal over 9780, never up; 0 stays off and a live radius stays at least 1."""
        s = min(1.0, (width * width + height * height) ** 0.5 / 9780)
        if s >= 1:
            return self
        med = max(1, int(self.median_radius * s + 0.5)) if self.median_radius > 0 else self.median_radius
        return replace(self, median_radius=med, guided_radius=max(1.0, self.guided_radius * s))


# Weights and cuts of the grid fit.
PRIOR_FLOOR, TIER2, SPILL, LAMBDA, DARK = 1e-4, 0.1, 0.05, 1e-6, 0.05
REGION_CONF, REGION_TIER2, REGION_CELLS, Z_LO, Z_HI = 0.02, 0.005, 32, 1.5, 4.0


def focus_energy(px: DataFrame, value: str = "v", pre_sigma: float = 0.0, sigma: float = 0.0, height: int = 8, width: int = 8) -> DataFrame:
    """stack, frame, y, x, v, e."""
    d = S.gaussian(px, pre_sigma, value) if pre_sigma > 0.01 else px
    d = S.laplacian_energy(d, value)
    return S.energy_grid(d, height, width, sigma, "e") if sigma > 0.01 else d


def confidence(best: DataFrame, conc: DataFrame | None, o: Options, factor: int, rows: int, cols: int) -> DataFrame:
    """stack, y, x, c: soft threshold of the winning energy over half the floor, times the concentration gate.

    ``best``: stack, y, x, energy. The floor is noise_floor times the 95th percentile (sorted[min(int(n p), n - 1)])."""
    p95 = A.order_statistic(best, "energy", 0.95, ["stack"])
    half = F.greatest(F.lit(1e-6), F.col("q") * o.noise_floor) / 2
    d = best.join(p95, "stack").withColumn("_h", half)
    es = F.greatest(F.col("energy") - F.col("_h"), F.lit(0.0))
    d = d.withColumn("c", es * es / (es * es + F.col("_h") * F.col("_h"))).drop("q", "_h")
    if conc is None or o.peak_concentration <= 0:
        return d
    k2 = o.peak_concentration**2
    d = J.from_grid(d, conc, factor, rows, cols, "concentration", out="_k")
    return d.withColumn("c", F.col("c") * F.col("_k") * F.col("_k") / (F.col("_k") * F.col("_k") + k2)).drop("_k")


def measured(px: DataFrame, factor: int) -> DataFrame:
    """Tier 1: cell means of confidence and confidence times depth; ``px``: stack, y, x, c, d."""
    g = px.groupBy("stack", F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x"))
    return g.agg(F.avg("c").alias("cg"), F.avg(F.col("c") * F.col("d")).alias("cdg"))


def lit_extremes(lum: DataFrame) -> DataFrame:
    """Per cell of a luminance cube (stack, frame, y, x, v): lmax, span, ds (first darkest frame), and by the stack's
    95th percentile of lmax the squared cuts dark2 and eps2."""
    e = A.extremes(lum).select("stack", "y", "x", F.col("hi").alias("lmax"), "span", F.col("darkest").alias("ds"))
    ref = A.order_statistic(e, "lmax", 0.95, ["stack"]).select("stack", F.greatest("q", F.lit(1e-6)).alias("_r"))
    e = e.join(ref, "stack")
    return e.withColumn("dark2", (F.col("_r") * DARK) ** 2).withColumn("eps2", (F.col("_r") * 0.002) ** 2).drop("_r")


def neighbour_curves(cube: DataFrame, cells: DataFrame, o: Options) -> DataFrame:
    """Tier 2: the 5 x 5 neighbourhood's energy by frame, each cell weighed 1 - confidence; c2, d2 where it is concentrated.

    ``cube``: stack, frame, y, x, v; ``cells``: stack, y, x, cg."""
    ring = F.explode(F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in range(-2, 3) for j in range(-2, 3)]))
    m = cube.join(cells.select("stack", "y", "x", (1 - F.col("cg")).alias("_m")), A.PIXEL).where("_m > 0").select("stack", "frame", "y", "x", (F.col("v") * F.col("_m")).alias("v"), ring.alias("o"))
    m = m.groupBy("stack", "frame", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).agg(F.sum("v").alias("v"))
    m = m.join(cells.select(*A.PIXEL), A.PIXEL)
    s = A.scored_curves(m, o.peak_concentration)
    t = cells.select(*A.PIXEL).join(s, A.PIXEL, "left")
    return t.select(*A.PIXEL, F.coalesce(F.col("depth").cast("double"), F.lit(0.0)).alias("d2"), F.coalesce(F.col("concentration") * TIER2, F.lit(0.0)).alias("c2"))


def regional(cube: DataFrame, cells: DataFrame, width: int, least: int = REGION_CELLS) -> DataFrame:
    """Tier R: components of lit cells without evidence commit to the peak of their summed curve, as far as it stands
    out of the 90th percentile. ``cells``: stack, y, x, cg, c2, d2, lmax, span, dark2. Returns cells with c2, d2 replaced."""
    lo = F.greatest(F.col("lmax") - F.col("span"), F.lit(0.0))
    c = cells.withColumn("lit", lo * lo / (lo * lo + F.col("dark2")))
    mask = c.withColumn("m", (F.col("cg") < REGION_CONF) & (F.col("c2") < REGION_TIER2) & (F.col("lit") > 0.5))
    lab = C.label(mask.select(*A.PIXEL, "m"), width)
    size = lab.where("label > 0").groupBy("stack", "label").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    z = A.mass_curves(cube, lab).join(size, ["stack", "label"]).where((F.col("p90") > F.col("med")) & (F.col("mx") > F.col("med")))
    z = z.select("stack", "label", F.col("peak").alias("_d"), P.clamp((F.col("z") - Z_LO) / (Z_HI - Z_LO)).alias("_s")).where("_s > 0")
    j = c.join(lab, A.PIXEL).join(z, ["stack", "label"], "left")
    return j.withColumn("d2", F.when(F.col("_s").isNotNull(), F.col("_d").cast("double")).otherwise(F.col("d2"))).withColumn("c2", F.when(F.col("_s").isNotNull(), F.col("_s") * TIER2 * F.col("lit")).otherwise(F.col("c2"))).drop("label", "_d", "_s", "lit")


def spill(cells: DataFrame) -> DataFrame:
    """Tier S: cells that swing in light, are dark at their darkest and lack confidence point to their darkest frame: ss, ws."""
    lo = F.greatest(F.col("lmax") - F.col("span"), F.lit(0.0))
    sig = F.col("span") * F.col("span") / (F.col("span") * F.col("span") + F.col("eps2"))
    dark = F.col("dark2") / (F.col("dark2") + lo * lo)
    s = F.col("span") / (F.col("lmax") + 1e-6) * sig * dark * F.greatest(1 - F.least("cg", F.lit(1.0)), F.lit(0.0))
    return cells.withColumn("ss", s).withColumn("ws", s * SPILL)


def combined(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """Tier 3: push-pull prior under all evidence; w and value v of each cell."""
    keep = 1 - F.col("ss")
    c = cells.withColumn("vw", F.col("cdg") * keep + F.col("c2") * F.col("d2") + F.col("ws") * F.col("ds")).withColumn("wt", F.col("cg") * keep + F.col("c2") + F.col("ws"))
    prior = C.push_pull(c.select("stack", "y", "x", "vw", F.col("wt").alias("w")), rows, cols).withColumnRenamed("v", "_p")
    c = c.join(prior, A.PIXEL).withColumn("w", F.col("wt") + PRIOR_FLOOR)
    return c.withColumn("v", (F.col("vw") + PRIOR_FLOOR * F.col("_p")) / F.col("w")).drop("_p")


def guided(cells: DataFrame, o: Options, factor: int) -> DataFrame:
    """Weighted guided filter of v by guide g with adaptive regularisation; box-mean coefficients a, b. ``cells``: stack, y, x, w, v, g."""
    r = max(1, int(o.guided_radius / factor + 0.5))
    c = cells
    for n, e in (("_w", F.col("w")), ("_g", F.col("w") * F.col("g")), ("_v", F.col("w") * F.col("v")), ("_gg", F.col("w") * F.col("g") * F.col("g")), ("_gv", F.col("w") * F.col("g") * F.col("v"))):
        c = box_mean(c.withColumn("_t", e), r, "_t", ("stack",), n).drop("_t")
    mg, mv = F.col("_g") / F.col("_w"), F.col("_v") / F.col("_w")
    c = c.withColumn("_mg", mg).withColumn("_mv", mv).withColumn("_var", F.greatest(F.col("_gg") / F.col("_w") - mg * mg, F.lit(0.0))).withColumn("_cov", F.col("_gv") / F.col("_w") - mg * mv)
    inv = c.groupBy("stack").agg(F.avg(1 / (F.col("_var") + LAMBDA)).alias("_inv"))
    c = c.join(inv, "stack")
    c = c.withColumn("a", F.col("_cov") / (F.col("_var") + o.guided_eps / ((F.col("_var") + LAMBDA) * F.col("_inv")))).withColumn("b", F.col("_mv") - F.col("a") * F.col("_mg"))
    for n in ("a", "b"):
        c = box_mean(c, r, n, ("stack",), f"_{n}bar").withColumn(n, F.col(f"_{n}bar")).drop(f"_{n}bar")
    return c.drop("_w", "_g", "_v", "_gg", "_gv", "_mg", "_mv", "_var", "_cov", "_inv")


def guide_scale(grid: DataFrame) -> DataFrame:
    """stack, gs: one over the 95th percentile of the cell means of the guide (stack, y, x, g0)."""
    return A.order_statistic(grid, "g0", 0.95, ["stack"]).select("stack", (1 / F.greatest("q", F.lit(1e-6))).alias("gs"))


def blend(px: DataFrame, coeff: DataFrame, scale: DataFrame, frames: DataFrame, factor: int, rows: int, cols: int) -> DataFrame:
    """Full-resolution depth. ``px``: stack, y, x, g (guide), c, d, consensus; ``coeff``: a, b, ss, ds by cell; ``frames``: stack, n."""
    d = px
    for n in ("a", "b", "ss", "ds"):
        d = J.from_grid(d, coeff.withColumn("_val", F.col(n).cast("double")), factor, rows, cols, "_val", out=f"_{n}")
    d = d.join(scale, "stack").join(frames.select("stack", "n"), "stack")
    cf = F.greatest("c", F.col("consensus") * F.col("consensus")) * (1 - F.col("_ss"))
    d = d.withColumn("_cf", cf).withColumn("_reg", F.col("_a") * F.col("gs") * F.col("g") + F.col("_b"))
    d = d.withColumn("_reg", F.col("_reg") + F.col("_ss") * (1 - F.col("_cf")) * (F.col("_ds") - F.col("_reg")))
    gap = (F.col("_reg") - F.col("d")) ** 2
    t = gap / (gap + P.dof_window(F.col("n")) ** 2)
    s = P.clamp((F.col("_cf") - 0.35) / 0.35)
    cb = F.col("_cf") + (1 - F.col("_cf")) * t * s * s * (3 - 2 * s)
    out = cb * F.col("d") + (1 - cb) * F.col("_reg")
    return d.select("stack", "y", "x", F.least(F.greatest(out, F.lit(0.0)), (F.col("n") - 1).cast("double")).alias("d"))


def fuse(px: DataFrame, height: int, width: int, o: Options | None = None, regularize: bool = True) -> tuple[DataFrame, DataFrame]:
    """(image, depth) of every stack; ``px``: stack, frame, y, x, r, g, b, a aligned frames. Focus is measured on
    luminance levelled to the first frame, and what is rendered is levelled to the geometric mean, unless the option is off.

    Frames that were excluded may leave gaps or no frame 0: the others are numbered from 0 by themselves, and depth is a
    place among them (:func:`aggregate.kept_depth` turns it into their own numbers)."""
    o = (o or Options()).resolved(width, height)
    px = A.dense_frames(px)[0]
    f = o.downsample
    lum = px.withColumn("v", P.luminance(F.col("r"), F.col("g"), F.col("b")))
    if o.normalize_exposure:
        gains = A.exposure_gain(A.channel_means(px, 7, width)).select("stack", "frame", "gain")
        lum = lum.join(gains, ["stack", "frame"], "left").withColumn("v", F.col("v") * F.coalesce("gain", F.lit(1.0))).drop("gain")
        px = C.cut(A.normalized(px, width))
    e = focus_energy(lum, "v", o.focus_pre_sigma, o.sharpness_sigma, height, width)
    if o.sharpness_sigma >= 4:  # the quarter grid gives back energies only
        e = e.select("stack", "frame", "y", "x", "e").join(lum.select("stack", "frame", "y", "x", "v", "a"), ["stack", "frame", "y", "x"])
    win = A.winner(e, F.col("e") * F.col("a"), {"g": "v"})
    frames = px.groupBy("stack").agg(F.countDistinct("frame").alias("n"))
    win = C.cut(win)  # one pass over the frames; the stages below reread its pixels several times
    depth = win.select("stack", "y", "x", F.col("frame").cast("double").alias("d"))
    if regularize:
        depth = regularized(win, A.box_down(e, f, "e").withColumnRenamed("e", "v"), A.box_down(lum, f, "v"), frames, height, width, o)
    return A.tent_render(px, depth, o.blend_radius), depth


def regularized(win: DataFrame, cube: DataFrame, lcube: DataFrame, frames: DataFrame, height: int, width: int, o: Options) -> DataFrame:
    """stack, y, x, d: confidence, weighted median, the grid fit and the blend with it; ``o`` with its radii resolved.

    ``win``: stack, y, x, energy, frame, g of the winners; ``cube``, ``lcube``: stack, frame, y, x, v, cell means of energy and
    of luminance; ``frames``: stack, n."""
    f = o.downsample
    rows, cols = -(-height // f), -(-width // f)
    cube, lcube = C.cut(cube), C.cut(lcube)
    conc = C.cut(A.curve_stats(cube))
    c = confidence(win.select("stack", "y", "x", "energy", "g", F.col("frame").cast("double").alias("d")), conc, o, f, rows, cols)
    if o.median_radius > 0:
        m = A.weighted_median(c, frames, o.median_radius, height, width)
        c = c.drop("d").join(m, A.PIXEL)
    else:
        c = c.withColumn("consensus", F.lit(0.0))
    c = C.cut(c)
    g0 = c.groupBy("stack", F.floor(F.col("y") / f).cast("int").alias("y"), F.floor(F.col("x") / f).cast("int").alias("x")).agg(F.avg("g").alias("g0"))
    gs = guide_scale(g0)
    cells = measured(c, f)
    cells = C.cut(cells.join(neighbour_curves(cube, cells, o), A.PIXEL).join(lit_extremes(lcube), A.PIXEL))
    cells = C.cut(spill(regional(cube, cells, cols)))
    cells = combined(cells, rows, cols).join(g0, A.PIXEL).join(gs, "stack").withColumn("g", F.col("g0") * F.col("gs"))
    return C.cut(blend(c, C.cut(guided(C.cut(cells), o, f)), gs, frames, f, rows, cols))


def depth_image(depth: DataFrame, frames: DataFrame) -> DataFrame:
    """stack, y, x, v: near is white."""
    return depth.join(frames.select("stack", "n"), "stack").select("stack", "y", "x", P.depth_visual(F.col("d"), F.col("n")).alias("v"))


def pruned(px: DataFrame, depth: DataFrame, radius: float) -> DataFrame:
    """Frames that some pixel can use: least depth - radius < frame < greatest depth + radius."""
    span = depth.groupBy("stack").agg((F.min("d") - radius).alias("_lo"), (F.max("d") + radius).alias("_hi"))
    return px.join(span, "stack").where((F.col("frame") > F.col("_lo")) & (F.col("frame") < F.col("_hi"))).drop("_lo", "_hi")


def noise_preview(cube: DataFrame, lcube: DataFrame, guide: DataFrame, o: Options, rows: int, cols: int, fit: bool = True) -> tuple[DataFrame, DataFrame]:
    """(stack, y, x, energy, frame, c of the grid's winners; stack, y, x, d: the depth that a noise floor gives), on the grid alone.

    What a finished fuse keeps is enough: ``cube`` and ``lcube`` (stack, frame, y, x, v: cell means of energy and light) and ``guide``
    (stack, y, x, g: cell means of the result's luminance). The fit runs on a grid half as fine, as it does below the full raster."""
    small = replace(o, downsample=2, median_radius=max(1, round(o.median_radius / 8)) if o.median_radius > 0 else 0, guided_radius=max(1.0, o.guided_radius / 8))
    win = C.cut(A.winner(cube, "v").join(guide.select(*A.PIXEL, "g"), A.PIXEL))
    sure = confidence(win, None, small, 2, -(-rows // 2), -(-cols // 2)).select(*A.PIXEL, "energy", "frame", "c")
    if not fit:
        return sure, win.select(*A.PIXEL, F.col("frame").cast("double").alias("d"))
    frames = cube.groupBy("stack").agg(F.countDistinct("frame").alias("n"))
    return sure, regularized(win, A.box_down(cube, 2), A.box_down(lcube, 2), frames, rows, cols, small)
