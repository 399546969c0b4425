"""Reductions over frames, cells and labels.

Planes are long-form tables (stack, frame, y, x, v). Reductions to a pixel are plain group-bys, so their
partial aggregation runs where the rows are read and one row for each pixel and task is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixel as P

PIXEL = ["stack", "y", "x"]


def winner(df: DataFrame, energy: Column | str, payload: dict[str, Column | str] | None = None, key: list[str] | None = None) -> DataFrame:
    """Sharpest frame of each pixel: key, energy, frame and payload columns of the winning row.

    Starts from energy 0 at frame 0: the first of equal frames wins, NaN never does, and a pixel where
    nothing is above 0 reports frame 0 with the payload of frame 0.
    """
    key = key or PIXEL
    e = F.col(energy) if isinstance(energy, str) else energy
    e = F.when(F.isnan(e) | e.isNull(), F.lit(0.0)).otherwise(F.greatest(e.cast("double"), F.lit(0.0)))
    rows = df.select(*key, "frame", e.alias("_e"), *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in (payload or {}).items()])
    # one comparable value: energy first, then the smaller frame (frame 0 among zeros)
    best = F.max_by(F.struct("_e", "frame", *(payload or {})), F.struct("_e", -F.col("frame")))
    return rows.groupBy(*key).agg(best.alias("_w")).select(*key, F.col("_w._e").alias("energy"), F.when(F.col("_w._e") > 0, F.col("_w.frame")).otherwise(F.lit(0)).alias("frame"), *[F.col(f"_w.{n}").alias(n) for n in payload or {}])


def winner_two_step(df: DataFrame, energy: str, key: list[str] | None = None) -> DataFrame:
    """The same winner by two hash aggregates (maximum, join back, least frame): the form for very many rows."""
    key = key or PIXEL
    top = df.where(~F.isnan(energy)).groupBy(*key).agg(F.greatest(F.max(energy), F.lit(0.0)).alias("energy"))
    at = df.join(top, key).where((F.col(energy) == F.col("energy")) & (F.col("energy") > 0)).groupBy(*key).agg(F.min("frame").alias("_f"))
    return top.join(at, key, "left").select(*key, "energy", F.coalesce("_f", F.lit(0)).alias("frame"))


def tent_render(px: DataFrame, depth: DataFrame, radius: float, channels: tuple[str, ...] = ("r", "g", "b"), floor: float = 1e-6) -> DataFrame:
    """Average of the frames about each pixel's depth, weight (max(1 - |frame - depth| / radius, 0) + floor) * a.

    Frames that no pixel of the stack can use are pruned first; an uncovered pixel is opaque black.
    """
    r = max(radius, 0.75)
    span = depth.groupBy("stack").agg((F.min("d") - r).alias("_lo"), (F.max("d") + r).alias("_hi"))
    j = px.join(span, "stack").where((F.col("frame") > F.col("_lo")) & (F.col("frame") < F.col("_hi"))).join(depth.select(*PIXEL, "d"), PIXEL)
    w = (F.greatest(1 - F.abs(F.col("frame") - F.col("d")) / r, F.lit(0.0)) + floor) * F.col("a")
    sums = j.withColumn("_w", w).groupBy(*PIXEL).agg(F.sum("_w").alias("_w"), *[F.sum(F.col("_w") * F.col(c)).alias(c) for c in channels])
    lit = F.col("_w") > 1e-7
    return sums.select(*PIXEL, *[F.when(lit, F.col(c) / F.when(lit, F.col("_w"))).otherwise(F.lit(0.0)).alias(c) for c in channels])


def channel_means(px: DataFrame, stride: int = 7, width: int = 8) -> DataFrame:
    """Alpha-weighted channel means of each frame over every ``stride``-th pixel."""
    s = px.where((F.col("y") * width + F.col("x")) % stride == 0)
    w = F.sum("a")
    return s.groupBy("stack", "frame").agg(*[F.when(w > 0, F.sum(F.col(c) * F.col("a")) / F.when(w > 0, w)).otherwise(F.lit(0.0)).alias(c) for c in "rgb"])


def exposure_gain(means: DataFrame) -> DataFrame:
    """Gain of each frame against its stack's first frame, by channel and by luminance of the means, within 0.5..2."""
    first = means.groupBy("stack").agg(*[F.min_by(c, "frame").alias(f"{c}0") for c in "rgb"])
    g = lambda ref, own: F.when(own > 1e-6, P.clamp(ref / F.when(own > 1e-6, own), 0.5, 2.0)).otherwise(F.lit(1.0))
    luma = lambda s: P.luminance(F.col(f"r{s}"), F.col(f"g{s}"), F.col(f"b{s}"))
    return means.join(first, "stack").select("stack", "frame", *[g(F.col(f"{c}0"), F.col(c)).alias(f"gain_{c}") for c in "rgb"], g(luma("0"), luma("")).alias("gain"))


def render_gains(gains: DataFrame, least: float = 0.001) -> DataFrame:
    """Gains over their geometric mean, for each channel; 1 for all where a stack's gains spread less than ``least``."""
    cs = [c for c in gains.columns if c.startswith("gain_")]
    g = gains.groupBy("stack").agg(*[F.exp(F.avg(F.log(F.greatest(c, F.lit(1e-6))))).alias(f"_m{c}") for c in cs], F.greatest(*[F.max(c) - F.min(c) for c in cs]).alias("_s"))
    return gains.join(g, "stack").select("stack", "frame", *[F.when(F.col("_s") < least, F.lit(1.0)).otherwise(F.col(c) / F.col(f"_m{c}")).alias(c) for c in cs])


def normalized(px: DataFrame, width: int) -> DataFrame:
    """Frames with the exposure chain's gains multiplied in: each against its stack's first, re-anchored to the geometric
    mean; a frame without a sampled pixel stays as it is. ``px``: stack, frame, y, x, r, g, b, a."""
    gains = render_gains(exposure_gain(channel_means(px, 7, width)).drop("gain"))
    j = px.join(gains, ["stack", "frame"], "left")
    return j.select(*[(F.col(c) * F.coalesce(f"gain_{c}", F.lit(1.0))).alias(c) if c in ("r", "g", "b") else F.col(c) for c in px.columns])


def dense_frames(px: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The frames that are there, numbered from 0 within their stack in their order, and (stack, frame, kept): the
    new number and the one it had. Fusion counts frames by place, so what was excluded must leave no gap."""
    from pyspark.sql import Window as W

    # one row for each frame of a stack
    index = px.select("stack", F.col("frame").alias("kept")).distinct().withColumn("frame", F.row_number().over(W.partitionBy("stack").orderBy("kept")) - 1)
    j = px.withColumnRenamed("frame", "kept").join(index, ["stack", "kept"])
    return j.select(*px.columns), index.select("stack", "frame", "kept")


def kept_depth(depth: DataFrame, index: DataFrame, value: str = "d") -> DataFrame:
    """Depths by place among the kept frames as depths by the frames' own numbers, linear in between."""
    own = index.groupBy("stack").agg(F.array_sort(F.collect_list(F.struct("frame", "kept"))).alias("_k"))  # one entry for each frame
    lo = F.floor(value).cast("int")
    at = lambda i: F.element_at("_k", F.least(i + 1, F.size("_k")).cast("int"))["kept"]
    d = depth.join(own, "stack").withColumn("_d", at(lo) + (F.col(value) - lo) * (at(lo + 1) - at(lo)))
    return d.withColumn(value, F.col("_d")).drop("_k", "_d")


def box_down(df: DataFrame, factor: int, value: str = "v", how: str = "avg", extra: tuple[str, ...] = ("stack", "frame")) -> DataFrame:
    """Cells of ``factor`` by ``factor`` pixels, clipped at the edges: their mean, or their maximum from 0 on."""
    agg = F.avg(value) if how == "avg" else F.greatest(F.max(value), F.lit(0.0))
    return df.groupBy(*extra, F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")).agg(agg.alias(value))


def extremes(df: DataFrame, value: str = "v", key: list[str] | None = None) -> DataFrame:
    """Least and greatest value of each pixel over its frames, span, and the first frame of the least."""
    key = key or PIXEL
    return df.groupBy(*key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.min_by("frame", F.struct(F.col(value), F.col("frame"))).alias("darkest")).withColumn("span", F.col("hi") - F.col("lo"))


def order_statistic(df: DataFrame, value: str, p: float, key: list[str], convention: str = "count") -> DataFrame:
    """sorted[min(int(n * p), n - 1)] (``count``), sorted[int((n - 1) * p)] (``gap``) of each group, as q.

    Exact, in two passes, so that a group may have any number of rows: mergeable sketches bracket the place to
    within a few thousandths of the group, values below the bracket are counted where they are read, and only the
    distinct values inside it are ranked.
    """
    from pyspark.sql import Window as W

    v = df.where(F.col(value).isNotNull()).select(*key, F.col(value).alias("_v"))
    near = [0.0, max(0.0, p - 1e-3), min(1.0, p + 1e-3), 1.0]  # the sketch is ten times as fine
    s = v.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", near, 10_000).alias("_b"))
    n = F.col("_n")
    k = F.least((n * F.lit(p)).cast("long"), n - 1) if convention == "count" else ((n - 1) * F.lit(p)).cast("long")
    few = n < 5000  # a thousandth of these is less than the rounding of places
    at = lambda i, j: F.when(few, F.element_at("_b", i)).otherwise(F.element_at("_b", j))
    s = s.select(*key, k.alias("_k"), at(1, 2).alias("_lo"), at(4, 3).alias("_hi"))
    inside = F.when(F.col("_v") >= F.col("_lo"), F.col("_v"))  # null: all that lies below counts as one value
    m = v.join(s, key).where(F.col("_v") <= F.col("_hi")).groupBy(*key, "_k", inside.alias("q")).agg(F.count(F.lit(1)).alias("_m"))
    upto = F.sum("_m").over(W.partitionBy(*key).orderBy(F.asc_nulls_first("q")).rowsBetween(W.unboundedPreceding, 0))
    return m.withColumn("_u", upto).where((F.col("_u") > F.col("_k")) & (F.col("_u") - F.col("_m") <= F.col("_k"))).select(*key, "q")


def upper_median(df: DataFrame, value: str, key: list[str]) -> DataFrame:
    """sorted[n div 2]."""
    return order_statistic(df, value, 0.5, key)


def curve_stats(df: DataFrame, value: str = "v", key: list[str] | None = None) -> DataFrame:
    """Peak concentration of each pixel's focus curve: share of the above-median energy within
    max(2, n div 16) frames of the peak; 1 with up to two frames or next to no energy. A curve has one entry
    for each frame of its stack, so the list it is folded from is bounded by the stack."""
    key = key or PIXEL
    c = df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("frame", F.col(value).alias("e")))).alias("c"))
    e = F.transform("c", lambda s: s["e"])
    n = F.size("c")
    c = c.withColumn("n", n).withColumn("best", F.greatest(F.array_max(e), F.lit(0.0))).withColumn("med", F.element_at(F.array_sort(e), (F.floor(n / 2) + 1).cast("int")))
    peak = F.when(F.col("best") > 0, F.element_at(F.filter("c", lambda s: s["e"] == F.col("best")), 1)["frame"]).otherwise(F.lit(0))
    c = c.withColumn("peak", peak).withColumn("win", P.dof_window(F.col("n")))
    zero = F.lit(0.0)
    over = lambda s: F.greatest(s["e"] - F.col("med"), zero)
    c = c.withColumn("total", F.aggregate("c", zero, lambda a, s: a + over(s)))
    c = c.withColumn("near", F.aggregate("c", zero, lambda a, s: a + F.when(F.abs(s["frame"] - F.col("peak")) <= F.col("win"), over(s)).otherwise(zero)))
    some = (F.col("n") > 2) & (F.col("total") > 1e-9)
    return c.select(*key, "n", "peak", "best", "total", F.when(some, F.col("near") / F.when(some, F.col("total"))).otherwise(F.lit(1.0)).alias("concentration"))


def scored_curves(df: DataFrame, threshold: float, value: str = "v", key: list[str] | None = None) -> DataFrame:
    """Depth and concentration where the curve holds energy and is at least ``threshold`` concentrated, else null."""
    s = curve_stats(df, value, key)
    ok = (F.col("total") > 1e-9) & (F.col("concentration") >= threshold)
    return s.select(*(key or PIXEL), F.when(ok, F.col("peak")).alias("depth"), F.when(ok, F.col("concentration")).alias("concentration"))


def weighted_median(df: DataFrame, bins: DataFrame, radius: int, height: int, width: int, value: str = "d", weight: str = "c", key: tuple[str, ...] = ("stack",)) -> DataFrame:
    """Median of the neighbourhood's depths by confidence, from a histogram over frames with interpolation
    inside the bin, and the share of the weight within max(2, n div 16) bins of it.

    Neighbours lie at every max(1, radius div 4)-th place up to ``radius``, edge-clamped; weights up to 0.001
    don't count, and a pixel without weight keeps its depth. ``bins``: stack, n (frames).
    """
    step = max(1, radius // 4)
    offs = list(range(-radius, radius + 1, step))
    d = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in offs for b in offs])
    at = df.select(*key, "y", "x", F.explode(d).alias("o"))
    near = at.select(*key, "y", "x", P.clamp(F.col("y") + F.col("o.dy"), 0, height - 1).cast("int").alias("_y"), P.clamp(F.col("x") + F.col("o.dx"), 0, width - 1).cast("int").alias("_x"))
    src = df.select(*key, F.col("y").alias("_y"), F.col("x").alias("_x"), F.col(value).alias("_v"), F.col(weight).alias("_w")).where("_w > 1e-3")
    h = near.join(src, [*key, "_y", "_x"]).join(bins.select("stack", "n"), "stack")
    h = h.withColumn("bin", F.least(F.greatest(F.floor(F.col("_v") + 0.5), F.lit(0)), F.col("n") - 1).cast("int"))
    h = h.groupBy(*key, "y", "x", "n", "bin").agg(F.sum("_w").alias("w"))
    # a histogram has at most one entry for each frame of the stack
    h = h.groupBy(*key, "y", "x", "n").agg(F.array_sort(F.collect_list(F.struct("bin", "w"))).alias("h"), F.sum("w").alias("total")).where("total > 1e-3")
    half = F.col("total") * 0.5
    walk = F.aggregate(
        "h",
        F.struct(F.lit(0.0).alias("acc"), F.lit(-1).alias("m"), F.lit(0.0).alias("below"), F.lit(0.0).alias("own")),
        lambda s, e: F.when(s["m"] >= 0, s).otherwise(
            F.struct((s["acc"] + e["w"]).alias("acc"), F.when((s["acc"] + e["w"] >= half) | (e["bin"] >= F.col("n") - 1), e["bin"]).otherwise(F.lit(-1)).alias("m"), s["acc"].alias("below"), e["w"].alias("own"))
        ),
    )
    h = h.withColumn("s", walk).withColumn("m", F.when(F.col("s.m") >= 0, F.col("s.m")).otherwise(F.col("n") - 1))
    frac = P.clamp((half - F.col("s.below")) / F.greatest(F.col("s.own"), F.lit(1e-9)))
    agree = F.aggregate("h", F.lit(0.0), lambda a, e: a + F.when(F.abs(e["bin"] - F.col("m")) <= P.dof_window(F.col("n")), e["w"]).otherwise(F.lit(0.0)))
    got = h.select(*key, "y", "x", (F.col("m") - 0.5 + frac).alias("_md"), (agree / F.col("total")).alias("_cs"))
    return df.join(got, [*key, "y", "x"], "left").select(*key, "y", "x", F.coalesce("_md", value).alias("d"), F.coalesce("_cs", F.lit(0.0)).alias("consensus"))


def region_scores(df: DataFrame, cy: float, cx: float, radius: float, value: str = "v") -> DataFrame:
    """Energy inside a disk, by frame."""
    inside = (F.col("y") - cy) ** 2 + (F.col("x") - cx) ** 2 <= radius * radius
    return df.where(inside).groupBy("stack", "frame").agg(F.sum(value).alias("score"))


def depth_vote(depth: DataFrame, cy: int, cx: int, radius: int) -> DataFrame:
    """Most frequent rounded depth inside a disk, sampled at every max(1, radius div 24)-th place; ties to the smaller."""
    from pyspark.sql import Window as W

    k = max(1, radius // 24)
    dy, dx = F.col("y") - cy, F.col("x") - cx
    s = depth.where((dy * dy + dx * dx <= radius * radius) & ((dy + radius) % k == 0) & ((dx + radius) % k == 0))
    c = s.groupBy("stack", F.floor(F.col("d") + 0.5).cast("int").alias("depth")).agg(F.count(F.lit(1)).alias("votes"))
    return c.withColumn("_r", F.row_number().over(W.partitionBy("stack").orderBy(F.desc("votes"), "depth"))).where("_r = 1").drop("_r")


def mass_curves(df: DataFrame, labels: DataFrame, value: str = "v") -> DataFrame:
    """Energy of each component by frame, with the curve's peak, median, 90th percentile and z = (max - med) / (p90 - med)."""
    m = df.join(labels.where("label > 0"), PIXEL).groupBy("stack", "label", "frame").agg(F.sum(value).alias("e"))
    c = m.groupBy("stack", "label").agg(F.array_sort(F.collect_list(F.struct("frame", "e"))).alias("c"))  # one entry for each frame
    e = F.array_sort(F.transform("c", lambda s: s["e"]))
    n = F.size("c")
    c = c.select("stack", "label", "c", F.array_max(e).alias("mx"), F.element_at(e, (F.floor(n / 2) + 1).cast("int")).alias("med"), F.element_at(e, F.least((n * F.lit(0.9)).cast("int"), n - 1) + 1).alias("p90"))
    band = F.col("p90") - F.col("med")
    z = F.when(band > 0, (F.col("mx") - F.col("med")) / F.when(band > 0, band))
    return c.select("stack", "label", F.element_at(F.filter("c", lambda s: s["e"] == F.col("mx")), 1)["frame"].alias("peak"), "mx", "med", "p90", z.alias("z"))


def component_stats(labels: DataFrame, height: int, width: int, ratio: str | None = None) -> DataFrame:
    """Cells, border contact and, with a ratio column, upper median of log2 ratio of each component."""
    edge = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == height - 1) | (F.col("x") == width - 1)
    own = labels.where("label > 0")
    out = own.groupBy("stack", "label").agg(F.count(F.lit(1)).alias("cells"), F.max(edge).alias("border"))
    if ratio:
        med = upper_median(own.withColumn("_l", F.log2(F.greatest(ratio, F.lit(1e-6)))), "_l", ["stack", "label"]).withColumnRenamed("q", "log_ratio")
        out = out.join(med, ["stack", "label"])
    return out


def flatness(anchors: DataFrame, radius: int = 4, least: int = 30) -> DataFrame:
    """Standard deviation of a component's anchors about the mean of the (2 radius + 1)-cell box; infinite below ``least`` anchors.

    ``anchors``: stack, label, y, x, v.
    """
    a = anchors.alias("a")
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)]))
    spread = anchors.select("stack", "label", F.col("v").alias("_v"), "y", "x", near.alias("o")).select("stack", "label", "_v", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    mean = spread.groupBy("stack", "label", "y", "x").agg(F.avg("_v").alias("_m"))
    r = a.join(mean, ["stack", "label", "y", "x"]).withColumn("_d", F.col("v") - F.col("_m"))
    return r.groupBy("stack", "label").agg(F.count(F.lit(1)).alias("anchors"), F.when(F.count(F.lit(1)) >= least, F.stddev_pop("_d")).otherwise(F.lit(float("inf"))).alias("sigma"))


def psnr(a: DataFrame, b: DataFrame, margin: int, height: int, width: int, channels: tuple[str, ...] = ("r", "g", "b"), key: tuple[str, ...] = ("stack",)) -> DataFrame:
    """PSNR of two images over their channels inside a margin; infinite where they agree."""
    inside = (F.col("y") >= margin) & (F.col("y") < height - margin) & (F.col("x") >= margin) & (F.col("x") < width - margin)
    j = a.where(inside).join(b.select(*key, "y", "x", *[F.col(c).alias(f"_{c}") for c in channels]), [*key, "y", "x"])
    se = sum(((F.col(c) - F.col(f"_{c}")) ** 2 for c in channels), F.lit(0.0)) / len(channels)
    g = j.groupBy(*key).agg(F.avg(se).alias("mse"))
    return g.select(*key, F.when(F.col("mse") > 0, -10 * F.log10(F.when(F.col("mse") > 0, F.col("mse")))).otherwise(F.lit(float("inf"))).alias("psnr"))


def best_offset_psnr(a: DataFrame, b: DataFrame, reach: int, height: int, width: int, value: str = "v") -> DataFrame:
    """The shift of ``b`` within ``reach`` at which it agrees best with ``a``: stack, dy, dx, psnr (first of equals).

    Offsets are a literal of (2 reach + 1) ** 2 entries, exploded on one side and joined by pixel.
    """
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]))
    inside = (F.col("y") >= reach) & (F.col("y") < height - reach) & (F.col("x") >= reach) & (F.col("x") < width - reach)
    s = a.where(inside).select("stack", "y", "x", F.col(value).alias("_a"), o.alias("o")).select("stack", "_a", F.col("o.dy").alias("dy"), F.col("o.dx").alias("dx"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    g = s.join(b.select("stack", "y", "x", F.col(value).alias("_b")), PIXEL).groupBy("stack", "dy", "dx").agg(F.round(F.avg((F.col("_a") - F.col("_b")) ** 2), 12).alias("mse"))
    best = g.groupBy("stack").agg(F.min(F.struct("mse", "dy", "dx")).alias("m")).select("stack", "m.*")
    return best.select("stack", "dy", "dx", F.when(F.col("mse") > 0, -10 * F.log10(F.when(F.col("mse") > 0, F.col("mse")))).otherwise(F.lit(float("inf"))).alias("psnr"))


def offset_errors(a: DataFrame, b: DataFrame, offsets: DataFrame, step: int, height: int, width: int, margin: int = 0, least: int = 64, value: str = "v") -> DataFrame:
    """stack, dy, dx, mse over every ``step``-th pixel, both ways, of where the shifted rasters overlap: ``b`` at (y, x) against
    ``a`` at (y + dy, x + dx). Offsets whose overlap has up to ``least`` places a side are left out.

    ``offsets``: stack, dy, dx; the samples of ``b``, which begin at the overlap's corner, are what is exploded."""
    y0, x0 = F.greatest(-F.col("dy"), F.lit(0)) + margin, F.greatest(-F.col("dx"), F.lit(0)) + margin
    y1, x1 = F.least(F.lit(height), height - F.col("dy")) - margin, F.least(F.lit(width), width - F.col("dx")) - margin
    o = offsets.withColumn("_y0", y0).withColumn("_x0", x0).withColumn("_y1", y1).withColumn("_x1", x1).where((F.col("_y1") - F.col("_y0") > least) & (F.col("_x1") - F.col("_x0") > least))
    # samples of b by their residue, so that an offset meets only the pixels of its own lattice
    at = b.select("stack", "y", "x", F.col(value).alias("_b"), (F.col("y") % step).alias("_ry"), (F.col("x") % step).alias("_rx"))
    o = o.withColumn("_ry", F.col("_y0") % step).withColumn("_rx", F.col("_x0") % step)
    s = at.join(o, ["stack", "_ry", "_rx"]).where((F.col("y") >= F.col("_y0")) & (F.col("y") < F.col("_y1")) & (F.col("x") >= F.col("_x0")) & (F.col("x") < F.col("_x1")))
    s = s.select("stack", "dy", "dx", "_b", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"))
    return s.join(a.select("stack", "y", "x", F.col(value).alias("_a")), PIXEL).groupBy("stack", "dy", "dx").agg(F.round(F.avg((F.col("_b") - F.col("_a")) ** 2), 12).alias("mse"))


def searched_offset(a: DataFrame, b: DataFrame, height: int, width: int, reach: int = 32, coarse: int = 16, fine: int = 4, around: int = 2, margin: int = 0, least: int = 64, value: str = "v") -> DataFrame:
    """stack, dy, dx, mse: the offset of ``b`` in ``a`` by a coarse and a fine search. All offsets within ``reach`` are compared on
    every ``coarse``-th pixel both ways, those ``around`` the best of these on every ``fine``-th, ranked among themselves; the first of
    equals in raster order. About (2 reach + 1)**2 / coarse**2 + (2 around + 1)**2 / fine**2 rows a pixel."""
    span = lambda lo, hi: F.explode(F.sequence(F.lit(lo), F.lit(hi)))
    stacks = b.select("stack").distinct()
    every = stacks.withColumn("dy", span(-reach, reach)).withColumn("dx", span(-reach, reach))
    best = lambda d: d.groupBy("stack").agg(F.min(F.struct("mse", "dy", "dx")).alias("m")).select("stack", "m.dy", "m.dx", "m.mse")
    found = best(offset_errors(a, b, every, coarse, height, width, margin, least, value)).select("stack", F.col("dy").alias("_y"), F.col("dx").alias("_x"))
    start = stacks.join(found, "stack", "left").select("stack", F.coalesce("_y", F.lit(0)).alias("_y"), F.coalesce("_x", F.lit(0)).alias("_x"))
    near = start.withColumn("_i", span(-around, around)).withColumn("_j", span(-around, around)).select("stack", (F.col("_y") + F.col("_i")).alias("dy"), (F.col("_x") + F.col("_j")).alias("dx"))
    return best(offset_errors(a, b, near, fine, height, width, margin, least, value))


def intersection_psnr(a: DataFrame, b: DataFrame, height: int, width: int, channels: tuple[str, ...] = ("r", "g", "b"), **search) -> DataFrame:
    """stack, dy, dx, psnr: two images of which neither holds the other, compared where they overlap at the offset that
    :func:`searched_offset` finds on their luminance."""
    lum = lambda d: d.select(*PIXEL, P.luminance(F.col("r"), F.col("g"), F.col("b")).alias("v"))
    at = searched_offset(lum(a), lum(b), height, width, **search).select("stack", "dy", "dx")
    moved = b.join(at, "stack").select("stack", "dy", "dx", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), *[F.col(c).alias(f"_{c}") for c in channels])
    se = sum(((F.col(c) - F.col(f"_{c}")) ** 2 for c in channels), F.lit(0.0)) / len(channels)
    g = moved.join(a, PIXEL).groupBy("stack", "dy", "dx").agg(F.avg(se).alias("mse"))
    return g.select("stack", "dy", "dx", F.when(F.col("mse") > 0, -10 * F.log10(F.when(F.col("mse") > 0, F.col("mse")))).otherwise(F.lit(float("inf"))).alias("psnr"))


def histogram_percentile(df: DataFrame, value: str, p: float, bins: int, top: float, key: list[str]) -> DataFrame:
    """Bin value at which the count from the top down first exceeds (1 - p) of all."""
    from pyspark.sql import Window as W

    h = df.groupBy(*key, P.clamp(F.floor(F.col(value) * bins / top), 0, bins - 1).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    down = W.partitionBy(*key).orderBy(F.desc("bin"))
    h = h.withColumn("_c", F.sum("n").over(down)).withColumn("_t", F.sum("n").over(W.partitionBy(*key)))
    return h.where(F.col("_c") > F.col("_t") * (1 - p)).groupBy(*key).agg((F.max("bin") * (top / bins)).alias("q"))


def veil(image: DataFrame, pct: float = 0.5, samples: int = 300_000) -> DataFrame:
    """Order statistic of each channel's linear light over about ``samples`` evenly spaced pixels (all, if fewer).

    ``image``: stack, i (pixel number), n (pixels), r, g, b.
    """
    step = F.greatest(F.lit(1), F.floor(F.col("n") / samples))
    s = image.where(F.col("i") % step == 0)
    out = None
    for c in "rgb":
        q = order_statistic(s.select("stack", P.srgb_linearize(F.greatest(c, F.lit(0.0))).alias("_v")), "_v", pct, ["stack"]).select("stack", F.col("q").alias(f"veil_{c}"))
        out = q if out is None else out.join(q, "stack")
    return out


def black_point(image: DataFrame, intensity: float = 1.0, lo: float = 0.02, hi: float = 0.06) -> DataFrame:
    """Subtract the veil in linear light where it is dark enough to be one; ``image`` as for :func:`veil`."""
    v = veil(image)
    enc = F.greatest(*[P.srgb_encode(F.col(f"veil_{c}")) for c in "rgb"])
    gate = 1 - P.smoothstep(lo, hi, enc)
    v = v.withColumn("_amount", F.when(gate > 0.001, gate * P.clamp(F.lit(intensity))).otherwise(F.lit(0.0)))
    j = image.join(v, "stack")
    new = lambda c: P.srgb_encode(F.greatest(P.srgb_linearize(F.greatest(c, F.lit(0.0))) - F.col(f"veil_{c}") * F.col("_amount"), F.lit(0.0)))
    return j.select("stack", "y", "x", *[F.when(F.col("_amount") > 0, new(c)).otherwise(F.col(c)).alias(c) for c in "rgb"])
