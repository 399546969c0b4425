"""Queries of the composite operators: depth from focus, pyramid fusion, registration, streams, files."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import pixel as P
from ..operators import aggregate as A
from ..operators import dmap as D
from ..operators import join as J
from ..operators import pmax as M
from ..operators import registration as R
from ..operators import stencil as S
from ..operators import tiles as T
from ..sources import synth
from ..sources import views as V
from .base import Book, r6, taps, with_views
from .spatial import LAP, lines

book = Book()
PX = ["stack", "y", "x"]


def energy(spark, d):
    return S.laplacian_energy(V.emb_stack(spark, d))


def fifty(df):
    """Every stack of ``df`` as one of 50 frames, so that a cut is a constant of the SQL."""
    return df.select("stack").distinct().withColumn("n", F.lit(50))


EN = f"lp AS ({LAP.format(src='emb')})"
BEST = f"{EN}, bs AS (SELECT stack, y, x, max(e) AS energy, CASE WHEN max(e) > 0 THEN arg_max(frame, (e, -frame)) ELSE 0 END AS frame FROM lp GROUP BY stack, y, x)"
SLICE = f"""{BEST}, nf AS (SELECT stack, count(*) AS n FROM frames GROUP BY stack), sp AS (SELECT stack, min(frame) - 1.0 AS lo, max(frame) + 1.0 AS hi FROM bs GROUP BY stack),
wt AS (SELECT e.*, greatest(1 - abs(e.frame - bs.frame), 0) + 1e-6 AS w FROM emb e JOIN bs USING (stack, y, x) JOIN sp USING (stack) WHERE e.frame > lo AND e.frame < hi),
rd AS (SELECT stack, y, x, sum(w * v) / sum(w) AS v FROM wt GROUP BY stack, y, x)
SELECT stack, y, x, bs.frame AS depth, round(energy, 6) AS energy, round(v, 6) + 0.0 AS v, round(1 - bs.frame / (n - 1.0), 6) AS depth_visual FROM bs JOIN rd USING (stack, y, x) JOIN nf USING (stack)"""


@book.add("depth_from_focus", with_views("emb", SLICE, cte=True))
def slice_zero(spark, d):
    """Laplacian energy, sharpest frame of each pixel, tent render about it, depth as gray."""
    px = V.emb_stack(spark, d)
    win = A.winner(S.laplacian_energy(px), "e")
    depth = win.select(*PX, F.col("frame").cast("double").alias("d"))
    image = A.tent_render(px.withColumn("a", F.lit(1.0)), depth, 1.0, ("v",))
    n = V.emb_frames(spark, d).groupBy("stack").agg((F.max("frame") + 1).alias("n"))
    out = win.join(image, PX).join(n, "stack")  # a row for each stack
    return out.select(*PX, F.col("frame").alias("depth"), r6(F.col("energy")).alias("energy"), r6(F.col("v")).alias("v"), r6(P.depth_visual(F.col("frame"), F.col("n"))).alias("depth_visual"))


@book.add("depth_from_focus_tiles")
def slice_tiles(spark, d):
    """Depth from focus of a synthetic stack on packed tiles."""
    s = {0: synth.Synth(frames=7, height=96, width=128, blur=4.0)}
    return T.pixels(T.fuse_tiles(synth.tiles(spark, s, 40), 96, 128, 40)).select(*PX, *[r6(F.col(c), 4).alias(c) for c in ("r", "g", "b", "d")])


@book.add("d2_resolved_options", "SELECT * FROM (VALUES (900, 600, 2, 14.157), (4240, 2832, 10, 66.733), (8256, 5504, 20, 128.0), (16, 16, 1, 1.0)) t(w, h, median_radius, guided_radius)")
def d2(spark, d):
    rows = [(w, h, o.median_radius, round(o.guided_radius, 3)) for w, h in ((900, 600), (4240, 2832), (8256, 5504), (16, 16)) for o in [D.Options().resolved(w, h)]]
    return spark.createDataFrame(rows, "w int, h int, median_radius int, guided_radius double")


HALF = "fl AS (SELECT stack, greatest(1e-6, 0.05 * max(CASE WHEN r = least(CAST(floor(n * 0.95) AS BIGINT), n - 1) THEN energy END)) / 2 AS h FROM (SELECT *, row_number() OVER (PARTITION BY stack ORDER BY energy) - 1 AS r, count(*) OVER (PARTITION BY stack) AS n FROM bs) GROUP BY stack), cf AS (SELECT stack, y, x, frame, energy, pow(greatest(energy - h, 0), 2) / (pow(greatest(energy - h, 0), 2) + h * h) AS c FROM bs JOIN fl USING (stack))"


@book.add("d3_confidence", with_views("emb", f"{BEST}, {HALF} SELECT stack, y, x, round(c, 6) AS c FROM cf", cte=True))
def d3(spark, d):
    c = D.confidence(A.winner(energy(spark, d), "e"), None, D.Options(), 4, 2, 2)
    return c.select(*PX, r6(F.col("c")).alias("c"))


CUBE = "cb AS (SELECT stack, frame, y // 4 AS y, x // 4 AS x, avg(e) AS v FROM lp GROUP BY ALL)"
CONC = """kv AS (SELECT *, row_number() OVER (PARTITION BY stack, y, x ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY stack, y, x) AS n FROM cb),
st AS (SELECT stack, y, x, max(n) AS n, max(CASE WHEN r = n // 2 THEN v END) AS med, CASE WHEN max(v) > 0 THEN arg_max(frame, (v, -frame)) ELSE 0 END AS peak, greatest(2, max(n) // 16) AS win FROM kv GROUP BY stack, y, x),
cc AS (SELECT stack, y, x, CASE WHEN any_value(st.n) > 2 AND sum(greatest(v - med, 0)) > 1e-9 THEN sum(CASE WHEN abs(frame - peak) <= win THEN greatest(v - med, 0) ELSE 0 END) / sum(greatest(v - med, 0)) ELSE 1 END AS k FROM cb JOIN st USING (stack, y, x) GROUP BY stack, y, x)"""


def bilinear(src: str, value: str, base: str, f: int, n: int, name: str) -> str:
    return f"""{name} AS (SELECT p.stack, p.y, p.x, sum((CASE WHEN i = 1 THEN gy - floor(gy) ELSE 1 - (gy - floor(gy)) END) * (CASE WHEN j = 1 THEN gx - floor(gx) ELSE 1 - (gx - floor(gx)) END) * s.{value}) AS {value}
FROM (SELECT stack, y, x, least(greatest((y + 0.5) / {f} - 0.5, 0), {n - 1}) AS gy, least(greatest((x + 0.5) / {f} - 0.5, 0), {n - 1}) AS gx FROM {base}) p, range(2) a(i), range(2) b(j), {src} s
WHERE s.stack = p.stack AND s.y = least(floor(gy) + i, {n - 1}) AND s.x = least(floor(gx) + j, {n - 1}) GROUP BY p.stack, p.y, p.x)"""


@book.add("d3_confidence_gated", with_views("emb", f"{BEST}, {HALF}, {CUBE}, {CONC}, {bilinear('cc', 'k', 'bs', 4, 2, 'kk')} SELECT stack, y, x, round(c * k * k / (k * k + 0.25), 6) AS c FROM cf JOIN kk USING (stack, y, x)", cte=True))
def d3b(spark, d):
    e = energy(spark, d)
    conc = A.curve_stats(A.box_down(e, 4, "e").withColumnRenamed("e", "v"))
    c = D.confidence(A.winner(e, "e"), conc, D.Options(), 4, 2, 2)
    return c.select(*PX, r6(F.col("c")).alias("c"))


@book.add("d5a_measured", with_views("emb", f"{BEST}, {HALF} SELECT stack, y // 4 AS y, x // 4 AS x, round(avg(c), 6) AS cg, round(avg(c * frame), 5) AS cdg FROM cf GROUP BY stack, y // 4, x // 4", cte=True))
def d5a(spark, d):
    c = D.confidence(A.winner(energy(spark, d), "e"), None, D.Options(), 4, 2, 2).withColumn("d", F.col("frame").cast("double"))
    return D.measured(c, 4).select(*PX, r6(F.col("cg")).alias("cg"), r6(F.col("cdg"), 5).alias("cdg"))


LEX = "lm AS (SELECT stack, frame, y // 2 AS y, x // 2 AS x, avg(least(greatest(v + 0.5, 0), 1)) AS v FROM emb GROUP BY ALL), le AS (SELECT stack, y, x, max(v) AS lmax, max(v) - min(v) AS span, arg_min(frame, (v, frame)) AS ds FROM lm GROUP BY stack, y, x), lr AS (SELECT stack, greatest(max(CASE WHEN r = least(CAST(floor(n * 0.95) AS BIGINT), n - 1) THEN lmax END), 1e-6) AS ref FROM (SELECT *, row_number() OVER (PARTITION BY stack ORDER BY lmax) - 1 AS r, count(*) OVER (PARTITION BY stack) AS n FROM le) GROUP BY stack)"


def lum_cube(spark, d):
    e = V.emb_stack(spark, d).withColumn("v", V.unit(F.col("v")))
    return A.box_down(e, 2)


@book.add("d5b_light_extremes", with_views("emb", f"{LEX} SELECT stack, y, x, round(lmax, 6) AS lmax, round(span, 6) AS span, ds, round(pow(0.05 * ref, 2), 9) AS dark2 FROM le JOIN lr USING (stack)", cte=True))
def d5b(spark, d):
    e = D.lit_extremes(lum_cube(spark, d))
    return e.select(*PX, r6(F.col("lmax")).alias("lmax"), r6(F.col("span")).alias("span"), "ds", r6(F.col("dark2"), 9).alias("dark2"))


NBR = f"""{BEST}, {HALF}, ce AS (SELECT stack, y // 2 AS y, x // 2 AS x, avg(c) AS cg FROM cf GROUP BY ALL), qb AS (SELECT stack, frame, y // 2 AS y, x // 2 AS x, avg(e) AS v FROM lp GROUP BY ALL),
cb AS (SELECT a.stack, b.frame, a.y, a.x, sum((1 - w.cg) * b.v) AS v FROM ce a JOIN qb b ON b.stack = a.stack AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 JOIN ce w ON w.stack = b.stack AND w.y = b.y AND w.x = b.x WHERE w.cg < 1 GROUP BY a.stack, b.frame, a.y, a.x), {CONC}
SELECT ce.stack, ce.y, ce.x, CASE WHEN k >= 0.2 THEN CAST(peak AS DOUBLE) ELSE 0.0 END AS d2, round(CASE WHEN k >= 0.2 THEN 0.1 * k ELSE 0 END, 6) AS c2 FROM ce JOIN cc USING (stack, y, x) JOIN st USING (stack, y, x)"""


@book.add("d5c_neighbour_curves", with_views("emb", NBR, cte=True))
def d5c(spark, d):
    e = energy(spark, d)
    c = D.confidence(A.winner(e, "e"), None, D.Options(), 2, 4, 4).withColumn("d", F.col("frame").cast("double"))
    cube = A.box_down(e, 2, "e").withColumnRenamed("e", "v")
    t = D.neighbour_curves(cube, D.measured(c, 2), D.Options(peak_concentration=0.2))
    return t.select(*PX, "d2", r6(F.col("c2")).alias("c2"))


@book.add("d5e_spill", with_views("emb", f"{LEX} SELECT stack, y, x, round(span / (lmax + 1e-6) * (span * span / (span * span + pow(0.002 * ref, 2))) * (pow(0.05 * ref, 2) / (pow(0.05 * ref, 2) + pow(greatest(lmax - span, 0), 2))) * 0.7, 6) AS ss FROM le JOIN lr USING (stack)", cte=True))
def d5e(spark, d):
    c = D.lit_extremes(lum_cube(spark, d)).withColumn("cg", F.lit(0.3))
    return D.spill(c).select(*PX, r6(F.col("ss")).alias("ss"))


GUID = """c0 AS (SELECT stack, y, x, least(greatest(max(CASE WHEN frame = 0 THEN v END) + 0.5, 0), 1) AS g, max(CASE WHEN frame = 1 THEN v END) AS v, 0.1 + abs(max(CASE WHEN frame = 2 THEN v END)) AS w FROM emb GROUP BY stack, y, x),
mo AS (SELECT a.stack, a.y, a.x, sum(b.w * b.g) / sum(b.w) AS mg, sum(b.w * b.v) / sum(b.w) AS mv, greatest(sum(b.w * b.g * b.g) / sum(b.w) - pow(sum(b.w * b.g) / sum(b.w), 2), 0) AS va, sum(b.w * b.g * b.v) / sum(b.w) - sum(b.w * b.g) / sum(b.w) * sum(b.w * b.v) / sum(b.w) AS cv FROM c0 a JOIN c0 b ON a.stack = b.stack AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY a.stack, a.y, a.x),
iv AS (SELECT stack, avg(1 / (va + 1e-6)) AS inv FROM mo GROUP BY stack), ab AS (SELECT stack, y, x, cv / (va + 1e-3 / ((va + 1e-6) * inv)) AS a, mv - cv / (va + 1e-3 / ((va + 1e-6) * inv)) * mg AS b FROM mo JOIN iv USING (stack))
SELECT p.stack, p.y, p.x, round(avg(q.a), 5) + 0.0 AS a, round(avg(q.b), 5) + 0.0 AS b FROM ab p JOIN ab q ON p.stack = q.stack AND abs(p.y - q.y) <= 2 AND abs(p.x - q.x) <= 2 GROUP BY p.stack, p.y, p.x"""


@book.add("d5g_guided", with_views("emb", GUID, cte=True))
def d5g(spark, d):
    e = V.emb_stack(spark, d)
    at = lambda f: F.max(F.when(F.col("frame") == f, F.col("v")))
    c = e.groupBy(*PX).agg(V.unit(at(0)).alias("g"), at(1).alias("v"), (F.abs(at(2)) + 0.1).alias("w"))
    return D.guided(c, D.Options(guided_radius=16.0), 8).select(*PX, r6(F.col("a"), 5).alias("a"), r6(F.col("b"), 5).alias("b"))


@book.add("d5_grid_fit")
def d5(spark, d):
    """All five tiers and the blend: depth of every stack (no SQL: the push-pull prior is iterative)."""
    px = V.rgb_stack(spark, d, holes=False)
    _, depth = D.fuse(px, 8, 8, D.Options(sharpness_sigma=0.0, focus_pre_sigma=0.0, normalize_exposure=False, downsample=2, median_radius=2, guided_radius=4.0))
    return depth.select(*PX, r6(F.col("d"), 4).alias("d"))


BLEND = """p0 AS (SELECT stack, y, x, least(greatest(max(CASE WHEN frame = 0 THEN v END) + 0.5, 0), 1) AS g, least(greatest(max(CASE WHEN frame = 1 THEN v END) + 0.5, 0), 1) AS c, abs(max(CASE WHEN frame = 2 THEN v END)) * 60 AS d, least(greatest(max(CASE WHEN frame = 3 THEN v END) + 0.5, 0), 1) AS k FROM emb GROUP BY stack, y, x),
nf AS (SELECT stack, count(*) AS n FROM frames GROUP BY stack),
t AS (SELECT *, greatest(c, k * k) * 0.8 AS cf, 3 * 2 * g + 10 AS r0 FROM p0 JOIN nf USING (stack)), u AS (SELECT *, r0 + 0.2 * (1 - cf) * (5 - r0) AS rg FROM t),
v AS (SELECT *, pow(rg - d, 2) / (pow(rg - d, 2) + pow(greatest(2, n // 16), 2)) AS t, least(greatest((cf - 0.35) / 0.35, 0), 1) AS s FROM u), w AS (SELECT *, cf + (1 - cf) * t * s * s * (3 - 2 * s) AS cb FROM v)
SELECT stack, y, x, round(least(greatest(cb * d + (1 - cb) * rg, 0), n - 1), 5) AS d FROM w"""


@book.add("d6_blend", with_views("emb", BLEND, cte=True))
def d6(spark, d):
    e = V.emb_stack(spark, d)
    at = lambda f: F.max(F.when(F.col("frame") == f, F.col("v")))
    px = e.groupBy(*PX).agg(V.unit(at(0)).alias("g"), V.unit(at(1)).alias("c"), (F.abs(at(2)) * 60).alias("d"), V.unit(at(3)).alias("consensus"))
    grid = e.where("frame = 0").groupBy("stack", F.floor(F.col("y") / 4).cast("int").alias("y"), F.floor(F.col("x") / 4).cast("int").alias("x")).agg(F.lit(3.0).alias("a"), F.lit(10.0).alias("b"), F.lit(0.2).alias("ss"), F.lit(5.0).alias("ds"))
    n = e.groupBy("stack").agg(F.countDistinct("frame").alias("n"))
    scale = n.select("stack", F.lit(2.0).alias("gs"))
    return D.blend(px, grid, scale, n, 4, 2, 2).select(*PX, r6(F.col("d"), 5).alias("d"))


@book.add("f3_frame_pruning", with_views("emb", f"{BEST}, sp AS (SELECT stack, min(frame) // 2 - 1.5 AS lo, max(frame) // 2 + 1.5 AS hi FROM bs GROUP BY stack) SELECT e.stack, count(DISTINCT e.frame) AS kept FROM frames e JOIN sp USING (stack) WHERE e.frame > lo AND e.frame < hi GROUP BY e.stack", cte=True))
def f3(spark, d):
    depth = A.winner(energy(spark, d), "e").select(*PX, F.floor(F.col("frame") / 2).cast("double").alias("d"))
    return D.pruned(V.emb_frames(spark, d).select("stack", "frame"), depth, 1.5).groupBy("stack").agg(F.countDistinct("frame").alias("kept"))


@book.add("f7_near_black", with_views("emb", "lo AS (SELECT stack, y, x, min(least(greatest(v + 0.5, 0), 1)) AS v FROM emb GROUP BY stack, y, x), s AS (SELECT stack, greatest(max(CASE WHEN r = least(CAST(floor(n * 0.99) AS BIGINT), n - 1) THEN v END), 1e-6) AS s FROM (SELECT *, row_number() OVER (PARTITION BY stack ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY stack) AS n FROM lo) GROUP BY stack), t AS (SELECT stack, y, x, least(greatest((v - 0.15 * s) / (s * 0.2), 0), 1) AS t FROM lo JOIN s USING (stack)) SELECT stack, y, x, round(1 - t * t * (3 - 2 * t), 6) AS m FROM t", cte=True))
def f7(spark, d):
    lo = V.emb_stack(spark, d).groupBy(*PX).agg(F.min(V.unit(F.col("v"))).alias("v"))
    return M.near_black(lo).select(*PX, r6(F.col("m")).alias("m"))


@book.add("f9_sharp_mask", with_views("emb", f"{EN}, fx AS (SELECT stack, y, x, max(e) AS hi, min(e) AS lo FROM lp GROUP BY stack, y, x), s AS (SELECT stack, 0.15 * greatest(max(CASE WHEN r = least(CAST(floor(n * 0.99) AS BIGINT), n - 1) THEN hi END), 1e-6) AS t FROM (SELECT *, row_number() OVER (PARTITION BY stack ORDER BY hi) - 1 AS r, count(*) OVER (PARTITION BY stack) AS n FROM fx) GROUP BY stack) SELECT stack, y, x, hi > t AND hi > 17.0 * greatest(lo, 1e-6) AS m FROM fx JOIN s USING (stack)".replace("17.0", str(min(max(3 * math.log2(50), 6.0), 32.0))), cte=True))
def f9(spark, d):
    fx = A.extremes(energy(spark, d), "e").select(*PX, "hi", "lo")
    return M.sharp_mask(fx, fifty(fx), governance=True)


M2 = f"""pl AS (SELECT stack, frame, array_agg(abs(r) + abs(g) + abs(b) ORDER BY y, x) AS v FROM rgb GROUP BY stack, frame), e1 AS MATERIALIZED (SELECT stack, frame, {taps('v', P.gaussian_kernel(1.0), 'x')} AS t FROM pl),
e2 AS MATERIALIZED (SELECT stack, frame, {taps('t', P.gaussian_kernel(1.0), 'y')} AS e FROM e1), w AS (SELECT stack, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, arg_max(frame, (e[i + 1], -frame)) AS frame FROM e2, range(64) t(i) GROUP BY stack, i)
SELECT stack, y, x, frame, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM w JOIN rgb USING (stack, frame, y, x)"""


@book.add("m2_select", with_views("rgb", M2, cte=True))
def m2(spark, d):
    s = M.select(V.rgb_stack(spark, d, holes=False), 1.0)
    return s.select(*PX, "frame", *[r6(F.col(c)).alias(c) for c in "rgb"])


@book.add("m3_select_raw", with_views("rgb", "w AS (SELECT stack, y, x, arg_max(frame, (abs(r) + abs(g) + abs(b), -frame)) AS frame FROM rgb GROUP BY stack, y, x) SELECT stack, y, x, frame, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM w JOIN rgb USING (stack, frame, y, x)", cte=True))
def m3(spark, d):
    return M.select(V.rgb_stack(spark, d, holes=False)).select(*PX, "frame", *[r6(F.col(c)).alias(c) for c in "rgb"])


TRK = "tb AS (SELECT *, abs(r) + abs(g) + abs(b) AS e, 0.2126 * r + 0.7152 * g + 0.0722 * b AS lum, abs(g - 0.5) AS focus FROM rgb), tr AS (SELECT stack, y, x, arg_max(frame, (e, -frame)) FILTER (WHERE focus > 0.25) AS fa, arg_min(frame, (lum, frame)) AS fb, arg_max(frame, (lum, -frame)) AS fq, arg_max(frame, (e, -frame)) AS fc, coalesce(bool_or(focus > 0.25), false) AS focused, min(lum) AS dark, max(lum) AS bright FROM tb GROUP BY stack, y, x)"


def tracked(spark, d):
    px = V.rgb_stack(spark, d, holes=False)
    px = px.withColumn("lum", P.luminance(F.col("r"), F.col("g"), F.col("b"))).withColumn("focus", F.abs(F.col("g") - 0.5))
    return M.tracks(px, 0.25)


@book.add("m4_tracks", with_views("rgb", f"{TRK} SELECT stack, y, x, coalesce(fa, -1) AS fa, fb, fq, fc, focused FROM tr", cte=True))
def m4(spark, d):
    return tracked(spark, d).select(*PX, F.coalesce("A.frame", F.lit(-1)).alias("fa"), F.col("B.frame").alias("fb"), F.col("Q.frame").alias("fq"), F.col("C.frame").alias("fc"), "focused")


@book.add("m6_flat_base", with_views("rgb", "SELECT stack, y, x, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b FROM rgb GROUP BY stack, y, x"))
def m6(spark, d):
    return V.rgb_stack(spark, d).groupBy(*PX).agg(*[r6(F.avg(c)).alias(c) for c in "rgb"])


@book.add("m9_merge", with_views("rgb", f"{TRK}, pk AS (SELECT stack, y, x, fc, CASE WHEN focused THEN fa WHEN (y + x) % 2 = 0 AND abs(bright - 0.6) < abs(dark - 0.6) THEN fq ELSE fb END AS fp FROM tr) SELECT k.stack, k.y, k.x, round(c.r + (p.r - c.r) * 0.75, 6) AS r, round(c.g + (p.g - c.g) * 0.75, 6) AS g, round(c.b + (p.b - c.b) * 0.75, 6) AS b FROM pk k JOIN rgb c ON c.stack = k.stack AND c.y = k.y AND c.x = k.x AND c.frame = k.fc JOIN rgb p ON p.stack = k.stack AND p.y = k.y AND p.x = k.x AND p.frame = k.fp", cte=True))
def m9(spark, d):
    t = tracked(spark, d)
    m = t.select(*PX, F.lit(0.75).alias("mask"), F.when((F.col("y") + F.col("x")) % 2 == 0, 1.0).otherwise(0.0).alias("bg"), F.lit(0.6).alias("clean"))
    return M.merge(t, m).select(*PX, *[r6(F.col(c)).alias(c) for c in "rgb"])


CLAMP = "bd AS (SELECT stack, frame, y, x, r - 0.5 AS r, g - 0.5 AS g, b - 0.5 AS b FROM rgb), o AS (SELECT stack, y, x, 1.5 * sum(r) AS r, 1.5 * sum(g) AS g, 1.5 * sum(b) AS b FROM bd GROUP BY stack, y, x), tp AS (SELECT stack, cy, cx, max(e) AS t FROM (SELECT stack, frame, y // 4 AS cy, x // 4 AS cx, avg(r * r + g * g + b * b) AS e FROM bd GROUP BY ALL) GROUP BY stack, cy, cx), ow AS (SELECT stack, y // 4 AS cy, x // 4 AS cx, avg(r * r + g * g + b * b) AS w FROM o GROUP BY ALL) SELECT o.stack, o.y, o.x, round(r * k, 6) + 0.0 AS r, round(g * k, 6) + 0.0 AS g, round(b * k, 6) + 0.0 AS b FROM o JOIN (SELECT stack, cy, cx, CASE WHEN w > t THEN sqrt(t / greatest(w, 1e-12)) ELSE 1 END AS k FROM tp JOIN ow USING (stack, cy, cx)) c ON c.stack = o.stack AND c.cy = o.y // 4 AND c.cx = o.x // 4"


@book.add("m11_envelope_clamp", with_views("rgb", CLAMP, cte=True))
def m11(spark, d):
    b = V.rgb_stack(spark, d).select("stack", "frame", "y", "x", *[(F.col(c) - 0.5).alias(c) for c in "rgb"])
    o = b.groupBy(*PX).agg(*[(F.sum(c) * 1.5).alias(c) for c in "rgb"])
    return M.envelope_clamp(o, b, 4).select(*PX, *[r6(F.col(c)).alias(c) for c in "rgb"])


GOV = f"{BEST}, mk AS (SELECT stack, y, x, (y * 3 + x) % 4 <> 0 AS m FROM bs), tf AS (SELECT stack, frame FROM (SELECT stack, frame, row_number() OVER (PARTITION BY stack ORDER BY round(sum(energy), 9) DESC, frame) AS r FROM bs JOIN mk USING (stack, y, x) WHERE m GROUP BY stack, frame) WHERE r <= 8), bz AS (SELECT stack, frame, y // 4 AS cy, x // 4 AS cx, round(sum(energy), 9) AS mass FROM bs JOIN mk USING (stack, y, x) JOIN tf USING (stack, frame) WHERE m GROUP BY ALL), bb AS (SELECT stack, cy, cx, arg_max(frame, (mass, -frame)) AS bf, max(mass) AS mm FROM bz GROUP BY stack, cy, cx) SELECT a.stack, a.y, a.x, CASE WHEN NOT m OR bf IS NULL OR coalesce(mass, 0) >= 0.85 * mm THEN a.frame ELSE bf END AS frame FROM bs a JOIN mk USING (stack, y, x) LEFT JOIN bb ON bb.stack = a.stack AND bb.cy = a.y // 4 AND bb.cx = a.x // 4 LEFT JOIN bz ON bz.stack = a.stack AND bz.cy = a.y // 4 AND bz.cx = a.x // 4 AND bz.frame = a.frame"


@book.add("m12_govern", with_views("emb", GOV, cte=True))
def m12(spark, d):
    win = A.winner(energy(spark, d), "e")
    return M.govern(win, win.select(*PX, ((F.col("y") * 3 + F.col("x")) % 4 != 0).alias("m")), 4)


@book.add("m1_pyramid_fuse")
def m1(spark, d):
    image = M.fuse(V.rgb_stack(spark, d, holes=False), 8, 8, M.Options(coarse_levels=0, normalize_exposure=False), n_levels=2)
    return image.select(*PX, *[r6(F.col(c), 5).alias(c) for c in "rgb"])


@book.add("m1_debloomed_fuse")
def m1d(spark, d):
    """A synthetic stack with exposure flicker, fused with tracks, masks, veto and clamp: PSNR against the truth."""
    s = {0: synth.Synth(scene="object", frames=5, height=32, width=48, blur=3.0, flicker=0.02)}
    image = M.fuse(synth.pixels(spark, s), 32, 48, M.Options(cell=8), n_levels=3)
    return A.psnr(image, synth.truth(spark, s), 4, 32, 48).select("stack", r6(F.col("psnr"), 2).alias("psnr"))


VETO = """cl AS (SELECT stack, frame, y // 2 AS y, x // 2 AS x, avg((r - 0.5) * (r - 0.5)) AS v FROM rgb GROUP BY ALL),
ce AS (SELECT stack, y, x, max(v) AS hi, min(v) AS lo FROM cl GROUP BY ALL),
el AS (SELECT *, sqrt(hi / greatest(lo, 1e-12)) AS q, row_number() OVER (PARTITION BY stack ORDER BY hi) - 1 AS k, count(*) OVER (PARTITION BY stack) AS n FROM ce WHERE NOT (y <= 1 AND x <= 1)),
fl AS (SELECT stack, max(CASE WHEN k = CAST(floor((n - 1) * 0.9) AS BIGINT) THEN hi END) * 0.01 AS f FROM el GROUP BY stack),
t AS (SELECT stack, y, x, CASE WHEN lo > f AND hi > 5.5e-6 THEN least(greatest((q - (1 + 0.25 * sqrt(2 * ln(50)))) / (0.2 * sqrt(2 * ln(50))), 0), 1) ELSE 0 END AS t FROM el JOIN fl USING (stack))
SELECT stack, y, x, round(coalesce(t * t * (3 - 2 * t), 0), 6) + 0.0 AS v FROM ce LEFT JOIN t USING (stack, y, x)"""


@book.add("m10_texture_veto", with_views("rgb", VETO, cte=True))
def m10(spark, d):
    px = V.rgb_stack(spark, d, holes=False).withColumn("v", (F.col("r") - 0.5) ** 2)
    c = A.box_down(px, 2).groupBy(*PX).agg(F.max("v").alias("env_max"), F.min("v").alias("env_min")).withColumn("sharp", F.col("y") + F.col("x") == 0)
    return M.texture_veto(c, fifty(c)).select(*PX, r6(F.col("v")).alias("v"))


FIELD = """lx AS (SELECT stack, y, x, min(least(greatest(v + 0.5, 0), 1)) AS lo, max(least(greatest(v + 0.5, 0), 1)) AS hi FROM emb GROUP BY stack, y, x),
fx AS (SELECT stack, y, x, max(e) + 0.1 AS hi, min(e) + 0.1 AS lo FROM lp GROUP BY stack, y, x),
sh AS (SELECT stack, 0.45 * greatest(max(CASE WHEN r = least(CAST(floor(n * 0.99) AS BIGINT), n - 1) THEN hi END), 1e-6) AS t FROM (SELECT *, row_number() OVER (PARTITION BY stack ORDER BY hi) - 1 AS r, count(*) OVER (PARTITION BY stack) AS n FROM fx) GROUP BY stack),
op AS MATERIALIZED (SELECT stack, y, x, y * 8 + x AS i FROM fx JOIN sh USING (stack) WHERE NOT hi > t),
r(stack, y, x, c) AS (SELECT stack, y, x, i FROM op UNION SELECT o.stack, o.y, o.x, r.c FROM r JOIN op o ON o.stack = r.stack AND abs(o.y - r.y) + abs(o.x - r.x) = 1 WHERE r.c < o.i),
nm AS (SELECT stack, y, x, min(c) AS c FROM r GROUP BY stack, y, x), lb AS (SELECT *, dense_rank() OVER (PARTITION BY stack ORDER BY c) AS label FROM nm),
px AS (SELECT lb.stack, y, x, label, CAST(least(floor(log2(greatest(f.hi / greatest(f.lo, 1e-6), 1)) * 4), 63) AS INTEGER) AS bin, CAST(l.hi - l.lo <= 0.75 AS INTEGER) AS c, y IN (0, 7) OR x IN (0, 7) AS e FROM lb JOIN fx f USING (stack, y, x) JOIN lx l USING (stack, y, x)),
st AS (SELECT stack, label, count(*) AS cells, bool_or(e) AS border, sum(c) AS clean, quantile_disc(bin, 0.5) AS bin FROM px GROUP BY stack, label)
SELECT stack, CAST(label AS INTEGER) AS label, cells, border, CAST(clean AS BIGINT) AS clean, bin, cells >= 3 AND border AND clean >= 2 AND bin / 4.0 < log2(least(greatest(3 * log2(n), 6), 32)) AS candidate FROM st JOIN (SELECT stack, count(*) AS n FROM frames GROUP BY stack) USING (stack)"""


def floored(spark, d):
    """Greatest and least energy of each pixel above a floor of noise."""
    return A.extremes(energy(spark, d), "e").select(*PX, (F.col("hi") + 0.1).alias("hi"), (F.col("lo") + 0.1).alias("lo"))


def light(spark, d):
    """Greatest and least light of each pixel."""
    return A.extremes(V.emb_stack(spark, d).withColumn("v", V.unit(F.col("v")))).select(*PX, "hi", "lo")


@book.add("m8_open_field", with_views("emb", f"{EN}, {FIELD}", cte=True, recursive=True))
def m8_field(spark, d):
    """Components outside the sharp mask and the gates that make one open background: size, border, clean pixels, median ratio."""
    fx = floored(spark, d)
    n = M.frame_counts(V.emb_frames(spark, d))
    _, st = M.open_field(fx, light(spark, d), n, 8, 8, radius=0, alpha=0.45, least=3, clean=2, clean_range=0.75)
    return st.select("stack", F.col("label").cast("int").alias("label"), "cells", "border", "clean", "bin", "candidate")


@book.add("m8_open_background")
def m8(spark, d):
    fx = floored(spark, d)
    _, clean = M.open_background(fx, light(spark, d), M.frame_counts(V.emb_frames(spark, d)), 8, 8, 2, flat=1.0, anchors=1, weight=0.1, ranges=(0.75, 1.0), radius=0, alpha=0.45, least=3, clean=2)
    return clean.select(*PX, r6(F.col("v")).alias("v"))


RES = "pr AS (SELECT stack, frame, frame + 1 AS other, abs(CAST(embedding[1] AS DOUBLE)) * 20 + CASE WHEN frame % 9 = 4 THEN 40 ELSE 0 END AS residual FROM frames WHERE (stack, frame + 1) IN (SELECT stack, frame FROM frames)), k AS (SELECT *, row_number() OVER (PARTITION BY stack ORDER BY residual) - 1 AS r, count(*) OVER (PARTITION BY stack) AS n FROM pr), md AS (SELECT stack, greatest(max(CASE WHEN r = n // 2 THEN residual END), 0.25) AS m FROM k GROUP BY stack), bd AS (SELECT stack, frame, other, residual / m AS ratio FROM pr JOIN md USING (stack) WHERE residual > greatest(3 * m, 4))"


def residuals(spark, d):
    f = V.emb_frames(spark, d).select("stack", "frame", F.abs(F.element_at("embedding", 1).cast("double")).alias("q"))
    p = J.adjacent_pairs(f.select("stack", "frame")).join(f, ["stack", "frame"])
    return p.select("stack", "frame", "other", (F.col("q") * 20 + F.when(F.col("frame") % 9 == 4, 40).otherwise(0)).alias("residual"))


@book.add("r5_residual_outliers", with_views("emb", f"{RES} SELECT stack, frame, other, round(ratio, 6) AS ratio FROM bd", cte=True))
def r5(spark, d):
    return R.residual_outliers(residuals(spark, d)).select("stack", "frame", "other", r6(F.col("ratio")).alias("ratio"))


@book.add("r6_blame", with_views("emb", f"{RES}, nn AS (SELECT stack, max(frame) AS last FROM frames GROUP BY stack), s AS (SELECT stack, f, count(*) AS k FROM (SELECT stack, frame AS f FROM bd UNION ALL SELECT stack, other FROM bd) GROUP BY stack, f), tw AS (SELECT stack, f FROM s WHERE k >= 2), ln AS (SELECT b.*, last FROM bd b JOIN nn USING (stack) WHERE (b.stack, b.frame) NOT IN (SELECT stack, f FROM tw) AND (b.stack, b.other) NOT IN (SELECT stack, f FROM tw)) SELECT stack, CAST(f AS INTEGER) AS frame, 'misaligned' AS kind FROM tw UNION SELECT stack, 0, 'misaligned' FROM ln WHERE frame = 0 UNION SELECT stack, CAST(last AS INTEGER), 'misaligned' FROM ln WHERE other = last", cte=True))
def r6_blame(spark, d):
    bad = R.residual_outliers(residuals(spark, d))
    return R.blame(V.emb_frames(spark, d).select("stack", "frame"), bad)


@book.add("r4_identity_gate", with_views("emb", "SELECT stack, frame, round(CASE WHEN r > i * 1.02 THEN i ELSE r END, 6) AS residual, CASE WHEN r > i * 1.02 THEN 1.0 ELSE 2.0 END::DOUBLE AS h0 FROM (SELECT stack, frame, abs(CAST(embedding[1] AS DOUBLE)) * 20 AS r, abs(CAST(embedding[2] AS DOUBLE)) * 20 AS i FROM frames)"))
def r4(spark, d):
    q = lambda k: F.abs(F.element_at("embedding", k).cast("double")) * 20
    p = V.emb_frames(spark, d).select("stack", "frame", (F.col("frame") + 1).alias("other"), q(1).alias("residual"), q(2).alias("identity_residual"), F.array(*[F.lit(v) for v in (2.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)]).alias("h"))
    return R.gated(p).select("stack", "frame", r6(F.col("residual")).alias("residual"), F.element_at("h", 1).alias("h0"))


@book.add("w5_transform_chain", with_views("emb", "SELECT stack, frame, round((n // 2 - frame) * 0.25, 6) + 0.0 AS tx, round((frame - n // 2) * 0.5, 6) + 0.0 AS ty FROM frames JOIN (SELECT stack, count(*) AS n FROM frames GROUP BY stack) USING (stack)"))
def w5(spark, d):
    f = V.emb_frames(spark, d).select("stack", "frame")
    p = J.adjacent_pairs(f).withColumn("h", F.array(*[F.lit(v) for v in (1.0, 0.0, 0.25, 0.0, 1.0, -0.5, 0.0, 0.0, 1.0)]))
    t = R.transforms(f, p, f)
    return t.select("stack", "frame", r6(F.element_at("h", 3)).alias("tx"), r6(F.element_at("h", 6)).alias("ty"))


@book.add("r1_registration")
def r1(spark, d):
    s = {0: synth.Synth(frames=5, height=48, width=64, jitter=2.5, blur=1.0)}
    px = synth.pixels(spark, s).withColumn("v", P.luminance(F.col("r"), F.col("g"), F.col("b")))
    pairs = J.adjacent_pairs(px.select("stack", "frame").distinct())
    h = R.register_pairs(px, pairs, 48, 64)
    return h.select("stack", "frame", "other", r6(F.element_at("h", 3), 3).alias("dx"), r6(F.element_at("h", 6), 3).alias("dy"))


@book.add("r2_registration")
def r2(spark, d):
    """A sabotaged stack: frame 2 misfired, frame 7 shows another scene; the others drift by known shifts."""
    good = synth.Synth(frames=11, height=48, width=64, jitter=2.0, blur=2.0)
    other = synth.Synth(frames=11, height=48, width=64, blur=0.0, seed=977)
    px = synth.pixels(spark, {0: good}).withColumn("v", P.luminance(F.col("r"), F.col("g"), F.col("b")))
    alien = synth.pixels(spark, {0: other}).where("frame = 7").withColumn("v", P.luminance(F.col("b"), F.col("r"), F.col("g")))
    px = px.where("frame <> 7").unionByName(alien).withColumn("v", F.when(F.col("frame") == 2, F.col("v") * 0.1).otherwise(F.col("v")))
    frames, issues = R.register_stacks(px, 48, 64)
    out = frames.join(issues, ["stack", "frame"], "left")
    return out.select("stack", "frame", F.coalesce("kind", F.lit("")).alias("kind"), r6(F.element_at("h", 3), 2).alias("tx"), r6(F.element_at("h", 6), 2).alias("ty"))


@book.add("s9_synth_fuse_psnr")
def s9(spark, d):
    s = {k: synth.Synth(scene=n, frames=7, height=48, width=64, blur=4.0) for k, n in enumerate(synth.SCENES)}
    image, _ = D.fuse(synth.pixels(spark, s), 48, 64, D.Options(sharpness_sigma=1.0, median_radius=4), regularize=False)
    return A.psnr(image, synth.truth(spark, s), 4, 48, 64).select("stack", r6(F.col("psnr"), 3).alias("psnr"))


