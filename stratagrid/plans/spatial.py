"""Queries of the stencils and of masks and components, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pixel as P
from ..operators import aggregate as A
from ..operators import components as C
from ..operators import join as J
from ..operators import registration as R
from ..operators import stencil as S
from ..sources import views as V
from .base import Book, r6, with_views

book = Book()
KEY = ("stack", "frame", "y", "x")


def lines(src: str, taps: list[tuple[int, float]], along: str, name: str, size: int = 8) -> str:
    """SQL of one edge-clamped convolution."""
    ks = ", ".join(f"({k}, {w!r})" for k, w in taps)
    other = "x" if along == "y" else "y"
    return f"{name} AS MATERIALIZED (SELECT a.stack, a.frame, a.y, a.x, sum(b.v * w) AS v FROM {src} a, (VALUES {ks}) t(k, w), {src} b WHERE b.stack = a.stack AND b.frame = a.frame AND b.{other} = a.{other} AND b.{along} = least(greatest(a.{along} + k, 0), {size - 1}) GROUP BY a.stack, a.frame, a.y, a.x)"


def out6(df, *cols, value="v"):
    return df.select(*cols, r6(F.col(value)).alias(value))


G15 = [(i - 5, w) for i, w in enumerate(P.gaussian_kernel(1.5))]
ALL = "f4 AS MATERIALIZED (SELECT * FROM emb)"


@book.add("n1_gaussian", with_views("emb", f"{ALL}, {lines('f4', G15, 'x', 'g1')}, {lines('g1', G15, 'y', 'g2')} SELECT stack, frame, y, x, round(v, 6) + 0.0 AS v FROM g2", cte=True))
def n1(spark, d):
    return out6(S.gaussian(V.emb_stack(spark, d), 1.5), *KEY)


@book.add("n1_gaussian_tiles", with_views("emb", f"{ALL}, {lines('f4', G15, 'x', 'g1')}, {lines('g1', G15, 'y', 'g2')} SELECT stack, frame, y, x, round(v, 6) + 0.0 AS v FROM g2", cte=True))
def n1t(spark, d):
    t = S.to_tiles(V.emb_stack(spark, d, by_frame=True), 4, 5, 8, 8)
    return out6(S.map_tiles(t, S.kernel_gaussian(1.5), 4), *KEY)


LAP = "SELECT a.stack, a.frame, a.y, a.x, pow(sum(b.v) - 4 * a.v, 2) AS e FROM {src} a, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) t(i, j), {src} b WHERE b.stack = a.stack AND b.frame = a.frame AND b.y = least(greatest(a.y + i, 0), 7) AND b.x = least(greatest(a.x + j, 0), 7) GROUP BY a.stack, a.frame, a.y, a.x, a.v"


@book.add("n2_laplacian", with_views("emb", f"lp AS ({LAP.format(src='emb')}) SELECT stack, frame, y, x, round(e, 6) AS e FROM lp", cte=True))
def n2(spark, d):
    return out6(S.laplacian_energy(V.emb_stack(spark, d)), *KEY, value="e")


@book.add("n2_laplacian_tiles", with_views("emb", f"lp AS ({LAP.format(src='emb')}) SELECT stack, frame, y, x, round(e, 6) AS e FROM lp", cte=True))
def n2t(spark, d):
    t = S.to_tiles(V.emb_stack(spark, d, by_frame=True), 4, 1, 8, 8)
    return out6(S.map_tiles(t, S.kernel_laplacian, 4, "e"), *KEY, value="e")


GATHER = """{name}t AS (SELECT a.*, CAST(floor(py) AS INTEGER) + i AS ty, CAST(floor(px) AS INTEGER) + j AS tx, (CASE WHEN i = 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) * (CASE WHEN j = 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) AS w FROM {at} a, range(2) p(i), range(2) q(j)),
{name} AS (SELECT t.stack, t.frame, t.y, t.x, sum(w * s.v) AS v FROM {name}t t JOIN {src} s ON s.stack = t.stack AND s.frame = t.frame AND s.y = least(ty, {h} - 1) AND s.x = least(tx, {w} - 1) GROUP BY t.stack, t.frame, t.y, t.x)"""
G1 = [(i - 3, w) for i, w in enumerate(P.gaussian_kernel(1.0))]
GRID = f"{ALL}, dn AS (SELECT stack, frame, y // 4 AS y, x // 4 AS x, avg(v) AS v FROM f4 GROUP BY ALL), {lines('dn', G1, 'x', 'b1', 2)}, {lines('b1', G1, 'y', 'b2', 2)}, pt AS (SELECT stack, frame, y, x, least(greatest((y + 0.5) / 4 - 0.5, 0), 1) AS py, least(greatest((x + 0.5) / 4 - 0.5, 0), 1) AS px FROM f4), {GATHER.format(name='up', at='pt', src='b2', h=2, w=2)} SELECT stack, frame, y, x, round(v, 6) + 0.0 AS v FROM up"


@book.add("n3_energy_grid", with_views("emb", GRID, cte=True))
def n3(spark, d):
    return out6(S.energy_grid(V.emb_stack(spark, d, by_frame=True), 8, 8, 4.0, "v"), *KEY)


@book.add("n4_half", with_views("emb", "SELECT stack, frame, y // 2 AS y, x // 2 AS x, round(avg(v), 6) + 0.0 AS v FROM emb WHERE y < 6 GROUP BY stack, frame, y // 2, x // 2"))
def n4(spark, d):
    return out6(S.half(V.emb_stack(spark, d).where("y < 7"), 7, 8), *KEY)


RES = f"{ALL}, pt AS (SELECT stack, frame, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, least(greatest((y + 0.5) * (8 / 5.0) - 0.5, 0), 7) AS py, least(greatest((x + 0.5) * (8 / 12.0) - 0.5, 0), 7) AS px FROM (SELECT DISTINCT stack, frame FROM f4), range(5) p(y), range(12) q(x)), {GATHER.format(name='up', at='pt', src='f4', h=8, w=8)} SELECT stack, frame, y, x, round(v, 6) + 0.0 AS v FROM up"


@book.add("n5_resize", with_views("emb", RES, cte=True))
def n5(spark, d):
    return out6(S.resize(V.emb_stack(spark, d, by_frame=True), 8, 8, 5, 12), *KEY)


H = [1.01, 0.02, -0.3, -0.015, 0.99, 0.4, 0.0005, -0.0004, 1.0]
LZ = "CASE WHEN abs({t}) < 1e-6 THEN 1.0 WHEN abs({t}) >= 3 THEN 0.0 ELSE 3 * sin(pi() * ({t})) * sin(pi() * ({t}) / 3) / (pi() * ({t}) * pi() * ({t})) END"
WARP = f"""{ALL}, m AS (SELECT *, (1.01 * x + 0.02 * y - 0.3) / (0.0005 * x - 0.0004 * y + 1) AS sx, (-0.015 * x + 0.99 * y + 0.4) / (0.0005 * x - 0.0004 * y + 1) AS sy FROM f4),
t AS (SELECT m.stack, m.frame, m.y, m.x, CASE WHEN sy BETWEEN -0.5 AND 7.5 AND sx BETWEEN -0.5 AND 7.5 THEN 1.0 ELSE 0.0 END AS a, i, j, floor(sy) + i AS ty, floor(sx) + j AS tx, ({LZ.format(t='sy - floor(sy) - i')}) * ({LZ.format(t='sx - floor(sx) - j')}) AS w FROM m, range(-2, 4) p(i), range(-2, 4) q(j))
SELECT t.stack, t.frame, t.y, t.x, round(least(greatest(sum(w * s.v) / sum(w), min(CASE WHEN i IN (0, 1) AND j IN (0, 1) THEN s.v END)), max(CASE WHEN i IN (0, 1) AND j IN (0, 1) THEN s.v END)), 5) + 0.0 AS v, any_value(a)::DOUBLE AS a FROM t JOIN f4 s ON s.stack = t.stack AND s.frame = t.frame AND s.y = least(greatest(ty, 0), 7) AND s.x = least(greatest(tx, 0), 7) GROUP BY t.stack, t.frame, t.y, t.x"""


@book.add("n6_lanczos_warp", with_views("emb", WARP, cte=True))
def n6(spark, d):
    e = V.emb_stack(spark, d, by_frame=True)
    return J.warp_gather(e, e, H, 8, 8).select(*KEY, r6(F.col("v"), 5).alias("v"), "a")


BIL = f"{ALL}, pt AS (SELECT stack, frame, y, x, least(greatest((-0.015 * x + 0.99 * y + 0.4) / (0.0005 * x - 0.0004 * y + 1), 0), 7) AS py, least(greatest((1.01 * x + 0.02 * y - 0.3) / (0.0005 * x - 0.0004 * y + 1), 0), 7) AS px FROM f4), {GATHER.format(name='up', at='pt', src='f4', h=8, w=8)} SELECT stack, frame, y, x, round(v, 6) + 0.0 AS v FROM up"


@book.add("n7_bilinear_warp", with_views("emb", BIL, cte=True))
def n7(spark, d):
    e = V.emb_stack(spark, d, by_frame=True)
    sx, sy = P.project(H, F.col("x"), F.col("y"))
    at = e.select(*KEY).withColumn("sy", sy).withColumn("sx", sx)
    return out6(J.gather(at, e, "sy", "sx", 8, 8, key=("stack", "frame")), *KEY)


SOBEL = f"{ALL}, g AS (SELECT a.stack, a.frame, a.y, a.x, sum(b.v * kx) AS gx, sum(b.v * ky) AS gy FROM f4 a, (VALUES (-1,-1,-1,-1),(-1,0,0,-2),(-1,1,1,-1),(0,-1,-2,0),(0,1,2,0),(1,-1,-1,1),(1,0,0,2),(1,1,1,1)) t(i, j, kx, ky), f4 b WHERE b.stack = a.stack AND b.frame = a.frame AND b.y = least(greatest(a.y + i, 0), 7) AND b.x = least(greatest(a.x + j, 0), 7) GROUP BY a.stack, a.frame, a.y, a.x) SELECT stack, frame, y, x, round(CASE WHEN y IN (0, 7) OR x IN (0, 7) THEN 0 ELSE abs(gx) + abs(gy) END, 6) AS g FROM g"


@book.add("n8_sobel", with_views("emb", SOBEL, cte=True))
def n8(spark, d):
    return out6(S.sobel(V.emb_stack(spark, d), 8, 8), *KEY, value="g")


@book.add("n9_rescale_box", with_views("li", "SELECT frame, y * 7 // 16 AS y, x * 5 // 16 AS x, round(avg(v), 6) AS v FROM li GROUP BY frame, y * 7 // 16, x * 5 // 16"))
def n9(spark, d):
    return out6(S.rescale_box(V.li_stack(spark, d), 16, 16, 7, 5), "frame", "y", "x")


MASK = "mk AS (SELECT stack, y, x, max(v) > med AS m FROM emb JOIN (SELECT stack, quantile_disc(w, 0.5) AS med FROM (SELECT stack, y, x, max(v) AS w FROM emb GROUP BY stack, y, x) GROUP BY stack) USING (stack) GROUP BY stack, y, x, med)"


def mask(spark, d):
    """Cells whose greatest value is above the stack's lower median of them."""
    e = V.emb_stack(spark, d).groupBy("stack", "y", "x").agg(F.max("v").alias("w"))
    med = e.groupBy("stack").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY w)").alias("med"))
    return e.join(med, "stack").select("stack", "y", "x", (F.col("w") > F.col("med")).alias("m"))


@book.add("n10_dilate_erode", with_views("emb", MASK + ", dl AS (SELECT a.stack, a.y, a.x, bool_or(b.m) AS dilated, bool_and(b.m) AS eroded FROM mk a JOIN mk b ON a.stack = b.stack AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.stack, a.y, a.x) SELECT * FROM dl", cte=True))
def n10(spark, d):
    m = mask(spark, d)
    return S.dilate(m, 1).withColumnRenamed("m", "dilated").join(S.erode(m, 1).withColumnRenamed("m", "eroded"), ["stack", "y", "x"])


COMP = MASK + """, op AS (SELECT stack, y, x, y * 8 + x AS i FROM mk WHERE m), r(stack, y, x, c) AS (SELECT stack, y, x, i FROM op UNION SELECT o.stack, o.y, o.x, r.c FROM r JOIN op o ON o.stack = r.stack AND abs(o.y - r.y) + abs(o.x - r.x) = 1 WHERE r.c < o.i),
nm AS (SELECT stack, y, x, min(c) AS c FROM r GROUP BY stack, y, x), lb AS (SELECT *, dense_rank() OVER (PARTITION BY stack ORDER BY c) AS label FROM nm)
SELECT mk.stack, mk.y, mk.x, CAST(coalesce(label, 0) AS INTEGER) AS label FROM mk LEFT JOIN lb USING (stack, y, x)"""


@book.add("n11_components", with_views("emb", COMP, cte=True, recursive=True))
def n11(spark, d):
    return C.label(mask(spark, d), 8).select("stack", "y", "x", F.col("label").cast("int").alias("label"))


REACH = MASK + """, r(stack, y, x, k) AS (SELECT stack, y, x, 0 FROM mk WHERE m AND y = 3 UNION SELECT o.stack, o.y, o.x, r.k + 1 FROM r JOIN mk o ON o.stack = r.stack AND o.m AND greatest(abs(o.y - r.y), abs(o.x - r.x)) = 1 WHERE r.k < 3)
SELECT stack, y, x, CAST(min(k) AS INTEGER) AS steps FROM r GROUP BY stack, y, x"""


@book.add("n12_bounded_reach", with_views("emb", REACH, cte=True, recursive=True))
def n12(spark, d):
    m = mask(spark, d)
    seeds = m.where("y = 3").select("stack", "y", "x", F.col("x").alias("origin"))
    return C.reach(m, seeds, 3).select("stack", "y", "x", "steps")


@book.add("n13_push_pull")
def n13(spark, d):
    e = V.emb_stack(spark, d).where("frame = 0")
    w = F.when((F.col("y") + F.col("x")) % 3 == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return out6(C.push_pull(e.select("stack", "y", "x", (F.col("v") * w).alias("vw"), w.alias("w")), 8, 8), "stack", "y", "x")


BURT = [(-2, 1 / 16), (-1, 4 / 16), (0, 6 / 16), (1, 4 / 16), (2, 1 / 16)]


def decimated(src: str, name: str, size: int) -> str:
    return f"{lines(src, BURT, 'x', name + '1', size)}, {lines(name + '1', BURT, 'y', name + '2', size)}, {name} AS (SELECT stack, frame, y // 2 AS y, x // 2 AS x, v FROM {name}2 WHERE y % 2 = 0 AND x % 2 = 0)"


def expanded(src: str, name: str, size: int) -> str:
    """SQL of the expansion to 2 * size."""
    one = "(VALUES (0, -1, 0.125), (0, 0, 0.75), (0, 1, 0.125), (1, 0, 0.5), (1, 1, 0.5)) t(o, k, w)"
    step = lambda s, n, a, b: f"{n} AS (SELECT a.stack, a.frame, {'a.y, a.x * 2 + o AS x' if a == 'x' else 'a.y * 2 + o AS y, a.x'}, sum(b.v * w) AS v FROM {s} a, {one}, {s} b WHERE b.stack = a.stack AND b.frame = a.frame AND b.{b} = a.{b} AND b.{a} = least(greatest(a.{a} + k, 0), {size - 1}) GROUP BY a.stack, a.frame, a.y, a.x, o)"
    return f"{step(src, name + 'x', 'x', 'y')}, {step(name + 'x', name, 'y', 'x')}"


@book.add("n14_expand", with_views("emb", f"{ALL}, {expanded('f4', 'ex', 8)} SELECT stack, frame, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(v, 6) + 0.0 AS v FROM ex", cte=True))
def n14(spark, d):
    return out6(S.expand(V.emb_stack(spark, d), 16, 16), *KEY)


@book.add("n15_decimate", with_views("emb", f"{ALL}, {decimated('f4', 'dc', 8)} SELECT stack, frame, y, x, round(v, 6) + 0.0 AS v FROM dc", cte=True))
def n15(spark, d):
    return out6(S.decimate(V.emb_stack(spark, d)), *KEY)


@book.add("n16_laplacian_band", with_views("emb", f"{ALL}, {decimated('f4', 'dc', 8)}, {expanded('dc', 'ex', 4)} SELECT a.stack, a.frame, a.y, a.x, round(a.v - e.v, 6) + 0.0 AS v FROM f4 a JOIN ex e ON e.stack = a.stack AND e.frame = a.frame AND e.y = a.y AND e.x = a.x", cte=True))
def n16(spark, d):
    return out6(S.pyramid(V.emb_stack(spark, d), 8, 8, 2)[0][0], *KEY)


@book.add("n16_collapse", with_views("emb", f"{ALL} SELECT stack, frame, y, x, round(v, 6) + 0.0 AS v FROM f4", cte=True))
def n16c(spark, d):
    return out6(S.collapse(S.pyramid(V.emb_stack(spark, d), 8, 8, 2)), *KEY)


@book.add("n17_smooth3", with_views("emb", "SELECT a.stack, a.frame, a.y, a.x, round(avg(b.v), 6) + 0.0 AS v FROM emb a JOIN emb b ON a.stack = b.stack AND a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL"))
def n17(spark, d):
    return out6(S.smooth3(V.emb_stack(spark, d), key=("stack", "frame")), *KEY)


PARA = """im AS (SELECT stack, 0 AS frame, y, x, v FROM emb WHERE frame = 0), dp AS (SELECT stack, y, x, v AS d FROM emb WHERE frame = 1),
q AS (SELECT stack, max(CASE WHEN r = CAST(floor(63 * 0.02) AS INTEGER) THEN d END) AS lo, max(CASE WHEN r = CAST(floor(63 * 0.98) AS INTEGER) THEN d END) AS hi FROM (SELECT *, row_number() OVER (PARTITION BY stack ORDER BY d) - 1 AS r FROM dp) GROUP BY stack),
pt AS (SELECT stack, 0 AS frame, y, x, CAST(y AS DOUBLE) AS py, least(greatest(x + (CASE WHEN hi - lo > 1e-3 THEN least(greatest((d - lo) / (hi - lo), 0), 1) - 0.5 ELSE 0 END) * 2.5, 0), 7) AS px FROM dp JOIN q USING (stack))"""


@book.add("n18_parallax", with_views("emb", f"{PARA}, {GATHER.format(name='up', at='pt', src='im', h=8, w=8)} SELECT stack, y, x, round(v, 6) + 0.0 AS v FROM up", cte=True))
def n18(spark, d):
    e = V.emb_stack(spark, d)
    dep = e.where("frame = 1").select("stack", "y", "x", F.col("v").alias("d"))
    return out6(S.parallax(e.where("frame = 0").drop("frame"), dep, 8, 8, 2.5), "stack", "y", "x")


@book.add("n19_paired_down", with_views("emb", "SELECT a.stack, a.y * 3 // 8 AS y, a.x * 3 // 8 AS x, round(avg(a.v), 6) + 0.0 AS v, round(avg(b.v), 6) + 0.0 AS d FROM emb a JOIN emb b USING (stack, y, x) WHERE a.frame = 0 AND b.frame = 1 GROUP BY a.stack, a.y * 3 // 8, a.x * 3 // 8"))
def n19(spark, d):
    e = V.emb_stack(spark, d)
    v = S.rescale_box(e.where("frame = 0"), 8, 8, 3, 3, key=("stack",))
    z = S.rescale_box(e.where("frame = 1"), 8, 8, 3, 3, key=("stack",)).withColumnRenamed("v", "d")
    return v.join(z, ["stack", "y", "x"]).select("stack", "y", "x", r6(F.col("v")).alias("v"), r6(F.col("d")).alias("d"))


@book.add("a22_component_stats", with_views("emb", COMP.replace("SELECT mk.stack, mk.y, mk.x, CAST(coalesce(label, 0) AS INTEGER) AS label FROM mk LEFT JOIN lb USING (stack, y, x)", "SELECT stack, CAST(label AS INTEGER) AS label, count(*) AS cells, bool_or(y IN (0, 7) OR x IN (0, 7)) AS border FROM lb GROUP BY stack, label"), cte=True, recursive=True))
def a22(spark, d):
    return A.component_stats(C.label(mask(spark, d), 8), 8, 8).select("stack", F.col("label").cast("int").alias("label"), "cells", "border")


MASS = COMP.split("SELECT mk.stack")[0] + ", ms AS (SELECT e.stack, label, frame, sum(greatest(v, 0)) AS e FROM emb e JOIN lb USING (stack, y, x) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY stack, label ORDER BY e) - 1 AS r, count(*) OVER (PARTITION BY stack, label) AS n FROM ms), s AS (SELECT stack, label, arg_max(frame, (e, -frame)) AS peak, max(e) AS mx, max(CASE WHEN r = n // 2 THEN e END) AS med, max(CASE WHEN r = least(CAST(floor(n * 0.9) AS BIGINT), n - 1) THEN e END) AS p90 FROM k GROUP BY stack, label) SELECT stack, CAST(label AS INTEGER) AS label, peak, round(mx, 6) AS mx, round(CASE WHEN p90 > med THEN (mx - med) / (p90 - med) END, 5) AS z FROM s"


@book.add("a21_mass_curves", with_views("emb", MASS, cte=True, recursive=True))
def a21(spark, d):
    e = V.emb_stack(spark, d).withColumn("v", F.greatest("v", F.lit(0.0)))
    m = A.mass_curves(e, C.label(mask(spark, d), 8))
    return m.select("stack", F.col("label").cast("int").alias("label"), "peak", r6(F.col("mx")).alias("mx"), r6(F.col("z"), 5).alias("z"))


FLAT = MASK + ", an AS (SELECT e.stack, 1 AS label, e.y, e.x, e.v FROM emb e JOIN mk USING (stack, y, x) WHERE frame = 0 AND m), bm AS (SELECT a.stack, a.y, a.x, any_value(a.v) - avg(b.v) AS d FROM an a JOIN an b ON a.stack = b.stack AND abs(a.y - b.y) <= 4 AND abs(a.x - b.x) <= 4 GROUP BY a.stack, a.y, a.x) SELECT stack, 1 AS label, count(*) AS anchors, round(CASE WHEN count(*) >= 30 THEN stddev_pop(d) ELSE CAST('Infinity' AS DOUBLE) END, 6) AS sigma FROM bm GROUP BY stack"


@book.add("a23_flatness", with_views("emb", FLAT, cte=True))
def a23(spark, d):
    e = V.emb_stack(spark, d).where("frame = 0").join(mask(spark, d).where("m"), ["stack", "y", "x"]).select("stack", F.lit(1).alias("label"), "y", "x", "v")
    return A.flatness(e).select("stack", "label", "anchors", r6(F.col("sigma")).alias("sigma"))


VARI = "bx AS (SELECT a.stack, a.frame, a.y, a.x, greatest(avg(b.v * b.v) - avg(b.v) * avg(b.v), 0) AS e FROM emb a JOIN emb b ON a.stack = b.stack AND a.frame = b.frame AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY a.stack, a.frame, a.y, a.x) SELECT stack, y, x, arg_max(frame, (e, -frame)) AS frame, round(max(e), 6) AS energy FROM bx GROUP BY stack, y, x"


@book.add("a30_texture_winner", with_views("emb", VARI, cte=True))
def a30(spark, d):
    from ..operators.pmax import texture_winner

    return texture_winner(V.emb_stack(spark, d)).select("stack", "y", "x", "frame", r6(F.col("energy")).alias("energy"))


ROT = "SELECT stack, 0 AS frame, CAST(i AS INTEGER) AS y, CAST(j AS INTEGER) AS x, least(greatest((j - 2) * sin(0.4) + (i - 1.5) * cos(0.4) + 3.6, 0), 7) AS py, least(greatest((j - 2) * cos(0.4) - (i - 1.5) * sin(0.4) + 3.2, 0), 7) AS px FROM (SELECT DISTINCT stack FROM emb), range(4) p(i), range(5) q(j)"


@book.add("f5_rotated_crop", with_views("emb", f"im AS (SELECT stack, 0 AS frame, y, x, v FROM emb WHERE frame = 0), pt AS ({ROT}), {GATHER.format(name='up', at='pt', src='im', h=8, w=8)} SELECT stack, y, x, round(v, 6) + 0.0 AS v FROM up", cte=True))
def f5(spark, d):
    e = V.emb_stack(spark, d).where("frame = 0").drop("frame")
    return out6(R.rotated_crop(e, 8, 8, 4, 5, 3.6, 3.2, 0.4), "stack", "y", "x")


CROP = "h AS (SELECT stack, frame, 1 + frame * 0.001 AS s, frame * 0.7 AS tx, frame * -0.4 AS ty FROM frames), b AS (SELECT stack, ceil(greatest(0, max(tx))) AS x0, ceil(greatest(0, max(ty))) AS y0, floor(least(200, min(s * 200 + tx))) AS x1, floor(least(100, min(s * 100 + ty))) AS y1 FROM h GROUP BY stack) SELECT stack, CAST(CASE WHEN ok THEN x0 ELSE 0 END AS INTEGER) AS x0, CAST(CASE WHEN ok THEN y0 ELSE 0 END AS INTEGER) AS y0, CAST(CASE WHEN ok THEN x1 ELSE 200 END AS INTEGER) AS x1, CAST(CASE WHEN ok THEN y1 ELSE 100 END AS INTEGER) AS y1 FROM (SELECT *, x1 - x0 >= 16 AND y1 - y0 >= 16 AS ok FROM b)"


@book.add("f6_coverage_crop", with_views("emb", CROP, cte=True))
def f6(spark, d):
    f = V.emb_frames(spark, d).select("stack", "frame")
    s, z = 1 + F.col("frame") * 0.001, F.lit(0.0)
    h = f.withColumn("h", F.array(s, z, F.col("frame") * 0.7, z, s, F.col("frame") * -0.4, z, z, F.lit(1.0)))
    return R.coverage_crop(h, 100, 200)
