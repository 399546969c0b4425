"""Queries of the scalar maps, filters and sinks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pixel as P
from ..sources import project
from ..sources import views as V
from .base import Book, r6, with_views

book = Book()
TONE = P.Tone(0.5, 30, -40, 25, 10, -15)
TONE_SQL = """
t0 AS (SELECT stack, frame, y, x, least(greatest(v + 0.5, 0), 1) AS v FROM emb),
t1 AS (SELECT *, (CASE WHEN v <= 0.04045 THEN v / 12.92 ELSE pow((v + 0.055) / 1.055, 2.4) END) * pow(2, 0.5) AS l FROM t0),
t2 AS (SELECT stack, frame, y, x, least(greatest(CASE WHEN l <= 0.0031308 THEN l * 12.92 ELSE 1.055 * pow(l, 1 / 2.4) - 0.055 END, 0), 1) AS v FROM t1),
t3 AS (SELECT stack, frame, y, x, v + (v * v * (3 - 2 * v) - v) * 0.3 AS v FROM t2),
t4 AS (SELECT stack, frame, y, x, v + v * v * (1 - v) * (6.75 * 0.3 * -0.4) AS v FROM t3),
t5 AS (SELECT stack, frame, y, x, v + v * (1 - v) * (1 - v) * (6.75 * 0.35 * 0.25) AS v FROM t4),
t6 AS (SELECT stack, frame, y, x, v + v * v * v * 0.025 AS v FROM t5),
t7 AS (SELECT stack, frame, y, x, least(greatest(v + (1 - v) * (1 - v) * (1 - v) * -0.0375, 0), 1) AS v FROM t6)"""


@book.add("p1_luminance", with_views("rgb", "SELECT stack, frame, y, x, round(0.2126 * r + 0.7152 * g + 0.0722 * b, 6) AS lum FROM rgb"))
def p1(spark, d):
    px = V.rgb_stack(spark, d)
    return px.select("stack", "frame", "y", "x", r6(P.luminance(F.col("r"), F.col("g"), F.col("b"))).alias("lum"))


@book.add("p2_affine", with_views("rgb", "SELECT stack, frame, y, x, round(r * 1.2 - 0.1, 6) + 0.0 AS r, round(g * 0.9 - 0.1, 6) + 0.0 AS g, round(b - 0.1, 6) + 0.0 AS b, a FROM rgb"))
def p2(spark, d):
    px = V.rgb_stack(spark, d)
    return px.select("stack", "frame", "y", "x", *[r6(P.affine(F.col(c), k, -0.1)).alias(c) for c, k in zip("rgb", (1.2, 0.9, 1.0))], "a")


@book.add("p3_smoothstep", with_views("emb", "SELECT stack, frame, y, x, round(t * t * (3 - 2 * t), 6) AS s, CASE WHEN v < 0.1 THEN 0.0 ELSE 1.0 END::DOUBLE AS hard FROM (SELECT *, least(greatest((v + 0.2) / 0.4, 0), 1) AS t FROM emb)"))
def p3(spark, d):
    e = V.emb_stack(spark, d)
    return e.select("stack", "frame", "y", "x", r6(P.smoothstep(-0.2, 0.2, F.col("v"))).alias("s"), P.smoothstep(0.1, 0.1, F.col("v")).alias("hard"))


@book.add("p4_srgb", with_views("emb", "SELECT stack, frame, y, x, round(CASE WHEN v <= 0.04045 THEN v / 12.92 ELSE pow((v + 0.055) / 1.055, 2.4) END, 6) AS lin, round(CASE WHEN v <= 0.0031308 THEN v * 12.92 ELSE 1.055 * pow(v, 1 / 2.4) - 0.055 END, 6) AS enc FROM (SELECT stack, frame, y, x, least(greatest(v + 0.5, 0), 1) AS v FROM emb)"))
def p4(spark, d):
    e = V.emb_stack(spark, d).withColumn("v", V.unit(F.col("v")))
    return e.select("stack", "frame", "y", "x", r6(P.srgb_linearize(F.col("v"))).alias("lin"), r6(P.srgb_encode(F.col("v"))).alias("enc"))


@book.add("p5_tone", with_views("emb", f"{TONE_SQL} SELECT stack, frame, y, x, round(v, 6) AS v FROM t7", cte=True))
def p5(spark, d):
    e = V.emb_stack(spark, d).withColumn("v", V.unit(F.col("v")))
    return e.select("stack", "frame", "y", "x", r6(P.tone(F.col("v"), TONE)).alias("v"))


@book.add("p6_tone_table", with_views("emb", f"{TONE_SQL} SELECT stack, frame, y, x, round(v, 3) AS v FROM t7", cte=True))
def p6(spark, d):
    e = V.emb_stack(spark, d).withColumn("v", V.unit(F.col("v")))
    t = F.array(*[F.lit(v) for v in P.tone_table(TONE)])
    return e.withColumn("_t", t).select("stack", "frame", "y", "x", (F.round(P.lookup(F.col("v"), F.col("_t"), 4096), 3) + 0.0).alias("v"))


@book.add("p7_tone_cube", "WITH t AS (SELECT CAST(i AS INTEGER) AS i, i / 15.0 AS u FROM range(16) t(i)), c AS (SELECT i, round(u + (u * u * (3 - 2 * u) - u) * 0.5, 6) AS v FROM t) SELECT a.i AS ri, b.i AS gi, c.i AS bi, a.v AS r, b.v AS g, c.v AS b FROM c a, c b, c")
def p7(spark, d):
    t = F.sequence(F.lit(0), F.lit(15))
    c = spark.range(1).select(F.explode(t).alias("ri")).withColumn("gi", F.explode(t)).withColumn("bi", F.explode(t))
    at = lambda n: r6(P.tone(F.col(n) / 15.0, P.Tone(contrast=50)))
    return c.select("ri", "gi", "bi", at("ri").alias("r"), at("gi").alias("g"), at("bi").alias("b"))


@book.add("p9_depth_visual", with_views("emb", "SELECT stack, frame, round(1 - frame / (n - 1.0), 6) AS v FROM (SELECT DISTINCT stack, frame, max(frame) OVER (PARTITION BY stack) + 1 AS n FROM frames)"))
def p9(spark, d):
    f = V.emb_frames(spark, d).select("stack", "frame")
    n = f.groupBy("stack").agg((F.max("frame") + 1).alias("n"))
    return f.join(n, "stack").select("stack", "frame", r6(P.depth_visual(F.col("frame"), F.col("n"))).alias("v"))


@book.add("p10_to_byte", with_views("emb", "SELECT stack, frame, y, x, CAST(floor(least(greatest(v + 0.5, 0), 1) * 255 + 0.5) AS INTEGER) AS byte FROM emb"))
def p10(spark, d):
    return V.emb_stack(spark, d).select("stack", "frame", "y", "x", P.to_byte(V.unit(F.col("v"))).alias("byte"))


@book.add("p11_quantize", with_views("emb", "SELECT stack, frame, y, x, q, round(q * (0.4 / 65535), 6) AS back FROM (SELECT stack, frame, y, x, CAST(floor(least(greatest(v * 65535 / 0.4, 0), 65535) + 0.5) AS INTEGER) AS q FROM emb)"))
def p11(spark, d):
    q = V.emb_stack(spark, d).withColumn("q", P.quantize(F.col("v"), 0.4))
    return q.select("stack", "frame", "y", "x", "q", r6(P.dequantize(F.col("q"), 0.4)).alias("back"))


H = [1.01, 0.02, -0.3, -0.015, 0.99, 0.4, 0.0005, -0.0004, 1.0]


@book.add("p12_project", with_views("li", "SELECT frame, y, x, round((1.01 * x + 0.02 * y - 0.3) / (0.0005 * x - 0.0004 * y + 1), 6) AS px, round((-0.015 * x + 0.99 * y + 0.4) / (0.0005 * x - 0.0004 * y + 1), 6) AS py FROM li"))
def p12(spark, d):
    px, py = P.project(H, F.col("x"), F.col("y"))
    return V.li_stack(spark, d).select("frame", "y", "x", r6(px).alias("px"), r6(py).alias("py"))


@book.add("p13_matrix", "SELECT CAST(k AS INTEGER) AS k, CASE WHEN k % 4 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM range(9) t(k)")
def p13(spark, d):
    one = P.mat_mul(P.mat_inverse(H), H)
    return spark.createDataFrame([(k, round(v, 9) + 0.0) for k, v in enumerate(one)], "k int, v double")


@book.add("p14_rescaled", "SELECT * FROM (VALUES (0, 1.01), (1, 0.02), (2, -0.6), (3, -0.015), (4, 0.99), (5, 0.8), (6, 0.00025), (7, -0.0002), (8, 1.0)) t(k, v)")
def p14(spark, d):
    return spark.createDataFrame([(k, round(v, 9)) for k, v in enumerate(P.rescaled(H, 2.0))], "k int, v double")


@book.add("p15_gaussian_kernel", "WITH k AS (SELECT i, exp(-(i * i) / (2 * 1.5 * 1.5)) AS w FROM range(-5, 6) t(i)) SELECT CAST(i AS INTEGER) AS i, round(w / sum(w) OVER (), 9) AS w FROM k")
def p15(spark, d):
    k = P.gaussian_kernel(1.5)
    return spark.createDataFrame([(i - len(k) // 2, round(w, 9)) for i, w in enumerate(k)], "i int, w double")


@book.add("p16_lanczos", "SELECT CAST(i AS INTEGER) AS i, round(CASE WHEN i = 0 THEN 1 WHEN abs(i) >= 300 THEN 0 ELSE 3 * sin(pi() * i / 100.0) * sin(pi() * i / 300.0) / (pi() * i / 100.0 * pi() * i / 100.0) END, 6) + 0.0 AS w FROM range(-320, 321) t(i)")
def p16(spark, d):
    return spark.range(-320, 321).select(F.col("id").cast("int").alias("i"), r6(P.lanczos3(F.col("id") / 100.0)).alias("w"))


@book.add("p17_phase", "SELECT CAST(t AS INTEGER) AS t, round(sin(2 * pi() * t / 90.0), 6) + 0.0 AS hx, round(sin(2 * pi() * t / 90.0), 6) + 0.0 AS cx, round(cos(2 * pi() * t / 90.0), 6) + 0.0 AS cy FROM range(90) t(t)")
def p17(spark, d):
    t = F.col("id") / 90.0
    (hx, _), (cx, cy) = P.phase(t, "horizontal"), P.phase(t, "circular")
    return spark.range(90).select(F.col("id").cast("int").alias("t"), r6(hx).alias("hx"), r6(cx).alias("cx"), r6(cy).alias("cy"))


@book.add("p18_difference", with_views("emb", "SELECT a.stack, a.y, a.x, round(least(greatest(abs(a.v - b.v) * 4, 0), 1), 6) AS v FROM emb a JOIN emb b USING (stack, y, x) WHERE a.frame = 0 AND b.frame = 1"))
def p18(spark, d):
    e = V.emb_stack(spark, d)
    b = e.where("frame = 1").select("stack", "y", "x", F.col("v").alias("w"))
    return e.where("frame = 0").join(b, ["stack", "y", "x"]).select("stack", "y", "x", r6(P.clamp(F.abs(F.col("v") - F.col("w")) * 4)).alias("v"))


def hashed(seed: int, out: str) -> str:
    """SQL of the hash of column id to 0..1: 64-bit products taken in 128 bits."""
    times = lambda a, m: f"CAST(CAST({a} AS UHUGEINT) * {m} % 18446744073709551616 AS UBIGINT)"
    first = seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    return f"{out}a AS (SELECT id, {times(f'xor(CAST({first} AS UBIGINT), CAST(id AS UBIGINT))', 0xBF58476D1CE4E5B9)} AS h FROM ids), {out}b AS (SELECT id, {times('xor(h, h >> 29)', 0x94D049BB133111EB)} AS h FROM {out}a), {out} AS (SELECT id, CAST(xor(h, h >> 32) >> 11 AS DOUBLE) / 9007199254740992.0 AS u FROM {out}b)"


@book.add("p19_hash_noise", f"WITH ids AS (SELECT CAST(i AS BIGINT) AS id FROM range(1000) t(i)), {hashed(42, 'ua')}, {hashed(43, 'va')} SELECT id, round(ua.u, 9) AS u, round(sqrt(-2 * ln(greatest(ua.u, 1e-12))) * cos(2 * pi() * va.u), 9) AS n FROM ua JOIN va USING (id)")
def p19(spark, d):
    import numpy as np
    import pandas as pd

    from ..sources.synth import normal, uniform

    def run(parts):
        for p in parts:
            k = p["id"].to_numpy()
            yield pd.DataFrame({"id": k, "u": np.round(uniform(42, k), 9), "n": np.round(normal(42, k), 9)})

    return spark.range(1000).mapInPandas(run, "id long, u double, n double")


@book.add("f1_coverage", with_views("rgb", "SELECT stack, frame, count(*) AS covered FROM rgb WHERE a > 0 GROUP BY stack, frame"))
def f1(spark, d):
    return V.rgb_stack(spark, d).where("a > 0").groupBy("stack", "frame").agg(F.count(F.lit(1)).alias("covered"))


@book.add("f4_crop", with_views("li", "SELECT frame, y - 3 AS y, x - 2 AS x, round(v, 6) AS v FROM li WHERE y BETWEEN 3 AND 11 AND x BETWEEN 2 AND 12"))
def f4(spark, d):
    from ..operators.registration import cropped

    li = V.li_stack(spark, d)
    box = spark.createDataFrame([(0, 2, 3, 13, 12)], "stack int, x0 int, y0 int, x1 int, y1 int")
    return cropped(li, box).select("frame", "y", "x", r6(F.col("v")).alias("v"))


@book.add("f8_never_focus_cut", with_views("emb", "SELECT stack, round(least(greatest(3 * log2(max(frame) + 1), 6), 32), 6) AS cut FROM frames GROUP BY stack"))
def f8(spark, d):
    n = V.emb_frames(spark, d).groupBy("stack").agg((F.max("frame") + 1).alias("n"))
    return n.select("stack", r6(F.least(F.greatest(3 * F.log2("n"), F.lit(6.0)), F.lit(32.0))).alias("cut"))


@book.add("f10_stride", with_views("emb", "SELECT stack, frame, y, x, round(v, 6) + 0.0 AS v FROM emb WHERE (y * 8 + x) % 7 = 0"))
def f10(spark, d):
    return V.emb_stack(spark, d).where((F.col("y") * 8 + F.col("x")) % 7 == 0).select("stack", "frame", "y", "x", r6(F.col("v")).alias("v"))


@book.add("k2_linear_negative", with_views("rgb", "SELECT stack, frame, y, x, CAST(floor(least(greatest((CASE WHEN r <= 0.04045 THEN r / 12.92 ELSE pow((r + 0.055) / 1.055, 2.4) END) * 0.5, 0), 1) * 65535 + 0.5) AS INTEGER) AS r, CAST(floor((CASE WHEN g <= 0.04045 THEN g / 12.92 ELSE pow((g + 0.055) / 1.055, 2.4) END) * 65535 + 0.5) AS INTEGER) AS g, CAST(floor((CASE WHEN b <= 0.04045 THEN b / 12.92 ELSE pow((b + 0.055) / 1.055, 2.4) END) * 0.8 * 65535 + 0.5) AS INTEGER) AS b FROM rgb"))
def k2(spark, d):
    return project.linear_negative(V.rgb_stack(spark, d), (0.5, 1.0, 0.8))


@book.add("k8_stored", with_views("emb", "SELECT stack, frame, y, x, CAST(floor(least(greatest(v * 64, 0), 65535) + 0.5) AS INTEGER) AS v FROM emb"))
def k8(spark, d):
    return project.stored(V.emb_stack(spark, d), 64.0, ("v",))


@book.add("s11_thumbnail", with_views("li", "SELECT frame, CAST(ty AS INTEGER) AS y, CAST(tx AS INTEGER) AS x, round(v, 6) AS v FROM li, range(5) a(ty), range(6) b(tx) WHERE li.y = ty * 16 // 5 AND li.x = tx * 16 // 6"))
def s11(spark, d):
    return project.preview(V.li_stack(spark, d), 16, 16, 5, 6).select("frame", "y", "x", r6(F.col("v")).alias("v"))


@book.add("k7_rocking_frames", "SELECT CAST(t AS INTEGER) AS t, round(sin(2 * pi() * t / 90.0) * 19.2, 6) + 0.0 AS dx, round(cos(2 * pi() * t / 90.0) * 19.2, 6) + 0.0 AS dy FROM range(90) t(t)")
def k7(spark, d):
    return spark.createDataFrame([(t, round(x, 6) + 0.0, round(y, 6) + 0.0) for t, x, y in project.rocking(90, "circular", 0.01, 1920)], "t int, dx double, dy double")
