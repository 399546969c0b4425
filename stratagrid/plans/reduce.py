"""Queries of the aggregations, joins and windows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pixel as P
from ..operators import aggregate as A
from ..operators import edits as E
from ..operators import join as J
from ..operators import registration as R
from ..operators import window as W
from ..sources import views as V
from .base import Book, r6, with_views

book = Book()
LUM = "0.2126 * r + 0.7152 * g + 0.0722 * b"
POS = "(SELECT stack, frame, y, x, greatest(v, 0) AS v FROM emb)"


def pos(spark, d):
    return V.emb_stack(spark, d).withColumn("v", F.greatest("v", F.lit(0.0)))


def lum(spark, d):
    return V.rgb_stack(spark, d).withColumn("v", P.luminance(F.col("r"), F.col("g"), F.col("b")))


ARGMAX = "SELECT stack, y, x, round(max(v), 6) + 0.0 AS energy, CASE WHEN max(v) > 0 THEN arg_max(frame, (v, -frame)) ELSE 0 END AS frame FROM {src} GROUP BY stack, y, x"


@book.add("a1_winner", with_views("emb", ARGMAX.format(src=POS)))
def a1(spark, d):
    w = A.winner(V.emb_stack(spark, d), "v")
    return w.select("stack", "y", "x", r6(F.col("energy")).alias("energy"), "frame")


@book.add("a1_winner_two_step", with_views("li", ARGMAX.format(src="li")))
def a1b(spark, d):
    w = A.winner_two_step(V.li_stack(spark, d), "v")
    return w.select("stack", "y", "x", r6(F.col("energy")).alias("energy"), "frame")


@book.add("a2_winner_payload", with_views("rgb", f"SELECT stack, y, x, arg_max(frame, (g * a, -frame)) AS frame, round(arg_max({LUM}, (g * a, -frame)), 6) AS guide FROM rgb GROUP BY stack, y, x"))
def a2(spark, d):
    w = A.winner(lum(spark, d), F.col("g") * F.col("a"), {"guide": "v"})
    return w.select("stack", "y", "x", "frame", r6(F.col("guide")).alias("guide"))


@book.add("a3_quantized_winner", with_views("emb", "SELECT stack, y, x, max(q) AS q, CASE WHEN max(q) > 0 THEN arg_max(frame, (q, -frame)) ELSE 0 END AS frame FROM (SELECT *, CAST(floor(least(greatest(v * 65535 / pk, 0), 65535) + 0.5) AS INTEGER) AS q FROM emb, (SELECT max(v) AS pk FROM emb)) GROUP BY stack, y, x"))
def a3(spark, d):
    e = V.emb_stack(spark, d)
    peak = e.agg(F.max("v").alias("pk")).first()["pk"]  # one number
    q = e.withColumn("q", P.quantize(F.col("v"), F.lit(peak).cast("double")))
    return A.winner(q, "q").select("stack", "y", "x", F.col("energy").cast("int").alias("q"), "frame")


DEPTH = "dp AS (SELECT stack, y, x, CAST(arg_max(frame, (g * a, -frame)) AS DOUBLE) AS d FROM rgb GROUP BY stack, y, x)"
TENT = f"""{DEPTH}, sp AS (SELECT stack, min(d) - 1.5 AS lo, max(d) + 1.5 AS hi FROM dp GROUP BY stack),
wt AS (SELECT r.*, (greatest(1 - abs(frame - d) / 1.5, 0) + 1e-6) * a AS w FROM rgb r JOIN dp USING (stack, y, x) JOIN sp USING (stack) WHERE frame > lo AND frame < hi)
SELECT stack, y, x, round(CASE WHEN sum(w) > 1e-7 THEN sum(w * r) / sum(w) ELSE 0 END, 6) AS r, round(CASE WHEN sum(w) > 1e-7 THEN sum(w * g) / sum(w) ELSE 0 END, 6) AS g, round(CASE WHEN sum(w) > 1e-7 THEN sum(w * b) / sum(w) ELSE 0 END, 6) AS b FROM wt GROUP BY stack, y, x"""


@book.add("a4_tent_render", with_views("rgb", TENT, cte=True))
def a4(spark, d):
    px = V.rgb_stack(spark, d)
    depth = A.winner(px, F.col("g") * F.col("a")).select("stack", "y", "x", F.col("frame").cast("double").alias("d"))
    return A.tent_render(px, depth, 1.5).select("stack", "y", "x", *[r6(F.col(c)).alias(c) for c in "rgb"])


MEANS = "ms AS (SELECT stack, frame, sum(r * a) / sum(a) AS r, sum(g * a) / sum(a) AS g, sum(b * a) / sum(a) AS b FROM rgb WHERE (y * 8 + x) % 7 = 0 GROUP BY stack, frame)"
GAINS = MEANS + ", g0 AS (SELECT stack, r AS r0, g AS g0, b AS b0 FROM ms WHERE frame = 0), gn AS (SELECT stack, frame, least(greatest(r0 / r, 0.5), 2) AS gain_r, least(greatest(g0 / g, 0.5), 2) AS gain_g, least(greatest(b0 / b, 0.5), 2) AS gain_b, least(greatest((0.2126 * r0 + 0.7152 * g0 + 0.0722 * b0) / (0.2126 * r + 0.7152 * g + 0.0722 * b), 0.5), 2) AS gain FROM ms JOIN g0 USING (stack))"


@book.add("a5_channel_means", with_views("rgb", MEANS + " SELECT stack, frame, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM ms", cte=True))
def a5(spark, d):
    return A.channel_means(V.rgb_stack(spark, d)).select("stack", "frame", *[r6(F.col(c)).alias(c) for c in "rgb"])


@book.add("a6_exposure_gain", with_views("rgb", GAINS + " SELECT stack, frame, round(gain_r, 6) AS gain_r, round(gain_g, 6) AS gain_g, round(gain_b, 6) AS gain_b, round(gain, 6) AS gain FROM gn", cte=True))
def a6(spark, d):
    g = A.exposure_gain(A.channel_means(V.rgb_stack(spark, d)))
    return g.select("stack", "frame", *[r6(F.col(c)).alias(c) for c in ("gain_r", "gain_g", "gain_b", "gain")])


@book.add("a7_render_gains", with_views("rgb", GAINS + ", gm AS (SELECT stack, exp(avg(ln(gain_r))) AS mr, exp(avg(ln(gain_g))) AS mg, exp(avg(ln(gain_b))) AS mb FROM gn GROUP BY stack) SELECT stack, frame, round(gain_r / mr, 6) AS gain_r, round(gain_g / mg, 6) AS gain_g, round(gain_b / mb, 6) AS gain_b FROM gn JOIN gm USING (stack)", cte=True))
def a7(spark, d):
    g = A.render_gains(A.exposure_gain(A.channel_means(V.rgb_stack(spark, d))))
    return g.select("stack", "frame", *[r6(F.col(c)).alias(c) for c in ("gain_r", "gain_g", "gain_b")])


@book.add("a8_box_down", with_views("li", "SELECT frame, y // 3 AS y, x // 3 AS x, round(avg(v), 6) AS v FROM li GROUP BY frame, y // 3, x // 3"))
def a8(spark, d):
    return A.box_down(V.li_stack(spark, d), 3).select("frame", "y", "x", r6(F.col("v")).alias("v"))


@book.add("a9_max_pool", with_views("emb", "SELECT stack, frame, y // 3 AS y, x // 3 AS x, round(greatest(max(v), 0), 6) + 0.0 AS v FROM emb GROUP BY stack, frame, y // 3, x // 3"))
def a9(spark, d):
    return A.box_down(V.emb_stack(spark, d), 3, how="max").select("stack", "frame", "y", "x", r6(F.col("v")).alias("v"))


@book.add("a10_pooled_energy", with_views("rgb", "SELECT stack, frame, y // 4 AS cy, x // 4 AS cx, round(avg(r * r + g * g + b * b), 6) AS e FROM rgb GROUP BY stack, frame, y // 4, x // 4"))
def a10(spark, d):
    px = V.rgb_stack(spark, d).withColumn("v", F.col("r") ** 2 + F.col("g") ** 2 + F.col("b") ** 2)
    return A.box_down(px, 4).select("stack", "frame", F.col("y").alias("cy"), F.col("x").alias("cx"), r6(F.col("v")).alias("e"))


@book.add("a11_extremes", with_views("emb", "SELECT stack, y, x, round(min(v), 6) + 0.0 AS lo, round(max(v), 6) + 0.0 AS hi, arg_min(frame, (v, frame)) AS darkest, round(max(v) - min(v), 6) AS span FROM emb GROUP BY stack, y, x"))
def a11(spark, d):
    return A.extremes(V.emb_stack(spark, d)).select("stack", "y", "x", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), "darkest", r6(F.col("span")).alias("span"))


@book.add("a12_cell_tables", with_views("emb", "c AS (SELECT stack, frame, y // 2 AS cy, x // 2 AS cx, sum(greatest(v, 0)) AS e FROM emb GROUP BY ALL) SELECT stack, cy, cx, round(max(e), 6) AS hi, round(min(e), 6) AS lo, arg_max(frame, (e, -frame)) AS frame FROM c GROUP BY stack, cy, cx", cte=True))
def a12(spark, d):
    c = pos(spark, d).groupBy("stack", "frame", F.floor(F.col("y") / 2).cast("int").alias("cy"), F.floor(F.col("x") / 2).cast("int").alias("cx")).agg(F.sum("v").alias("e"))
    return c.groupBy("stack", "cy", "cx").agg(r6(F.max("e")).alias("hi"), r6(F.min("e")).alias("lo"), F.max_by("frame", F.struct(F.col("e"), -F.col("frame"))).alias("frame"))


ORDER = "(SELECT stack, v, row_number() OVER (PARTITION BY stack ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY stack) AS n FROM emb)"


@book.add("a13_percentiles", with_views("emb", f"SELECT stack, round(max(CASE WHEN r = least(CAST(floor(n * 0.95) AS BIGINT), n - 1) THEN v END), 6) AS p95, round(max(CASE WHEN r = CAST(floor((n - 1) * 0.98) AS BIGINT) THEN v END), 6) AS p98 FROM {ORDER} GROUP BY stack"))
def a13(spark, d):
    e = V.emb_stack(spark, d)
    a = A.order_statistic(e, "v", 0.95, ["stack"]).select("stack", r6(F.col("q")).alias("p95"))
    return a.join(A.order_statistic(e, "v", 0.98, ["stack"], "gap").select("stack", r6(F.col("q")).alias("p98")), "stack")


LINR = "CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END"


@book.add("a14_veil", with_views("rgb", "SELECT stack, " + ", ".join(f"round(max(CASE WHEN k_{c} = n // 2 THEN {LINR.format(c=c)} END), 6) AS veil_{c}" for c in "rgb") + " FROM (SELECT *, count(*) OVER (PARTITION BY stack) AS n, " + ", ".join(f"row_number() OVER (PARTITION BY stack ORDER BY {c}) - 1 AS k_{c}" for c in "rgb") + " FROM rgb WHERE frame = 3) GROUP BY stack"))
def a14(spark, d):
    img = V.rgb_stack(spark, d).where("frame = 3").withColumn("i", F.col("y") * 8 + F.col("x")).withColumn("n", F.lit(64))
    return A.veil(img).select("stack", *[r6(F.col(f"veil_{c}")).alias(f"veil_{c}") for c in "rgb"])


ENC = "CASE WHEN {c} <= 0.0031308 THEN ({c}) * 12.92 ELSE 1.055 * pow(greatest({c}, 0.0031308), 1 / 2.4) - 0.055 END"
VEIL = "dk AS (SELECT stack, y, x, r * 0.05 AS r, g * 0.05 AS g, b * 0.05 AS b FROM rgb WHERE frame = 3), kk AS (SELECT *, " + ", ".join(f"row_number() OVER (PARTITION BY stack ORDER BY {c}) - 1 AS k_{c}" for c in "rgb") + " FROM dk), ve AS (SELECT stack, " + ", ".join(f"max(CASE WHEN k_{c} = 32 THEN {LINR.format(c=c)} END) AS v{c}" for c in "rgb") + " FROM kk GROUP BY stack), ga AS (SELECT *, least(greatest((greatest(" + ", ".join(ENC.format(c=f"v{c}") for c in "rgb") + ") - 0.02) / 0.04, 0), 1) AS t FROM ve), am AS (SELECT *, CASE WHEN 1 - t * t * (3 - 2 * t) > 0.001 THEN 1 - t * t * (3 - 2 * t) ELSE 0 END AS am FROM ga), sb AS (SELECT stack, y, x, am, r, g, b, " + ", ".join(f"greatest({LINR.format(c=c)} - v{c} * am, 0) AS s{c}" for c in "rgb") + " FROM dk JOIN am USING (stack)) SELECT stack, y, x, " + ", ".join(f"round(CASE WHEN am > 0 THEN {ENC.format(c='s' + c)} ELSE {c} END, 6) AS {c}" for c in "rgb") + " FROM sb"


@book.add("p8_black_point", with_views("rgb", VEIL, cte=True))
def p8(spark, d):
    img = V.rgb_stack(spark, d).where("frame = 3").withColumn("i", F.col("y") * 8 + F.col("x")).withColumn("n", F.lit(64))
    img = img.withColumns({c: F.col(c) * 0.05 for c in "rgb"})
    return A.black_point(img).select("stack", "y", "x", *[r6(F.col(c)).alias(c) for c in "rgb"])


@book.add("a15_upper_median", with_views("emb", "SELECT stack, y, x, round(max(CASE WHEN r = n // 2 THEN v END), 6) + 0.0 AS med FROM (SELECT stack, y, x, v, row_number() OVER (PARTITION BY stack, y, x ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY stack, y, x) AS n FROM emb) GROUP BY stack, y, x"))
def a15(spark, d):
    return A.upper_median(V.emb_stack(spark, d), "v", ["stack", "y", "x"]).select("stack", "y", "x", r6(F.col("q")).alias("med"))


CURVE = f"""pv AS {POS}, kv AS (SELECT *, row_number() OVER (PARTITION BY stack, y, x ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY stack, y, x) AS n FROM pv),
st AS (SELECT stack, y, x, max(n) AS n, max(CASE WHEN r = n // 2 THEN v END) AS med, CASE WHEN max(v) > 0 THEN arg_max(frame, (v, -frame)) ELSE 0 END AS peak, greatest(2, max(n) // 16) AS win FROM kv GROUP BY stack, y, x),
cv AS (SELECT stack, y, x, any_value(peak) AS peak, any_value(st.n) AS n, sum(greatest(v - med, 0)) AS total, sum(CASE WHEN abs(frame - peak) <= win THEN greatest(v - med, 0) ELSE 0 END) AS near FROM pv JOIN st USING (stack, y, x) GROUP BY stack, y, x)"""


@book.add("a16_concentration", with_views("emb", CURVE + " SELECT stack, y, x, peak, round(CASE WHEN n > 2 AND total > 1e-9 THEN near / total ELSE 1 END, 6) AS concentration FROM cv", cte=True))
def a16(spark, d):
    return A.curve_stats(pos(spark, d)).select("stack", "y", "x", "peak", r6(F.col("concentration")).alias("concentration"))


@book.add("a17_scored_curves", with_views("emb", CURVE + " SELECT stack, y, x, CASE WHEN total > 1e-9 AND near / total >= 0.3 THEN peak END AS depth, round(CASE WHEN total > 1e-9 AND near / total >= 0.3 THEN near / total END, 6) AS concentration FROM cv", cte=True))
def a17(spark, d):
    return A.scored_curves(pos(spark, d), 0.3).select("stack", "y", "x", "depth", r6(F.col("concentration")).alias("concentration"))


WMED = f"""bs AS (SELECT stack, y, x, CAST(CASE WHEN max(v) > 0 THEN arg_max(frame, (v, -frame)) ELSE 0 END AS DOUBLE) AS d, max(v) * 2 AS c, count(*) AS n FROM {POS} GROUP BY stack, y, x),
nb AS (SELECT a.stack, a.y, a.x, any_value(a.n) AS n, CAST(least(greatest(floor(b.d + 0.5), 0), a.n - 1) AS INTEGER) AS bin, sum(b.c) AS w
 FROM bs a, range(-4, 5) p(dy), range(-4, 5) q(dx), bs b WHERE b.stack = a.stack AND b.y = least(greatest(a.y + dy, 0), 7) AND b.x = least(greatest(a.x + dx, 0), 7) AND b.c > 1e-3 GROUP BY a.stack, a.y, a.x, a.n, bin),
ac AS (SELECT *, sum(w) OVER (PARTITION BY stack, y, x ORDER BY bin) AS acc, sum(w) OVER (PARTITION BY stack, y, x) AS total FROM nb),
mm AS (SELECT stack, y, x, min(bin) AS m FROM ac WHERE acc >= total * 0.5 GROUP BY stack, y, x),
ag AS (SELECT ac.stack, ac.y, ac.x, sum(CASE WHEN abs(bin - m) <= greatest(2, n // 16) THEN w ELSE 0 END) / any_value(total) AS consensus, max(CASE WHEN bin = m THEN m - 0.5 + least(greatest((total * 0.5 - (acc - w)) / greatest(w, 1e-9), 0), 1) END) AS d FROM ac JOIN mm USING (stack, y, x) GROUP BY ac.stack, ac.y, ac.x)
SELECT stack, y, x, round(coalesce(ag.d, bs.d), 5) AS d, round(coalesce(consensus, 0), 5) AS consensus FROM bs LEFT JOIN ag USING (stack, y, x)"""


@book.add("a18_weighted_median", with_views("emb", WMED, cte=True))
def a18(spark, d):
    e = pos(spark, d)
    w = A.winner(e, "v").select("stack", "y", "x", F.col("frame").cast("double").alias("d"), (F.col("energy") * 2).alias("c"))
    n = e.groupBy("stack").agg(F.countDistinct("frame").alias("n"))
    return A.weighted_median(w, n, 4, 8, 8).select("stack", "y", "x", r6(F.col("d"), 5).alias("d"), r6(F.col("consensus"), 5).alias("consensus"))


@book.add("a19_region_scores", with_views("emb", f"SELECT stack, frame, round(sum(v), 6) AS score FROM {POS} WHERE (y - 3) * (y - 3) + (x - 4) * (x - 4) <= 6.25 GROUP BY stack, frame"))
def a19(spark, d):
    return A.region_scores(pos(spark, d), 3, 4, 2.5).select("stack", "frame", r6(F.col("score")).alias("score"))


VOTE = f"bs AS (SELECT stack, y, x, CASE WHEN max(v) > 0 THEN arg_max(frame, (v, -frame)) ELSE 0 END AS d FROM {POS} GROUP BY stack, y, x), vt AS (SELECT stack, d // 8 AS depth, count(*) AS votes FROM bs WHERE (y - 3) * (y - 3) + (x - 4) * (x - 4) <= 16 GROUP BY stack, d // 8) SELECT stack, depth, votes FROM (SELECT *, row_number() OVER (PARTITION BY stack ORDER BY votes DESC, depth) AS r FROM vt) WHERE r = 1"


@book.add("a20_depth_vote", with_views("emb", VOTE, cte=True))
def a20(spark, d):
    w = A.winner(pos(spark, d), "v").select("stack", "y", "x", F.floor(F.col("frame") / 8).cast("double").alias("d"))
    return A.depth_vote(w, 3, 4, 4).drop("_r")


@book.add("a24_psnr", with_views("rgb", "SELECT a.stack, round(-10 * log10(avg(((a.r - b.r) * (a.r - b.r) + (a.g - b.g) * (a.g - b.g) + (a.b - b.b) * (a.b - b.b)) / 3)), 6) AS psnr FROM rgb a JOIN rgb b USING (stack, y, x) WHERE a.frame = 0 AND b.frame = 1 AND y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 GROUP BY a.stack"))
def a24(spark, d):
    px = V.rgb_stack(spark, d)
    return A.psnr(px.where("frame = 0"), px.where("frame = 1"), 1, 8, 8).select("stack", r6(F.col("psnr")).alias("psnr"))


@book.add("a25_best_offset", with_views("emb", "SELECT stack, dy, dx, round(-10 * log10(mse), 6) AS psnr FROM (SELECT stack, arg_min(dy, (mse, dy, dx)) AS dy, arg_min(dx, (mse, dy, dx)) AS dx, min(mse) AS mse FROM (SELECT a.stack, CAST(dy AS INTEGER) AS dy, CAST(dx AS INTEGER) AS dx, round(avg((a.v - b.v) * (a.v - b.v)), 12) AS mse FROM emb a, range(-2, 3) p(dy), range(-2, 3) q(dx), emb b WHERE a.frame = 0 AND b.frame = 1 AND a.stack = b.stack AND b.y = a.y + dy AND b.x = a.x + dx AND a.y BETWEEN 2 AND 5 AND a.x BETWEEN 2 AND 5 GROUP BY a.stack, dy, dx) GROUP BY stack)"))
def a25(spark, d):
    e = V.emb_stack(spark, d)
    return A.best_offset_psnr(e.where("frame = 0"), e.where("frame = 1"), 2, 8, 8).select("stack", "dy", "dx", r6(F.col("psnr")).alias("psnr"))


@book.add("a26_gray_stats", with_views("rgb", f"SELECT stack, frame, round(avg({LUM}) * 255, 6) AS lum_mean FROM rgb GROUP BY stack, frame"))
def a26(spark, d):
    return R.gray_stats(lum(spark, d)).select("stack", "frame", r6(F.col("lum_mean")).alias("lum_mean"))


@book.add("a26_histogram_percentile", with_views("emb", "h AS (SELECT stack, CAST(least(greatest(floor(abs(v) * 256 / 0.6), 0), 255) AS INTEGER) AS bin, count(*) AS n FROM emb GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY stack ORDER BY bin DESC) AS c, sum(n) OVER (PARTITION BY stack) AS t FROM h) SELECT stack, round(max(bin) * (0.6 / 256), 6) AS q FROM c WHERE c > t * 0.01 GROUP BY stack", cte=True))
def a26b(spark, d):
    e = V.emb_stack(spark, d).withColumn("v", F.abs("v"))
    return A.histogram_percentile(e, "v", 0.99, 256, 0.6, ["stack"]).select("stack", r6(F.col("q")).alias("q"))


@book.add("a27_pair_residual", with_views("emb", "SELECT a.stack, a.frame, b.frame AS other, round(CASE WHEN count(*) > 20 THEN avg(abs(a.v - b.v)) * 255 ELSE CAST('Infinity' AS DOUBLE) END, 6) AS residual FROM emb a JOIN emb b ON a.stack = b.stack AND b.frame = a.frame + 1 AND b.y = a.y + 1 AND b.x = a.x - 1 GROUP BY a.stack, a.frame, b.frame"))
def a27(spark, d):
    e = V.emb_stack(spark, d)
    p = J.adjacent_pairs(V.emb_frames(spark, d).select("stack", "frame")).withColumn("dy", F.lit(1)).withColumn("dx", F.lit(-1))
    return R.pair_residual(e, p, least=20).select("stack", "frame", "other", r6(F.col("residual")).alias("residual"))


@book.add("r3_exposure_outliers", with_views("rgb", f"m AS (SELECT stack, frame, avg(({LUM}) * CASE WHEN frame % 13 = 5 THEN 0.4 WHEN frame % 17 = 3 THEN 2.5 ELSE 1 END) * 255 AS l FROM rgb GROUP BY stack, frame), k AS (SELECT *, row_number() OVER (PARTITION BY stack ORDER BY l) - 1 AS r, count(*) OVER (PARTITION BY stack) AS n FROM m), md AS (SELECT stack, greatest(max(CASE WHEN r = n // 2 THEN l END), 0.25) AS md FROM k GROUP BY stack) SELECT stack, frame, 'exposureOutlier' AS kind, round(l / md, 6) AS magnitude FROM m JOIN md USING (stack) WHERE l / md < 0.5 OR l / md > 2", cte=True))
def r3(spark, d):
    f = F.col("frame")
    k = F.when(f % 13 == 5, 0.4).when(f % 17 == 3, 2.5).otherwise(1.0)
    g = R.gray_stats(lum(spark, d).withColumn("v", F.col("v") * k))
    return R.exposure_outliers(g).select("stack", "frame", "kind", r6(F.col("magnitude")).alias("magnitude"))


@book.add("j3_band_join", with_views("emb", f"bs AS (SELECT stack, y, x, CAST(CASE WHEN max(v) > 0 THEN arg_max(frame, (v, -frame)) ELSE 0 END AS DOUBLE) + 0.25 AS d FROM {POS} GROUP BY stack, y, x) SELECT stack, y, x, frame FROM bs JOIN frames USING (stack) WHERE abs(frame - d) < 2.5", cte=True))
def j3(spark, d):
    w = A.winner(pos(spark, d), "v").select("stack", "y", "x", (F.col("frame") + 0.25).alias("d"))
    return J.band_join(w, V.emb_frames(spark, d).select("stack", "frame"), 2.5).select("stack", "y", "x", "frame")


@book.add("j6_adjacent_pairs", with_views("emb", "SELECT stack, frame, frame + 1 AS other FROM frames WHERE (stack, frame + 1) IN (SELECT stack, frame FROM frames)"))
def j6(spark, d):
    return J.adjacent_pairs(V.emb_frames(spark, d).select("stack", "frame"))


@book.add("j7_nearest_survivor", with_views("emb", "s AS (SELECT stack, frame FROM frames WHERE frame % 5 IN (1, 4)) SELECT f.stack, f.frame, arg_min(s.frame, (abs(s.frame - f.frame), s.frame)) AS nearest FROM frames f JOIN s ON s.stack = f.stack GROUP BY f.stack, f.frame", cte=True))
def j7(spark, d):
    f = V.emb_frames(spark, d).select("stack", "frame")
    return J.nearest_survivor(f, f.where((F.col("frame") % 5).isin(1, 4)))


@book.add("j8_from_grid", with_views("emb", """g AS (SELECT stack, frame, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM emb GROUP BY ALL),
p AS (SELECT stack, frame, y, x, least(greatest((y + 0.5) / 2 - 0.5, 0), 3) AS gy, least(greatest((x + 0.5) / 2 - 0.5, 0), 3) AS gx FROM emb),
t AS (SELECT p.*, CAST(floor(gy) AS INTEGER) + i AS ty, CAST(floor(gx) AS INTEGER) + j AS tx, (CASE WHEN i = 1 THEN gy - floor(gy) ELSE 1 - (gy - floor(gy)) END) * (CASE WHEN j = 1 THEN gx - floor(gx) ELSE 1 - (gx - floor(gx)) END) AS w FROM p, range(2) a(i), range(2) b(j))
SELECT t.stack, t.frame, t.y, t.x, round(sum(w * g.v), 6) + 0.0 AS v FROM t JOIN g ON g.stack = t.stack AND g.frame = t.frame AND g.y = least(t.ty, 3) AND g.x = least(t.tx, 3) GROUP BY t.stack, t.frame, t.y, t.x""", cte=True))
def j8(spark, d):
    e = V.emb_stack(spark, d)
    g = A.box_down(e, 2)
    px = e.select("stack", "frame", "y", "x")
    return J.from_grid(px, g, 2, 4, 4, key=("stack", "frame")).select("stack", "frame", "y", "x", r6(F.col("v")).alias("v"))


@book.add("j10_without_flagged", with_views("emb", "SELECT stack, frame FROM frames WHERE frame % 7 <> 3"))
def j10(spark, d):
    f = V.emb_frames(spark, d).select("stack", "frame")
    return J.without_flagged(f, f.where("frame % 7 = 3"))


@book.add("j11_alignment_key", with_views("emb", "SELECT stack, sha256(string_agg(CAST(frame * 3 AS VARCHAR), chr(10) ORDER BY frame)) AS key FROM frames GROUP BY stack"))
def j11(spark, d):
    f = V.emb_frames(spark, d).select("stack", "frame", (F.col("frame") * 3).alias("p"))
    return J.alignment_key(f, "p")


@book.add("w1_gap_split", "WITH c AS (SELECT user_id AS folder, event_id AS name, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS f FROM events) SELECT folder, name, CAST(sum(f) OVER (PARTITION BY folder ORDER BY ts, name) AS INTEGER) AS session FROM c")
def w1(spark, d):
    return W.split_by_gap(V.capture(spark, d), 6 * 3600.0).select("folder", "name", "session")


CAPT = "WITH c AS (SELECT user_id AS folder, event_id AS name, CASE WHEN event_id % 97 <> 0 THEN ts END AS ts FROM events), u AS (SELECT *, bool_or(ts IS NULL) OVER (PARTITION BY folder) AS u FROM c)"


def undated(spark, d):
    return V.capture(spark, d).withColumn("ts", F.when(F.col("name") % 97 != 0, F.col("ts")))


@book.add("w2_frame_order", CAPT + " SELECT folder, name, CAST(row_number() OVER (PARTITION BY folder ORDER BY CASE WHEN NOT u THEN ts END NULLS FIRST, name) - 1 AS INTEGER) AS pos FROM u")
def w2(spark, d):
    return W.frame_order(undated(spark, d)).select("folder", "name", "pos")


@book.add("w3_order_issue", CAPT + ", r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY name) AS n, row_number() OVER (PARTITION BY folder ORDER BY ts NULLS FIRST, name) AS t FROM c) SELECT folder, CASE WHEN bool_or(ts IS NULL) THEN 'undated' WHEN bool_or(n <> t) THEN 'mismatch' ELSE 'none' END AS issue FROM r GROUP BY folder")
def w3(spark, d):
    return W.order_issue(undated(spark, d))


@book.add("w4_disambiguated", "SELECT p_partkey, CASE WHEN n = 1 THEN p_brand ELSE p_brand || ' (' || n || ')' END AS label FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)")
def w4(spark, d):
    return W.disambiguated(V.load(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey").select("p_partkey", "label")


@book.add("w6_suspicion", with_views("emb", "p AS (SELECT stack, frame, frame % 4 < 2 AS bad FROM frames WHERE (stack, frame + 1) IN (SELECT stack, frame FROM frames)) SELECT stack, frame, sum(CAST(bad AS INTEGER)) AS bad_pairs FROM (SELECT stack, frame, bad FROM p UNION ALL SELECT stack, frame + 1, bad FROM p) GROUP BY stack, frame", cte=True))
def w6(spark, d):
    p = J.adjacent_pairs(V.emb_frames(spark, d).select("stack", "frame")).withColumn("bad", F.col("frame") % 4 < 2)
    return W.suspicion(p)


@book.add("w7_summed_area", with_views("li", "SELECT a.frame, a.y, a.x, round(sum(b.v), 6) AS sat FROM li a JOIN li b ON a.frame = b.frame AND b.y <= a.y AND b.x <= a.x GROUP BY a.frame, a.y, a.x"))
def w7(spark, d):
    return W.summed_area(V.li_stack(spark, d), key=("stack", "frame")).select("frame", "y", "x", r6(F.col("sat")).alias("sat"))


@book.add("w8_box_mean", with_views("emb", "SELECT a.stack, a.frame, a.y, a.x, round(avg(b.v), 6) + 0.0 AS mean FROM emb a JOIN emb b ON a.stack = b.stack AND a.frame = b.frame AND b.y BETWEEN a.y - 2 AND a.y + 2 AND b.x BETWEEN a.x - 2 AND a.x + 2 GROUP BY ALL"))
def w8(spark, d):
    e = V.emb_stack(spark, d)
    return W.box_mean(e, 2, key=("stack", "frame")).select("stack", "frame", "y", "x", r6(F.col("mean")).alias("mean"))


@book.add("w11_top_frames", with_views("emb", f"w AS (SELECT stack, y, x, max(v) AS e, CASE WHEN max(v) > 0 THEN arg_max(frame, (v, -frame)) ELSE 0 END AS frame FROM {POS} GROUP BY stack, y, x), g AS (SELECT stack, frame, round(sum(e), 9) AS m FROM w GROUP BY stack, frame) SELECT stack, frame, round(m, 6) AS mass, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY stack ORDER BY m DESC, frame) AS r FROM g) WHERE r <= 8", cte=True))
def w11(spark, d):
    t = W.top_frames(A.winner(pos(spark, d), "v"), "energy")
    return t.select("stack", "frame", r6(F.col("mass")).alias("mass"), "rank")


@book.add("u1_stamp", with_views("emb", "t AS (SELECT a.stack, a.y, a.x, a.v AS v, b.v AS s, sqrt((a.y - 3) * (a.y - 3) + (a.x - 4) * (a.x - 4)) AS q FROM emb a JOIN emb b USING (stack, y, x) WHERE a.frame = 0 AND b.frame = 1), k AS (SELECT *, least(greatest((q - 1.5) / 1.5, 0), 1) AS t FROM t), al AS (SELECT *, CASE WHEN q <= 3 THEN 1 - t * t * (3 - 2 * t) ELSE 0 END AS al FROM k) SELECT stack, y, x, round(CASE WHEN al > 0.003 THEN v + (s - v) * al ELSE v END, 6) + 0.0 AS v FROM al", cte=True))
def u1(spark, d):
    e = V.emb_stack(spark, d)
    return E.stamp(e.where("frame = 0").drop("frame"), e.where("frame = 1"), 3, 4, 3.0).select("stack", "y", "x", r6(F.col("v")).alias("v"))


@book.add("u3_replay", with_views("emb", "SELECT stack, y, x, round(coalesce(arg_max(CASE WHEN frame > 0 THEN v END, frame) FILTER (WHERE frame > 0 AND frame % 4 <> 3 AND (x + y + frame) % 3 = 0), max(CASE WHEN frame = 0 THEN v END)), 6) + 0.0 AS v FROM emb GROUP BY stack, y, x"))
def u3(spark, d):
    e = V.emb_stack(spark, d)
    log = e.where("frame > 0 AND (x + y + frame) % 3 = 0").select(F.col("frame").alias("edit"), (F.col("frame") % 4 == 3).alias("undone"), "stack", "y", "x", "v")
    return E.replay(e.where("frame = 0").drop("frame"), log).select("stack", "y", "x", r6(F.col("v")).alias("v"))


@book.add("u4_sharpest", with_views("emb", f"s AS (SELECT stack, frame, round(sum(v), 12) AS s FROM {POS} WHERE (y - 3) * (y - 3) + (x - 4) * (x - 4) <= 4 GROUP BY stack, frame) SELECT stack, arg_max(frame, (s, -frame)) AS frame, round(max(s), 6) AS score FROM s GROUP BY stack HAVING max(s) > 0", cte=True))
def u4(spark, d):
    return E.sharpest(pos(spark, d), 3, 4, 2.0).select("stack", "frame", r6(F.col("score")).alias("score"))


def plane(spark, d, frame, name="v"):
    return V.emb_stack(spark, d).where(F.col("frame") == frame).select("stack", "y", "x", F.col("v").alias(name))


@book.add("j1_pixel_join", with_views("emb", "SELECT a.stack, a.y, a.x, round(a.v, 6) + 0.0 AS v, round(b.v, 6) + 0.0 AS w FROM emb a JOIN emb b USING (stack, y, x) WHERE a.frame = 0 AND b.frame = 1"))
def j1(spark, d):
    return J.pixel_join(plane(spark, d, 0), plane(spark, d, 1, "w")).select("stack", "y", "x", r6(F.col("v")).alias("v"), r6(F.col("w")).alias("w"))


@book.add("j2_frame_params", with_views("emb", "SELECT stack, frame, y, x, round(v * (1 + frame * 0.01), 6) + 0.0 AS v FROM emb"))
def j2(spark, d):
    params = V.emb_frames(spark, d).select("stack", "frame", (1 + F.col("frame") * 0.01).alias("gain"))
    return J.with_frame_params(V.emb_stack(spark, d), params).select("stack", "frame", "y", "x", r6(F.col("v") * F.col("gain")).alias("v"))


@book.add("j9_label_stats", with_views("emb", "l AS (SELECT stack, y, x, v, (y // 4) * 2 + x // 4 + 1 AS label FROM emb WHERE frame = 0), s AS (SELECT stack, label, count(*) AS cells, avg(v) AS mean FROM l GROUP BY stack, label) SELECT stack, y, x, CAST(label AS INTEGER) AS label, cells, round(mean, 6) + 0.0 AS mean FROM l JOIN s USING (stack, label)", cte=True))
def j9(spark, d):
    lab = plane(spark, d, 0).withColumn("label", (F.floor(F.col("y") / 4) * 2 + F.floor(F.col("x") / 4) + 1).cast("int"))
    stats = lab.groupBy("stack", "label").agg(F.count(F.lit(1)).alias("cells"), F.avg("v").alias("mean"))
    return J.with_label_stats(lab.drop("v"), stats).select("stack", "y", "x", "label", "cells", r6(F.col("mean")).alias("mean"))


@book.add("u5_merge_depth", with_views("emb", "SELECT a.stack, a.y, a.x, round(CASE WHEN (a.x + a.y) % 3 = 0 AND a.y < 4 THEN b.v ELSE a.v END, 6) + 0.0 AS d FROM emb a JOIN emb b USING (stack, y, x) WHERE a.frame = 0 AND b.frame = 1"))
def u5(spark, d):
    """Every third pixel edited, the lower half reverted."""
    edited = plane(spark, d, 1, "d").where("(x + y) % 3 = 0")
    left = E.revert_depth(edited, edited.where("y >= 4"))
    return E.merge_depth(plane(spark, d, 0, "d"), left).select("stack", "y", "x", r6(F.col("d")).alias("d"))


@book.add("u7_stale", with_views("emb", "s AS (SELECT DISTINCT stack FROM frames) SELECT stack, stack % 4 = 0 OR stack % 2 = 1 AS stale FROM s", cte=True))
def u7(spark, d):
    s = V.emb_frames(spark, d).select("stack").distinct()
    stored = s.where("stack % 4 <> 0").select("stack", F.md5(F.col("stack").cast("string")).alias("hash"))
    return E.stale(stored, s.select("stack", F.md5((F.col("stack") + F.col("stack") % 2).cast("string")).alias("hash")))


@book.add("u8_batch", with_views("emb", "SELECT stack, y, x, round(max(v), 6) + 0.0 AS hi FROM emb WHERE stack % 2 = 0 GROUP BY stack, y, x"))
def u8(spark, d):
    e = V.emb_stack(spark, d)
    stacks = V.emb_frames(spark, d).select("stack").distinct().withColumn("enabled", F.col("stack") % 2 == 0)
    return E.batch(e, stacks, A.extremes).select("stack", "y", "x", r6(F.col("hi")).alias("hi"))


@book.add("u9_admitted", "SELECT c_custkey AS stack, CAST(c_custkey * 13 % 9000 AS BIGINT) * (c_custkey * 7 % 9000) * 150 + 2147483648 <= 4294967296 AS admitted FROM customer")
def u9(spark, d):
    c = V.load(spark, d, "customer")
    s = c.select(F.col("c_custkey").alias("stack"), (F.col("c_custkey") * 13 % 9000).cast("int").alias("height"), (F.col("c_custkey") * 7 % 9000).cast("int").alias("width"))
    return E.admitted(s, 4 << 30).select("stack", "admitted")


@book.add("a31_status_counts", "SELECT count(*) FILTER (WHERE o_orderstatus <> 'F' AND NOT o_orderpriority = '1-URGENT') AS pending, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS fused FROM orders")
def a31(spark, d):
    o = V.load(spark, d, "orders").select((F.col("o_orderstatus") != "F").alias("enabled"), (F.col("o_orderpriority") == "1-URGENT").alias("fused"))
    return E.status_counts(o)
