"""Queries of the fusion drivers and their parts: stacks with excluded frames, tiles, matching, searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pixel as P
from ..operators import aggregate as A
from ..operators import dmap as D
from ..operators import edits as E
from ..operators import matching as MT
from ..operators import pmax as M
from ..operators import pyramid_tiles as PT
from ..operators import registration as R
from ..operators import stencil as S
from ..sources import views as V
from .base import Book, r6, taps, with_views
from .spatial import LAP

book = Book()
PX = ["stack", "y", "x"]


def kept_frames(spark, d):
    """Stacks of colours of which every third frame, the first included, was excluded."""
    return V.rgb_stack(spark, d).where("frame % 3 <> 0")


LUMA = "0.2126 * {0} + 0.7152 * {1} + 0.0722 * {2}"
#: Kept frames numbered from 0, gains against the first of them, render gains.
KEPT = f"""px AS MATERIALIZED (SELECT stack, CAST(dense_rank() OVER (PARTITION BY stack ORDER BY frame) - 1 AS INTEGER) AS frame, frame AS own, y, x, r, g, b, a FROM rgb WHERE frame % 3 <> 0),
ms AS (SELECT stack, frame, sum(r * a) / sum(a) AS r, sum(g * a) / sum(a) AS g, sum(b * a) / sum(a) AS b FROM px WHERE (y * 8 + x) % 7 = 0 GROUP BY stack, frame),
m0 AS (SELECT stack, r AS r0, g AS g0, b AS b0 FROM ms WHERE frame = 0),
gn AS (SELECT stack, frame, least(greatest(r0 / r, 0.5), 2) AS kr, least(greatest(g0 / g, 0.5), 2) AS kg, least(greatest(b0 / b, 0.5), 2) AS kb, least(greatest(({LUMA.format('r0', 'g0', 'b0')}) / ({LUMA.format('r', 'g', 'b')}), 0.5), 2) AS k FROM ms JOIN m0 USING (stack)),
gm AS (SELECT stack, exp(avg(ln(kr))) AS mr, exp(avg(ln(kg))) AS mg, exp(avg(ln(kb))) AS mb, greatest(max(kr) - min(kr), max(kg) - min(kg), max(kb) - min(kb)) AS s FROM gn GROUP BY stack),
nx AS (SELECT stack, frame, own, y, x, a, CASE WHEN s < 0.001 THEN r ELSE r * kr / mr END AS r, CASE WHEN s < 0.001 THEN g ELSE g * kg / mg END AS g, CASE WHEN s < 0.001 THEN b ELSE b * kb / mb END AS b FROM px JOIN gn USING (stack, frame) JOIN gm USING (stack)),
lm AS (SELECT stack, frame, y, x, k * ({LUMA.format('r', 'g', 'b')}) AS v FROM px JOIN gn USING (stack, frame)),
lp AS ({LAP.format(src='lm')}),
dp AS (SELECT stack, y, x, CASE WHEN max(e * a) > 0 THEN arg_max(frame, (e * a, -frame)) ELSE 0 END AS d FROM lp JOIN px USING (stack, frame, y, x) GROUP BY stack, y, x),
sp AS (SELECT stack, min(d) - 1.0 AS lo, max(d) + 1.0 AS hi FROM dp GROUP BY stack),
wt AS (SELECT n.*, d, (greatest(1 - abs(frame - d), 0) + 1e-6) * a AS w FROM nx n JOIN dp USING (stack, y, x) JOIN sp USING (stack) WHERE frame > lo AND frame < hi),
nm AS (SELECT DISTINCT stack, frame AS d, own FROM px)
SELECT stack, y, x, d, nm.own AS kept, round(sum(w * r) / sum(w), 6) + 0.0 AS r, round(sum(w * g) / sum(w), 6) + 0.0 AS g, round(sum(w * b) / sum(w), 6) + 0.0 AS b FROM wt JOIN nm USING (stack, d) GROUP BY stack, y, x, d, nm.own"""


@book.add("f2_fuse_without_excluded", with_views("rgb", KEPT, cte=True))
def f2(spark, d):
    """Depth from focus of what an exclusion leaves, exposure levelled: no stack has a frame 0, all have gaps."""
    px = kept_frames(spark, d)
    image, depth = D.fuse(px, 8, 8, D.Options(sharpness_sigma=0.0, focus_pre_sigma=0.0), regularize=False)
    kept = A.kept_depth(depth, A.dense_frames(px)[1]).select(*PX, F.col("d").cast("int").alias("kept"))
    out = image.join(depth, PX).join(kept, PX)
    return out.select(*PX, F.col("d").cast("int").alias("d"), "kept", *[r6(F.col(c)).alias(c) for c in "rgb"])


def doubled(col: str) -> tuple[str, str]:
    """A 4 x 4 list to 4 x 8, and 4 x 8 (named ``t``) to 8 x 8."""
    x = f"list_transform(range(32), lambda i: CASE WHEN i % 2 = 0 THEN {col}[(i // 8) * 4 + greatest(i % 8 // 2 - 1, 0) + 1] / 8 + 0.75 * {col}[(i // 8) * 4 + i % 8 // 2 + 1] + {col}[(i // 8) * 4 + least(i % 8 // 2 + 1, 3) + 1] / 8 ELSE ({col}[(i // 8) * 4 + i % 8 // 2 + 1] + {col}[(i // 8) * 4 + least(i % 8 // 2 + 1, 3) + 1]) / 2 END)"
    y = "list_transform(range(64), lambda i: CASE WHEN i // 8 % 2 = 0 THEN t[greatest(i // 16 - 1, 0) * 8 + i % 8 + 1] / 8 + 0.75 * t[(i // 16) * 8 + i % 8 + 1] + t[least(i // 16 + 1, 3) * 8 + i % 8 + 1] / 8 ELSE (t[(i // 16) * 8 + i % 8 + 1] + t[least(i // 16 + 1, 3) * 8 + i % 8 + 1]) / 2 END)"
    return x, y


GAUSS = P.gaussian_kernel(1.0)
#: A one-level pyramid of each channel of each frame, each plane a list.
PYR1 = f"""pl AS (SELECT stack, frame, c, array_agg(v ORDER BY y, x) AS v FROM (SELECT stack, frame, y, x, unnest(['r', 'g', 'b']) AS c, unnest([r, g, b]) AS v FROM rgb) GROUP BY ALL),
c1 AS MATERIALIZED (SELECT *, {taps('v', S.BURT, 'x')} AS t FROM pl),
c2 AS MATERIALIZED (SELECT stack, frame, c, v, {taps('t', S.BURT, 'y')} AS t FROM c1),
lo AS MATERIALIZED (SELECT stack, frame, c, v, list_transform(range(16), lambda i: t[(i // 4) * 16 + (i % 4) * 2 + 1]) AS low FROM c2),
u1 AS MATERIALIZED (SELECT *, {doubled('low')[0]} AS t FROM lo),
bd AS MATERIALIZED (SELECT stack, frame, c, low, list_transform(list_zip(v, {doubled('low')[1]}), lambda p: p[1] - p[2]) AS band FROM u1),
en AS (SELECT stack, frame, list_transform(range(64), lambda i: abs(max(CASE WHEN c = 'r' THEN band END)[i + 1]) + abs(max(CASE WHEN c = 'g' THEN band END)[i + 1]) + abs(max(CASE WHEN c = 'b' THEN band END)[i + 1])) AS v FROM bd GROUP BY stack, frame),
e1 AS MATERIALIZED (SELECT stack, frame, {taps('v', GAUSS, 'x')} AS t FROM en),
e2 AS MATERIALIZED (SELECT stack, frame, {taps('t', GAUSS, 'y')} AS e FROM e1),
wn AS (SELECT stack, i, arg_max(frame, (e[i + 1], -frame)) AS frame FROM e2, range(64) t(i) GROUP BY stack, i),
fb AS (SELECT wn.stack, c, i, band[i + 1] AS v FROM wn JOIN bd USING (stack, frame)),
bs AS (SELECT stack, c, list_transform(range(16), lambda i: list_avg(list_transform(l, lambda q: q[i + 1]))) AS low FROM (SELECT stack, c, array_agg(low) AS l FROM bd GROUP BY stack, c)),
b1 AS MATERIALIZED (SELECT *, {doubled('low')[0]} AS t FROM bs),
b2 AS MATERIALIZED (SELECT stack, c, {doubled('low')[1]} AS up FROM b1)
SELECT stack, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, {", ".join(f"round(max(CASE WHEN c = '{c}' THEN v + up[i + 1] END), 6) + 0.0 AS {c}" for c in "rgb")} FROM fb JOIN b2 USING (stack, c) GROUP BY stack, i"""


@book.add("m1_pyramid_tiles", with_views("rgb", PYR1, cte=True))
def m1_tiles(spark, d):
    """Pyramid fusion of all frames of each stack on packed tiles, one level, base averaged."""
    g = PT.Grid(8, 8, 8, 1, "<f8")
    px = V.rgb_stack(spark, d, holes=False)
    image = PT.fuse(PT.from_pixels(px, g), g, M.Options(coarse_levels=0, normalize_exposure=False))
    return PT.long_form(image, ["r", "g", "b"], "<f8").select(*PX, *[r6(F.col(c)).alias(c) for c in "rgb"])


def of_pair(spark, d, odd: int):
    """The vectors of a label with even or odd vec_id, as descriptors of the fixed or the moving frame of one pair."""
    e = V.load(spark, d, "embeddings").where((F.col("vec_id") % 2 == odd) & F.col("label").isNotNull())
    return e.select(F.col("label").cast("int").alias("stack"), F.lit(0).alias("frame"), F.lit(1).alias("other"), F.col("vec_id").cast("int").alias("id"), F.col("embedding").cast("array<double>").alias("desc"))


NEAREST = """WITH p AS (
  SELECT m.label AS stack, m.vec_id AS id, f.vec_id AS nearest, sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(CAST(m.embedding[i] AS DOUBLE) - CAST(f.embedding[i] AS DOUBLE), 2)))) AS d
  FROM embeddings m JOIN embeddings f ON f.label = m.label WHERE m.vec_id % 2 = 1 AND f.vec_id % 2 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY stack, id ORDER BY d, nearest) AS k FROM p)
SELECT CAST(stack AS INTEGER) AS stack, CAST(id AS INTEGER) AS id, CAST(max(CASE WHEN k = 1 THEN nearest END) AS INTEGER) AS nearest, round(min(d), 6) AS d1, round(max(d), 6) AS d2, min(d) < 0.9 * max(d) AS kept FROM r WHERE k <= 2 GROUP BY stack, id HAVING count(*) = 2"""


@book.add("r1_ratio_test", NEAREST)
def r1_ratio(spark, d):
    """Each moving descriptor's two nearest fixed ones and whether it passes a ratio of 0.9."""
    near = MT.two_nearest(of_pair(spark, d, 1), of_pair(spark, d, 0))
    kept = MT.ratio_matches(near, 0.9).select("stack", "id", F.lit(True).alias("kept"))
    return near.join(kept, ["stack", "id"], "left").select("stack", "id", "nearest", r6(F.col("d1")).alias("d1"), r6(F.col("d2")).alias("d2"), F.coalesce("kept", F.lit(False)).alias("kept"))


WARP = ["1 + 0.01 * stack", "0.02 + 0 * stack", "3.0 * stack", "-0.015 + 0 * stack", "0.98 + 0 * stack", "-2.0 * stack", "0.0001 * stack", "0.00005 + 0 * stack", "1.0 + 0 * stack"]


@book.add("r1_consensus", "SELECT CAST(label AS INTEGER) AS stack, CAST(count(*) AS INTEGER) AS n, " + ", ".join(f"round({w.replace('stack', 'label')}, 6) + 0.0 AS h{k}" for k, w in enumerate(WARP)) + " FROM embeddings WHERE vec_id % 4 <> 0 GROUP BY label")
def r1_consensus(spark, d):
    """A known homography for each label, found again from all its vectors' places, a quarter of which point elsewhere."""
    q = lambda k: F.element_at("embedding", k).cast("double") * 100 + 50
    m = V.load(spark, d, "embeddings").where("label IS NOT NULL").select(F.col("label").cast("int").alias("stack"), F.lit(0).alias("frame"), F.lit(1).alias("other"), F.col("vec_id").cast("int").alias("id"), q(1).alias("mx"), q(2).alias("my"), q(3).alias("_q"))
    fx, fy = P.project([F.expr(w).cast("double") for w in WARP], F.col("mx"), F.col("my"))
    off = F.when(F.col("id") % 4 == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    m = m.withColumn("fx", fx + off * (40 + F.col("_q"))).withColumn("fy", fy - off * (20 + F.col("_q") * 2))
    got = MT.consensus(m.select(*MT.PAIR, "id", "my", "mx", "fy", "fx"), 100)
    return got.select("stack", "n", *[r6(F.element_at("h", k + 1)).alias(f"h{k}") for k in range(9)])


SEARCH = """a AS MATERIALIZED (SELECT stack, y, x, max(v) AS v FROM emb WHERE frame % 2 = 0 GROUP BY stack, y, x), b AS MATERIALIZED (SELECT stack, y, x, max(v) AS v FROM emb WHERE frame % 2 = 1 GROUP BY stack, y, x),
st AS (SELECT DISTINCT stack FROM b),
co AS (SELECT stack, CAST(i AS INTEGER) AS dy, CAST(j AS INTEGER) AS dx FROM st, range(-3, 4) p(i), range(-3, 4) q(j)),
ce AS (SELECT stack, dy, dx, round(avg(pow(b.v - a.v, 2)), 12) AS mse FROM co o JOIN b USING (stack) JOIN a USING (stack) WHERE b.y >= greatest(-dy, 0) AND b.x >= greatest(-dx, 0) AND b.y < least(8, 8 - dy) AND b.x < least(8, 8 - dx) AND (b.y - greatest(-dy, 0)) % 3 = 0 AND (b.x - greatest(-dx, 0)) % 3 = 0 AND a.y = b.y + dy AND a.x = b.x + dx GROUP BY stack, dy, dx),
cb AS (SELECT stack, arg_min(dy, (mse, dy, dx)) AS y0, arg_min(dx, (mse, dy, dx)) AS x0 FROM ce GROUP BY stack),
fo AS (SELECT stack, CAST(y0 + i AS INTEGER) AS dy, CAST(x0 + j AS INTEGER) AS dx FROM cb, range(-1, 2) p(i), range(-1, 2) q(j)),
fe AS (SELECT stack, dy, dx, round(avg(pow(b.v - a.v, 2)), 12) AS mse FROM fo o JOIN b USING (stack) JOIN a USING (stack) WHERE b.y >= greatest(-dy, 0) AND b.x >= greatest(-dx, 0) AND b.y < least(8, 8 - dy) AND b.x < least(8, 8 - dx) AND least(8, 8 - dy) - greatest(-dy, 0) > 3 AND least(8, 8 - dx) - greatest(-dx, 0) > 3 AND (b.y - greatest(-dy, 0)) % 2 = 0 AND (b.x - greatest(-dx, 0)) % 2 = 0 AND a.y = b.y + dy AND a.x = b.x + dx GROUP BY stack, dy, dx)
SELECT stack, arg_min(dy, (mse, dy, dx)) AS dy, arg_min(dx, (mse, dy, dx)) AS dx, round(min(mse), 9) AS mse FROM fe GROUP BY stack"""


@book.add("a25_searched_offset", with_views("emb", SEARCH, cte=True))
def a25_search(spark, d):
    """Coarse and fine search of the offset between the brightest values of even and of odd frames."""
    e = V.emb_stack(spark, d)
    side = lambda k: e.where(F.col("frame") % 2 == k).groupBy(*PX).agg(F.max("v").alias("v"))
    got = A.searched_offset(side(0), side(1), 8, 8, reach=3, coarse=3, fine=2, around=1, least=3)
    return got.select("stack", "dy", "dx", r6(F.col("mse"), 9).alias("mse"))


UNDO = """l AS (SELECT DISTINCT stack, frame AS edit, y // 2 AS ty, x // 2 AS tx FROM emb WHERE frame % 4 <> 3 AND (x + y * 3 + frame) % 5 = 0 AND x <= frame % 8),
s AS (SELECT stack, edit, count(*) * 64 AS bytes FROM l GROUP BY stack, edit), k AS (SELECT *, row_number() OVER (PARTITION BY stack ORDER BY edit DESC) AS n, sum(bytes) OVER (PARTITION BY stack ORDER BY edit DESC) AS b FROM s)
SELECT stack, edit, bytes, n = 1 OR (n <= 12 AND b <= 4000) AS kept FROM k"""


@book.add("u3_undoable", with_views("emb", UNDO, cte=True))
def u3_undoable(spark, d):
    """The live edits of a log that both limits, of strokes and of bytes, still let undo."""
    e = V.emb_stack(spark, d).where("(x + y * 3 + frame) % 5 = 0 AND x <= frame % 8")
    log = e.select(F.col("frame").alias("edit"), (F.col("frame") % 4 == 3).alias("undone"), "stack", "y", "x", "v")
    return E.undoable(log, 12, 4000, 2, 16)


@book.add("k5_aligned_frames", with_views("emb", """s AS (SELECT *, frame % 3 - 1 AS dx, frame % 2 AS dy FROM emb), b AS (SELECT stack, max(dx) AS x0, max(dy) AS y0, 8 + min(dx) AS x1, 8 + min(dy) AS y1 FROM s GROUP BY stack)
SELECT stack, frame, CAST(y + dy - greatest(y0, 0) AS INTEGER) AS y, CAST(x + dx - greatest(x0, 0) AS INTEGER) AS x, round(v, 6) + 0.0 AS v, 1.0::DOUBLE AS a FROM s JOIN b USING (stack) WHERE x + dx >= greatest(x0, 0) AND x + dx < least(x1, 8) AND y + dy >= greatest(y0, 0) AND y + dy < least(y1, 8)""", cte=True))
def k5(spark, d):
    """Frames moved by known shifts, brought onto one canvas and cut to what all cover."""
    e = V.emb_stack(spark, d, by_frame=True)
    one, nil = F.lit(1.0), F.lit(0.0)
    h = F.array(one, nil, (F.col("frame") % 3 - 1).cast("double"), nil, one, (F.col("frame") % 2).cast("double"), nil, nil, one)
    frames = V.emb_frames(spark, d).select("stack", "frame", h.alias("h"))
    return R.aligned(e, frames, 8, 8, ("v",), least=2).select("stack", "frame", "y", "x", r6(F.col("v")).alias("v"), "a")


PREVIEW = f"""lp AS ({LAP.format(src='emb')}), cb AS (SELECT stack, frame, y // 2 AS y, x // 2 AS x, avg(e) AS v FROM lp GROUP BY ALL),
bs AS (SELECT stack, y, x, max(v) AS energy, CASE WHEN max(v) > 0 THEN arg_max(frame, (v, -frame)) ELSE 0 END AS frame FROM cb GROUP BY stack, y, x),
fl AS (SELECT stack, greatest(1e-6, 0.2 * max(CASE WHEN r = least(CAST(floor(n * 0.95) AS BIGINT), n - 1) THEN energy END)) / 2 AS h FROM (SELECT *, row_number() OVER (PARTITION BY stack ORDER BY energy) - 1 AS r, count(*) OVER (PARTITION BY stack) AS n FROM bs) GROUP BY stack)
SELECT stack, y, x, frame, round(energy, 6) AS energy, round(pow(greatest(energy - h, 0), 2) / (pow(greatest(energy - h, 0), 2) + h * h), 6) AS c FROM bs JOIN fl USING (stack)"""


@book.add("u6_noise_preview", with_views("emb", PREVIEW, cte=True))
def u6(spark, d):
    """What a noise floor of 0.2 makes of the grid's winners."""
    e = V.emb_stack(spark, d)
    cube = A.box_down(S.laplacian_energy(e), 2, "e").withColumnRenamed("e", "v")
    light = A.box_down(e, 2)
    guide = light.groupBy(*PX).agg(F.avg("v").alias("g"))
    sure, _ = D.noise_preview(cube, light, guide, D.Options(noise_floor=0.2), 4, 4, fit=False)
    return sure.select(*PX, F.col("frame").cast("int").alias("frame"), r6(F.col("energy")).alias("energy"), r6(F.col("c")).alias("c"))
