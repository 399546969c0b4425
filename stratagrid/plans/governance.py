"""Queries of background governance's lit tier, on mosaics of embeddings that are given a region, pockets and glints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import lit as L
from ..operators import pmax as M
from ..sources import views as V
from .base import Book, with_views

book = Book()
SIDE = 32
SMALL = L.Lit(block=4, reach=3)


def scene(spark, d):
    """stack, frame, y, x, e, l: energy and light of the mosaics. Left of column 20 (moved by the stack) energy peaks a little in frame 1;
    in it lie a pocket that peaks in frame 11, a glint of frame 1 and a sharp spot, in odd stacks so strong that the region's peak no
    longer stands out; right of it surroundings and what comes into focus in frame 12; the last rows are dark."""
    m = V.emb_mosaic(spark, d)
    y, f, x = F.col("y"), F.col("frame"), F.col("x") - F.col("stack") % 3
    at = lambda y0, y1, x0, x1: y.between(y0, y1) & x.between(x0, x1)
    peak = lambda n, k: F.when(f == n, F.lit(k)).otherwise(F.lit(1.0))
    k = (
        F.when(at(10, 16, 8, 14), peak(11, 3.3)).when(at(20, 21, 9, 11), peak(1, 12.0)).when(at(24, 24, 6, 6 + F.col("stack") % 2), peak(12, 60.0))
        .when(x >= 23, peak(12, 200.0)).when(x >= 20, peak(1, 9.0)).otherwise(peak(1, 1.3))
    )
    return m.select("stack", "frame", "y", "x", ((1 + 2 * F.abs("v")) * k).alias("e"), F.when(y >= 28, F.abs("v") * 0.01).otherwise(0.3 + F.abs("v")).alias("l"))


SCENE = """sc AS (SELECT stack, frame, y, x, x - stack % 3 AS u, v FROM mosaic),
px AS MATERIALIZED (SELECT stack, frame, y, x, (1 + 2 * abs(v)) * CASE WHEN y BETWEEN 10 AND 16 AND u BETWEEN 8 AND 14 THEN CASE WHEN frame = 11 THEN 3.3 ELSE 1 END
  WHEN y BETWEEN 20 AND 21 AND u BETWEEN 9 AND 11 THEN CASE WHEN frame = 1 THEN 12 ELSE 1 END WHEN y = 24 AND u BETWEEN 6 AND 6 + stack % 2 THEN CASE WHEN frame = 12 THEN 60 ELSE 1 END
  WHEN u >= 23 THEN CASE WHEN frame = 12 THEN 200 ELSE 1 END WHEN u >= 20 THEN CASE WHEN frame = 1 THEN 9 ELSE 1 END ELSE CASE WHEN frame = 1 THEN 1.3 ELSE 1 END END::DOUBLE AS e,
  CASE WHEN y >= 28 THEN abs(v) * 0.01 ELSE 0.3 + abs(v) END AS l FROM sc)"""


def place(rel: str, value: str, p: float) -> str:
    return f"SELECT stack, max(CASE WHEN r = least(CAST(floor(n * {p}) AS BIGINT), n - 1) THEN {value} END) AS q FROM (SELECT stack, {value}, row_number() OVER (PARTITION BY stack ORDER BY {value}) - 1 AS r, count(*) OVER (PARTITION BY stack) AS n FROM {rel}) GROUP BY stack"


MEMBER = f"""{SCENE},
g AS MATERIALIZED (SELECT stack, y, x, max(e) AS hi, min(e) AS lo, min(l) AS l, max(l) AS lhi, CASE WHEN max(e) > 0 THEN arg_max(frame, (e, -frame)) END AS arg FROM px GROUP BY stack, y, x),
kn AS ({place('g', 'lhi', 0.95)}), fl AS ({place('g', 'hi', 0.99)}),
m AS MATERIALIZED (SELECT stack, y, x, arg, l > 0.05 * greatest(kn.q, 1e-6) AND y BETWEEN 2 AND 29 AND x BETWEEN 2 AND 29 AND NOT (hi > 0.002 * greatest(fl.q, 1e-7) AND hi > 4 * greatest(lo, 1e-7)) AS core,
  l > 0.05 * greatest(kn.q, 1e-6) AND NOT (hi > 0.002 * greatest(fl.q, 1e-7) AND hi > 30 * greatest(lo, 1e-7)) AS wide FROM g JOIN kn USING (stack) JOIN fl USING (stack))"""
FOUR = "(VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(dy, dx)"
EIGHT = "(SELECT a - 1 AS dy, b - 1 AS dx FROM range(3) p(a), range(3) q(b) WHERE a <> 1 OR b <> 1)"
BOX = "(SELECT a - 2 AS dy, b - 2 AS dx FROM range(5) p(a), range(5) q(b))"


def parts(name: str, rel: str) -> str:
    """Components of a relation of cells: ``name``(stack, y, x, c), c the least place of the component."""
    return f"""{name}_o AS MATERIALIZED (SELECT stack, y, x, y * 32 + x AS i FROM {rel}), {name}_r(stack, y, x, c) AS (SELECT stack, y, x, i FROM {name}_o UNION SELECT o.stack, o.y, o.x, r.c FROM {name}_r r, {FOUR}, {name}_o o WHERE o.stack = r.stack AND o.y = r.y + dy AND o.x = r.x + dx AND r.c < o.i),
{name} AS MATERIALIZED (SELECT stack, y, x, min(c) AS c FROM {name}_r GROUP BY stack, y, x)"""


REGIONS = f"""{MEMBER}, {parts('ho', '(SELECT * FROM m WHERE NOT core)')},
hs AS (SELECT stack, c FROM ho GROUP BY stack, c HAVING count(*) <= 4096 AND NOT bool_or(y = 0 OR x = 0 OR y = 31 OR x = 31)),
fi AS (SELECT stack, y, x FROM m WHERE core UNION SELECT stack, y, x FROM m JOIN ho USING (stack, y, x) JOIN hs USING (stack, c) WHERE wide),
{parts('cc', 'fi')}, cd AS (SELECT *, dense_rank() OVER (PARTITION BY stack ORDER BY c) AS label, count(*) OVER (PARTITION BY stack, c) AS n FROM cc),
lb AS MATERIALIZED (SELECT stack, y, x, CAST(label AS INTEGER) AS label FROM cd WHERE n >= 256)"""


def most(rel: str) -> str:
    return f"SELECT stack, blk, bx, label FROM (SELECT stack, y // 4 AS blk, x // 4 AS bx, label, count(*) AS n FROM {rel} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY stack, blk, bx ORDER BY n DESC, label) = 1 AND n * 2 >= 16"


def peak(name: str, blocks: str) -> str:
    return f"""{name}_e AS (SELECT stack, label, frame, round(sum(e), 9) AS e FROM px JOIN {blocks} b USING (stack) WHERE b.blk = y // 4 AND b.bx = x // 4 GROUP BY ALL),
{name}_c AS (SELECT k.stack, k.label, k.frame, coalesce(e, 0) AS e, row_number() OVER (PARTITION BY k.stack, k.label ORDER BY coalesce(e, 0)) - 1 AS r, count(*) OVER (PARTITION BY k.stack, k.label) AS n FROM (SELECT DISTINCT b.stack, label, frame FROM {blocks} b JOIN px ON px.stack = b.stack) k LEFT JOIN {name}_e USING (stack, label, frame)),
{name} AS MATERIALIZED (SELECT stack, label, arg_max(frame, (e, -frame)) AS frame, arg_max(frame, (e, -frame)) FILTER (WHERE frame <= 2) AS near, max(e) AS mx, max(CASE WHEN r = n // 2 THEN e END) AS med, max(CASE WHEN r = least(CAST(floor(n * 0.9) AS BIGINT), n - 1) THEN e END) AS p90 FROM {name}_c GROUP BY stack, label)"""


DECIDED = f"""{REGIONS}, bl AS MATERIALIZED (SELECT * FROM ({most('lb')}) WHERE blk BETWEEN 1 AND 6 AND bx BETWEEN 1 AND 6), {peak('p1', 'bl')},
lk AS MATERIALIZED (SELECT a.stack, a.y, a.x FROM m a, {BOX} d, m b WHERE b.stack = a.stack AND b.y = a.y + dy AND b.x = a.x + dx AND a.arg IS NOT NULL AND b.arg IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (WHERE abs(a.arg - b.arg) <= 2) > count(*) * 0.6::DOUBLE),
ed AS (SELECT DISTINCT a.stack, a.y, a.x FROM lb a, {BOX} d, m b WHERE b.stack = a.stack AND b.y = a.y + dy AND b.x = a.x + dx AND (b.stack, b.y, b.x) NOT IN (SELECT (stack, y, x) FROM lb)),
ca AS (SELECT m.stack, m.y, m.x, m.arg FROM m JOIN lb USING (stack, y, x) JOIN p1 USING (stack, label) JOIN lk USING (stack, y, x) WHERE abs(m.arg - near) > 2 AND (m.stack, m.y, m.x) NOT IN (SELECT (stack, y, x) FROM ed)),
{parts('cp', 'ca')}, cr AS (SELECT stack, y, x, c, arg, row_number() OVER (PARTITION BY stack, c ORDER BY arg) - 1 AS r, count(*) OVER (PARTITION BY stack, c) AS n FROM cp JOIN ca USING (stack, y, x)),
an AS (SELECT stack, c, max(CASE WHEN r = n // 2 THEN arg END) AS ref FROM cr WHERE n >= 16 GROUP BY stack, c),
gr(stack, y, x, c, ref) AS (SELECT stack, y, x, c, ref FROM cp JOIN an USING (stack, c) UNION SELECT o.stack, o.y, o.x, r.c, r.ref FROM gr r, {EIGHT} d, (SELECT m.* FROM m JOIN lb USING (stack, y, x)) o WHERE o.stack = r.stack AND o.y = r.y + dy AND o.x = r.x + dx AND abs(o.arg - r.ref) <= 2),
ve AS MATERIALIZED (SELECT DISTINCT stack, y, x FROM gr),
vb AS (SELECT stack, y // 4 AS blk, x // 4 AS bx FROM lb LEFT JOIN (SELECT *, 1 AS v FROM ve) USING (stack, y, x) GROUP BY ALL HAVING count(v) * 2 >= count(*)),
b2 AS MATERIALIZED (SELECT * FROM bl ANTI JOIN vb USING (stack, blk, bx)), {peak('p2', 'b2')}"""
ON = "frame <= 2 AND p90 > med AND mx > med AND (mx - med) / (p90 - med) >= 2"
SPREAD = f"""{DECIDED}, ow AS (SELECT stack, label, frame AS ref FROM p2 WHERE {ON}),
wk(stack, y, x, label, ref, k) AS (SELECT stack, y, x, label, ref, 0 FROM lb JOIN ow USING (stack, label) UNION SELECT o.stack, o.y, o.x, r.label, r.ref, r.k + 1 FROM wk r, {EIGHT} d, m o LEFT JOIN (SELECT *, true AS l FROM lk) lk USING (stack, y, x) WHERE o.stack = r.stack AND o.y = r.y + dy AND o.x = r.x + dx AND r.k < 3 AND o.wide AND NOT (coalesce(l, false) AND coalesce(abs(o.arg - r.ref) > 2, false))),
ce AS MATERIALIZED (SELECT stack, y, x, arg_min(label, (k, label)) AS label, arg_min(ref, (k, label)) AS frame, min(k) AS steps FROM wk GROUP BY stack, y, x)"""


def decided(spark, d):
    px = scene(spark, d)
    lum = A.extremes(px.withColumnRenamed("l", "v"), "v")
    grid = L.cells(px.select("stack", "frame", "y", "x", "e"), lum, 1)
    return grid, L.knee(lum), M.frame_counts(px)


@book.add("m12_lit_regions", with_views("mosaic", f"{REGIONS} SELECT stack, y, x, label FROM lb", cte=True, recursive=True))
def regions(spark, d):
    """Lit cells whose energy hardly moves, glints filled, in regions of 256 cells or more."""
    grid, cut, _ = decided(spark, d)
    member = L.C.cut(L.membership(grid, cut, SIDE, SIDE, SMALL))
    return L.regions(member, SIDE, SIDE, SMALL).select("stack", "y", "x", F.col("label").cast("int").alias("label"))


@book.add("m12_lit_cells", with_views("mosaic", f"{SPREAD} SELECT stack, y, x, label, CAST(frame AS INTEGER) AS frame, CAST(steps AS INTEGER) AS steps, (stack, y, x) IN (SELECT (stack, y, x) FROM ve) AS veto FROM ce", cte=True, recursive=True))
def lit_cells(spark, d):
    """Cells that take one frame: regions with one peak near the first frame, less pockets, spread into their surroundings."""
    out, _ = L.lit_cells(*decided(spark, d), SIDE, SIDE, SMALL)
    return out.select("stack", "y", "x", F.col("label").cast("int").alias("label"), "frame", "steps", "veto")
