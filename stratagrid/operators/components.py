"""Connected components, bounded reach and push-pull filling on masks and grids."""

from __future__ import annotations

import re
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def label(mask: DataFrame, width: int) -> DataFrame:
    """4-connected components of ``m``: stack, y, x, label (from 1, in raster order of first pixels; 0 outside).

    Least-place propagation: row runs collapse first (one window), then every run takes the least name of the
    runs it touches until nothing changes, with pointer jumps; lineage is cut in each round.
    """
    open_ = mask.where("m").select("stack", "y", "x", (F.col("y") * width + F.col("x")).cast("long").alias("i"))
    w = W.partitionBy("stack", "y").orderBy("x")
    fresh = F.when(F.col("x") - F.lag("x").over(w) == 1, 0).otherwise(1)
    runs = open_.withColumn("_f", fresh).withColumn("_g", F.sum("_f").over(w)).withColumn("run", F.min("i").over(W.partitionBy("stack", "y", "_g"))).select("stack", "y", "x", "i", "run")
    runs = settle(runs)
    below = runs.select("stack", (F.col("y") - 1).alias("y"), "x", F.col("run").alias("other"))
    e = runs.join(below, ["stack", "y", "x"]).select("stack", F.col("run").alias("a"), F.col("other").alias("b")).distinct()
    e = settle(e.unionAll(e.select("stack", F.col("b").alias("a"), F.col("a").alias("b"))))
    names = settle(runs.select("stack", "run", F.col("run").alias("name")).distinct())
    while True:
        near = e.join(names.select("stack", F.col("run").alias("b"), "name"), ["stack", "b"]).groupBy("stack", F.col("a").alias("run")).agg(F.min("name").alias("_n"))
        step = names.join(near, ["stack", "run"], "left").select("stack", "run", "name", F.least("name", F.coalesce("_n", "name")).alias("new"))
        # the name is itself a run: jump to where that run already points
        jump = step.select("stack", F.col("run").alias("new"), F.col("new").alias("_j"))
        nxt = settle(step.join(jump, ["stack", "new"], "left").select("stack", "run", F.col("name").alias("old"), F.least("new", F.coalesce("_j", "new")).alias("name")))
        done = nxt.where("old <> name").isEmpty()
        names = nxt.drop("old")
        if done:
            break
    order = names.select("stack", "name").distinct().withColumn("label", F.row_number().over(W.partitionBy("stack").orderBy("name")))
    own = runs.join(names, ["stack", "run"]).join(order, ["stack", "name"]).select("stack", "y", "x", "label")
    return mask.select("stack", "y", "x").join(own, ["stack", "y", "x"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def cut(df: DataFrame) -> DataFrame:
    """Lineage cut in the shared checkpoint folder; a temporary one only on a local master, where there is one machine.

    Spark deletes a checkpoint's files with its last reader where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="stratagrid-")
        sc.setCheckpointDir(named)
    return df.checkpoint()


def settle(df: DataFrame) -> DataFrame:
    """:func:`cut` without the planner's size estimate. A checkpoint keeps the estimate of its plan, joins multiply estimates, and
    in a loop the number's digits double with every round until planning takes longer than the work."""
    done, spark = cut(df), df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(done._jdf.javaRDD(), done._jdf.schema()), spark)


def reach(mask: DataFrame, seeds: DataFrame, radius: int) -> DataFrame:
    """Cells of ``m`` that an 8-connected walk inside the mask reaches from a seed within ``radius`` steps: stack, y, x, steps, origin.

    The origin is the least seed among those at equal steps. ``radius`` rounds of one join each.
    """
    cells = mask.where("m").select("stack", "y", "x")
    got = cells.join(seeds.select("stack", "y", "x", "origin"), ["stack", "y", "x"]).withColumn("steps", F.lit(0))
    ring = F.explode(F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]))
    edge = got
    for k in range(1, radius + 1):
        nxt = edge.withColumn("_o", ring).select("stack", (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x"), "origin")
        edge = nxt.groupBy("stack", "y", "x").agg(F.min("origin").alias("origin")).join(cells, ["stack", "y", "x"]).join(got.select("stack", "y", "x"), ["stack", "y", "x"], "left_anti").withColumn("steps", F.lit(k))
        edge = cut(edge.select("stack", "y", "x", "origin", "steps"))
        got = cut(got.select("stack", "y", "x", "origin", "steps").unionAll(edge))
    return got.select("stack", "y", "x", "steps", "origin")


def fill(vw: np.ndarray, w: np.ndarray, tau: float = 1e-3) -> np.ndarray:
    """Push-pull: weights and weighted values are averaged down to one cell; each level then adds to its own the
    coarser level's answer (bilinear about cell centres) with weight ``tau``."""
    h, wd = w.shape
    if h == 1 and wd == 1:
        return np.where(w > 0, vw / np.where(w > 0, w, 1), 0.0)
    H, V = (h + 1) // 2, (wd + 1) // 2
    grow = lambda a: np.pad(a, ((0, 2 * H - h), (0, 2 * V - wd))).reshape(H, 2, V, 2).sum((1, 3))
    n = grow(np.ones_like(w))
    low = fill(grow(vw) / n, grow(w) / n, tau)

    def at(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        i = p.astype(int)
        return i, np.minimum(i + 1, m - 1), p - i

    (y0, y1, fy), (x0, x1, fx) = at(h, H), at(wd, V)
    across = lambda r: low[r][:, x0] * (1 - fx) + low[r][:, x1] * fx
    up = across(y0) * (1 - fy)[:, None] + across(y1) * fy[:, None]
    return (vw + tau * up) / (w + tau)


def push_pull(grid: DataFrame, height: int, width: int) -> DataFrame:
    """stack, y, x, v from weighted values ``vw`` and weights ``w``. A grid is 1/64 of its image: one task for each stack."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        a, b = np.zeros((height, width)), np.zeros((height, width))
        a[p["y"], p["x"]], b[p["y"], p["x"]] = p["vw"], p["w"]
        out = fill(a, b)
        return pd.DataFrame({"stack": p["stack"], "y": p["y"], "x": p["x"], "v": out[p["y"], p["x"]]})

    return grid.select("stack", "y", "x", "vw", "w").groupBy("stack").applyInPandas(run, "stack int, y int, x int, v double")
