"""Deterministic plane stacks over the supplied tables.

``emb_stack``: each embedding is an 8 x 8 plane; its label is the stack and its rank by vec_id the frame.
``rgb_stack``: the same as colours in 0..1 with coverage. ``li_stack``: lineitem gridded into 7 frames of
16 x 16. ``capture``: events as captures of frames in folders. Scans read only the columns they need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SIDE = 8


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("label").orderBy("vec_id")
    e = load(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return e.select(F.col("label").alias("stack"), (F.row_number().over(w) - 1).alias("frame"), "embedding")


def emb_stack(spark: SparkSession, sf_dir: str, by_frame: bool = False) -> DataFrame:
    """stack, frame, y, x, v. ``by_frame``: frames are dealt out before their pixels come apart, for work on single planes; numbering
    them leaves all of a stack in one task."""
    e = emb_frames(spark, sf_dir)
    e = e.repartition("stack", "frame") if by_frame else e
    e = e.select("stack", "frame", F.posexplode("embedding").alias("i", "f"))
    return e.select("stack", "frame", F.floor(F.col("i") / SIDE).cast("int").alias("y"), (F.col("i") % SIDE).alias("x"), F.col("f").cast("double").alias("v"))


def emb_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stack, frame, y, x, v: planes of 32 x 32 of 16 embeddings each, 16 planes a stack, all by vec_id."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "f"))
    tile = F.col("vec_id") % 16
    y, x = F.floor(tile / 4) * SIDE + F.floor(F.col("i") / SIDE), tile % 4 * SIDE + F.col("i") % SIDE
    return e.select(F.floor(F.col("vec_id") / 256).cast("int").alias("stack"), (F.floor(F.col("vec_id") / 16) % 16).cast("int").alias("frame"), y.cast("int").alias("y"), x.cast("int").alias("x"), F.col("f").cast("double").alias("v"))


def unit(x: Column) -> Column:
    return F.least(F.greatest(x + 0.5, F.lit(0.0)), F.lit(1.0))


def rgb_stack(spark: SparkSession, sf_dir: str, holes: bool = True) -> DataFrame:
    """stack, frame, y, x, r, g, b, a; ``holes``: alpha 0 where (frame + x + y) is a multiple of 11."""
    e = emb_frames(spark, sf_dir).select("stack", "frame", "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    e = e.withColumn("y", F.floor(F.col("i") / SIDE).cast("int")).withColumn("x", F.col("i") % SIDE)
    at = lambda y, x: unit(F.element_at("embedding", (y * SIDE + x + 1).cast("int")).cast("double"))
    y, x = F.col("y"), F.col("x")
    a = F.when((F.col("frame") + x + y) % 11 == 0, F.lit(0.0)).otherwise(F.lit(1.0)) if holes else F.lit(1.0)
    return e.select("stack", "frame", "y", "x", at(y, x).alias("r"), at(y, 7 - x).alias("g"), at(7 - y, x).alias("b"), a.alias("a"))


def li_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stack 0, frame, y, x, v: means of quantity by cell, pre-aggregated where they are read."""
    li = load(spark, sf_dir, "lineitem").select("l_linenumber", "l_suppkey", "l_partkey", "l_quantity").where("l_linenumber IS NOT NULL")
    g = li.groupBy((F.col("l_linenumber") - 1).cast("int").alias("frame"), (F.col("l_suppkey") % 16).cast("int").alias("y"), (F.col("l_partkey") % 16).cast("int").alias("x"))
    return g.agg((F.avg("l_quantity") / 50).alias("v")).select(F.lit(0).alias("stack"), "frame", "y", "x", "v")


def capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """folder, name, ts."""
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("folder"), F.col("event_id").alias("name"), "ts")


def seconds(ts: str | Column) -> Column:
    """A zone-less time as seconds; the session's zone must be UTC."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp")) / F.lit(1_000_000.0)


#: The same views for the SQL of the oracles, as common table expressions.
SQL = {
    "emb": """
frames AS (SELECT label AS stack, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS frame, embedding FROM embeddings),
emb AS (SELECT stack, frame, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(embedding[i + 1] AS DOUBLE) AS v FROM frames, range(64) t(i))""",
    "rgb": """
frames AS (SELECT label AS stack, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS frame, embedding FROM embeddings),
rgb AS (SELECT stack, frame, y, x,
  least(greatest(CAST(embedding[y * 8 + x + 1] AS DOUBLE) + 0.5, 0), 1) AS r,
  least(greatest(CAST(embedding[y * 8 + (7 - x) + 1] AS DOUBLE) + 0.5, 0), 1) AS g,
  least(greatest(CAST(embedding[(7 - y) * 8 + x + 1] AS DOUBLE) + 0.5, 0), 1) AS b,
  CASE WHEN (frame + x + y) % 11 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS a
  FROM frames, (SELECT CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x FROM range(64) t(i)))""",
    "mosaic": """
mosaic AS (SELECT CAST(vec_id // 256 AS INTEGER) AS stack, CAST(vec_id // 16 % 16 AS INTEGER) AS frame, CAST(vec_id % 16 // 4 * 8 + i // 8 AS INTEGER) AS y, CAST(vec_id % 4 * 8 + i % 8 AS INTEGER) AS x, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) t(i))""",
    "li": """
li AS (SELECT 0 AS stack, CAST(l_linenumber - 1 AS INTEGER) AS frame, CAST(l_suppkey % 16 AS INTEGER) AS y, CAST(l_partkey % 16 AS INTEGER) AS x, avg(l_quantity) / 50 AS v
  FROM lineitem WHERE l_linenumber IS NOT NULL GROUP BY 2, 3, 4)""",
}
