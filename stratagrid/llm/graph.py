"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free


def components(edges: DataFrame) -> DataFrame | None:
    """(node, root) for every node of ``edges`` (a, b: longs that are hashes, so their order is random); None without edges.

    Every node moves to the least node of its neighbourhood and the edges are rewritten between those; as
    the order is random, each round leaves a fraction of the nodes, so the number of rounds grows with the
    logarithm of the largest component. Stars, the common case, take two. Nothing is collected.
    """
    e = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    label = None
    while not e.isEmpty():
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("m")), "moves")
        old = label
        if old is None:
            label = cut(move.select("node", F.col("m").alias("root")), "labels")
        else:
            at = move.select(F.col("node").alias("root"), "m")
            label = cut(old.join(at, "root", "left").select("node", F.coalesce("m", "root").alias("root")), "labels")
            free(old)
        a = move.select(F.col("node").alias("a"), F.col("m").alias("ma"))
        b = move.select(F.col("node").alias("b"), F.col("m").alias("mb"))
        nxt = cut(e.join(a, "a").join(b, "b").where("ma <> mb").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct(), "edges")
        free(e, move)
        e = nxt
    free(e)
    return label
