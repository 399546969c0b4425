"""Nearest neighbours by a block matrix join (operator 3).

Vectors are quantised to int8 with a scale and a residual norm each. Candidates lie in blocks of ``block``
rows, queries in blocks of ``query_block``; a tile is one candidate block with one query block. A tile's
int8 products give the distance of the quantised vectors, and the residual norms bound the true distance
from both sides (triangle inequality). Pairs whose lower bound is above the query's k-th smallest upper
bound, or above the k-th distance known so far, can't be answers; the rest are recomputed
on the original components in double precision and enter the query's heap of k (distance, id). Heaps of
all tasks are merged at the end. No answer is lost, so recall is 1.

The queries meet each other first, which bounds each query's k-th distance before it meets all rows.

Defined cases: vectors that are null, zero, of length 0 or hold null or non-finite components, and rows
with a null id, take no part; vectors of different lengths are not compared; rows with one id are one
candidate at its smallest distance, and a repeated query id is answered once, from its first vector by
value; a query has fewer rows if there are fewer candidates; ties go to the smaller id.

Scale: candidate blocks are packed once from the scan's own partitions and stay there. The queries go round
in lots of at most ``lot`` rows, each broadcast to a pass over the candidates, so that what is sent is bounded
and what is read is the table once for each lot; candidates are never shuffled. A task keeps a heap of k for
each query of a lot, and of these only rows within the query's bound are shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, only, table

BLOCK = "dim int, blk int, ids binary, vecs binary, bounds binary"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and the norm of what they leave out, for each row."""
    scale = np.abs(x).max(1) / 127.0
    scale[scale == 0] = 1.0  # underflow of a subnormal row
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    rest = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(1))
    return codes, scale, rest


def int_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int8 codes, exactly: float32 holds sums of up to 1024 products of 127 * 127."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], 1024):
        out += a[:, k : k + 1024].astype(np.float32) @ b[:, k : k + 1024].astype(np.float32).T
    return out


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row-wise Euclidean distances, components added in their order."""
    with np.errstate(over="ignore"):
        s = np.zeros(len(q))
        for j in range(q.shape[1]):
            d = q[:, j] - c[:, j]
            s += d * d
        out = np.sqrt(s)
        odd = np.flatnonzero(~((out < 1e154) & (out > 1e-150)))  # squares that overflow or vanish are taken of scaled differences
        if len(odd):
            d = np.abs(q[odd] - c[odd])
            top = d.max(1)
            by = np.where((top > 0) & np.isfinite(top), top, 1.0)
            out[odd] = np.where(np.isfinite(top), by * np.sqrt(((d / by[:, None]) ** 2).sum(1)), top)
    return out


class Heaps:
    """A heap of the k nearest (distance, id) for each query of one block."""

    def __init__(self, k: int, ids: np.ndarray, x: np.ndarray, bound: np.ndarray):
        self.k, self.ids, self.x, self.bound = k, ids, x, bound
        self.codes, self.scale, self.rest = quantise(x)
        self.sq = self.scale**2 * (self.codes.astype(np.float64) ** 2).sum(1)
        self.heap: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.worst = bound.copy()

    @np.errstate(over="ignore", invalid="ignore")
    def tile(self, ids: np.ndarray, x: np.ndarray, parts: tuple) -> None:
        codes, scale, rest, sq = parts
        cross = int_products(self.codes, codes) * (self.scale[:, None] * scale)
        mid = np.sqrt(np.maximum(self.sq[:, None] + sq - 2 * cross, 0))
        slack = self.rest[:, None] + rest + 1e-9 * (np.sqrt(self.sq)[:, None] + np.sqrt(sq)) + 1e-150
        own = self.ids[:, None] == ids
        upper = np.where(own | np.isnan(mid), np.inf, mid + slack)
        n = min(self.k, len(ids)) - 1
        kth = np.partition(upper, n, axis=1)[:, n] if len(ids) > self.k else np.full(len(self.ids), np.inf)
        live = ~(mid - slack > np.minimum(kth, self.worst)[:, None]) & ~own  # what overflows bounds nothing
        r, c = np.nonzero(live)
        for lo in range(0, len(r), 1 << 18):
            i, j = r[lo : lo + (1 << 18)], c[lo : lo + (1 << 18)]
            d = exact(self.x[i], x[j])
            close = d <= self.bound[i]
            i, j, d = i[close], j[close], d[close]
            order = np.lexsort((ids[j], d, i))
            i, d, v = i[order], d[order], ids[j][order]
            first = np.concatenate([[True], i[1:] != i[:-1]])
            rank = np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))
            # one id may stand in several rows: within a tile each id is unique, so k of a query are enough
            ok = rank < self.k
            for a, b, e in zip(i[ok].tolist(), d[ok].tolist(), v[ok].tolist()):
                self.push(a, b, e)

    def push(self, q: int, d: float, v: int) -> None:
        h, item = self.heap[q], (-d, -v)
        if any(x[1] == -v for x in h):
            old = next(x for x in h if x[1] == -v)
            if item > old:
                h.remove(old)
                heapq.heapify(h)
                heapq.heappush(h, item)
        elif len(h) < self.k:
            heapq.heappush(h, item)
        elif item > h[0]:
            heapq.heapreplace(h, item)
        self.worst[q] = -h[0][0] if len(h) == self.k else self.bound[q]

    def rows(self) -> Iterator[tuple[int, int, float]]:
        for q, h in zip(self.ids.tolist(), self.heap):
            for d, v in sorted(h, reverse=True):
                yield q, -v, -d


def sound(df: DataFrame, key: str, vec: str) -> DataFrame:
    """id and v (double components) of the rows that take part."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine_on("v"))


def fine_on(col: str):
    return F.forall(col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.coalesce(F.exists(col, lambda x: x != 0), F.lit(False))


def blocks(vecs: DataFrame, rows: int) -> DataFrame:
    """One row for each block: ids, components and, if there, the column ``bound``, as packed binaries. Ids within a block are unique."""
    bounded = "bound" in vecs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, tuple]] = {}
        made = 0

        def out(dim: int):
            nonlocal made
            ids, v = zip(*sorted(held.pop(dim).items()))
            made += 1
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "blk": pa.array([made], pa.int32()), "ids": [np.array(ids, "<i8").tobytes()], "vecs": [np.array([x for x, _ in v], "<f8").tobytes()], "bounds": [np.array([y for _, y in v], "<f8").tobytes()]})

        for batch in batches:
            far = batch.column(2).to_pylist() if bounded else [np.inf] * batch.num_rows
            for i, v, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), far):
                part = held.setdefault(len(v), {})
                if i in part and part[i][0] != v:
                    yield out(len(v))
                    part = held.setdefault(len(v), {})
                part[i] = v, y
                if len(part) >= rows:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return vecs.mapInArrow(run, BLOCK)


def _heaped(tiles: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score of each task's heaps; ``tiles``: dim, qb, ids, vecs, bounds, cids, cvecs, those of one candidate block together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, Heaps] = {}
        last, parts, x, i = None, (), None, None
        for batch in batches:
            for r in range(batch.num_rows):
                dim, qb, cids, cvecs = (batch.column(c)[r].as_py() for c in (0, 1, 5, 6))
                if qb not in heaps:
                    ids, vecs, bounds = (batch.column(c)[r].as_py() for c in (2, 3, 4))
                    heaps[qb] = Heaps(k, np.frombuffer(ids, "<i8"), np.frombuffer(vecs, "<f8").reshape(-1, dim), np.frombuffer(bounds, "<f8"))
                if cids != last:
                    last, x, i = cids, np.frombuffer(cvecs, "<f8").reshape(-1, dim), np.frombuffer(cids, "<i8")
                    with np.errstate(over="ignore", invalid="ignore"):
                        codes, scale, rest = quantise(x)
                        parts = codes, scale, rest, scale**2 * (codes.astype(np.float64) ** 2).sum(1)
                heaps[qb].tile(i, x, parts)
        for h in heaps.values():
            cols = list(zip(*h.rows())) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return tiles.mapInArrow(run, "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    one = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place = W.partitionBy("query_id").orderBy("score", "vec_id")  # at most k rows for each task of a query, and those within its bound
    return one.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vec: str = "embedding", block: int = 4096, query_block: int = 256, lot: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of ``vectors`` for each row of ``queries``."""
    q0 = cut(sound(queries, key, vec).groupBy("id").agg(F.min("v").alias("v")).withColumn("lot", F.pmod(F.xxhash64("id"), F.lit(1 << 20))), "queries")
    lots = max(1, -(-q0.count() // lot))
    cand = cut(blocks(sound(vectors, key, vec), block), "candidates").select("dim", F.col("ids").alias("cids"), F.col("vecs").alias("cvecs"))

    def meet(rows: DataFrame, candidates: DataFrame) -> DataFrame:
        """Each candidate block with each block of the queries ``rows``: a lot of bounded size, so it is broadcast; lengths must agree."""
        qb = blocks(rows.select("id", "v", *(["bound"] if "bound" in rows.columns else [])).coalesce(1), query_block).select("dim", F.col("blk").alias("qb"), "ids", "vecs", "bounds")
        tiles = candidates.join(F.broadcast(qb), "dim").select("dim", "qb", "ids", "vecs", "bounds", "cids", "cvecs")
        return _heaped(tiles, k)

    own = None
    parts = []
    for n in range(lots):
        mine = q0.where((F.col("lot") % lots) == n)
        others = blocks(mine.select("id", "v"), block).select("dim", F.col("ids").alias("cids"), F.col("vecs").alias("cvecs"))
        near = _best(meet(mine, others), k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
        bounded = cut(mine.join(near, "id", "left").select("id", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound")), "bounds")
        parts.append(meet(bounded, cand))
    for x in parts:
        own = x if own is None else own.unionAll(x)
    return _best(own, k)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = only(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest(e, e.where(F.col("vec_id") % 100 == 0))


SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         sqrt(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])))) AS score
  FROM e q JOIN e c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

QUERIES = {"op3_nearest": op3_nearest}
ORACLES = {"op3_nearest": SQL}
