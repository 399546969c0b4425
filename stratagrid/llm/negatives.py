"""Hard negatives by distributed radix selection (operator 13).

A score is the integer inner product of two vectors of components floor(``grain`` * x). An anchor's positives are its best
rows of the same label. Each anchor and positive open a window of scores, ``low`` percent of the positive's score up to
that score, for rows of other labels. Which row is the k-th of a window is found digit by digit: every task counts
its rows of the window's open bucket by the next ``BITS`` bits of (window's top - score), the counts are added up, and
the bucket that holds the k-th row is the next to be opened. When the scores are all spent, the digits of vec_id
go on, so that any number of rows may tie. A window is settled when the rows up to its bucket are no more than
``slack``; then only those rows are gathered and ranked.

Defined cases: rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part;
vectors of different lengths are not compared; rows with the anchor's id are never its positives or negatives;
repeated rows are candidates each for itself; a repeated anchor id is answered once, from its smallest (label,
vector); an anchor without positives, or a window without rows, gives no rows; other columns are ignored; an empty
table gives an empty result. Products of any size are exact (beyond 2**53 they are taken of Python's integers), but a
score that is returned must fit 64 bits, or the query fails.

Scale: candidates are packed in blocks once and never shuffled. Anchors go round in lots of at most ``lot`` rows
and ``lot_mb`` of vectors, each sent to a pass over the candidates for each digit; a pass shuffles one row of
2**BITS counts for each open window and task. Each lot's result is written on its own, so that the plan doesn't grow with
the lots, and a lost executor costs its part of one pass.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, free, only, table

BITS = 5
WIDTH = 1 << BITS
BLOCK_MB = 8
CELLS = 1 << 20  # scores worked on at once
_EXACT = float(1 << 53)
_HIST = [f"h{i}" for i in range(WIDTH)]


def sound(df: DataFrame, key: str, vec: str, label: str) -> DataFrame:
    """id, label and v of the rows that take part."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vec).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & fine)


def whole(v: np.ndarray, grain: int) -> np.ndarray:
    """floor(grain * v): int64 where that holds them, else Python integers."""
    with np.errstate(over="ignore"):
        x = np.floor(v * grain)
    if (np.abs(x) < _EXACT).all():
        return x.astype(np.int64)
    # a double of 2**53 or more is a whole number, and so is its product
    return np.array([int(a) * grain if abs(a) >= _EXACT else int(np.floor(a * grain)) for a in v.ravel().tolist()], object).reshape(v.shape)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T exactly."""
    if a.dtype != object and b.dtype != object:
        most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
        if most < _EXACT:
            return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
        if most < 2.0**61:
            return a @ b.T
    return a.astype(object) @ b.astype(object).T


def blocks(rows: DataFrame, mb: int = BLOCK_MB) -> DataFrame:
    """dim, ids, labels, vecs: the rows of a batch that have one length, packed, at most ``mb`` of vectors in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            offs = batch.column(2).offsets.to_numpy()
            values = batch.column(2).values.to_numpy(zero_copy_only=False)
            dims = np.diff(offs)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                step = max(1, (mb << 20) // (8 * dim))
                for lo in range(0, len(own), step):
                    at = own[lo : lo + step]
                    vecs = values[offs[at][:, None] + np.arange(dim)]
                    yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": [ids[at].astype("<i8").tobytes()], "labels": [labels[at].astype("<i8").tobytes()], "vecs": [vecs.astype("<f8").tobytes()]})

    return rows.select("id", "label", "v").mapInArrow(run, "dim int, ids binary, labels binary, vecs binary")


@dataclass
class Anchors:
    """The anchors of a lot that have one length; ``no`` are their numbers in the lot."""

    no: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vecs: np.ndarray


class Positives:
    """A heap of the ``k`` best rows of its own label for each anchor."""

    schema = "a int, id long, score long"

    def __init__(self, k: int):
        self.k, self.heaps = k, {}

    def add(self, own: Anchors, ids: np.ndarray, labels: np.ndarray, s: np.ndarray) -> None:
        alike = (own.labels[:, None] == labels) & (own.ids[:, None] != ids)
        for r in np.flatnonzero(alike.any(1)).tolist():
            c = np.flatnonzero(alike[r])
            x = s[r, c]
            if len(c) > self.k and x.dtype != object:  # all that reach the k-th score
                keep = x >= np.partition(x, -self.k)[-self.k]
                c, x = c[keep], x[keep]
            heap = self.heaps.setdefault(int(own.no[r]), [])
            for score, i in heapq.nlargest(self.k, zip(x.tolist(), (-ids[c]).tolist())):
                if len(heap) < self.k:
                    heapq.heappush(heap, (score, i))
                elif (score, i) > heap[0]:
                    heapq.heapreplace(heap, (score, i))

    def rows(self) -> Iterator[pa.RecordBatch]:
        got = [(a, -i, s) for a, h in self.heaps.items() for s, i in h]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["a", "id", "score"])


class Windows:
    """Windows of a lot, one for each anchor and positive, and how far each has been narrowed.

    A row's place in its window is (top - score, id - first id), the latter without sign. ``base`` is where the open
    bucket begins, ``shift`` how many bits its next digit leaves over; once the score is spent it is kept in ``tie``, and
    the bucket is one of ids, ``id_base`` to ``id_last``.
    ``above`` counts the rows before the bucket.
    """

    def __init__(self, rows: list, low: int, first_id: int, last_id: int):
        self.a = np.array([r["a"] for r in rows], np.int64)
        self.top = np.array([r["score"] for r in rows], np.int64)
        self.width = np.array([r["score"] - -(-low * r["score"] // 100) for r in rows], np.int64)
        self.live = self.width >= 0  # none below a negative score
        n = len(rows)
        self.first_id, self.id_bits = np.uint64(first_id % 2**64), max(1, (last_id - first_id).bit_length())
        bits = np.array([int(w).bit_length() if w > 0 else 0 for w in self.width.tolist()], np.int64)
        self.base, self.shift, self.tie = np.zeros(n, np.int64), np.maximum(bits - BITS, 0), np.full(n, -1, np.int64)
        self.span = np.maximum(self.width + 1, 1)
        self.id_base, self.id_last = np.zeros(n, np.uint64), np.full(n, 2**64 - 1, np.uint64)
        self.above, self.open = np.zeros(n, np.int64), self.live.copy()
        self.of: dict[int, list[int]] = {}
        for w in np.flatnonzero(self.live).tolist():
            self.of.setdefault(int(self.a[w]), []).append(w)

    def narrow(self, w: int, counts: np.ndarray, k: int, slack: int) -> None:
        """Open the bucket that holds the k-th row; settle the window when few rows are left."""
        upto = self.above[w] + np.cumsum(counts)
        if upto[-1] < k or upto[-1] <= slack:
            self.open[w] = False  # all rows up to the end of the bucket
            return
        d, shift = int(np.searchsorted(upto, k)), int(self.shift[w])
        self.above[w] = upto[d] - counts[d]
        if self.tie[w] < 0:
            self.base[w] += d << shift
            self.span[w] = 1 << shift
        else:
            begin = int(self.id_base[w]) + (d << shift)
            self.id_base[w], self.id_last[w] = np.uint64(begin), np.uint64(begin + (1 << shift) - 1)
        if upto[d] <= slack:
            self.open[w] = False
        elif shift > 0:
            self.shift[w] = max(0, shift - BITS)
        elif self.tie[w] < 0:  # one score is left: on to the ids
            self.tie[w], self.shift[w] = self.base[w], max(0, self.id_bits - BITS)
        else:
            self.open[w] = False  # one id, repeated

    def places(self, slot: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, s: np.ndarray, other: np.ndarray, upto: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, candidate, next digit) of the rows in open buckets, or (``upto``: window, candidate, top - score) of all up to their ends."""
        for rows, w in slot:
            top, tie, x = self.top[w], self.tie[w], s[rows]
            wide = x.dtype == object or (np.abs(top) >= 1 << 61).any()
            d = top.astype(object)[:, None] - x if wide else top[:, None] - x
            tied = tie >= 0
            lo = np.zeros(len(w), np.int64) if upto else np.where(tied, tie, self.base[w])
            hi = np.minimum(np.where(tied, tie, self.base[w] + self.span[w] - 1), self.width[w])
            r, c = np.nonzero(other[rows] & (d >= lo[:, None]) & (d <= hi[:, None]))
            at = d[r, c].astype(np.int64)
            digit = at if upto else (at - self.base[w][r]) >> self.shift[w][r]
            if tied.any():
                of_id, begin = ids[c].view(np.uint64) - self.first_id, self.id_base[w][r]
                on = tied[r] & (at == tie[r])
                ok = ~on | ((of_id <= self.id_last[w][r]) & ((of_id >= begin) | upto))
                if not upto:
                    digit = np.where(on, ((of_id - begin) >> self.shift[w][r].astype(np.uint64)).astype(np.int64), digit)
                r, c, digit = r[ok], c[ok], digit[ok]
            yield w[r], c, digit


class Histograms:
    """Counts of each open window's rows by the next digit."""

    schema = "w int, " + ", ".join(f"{h} long" for h in _HIST)

    def __init__(self, windows: Windows):
        self.w = windows
        self.no = np.flatnonzero(windows.open)
        self.at = np.full(len(windows.a), -1, np.int64)
        self.at[self.no] = np.arange(len(self.no))
        self.counts = np.zeros(len(self.no) * WIDTH, np.int64)

    def add(self, own: Anchors, ids: np.ndarray, labels: np.ndarray, s: np.ndarray) -> None:
        other = (own.labels[:, None] != labels) & (own.ids[:, None] != ids)
        for w, _, digit in self.w.places(slots(self.w, own, self.w.open), ids, s, other, False):
            self.counts += np.bincount(self.at[w] * WIDTH + digit, minlength=len(self.counts))

    def rows(self) -> Iterator[pa.RecordBatch]:
        h = self.counts.reshape(-1, WIDTH)
        some = np.flatnonzero(h.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(self.no[some], pa.int32()), *[pa.array(h[some, i], pa.int64()) for i in range(WIDTH)]], names=["w", *_HIST])


class Rows:
    """The rows up to the end of each settled bucket, of a task no more than the first ``k`` of a window."""

    schema = "w int, id long, score long"

    def __init__(self, windows: Windows, k: int):
        self.w, self.k = windows, k
        self.got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, own: Anchors, ids: np.ndarray, labels: np.ndarray, s: np.ndarray) -> None:
        other = (own.labels[:, None] != labels) & (own.ids[:, None] != ids)
        for w, c, place in self.w.places(slots(self.w, own, self.w.live), ids, s, other, True):
            self.got.append((w, place, ids[c]))
            self.held += len(w)
        if self.held > 1 << 20:
            self.trim()

    def trim(self) -> None:
        w, d, i = (np.concatenate([g[j] for g in self.got]) if self.got else np.zeros(0, np.int64) for j in range(3))
        order = np.lexsort((i, d, w))
        w, d, i = w[order], d[order], i[order]
        new = np.concatenate([[True], w[1:] != w[:-1]]) if len(w) else np.zeros(0, bool)
        rank = np.arange(len(w)) - np.maximum.accumulate(np.where(new, np.arange(len(w)), 0)) if len(w) else w
        ok = rank < self.k
        self.got, self.held = [(w[ok], d[ok], i[ok])], int(ok.sum())

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.trim()
        w, d, i = self.got[0]
        yield pa.RecordBatch.from_arrays([pa.array(w, pa.int32()), pa.array(i, pa.int64()), pa.array(self.w.top[w] - d, pa.int64())], names=["w", "id", "score"])


def slots(windows: Windows, own: Anchors, which: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``own`` and a window of each: first all first windows, then all second ones, and so on."""
    lists = [[w for w in windows.of.get(n, ()) if which[w]] for n in own.no.tolist()]
    out = []
    for j in range(max(map(len, lists), default=0)):
        rows = np.array([r for r, x in enumerate(lists) if len(x) > j], np.int64)
        out.append((rows, np.array([lists[r][j] for r in rows.tolist()], np.int64)))
    return out


def scan(candidates: DataFrame, anchors, fold, grain: int) -> DataFrame:
    """One pass of a lot over the candidates; ``fold`` makes what a task adds up. ``anchors``: broadcast list of :class:`Anchors`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {a.vecs.shape[1]: (a, whole(a.vecs, grain)) for a in anchors.value}
        out = fold()
        for batch in batches:
            for r in range(batch.num_rows):
                dim, ids, labels, vecs = (c[r].as_py() for c in batch.columns)
                if dim not in held:
                    continue
                own, own_whole = held[dim]
                ids, labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
                x = whole(np.frombuffer(vecs, "<f8").reshape(-1, dim), grain)
                step = max(1, CELLS // len(ids))
                for lo in range(0, len(own.no), step):
                    part = Anchors(own.no[lo : lo + step], own.ids[lo : lo + step], own.labels[lo : lo + step], own.vecs[lo : lo + step])
                    out.add(part, ids, labels, products(own_whole[lo : lo + step], x))
        yield from out.rows()

    return candidates.mapInArrow(run, fold().schema)


def grouped(rows: list) -> tuple[list[Anchors], list[int]]:
    """The anchors of a lot by length, and their ids by number."""
    by: dict[int, list[int]] = {}
    for n, r in enumerate(rows):
        by.setdefault(len(r["v"]), []).append(n)
    own = [Anchors(np.array(ns, np.int64), np.array([rows[n]["id"] for n in ns], np.int64), np.array([rows[n]["label"] for n in ns], np.int64), np.array([rows[n]["v"] for n in ns], np.float64)) for ns in by.values()]
    return own, [r["id"] for r in rows]


def mine_lot(spark: SparkSession, candidates: DataFrame, rows: list, span: tuple[int, int], positives: int, negatives: int, low: int, grain: int, slack: int) -> DataFrame:
    own, ids = grouped(rows)
    sent = spark.sparkContext.broadcast(own)
    best = W.partitionBy("a").orderBy(F.desc("score"), "id")
    found = scan(candidates, sent, lambda: Positives(positives), grain).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives)
    opened = found.orderBy("a", "rank").collect()  # at most ``positives`` for each anchor of a lot
    windows = Windows(opened, low, *span)
    while windows.open.any():
        state = spark.sparkContext.broadcast(windows)
        counted = scan(candidates, sent, lambda state=state: Histograms(state.value), grain).groupBy("w").agg(*[F.sum(h).alias(h) for h in _HIST]).collect()
        counts = {r["w"]: np.array(r[1:], np.int64) for r in counted}
        for w in np.flatnonzero(windows.open).tolist():
            windows.narrow(w, counts.get(w, np.zeros(WIDTH, np.int64)), negatives, slack)
    state = spark.sparkContext.broadcast(windows)
    place = W.partitionBy("w").orderBy(F.desc("score"), "id")
    got = scan(candidates, sent, lambda: Rows(state.value, negatives), grain).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= negatives)
    about = [(w, ids[r["a"]], r["id"], r["score"]) for w, r in enumerate(opened)]
    about = spark.createDataFrame(about, "w int, anchor_id long, positive_id long, positive_score long")
    return got.join(F.broadcast(about), "w").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, grain: int = 256, key: str = "vec_id", vec: str = "embedding", label: str = "label", lot: int = 4096, lot_mb: int = 16, slack: int = 64) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each row of ``anchors`` and its positives among ``vectors``."""
    spark = vectors.sparkSession
    one = sound(anchors, key, vec, label).groupBy("id").agg(F.min(F.struct("label", "v")).alias("m")).select("id", "m.label", "m.v")
    asked = cut(one.withColumn("lot", F.xxhash64("id")), "anchors")
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(8 * F.size("v")).alias("b")).first()
    rows = sound(vectors, key, vec, label)
    candidates = cut(blocks(rows), "candidates")
    span = rows.agg(F.min("id").alias("a"), F.max("id").alias("b")).first()
    lots = max(1, -(-size["n"] // lot), -(-(size["b"] or 0) // (lot_mb << 20)))
    written = []
    for n in range(lots):
        some = asked.where(F.pmod("lot", F.lit(lots)) == n).select("id", "label", "v").orderBy("id").collect()  # bounded by lot and lot_mb
        if some and span["a"] is not None:
            written.append(cut(mine_lot(spark, candidates, some, (span["a"], span["b"]), positives, negatives, low, grain, slack), "negatives"))
    free(asked, candidates)
    if not written:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return spark.read.schema(written[0].schema).parquet(*[w._cut_at for w in written])


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = only(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    e = e.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(e, e.where(F.col("vec_id") % 100 == 0))


SQL = """
WITH e AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.id AS anchor_id, a.label AS own, c.id AS id, c.label AS label,
         CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score
  FROM e a JOIN e c ON c.id <> a.id AND len(c.v) = len(a.v) WHERE a.id % 100 = 0
), p AS (SELECT anchor_id, own, id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.own AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLES = {"op13_hard_negatives": SQL}
