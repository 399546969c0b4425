"""Sharding by longest-processing-time scheduling (operator 5).

Documents with equal texts form a group that stays together. Groups, largest first, go to the least
loaded shard; a heap holds the loads. Groups of one size are interchangeable for this schedule, so the
driver schedules the histogram of group sizes: for c groups of size s it takes the c least values of
load + i * s (what the heap would pop), the bulk by a threshold and the last ones from the heap itself.
The histogram comes to the driver in slices of ``slice_sizes`` sizes, largest first, and only the loads are
carried from one to the next. The result, so many groups of a size to each shard, is written as a table and
handed out by rank within the size.

Defined cases: a null text has no bytes, so its document weighs 8, and null texts are one group, apart
from empty ones; repeated rows are shards' rows like others; ties of load go to the smaller shard number;
an empty table gives an empty result; other columns are ignored.

Scale: texts are read once, narrowly; only ids, sizes and hashes are shuffled, counts are combined before
shuffling, and ranks and slots are made in buckets. A group larger than a fair share fills its shard alone,
as it must stay together.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_len, cut, free, only, ranked, table


def schedule(sizes: Iterable[tuple[int, int]], shards: int, load: np.ndarray | None = None) -> list[tuple[int, np.ndarray]]:
    """For each (size, count), largest size first: how many go to each shard. ``load``: what the shards hold already, and then hold."""
    load = np.zeros(shards, np.int64) if load is None else load
    out = []
    for size, count in sorted(sizes, reverse=True):
        take = np.zeros(shards, np.int64)
        if count > 4 * shards:
            lo, hi = int(load.min()), int(load.max()) + size * count
            while hi - lo > 1:  # the greatest level below which the heap would hand out at most `count`
                mid = (lo + hi) // 2
                if int(np.maximum(0, -(-(mid - load) // size)).sum()) <= count:
                    lo = mid
                else:
                    hi = mid
            take = np.maximum(0, -(-(lo - load) // size))
        heap = [(int(load[j] + take[j] * size), j) for j in range(shards)]
        heapq.heapify(heap)
        for _ in range(count - int(take.sum())):
            at, j = heap[0]
            take[j] += 1
            heapq.heapreplace(heap, (at + size, j))
        load += take * size
        out.append((size, take))
    return out


def assign(docs: DataFrame, shards: int = 24, overhead: int = 8, slice_sizes: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``bytes``)."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = cut(
        only(docs, "doc_id", "text").select(
            "doc_id", (byte_len("text") + overhead).alias("size"), F.crc32(raw).alias("text_crc32"),
            F.when(F.col("text").isNull(), F.lit("")).otherwise(F.md5(raw)).alias("_g"),
        ),
        "sizes",
    )
    groups = cut(base.groupBy("_g").agg(F.sum("size").alias("_s")), "groups")
    histogram = cut(groups.groupBy("_s").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("_s")), "histogram")
    load = np.zeros(shards, np.int64)
    ends = []
    for part in batched(histogram.orderBy(F.desc("_s")).toLocalIterator(), slice_sizes):
        took = schedule([(r["_s"], r["n"]) for r in part], shards, load)
        sums = np.cumsum([take for _, take in took], axis=1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, shards), pa.int32()), pa.array(sums.reshape(-1)))
        ends.append(cut(spark.createDataFrame(pa.table({"_s": pa.array([s for s, _ in took], pa.int64()), "_ends": lists})), "ends"))
    if not ends:  # no documents
        ends = [spark.createDataFrame([], "_s long, _ends array<long>")]
    where = ends[0]
    for x in ends[1:]:
        where = where.unionAll(x)
    shard = F.size(F.filter("_ends", lambda e: e <= F.col("_r"))).cast("int")
    placed = ranked(groups, ["_s"], ["_g"], "_r").join(where, "_s").select("_g", shard.alias("shard"))
    rows = cut(base.join(placed, "_g").drop("_g"), "placed")
    free(base, groups, histogram)
    out = ranked(rows, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


QUERIES = {"op5_sharding": op5_sharding}
ORACLES: dict[str, str] = {}
