"""Suffix-array dedup: removal of every byte that a repeated ``length``-byte string covers (operator 6).

1. Reduction. Every window of ``length`` bytes picks its anchor: the place in it with the least hash of 8
   bytes, among those after which ``gram`` bytes still lie in the window (the first of equals). Equal windows
   pick the same anchor, and the windows of one anchor are consecutive, so a document is a list of ranges:
   anchor key (hash of the gram) and class (hash of all the bytes that the range's windows cover). A key that
   stands once in the corpus rules out its windows; ranges of one class are alike, so one of them stands for
   all, with their number as its weight.
2. The bytes of these go to one task for each batch of keys: shards of them get a Burrows-Wheeler transform
   each, the transforms are merged by iterative interleave refinement up to depth ``length``, and the
   intervals of windows with a common prefix of that length and a weight of two or more are the repeated ones
   (see ``bwt``). No suffix is sorted across shards. Where one class stands more than once, its hash has already
   grouped the equal ranges, and the merge gives its windows their weight; windows that only ranges of
   different classes share (about a fifth of the ranges on the test data) are found by the merge alone.
3. A key with more than ``crowd`` classes would be one large task. Its windows are dealt by where their anchor
   stands in them, first sixteen places together, then, where that is still a crowd, one: equal windows stay
   together, and the bytes that all windows of such a part share become part of its key. The parts are
   classed, weighed and merged like others; at one place a part is a single window, so there its class alone
   counts and the merge has nothing to add.
4. Spans are carried to all ranges of their class, gathered for each document and applied to its bytes.

Keys and classes are 64-bit hashes; nothing else is approximate. Matches never cross documents; overlaps
count; strings are judged on the input. Each repeated window is removed everywhere.

Defined cases: null text is empty; texts shorter than ``length`` stay whole; repeated rows repeat each other
and lose all such bytes; doc_id may be null or repeated; an empty table gives an empty result; other columns
are ignored. A very long text is read in overlapping pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bwt
from . import textkit as K
from .common import cut, free, numbered, only, table

PIECE = 4 << 20
BATCH = 1 << 20  # bytes that one merge takes at a time; a key's ranges are at most as many as fill it


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place but the last 7."""
    return np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,))


def anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start of each range, and its anchor, over the documents of a chunk."""
    none = np.zeros(0, np.int64)
    n, span = len(data), length - gram + 1
    if n < length:
        return none, none, none
    h = eights(data) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    key = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)  # ties go to the first place
    # least of every run of `span` places (van Herk): block suffix minima meet block prefix minima
    m = n - length + 1
    k = key[: m + span - 1]
    pad = -len(k) % span
    grid = np.concatenate([k, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, span)
    pre = np.minimum.accumulate(grid, axis=1).reshape(-1)
    suf = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    at = (np.minimum(suf[:m], pre[span - 1 : span - 1 + m]) & np.uint64((1 << 24) - 1)).astype(np.int64)
    size = np.diff(offs)
    own = np.flatnonzero(size >= length)
    count = size[own] - length + 1
    start = np.repeat(offs[:-1][own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    if not len(start):
        return none, none, none
    a = at[start]
    edge = np.flatnonzero((a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1)) + 1
    first = np.concatenate([[0], edge])
    last = np.concatenate([edge, [len(start)]]) - 1
    return start[first], start[last], a[first]


def pieces(data: np.ndarray, offs: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, document of each, its first byte's place): a document above PIECE in pieces that overlap by length - 1."""
    if len(data) <= 2 * PIECE:
        yield data, offs, np.arange(len(offs) - 1), np.zeros(len(offs) - 1, np.int64)
        return
    for d in range(len(offs) - 1):
        own = data[offs[d] : offs[d + 1]]
        for lo in range(0, max(1, len(own) - length + 1), PIECE):
            part = own[lo : lo + PIECE + length - 1]
            yield part, np.array([0, len(part)]), np.array([d]), np.array([lo])


def _ranges(src: DataFrame, length: int, gram: int) -> DataFrame:
    """rid, at (first window start << 32 | further windows << 16 | from there to the anchor), key, class of each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in K.chunks(b.column(1), 1 << 20):
                rid = b.column(0).slice(i, j - i).to_numpy(zero_copy_only=False)
                for part, o, doc, shift in pieces(data, offs, length):
                    s1, s2, a = anchors(part, o, length, gram)
                    if not len(s1):
                        continue
                    d = np.searchsorted(o, s1, "right") - 1
                    at = ((s1 - o[d] + shift[d]) << 32) | ((s2 - s1) << 16) | (a - s1)
                    key, cls = K.span_hash(part, a, a + gram), K.mix(K.span_hash(part, s1, s2 + length) + (a - s1).astype(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(rid[doc[d]], pa.int64()), pa.array(at, pa.int64()), pa.array(key.view(np.int64)), pa.array(cls.view(np.int64))], names=["rid", "at", "key", "cls"])

    return src.mapInArrow(run, "rid long, at long, key long, cls long")


BODY = "key long, cls long, rid long, at long, weight long, body binary"


def _bytes_of(joined: DataFrame, length: int) -> DataFrame:
    """The bytes of each wanted range; ``joined``: rid, text, want (key, cls, at, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                raw = b.column(1)[r].as_py().encode()
                want = b.column(2)[r].as_py()
                at = [w["at"] for w in want]
                body = [raw[a >> 32 : (a >> 32) + (a >> 16 & 0xFFFF) + length] for a in at]
                cols = [[w[c] for w in want] for c in ("key", "cls")] + [[b.column(0)[r].as_py()] * len(at), at, [w["weight"] for w in want]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(body, pa.binary())], names=["key", "cls", "rid", "at", "weight", "body"])

    return joined.mapInArrow(run, BODY)


def _parts(bodies: DataFrame, length: int, places: int) -> DataFrame:
    """Ranges dealt by where the anchor stands in their windows, ``places`` together: key2, cls2, place (as of a range) and bytes of each part, and its first window in the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, _, _, at, _, body = (b.column(c).to_pylist() for c in range(6))
            src, first, own, bytes_, lo, hi, group = [], [], [], [], [], [], []
            for r, (a, x) in enumerate(zip(at, body)):
                n, anchor = (a >> 16 & 0xFFFF) + 1, a & 0xFFFF
                w = 0
                while w < n:  # windows w to z - 1 have their anchor in one group of places
                    g = (anchor - w) // places
                    z = min(n, anchor - g * places + 1)
                    src.append(r)
                    first.append(w)
                    own.append(((a >> 32) + w) << 32 | (z - 1 - w) << 16 | (anchor - w))
                    bytes_.append(x[w : z - 1 + length])
                    lo.append(anchor - g * places - w)  # what all windows of the group share begins and ends here
                    hi.append(anchor - g * places - places + 1 + length - w)
                    group.append(g)
                    w = z
            n = np.array([len(x) for x in bytes_], np.int64)
            data, begin = np.frombuffer(b"".join(bytes_), np.uint8), np.cumsum(n) - n
            of = np.array(src, np.int64)
            h = K.span_hash(data, begin + np.array(lo, np.int64), begin + np.array(hi, np.int64))
            key2 = K.mix(h ^ K.mix(np.array(key, np.int64)[of].view(np.uint64) + np.array(group, np.uint64)))
            cls2 = K.mix(K.span_hash(data, begin, begin + n) + np.array(lo, np.int64).astype(np.uint64))
            cols = [b.column(c).take(pa.array(of)) for c in range(5)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(key2.view(np.int64)), pa.array(cls2.view(np.int64)), pa.array(own, pa.int64()), pa.array(first, pa.int64()), pa.array(bytes_, pa.binary())], names=["key", "cls", "rid", "at", "weight", "key2", "cls2", "at2", "first", "body"])

    return bodies.mapInArrow(run, "key long, cls long, rid long, at long, weight long, key2 long, cls2 long, at2 long, first long, body binary")


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    e = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return e[::2], e[1::2]


def _merged(rows: DataFrame, length: int, batch: int = BATCH) -> DataFrame:
    """key, cls, rid, at, weight and runs s to e - 1 of repeated windows; rows of one key stand together."""

    def solve(key, cls, rid, at, weight, body):
        again = bwt.repeated(body, [len(x) - length + 1 for x in body], weight, length)
        src, out = [], [[], []]
        for k, f in enumerate(again):
            for col, v in zip(out, runs(f)):
                col += v.tolist()
            src += [k] * (len(out[0]) - len(src))
        cols = [pa.array(np.array(c, np.int64)[src] if src else [], pa.int64()) for c in (key, cls, rid, at, weight)]
        return pa.RecordBatch.from_arrays(cols + [pa.array(c, pa.int64()) for c in out], names=["key", "cls", "rid", "at", "weight", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(6)]
        size = 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in range(6))):
                if size >= batch and row[0] != held[0][-1]:
                    yield solve(*held)
                    held, size = [[] for _ in range(6)], 0
                for col, v in zip(held, row):
                    col.append(v)
                size += len(row[5])
        if held[0]:
            yield solve(*held)

    return rows.mapInArrow(run, "key long, cls long, rid long, at long, weight long, s long, e long")


def _solved(bodies: DataFrame, length: int, crowd: int, places: tuple[int, ...]) -> DataFrame:
    """key, cls, rid, at, weight, s and e as of :func:`_merged`, for bodies in any order."""
    crowds = bodies.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    together = lambda df: _merged(df.repartition("key").sortWithinPartitions("key"), length)
    if not places:
        return together(bodies)
    crowds = cut(crowds.where(F.col("c") > crowd).select("key"), "crowds")
    if crowds.isEmpty():
        return together(bodies)
    parts = cut(_parts(bodies.join(crowds, "key", "left_semi").select(*bodies.columns), length, places[0]), "parts")
    sums = parts.groupBy("key2", "cls2").agg(F.sum("weight").alias("weight"), F.min(F.struct("rid", "at2")).alias("m"))
    one = parts.join(sums.select("key2", "cls2", "m", F.col("weight").alias("sum")), ["key2", "cls2"]).where((F.col("rid") == F.col("m.rid")) & (F.col("at2") == F.col("m.at2")))
    one = cut(one.select(F.col("key2").alias("key"), F.col("cls2").alias("cls"), "rid", F.col("at2").alias("at"), F.col("sum").alias("weight"), "body"), "bodies")
    got = _solved(one, length, crowd, places[1:]).select(F.col("key").alias("key2"), F.col("cls").alias("cls2"), "s", "e")
    back = parts.drop("body").join(got, ["key2", "cls2"]).select("key", "cls", "rid", "at", "weight", (F.col("first") + F.col("s")).alias("s"), (F.col("first") + F.col("e")).alias("e"))
    return together(bodies.join(crowds, "key", "left_anti").select(*bodies.columns)).unionAll(back)


def spans(src: DataFrame, length: int = 200, gram: int = 64, crowd: int = 3000) -> DataFrame:
    """(rid, lo, hi): spans whose union is what repeated ``length``-byte strings cover; ``src``: rid, text."""
    rows = cut(_ranges(src, length, gram), "windows")
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("total")).where("total > 1").select("key")
    hit = cut(rows.join(keys, "key"), "ranges")
    free(rows)
    want = hit.groupBy("key", "cls").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("rid", "at")).alias("m"))
    want = want.select("key", "cls", "weight", F.col("m.rid").alias("rid"), F.col("m.at").alias("at"))  # one range of each class
    per_doc = want.groupBy("rid").agg(F.collect_list(F.struct("key", "cls", "at", "weight")).alias("want"))  # a document's own ranges
    bodies = cut(_bytes_of(src.join(per_doc, "rid").select("rid", "text", "want"), length), "bodies")
    found = cut(_solved(bodies, length, crowd, (16, 1)), "found")
    start = lambda at: F.shiftright(at, 32)
    span = lambda df: df.select("rid", (start("at") + F.col("s")).alias("lo"), (start("at") + F.col("e") - 1 + length).alias("hi"))
    all_of = hit.join(found.where("weight > 1").select("key", "cls", "s", "e"), ["key", "cls"])
    return span(found.where("weight = 1")).unionAll(span(all_of))


def dedup(docs: DataFrame, length: int = 200, gram: int = 64, crowd: int = 3000, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row; with ``texts`` also what is kept, as bytes."""
    src = numbered(only(docs, "doc_id", "text")).select(F.col("row.doc_id").alias("doc_id"), "rid", F.coalesce("row.text", F.lit("")).alias("text"))
    got = spans(src.select("rid", "text"), length, gram, crowd)
    # at most a span for each of a document's ranges and windows runs
    per_doc = got.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("cuts"))
    joined = src.join(per_doc, "rid", "left").select("doc_id", "text", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                out: list[list] = [[], [], [], [], []]
                for text, cuts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    raw = text.encode()
                    lo, hi = merged_spans(cuts or [])
                    keep, last = [], 0
                    for x, y in zip(lo, hi):
                        keep.append(raw[last:x])
                        last = y
                    keep.append(raw[last:])
                    kept = b"".join(keep)
                    for col, v in zip(out, (len(raw), len(raw) - len(kept), len(lo), hashlib.sha256(kept).hexdigest(), kept)):
                        col.append(v)
                cols = [b.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(out[4], pa.binary())] * texts, names=names + ["kept"] * texts)

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)


def merged_spans(cuts: list[dict]) -> tuple[list[int], list[int]]:
    """Maximal runs of the union of spans."""
    lo: list[int] = []
    hi: list[int] = []
    for a, b in sorted((c["lo"], c["hi"]) for c in cuts):
        if hi and a <= hi[-1]:
            hi[-1] = max(hi[-1], b)
        else:
            lo.append(a)
            hi.append(b)
    return lo, hi


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
ORACLES: dict[str, str] = {}
