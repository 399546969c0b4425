"""Benchmark decontamination by Wu-Manber multi-pattern search over words (operator 7).

Words of an item and of a document are runs of ASCII letters, digits and non-ASCII characters after A-Z
are lower-cased. A pattern is a window of ``window`` consecutive item words (the whole item if it has
fewer). Patterns are grouped by length m; for each group the search slides over the document's words with
a block of B words: a shift table tells how far the block at the window's end lets it jump (m - B + 1
where the block is in no pattern), a zero shift opens the bucket of that suffix block, and the candidates
there are compared with the text word for word. Many documents are searched in step, one lane for each
run of words, so that a step is a few numpy operations.

Defined cases: null or wordless texts have no words and hit nothing; items with null id or no words take
no part; rows of one item_id are one item, the union of their windows; repeated documents are answered
row by row; other columns of either table are ignored.

Scale: one narrow pass over the documents, no shuffle. The patterns travel in the task closure only while
they stay under ``max_pattern_mb`` of text (about forty times that in the driver and in each worker); a larger
benchmark is searched in blocks of items, and the per-row partial hits (spans, not texts) of the blocks are
merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .common import only, table

WORD = K.byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LANE = 512  # words in a lane


def split_words(text: str | None) -> list[bytes]:
    d = K.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    s, e, _ = K.word_spans(d, np.array([0, len(d)]), WORD)
    raw = d.tobytes()
    return [raw[a:b] for a, b in zip(s, e)]


class Patterns:
    """Patterns of one length: shift table by block hash, suffix buckets, and words for the comparison."""

    BITS = 16

    def __init__(self, m: int, windows: dict[tuple[bytes, ...], set]):
        self.m, self.b = m, 2 if m >= 4 else 1
        self.rows = sorted(windows)
        self.items = [sorted(windows[w]) for w in self.rows]
        words = [w for row in self.rows for w in row]
        d = np.frombuffer(b"".join(words), np.uint8)
        e = np.cumsum([len(w) for w in words])
        s = np.concatenate([[0], e[:-1]]).astype(np.int64)
        self.hash = K.span_hash(d, s, e).reshape(-1, m)
        self.shift = np.full(1 << self.BITS, m - self.b + 1, np.int64)
        for end in range(self.b, m + 1):  # later ends give smaller shifts, so they overwrite last
            self.shift[self.slot(self.block(self.hash, end))] = m - end
        suffix = self.block(self.hash, m)
        order = np.argsort(suffix, kind="stable")
        self.order, self.suffix = order, suffix[order]

    def block(self, h: np.ndarray, end: int) -> np.ndarray:
        return h[:, end - 1] if self.b == 1 else K.gram_hash(h[:, end - 2 : end].reshape(-1), 2)[::2]

    def slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.BITS)).astype(np.int64)

    def search(self, words: np.ndarray, block: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window start, pattern) of every hash-equal window; ``first``: where each document's words begin."""
        m, found_at, found = self.m, [], []
        counts = np.diff(first) - m + 1  # windows of each document
        docs = np.flatnonzero(counts > 0)
        if not len(docs):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lanes = -(-counts[docs] // LANE)
        lead = np.repeat(first[docs], lanes) + LANE * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        stop = np.minimum(lead + LANE, np.repeat(first[docs] + counts[docs], lanes))
        at = lead
        while len(at):
            h = block[at + m - self.b]
            step = self.shift[self.slot(h)]
            hit = np.flatnonzero(step == 0)
            if len(hit):
                lo = np.searchsorted(self.suffix, h[hit], "left")
                n = np.searchsorted(self.suffix, h[hit], "right") - lo
                pat = self.order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                pos = np.repeat(at[hit], n)
                ok = np.ones(len(pos), bool)
                for j in range(m):
                    ok &= words[pos + j] == self.hash[pat, j]
                found_at.append(pos[ok])
                found.append(pat[ok])
                step[hit] = 1
            at = at + step
            live = at < stop
            at, stop = at[live], stop[live]
        return np.concatenate([np.zeros(0, np.int64), *found_at]), np.concatenate([np.zeros(0, np.int64), *found])


def build(items: list[tuple[int, str | None]], window: int) -> list[Patterns]:
    by: dict[int, dict[tuple[bytes, ...], set]] = {}
    for item, text in items:
        w = split_words(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            by.setdefault(m, {}).setdefault(tuple(w[i : i + m]), set()).add(item)
    return [Patterns(m, by[m]) for m in sorted(by)]


def scan_chunk(data: np.ndarray, offs: np.ndarray, groups: list[Patterns]):
    """Word count, and for each document its sorted hit words and items."""
    data = K.LOWER[data]
    s, e, first = K.word_spans(data, offs, WORD)
    n_docs = len(offs) - 1
    hits: list[set] = [()] * n_docs
    cover = np.zeros(len(s) + 1, np.int64)
    if len(s):
        words = K.span_hash(data, s, e)
        pairs = K.gram_hash(words, 2)
        for g in groups:
            at, pat = g.search(words, words if g.b == 1 else pairs, first)
            for a, p in zip(at.tolist(), pat.tolist()):  # the direct comparison
                row = g.rows[p]
                if all(data[s[a + j] : e[a + j]].tobytes() == row[j] for j in range(g.m)):
                    cover[a] += 1
                    cover[a + g.m] -= 1
                    d = int(np.searchsorted(first, a, "right")) - 1
                    hits[d] = hits[d] or set()
                    hits[d].update(g.items[p])
    run = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return np.diff(first), np.diff(run[first]), hits, run, first, s, e


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep: tuple[str, ...] = ("doc_id",), max_pattern_mb: int = 4) -> DataFrame:
    """``keep`` columns, n_words, n_hit, n_items, items (sorted as strings), items_sha256 and contaminated for each document row."""
    items = only(benchmark, "item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    if size > max_pattern_mb << 20:
        return _in_blocks(docs, items, window, keep, max_pattern_mb, size)
    groups = build([(r["item_id"], r["text"]) for r in items.toLocalIterator()], window)
    return _scan(docs, groups, keep)


def _with_text(keep: tuple[str, ...]) -> tuple[str, ...]:
    return keep if "text" in keep else (*keep, "text")


def _scan(docs: DataFrame, groups: list[Patterns], keep: tuple[str, ...]) -> DataFrame:
    own = [f for f in docs.schema.fields if f.name in keep]
    ddl = docs.select(*[f"`{k}`" for k in keep]).schema
    from .common import schema_of

    out = ddl
    for f in schema_of("n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean").fields:
        out = out.add(f)
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(out)
    assert len(own) == len(keep)
    cols_in = _with_text(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in K.chunks(batch.column(cols_in.index("text"))):
                n_words, n_hit, hits, *_ = scan_chunk(data, offs, groups)
                names = [sorted(map(str, h)) for h in hits]
                cols = [batch.column(k).slice(i, j - i) for k in range(len(keep))]
                cols += [pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in names], pa.int64()), pa.array(names, pa.list_(pa.string()))]
                cols += [pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]), pa.array(n_hit > 0)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, target)], schema=target)

    return docs.select(*[f"`{k}`" for k in cols_in]).mapInArrow(run, out)


def _in_blocks(docs, items, window, keep, max_mb, size) -> DataFrame:
    """A benchmark above the bound: one pass for each block of items; counts of hit words need the spans' union, so spans travel."""
    from .common import cut, ranked

    base = cut(docs.select(*[f"`{k}`" for k in _with_text(keep)]).withColumn("_rid", F.monotonically_increasing_id()), "decontam")
    n = -(-size // max(1 << 12, max_mb << 20)) + 1
    parts = cut(items.withColumn("_blk", F.pmod(F.xxhash64("item_id"), F.lit(n))), "items")
    spans = None
    for b in range(n):
        groups = build([(r["item_id"], r["text"]) for r in parts.where(F.col("_blk") == b).toLocalIterator()], window)

        def run(batches, groups=groups):
            for batch in batches:
                for i, j, data, offs in K.chunks(batch.column(1)):
                    _, n_hit, hits, run_, first, s, _ = scan_chunk(data, offs, groups)
                    rid = batch.column(0).slice(i, j - i).to_numpy(zero_copy_only=False)
                    rows = np.flatnonzero(n_hit)
                    at = [np.flatnonzero(np.diff(run_[first[d] : first[d + 1] + 1])).tolist() for d in rows]
                    yield pa.RecordBatch.from_pydict({"_rid": pa.array(rid[rows], pa.int64()), "at": pa.array(at, pa.list_(pa.int64())), "it": pa.array([sorted(map(str, hits[d])) for d in rows], pa.list_(pa.string()))})

        got = base.select("_rid", "text").mapInArrow(run, "_rid long, at array<long>, it array<string>")
        spans = got if spans is None else spans.unionAll(got)
    hit = cut(spans, "spans").groupBy("_rid").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("it")))).alias("items"))
    words = _scan(base, [], (*keep, "_rid")).select(*[f"`{k}`" for k in keep], "_rid", "n_words")
    none = F.array().cast("array<string>")
    return (
        words.join(hit, "_rid", "left").drop("_rid")
        .select(*[f"`{k}`" for k in keep], "n_words", F.coalesce(F.size("at"), F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).withColumn("contaminated", F.col("n_hit") > 0)
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, window: int = 10, max_pattern_mb: int = 4) -> DataFrame:
    """Documents without any benchmark window; the columns of ``docs``."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return find(rows, table(spark, sf_dir, "benchmark"), window, ("row",), max_pattern_mb).where(~F.col("contaminated")).select("row.*")


SQL = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w, row_number() OVER () AS rid
  FROM documents
), ms AS (SELECT DISTINCT m FROM win), pos AS (
  SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, ms WHERE len(w) >= m
), hit AS (
  SELECT p.rid, p.i, p.m, win.item_id FROM (SELECT rid, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM pos) p JOIN win ON win.m = p.m AND win.g = p.g
), hw AS (
  SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS k FROM hit) GROUP BY rid
), hi AS (
  SELECT rid, count(*) AS n_items, string_agg(it, ',' ORDER BY it) AS s FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS it FROM hit) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""

QUERIES = {"op7_decontamination": op7_decontamination}
ORACLES = {"op7_decontamination": SQL}
