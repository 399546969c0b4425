"""Line dedup by winnowing over line hashes (operator 2).

A document is its lines (split at line feeds) and each line stands as one unit, or as two if it has
``long_words`` words or more. Of every ``window`` consecutive units the least hash is selected (the last of
equals); the selected positions are the fingerprints, and any two documents that share ``window`` units in a
row share one (with the production window of 2: two lines, or one long line). Fingerprints that stand once
are dropped. The positions of the others are joined, each with the first place in order of (doc_id, row,
line) that holds the same units around the fingerprint, so a popular line costs one row for each of its
places and never their pairs. Joined positions at one distance between the same two documents are
extended both ways, through the windows that touch, to maximal runs, and the lines of a run go from the later
document. So exactly the later repeats of a run of units go, and the first stays whole. Since every window of
a repeated run is itself joined, a run is the union of its windows: extension puts them together, it finds
no line that no window holds.

Units are compared by 128-bit BLAKE2 digests of their bytes.

Defined cases: null text stays null and has no lines; an empty text is one empty line; empty lines are
units like others; a null doc_id comes last; repeated rows are later copies and lose their runs; a document
whose every line goes becomes the empty text; an empty table gives an empty result.

Scale: one pass makes the units; fingerprints and windows are counted with combining before the shuffle and
joined back by key, where AQE splits hot keys; spans are gathered for each document.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import textkit as K
from .common import cut, numbered, only, schema_of, table

NOT_LF = ~K.byte_class((10, 10))
SPACE = ~K.byte_class((0x20, 0x20), (0x09, 0x0D))


def units(data: np.ndarray, offs: np.ndarray, long_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of the units (two numbers each), their lines in the document, and where each document's units begin."""
    n_docs = len(offs) - 1
    feeds = np.flatnonzero(data == 10)
    d = np.searchsorted(offs, feeds, "right") - 1
    starts = np.concatenate([offs[:-1], feeds + 1])
    ends = np.concatenate([offs[1:], feeds])
    owner = np.concatenate([np.arange(n_docs), d])
    by = np.lexsort((starts, owner))
    starts, owner = starts[by], owner[by]
    last = np.concatenate([owner[1:] != owner[:-1], [True]]) if len(owner) else np.zeros(0, bool)
    ends = np.where(last, offs[1:][owner], np.concatenate([starts[1:], [0]])[: len(starts)] - 1)
    raw = data.tobytes()
    h = np.frombuffer(b"".join([blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(starts.tolist(), ends.tolist())]), "<u8").reshape(-1, 2)
    w, _, _ = K.word_spans(data, offs, SPACE)
    words = np.searchsorted(w, ends) - np.searchsorted(w, starts)
    first = np.searchsorted(owner, np.arange(n_docs + 1))
    line = np.arange(len(owner)) - first[owner]
    twice = 1 + (words >= long_words)
    at = np.repeat(np.arange(len(h)), twice)
    second = np.concatenate([[False], at[1:] == at[:-1]]) if len(at) else np.zeros(0, bool)
    u = np.where(second[:, None], K.mix(h[at] + np.uint64(0xABCDEF)), h[at])
    return u, line[at], np.concatenate([[0], np.cumsum(twice)])[first]


def winnow(u: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each window, its selected place, its document)."""
    n = np.diff(first) - window + 1
    own = np.flatnonzero(n > 0)
    c = n[own]
    start = np.repeat(first[own] - (np.cumsum(c) - c), c) + np.arange(c.sum())
    pick, low = start.copy(), u[start] if len(start) else np.zeros(0, np.uint64)
    for j in range(1, window):
        v = u[start + j]
        up = v <= low
        pick, low = np.where(up, start + j, pick), np.where(up, v, low)
    return start, pick, np.repeat(own, c)


def _windows(src: DataFrame, window: int, long_words: int) -> DataFrame:
    """rid, doc_id, lo, hi (first and last line of each window), print (selected unit), at (its place), key and key2 (digest of its units)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in K.chunks(b.column(2)):
                u, line, first = units(data, offs, long_words)
                s, p, d = winnow(u[:, 0], first, window)
                keys = [K.gram_hash(np.ascontiguousarray(u[:, k]), window)[s].view(np.int64) if len(s) else np.zeros(0, np.int64) for k in (0, 1)]
                own = pa.array(d)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i).take(own), b.column(1).slice(i, j - i).cast(pa.int64()).take(own), pa.array(line[s], pa.int32()), pa.array(line[s + window - 1] if len(s) else s, pa.int32()), pa.array(u[p, 0].view(np.int64)), pa.array(p - first[d], pa.int64()), *map(pa.array, keys)],
                    names=["rid", "doc_id", "lo", "hi", "print", "at", "key", "key2"],
                )

    return src.mapInArrow(run, "rid long, doc_id long, lo int, hi int, print long, at long, key long, key2 long")


def extended(matches: list[dict]) -> list[tuple[int, int]]:
    """First and last lines of the maximal runs that joined positions (lo, hi, from_rid, from_lo) make up."""
    out: list[tuple[int, int]] = []
    at = None
    for side, lo, hi in sorted(((m["from_rid"], m["lo"] - m["from_lo"]), m["lo"], m["hi"]) for m in matches):
        if side == at and lo <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
        at = side
    return out


def dedup_rows(rows: DataFrame, window: int = 2, long_words: int = 8) -> DataFrame:
    """row (its text without the later repeated runs), n_lines and n_removed (numbers of lines); ``rows``: see common.numbered."""
    src = rows.select("rid", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text")).where("text IS NOT NULL")
    w = _windows(src, window, long_words)
    # fingerprints that stand in more than one place; several windows may select one place
    ends = [f(c).alias(f"{n}{c}") for n, f in (("lo_", F.min), ("hi_", F.max)) for c in ("rid", "at")]
    prints = w.groupBy("print").agg(*ends).where("lo_rid <> hi_rid OR lo_at <> hi_at").select("print")
    near = cut(w.join(prints, "print", "left_semi").drop("print", "at"), "windows")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "rid", "lo")
    heads = near.groupBy("key", "key2").agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "key2", "head")
    later = near.join(heads, ["key", "key2"]).where((F.col("rid") != F.col("head.rid")) | (F.col("lo") != F.col("head.lo")))
    spans = later.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi", F.col("head.rid").alias("from_rid"), F.col("head.lo").alias("from_lo"))).alias("matches"))
    kind = T.StructType([rows.schema["row"], *schema_of("n_lines long, n_removed long").fields])
    target = to_arrow_schema(kind)
    names = rows.schema["row"].dataType.names
    text_at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields = b.column(0).flatten()
            texts, n_lines, n_gone = [], [], []
            for text, matches in zip(fields[text_at].to_pylist(), b.column(1).to_pylist()):
                lines = [] if text is None else text.split("\n")
                n_lines.append(len(lines))
                gone = np.zeros(len(lines), bool)
                for lo, hi in extended(matches or []):
                    gone[lo : hi + 1] = True
                n_gone.append(int(gone.sum()))
                texts.append("\n".join(x for x, g in zip(lines, gone) if not g) if n_gone[-1] else text)
            fields[text_at] = pa.array(texts, fields[text_at].type)
            cols = [pa.StructArray.from_arrays(fields, names=names), pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, target)], schema=target)

    return rows.join(spans, "rid", "left").select("row", "matches").mapInArrow(run, kind)


def deduped(docs: DataFrame, window: int = 2, long_words: int = 8) -> DataFrame:
    """The rows of ``docs`` with later repeated runs gone from ``text``."""
    return dedup_rows(numbered(docs), window, long_words).select("row.*")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup_rows(numbered(only(table(spark, sf_dir, "documents"), "doc_id", "text")))
    return got.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.col("row.text").cast("binary"), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later repeats of runs of lines; n_chars follows where there is such a column."""
    got = dedup_rows(numbered(docs))
    if "n_chars" in docs.columns:
        chars = F.when(F.col("n_removed") > 0, F.length("row.text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
        got = got.withColumn("row", F.col("row").withField("n_chars", chars))
    return got.select("row.*")


SQL = r"""
WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS rid FROM documents),
l AS (
  SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d WHERE text IS NOT NULL
), w AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 8 AS long, lead(line) OVER (PARTITION BY rid ORDER BY k) AS nxt FROM l
), win AS (
  SELECT rid, doc_id, k AS lo, k + 1 AS hi, line || chr(10) || nxt AS g, 2 AS kind FROM w WHERE nxt IS NOT NULL
  UNION ALL SELECT rid, doc_id, k, k, line, 1 FROM w WHERE long
), r AS (
  SELECT *, row_number() OVER (PARTITION BY kind, g ORDER BY doc_id NULLS LAST, rid, lo) AS n FROM win
), gone AS (SELECT DISTINCT rid, unnest(range(lo, hi + 1)) AS k FROM r WHERE n > 1),
kept AS (
  SELECT l.rid, count(*) AS n_lines, count(gone.k) AS n_removed, string_agg(CASE WHEN gone.k IS NULL THEN line END, chr(10) ORDER BY l.k) AS t
  FROM l LEFT JOIN gone ON gone.rid = l.rid AND gone.k = l.k GROUP BY l.rid
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN text IS NOT NULL THEN sha256(coalesce(t, '')) END AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLES = {"op2_line_dedup": SQL}
