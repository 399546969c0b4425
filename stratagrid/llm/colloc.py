"""Phrase collocations by contiguous pattern growth (operator 11).

Every occurrence of a word is a pointer to the up to ``longest`` words of its piece that start there. The pointers of
a prefix word go to one task, which sorts them by the words behind the prefix; a frequent prefix then owns a
contiguous range of pointers, and growing it to the right splits this range by the next word, depth first, for as
long as ranges hold ``least`` occurrences. Equal pointers of a chunk of text travel as one with their number.

A word with more than ``share`` occurrences (in its language) is hot. The range of a prefix that consists of hot words
only is dealt over the tasks by its next word as well, and so on; the counts of such prefixes are added up afterwards, all
other counts are whole where they are made. There is no more than one hot word for each ``share`` words of the corpus,
and only their 64-bit hashes are sent to the tasks (a word of the same hash would be dealt alike, and counted right).

Scores compare a phrase with the parts of each cut, in decimal arithmetic of 38 digits: exact for counts below 10**16.

Defined cases: null and empty texts hold no words; a null language is ``und``; repeated rows count again; other
columns are ignored; an empty table gives an empty result; words of any length count.

Scale: the words are counted first (one row for each word, language and chunk is shuffled), then every occurrence is
shuffled once as text, packed by task. Memory: a chunk of text, cut at the end of a piece, and the pointers of
one task, about ``share`` of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkit as K
from .common import cut, free, table

CHUNK = 3 << 20
SHARE = 500_000
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False
POINTERS = "lang string, bucket int, counts binary, reach binary, words binary"


class Chunk:
    """The words of some text, each followed by one space: bytes, where each begins, its piece, its language and its code."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, langs: np.ndarray):
        is_word = _WORD[data]
        held = is_word.copy()
        held[1:] |= is_word[:-1]
        first = is_word.copy()
        first[1:] &= ~is_word[:-1]
        starts = np.flatnonzero(first)
        self.piece = np.cumsum(_BREAK[data], dtype=np.int32)[starts]
        self.lang = langs[np.searchsorted(offs, starts, "right") - 1]
        self.bytes = np.where(is_word, K.LOWER[data], np.uint8(0x20))[held]
        self.at = np.append(np.cumsum(held)[starts] - 1, len(self.bytes)).astype(np.int64)
        self.coded, self.code = dictionary(self.bytes, self.at)

    def reach(self, longest: int) -> np.ndarray:
        """Words of the piece from each one on, itself included, at most ``longest``."""
        out = np.ones(len(self.piece), np.uint8)
        for k in range(1, min(longest, len(out))):
            out[:-k] += self.piece[k:] == self.piece[:-k]
        return out


def dictionary(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct words, each with its space, and the code of every word."""
    d = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
    return d.dictionary, d.indices.to_numpy()


def text_chunks(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[Chunk, list[str]]]:
    """Chunks of about ``limit`` bytes of a batch (lang, text), cut at the ends of pieces, and the names of their language codes."""
    lang = batch.column(0).dictionary_encode()
    names, codes = lang.dictionary.to_pylist(), lang.indices.to_numpy()
    texts = pc.binary_join_element_wise(pc.fill_null(batch.column(1).cast(pa.large_string()), ""), *[pa.scalar(x, pa.large_string()) for x in ("", "\n")])
    for lo, hi, data, offs in K.chunks(texts, limit):
        a = 0
        while a < len(data):
            b = len(data)
            if b - a > 2 * limit:
                ends = np.flatnonzero(_BREAK[data[a + limit : a + 2 * limit]])
                if not len(ends):  # no piece ends there: on to where this one does
                    step = a + 2 * limit
                    while step < b and not len(ends := np.flatnonzero(_BREAK[data[step : step + limit]])):
                        step += limit
                    b = step + int(ends[0]) + 1
                else:
                    b = a + limit + int(ends[0]) + 1
            c = Chunk(data[a:b], np.maximum(offs[:-1] - a, -1), codes[lo:hi])
            if len(c.piece):
                yield c, names
            a = b


def count_words(docs: DataFrame, lang: str, text: str, chunk: int) -> DataFrame:
    """lang, phrase, f of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, names in text_chunks(batch, chunk):
                key = c.lang.astype(np.int64) * len(c.coded) + c.code
                some, n = np.unique(key, return_counts=True)
                words = [w[:-1].decode() for w in c.coded.take(pa.array(some % len(c.coded))).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(some // len(c.coded))), pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["lang", "phrase", "f"])

    own = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")), F.col(f"`{text}`"))
    return own.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def word_hash(coded: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word of a dictionary."""
    _, at, data = coded.buffers()
    at = np.frombuffer(at, np.int64)[coded.offset : coded.offset + len(coded) + 1]
    return K.span_hash(np.frombuffer(data, np.uint8), at[:-1], at[1:])


def in_language(h: np.ndarray, lang: str) -> np.ndarray:
    b = np.frombuffer(lang.encode() + b" ", np.uint8)
    return K.mix(h ^ K.span_hash(b, np.array([0]), np.array([len(b)])))


def is_hot(hot: np.ndarray, h: np.ndarray) -> np.ndarray:
    return hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h if len(hot) else np.zeros(len(h), bool)


def dense(columns: list[np.ndarray], top: list[int]) -> np.ndarray:
    """One int64 for each row, ordered as the rows are; ``columns`` hold 0..top - 1."""
    key, most = columns[0].astype(np.int64), top[0]
    for c, t in zip(columns[1:], top[1:]):
        if most * t >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            most = int(key.max()) + 1
        key, most = key * t + c, most * t
    return key


def pointers(docs: DataFrame, lang: str, text: str, longest: int, hot: np.ndarray, buckets: int, chunk: int) -> DataFrame:
    """Rows of many pointers each: language, task, and of each pointer how often it stands in the chunk, its words and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, names in text_chunks(batch, chunk):
                reach, n, d = c.reach(longest), len(c.piece), len(c.coded)
                h = word_hash(c.coded)
                ahead = np.append(c.code, np.zeros(longest, np.int32))
                cols = [np.where(reach > k, ahead[k : k + n] + 1, 0) for k in range(longest)]
                key = dense([c.lang, *cols], [len(names), *[d + 1] * longest])
                _, first, times = np.unique(key, return_index=True, return_counts=True)
                lang_of, size = c.lang[first], reach[first].astype(np.int64)
                # the hash of a pointer's first word, and of further ones while all before are hot
                to = np.zeros(len(first), np.uint64)
                own = {i: in_language(h, names[i]) for i in np.unique(lang_of).tolist()}
                flags = {i: is_hot(hot, x) for i, x in own.items()}
                for i in own:
                    mine = np.flatnonzero(lang_of == i)
                    x, o = np.zeros(len(mine), np.uint64), np.ones(len(mine), bool)
                    for k in range(longest):
                        at = np.flatnonzero(o & (size[mine] > k))
                        code = c.code[first[mine[at]] + k]
                        x[at] = K.mix(x[at] + own[i][code] + np.uint64(k))
                        o[:] = False
                        o[at] = flags[i][code]
                    to[mine] = x
                bucket = (to % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(lang_of.astype(np.int64) * buckets + bucket, kind="stable")  # by words inside a task's pointers
                first, times, size, lang_of, bucket = first[order], times[order], size[order], lang_of[order], bucket[order]
                a, b = c.at[first], c.at[first + size]
                stop = np.concatenate([[0], np.cumsum(b - a)])
                packed = c.bytes[np.repeat(a - stop[:-1], b - a) + np.arange(stop[-1])]
                edge = np.concatenate([[0], np.flatnonzero(np.diff(lang_of.astype(np.int64) * buckets + bucket)) + 1, [len(first)]])
                cells = lambda x, at: pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edge) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(x)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i] for i in lang_of[edge[:-1]]], pa.string()), pa.array(bucket[edge[:-1]], pa.int32()), cells(times.astype("<u4"), edge * 4), cells(size.astype(np.uint8), edge), cells(packed, stop[edge])],
                    names=["lang", "bucket", "counts", "reach", "words"],
                )

    own = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")), F.col(f"`{text}`"))
    return own.mapInArrow(run, POINTERS)


class Projection:
    """The pointers of one task, sorted by their words; runs[d] are the ranges of pointers that share d + 1 words."""

    def __init__(self, counts: np.ndarray, reach: np.ndarray, words: np.ndarray, longest: int):
        ends = np.flatnonzero(words == 0x20) + 1
        self.coded, code = dictionary(words, np.concatenate([[0], ends]).astype(np.int64))
        first = np.cumsum(reach, dtype=np.int64) - reach
        cols = [np.where(reach > k, code[np.minimum(first + k, len(code) - 1)] + 1, 0) for k in range(longest)]
        order = np.argsort(dense(cols, [len(self.coded) + 1] * longest), kind="stable")
        self.cols = [c[order] for c in cols]
        total = np.concatenate([[0], np.cumsum(counts[order], dtype=np.int64)])
        new = np.zeros(len(order), bool)
        new[0] = True
        self.runs, self.counts, self.child = [], [], []
        for c in self.cols:
            new[1:] |= c[1:] != c[:-1]
            at = np.flatnonzero(new)
            self.runs.append(at)
            self.counts.append(np.diff(total[np.append(at, len(order))]))
        for a, b in zip(self.runs, self.runs[1:]):
            self.child.append(np.searchsorted(b, np.append(a, len(order))))

    def grow(self, least: int, hot: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(pointer, words, occurrences) of every frequent prefix of two words and more, and of those whose count is only a part."""
        last = len(self.cols) - 1

        def right(depth: int, lo: int, hi: int, parts: bool) -> Iterator[tuple[int, int, int]]:
            """Prefixes of depth + 1 words among the runs lo..hi - 1, which extend one prefix of depth words."""
            at, n = self.runs[depth][lo:hi], self.counts[depth][lo:hi]
            word = self.cols[depth][at]
            part = hot[word] if parts and depth < last else np.zeros(len(at), bool)  # only some of its pointers are here
            for i in np.flatnonzero((word > 0) & ((n >= least) | part)).tolist():
                if depth:
                    yield int(at[i]), depth + 1, int(n[i])
                if depth < last:
                    yield from right(depth + 1, int(self.child[depth][lo + i]), int(self.child[depth][lo + i + 1]), bool(part[i]))

        yield from right(0, 0, len(self.runs[0]), True)


def grown(rows: DataFrame, least: int, longest: int, hot: np.ndarray) -> DataFrame:
    """lang, phrase, k, f of the phrases of two words and more; one task for each bucket of prefixes."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        joined = lambda c, t: np.frombuffer(b"".join(x.as_buffer() for x in group[c]), t)
        counts, reach, words = joined("counts", "<u4"), joined("reach", np.uint8), joined("words", np.uint8)
        p = Projection(counts, reach.astype(np.int64), words, longest)
        lang = key[0].as_py()
        flags = np.append(False, is_hot(hot, in_language(word_hash(p.coded), lang)))
        found = list(p.grow(least, flags))
        text = p.coded.take(pa.array([p.cols[d][at] - 1 for at, k, _ in found for d in range(k)], pa.int64())).to_pylist()
        phrases, i = [], 0
        for _, k, _ in found:
            phrases.append(b"".join(text[i : i + k])[:-1].decode())
            i += k
        return pa.table({"lang": pa.array([lang] * len(found), pa.string()), "phrase": pa.array(phrases, pa.string()), "k": pa.array([k for _, k, _ in found], pa.int32()), "f": pa.array([n for _, _, n in found], pa.int64())})

    out = rows.groupBy("lang", "bucket").applyInArrow(run, "lang string, phrase string, k int, f long")
    return out.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def phrases(docs: DataFrame, least: int = 10, longest: int = 3, lang: str = "lang", text: str = "text", share: int = SHARE, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: (lang, n) words of each language; (lang, phrase, f) of words, (lang, phrase, k, f) of phrases, at least ``least``."""
    words = cut(count_words(docs, lang, text, chunk), "words")
    totals = cut(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    n = totals.agg(F.sum("n")).first()[0] or 0
    heavy = words.where(F.col("f") > share).collect()  # at most one for each ``share`` words of the corpus
    h = [in_language(K.span_hash(b := np.frombuffer(r["phrase"].encode() + b" ", np.uint8), np.array([0]), np.array([len(b)])), r["lang"])[0] for r in heavy]
    hot = np.sort(np.array(h, np.uint64))
    some = cut(words.where(F.col("f") >= least), "frequent")
    free(words)
    return totals, some, cut(grown(pointers(docs, lang, text, longest, hot, max(1, -(-n // share)), chunk), least, longest, hot), "phrases")


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, inside: int = 50, top: int = 2000, lang: str = "lang", text: str = "text", share: int = SHARE, chunk: int = CHUNK, spread: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 to ``longest`` words.

    A phrase goes if a longer one that holds it has at least ``inside`` percent of its occurrences.
    """
    totals, words, grown_ = phrases(docs, least, longest, lang, text, share, chunk)
    part = words.select("lang", "phrase", "f").unionAll(grown_.where(F.col("k") < longest).select("lang", "phrase", "f"))
    cuts = grown_.select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', cut)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    big = lambda c: f"CAST({c} AS DECIMAL(19,0))"
    score = F.expr(f"({big('a')} * {big('a')} * CAST(1000000 AS DECIMAL(7,0))) div ({big('l')} * {big('r')})")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m")).select("lang", "phrase", "k", "a", "m.l", "m.r", "m.score")
    piece = F.expr("explode(flatten(transform(sequence(2, k - 1), m -> transform(sequence(0, k - m), i -> array_join(slice(split(phrase, ' '), i + 1, m), ' ')))))")
    held = grown_.where(F.col("k") > 2).select("lang", "f", piece.alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = scored.join(held, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < inside * F.col("a"), F.lit(True)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = left.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(spread)))  # no language meets in one task before its best are known
    some = some.withColumn("rank", F.row_number().over(W.partitionBy("lang", "_s").orderBy(*order))).where(F.col("rank") <= top).drop("_s")
    best = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (
  SELECT lang, 1 AS k, unnest(ws) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w
), f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, CAST(count(*) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cuts AS (SELECT lang, k, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS head, array_to_string(ws[cut + 1:], ' ') AS rest FROM c, range(1, 3) t(cut) WHERE cut < k),
s AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, cut, x.f AS l, y.f AS r, CAST(1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = rest
), one AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, sub, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS sub FROM c WHERE k = 3) GROUP BY ALL
), kept AS (SELECT one.* FROM one LEFT JOIN longer ON longer.lang = one.lang AND sub = phrase WHERE most IS NULL OR 100 * most < 50 * a),
best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT best.lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(best.r AS BIGINT) AS r, n, score FROM best JOIN total ON total.lang = best.lang WHERE rank <= 2000
"""

QUERIES = {"op11_collocations": op11_collocations}
ORACLES = {"op11_collocations": SQL}
