"""Quality classifier from weak labels (operator 1).

Overlapping heuristic labellers vote good, bad or nothing on every document. A label model estimates their
accuracies by expectation-maximisation over the counts of vote patterns of all documents (labellers taken
as independent given the true class: good, or one of several kinds of bad), and gives each pattern a posterior of
being good. Posterior labels of a bounded sample then train a hashed linear scorer: the score is the
logistic of the mean weight of a document's tokens and token shapes, so the scorer also tells apart what no
labeller names. Given labels (of quality) are not used; they serve to measure.

Bounds: the pattern table has at most 3 ** labellers rows; the scorer learns from ``sample`` documents, the
first by a hash of doc_id and text among those of at most ``sample_bytes`` bytes; equal rows count once.

Defined cases: null, empty and wordless texts are voted bad by the length labeller and get the scorer's
value for a text without tokens; repeated documents are scored row by row, so ties are equal texts; a null
doc_id is scored like any and has its share of the sample; with an empty table nothing is learned and nothing returned; other columns are ignored.

Scale: two narrow passes over whole texts (votes with their pattern counts; scores), no shuffle but that of
the pattern counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .common import only, table

SPACE = ~K.byte_class((0x20, 0x20), (0x09, 0x0D))
# Frequent function words of some languages; the scorer's shapes need none.
FUNCTION_WORDS = "the of and to in is that it for was be as le la les de des et que du en un une der die das und den von zu mit nicht ein ist el los las y se por con para".split()
SYMBOLS = b"#$%&*|{}<>\\^~_=@+"
LABELLERS = ("symbols", "capitals", "word_length", "function_words", "repeated_lines", "variety", "line_ends", "shouting", "length", "digits")


def _lut(chars: bytes) -> np.ndarray:
    lut = np.zeros(256, bool)
    lut[list(chars)] = True
    return lut


_SYM, _UP, _LOW, _DIG = _lut(SYMBOLS), K.byte_class((65, 90)), K.byte_class((97, 122), (0x80, 0xFF)), K.byte_class((48, 57))
_END = _lut(b".!?\"')")
_KNOWN = None


def known_words() -> np.ndarray:
    global _KNOWN
    if _KNOWN is None:
        d = np.frombuffer("".join(FUNCTION_WORDS).encode(), np.uint8)
        e = np.cumsum([len(w) for w in FUNCTION_WORDS])
        _KNOWN = np.sort(K.span_hash(d, np.concatenate([[0], e[:-1]]), e))
    return _KNOWN


def votes(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """1 good, -1 bad, 0 no vote: documents x LABELLERS."""
    n_docs = len(offs) - 1
    s, e, first = K.word_spans(data, offs, SPACE)
    n = np.diff(first)
    nz = np.maximum(n, 1)
    count = lambda lut: np.diff(np.concatenate([[0], np.cumsum(lut[data])])[offs])
    letters_up, letters = count(_UP), count(_UP) + count(_LOW)
    body = np.maximum(1, count(SPACE))
    doc = np.repeat(np.arange(n_docs), n)
    per = lambda flags: np.bincount(doc, flags, n_docs) / nz
    out = np.zeros((n_docs, len(LABELLERS)), np.int8)

    def vote(name: str, good: np.ndarray, bad: np.ndarray) -> None:
        out[:, LABELLERS.index(name)] = np.where(n == 0, 0, good.astype(np.int8) - bad.astype(np.int8))

    sym = count(_SYM) / body
    vote("symbols", sym < 0.01, sym > 0.04)
    up = letters_up / np.maximum(1, letters)
    vote("capitals", up < 0.15, up > 0.4)
    mean = body / nz
    vote("word_length", (mean > 3) & (mean < 10), (mean < 2) | (mean > 14))
    if len(s):
        lower = K.LOWER[data]
        h = K.span_hash(lower, s, e)
        fun = per(np.isin(h, known_words()))
        vote("function_words", fun > 0.15, fun < 0.02)
        by = np.lexsort((h, doc))
        fresh = np.ones(len(h))
        fresh[1:] = (h[by][1:] != h[by][:-1]) | (doc[by][1:] != doc[by][:-1])
        rich = np.bincount(doc[by], fresh, n_docs) / np.where(nz > 200, 200 * (nz / 200) ** 0.6, nz)  # distinct words grow more slowly than words
        vote("variety", rich > 0.4, rich < 0.2)
        loud = per((data[e - 1] == 33) & (e - s > 1) & (data[np.maximum(e - 2, 0)] == 33))
        vote("shouting", loud < 0.01, loud > 0.1)
    feeds = np.flatnonzero(data == 10)
    ls = np.sort(np.concatenate([offs[:-1], feeds + 1]))
    le = np.sort(np.concatenate([offs[1:], feeds]))
    lines_of = np.clip(np.searchsorted(offs, ls, "right") - 1, 0, n_docs - 1)
    some = le > ls
    ls, le, ld = ls[some], le[some], lines_of[some]
    lines = np.maximum(1, np.bincount(ld, minlength=n_docs))
    if len(ls):
        lh = K.span_hash(data, ls, le)
        by = np.lexsort((lh, ld))
        same = np.zeros(len(lh))
        same[1:] = (lh[by][1:] == lh[by][:-1]) & (ld[by][1:] == ld[by][:-1])
        dup = np.bincount(ld[by], same, n_docs) / lines
        vote("repeated_lines", (dup == 0) & (lines > 2), dup > 0.3)
        ended = np.bincount(ld, _END[data[le - 1]], n_docs) / lines
        vote("line_ends", ended > 0.7, ended < 0.2)
    dig = count(_DIG) / body
    vote("digits", dig < 0.02, dig > 0.15)
    out[:, LABELLERS.index("length")] = (n >= 20).astype(np.int8) - (n < 2).astype(np.int8)
    return out


def code(v: np.ndarray) -> np.ndarray:
    """A vote pattern as one number, base 3."""
    return ((v + 1).astype(np.int64) * 3 ** np.arange(v.shape[1])).sum(1)


def pattern(c: np.ndarray, k: int) -> np.ndarray:
    return (c[:, None] // 3 ** np.arange(k) % 3 - 1).astype(np.int8)


@dataclass
class LabelModel:
    """Shares of the latent classes (the first is good, one kind of bad for each labeller) and the chance of
    each vote (-1, 0, 1) of each labeller in each class."""

    share: np.ndarray  # classes
    table: np.ndarray  # labellers x classes x 3

    def responsibilities(self, v: np.ndarray) -> np.ndarray:
        lp = np.log(self.share) + sum(np.log(self.table[j][:, v[:, j] + 1]).T for j in range(v.shape[1]))
        p = np.exp(lp - lp.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Chance of being good."""
        return self.responsibilities(v)[:, 0]

    def accuracy(self) -> dict[str, float]:
        """Share of right votes among those cast, by labeller."""
        right = self.share[0] * self.table[:, 0, 2] + self.table[:, 1:, 0] @ self.share[1:]
        cast = right + self.share[0] * self.table[:, 0, 0] + self.table[:, 1:, 2] @ self.share[1:]
        return dict(zip(LABELLERS, (right / cast).tolist()))


def em(v: np.ndarray, count: np.ndarray, rounds: int = 200, pseudo: float = 0.5) -> LabelModel:
    """Dawid-Skene on vote patterns with their counts.

    Documents are bad in ways that exclude each other (a shout is no table), so one class of bad ones would
    break the labellers' independence: each labeller starts a class of its own from its bad votes, good starts
    from the documents without any.
    """
    k = v.shape[1]
    bad = (v == -1).astype(float)
    n_bad = bad.sum(1, keepdims=True)
    q = np.concatenate([np.where(n_bad == 0, 0.98, 0.3 ** (n_bad + 1)), np.where(n_bad == 0, 0.02 / k, bad / np.maximum(1, n_bad))], 1)
    q /= q.sum(1, keepdims=True)
    m = None
    for _ in range(rounds):
        w = q * count[:, None]
        t = np.stack([np.stack([w[v[:, j] == x].sum(0) for x in (-1, 0, 1)], 1) for j in range(k)]) + pseudo
        share = w.sum(0) + pseudo
        m = LabelModel(share / share.sum(), t / t.sum(2, keepdims=True))
        new = m.responsibilities(v)
        if np.abs(new - q).max() < 1e-6:
            break
        q = new
    return m


class Scorer:
    """Logistic of the mean weight of hashed tokens and token shapes."""

    def __init__(self, bits: int = 15):
        self.bits = bits
        self.w = np.zeros(1 << bits)
        self.b = 0.0

    def buckets(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two buckets for each token (word, shape), and where each document's tokens begin."""
        s, e, first = K.word_spans(data, offs, SPACE)
        if not len(s):
            return np.zeros((0, 2), np.int64), first
        word = K.span_hash(K.LOWER[data], s, e)
        kind = data.copy()
        kind[_LOW[data]], kind[_UP[data]], kind[_DIG[data]] = 97, 65, 48
        keep = np.ones(len(data), bool)
        keep[1:] = (kind[1:] != kind[:-1]) | ~((kind[1:] == 97) | (kind[1:] == 65) | (kind[1:] == 48))
        keep[s] = True
        at = np.concatenate([[0], np.cumsum(keep)])
        shape = K.mix(K.span_hash(kind[keep], at[s], at[e]) + np.uint64(77))
        sh = np.uint64(64 - self.bits)
        return np.stack([word >> sh, shape >> sh], 1).astype(np.int64), first

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int = 400, rate: float = 15.0, ridge: float = 1e-5) -> None:
        """Full-batch gradient steps with per-weight scaling; docs: buckets with their shares."""
        size = np.array([len(a) for a, _ in docs])
        col = np.concatenate([a for a, _ in docs]) if len(docs) else np.zeros(0, np.int64)
        val = np.concatenate([x for _, x in docs]) if len(docs) else np.zeros(0)
        row = np.repeat(np.arange(len(docs)), size)
        g2 = np.full(len(self.w), 1e-8)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, val * self.w[col], len(docs)) + self.b, -30, 30)))
            err = (p - y) / len(y)
            g = np.bincount(col, val * err[row], len(self.w)) + ridge * self.w
            g2 += g * g
            self.w -= rate * g / np.sqrt(g2)
            self.b -= 2.0 * err.sum()

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        k, first = self.buckets(data, offs)
        c = np.concatenate([[0.0], np.cumsum(self.w[k].sum(1))])
        n = np.diff(first)
        return 1 / (1 + np.exp(-np.clip((c[first[1:]] - c[first[:-1]]) / np.maximum(1, n) + self.b, -30, 30)))


def voted(docs: DataFrame, bits: int = 15) -> DataFrame:
    """doc_id, votes (pattern number), n_votes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in K.chunks(b.column(1)):
                v = votes(data, offs)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).cast(pa.int64()), pa.array(code(v)), pa.array((v != 0).sum(1), pa.int32())], names=["doc_id", "votes", "n_votes"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, votes long, n_votes int")


def train(docs: DataFrame, sample: int = 6000, bits: int = 15, sample_bytes: int = 1 << 15) -> tuple[LabelModel | None, Scorer]:
    """The label model from all documents' votes, and the scorer from the posteriors of a bounded sample."""
    seen = voted(docs).groupBy("votes").agg(F.count(F.lit(1)).alias("n")).toArrow()  # at most 3 ** labellers rows
    scorer = Scorer(bits)
    if not seen.num_rows:
        return None, scorer
    model = em(pattern(seen["votes"].to_numpy(), len(LABELLERS)), seen["n"].to_numpy().astype(float))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    hashed = only(docs, "doc_id", "text").where(size <= sample_bytes).select("text", F.xxhash64("doc_id", "text").alias("_h"))
    edge = hashed.select("_h").distinct().orderBy("_h").limit(sample).agg(F.max("_h").alias("h")).first()["h"]  # one number; null if all texts are longer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for i, j, data, offs in K.chunks(b.column(0)):
                k, first = scorer.buckets(data, offs)
                p = model.posterior(votes(data, offs))
                rows = []
                for h, a, z, q in zip(b.column(1).slice(i, j - i).to_pylist(), first[:-1].tolist(), first[1:].tolist(), p.tolist()):
                    if h not in seen:
                        seen.add(h)
                        col, n = np.unique(k[a:z].reshape(-1), return_counts=True)
                        rows.append((h, col.astype("<i4").tobytes(), (n / max(1, z - a)).astype("<f4").tobytes(), q))
                cols = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.float64()))], names=["h", "c", "v", "p"])

    chosen = hashed.where(F.col("_h") <= F.lit(edge)).mapInArrow(run, "h long, c binary, v binary, p double")
    got = chosen.dropDuplicates(["h"]).collect()  # at most `sample` rows, each of at most sample_bytes buckets
    got = sorted((bytes(r["c"]), bytes(r["v"]), r["p"]) for r in got)
    scorer.fit([(np.frombuffer(c, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(float)) for c, v, _ in got], np.array([p for *_, p in got]))
    return model, scorer


def classified(docs: DataFrame, model: LabelModel | None, scorer: Scorer) -> DataFrame:
    """doc_id, n_votes, posterior (of the votes), score (of the scorer), predicted (1 good) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in K.chunks(b.column(1)):
                v = votes(data, offs)
                s = scorer.score(data, offs)
                post = model.posterior(v) if model is not None else np.full(len(s), 0.5)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i).cast(pa.int64()), pa.array((v != 0).sum(1), pa.int32()), pa.array(post), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                    names=["doc_id", "n_votes", "posterior", "score", "predicted"],
                )

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_votes int, posterior double, score double, predicted int")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classified(docs, *train(docs))


QUERIES = {"op1_quality": op1_quality}
ORACLES: dict[str, str] = {}
