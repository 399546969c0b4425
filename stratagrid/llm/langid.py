"""Language identification by multilingual mixture inference (operator 9).

For every language the counts of character trigrams inside words give a smoothed distribution, and so a
likelihood of each word. A document is a mixture: expectation-maximisation estimates the proportions of
the languages from its words' likelihoods. Language sets are then compared by penalised likelihood: the
sets nest in order of the proportions found with all languages, each is refitted, and the one with the
greatest log likelihood less ``penalty`` * log(words) for each further language is the document's set. The
answer is its largest member, the score that member's proportion.

Learning counts the trigrams (hashed to ``buckets``) of all documents with a language outside the held-out
fold crc32(doc_id) mod 4 = 2; lang, source and doc_id are no inputs of a prediction.

Defined cases: ``und`` with score 0 for null or empty texts, texts without a letter, and if nothing could
be learned; ties go to the language first
in order of name; a null lang is not learned from; repeated documents are answered row by row; other
columns are ignored.

Scale: one pass that learns (each task sends at most languages x buckets counts) and one narrow pass that
predicts; whole texts, in chunks of documents of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .common import fold, only, table

WORD = K.byte_class((0x61, 0x7A), (0x80, 0xFF))


def grams(arr: pa.Array, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, trigram buckets, where each word's begin, words' documents, words of each document)."""
    low = pc.utf8_lower(pc.fill_null(arr.cast(pa.large_string()), ""))
    for i, j, data, offs in K.chunks(low, 1 << 20):
        s, e, first = K.word_spans(data, offs, WORD)
        n = np.diff(first)
        if not len(s):
            yield i, j, np.zeros(0, np.int64), s, s, n
            continue
        # each word's letters with a blank before and after it: one trigram centred at each letter
        size = e - s
        at = np.repeat(s - (np.cumsum(size) - size), size) + np.arange(size.sum())
        c = data[at].astype(np.uint32)
        start = np.cumsum(size) - size
        left, right = np.empty_like(c), np.empty_like(c)
        left[1:], right[:-1] = c[:-1], c[1:]
        left[start], right[start + size - 1] = 0x20, 0x20
        h = ((left << np.uint32(16)) | (c << np.uint32(8)) | right) * np.uint32(0x9E3779B1)
        yield i, j, (h >> np.uint32(32 - bits)).astype(np.int64), start, np.repeat(np.arange(j - i), n), n


class Mixture:
    def __init__(self, langs: list[str], counts: np.ndarray, bits: int, penalty: float = 2.0, alpha: float = 0.5):
        """counts: languages x buckets."""
        self.langs, self.bits, self.penalty = langs, bits, penalty
        p = (counts + alpha) / (counts.sum(1, keepdims=True) + alpha * counts.shape[1])
        self.log = np.ascontiguousarray(np.log(p).T.astype(np.float32))

    def em(self, lik: np.ndarray, doc: np.ndarray, cut: np.ndarray, n: np.ndarray, use: np.ndarray, steps: int) -> np.ndarray:
        """Proportions of the used languages for each document."""
        pi = use / use.sum(1, keepdims=True)
        for _ in range(steps):
            post = lik * pi[doc]
            post /= post.sum(1, keepdims=True)
            pi = np.add.reduceat(post, cut, axis=0) / n[:, None]
        return pi

    def fit(self, lik: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chosen language and its proportion for documents with n > 0 words each."""
        doc, cut = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
        ll = lambda pi: np.add.reduceat(np.log((lik * pi[doc]).sum(1)), cut)
        full = self.em(lik, doc, cut, n, np.ones((len(n), lik.shape[1]), np.float32), 8)
        rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
        best, value = None, None
        for k in range(1, lik.shape[1] + 1):
            use = (rank < k).astype(np.float32)
            pi = use if k == 1 else self.em(lik, doc, cut, n, use, 5)
            got = ll(np.maximum(pi, 1e-9)) - self.penalty * (k - 1) * np.log(n + 1.0)
            if best is None:
                best, value = pi.copy(), got
            else:
                up = got > value
                best[up], value[up] = pi[up], got[up]
        top = best.argmax(1)
        return top, best[np.arange(len(n)), top].astype(np.float64)

    def predict(self, arr: pa.Array) -> tuple[list[str], np.ndarray]:
        names, score = ["und"] * len(arr), np.zeros(len(arr))
        if not self.langs:
            return names, score
        for i, j, g, start, doc, n in grams(arr, self.bits):
            some = np.flatnonzero(n)
            if not len(some):
                continue
            w = np.add.reduceat(self.log[g], start, axis=0)
            lik = np.exp(np.maximum(w - w.max(1, keepdims=True), -30))
            top, share = self.fit(lik, n[some])
            texts = arr.slice(i, j - i)
            for d, t, s in zip(some.tolist(), top.tolist(), share.tolist()):
                if any(map(str.isalpha, texts[d].as_py())):
                    names[i + d], score[i + d] = self.langs[t], min(1.0, s)
        return names, score


def learn(docs: DataFrame, bits: int = 16) -> Mixture:
    """Trigram counts of all the given documents that have a lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(0).to_pylist()
            for i, j, g, start, doc, n in grams(b.column(1), bits):
                per = np.add.reduceat(np.ones(len(g), np.int64), start) if len(start) else np.zeros(0, np.int64)
                of = np.repeat(doc, per)
                codes = {x: k for k, x in enumerate(sorted(set(langs[i:j])))}
                own = np.array([codes[x] for x in langs[i:j]])
                both = np.bincount((own[of] << bits) + g, minlength=len(codes) << bits).reshape(-1, 1 << bits)
                for x, k in codes.items():
                    held[x] = held.get(x, 0) + both[k]
        for x, c in held.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], names=["lang", "g", "n"])

    rows = only(docs, "lang", "text").where("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "lang string, g int, n long")
    got = rows.groupBy("lang", "g").agg(F.sum("n").alias("n"))
    t = got.toArrow()  # at most languages x buckets rows
    langs = sorted(set(t["lang"].to_pylist()))
    counts = np.zeros((len(langs), 1 << bits))
    code = {x: k for k, x in enumerate(langs)}
    counts[[code[x] for x in t["lang"].to_pylist()], t["g"].to_numpy()] = t["n"].to_numpy()
    return Mixture(langs, counts, bits)


def predicted(docs: DataFrame, model: Mixture) -> DataFrame:
    """doc_id, lang_pred and score of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score = model.predict(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(fold("doc_id", 4) != 2))
    return predicted(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language": op9_language}
ORACLES: dict[str, str] = {}
