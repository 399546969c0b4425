"""Toxicity by compression distance (operator 8).

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A text is cut into windows,
each a run of ``window`` space-separated words in lower case, and every window is compressed with both; the
gain is how many bytes the toxic dictionary saves. A window counts as toxic from a calibrated gain on, and
the document's score is a logistic function, calibrated by cross-fitting on the labelled
sample, of how many of its windows do, in number and in share.

A window of one word is shorter than what zstandard bothers to match, so it stands between two fixed
frames of bytes that both dictionaries end with: these cost the same under either. The toxic dictionary is
trained on the words of toxic documents whose document frequency is at least ``lift`` times the ordinary
one, for COVER training would otherwise spend itself on what both classes share.

Learning uses a bounded sample of labelled documents (``sample_toxic`` and ``sample_ordinary``, the first by
a hash of doc_id among those of at most ``sample_bytes`` bytes, each as a whole) outside the held-out fold
crc32(doc_id) mod 5 = 0; in the logistic each document stands for as many as its class has labels for one
sampled, so that 0.5 means the same at every number of labels. Scoring covers every window of every whole text. Lang, source and doc_id are no
inputs of a score.

Defined cases: null, empty and wordless texts have no windows and get the score of a document without toxic
windows; null labels and labels of absent documents are ignored; a doc_id labelled twice counts with its
larger label, and rows of one labelled doc_id and text are learned from once; with no toxic or no ordinary
sample every score is the label's share (0 without labels); repeated documents are scored row by row, so ties
are equal rows; an empty table gives an empty result; other columns are ignored.

Scale: scoring is one narrow pass, no shuffle; a worker keeps the gains of words met before in a table of
bounded size, so that a word is compressed once and not at each occurrence.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fold, free, only, schema_of, table

FRAME, TAIL = bytes(range(200, 232)), bytes(range(232, 248))
LEVELS = (3, 4, 5, 6)  # gains that may become the threshold
CACHE = 1_000_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def train(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained on the samples; their own end where they are too few to train on."""
    try:
        return zs.train_dictionary(size, samples, k=16, d=6).as_bytes()[-size:]
    except zs.ZstdError:
        return b" ".join(samples)[-size:]


def compressor(content: bytes) -> zs.ZstdCompressor:
    p = zs.ZstdCompressionParameters(
        min_match=4, strategy=zs.STRATEGY_GREEDY, search_log=4, hash_log=12, chain_log=12, window_log=15, target_length=16,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zs.FORMAT_ZSTD1_MAGICLESS,
    )
    return zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(content + FRAME + TAIL, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=p)


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    window: int = 1
    level: int = 5
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3))
    constant: float | None = None

    def __post_init__(self):
        self._pair = None
        self._gain: dict[bytes, int] = {}

    def __getstate__(self):
        return self.__dict__ | {"_pair": None, "_gain": {}}

    def gains(self, windows: set[bytes]) -> dict[bytes, int]:
        """Bytes that the toxic dictionary saves on each window."""
        if self._pair is None:
            self._pair = compressor(self.ordinary), compressor(self.toxic)
        if len(self._gain) > CACHE:
            self._gain.clear()
        new = list(windows.difference(self._gain))
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            framed = [FRAME + b" " + w + b" " + TAIL for w in part]
            a, b = (c.multi_compress_to_buffer(framed) for c in self._pair)
            for k, w in enumerate(part):
                self._gain[w] = len(a[k]) - len(b[k])
        return self._gain

    def windows(self, text: str | None) -> list[bytes]:
        w = words_of(text)
        return w if self.window == 1 else [b" ".join(w[i : i + self.window]) for i in range(0, len(w), self.window)]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Windows, and windows with a gain of at least each of LEVELS, for each text."""
        split = [self.windows(t) for t in texts]
        gain = self.gains(set().union(*split))
        out = np.zeros((len(texts), 1 + len(LEVELS)))
        for row, s in zip(out, split):
            g = np.fromiter(map(gain.__getitem__, s), np.int64, len(s))
            row[0] = len(s)
            row[1:] = [(g >= k).sum() for k in LEVELS]
        return out

    def features(self, counts: np.ndarray) -> np.ndarray:
        c = counts[:, 1 + LEVELS.index(self.level)]
        return np.stack([np.ones(len(c)), np.log1p(c), np.minimum(1, 20 * c / np.maximum(1, counts[:, 0]))], 1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.features(self.counts(texts)) @ self.weights, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 30, times: np.ndarray | float = 1.0) -> np.ndarray:
    """Newton steps on the penalised log likelihood; each row counts ``times``."""
    w = np.zeros(x.shape[1])
    r = np.full(x.shape[1], ridge)
    r[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (times * p * (1 - p))[:, None]).T @ x + np.diag(r)
        w = w + np.linalg.solve(h, x.T @ (times * (y - p)) - r * w)
    return w


def auc(s: np.ndarray, y: np.ndarray) -> float:
    _, inv, n = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[inv]
    a, b = int(y.sum()), int((1 - y).sum())
    return float((rank[y == 1].sum() - a * (a + 1) / 2) / (a * b)) if a and b else 0.5


def dictionaries(texts: list[str], y: np.ndarray, window: int, size: int, lift: float, least: int) -> Model:
    sets = [set(words_of(t)) for t in texts]
    df = [Counter(), Counter()]
    for s, k in zip(sets, y):
        df[k].update(s)
    n = [int((y == k).sum()) for k in (0, 1)]
    few = min(least, max(1, n[1] // 4))
    told = {w for w, c in df[1].items() if c >= few and c / n[1] >= lift * (df[0][w] + 0.5) / n[0]}
    usual = {w for w, c in df[0].items() if c >= few and w not in told}
    join = lambda s, keep: b" " + b" ".join(sorted(s & keep)) + b" "
    tox = [x for x in (join(s, told) for s, k in zip(sets, y) if k == 1) if len(x) > 8]
    usl = [x for x in (join(s, usual) for s, k in zip(sets, y) if k == 0) if len(x) > 8]
    return Model(train(tox, size), train(usl, size), window)


def learn(texts: list[str], labels: list[int], window: int = 1, size: int = 8192, lift: float = 8.0, least: int = 3, folds: int = 3, stands: tuple[float, float] = (1.0, 1.0)) -> Model:
    """A model from labelled texts. The calibration is cross-fitted: each fold's documents are counted with
    dictionaries trained on the other folds; the dictionaries that are kept see all. ``stands``: how many labels
    a sampled ordinary and a sampled toxic document stand for, so that the sample's class ratio is not learned."""
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return Model(b"", b"", window, constant=float(y.mean()) if len(y) else 0.0)
    part = np.zeros(len(y), np.int64)
    for k in (0, 1):
        own = np.flatnonzero(y == k)
        part[own] = np.arange(len(own)) % folds
    m = dictionaries(texts, y, window, size, lift, least)
    counts = np.zeros((len(y), 1 + len(LEVELS)))
    for f in range(folds):
        rest, own = np.flatnonzero(part != f), np.flatnonzero(part == f)
        cross = dictionaries([texts[i] for i in rest], y[rest], window, size, lift, least) if y[rest].any() and not y[rest].all() else m
        counts[own] = cross.counts([texts[i] for i in own])
    share = counts[:, 1:] / np.maximum(1, counts[:, :1])
    m.level = LEVELS[int(np.argmax([auc(share[:, k], y) for k in range(len(LEVELS))]))]
    m.weights = logistic(m.features(counts), y, times=np.array(stands)[y])
    return m


def fit(docs: DataFrame, labels: DataFrame, window: int = 1, sample_toxic: int = 2000, sample_ordinary: int = 4000, sample_bytes: int = 1 << 15, size: int = 8192, lift: float = 8.0) -> Model:
    """Learn from the bounded sample of labelled documents outside the held-out fold.

    Only labels whose document is there, with a text of at most ``sample_bytes`` bytes, are sampled and counted."""
    lab = only(labels, "doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    there = only(docs, "doc_id", "text").where(F.octet_length("text") <= sample_bytes).select("doc_id")
    lab = cut(lab.where(fold("doc_id", 5) != 0).join(there, "doc_id", "left_semi"), "labelled")
    n = {r["toxic"]: r["count"] for r in lab.groupBy("toxic").count().collect()}
    stands = tuple(max(1.0, n.get(k, 0) / most) for k, most in ((0, sample_ordinary), (1, sample_toxic)))
    h = F.xxhash64("doc_id")
    pick = [lab.where(c).orderBy(h, "doc_id").limit(n) for c, n in ((F.col("toxic") == 1, sample_toxic), (F.col("toxic") == 0, sample_ordinary))]
    chosen = pick[0].unionAll(pick[1])  # at most sample_toxic + sample_ordinary rows of two numbers
    short = only(docs, "doc_id", "text").where(F.octet_length("text") <= sample_bytes)
    rows = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))  # one text for each label
    got = [(r["doc_id"], r["toxic"], r["text"]) for r in rows.collect()]
    free(lab)
    got.sort(key=lambda r: (hash_order(r[0]), r[0]))
    return learn([r[2] for r in got], [r[1] for r in got], window, size, lift, stands=stands)


def hash_order(doc_id: int) -> int:
    return (doc_id * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with score and predicted for each row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = docs.select(*[f"`{k}`" for k in keep]).schema
    for f in schema_of("score double, predicted int").fields:
        out = out.add(f)
    target = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                s = model.score(part.column(len(keep)).to_pylist())
                cols = [*(part.column(i) for i in range(len(keep))), pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, target)], schema=target)

    return docs.select(*[f"`{k}`" for k in keep], "text").mapInArrow(run, out)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted toxic; the columns of ``docs``."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return scored(rows, model, ("row",)).where("predicted = 0").select("row.*")


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}
