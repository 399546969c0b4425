"""Best-fit packing with exact-complement hashing (operator 10).

Documents become pieces of at most ``capacity`` tokens. Only the histogram of piece lengths (at most
``capacity`` rows) reaches the driver, where sequences are planned as recipes: lists of lengths with a
multiplicity. Lengths are opened longest first; single, pair and triple sums of the lengths still
available are indexed, a gap that one of them fills exactly consumes that combination under the
availability counts, and what has no exact complement is filled best-fit (largest length that fits, again
and again). A recipe is repeated as often as its availabilities allow, so the plan grows with the number
of lengths and not with the corpus.

Pieces then take their places by rank: the r-th piece of a length goes to the r-th place that the recipes
keep for this length. Ranks are made in buckets (see ``ranked``), so no length has to fit in one task.

Defined cases: a null text is an empty one (just the end id); repeated rows are packed row by row and,
having equal columns, are interchangeable; an empty table gives an empty result; other columns are
ignored. The tokenizer file is a parameter, read by each Python worker on first use.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, only, ranked, table
from .textkit import chunks

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
CACHE = 800_000
_loaded: dict[str, tuple] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Characters that need no normalisation beyond lower-casing, and the pre-tokens that the
# tokenizer's own file names, for such characters.
_ODD = re.compile("[^\x00-\u012f\u0131-\u017f]")
_PRETOKENS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class Encoder:
    """ids of a text as little-endian uint32 bytes.

    The tokenizer drops white space and splits at it before anything else, so the ids of a text are those
    of its space-separated chunks in a row; chunks met before come from a table of bounded size. A new chunk
    of Latin characters is lower-cased and split as the tokenizer's file says, and its pre-tokens, which are
    far fewer than chunks, go through the merges in batches; the last token of a pre-token is known by its
    word-end mark. Any other chunk, and any tokenizer of another make, is encoded as it stands.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        split = next((x for x in (made.get("pre_tokenizer") or {}).get("pretokenizers", []) if x.get("type") == "Split"), {})
        kinds = [x["type"] for x in (made.get("normalizer") or {}).get("normalizers", [])]
        end = made["model"].get("end_of_word_suffix")
        self.known_make = bool(end) and kinds == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": _PRETOKENS}
        self.specials = [x["content"] for x in made.get("added_tokens", [])]
        self.find = regex.compile(_PRETOKENS).findall
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        for token, i in self.tok.get_vocab().items():
            self.ends[i] = bool(end) and token.endswith(end)
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def merge(self, words: list[str]) -> None:
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            ids = np.array(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) != len(part):  # not one pre-token each after all
                self.words.update((w, self.whole(w)) for w in part)
                continue
            raw, b = ids.tobytes(), (stop * 4).tolist()
            self.words.update((w, raw[x:y]) for w, x, y in zip(part, [0, *b], b))

    def learn(self, new: list[str]) -> None:
        if len(self.known) > CACHE:
            self.known.clear()
        if len(self.words) > CACHE:
            self.words.clear()
        parts: dict[str, list[str]] = {}
        for c in new:
            if not self.known_make or _ODD.search(c) or ("<" in c and any(x in c for x in self.specials)):
                self.known[c] = self.whole(c)
                continue
            low = c.lower()
            if low.isalpha():
                parts[c] = [low]
            elif low[:-1].isalpha() and low[-1] in ".,":
                parts[c] = [low[:-1], low[-1]]
            else:
                parts[c] = self.find(low)
        self.merge(list({w for p in parts.values() for w in p}.difference(self.words)))
        get = self.words.__getitem__
        for c, p in parts.items():
            self.known[c] = b"".join(map(get, p))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's begin (null: none)."""
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        lists = pc.fill_null(lists, pa.scalar([], lists.type)) if lists.null_count else lists
        coded = lists.flatten().dictionary_encode()
        every, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        for _ in range(2):  # a second time if the table was emptied
            if new := [c for c in every if c not in self.known]:
                self.learn(new)
        ids = [self.known[c] for c in every]
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(n) - n
        each = n[codes]
        stop = np.concatenate([[0], np.cumsum(each)])
        out = flat[np.repeat(first[codes] - stop[:-1], each) + np.arange(stop[-1])]
        at = lists.offsets.to_numpy()
        return out, stop[at - at[0]]


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for lo, hi, *_ in chunks(batch.column(1)):
                ids, at = enc(batch.column(1).slice(lo, hi - lo))
                out: list[list] = [[], [], [], [], []]
                for doc, a, b in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    own = ids[a:b].tobytes() + end
                    for k, start in enumerate(range(0, b - a + 1, capacity)):
                        p = own[start * 4 : (start + capacity) * 4]
                        for col, v in zip(out, (doc, k, start, len(p) // 4, zlib.crc32(p))):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return only(docs, "doc_id", "text").mapInArrow(run, PIECE)


def plan(counts: dict[int, int], capacity: int = 4096) -> list[tuple[int, list[int]]]:
    """Recipes (multiplicity, lengths in place order) that use up ``counts``, length by count.

    The sum indexes are direct-address tables over 0..capacity: ``left`` has the pieces of each length
    (single sums), ``pair`` the number of pairs of available lengths for each sum; a triple is a single
    whose remainder has a pair. They are complete, so a gap is left to best-fit only if no combination of
    up to three lengths fills it (under the counts that the recipe has not used itself).
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    pair = np.zeros(capacity + 1, np.int64)
    for n in np.flatnonzero(left):
        m = np.flatnonzero(left[n : capacity + 1 - n]) + n
        pair[m + n] += 1

    def retire(n: int) -> None:
        m = np.flatnonzero(left[: capacity + 1 - n])
        pair[m + n] -= 1
        if 2 * n <= capacity:  # the pair (n, n); n itself is no longer in ``left``
            pair[2 * n] -= 1

    def pairs(gap: int, free: np.ndarray) -> tuple[int, int] | None:
        if pair[gap] <= 0:
            return None
        half = gap // 2
        a = np.flatnonzero((free[1 : half + 1] > 0) & (free[gap - 1 : gap - half - 1 : -1] > 0)) + 1
        if len(a) and 2 * a[-1] == gap and free[a[-1]] < 2:
            a = a[:-1]
        return (int(gap - a[0]), int(a[0])) if len(a) else None

    def exact(gap: int, free: np.ndarray) -> tuple[int, ...] | None:
        if free[gap] > 0:
            return (gap,)
        if two := pairs(gap, free):
            return two
        c = np.flatnonzero(free[: gap - 1] > 0)
        for n in c[pair[gap - c] > 0][::-1].tolist():
            free[n] -= 1
            two = pairs(gap - n, free)
            free[n] += 1
            if two:
                return (n, *two)
        return None

    out: list[tuple[int, list[int]]] = []
    big = capacity
    while True:
        while big > 0 and left[big] == 0:
            big -= 1
        if big == 0:
            return out
        recipe, gap, free = [big], capacity - big, left.copy()
        free[big] -= 1
        while gap > 0:
            found = exact(gap, free)
            if found is None:
                fit = np.flatnonzero(free[: gap + 1] > 0)
                if not len(fit):
                    break
                found = (int(fit[-1]),)
            recipe += found
            np.subtract.at(free, list(found), 1)
            gap -= sum(found)
        used = Counter(recipe)
        times = int(min(left[n] // c for n, c in used.items()))
        out.append((times, recipe))
        for n, c in used.items():
            left[n] -= c * times
            if left[n] == 0:
                retire(n)


def places(recipes: list[tuple[int, list[int]]]) -> Iterator[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset): ``count`` pieces of a length go to one offset of consecutive sequences."""
    taken: Counter = Counter()
    seq = 0
    for times, recipe in recipes:
        at = 0
        for n in recipe:
            yield n, taken[n], times, seq, at
            taken[n] += times
            at += n
        seq += times


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    spark = docs.sparkSession
    got = cut(pieces(docs, tokenizer, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in got.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    rows = list(places(plan(counts, capacity)))
    by: dict[int, list] = {}
    for n, rank, _, seq, at in rows:
        by.setdefault(n, []).append((rank, seq, at))
    table_ = {n: tuple(np.array(x, np.int64) for x in zip(*sorted(v))) for n, v in by.items()}
    sent = spark.sparkContext.broadcast(table_)  # grows with the lengths in use, at most a few hundred thousand places

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        t = sent.value
        n, r = length.to_numpy(), rank.to_numpy()
        seq, off = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        order = np.argsort(n, kind="stable")
        edges = np.flatnonzero(np.diff(n[order])) + 1
        for part in np.split(order, edges):
            if len(part):
                first, s, o = t[int(n[part[0]])]
                k = np.searchsorted(first, r[part], "right") - 1
                seq[part], off[part] = s[k] + r[part] - first[k], o[k]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    r = ranked(got, ["length"], ["doc_id", "piece", "ids_crc32", "start"], "_rank")
    return r.withColumn("_p", place("length", "_rank")).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_p.sequence_id").alias("sequence_id"), F.col("_p.offset").alias("offset"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
ORACLES: dict[str, str] = {}
