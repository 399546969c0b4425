"""Byte-level BPE encoding and decoding (operator 12).

A vocabulary file (``tokenizers`` JSON, byte-level BPE) gives the merges. A pre-token's bytes become a doubly
linked list of symbols; a heap holds the ranks of the merges that neighbours allow, smallest rank first and
leftmost among equals. An entry whose symbols have changed since it was pushed is stale and skipped. Decoding
concatenates the vocabulary's byte strings; bytes that aren't UTF-8 become U+FFFD.

A text is cut where white space follows something else, which no pre-token crosses. The pieces of many documents
are coded by Arrow's dictionary, so each distinct piece of a chunk is looked up once; pieces and pre-tokens that
were met before come from tables of at most ``CACHE`` entries, others go through the heap.

Defined cases: a null or empty text has no ids and decodes to the empty text; a special token's string in a text
becomes its id, as the library does by default; repeated rows are encoded row by row; the columns of the input
stay as they are, but for those that the operator adds (an input column of such a name is replaced); an empty table
gives an empty result. An id outside the vocabulary is refused by :func:`decode`, null ids decode to null.

Scale: one narrow pass, no shuffle; working memory is a chunk of text (a longer text is a chunk of its own).
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .common import only, table

CACHE = 150_000
KEEP = 64  # bytes up to which a piece is remembered

# Unicode white space, and the pre-tokens of byte-level BPE.
_WS = "\t-\r \x85\xa0  -     　"
_PRETOKENS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
_SPACE = K.byte_class((0x09, 0x0D), (0x20, 0x20))

_loaded: dict[str, Bpe] = {}


class Recent(dict):
    """A table of at most twice ``CACHE`` entries: what was asked for since the last turn outlives the next one."""

    def __init__(self) -> None:
        super().__init__()
        self.older: dict = {}

    def __missing__(self, key):
        """Entries of the last turn come back; others are None and not kept."""
        got = self.older.get(key)
        if got is not None:
            self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        self[key] = value


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, then from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = sorted(set(range(256)).difference(own))
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def packed(ids: list[int]) -> bytes:
    """ids as little-endian uint32 bytes."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Bpe:
    """Merges, vocabulary strings and the tables of what was encoded before."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, pre = made["model"], made.get("pre_tokenizer") or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        added = made.get("added_tokens") or []
        if made.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path} is no plain byte-level BPE file")
        letter = byte_letters()
        vocab = model["vocab"]
        strings: dict[int, bytes] = {i: bytes(letter[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"].encode(): t["id"] for t in added}
        strings |= {i: t for t, i in self.special.items()}
        self.size = max(strings) + 1
        self.strings = pa.array([strings.get(i) for i in range(self.size)], pa.large_binary())
        self.of_byte = [vocab[c] for c, _ in sorted(letter.items(), key=lambda x: x[1])]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank.setdefault(vocab[a] * self.size + vocab[b], len(self.made))
            self.made.append(vocab[a + b])
        self.split = regex.compile(_PRETOKENS).findall
        self.find_special = re.compile(b"|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))).finditer if self.special else None
        self.words, self.known = Recent(), Recent()

    def merge(self, raw: bytes) -> list[int]:
        """ids of one pre-token."""
        sym = [self.of_byte[b] for b in raw]
        n, size, rank, made = len(sym), self.size, self.rank.get, self.made
        if n < 2:
            return sym
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # an entry is rank * n + place; ``now`` has the entry that holds for the pair at each place
        now = [-1 if (r := rank(a * size + b)) is None else r * n + i for i, (a, b) in enumerate(zip(sym, sym[1:]))]
        heap = [e for e in now if e >= 0]
        heapq.heapify(heap)
        while heap:
            e = heapq.heappop(heap)
            i = e % n
            if now[i] != e:
                continue  # stale
            s = sym[i] = made[e // n]
            j = after[i]
            k = after[i] = after[j]
            now[i] = -1
            if k < n:
                now[j] = -1
                before[k] = i
                if (r := rank(s * size + sym[k])) is not None:
                    now[i] = r * n + i
                    heapq.heappush(heap, now[i])
            h = before[i]
            if h >= 0:
                now[h] = -1
                if (r := rank(sym[h] * size + s)) is not None:
                    now[h] = r * n + h
                    heapq.heappush(heap, now[h])
        out, i = [], 0
        while i < n:
            out.append(sym[i])
            i = after[i]
        return out

    def piece(self, raw: bytes) -> bytes:
        """ids of one piece as little-endian uint32 bytes."""
        if raw in self.special:
            return packed([self.special[raw]])
        out = []
        text = raw.decode()
        body = text[1:] if text[0] == " " else text
        if text.isascii() and body.isalpha():
            words = (text,)
        elif text.isascii() and body[-1:] in ".," and body[:-1].isalpha():
            words = (text[:-1], text[-1])
        else:
            words = self.split(text)
        for w in words:
            ids = self.words[w]
            if ids is None:
                ids = packed(self.merge(w.encode()))
                if len(w) <= KEEP:
                    self.words.put(w, ids)
            out.append(ids)
        return b"".join(out)

    def starts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Where pieces begin: at a document, at white space after something else, before and after a special token."""
        ws = _SPACE[data]
        at = ws.copy()
        at[1:] &= ~ws[:-1]
        at[0] = True
        odd = np.flatnonzero(at)
        odd = odd[odd > 2]
        odd = odd[data[odd - 1] >= 0x80]  # white space outside ASCII before it: the run is one
        if len(odd):
            a, b, c = (data[odd - k].astype(np.int64) for k in (3, 2, 1))
            two = (b == 0xC2) & ((c == 0x85) | (c == 0xA0))
            e2 = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
            at[odd[two | e2 | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))]] = False
        if len(data) > 2 and at[2] and data[0] == 0xC2 and data[1] in (0x85, 0xA0):
            at[2] = False
        at[offs[:-1][offs[:-1] < len(data)]] = True
        if self.find_special:
            raw = data.tobytes()
            if any(t in raw for t in self.special):
                for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist()):
                    for m in self.find_special(raw, lo, hi):
                        at[m.start()] = True
                        at[m.start() + 1 : m.end()] = False
                        if m.end() < len(data):
                            at[m.end()] = True
        return np.flatnonzero(at)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk one after another, and where each document's begin."""
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(offs), np.int64)
        at = self.starts(data, offs)
        bounds = pa.py_buffer(np.append(at, len(data)).astype(np.int64))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, bounds, pa.py_buffer(data)]).dictionary_encode()
        every, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        ids = []
        for p in every:
            got = self.known[p]
            if got is None:
                got = self.piece(p)
                if len(p) <= KEEP:
                    self.known.put(p, got)
            ids.append(got)
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(n) - n
        each = n[codes]
        stop = np.concatenate([[0], np.cumsum(each)])
        return flat[np.repeat(first[codes] - stop[:-1], each) + np.arange(stop[-1])], stop[np.searchsorted(at, offs)]


def loaded(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def _kept(df: DataFrame, *gone: str) -> list[str]:
    return [c for c in df.columns if c not in gone]


def encode(docs: DataFrame, tokenizer: str | None = None, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the text, if not given), n_tokens long and ids binary (little-endian uint32)."""
    path = tokenizer or default_tokenizer()
    kept = _kept(docs, text, "n_tokens", "ids") if keep is None else list(keep)
    out = T.StructType([docs.schema[c] for c in kept]).add("n_tokens", "long").add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for lo, hi, data, offs in K.chunks(batch.column(0)):
                ids, at = bpe.encode(data, offs)
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(at * 4), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns[1:]], pa.array(np.diff(at), pa.int64()), packed], names=out.names)

    return docs.select(F.col(f"`{text}`").alias("_text"), *[F.col(f"`{c}`") for c in kept]).mapInArrow(run, out)


def decode(rows: DataFrame, tokenizer: str | None = None, ids: str = "ids", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if not given) and text string of little-endian uint32 ``ids``."""
    path = tokenizer or default_tokenizer()
    kept = _kept(rows, "text") if keep is None else list(keep)
    out = T.StructType([rows.schema[c] for c in kept]).add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = loaded(path).strings
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                own = batch.column(0).slice(lo, 256)
                texts = []
                for raw in own:
                    if not raw.is_valid:
                        texts.append(None)
                        continue
                    own_ids = np.frombuffer(raw.as_buffer(), "<u4")
                    got = strings.take(pa.array(np.minimum(own_ids, len(strings) - 1)))
                    if got.null_count or (len(own_ids) and own_ids.max() >= len(strings)):
                        raise ValueError("an id has no string in the vocabulary")
                    _, at, data = got.buffers()
                    at = np.frombuffer(at, np.int64)
                    texts.append(bytes(data[int(at[0]) : int(at[len(got)])]).decode("utf-8", "replace") if len(got) else "")
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, 256) for c in batch.columns[1:]], pa.array(texts, pa.string())], names=out.names)

    return rows.select(F.col(f"`{ids}`").alias("_ids"), *[F.col(f"`{c}`") for c in kept]).mapInArrow(run, out)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(only(table(spark, sf_dir, "documents"), "doc_id", "text"))
    back = decode(coded)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op12_bpe": op12_bpe}
ORACLES: dict[str, str] = {}
