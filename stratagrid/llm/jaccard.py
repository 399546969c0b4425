"""N-gram Jaccard join with PartEnum signatures (operator 4).

A document's set is its distinct shingles of ``n`` words (as 64-bit hashes); with fewer words the whole
sequence is one shingle, without words the set is empty and linked with nothing. Two sets link when
``den`` * intersection >= ``num`` * union.

1. Documents with one set are a class, named by a hash of the set; a second hash of each class is compared,
   and the seed changes should two sets ever share a name.
2. Sizes fall into bands of ratio ``ratio``. A set signs for its own band and, if it is large enough to
   link with a set of the next band, for that one. In a band two linked sets differ in at most k elements,
   k following from the band's largest size. The shingle domain is dealt into n1 = k // 2 + g parts of
   ``sub`` pieces (three; two make fewer but far weaker signatures); at least g parts hold at most one of
   the differences, so all their pieces but one are alike. All subsets that leave one piece out are enumerated
   for each part, and a signature is the hash of band, part, subset and of the set's elements there. Linked
   sets share at least one signature. A subset without elements tells nothing, so a set signs for such
   subsets only if at least g of its parts have one (in fewer, one of the g alike parts has none).
3. Signatures travel packed, by bucket: six bytes each beside their class. Classes of one batch that share a
   signature send it once, under their least; the others follow by a join, which splits where a signature
   is hot. A signature held by several classes names its least class as leader.
4. A leader's classes, with their sizes and parity sketches, meet in blocks. Two exact bounds say which pairs may link:
   on the sizes, and on the sketches, whose distance never exceeds the sets'. In a group of one block a spanning
   forest of such pairs is verified; in a larger group each class is verified with the leader, and then what lies in other
   components than the largest meets the others, block by block. Where a pair fails, the group's components are
   verified with each other again, nearest pairs first, until nothing is left. So no link between
   components is lost, while a large group of copies costs about one verification each and never all its pairs.
   Verification compares the shingles themselves, word for word.

Defined cases: null text is empty; a null doc_id has its class's component (null if the class has no id);
repeated rows are copies; ties don't occur; an empty table gives an empty result; other columns are ignored.

Scale: sets are made where the text is read; the texts of classes that share a signature are shuffled once
and then again for the pairs that are verified; each intermediate result is deleted after its last reader.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkit as K
from .common import cut, free, numbered, only, table
from .graph import components

SPACE = ~K.byte_class((0x20, 0x20), (0x09, 0x0D))
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SKETCH, SHORT = 512, 600  # bits of the parity sketch of a set of up to so many elements; four times as many for four times the set
UNIT = 1 << 21  # signatures that a task packs at a time
BUCKET = 1 << 22  # about so many signatures in a bucket
BLOCK = 256  # about so many classes in a block
PASS = 400_000  # words of a text from which its shingles are compared in several passes


@dataclass(frozen=True)
class Scheme:
    n: int = 3
    num: int = 90
    den: int = 100
    ratio: float = 1.3
    sub: int = 3  # pieces of a part; a signature leaves one of them out
    seed: int = 0

    def bands(self, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Least and largest size of each band, its parts, the alike parts among them, and the size from which the band below signs here."""
        lo, hi = [1], []
        ratio = max(self.ratio, self.den / self.num)
        while True:
            hi.append(max(lo[-1], int(lo[-1] * ratio), lo[-1] * self.den // self.num))
            if hi[-1] >= largest:
                break
            lo.append(hi[-1] + 1)
        low, high = np.array(lo, np.int64), np.array(hi, np.int64)
        k = (self.den - self.num) * 2 * high // (self.den + self.num)
        alike = 1 + k // 16
        return low, high, k // 2 + alike, alike, -(-self.num * low // self.den)

    def sets(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """The sorted set of each document."""
        data = K.LOWER[data]
        s, e, first = K.word_spans(data, offs, SPACE)
        w = K.span_hash(data, s, e)
        g = K.gram_hash(w, self.n) ^ np.uint64(self.seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= self.n:
                out.append(np.unique(g[a : b - self.n + 1]))
            elif b > a:
                out.append(K.mix(K.gram_hash(w[a:b], b - a) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out

    def signatures(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All signatures one set after another, and where each set's begin."""
        size = np.array([len(x) for x in sets], np.int64)
        low, high, parts, alike, below = self.bands(int(size.max(initial=1)) * self.den // self.num + 1)  # sets linked with these may lie elsewhere
        band = np.searchsorted(high, size)
        up = (band + 1 < len(low)) & (size >= below[np.minimum(band + 1, len(low) - 1)])
        each = np.where(size > 0, 1 + up, 0)
        owner = np.repeat(np.arange(len(sets)), each)  # an instance is a set signing for a band
        second = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
        inst_band = band[owner] + second
        n1 = parts[inst_band]
        first = np.cumsum(n1) - n1
        total = int(n1.sum())
        # elements of each instance
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
        begin = np.cumsum(size) - size
        m = size[owner]
        el = flat[np.repeat(begin[owner] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
        inst = np.repeat(np.arange(len(owner)), m)
        part = ((el >> np.uint64(32)) % n1[inst].astype(np.uint64)).astype(np.int64)
        piece = ((el & np.uint64(0xFFFFFFFF)) % np.uint64(self.sub)).astype(np.int64)
        cell = self.sub * (first[inst] + part) + piece
        v = K.mix(el + np.uint64(0x51ED270B))
        lo = np.bincount(cell, (v & np.uint64(0xFFFFFFFF)).astype(np.float64), self.sub * total).astype(np.uint64)
        hi = np.bincount(cell, (v >> np.uint64(32)).astype(np.float64), self.sub * total).astype(np.uint64)
        t = (lo + (hi << np.uint64(32))).reshape(-1, self.sub)  # sums modulo 2 ** 64: both halves are exact in doubles
        whole = t.sum(1)
        held = np.bincount(cell, minlength=self.sub * total).reshape(-1, self.sub)
        bare = held.sum(1)[:, None] == held  # the other pieces hold nothing
        place = np.arange(total) - np.repeat(first, n1)
        tag = K.mix((np.repeat(inst_band, n1).astype(np.uint64) << np.uint64(40)) + (place.astype(np.uint64) << np.uint64(2)))
        sig = np.stack([K.mix((whole - t[:, q]) ^ (tag + np.uint64(q))) for q in range(self.sub)], 1)
        of = np.repeat(np.arange(len(owner)), n1)
        poor = np.bincount(of, bare.any(1), len(owner)) >= alike[inst_band]
        keep = ~bare | poor[of][:, None]
        per = np.bincount(owner[of], keep.sum(1), len(sets)).astype(np.int64)
        return sig[keep], np.concatenate([[0], np.cumsum(per)])


def names(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each set."""
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    out = []
    for salt in (0x1234567, 0x7654321):
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(flat + np.uint64(salt)))])
        end = np.cumsum(size)
        out.append(K.mix(c[end] - c[end - size] + size.astype(np.uint64)))
    return out[0], out[1]


def sketches(sets: list[np.ndarray]) -> list[bytes]:
    """Parity of the elements that fall on each bit; the exclusive or of its quarters is the sketch of a quarter of the bits."""
    size = np.array([len(x) for x in sets], np.int64)
    level = np.ceil(np.log(np.maximum(size, SHORT) / SHORT) / np.log(4) - 1e-9).astype(np.int64)
    out = [b""] * len(sets)
    for k in np.unique(level).tolist():
        own = np.flatnonzero(level == k).tolist()
        bits = SKETCH << (2 * k)
        flat = np.concatenate([sets[i] for i in own])
        bit = (K.mix(flat) & np.uint64(bits - 1)).astype(np.int64) + bits * np.repeat(np.arange(len(own)), size[own])
        odd = (np.bincount(bit, minlength=bits * len(own)) & 1).astype(np.uint8).reshape(len(own), bits)
        for i, row in zip(own, np.packbits(odd, axis=1)):
            out[i] = row.tobytes()
    return out


def _made(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """doc_id, rid, n, key, key2 for each row of (doc_id, rid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in K.chunks(b.column(2)):
                sets = scheme.sets(data, offs)
                k1, k2 = names(sets)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i).cast(pa.int64()), b.column(1).slice(i, j - i), pa.array([len(x) for x in sets], pa.int64()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))],
                    names=["doc_id", "rid", "n", "key", "key2"],
                )

    return docs.mapInArrow(run, "doc_id long, rid long, n long, key long, key2 long")


def _runs(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))


def _packed(docs: DataFrame, scheme: Scheme, buckets: int) -> DataFrame:
    """Signatures of the texts, packed by bucket: the classes, how many signatures of each follow, and these (47 bits
    and whether other classes of the unit have it too, as 4 and 2 bytes). Rows with a negative bucket hold what
    these stand for: leader, class and signature."""
    ddl = "bucket int, keys binary, counts binary, lo binary, hi binary"

    def flush(keys: list[np.ndarray], sigs: list[np.ndarray], owns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, sig, own = np.sort(np.concatenate(keys)), np.concatenate(sigs), np.concatenate(owns)
        rank = np.searchsorted(key, own).astype(np.uint32)
        home = ((sig & np.uint64(0x1FFFF)) % np.uint64(buckets)).astype(np.int64)
        code = (sig >> np.uint64(17)) << np.uint64(1)
        by = np.argsort(sig)
        sig, rank, home, code = sig[by], rank[by], home[by], code[by]
        at = _runs(sig)
        n = np.diff(np.concatenate([at, [len(sig)]]))
        lead = np.minimum.reduceat(rank, at) if len(at) else rank
        follow = np.flatnonzero((np.repeat(n, n) > 1) & (rank != np.repeat(lead, n)))
        ident = (code[follow] << np.uint64(16)) | home[follow].astype(np.uint64)
        leads = np.repeat(lead, n)[follow]
        for a in range(0, len(follow), 1 << 16):
            part = slice(a, a + (1 << 16))
            spread = -1 - int(ident[a] % np.uint64(1 << 20))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([spread], pa.int32()), "keys": [key[leads[part]].tobytes()], "counts": [b""], "lo": [key[rank[follow[part]]].tobytes()], "hi": [ident[part].tobytes()]})
        code, home = code[at] | (n > 1).astype(np.uint64), home[at]
        by = np.lexsort((lead, home))
        code, home, lead = code[by], home[by], lead[by]
        edge = _runs(home)
        out = []
        for a, z in zip(edge.tolist(), [*edge[1:].tolist(), len(home)]):
            own_at = _runs(lead[a:z])
            c = np.diff(np.concatenate([own_at, [z - a]])).astype("<u4")
            out.append((int(home[a]), key[lead[a:z][own_at]].tobytes(), c.tobytes(), code[a:z].astype("<u4").tobytes(), (code[a:z] >> np.uint64(32)).astype("<u2").tobytes()))
        for a in range(0, len(out), 500):
            cols = list(zip(*out[a : a + 500]))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "keys", "counts", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, keys, sigs, owns, held = set(), [], [], [], 0
        for b in batches:
            for _, _, data, offs in K.chunks(b.column(0)):
                sets = [x for x in scheme.sets(data, offs) if len(x)]
                name = names(sets)[0].view(np.int64)
                fresh = []
                for i, k in enumerate(name.tolist()):
                    if k not in seen:
                        seen.add(k)
                        fresh.append(i)
                if not fresh:
                    continue
                sig, at = scheme.signatures([sets[i] for i in fresh])
                keys.append(name[fresh])
                sigs.append(sig)
                owns.append(np.repeat(name[fresh], np.diff(at)))
                held += len(sig)
                if held >= UNIT:
                    yield from flush(keys, sigs, owns)
                    seen, keys, sigs, owns, held = set(), [], [], [], 0
        if held:
            yield from flush(keys, sigs, owns)

    return docs.mapInArrow(run, ddl)


def _met(packed: DataFrame) -> DataFrame:
    """(kind, sig, a, b) from packed rows, those of a bucket one after another: 0 leader and class (sig: 1 where the signature
    has three classes or more, else 0), 1 signature and leader, 2 signature, leader of a unit and class."""

    def out(kind: int, sig: np.ndarray | None, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        cols = [none if c is None else pa.array(c.view(np.int64)) for c in (sig, a, b)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *cols], names=["kind", "sig", "a", "b"])

    def solve(bucket: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        key = np.concatenate([np.repeat(np.frombuffer(k, np.int64), np.frombuffer(c, "<u4")) for k, c, _, _ in held])
        code = np.concatenate([np.frombuffer(lo, "<u4").astype(np.uint64) | (np.frombuffer(hi, "<u2").astype(np.uint64) << np.uint64(32)) for *_, lo, hi in held])
        flag, code = (code & np.uint64(1)).astype(np.int8), code >> np.uint64(1)
        by = np.argsort(code)
        code, key, flag = code[by], key[by], flag[by]
        at = _runs(code)
        n = np.diff(np.concatenate([at, [len(code)]]))
        lead = np.minimum.reduceat(key, at)
        told = np.maximum.reduceat(flag, at) > 0
        yield out(1, (code[at][told] << np.uint64(17)) | np.uint64(bucket), lead[told], None)
        a, many = np.repeat(lead, n), np.repeat((n > 2) | told, n)
        some = np.flatnonzero(a != key)
        a, b, many = a[some], key[some], many[some]
        by = np.lexsort((~many, b, a))
        a, b, many = a[by], b[by], many[by]
        new = np.concatenate([np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        yield out(0, many[new].astype(np.int64), a[new], b[new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            for k in range(b.num_rows):
                bucket, *row = (b.column(c)[k].as_py() for c in range(5))
                if bucket < 0:
                    yield out(2, np.frombuffer(row[3], np.uint64), np.frombuffer(row[0], np.int64), np.frombuffer(row[2], np.int64))
                    continue
                if bucket != at and held:
                    yield from solve(at, held)
                    held = []
                at = bucket
                held.append(row)
        if held:
            yield from solve(at, held)

    return packed.mapInArrow(run, "kind int, sig long, a long, b long")


def _sketched(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """key, n, sk (the sketch) and text of each row of (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in K.chunks(b.column(1)):
                sets = scheme.sets(data, offs)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array([len(x) for x in sets], pa.int32()), pa.array(sketches(sets), pa.binary()), b.column(1).slice(i, j - i).cast(pa.string())],
                    names=["key", "n", "sk", "text"],
                )

    return docs.mapInArrow(run, "key long, n int, sk binary, text string")


def words_of(text: str) -> list[bytes]:
    return WORDS.findall(text.encode().translate(K.LOWER.tobytes()))


def shingles(w: list[bytes], n: int, part: int = 0, parts: int = 1) -> set[tuple]:
    got = zip(*(w[j:] for j in range(n))) if len(w) >= n else [tuple(w)]
    return set(got) if parts == 1 else {t for t in got if hash(t) % parts == part}


def _checked(pairs: DataFrame, scheme: Scheme) -> DataFrame:
    """a, b, ra, rb of the pairs (a, b, ra, rb, ta, tb) that link; those of one ``a`` follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, wa, sa = None, [], set()
        for b in batches:
            good = []
            for k, a in enumerate(b.column(0).to_pylist()):
                if a != last:
                    last, wa = a, words_of(b.column(4)[k].as_py())
                    sa = shingles(wa, scheme.n) if len(wa) <= PASS else None
                wb = words_of(b.column(5)[k].as_py())
                if sa is not None and len(wb) <= PASS:
                    sb = shingles(wb, scheme.n)
                    na, nb, both = len(sa), len(sb), len(sa & sb)
                else:  # long texts in several passes, so that few shingles are held at a time
                    na = nb = both = 0
                    parts = max(len(wa), len(wb)) // PASS + 1
                    for p in range(parts):
                        x, y = shingles(wa, scheme.n, p, parts), shingles(wb, scheme.n, p, parts)
                        na, nb, both = na + len(x), nb + len(y), both + len(x & y)
                if scheme.den * both >= scheme.num * (na + nb - both):
                    good.append(k)
            yield b.select([0, 1, 2, 3]).take(pa.array(good, pa.int64()))

    return pairs.select("a", "b", "ra", "rb", "ta", "tb").mapInArrow(run, "a long, b long, ra long, rb long")


class Block:
    """Classes of one leader as columns: node, root, n, whether in a signature of three classes or more, sketches."""

    def __init__(self, rows: list[dict]):
        num = lambda c: np.array([r[c] for r in rows], np.int64)
        self.node, self.root, self.n, self.many = num("node"), num("root"), num("n"), num("many") > 0
        self.sketch = [np.frombuffer(r["sk"], "<u8") for r in rows]
        self.words = np.array([len(x) for x in self.sketch], np.int64)

    def folded(self, i: int, words: int) -> np.ndarray:
        x = self.sketch[i]
        while len(x) > words:
            x = np.bitwise_xor.reduce(x.reshape(4, -1))
        return x


def candidates(x: Block, y: Block, ok: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in x and in y, and distance of the sketches, of the pairs of ``ok`` that sizes and sketches allow."""
    ok = ok & (np.minimum(x.n[:, None], y.n) * scheme.den >= np.maximum(x.n[:, None], y.n) * scheme.num) & (x.root[:, None] != y.root)
    i, j = np.nonzero(ok)
    far = np.zeros(len(i), np.int64)
    for least in (True, False):  # all by the smallest sketch first, then what passes by the finest that both have
        fine = np.full(len(i), SKETCH // 64) if least else np.minimum(x.words[i], y.words[j])
        for words in np.unique(fine[fine > SKETCH // 64] if not least else fine).tolist():
            own = np.flatnonzero(fine == words)
            u, p = np.unique(i[own], return_inverse=True)
            v, q = np.unique(j[own], return_inverse=True)
            a, b = np.stack([x.folded(k, words) for k in u.tolist()]), np.stack([y.folded(k, words) for k in v.tolist()])
            d = np.zeros(len(own), np.int64)
            for w in range(words):
                d += np.bitwise_count(a[p, w] ^ b[q, w])
            far[own] = d
        near = far * (scheme.den + scheme.num) <= (scheme.den - scheme.num) * (x.n[i] + y.n[j])
        i, j, far = i[near], j[near], far[near]
    return i, j, far


def forest(a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Places of the edges (a, b) of a shortest spanning forest."""
    up: dict[int, int] = {}

    def top(v: int) -> int:
        while up.get(v, v) != v:
            up[v] = up.get(up[v], up[v])
            v = up[v]
        return v

    kept = []
    for k in np.lexsort((b, a, far)).tolist():
        s, t = top(int(a[k])), top(int(b[k]))
        if s != t:
            up[s] = t
            kept.append(k)
    return np.array(kept, np.int64)


def nearest(u: np.ndarray, v: np.ndarray, far: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``take`` shortest edges of each pair of components (u, v), and whether that pair has more."""
    lo, hi = np.minimum(u, v), np.maximum(u, v)
    by = np.lexsort((far, hi, lo))
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(by)), bool), (lo[by][1:] != lo[by][:-1]) | (hi[by][1:] != hi[by][:-1])]))
    n = np.diff(np.concatenate([at, [len(by)]]))
    first = np.arange(len(by)) - np.repeat(at, n) < take
    return by[first], np.repeat(n > take, n)[first]


def _met_in_blocks(blocks: DataFrame, scheme: Scheme, take: int) -> DataFrame:
    """Pairs a, b of classes that the bounds allow, with far, lead and more; ``blocks``: lead, x and y (null: x with itself),
    lists of (node, root, n, sk, many). With ``take`` 0 a spanning forest of the pairs, else the nearest of each two components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                lead, x = b.column(0)[r].as_py(), Block(b.column(1)[r].as_py())
                other = b.column(2)[r].as_py()
                y = x if other is None else Block(other)
                ok = (x.many[:, None] & y.many) | (x.node == lead)[:, None] | (y.node == lead)
                ok &= x.node[:, None] < y.node if other is None else x.node[:, None] != y.node
                i, j, far = candidates(x, y, ok, scheme)
                if take:
                    pick, more = nearest(x.root[i], y.root[j], far, take)
                else:
                    pick = forest(x.node[i], y.node[j], far)
                    more = np.zeros(len(pick), bool)
                yield pa.RecordBatch.from_arrays([pa.array(x.node[i][pick]), pa.array(y.node[j][pick]), pa.array(far[pick]), pa.array(more), pa.array(np.full(len(pick), lead, np.int64))], names=["a", "b", "far", "more", "lead"])

    return blocks.select("lead", "x", "y").mapInArrow(run, "a long, b long, far long, more boolean, lead long")


def link(docs: DataFrame, scheme: Scheme | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    return link_rows(numbered(only(docs, "doc_id", "text")), scheme or Scheme()).drop("rid", "represents")


def link_rows(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """doc_id, rid, n_shingles, component_id, and whether the row is the one that represents its component; ``rows``: see common.numbered."""
    src = rows.select(F.col("row.doc_id").alias("doc_id"), "rid", F.col("row.text").alias("text"))
    while True:
        base = cut(_made(src, scheme), "named")
        classes = base.where("n > 0").groupBy("key").agg(F.min("key2").alias("k2"), F.max("key2").alias("k3"), F.min("rid").alias("rid"))
        if classes.where("k2 <> k3").isEmpty():
            break
        free(base)
        scheme = replace(scheme, seed=scheme.seed + 1)
    spark = rows.sparkSession
    total = base.agg(F.sum("n").alias("n")).first()["n"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    buckets = min(1 << 16, max(parts, total // BUCKET))
    packed = _packed(src.select("text").where("text IS NOT NULL"), scheme, buckets)
    met = cut(_met(packed.repartition(parts, "bucket").sortWithinPartitions("bucket")), "met")
    lead = met.where("kind = 1").select("sig", F.col("a").alias("lead"))
    unit = met.where("kind = 2").join(lead, "sig").select("lead", F.col("b").alias("node"), F.lit(1).cast("long").alias("many")).where("lead <> node")
    star = met.where("kind = 0").select(F.col("a").alias("lead"), F.col("b").alias("node"), F.col("sig").alias("many")).unionAll(unit)
    star = cut(star.groupBy("lead", "node").agg(F.max("many").alias("many")), "star")
    free(met)

    near = star.select(F.col("lead").alias("key")).unionAll(star.select(F.col("node").alias("key"))).distinct()
    reps = near.join(classes.select("key", "rid"), "key")
    cls = cut(_sketched(src.join(reps, "rid").select("key", "text"), scheme), "classes")
    root = cut(cls.select(F.col("key").alias("node"), F.col("key").alias("root")), "roots")

    def rooted(df: DataFrame, x: str, out: str) -> DataFrame:
        return df.join(root.select(F.col("node").alias(x), F.col("root").alias(out)), x)

    def verified(pairs: DataFrame, few: bool) -> DataFrame:
        """``few``: most texts are not needed, so those that are get picked by a table of keys that Spark may broadcast."""
        texts = cls.select("key", "text")
        if few:
            need = cut(pairs.select(F.col("a").alias("key")).unionAll(pairs.select(F.col("b").alias("key"))).distinct(), "keys")
            texts = texts.join(need, "key", "left_semi")
        text = lambda x: texts.select(F.col("key").alias(x), F.col("text").alias(f"t{x}"))
        links = cut(_checked(pairs.select("a", "b", "ra", "rb").join(text("b"), "b").join(text("a"), "a"), scheme), "links")
        if few:
            free(need)
        return links

    def merge(links: DataFrame) -> None:
        """Components of the roots that ``links`` (ra, rb) connect become one."""
        nonlocal root
        new = components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        if new is None:
            return
        old = root
        root = cut(old.join(new.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left").select("node", F.coalesce("_to", "root").alias("root")), "roots")
        free(old, new)

    def settle(pairs: DataFrame, few: bool = True) -> None:
        """Verify pairs (a, b, far) until none is left between different components, the nearest of each two components first."""
        take = 1
        while True:
            open_ = cut(rooted(rooted(pairs, "a", "ra"), "b", "rb").where("ra <> rb"), "between")
            if open_.isEmpty():
                free(open_)
                return
            place = W.partitionBy(F.least("ra", "rb"), F.greatest("ra", "rb")).orderBy("far", "a", "b")
            chosen = cut(open_.withColumn("_k", F.row_number().over(place)).where(F.col("_k") <= take).drop("_k"), "chosen")
            links = verified(chosen, few)
            merge(links)
            pairs = open_.join(chosen.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "far")
            free(links)
            few = True
            take *= 16

    def members(ties: DataFrame) -> DataFrame:
        """lead, size (of its group) and m, a class of it as a row of a block; the leader is one of its own."""
        rows = ties.unionAll(ties.select("lead").distinct().select("lead", F.col("lead").alias("node"), F.lit(1).cast("long").alias("many")))
        rows = rooted(rows, "node", "root").join(cls.select(F.col("key").alias("node"), "n", "sk"), "node")
        return rows.select("lead", F.struct("node", "root", "n", "sk", "many").alias("m"))

    def blocked(rows: DataFrame, size: str, name: str) -> DataFrame:
        """Lists of about BLOCK members of a group."""
        blk = F.pmod(F.xxhash64("m.node"), F.ceil(F.col(size) / BLOCK))
        return rows.groupBy("lead", "size", blk.alias("blk")).agg(F.collect_list("m").alias(name)).drop("blk")

    sizes = star.groupBy("lead").agg((F.count(F.lit(1)) + 1).alias("size"))
    blocks = cut(blocked(members(star).join(sizes, "lead"), "size", "m"), "blocks")
    none = F.lit(None).cast(blocks.schema["m"].dataType)
    alone = blocks.where(F.col("size") <= BLOCK).select("lead", F.col("m").alias("x"), none.alias("y"))
    head = cls.select(F.col("key").alias("lead"), F.array(F.struct(F.col("key").alias("node"), F.col("key").alias("root"), "n", "sk", F.lit(1).cast("long").alias("many"))).alias("x"))
    large = blocks.where(F.col("size") > BLOCK).join(head, "lead").select("lead", "x", F.col("m").alias("y"))
    found = cut(_met_in_blocks(alone.unionAll(large), scheme, 0), "pairs")
    free(blocks)
    settle(found.groupBy("a", "b").agg(F.min("far").alias("far")), few=False)
    failed = rooted(rooted(found, "a", "ra"), "b", "rb").where("ra <> rb").select("lead")
    again = cut(failed.unionAll(sizes.where(F.col("size") > BLOCK).select("lead")).distinct(), "leads")
    free(found)
    take = 16
    while not again.isEmpty():
        rows = members(star.join(again, "lead", "left_semi"))
        shares = rows.groupBy("lead", F.col("m.root").alias("root")).agg(F.count(F.lit(1)).alias("c"))
        tops = shares.groupBy("lead").agg(F.max(F.struct("c", "root")).alias("t"), F.count(F.lit(1)).alias("k"), F.sum("c").alias("size")).where("k > 1").select("lead", F.col("t.root").alias("top"), "size", (F.col("size") - F.col("t.c")).alias("rest"))
        rows = cut(rows.join(tops, "lead"), "members")
        both = blocked(rows.where(F.col("m.root") != F.col("top")), "rest", "x").drop("size").join(blocked(rows, "size", "y").drop("size"), "lead")
        found = cut(_met_in_blocks(both, scheme, take), "pairs")
        settle(found.groupBy("a", "b").agg(F.min("far").alias("far")))
        more = cut(found.where("more").select("lead").distinct(), "leads")
        free(rows, found, again)
        again = more
        take *= 16
    free(again)

    out = base.select("doc_id", "rid", "n", "key").join(root.select(F.col("node").alias("key"), F.col("root").alias("_r")), "key", "left").withColumn("_root", F.coalesce("_r", "key"))
    heads = out.where("n > 0").groupBy("_root").agg(F.min("doc_id").alias("_c"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("_h"))
    out = out.join(heads, "_root", "left")
    alone = F.col("n") == 0
    out = cut(out.select("doc_id", "rid", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("_c")).alias("component_id"), (alone | (F.col("rid") == F.col("_h.rid"))).alias("represents")), "linked")
    free(base, star, cls, root)
    return out


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


SCHEME = Scheme(5, 80, 100, ratio=1.4)  # of the pipeline: five words, similarity 0.8


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group (five words, similarity 0.8): the one with the smallest doc_id."""
    rows = numbered(docs)
    gone = cut(link_rows(rows, SCHEME).where("NOT represents").select("rid"), "gone")  # few against the rows, as a rule: then no text is shuffled
    return rows.join(gone, "rid", "left_anti").select("row.*")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE least(na.n, nb.n) * 100 >= greatest(na.n, nb.n) * 90
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))
), both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(v, c) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT x.b, r.c FROM r JOIN both_ways x ON x.a = r.v WHERE r.c < x.b
), c AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.v = d.doc_id
"""

QUERIES = {"op4_jaccard_join": op4_jaccard_join}
ORACLES = {"op4_jaccard_join": SQL}
