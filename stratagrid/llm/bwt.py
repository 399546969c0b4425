"""Burrows-Wheeler transforms of text shards, and their merge by iterative interleave refinement.

A shard is a byte string, read in a circle. Its transform lists, in order of its rotations, the ``step`` bytes
before each (one symbol, 8 bytes where the depth allows). The merge never compares texts: starting from the shards' rotations one shard after another, it
walks through the interleave, takes the next symbol of the shard standing there, and deals the places stably
by symbol. After h such rounds the interleave is in order of the rotations' first step * h bytes, and the block
boundaries that appeared by then are where the common prefix is shorter than that.
"""

from __future__ import annotations

import numpy as np


def order(text: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of ``text`` in order of at least their first ``depth`` bytes (ties in any order), by prefix doubling."""
    n = len(text)
    ring = np.concatenate([text, np.resize(text, 8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | ring[j : j + n]
    by = np.argsort(key)
    start = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
    rank = np.empty(n, np.int64)  # the place at which a rotation's group begins
    rank[by] = np.repeat(start, np.diff(np.append(start, n)))
    h = 8
    while h < depth:
        size = np.bincount(rank, minlength=n)
        tied = np.flatnonzero(size[rank[by]] > 1)  # only groups of several are looked at again
        if not len(tied):
            break
        at = by[tied]
        key = rank[at].astype(np.uint64) * np.uint64(n + 1) + rank[(at + h) % n].astype(np.uint64)
        move = np.argsort(key)
        by[tied], key = at[move], key[move]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        rank[by[tied]] = np.repeat(tied[start], np.diff(np.append(start, len(tied))))
        h *= 2
    return by


def step_of(depth: int) -> int:
    return next(k for k in (8, 4, 2, 1) if depth % k == 0)


def transform(text: np.ndarray, by: np.ndarray, step: int) -> np.ndarray:
    """The ``step`` bytes before each rotation, in order, as one symbol."""
    out = np.zeros(len(by), np.uint64)
    for k in range(step, 0, -1):
        out = (out << np.uint64(8)) | np.take(text, by - k, mode="wrap")
    return out


def stable(symbol: np.ndarray) -> np.ndarray:
    """Stable order of small numbers, 16 bits at a time (radix)."""
    by = np.argsort(symbol.astype(np.uint16), kind="stable")
    if len(symbol) and int(symbol.max()) >> 16:
        by = by[np.argsort((symbol >> 16).astype(np.uint16)[by], kind="stable")]
    return by


def merge(transforms: list[np.ndarray], back: list[np.ndarray], begin: list[np.ndarray], weight: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave (numbers of rotations, counted through all shards in their orders) and the block of each place.

    ``back``: for each rotation of a shard, in order, the number in that order of the rotation one symbol
    earlier (the LF mapping). ``begin``: the rotations that the walk starts from, in order, and ``weight`` how often each
    stands; it ends ``depth`` bytes earlier, so only rotations whose prefixes are asked for need to be walked. Places
    of one block have rotations that agree on their first ``depth`` bytes. A block that holds a single rotation that
    stands once is left out as soon as it appears: a longer prefix can't be repeated where a part of it isn't.
    """
    _, flow = np.unique(np.concatenate(transforms), return_inverse=True)  # symbols in order, as small numbers
    flow = flow.astype(np.uint32)
    shift = np.cumsum([0, *map(len, transforms)])[:-1]
    lf = np.concatenate([b + s for b, s in zip(back, shift)])
    z, times = np.concatenate([b + s for b, s in zip(begin, shift)]), np.concatenate(weight)
    block = np.zeros(len(z), np.int64)
    for _ in range(depth // step_of(depth)):
        symbol = flow[z]
        move = stable(symbol)
        z, block, times, s = lf[z[move]], block[move], times[move], symbol[move]
        at = np.flatnonzero(np.concatenate([np.ones(min(1, len(z)), bool), (block[1:] != block[:-1]) | (s[1:] != s[:-1])]))
        n = np.diff(np.append(at, len(z)))
        live = np.add.reduceat(times, at) >= 2 if len(at) else np.zeros(0, bool)
        keep = np.repeat(live, n)
        z, times, block = z[keep], times[keep], np.repeat(np.arange(int(live.sum())), n[live])
    return z, block


def repeated(texts: list[bytes], starts: list[int], weights: list[int], depth: int, shard: int = 1 << 17) -> list[np.ndarray]:
    """For each text, which of its first ``starts`` windows of ``depth`` bytes stand elsewhere too.

    ``weights``: how often a text's windows are known to stand in the corpus.
    """
    groups: list[list[int]] = [[]]
    size = 0
    for i, t in enumerate(texts):
        if size >= shard:
            groups.append([])
            size = 0
        groups[-1].append(i)
        size += len(t)
    places, transforms, back, begin, counts = [], [], [], [], []
    offset = 0
    home: list[tuple[int, int]] = []
    step = step_of(depth)
    for g in groups:
        text = np.frombuffer(b"".join(texts[i] for i in g), np.uint8)
        w, first = np.zeros(len(text), np.int64), offset
        for i in g:
            home.append((i, offset))
            w[offset - first : offset - first + starts[i]] = weights[i]
            offset += len(texts[i])
        by = order(text, depth)
        number = np.empty(len(by), np.int64)
        number[by] = np.arange(len(by))
        transforms.append(transform(text, by, step))
        back.append(number[(by - step) % len(by)])
        asked = np.flatnonzero(w)
        ends = number[(asked + depth) % len(text)]
        in_order = np.argsort(ends)
        begin.append(ends[in_order])
        places.append(by + first)
        counts.append(w[asked[in_order]])
    z, _ = merge(transforms, back, begin, counts, depth)  # the intervals of repeated windows
    at = np.concatenate(places)
    again = np.zeros(len(at), bool)
    again[at[z]] = True
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(texts)
    for i, o in home:
        out[i] = again[o : o + starts[i]]
    return out
