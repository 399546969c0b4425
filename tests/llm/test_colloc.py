"""Operator 11 against a count of every phrase in plain Python."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from stratagrid.llm import colloc

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, longest=3, inside=50, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    longer = collections.Counter()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(a, longer[lang, w[i : i + k]])
    best = collections.defaultdict(list)
    for (lang, w), a in cand.items():
        cuts = [(1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        if 100 * longer[lang, w] < inside * a:
            best[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, rows in best.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top])}


def got(df):
    return {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect()}


def texts(seed, n=300, vocabulary=12):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "THÉ", "x" * 70, "日本", "a\x00b", "c\x1cd", *[f"w{i}" for i in range(vocabulary)]]
    join = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "?"]
    out = []
    for _ in range(n):
        w = [rng.choice(words[:4] if rng.random() < 0.5 else words) for _ in range(rng.randint(0, 25))]
        out.append((rng.choice(["en", "de", None, "und"]), "".join(x + rng.choice(join) for x in w)))
    return [*out, ("en", None), ("en", ""), (None, " \t"), ("fr", "..."), ("en", "the of " * 400)]


@pytest.mark.parametrize("share,chunk,longest,least,inside,top", [(500_000, 8 << 20, 3, 10, 50, 2000), (200, 700, 3, 3, 80, 7), (20, 150, 4, 10, 50, 2000), (40, 300, 2, 3, 80, 7)])
def test_equals_brute_force(spark, share, chunk, longest, least, inside, top):
    """Small shares make most words hot, so prefixes are dealt over many tasks; small chunks cut texts at pieces."""
    rows = texts(share)
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "lang string, text string")
    assert got(colloc.collocations(docs, least, longest, inside, top, share=share, chunk=chunk, spread=3)) == brute(rows, least, longest, inside, top)


def test_one_phrase_holds_most_rows(spark):
    rows = [("en", "of the same thing")] * 4000 + [("en", f"of the w{i}") for i in range(2000)] + texts(5, 60)
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 5), "lang string, text string")
    assert got(colloc.collocations(docs, share=500)) == brute(rows)


def test_prefixes_grow_only_while_frequent():
    """Depth first, and never into a range with fewer occurrences than asked for."""
    words = b"a b c a b d a x y b c d q r s "
    p = colloc.Projection(np.array([6, 5, 9, 30, 1]), np.array([3] * 5), np.frombuffer(words, np.uint8), 3)
    text = p.coded.to_pylist()
    found = [(b"".join(text[p.cols[d][at] - 1] for d in range(k)), n) for at, k, n in p.grow(10, np.zeros(len(text) + 1, bool))]
    assert found == [(b"a b ", 11), (b"b c ", 30), (b"b c d ", 30)]
    parts = [(k, n) for at, k, n in p.grow(100, np.array([False] + [t in (b"a ", b"b ") for t in text]))]
    assert parts == [(2, 11)]  # of a prefix of hot words every part is reported


def test_large_counts_stay_exact(spark):
    big = 3 * 10**15 + 1
    rows = spark.createDataFrame([(big, big + 2, big + 5)], "a long, l long, r long")
    d = "CAST({} AS DECIMAL(19,0))".format
    score = rows.selectExpr(f"({d('a')} * {d('a')} * CAST(1000000 AS DECIMAL(7,0))) div ({d('l')} * {d('r')}) AS s").first()[0]
    assert score == 1000000 * big * big // ((big + 2) * (big + 5))


def test_defined_cases(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    out = colloc.collocations(empty)
    assert out.count() == 0 and out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = [("en", "a b. " * 12), ("en", "a b. " * 12), (None, None)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "lang string, text string, f int, phrase string, rank int")
    assert got(colloc.collocations(docs)) == brute(rows) == {("en", 1, "a b", 24, 24, 24, 48, 1000000)}


def test_very_long_piece_and_text():
    b = pa.RecordBatch.from_pydict({"lang": ["en", "en"], "text": ["w " * 5000, "a b. " * 3000]})
    chunks = list(colloc.text_chunks(b, 500))
    assert sum(len(c.piece) for c, _ in chunks) == 11000 and max(len(c.piece) for c, _ in chunks) <= 5000 + 400
    assert sum((c.reach(3) == 3).sum() for c, _ in chunks) == 4998


def test_whole_table(spark, sf):
    from stratagrid.llm.common import table

    rows = [(r["lang"], r["text"]) for r in table(spark, sf, "documents").select("lang", "text").collect()]
    assert got(colloc.op11_collocations(spark, sf)) == brute(rows)
