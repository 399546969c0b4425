"""Edge rows, clashing names, adversarial texts and whole-pipeline brute force."""

import collections
import hashlib
import heapq
import os
import random
import zlib

import numpy as np
import pytest
from test_llm import brute_lines, brute_repeats

from stratagrid.llm import decontam, jaccard, knn, langid, lines, packing, quality, repeats, sharding, toxicity
from stratagrid.llm import textkit as K
from stratagrid.llm.common import table

NAMES = "score predicted contaminated items n_words n_hit n_items _lines _cuts _rid rid row key key2 sig root n_lines n_removed matches lang".split()


def docs_of(spark, texts, ids=None, parts=2):
    rows = [(i, t) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string")


def morse(n, a, b):
    s = [0]
    while len(s) < n:
        s += [1 - x for x in s]
    return "".join(a if x == 0 else b for x in s[:n]), "".join(b if x == 0 else a for x in s[:n])


def test_hash_tells_apart_what_sums_confuse():
    for n in (64, 512, 1024, 2048, 4096):
        for a, b in ("ab", "!a"):
            d = np.frombuffer("".join(morse(n, a, b)).encode(), np.uint8)
            h = K.span_hash(d, np.array([0, n]), np.array([n, 2 * n]))
            assert h[0] != h[1]
    x = np.frombuffer(b"abc" * 2000, np.uint8)
    for n in (1, 7, 8, 9, 511, 512, 513, 1000):  # alike wherever it stands
        assert len(set(K.span_hash(x, np.array([0, 3, 300]), np.array([n, 3 + n, 300 + n])).tolist())) == 1
        assert len(set(K.span_hash(x, np.array([0, 1]), np.array([n, 1 + n])).tolist())) == 2


def test_adversarial_texts(spark):
    a, b = morse(2048, "a", "b")
    got = {r["doc_id"]: r["text"] for r in lines.deduped(docs_of(spark, [f"x\n{a}", f"x\n{b}"])).collect()}
    assert got == {0: f"x\n{a}", 1: f"x\n{b}"}
    assert {r["component_id"] for r in jaccard.link(docs_of(spark, [a, b])).collect()} == {0, 1}
    texts = [a, b + "zz" * 300]
    assert sorted(tuple(r)[1:] for r in repeats.dedup(docs_of(spark, texts)).collect()) == brute_repeats([t.encode() for t in texts], 200)


@pytest.mark.parametrize("scheme", [jaccard.Scheme(), jaccard.SCHEME])
def test_linked_sets_share_a_signature(scheme):
    rng = np.random.default_rng(3)
    for size in [1, 2, 3, 5, 8, 12, 20, 33, 47, 60, 90, 140, 300, 700, 1500]:
        for _ in range(12):
            both = rng.integers(0, 1 << 63, size).astype(np.uint64)
            most = int(size * (scheme.den - scheme.num) / scheme.num)  # differences that still link: den * size >= num * (size + extra)
            x = int(rng.integers(0, most + 1))
            a = np.unique(np.concatenate([both, rng.integers(0, 1 << 63, x).astype(np.uint64)]))
            b = np.unique(np.concatenate([both, rng.integers(0, 1 << 63, most - x).astype(np.uint64)]))
            assert scheme.den * size >= scheme.num * (len(a) + len(b) - size)
            s, t = (set(scheme.signatures([v])[0].tolist()) for v in (a, b))
            assert s & t, (size, x, most)


def test_stages_keep_columns_of_any_name(spark, sf):
    text = "one two three four five six seven eight nine ten"
    rows = [(k, t, *[f"{n}{k}" for n in NAMES]) for k, t in enumerate([text + "\n" + text, text, "other words here", "other words here", None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES))
    for stage, kept in ((toxicity.stage, range(6)), (lines.stage, range(6)), (jaccard.stage, (0, 1, 2, 4, 5)), (decontam.stage, range(6))):
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns
        out = {r["doc_id"]: r for r in got.collect()}
        assert sorted(out) == list(kept), stage
        assert all(out[k][n] == f"{n}{k}" for k in kept for n in NAMES)
    assert packing.stage(spark, docs, sf).count() == 6
    for stage in (toxicity.stage, lines.stage, jaccard.stage, decontam.stage, packing.stage):
        assert stage(spark, docs.limit(0), sf).count() == 0
    nulls = docs.selectExpr("CAST(NULL AS LONG) AS doc_id", *[f"`{c}`" for c in docs.columns[1:]])
    assert [stage(spark, nulls, sf).count() for stage in (toxicity.stage, lines.stage, jaccard.stage, decontam.stage)] == [6, 6, 5, 6]


def test_line_dedup_rows(spark):
    long = "one two three four five six seven eight nine"
    docs = docs_of(spark, [long, long, long, None, f"a\nb\n{long}"], [None, 5, 5, 7, 6])
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in lines.deduped(docs).collect())
    assert got == sorted([("None", ""), ("5", long), ("5", ""), ("7", "None"), ("6", "a\nb")])
    assert lines.deduped(docs.limit(0)).count() == 0
    assert lines.extended([{"lo": k, "hi": k + 1, "from_rid": 9, "from_lo": k + 3} for k in (4, 5, 8)] + [{"lo": 9, "hi": 10, "from_rid": 9, "from_lo": 1}]) == [(4, 6), (8, 9), (9, 10)]


def test_jaccard_null_ids_copies_and_hot_signature(spark):
    rng = random.Random(1)
    same = " ".join(f"w{k}" for k in range(30))
    shared = [f"s{k}" for k in range(40)]
    hot = [" ".join(shared + [f"d{d}x{k}" for k in range(60)]) for d in range(80)]  # share 40 of 100 words, link with nothing
    ids = [None, 3, 3, 4] + list(range(100, 180))
    got = [tuple(r) for r in jaccard.link(docs_of(spark, [same, same, same, ""] + hot, ids, 4)).select("doc_id", "component_id").collect()]
    assert collections.Counter(got) == collections.Counter([(None, 3), (3, 3), (3, 3), (4, 4)] + [(k, k) for k in range(100, 180)])
    assert {r["component_id"] for r in jaccard.link(docs_of(spark, [same], [None])).collect()} == {None}
    rng.shuffle(hot)


def test_sharding_loads_are_the_heap_s(spark):
    rng = random.Random(7)
    texts = ["x" * rng.choice([0, 1, 5, 40, 41, 300]) + str(rng.randint(0, 30)) for _ in range(400)] + [None] * 9
    docs = docs_of(spark, texts)
    groups = collections.Counter()
    for t in texts:
        groups[t] += len((t or "").encode()) + 8
    heap = [(0, j) for j in range(7)]
    for s in sorted(groups.values(), reverse=True):
        at, j = heapq.heappop(heap)
        heapq.heappush(heap, (at + s, j))
    for n in (1, 3, 50_000):
        load = collections.Counter()
        for r in sharding.assign(docs, 7, slice_sizes=n).collect():
            load[r["shard"]] += r["size"]
        assert load == {j: at for at, j in heap}


@pytest.mark.parametrize("crowd", [1, 10, 10**9])
def test_suffix_dedup_of_crowded_anchors(spark, crowd):
    rng = random.Random(8)
    core = "".join(rng.choice("abcdefgh") for _ in range(230))
    noise = lambda n: "".join(rng.choice("xyz") for _ in range(n))
    texts = [noise(rng.randint(0, 40)) + core[rng.randint(0, 20) : rng.randint(205, 230)] + noise(rng.randint(0, 300)) for _ in range(60)] + [core] * 3
    got = sorted(tuple(r)[1:] for r in repeats.dedup(docs_of(spark, texts), crowd=crowd).collect())
    assert got == brute_repeats([t.encode() for t in texts], 200)


def test_suffix_dedup_of_a_very_long_text(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(97, 123, 9_000_000).astype(np.uint8).tobytes().decode()
    passage = a[4_194_000:4_195_000]  # where the pieces meet
    got = {r["doc_id"]: r for r in repeats.dedup(docs_of(spark, [a, "?" + passage + "!"]).selectExpr("doc_id", "text", "1 AS rid", "2 AS at", "3 AS key")).collect()}
    assert (got[0]["n_removed"], got[0]["n_spans"], got[1]["n_removed"]) == (1000, 1, 1000)
    assert got[0]["kept_sha256"] == hashlib.sha256((a[:4_194_000] + a[4_195_000:]).encode()).hexdigest()
    assert repeats.dedup(docs_of(spark, []) if False else spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_nearest_of_extreme_vectors(spark):
    v = [(0, [1e200, 1.0]), (1, [1.5e200, 1.0]), (2, [3e200, 1.0]), (3, [1e-200, 0.0]), (4, [2e-200, 0.0]), (100, [1e-200, 1e-201])]
    df = spark.createDataFrame([(*r, 7, 8) for r in v], "vec_id long, embedding array<double>, id int, bound int")
    got = [tuple(r) for r in knn.nearest(df, df.where("vec_id % 100 = 0"), k=3).orderBy("query_id", "rank").collect()]
    assert [r[2] for r in got if r[0] == 0] == [1, 3, 4] and [r[2] for r in got if r[0] == 100] == [3, 4, 0]
    assert got[0][3] == pytest.approx(5e199)


def test_nearest_in_lots(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(k, rng.standard_normal(8).tolist()) for k in range(400)], "vec_id long, embedding array<double>")
    q = df.where("vec_id % 5 = 0")
    one, many = (sorted(map(tuple, knn.nearest(df, q, block=50, query_block=8, lot=n).collect())) for n in (10**6, 17))
    assert one == many and len(one) == 800


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, item_id long, text string")
    docs = docs_of(spark, ["a b c", None])
    assert decontam.find(none, none).count() == 0
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in decontam.find(docs, none).orderBy("doc_id").collect()] == [(3, 0, False), (0, 0, False)]


def test_toxicity_labels(spark):
    docs = docs_of(spark, [f"fine words number {k}" for k in range(40)] + [f"awful{k % 3} thing awful{k % 3}" for k in range(40)])
    schema = "doc_id long, toxic int, extra string"
    lab = [(k, int(k >= 40), "e") for k in range(80)] + [(41, 0, "e"), (999, 1, "e"), (None, 1, "e"), (3, None, "e")]
    m = toxicity.fit(docs, spark.createDataFrame(lab, schema))
    s = m.score(["fine words number 7", "awful1 thing awful1", None, ""])
    assert s[1] > 0.5 > s[0] and s[2] == s[3] < 0.5
    for y in (0, 1):
        one = toxicity.fit(docs, spark.createDataFrame([(k, y, "e") for k in range(9)], schema))
        assert one.score(["x", None]).tolist() == [y, y]
    assert toxicity.fit(docs, spark.createDataFrame([], schema)).score(["x"]).tolist() == [0.0]
    assert toxicity.scored(docs.limit(0), m).count() == 0


def test_toxicity_learns_beside_foreign_labels_and_long_texts(spark):
    """Labels of absent documents, and documents above the sample's size, take no place in the sample and don't count."""
    fine, awful = [f"fine words number {k}" for k in range(60)], [f"awful{k % 3} thing awful{k % 3}" for k in range(60)]
    docs = docs_of(spark, [*fine, *awful, *["long " * 900] * 40])
    schema = "doc_id long, toxic int"
    own = [(k, int(k >= 60)) for k in range(120)]
    alone = toxicity.fit(docs.where("doc_id < 120"), spark.createDataFrame(own, schema), sample_toxic=20, sample_ordinary=30)
    more = own + [(10_000 + k, k % 2) for k in range(4000)] + [(120 + k, k % 2) for k in range(40)]
    m = toxicity.fit(docs, spark.createDataFrame(more, schema), sample_toxic=20, sample_ordinary=30, sample_bytes=1000)
    probe = ["fine words number 7", "awful1 thing awful1", "long " * 900]
    assert m.score(probe).tolist() == alone.score(probe).tolist()
    assert m.score(probe)[1] > 0.5 > m.score(probe)[0]
    none = toxicity.fit(docs, spark.createDataFrame([(10_000 + k, k % 2) for k in range(40)], schema))
    assert none.score(probe).tolist() == [0.0] * 3


def test_language_ties_and_empty_table(spark):
    docs = spark.createDataFrame([("aaa bbb", "z"), ("aaa bbb", "y")], "text string, lang string")
    m = langid.learn(docs)
    assert m.predict(__import__("pyarrow").array(["aaa bbb", "123", None]))[0] == ["y", "und", "und"]  # equal likelihoods: first by name
    assert langid.predicted(docs_of(spark, ["x"]).limit(0), m).count() == 0


def test_quality_of_odd_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    odd = docs_of(spark, [None, "", " \n ", "a" * 200_000], [None, 1, 1, 2])
    both = docs.unionAll(odd).unionAll(docs.limit(1)).unionAll(docs.limit(1))
    got = quality.classified(both, *quality.train(both)).collect()
    assert len(got) == both.count() and all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 for r in got)
    blank = quality.classified(odd, *quality.train(both)).collect()
    assert len({r["score"] for r in blank[:3]}) == 1 and all(r["n_votes"] == 1 for r in blank[:3])
    copies = quality.train(docs.limit(3).unionAll(docs.limit(3)).unionAll(docs.limit(3)), sample=5)[1]
    assert np.isfinite(copies.w).all()


def test_packing_of_a_very_long_text(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    text = " ".join(f"word{k % 977} n{k}" for k in range(250_000))
    got = packing.pack(docs_of(spark, [text]).selectExpr("doc_id", "text", "1 AS piece", "2 AS length")).orderBy("piece").collect()
    ids = [*tok.encode(text, add_special_tokens=False).ids, 1]
    assert [r["length"] for r in got] == [min(4096, len(ids) - a) for a in range(0, len(ids), 4096)]
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes()) for a in range(0, len(ids), 4096)]


def shingles(text, n):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_pipeline_equals_brute_force(spark, sf, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline as cp

    rng = random.Random(11)
    sample = table(spark, sf, "documents").orderBy("doc_id").limit(60).collect()
    items = [r["text"] for r in table(spark, sf, "benchmark").orderBy("item_id").limit(20).collect()]
    texts = [r["text"] for r in sample]
    for k in range(30):
        w = rng.choice(texts[:60]).split(" ")
        for _ in range(rng.choice([0, 1, 2, 8])):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 9)}"
        texts.append(" ".join(w) + rng.choice(["", "\n" + rng.choice(items), "\nsame closing line of eight words stands here again"]))
    texts += [None, "", "   ", texts[3], "you worthless pathetic idiot " * 12]
    spark.createDataFrame([(k, t, None if t is None else len(t), "x") for k, t in enumerate(texts)], "doc_id long, text string, n_chars long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("benchmark", "labels"):
        os.symlink(f"{sf}/{name}.parquet", f"{tmp_path}/{name}.parquet")
    labels = table(spark, str(tmp_path), "labels")
    model = toxicity.fit(table(spark, str(tmp_path), "documents"), labels)
    kept = [(k, t) for k, t in enumerate(texts) if model.score([t])[0] < 0.5]
    cut = brute_lines([(k, k, t) for k, t in kept])
    kept = [(k, t) for (k, _), t in zip(kept, cut)]
    sets = {k: shingles(t, 5) for k, t in kept}
    top = {k: k for k, _ in kept}

    def find(k):
        return k if top[k] == k else find(top[k])

    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and 100 * len(x & y) >= 80 * len(x | y):
                i, j = sorted((find(a), find(b)))
                top[j] = i
    kept = [(k, t) for k, t in kept if find(k) == k]
    windows = collections.defaultdict(set)
    for r in table(spark, sf, "benchmark").collect():
        w = decontam.split_words(r["text"])
        m = min(10, len(w))
        if m:
            windows[m].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))

    def hit(t):
        w = decontam.split_words(t)
        return any(tuple(w[i : i + m]) in g for m, g in windows.items() for i in range(len(w) - m + 1))

    kept = [(k, t) for k, t in kept if not hit(t)]
    tok, want = Tokenizer.from_file(packing.default_tokenizer()), collections.Counter()
    for k, t in kept:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for p, a in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[a : a + 4096], "<u4")
            want[k, p, a, len(part), zlib.crc32(part.tobytes())] += 1
    got = cp.run(spark, str(tmp_path)).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    assert 40 < len(kept) < len(texts)
