"""The ten operators against brute force, SQL or held-out labels, and on edge rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from compare import same

from stratagrid.llm import bwt, decontam, jaccard, knn, langid, lines, packing, quality, registry, repeats, sharding, toxicity
from stratagrid.llm.common import table

EDGE = [(1, None, "x"), (2, "", "y"), (3, "one", "x"), (3, "one", "x"), (None, "a b c d e f g h i j k l", "z"), (5, "word " * 3000, "z"), (6, "\n\n", None), (7, "ÄÖ 漢字 <|endoftext|>\ttab", "q")]
DOCS = "doc_id long, text string, n_rows string"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


def test_sql_oracles(spark, sf, duck):
    for name, sql in registry.oracle_sql().items():
        same(registry.queries()[name](spark, sf).toPandas(), duck.execute(sql).df())


def test_quality(spark, sf, edge):
    docs = table(spark, sf, "documents")
    got = {r["doc_id"]: r for r in quality.classified(docs, *quality.train(docs)).collect()}
    lab = table(spark, sf, "labels").where("quality IS NOT NULL").collect()
    y = np.array([r["quality"] for r in lab])
    assert toxicity.auc(np.array([got[r["doc_id"]]["score"] for r in lab]), y) > 0.8
    assert quality.classified(edge, *quality.train(edge)).count() == len(EDGE)
    assert quality.classified(edge.limit(0), *quality.train(edge.limit(0))).count() == 0


def test_em_finds_the_bad_kinds():
    rng = np.random.default_rng(0)
    kind = rng.choice(5, 5000, p=[0.8, 0.05, 0.05, 0.05, 0.05])  # 0 is good, kind k is told by labellers k - 1 and k
    alarm = rng.random((5000, 5)) < 0.02
    told = np.stack([((kind == j + 1) | (kind == j)) & (kind > 0) & (rng.random(5000) < 0.9) for j in range(5)], 1)
    v = np.where(told | alarm, -1, 1).astype(np.int8)
    c, n = np.unique(quality.code(v), return_counts=True)
    m = quality.em(quality.pattern(c, 5), n.astype(float))
    assert toxicity.auc(m.posterior(v), (kind == 0).astype(int)) > 0.97


def brute_lines(rows):
    seen, out = set(), []
    for _, _, text in rows:
        if text is None:
            out.append(None)
            continue
        ls = text.split("\n")
        gone = set()
        for i, x in enumerate(ls):
            wins = [("l", x)] if len(x.split()) >= 8 else []
            keys = [(k, [i]) for k in wins] + ([(("p", x, ls[i + 1]), [i, i + 1])] if i + 1 < len(ls) else [])
            for k, own in keys:
                if k in seen:
                    gone.update(own)
                seen.add(k)
        out.append("\n".join(x for i, x in enumerate(ls) if i not in gone))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    pool = ["a b c", "d", "", "e f g h i j k l m", "n o p q r s t u v w x", "y z", "1 2 3 4 5 6 7 8 9"]
    rows = [(k, k, "\n".join(rng.choice(pool) + rng.choice(["", " " + str(rng.random())]) for _ in range(rng.randint(1, 6)))) for k in range(60)] + [(60, 60, None), (61, 61, "")]
    df = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["text"] for r in lines.deduped(df).collect()}
    assert [got[r[0]] for r in rows] == brute_lines(rows)


def test_nearest_with_bad_rows_ties_and_lengths(spark):
    rng = np.random.default_rng(1)
    v = [(k, rng.standard_normal(5).tolist()) for k in range(300)]
    v += [(400 + k, v[0][1]) for k in range(30)] + [(500, None), (501, [0.0] * 5), (502, [float("nan")] * 5), (503, [1.0, 2.0]), (504, []), (505, [None, 1.0, 1.0, 1.0, 1.0]), (None, [1.0] * 5), (1, v[1][1])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in knn.nearest(df, df.where("vec_id % 100 = 0"), block=64, query_block=2).orderBy("query_id", "rank").collect()]
    fine = {i: np.array(x) for i, x in v if i is not None and x and len(x) == 5 and None not in x and np.isfinite(x).all() and any(x)}
    ref = []
    for q in sorted(i for i in fine if i % 100 == 0):
        d = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(fine[q], fine[c])))), c) for c in fine if c != q)[:10]
        ref += [(q, k + 1, c, s) for k, (s, c) in enumerate(d)]
    assert [g[:3] for g in got] == [r[:3] for r in ref] and np.allclose([g[3] for g in got], [r[3] for r in ref])
    assert knn.nearest(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("scheme", [jaccard.Scheme(), jaccard.SCHEME, jaccard.Scheme(5, 80, 100, ratio=1.6, sub=2)])
def test_jaccard_equals_brute_force(spark, scheme):
    rng = random.Random(4)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 99)) for _ in range(n)] for n in (4, 12, 40, 80, 200)]
    docs = []
    for b in base:
        for _ in range(12):
            w = list(b)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = "x" + str(rng.random())
            docs.append(" ".join(w))
    docs += ["", None, "a", "A", "a b", "a  b"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    n, sets = scheme.n, []
    for t in docs:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    comp = list(range(len(docs)))
    find = lambda i: i if comp[i] == i else find(comp[i])
    for i in range(len(docs)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and scheme.den * k >= scheme.num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link(df, scheme).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in range(len(docs))}
    assert jaccard.link(df.limit(0)).count() == 0


@pytest.mark.parametrize("scheme", [jaccard.Scheme(), jaccard.SCHEME, jaccard.Scheme(5, 80, 100, ratio=1.6)])
def test_jaccard_links_across_bands_and_partitions(spark, scheme):
    low, high, *_ = scheme.bands(3000)
    docs = []
    for b in (k for k in range(len(low) - 1) if 20 < high[k] < 1500):
        small = [f"b{b}w{i}" for i in range(high[b] - 1 + scheme.n - 1)]  # the largest of its partition, below its band's end
        docs += [small, small + [f"b{b}more{i}" for i in range(2)]]  # in the next band
    n = [len(w) - scheme.n + 1 for w in docs]
    assert all(np.searchsorted(high, n[k]) + 1 == np.searchsorted(high, n[k + 1]) and n[k] * scheme.den >= n[k + 1] * scheme.num for k in range(0, len(n), 2)) and len(n) > 4
    for k in range(0, len(docs), 2):
        df = spark.createDataFrame(spark.sparkContext.parallelize([(k, " ".join(docs[k])), (k + 1, " ".join(docs[k + 1]))], 2), "doc_id long, text string")
        sig = [set(scheme.signatures(scheme.sets(d, o))[0].tolist()) for r in df.collect() for d, o in [(np.frombuffer(r["text"].encode(), np.uint8), np.array([0, len(r["text"])]))]]
        assert sig[0] & sig[1]
    both = spark.createDataFrame(spark.sparkContext.parallelize([(k, " ".join(w)) for k, w in enumerate(docs)], len(docs)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.link(both, scheme).collect()}
    assert got == {k: k - k % 2 for k in range(len(docs))}


def test_schedule_is_the_heap_s():
    import heapq

    rng = random.Random(0)
    for _ in range(100):
        k, sizes = rng.randint(1, 7), [(s, rng.choice([1, 2, 5, 40, 200])) for s in rng.sample(range(1, 50), rng.randint(0, 9))]
        heap = [(0, j) for j in range(k)]
        for size, take in sharding.schedule(sizes, k):
            ref = [0] * k
            for _ in range(dict(sizes)[size]):
                at, j = heapq.heappop(heap)
                ref[j] += 1
                heapq.heappush(heap, (at + size, j))
            assert ref == take.tolist()


def test_sharding(spark, sf, edge):
    for df in (table(spark, sf, "documents"), edge):
        rows = df.collect()
        got = sharding.assign(df, 5).collect()
        assert sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in rows) == sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got)
        for s in {r["shard"] for r in got}:
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
        home = collections.defaultdict(set)
        for r in got:
            home[r["text_crc32"], r["size"]].add(r["shard"])
        assert all(len(v) == 1 for (c, n), v in home.items() if n > 8)
    assert sharding.assign(edge.limit(0)).count() == 0


def test_bwt_merge_equals_counts():
    rng = random.Random(3)
    for _ in range(60):
        depth, letters = rng.choice([4, 7, 8, 20]), rng.choice([2, 3, 200])
        texts = [bytes(rng.randrange(letters) for _ in range(rng.randint(depth, 60))) for _ in range(rng.randint(1, 12))]
        starts, weights = [rng.randint(1, len(x) - depth + 1) for x in texts], [rng.choice([1, 1, 2]) for _ in texts]
        c = collections.Counter()
        for x, s, w in zip(texts, starts, weights):
            for i in range(s):
                c[x[i : i + depth]] += w
        for x, s, g in zip(texts, starts, bwt.repeated(texts, starts, weights, depth, rng.choice([1, 50, 10**6]))):
            assert [c[x[i : i + depth]] >= 2 for i in range(s)] == g.tolist()


def brute_repeats(docs, n):
    c = collections.Counter(b[i : i + n] for b in docs for i in range(len(b) - n + 1))
    out = []
    for b in docs:
        m = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if c[b[i : i + n]] > 1:
                m[i : i + n] = b"\1" * n
        kept = bytes(x for x, y in zip(b, m) if not y)
        out.append((len(b), sum(m), sum(1 for i in range(len(m)) if m[i] and (i == 0 or not m[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length,gram,crowd", [(200, 64, 1500), (200, 64, 1), (20, 8, 3)])
def test_suffix_dedup_equals_brute_force(spark, length, gram, crowd):
    rng = random.Random(5)
    base = "".join(rng.choice("abcé ") for _ in range(400))
    noise = lambda n: "".join(rng.choice("xyz") for _ in range(n))
    docs = [None, "", base, base, base[50:300] + "xx", "ab" * 300, "a" * 200, base[:150] + "zz" + base[150:]] + [noise(30) + base[i : i + 230] + noise(30) for i in range(25)]
    df = spark.createDataFrame([(k if k else None, t) for k, t in enumerate(docs)], "doc_id long, text string")
    got = sorted(tuple(r)[1:] for r in repeats.dedup(df, length, gram, crowd).collect())
    assert got == brute_repeats([(t or "").encode() for t in docs], length)


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 300)
    rng = np.random.default_rng(0)
    a = rng.integers(97, 123, 5000).astype(np.uint8)
    whole = list(zip(*repeats.anchors(a, np.array([0, 5000]), 40, 16)))
    parts = []
    for d, o, _, shift in repeats.pieces(a, np.array([0, 5000]), 40):
        s1, s2, at = repeats.anchors(d, o, 40, 16)
        parts += [s for x, y in zip(s1, s2) for s in range(x + shift[0], y + shift[0] + 1)]
    assert sorted(parts) == [s for x, y, _ in whole for s in range(x, y + 1)]


def test_decontamination_edges_and_blocks(spark, sf, edge):
    items = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, None), (None, "one"), (4, "ONE"), (5, "!!!"), (1, "k l")], "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"]) for r in decontam.find(edge, items).collect())
    assert ("None", 12, 12, 1) in got and got.count(("3", 1, 1, 1)) == 2 and ("1", 0, 0, 0) in got
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    one = decontam.find(docs, bench).select(cols).collect()
    two = decontam.find(docs, bench, max_pattern_mb=0).select(cols).collect()  # the way of large benchmarks: in blocks
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and len(one) == docs.count()


def test_decontamination_stage_in_blocks(spark, sf):
    docs = table(spark, sf, "documents")
    one, two = decontam.stage(spark, docs, sf), decontam.stage(spark, docs, sf, max_pattern_mb=0)
    assert two.columns == docs.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_toxicity_held_out(spark, edge):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    m = toxicity.fit(docs, labels)
    ho = docs.join(labels.select("doc_id", "toxic"), "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").select("text", "toxic").toPandas()
    s = m.score(ho["text"].tolist())
    assert toxicity.auc(s, ho["toxic"].to_numpy()) > 0.9
    assert ((s >= 0.5) & (ho["toxic"] == 0)).mean() < 0.04
    got = toxicity.scored(edge, m).collect()
    assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.learn([], []).score(["x"])[0] == 0.0


def test_toxicity_sample_keeps_the_class_ratio(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    ho = docs.join(labels.select("doc_id", "toxic"), "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").select("text", "toxic").toPandas()
    m = toxicity.fit(docs, labels, sample_toxic=200, sample_ordinary=200)  # bound to 1 : 1, the labels are about 1 : 8
    assert abs(m.score(ho["text"].tolist()).mean() - ho["toxic"].mean()) < 0.03


def test_language_held_out(spark, sf, edge):
    docs = table(spark, sf, "documents")
    q = langid.op9_language(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").toPandas()
    assert (q["lang_pred"] == q["lang"]).mean() > 0.95
    got = {str(r["doc_id"]): r for r in langid.predicted(edge, langid.learn(docs)).collect()}
    assert got["1"]["lang_pred"] == got["2"]["lang_pred"] == got["6"]["lang_pred"] == "und"
    assert langid.predicted(edge, langid.learn(docs.limit(0))).count() == len(EDGE)


def test_language_sets_of_more_than_four():
    m = langid.Mixture(list("abcdef"), np.ones((6, 4)), 2)
    lik = np.full((600, 6), 1e-6, np.float32)
    lik[np.arange(600), np.minimum(np.arange(600) // 95, 5)] = 1  # six languages, 95 words each, the last 125
    top, share = m.fit(lik, np.array([600]))
    assert top[0] == 5 and abs(share[0] - 125 / 600) < 0.01


def test_packing_round_trip(spark, sf, edge):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    for df in (table(spark, sf, "documents"), edge):
        rows = df.select("doc_id", "text").collect()
        ref = collections.Counter()
        for r in rows:
            ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]
            for k, a in enumerate(range(0, len(ids), 4096)):
                p = np.array(ids[a : a + 4096], "<u4")
                ref[r["doc_id"], k, a, len(p), zlib.crc32(p.tobytes())] += 1
        got = packing.pack(df).collect()
        assert collections.Counter(tuple(r)[:5] for r in got) == ref
        seqs = collections.defaultdict(list)
        for r in got:
            seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        for v in seqs.values():
            at = 0
            for o, n in sorted(v):
                assert o == at
                at += n
            assert at <= 4096
        assert len(seqs) <= -(-sum(r["length"] for r in got) // 4096) + 2
    assert packing.pack(edge.limit(0)).count() == 0


def test_plan_uses_up_the_counts():
    rng = random.Random(6)
    for _ in range(30):
        cap = rng.choice([10, 64, 300])
        counts = {rng.randint(1, cap): rng.randint(1, 40) for _ in range(rng.randint(0, 30))}
        used = collections.Counter()
        for times, recipe in packing.plan(counts, cap):
            assert sum(recipe) <= cap
            for n in recipe:
                used[n] += times
        assert used == collections.Counter(counts)


def test_pipeline(spark, sf):
    import corpus_pipeline as cp

    docs = table(spark, sf, "documents")
    cur = docs
    for name, stage in cp.STAGES[:-1]:
        nxt = stage(spark, cur, sf).cache()
        assert nxt.columns == docs.columns and nxt.count() <= cur.count(), name
        cur = nxt
    assert not [r for r in decontam.find(cur, table(spark, sf, "benchmark")).collect() if r["contaminated"]]
    assert cp.run(spark, sf).select("doc_id").distinct().count() == cur.select("doc_id").distinct().count()
