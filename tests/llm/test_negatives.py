"""Operator 13 against all products in Python integers."""

import math
import random

import numpy as np
import pytest

from stratagrid.llm import negatives as N


def brute(rows, positives=5, negatives=5, low=80, grain=256, every=100):
    ok = [(i, lab, [math.floor(grain * float(x)) if abs(x) < 2**900 else math.floor(x) * grain for x in v]) for i, lab, v in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    raw = {(i, lab, tuple(v)) for i, lab, v in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in sorted({r[0] for r in raw if r[0] % every == 0}):
        lab, v = min((r[1], r[2]) for r in raw if r[0] == a)
        v = [math.floor(grain * x) for x in v]
        s = [(-sum(p * q for p, q in zip(v, w)), i, own) for i, own, w in ok if i != a and len(w) == len(v)]
        for ps, p, _ in sorted(x for x in s if x[2] == lab)[:positives]:
            fit = sorted((n, i) for n, i, own in s if own != lab and low * -ps <= 100 * -n <= 100 * -ps)[:negatives]
            out += [(a, p, k + 1, i, -ps, -n) for k, (n, i) in enumerate(fit)]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


def frame(spark, rows, parts=3):
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "vec_id long, label int, embedding array<double>")


def mined(spark, rows, every=100, **kw):
    e = frame(spark, rows)
    return got(N.mine(e, e.where(f"vec_id % {every} = 0"), **kw))


def vectors(seed, n, dim=4, labels=3, spread=1.0):
    rng = random.Random(seed)
    return [(i, rng.randrange(labels), [rng.gauss(0.6, spread) for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("seed,kw", [(1, {}), (2, {"slack": 0}), (3, {"lot": 2, "slack": 1}), (4, {"negatives": 12, "positives": 3, "low": 95}), (5, {"low": 0, "grain": 4})])
def test_equals_brute_force(spark, seed, kw):
    """Slack 0 narrows every window to one score and on to single ids."""
    rows = vectors(seed, 260, labels=3, spread=0.4)
    assert mined(spark, rows, 20, **kw) == brute(rows, every=20, **{k: v for k, v in kw.items() if k not in ("slack", "lot")})


def test_ties_of_a_third_of_all_rows(spark):
    rows = vectors(7, 300, spread=0.3) + [(1000 + 7 * i, i % 3, [0.5, 0.5, 0.5, 0.5]) for i in range(700)] + [(-(10**12) + i, 1, [0.5] * 4) for i in range(60)] + [(5000, 0, [0.5] * 4), (2**62, 2, [0.5] * 4), (-(2**62), 2, [0.5] * 4)]
    assert mined(spark, rows, slack=3) == brute(rows)


def test_one_id_in_very_many_rows(spark):
    rows = vectors(8, 50) + [(77, 1, [0.9] * 4)] * 200 + [(100, 0, [0.9] * 4)]
    assert mined(spark, rows, slack=2) == brute(rows)


def test_rows_that_take_no_part_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(9, 60, spread=0.2) + [(None, 1, [1.0] * 4), (200, None, [1.0] * 4), (300, 1, None), (400, 1, []), (500, 1, [1.0, nan, 1.0, 1.0]), (600, 1, [inf] * 4), (700, 1, [1.0, None, 1.0, 1.0])]
    rows += [(800, 1, [0.7] * 3), (801, 1, [0.7] * 3), (802, 2, [0.69] * 3)]  # another length
    rows += [(900, 2, [0.6] * 4), (900, 1, [0.6] * 4), (900, 1, [0.6] * 4), (55, 2, [0.5] * 4)]
    want = brute(rows)
    assert mined(spark, rows) == want and {a for a, *_ in want} >= {0, 800, 900}


def test_products_beyond_doubles_and_long(spark):
    rows = [(i, i % 2, [float(2**20 + i), float(-(2**19)), 3.5 * i]) for i in range(120)]
    assert mined(spark, rows) == brute(rows)
    assert N.whole(np.array([[2.0**60, -0.001]]), 256).tolist() == [[2**68, -1]]
    assert N.products(np.array([[2**40, 1]]), np.array([[2**40, 1]])).tolist() == [[2**80 + 1]]
    with pytest.raises(Exception):
        mined(spark, [(0, 1, [1e300]), (1, 1, [1e300])])  # its score doesn't fit


def test_empty_and_clashing_names(spark):
    e = frame(spark, []).selectExpr("*", "1 AS id", "2 AS w", "3 AS lot", "4 AS v")
    assert N.mine(e, e).count() == 0
    rows = vectors(11, 120, spread=0.2)
    e = frame(spark, rows).selectExpr("*", "1 AS id", "2 AS w", "3 AS lot", "4 AS v", "5 AS score", "6 AS a")
    assert got(N.mine(e, e.where("vec_id % 100 = 0"))) == brute(rows)


def test_a_pass_counts_only_the_open_bucket():
    rows = [{"a": 0, "id": 1, "score": 1000}]
    w = N.Windows(rows, 80, 0, 99)
    assert w.width[0] == 200 and w.shift[0] == 3
    counts = np.zeros(N.WIDTH, np.int64)
    counts[2], counts[4] = 3, 90
    w.narrow(0, counts, 5, 10)
    assert (w.base[0], w.shift[0], w.span[0], w.above[0], bool(w.open[0])) == (32, 0, 8, 3, True)
    counts[:] = 0
    counts[1] = 90
    w.narrow(0, counts, 5, 10)
    assert w.tie[0] == 33 and w.shift[0] == 2  # the score is spent: digits of the id
    w.narrow(0, np.full(N.WIDTH, 1, np.int64), 5, 10)
    assert not w.open[0]


def test_table_against_sql(spark, duck, sf):
    want = sorted(duck.execute(N.SQL).df()[["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]].itertuples(index=False, name=None))
    assert got(N.op13_hard_negatives(spark, sf)) == want
