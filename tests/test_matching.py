"""Registration by features: known warps, outliers, brute-force nearest descriptors."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratagrid.operators import matching as MT
from stratagrid.operators import stencil as S


def scene(height, width, seed=3):
    rng = np.random.default_rng(seed)
    a = rng.random((height, width))
    a = S.kernel_gaussian(1.3)(a)
    return (a - a.min()) / (a.max() - a.min())


def warped(a, h):
    """The image whose place p shows what ``a`` has at h(p)."""
    y, x = np.mgrid[: a.shape[0], : a.shape[1]].astype(float)
    w = h[6] * x + h[7] * y + h[8]
    u, v = np.clip((h[0] * x + h[1] * y + h[2]) / w, 0, a.shape[1] - 1.001), np.clip((h[3] * x + h[4] * y + h[5]) / w, 0, a.shape[0] - 1.001)
    i, j = v.astype(int), u.astype(int)
    fy, fx = v - i, u - j
    return (a[i, j] * (1 - fx) + a[i, j + 1] * fx) * (1 - fy) + (a[i + 1, j] * (1 - fx) + a[i + 1, j + 1] * fx) * fy


def long(spark, frames):
    rows = []
    for f, a in frames.items():
        y, x = np.mgrid[: a.shape[0], : a.shape[1]]
        rows.append(pd.DataFrame({"stack": 0, "frame": f, "y": y.ravel(), "x": x.ravel(), "v": a.ravel()}))
    return spark.createDataFrame(pd.concat(rows)).select(*[F.col(c).cast("int").alias(c) for c in ("stack", "frame", "y", "x")], "v")


def test_rotation_scale_and_perspective_are_found(spark):
    h, w = 72, 90
    c, s = np.cos(0.05), np.sin(0.05)
    turns = {1: [c, -s, 3.0, s, c, -2.0, 0, 0, 1], 2: [1.03, 0.02, -2.5, -0.01, 0.98, 1.5, 2e-4, -1e-4, 1]}
    a = scene(h, w)
    px = long(spark, {0: a, **{k: warped(a, t) for k, t in turns.items()}, 3: np.full((h, w), 0.5)})
    pairs = spark.createDataFrame([(0, 0, k) for k in (1, 2, 3)], "stack int, frame int, other int")
    got = {r["other"]: r["h"] for r in MT.register_features(px, pairs, h, w).collect()}
    assert set(got) == {1, 2}  # a frame without corners loses its pair
    for k, t in turns.items():
        # frame k shows at p what the fixed frame has at t(p), so fixed -> moving is the inverse of t
        m = np.linalg.inv(np.array(t).reshape(3, 3))
        for x, y in ((10, 10), (80, 10), (10, 60), (80, 60)):
            want, own = m @ [x, y, 1], np.array(got[k]).reshape(3, 3) @ [x, y, 1]
            assert np.hypot(*(want[:2] / want[2] - own[:2] / own[2])) < 0.5


def test_consensus_leaves_outliers_out(spark):
    rng = np.random.default_rng(1)
    h = np.array([1.02, 0.03, 5, -0.02, 0.97, -4, 1e-4, 5e-5, 1])
    rows = []
    for pair, bad in ((0, 0.0), (1, 0.6)):
        for i, (x, y) in enumerate(rng.uniform(0, 200, (120, 2))):
            d = h[6] * x + h[7] * y + 1
            u, v = (h[0] * x + h[1] * y + h[2]) / d, (h[3] * x + h[4] * y + h[5]) / d
            if rng.random() < bad:
                u, v = rng.uniform(0, 200, 2)
            rows.append((0, 0, pair + 1, i, float(y), float(x), float(v), float(u)))
    rows += [(0, 0, 9, i, float(i), 0.0, float(i), 0.0) for i in range(3)]  # too few
    rows += [(0, 0, 8, i, float(i), float(i), float(i), float(i)) for i in range(30)]  # all on a line
    m = spark.createDataFrame(rows, "stack int, frame int, other int, id int, my double, mx double, fy double, fx double")
    got = {r["other"]: r for r in MT.consensus(m, 300).collect()}
    assert set(got) == {1, 2} and got[1]["n"] == 120 and 40 <= got[2]["n"] < 60
    assert np.allclose(got[1]["h"], h, atol=1e-6) and np.allclose(np.array(got[2]["h"])[[0, 1, 3, 4]], h[[0, 1, 3, 4]], atol=0.05)


@pytest.mark.parametrize("count", [2, 40, 600])
def test_two_nearest_equal_brute_force(spark, count):
    rng = np.random.default_rng(count)
    f, m = rng.normal(size=(count, 6)), rng.normal(size=(30, 6))
    f[1] = f[0]  # equals: the smaller id
    rows = lambda a: spark.createDataFrame([(0, 0, 1, i, [float(v) for v in r]) for i, r in enumerate(a)], "stack int, frame int, other int, id int, desc array<double>")
    got = {r["id"]: r for r in MT.two_nearest(rows(m), rows(f)).collect()}
    for i, v in enumerate(m):
        d = np.sqrt(((f - v) ** 2).sum(1))
        assert got[i]["nearest"] == int(d.argmin()) and np.allclose([got[i]["d1"], got[i]["d2"]], np.sort(d)[:2])
    assert MT.two_nearest(rows(m), rows(f[:1])).count() == 0 and MT.two_nearest(rows(m).where("false"), rows(f)).count() == 0
    passed = {r["id"] for r in MT.ratio_matches(MT.two_nearest(rows(m), rows(f))).collect()}
    assert passed == {i for i, r in got.items() if r["d1"] < 0.75 * r["d2"]}


def test_a_turning_stack_is_registered(spark):
    """Frames turned by 2 degrees each, one of them blank: the others chain to the middle survivor, the blank one has an issue."""
    from stratagrid.operators import registration as R

    h, w = 64, 80
    a = scene(h, w, 5)
    turn = lambda k: [np.cos(k), -np.sin(k), 2.0 * k, np.sin(k), np.cos(k), -k, 0, 0, 1]
    px = long(spark, {0: a, 1: warped(a, turn(0.035)), 2: warped(a, turn(0.07)), 3: np.full((h, w), float(a.mean()))})
    frames, issues = R.register_stacks(px, h, w, features=True)
    got = {r["frame"]: np.array(r["h"]).reshape(3, 3) for r in frames.collect()}
    assert {r["frame"] for r in issues.collect()} == {3}
    # from frame 0 to the middle survivor, frame 1
    want = np.linalg.inv(np.array(turn(0.035)).reshape(3, 3))
    for x, y in ((15, 15), (65, 15), (15, 50), (65, 50)):
        p, q = want @ [x, y, 1], got[0] @ [x, y, 1]
        assert np.hypot(*(p[:2] / p[2] - q[:2] / q[2])) < 0.7
    assert np.allclose(got[1], np.eye(3), atol=1e-9)
