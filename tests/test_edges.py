"""Edge rows: ties, zeros, NaN, coverage, flat depth, empty input; kernels, files, projects, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagrid.functions import pixel as P
from stratagrid.operators import aggregate as A
from stratagrid.operators import components as C
from stratagrid.operators import edits as E
from stratagrid.operators import registration as R
from stratagrid.operators import window as W
from stratagrid.sources import project, raster, synth
from stratagrid.streaming import winner as live

PX = "stack int, frame int, y int, x int, v double"


def test_winner_ties_zero_nan(spark):
    nan = float("nan")
    rows = [(0, f, 0, 0, 0.0) for f in range(4)] + [(0, f, 0, 1, e) for f, e in enumerate((5.0, 1.0, 2.0, 5.0))] + [(0, f, 0, 2, e) for f, e in enumerate((nan, 1.0, nan, 0.5))] + [(0, 0, 0, 3, -1.0)]
    df = spark.createDataFrame(rows, PX)
    got = {r["x"]: (r["frame"], r["energy"]) for r in A.winner(df, "v").collect()}
    assert got == {0: (0, 0.0), 1: (0, 5.0), 2: (1, 1.0), 3: (0, 0.0)}
    two = {r["x"]: r["frame"] for r in A.winner_two_step(df, "v").collect()}
    assert two == {0: 0, 1: 0, 2: 1, 3: 0}
    assert A.winner(df.limit(0), "v").count() == 0


def test_uncovered_pixel_is_black(spark):
    px = spark.createDataFrame([(0, 0, 0, 0, 0.5, 0.5, 0.5, 0.0)], "stack int, frame int, y int, x int, r double, g double, b double, a double")
    d = spark.createDataFrame([(0, 0, 0, 0.0)], "stack int, y int, x int, d double")
    assert [tuple(r) for r in A.tent_render(px, d, 1.0).collect()] == [(0, 0, 0, 0.0, 0.0, 0.0)]


def test_short_curves_are_concentrated(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 1.0), (0, 1, 0, 0, 2.0)], PX)
    assert A.curve_stats(df).first()["concentration"] == 1.0


def test_gap_of_exactly_the_limit_does_not_split(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [(1, k, t + dt.timedelta(seconds=s)) for k, s in enumerate((0, 10, 20.5))] + [(2, 0, None), (2, 1, t), (2, 2, t + dt.timedelta(days=1))]
    got = {(r["folder"], r["name"]): r["session"] for r in W.split_by_gap(spark.createDataFrame(rows, "folder int, name int, ts timestamp_ntz")).collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 1, (2, 0): 0, (2, 1): 0, (2, 2): 0}


def test_matrix_and_chain():
    h = P.similarity(1.02, 0.1, 3, -2, 10, 5)
    assert np.allclose(P.mat_mul(h, P.mat_inverse(h)), np.eye(3).ravel())
    t = [[1.0, 0, dx, 0, 1.0, 0, 0, 0, 1.0] for dx in (1, 2, 3)]
    assert [m[2] for m in W.chain(t, 1)] == [-1, 0, 2, 5]
    with pytest.raises(ValueError):
        P.mat_inverse([0.0] * 9)


def test_push_pull_fills_from_one_cell():
    vw, w = np.zeros((5, 7)), np.zeros((5, 7))
    vw[2, 3], w[2, 3] = 4.0, 1.0
    assert np.allclose(C.fill(vw, w), 4.0, atol=1e-6)
    assert (C.fill(np.zeros((3, 3)), np.zeros((3, 3))) == 0).all()


def test_phase_correlation_finds_the_shift():
    rng = np.random.default_rng(1)
    a = rng.random((64, 64))
    dy, dx = R.shift_of(a, np.roll(a, (3, -5), (0, 1)))
    assert round(dy) == 3 and round(dx) == -5


def test_strict_refuses_issues(spark):
    f = spark.createDataFrame([(0, 0)], "stack int, frame int")
    assert R.strict(f, f.limit(0)).count() == 1
    with pytest.raises(ValueError):
        R.strict(f, f)


def test_stroke_carries_over_joints(spark):
    pts = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 0.0, 1.5), (0, 2, 0.0, 4.0)], "stroke int, k int, y double, x double")
    assert sorted(r["x"] for r in E.stroke(pts, 3.0).collect()) == pytest.approx([0.0, 1.0, 2.0, 3.0, 4.0])


def test_undo_and_replay(spark):
    img = spark.createDataFrame([(0, 0, 0, 1.0)], "stack int, y int, x int, v double")
    log = spark.createDataFrame([(1, False, 0, 0, 0, 2.0), (2, False, 0, 0, 0, 3.0)], "edit int, undone boolean, stack int, y int, x int, v double")
    assert E.replay(img, log).first()["v"] == 3.0
    assert E.replay(img, E.undo(log)).first()["v"] == 2.0


def test_raster_files_round_trip(spark, tmp_path):
    a = np.random.default_rng(0).random((5, 4, 3))
    for ext in ("ppm", "tif"):
        b = raster.decode(raster.ENCODERS[ext](a))
        assert np.abs(b[..., :3] - a).max() < 1e-4 and (b[..., 3] == 1).all()
    assert raster.encode_png(a)[:4] == b"\x89PNG"
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "a.ppm").write_bytes(raster.encode_pnm(a))
    (tmp_path / "s1" / "b.tif").write_bytes(raster.encode_tiff(a, 8))
    raster.register(spark)
    meta = spark.read.format("stack_frames").option("path", str(tmp_path)).load()
    assert {(r["width"], r["height"], r["bits"]) for r in meta.collect()} == {(4, 5, 16), (4, 5, 8)}
    assert spark.read.format("stack_px").option("path", str(tmp_path)).option("reduce", "2").load().count() == 12
    assert raster.binary_pixels(spark, str(tmp_path)).count() == 40
    assert raster.folders(spark, str(tmp_path)).count() == 2


def test_project_round_trip(spark, tmp_path):
    img = spark.createDataFrame([(0, 0, 0, 0.25, 0.5, 1.0)], "stack int, y int, x int, r double, g double, b double")
    dep = spark.createDataFrame([(0, 0, 0, 3.5)], "stack int, y int, x int, d double")
    project.save(spark, str(tmp_path / "p"), img, dep, {"radius": 1})
    m, i, d = project.load(spark, str(tmp_path / "p"))
    assert m["settings"] == {"radius": 1} and d.first()["d"] == 3.5 and abs(i.first()["r"] - 0.25) < 1e-4
    assert 'crs:Exposure2012="+0.50"' in project.xmp(P.Tone(exposure=0.5))


def test_fuse_recovers_the_scene(spark):
    from stratagrid.operators import dmap

    s = {0: synth.Synth(frames=7, height=32, width=48, blur=4.0)}
    px = synth.pixels(spark, s).cache()
    image, _ = dmap.fuse(px, 32, 48, regularize=False)
    good = A.psnr(image, synth.truth(spark, s), 3, 32, 48).first()["psnr"]
    mean = px.groupBy("stack", "y", "x").agg(*[F.avg(c).alias(c) for c in "rgb"])
    assert good > A.psnr(mean, synth.truth(spark, s), 3, 32, 48).first()["psnr"] + 3


def test_stream_equals_batch_with_late_frames(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(0, f, 0, x, float((f * 7 + x * 3) % 5), float(f)) for f in range(6) for x in range(3)]
    schema = "stack int, frame int, y int, x int, e double, v double"
    for part in ((4, 5), (0, 1), (2, 3)):
        spark.createDataFrame([r for r in rows if r[1] in part], schema).coalesce(1).write.mode("append").parquet(str(src))
    q = live.start(live.running(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))), "live", str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    got = sorted((r["x"], r["frame"], r["energy"]) for r in spark.table("live").collect())
    ref = sorted((r["x"], r["frame"], r["energy"]) for r in A.winner(spark.createDataFrame(rows, schema), "e").collect())
    assert got == ref


def test_order_statistics_of_groups_of_any_size(spark):
    from stratagrid.operators import aggregate as A

    rng = np.random.default_rng(0)
    groups = {}
    for n in (1, 2, 3, 64, 999, 4999, 5000, 5001, 30000):
        v = np.round(rng.standard_normal(n), 3)
        v[rng.random(n) < 0.3] = 0.0
        groups[n] = v
    df = spark.createDataFrame([(n, float(x)) for n, v in groups.items() for x in v] + [(1, None)], "stack int, v double").repartition(5)
    for p in (0.02, 0.5, 0.95, 0.98):
        for how in ("count", "gap"):
            got = {r["stack"]: r["q"] for r in A.order_statistic(df, "v", p, ["stack"], how).collect()}
            assert got == {n: np.sort(v)[min(int(n * p), n - 1) if how == "count" else int((n - 1) * p)] for n, v in groups.items()}


def test_a_second_save_replaces_the_first(spark, tmp_path):
    from stratagrid.sources import project

    img = lambda v: spark.createDataFrame([(0, 0, 0, v, v, v)], "stack int, y int, x int, r double, g double, b double")
    dep = spark.createDataFrame([(0, 0, 0, 1.0)], "stack int, y int, x int, d double")
    for v in (0.25, 0.5):
        project.save(spark, str(tmp_path / "p"), img(v), dep, {"v": v})
    m, i, _ = project.load(spark, str(tmp_path / "p"))
    assert m["settings"] == {"v": 0.5} and abs(i.first()["r"] - 0.5) < 1e-4


def test_registration_names_sabotaged_frames(spark):
    from stratagrid.plans import catalog

    got = {r["frame"]: r for r in catalog.queries()["r2_registration"](spark, "").collect()}
    assert {k: r["kind"] for k, r in got.items() if r["kind"]} == {2: "exposureOutlier", 7: "misaligned"}
    p = synth.frame_params(synth.Synth(frames=11, height=48, width=64, jitter=2.0, blur=2.0)).set_index("frame")
    for k in (0, 1, 2, 3, 4, 5, 6, 8, 9, 10):
        assert abs(got[k]["tx"] - p["jx"][k]) < 0.4 and abs(got[k]["ty"] - p["jy"][k]) < 0.4


def test_tiles_equal_the_long_form(spark):
    from stratagrid.operators import stencil as S
    from stratagrid.operators import tiles as T

    s = {0: synth.Synth(frames=5, height=37, width=50, blur=3.0)}
    got = T.pixels(T.fuse_tiles(synth.tiles(spark, s, 16), 37, 50, 16)).toPandas().sort_values(["y", "x"])
    px = synth.pixels(spark, s)
    e = S.laplacian_energy(px.withColumn("v", P.luminance(F.col("r"), F.col("g"), F.col("b"))))
    depth = A.winner(e, "e").select("stack", "y", "x", F.col("frame").cast("double").alias("d"))
    ref = A.tent_render(px, depth, 1.0).join(depth, ["stack", "y", "x"]).toPandas().sort_values(["y", "x"])
    same = got["d"].to_numpy() == ref["d"].to_numpy()
    assert len(got) == 37 * 50 and same.mean() > 0.999  # 32-bit energies may tie otherwise
    assert all(np.allclose(got[c].to_numpy()[same], ref[c].to_numpy()[same], atol=1e-4) for c in "rgb")


def test_rasters_of_more_kinds(spark, tmp_path):
    import struct
    import zlib

    rng = np.random.default_rng(0)
    img = rng.random((7, 9, 3))
    for bits in (8, 16):
        assert np.allclose(raster.decode(raster.encode_png(img, bits))[..., :3], img, atol=1 / 255)
    # every PNG filter, by hand
    v = (img * 255 + 0.5).astype(np.uint8)
    rows, prev = [], np.zeros((9, 3), int)
    for y in range(7):
        cur = v[y].astype(int)
        left, corner = np.vstack([np.zeros((1, 3), int), cur[:-1]]), np.vstack([np.zeros((1, 3), int), prev[:-1]])
        p = left + prev - corner
        pa, pb, pc = abs(p - left), abs(p - prev), abs(p - corner)
        guess = [0 * cur, left, prev, (left + prev) // 2, np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, prev, corner))][y % 5]
        rows.append(bytes([y % 5]) + ((cur - guess) % 256).astype(np.uint8).tobytes())
        prev = cur
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 7, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
    assert (raster.decode(png)[..., :3] * 255 + 0.5).astype(int).tolist() == v.tolist()
    # deflated TIFF with horizontal differences and a date
    d = v.astype(int)
    d[:, 1:] -= v[:, :-1].astype(int)
    body, date = zlib.compress((d % 256).astype(np.uint8).tobytes()), b"2024:05:06 07:08:09\0"
    tags = [(256, 4, 1, 9), (257, 4, 1, 7), (258, 3, 1, 8), (259, 3, 1, 8), (273, 4, 1, 8 + 2 + 12 * 9 + 4 + 20), (277, 3, 1, 3), (279, 4, 1, len(body)), (306, 2, 20, 8 + 2 + 12 * 9 + 4), (317, 3, 1, 2)]
    ifd = struct.pack("<H", 9) + b"".join(struct.pack("<HHI", t, k, n) + (struct.pack("<HH", x, 0) if k == 3 else struct.pack("<I", x)) for t, k, n, x in tags) + bytes(4)
    (tmp_path / "a.tif").write_bytes(b"II*\0" + struct.pack("<I", 8) + ifd + date + body)
    (tmp_path / "b.png").write_bytes(png)
    raster.register(spark)
    meta = {r["name"]: r for r in spark.read.format("stack_frames").option("path", str(tmp_path)).load().collect()}
    assert meta["a.tif"]["captured_at"] == "2024:05:06 07:08:09" and (meta["b.png"]["width"], meta["b.png"]["height"]) == (9, 7)
    px = spark.read.format("stack_px").option("path", str(tmp_path)).load().toPandas()
    for name in ("a.tif", "b.png"):
        got = px[px["path"].str.endswith(name)].sort_values(["y", "x"])
        assert (got[["r", "g", "b"]].to_numpy() * 255 + 0.5).astype(int).tolist() == v.reshape(-1, 3).tolist()
