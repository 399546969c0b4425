"""Two-dimensional neighbourhoods: long form (the definition, checked by SQL) and tile kernels (the scale path).

Convolutions repeat the edge pixel; box means are clipped; the Sobel border is 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pixel as P
from .aggregate import box_down
from .join import gather

PLANE = ("stack", "frame")


def _line(key: tuple[str, ...], along: str):
    across = "x" if along == "y" else "y"
    return W.partitionBy(*key, across).orderBy(along)


def shifted(value: str | Column, k: int, key: tuple[str, ...], along: str, radius: int | None = None) -> Column:
    """The value ``k`` places on along an axis of a dense raster, the edge's beyond it."""
    w = _line(key, along)
    c = F.col(value) if isinstance(value, str) else value
    if k == 0:
        return c
    moved = F.lead(c, k).over(w) if k > 0 else F.lag(c, -k).over(w)
    full = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return F.coalesce(moved, F.last(c).over(full) if k > 0 else F.first(c).over(full))


def convolve(df: DataFrame, kernel: list[float], along: str, value: str = "v", key: tuple[str, ...] = PLANE) -> DataFrame:
    r = len(kernel) // 2
    total = sum((shifted(value, i - r, key, along) * w for i, w in enumerate(kernel)), F.lit(0.0))
    return df.withColumn("_c", total).withColumn(value, F.col("_c")).drop("_c")


def gaussian(df: DataFrame, sigma: float, value: str = "v", key: tuple[str, ...] = PLANE) -> DataFrame:
    """Separable blur; nothing below sigma 0.01."""
    if sigma <= 0.01:
        return df
    k = P.gaussian_kernel(sigma)
    return convolve(convolve(df, k, "x", value, key), k, "y", value, key)


def laplacian_energy(df: DataFrame, value: str = "v", key: tuple[str, ...] = PLANE, out: str = "e") -> DataFrame:
    """Squared 4-neighbour Laplacian."""
    s = sum((shifted(value, k, key, a) for a in ("x", "y") for k in (-1, 1)), F.lit(0.0)) - F.col(value) * 4
    return df.withColumn("_l", s).withColumn(out, F.col("_l") * F.col("_l")).drop("_l")


def half(df: DataFrame, height: int, width: int, value: str = "v", key: tuple[str, ...] = PLANE) -> DataFrame:
    """2 x 2 means; an odd last row or column is left out."""
    d = df.where((F.col("y") < height // 2 * 2) & (F.col("x") < width // 2 * 2))
    return box_down(d, 2, value, extra=key)


def resize(df: DataFrame, height: int, width: int, to_h: int, to_w: int, value: str = "v", key: tuple[str, ...] = PLANE) -> DataFrame:
    """Bilinear about pixel centres, edge-clamped."""
    keys = df.select(*key).distinct()
    at = keys.select(*key, F.explode(F.sequence(F.lit(0), F.lit(to_h - 1))).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(to_w - 1))))
    at = at.withColumn("_py", (F.col("y") + 0.5) * (height / to_h) - 0.5).withColumn("_px", (F.col("x") + 0.5) * (width / to_w) - 0.5)
    return gather(at, df, "_py", "_px", height, width, value, key, value).drop("_py", "_px")


def energy_grid(df: DataFrame, height: int, width: int, sigma: float, value: str = "e", key: tuple[str, ...] = PLANE) -> DataFrame:
    """Energy blurred on a quarter grid (box by 4, blur by sigma / 4, back up) once sigma is 4 or more, else directly."""
    if sigma < 4:
        return gaussian(df, sigma, value, key)
    small = gaussian(box_down(df, 4, value, extra=key), sigma / 4, value, key)
    return resize(small, -(-height // 4), -(-width // 4), height, width, value, key)


def sobel(df: DataFrame, height: int, width: int, value: str = "v", key: tuple[str, ...] = PLANE, out: str = "g") -> DataFrame:
    """L1 gradient magnitude, 0 on the border."""
    sm = lambda a: shifted(value, -1, key, a) + F.col(value) * 2 + shifted(value, 1, key, a)
    d = df.withColumn("_sy", sm("y")).withColumn("_sx", sm("x"))
    gx = shifted("_sy", 1, key, "x") - shifted("_sy", -1, key, "x")
    gy = shifted("_sx", 1, key, "y") - shifted("_sx", -1, key, "y")
    rim = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == height - 1) | (F.col("x") == width - 1)
    return d.withColumn(out, F.when(rim, F.lit(0.0)).otherwise(F.abs(gx) + F.abs(gy))).drop("_sx", "_sy")


def rescale_box(df: DataFrame, height: int, width: int, to_h: int, to_w: int, value: str = "v", key: tuple[str, ...] = PLANE) -> DataFrame:
    """Box mean onto a smaller raster of any ratio."""
    ty, tx = F.floor(F.col("y") * to_h / height).cast("int"), F.floor(F.col("x") * to_w / width).cast("int")
    return df.groupBy(*key, ty.alias("y"), tx.alias("x")).agg(F.avg(value).alias(value))


def dilate(df: DataFrame, radius: int, mask: str = "m", key: tuple[str, ...] = ("stack",)) -> DataFrame:
    """Square dilation, clipped at the edges."""
    for along in ("x", "y"):
        df = df.withColumn("_m", F.max(mask).over(_line(key, along).rowsBetween(-radius, radius))).withColumn(mask, F.col("_m")).drop("_m")
    return df


def erode(df: DataFrame, radius: int, mask: str = "m", key: tuple[str, ...] = ("stack",)) -> DataFrame:
    d = dilate(df.withColumn(mask, ~F.col(mask)), radius, mask, key)
    return d.withColumn(mask, ~F.col(mask))


def smooth3(df: DataFrame, value: str = "v", key: tuple[str, ...] = ("stack",)) -> DataFrame:
    """3 x 3 clipped box mean."""
    from .window import box_mean

    return box_mean(df, 1, value, key, "_o").withColumn(value, F.col("_o")).drop("_o")


# The pyramid's five taps.
BURT = [1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16]


def decimate(df: DataFrame, value: str = "v", key: tuple[str, ...] = PLANE) -> DataFrame:
    """Five-tap blur, every second sample; (n + 1) div 2 of them."""
    d = convolve(convolve(df, BURT, "x", value, key), BURT, "y", value, key)
    d = d.where((F.col("y") % 2 == 0) & (F.col("x") % 2 == 0))
    return d.withColumn("y", F.floor(F.col("y") / 2).cast("int")).withColumn("x", F.floor(F.col("x") / 2).cast("int"))


def expand(df: DataFrame, height: int, width: int, value: str = "v", key: tuple[str, ...] = PLANE) -> DataFrame:
    """To twice the raster (of the given size): even places 1/8, 6/8, 1/8, odd ones 1/2, 1/2; edge-clamped."""
    for along, size in (("x", width), ("y", height)):
        even = shifted(value, -1, key, along) / 8 + F.col(value) * 0.75 + shifted(value, 1, key, along) / 8
        odd = (F.col(value) + shifted(value, 1, key, along)) / 2
        d = df.withColumn("_e", even).withColumn("_o", odd)
        two = F.explode(F.array(F.struct((F.col(along) * 2).alias("p"), F.col("_e").alias("q")), F.struct((F.col(along) * 2 + 1).alias("p"), F.col("_o").alias("q"))))
        df = d.withColumn("_t", two).withColumn(along, F.col("_t.p").cast("int")).withColumn(value, F.col("_t.q")).drop("_e", "_o", "_t").where(F.col(along) < size)
    return df


def pyramid(df: DataFrame, height: int, width: int, levels: int, value: str = "v", key: tuple[str, ...] = PLANE) -> list[tuple[DataFrame, int, int]]:
    """Laplacian bands, finest first, and the base last, each with its raster's size."""
    out, cur = [], df.select(*key, "y", "x", value)
    for _ in range(levels):
        low = decimate(cur, value, key)
        h2, w2 = (height + 1) // 2, (width + 1) // 2
        up = expand(low, height, width, value, key).withColumnRenamed(value, "_u")
        band = cur.join(up, [*key, "y", "x"]).withColumn(value, F.col(value) - F.col("_u")).drop("_u")
        out.append((band, height, width))
        cur, height, width = low, h2, w2
    out.append((cur, height, width))
    return out


def collapse(bands: list[tuple[DataFrame, int, int]], value: str = "v", key: tuple[str, ...] = PLANE) -> DataFrame:
    cur = bands[-1][0]
    for band, h, w in reversed(bands[:-1]):
        up = expand(cur, h, w, value, key).withColumnRenamed(value, "_u")
        cur = band.join(up, [*key, "y", "x"]).withColumn(value, F.col(value) + F.col("_u")).drop("_u")
    return cur


def parallax(image: DataFrame, depth: DataFrame, height: int, width: int, shift: float, value: str = "v") -> DataFrame:
    """Sideways view: each pixel gathers from x + shift * disparity, the disparity being the depth between its
    2nd and 98th percentile on -0.5..0.5 (0 where that span is at most 0.001)."""
    from .aggregate import order_statistic

    lo = order_statistic(depth, "d", 0.02, ["stack"], "gap").withColumnRenamed("q", "_lo")
    hi = order_statistic(depth, "d", 0.98, ["stack"], "gap").withColumnRenamed("q", "_hi")
    d = depth.join(lo.join(hi, "stack"), "stack")
    span = F.col("_hi") - F.col("_lo")
    disp = F.when(span > 1e-3, P.clamp((F.col("d") - F.col("_lo")) / F.when(span > 1e-3, span)) - 0.5).otherwise(F.lit(0.0))
    at = d.select("stack", "y", "x", F.col("y").cast("double").alias("_py"), (F.col("x") + disp * shift).alias("_px"))
    return gather(at, image, "_py", "_px", height, width, value, ("stack",), value).drop("_py", "_px")


# -- tile form -----------------------------------------------------------------------------------------------

#: Least side of the blocks that tiles are cut from, and most pixels that a kernel gets at once.
CUT, AT_ONCE = 32, 1 << 20


def cut_tiles(df: DataFrame, key: tuple[str, ...], tile: int, halo: int, height: int, width: int, values: tuple[str, ...], dtype: str = "<f8") -> DataFrame:
    """``key``, ty, tx, y0, x0, h, w and px: tiles with a halo of neighbours (edge tiles end at the raster), planes one after another.

    Pixels meet in blocks of whole tiles and their halo, a list each, so one goes to more than one block only near the rim of a block;
    a batch of blocks is cut at once. A block is bounded by (max(tile, CUT) + tile + 2 halo) ** 2."""
    n = max(1, CUT // tile)
    size = n * tile

    def span(c: str, length: int) -> Column:
        lo = F.greatest(F.floor((F.col(c) - halo) / size), F.lit(0)).cast("int")
        return F.sequence(lo, F.least(F.floor((F.col(c) + halo) / size), F.lit((length - 1) // size)).cast("int"))

    cols = [F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(values)]
    e = df.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).select(*[F.col(k).cast("int").alias(k) for k in key], "y", "x", *cols)
    e = e.withColumn("_by", F.explode(span("y", height))).withColumn("_bx", F.explode(span("x", width)))
    side = size + 2 * halo
    place = ((F.col("y") - F.col("_by") * size + halo) * side + F.col("x") - F.col("_bx") * size + halo).cast("int")
    g = e.groupBy(*key, "_by", "_bx").agg(F.collect_list(F.struct(place.alias("p"), *[f"_v{i}" for i in range(len(values))])).alias("_px"))
    names = [*key, "ty", "tx", "y0", "x0", "h", "w"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, AT_ONCE // (side * side))
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                px = batch["_px"]
                row = np.repeat(np.arange(len(px)), px.value_lengths().to_numpy())
                p, *vs = px.flatten().flatten()
                a = np.zeros((len(px), len(vs), side * side), dtype)
                for i, v in enumerate(vs):
                    a[row, i, p.to_numpy()] = v.to_numpy(zero_copy_only=False)  # null becomes NaN
                a = a.reshape(len(px), len(vs), side, side)
                by, bx = batch["_by"].to_numpy(), batch["_bx"].to_numpy()
                keys = [batch[k].to_numpy() for k in key]
                for cy, cx in np.unique(np.stack([by, bx], 1), axis=0).tolist():
                    at = np.flatnonzero((by == cy) & (bx == cx))
                    for ty in range(cy * n, min((cy + 1) * n, -(-height // tile))):
                        for tx in range(cx * n, min((cx + 1) * n, -(-width // tile))):
                            y0, x0 = max(0, ty * tile - halo), max(0, tx * tile - halo)
                            h, w = min(height, (ty + 1) * tile + halo) - y0, min(width, (tx + 1) * tile + halo) - x0
                            oy, ox = y0 - cy * size + halo, x0 - cx * size + halo
                            part = np.ascontiguousarray(a[at, :, oy : oy + h, ox : ox + w])
                            packed = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * (part.nbytes // len(at))).astype("<i4")), pa.py_buffer(part)])
                            ints = [*[k[at] for k in keys], *[np.full(len(at), c, np.int32) for c in (ty, tx, y0, x0, h, w)]]
                            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in ints], packed], names=[*names, "px"])

    return g.mapInArrow(run, ", ".join(f"{c} int" for c in names) + ", px binary")


def to_tiles(df: DataFrame, tile: int, halo: int, height: int, width: int, value: str = "v") -> DataFrame:
    """Tiles of float64 with a halo of neighbours (:func:`cut_tiles`)."""
    return cut_tiles(df, PLANE, tile, halo, height, width, (value,))


def map_tiles(tiles: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], tile: int, value: str = "v") -> DataFrame:
    """Long form of the kernel's result inside each tile (its halo is dropped). The kernel pads by repeating the edge and works on the
    last two axes: it gets all tiles of a batch that have one place at once."""
    where = ["ty", "tx", "y0", "x0", "h", "w"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.stack([batch[c].to_numpy() for c in where], 1) if batch.num_rows else np.empty((0, 6), np.int32)
            places, which = np.unique(at, axis=0, return_inverse=True)
            for k, (ty, tx, y0, x0, h, w) in enumerate(places.tolist()):
                rows = np.flatnonzero(which.ravel() == k)
                step = max(1, AT_ONCE // (h * w))
                for part in (batch.take(pa.array(rows[i : i + step])) for i in range(0, len(rows), step)):
                    n, px = part.num_rows, part["px"]
                    _, offsets, data = px.buffers()
                    first = np.frombuffer(offsets, "<i4")[px.offset]
                    a = kernel(np.frombuffer(data, "<f8", n * h * w, first).reshape(n, h, w))
                    y, x = np.arange(y0, y0 + h, dtype=np.int32), np.arange(x0, x0 + w, dtype=np.int32)
                    own_y, own_x = y // tile == ty, x // tile == tx
                    a = a[:, own_y][:, :, own_x]
                    gy, gx = np.meshgrid(y[own_y], x[own_x], indexing="ij")
                    long = [*[np.repeat(part[c].to_numpy(), gy.size) for c in PLANE], np.tile(gy.ravel(), n), np.tile(gx.ravel(), n)]
                    yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in long], pa.array(a.ravel())], names=[*PLANE, "y", "x", value])

    return tiles.mapInArrow(run, f"stack int, frame int, y int, x int, {value} double")


def edged(a: np.ndarray, y: int, x: int) -> np.ndarray:
    """Padded along the last two axes with the edge."""
    return np.pad(a, [(0, 0)] * (a.ndim - 2) + [(y, y), (x, x)], mode="edge")


def kernel_laplacian(a: np.ndarray) -> np.ndarray:
    p = edged(a, 1, 1)
    return (p[..., :-2, 1:-1] + p[..., 2:, 1:-1] + p[..., 1:-1, :-2] + p[..., 1:-1, 2:] - 4 * a) ** 2


def kernel_gaussian(sigma: float) -> Callable[[np.ndarray], np.ndarray]:
    k = np.array(P.gaussian_kernel(sigma))
    r = len(k) // 2

    def run(a: np.ndarray) -> np.ndarray:
        p = edged(a, 0, r)
        a = sum(w * p[..., i : i + a.shape[-1]] for i, w in enumerate(k))
        p = edged(a, r, 0)
        return sum(w * p[..., i : i + a.shape[-2], :] for i, w in enumerate(k))

    return run
