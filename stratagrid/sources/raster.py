"""Raster files as tables: a metadata source that reads headers only, and a pixel source.

Formats: binary PGM/PPM (8 and 16 bit), strip TIFF (8 and 16 bit gray or RGB, either byte order, uncompressed or
deflated, with or without horizontal differences), PNG without interlace or palette (8 and 16 bit).
A Python data source offers no column pruning, so metadata and pixels are two sources. Files are partitions, named
by a glob under a folder that all executors see; ``binary_pixels`` reads through Spark's own file source instead.
"""

from __future__ import annotations

import glob
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

EXTENSIONS = ("pgm", "ppm", "tif", "tiff", "png")
META = "path string, name string, folder string, width int, height int, channels int, bits int, captured_at string"
_META = pa.schema([(n, pa.int32() if t == "int" else pa.string()) for n, t in (c.split() for c in META.split(", "))])
PX = "path string, y int, x int, r double, g double, b double, a double"


def header(raw) -> tuple[str, int, int, int, int, list[tuple[int, int]], str, dict]:
    """kind, width, height, channels, bits, (offset, length) of the samples, byte order, and what else decoding needs
    (deflated, differences) or is told (captured_at). ``raw``: bytes, or what gives them by slices."""
    if raw[:2] in (b"P5", b"P6"):
        m = re.match(rb"P[56](?:\s+#[^\n]*)*\s+(\d+)(?:\s+#[^\n]*)*\s+(\d+)(?:\s+#[^\n]*)*\s+(\d+)\s", raw[:4096])
        if not m:
            raise ValueError("not a PGM/PPM header")
        w, h, top = (int(v) for v in m.groups())
        c, bits = (3 if raw[1:2] == b"6" else 1), (16 if top > 255 else 8)
        return "pnm", w, h, c, bits, [(m.end(), w * h * c * bits // 8)], ">", {}
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        w, h, bits, colour, _, _, interlace = struct.unpack(">IIBBBBB", raw[16:29])
        c = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
        if c is None or interlace or bits not in (8, 16):
            raise ValueError("PNG with a palette, an interlace or few bits")
        return "png", w, h, c, bits, [], ">", {}
    if raw[:4] in (b"II*\0", b"MM\0*"):
        o = "<" if raw[:1] == b"I" else ">"
        at = struct.unpack(o + "I", raw[4:8])[0]
        tags = {}
        for k in range(struct.unpack(o + "H", raw[at : at + 2])[0]):
            e = raw[at + 2 + 12 * k : at + 14 + 12 * k]
            tag, kind, n = struct.unpack(o + "HHI", e[:8])
            size = {2: 1, 3: 2, 4: 4}.get(kind)
            if size:
                body = e[8 : 8 + size * n] if size * n <= 4 else raw[(p := struct.unpack(o + "I", e[8:12])[0]) : p + size * n]
                tags[tag] = body.rstrip(b"\0").decode("latin-1") if kind == 2 else struct.unpack(o + ("H" if size == 2 else "I") * n, body)
        way = tags.get(259, (1,))[0]
        if way not in (1, 8, 32946):
            raise ValueError("TIFF compressed otherwise than by deflate")
        bits = tags.get(258, (8,))[0]
        more = {"deflated": way != 1, "differences": tags.get(317, (1,))[0] == 2, "captured_at": tags.get(306)}
        return "tiff", tags[256][0], tags[257][0], tags.get(277, (1,))[0], bits, list(zip(tags[273], tags[279])), o, more
    raise ValueError("unknown raster format")


def png_samples(raw: bytes, w: int, h: int, c: int, bits: int) -> bytes:
    """The unfiltered rows of a PNG."""
    at, body = 8, []
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        if kind == b"IDAT":
            body.append(raw[at + 8 : at + 8 + n])
        at += 12 + n
    step = c * bits // 8
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h + 1, w + 1, step), np.uint8)  # a row and a column of zeros before the first
    for y in range(h):
        kind, v = rows[y, 0], rows[y, 1:].reshape(w, step)
        up, own = out[y], out[y + 1]
        if kind == 0:
            own[1:] = v
        elif kind == 1:
            own[1:] = np.cumsum(v, axis=0, dtype=np.uint8)
        elif kind == 2:
            own[1:] = v + up[1:]
        else:
            for x in range(w):
                a, b, d = (t.astype(np.int16) for t in (own[x], up[x + 1], up[x]))
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - d
                    pa, pb, pd = abs(p - a), abs(p - b), abs(p - d)
                    guess = np.where((pa <= pb) & (pa <= pd), a, np.where(pb <= pd, b, d))
                own[x + 1] = v[x] + guess.astype(np.uint8)
    return out[1:, 1:].tobytes()


def decode(raw: bytes) -> np.ndarray:
    """height x width x 4 in 0..1; gray is repeated, alpha is 1 where the file has none."""
    kind, w, h, c, bits, parts, o, more = header(raw)
    if kind == "png":
        body = png_samples(raw, w, h, c, bits)
    else:
        body = b"".join(zlib.decompress(raw[a : a + n]) if more.get("deflated") else raw[a : a + n] for a, n in parts)
    v = np.frombuffer(body, (o + "u2") if bits == 16 else "u1")[: w * h * c].reshape(h, w, c)
    if more.get("differences"):
        v = np.cumsum(v, axis=1, dtype=np.uint16 if bits == 16 else np.uint8)
    v = v / float(2**bits - 1)
    rgb = v[..., :3] if c >= 3 else np.repeat(v[..., :1], 3, 2)
    a = v[..., -1:] if c in (2, 4) else np.ones((h, w, 1))
    return np.concatenate([rgb, a], 2)


class Slices:
    """A file's bytes by slices, so that a header costs a few small reads."""

    def __init__(self, f):
        self.f = f

    def __getitem__(self, s: slice) -> bytes:
        self.f.seek(s.start or 0)
        return self.f.read(s.stop - (s.start or 0))


def reduced(a: np.ndarray, k: int) -> np.ndarray:
    """Box means of k x k pixels, clipped at the edges."""
    if k <= 1:
        return a
    ys, xs = np.arange(0, a.shape[0], k), np.arange(0, a.shape[1], k)
    n = np.add.reduceat(np.add.reduceat(np.ones(a.shape[:2]), ys, 0), xs, 1)
    return np.add.reduceat(np.add.reduceat(a, ys, 0), xs, 1) / n[..., None]


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict, pixels: bool):
        self.top, self.pixels, self.k = options["path"], pixels, int(options.get("reduce", "1"))

    def partitions(self) -> list[InputPartition]:
        names = [p for p in glob.glob(os.path.join(self.top, "**", "*"), recursive=True) if p.rsplit(".", 1)[-1].lower() in EXTENSIONS and "/." not in p]
        return [_File(p) for p in sorted(names)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        p = partition.path
        with open(p, "rb") as f:
            if not self.pixels:
                _, w, h, c, bits, _, _, more = header(Slices(f))
                yield pa.RecordBatch.from_pylist([{"path": p, "name": os.path.basename(p), "folder": os.path.dirname(p), "width": w, "height": h, "channels": c, "bits": bits, "captured_at": more.get("captured_at")}], _META)
                return
            a = reduced(decode(f.read()), self.k)
        h, w = a.shape[:2]
        for y in range(0, h, max(1, 65536 // w)):  # some rows at a time
            part = a[y : y + max(1, 65536 // w)]
            yy, xx = np.divmod(np.arange(part.shape[0] * w, dtype=np.int32), np.int32(w))
            yield pa.RecordBatch.from_arrays([pa.array([p] * len(yy), pa.string()), pa.array(yy + np.int32(y)), pa.array(xx), *(pa.array(part[..., k].ravel()) for k in range(4))], names=["path", "y", "x", "r", "g", "b", "a"])


class FramesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stack_frames"

    def schema(self) -> str:
        return META

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), False)


class PixelsSource(FramesSource):
    @classmethod
    def name(cls) -> str:
        return "stack_px"

    def schema(self) -> str:
        return PX

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), True)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FramesSource)
    spark.dataSource.register(PixelsSource)


def folders(spark: SparkSession, path: str) -> DataFrame:
    """path, name, folder, frame of every raster below ``path``: each directory is a group, in order of name. Reads no content."""
    from pyspark.sql import Window as W

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    files = files.where(F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).isin(*EXTENSIONS) & ~F.col("path").rlike(r"/\."))
    f = files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"))
    return f.withColumn("frame", F.row_number().over(W.partitionBy("folder").orderBy("name")) - 1)


def binary_pixels(spark: SparkSession, path: str, reduce: int = 1) -> DataFrame:
    """Pixels of all rasters below a path that any of Spark's file systems can read."""
    import pandas as pd

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, raw in zip(part["path"], part["content"]):
                a = reduced(decode(bytes(raw)), reduce)
                yy, xx = np.meshgrid(np.arange(a.shape[0], dtype="int32"), np.arange(a.shape[1], dtype="int32"), indexing="ij")
                yield pd.DataFrame({"path": p, "y": yy.ravel(), "x": xx.ravel(), **{n: a[..., i].ravel() for i, n in enumerate("rgba")}})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).isin(*EXTENSIONS))
    return files.select("path", "content").mapInPandas(run, PX)


def encode_pnm(a: np.ndarray, bits: int = 16) -> bytes:
    top = 2**bits - 1
    v = (np.clip(a[..., :3], 0, 1) * top + 0.5).astype(">u2" if bits == 16 else "u1")
    return b"P6\n%d %d\n%d\n" % (a.shape[1], a.shape[0], top) + v.tobytes()


def encode_png(a: np.ndarray, bits: int = 16, text: dict[str, str] | None = None) -> bytes:
    """RGB PNG of 8 or 16 bits with optional text chunks (an XMP packet, a comment)."""
    top = 2**bits - 1
    v = (np.clip(a[..., :3], 0, 1) * top + 0.5).astype(">u2" if bits == 16 else "u1")
    rows = b"".join(b"\0" + r.tobytes() for r in v)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    notes = b"".join(chunk(b"iTXt", k.encode("latin-1") + b"\0\0\0\0\0" + t.encode()) for k, t in (text or {}).items())
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], bits, 2, 0, 0, 0)) + notes + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def encode_tiff(a: np.ndarray, bits: int = 16) -> bytes:
    v = (np.clip(a[..., :3], 0, 1) * (2**bits - 1) + 0.5).astype("<u2" if bits == 16 else "u1").tobytes()
    h, w = a.shape[:2]
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 3, 8 + 2 + 12 * 9 + 4), (259, 3, 1, 1), (262, 3, 1, 2), (273, 4, 1, 8 + 2 + 12 * 9 + 4 + 6), (277, 3, 1, 3), (278, 4, 1, h), (279, 4, 1, len(v))]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHI", t, k, n) + (struct.pack("<HH", x, 0) if k == 3 and n == 1 else struct.pack("<I", x)) for t, k, n, x in tags) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", 8) + ifd + struct.pack("<HHH", bits, bits, bits) + v


ENCODERS = {"png": encode_png, "ppm": encode_pnm, "tif": encode_tiff, "tiff": encode_tiff}


def encoded(image: DataFrame, extension: str, bits: int = 16, key: str = "stack") -> DataFrame:
    """key, name, content: one encoded file for each image (stack, y, x, r, g, b); an image is assembled in its task."""
    import pandas as pd

    if extension not in ENCODERS:
        raise ValueError(f"unknown extension: {extension}")

    def run(k: tuple, p: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(p["y"].max()) + 1, int(p["x"].max()) + 1, 3))
        a[p["y"], p["x"]] = p[["r", "g", "b"]]
        return pd.DataFrame([(str(k[0]), f"{k[0]}.{extension}", ENCODERS[extension](a, bits))], columns=[key, "name", "content"])

    return image.groupBy(key).applyInPandas(run, f"{key} string, name string, content binary")


def aligned_files(px: DataFrame, frames: DataFrame, height: int, width: int, extension: str = "png", bits: int = 16) -> DataFrame:
    """key, name, content: one encoded file for each aligned frame, named by stack and frame; all of a stack lie on one canvas.

    ``px``: stack, frame, y, x, r, g, b; ``frames``: stack, frame, h (frame -> reference)."""
    from ..operators.registration import aligned

    a = aligned(px, frames, height, width)
    return encoded(a.withColumn("key", F.concat_ws("-", F.col("stack"), F.lpad(F.col("frame").cast("string"), 5, "0"), F.lit("aligned"))), extension, bits, "key")


def write_images(image: DataFrame, folder: str, extension: str = "png", bits: int = 16) -> None:
    """Files in a folder that driver and executors share."""

    def put(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            with open(os.path.join(folder, r["name"]), "wb") as f:
                f.write(r["content"])

    encoded(image, extension, bits).foreachPartition(put)
