"""Projects: a partitioned Parquet folder with a JSON manifest (format version 3), and small text formats."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from ..functions import pixel as P

VERSION, SPACE = 3, "p3"
#: Fixed-point scales of the stored planes.
SCALES = {"depth": 64.0, "image": 65535.0}


def stored(df: DataFrame, scale: float, values: tuple[str, ...]) -> DataFrame:
    """Values as 16-bit fixed point (in an int)."""
    fixed = lambda c: (F.least(F.greatest(F.col(c) * scale, F.lit(0.0)), F.lit(65535.0)) + 0.5).cast("int")
    return df.select(*[fixed(c).alias(c) if c in values else F.col(c) for c in df.columns])


def restored(df: DataFrame, scale: float, values: tuple[str, ...]) -> DataFrame:
    return df.select(*[(F.col(c) / scale).alias(c) if c in values else F.col(c) for c in df.columns])


def save(spark: SparkSession, path: str, image: DataFrame, depth: DataFrame, settings: dict | None = None) -> None:
    """Planes by stack into a folder of this save, then a manifest line that names it: what a broken save leaves is
    never read, and the last whole save stays."""
    own = f"save-{uuid.uuid4().hex}"
    stored(image, SCALES["image"], ("r", "g", "b")).write.partitionBy("stack").parquet(f"{path}/{own}/image")
    stored(depth, SCALES["depth"], ("d",)).write.partitionBy("stack").parquet(f"{path}/{own}/depth")
    try:
        number = load_manifest(spark, path)["number"] + 1
    except AnalysisException:  # no project yet
        number = 0
    text = json.dumps({"version": VERSION, "space": SPACE, "number": number, "planes": own, "settings": settings or {}})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").text(f"{path}/manifest")


def load_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest of the last whole save: one line for each save."""
    return max((json.loads(r["value"]) for r in spark.read.text(f"{path}/manifest").collect()), key=lambda m: m.get("number", 0))


def load(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame]:
    """(manifest, image, depth); another version or colour space is refused, missing optional keys default."""
    m = load_manifest(spark, path)
    if m.get("version") != VERSION:
        raise ValueError(f"project version {m.get('version')}")
    if m.get("space", SPACE) != SPACE:
        raise ValueError(f"working space {m['space']}")
    m.setdefault("settings", {})
    return m, restored(spark.read.parquet(f"{path}/{m['planes']}/image"), SCALES["image"], ("r", "g", "b")), restored(spark.read.parquet(f"{path}/{m['planes']}/depth"), SCALES["depth"], ("d",))


def xmp(settings: P.Tone) -> str:
    """A packet with the tone settings as attributes."""
    names = {"Exposure2012": settings.exposure, "Contrast2012": settings.contrast, "Highlights2012": settings.highlights, "Shadows2012": settings.shadows, "Whites2012": settings.whites, "Blacks2012": settings.blacks}
    body = " ".join(f'crs:{k}="{v:+.2f}"' if k.startswith("Exp") else f'crs:{k}="{v:+.0f}"' for k, v in names.items())
    return f'<?xpacket begin="" id="W5M0MpCehiHzreSzNTczkc9d"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:crs="http://ns.adobe.com/camera-raw-settings/1.0/" {body}/></rdf:RDF></x:xmpmeta><?xpacket end="w"?>'


def linear_negative(image: DataFrame, neutral: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """16-bit linear samples with the white balance taken out: linearised, times the neutral of each channel."""
    return image.select(*[c for c in ("stack", "frame", "y", "x") if c in image.columns], *[(P.clamp(P.srgb_linearize(F.greatest(c, F.lit(0.0))) * n) * 65535 + 0.5).cast("int").alias(c) for c, n in zip("rgb", neutral)])


def preview(df: DataFrame, height: int, width: int, to_h: int, to_w: int) -> DataFrame:
    """Nearest thumbnail: source row y * height div to_h, column likewise; index arithmetic, no gather."""
    return df.withColumn("_ty", F.ceil(F.col("y") * to_h / height)).withColumn("_tx", F.ceil(F.col("x") * to_w / width)).where(
        (F.floor(F.col("_ty") * height / to_h) == F.col("y")) & (F.floor(F.col("_tx") * width / to_w) == F.col("x")) & (F.col("_ty") < to_h) & (F.col("_tx") < to_w)
    ).withColumn("y", F.col("_ty").cast("int")).withColumn("x", F.col("_tx").cast("int")).drop("_ty", "_tx")


def rocking(frames: int, path: str, amplitude: float, width: int) -> list[tuple[int, float, float]]:
    """(t, dx, dy) of an animation's frames."""
    import math

    out = []
    for t in range(frames):
        a = 2 * math.pi * t / frames
        x, y = {"horizontal": (math.sin(a), 0.0), "vertical": (0.0, math.sin(a)), "circular": (math.sin(a), math.cos(a))}[path]
        out.append((t, x * amplitude * width, y * amplitude * width))
    return out
