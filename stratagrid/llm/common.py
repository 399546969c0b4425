"""Shared helpers: reading tables, cutting lineage in the shared folder, bounded ranks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on a local master, where there is one machine."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="stratagrid-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` written once to the shared folder and read back, so that a lost executor costs a re-read and not the lineage.

    The files go with :func:`free`, at the latest when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    fs, p = _path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def free(*cuts: DataFrame) -> None:
    """Delete the files of cuts that nothing reads any more."""
    for df in cuts:
        fs, p = _path(df.sparkSession, df._cut_at)
        fs.delete(p, True)


def numbered(docs: DataFrame) -> DataFrame:
    """rid and the whole row as one struct column ``row``, written once: a row's number then stays the same for
    every reader, and no column of ``docs`` can meet one of an operator's own."""
    return cut(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "rows")


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, so that extra or clashing ones can't meet an operator's own."""
    return df.select(*[F.col(n) for n in names])


def fold(key: str, n: int) -> Column:
    """crc32 of a key written as text, modulo ``n``; a null key counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def byte_len(col: str) -> Column:
    return F.coalesce(F.octet_length(F.col(col)), F.lit(0)).cast("long")


def ranked(df: DataFrame, key: list[str], order: list[str], out: str, per_bucket: int = 1000, most: int = 20_000) -> DataFrame:
    """Gapless ranks from 0 within the non-null ``key`` in long column ``out``, without a whole key in one task.

    Each key's rows are dealt over buckets by a hash of ``order``; buckets get running offsets from
    their counts (one row per key and bucket, at most ``most`` for a key), and ``row_number`` runs inside
    a bucket only. The number of buckets follows the row count, so a bucket stays small however hot its
    key is. ``df`` must be cheap to read twice (written by :func:`cut`). Equal rows are interchangeable.
    """
    from pyspark.sql import Window as W

    buckets = min(most, max(1, -(-df.count() // per_bucket)))
    b = df.withColumn("_b", F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(buckets)).cast("int"))
    before = W.partitionBy(*key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offs = b.groupBy(*key, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rn = b.withColumn("_rn", F.row_number().over(W.partitionBy(*key, "_b").orderBy(*order)))
    return rn.join(offs, [*key, "_b"]).withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("long")).select(*df.columns, out)


def schema_of(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)
