"""Registry of the library's queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import composite, fusion, governance, reduce, scalar, spatial

BOOKS = (scalar.book, reduce.book, spatial.book, composite.book, fusion.book, governance.book)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth from focus and the all-in-focus render of every stack."""
    return composite.slice_zero(spark, sf_dir)


def queries() -> dict:
    return {k: f for b in BOOKS for k, f in b.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for b in BOOKS for k, s in b.sql.items()}
