"""A book of queries: name, Spark function, SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.views import SQL

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return put


def with_views(view: str, body: str, cte: bool = False, recursive: bool = False) -> str:
    """``body`` over a view; ``cte``: the body starts with further common table expressions."""
    return f"WITH {'RECURSIVE ' * recursive}{SQL[view]}{',' if cte else ''} {body}"


def r6(c: Column, digits: int = 6) -> Column:
    """Rounded, and never a negative zero: sums may be added up in any order."""
    return F.round(c, digits) + F.lit(0.0)


def taps(col: str, weights: list[float], along: str, side: int = 8) -> str:
    """A plane kept as a list, convolved along an axis with its edge repeated."""
    r = len(weights) // 2
    at = lambda o: f"(i // {side}) * {side} + least(greatest(i % {side} + {o}, 0), {side - 1}) + 1" if along == "x" else f"least(greatest(i // {side} + {o}, 0), {side - 1}) * {side} + i % {side} + 1"
    return f"list_transform(range({side * side}), lambda i: " + " + ".join(f"{w!r} * {col}[{at(k - r)}]" for k, w in enumerate(weights)) + ")"
