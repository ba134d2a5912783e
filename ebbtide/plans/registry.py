"""Registered queries: a Spark build, its output columns and the matching SQL.

`columns` lists "name:kind"; the kind fixes how both sides present a value:
i = whole number, f = double rounded to 6 digits (f2, f4 ... other digits; by
floor(x * 10^n + 0.5), which both engines compute alike),
d = date as text, s = text, b = boolean, a = array of text joined by ",".
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    columns: tuple[tuple[str, str], ...]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder)).select(
            *[_spark_value(c, k).alias(c) for c, k in self.columns]
        )

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        shown = ", ".join(f"{_sql_value(c, k)} AS {c}" for c, k in self.columns)
        return f"SELECT {shown} FROM ({self.sql}) AS q"


def _digits(kind: str) -> int:
    return int(kind[1:] or 6)


def _spark_value(name: str, kind: str):
    c = F.col(name)
    if kind == "i":
        return c.cast("bigint")
    if kind[0] == "f":
        scale = 10.0 ** _digits(kind)
        x = c.cast("double") * scale
        # beyond 9e15 a double has no fraction left to round
        return F.when(F.abs(x) < 9e15, F.floor(x + 0.5) / F.lit(scale)).otherwise(c.cast("double"))
    if kind == "b":
        return c.cast("boolean")
    if kind == "a":
        return F.array_join(c, ",")
    return c.cast("string")


def _sql_value(name: str, kind: str) -> str:
    if kind == "i":
        return f"CAST({name} AS BIGINT)"
    if kind[0] == "f":
        scale = f"{10.0 ** _digits(kind):.1f}"
        x = f"CAST({name} AS DOUBLE) * CAST({scale} AS DOUBLE)"
        return f"CASE WHEN abs({x}) < 9e15 THEN floor({x} + CAST(0.5 AS DOUBLE)) / CAST({scale} AS DOUBLE) ELSE CAST({name} AS DOUBLE) END"
    if kind == "b":
        return f"CAST({name} AS BOOLEAN)"
    if kind == "a":
        return f"array_to_string({name}, ',')"
    if kind == "d":
        return f"CAST(CAST({name} AS DATE) AS VARCHAR)"
    return f"CAST({name} AS VARCHAR)"


REGISTRY: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Register a build function under a name."""
    pairs = tuple(tuple(item.split(":")) for item in columns.split())

    def register(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, build, pairs, sql)
        return build

    return register
