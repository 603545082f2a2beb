"""The table of registered queries: name -> Spark query and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import with_views

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None
    covers: str


REGISTRY: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None, ctes: dict[str, str] | None = None):
    """Register a query; `covers` names the inventory lines it stands for."""

    def wrap(fn: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(fn, with_views(sql, ctes) if sql else None, covers)
        return fn

    return wrap


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: stamps as text, doubles rounded, no negative zero."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        x = F.col(f"`{f.name}`")
        if kind in ("double", "float"):
            out.append((F.round(x.cast("double"), digits) + F.lit(0.0)).alias(f.name))
        elif kind in ("timestamp", "timestamp_ntz"):
            out.append(F.date_format(x, "yyyy-MM-dd HH:mm:ss").alias(f.name))
        elif kind == "date":
            out.append(F.date_format(x, "yyyy-MM-dd").alias(f.name))
        elif kind in ("integer", "short", "byte"):
            out.append(x.cast("bigint").alias(f.name))
        else:
            out.append(x.alias(f.name))
    return df.select(*out)


def rd(expr: str, name: str, digits: int = 6) -> str:
    """SQL twin of `present` for one double column."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


def ts(expr: str, name: str = "timestamp") -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') AS {name}"


def rds(names: list[str] | str, digits: int = 6) -> str:
    cols = names.split() if isinstance(names, str) else names
    return ", ".join(rd(x, x, digits) for x in cols)
