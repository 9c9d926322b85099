"""Queries, their output schemas and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.relations import SQL, Relations

#: Types of output columns, in Spark and in the checking SQL engine.
TYPES = {"long": ("long", "BIGINT"), "double": ("double", "DOUBLE"), "string": ("string", "VARCHAR"), "boolean": ("boolean", "BOOLEAN")}
DIGITS = 6


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[Relations], DataFrame]
    oracle: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Relations(spark, sf_dir))
        out = []
        for name, kind in self.columns:
            c = F.col(name).cast(TYPES[kind][0])
            out.append((F.round(c, DIGITS) if kind == "double" else c).alias(name))
        return df.select(*out)

    def sql(self) -> str:
        out = ", ".join(f"round(CAST({n} AS DOUBLE), {DIGITS}) AS {n}" if k == "double" else f"CAST({n} AS {TYPES[k][1]}) AS {n}" for n, k in self.columns)
        return f"WITH RECURSIVE {', '.join(f'{n} AS ({s})' for n, s in SQL.items() if n in needed(self.oracle))}{', ' if needed(self.oracle) else ''}answer AS ({self.oracle}) SELECT {out} FROM answer"


def needed(text: str) -> set[str]:
    """Relations that text names, and those that they name."""
    import re

    found = {n for n in SQL if re.search(rf"\b{n}\b", text)}
    for n in list(found):
        found |= needed(SQL[n])
    return found


REGISTRY: dict[str, Query] = {}


def query(columns: str, oracle: str | None = None) -> Callable:
    """Register a function from Relations to a DataFrame under its own name. columns: "name kind, ..."."""

    def register(build: Callable[[Relations], DataFrame]) -> Callable[[Relations], DataFrame]:
        kinds = tuple(tuple(c.split()) for c in columns.split(","))
        REGISTRY[build.__name__] = Query(build.__name__, kinds, build, oracle)
        return build

    return register
