"""All queries of the library's own operators, by name, with their SQL twins.

Doubles are rounded to six digits on both sides, since sums may differ in the last bits; a billionth
is added first, so that a mean of two-digit prices that lies half way goes the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
MODULES = ("tables", "quality", "clusters", "choices", "completion", "structure", "panels")


def _tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded, integers as long."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double") + F.lit(1e-9), 6) + F.lit(0.0)
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, doubles: str = "", longs: str = ""):
    """Register a query; ``doubles`` and ``longs`` name the SQL's columns to round and to cast."""

    def add(f):
        _QUERIES[name] = lambda spark, d: _tidy(f(spark, d))
        if sql:
            changes = [f"round(CAST({c} AS DOUBLE) + 1e-9, 6) + 0.0 AS {c}" for c in doubles.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()]
            _ORACLES[name] = f"SELECT * REPLACE ({', '.join(changes)}) FROM ({sql})" if changes else sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        import_module(f"cairn.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
