"""Query catalog: a Spark plan per key and, where SQL can say the same, its comparison text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .oracle import with_views
from .store import Store, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Columns as numbers, booleans and text: dates and times as ISO text, decimals as double."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, ",")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(key: str, sql: str | None = None):
    """Register ``fn(store) -> DataFrame`` under ``key`` with its comparison SQL."""
    def wrap(fn: Callable[[Store], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: plain(fn(store(spark, sf_dir)))
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return wrap


def comparison_sql() -> dict[str, str]:
    """Every comparison text with the views it needs inlined."""
    return {key: with_views(sql) for key, sql in ORACLE.items()}


def ts(c: str, name: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {name or c.split('.')[-1]}"


def day(c: str, name: str | None = None) -> str:
    return f"cast({c} AS varchar) AS {name or c.split('.')[-1]}"


def num(c: str, name: str | None = None) -> str:
    return f"cast({c} AS double) AS {name or c.split('.')[-1]}"


def big(c: str, name: str | None = None) -> str:
    return f"cast({c} AS bigint) AS {name or c.split('.')[-1]}"
