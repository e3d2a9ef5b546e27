"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rollbook.session import shared_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster shares (spark.checkpoint.dir)."""
    return f"{shared_dir(spark)}/llm/{spark.sparkContext.applicationId}/{uuid.uuid4().hex[:12]}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def short_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hold at most ``rows`` whole texts in a batch between the JVM and Python; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def byte_runs(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive runs (from, to) whose sizes add up to ``most`` bytes, unless one item alone is larger."""
    ends, out, lo = np.cumsum(sizes, dtype=np.int64), [], 0
    while lo < len(sizes):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, "right")))
        out.append((lo, hi))
        lo = hi
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def same(a: Column, b: Column) -> Column:
    """Null-safe equality, as an equi join key."""
    return a.eqNullSafe(b)


def text_hash(c: Column) -> Column:
    """With the id, the key of a row; rows that agree in both are the same document twice."""
    return F.xxhash64(F.coalesce(c, F.lit("")))
