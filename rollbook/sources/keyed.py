"""A keyed table in files whose batches rewrite only what they touch (SNK-1, SNK-6, STR).

Rows lie in leaves by the leading bits of a hash of their key: a leaf is (depth, prefix). A leaf holds
about ``LEAF_ROWS`` rows at most; one that a batch grows beyond is split by more bits, and only that one.
A version's manifest names, for every leaf, the version that wrote its file. So a batch reads and writes
the leaves of its keys and one small manifest, however large the table is.

Leaves are written first, the manifest last, as one file; it makes the version visible at once. Running
a committed version again does nothing, and running one again that was cut off overwrites its own
leaves only. The two versions before the newest stay readable; leaves that no kept version names go.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import shuffles_freed

LEAF_ROWS = 200_000
KEPT = 2
HASH_BITS = 62
MANIFEST = "version long, depth int, prefix long, written long, rows long, schema string"


class Leaf(NamedTuple):
    depth: int
    prefix: int
    written: int
    rows: int


class Version(NamedTuple):
    number: int
    leaves: list[Leaf]
    schema: T.StructType


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target with the rows of the source; the source wins on equal keys (one source row per key)."""
    return source.unionByName(target.join(source.select(*keys), keys, "left_anti"))


def _versions(spark: SparkSession, path: str) -> dict[int, Version]:
    """Committed versions that are kept; a version has as many rows as leaves."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return {}
        raise
    out: dict[int, Version] = {}
    for r in rows:
        if r.version not in out:
            out[r.version] = Version(r.version, [], T.StructType.fromJson(json.loads(r.schema)))
        out[r.version].leaves.append(Leaf(r.depth, r.prefix, r.written, r.rows))
    return out


def _newest(spark: SparkSession, path: str, before: int | None) -> Version | None:
    found = {n: v for n, v in _versions(spark, path).items() if before is None or n < before}
    return found[max(found)] if found else None


def _file(path: str, leaf: Leaf) -> str:
    return f"{path}/data/version={leaf.written}/leaf={leaf.depth}-{leaf.prefix}"


def _read(spark: SparkSession, path: str, version: Version, leaves: list[Leaf]) -> DataFrame:
    files = [_file(path, leaf) for leaf in leaves if leaf.rows]
    return spark.read.schema(version.schema).parquet(*files) if files else spark.createDataFrame([], version.schema)


def read_current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """Newest committed version, or the newest below ``before``."""
    version = _newest(spark, path, before)
    return None if version is None else _read(spark, path, version, version.leaves)


def _deeper(depth: int, rows: int) -> int:
    """Depth of a leaf that is to hold ``rows``: as many more bits as bring it below the bound."""
    return min(HASH_BITS, depth + max(0, math.ceil(math.log2(max(rows, 1) / LEAF_ROWS))))


def _split(depth: int, prefix: int, to: int) -> range:
    return range(prefix << to - depth, prefix + 1 << to - depth)


def _placed(rows: DataFrame, keys: list[str], leaves: list[Leaf]) -> DataFrame:
    """Rows with ``_hash`` and the leaf that holds their key: depth and prefix. A key lies in exactly one."""
    # a null key has a place like any value
    h = F.shiftrightunsigned(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys]), 64 - HASH_BITS)
    places = F.array(*[F.struct(F.lit(d).alias("_depth"), F.shiftrightunsigned(F.col("_hash"), HASH_BITS - d).alias("_prefix")) for d in sorted({x.depth for x in leaves})])
    known = rows.sparkSession.createDataFrame([(x.depth, x.prefix) for x in leaves], "_depth int, _prefix long")
    # the driver holds the list of leaves; joined by shuffle, all rows of a leaf would go to one task
    return rows.withColumn("_hash", h).select("*", F.inline(places)).join(F.broadcast(known), ["_depth", "_prefix"])


def _touched(source: DataFrame, keys: list[str], version: Version) -> list[Leaf]:
    hit = {(r._depth, r._prefix) for r in _placed(source.select(*keys), keys, version.leaves).select("_depth", "_prefix").distinct().collect()}
    return [x for x in version.leaves if (x.depth, x.prefix) in hit]


def matching(source: DataFrame, path: str, keys: list[str], before: int | None = None) -> DataFrame | None:
    """Rows of the leaves that hold the keys of ``source``: all rows of these keys, and some neighbors."""
    version = _newest(source.sparkSession, path, before)
    return None if version is None else _read(source.sparkSession, path, version, _touched(source, keys, version))


def upsert_into(source: DataFrame, path: str, keys: list[str], version: int, combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> None:
    """Write ``version`` of the table at ``path``: the version before it with the source merged in.

    ``combine(old, source)`` gives the new rows of the touched leaves from their old rows and the
    source; by default the source wins on equal keys.
    """
    spark = source.sparkSession
    versions = _versions(spark, path)
    if version in versions:
        return
    found = [n for n in versions if n < version]
    old = versions[max(found)] if found else Version(-1, [Leaf(0, 0, -1, 0)], source.schema)
    # a new table has one leaf and no rows to be met
    touched = _touched(source, keys, old) if found else old.leaves
    before = _read(spark, path, old, touched)
    merged = combine(before, source) if combine else upsert(before, source, keys) if found else source
    if not found:
        old = old._replace(schema=merged.schema)
    merged = merged.select(*old.schema.names)
    rows = _placed(merged, keys, touched or old.leaves).persist()
    try:
        counts = {(r._depth, r._prefix): r["count"] for r in rows.groupBy("_depth", "_prefix").count().collect()}
        deeper = {(x.depth, x.prefix): _deeper(x.depth, counts.get((x.depth, x.prefix), 0)) for x in touched}
        if touched:
            new = spark.createDataFrame([(d, p, n) for (d, p), n in deeper.items()], "_depth int, _prefix long, _new int")
            split = rows.join(F.broadcast(new), ["_depth", "_prefix"]).withColumn("_at", F.expr(f"shiftrightunsigned(_hash, {HASH_BITS} - _new)"))
            named = split.withColumn("leaf", F.concat_ws("-", "_new", "_at"))
            named.repartition("leaf").select(*old.schema.names, "leaf").write.mode("overwrite").partitionBy("leaf").parquet(f"{path}/data/version={version}")
            whole = all(to == depth for (depth, _), to in deeper.items())
            held = counts if whole else {(r._new, r._at): r["count"] for r in split.groupBy("_new", "_at").count().collect()}
        leaves = [x for x in old.leaves if (x.depth, x.prefix) not in deeper]
        for (depth, prefix), to in deeper.items():
            for at in _split(depth, prefix, to):
                leaves.append(Leaf(to, at, version, held.get((to, at), 0)))
    finally:
        rows.unpersist()
    _commit(spark, path, versions, Version(version, leaves, old.schema))


def group_into(source: DataFrame, path: str, keys: list[str], version: int, group: Callable[[DataFrame, list[str]], DataFrame], place: list[str] | None = None) -> None:
    """``upsert_into`` for rows that add up: ``group(rows, by)`` gives one row per group ``by`` (the leaf and
    the keys) from the old rows of the touched leaves and the source together.

    All rows meet in their leaf by one shuffle, are grouped there and written as they come, sorted by key; nothing
    is cached. So a leaf is split before its rows are grouped, by its old rows and the number of keys that come.
    ``place`` names the keys whose hash finds the leaf, the same for all versions: rows that are equal in them lie
    side by side, which packs them closely, but cannot be split. By default all keys do.
    """
    place = place or keys
    spark = source.sparkSession
    versions = _versions(spark, path)
    if version in versions:
        return
    found = [n for n in versions if n < version]
    old = versions[max(found)] if found else Version(-1, [Leaf(0, 0, -1, 0)], source.schema)
    # keys are counted, not rows: a key that comes often does not split its leaf
    coming = _placed(source.select(*keys), place, old.leaves).groupBy("_depth", "_prefix").agg(F.approx_count_distinct(F.xxhash64(*keys)).alias("n"))
    new = {(r._depth, r._prefix): r.n for r in coming.collect()}
    touched = [x for x in old.leaves if (x.depth, x.prefix) in new or not found]
    leaves = [x for x in old.leaves if x not in touched]
    if touched:
        deeper = [(x, _deeper(x.depth, x.rows + new.get((x.depth, x.prefix), 0))) for x in touched]
        split = [Leaf(to, at, version, 0) for x, to in deeper for at in _split(x.depth, x.prefix, to)]
        rows = _read(spark, path, old, touched).unionByName(source) if found else source
        named = _placed(rows, place, split).withColumn("leaf", F.concat_ws("-", "_depth", "_prefix")).select(*rows.columns, "leaf")
        # few leaves share a task; beyond the usual number of tasks a writing task would hold and spill all its rows
        tasks = min(2 * len(split), int(spark.conf.get("spark.sql.shuffle.partitions")))
        merged = group(named.repartition(tasks, "leaf"), ["leaf", *keys])
        if not found:
            old = old._replace(schema=merged.drop("leaf").schema)
        data = f"{path}/data/version={version}"
        with shuffles_freed(spark):
            merged.select(*old.schema.names, "leaf").write.mode("overwrite").option("compression", "zstd").partitionBy("leaf").parquet(data)
        # only the footers are read
        held = {r.leaf: r["count"] for r in spark.read.schema("leaf string").parquet(data).groupBy("leaf").count().collect()}
        leaves += [x._replace(rows=held.get(f"{x.depth}-{x.prefix}", 0)) for x in split]
    _commit(spark, path, versions, Version(version, leaves, old.schema))


def _commit(spark: SparkSession, path: str, versions: dict[int, Version], new: Version) -> None:
    """Write the manifest of a version whose leaves are there, then drop what no kept version names."""
    schema = new.schema.json()
    manifest = spark.createDataFrame([(*x, schema) for x in new.leaves], "depth int, prefix long, written long, rows long, schema string")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={new.number}")
    _clean(spark, path, versions | {new.number: new})


def _clean(spark: SparkSession, path: str, versions: dict[int, Version]) -> None:
    """Delete manifests beyond the kept ones, then the leaves that only they named."""
    kept = sorted(versions)[-KEPT - 1 :]
    named = {_file(path, x) for n in kept for x in versions[n].leaves}
    gone = [n for n in versions if n not in kept]
    old = [f"{path}/manifest/version={n}" for n in gone] + sorted({_file(path, x) for n in gone for x in versions[n].leaves if x.rows} - named)
    jvm = getattr(spark, "_jvm", None)
    for name in old if jvm else []:
        place = jvm.org.apache.hadoop.fs.Path(name)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
