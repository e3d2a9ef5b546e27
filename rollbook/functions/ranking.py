"""Top rows per group and first pairs of a group without building the group or its pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import staged

SALTS = 64


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], n: int, salt_on: list[str], rank: str = "rn"
) -> DataFrame:
    """The first ``n`` rows of every group in ``order``.

    Two rounds: rows are first cut to ``n`` within (group, salt), then to ``n`` within the group.
    A group holding a third of all rows is spread over SALTS tasks, and the second round sees at
    most ``SALTS * n`` rows of it.
    """
    salt = F.pmod(F.xxhash64(*salt_on), F.lit(SALTS))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn(rank, F.row_number().over(first))
        .where(F.col(rank) <= n)
        .drop("_salt", rank)
        .withColumn(rank, F.row_number().over(last))
        .where(F.col(rank) <= n)
    )


def first_pairs(df: DataFrame, keys: list[str], uid: str, k: int, carry: list[str]) -> DataFrame:
    """The first ``k`` pairs (uid1 < uid2 inside a group) in the order uid1, uid2, keys.

    Exact without all pairs. Inside a group the first k pairs use only its k + 1 smallest uids.
    Overall they use at most k different (uid1, group) rows: the k smallest that have a larger
    partner. So at most k seeds meet at most k + 1 partners each. ``carry`` columns come back
    as <col>1 and <col>2.
    """
    members = top_per_group(
        df.select(*keys, uid, *carry).where(F.col(uid).isNotNull()), keys, [F.col(uid)], k + 1, [uid]
    )
    last = members.groupBy(*keys).agg(F.max(uid).alias("_last"))
    seeds = (
        members.join(last, keys)
        .where(F.col(uid) < F.col("_last"))
        .orderBy(uid, *keys)
        .limit(k)
        .select(*keys, *[F.col(c).alias(f"{c}1") for c in (uid, *carry)])
    )
    partners = members.select(*keys, *[F.col(c).alias(f"{c}2") for c in (uid, *carry)])
    # seeds has at most k rows by the limit above
    return (
        partners.join(F.broadcast(seeds), keys)
        .where(F.col(f"{uid}1") < F.col(f"{uid}2"))
        .orderBy(f"{uid}1", f"{uid}2", *keys)
        .limit(k)
    )


def pair_count(n: Column) -> Column:
    """Unordered pairs of a group of n."""
    return (n * (n - 1) / 2).cast("bigint")


class Ranked:
    """Rows in one order, numbered without a task that sees them all.

    The rows are range partitioned and sorted by (group, order) and written. Only the number and the
    weight of every (group, partition) are added up along the partitions; a row's place follows from
    its place inside its partition. So a page opens the few partitions that hold its ranks, and costs
    the same at every offset.
    """

    def __init__(self, df: DataFrame, group: list[str], order: list[Column], name: str, weight: str | None = None):
        self.group, self.columns, self.weight = group or ["_all"], df.columns, weight
        rows = df if group else df.withColumn("_all", F.lit(0))
        keys = [*[F.asc(g) for g in self.group], *order]
        self.rows = staged(
            rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
            .withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), name)
        w = F.col(weight) if weight else F.lit(1)
        runs = self.rows.groupBy(*self.group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"), F.sum(w).alias("_weight"))
        before = Window.partitionBy(*self.group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*self.group)
        self.runs = runs.select(
            *self.group, "_part", "_first", "_weight", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
            F.coalesce(F.sum("_weight").over(before), F.lit(0)).alias("_weight_before"), F.sum("_weight").over(whole).alias("total"))

    def numbered(self, rows: DataFrame | None = None) -> DataFrame:
        """The rows with ``pos`` (from 0), ``before`` (weight of all earlier rows) and ``total`` (weight of the group)."""
        rows = self.rows if rows is None else rows
        keys = [*self.group, "_part"]
        runs = self.runs.withColumnsRenamed({k: f"_of_{k}" for k in keys})
        same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]  # a null group is one too
        out = rows.join(runs, same)
        out = out.withColumn("pos", F.col("_rows_before") + F.col("_row") - F.col("_first"))
        if self.weight:
            inside = Window.partitionBy(*keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
            out = out.withColumn("before", F.col("_weight_before") + F.coalesce(F.sum(self.weight).over(inside), F.lit(0)))
        else:
            out = out.withColumn("before", F.col("pos"))
        return out.select(*self.columns, "pos", "before", "total")

    def between(self, lo: int, hi: int) -> DataFrame:
        """Numbered rows of an ungrouped order whose weights overlap the ranks ``lo`` to ``hi`` (exclusive)."""
        # every partition named here holds at least one of the hi - lo ranks
        parts = [r._part for r in self.runs.where((F.col("_weight_before") < hi) & (F.col("_weight_before") + F.col("_weight") > lo)).select("_part").collect()]
        out = self.numbered(self.rows.where(F.col("_part").isin(parts)))
        return out.where((F.col("before") < hi) & (F.col("before") + F.col(self.weight) > lo))
