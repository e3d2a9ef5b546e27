"""Whole runs: the batch rule set and the sync, each reported as one table of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.ranking import pair_count
from ..operators import flags as fl
from ..operators import graph as g
from ..operators import rules as r
from ..operators.quality import one_row


def _step(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias("cases")).select(F.lit(name).alias("step"), "cases")


def run_batch(s, people: DataFrame) -> DataFrame:
    """Quality, score, rules A, B, C, E, F, H and I in order; all cases per step and the alert total.

    F1 and H1 read the flag state of the last sync, not the flags of this run.
    """
    quality = r.data_quality(people, s.as_of).select(F.concat(F.lit("quality:"), "check").alias("step"), F.col("issue_count").alias("cases"))
    total_of = F.coalesce(F.sum("cases"), F.lit(0).cast("bigint")).alias("cases")
    people_rules = [df.agg(total_of).select(F.lit(rule).alias("step"), "cases") for rule, df in s.batch().items()]
    others = {"C1": r.rule_c1(s.scored, s.places, None), "E1": r.overloaded_cards(s.member_of), "F1": r.suspicious_operators(s.operators, s.state)}
    alerts = fl.union(*people_rules, *[_step(df, rule) for rule, df in others.items()])
    total = alerts.agg(F.sum("cases").alias("cases")).select(F.lit("total_fraud_alerts").alias("step"), "cases")
    return fl.union(quality, _step(s.scored, "scored"), alerts, total)


def run_sync(s) -> DataFrame:
    """Profiles, payouts, rollups, scores and sync rules; clusters and pairs in their own columns.

    The pairs of I1 are counted as the sync reports them: members that come first in a pair plus
    members that come second.
    """
    none = F.lit(None).cast("bigint")

    def plain(df: DataFrame, name: str) -> DataFrame:
        return _step(df, name).withColumn("pairs", none)

    def grouped(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
        return sizes.agg(F.count("*").alias("cases"), F.coalesce(F.sum(pair_count(F.col("n"))), F.lit(0).cast("bigint")).alias("pairs")).select(F.lit(name).alias("step"), "cases", "pairs")

    flags = s.flags.groupBy("rule").agg(F.count("*").alias("cases"))
    kinds = [r_ for r_ in fl.SYNC_FLAGS if r_ != "I1"]
    # rules without a hit still report a zero
    wanted = s.spark.createDataFrame([(k,) for k in kinds], "step string")
    per_rule = wanted.join(flags.withColumnRenamed("rule", "step"), "step", "left").select("step", F.coalesce("cases", F.lit(0).cast("bigint")).alias("cases"), none.alias("pairs"))
    shared = r.shared_member_ids(s.member_of)
    sizes = shared.groupBy("ration_card_number", "member_id").agg(F.count("*").alias("n"), F.min("uid").alias("lo"), F.max("uid").alias("hi"))
    # first ends: members that are not the last of their group; second ends: not the first
    ends = shared.join(sizes, ["ration_card_number", "member_id"]).agg(
        (F.countDistinct(F.when(F.col("uid") < F.col("hi"), F.col("uid"))) + F.countDistinct(F.when(F.col("uid") > F.col("lo"), F.col("uid")))).alias("cases"))
    i1 = one_row(grouped(shared, ["ration_card_number", "member_id"], "I1").drop("cases"), ends).select("step", "cases", "pairs")
    return fl.union(
        plain(s.profile, "profiles"), plain(g.payout_windows(s.txn), "payout_windows"), plain(s.scored, "scored"),
        grouped(s.dup, ["cluster_id", "name", "gender"], "B1"), grouped(s.dob, ["gp_code", "dob"], "B3"), per_rule, plain(s.c1, "C1"), i1,
    )
