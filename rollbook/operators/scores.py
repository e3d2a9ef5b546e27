"""Vulnerability score, tiers and their aggregates (SC)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def risk_tier(score: Column) -> Column:
    return F.when(score >= 61, "CRITICAL").when(score >= 41, "HIGH").when(score >= 21, "MODERATE").otherwise("LOW")


def vulnerability(citizens: DataFrame, schemes: DataFrame, compat: bool = False) -> DataFrame:
    """Score of every citizen from age, gender and schemes.

    ``compat`` counts a scheme that is both active and closed twice.
    """
    name = F.lower("scheme_name")
    counted = F.countDistinct("scheme_id", "status") if compat else F.countDistinct("scheme_id")
    per_citizen = schemes.groupBy("uid").agg(
        counted.alias("n_schemes"),
        F.bool_or(F.contains(name, F.lit("widow"))).alias("has_widow"),
        F.bool_or(F.contains(name, F.lit("disab"))).alias("has_disab"),
        F.bool_or(F.contains(name, F.lit("bpl"))).alias("has_bpl"),
    )
    n = F.coalesce("n_schemes", F.lit(0))
    points = (
        F.when(F.col("age") > 80, 30).when(F.col("age") > 60, 20).when(F.col("age") < 5, 15).otherwise(0)
        + F.when(F.col("gender") == "FEMALE", 10).otherwise(0)
        + F.when(n == 0, 25).when(n == 1, 15).otherwise(0)
        + F.when(F.col("has_widow"), 10).otherwise(0)
        + F.when(F.col("has_disab"), 15).otherwise(0)
        + F.when(F.col("has_bpl"), 15).otherwise(0)
    )
    scored = citizens.join(per_citizen, "uid", "left").withColumn("vulnerability_score", points)
    return scored.withColumn("risk_tier", risk_tier(F.col("vulnerability_score"))).drop("n_schemes", "has_widow", "has_disab", "has_bpl")


def half_up(c: Column, digits: int) -> Column:
    """Rounded half up the way the score reports do it: scale, round, scale back."""
    f = 10 ** digits
    return F.floor(c * f + 0.5) / f


def global_stats(scored: DataFrame) -> DataFrame:
    s = F.col("vulnerability_score")
    return scored.agg(
        F.count("*").alias("total_citizens"),
        half_up(F.coalesce(F.avg(s), F.lit(0.0)), 1).alias("avg_vulnerability"),
        F.count_if(s >= 61).alias("critical_count"),
        F.count_if((s >= 41) & (s < 61)).alias("high_risk_count"),
        F.count_if(F.col("gender") == "FEMALE").alias("female_count"),
    )


def district_stats_cached(scored: DataFrame, places: DataFrame) -> DataFrame:
    """Counts per district through the residence path: residences, not distinct citizens."""
    return (
        places.select("uid", "gp_code", "block_code", "district_code").distinct()
        .join(scored.select("uid", "vulnerability_score", "risk_tier"), "uid")
        .groupBy("district_code").agg(
            F.count("*").alias("citizen_count"),
            half_up(F.avg("vulnerability_score"), 1).alias("avg_risk_score"),
            F.count_if(F.col("risk_tier") == "CRITICAL").alias("critical_count"),
            F.count_if(F.col("risk_tier") == "HIGH").alias("high_count"),
        )
    )


def high_risk() -> Column:
    return (
        F.col("risk_tier").isin("HIGH", "CRITICAL") | (F.col("vulnerability_score") >= 60)
        | F.coalesce("is_ghost_flag", F.lit(False)) | F.coalesce("is_dup_flag", F.lit(False))
    )


def gp_risk(citizens: DataFrame, resides: DataFrame) -> DataFrame:
    both = resides.select("uid", "gp_code").distinct().join(citizens, "uid")
    return both.groupBy("gp_code").agg(
        F.countDistinct("uid").alias("total_citizens"),
        F.countDistinct(F.when(high_risk(), F.col("uid"))).alias("high_risk_count"),
    ).withColumn(
        "high_risk_pct", F.when(F.col("total_citizens") > 0, F.col("high_risk_count") / F.col("total_citizens")).otherwise(0.0)
    )
