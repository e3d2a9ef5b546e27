"""Validation and quality reports over the person and enrollment tables (QA)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .registry import unmatched

MEMBER, CARD, DISTRICT = "ration_card_memberid", "ration_card_number", "lgd_district_code"


def in_district(df: DataFrame, district: int | None) -> DataFrame:
    return df if district is None else df.where(F.col(DISTRICT) == district)


def one_row(*parts: DataFrame) -> DataFrame:
    """Single-row aggregates with different columns side by side, as a union and no join."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def total(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(name))


def person_row_count(pd: DataFrame, district: int | None = None) -> DataFrame:
    return total(in_district(pd, district), "person_detail_count")


def duplicates(df: DataFrame, keys: list[str], n: int = 100) -> DataFrame:
    return (
        df.groupBy(*keys).agg(F.count("*").alias("duplicate_count")).where("duplicate_count > 1")
        .orderBy(F.desc("duplicate_count"), *keys).limit(n)
    )


def unmatched_count(pd: DataFrame, benef: DataFrame, name: str, district: int | None = None) -> DataFrame:
    """Rows of a source without a person, against the persons of all districts."""
    return total(unmatched(pd, in_district(benef, district)), name)


def family_sample(pd: DataFrame, n: int = 20) -> DataFrame:
    return (
        pd.groupBy(CARD).agg(F.count("*").alias("family_size"))
        .orderBy(F.desc("family_size"), F.asc_nulls_last(CARD)).limit(n)
    )


def pilot_summary(pd: DataFrame, pse: DataFrame, status: DataFrame, district: int) -> DataFrame:
    """Six scalars of one district; the duplicate counts cover all districts."""
    here = in_district(pd, district)
    sizes = here.groupBy(CARD).agg(F.count("*").alias("family_size"))
    dup_p = pd.groupBy(MEMBER).count().where("count > 1")
    dup_e = pse.groupBy(MEMBER, "scheme_id").count().where("count > 1")
    return one_row(
        total(here, "person_count"),
        total(in_district(pse, district), "enrollment_count"),
        total(status, "eligibility_count"),
        total(dup_p, "person_duplicates"),
        total(dup_e, "enrollment_duplicates"),
        sizes.agg(F.coalesce(F.max("family_size"), F.lit(0)).alias("max_family_size")),
    ).withColumn("district_code", F.lit(district))


def coverage_counts(rc: DataFrame, pd: DataFrame, district: int) -> DataFrame:
    return one_row(
        in_district(rc, district).agg(
            F.countDistinct(MEMBER).alias("source_person_count"), F.countDistinct(CARD).alias("source_family_count")
        ),
        in_district(pd, district).agg(F.countDistinct(CARD).alias("output_family_count")),
    )


def persons_without_scheme(pd: DataFrame, pse: DataFrame, district: int) -> DataFrame:
    return total(in_district(pd, district).join(pse, MEMBER, "left_anti"), "person_without_scheme_count")


def partial_families(pd: DataFrame, pse: DataFrame, scheme: str, district: int) -> DataFrame:
    target = pse.where(F.col("scheme_id") == scheme).select(MEMBER, "scheme_id")
    families = (
        in_district(pd, district).join(target, MEMBER, "left").groupBy(CARD)
        .agg(F.count_if(F.col("scheme_id") == scheme).alias("inside"), F.count_if(F.col("scheme_id").isNull()).alias("outside"))
        .where("inside > 0 AND outside > 0")
    )
    return total(families, "families_with_partial_coverage")


def largest_families(pd: DataFrame, pse: DataFrame, scheme: str, district: int, n: int = 5) -> DataFrame:
    """Largest families first, then their scheme counts: only n families reach the joins."""
    here = in_district(pd, district)
    base = (
        here.groupBy(CARD).agg(F.count("*").alias("family_size"), F.count_if(F.col("is_hof") == 1).alias("hof_count"))
        .orderBy(F.desc("family_size"), F.asc_nulls_last(CARD)).limit(n)
    )
    # n rows by the limit above
    members = here.select(CARD, MEMBER).join(F.broadcast(base.select(CARD)), CARD)
    schemes = members.join(pse.select(MEMBER, "scheme_id"), MEMBER).groupBy(CARD).agg(
        F.countDistinct(F.when(F.col("scheme_id") == scheme, F.col(MEMBER))).alias("members_in_scheme"),
        F.countDistinct("scheme_id").alias("distinct_schemes"),
    )
    zero = F.lit(0).cast("bigint")
    return base.join(schemes, CARD, "left").select(
        CARD, "family_size", "hof_count",
        F.coalesce("members_in_scheme", zero).alias("members_in_scheme"),
        F.coalesce("distinct_schemes", zero).alias("distinct_schemes"),
    )


def scheme_mix(pse: DataFrame, district: int, n: int = 10) -> DataFrame:
    return (
        in_district(pse, district).groupBy("scheme_id", "scheme_type").agg(F.count("*").alias("member_count"))
        .orderBy(F.desc("member_count"), "scheme_id", "scheme_type").limit(n)
    )


def build_checks(summary: DataFrame, coverage: DataFrame) -> DataFrame:
    return one_row(summary, coverage).select(
        (F.col("person_count") == F.col("source_person_count")).alias("person_count_matches_source"),
        (F.col("output_family_count") == F.col("source_family_count")).alias("family_count_matches_source"),
        (F.col("person_duplicates") == 0).alias("person_duplicates_zero"),
        (F.col("enrollment_duplicates") == 0).alias("enrollment_duplicates_zero"),
        (F.col("eligibility_count") == 0).alias("eligibility_pending"),
    )


def lookup_misses(pd: DataFrame, benef: DataFrame) -> DataFrame:
    """Rows missed by a uid lookup and then by a member lookup, uid present or not."""
    by_uid = pd.where("uid IS NOT NULL").select(F.col("uid").alias("p_uid"))
    by_member = pd.select(F.col(MEMBER).alias("p_member"))
    return benef.join(by_uid, F.col("uid") == F.col("p_uid"), "left_anti").join(
        by_member, F.col(MEMBER) == F.col("p_member"), "left_anti"
    )


def match_rate(missed: Column, rows: Column) -> Column:
    return F.when(rows > 0, F.round((1 - missed / rows) * 100, 2))


def join_loss(pd: DataFrame, cash: DataFrame, health: DataFrame, district: int) -> DataFrame:
    """Join loss of both sources against the persons of the same district."""
    here = in_district(pd, district)
    parts = []
    for name, src in (("cash", cash), ("health", health)):
        rows = in_district(src, district)
        parts += [total(lookup_misses(here, rows), f"unmatched_{name}_rows"), total(rows, f"{name}_source_rows")]
    out = one_row(*parts)
    for name in ("cash", "health"):
        out = out.withColumn(f"{name}_match_rate_pct", match_rate(F.col(f"unmatched_{name}_rows"), F.col(f"{name}_source_rows")))
    return out.withColumn("district_code", F.lit(district))


def rollout_summary(pd: DataFrame, pse: DataFrame, status: DataFrame, pilot: int) -> DataFrame:
    other = F.col(DISTRICT) != pilot
    return one_row(
        pd.agg(
            F.count("*").alias("person_count"),
            F.countDistinct(CARD).alias("family_count"),
            F.countDistinct(DISTRICT).alias("person_district_count"),
            F.count_if(other).alias("non_pilot_person_count"),
        ),
        pse.agg(
            F.count("*").alias("enrollment_count"),
            F.countDistinct(DISTRICT).alias("enrollment_district_count"),
            F.count_if(other).alias("non_pilot_enrollment_count"),
        ),
        total(status, "eligibility_count"),
    ).withColumn("full_rollout_detected", F.col("non_pilot_person_count") > 0)


def top_districts(pd: DataFrame, n: int = 10) -> DataFrame:
    return (
        pd.groupBy(DISTRICT).agg(F.count("*").alias("person_count"))
        .orderBy(F.desc("person_count"), F.asc_nulls_last(DISTRICT)).limit(n)
    )


def district_stats(benef: DataFrame, district: int) -> DataFrame:
    return in_district(benef, district).agg(
        F.count("*").alias("total_beneficiaries"),
        F.count_if(F.col("gender") == "FEMALE").alias("female_count"),
        F.count_if(F.col("gender") == "MALE").alias("male_count"),
    )
