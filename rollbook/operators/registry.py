"""Person, enrollment and curated profile tables (REG)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PERSON_DETAIL = [
    "ration_card_memberid", "ration_card_number", "ration_card_type_code", "uid",
    "uid_verified_status", "fullname", "member_dob", "gender", "caste", "disability_type",
    "mobile", "is_hof", "hof_member_id", "relationship_hof", "father_name", "mother_name",
    "spouse_name", "rc_member_status", "rc_approval_date", "rc_closure_date",
    "lgd_district_code", "lgd_district_name", "lgd_block_code", "lgd_block_name",
    "lgd_gp_code", "lgd_gp_name", "address",
]

ENROLLMENT = [
    "ration_card_memberid", "scheme_id", "scheme_type", "scheme_beneficiary_id",
    "enrollment_status", "enrollment_grade", "approved_date", "closing_date",
    "total_amount_received", "installment_count", "first_payment_date", "last_payment_date",
    "lgd_district_code",
]


def first_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key. The rank filter is pushed below the shuffle as a group limit, so a
    task sends at most one row per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def person_columns(rc: DataFrame) -> DataFrame:
    """Renames and the caste and disability choices of the person table."""
    caste = F.coalesce(F.nullif(F.col("caste_as_caste_data"), F.lit("")), F.col("caste"))
    return (
        rc.withColumn("caste", caste)
        .withColumnRenamed("reserve_field1", "disability_type")
        .withColumnRenamed("member_status", "rc_member_status")
        .withColumn("rc_approval_date", F.col("entry_ts"))
        .withColumn("rc_closure_date", F.when(F.col("rc_member_status") == "INACTIVE", F.col("modify_ts")))
    )


def build_person_detail(rc: DataFrame, district: int | None = None) -> DataFrame:
    """Latest row per member; ties by uid, then name."""
    rows = rc if district is None else rc.where(F.col("lgd_district_code") == district)
    rows = rows.where(F.col("ration_card_memberid").isNotNull())
    latest = first_row(
        rows,
        ["ration_card_memberid"],
        [F.col("entry_ts").desc_nulls_last(), F.col("uid").asc_nulls_last(), F.col("fullname").asc_nulls_last()],
    )
    return person_columns(latest).select(*PERSON_DETAIL)


def match_identity(persons: DataFrame, benef: DataFrame) -> DataFrame:
    """Beneficiary rows with the member they belong to, as ``matched_memberid``.

    Equal uid when both have one, else equal member id. Written as two equi joins: an OR in the
    join condition would plan a nested loop. The halves cannot overlap, since the second one
    keeps only pairs with a null uid on either side.
    """
    p = persons.select(
        F.col("ration_card_memberid").alias("matched_memberid"), F.col("uid").alias("matched_uid"),
        F.col("lgd_district_code").alias("matched_district"),
    )
    by_uid = benef.join(p, F.col("uid") == F.col("matched_uid"))
    by_member = benef.join(p, F.col("ration_card_memberid") == F.col("matched_memberid")).where(
        F.col("uid").isNull() | F.col("matched_uid").isNull()
    )
    return by_uid.unionByName(by_member)


def unmatched(persons: DataFrame, benef: DataFrame) -> DataFrame:
    """Beneficiary rows that ``match_identity`` finds no member for, as chained anti joins."""
    by_uid = persons.where("uid IS NOT NULL").select(F.col("uid").alias("p_uid"))
    members = persons.select(F.col("ration_card_memberid").alias("p_member"), F.col("uid").alias("p_uid2"))
    rest = benef.join(by_uid, F.col("uid") == F.col("p_uid"), "left_anti")
    return rest.join(
        members,
        (F.col("ration_card_memberid") == F.col("p_member")) & (F.col("uid").isNull() | F.col("p_uid2").isNull()),
        "left_anti",
    )


def cash_rollup(txn: DataFrame) -> DataFrame:
    return txn.groupBy("scheme_beneficiary_id", "scheme_id").agg(*_payment_aggregates())


def claim_rollup(txn: DataFrame) -> DataFrame:
    """Claims roll up by beneficiary alone; the scheme is not part of the key."""
    return txn.groupBy("scheme_beneficiary_id").agg(*_payment_aggregates())


def _payment_aggregates() -> list[Column]:
    return [
        F.sum("amount").alias("total_amount"),
        F.count("*").alias("installments"),
        F.min("transaction_timestamp").alias("first_payment_date"),
        F.max("transaction_timestamp").alias("last_payment_date"),
    ]


def newest() -> list[Column]:
    return [F.col("approved_date").desc_nulls_last(), F.col("scheme_beneficiary_id").asc_nulls_last(), F.col("sl_no").asc_nulls_last()]


def _enrollments(rc, benef, rollup, keys, scheme_type, district) -> DataFrame:
    if district is not None:
        benef = benef.where(F.col("lgd_district_code") == district)
    matched = match_identity(rc, benef).where(F.col("matched_memberid").isNotNull())
    # One row per (member, scheme) before the payments join: the loser rows need no payments.
    kept = first_row(
        matched, ["matched_memberid", "scheme_id"], newest()
    )
    return kept.join(rollup, keys, "left").select(
        F.col("matched_memberid").alias("ration_card_memberid"),
        "scheme_id",
        F.lit(scheme_type).alias("scheme_type"),
        "scheme_beneficiary_id",
        F.when(F.col("closing_date").isNull(), "ACTIVE").otherwise("CLOSED").alias("enrollment_status"),
        F.col("grade").alias("enrollment_grade"),
        "approved_date",
        "closing_date",
        F.coalesce("total_amount", F.lit(0).cast("decimal(28,2)")).alias("total_amount_received"),
        F.coalesce("installments", F.lit(0).cast("bigint")).alias("installment_count"),
        "first_payment_date",
        "last_payment_date",
        "lgd_district_code",
    )


def cash_enrollments(rc, benef, txn, district: int | None = None) -> DataFrame:
    keys = ["scheme_beneficiary_id", "scheme_id"]
    return _enrollments(rc, benef, cash_rollup(txn), keys, "CASH", district)


def health_enrollments(rc, benef, txn, district: int | None = None) -> DataFrame:
    keys = ["scheme_beneficiary_id"]
    return _enrollments(rc, benef, claim_rollup(txn), keys, "SWASTHYA_SATHI", district)


def build_enrollments(cash_rows: DataFrame, health_rows: DataFrame) -> DataFrame:
    """One row per (member, scheme) of both kinds: the latest approval, cash first on a tie."""
    both = cash_rows.unionByName(health_rows).where(F.col("ration_card_memberid").isNotNull())
    order = [F.col("approved_date").desc_nulls_last(), F.col("scheme_type").asc()]
    return first_row(both, ["ration_card_memberid", "scheme_id"], order).select(*ENROLLMENT)


def enrollment_eligibility(person_detail, enrollments, status) -> DataFrame:
    person = person_detail.drop("uid", "uid_verified_status", "mobile", "father_name", "mother_name",
                                "spouse_name", "rc_approval_date", "rc_closure_date", "address")
    return person.join(enrollments.drop("lgd_district_code", "scheme_beneficiary_id"), "ration_card_memberid").join(
        status, ["ration_card_memberid", "scheme_id"], "left"
    )


# Columns whose presence counts towards the completeness of a beneficiary row.
COMPLETENESS = ["fullname", "gender", "member_dob", "mobile", "ration_card_number", "ration_card_memberid",
                "approved_date", "lgd_district_code"]


def completeness(cols: list[str] = COMPLETENESS) -> Column:
    filled = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1).otherwise(0) for c in cols]
    return sum(filled[1:], filled[0])


PROFILE_KEY = ["uid", "scheme_beneficiary_id"]



def profile_order() -> list[Column]:
    latest = [F.col(c).desc_nulls_last() for c in ("modify_ts", "entry_ts", "approved_date")]
    return [*latest, F.col("completeness_score").desc(), F.col("source_priority").asc(), F.col("sl_no").asc()]


def valid_key() -> Column:
    return (F.coalesce(F.trim("uid"), F.lit("")) != "") & (F.coalesce(F.trim("scheme_beneficiary_id"), F.lit("")) != "")


def build_profile(benef: DataFrame) -> DataFrame:
    """Winning row per (uid, beneficiary id) with its group size and completeness score."""
    rows = benef.where(valid_key()).withColumn("completeness_score", completeness())
    # The size comes from a partial aggregate, the winner from a group limit: neither holds a group.
    sizes = rows.groupBy(*PROFILE_KEY).agg(F.count("*").alias("duplicate_group_size"))
    return first_row(rows, PROFILE_KEY, profile_order()).join(sizes, PROFILE_KEY)


def _mixed_values(rows: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Keys with two different values of ``col``; min and max combine before the shuffle."""
    return rows.groupBy(*keys).agg(F.min(col).alias("_a"), F.max(col).alias("_b")).where("_a <> _b").select(*keys)


def build_skipped(benef: DataFrame, persons: DataFrame, txn: DataFrame) -> DataFrame:
    """Rows kept out of the profile or in doubt, one row per (source row, reason)."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    ref = F.col("sl_no").cast("string").alias("source_ref")

    def reason(df: DataFrame, code: str) -> DataFrame:
        return df.select(ref, F.lit(code).alias("reason"))

    no_uid, no_benef = blank("uid"), blank("scheme_beneficiary_id")
    key_reason = (
        F.when(no_uid & no_benef, "INVALID_KEY_COMBINATION")
        .when(no_uid, "MISSING_UID")
        .when(no_benef, "MISSING_SCHEME_BENEFICIARY_ID")
    )
    keyless = benef.select(ref, key_reason.alias("reason")).where("reason IS NOT NULL")

    rows = benef.where(valid_key())
    winners = build_profile(benef).select(F.col("sl_no").alias("win_no"))
    losers = rows.join(winners, F.col("sl_no") == F.col("win_no"), "left_anti")
    schemes = rows.join(_mixed_values(rows, PROFILE_KEY, "scheme_id"), PROFILE_KEY, "left_semi")
    identity = _mixed_values(rows, ["uid"], "member_dob").unionByName(_mixed_values(rows, ["uid"], "gender")).distinct()
    personal = rows.join(identity, "uid", "left_semi")
    # Several source members under one member id cannot be told apart by the fallback match.
    ambiguous = persons.groupBy("ration_card_memberid").count().where("count > 1").select("ration_card_memberid")
    doubtful = benef.where("uid IS NULL").join(ambiguous, "ration_card_memberid", "left_semi")
    paid = txn.join(
        rows.select("scheme_beneficiary_id", "scheme_id"), ["scheme_beneficiary_id", "scheme_id"], "left_anti"
    ).select(F.col("transaction_ref_no").alias("source_ref"), F.lit("NO_BENEFICIARY_MATCH_FOR_TRANSACTION").alias("reason"))
    parts = [
        keyless,
        reason(losers, "DUPLICATE_LOSER"),
        reason(schemes, "CONFLICTING_SCHEME_ID"),
        reason(personal, "CONFLICTING_PERSONAL_DATA"),
        reason(doubtful, "AMBIGUOUS_RC_MATCH"),
        paid,
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def full_view(profile: DataFrame, txn: DataFrame) -> DataFrame:
    keys = ["uid", "scheme_id", "scheme_beneficiary_id"]
    return profile.join(txn.drop("lgd_district_code"), keys, "left")
