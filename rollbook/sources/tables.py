"""Registry families read from the given tables.

The views below derive registry-shaped rows from the star schema with integer arithmetic on the
keys, so each grows with its input. Only ``nation`` and ``region`` (25 and 5 rows) are broadcast;
names come from all of ``part`` by an equi join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

HEALTH_SCHEME = "S767"

# Scheme codes and their names.
SCHEME_NAMES = [
    ("S101", "Old Age Pension"),
    ("S102", "Widow Support"),
    ("S103", "Disability Allowance BPL"),
    ("S767", "Health Card"),
    ("C501", "Vivah Scholarship APL"),
    ("S900", "Local Employment"),
]

PERSON_COLUMNS = {
    "c_custkey": "c_custkey",
    "uid": "CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE concat('U', cast(100000000000 + c_custkey AS string)) END",
    "ration_card_memberid": "CASE WHEN c_custkey % 29 = 1 THEN concat('M', cast(c_custkey - 1 AS string)) ELSE concat('M', cast(c_custkey AS string)) END",
    "ration_card_number": "CASE WHEN c_custkey % 100 < 15 THEN concat('RX', cast(cast(floor(c_custkey / 100) AS int) AS string)) ELSE concat('R', cast(cast(floor(c_custkey / 4) AS int) AS string)) END",
    "ration_card_type_code": "CASE WHEN c_custkey % 2 = 0 THEN 'PHH' ELSE 'AAY' END",
    "uid_verified_status": "cast(c_custkey % 2 AS int)",
    "fullname": "upper(concat(p_name, CASE WHEN c_custkey % 7 = 0 THEN 's' ELSE '' END))",
    "member_dob": "CASE WHEN c_custkey % 41 = 0 THEN NULL WHEN c_custkey % 43 = 0 THEN '' WHEN c_custkey % 47 = 0 THEN '1900-01-01' WHEN c_custkey % 97 = 0 THEN '2031-01-01' ELSE cast(DATE '1905-01-01' + cast(1500 * (CASE WHEN c_nationkey % 5 = 0 THEN c_custkey % 15 ELSE c_custkey % 30 END) AS int) AS string) END",
    "gender": "CASE WHEN c_custkey % 53 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'MALE' ELSE 'FEMALE' END",
    "caste_as_caste_data": "CASE WHEN c_custkey % 11 = 0 THEN 'OBC-B' WHEN c_custkey % 13 = 0 THEN '' END",
    "caste": "CASE c_custkey % 5 WHEN 0 THEN 'OBC-A' WHEN 1 THEN 'SC' WHEN 2 THEN 'EBC' WHEN 3 THEN '' ELSE 'General' END",
    "reserve_field1": "CASE WHEN c_custkey % 17 = 0 THEN 'LOCOMOTOR' END",
    "mobile": "CASE WHEN c_custkey % 6 = 0 THEN '' ELSE concat('9', cast(c_custkey % 700 AS string)) END",
    "is_hof": "CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END",
    "hof_member_id": "concat('M', cast(c_custkey - c_custkey % 4 AS string))",
    "relationship_hof": "CASE WHEN c_custkey % 4 = 0 THEN 'SELF' ELSE 'MEMBER' END",
    "father_name": "cast(NULL AS string)",
    "mother_name": "cast(NULL AS string)",
    "spouse_name": "cast(NULL AS string)",
    "member_status": "CASE WHEN c_custkey % 19 = 0 THEN 'INACTIVE' WHEN c_custkey % 23 = 0 THEN '' ELSE 'ACTIVE' END",
    "closure_remarks": "CASE WHEN c_custkey % 31 = 0 THEN 'Retired from service' WHEN c_custkey % 37 = 0 THEN 'Transfer of unit' END",
    "entry_ts": "CASE WHEN c_custkey % 61 = 0 THEN NULL ELSE DATE '2023-01-01' + cast(c_custkey % 500 AS int) END",
    "modify_ts": "CASE WHEN c_custkey % 2 = 0 THEN DATE '2023-06-01' + cast(c_custkey % 300 AS int) END",
    "entry_by": "concat('OP', cast(c_custkey % 20 AS string))",
    "address": "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE concat(' lane ', cast(c_custkey % 800 AS string), ' ') END",
    "annual_income": "CASE WHEN c_custkey % 8 = 0 THEN NULL WHEN c_custkey % 8 = 1 THEN '1.5 lakh' ELSE cast(60000 + (c_custkey % 40) * 5000 AS string) END",
    "is_disabled": "CASE WHEN c_custkey % 17 = 0 THEN 'Y' WHEN c_custkey % 17 = 1 THEN 'N' END",
    "disability_status": "CASE WHEN c_custkey % 17 = 1 THEN 'Y' WHEN c_custkey % 17 = 2 THEN 'NO' END",
    "marital_status": "CASE c_custkey % 4 WHEN 0 THEN 'Widow' WHEN 1 THEN 'Married' WHEN 2 THEN 'Unmarried' END",
    "lgd_district_code": "r_regionkey",
    "lgd_district_name": "r_name",
    "lgd_block_code": "r_regionkey * 10 + c_nationkey % 2",
    "lgd_block_name": "concat('BLOCK_', cast(r_regionkey * 10 + c_nationkey % 2 AS string))",
    "lgd_gp_code": "c_nationkey",
    "lgd_gp_name": "n_name",
}

BENEFICIARY_COLUMNS = {
    "sl_no": "o_orderkey",
    "scheme_id": "CASE WHEN lgd_gp_code = 3 AND o_orderkey % 3 = 0 THEN 'S900' WHEN o_orderpriority = '1-URGENT' THEN 'S101' WHEN o_orderpriority = '2-HIGH' THEN 'S102' WHEN o_orderpriority = '3-MEDIUM' THEN 'S103' WHEN o_orderpriority = '5-LOW' THEN 'C501' ELSE 'S767' END",
    "scheme_beneficiary_id": "CASE WHEN o_orderkey % 101 = 1 THEN concat('B', cast(o_orderkey - 1 AS string)) ELSE concat('B', cast(o_orderkey AS string)) END",
    "approved_date": "cast(o_orderdate AS date)",
    "closing_date": "CASE WHEN o_orderstatus = 'F' THEN cast(o_orderdate AS date) + 365 END",
    "grade": "cast(o_orderkey % 5 AS int)",
}

TRANSACTION_COLUMNS = {
    "uid": "uid",
    "scheme_id": "scheme_id",
    "scheme_beneficiary_id": "scheme_beneficiary_id",
    "lgd_district_code": "lgd_district_code",
    "transaction_ref_no": "concat(cast(l_orderkey AS string), '-', cast(l_linenumber AS string))",
    "amount": "cast(l_extendedprice AS decimal(18,2))",
    "transaction_timestamp": "l_shipdate",
    "financial_year": "cast(year(l_shipdate) AS string)",
    "installment_year": "cast(year(l_shipdate) AS string)",
    "installment_month_code": "lpad(cast(month(l_shipdate) AS string), 2, '0')",
    "installment_month": "cast(NULL AS string)",
    "source_sl_no": "l_linenumber",
}


def _exprs(cols: dict[str, str]) -> list:
    return [F.expr(sql).alias(name) for name, sql in cols.items()]


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scheme_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCHEME_NAMES, "scheme_id string, scheme_name string")


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per registered member (role of the ration-card beneficiary family)."""
    places = raw(spark, sf_dir, "nation").join(
        F.broadcast(raw(spark, sf_dir, "region")), F.expr("n_regionkey = r_regionkey")
    )
    # There are four parts to three customers at every scale; a customer without one has no name.
    names = raw(spark, sf_dir, "part").select("p_partkey", "p_name")
    return (
        raw(spark, sf_dir, "customer")
        .join(F.broadcast(places), F.expr("c_nationkey = n_nationkey"))
        .join(names, F.expr("p_partkey = c_custkey"), "left")
        .select(*_exprs(PERSON_COLUMNS))
    )


def beneficiaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheme beneficiary rows of all families with the member's columns beside them."""
    orders = raw(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority"
    )
    person = persons(spark, sf_dir)
    both = orders.join(person, F.expr("o_custkey = c_custkey"))
    return both.select(*[F.col(c) for c in PERSON_COLUMNS], *_exprs(BENEFICIARY_COLUMNS))


def source_beneficiaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beneficiary rows as the sources deliver them: some uids missing, some keys unknown or blank."""
    return beneficiaries(spark, sf_dir).select(
        "sl_no",
        F.expr("CASE WHEN sl_no % 37 = 3 THEN NULL WHEN sl_no % 211 = 5 THEN concat('Z', uid) ELSE uid END").alias("uid"),
        F.expr("CASE WHEN sl_no % 211 = 5 THEN concat('Z', ration_card_memberid) ELSE ration_card_memberid END").alias("ration_card_memberid"),
        "lgd_district_code",
        "scheme_id",
        F.expr("CASE WHEN sl_no % 307 = 7 THEN '' ELSE scheme_beneficiary_id END").alias("scheme_beneficiary_id"),
        "grade",
        "approved_date",
        "closing_date",
        "fullname",
        "gender",
        "member_dob",
        "mobile",
        "ration_card_number",
        F.expr("CASE WHEN sl_no % 3 = 0 THEN NULL ELSE approved_date + 10 END").alias("modify_ts"),
        F.expr("approved_date + cast(sl_no % 4 AS int)").alias("entry_ts"),
        F.expr(f"CASE WHEN scheme_id = '{HEALTH_SCHEME}' THEN 2 ELSE 1 END").alias("source_priority"),
    )


def transactions(spark: SparkSession, sf_dir: str, *more: str, dealt: int | None = None) -> DataFrame:
    """One row per payout event; ``more`` names beneficiary columns to keep. ``dealt`` deals the events out to so many partitions."""
    items = raw(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate"
    )
    # Only the key columns of the beneficiary are needed; the planner prunes the rest.
    both = items.join(beneficiaries(spark, sf_dir), F.expr("l_orderkey = sl_no"))
    if dealt:
        # shuffled before the texts are made, which are longer than what they are made of
        row = [F.expr(TRANSACTION_COLUMNS[c]) for c in ("transaction_ref_no", "source_sl_no")]
        both = both.repartition(dealt, F.xxhash64(*row))
    return both.select(*_exprs(TRANSACTION_COLUMNS), *more)


def payment_rollup(payments: DataFrame, source: str) -> DataFrame:
    """Payments added up per (scheme_beneficiary_id, scheme_id).

    The payments of one ``source`` row lie in one partition after their join, so they are added up there
    without a shuffle; only one row per source row, not one per payment and month, goes to the key.
    """
    keys = ["scheme_beneficiary_id", "scheme_id"]
    latest = F.struct("transaction_timestamp", "source_sl_no", "transaction_ref_no")
    # a month code has two digits, so the text is one of the pair
    month = F.concat("installment_year", F.lit("-"), "installment_month_code")
    per_source = payments.groupBy(source, *keys).agg(
        F.count("*").alias("_n"), F.sum("amount").alias("_amount"), F.max(latest).alias("_latest"),
        F.max("transaction_timestamp").alias("_last"), F.min("transaction_timestamp").alias("_first"),
        F.collect_set(month).alias("_months"), F.collect_set("financial_year").alias("_years"),
        F.count_if(F.col("source_sl_no") % 2 == 1).alias("_odd"), F.count_if(F.col("source_sl_no") % 2 == 0).alias("_even"),
    )

    def every(c: str) -> Column:
        return F.array_distinct(F.flatten(F.collect_list(c)))

    return per_source.groupBy(*keys).agg(
        F.sum("_n").alias("transaction_rows"),
        F.sum("_amount").cast("decimal(28,2)").alias("transaction_total_amount"),
        F.max("_last").alias("latest_transaction_timestamp"),
        F.max("_latest")["transaction_ref_no"].alias("latest_transaction_ref_no"),
        F.min("_first").alias("first_transaction_timestamp"),
        F.size(every("_months")).cast("bigint").alias("installment_count"),
        F.array_join(F.sort_array(every("_years")), ",").alias("financial_years"),
        F.sum("_odd").alias("tran_count_1"),
        F.sum("_even").alias("tran_count_2"),
    )


def cash(df: DataFrame) -> DataFrame:
    return df.where(F.col("scheme_id") != HEALTH_SCHEME)


def health(df: DataFrame) -> DataFrame:
    return df.where(F.col("scheme_id") == HEALTH_SCHEME)


def registry_table(
    spark: SparkSession, sf_dir: str, name: str, district_code: int | None = None
) -> DataFrame:
    """Read one registry family, optionally one district of it."""
    families = {
        "rc_beneficiary": lambda: persons(spark, sf_dir),
        "scheme_beneficiary_cash": lambda: cash(source_beneficiaries(spark, sf_dir)),
        "scheme_transaction_cash_2526": lambda: cash(transactions(spark, sf_dir)),
        "swasthya_sathi_beneficiary": lambda: health(source_beneficiaries(spark, sf_dir)),
        "swasthya_sathi_transaction_2526": lambda: health(transactions(spark, sf_dir)),
    }
    df = families[name]()
    return df if district_code is None else df.where(F.col("lgd_district_code") == district_code)


def read_family(
    spark: SparkSession, path: str, district_code: int | None = None
) -> DataFrame:
    """A family stored as one dataset partitioned by district; the filter prunes folders."""
    df = spark.read.parquet(path)
    return df if district_code is None else df.where(F.col("lgd_district_code") == district_code)


def write_family(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("lgd_district_code").parquet(path)


def table_inventory(tables: DataFrame) -> DataFrame:
    """Tables and distinct schemes per family; a family name is the table name without its suffix."""
    family = F.regexp_replace("table_name", r"_(?:mask_\d+_\d+|mask_\d+|\d{3}_\d+|\d{3})$", "")
    return (
        tables.withColumn("family", family)
        .groupBy("family")
        .agg(
            F.countDistinct("table_name").alias("table_count"),
            F.countDistinct("scheme_id").alias("scheme_count"),
            F.count("*").alias("row_count"),
        )
    )


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated enrollment profile: beneficiary and member columns beside the payment rollup."""
    # The rollup key is shared by payments and profile, so both sides aggregate before they meet.
    rollup = payment_rollup(transactions(spark, sf_dir, "sl_no"), "sl_no")
    return (
        beneficiaries(spark, sf_dir)
        .join(rollup, ["scheme_beneficiary_id", "scheme_id"], "left")
        .withColumn("source_family", F.when(F.col("scheme_id") == HEALTH_SCHEME, "health").otherwise("cash"))
        .withColumn("source_table", F.concat_ws("_", F.col("source_family"), F.col("lgd_district_code").cast("string")))
        .withColumn("rc_match_type", F.when(F.col("uid").isNotNull(), "UID").otherwise("MEMBER"))
    )
