"""Node and edge tables of the identity graph and their rollups (GRA)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import age_years, iso_date


def text_or(c: str, default: str) -> Column:
    return F.trim(F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(default)))


def trimmed(c: str) -> Column:
    return text_or(c, "")


def null_if_blank(c: str) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def normalize_profile(df: DataFrame) -> DataFrame:
    """Trim, upper case and default the profile columns; build the enrollment key."""
    keep = [c for c in ("tran_count_1", "tran_count_2", "transaction_rows", "installment_count", "completeness_score") if c in df.columns]
    out = df.select(
        trimmed("uid").alias("uid"),
        trimmed("scheme_id").alias("scheme_id"),
        trimmed("scheme_beneficiary_id").alias("scheme_beneficiary_id"),
        F.concat_ws(":", trimmed("uid"), trimmed("scheme_beneficiary_id")).alias("enrollment_key"),
        F.when(F.col("closing_date").isNotNull(), "Closed").otherwise("Active").alias("enrollment_status"),
        trimmed("source_family").alias("source_family"),
        trimmed("source_table").alias("source_table"),
        F.upper(text_or("fullname", "UNKNOWN")).alias("fullname"),
        F.upper(trimmed("gender")).alias("gender"),
        F.nullif(F.col("member_dob").cast("string"), F.lit("")).alias("member_dob"),
        trimmed("mobile").alias("mobile"),
        trimmed("ration_card_number").alias("ration_card_number"),
        trimmed("ration_card_memberid").alias("ration_card_memberid"),
        F.upper(trimmed("address")).alias("address_sanitized"),
        F.coalesce(F.col("lgd_district_code").cast("string"), F.lit("")).alias("district_code"),
        text_or("lgd_district_name", "Unknown District").alias("district_name"),
        F.coalesce(F.col("lgd_block_code").cast("string"), F.lit("")).alias("block_code"),
        text_or("lgd_block_name", "Unknown Block").alias("block_name"),
        F.coalesce(F.col("lgd_gp_code").cast("string"), F.lit("")).alias("gp_code"),
        text_or("lgd_gp_name", "Unknown GP").alias("gp_name"),
        F.col("approved_date").cast("string").alias("approved_date"),
        F.col("closing_date").cast("string").alias("closing_date"),
        F.col("grade").cast("string").alias("grade"),
        null_if_blank("rc_match_type").alias("rc_match_type"),
        F.coalesce(F.col("transaction_total_amount").cast("decimal(28,2)"), F.lit(0).cast("decimal(28,2)")).alias("transaction_total_amount"),
        "latest_transaction_timestamp",
        null_if_blank("latest_transaction_ref_no").alias("latest_transaction_ref_no"),
        "first_transaction_timestamp",
        "financial_years",
        F.col("entry_by"),
        "row_no",
        *[F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias(c) for c in keep],
    )
    return out


# Row order of the profile read: later rows only fill gaps of earlier ones.
ROW_ORDER = ["scheme_id", "scheme_beneficiary_id", "row_no"]


def _first_set(c: str) -> Column:
    """First non-null value in row order, as a partial aggregate."""
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*ROW_ORDER)))


def citizen_nodes(profile: DataFrame, as_of: Column) -> DataFrame:
    nodes = profile.groupBy("uid").agg(
        _first_set("fullname").alias("name"),
        _first_set("gender").alias("gender"),
        _first_set("member_dob").alias("dob"),
        _first_set("mobile").alias("mobile"),
    )
    return nodes.withColumn("age", age_years(iso_date(F.col("dob")), as_of))


def geo_nodes(profile: DataFrame) -> DataFrame:
    """District, block and GP nodes; a name is the first set one, by text for a stable choice."""
    parts = []
    for label, col in (("District", "district"), ("Block", "block"), ("GP", "gp")):
        parts.append(
            profile.groupBy(F.col(f"{col}_code").alias("code")).agg(F.min(f"{col}_name").alias("name"))
            .select(F.lit(label).alias("label"), "code", "name")
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def edges(profile: DataFrame, src: str, dst: str, rel: str) -> DataFrame:
    return profile.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct().withColumn("rel", F.lit(rel))


def geo_edges(profile: DataFrame) -> DataFrame:
    """PART_OF between places and RESIDES_IN; a citizen may reside in two GPs."""
    return (
        edges(profile, "gp_code", "block_code", "GP_PART_OF_BLOCK")
        .unionByName(edges(profile, "block_code", "district_code", "BLOCK_PART_OF_DISTRICT"))
        .unionByName(edges(profile, "uid", "gp_code", "RESIDES_IN"))
    )


def scheme_nodes(profile: DataFrame, dim: DataFrame) -> DataFrame:
    """Schemes seen, named from the scheme dimension; an unknown one keeps its id as name."""
    seen = profile.select("scheme_id").distinct()
    return seen.join(dim, "scheme_id", "left").select(
        "scheme_id", F.coalesce("scheme_name", F.nullif(F.col("scheme_id"), F.lit("")), F.lit("Unknown Scheme")).alias("scheme_name")
    )


ENROLLMENT_FILL = ["approved_date", "closing_date", "grade", "rc_match_type", "transaction_rows",
                   "transaction_total_amount", "latest_transaction_timestamp", "latest_transaction_ref_no",
                   "first_transaction_timestamp", "installment_count", "financial_years", "tran_count_1",
                   "tran_count_2"]


def enrollment_nodes(profile: DataFrame) -> DataFrame:
    """One node per enrollment key. On a repeat the status is the last one and every other value
    is the last one set; identity columns stay those of the first row."""
    order = F.struct(*ROW_ORDER)

    def last_set(c: str) -> Column:
        return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c)

    # Keys hardly repeat, and a partial aggregate carries the row order once per column: the rows themselves are the smaller shuffle.
    rows = profile.select("enrollment_key", *ROW_ORDER, "uid", "source_family", "enrollment_status", *ENROLLMENT_FILL).repartition("enrollment_key")
    return rows.groupBy("enrollment_key").agg(
        F.min_by("uid", order).alias("uid"),
        F.min_by("scheme_id", order).alias("scheme_id"),
        F.min_by("scheme_beneficiary_id", order).alias("scheme_beneficiary_id"),
        F.min_by("source_family", order).alias("source_family"),
        F.max_by("enrollment_status", order).alias("status"),
        *[last_set(c) for c in ENROLLMENT_FILL],
    )


def enrollment_edges(profile: DataFrame) -> DataFrame:
    """HAS_ENROLLMENT and the two ENROLLED_IN kinds, unique per (source, target, status)."""
    none = F.lit(None).cast("string")
    has = profile.select(F.lit("HAS_ENROLLMENT").alias("rel"), F.col("uid").alias("src"), F.col("enrollment_key").alias("dst"), none.alias("status"))
    of = profile.select(F.lit("ENROLLMENT_ENROLLED_IN").alias("rel"), F.col("enrollment_key").alias("src"), F.col("scheme_id").alias("dst"), F.col("enrollment_status").alias("status"))
    direct = profile.select(F.lit("ENROLLED_IN").alias("rel"), F.col("uid").alias("src"), F.col("scheme_id").alias("dst"), F.col("enrollment_status").alias("status"))
    return has.unionByName(of).unionByName(direct).distinct()


def citizen_schemes(profile: DataFrame, schemes: DataFrame) -> DataFrame:
    """ENROLLED_IN of citizens with the scheme name, unique per (citizen, scheme, status)."""
    pairs = profile.select("uid", "scheme_id", F.col("enrollment_status").alias("status")).distinct()
    return pairs.join(schemes, "scheme_id")


def member_of(profile: DataFrame) -> DataFrame:
    """Citizen to ration card, with the member id set last."""
    return (
        profile.where("ration_card_number <> ''").groupBy("uid", "ration_card_number")
        .agg(F.max_by("ration_card_memberid", F.struct(*ROW_ORDER)).alias("member_id"))
    )


def hub_edges(profile: DataFrame) -> DataFrame:
    """Identity hubs: ration card, mobile, address; only for values that are set."""
    card = member_of(profile).select(F.lit("MEMBER_OF").alias("rel"), "uid", F.col("ration_card_number").alias("hub"), "member_id")
    none = F.lit(None).cast("string")
    out = card
    for rel, c in (("HAS_MOBILE", "mobile"), ("LIVES_AT", "address_sanitized")):
        out = out.unionByName(
            profile.where(F.col(c) != "").select(F.lit(rel).alias("rel"), "uid", F.col(c).alias("hub"), none.alias("member_id")).distinct()
        )
    return out


def operator_edges(profile: DataFrame) -> DataFrame:
    return profile.where(F.trim("entry_by") != "").select("uid", F.trim("entry_by").alias("operator_id")).distinct()


PAYOUT_KEYS = ["uid", "scheme_id", "scheme_beneficiary_id", "financial_year", "installment_year",
               "installment_month_code", "installment_month"]


def payout_windows(txn: DataFrame) -> DataFrame:
    """Payments per enrollment and month; the latest reference takes nulls last in both keys."""
    return txn.groupBy(*PAYOUT_KEYS).agg(
        F.count("*").alias("transaction_count"),
        F.coalesce(F.sum("amount"), F.lit(0).cast("decimal(28,2)")).alias("total_amount"),
        F.max("transaction_timestamp").alias("latest_transaction_timestamp"),
        F.max_by("transaction_ref_no", F.struct("transaction_timestamp", "source_sl_no", "transaction_ref_no")).alias("latest_transaction_ref_no"),
    )


def payout_keys(df: DataFrame) -> DataFrame:
    """Payout month key and label with their fallbacks."""
    def known(*cols: str) -> Column:
        return F.coalesce(*[null_if_blank(c) for c in cols], F.lit("UNKNOWN"))

    label = F.concat_ws(" ", F.coalesce(null_if_blank("installment_month"), null_if_blank("installment_month_code")), null_if_blank("installment_year"))
    return df.withColumn(
        "payout_month_key",
        F.concat_ws(":", known("scheme_id"), known("financial_year"), known("installment_year"), known("installment_month_code", "installment_month")),
    ).withColumn(
        "payout_month_label", F.coalesce(F.nullif(label, F.lit("")), null_if_blank("financial_year"), F.lit("Unknown Payout Month"))
    ).withColumn("enrollment_key", F.concat_ws(":", trimmed("uid"), trimmed("scheme_beneficiary_id")))


def payout_sample(txn: DataFrame, sample: DataFrame) -> DataFrame:
    """Payout windows of sampled enrollments only; the payments are filtered before grouping."""
    keys = ["uid", "scheme_id", "scheme_beneficiary_id"]
    return payout_windows(txn.join(sample.select(*keys).distinct(), keys, "left_semi"))


def payout_graph(windows: DataFrame) -> DataFrame:
    """PayoutMonth nodes and the edges from enrollments and schemes."""
    w = payout_keys(windows)
    none = F.lit(None).cast("string")
    node = w.groupBy(F.col("payout_month_key").alias("dst")).agg(F.min("payout_month_label").alias("src")).select(F.lit("PayoutMonth").alias("rel"), "src", "dst")
    got = w.select(F.lit("RECEIVED_PAYOUT_IN").alias("rel"), F.col("enrollment_key").alias("src"), F.col("payout_month_key").alias("dst")).distinct()
    has = w.select(F.lit("HAS_PAYOUT_WINDOW").alias("rel"), F.col("scheme_id").alias("src"), F.col("payout_month_key").alias("dst")).distinct()
    return node.unionByName(got).unionByName(has)


def key_violations(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Keys that occur more than once in a node table."""
    parts = [
        df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("copies")).where("copies > 1")
        .select(F.lit(label).alias("label"), "key", "copies")
        for label, (df, key) in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merge_hubs(hubs: DataFrame, edges: DataFrame) -> DataFrame:
    """Point the edges of hubs with one number at the hub with the smallest id."""
    kept = hubs.groupBy("number").agg(F.min("hub_id").alias("kept_id"))
    mapping = hubs.join(kept, "number").select("hub_id", "kept_id")
    return edges.join(mapping, "hub_id").select("uid", F.col("kept_id").alias("hub_id")).distinct()


def drop_orphans(hubs: DataFrame, edges: DataFrame) -> DataFrame:
    return hubs.join(edges, "hub_id", "left_semi")


def align_flags(citizens: DataFrame, as_of: Column) -> DataFrame:
    """Missing flags become false, a missing age comes from the date of birth."""
    out = citizens
    for c in ("is_ghost_flag", "is_dup_flag", "is_anomaly_flag"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(False)))
    return out.withColumn("age", F.coalesce("age", age_years(iso_date(F.col("dob")), as_of)))


def citizen_rollups(enrollments: DataFrame) -> DataFrame:
    return enrollments.groupBy("uid").agg(
        F.count("*").alias("enrollment_count"),
        F.countDistinct("scheme_id").alias("scheme_count"),
        F.sum("transaction_rows").alias("transaction_rows"),
        F.sum("transaction_total_amount").alias("transaction_total_amount"),
        F.max("latest_transaction_timestamp").alias("latest_transaction_timestamp"),
        (F.sum("transaction_rows") > 0).alias("has_transactions"),
        F.sum("tran_count_1").alias("tran_count_1"),
        F.sum("tran_count_2").alias("tran_count_2"),
    )


def gp_totals(resides: DataFrame) -> DataFrame:
    return resides.groupBy("gp_code").agg(F.countDistinct("uid").alias("total_citizens"))


def scheme_totals(citizen_schemes: DataFrame) -> DataFrame:
    return citizen_schemes.groupBy("scheme_id").agg(F.countDistinct("uid").alias("beneficiary_count"))


def graph_stats(profile: DataFrame, windows: DataFrame) -> DataFrame:
    """Node counts per label in one pass over the profile and one over the payout windows."""
    labels = {
        "Citizen": "uid", "District": "district_code", "Block": "block_code", "GP": "gp_code", "Scheme": "scheme_id",
        "Enrollment": "enrollment_key", "RationCard": "nullif(ration_card_number, '')", "Mobile": "nullif(mobile, '')",
        "Address": "nullif(address_sanitized, '')",
    }
    keys = profile.select(F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.expr(v).alias("key")) for k, v in labels.items()])).alias("n")).select("n.*")
    months = payout_keys(windows).select(F.lit("PayoutMonth").alias("label"), F.col("payout_month_key").alias("key"))
    return keys.unionByName(months).where("key IS NOT NULL").distinct().groupBy("label").agg(F.count("*").alias("node_count"))
