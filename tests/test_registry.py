from datetime import date

from pyspark.sql import functions as F

from rollbook.operators import quality as qa
from rollbook.operators import registry as reg
from rollbook.sources import tables as t
from conftest import SF

BENEF = "sl_no long, uid string, ration_card_memberid string, lgd_district_code int, scheme_id string, scheme_beneficiary_id string, grade int, approved_date date, closing_date date"
PERSON = "ration_card_memberid string, uid string, lgd_district_code int"


def test_match_follows_the_or_condition(spark):
    p = spark.createDataFrame([("M1", "U1", 1), ("M2", None, 1), ("M3", "U3", 1)], PERSON)
    b = spark.createDataFrame([
        (1, "U1", "M9", 1, "S1", "B1", 1, None, None),  # equal uid
        (2, None, "M1", 1, "S1", "B2", 1, None, None),  # no uid on this side: member id
        (3, "U7", "M2", 1, "S1", "B3", 1, None, None),  # no uid on the person side: member id
        (4, "U7", "M3", 1, "S1", "B4", 1, None, None),  # both have one and they differ: no match
    ], BENEF)
    got = {(r.sl_no, r.matched_memberid) for r in reg.match_identity(p, b).collect()}
    assert got == {(1, "M1"), (2, "M1"), (3, "M2")}
    assert [r.sl_no for r in reg.unmatched(p, b).collect()] == [4]


def test_person_detail_ties_and_caste(spark):
    rc = t.persons(spark, SF).limit(1).drop("c_custkey")
    two = rc.withColumns({"ration_card_memberid": F.lit("M1"), "entry_ts": F.lit(date(2024, 1, 1)), "uid": F.lit("U2"), "caste_as_caste_data": F.lit(""), "caste": F.lit("SC")})
    rows = two.unionByName(two.withColumn("uid", F.lit("U1"))).unionByName(two.withColumns({"uid": F.lit("U0"), "entry_ts": F.lit(None).cast("date")}))
    (r,) = reg.build_person_detail(rows).collect()
    assert (r.uid, r.caste) == ("U1", "SC")


def test_key_in_both_branches_keeps_latest_then_cash(spark):
    cols = "ration_card_memberid string, scheme_id string, scheme_type string, scheme_beneficiary_id string, enrollment_status string, enrollment_grade int, approved_date date, closing_date date, total_amount_received decimal(28,2), installment_count long, first_payment_date date, last_payment_date date, lgd_district_code int"
    def row(member, kind, when):
        return (member, "S1", kind, "B", "ACTIVE", 1, when, None, None, 0, None, None, 1)
    cash = spark.createDataFrame([row("M1", "CASH", date(2020, 1, 1)), row("M2", "CASH", date(2020, 1, 1)), row(None, "CASH", None)], cols)
    health = spark.createDataFrame([row("M1", "SWASTHYA_SATHI", date(2021, 1, 1)), row("M2", "SWASTHYA_SATHI", date(2020, 1, 1))], cols)
    assert {(r.ration_card_memberid, r.scheme_type) for r in reg.build_enrollments(cash, health).collect()} == {("M1", "SWASTHYA_SATHI"), ("M2", "CASH")}


def test_join_loss_of_one_unmatched_row(spark):
    p = spark.createDataFrame([("M1", "U1", 5)], PERSON)
    b = spark.createDataFrame([(1, "U9", "M9", 5, "S1", "B1", 1, None, None)], BENEF)
    (r,) = qa.join_loss(p, b, b.where("false"), 5).collect()
    assert (r.unmatched_cash_rows, r.cash_match_rate_pct, r.health_match_rate_pct) == (1, 0.0, None)


def test_no_nested_loops(spark):
    """The identity match and the quality reports plan equi joins only."""
    from rollbook.plans.store import store

    s = store(spark, SF)
    cash, health = t.cash(s.benef), t.health(s.benef)
    frames = [
        reg.match_identity(s.persons, s.benef), reg.unmatched(s.persons, s.benef), reg.cash_enrollments(s.persons, cash, t.cash(s.txn)), reg.build_skipped(s.benef, s.persons, s.txn),
        qa.join_loss(s.person_detail, cash, health, 1), qa.unmatched_count(s.person_detail, cash, "n"), qa.pilot_summary(s.person_detail, s.enrollments, s.eligibility_status, 1),
    ]
    for df in frames:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    # a window over all rows of a key keeps one row per task
    assert "WindowGroupLimit" in reg.build_person_detail(s.persons)._jdf.queryExecution().executedPlan().toString()


def test_family_inventory_and_partitions(spark, tmp_path):
    rows = spark.createDataFrame([("rc_beneficiary_303", "S1"), ("rc_beneficiary_mask_000", None), ("scheme_transaction_cash_2526_304", "S2"), ("scheme_transaction_cash_2526", "S2")], "table_name string, scheme_id string")
    got = {r.family: (r.table_count, r.scheme_count) for r in t.table_inventory(rows).collect()}
    assert got == {"rc_beneficiary": (2, 1), "scheme_transaction_cash_2526": (2, 1)}
    path = str(tmp_path / "family")
    t.write_family(t.persons(spark, SF), path)
    one = t.read_family(spark, path, 1)
    assert "PartitionFilters: [isnotnull(lgd_district_code" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == t.persons(spark, SF).where("lgd_district_code = 1").count()


def test_payment_rollup_adds_up_per_source_first(spark):
    """Nulls, shared keys and months that two source rows have in common; one shuffle for the key, none for the months."""
    from decimal import Decimal

    from rollbook.sources import tables as t

    rows = []
    for i in range(400):
        year, month = (None, None) if i % 11 == 0 else (str(2020 + i % 3), f"{i % 12 + 1:02d}")
        when = None if i % 11 == 0 else f"{year}-{month}-{i % 28 + 1:02d} 00:00:00"
        rows.append((i % 40, f"B{i % 40 // 2}", None if i % 40 // 2 == 7 else f"S{i % 2}", None if i % 13 == 0 else Decimal(i) / 4, when, year, year, month, i % 5 if i % 17 else None, None if i % 19 == 0 else f"R{i % 90}"))
    pay = spark.createDataFrame(rows, "sl_no long, scheme_beneficiary_id string, scheme_id string, amount decimal(18,2), t string, financial_year string, installment_year string, installment_month_code string, source_sl_no int, transaction_ref_no string")
    pay = pay.withColumn("transaction_timestamp", F.col("t").cast("timestamp")).drop("t")
    keys = ["scheme_beneficiary_id", "scheme_id"]
    want = pay.groupBy(*keys).agg(
        F.count("*").alias("transaction_rows"), F.sum("amount").alias("transaction_total_amount"), F.max("transaction_timestamp").alias("latest_transaction_timestamp"),
        F.max_by("transaction_ref_no", F.struct("transaction_timestamp", "source_sl_no", "transaction_ref_no")).alias("latest_transaction_ref_no"),
        F.min("transaction_timestamp").alias("first_transaction_timestamp"), F.countDistinct("installment_year", "installment_month_code").alias("installment_count"),
        F.array_join(F.sort_array(F.collect_set("financial_year")), ",").alias("financial_years"),
        F.count_if(F.col("source_sl_no") % 2 == 1).alias("tran_count_1"), F.count_if(F.col("source_sl_no") % 2 == 0).alias("tran_count_2"))
    got = t.payment_rollup(pay, "sl_no")
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    placed = t.payment_rollup(pay.repartition(4, "sl_no"), "sl_no")
    assert placed._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning(scheme_beneficiary_id") == 1
