from datetime import date, datetime

from pyspark.sql import functions as F

from rollbook.operators import graph as g
from rollbook.operators import scores as sc

PROFILE = """uid string, scheme_id string, scheme_beneficiary_id string, closing_date date, approved_date date, source_family string, source_table string, fullname string, gender string, member_dob string,
 mobile string, ration_card_number string, ration_card_memberid string, address string, lgd_district_code int, lgd_district_name string, lgd_block_code int, lgd_block_name string, lgd_gp_code int, lgd_gp_name string,
 grade int, rc_match_type string, transaction_total_amount decimal(18,2), latest_transaction_timestamp timestamp, latest_transaction_ref_no string, first_transaction_timestamp timestamp, financial_years string,
 entry_by string, row_no long, transaction_rows long"""


def profile(spark, **over):
    row = dict(uid=" 12345 ", scheme_id="S100", scheme_beneficiary_id=" BEN-1", closing_date=None, approved_date=date(2020, 1, 1), source_family="cash", source_table=None, fullname=None, gender="female ",
               member_dob="", mobile=None, ration_card_number="", ration_card_memberid="M1", address=" some lane ", lgd_district_code=None, lgd_district_name=None, lgd_block_code=1, lgd_block_name="B",
               lgd_gp_code=2, lgd_gp_name="", grade=None, rc_match_type=None, transaction_total_amount=None, latest_transaction_timestamp=None, latest_transaction_ref_no="", first_transaction_timestamp=None,
               financial_years=None, entry_by="OP1", row_no=1, transaction_rows=None)
    row.update(over)
    return tuple(row.values())


def test_profile_shape(spark):
    (r,) = g.normalize_profile(spark.createDataFrame([profile(spark)], PROFILE)).collect()
    assert (r.enrollment_key, r.enrollment_status, r.address_sanitized) == ("12345:BEN-1", "Active", "SOME LANE")
    assert (r.fullname, r.gender, r.member_dob, r.district_name, r.gp_name, r.district_code) == ("UNKNOWN", "FEMALE", None, "Unknown District", "Unknown GP", "")
    assert (r.latest_transaction_ref_no, r.transaction_rows) == (None, 0)


def test_enrollment_repeat(spark):
    rows = [profile(spark, grade=3, row_no=1), profile(spark, closing_date=date(2021, 1, 1), row_no=2, transaction_rows=4)]
    (e,) = g.enrollment_nodes(g.normalize_profile(spark.createDataFrame(rows, PROFILE)).withColumns({c: F.lit(0) for c in ("installment_count", "tran_count_1", "tran_count_2")})).collect()
    assert (e.status, e.grade, e.closing_date, e.transaction_rows) == ("Closed", "3", "2021-01-01", 4)


def test_payout_key(spark):
    cols = "uid string, scheme_id string, scheme_beneficiary_id string, financial_year string, installment_year string, installment_month_code string, installment_month string"
    rows = [("1", "S100", "B", "2526", "2026", "JAN", None), ("2", "S100", "B", None, None, " ", None), ("3", None, "B", "2526", None, None, None)]
    got = {r.uid: (r.payout_month_key, r.payout_month_label) for r in g.payout_keys(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"1": ("S100:2526:2026:JAN", "JAN 2026"), "2": ("S100:UNKNOWN:UNKNOWN:UNKNOWN", "Unknown Payout Month"), "3": ("UNKNOWN:2526:UNKNOWN:UNKNOWN", "2526")}


def test_payout_latest_reference_takes_nulls_last(spark):
    cols = "uid string, scheme_id string, scheme_beneficiary_id string, financial_year string, installment_year string, installment_month_code string, installment_month string, amount decimal(18,2), transaction_timestamp timestamp, transaction_ref_no string, source_sl_no int"
    base = ("1", "S", "B", "f", "y", "m", None)
    rows = [base + (1, None, "late-null", 9), base + (2, datetime(2024, 1, 1), "a", None), base + (3, datetime(2024, 1, 1), "b", 1)]
    (r,) = g.payout_windows(spark.createDataFrame([x[:7] + (None if x[7] is None else __import__("decimal").Decimal(x[7]),) + x[8:] for x in rows], cols)).collect()
    assert (r.transaction_count, float(r.total_amount), r.latest_transaction_ref_no) == (3, 6.0, "b")


def test_score_counts_schemes(spark):
    cit = spark.createDataFrame([("1", 85, "FEMALE"), ("2", 30, "MALE"), ("3", None, "")], "uid string, age int, gender string")
    sch = spark.createDataFrame([("1", "S1", "Active", "Widow Support"), ("1", "S1", "Closed", "Widow Support"), ("2", "S2", "Active", "Disability BPL")], "uid string, scheme_id string, status string, scheme_name string")
    got = {r.uid: (r.vulnerability_score, r.risk_tier) for r in sc.vulnerability(cit, sch).collect()}
    assert got == {"1": (65, "CRITICAL"), "2": (45, "HIGH"), "3": (25, "MODERATE")}
    assert {r.uid: r.vulnerability_score for r in sc.vulnerability(cit, sch, compat=True).collect()}["1"] == 50
