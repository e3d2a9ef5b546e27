"""Comparison SQL: named views that a query text may use, inlined as CTEs."""

from __future__ import annotations

import re

from ..sources.tables import BENEFICIARY_COLUMNS, PERSON_COLUMNS, SCHEME_NAMES, TRANSACTION_COLUMNS

VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql.strip()


def _cols(cols: dict[str, str]) -> str:
    return ",\n ".join(f"{sql} AS {name}" for name, sql in cols.items())


def _needed(sql: str, seen: list[str]) -> None:
    for name in VIEWS:
        if name not in seen and re.search(rf"\b{name}\b", sql):
            _needed(VIEWS[name], seen)
            if name not in seen:
                seen.append(name)


def with_views(sql: str) -> str:
    """The query with every view it needs as a CTE, in order of use."""
    order: list[str] = []
    _needed(sql, order)
    if not order:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS MATERIALIZED (\n{VIEWS[n]}\n)" for n in order)
    body = sql.strip()
    # a query with its own WITH list continues the one of the views
    return f"WITH {ctes},\n{body[5:]}" if body.startswith("WITH ") else f"WITH {ctes}\n{body}"


view("scheme_dim", "SELECT * FROM (VALUES " + ", ".join(f"('{a}','{b}')" for a, b in SCHEME_NAMES) + ") AS v(scheme_id, scheme_name)")
view("person_src", f"""
SELECT {_cols(PERSON_COLUMNS)}
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
LEFT JOIN part ON p_partkey = c_custkey""")
view("benef_full", f"""
SELECT p.*, {_cols(BENEFICIARY_COLUMNS)}
FROM orders JOIN person_src p ON o_custkey = p.c_custkey""")
view("benef_src", """
SELECT sl_no,
 CASE WHEN sl_no % 37 = 3 THEN NULL WHEN sl_no % 211 = 5 THEN 'Z' || uid ELSE uid END AS uid,
 CASE WHEN sl_no % 211 = 5 THEN 'Z' || ration_card_memberid ELSE ration_card_memberid END AS ration_card_memberid,
 lgd_district_code, scheme_id, CASE WHEN sl_no % 307 = 7 THEN '' ELSE scheme_beneficiary_id END AS scheme_beneficiary_id,
 grade, approved_date, closing_date, fullname, gender, member_dob, mobile, ration_card_number,
 CASE WHEN sl_no % 3 = 0 THEN NULL ELSE approved_date + 10 END AS modify_ts,
 approved_date + cast(sl_no % 4 AS int) AS entry_ts,
 CASE WHEN scheme_id = 'S767' THEN 2 ELSE 1 END AS source_priority
FROM benef_full""")
view("txn_src", f"SELECT {_cols(TRANSACTION_COLUMNS)} FROM lineitem JOIN benef_full ON l_orderkey = sl_no")
view("person_detail", """
SELECT ration_card_memberid, ration_card_number, ration_card_type_code, uid, uid_verified_status, fullname, member_dob, gender,
 coalesce(nullif(caste_as_caste_data, ''), caste) AS caste, reserve_field1 AS disability_type, mobile, is_hof, hof_member_id,
 relationship_hof, father_name, mother_name, spouse_name, member_status AS rc_member_status, entry_ts AS rc_approval_date,
 CASE WHEN member_status = 'INACTIVE' THEN modify_ts END AS rc_closure_date,
 lgd_district_code, lgd_district_name, lgd_block_code, lgd_block_name, lgd_gp_code, lgd_gp_name, address
FROM (SELECT *, row_number() OVER (PARTITION BY ration_card_memberid ORDER BY entry_ts DESC NULLS LAST, uid NULLS LAST, fullname NULLS LAST) AS rn
      FROM person_src) WHERE rn = 1""")
OR_MATCH = """((p.uid IS NOT NULL AND b.uid IS NOT NULL AND p.uid = b.uid)
 OR ((p.uid IS NULL OR b.uid IS NULL) AND p.ration_card_memberid IS NOT NULL AND p.ration_card_memberid = b.ration_card_memberid))"""
view("matched", f"""
SELECT p.ration_card_memberid AS member, p.uid AS person_uid, p.lgd_district_code AS person_district, b.*
FROM person_src p JOIN benef_src b ON {OR_MATCH}""")
PAY = """sum(amount) AS total_amount, count(*) AS installments, min(transaction_timestamp) AS first_payment_date,
 max(transaction_timestamp) AS last_payment_date"""
view("cash_txn", f"SELECT scheme_beneficiary_id, scheme_id, {PAY} FROM txn_src WHERE scheme_id <> 'S767' GROUP BY 1, 2")
view("health_txn", f"SELECT scheme_beneficiary_id, {PAY} FROM txn_src WHERE scheme_id = 'S767' GROUP BY 1")


def _enroll(kind: str, cond: str, on: str, rollup: str) -> str:
    return f"""
SELECT ration_card_memberid, scheme_id, scheme_type, scheme_beneficiary_id, enrollment_status, enrollment_grade, approved_date, closing_date,
 total_amount_received, installment_count, first_payment_date, last_payment_date, lgd_district_code FROM (
 SELECT m.member AS ration_card_memberid, m.scheme_id, '{kind}' AS scheme_type, m.scheme_beneficiary_id,
  CASE WHEN closing_date IS NULL THEN 'ACTIVE' ELSE 'CLOSED' END AS enrollment_status, grade AS enrollment_grade, approved_date, closing_date,
  coalesce(total_amount, 0) AS total_amount_received, coalesce(installments, 0) AS installment_count, first_payment_date, last_payment_date, lgd_district_code,
  row_number() OVER (PARTITION BY m.member, m.scheme_id ORDER BY approved_date DESC NULLS LAST, m.scheme_beneficiary_id NULLS LAST, sl_no) AS rn
 FROM matched m LEFT JOIN {rollup} x ON {on} WHERE m.member IS NOT NULL AND m.scheme_id {cond}) WHERE rn = 1"""


view("cash_rows", _enroll("CASH", "<> 'S767'", "x.scheme_beneficiary_id = m.scheme_beneficiary_id AND x.scheme_id = m.scheme_id", "cash_txn"))
view("health_rows", _enroll("SWASTHYA_SATHI", "= 'S767'", "x.scheme_beneficiary_id = m.scheme_beneficiary_id", "health_txn"))
view("pse", """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ration_card_memberid, scheme_id ORDER BY approved_date DESC NULLS LAST, scheme_type) AS rn
 FROM (SELECT * FROM cash_rows UNION ALL SELECT * FROM health_rows)) WHERE rn = 1""")
view("elig_status", """
SELECT ration_card_memberid, scheme_id, code % 2 = 0 AS is_eligible, enrollment_status = 'ACTIVE' AS is_enrolled,
 CASE WHEN code % 2 = 0 THEN 'ELIGIBLE' ELSE 'NOT_ELIGIBLE' END AS eligibility_state
FROM (SELECT *, try_cast(substring(ration_card_memberid, 2, 20) AS bigint) AS code FROM pse) WHERE coalesce(code % 3, 0) <> 0""")
view("txn_rollup", """
SELECT scheme_beneficiary_id, scheme_id, count(*) AS transaction_rows, sum(amount) AS transaction_total_amount,
 max(transaction_timestamp) AS latest_transaction_timestamp,
 arg_max(transaction_ref_no, (transaction_timestamp, source_sl_no, transaction_ref_no)) AS latest_transaction_ref_no,
 min(transaction_timestamp) AS first_transaction_timestamp,
 count(DISTINCT installment_year || '-' || installment_month_code) AS installment_count,
 string_agg(DISTINCT financial_year, ',' ORDER BY financial_year) AS financial_years,
 count(*) FILTER (WHERE source_sl_no % 2 = 1) AS tran_count_1, count(*) FILTER (WHERE source_sl_no % 2 = 0) AS tran_count_2
FROM txn_src GROUP BY 1, 2""")
view("profile_raw", """
SELECT b.*, t.* EXCLUDE (scheme_beneficiary_id, scheme_id), CASE WHEN b.scheme_id = 'S767' THEN 'health' ELSE 'cash' END AS source_family,
 'UID' AS rc_match_type, b.sl_no AS row_no
FROM benef_full b LEFT JOIN txn_rollup t ON t.scheme_beneficiary_id = b.scheme_beneficiary_id AND t.scheme_id = b.scheme_id
WHERE b.uid IS NOT NULL""")
view("prof", """
SELECT uid, scheme_id, scheme_beneficiary_id, uid || ':' || scheme_beneficiary_id AS enrollment_key,
 CASE WHEN closing_date IS NOT NULL THEN 'Closed' ELSE 'Active' END AS enrollment_status, source_family,
 source_family || '_' || cast(lgd_district_code AS varchar) AS source_table,
 upper(trim(fullname)) AS fullname, upper(trim(coalesce(gender, ''))) AS gender, nullif(member_dob, '') AS member_dob, mobile, ration_card_number,
 ration_card_memberid, upper(trim(coalesce(address, ''))) AS address_sanitized, cast(lgd_district_code AS varchar) AS district_code,
 lgd_district_name AS district_name, cast(lgd_block_code AS varchar) AS block_code, lgd_block_name AS block_name,
 cast(lgd_gp_code AS varchar) AS gp_code, lgd_gp_name AS gp_name, cast(approved_date AS varchar) AS approved_date,
 cast(closing_date AS varchar) AS closing_date, cast(grade AS varchar) AS grade, rc_match_type,
 coalesce(transaction_rows, 0) AS transaction_rows, coalesce(transaction_total_amount, 0) AS transaction_total_amount,
 latest_transaction_timestamp, latest_transaction_ref_no, first_transaction_timestamp, coalesce(installment_count, 0) AS installment_count, financial_years,
 coalesce(tran_count_1, 0) AS tran_count_1, coalesce(tran_count_2, 0) AS tran_count_2, entry_by, row_no
FROM profile_raw""")
view("scheme_names", "SELECT DISTINCT p.scheme_id, coalesce(d.scheme_name, p.scheme_id) AS scheme_name FROM prof p LEFT JOIN scheme_dim d USING (scheme_id)")
view("schemes", "SELECT DISTINCT uid, scheme_id, enrollment_status AS status, scheme_name FROM prof JOIN scheme_names USING (scheme_id)")
view("places", "SELECT DISTINCT uid, gp_code, gp_name, block_code, block_name, district_code, district_name FROM prof")
view("first_place", "SELECT uid, min(district_name) AS district, min(block_name) AS block, min(gp_name) AS gp FROM places GROUP BY 1")
view("member_of", """
SELECT uid, ration_card_number, arg_max(ration_card_memberid, (scheme_id, scheme_beneficiary_id, row_no)) AS member_id
FROM prof WHERE ration_card_number <> '' GROUP BY 1, 2""")
view("operators", "SELECT DISTINCT uid, entry_by AS operator_id FROM prof")
view("enr_nodes", """
SELECT enrollment_key, arg_min(uid, o) AS uid, arg_min(scheme_id, o) AS scheme_id, arg_min(scheme_beneficiary_id, o) AS scheme_beneficiary_id,
 arg_min(source_family, o) AS source_family, arg_max(enrollment_status, o) AS status,
 arg_max(approved_date, o) FILTER (WHERE approved_date IS NOT NULL) AS approved_date, arg_max(closing_date, o) FILTER (WHERE closing_date IS NOT NULL) AS closing_date,
 arg_max(grade, o) AS grade, arg_max(transaction_rows, o) AS transaction_rows, arg_max(transaction_total_amount, o) AS transaction_total_amount,
 arg_max(latest_transaction_timestamp, o) FILTER (WHERE latest_transaction_timestamp IS NOT NULL) AS latest_transaction_timestamp,
 arg_max(latest_transaction_ref_no, o) FILTER (WHERE latest_transaction_ref_no IS NOT NULL) AS latest_transaction_ref_no,
 arg_max(installment_count, o) AS installment_count, arg_max(tran_count_1, o) AS tran_count_1, arg_max(tran_count_2, o) AS tran_count_2,
 arg_max(financial_years, o) FILTER (WHERE financial_years IS NOT NULL) AS financial_years
FROM (SELECT *, (scheme_id, scheme_beneficiary_id, row_no) AS o FROM prof) GROUP BY 1""")
view("rollups", """
SELECT uid, count(*) AS enrollment_count, count(DISTINCT scheme_id) AS scheme_count, sum(transaction_rows) AS transaction_rows,
 sum(transaction_total_amount) AS transaction_total_amount, max(latest_transaction_timestamp) AS latest_transaction_timestamp,
 sum(transaction_rows) > 0 AS has_transactions, sum(tran_count_1) AS tran_count_1, sum(tran_count_2) AS tran_count_2
FROM enr_nodes GROUP BY 1""")
AGE = """CASE WHEN d <= DATE '2024-06-01' THEN 2024 - year(d) - CASE WHEN 601 < month(d) * 100 + day(d) THEN 1 ELSE 0 END
 ELSE -(year(d) - 2024 - CASE WHEN month(d) * 100 + day(d) < 601 THEN 1 ELSE 0 END) END"""
view("citizen_nodes", f"""
SELECT uid, name, gender, dob, mobile, {AGE} AS age FROM (
 SELECT uid, arg_min(fullname, o) AS name, arg_min(gender, o) AS gender, arg_min(member_dob, o) FILTER (WHERE member_dob IS NOT NULL) AS dob,
  arg_min(mobile, o) AS mobile, cast(try_strptime(arg_min(member_dob, o) FILTER (WHERE member_dob IS NOT NULL), '%Y-%m-%d') AS date) AS d
 FROM (SELECT *, (scheme_id, scheme_beneficiary_id, row_no) AS o FROM prof) GROUP BY uid)""")
view("scored", """
SELECT *, CASE WHEN vulnerability_score >= 61 THEN 'CRITICAL' WHEN vulnerability_score >= 41 THEN 'HIGH' WHEN vulnerability_score >= 21 THEN 'MODERATE' ELSE 'LOW' END AS risk_tier
FROM (SELECT c.*, r.* EXCLUDE (uid),
 CASE WHEN age > 80 THEN 30 WHEN age > 60 THEN 20 WHEN age < 5 THEN 15 ELSE 0 END + CASE WHEN gender = 'FEMALE' THEN 10 ELSE 0 END
 + CASE WHEN coalesce(n, 0) = 0 THEN 25 WHEN n = 1 THEN 15 ELSE 0 END + CASE WHEN w THEN 10 ELSE 0 END + CASE WHEN di THEN 15 ELSE 0 END
 + CASE WHEN bp THEN 15 ELSE 0 END AS vulnerability_score
 FROM citizen_nodes c LEFT JOIN rollups r USING (uid)
 LEFT JOIN (SELECT uid, count(DISTINCT scheme_id) AS n, bool_or(lower(scheme_name) LIKE '%widow%') AS w, bool_or(lower(scheme_name) LIKE '%disab%') AS di,
   bool_or(lower(scheme_name) LIKE '%bpl%') AS bp FROM schemes GROUP BY uid) s USING (uid))""")
view("dup_pairs", """
SELECT a.uid AS uid1, b.uid AS uid2, a.name, a.dob, a.gender FROM scored a JOIN scored b
 ON a.name = b.name AND a.dob IS NOT DISTINCT FROM b.dob AND a.gender = b.gender AND a.uid < b.uid WHERE a.name <> ''""")
view("dob_groups", "SELECT gp_code, dob, count(*) AS n FROM (SELECT DISTINCT uid, gp_code FROM places) JOIN scored USING (uid) WHERE dob IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5")
view("dob_members", "SELECT DISTINCT p.uid, p.gp_code, s.dob, n FROM places p JOIN scored s USING (uid) JOIN dob_groups g ON g.gp_code = p.gp_code AND g.dob = s.dob")
view("dob_pairs", "SELECT a.uid AS uid1, b.uid AS uid2, a.gp_code, a.dob, a.n FROM dob_members a JOIN dob_members b ON a.gp_code = b.gp_code AND a.dob = b.dob AND a.uid < b.uid")
view("flag_state", """
SELECT s.*, coalesce(age > 110, false) OR coalesce(age < 0, false) OR uid IN (SELECT uid FROM dob_members) AS is_ghost_flag,
 uid IN (SELECT uid1 FROM dup_pairs UNION SELECT uid2 FROM dup_pairs) AS is_dup_flag FROM scored s""")
view("paid_ghosts", "SELECT * FROM flag_state WHERE (is_ghost_flag OR is_dup_flag) AND (coalesce(transaction_rows,0) > 0 OR coalesce(tran_count_1,0) > 0 OR coalesce(tran_count_2,0) > 0)")
view("bad_operators", """
SELECT operator_id, total_registrations, fraud_count, fraud_count / total_registrations AS error_rate FROM (
 SELECT operator_id, count(*) AS total_registrations, count(*) FILTER (WHERE is_ghost_flag OR is_dup_flag) AS fraud_count
 FROM operators JOIN flag_state USING (uid) GROUP BY 1) WHERE total_registrations > 20 AND fraud_count / total_registrations > 0.15""")
view("member_pairs", """
SELECT a.uid AS uid1, b.uid AS uid2, a.ration_card_number, a.member_id FROM member_of a JOIN member_of b
 ON a.ration_card_number = b.ration_card_number AND a.member_id = b.member_id AND a.uid < b.uid WHERE a.member_id <> ''""")
view("flags", """
SELECT *, strftime(TIMESTAMP '2024-01-01' + to_hours(cast(regexp_extract(entity_id, '[0-9]+') AS bigint) % 720), '%Y-%m-%d %H:%M:%S') AS detected_at FROM (
 SELECT 'citizen' AS entity, uid AS entity_id, 'A1' AS rule, 'GHOST' AS type, 'Age > 110' AS description, 85 AS confidence, 'Ghost (Age Anomaly)' AS label FROM scored WHERE age > 110
 UNION ALL SELECT 'citizen', uid, 'A2', 'GHOST', 'DOB in future', 90, 'Ghost (Pension Anomaly)' FROM scored WHERE age < 0
 UNION ALL SELECT 'citizen', uid, 'D1', 'DATA_QUALITY', 'Missing DOB', 60, 'Rule D1' FROM scored WHERE dob IS NULL OR dob IN ('', 'None')
 UNION ALL SELECT 'citizen', uid, 'H1', 'EXPLOITATION', 'Monetized Ghost (Active transactions on ghost/dup account)', 98, 'Ghost Monetization' FROM paid_ghosts
 UNION ALL SELECT 'citizen', uid, 'I1', 'IDENTITY_CLONE', 'Shared Member ID on same Ration Card', 100, 'Systemic Data Conflict' FROM (SELECT uid1 AS uid FROM member_pairs UNION SELECT uid2 FROM member_pairs)
 UNION ALL SELECT 'card', ration_card_number, 'E1', 'HOUSEHOLD_RING', 'Ration Card Shared by >10 UIDs', 95, 'Synthetic Household' FROM member_of GROUP BY ration_card_number HAVING count(DISTINCT uid) > 10
 UNION ALL SELECT 'operator', operator_id, 'F1', 'INTERNAL_ANOMALY', 'High Fraud registration rate (>15%)', 90, 'Operator Corruption Suspect' FROM bad_operators)""")
view("citizen_flags", "SELECT * RENAME (entity_id AS uid) FROM flags WHERE entity = 'citizen'")
view("citizens", "SELECT *, uid IN (SELECT uid FROM citizen_flags WHERE rule IN ('H1', 'I1')) AS is_anomaly_flag FROM flag_state")
