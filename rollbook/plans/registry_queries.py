"""SRC, REG and QA queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as qa
from ..operators import registry as reg
from ..functions.ranking import top_per_group
from ..sources import tables as t
from .base import big, day, num, query, ts

D, PILOT, SCHEME, SAMPLE = 1, 0, "S767", 50

# --- SRC ---------------------------------------------------------------------------------------


@query("src_1", "SELECT c_custkey, uid, ration_card_memberid, ration_card_number, fullname, member_dob, gender, lgd_district_code FROM person_src WHERE lgd_district_code = 1")
def _(s):
    cols = ["c_custkey", "uid", "ration_card_memberid", "ration_card_number", "fullname", "member_dob", "gender", "lgd_district_code"]
    return t.registry_table(s.spark, s.sf_dir, "rc_beneficiary", D).select(*cols)


FAMILIES = {
    "rc_beneficiary": "NULL",
    "scheme_beneficiary_cash": "scheme_id",
    "swasthya_sathi_beneficiary": "scheme_id",
    "scheme_transaction_cash_2526": "scheme_id",
    "swasthya_sathi_transaction_2526": "scheme_id",
}


@query("src_2", """
SELECT family, count(DISTINCT table_name) AS table_count, count(DISTINCT scheme_id) AS scheme_count, count(*) AS row_count FROM (
 SELECT 'rc_beneficiary' AS family, lgd_district_code AS table_name, NULL AS scheme_id FROM person_src
 UNION ALL SELECT CASE WHEN scheme_id = 'S767' THEN 'swasthya_sathi_beneficiary' ELSE 'scheme_beneficiary_cash' END, lgd_district_code, scheme_id FROM benef_src
 UNION ALL SELECT CASE WHEN scheme_id = 'S767' THEN 'swasthya_sathi_transaction_2526' ELSE 'scheme_transaction_cash_2526' END, lgd_district_code, scheme_id FROM txn_src)
GROUP BY family""")
def _(s):
    parts = []
    for name, scheme in FAMILIES.items():
        rows = t.registry_table(s.spark, s.sf_dir, name)
        table = F.concat(F.lit(f"{name}_"), F.lpad((F.col("lgd_district_code") + 300).cast("string"), 3, "0"))
        parts.append(rows.select(table.alias("table_name"), F.expr(f"cast({scheme} AS string)").alias("scheme_id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return t.table_inventory(out)


@query("src_3", f"""
SELECT uid, scheme_id, scheme_beneficiary_id, fullname, gender, member_dob, {day('approved_date')}, {day('closing_date')}, {big('coalesce(transaction_rows, 0)', 'transaction_rows')}
FROM profile_raw ORDER BY uid, scheme_id, scheme_beneficiary_id, row_no LIMIT 200 OFFSET 100""")
def _(s):
    page = s.profile_raw.orderBy("uid", "scheme_id", "scheme_beneficiary_id", "row_no").offset(100).limit(200)
    return page.select("uid", "scheme_id", "scheme_beneficiary_id", "fullname", "gender", "member_dob", "approved_date", "closing_date",
                       F.coalesce("transaction_rows", F.lit(0).cast("bigint")).alias("transaction_rows"))


def profile_sample(profile, n: int):
    """First n profile rows of every scheme."""
    return top_per_group(profile, ["scheme_id"], [F.col("uid"), F.col("scheme_beneficiary_id"), F.col("row_no")], n, ["uid", "row_no"])


@query("src_4", f"""
SELECT scheme_id, uid, scheme_beneficiary_id, rn FROM (
 SELECT *, row_number() OVER (PARTITION BY scheme_id ORDER BY uid, scheme_beneficiary_id, row_no) AS rn FROM profile_raw) WHERE rn <= {SAMPLE}""")
def _(s):
    return profile_sample(s.profile_raw, SAMPLE).select("scheme_id", "uid", "scheme_beneficiary_id", "rn")


# --- REG ---------------------------------------------------------------------------------------


@query("reg_1", f"""
SELECT ration_card_memberid, ration_card_number, uid, fullname, member_dob, gender, mobile, is_hof, hof_member_id, rc_member_status,
 {day('rc_approval_date')}, {day('rc_closure_date')}, lgd_district_code, lgd_block_code, lgd_gp_code, address FROM person_detail""")
def _(s):
    cols = ["ration_card_memberid", "ration_card_number", "uid", "fullname", "member_dob", "gender", "mobile", "is_hof", "hof_member_id", "rc_member_status",
            "rc_approval_date", "rc_closure_date", "lgd_district_code", "lgd_block_code", "lgd_gp_code", "address"]
    return reg.build_person_detail(s.persons).select(*cols)


@query("reg_2", "SELECT ration_card_memberid, caste, disability_type, rc_member_status, ration_card_type_code FROM person_detail")
def _(s):
    return reg.build_person_detail(s.persons).select("ration_card_memberid", "caste", "disability_type", "rc_member_status", "ration_card_type_code")


@query("reg_3", "SELECT member, person_uid, sl_no, scheme_id, person_district FROM matched")
def _(s):
    m = reg.match_identity(s.persons, s.benef)
    return m.select(F.col("matched_memberid").alias("member"), F.col("matched_uid").alias("person_uid"), "sl_no", "scheme_id", F.col("matched_district").alias("person_district"))


PAY = f"{num('total_amount')}, installments, {ts('first_payment_date')}, {ts('last_payment_date')}"


@query("reg_4", f"SELECT scheme_beneficiary_id, scheme_id, {PAY} FROM cash_txn")
def _(s):
    return reg.cash_rollup(t.cash(s.txn))


@query("reg_5", f"SELECT scheme_beneficiary_id, {PAY} FROM health_txn")
def _(s):
    return reg.claim_rollup(t.health(s.txn))


ENR = f"""ration_card_memberid, scheme_id, scheme_type, scheme_beneficiary_id, enrollment_status, enrollment_grade, {day('approved_date')}, {day('closing_date')},
 {num('total_amount_received')}, {big('installment_count')}, {ts('first_payment_date')}, {ts('last_payment_date')}, lgd_district_code"""


@query("reg_6", f"SELECT {ENR} FROM cash_rows")
def _(s):
    return reg.cash_enrollments(s.persons, t.cash(s.benef), t.cash(s.txn))


@query("reg_7", f"SELECT {ENR} FROM health_rows")
def _(s):
    return reg.health_enrollments(s.persons, t.health(s.benef), t.health(s.txn))


@query("reg_8", f"SELECT {ENR} FROM pse")
def _(s):
    cash = reg.cash_enrollments(s.persons, t.cash(s.benef), t.cash(s.txn))
    health = reg.health_enrollments(s.persons, t.health(s.benef), t.health(s.txn))
    return reg.build_enrollments(cash, health)


@query("reg_9", f"""
SELECT p.ration_card_memberid, fullname, caste, lgd_gp_code, e.scheme_id, scheme_type, enrollment_status, {day('approved_date')},
 {num('total_amount_received')}, is_eligible, is_enrolled, eligibility_state
FROM person_detail p JOIN pse e USING (ration_card_memberid) LEFT JOIN elig_status s ON s.ration_card_memberid = e.ration_card_memberid AND s.scheme_id = e.scheme_id""")
def _(s):
    v = reg.enrollment_eligibility(s.person_detail, s.enrollments, s.eligibility_status)
    return v.select("ration_card_memberid", "fullname", "caste", "lgd_gp_code", "scheme_id", "scheme_type", "enrollment_status", "approved_date",
                    "total_amount_received", "is_eligible", "is_enrolled", "eligibility_state")


COMPLETE = " + ".join(f"CASE WHEN coalesce(cast({c} AS varchar), '') <> '' THEN 1 ELSE 0 END" for c in reg.COMPLETENESS)
KEYED = f"""(SELECT *, {COMPLETE} AS completeness_score FROM benef_src WHERE coalesce(trim(uid), '') <> '' AND coalesce(trim(scheme_beneficiary_id), '') <> '')"""
RANKED = f"""(SELECT *, count(*) OVER (PARTITION BY uid, scheme_beneficiary_id) AS duplicate_group_size,
  row_number() OVER (PARTITION BY uid, scheme_beneficiary_id ORDER BY modify_ts DESC NULLS LAST, entry_ts DESC NULLS LAST, approved_date DESC NULLS LAST,
   completeness_score DESC, source_priority, sl_no) AS rn FROM {KEYED})"""


@query("reg_10", f"SELECT uid, scheme_beneficiary_id, scheme_id, sl_no, completeness_score, duplicate_group_size, {day('modify_ts')} FROM {RANKED} WHERE rn = 1")
def _(s):
    return reg.build_profile(s.benef).select("uid", "scheme_beneficiary_id", "scheme_id", "sl_no", "completeness_score", "duplicate_group_size", "modify_ts")


@query("reg_11", f"""
WITH keyed AS {KEYED}, ranked AS {RANKED}
SELECT cast(sl_no AS varchar) AS source_ref, CASE WHEN coalesce(trim(uid), '') = '' AND coalesce(trim(scheme_beneficiary_id), '') = '' THEN 'INVALID_KEY_COMBINATION'
  WHEN coalesce(trim(uid), '') = '' THEN 'MISSING_UID' ELSE 'MISSING_SCHEME_BENEFICIARY_ID' END AS reason
 FROM benef_src WHERE coalesce(trim(uid), '') = '' OR coalesce(trim(scheme_beneficiary_id), '') = ''
UNION ALL SELECT cast(sl_no AS varchar), 'DUPLICATE_LOSER' FROM ranked WHERE rn > 1
UNION ALL SELECT cast(sl_no AS varchar), 'CONFLICTING_SCHEME_ID' FROM keyed WHERE (uid, scheme_beneficiary_id) IN (SELECT (uid, scheme_beneficiary_id) FROM keyed GROUP BY uid, scheme_beneficiary_id HAVING count(DISTINCT scheme_id) > 1)
UNION ALL SELECT cast(sl_no AS varchar), 'CONFLICTING_PERSONAL_DATA' FROM keyed WHERE uid IN (SELECT uid FROM keyed GROUP BY uid HAVING count(DISTINCT member_dob) > 1 OR count(DISTINCT gender) > 1)
UNION ALL SELECT cast(sl_no AS varchar), 'AMBIGUOUS_RC_MATCH' FROM benef_src WHERE uid IS NULL AND ration_card_memberid IN (SELECT ration_card_memberid FROM person_src GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT transaction_ref_no, 'NO_BENEFICIARY_MATCH_FOR_TRANSACTION' FROM txn_src x WHERE NOT EXISTS (SELECT 1 FROM keyed k WHERE k.scheme_beneficiary_id = x.scheme_beneficiary_id AND k.scheme_id = x.scheme_id)""")
def _(s):
    return reg.build_skipped(s.benef, s.persons, s.txn)


@query("reg_12", f"""
SELECT p.uid, p.scheme_id, p.scheme_beneficiary_id, p.row_no, p.fullname, x.transaction_ref_no, {num('x.amount')}, {ts('x.transaction_timestamp')}
FROM profile_raw p LEFT JOIN txn_src x ON x.uid = p.uid AND x.scheme_id = p.scheme_id AND x.scheme_beneficiary_id = p.scheme_beneficiary_id""")
def _(s):
    v = reg.full_view(s.profile_raw.select("uid", "scheme_id", "scheme_beneficiary_id", "row_no", "fullname"), s.txn)
    return v.select("uid", "scheme_id", "scheme_beneficiary_id", "row_no", "fullname", "transaction_ref_no", "amount", "transaction_timestamp")


# --- QA ----------------------------------------------------------------------------------------


@query("qa_1", "SELECT count(*) AS person_detail_count FROM person_detail WHERE lgd_district_code = 1")
def _(s):
    return qa.person_row_count(s.person_detail, D)


@query("qa_2", "SELECT ration_card_memberid, count(*) AS duplicate_count FROM person_src GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 100")
def _(s):
    # Run on the source, where member ids do repeat; the person table has none by construction.
    return qa.duplicates(s.persons, ["ration_card_memberid"])


@query("qa_3", "SELECT member AS ration_card_memberid, scheme_id, count(*) AS duplicate_count FROM matched GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 3 DESC, 1, 2 LIMIT 100")
def _(s):
    m = reg.match_identity(s.persons, s.benef).select(F.col("matched_memberid").alias("ration_card_memberid"), "scheme_id")
    return qa.duplicates(m, ["ration_card_memberid", "scheme_id"])


def _unmatched_sql(cond: str, name: str) -> str:
    return f"""SELECT count(*) AS {name} FROM benef_src b WHERE scheme_id {cond} AND lgd_district_code = 1 AND NOT EXISTS (SELECT 1 FROM person_detail p WHERE
 (p.uid IS NOT NULL AND b.uid IS NOT NULL AND p.uid = b.uid) OR ((p.uid IS NULL OR b.uid IS NULL) AND p.ration_card_memberid = b.ration_card_memberid))"""


@query("qa_4", _unmatched_sql("<> 'S767'", "unmatched_cash_rows"))
def _(s):
    return qa.unmatched_count(s.person_detail, t.cash(s.benef), "unmatched_cash_rows", D)


@query("qa_5", "SELECT ration_card_number, count(*) AS family_size FROM person_detail GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(s):
    return qa.family_sample(s.person_detail)


SUMMARY = """SELECT (SELECT count(*) FROM person_detail WHERE lgd_district_code = 1) AS person_count, (SELECT count(*) FROM pse WHERE lgd_district_code = 1) AS enrollment_count,
 (SELECT count(*) FROM elig_status) AS eligibility_count, (SELECT count(*) FROM (SELECT 1 FROM person_detail GROUP BY ration_card_memberid HAVING count(*) > 1)) AS person_duplicates,
 (SELECT count(*) FROM (SELECT 1 FROM pse GROUP BY ration_card_memberid, scheme_id HAVING count(*) > 1)) AS enrollment_duplicates,
 (SELECT coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM person_detail WHERE lgd_district_code = 1 GROUP BY ration_card_number)) AS max_family_size, 1 AS district_code"""


@query("qa_6", SUMMARY)
def _(s):
    return qa.pilot_summary(s.person_detail, s.enrollments, s.eligibility_status, D)


COVER = """SELECT (SELECT count(DISTINCT ration_card_memberid) FROM person_src WHERE lgd_district_code = 1) AS source_person_count,
 (SELECT count(DISTINCT ration_card_number) FROM person_src WHERE lgd_district_code = 1) AS source_family_count,
 (SELECT count(DISTINCT ration_card_number) FROM person_detail WHERE lgd_district_code = 1) AS output_family_count"""


@query("qa_7", COVER)
def _(s):
    return qa.coverage_counts(s.persons, s.person_detail, D)


@query("qa_8", "SELECT count(*) AS person_without_scheme_count FROM person_detail p WHERE lgd_district_code = 1 AND NOT EXISTS (SELECT 1 FROM pse e WHERE e.ration_card_memberid = p.ration_card_memberid)")
def _(s):
    return qa.persons_without_scheme(s.person_detail, s.enrollments, D)


@query("qa_9", """SELECT count(*) AS families_with_partial_coverage FROM (SELECT p.ration_card_number FROM person_detail p LEFT JOIN pse e ON e.ration_card_memberid = p.ration_card_memberid AND e.scheme_id = 'S767'
 WHERE p.lgd_district_code = 1 GROUP BY 1 HAVING count(*) FILTER (WHERE e.scheme_id = 'S767') > 0 AND count(*) FILTER (WHERE e.scheme_id IS NULL) > 0)""")
def _(s):
    return qa.partial_families(s.person_detail, s.enrollments, SCHEME, D)


@query("qa_10", _unmatched_sql("= 'S767'", "unmatched_health_rows"))
def _(s):
    return qa.unmatched_count(s.person_detail, t.health(s.benef), "unmatched_health_rows", D)


@query("qa_11", """
SELECT b.*, coalesce(members_in_scheme, 0) AS members_in_scheme, coalesce(distinct_schemes, 0) AS distinct_schemes FROM (
 SELECT ration_card_number, count(*) AS family_size, count(*) FILTER (WHERE is_hof = 1) AS hof_count FROM person_detail WHERE lgd_district_code = 1 GROUP BY 1) b
LEFT JOIN (SELECT ration_card_number, count(DISTINCT CASE WHEN scheme_id = 'S767' THEN p.ration_card_memberid END) AS members_in_scheme, count(DISTINCT scheme_id) AS distinct_schemes
 FROM person_detail p JOIN pse e USING (ration_card_memberid) WHERE p.lgd_district_code = 1 GROUP BY 1) x USING (ration_card_number)
ORDER BY family_size DESC, ration_card_number LIMIT 5""")
def _(s):
    return qa.largest_families(s.person_detail, s.enrollments, SCHEME, D)


@query("qa_12", "SELECT scheme_id, scheme_type, count(*) AS member_count FROM pse WHERE lgd_district_code = 1 GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10")
def _(s):
    return qa.scheme_mix(s.enrollments, D)


@query("qa_13", f"""SELECT person_count = source_person_count AS person_count_matches_source, output_family_count = source_family_count AS family_count_matches_source,
 person_duplicates = 0 AS person_duplicates_zero, enrollment_duplicates = 0 AS enrollment_duplicates_zero, eligibility_count = 0 AS eligibility_pending
FROM ({SUMMARY}), ({COVER})""")
def _(s):
    summary = qa.pilot_summary(s.person_detail, s.enrollments, s.eligibility_status, D)
    return qa.build_checks(summary, qa.coverage_counts(s.persons, s.person_detail, D))


def _loss(cond: str) -> str:
    return f"""(SELECT count(*) FROM benef_src b WHERE scheme_id {cond} AND lgd_district_code = 1
  AND (b.uid IS NULL OR b.uid NOT IN (SELECT uid FROM person_detail WHERE lgd_district_code = 1 AND uid IS NOT NULL))
  AND b.ration_card_memberid NOT IN (SELECT ration_card_memberid FROM person_detail WHERE lgd_district_code = 1))"""


@query("qa_14", f"""
SELECT *, round((1 - unmatched_cash_rows / cash_source_rows) * 100, 2) AS cash_match_rate_pct, round((1 - unmatched_health_rows / health_source_rows) * 100, 2) AS health_match_rate_pct FROM (
SELECT {_loss("<> 'S767'")} AS unmatched_cash_rows, (SELECT count(*) FROM benef_src WHERE scheme_id <> 'S767' AND lgd_district_code = 1) AS cash_source_rows,
 {_loss("= 'S767'")} AS unmatched_health_rows, (SELECT count(*) FROM benef_src WHERE scheme_id = 'S767' AND lgd_district_code = 1) AS health_source_rows, 1 AS district_code)""")
def _(s):
    return qa.join_loss(s.person_detail, t.cash(s.benef), t.health(s.benef), D)


@query("qa_15", """
SELECT *, non_pilot_person_count > 0 AS full_rollout_detected FROM (SELECT
 (SELECT count(*) FROM person_detail) AS person_count, (SELECT count(DISTINCT ration_card_number) FROM person_detail) AS family_count,
 (SELECT count(DISTINCT lgd_district_code) FROM person_detail) AS person_district_count, (SELECT count(*) FROM person_detail WHERE lgd_district_code <> 0) AS non_pilot_person_count,
 (SELECT count(*) FROM pse) AS enrollment_count, (SELECT count(DISTINCT lgd_district_code) FROM pse) AS enrollment_district_count,
 (SELECT count(*) FROM pse WHERE lgd_district_code <> 0) AS non_pilot_enrollment_count, (SELECT count(*) FROM elig_status) AS eligibility_count)""")
def _(s):
    return qa.rollout_summary(s.person_detail, s.enrollments, s.eligibility_status, PILOT)


@query("qa_16", "SELECT lgd_district_code, count(*) AS person_count FROM person_detail GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(s):
    return qa.top_districts(s.person_detail)


@query("qa_17", "SELECT count(*) AS total_beneficiaries, count(*) FILTER (WHERE gender = 'FEMALE') AS female_count, count(*) FILTER (WHERE gender = 'MALE') AS male_count FROM profile_raw WHERE lgd_district_code = 1")
def _(s):
    return qa.district_stats(s.profile_raw, D)
