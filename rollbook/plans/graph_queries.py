"""GRA and SC queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import age_calendar, age_years, derive_age, iso_date, parse_dob
from ..operators import graph as g
from ..operators import scores as sc
from .base import big, num, query, ts
from .oracle import AGE, view
from .registry_queries import SAMPLE, profile_sample

PROF_COLS = ["row_no", "uid", "scheme_id", "scheme_beneficiary_id", "enrollment_key", "enrollment_status", "source_family", "source_table", "fullname", "gender",
             "member_dob", "mobile", "ration_card_number", "ration_card_memberid", "address_sanitized", "district_code", "district_name", "block_code", "block_name",
             "gp_code", "gp_name", "approved_date", "closing_date", "grade", "rc_match_type", "latest_transaction_ref_no", "financial_years"]


@query("gra_1", f"SELECT {', '.join(PROF_COLS)}, {big('transaction_rows')}, {num('transaction_total_amount')}, {ts('latest_transaction_timestamp')}, {big('installment_count')} FROM prof")
def _(s):
    return s.profile.select(*PROF_COLS, "transaction_rows", "transaction_total_amount", "latest_transaction_timestamp", "installment_count")


@query("gra_2", "SELECT uid, name, gender, dob, mobile, age FROM citizen_nodes")
def _(s):
    return g.citizen_nodes(s.profile, s.as_of)


@query("gra_3", """
SELECT 'GP_PART_OF_BLOCK' AS rel, gp_code AS src, block_code AS dst FROM places GROUP BY ALL
UNION ALL SELECT 'BLOCK_PART_OF_DISTRICT', block_code, district_code FROM places GROUP BY ALL
UNION ALL SELECT 'RESIDES_IN', uid, gp_code FROM places GROUP BY ALL
UNION ALL SELECT 'NODE District', district_code, min(district_name) FROM places GROUP BY district_code
UNION ALL SELECT 'NODE Block', block_code, min(block_name) FROM places GROUP BY block_code
UNION ALL SELECT 'NODE GP', gp_code, min(gp_name) FROM places GROUP BY gp_code""")
def _(s):
    nodes = g.geo_nodes(s.profile).select(F.concat_ws(" ", F.lit("NODE"), "label").alias("rel"), F.col("code").alias("src"), F.col("name").alias("dst"))
    return g.geo_edges(s.profile).select("rel", "src", "dst").unionByName(nodes)


@query("gra_4", "SELECT scheme_id, scheme_name FROM scheme_names")
def _(s):
    return g.scheme_nodes(s.profile, s.scheme_dim)


ENR = ["enrollment_key", "uid", "scheme_id", "scheme_beneficiary_id", "source_family", "status", "approved_date", "closing_date", "grade", "latest_transaction_ref_no", "financial_years"]


@query("gra_5", f"SELECT {', '.join(ENR)}, {big('transaction_rows')}, {num('transaction_total_amount')}, {ts('latest_transaction_timestamp')}, {big('tran_count_1')}, {big('tran_count_2')} FROM enr_nodes")
def _(s):
    return g.enrollment_nodes(s.profile).select(*ENR, "transaction_rows", "transaction_total_amount", "latest_transaction_timestamp", "tran_count_1", "tran_count_2")


@query("gra_5_edges", """
SELECT DISTINCT 'HAS_ENROLLMENT' AS rel, uid AS src, enrollment_key AS dst, NULL AS status FROM prof
UNION ALL SELECT DISTINCT 'ENROLLMENT_ENROLLED_IN', enrollment_key, scheme_id, enrollment_status FROM prof
UNION ALL SELECT DISTINCT 'ENROLLED_IN', uid, scheme_id, enrollment_status FROM prof""")
def _(s):
    return g.enrollment_edges(s.profile)


@query("gra_6", """
SELECT 'MEMBER_OF' AS rel, uid, ration_card_number AS hub, member_id FROM member_of
UNION ALL SELECT DISTINCT 'HAS_MOBILE', uid, mobile, NULL FROM prof WHERE mobile <> ''
UNION ALL SELECT DISTINCT 'LIVES_AT', uid, address_sanitized, NULL FROM prof WHERE address_sanitized <> ''""")
def _(s):
    return g.hub_edges(s.profile)


@query("gra_7", "SELECT uid, operator_id FROM operators")
def _(s):
    return g.operator_edges(s.profile)


view("windows", """
SELECT uid, scheme_id, scheme_beneficiary_id, financial_year, installment_year, installment_month_code, installment_month, count(*) AS transaction_count,
 coalesce(sum(amount), 0) AS total_amount, max(transaction_timestamp) AS latest_transaction_timestamp,
 arg_max(transaction_ref_no, (transaction_timestamp, source_sl_no, transaction_ref_no)) AS latest_transaction_ref_no
FROM txn_src GROUP BY ALL""")
WIN = ["uid", "scheme_id", "scheme_beneficiary_id", "financial_year", "installment_year", "installment_month_code", "transaction_count"]
WIN_SQL = f"{', '.join('w.' + c for c in WIN)}, {num('total_amount')}, {ts('latest_transaction_timestamp')}, latest_transaction_ref_no"
WIN_OUT = [*WIN, "total_amount", "latest_transaction_timestamp", "latest_transaction_ref_no"]


@query("gra_8", f"SELECT {WIN_SQL} FROM windows w")
def _(s):
    return g.payout_windows(s.txn).select(*WIN_OUT)


@query("gra_9", """
SELECT DISTINCT scheme_id || ':' || financial_year || ':' || installment_year || ':' || installment_month_code AS payout_month_key,
 installment_month_code || ' ' || installment_year AS payout_month_label FROM windows""")
def _(s):
    return g.payout_keys(g.payout_windows(s.txn)).select("payout_month_key", "payout_month_label").distinct()


@query("gra_10", f"""
SELECT {WIN_SQL} FROM windows w WHERE (uid, scheme_id, scheme_beneficiary_id) IN (SELECT (uid, scheme_id, scheme_beneficiary_id) FROM (
 SELECT *, row_number() OVER (PARTITION BY scheme_id ORDER BY uid, scheme_beneficiary_id, row_no) AS rn FROM profile_raw) WHERE rn <= {SAMPLE})""")
def _(s):
    return g.payout_sample(s.txn, profile_sample(s.profile_raw, SAMPLE)).select(*WIN_OUT)


@query("gra_11", """
WITH k AS (SELECT *, scheme_id || ':' || financial_year || ':' || installment_year || ':' || installment_month_code AS pk, coalesce(uid, '') || ':' || scheme_beneficiary_id AS ek FROM windows)
SELECT 'PayoutMonth' AS rel, min(installment_month_code || ' ' || installment_year) AS src, pk AS dst FROM k GROUP BY pk
UNION ALL SELECT DISTINCT 'RECEIVED_PAYOUT_IN', ek, pk FROM k UNION ALL SELECT DISTINCT 'HAS_PAYOUT_WINDOW', scheme_id, pk FROM k""")
def _(s):
    return g.payout_graph(g.payout_windows(s.txn))


@query("gra_12", """
SELECT 'ProfileRow' AS label, uid || ':' || scheme_beneficiary_id AS key, count(*) AS copies FROM prof GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'Member', ration_card_memberid, count(*) FROM person_src GROUP BY ALL HAVING count(*) > 1""")
def _(s):
    # Node tables are unique by construction; their source rows are the ones that can repeat.
    return g.key_violations({
        "Citizen": (s.scored, "uid"), "Enrollment": (s.enrollment_nodes, "enrollment_key"), "Scheme": (s.scheme_names, "scheme_id"),
        "ProfileRow": (s.profile, "enrollment_key"), "Member": (s.persons, "ration_card_memberid"),
    })


def mobile_hubs(s):
    """Mobile hubs as they would stand before hardening: one per (number, GP)."""
    edges = s.profile.where("mobile <> ''").select("uid", F.col("mobile").alias("number"), F.concat_ws("@", "mobile", "gp_code").alias("hub_id")).distinct()
    hubs = edges.select("hub_id", "number").distinct()
    # Hubs of other operators' numbers that no citizen uses any more.
    unused = s.persons.where("mobile <> ''").select(F.concat_ws("@", "mobile", F.lit("0")).alias("hub_id"), F.col("mobile").alias("number")).distinct()
    return hubs.unionByName(unused).distinct(), edges


HUBS = """SELECT DISTINCT mobile || '@' || gp_code AS hub_id, mobile AS number FROM prof WHERE mobile <> ''
 UNION SELECT DISTINCT mobile || '@0', mobile FROM person_src WHERE mobile <> ''"""


@query("gra_13", f"""
WITH hubs AS ({HUBS}), kept AS (SELECT number, min(hub_id) AS hub_id FROM hubs GROUP BY 1)
SELECT DISTINCT uid, hub_id FROM prof JOIN kept ON number = mobile WHERE mobile <> ''""")
def _(s):
    hubs, edges = mobile_hubs(s)
    return g.merge_hubs(hubs, edges)


@query("gra_14", f"SELECT hub_id, number FROM ({HUBS}) WHERE hub_id IN (SELECT mobile || '@' || gp_code FROM prof WHERE mobile <> '')")
def _(s):
    hubs, edges = mobile_hubs(s)
    return g.drop_orphans(hubs, edges)


@query("gra_15", f"""
SELECT uid, coalesce(CASE WHEN is_ghost_flag THEN true END, false) AS is_ghost_flag, is_dup_flag, false AS is_anomaly_flag,
 age FROM flag_state""")
def _(s):
    # Marks and ages as an older graph would hold them: set ones only.
    old = s.state.select(
        "uid", "dob", F.when(F.col("is_ghost_flag"), F.lit(True)).alias("is_ghost_flag"), "is_dup_flag",
        F.lit(None).cast("boolean").alias("is_anomaly_flag"), F.when(F.col("is_dup_flag"), F.col("age")).alias("age"))
    return g.align_flags(old, s.as_of).drop("dob")


@query("gra_16", f"""
SELECT uid, enrollment_count, scheme_count, {big('transaction_rows')}, {num('transaction_total_amount')}, {ts('latest_transaction_timestamp')}, has_transactions,
 {big('tran_count_1')}, {big('tran_count_2')} FROM rollups""")
def _(s):
    return g.citizen_rollups(s.enrollment_nodes)


@query("gra_17", """
SELECT 'gp' AS kind, gp_code AS key, count(DISTINCT uid) AS total FROM places GROUP BY 2
UNION ALL SELECT 'scheme', scheme_id, count(DISTINCT uid) FROM schemes GROUP BY 2""")
def _(s):
    gp = g.gp_totals(s.places).select(F.lit("gp").alias("kind"), F.col("gp_code").alias("key"), F.col("total_citizens").alias("total"))
    return gp.unionByName(s.scheme_totals.select(F.lit("scheme").alias("kind"), F.col("scheme_id").alias("key"), F.col("beneficiary_count").alias("total")))


@query("gra_18", """
SELECT 'Citizen' AS label, count(DISTINCT uid) AS node_count FROM prof UNION ALL SELECT 'District', count(DISTINCT district_code) FROM prof
UNION ALL SELECT 'Block', count(DISTINCT block_code) FROM prof UNION ALL SELECT 'GP', count(DISTINCT gp_code) FROM prof
UNION ALL SELECT 'Scheme', count(DISTINCT scheme_id) FROM prof UNION ALL SELECT 'Enrollment', count(DISTINCT enrollment_key) FROM prof
UNION ALL SELECT 'RationCard', count(DISTINCT nullif(ration_card_number, '')) FROM prof UNION ALL SELECT 'Mobile', count(DISTINCT nullif(mobile, '')) FROM prof
UNION ALL SELECT 'Address', count(DISTINCT nullif(address_sanitized, '')) FROM prof
UNION ALL SELECT 'PayoutMonth', count(DISTINCT scheme_id || ':' || financial_year || ':' || installment_year || ':' || installment_month_code) FROM windows""")
def _(s):
    return g.graph_stats(s.profile, g.payout_windows(s.txn))


FLOOR_AGE = "2024 - year(d) - CASE WHEN 601 < month(d) * 100 + day(d) THEN 1 ELSE 0 END"


@query("sc_1", f"""
SELECT c_custkey, {AGE} AS age, {FLOOR_AGE} AS age_calendar, CASE WHEN d IS NOT NULL THEN greatest({FLOOR_AGE}, 0) END AS age_derived
FROM (SELECT c_custkey, cast(try_strptime(member_dob, '%Y-%m-%d') AS date) AS d FROM person_src)""")
def _(s):
    dob = F.col("member_dob")
    return s.persons.select(
        "c_custkey", age_years(iso_date(dob), s.as_of).alias("age"), age_calendar(parse_dob(dob), s.as_of).alias("age_calendar"),
        derive_age(dob, s.as_of).alias("age_derived"))


@query("sc_2", "SELECT uid, vulnerability_score, risk_tier FROM scored")
def _(s):
    return sc.vulnerability(g.citizen_nodes(s.profile, s.as_of), s.schemes).select("uid", "vulnerability_score", "risk_tier")


@query("sc_3", "SELECT vulnerability_score AS score, risk_tier AS tier, count(*) AS citizens FROM scored GROUP BY 1, 2")
def _(s):
    return s.scored.groupBy(F.col("vulnerability_score").alias("score"), sc.risk_tier(F.col("vulnerability_score")).alias("tier")).agg(F.count("*").alias("citizens"))


@query("sc_4", """
SELECT count(*) AS total_citizens, floor(coalesce(avg(vulnerability_score), 0.0) * 10 + 0.5) / 10 AS avg_vulnerability, count(*) FILTER (WHERE vulnerability_score >= 61) AS critical_count,
 count(*) FILTER (WHERE vulnerability_score >= 41 AND vulnerability_score < 61) AS high_risk_count, count(*) FILTER (WHERE gender = 'FEMALE') AS female_count FROM scored""")
def _(s):
    return sc.global_stats(s.scored)


@query("sc_5", """
SELECT district_code, count(*) AS citizen_count, floor(avg(vulnerability_score) * 10 + 0.5) / 10 AS avg_risk_score, count(*) FILTER (WHERE risk_tier = 'CRITICAL') AS critical_count,
 count(*) FILTER (WHERE risk_tier = 'HIGH') AS high_count FROM (SELECT DISTINCT uid, gp_code, block_code, district_code FROM places) JOIN scored USING (uid) GROUP BY 1""")
def _(s):
    return sc.district_stats_cached(s.scored, s.places)


@query("sc_6", """
SELECT gp_code, count(DISTINCT uid) AS total_citizens, count(DISTINCT CASE WHEN risk_tier IN ('HIGH','CRITICAL') OR vulnerability_score >= 60 OR is_ghost_flag OR is_dup_flag THEN uid END) AS high_risk_count,
 count(DISTINCT CASE WHEN risk_tier IN ('HIGH','CRITICAL') OR vulnerability_score >= 60 OR is_ghost_flag OR is_dup_flag THEN uid END) / count(DISTINCT uid) AS high_risk_pct
FROM places JOIN flag_state USING (uid) GROUP BY 1""")
def _(s):
    return sc.gp_risk(s.state, s.places)
