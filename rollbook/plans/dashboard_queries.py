"""Dashboard and case-work queries (DSH)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dashboards as d
from ..operators import feed as fd
from ..operators import rules as r
from ..sources import tables as t
from .base import num, query, ts
from .oracle import view
from .rule_queries import raw_people

REGISTRY_TOTAL = 2234522
NOW = "2024-01-31 00:00:00"
CRITICAL = "risk_tier = 'CRITICAL' OR coalesce(vulnerability_score, 0) >= 80"
HIGH = "risk_tier IN ('HIGH', 'CRITICAL') OR coalesce(vulnerability_score, 0) >= 60"

view("feed_all", """
SELECT rule, label, type, description, name, uid, coalesce(dob, 'Unknown') AS dob, 'Unknown' AS gp_name, coalesce(f.district, 'Unknown') AS district, confidence, detected_at,
 coalesce(scheme, 'N/A') AS scheme, other_uid
FROM (SELECT uid, rule, label, type, description, confidence, detected_at, NULL AS other_uid FROM citizen_flags
 UNION ALL SELECT uid1, 'B1', 'B1', 'DUPLICATE', 'Potential duplicate with ' || s.name || ' (UID: ' || uid2 || ')', 92, NULL, uid2 FROM dup_pairs JOIN (SELECT uid, name FROM scored) s ON s.uid = uid2
 UNION ALL SELECT uid1, 'B3', 'B3', 'DUPLICATE', 'Same DOB at GP as ' || s.name || ' (UID: ' || uid2 || ')', 80, NULL, uid2 FROM dob_pairs JOIN (SELECT uid, name FROM scored) s ON s.uid = uid2) x
JOIN (SELECT uid, name, dob FROM scored) USING (uid) LEFT JOIN first_place f USING (uid) LEFT JOIN (SELECT uid, min(scheme_id) AS scheme FROM schemes GROUP BY 1) USING (uid)
UNION ALL SELECT rule, label, type, description, CASE WHEN entity = 'card' THEN 'Ration Card ' ELSE 'Operator ' END || entity_id, entity_id, 'Unknown', 'N/A', 'N/A', confidence, detected_at, 'N/A', NULL
 FROM flags WHERE entity <> 'citizen'""")
FEED_ORDER = "confidence DESC, detected_at DESC NULLS FIRST, uid, rule, other_uid NULLS FIRST"
FEED_COLS = ", ".join(fd.COLUMNS)
# Entries: a flag, or all pair rows of a rule and first citizen with the text before the partner.
view("feed_entries", f"""SELECT {FEED_COLS}, 1 AS rows FROM feed_all WHERE other_uid IS NULL
UNION ALL SELECT rule, label, type, CASE rule WHEN 'B1' THEN 'Potential duplicate with ' ELSE 'Same DOB at GP as ' END, name, uid, dob, gp_name, district, confidence, detected_at, scheme, count(*) FROM feed_all
 WHERE other_uid IS NOT NULL GROUP BY ALL""")


def page(s, limit: int, offset: int = 0):
    return fd.page(s.feed_index, s.feed_members, s.citizens, limit, offset)


@query("dsh_1", """SELECT count(DISTINCT entity_id) FILTER (WHERE entity = 'citizen') AS citizen_cases, count(DISTINCT entity_id) FILTER (WHERE entity = 'operator') AS operator_cases,
 count(DISTINCT entity_id) FILTER (WHERE entity = 'card') AS household_cases, count(DISTINCT (entity, entity_id)) AS total FROM flags""")
def _(s):
    return d.flagged_cases(s.flags)


@query("dsh_2", f"""
SELECT *, {REGISTRY_TOTAL} AS registry_total, round(total_citizens / {REGISTRY_TOTAL} * 100, 1) AS coverage_pct FROM (
SELECT count(*) AS total_citizens, floor(avg(vulnerability_score) * 100 + 0.5) / 100 AS avg_vulnerability, count(*) FILTER (WHERE {CRITICAL}) AS critical_count,
 count(*) FILTER (WHERE {HIGH}) AS high_risk_count, count(*) FILTER (WHERE lower(gender) = 'female') AS female_count, count(*) FILTER (WHERE risk_tier = 'CRITICAL') AS critical_tier_count FROM scored)""")
def _(s):
    return d.kpi_stats(s.citizens, REGISTRY_TOTAL)


@query("dsh_3", f"""
SELECT district_name AS district, count(DISTINCT uid) AS citizen_count, floor(avg(vulnerability_score) * 100 + 0.5) / 100 AS avg_risk_score,
 count(DISTINCT CASE WHEN {CRITICAL} THEN uid END) AS critical_count, count(DISTINCT CASE WHEN {HIGH} THEN uid END) AS high_count
FROM (SELECT DISTINCT uid, gp_code, block_code, district_name FROM places) JOIN scored USING (uid) GROUP BY 1""")
def _(s):
    return d.heatmap(s.citizens, s.places)


view("scheme_text", "SELECT uid, string_agg(DISTINCT scheme_name, ',' ORDER BY scheme_name) AS schemes FROM schemes GROUP BY 1")
view("scheme_ids", "SELECT uid, string_agg(DISTINCT scheme_id, ',' ORDER BY scheme_id) AS schemes FROM schemes GROUP BY 1")


def _top_risk_sql(where: str) -> str:
    return f"""SELECT name, gender, dob, uid, vulnerability_score AS score, risk_tier AS tier, district, block, gp, schemes FROM scored LEFT JOIN first_place USING (uid) LEFT JOIN scheme_text USING (uid)
 WHERE {where} ORDER BY vulnerability_score DESC, uid LIMIT 20"""


@query("dsh_4", _top_risk_sql("true"))
def _(s):
    return d.top_risk(s.citizens, s.places, s.schemes, 2024)


@query("dsh_4_high_elderly", _top_risk_sql("risk_tier = 'HIGH' AND try_cast(split_part(dob, '-', 1) AS int) <= 1964"))
def _(s):
    return d.top_risk(s.citizens, s.places, s.schemes, 2024, tier="high", segment="elderly")


@query("dsh_4_children", _top_risk_sql("try_cast(split_part(dob, '-', 1) AS int) >= 2006"))
def _(s):
    return d.top_risk(s.citizens, s.places, s.schemes, 2024, segment="children")


@query("dsh_4_workers", _top_risk_sql("try_cast(split_part(dob, '-', 1) AS int) > 1964 AND try_cast(split_part(dob, '-', 1) AS int) < 2006"))
def _(s):
    return d.top_risk(s.citizens, s.places, s.schemes, 2024, segment="workers")


@query("dsh_5", "SELECT risk_tier AS tier, count(*) AS citizen_count FROM scored GROUP BY 1")
def _(s):
    return d.score_distribution(s.citizens)


@query("dsh_6", """
SELECT uid, name, coalesce(dob, 'Unknown') AS dob, coalesce(gp, 'Unknown') AS shared_gp, coalesce(scheme, 'General') AS scheme, confidence, rule, description
FROM (SELECT * FROM citizen_flags WHERE type = 'GHOST' ORDER BY confidence DESC, uid, rule LIMIT 200) JOIN (SELECT uid, name, dob FROM scored) USING (uid)
LEFT JOIN first_place USING (uid) LEFT JOIN (SELECT uid, min(scheme_name) AS scheme FROM schemes GROUP BY 1) USING (uid)""")
def _(s):
    return d.ghost_list(s.citizens, s.places, s.schemes, s.flags)


@query("dsh_7", f"SELECT {FEED_COLS} FROM feed_all ORDER BY {FEED_ORDER} LIMIT 500 OFFSET 100")
def _(s):
    return page(s, 500, 100).select(*fd.COLUMNS)


@query("dsh_7_deep", f"SELECT {FEED_COLS} FROM feed_all ORDER BY {FEED_ORDER} LIMIT 300 OFFSET 3000")
def _(s):
    return page(s, 300, 3000).select(*fd.COLUMNS)


@query("dsh_7_all", f"""SELECT *, coalesce(sum(rows) OVER (ORDER BY confidence DESC, detected_at DESC NULLS FIRST, uid, rule, label, description ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS first_rank
 FROM feed_entries""")
def _(s):
    return s.feed_index.numbered().select(*fd.COLUMNS, "rows", F.col("before").alias("first_rank"))


@query("dsh_8", "SELECT (SELECT count(*) FROM flags) + (SELECT count(*) FROM dup_pairs) + (SELECT count(*) FROM dob_pairs) AS total")
def _(s):
    return d.feed_total(s.flags, s.dup, s.dob)


FEED_ID = "substring(sha256(coalesce(rule, '') || '|' || coalesce(uid, '') || '|' || coalesce(name, '') || '|' || coalesce(detected_at, '') || '|' || coalesce(description, '')), 1, 24)"


@query("dsh_9", f"SELECT rule, uid, name, confidence, rows, {FEED_ID} AS id FROM feed_entries")
def _(s):
    return d.feed_ids(s.feed_entries).select("rule", "uid", "name", "confidence", "rows", "id")


@query("dsh_9_page", f"SELECT rule, uid, name, confidence, {FEED_ID} AS id FROM (SELECT * FROM feed_all ORDER BY {FEED_ORDER} LIMIT 500 OFFSET 1000)")
def _(s):
    return d.feed_ids(page(s, 500, 1000)).select("rule", "uid", "name", "confidence", "id")


# Reviews: an event reviews the feed row of the flag table with its number, spread over 200 rows.
ACTIONS = {"purchase": "APPROVE", "error": "REJECT", "signup": "ESCALATE", "view": "NEEDS_FIELD_VERIFICATION", "click": "invalid"}
ACTION_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTIONS.items()) + " END"
view("reviews", f"""SELECT event_id AS review_id, cast(event_id % 200 AS varchar) AS decision_id, {ACTION_SQL} AS action, CASE WHEN event_id % 4 = 0 THEN NULL ELSE props END AS note,
 strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS reviewed_at FROM events""")


def reviews(s):
    e = t.raw(s.spark, s.sf_dir, "events")
    return e.select(
        F.col("event_id").alias("review_id"), (F.col("event_id") % 200).cast("string").alias("decision_id"), F.expr(ACTION_SQL).alias("action"),
        F.when(F.col("event_id") % 4 != 0, F.col("props")).alias("note"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("reviewed_at"))


# Decision ids are row numbers here, so a feed row gets one from the digits of its subject.
REVIEW_KEY = "cast(cast(regexp_extract(uid, '[0-9]+', 0) AS bigint) % 250 AS string)"
LATEST = """(SELECT decision_id, arg_max(action, (reviewed_at, review_id)) AS review_action, arg_max(coalesce(note, '-'), (reviewed_at, review_id)) AS review_note, max(reviewed_at) AS reviewed_at FROM reviews GROUP BY 1)"""


def reviewed(s):
    return d.with_reviews(s.feed_entries.withColumn("decision_id", F.expr(REVIEW_KEY)), reviews(s), "decision_id")


def _reviewed(feed: str) -> str:
    return f"SELECT p.*, review_action, nullif(review_note, '-') AS review_note, reviewed_at FROM (SELECT *, {REVIEW_KEY} AS decision_id FROM {feed}) p LEFT JOIN {LATEST} USING (decision_id)"


view("reviewed", _reviewed("feed_all"))
view("reviewed_entries", _reviewed("feed_entries"))


@query("dsh_10", "SELECT rule, uid, description, rows, review_action, review_note, reviewed_at FROM reviewed_entries")
def _(s):
    return reviewed(s).select("rule", "uid", "description", "rows", "review_action", "review_note", "reviewed_at")


@query("dsh_11", """
SELECT *, count(*) OVER (PARTITION BY rule) AS rule_total FROM (SELECT rule, confidence, gp_code AS subject, gp_name || '/' || block AS detail FROM c1_all
 UNION ALL SELECT rule, confidence, uid, scheme_a || '/' || scheme_b FROM c2_all)""")
def _(s):
    return d.anomalies(r.rule_c1(s.scored, s.places, None), r.rule_c2(s.scored, s.schemes, None))


def _queue_sql(flag_where: str = "true", place_where: str = "true") -> str:
    return f"""(SELECT uid, count(DISTINCT rule) AS flags, string_agg(DISTINCT upper(rule), ',' ORDER BY upper(rule)) AS rule_codes,
 string_agg(DISTINCT description, ' | ' ORDER BY description) AS flag_notes, list_sort(list_distinct(list(label || ': ' || description)))[1:2] AS first_notes
 FROM citizen_flags WHERE {flag_where} AND uid IN (SELECT uid FROM places WHERE {place_where}) GROUP BY 1)"""


def _audit_sql(limit: int, flag_where: str = "true", place_where: str = "true") -> str:
    return f"""SELECT name, uid, dob, gender, vulnerability_score AS score, district, block, gp, flags, rule_codes, flag_notes, coalesce(scheme, 'N/A') AS scheme
 FROM {_queue_sql(flag_where, place_where)} JOIN scored USING (uid) LEFT JOIN (SELECT uid, min(district_name) AS district, min(block_name) AS block, min(gp_name) AS gp FROM places WHERE {place_where} GROUP BY 1) USING (uid)
 LEFT JOIN (SELECT uid, min(scheme_id) AS scheme FROM schemes GROUP BY 1) USING (uid) ORDER BY flags DESC, vulnerability_score DESC, uid LIMIT {limit}"""


view("queue", _audit_sql(50))
view("seeds", "SELECT uid, name FROM queue ORDER BY flags DESC, score DESC, uid LIMIT 20")


def queue(s, limit: int = 50):
    return d.audit_queue(s.citizens, s.places, s.schemes, s.flags, limit)


def seeds(s):
    """Citizens a case worker opens first: the head of the audit queue."""
    return s._written("seeds", lambda: queue(s, 20)).select("uid", "name")


@query("dsh_12", "SELECT * FROM queue")
def _(s):
    return queue(s)


@query("dsh_12_filtered", _audit_sql(50, "rule IN ('A1', 'H1')", "district_name = 'ASIA' AND block_name = 'BLOCK_20'"))
def _(s):
    return d.audit_queue(s.citizens, s.places, s.schemes, s.flags, 50, ["a1", " H1"], "ASIA", "BLOCK_20")


@query("dsh_12_total", "SELECT count(DISTINCT uid) AS total FROM citizen_flags WHERE rule IN ('A1', 'H1') AND uid IN (SELECT uid FROM places WHERE district_name = 'ASIA')")
def _(s):
    return d.audit_queue_total(s.citizens, s.places, s.flags, ["A1", "H1"], "ASIA")


@query("dsh_13", """
SELECT DISTINCT 'district' AS kind, district_name AS value, NULL AS value2 FROM places UNION ALL SELECT DISTINCT 'block', block_name, NULL FROM places
UNION ALL SELECT DISTINCT 'district_block', district_name, block_name FROM places UNION ALL SELECT DISTINCT 'rule', rule, NULL FROM citizen_flags""")
def _(s):
    return d.filter_values(s.places, s.flags)


@query("dsh_14", f"""
SELECT rule, rule IN (SELECT rule FROM citizen_flags) AS detected FROM (SELECT unnest({d.CANONICAL_RULES}) AS rule UNION SELECT rule FROM citizen_flags)""")
def _(s):
    return d.audit_rules(s.spark, s.flags)


def _case(table: dict, key: str, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{default}' END"


@query("dsh_15", f"""
SELECT name, uid, district, gp || ' / ' || block AS region, flags,
 array_to_string([c || ' - ' || {_case(d.RULE_NAMES, 'c', 'Unclassified Rule')} FOR c IN string_split(rule_codes, ',')], '; ') AS rules_text,
 'Why flagged: ' || {_case(d.RULE_EXPLANATIONS, "split_part(rule_codes, ',', 1)", 'General anomaly for field verification.')} || ' | Signal details: ' || array_to_string(first_notes, ' | ') AS justification
FROM {_queue_sql()} JOIN (SELECT uid, name FROM scored) USING (uid) LEFT JOIN first_place USING (uid)""")
def _(s):
    return d.audit_brief(s.citizens, s.places, s.flags)


view("op_audit", """
SELECT uid, name, vulnerability_score AS risk_score, risk_tier AS tier, gender, dob, coalesce(flags, '') AS flags, coalesce(flag_count, 0) AS flag_count
FROM scored LEFT JOIN (SELECT uid, string_agg(rule || ':' || type || ':' || confidence, ',' ORDER BY confidence DESC, rule) AS flags, count(*) AS flag_count FROM citizen_flags GROUP BY 1) USING (uid)
WHERE uid IN (SELECT uid FROM operators WHERE operator_id = 'OP7')""")


@query("dsh_16", "SELECT * FROM op_audit")
def _(s):
    return d.operator_audit(s.citizens, s.operators, s.flags, "OP7")


@query("dsh_17", """SELECT DISTINCT rule, ration_card_number AS subject, member_count AS total, NULL::double AS rate, confidence FROM e1
 UNION ALL SELECT rule, operator_id, total_registrations, fraud_rate, confidence FROM f1""")
def _(s):
    return d.rules_ef(r.rule_e1(s.member_of, s.scored), r.rule_f1(s.operators, s.state))


@query("dsh_18", f"""
SELECT *, CASE WHEN integrity_index >= 95 THEN 'GOOD' WHEN integrity_index >= 85 THEN 'FAIR' ELSE 'POOR' END AS health FROM (
 SELECT total_issues, total_citizens, CASE WHEN total_issues > 0 AND i >= 100 THEN 99.9 ELSE i END AS integrity_index FROM (
  SELECT *, greatest(0.0::double, least(100.0::double, round((1.0::double - total_issues / total_citizens) * 100.0, 1))) AS i FROM (
   SELECT (SELECT cast(sum(issue_count) AS bigint) FROM quality) AS total_issues, (SELECT count(*) FROM person_src) AS total_citizens)))""")
def _(s):
    return d.integrity(r.data_quality(raw_people(s), s.as_of), s.persons)


view("both_dup", "SELECT uid1 AS src, uid2 AS dst FROM dup_pairs UNION ALL SELECT uid2, uid1 FROM dup_pairs")
view("hood", """
SELECT DISTINCT uid AS source, gp_code AS target, 'RESIDES_IN' AS label, '' AS description FROM places JOIN seeds USING (uid)
UNION ALL SELECT src, dst, 'POTENTIAL_DUPLICATE', 'Rule: B1 (Conf: 92%)' FROM both_dup WHERE src IN (SELECT uid FROM seeds)
UNION ALL SELECT uid1, uid2, 'SAME_DOB_AT_GP', 'Cluster size: ' || n FROM dob_pairs WHERE uid1 IN (SELECT uid FROM seeds)
UNION ALL SELECT uid2, uid1, 'SAME_DOB_AT_GP', 'Cluster size: ' || n FROM dob_pairs WHERE uid2 IN (SELECT uid FROM seeds)
UNION ALL SELECT uid, 'FLAG_' || rule || '_' || type, 'FLAGGED_AS', 'Conf: ' || confidence || '%' FROM citizen_flags JOIN seeds USING (uid)
UNION ALL SELECT DISTINCT gp_code, scheme_id, 'HIGH_RISK_CLUSTER', '' FROM c1s WHERE gp_code IN (SELECT gp_code FROM places JOIN seeds USING (uid))""")


def hood(s):
    return d.neighborhood(s.citizens, s.places, s.flags, s.dup, s.dob, s.c1, s.scheme_names, seeds(s))


@query("dsh_19", "SELECT * FROM hood")
def _(s):
    return hood(s)


@query("dsh_19_nodes", """
WITH ends AS (SELECT source AS id FROM hood UNION SELECT target FROM hood)
SELECT id, name AS label, 'Citizen' AS type, risk_tier FROM ends JOIN scored ON uid = id
UNION ALL SELECT id, min(gp_name), 'GP', NULL FROM ends JOIN places ON gp_code = id GROUP BY id
UNION ALL SELECT id, scheme_name, 'Scheme', NULL FROM ends JOIN scheme_names ON scheme_id = id
UNION ALL SELECT DISTINCT id, type || ': ' || description, 'FraudFlag', NULL FROM ends JOIN flags ON id = 'FLAG_' || rule || '_' || type""")
def _(s):
    return d.node_rows(hood(s), s.citizens, s.places, s.flags, s.scheme_names)


PRIORITY = "cast(is_ghost_flag OR is_dup_flag OR is_anomaly_flag OR risk_tier IN ('HIGH','CRITICAL') OR uid IN (SELECT uid FROM citizen_flags) AS int)"
view("slice", f"SELECT c.*, gp_code, block_code, district_code, {PRIORITY} AS priority_score FROM citizens c LEFT JOIN places USING (uid) ORDER BY priority_score DESC, vulnerability_score DESC, uid, gp_code LIMIT 1200")
view("scheme_slice", f"SELECT c.*, {PRIORITY} AS priority_score FROM citizens c WHERE uid IN (SELECT uid FROM schemes WHERE scheme_id = 'S767') ORDER BY priority_score DESC, vulnerability_score DESC, uid LIMIT 1500")


def _slice_links(name: str, scheme: str) -> str:
    return f"""SELECT DISTINCT uid AS source, scheme_id AS target, 'ENROLLED_IN' AS label, 'Status: Active' AS description FROM schemes WHERE uid IN (SELECT uid FROM {name}) {scheme}
UNION ALL SELECT uid1, uid2, 'POTENTIAL_DUPLICATE', 'Rule: B1 (92%)' FROM dup_pairs WHERE uid1 IN (SELECT uid FROM {name})
UNION ALL SELECT uid, 'FLAG_' || rule || '_' || type, 'FLAGGED_AS', 'Conf: ' || confidence || '%' FROM citizen_flags WHERE uid IN (SELECT uid FROM {name})"""


@query("dsh_20", f"""
SELECT DISTINCT 'block_code:' || block_code AS source, 'district_code:' || district_code AS target, 'PART_OF' AS label, '' AS description FROM slice
UNION ALL SELECT DISTINCT 'gp_code:' || gp_code, 'block_code:' || block_code, 'PART_OF', '' FROM slice UNION ALL SELECT DISTINCT uid, 'gp_code:' || gp_code, 'RESIDES_IN', '' FROM slice
UNION ALL {_slice_links('slice', '')}""")
def _(s):
    return d.slice_rows(s.citizens, s.places, s.schemes, s.flags, s.dup)


@query("dsh_20_nodes", """
SELECT DISTINCT uid, name, risk_tier, priority_score, CASE WHEN fraud_reason IS NOT NULL THEN 'FraudFlag' ELSE 'Citizen' END AS type, fraud_reason FROM (
 SELECT *, coalesce(flag_text, CASE WHEN is_ghost_flag THEN 'Ghost/Deceased Account' WHEN is_dup_flag THEN 'Duplicate Identity' WHEN is_anomaly_flag THEN 'Usage Anomaly'
  WHEN risk_tier IN ('HIGH','CRITICAL') THEN 'Risk Tier: ' || risk_tier END) AS fraud_reason
 FROM slice LEFT JOIN (SELECT uid, min(type || ': ' || description) AS flag_text FROM citizen_flags GROUP BY 1) USING (uid))""")
def _(s):
    return d.slice_nodes(s.citizens, s.places, s.flags)


@query("dsh_21", _slice_links("scheme_slice", "AND scheme_id = 'S767'"))
def _(s):
    return d.slice_rows(s.citizens, s.places, s.schemes, s.flags, s.dup, 1500, "S767")


@query("dsh_22", """SELECT scheme_id AS id, scheme_name AS name, (SELECT count(DISTINCT uid) FROM schemes x WHERE x.scheme_id = n.scheme_id) AS citizen_count,
 (SELECT count(DISTINCT enrollment_key) FROM prof x WHERE x.scheme_id = n.scheme_id) AS enrollment_count FROM scheme_names n""")
def _(s):
    return d.scheme_catalog(s.schemes, s.profile, s.scheme_names)


@query("dsh_23", """SELECT uid, scheme_name, name, dob, gender, district, block, gp FROM (SELECT DISTINCT uid, scheme_name FROM schemes WHERE scheme_id = 'S767' ORDER BY uid LIMIT 50)
 JOIN (SELECT uid, name, dob, gender FROM scored) USING (uid) LEFT JOIN first_place USING (uid)""")
def _(s):
    return d.scheme_citizens(s.citizens, s.places, s.schemes, "S767")


@query("dsh_24", "SELECT uid, name, dob, gender, age FROM scored WHERE age > 60 AND uid IN (SELECT uid FROM schemes WHERE scheme_id = 'S767') ORDER BY age DESC, uid LIMIT 100")
def _(s):
    return d.scheme_age(s.citizens, s.schemes, "S767", 60)


# Names asked for: the second word of the names at the head of the audit queue, and two misses.
view("asked", "SELECT DISTINCT lower(split_part(name, ' ', 2)) AS query FROM seeds UNION SELECT 'zz nobody' UNION SELECT 'an x steel'")


def asked(s):
    word = F.lower(F.element_at(F.split("name", " "), 2))
    more = s.spark.createDataFrame([("zz nobody",), ("an x steel",)], "query string")
    return seeds(s).select(word.alias("query")).unionByName(more).where("query <> ''").distinct()


FLAG_TEXT = "(SELECT uid, string_agg(DISTINCT rule || ':' || type || ':' || confidence, ',' ORDER BY rule || ':' || type || ':' || confidence) AS flags FROM citizen_flags GROUP BY 1)"


@query("dsh_25", f"""
SELECT uid, name, dob, gender, vulnerability_score, risk_tier, district, block, gp, coalesce(flags, '') AS flags, schemes, query FROM (
 SELECT *, row_number() OVER (PARTITION BY query ORDER BY uid) AS rn FROM scored JOIN asked ON contains(lower(name), query) WHERE query <> '')
LEFT JOIN first_place USING (uid) LEFT JOIN {FLAG_TEXT} USING (uid) LEFT JOIN scheme_ids USING (uid) WHERE rn <= 5""")
def _(s):
    return d.snapshot_by_name(s.citizens, s.places, s.schemes, s.flags, asked(s))


@query("dsh_26", """
SELECT query, uid, name, district, block, gp FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY uid) AS rn FROM (
  SELECT DISTINCT query, uid, name FROM scored JOIN (SELECT query, unnest(string_split_regex(trim(query), '\\s+')) AS token FROM asked) ON length(token) >= 2 AND contains(lower(name), lower(token))))
LEFT JOIN first_place USING (uid) WHERE rn <= 8""")
def _(s):
    return d.name_suggestions(s.citizens, s.places, asked(s))


@query("dsh_27", f"""
SELECT uid, s.name, dob, gender, vulnerability_score, risk_tier, district, block, gp, coalesce(flags, '') AS flags, schemes, duplicate_uid, duplicate_name, coalesce(duplicate_count, 0) AS duplicate_count
FROM scored s LEFT JOIN first_place USING (uid) LEFT JOIN {FLAG_TEXT} USING (uid) LEFT JOIN scheme_ids USING (uid)
LEFT JOIN (SELECT src AS uid, dst AS duplicate_uid, x.name AS duplicate_name, duplicate_count FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS rn, count(*) OVER (PARTITION BY src) AS duplicate_count FROM both_dup) JOIN scored x ON x.uid = dst WHERE rn <= {d.DRAWN}) USING (uid)
WHERE uid IN (SELECT uid FROM seeds)""")
def _(s):
    return d.snapshot_by_uid(s.citizens, s.places, s.schemes, s.flags, s.dup, seeds(s))


view("asked_ids", "SELECT uid || '' AS uid FROM seeds")
view("asked_benef", "SELECT DISTINCT scheme_beneficiary_id FROM profile_raw WHERE lgd_gp_name = 'JAPAN' AND scheme_id = 'S900'")


def asked_benef(s):
    return s.profile_raw.where("lgd_gp_name = 'JAPAN' AND scheme_id = 'S900'").select("scheme_beneficiary_id").distinct()


@query("dsh_28", f"""
SELECT p.uid, p.scheme_id, p.scheme_beneficiary_id, fullname, gender, member_dob, lgd_district_name, row_no, financial_year, installment_month_code, {num('amount')}, {ts('transaction_timestamp')}, transaction_ref_no
FROM (SELECT * FROM profile_raw WHERE uid IN (SELECT uid FROM seeds) OR scheme_beneficiary_id IN (SELECT scheme_beneficiary_id FROM asked_benef)) p
LEFT JOIN txn_src x ON x.scheme_beneficiary_id = p.scheme_beneficiary_id""".replace("amount", "x.amount").replace("x.amount AS double) AS x.amount", "x.amount AS double) AS amount"))
def _(s):
    return d.citizen_360(s.profile_raw, s.txn, seeds(s).select("uid"), asked_benef(s)).select(
        "uid", "scheme_id", "scheme_beneficiary_id", "fullname", "gender", "member_dob", "lgd_district_name", "row_no", "financial_year", "installment_month_code", "amount",
        "transaction_timestamp", "transaction_ref_no")


@query("dsh_29", "SELECT fullname, lgd_district_name, lgd_block_name, scheme_beneficiary_id FROM profile_raw WHERE fullname ILIKE '%bolt%' ORDER BY 1, 4, 3 LIMIT 10")
def _(s):
    return d.search_citizens(s.profile_raw, "bolt")


def _share(edges: str, hub: str, name: str) -> str:
    return f"LEFT JOIN (SELECT uid, max(n) AS {name} FROM {edges} JOIN (SELECT {hub}, count(DISTINCT uid) AS n FROM {edges} GROUP BY 1) USING ({hub}) GROUP BY 1) USING (uid)"


view("mobiles", "SELECT DISTINCT uid, mobile FROM prof WHERE mobile <> ''")
view("ctx", f"""
SELECT uid, name, dob, age, vulnerability_score, risk_tier, district, block, gp, coalesce(scheme_count2, 0) AS scheme_count, coalesce(duplicate_edges, 0) AS duplicate_edges,
 coalesce(dob_cluster_edges, 0) AS dob_cluster_edges, coalesce(mobile_share_count, 0) AS mobile_share_count, coalesce(household_size, 0) AS household_size,
 coalesce(operator_volume, 0) AS operator_volume, coalesce(flag_count, 0) AS flag_count, coalesce(gp_anomalies, 0) AS gp_anomalies
FROM scored LEFT JOIN first_place USING (uid) LEFT JOIN (SELECT uid, count(DISTINCT scheme_id) AS scheme_count2 FROM schemes GROUP BY 1) USING (uid)
LEFT JOIN (SELECT src AS uid, count(*) AS duplicate_edges FROM both_dup GROUP BY 1) USING (uid)
LEFT JOIN (SELECT uid, count(*) AS dob_cluster_edges FROM (SELECT uid1 AS uid FROM dob_pairs UNION ALL SELECT uid2 FROM dob_pairs) GROUP BY 1) USING (uid)
{_share('mobiles', 'mobile', 'mobile_share_count')} {_share('member_of', 'ration_card_number', 'household_size')} {_share('operators', 'operator_id', 'operator_volume')}
LEFT JOIN (SELECT uid, count(DISTINCT rule) AS flag_count FROM citizen_flags GROUP BY 1) USING (uid)
LEFT JOIN (SELECT uid, count(DISTINCT (gp_code, scheme_id)) AS gp_anomalies FROM places JOIN c1s USING (gp_code) GROUP BY 1) USING (uid)""")


def context(s):
    return d.assessment_context(s.citizens, s.places, s.schemes, s.flags, s.dup, s.dob, s.member_of, s.mobiles, s.operators, s.c1)


@query("dsh_30", "SELECT * FROM ctx")
def _(s):
    return context(s)


@query("dsh_31", """SELECT uid, CASE WHEN duplicate_edges > 0 THEN 'SUSPEND' WHEN dob_cluster_edges > 0 THEN 'INVESTIGATE' WHEN age > 110 OR age < 0 THEN 'SUSPEND'
 WHEN dob IS NULL THEN 'MONITOR' ELSE 'CLEAR' END AS recommendation FROM ctx""")
def _(s):
    return d.recommend(context(s)).select("uid", "recommendation")


@query("dsh_32", """SELECT confidence, CASE WHEN confidence < 30 THEN 'CLEAR' WHEN confidence < 60 THEN 'MONITOR' WHEN confidence < 80 THEN 'INVESTIGATE' ELSE 'SUSPEND' END AS band,
 count(*) AS flag_rows FROM (SELECT confidence FROM flags UNION ALL SELECT vulnerability_score FROM scored) GROUP BY 1, 2""")
def _(s):
    c = F.col("confidence")
    every = s.flags.select(c).unionByName(s.citizens.select(F.col("vulnerability_score").alias("confidence")))
    return every.groupBy("confidence", d.confidence_band(c).alias("band")).agg(F.count("*").alias("flag_rows"))


@query("dsh_33", f"""
SELECT rule, uid, name, confidence, detected_at, district, scheme FROM reviewed WHERE confidence >= 85 AND review_action IS NULL
 AND (detected_at IS NULL OR detected_at >= strftime(TIMESTAMP '{NOW}' - INTERVAL 168 HOUR, '%Y-%m-%d %H:%M:%S'))
 AND contains(lower(concat_ws(' ', coalesce(name, ''), coalesce(uid, ''), coalesce(rule, ''), coalesce(description, ''))), 'ghost')
ORDER BY confidence DESC, coalesce(detected_at, '') DESC, uid, rule, other_uid NULLS FIRST LIMIT 8""")
def _(s):
    rows = fd.filtered(reviewed(s), F.lit(NOW).cast("timestamp"), high_only=True, pending_only=True, hours=168)
    found, members = fd.with_text(rows, s.feed_members, s.citizens, " Ghost ")
    # the dashboard shows pages of eight
    return fd.page(fd.ranked(found, nulls_first=False), members, s.citizens, 8).select("rule", "uid", "name", "confidence", "detected_at", "district", "scheme")


@query("dsh_33_text", """SELECT rule, count(*) AS feed_rows, count(DISTINCT uid) AS subjects FROM feed_all
 WHERE contains(lower(concat_ws(' ', coalesce(name, ''), coalesce(uid, ''), coalesce(rule, ''), coalesce(description, ''))), 'anvil') GROUP BY 1""")
def _(s):
    found, _ = fd.with_text(s.feed_entries, s.feed_members, s.citizens, "anvil")
    return found.groupBy("rule").agg(F.sum("rows").alias("feed_rows"), F.countDistinct("uid").alias("subjects"))


@query("dsh_33_district", f"""
SELECT rule, uid, name, confidence, detected_at, district, scheme FROM reviewed WHERE district = 'EUROPE' AND scheme = 'C501' AND rule = 'H1'
 AND (detected_at IS NULL OR detected_at >= strftime(TIMESTAMP '{NOW}' - INTERVAL 720 HOUR, '%Y-%m-%d %H:%M:%S'))""")
def _(s):
    hits = fd.filtered(reviewed(s), F.lit(NOW).cast("timestamp"), scheme="C501", district="EUROPE", rule="H1", hours=720)
    return hits.select("rule", "uid", "name", "confidence", "detected_at", "district", "scheme")


@query("dsh_34", """
SELECT category, rule, count(*) AS feed_rows FROM (SELECT rule, unnest(list_filter([CASE WHEN type LIKE '%GHOST%' THEN 'ghost' END,
 CASE WHEN regexp_matches(type, 'DUPLICATE|CLONE') OR regexp_matches(rule, '^[BI]') THEN 'duplicate' END,
 CASE WHEN regexp_matches(type, 'ANOMALY|INTERNAL') OR regexp_matches(rule, '^[CFH]') THEN 'anomaly' END], lambda x: x IS NOT NULL)) AS category FROM feed_all) GROUP BY 1, 2""")
def _(s):
    return d.categorise(s.feed_entries).groupBy("category", "rule").agg(F.sum("rows").alias("feed_rows"))


@query("dsh_35", """SELECT coalesce(problem, 'VALID') AS outcome, action, count(*) AS reviews FROM (SELECT *, CASE WHEN action NOT IN ('APPROVE', 'REJECT', 'ESCALATE', 'NEEDS_FIELD_VERIFICATION') THEN 'INVALID_ACTION'
 WHEN action IN ('REJECT', 'ESCALATE') AND trim(coalesce(note, '')) = '' THEN 'NOTE_REQUIRED' END AS problem FROM (SELECT * REPLACE (upper(trim(action)) AS action) FROM reviews)) GROUP BY 1, 2""")
def _(s):
    return d.checked_reviews(reviews(s)).groupBy(F.coalesce("problem", F.lit("VALID")).alias("outcome"), "action").agg(F.count("*").alias("reviews"))


@query("dsh_35_history", """SELECT decision_id, review_id, action, note, reviewed_at, newest_rank FROM (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY reviewed_at DESC, review_id DESC) AS newest_rank
 FROM reviews WHERE action IN ('APPROVE', 'NEEDS_FIELD_VERIFICATION') OR (action IN ('REJECT', 'ESCALATE') AND trim(coalesce(note, '')) <> '')) WHERE newest_rank <= 50""")
def _(s):
    return d.review_history(reviews(s))


DIGITS = "cast(regexp_extract(uid, '[0-9]+', 0) AS bigint)"


def labels(s):
    """A verdict for every citizen: confirmed by parity, with hours to triage and closure."""
    n = F.expr(DIGITS)
    return s.citizens.select(F.col("uid").alias("entity_id"), (n % 2 == 0).alias("confirmed"), (n % 48).alias("triage_hours"), (n % 48 + n % 100).alias("closure_hours"))


@query("dsh_36", f"""
SELECT *, true_positives / (true_positives + false_positives) AS precision, true_positives / (true_positives + false_negatives) AS recall, false_positives / (false_positives + true_negatives) AS false_positive_rate FROM (
SELECT count(*) FILTER (WHERE hit AND n % 2 = 0) AS true_positives, count(*) FILTER (WHERE hit AND n % 2 = 1) AS false_positives, count(*) FILTER (WHERE NOT hit AND n % 2 = 0) AS false_negatives,
 count(*) FILTER (WHERE NOT hit AND n % 2 = 1) AS true_negatives, avg(n % 48) FILTER (WHERE hit) AS avg_triage_hours, avg(n % 48 + n % 100) FILTER (WHERE hit) AS avg_closure_hours
FROM (SELECT {DIGITS} AS n, uid IN (SELECT uid FROM citizen_flags) AS hit FROM scored))""")
def _(s):
    return d.detection_metrics(s.flags.where("entity = 'citizen'"), labels(s))


@query("dsh_37", """
SELECT coalesce(nullif(split_part(rule_codes, ',', 1), ''), 'AUDIT') AS rule, replace(rule_codes, ',', ', ') AS label, 'AUDIT_QUEUE' AS type, name, uid, dob, gp AS gp_name, district, block, scheme,
 greatest(70, least(99, coalesce(nullif(score, 0), flags * 18)))::int AS confidence, split_part(flag_notes, ' | ', 1) AS description FROM queue""")
def _(s):
    return d.queue_as_feed(queue(s))


@query("dsh_38", """SELECT count(*) AS registrations, count(*) FILTER (WHERE flag_count > 0) AS flagged, round(count(*) FILTER (WHERE flag_count > 0) / count(*) * 100, 0) AS flag_rate_pct FROM op_audit""")
def _(s):
    return d.operator_summary(d.operator_audit(s.citizens, s.operators, s.flags, "OP7"))


@query("snk_3", """SELECT rule AS rule_id, coalesce(name, 'Unknown') AS name, coalesce(label, type) AS category, description AS risk_explanation, confidence || '%' AS confidence, coalesce(gp_name, '') AS shared_gp,
 coalesce(dob, '') AS dob, rows AS records FROM feed_entries""")
def _(s):
    return d.export_flags(s.feed_entries)
