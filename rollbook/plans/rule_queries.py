"""Fraud rule and batch run queries (R, RUN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flags as fl
from ..operators import rules as r
from .base import query
from .jobs import run_batch, run_sync
from .oracle import view

view("named_schemes", "SELECT DISTINCT uid, scheme_name AS scheme FROM schemes")
view("a1_all", "SELECT uid, name, dob, age, 95 AS confidence, 'A1_IMPOSSIBLE_AGE' AS rule FROM scored WHERE dob IS NOT NULL AND age > 105")
view("a1", "SELECT * FROM a1_all ORDER BY age DESC, uid LIMIT 500")
view("a2_all", """SELECT uid, name, dob, age, scheme, 85 AS confidence, 'A2_WRONG_AGE_FOR_SCHEME' AS rule FROM scored JOIN named_schemes USING (uid)
 WHERE dob IS NOT NULL AND age < 58 AND (lower(scheme) LIKE '%old age%' OR lower(scheme) LIKE '%pension%')""")
view("a2", "SELECT * FROM a2_all ORDER BY uid, scheme LIMIT 500")
view("a3_all", """SELECT uid, name, dob, age, scheme, 90 AS confidence, 'A3_CHILD_IN_ADULT_SCHEME' AS rule FROM scored JOIN named_schemes USING (uid)
 WHERE dob IS NOT NULL AND age < 18 AND regexp_matches(lower(scheme), 'widow|pension|employment|mgnregs')""")
view("a3", "SELECT * FROM a3_all ORDER BY uid, scheme LIMIT 500")
view("b1_all", """SELECT p.name AS name1, p.name AS name2, uid1, uid2, dob, gender, f.gp AS shared_gp, 1.0::double AS name_similarity, 92 AS confidence, 'B1_EXACT_DUPLICATE' AS rule
 FROM dup_pairs p LEFT JOIN first_place f ON f.uid = uid1 WHERE dob IS NOT NULL""")
view("b1", "SELECT * FROM b1_all ORDER BY uid1, uid2 LIMIT 500")
view("c2_all", """SELECT uid, name, a.scheme AS scheme_a, b.scheme AS scheme_b, 90 AS confidence, 'C2_SCHEME_CONTRADICTION' AS rule FROM named_schemes a JOIN named_schemes b USING (uid) JOIN scored USING (uid)
 WHERE a.scheme <> b.scheme AND ((lower(a.scheme) LIKE '%widow%' AND (lower(b.scheme) LIKE '%married%' OR lower(b.scheme) LIKE '%vivah%'))
  OR (lower(a.scheme) LIKE '%bpl%' AND lower(b.scheme) LIKE '%apl%'))""")
view("c2", "SELECT * FROM c2_all ORDER BY uid, scheme_a, scheme_b LIMIT 50")
view("h1_all", "SELECT uid, name, coalesce(transaction_rows, tran_count_1, 0)::bigint AS trans, 98 AS confidence, 'H1_GHOST_MONETIZATION' AS rule FROM paid_ghosts")
view("h1", "SELECT * FROM h1_all ORDER BY uid LIMIT 100")
view("i1_all", """SELECT a.name AS name1, b.name AS name2, uid1, uid2, member_id AS shared_member_id, 100 AS confidence, 'I1_MEMBER_ID_CONFLICT' AS rule
 FROM member_pairs JOIN scored a ON a.uid = uid1 JOIN scored b ON b.uid = uid2""")
view("i1", """SELECT a.name AS name1, b.name AS name2, uid1, uid2, member_id AS shared_member_id, 100 AS confidence, 'I1_MEMBER_ID_CONFLICT' AS rule
 FROM (SELECT * FROM member_pairs ORDER BY uid1, uid2, ration_card_number LIMIT 100) JOIN scored a ON a.uid = uid1 JOIN scored b ON b.uid = uid2""")
# Bigrams per word, tagged with their occurrence number, so that set overlap is multiset overlap.
view("gram_sets", """
SELECT name, list(g || '#' || rn) AS grams FROM (
 SELECT name, g, row_number() OVER (PARTITION BY name, g) AS rn FROM (
  SELECT name, CASE WHEN length(w) < 2 THEN w ELSE substring(w, i::int, 2) END AS g FROM (
   SELECT name, w, unnest(range(1, greatest(length(w), 2))) AS i FROM (
    SELECT name, unnest(string_split_regex(lower(name), '\\s+')) AS w FROM (SELECT DISTINCT name FROM scored)) WHERE w <> ''))) GROUP BY name""")
view("fuzzy_pairs", """
SELECT name1, name2, uid1, uid2, dob, shared_gp, 2.0 * len(list_intersect(x.grams, y.grams)) / (len(x.grams) + len(y.grams)) AS similarity FROM (
 SELECT a.name AS name1, b.name AS name2, a.uid AS uid1, b.uid AS uid2, a.dob, a.gp_name AS shared_gp FROM
  (SELECT DISTINCT p.uid, gp_code, gp_name, name, dob, gender FROM places p JOIN scored USING (uid) WHERE dob IS NOT NULL) a JOIN
  (SELECT DISTINCT p.uid, gp_code, gp_name, name, dob, gender FROM places p JOIN scored USING (uid) WHERE dob IS NOT NULL) b
  ON a.gp_code = b.gp_code AND a.dob = b.dob AND a.gender = b.gender AND a.uid < b.uid)
JOIN gram_sets x ON x.name = name1 JOIN gram_sets y ON y.name = name2""")
view("b2_all", """SELECT similarity, name1, name2, uid1, uid2, dob, shared_gp, floor(similarity * 100 + 0.5) / 100 AS name_similarity, floor(60 + similarity * 40)::int AS confidence, 'B2_FUZZY_NAME_DUPLICATE' AS rule
 FROM fuzzy_pairs WHERE similarity > 0.82""")
view("b2", "SELECT * EXCLUDE (similarity) FROM b2_all ORDER BY similarity DESC, uid1, uid2, shared_gp LIMIT 500")


@query("r_a1", "SELECT * FROM a1")
def _(s):
    return r.rule_a1(s.scored)


@query("r_a1s", "SELECT uid, age, 85 AS confidence, 'A1' AS rule FROM scored WHERE age > 110")
def _(s):
    return r.sync_a1(s.scored)


@query("r_a2", "SELECT * FROM a2")
def _(s):
    return r.rule_a2(s.scored, s.schemes)


@query("r_a2s", "SELECT uid, age, 90 AS confidence, 'A2' AS rule FROM scored WHERE age < 0")
def _(s):
    return r.sync_a2(s.scored)


@query("r_a3", "SELECT * FROM a3")
def _(s):
    return r.rule_a3(s.scored, s.schemes)


@query("r_b1", "SELECT * FROM b1")
def _(s):
    return r.rule_b1(s.scored, s.places)


@query("r_b1s", """
WITH both_ends AS (SELECT uid1 AS uid, uid2 AS other FROM dup_pairs UNION ALL SELECT uid2, uid1 FROM dup_pairs)
SELECT uid, least(uid, min(other)) AS cluster_id, count(*) AS links, 92 AS confidence, 'B1' AS rule FROM both_ends GROUP BY uid""")
def _(s):
    # Every two members of a cluster are one POTENTIAL_DUPLICATE edge; the SQL counts real pairs.
    out = r.duplicate_clusters(s.scored).select("uid", "cluster_id", (F.col("cluster_size") - 1).alias("links"))
    return r._rule(out, "B1", 92)


@query("r_b2", "SELECT * FROM b2")
def _(s):
    return r.rule_b2(s.scored, s.places)


@query("r_b3", """
WITH both_ends AS (SELECT uid1 AS uid, uid2 AS other, gp_code, dob FROM dob_pairs UNION ALL SELECT uid2, uid1, gp_code, dob FROM dob_pairs)
SELECT uid, gp_code, dob, least(uid, min(other)) AS cluster_id, count(*) + 1 AS cluster_size FROM both_ends GROUP BY uid, gp_code, dob""")
def _(s):
    return r.dob_clusters(s.scored, s.places).select("uid", "gp_code", "dob", "cluster_id", "cluster_size")


@query("r_b4", """
WITH m AS (SELECT DISTINCT p.uid, gp_code, name, dob FROM places p JOIN scored USING (uid) WHERE dob IS NOT NULL AND name <> '')
SELECT a.uid, a.gp_code, a.name, a.dob, count(*) AS cross_links, 65 AS confidence, 'B4' AS rule
FROM m a JOIN m b ON a.name = b.name AND a.dob = b.dob AND a.gp_code <> b.gp_code GROUP BY ALL""")
def _(s):
    return r.rule_b4(s.scored, s.places).drop("cluster_id", "cluster_size")


@query("r_bl", """
SELECT a.uid AS uid1, b.uid AS uid2, a.name AS person_1, b.name AS person_2, a.gp_name AS shared_gp, a.dob, a.gender, 80 AS confidence, 'B1_EXACT_DOB_GENDER_GP' AS rule
FROM (SELECT DISTINCT uid, gp_code, gp_name, name, dob, gender FROM places JOIN scored USING (uid)) a JOIN (SELECT DISTINCT uid, gp_code, name, dob, gender FROM places JOIN scored USING (uid)) b
 ON a.gp_code = b.gp_code AND a.dob = b.dob AND a.gender = b.gender AND a.uid < b.uid ORDER BY uid1, uid2, a.gp_code LIMIT 15""")
def _(s):
    return r.gp_dob_gender_pairs(s.scored, s.places)


view("c1_all", """
SELECT * FROM (SELECT gp_code, gp_name, coalesce(block_name, 'Unknown') AS block, count(*) AS total_citizens, count(*) FILTER (WHERE vulnerability_score >= 60) AS max_risk_count,
 floor(100.0 * count(*) FILTER (WHERE vulnerability_score >= 60) / count(*) + 0.5) / 100 AS concentration_ratio, 75 AS confidence, 'C1_GP_CONCENTRATION_SPIKE' AS rule
 FROM (SELECT DISTINCT uid, gp_code, gp_name, block_name FROM places) JOIN scored USING (uid) GROUP BY 1, 2, 3)
WHERE total_citizens > 5 AND concentration_ratio > 0.5""")
view("c1", "SELECT * FROM c1_all ORDER BY concentration_ratio DESC, gp_code LIMIT 30")


@query("r_c1", "SELECT * FROM c1")
def _(s):
    return r.rule_c1(s.scored, s.places)


view("c1s", """
SELECT gp_code, scheme_id, count(DISTINCT uid) AS gp_beneficiary_count, total_scheme_count, count(DISTINCT uid) / total_scheme_count AS concentration_ratio, 'C1' AS rule
FROM places JOIN schemes USING (uid) JOIN (SELECT scheme_id, count(DISTINCT uid) AS total_scheme_count FROM schemes GROUP BY 1) USING (scheme_id)
GROUP BY gp_code, scheme_id, total_scheme_count HAVING count(DISTINCT uid) >= 50 AND count(DISTINCT uid) / total_scheme_count > 0.15""")


@query("r_c1s", "SELECT * FROM c1s")
def _(s):
    return r.sync_c1(s.places, s.schemes, s.scheme_totals)


@query("r_c2", "SELECT * FROM c2")
def _(s):
    return r.rule_c2(s.scored, s.schemes)


@query("r_c3", """SELECT uid, enrollment_key, scheme_id, approved_date, dob, 80 AS confidence, 'C3' AS rule FROM enr_nodes JOIN (SELECT uid, dob FROM scored) USING (uid)
 WHERE year(try_cast(approved_date AS date)) < year(try_cast(dob AS date))""")
def _(s):
    return r.rule_c3(s.scored, s.enrollment_nodes)


view("quality", """
SELECT 'D1_NULL_DOB' AS "check", count(*) FILTER (WHERE member_dob IS NULL) AS issue_count FROM person_src
UNION ALL SELECT 'D2_PLACEHOLDER_DOB', count(*) FILTER (WHERE member_dob IN ('1900-01-01', '0000-00-00', '')) FROM person_src
UNION ALL SELECT 'D3_FUTURE_DOB', count(*) FILTER (WHERE try_cast(member_dob AS date) > DATE '2024-06-01') FROM person_src
UNION ALL SELECT 'D4_SHORT_NAME', count(*) FILTER (WHERE length(fullname) < 3) FROM person_src
UNION ALL SELECT 'D5_NULL_UID', count(*) FILTER (WHERE uid IS NULL) FROM person_src
UNION ALL SELECT 'D6_NULL_GENDER', count(*) FILTER (WHERE gender IS NULL) FROM person_src""")


def raw_people(s):
    return s.persons.select("uid", F.col("fullname").alias("name"), F.col("member_dob").alias("dob"), "gender")


@query("r_d", "SELECT * FROM quality")
def _(s):
    return r.data_quality(raw_people(s), s.as_of)


@query("r_d1s", "SELECT uid, 60 AS confidence, 'D1' AS rule FROM scored WHERE dob IS NULL OR dob IN ('', 'None')")
def _(s):
    return r.sync_d1(s.scored)


@query("r_d3", """SELECT DISTINCT uid, scheme_beneficiary_id, holders, 88 AS confidence, 'D3' AS rule FROM prof
 JOIN (SELECT scheme_beneficiary_id, count(DISTINCT uid) AS holders FROM prof GROUP BY 1 HAVING count(DISTINCT uid) > 1) USING (scheme_beneficiary_id)""")
def _(s):
    return r.rule_d3(s.profile)


view("big_cards", "SELECT ration_card_number, count(DISTINCT uid) AS member_count FROM member_of GROUP BY 1 HAVING count(DISTINCT uid) > 10")
view("e1", """SELECT ration_card_number, member_count, uid, name AS member, 95 AS confidence, 'E1_HOUSEHOLD_OVERLOAD' AS rule FROM member_of JOIN
 (SELECT * FROM big_cards ORDER BY member_count DESC, ration_card_number LIMIT 50) USING (ration_card_number) JOIN (SELECT uid, name FROM scored) USING (uid)""")


@query("r_e1", "SELECT * FROM e1")
def _(s):
    return r.rule_e1(s.member_of, s.scored)


@query("r_e1s", "SELECT *, 95 AS confidence, 'E1' AS rule FROM big_cards")
def _(s):
    return r.sync_e1(s.member_of)


view("f1_all", """SELECT error_rate, operator_id, total_registrations, fraud_count, floor(error_rate * 100 + 0.5) / 100 AS fraud_rate, 90 AS confidence, 'F1_OPERATOR_CORRUPTION' AS rule
 FROM bad_operators""")
view("f1", "SELECT * EXCLUDE (error_rate) FROM f1_all ORDER BY error_rate DESC, operator_id LIMIT 30")


@query("r_f1", "SELECT * FROM f1")
def _(s):
    return r.rule_f1(s.operators, s.state)


@query("r_h1", "SELECT * FROM h1")
def _(s):
    return r.rule_h1(s.state)


@query("r_i1", "SELECT * FROM i1")
def _(s):
    return r.rule_i1(s.member_of, s.scored)


view("batch_flags", """
SELECT uid, rule, coalesce(label, 'Rule ' || rule) AS label, CASE WHEN rule LIKE 'A%' THEN 'GHOST' WHEN rule LIKE 'B%' THEN 'DUPLICATE' ELSE 'ANOMALY' END AS type, confidence,
 coalesce(description, 'Intelligence flag requiring field audit.') AS description, 'batch' AS ruleset FROM (
 SELECT uid, rule, max(confidence) AS confidence FROM (
  SELECT uid, 'A1' AS rule, confidence FROM a1_all UNION ALL SELECT uid, 'A2', confidence FROM a2_all UNION ALL SELECT uid, 'A3', confidence FROM a3_all
  UNION ALL SELECT uid1, 'B1', confidence FROM b1_all UNION ALL SELECT uid1, 'B2', confidence FROM b2_all UNION ALL SELECT uid, 'C2', confidence FROM c2_all
  UNION ALL SELECT uid, 'H1', confidence FROM h1_all UNION ALL SELECT uid1, 'I1', confidence FROM i1_all) GROUP BY 1, 2)
LEFT JOIN (VALUES """ + ", ".join("('{}', '{}', '{}')".format(a, b.replace("'", "''"), c.replace("'", "''")) for a, b, c in fl.RULE_METADATA) + ") AS m(rule, label, description) USING (rule)")


@query("run_1", "SELECT * FROM batch_flags")
def _(s):
    return fl.persist_flags(s.batch())


@query("run_1_state", """
SELECT uid, is_ghost_flag OR coalesce(g, false) AS is_ghost_flag, is_dup_flag OR coalesce(d, false) AS is_dup_flag, coalesce(a, false) AS is_anomaly_flag
FROM flag_state LEFT JOIN (SELECT uid, bool_or(type = 'GHOST') AS g, bool_or(type = 'DUPLICATE') AS d, bool_or(type = 'ANOMALY') AS a FROM batch_flags GROUP BY 1) USING (uid)""")
def _(s):
    return fl.apply_flags(s.state, s.batch_flags)


@query("run_2", "SELECT operator_id, fraud_rate, fraud_rate IS NOT NULL AS is_suspicious FROM (SELECT DISTINCT operator_id FROM operators) LEFT JOIN f1_all USING (operator_id)")
def _(s):
    return fl.persist_operators(s.operators, r.rule_f1(s.operators, s.state, None))


@query("run_3", """
SELECT 'quality:' || "check" AS step, issue_count AS cases FROM quality UNION ALL SELECT 'scored', count(*) FROM scored
UNION ALL SELECT 'A1', count(*) FROM a1_all UNION ALL SELECT 'A2', count(*) FROM a2_all UNION ALL SELECT 'A3', count(*) FROM a3_all
UNION ALL SELECT 'B1', count(*) FROM b1_all UNION ALL SELECT 'B2', count(*) FROM b2_all UNION ALL SELECT 'C1', count(*) FROM c1_all UNION ALL SELECT 'C2', count(*) FROM c2_all
UNION ALL SELECT 'E1', count(*) FROM big_cards UNION ALL SELECT 'F1', count(*) FROM f1_all UNION ALL SELECT 'H1', count(*) FROM h1_all UNION ALL SELECT 'I1', count(*) FROM i1_all
UNION ALL SELECT 'total_fraud_alerts', (SELECT count(*) FROM a1_all) + (SELECT count(*) FROM a2_all) + (SELECT count(*) FROM a3_all) + (SELECT count(*) FROM b1_all) + (SELECT count(*) FROM b2_all)
 + (SELECT count(*) FROM c1_all) + (SELECT count(*) FROM c2_all) + (SELECT count(*) FROM big_cards) + (SELECT count(*) FROM f1_all) + (SELECT count(*) FROM h1_all) + (SELECT count(*) FROM i1_all)""")
def _(s):
    return run_batch(s, raw_people(s))


@query("run_4", f"""
SELECT 'profiles' AS step, count(*) AS cases, NULL::bigint AS pairs FROM prof UNION ALL SELECT 'payout_windows', count(*), NULL FROM windows UNION ALL SELECT 'scored', count(*), NULL FROM scored
UNION ALL SELECT 'B1', (SELECT count(*) FROM (SELECT DISTINCT name, dob, gender FROM dup_pairs)), count(*) FROM dup_pairs
UNION ALL SELECT 'B3', (SELECT count(*) FROM dob_groups), count(*) FROM dob_pairs
UNION ALL SELECT 'A1', count(*), NULL FROM flags WHERE rule = 'A1' UNION ALL SELECT 'A2', count(*), NULL FROM flags WHERE rule = 'A2' UNION ALL SELECT 'D1', count(*), NULL FROM flags WHERE rule = 'D1'
UNION ALL SELECT 'C1', count(*), NULL FROM c1s UNION ALL SELECT 'E1', count(*), NULL FROM flags WHERE rule = 'E1' UNION ALL SELECT 'F1', count(*), NULL FROM flags WHERE rule = 'F1'
UNION ALL SELECT 'H1', count(*), NULL FROM flags WHERE rule = 'H1'
UNION ALL SELECT 'I1', (SELECT count(DISTINCT uid1) + count(DISTINCT uid2) FROM member_pairs), count(*) FROM member_pairs""")
def _(s):
    return run_sync(s)
