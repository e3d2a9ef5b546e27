"""Sink and stream queries (SNK, STR): what the written tables hold afterwards."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import entity_graph as eg
from ..operators import manifests as m
from ..operators.flags import union
from ..session import shared_dir, shuffles_freed
from ..sources import removal, sinks
from ..sources import tables as t
from ..streaming import jobs
from . import eligibility_fixture as fx
from .base import query
from ..operators.graph import PAYOUT_KEYS
from .dashboard_queries import reviews
from .document_queries import KIND, links, stored_chunks, triplets
from .eligibility_queries import concepts, judged, verdicts
from .graph_queries import WIN_OUT, WIN_SQL
from .oracle import view


GRA_8_SQL = f"SELECT {WIN_SQL} FROM windows w"


def run_dir(s, name: str) -> str:
    """A new folder for one run below the shared folder."""
    return f"{shared_dir(s.spark)}/{s.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:8]}"


# A district delivers its persons again, with a new mobile number and some new members.
DELIVERY = "lgd_district_code = 1"


@query("snk_1", f"""
SELECT ration_card_memberid, uid, CASE WHEN {DELIVERY} THEN '800' ELSE mobile END AS mobile, lgd_district_code FROM person_detail
UNION ALL SELECT 'N' || ration_card_memberid, uid, '800', lgd_district_code FROM person_detail WHERE {DELIVERY} AND is_hof = 1""")
def _(s):
    cols = ["ration_card_memberid", "uid", "mobile", "lgd_district_code"]
    target = s.person_detail.select(*cols)
    again = s.person_detail.where(DELIVERY).withColumn("mobile", F.lit("800"))
    fresh = again.where("is_hof = 1").withColumn("ration_card_memberid", F.concat(F.lit("N"), "ration_card_memberid"))
    path = run_dir(s, "upsert")
    sinks.upsert_into(target, path, ["ration_card_memberid"], 0)
    sinks.upsert_into(again.select(*cols).unionByName(fresh.select(*cols)), path, ["ration_card_memberid"], 1)
    return sinks.read_current(s.spark, path)


@query("snk_2")
def _(s):
    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
    tables = {n: (lambda n=n: t.raw(s.spark, s.sf_dir, n)) for n in names}
    return sinks.top_rows(s.spark, tables, 10)


@query("snk_4", """SELECT ration_card_memberid, decision_bucket, 'run' AS evaluation_run_id, 'C501' AS scheme_id FROM verdict_c501""")
def _(s):
    path = run_dir(s, "evaluation")
    rows = verdicts(s, "C501")
    sinks.write_evaluation(
        rows.select("ration_card_memberid", "decision_bucket", "passed_ids", "failed_ids", "unmapped_ids"), m.manifest_summary(rows), path, "run", "C501", {"enrolled_only": False})
    out = s.spark.read.schema("ration_card_memberid string, decision_bucket string, evaluation_run_id string, scheme_id string").json(f"{path}/subjects")
    return out.select("ration_card_memberid", "decision_bucket", "evaluation_run_id", "scheme_id")


@query("snk_5", "SELECT rule_id, decision, count(*) AS rows FROM elig_decisions GROUP BY 1, 2")
def _(s):
    path = run_dir(s, "decisions")
    rows = judged(s).select("rule_id", "uid", "row_no", "decision")
    # every rule is judged twice; the second run of a rule replaces its first
    sinks.replace_decisions(rows.withColumn("decision", F.lit("STALE")), path)
    sinks.replace_decisions(rows, path)
    return s.spark.read.schema(rows.schema).parquet(path).groupBy("rule_id", "decision").agg(F.count("*").alias("rows"))


@query("snk_6", """SELECT sha256(doc_id || ':' || chunk_index) AS point_id, doc_id, chunk_index, element_type, nullif(regexp_extract(upper(filename), '([A-Z][0-9]{3,5})', 1), '') AS scheme_id, length(text) AS chars
FROM chunks JOIN (SELECT doc_id, filename FROM policy_docs) USING (doc_id)""")
def _(s):
    docs = fx.policy_docs(s).select("doc_id", "filename", F.concat(F.lit("documents/"), "filename").alias("object_key"))
    first = sinks.chunk_points(stored_chunks(s), docs)
    path = run_dir(s, "chunks")
    sinks.upsert_into(first, path, ["point_id"], 0)
    sinks.upsert_into(first, path, ["point_id"], 1)
    return sinks.read_current(s.spark, path).select("point_id", "doc_id", "chunk_index", "element_type", "scheme_id", F.length("text").alias("chars"))


view("doc_rules", "SELECT 'D' || cast(doc_id AS varchar) AS rule_id, doc_id FROM policy_docs WHERE scheme_id IS NOT NULL")


# Every table after the removal: its rows, and a sum over the digests of their columns.
REMOVED = {
    "chunks": ("doc_id, chunk_index, text, element_type", "chunks WHERE doc_id NOT IN (SELECT doc_id FROM gone)"),
    "rules": ("rule_id, doc_id", "doc_rules WHERE doc_id NOT IN (SELECT doc_id FROM gone)"),
    "decisions": ("decision_id, rule_id", "(SELECT o_orderkey AS decision_id, 'D' || cast(o_orderkey % 800 AS varchar) AS rule_id FROM orders) WHERE rule_id NOT IN (SELECT rule_id FROM gone_rules)"),
    "manual_inputs": ("input_id, rule_id", "(SELECT c_custkey AS input_id, 'D' || cast(c_custkey AS varchar) AS rule_id FROM customer) WHERE rule_id NOT IN (SELECT rule_id FROM gone_rules)"),
    "project_links": ("project_id, doc_id", "(SELECT project_id, document_id AS doc_id FROM links) WHERE doc_id NOT IN (SELECT doc_id FROM gone)"),
    "entities": ("name, type, document_count", f"(SELECT name, {KIND.replace('X', 'name')} AS type, count(*) AS document_count FROM entity_docs WHERE document_id NOT IN (SELECT doc_id FROM gone) GROUP BY 1)"),
    "entity_documents": ("name, doc_id", "(SELECT name, document_id AS doc_id FROM entity_docs) WHERE doc_id NOT IN (SELECT doc_id FROM gone)"),
    "relations": ("source, relation, target, description, document_count", "(SELECT source, relation, target, r.description, count(DISTINCT document_id) AS document_count FROM triplets JOIN relations r USING (source, relation, target) WHERE document_id NOT IN (SELECT doc_id FROM gone) GROUP BY ALL)"),
    "relation_documents": ("source, relation, target, doc_id", "(SELECT DISTINCT source, relation, target, document_id AS doc_id FROM triplets) WHERE doc_id NOT IN (SELECT doc_id FROM gone)"),
}
_SNK_7 = " UNION ALL ".join(
    f"""SELECT '{name}' AS table_name, count(*) AS rows, cast(sum(('0x' || substr(md5(concat_ws('|', {cols})), 1, 8))::bigint) AS bigint) AS digest FROM {rows}""" for name, (cols, rows) in REMOVED.items())


@query("snk_7", f"""WITH gone AS (SELECT doc_id FROM documents WHERE lang = 'es'), gone_rules AS (SELECT rule_id FROM doc_rules WHERE doc_id IN (SELECT doc_id FROM gone))
{_SNK_7}""")
def _(s):
    raw = lambda n: t.raw(s.spark, s.sf_dir, n)
    rule = lambda c: F.concat(F.lit("D"), c.cast("string")).alias("rule_id")
    found = triplets(s)
    by_doc = {"document_id": "doc_id"}
    tables = {
        "chunks": stored_chunks(s), "rules": fx.policy_docs(s).where("scheme_id IS NOT NULL").select(rule(F.col("doc_id")), "doc_id"),
        "decisions": raw("orders").select(F.col("o_orderkey").alias("decision_id"), rule(F.col("o_orderkey") % 800)),
        "manual_inputs": raw("customer").select(F.col("c_custkey").alias("input_id"), rule(F.col("c_custkey"))), "project_links": links(s).withColumnsRenamed(by_doc),
        "entities": eg.merge_entities(found), "entity_documents": eg.entity_documents(found).withColumnsRenamed(by_doc),
        "relations": eg.merge_relations(found), "relation_documents": eg.relation_documents(found).withColumnsRenamed(by_doc),
    }
    root = run_dir(s, "removal")
    removal.write_tables(tables, root)
    removal.remove_documents(raw("documents").where("lang = 'es'").select("doc_id"), root, 1)
    parts = []
    for name, df in removal.read_tables(s.spark, root).items():
        text = F.concat_ws("|", *[F.col(c.strip()).cast("string") for c in REMOVED[name][0].split(",")])
        digest = F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"))
        parts.append(df.agg(F.count("*").alias("rows"), digest.alias("digest")).select(F.lit(name).alias("table_name"), "rows", "digest"))
    return union(*parts)


# --- streams -----------------------------------------------------------------------------------


@query("str_1", f"""SELECT enrollment_key, enrollment_status AS status, fullname, row_no FROM (SELECT *, row_number() OVER (PARTITION BY enrollment_key ORDER BY scheme_id DESC, scheme_beneficiary_id DESC, row_no DESC) AS rn FROM prof) WHERE rn = 1""")
def _(s):
    cols = ["enrollment_key", "enrollment_status", "fullname", "scheme_id", "scheme_beneficiary_id", "row_no"]
    source, target = run_dir(s, "profile-files"), run_dir(s, "synced")
    rows = s.profile.select(*cols)
    rows.repartition(6, "row_no").write.parquet(source)
    jobs.stream_sync(jobs.file_stream(s.spark, source, rows.schema, files=2), target, f"{target}-checkpoint")
    return sinks.read_current(s.spark, target).select("enrollment_key", F.col("enrollment_status").alias("status"), "fullname", "row_no")


@query("str_1_payouts", GRA_8_SQL)
def _(s):
    return jobs.payout_rows(synced_payouts(s)).select(*WIN_OUT)


@query("str_1_payout_links", """SELECT count(*) AS windows, count(DISTINCT payout_month_key) AS months, cast(sum(transaction_count) AS bigint) AS payments FROM (
 SELECT scheme_id || ':' || financial_year || ':' || installment_year || ':' || installment_month_code AS payout_month_key, transaction_count, coalesce(uid, '') || ':' || scheme_beneficiary_id AS k FROM windows)
 WHERE k IN (SELECT enrollment_key FROM prof)""")
def _(s):
    found = jobs.payouts_of(s.enrollment_keys, synced_payouts(s))
    return found.agg(F.count("*").alias("windows"), F.countDistinct("payout_month_key").alias("months"), F.sum("transaction_count").alias("payments"))


def synced_payouts(s):
    """Payments in six files in no order of time, two a batch."""
    source, target = run_dir(s, "payment-files"), run_dir(s, "payouts")
    rows = t.transactions(s.spark, s.sf_dir, dealt=6).select(*PAYOUT_KEYS, "amount", "transaction_timestamp", "source_sl_no", "transaction_ref_no")
    with shuffles_freed(s.spark):
        rows.write.option("compression", "zstd").parquet(source)
    jobs.stream_payouts(jobs.file_stream(s.spark, source, rows.schema, files=2), target, f"{target}-checkpoint")
    return sinks.read_current(s.spark, target)


@query("str_2", """SELECT suggested_input_field AS field_key, count(DISTINCT doc_id) AS occurrence_count, CASE WHEN count(DISTINCT doc_id) >= 3 THEN 'ACTIVE' ELSE 'CANDIDATE' END AS status, min(doc_id) AS first_seen, max(doc_id) AS last_seen,
 arg_max(evidence_quote, (doc_id, evidence_quote)) FILTER (WHERE evidence_quote IS NOT NULL) AS latest_quote FROM keyword_concepts GROUP BY 1""")
def _(s):
    source, target = run_dir(s, "observations"), run_dir(s, "signals")
    rows = concepts(s).select("doc_id", F.col("suggested_input_field").alias("field_key"), F.col("evidence_quote").alias("quote"))
    # the rows of a document lie in several files, and every fifth row comes twice
    rows = rows.unionByName(rows.where("doc_id % 5 = 0"))
    rows.repartition(6, F.xxhash64("doc_id", "quote", F.rand(7))).write.parquet(source)
    jobs.stream_signals(jobs.file_stream(s.spark, source, rows.schema, files=2), target, f"{target}-checkpoint")
    return sinks.read_current(s.spark, target).select("field_key", "occurrence_count", "status", "first_seen", "last_seen", "latest_quote")


@query("str_3", """SELECT decision_id, arg_max(review_id, (reviewed_at, review_id)) AS review_id, arg_max(action, (reviewed_at, review_id)) AS action FROM reviews GROUP BY 1""")
def _(s):
    source, target = run_dir(s, "review-files"), run_dir(s, "latest-reviews")
    rows = reviews(s).withColumn("reviewed_at", F.col("reviewed_at").cast("timestamp"))
    rows.repartition(3, "review_id").write.parquet(source)
    jobs.stream_reviews(jobs.file_stream(s.spark, source, rows.schema, files=1), target, f"{target}-checkpoint")
    return sinks.read_current(s.spark, target).select("decision_id", "review_id", "action")


def _windows(days: int) -> str:
    return f"""SELECT strftime(d + to_days(-k), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(d + to_days({days} - k), '%Y-%m-%d %H:%M:%S') AS window_end, rule, count(*) AS flags
FROM (SELECT rule, date_trunc('day', strptime(detected_at, '%Y-%m-%d %H:%M:%S')) AS d FROM flags), (SELECT unnest(range(0, {days})) AS k) GROUP BY ALL"""


def recent(s, span: str):
    source, target = run_dir(s, "flag-files"), run_dir(s, f"recent-{span}")
    flag_id = F.sha2(F.to_json(F.struct(*s.flags.columns)), 256).alias("flag_id")
    rows = s.flags.select(flag_id, "entity_id", "rule", F.col("detected_at").cast("timestamp").alias("detected_at"))
    # a third of the flags is delivered again, in other files
    rows = rows.unionByName(rows.where(F.crc32("flag_id") % 3 == 0))
    rows.repartition(3, F.rand(5)).write.parquet(source)
    jobs.stream_recent_flags(jobs.file_stream(s.spark, source, rows.schema, files=1), target, f"{target}-checkpoint", span)
    return sinks.read_current(s.spark, target).select("window_start", "window_end", "rule", "flags")


@query("str_4_24h", _windows(1))
def _(s):
    return recent(s, "24H")


@query("str_4_7d", _windows(7))
def _(s):
    return recent(s, "7D")


@query("str_4_30d", _windows(30))
def _(s):
    return recent(s, "30D")
