"""Policy documents, rules, manual inputs and manifests the eligibility queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import judging as j
from ..sources import tables as t

LINE = "chr(10)"
# Policy passages put before the text of each document; numbers come from its id.
PASSAGE = f"""CASE doc_id % 6
 WHEN 0 THEN concat('Eligibility: applicants with age between 18 and ', cast(45 + doc_id % 16 AS string), ' who are female widows only may apply. Annual income below Rs ', cast(1 + doc_id % 4 AS string), ' lakh. Scheme S767 replaces S101.')
 WHEN 1 THEN concat('Minimum age ', cast(18 + doc_id % 10 AS string), '. Eligible persons must be unmarried. Income not exceeding 1.5 crore. See C501 and SS_001; not with SS_001.')
 WHEN 2 THEN 'Who can apply: persons with disability, maximum age 60. The applicant must be a permanent resident of West Bengal.'
 WHEN 3 THEN concat('Inclusion: caste SC or OBC, undergraduate regular course. The student must not be receiving any other scholarship.', {LINE}, 'Families covered under any other State insurance scheme are excluded. Families covered under ESI are excluded.')
 WHEN 4 THEN concat('An employee drawing Medical Allowance is not eligible.', {LINE}, {LINE}, 'Exclusion: any other category as may be notified by the State Government. Income up to 90 thousand.')
 ELSE 'General notice.' END"""
CODE = "CASE doc_id % 6 WHEN 0 THEN 'S767' WHEN 1 THEN 'C501' WHEN 2 THEN 'SS_001' WHEN 3 THEN 'S101' WHEN 4 THEN 'S103' END"
POLICY = {
    "doc_id": "doc_id",
    "filename": f"concat('doc_', lang, '_', coalesce({CODE}, 'note'), '_', cast(doc_id % 3 AS string), '.pdf')",
    "scheme_id": CODE,
    "text": f"concat({PASSAGE}, {LINE}, text)",
}


def policy_docs(s) -> DataFrame:
    docs = t.raw(s.spark, s.sf_dir, "documents")
    return docs.select(*[F.expr(sql).alias(name) for name, sql in POLICY.items()])


POLICY_SQL = "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in POLICY.items()) + " FROM documents"

RULES = [
    {"rule_id": "R1", "rule_name": "Health cover", "scheme_id": "S767", "include": [("age", ">=", 18), ("age", "<=", 60), ("gender", "in", ["FEMALE"])],
     "exclude": [("scheme_id", "in", ["SS_001", "S103"]), ("employment_status", "=", "INACTIVE")], "unmapped": [("eligibility_scope", "eligibility_scope", "text")]},
    {"rule_id": "R2", "rule_name": "Scholarship", "scheme_id": "C501", "include": [("caste", "in", ["OBC-A", "OBC-B", "EBC", "General"]), ("annual_income", "<=", 200000)],
     "unmapped": [("no_other_scholarship", "no_other_scholarship", "boolean"), ("single_scholarship_rule", "no_other_scholarship", "boolean")]},
    {"rule_id": "R3", "rule_name": "Disability allowance", "scheme_id": "S103", "include": [("is_disabled", "=", True), ("annual_income", "<", 250000)],
     "exclude": [("retired_or_terminated", "=", True)]},
    {"rule_id": "R4", "rule_name": "Old age pension", "scheme_id": "s101 ", "include": [("member_dob", "<", "1964-06-01"), ("service_duration_months", ">", 1), ("receives_pension", "is_null", None)],
     "exclude": [("age", ">", 115)]},
    {"rule_id": "R5", "rule_name": "Widow support", "scheme_id": "S102", "include": [("marital_status", "=", "Widow"), ("gender", "!=", "MALE"), ("rc_is_hof", "=", True)],
     "exclude": [("rc_ration_card_type_code", "not_in", ["PHH", "AAY"])]},
    {"rule_id": "R6", "rule_name": "Local employment", "scheme_id": "S900", "include": [("employment_status", "not_in", ["INACTIVE", "CLOSED"]), ("ida_covered", "is_null", None), ("gender", "is_not_null", None)]},
    {"rule_id": "R7", "rule_name": "Unreadable policy", "scheme_id": "S900"},
]
# Manual inputs exist for every ninth person and two rules.
MANUAL_RULES = ["R2", "R3"]
MANUAL = {"annual_income": "'2 lakh'", "no_other_scholarship": "CASE WHEN c_custkey % 27 = 0 THEN 'maybe' ELSE 'Yes' END"}


def rules(s) -> DataFrame:
    return j.rule_rows(s.spark, RULES)


def citizens(s) -> DataFrame:
    """Master rows with the registry columns under the names that rules use."""
    rows = s.profile_raw.withColumnRenamed("is_hof", "rc_is_hof").withColumnRenamed("ration_card_type_code", "rc_ration_card_type_code")
    return j.enrich_citizens(j.with_latest_rc(rows.drop("member_status"), s.persons))


def manual(s) -> DataFrame:
    entries = [x for k, v in MANUAL.items() for x in (F.lit(k), F.expr(v))]
    people = s.persons.where("uid IS NOT NULL AND c_custkey % 9 = 0").select("uid", F.create_map(*entries).alias("values"))
    return people.withColumn("rule_id", F.explode(F.array(*[F.lit(r) for r in MANUAL_RULES])))


MANIFESTS = {
    "C501": {
        "scheme_id": "C501", "scheme_name": "Vivah Scholarship APL", "rule_name": "Scholarship manifest", "manifest_version": "1.0",
        "include_conditions": [
            {"condition_id": "INC_001", "field": "age", "operator": ">=", "value": 16, "scope": "person"},
            {"condition_id": "INC_002", "field": "social_category", "operator": "in", "value": ["OBC", "EBC", "DNT"], "scope": "person"},
            {"condition_id": "INC_003", "field": "citizenship", "operator": "=", "value": "Indian", "scope": "person"},
            {"condition_id": "INC_004", "field": "district_code", "operator": "<=", "value": 4, "scope": "person"},
        ],
        "exclude_conditions": [
            {"condition_id": "EXC_001", "field": "is_third_or_more_boy_sibling_claimant", "operator": "=", "value": True, "scope": "family"},
            {"condition_id": "EXC_002", "field": "holds_other_scholarship_or_stipend", "operator": "=", "value": True, "scope": "person"},
        ],
        "renewal_conditions": [{"condition_id": "REN_001", "field": "is_permanently_settled_in_awarding_state", "operator": "=", "value": True, "scope": "person"}],
    },
    "S767": {
        "scheme_id": "S767", "scheme_name": "Health Card", "rule_name": "Health manifest", "manifest_version": "1.0",
        "include_conditions": [
            {"condition_id": "INC_001", "field": "gender", "operator": "in", "value": ["female", "male"], "scope": "person"},
            {"condition_id": "INC_002", "field": "family_income_slab", "operator": "<=", "value": 3, "scope": "family"},
        ],
        "exclude_conditions": [{"condition_id": "EXC_001", "field": "is_enrolled_in_target_scheme", "operator": "=", "value": True, "scope": "person"}],
        "renewal_conditions": [],
    },
}
