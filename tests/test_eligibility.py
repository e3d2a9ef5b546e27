from pyspark.sql import functions as F

from rollbook.operators import conditions as c
from rollbook.operators import judging as j
from rollbook.operators import manifests as m
from rollbook.operators import policy_text as p
from rollbook.operators.concepts import map_concept
from rollbook.plans.eligibility_fixture import MANIFESTS


def as_of():
    return F.lit("2024-06-01").cast("date")


def test_conditions_from_text(spark):
    text = "This scheme is for female widows only. Applicants with age between 18 and 60. Annual income less than Rs 120000. Not for SS_001 or S767."
    (r,) = p.extract_conditions(spark.createDataFrame([(1, "S767", text)], "doc_id long, scheme_id string, text string")).collect()
    assert (r.age_min, r.age_max, r.gender_in, r.marital_status_in, r.income_max, r.conflict_scheme_ids) == (18, 60, ["FEMALE"], ["WIDOW"], 120000.0, ["SS_001"])


def test_amounts(spark):
    rows = [("2 lakh", 200000.0), ("1.5 crore", 15000000.0), ("90 thousand", 90000.0), ("Rs 1,20,000", 120000.0), ("none", None), ("1.2.3", None), (None, None)]
    got = spark.createDataFrame([(a,) for a, _ in rows], "t string").select(p.parse_amount(F.col("t")).alias("x")).collect()
    assert [x.x for x in got] == [b for _, b in rows]


def test_file_names(spark):
    rows = [("doc_GE_S767_0.pdf", ["S767"]), ("doc_LB_S051_1.pdf", ["S051"]), ("doc_QB_C501_0.pdf", ["C501"]), ("SS_001-S12.pdf", ["SS_001", "S12"]), ("XS767.pdf", [])]
    got = spark.createDataFrame([(a,) for a, _ in rows], "t string").select(p.scheme_from_filename(F.col("t")).alias("x")).collect()
    assert [x.x for x in got] == [b for _, b in rows]


def test_reply_objects(spark):
    rows = [(1, '{"scheme_id": "S1", "age_min": 5}'), (2, '```json\n{"scheme_id": "S2"}\n```'), (3, 'so: {"scheme_id": "S3", "x": {"y": 1}} ok'), (4, '[1]'), (5, '{"a": '), (6, None)]
    got = {r.reply_id: (r.is_object, r.scheme_id, r.age_min) for r in p.reply_json(spark.createDataFrame(rows, "reply_id long, reply string")).collect()}
    assert got == {1: (True, "S1", 5), 2: (True, "S2", None), 3: (True, "S3", None), 4: (False, None, None), 5: (False, None, None), 6: (False, None, None)}


def test_concepts(spark):
    rows = {"income_limit": ("annual_income", "number", True), "Families covered under any ESI scheme": ("exclude_families_covered_under_esi_scheme", "boolean", True),
            "must own a small farm": ("must_own_small_farm", "text", True), "is_veteran": ("is_veteran", "boolean", False), "resident of West Bengal": ("has_west_bengal_residency", "boolean", True)}
    df = spark.createDataFrame([(k,) for k in rows], "k string").select("k", map_concept(F.col("k")).alias("x")).select("k", "x.*")
    assert {r.k: (r.field, r.input_type, r.mapped) for r in df.collect()} == rows


COND = "rule_id long, bucket string, field string, operator string, kind string, value string, values array<string>, value_type string, evidence_quote string, pos int"


def test_validation(spark):
    rows = [(1, "include", "is_disabled", "in", "list", None, ["true"], "boolean", None, 0), (2, "include", "age", ">=", "number", "18", [], "number", None, 0), (3, "include", "height", "=", "number", "1", [], "number", None, 0),
            (4, "include", "gender", "in", "list", None, [], "text", None, 0), (5, "include", "age", "is_null", "number", "1", [], "number", None, 0)]
    got = {r.rule_id: r.error for r in c.validate_conditions(spark.createDataFrame(rows, COND)).collect()}
    assert got == {1: "OPERATOR_NOT_ALLOWED", 2: None, 3: "UNSUPPORTED_FIELD", 4: "LIST_REQUIRED", 5: "VALUE_NOT_EXPECTED"}


def test_scheme_values_that_are_no_codes(spark):
    rows = [(1, "exclude", "scheme_id", "in", "list", None, ["State Insurance"], "text", None, 0), (2, "exclude", "scheme_id", "in", "list", None, ["SS_001"], "text", None, 0)]
    kept, down = c.sanitize_conditions(spark.createDataFrame(rows, COND))
    assert [r.rule_id for r in kept.collect()] == [2]
    (d,) = down.collect()
    assert d.requirement == "Excluded if covered under State Insurance" and d.suggested_input_field == "exclude_families_covered_under_state_insurance"


CITIZEN = """uid string, scheme_id string, scheme_beneficiary_id string, row_no long, fullname string, member_dob string, gender string, caste string, marital_status string, annual_income string, is_disabled string,
 disability_status string, employment_status string, service_duration_months long, retired_or_terminated string, rc_ration_card_type_code string, rc_is_hof int, approved_date date, closing_date date, closure_remarks string,
 tran_count_1 long, tran_count_2 long"""


def citizen(spark, **over):
    row = dict(uid="U1", scheme_id="SS_001", scheme_beneficiary_id="B1", row_no=1, fullname="A", member_dob="1990-01-01", gender="FEMALE", caste="SC", marital_status=None, annual_income=None, is_disabled=None,
               disability_status=None, employment_status="ACTIVE", service_duration_months=None, retired_or_terminated=None, rc_ration_card_type_code=None, rc_is_hof=None, approved_date=None, closing_date=None,
               closure_remarks=None, tran_count_1=None, tran_count_2=None)
    row.update(over)
    return spark.createDataFrame([tuple(row.values())], CITIZEN)


ADULT = {"rule_id": "R", "rule_name": "n", "scheme_id": "S767", "include": [("age", ">=", 18), ("age", "<=", 60), ("gender", "in", ["FEMALE"])]}


def run(spark, rule, manual=None, **over):
    base = citizen(spark, **over).join(j.rule_rows(spark, [rule]))
    inputs = None
    if manual is not None:
        inputs = spark.createDataFrame([("R", "U1", manual)], "rule_id string, uid string, values map<string,string>")
    (r,) = j.judge(base, as_of(), inputs).collect()
    return r


def test_decisions(spark):
    out = run(spark, ADULT)
    assert out.decision == "EXCLUSION_ERROR" and out.decision_confidence == 0.95 and "Passed checks: age >= 18.00 (actual=34.00)" in out.reason
    assert run(spark, ADULT, scheme_id="S767", member_dob="2015-01-01", gender="MALE").decision == "INCLUSION_ERROR"
    assert run(spark, ADULT, scheme_id=" s767").decision == "VALID_ENROLLMENT"
    assert run(spark, ADULT, gender="MALE").decision == "NOT_APPLICABLE"
    missing = run(spark, {**ADULT, "include": [("employment_status", "in", ["ACTIVE"])]}, employment_status=None)
    assert (missing.decision, missing.missing_fields) == ("REVIEW_REQUIRED", ["employment_status"])
    assert run(spark, {"rule_id": "R", "rule_name": "n", "scheme_id": "S767"}).decision == "REVIEW_REQUIRED"


def test_open_conditions(spark):
    free = {**ADULT, "unmapped": [("eligibility_scope", "eligibility_scope", "text"), ("exclusion_list", "x", "text")]}
    assert run(spark, free, scheme_id="S767").decision == "VALID_ENROLLMENT"
    asked = {**ADULT, "unmapped": [("no_other_scholarship", "no_other_scholarship", "boolean")]}
    assert run(spark, asked, scheme_id="S767").open_fields == ["no_other_scholarship"]
    assert run(spark, asked, {"no_other_scholarship": "maybe"}, scheme_id="S767").decision == "REVIEW_REQUIRED"
    for value in ("true", "no"):
        assert run(spark, asked, {"no_other_scholarship": value}, scheme_id="S767").decision == "VALID_ENROLLMENT"


def test_manual_values_win_and_disability_text(spark):
    rule = {**ADULT, "include": [("annual_income", "<=", 200000), ("is_disabled", "=", False)]}
    r = run(spark, rule, {"annual_income": "2 lakh"}, scheme_id="S767", annual_income="9 lakh", is_disabled="N", disability_status="Y")
    assert r.decision == "VALID_ENROLLMENT"


def test_requirements_are_worked_out_once(spark):
    """The fields to ask for are one column that the rows are made from, not two copies of the same work."""
    asked = {**ADULT, "include": [("annual_income", "<=", 200000), ("gender", "=", "FEMALE")], "unmapped": [("no_other_scholarship", "no_other_scholarship", "boolean"), ("x", "course_level", "text")]}
    rows = j.judge(citizen(spark).join(j.rule_rows(spark, [asked])), as_of(), spark.createDataFrame([("R", "U1", {"course_level": "BA"})], "rule_id string, uid string, values map<string,string>"))
    got = j.manual_requirements(rows)
    assert {(r.field, r.input_type, r.why) for r in got.collect()} == {
        ("no_other_scholarship", "boolean", "MISSING_IN_DATASET"), ("annual_income", "number", "MISSING_IN_DATASET"), ("course_level", "text", "POLICY_CONCEPT")}
    stored = spark.createDataFrame(rows.select("rule_id", "uid", "scheme_beneficiary_id", "row_no", "missing_fields", "open_fields", "conditions", "unmapped", "source").collect(), rows.select(
        "rule_id", "uid", "scheme_beneficiary_id", "row_no", "missing_fields", "open_fields", "conditions", "unmapped", "source").schema)
    plan = j.manual_requirements(stored)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(conditions") == 1


PERSON = "ration_card_memberid string, ration_card_number string, uid string, fullname string, member_dob string, gender string, caste string, lgd_district_code int"


def subjects(spark, people, enrolled=(), **kw):
    pse = spark.createDataFrame(list(enrolled), "ration_card_memberid string, scheme_id string, enrollment_status string, approved_date date, total_amount_received double")
    return m.manifest_subjects(spark.createDataFrame(people, PERSON), pse, "C501", **kw)


def test_manifest_verdicts(spark):
    boys = [(f"M{i}", "R1", f"U{i}", "N", "2000-01-01", "MALE", "OBC-B", 3) for i in range(2)] + [("M3", "R2", "U3", "N", "2000-01-01", "FEMALE", "SC", 3)]
    enr = [("M0", "C501", "ACTIVE", None, 1.0), ("M0", "S767", "ACTIVE", None, 1.0), ("M1", "S1", "ACTIVE", None, 1.0)]
    got = {r.ration_card_memberid: r for r in m.manifest_verdict(subjects(spark, boys, enr), MANIFESTS["C501"], as_of()).collect()}
    assert (got["M0"].decision_bucket, got["M1"].decision_bucket) == ("ELIGIBLE_ENROLLED", "ELIGIBLE_NOT_ENROLLED")
    assert (got["M3"].decision_bucket, got["M3"].unmapped_ids) == ("REVIEW_REQUIRED", ["INC_002"])
    # counted once per enrollment, two boys with three enrollments pass for three boys
    twice = {r.ration_card_memberid: r for r in m.manifest_verdict(subjects(spark, boys, enr, compat=True), MANIFESTS["C501"], as_of()).collect()}
    assert (twice["M0"].decision_bucket, twice["M0"].failed_ids) == ("NOT_ELIGIBLE_ENROLLED", ["EXC_001"])


def test_manifest_files(spark, tmp_path):
    import json

    for k, v in MANIFESTS.items():
        (tmp_path / f"{k}.json").write_text(json.dumps(v, indent=1))
    got = {r.scheme_id: (r.include_condition_count, r.exclude_condition_count, r.renewal_condition_count) for r in m.list_manifests(m.load_manifests(spark, str(tmp_path))).collect()}
    assert got == {"C501": (4, 2, 1), "S767": (2, 1, 0)}


def test_versions_across_spans(spark):
    rows = spark.createDataFrame([("f", i) for i in range(0, 250, 5)] + [("g", 7)], "k string, n long")
    got = {(r.k, r.n): (r.rule_version, r.is_latest) for r in c.version_rules(rows, ["k"], "n", 40).collect()}
    assert all(got[("f", i)] == (i // 5 + 1, i == 245) for i in range(0, 250, 5)) and got[("g", 7)] == (1, True)


def _focused(text: str) -> str:
    """The pieces around cue words by positions, merged where they touch."""
    import re

    t = re.sub(r"\s+", " ", text).strip()
    spans: list[list[int]] = []
    for hit in re.finditer(p.CUES, t):
        a, z = max(0, hit.start() - 120), min(len(t), hit.end() + 620)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], z)
        else:
            spans.append([a, z])
    return "\n\n".join(x for x in (t[a:z].strip() for a, z in spans) if x).strip()


def test_windows_keep_the_whole_text(spark):
    import random

    rng = random.Random(5)
    words = ["eligible", "Not eligible", "exclusion", "who can apply", "ineligible", *["income", "scheme", "caf\u00e9", "\u0986\u09ac\u09c7\u09a6\u09a8", "aid,", "x" * 40] * 12]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 30, 400, 3000)]
    far = "eligible " + "a" * 738 + " include"  # 740 characters between the cue words: still one piece
    texts += [far, far.replace("a a", "a aa"), "eligible " + "a" * 739 + " include", "include", "nothing here", "", "  \n "]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "doc_id long, text string")

    focus = p.focus_windows(docs, 500).orderBy("doc_id", "window_no").collect()
    plain = p.text_windows(docs, 500).orderBy("doc_id", "window_no").collect()
    for i, t in [*enumerate(texts), (99, "")]:
        got = [r for r in focus if r["doc_id"] == i]
        assert [r["window_no"] for r in got] == list(range(len(got)))
        assert "".join(r["focused_text"] for r in got) == _focused(t)
        assert all(len(r["focused_text"]) == 500 for r in got[:-1]) and len(got[-1]["focused_text"]) <= 500
        assert "".join(r["text_window"] for r in plain if r["doc_id"] == i) == " ".join(t.split())
    assert {r["matches"] for r in focus if r["doc_id"] == 0 or r["doc_id"] == 7} >= {"include"}


def test_windows_of_a_long_text(spark):
    text = ("Who can apply: residents. " + "word " * 200) * 8000  # 8 MB, 8000 pieces
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    focus = p.focus_windows(docs).agg(F.count("*").alias("n"), F.sum(F.length("focused_text")).alias("chars")).first()
    assert focus["chars"] == len(_focused(text)) and focus["n"] == -(-focus["chars"] // 8000)
    assert p.text_windows(docs).agg(F.sum(F.length("text_window"))).first()[0] == len(text.strip())
