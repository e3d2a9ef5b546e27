"""Judging citizens against rules (ELG-18 to ELG-30).

Rules carry their conditions as an array, so every citizen row meets its rule once and is judged
inside the row: no exploded conditions and no shuffle after the base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.dates import age_calendar, parse_dob
from .concepts import FIELD_TYPES, MANUAL_FIELD_TYPES, lookup, manual_input_type, map_concept
from .conditions import NON_BLOCKING
from .policy_text import parse_amount
from .registry import first_row

# Bucket of each decision.
BUCKETS = {
    "VALID_ENROLLMENT": "ELIGIBLE_ENROLLED", "INCLUSION_ERROR": "NOT_ELIGIBLE_ENROLLED", "EXCLUSION_ERROR": "ELIGIBLE_NOT_ENROLLED",
    "NOT_APPLICABLE": "NOT_ELIGIBLE_NOT_ENROLLED", "REVIEW_REQUIRED": "REVIEW_REQUIRED",
}
# Operator shown for an exclusion.
INVERTED = {"=": "!=", "!=": "=", ">": "<=", "<": ">=", ">=": "<", "<=": ">", "in": "not_in", "not_in": "in", "is_null": "is_not_null", "is_not_null": "is_null"}

CONDITION = "struct<bucket:string,field:string,operator:string,value_type:string,value:string,values:array<string>,num:double,flag:boolean,shown:string>"
UNMAPPED = "struct<requirement:string,suggested_input_field:string,input_type:string>"
RULE_SCHEMA = f"rule_id string, rule_name string, target_scheme string, conditions array<{CONDITION}>, unmapped array<{UNMAPPED}>"

# Citizen columns a condition or an input field can read.
CITIZEN_FIELDS = ["uid", "scheme_id", "scheme_beneficiary_id", "fullname", "member_dob", "gender", "caste", "marital_status", "annual_income", "is_disabled",
                  "disability_status", "employment_status", "service_duration_months", "retired_or_terminated", "rc_ration_card_type_code", "rc_is_hof",
                  "approved_date", "closing_date", "closure_remarks", "tran_count_1", "tran_count_2"]


def normal(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c, F.lit(""))))


def boolish(c: Column) -> Column:
    t = normal(c)
    return F.when(t.isin("YES", "Y", "TRUE", "1"), F.lit(True)).when(t.isin("NO", "N", "FALSE", "0"), F.lit(False))


def rule_rows(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """Rules given as plain values; expected values are normalised once here."""
    rows = []
    for r in rules:
        conditions = []
        for bucket in ("include", "exclude"):
            for field, op, value in r.get(bucket, []):
                kind = FIELD_TYPES[field]
                text, many, num, flag, shown = None, [], None, None, None
                if isinstance(value, list):
                    many = [str(v).strip().upper() for v in value]
                    shown = "[" + ", ".join(many) + "]"
                elif isinstance(value, bool):
                    flag, shown = value, str(value).lower()
                elif kind == "number" and value is not None:
                    num, shown = float(value), f"{value:.2f}"
                elif value is not None:
                    text = str(value).strip() if kind == "date" else str(value).strip().upper()
                    shown = text
                conditions.append((bucket, field, op, kind, text, many, num, flag, shown))
        rows.append((r["rule_id"], r["rule_name"], r["scheme_id"].strip().upper(), conditions, [tuple(u) for u in r.get("unmapped", [])]))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def with_latest_rc(citizens: DataFrame, rc: DataFrame) -> DataFrame:
    """Status and remarks of the latest registry row of the uid."""
    latest = first_row(
        rc.where("uid IS NOT NULL"), ["uid"],
        [F.desc_nulls_last("modify_ts"), F.desc_nulls_last("entry_ts"), F.asc("ration_card_memberid"), F.asc("fullname")],
    ).select("uid", F.col("member_status").alias("rc_member_status"), F.col("closure_remarks").alias("rc_closure_remarks"))
    return citizens.join(latest, "uid", "left")


def enrich_citizens(df: DataFrame) -> DataFrame:
    """Employment status, months of service and the retired mark."""
    status = normal(F.col("rc_member_status"))
    remarks = normal(F.coalesce(F.nullif(F.col("closure_remarks"), F.lit("")), F.col("rc_closure_remarks")))
    months = F.coalesce("tran_count_1", F.lit(0)) + F.coalesce("tran_count_2", F.lit(0))
    return (
        df.withColumn("employment_status", F.when(status != "", status).when(F.col("closing_date").isNotNull(), "CLOSED").otherwise("ACTIVE"))
        .withColumn("service_duration_months", F.when(months != 0, months))
        .withColumn("retired_or_terminated", F.when(remarks.rlike("RETIRED|TERMINATED"), "true").when(remarks.rlike("CLOSED|TRANSFER|DEATH|INACTIVE"), "false"))
    )


def _has_uid() -> Column:
    return F.trim(F.coalesce("uid", F.lit(""))) != ""


#: A rule list of up to so many rows goes to every task; citizens are not moved.
RULE_ROWS = 5000


def _is_list(rules: DataFrame) -> bool:
    return rules.limit(RULE_ROWS + 1).count() <= RULE_ROWS


def base_scheme_only(rules: DataFrame, citizens: DataFrame) -> DataFrame:
    """Rows enrolled in the target scheme of each rule."""
    index = F.broadcast(rules) if _is_list(rules) else rules
    return citizens.where(_has_uid()).join(index, F.upper(F.trim("scheme_id")) == F.col("target_scheme"))


def base_preferred(rules: DataFrame, citizens: DataFrame) -> DataFrame:
    """One row per rule and uid: the row in the target scheme when there is one, else the newest.

    The newest row per (uid, scheme) and per uid are picked once for all rules; a rule then only
    chooses between the two. A citizen's newest row carries the schemes of the citizen, so the rules
    it stands for are picked inside the row, from the rule list as one constant.
    """
    order = [F.desc_nulls_last("latest_transaction_timestamp"), F.desc_nulls_last("approved_date"), F.asc("scheme_id"), F.asc("scheme_beneficiary_id"), F.asc("row_no")]
    rows = citizens.where(_has_uid()).withColumn("_scheme", F.upper(F.trim("scheme_id")))
    per_scheme = first_row(rows, ["uid", "_scheme"], order)
    newest = first_row(per_scheme, ["uid"], order)
    targets = rules.where("target_scheme IS NOT NULL").select("target_scheme").distinct()
    if _is_list(rules):
        rules = F.broadcast(rules)
        inside = per_scheme.join(rules, F.col("_scheme") == F.col("target_scheme"))
        # schemes that no rule asks for are no reason to stay away
        held = per_scheme.join(F.broadcast(targets), F.col("_scheme") == F.col("target_scheme"), "left_semi").groupBy("uid").agg(F.collect_set("_scheme").alias("_held"))
        row_type = rules.schema.simpleString()
        listed = rules.agg(F.to_json(F.collect_list(F.struct(*rules.columns)))).first()[0]
        of = F.filter(F.from_json(F.lit(listed), f"array<{row_type}>"), lambda r: ~F.coalesce(F.array_contains("_held", r["target_scheme"]), F.lit(False)))
        outside = newest.join(held, "uid", "left").withColumn("r", F.explode(of)).select(*newest.columns, "r.*")
    else:
        # more rules than a list: every uid meets every rule all the same
        inside = per_scheme.join(rules, F.col("_scheme") == F.col("target_scheme"))
        outside = newest.crossJoin(rules).join(inside.select("rule_id", "uid"), ["rule_id", "uid"], "left_anti")
    return inside.drop("_scheme").unionByName(outside.drop("_scheme"))


def with_manual(base: DataFrame, manual: DataFrame | None) -> DataFrame:
    """Adds ``source``, the citizen values as text, with manual inputs of (rule_id, uid) on top."""
    entries = [x for c in CITIZEN_FIELDS if c in base.columns for x in (F.lit(c), F.col(c).cast("string"))]
    out = base.withColumn("raw", F.create_map(*entries))
    if manual is None:
        return out.withColumn("source", F.col("raw")).withColumn("manual", F.lit(None).cast("map<string,string>"))
    out = out.join(manual.select("rule_id", "uid", F.col("values").alias("manual")), ["rule_id", "uid"], "left")
    kept = F.map_filter("raw", lambda k, v: ~F.map_contains_key("manual", k))
    return out.withColumn("source", F.when(F.col("manual").isNull(), F.col("raw")).otherwise(F.map_concat(kept, F.col("manual"))))


def resolve_fields(df: DataFrame, as_of: Column) -> DataFrame:
    """Adds ``vals``: each logical field as struct(t, n, b) with one member set by its type."""
    src = F.col("source")
    no_t, no_n, no_b = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("boolean")

    def text(c: Column) -> Column:
        return F.struct(c.alias("t"), no_n.alias("n"), no_b.alias("b"))

    def number(c: Column) -> Column:
        return F.struct(no_t.alias("t"), c.cast("double").alias("n"), no_b.alias("b"))

    def flag(c: Column) -> Column:
        return F.struct(no_t.alias("t"), no_n.alias("n"), boolish(c).alias("b"))

    df = df.withColumn("_dob", parse_dob(src["member_dob"]))
    dob = F.col("_dob")
    months = F.floor(src["service_duration_months"].try_cast("double"))
    values = {
        "age": number(age_calendar(dob, as_of)), "gender": text(normal(src["gender"])), "marital_status": text(normal(src["marital_status"])),
        "annual_income": number(parse_amount(src["annual_income"])),
        "is_disabled": flag(F.coalesce(F.nullif(src["is_disabled"], F.lit("")), src["disability_status"])),
        "employment_status": text(normal(src["employment_status"])), "service_duration_months": number(months),
        "ida_covered": flag(src["ida_covered"]), "scheme_id": text(normal(src["scheme_id"])), "receives_pension": flag(src["receives_pension"]),
        "retired_or_terminated": flag(src["retired_or_terminated"]), "reemployed_same_factory": flag(src["reemployed_same_factory"]),
        "member_dob": text(dob.cast("string")), "caste": text(normal(src["caste"])),
        "rc_ration_card_type_code": text(normal(src["rc_ration_card_type_code"])), "rc_is_hof": flag(src["rc_is_hof"]),
    }
    # From entries and not create_map: the optimizer would inline a created map into every lookup
    # and parse the same text again for each condition.
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()])
    return df.withColumn("vals", F.map_from_entries(entries)).drop("_dob")


def _is_null(v: Column) -> Column:
    return v["t"].isNull() & v["n"].isNull() & v["b"].isNull()


def _shown(v: Column) -> Column:
    return F.coalesce(v["t"], v["n"].cast("decimal(18,2)").cast("string"), v["b"].cast("string"), F.lit("null"))


def _compare(a: Column, op: Column, b: Column) -> Column:
    return F.when(op == "=", a == b).when(op == "!=", a != b).when(op == ">", a > b).when(op == "<", a < b).when(op == ">=", a >= b).when(op == "<=", a <= b)


def _matched(v: Column, c: Column) -> Column:
    op = c["operator"]
    kind = c["value_type"]
    return F.coalesce(
        F.when(op == "is_null", _is_null(v)).when(op == "is_not_null", ~_is_null(v))
        .when(op == "in", F.array_contains(c["values"], v["t"])).when(op == "not_in", ~F.array_contains(c["values"], v["t"]))
        .when(kind == "number", _compare(v["n"], op, c["num"])).when(kind == "boolean", _compare(v["b"], op, c["flag"]))
        .otherwise(_compare(v["t"], op, c["value"])),
        F.lit(False),
    )


def evaluate_conditions(df: DataFrame) -> DataFrame:
    """Adds checks, missing fields and whether all checks passed; an exclusion inverts its test."""
    def check(c: Column) -> Column:
        v = F.col("vals")[c["field"]]
        missing = ~c["operator"].isin("is_null", "is_not_null") & (_is_null(v) | F.coalesce(F.trim(v["t"]) == "", F.lit(False)))
        hit = _matched(v, c)
        inside = c["bucket"] == "include"
        return F.struct(
            c["field"].alias("field"), F.when(inside, c["operator"]).otherwise(lookup(INVERTED, c["operator"])).alias("operator"),
            c["shown"].alias("expected"), _shown(v).alias("actual"), F.when(inside, hit).otherwise(~hit).alias("passed"),
            c["bucket"].alias("bucket"), missing.alias("missing"),
        )

    out = df.withColumn("_all", F.transform("conditions", check))
    out = out.withColumn("checks", F.filter("_all", lambda x: ~x["missing"]))
    return (
        out.withColumn("missing_fields", F.array_sort(F.array_distinct(F.transform(F.filter("_all", lambda x: x["missing"]), lambda x: x["field"]))))
        .withColumn("passed_checks", F.size(F.filter("checks", lambda x: x["passed"])))
        .withColumn("total_checks", F.size("checks"))
        .withColumn("is_eligible_by_checks", F.forall("checks", lambda x: x["passed"]))
        .drop("_all")
    )


def open_conditions(df: DataFrame) -> DataFrame:
    """Adds ``open_fields``: unmapped conditions without a usable input. Two keys never block.

    Of conditions on the same field only the first one counts.
    """
    def key(u: Column) -> Column:
        return F.coalesce(F.nullif(F.trim(u["suggested_input_field"]), F.lit("")), F.trim(u["requirement"]))

    def requirement(u: Column) -> Column:
        return F.trim(F.coalesce(F.nullif(u["requirement"], F.lit("")), u["suggested_input_field"]))

    rows = F.filter("unmapped", lambda u: ~requirement(u).isin(NON_BLOCKING))
    keys = F.transform(rows, key)
    firsts = F.filter(rows, lambda u, i: F.array_position(keys, key(u)) == i + 1)

    def is_open(u: Column) -> Column:
        field = F.trim(F.coalesce(u["suggested_input_field"], F.lit("")))
        value = F.col("source")[field]
        empty = F.trim(F.coalesce(value, F.lit(""))) == ""
        vague = (F.lower(F.coalesce(u["input_type"], F.lit("text"))) == "boolean") & boolish(value).isNull()
        return (field == "") | empty | vague

    return df.withColumn("open_fields", F.array_sort(F.array_distinct(F.transform(F.filter(firsts, is_open), key))))


def decide(df: DataFrame) -> DataFrame:
    """Decision in the order open, no criteria, missing, then eligible against enrolled."""
    enrolled = normal(F.col("source")["scheme_id"]) == F.col("target_scheme")
    none = (F.size("conditions") == 0) & (F.size("unmapped") == 0)
    ok = F.col("is_eligible_by_checks")
    out = df.withColumn("is_enrolled", enrolled)
    review = (F.size("open_fields") > 0) | none | (F.size("missing_fields") > 0)
    decision = (
        F.when(review, "REVIEW_REQUIRED").when(ok & ~F.col("is_enrolled"), "EXCLUSION_ERROR").when(~ok & F.col("is_enrolled"), "INCLUSION_ERROR")
        .when(ok, "VALID_ENROLLMENT").otherwise("NOT_APPLICABLE")
    )
    share = F.when(F.col("total_checks") > 0, F.col("passed_checks") / F.col("total_checks")).otherwise(0.0)
    confidence = F.when(review, 0.0).otherwise(F.round(F.least(F.lit(0.99), 0.75 + share * 0.2), 4))
    return out.withColumn("decision", decision).withColumn("decision_confidence", confidence).withColumn("is_eligible", ~review & ok)


def reasons(df: DataFrame) -> DataFrame:
    """Adds the reason sentence of the decision. The wording of the sentences."""
    def listed(passed: bool) -> Column:
        some = F.filter("checks", lambda x: x["passed"] == F.lit(passed))
        text = F.transform(some, lambda x: F.concat(x["field"], F.lit(" "), x["operator"], F.lit(" "), F.coalesce(x["expected"], F.lit("null")), F.lit(" (actual="), x["actual"], F.lit(")")))
        return F.array_join(text, "; ")

    target = F.col("target_scheme")
    d = F.col("decision")
    failed_text = F.when(listed(False) != "", F.concat(F.lit("Failed checks: "), listed(False), F.lit("."))).otherwise("No failing check details available.")
    passed_text = F.when(listed(True) != "", F.concat(F.lit("Passed checks: "), listed(True), F.lit("."))).otherwise("No executable checks were available.")
    reason = (
        F.when(F.size("open_fields") > 0, F.concat(F.lit("Document contains unresolved eligibility criteria requiring manual inputs: "), F.array_join("open_fields", ", "), F.lit(".")))
        .when((F.size("conditions") == 0) & (F.size("unmapped") == 0), "No usable eligibility criteria were extracted from the policy document. Manual rule validation is required.")
        .when(d == "REVIEW_REQUIRED", F.concat(
            F.lit("Required citizen data is missing for executable criteria fields: "), F.array_join("missing_fields", ", "),
            F.lit(". Final inclusion/exclusion decision requires these fields.")))
        .when(d == "EXCLUSION_ERROR", F.concat(F.lit("Citizen is eligible by extracted criteria but not enrolled in target scheme "), target, F.lit(". "), passed_text))
        .when(d == "INCLUSION_ERROR", F.concat(F.lit("Citizen is enrolled in target scheme "), target, F.lit(" but failed eligibility checks. "), failed_text))
        .when(d == "VALID_ENROLLMENT", F.concat(F.lit("Citizen is eligible and correctly enrolled in target scheme "), target, F.lit(".")))
        .otherwise(F.concat(F.lit("Citizen is not eligible and not enrolled in target scheme "), target, F.lit(". "), failed_text))
    )
    return df.withColumn("reason", reason)


def judge(base: DataFrame, as_of: Column, manual: DataFrame | None = None) -> DataFrame:
    """Decisions of a base: fields, checks, open conditions, decision and reason in one narrow stage."""
    rows = resolve_fields(with_manual(base, manual), as_of)
    return reasons(decide(open_conditions(evaluate_conditions(rows))))


DECISION = ["rule_id", "uid", "scheme_beneficiary_id", "scheme_id", "row_no", "fullname", "decision", "decision_confidence", "is_eligible", "is_enrolled", "passed_checks", "total_checks", "reason"]


def run_counts(decisions: DataFrame) -> DataFrame:
    """Counts per rule and decision with the bucket name; all rules in one aggregate."""
    per = decisions.groupBy("rule_id", "decision").agg(F.count("*").alias("rows"))
    return per.withColumn("bucket", lookup(BUCKETS, F.col("decision")))


def run_preview(decisions: DataFrame, n: int = 25) -> DataFrame:
    """First rows of every rule with a clear outcome."""
    from ..functions.ranking import top_per_group

    clear = decisions.where(F.col("decision").isin("INCLUSION_ERROR", "EXCLUSION_ERROR", "VALID_ENROLLMENT"))
    return top_per_group(clear, ["rule_id"], [F.asc("uid"), F.asc("scheme_beneficiary_id"), F.asc("row_no")], n, ["uid", "row_no"])


def rejudge(rules: DataFrame, citizens: DataFrame, manual: DataFrame, as_of: Column) -> DataFrame:
    """New decisions for the (rule, uid) keys that have manual inputs, and for no others."""
    # values typed by people: a boolean input must read as yes or no, a number as a number
    base = base_scheme_only(rules, citizens).join(manual.select("rule_id", "uid"), ["rule_id", "uid"], "left_semi")
    return judge(base, as_of, manual)


def input_errors(manual: DataFrame) -> DataFrame:
    """Manual inputs whose value does not fit the type of the field."""
    rows = manual.select("rule_id", "uid", F.explode("values").alias("field", "value"))
    kind = manual_input_type(F.col("field"))
    filled = F.trim(F.coalesce("value", F.lit(""))) != ""
    problem = (
        F.when(filled & (kind == "boolean") & boolish(F.col("value")).isNull(), "NOT_A_BOOLEAN")
        .when(filled & (kind == "number") & F.col("value").try_cast("double").isNull(), "NOT_A_NUMBER")
    )
    return rows.withColumn("problem", problem).where("problem IS NOT NULL")


def decision_list(decisions: DataFrame, people: DataFrame, decision: str | None = None) -> DataFrame:
    """Decisions with the name of the person (one per uid) and the bucket."""
    names = people.where("uid IS NOT NULL").groupBy("uid").agg(F.min("fullname").alias("citizen_name"))
    rows = decisions if decision is None else decisions.where(F.col("decision") == decision)
    return rows.drop("fullname").join(names, "uid", "left").withColumn("bucket", lookup(BUCKETS, F.col("decision")))


def manual_requirements(decisions: DataFrame) -> DataFrame:
    """Fields a person should fill in for a citizen, with type and reason, one row per field.

    Unmapped inputs come with the reason of the policy; a field that is empty in the citizen row
    comes with the reason that it is missing, which also replaces the policy reason.
    """
    def empty(f: Column) -> Column:
        return F.trim(F.coalesce(F.col("source")[f], F.lit(""))) == ""

    asked = F.filter(F.transform("unmapped", lambda u: F.trim(u["suggested_input_field"])), lambda f: f != "")
    needed = F.filter(F.transform("conditions", lambda c: c["field"]), empty)
    open_mapped = F.filter(F.transform(F.filter("open_fields", lambda k: map_concept(k)["mapped"]), lambda k: map_concept(k)["field"]), empty)
    suggested = F.array_distinct(F.concat(needed, F.filter("missing_fields", empty), F.filter(asked, empty), open_mapped))
    fields = F.array_distinct(F.concat(asked, F.col("suggested")))
    rows = decisions.withColumn("suggested", suggested).select("rule_id", "uid", "scheme_beneficiary_id", "row_no", "unmapped", F.explode(fields).alias("field"), "suggested")
    from_policy = F.get(F.filter("unmapped", lambda u: F.trim(u["suggested_input_field"]) == F.col("field")), F.lit(0))
    missing = F.array_contains("suggested", F.col("field"))
    return rows.select(
        "rule_id", "uid", "scheme_beneficiary_id", "row_no", "field",
        F.coalesce(from_policy["input_type"], manual_input_type(F.col("field"))).alias("input_type"),
        F.when(missing, "MISSING_IN_DATASET").otherwise("POLICY_CONCEPT").alias("why"),
    )


def rule_manifest(rules: DataFrame) -> DataFrame:
    """Field mapping of every rule: each field once, where it comes from and its state."""
    from_conditions = F.transform("conditions", lambda c: F.struct(
        c["field"].alias("field"), c["bucket"].alias("origin"), c["value_type"].alias("value_type"),
        F.concat(F.initcap(c["bucket"]), F.lit(" condition: "), c["operator"], F.lit(" "), F.coalesce(c["shown"], F.lit("null"))).alias("note")))
    from_unmapped = F.transform("unmapped", lambda u: F.struct(
        F.trim(u["suggested_input_field"]).alias("field"), F.lit("unmapped").alias("origin"), F.coalesce(u["input_type"], manual_input_type(u["suggested_input_field"])).alias("value_type"),
        F.lit("Unmapped policy criterion requiring manual input.").alias("note")))
    every = F.filter(F.concat(from_conditions, from_unmapped), lambda x: x["field"] != "")
    names = F.transform(every, lambda x: x["field"])
    firsts = F.filter(every, lambda x, i: F.array_position(names, x["field"]) == i + 1)
    rows = rules.select("rule_id", F.col("target_scheme").alias("scheme_id"), "rule_name", F.explode(firsts).alias("f"))
    known = lookup(FIELD_TYPES, F.col("f.field")).isNotNull()
    field = F.col("f.field")
    return rows.select(
        "rule_id", "scheme_id", "rule_name", field.alias("schema_field"), F.col("f.origin").alias("origin"),
        F.when(field == "age", "member_dob (computed)").when(known, field).alias("db_column"), F.when(known, "MAPPED").otherwise("MISSING").alias("db_status"),
        F.coalesce(lookup({**FIELD_TYPES, **MANUAL_FIELD_TYPES}, F.when(F.col("f.origin") != "unmapped", field)), F.col("f.value_type")).alias("value_type"), F.col("f.note").alias("note"),
    )
