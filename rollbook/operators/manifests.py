"""Fixed policy manifests judged against the registry tables (ELG-31 to ELG-35, SRC-6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.dates import derive_age
from .quality import in_district

GROUPS = ("include_conditions", "exclude_conditions", "renewal_conditions")


def load_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifest files as rows; a file that is no object is left out by its missing scheme id."""
    return spark.read.option("multiLine", True).option("mode", "PERMISSIVE").json(path).where("scheme_id IS NOT NULL")


def list_manifests(manifests: DataFrame) -> DataFrame:
    counts = [F.coalesce(F.size(g), F.lit(0)).alias(g.replace("conditions", "condition_count")) for g in GROUPS]
    return manifests.select("scheme_id", "scheme_name", "rule_name", "manifest_version", *counts)


def upper_trim(c: Column) -> Column:
    return F.upper(F.trim(c))


def manifest_subjects(pd: DataFrame, pse: DataFrame, target: str, district: int | None = None, enrolled_only: bool = False, compat: bool = False) -> DataFrame:
    """Persons with their scheme set, family counts and target enrollment.

    Families count a member once; ``compat`` counts a member once per enrollment. Scheme sets are
    bounded by the scheme catalog.
    """
    member, card = "ration_card_memberid", "ration_card_number"
    is_target = upper_trim(F.col("scheme_id")) == target
    per_person = pse.groupBy(member).agg(
        F.array_sort(F.collect_set("scheme_id")).alias("person_scheme_ids"), F.bool_or(is_target).alias("is_enrolled_in_target"),
        F.count_if(is_target).alias("target_scheme_enrollment_rows"), F.count("*").alias("_rows"),
    )
    people = pd.join(per_person, member, "left")
    weight = F.coalesce("_rows", F.lit(1)) if compat else F.lit(1)
    sex = upper_trim(F.col("gender"))
    families = people.groupBy(card).agg(
        F.sum(weight).cast("bigint").alias("family_member_count"), F.sum(F.when(sex == "MALE", weight).otherwise(0)).cast("bigint").alias("male_family_member_count"),
        F.sum(F.when(sex == "FEMALE", weight).otherwise(0)).cast("bigint").alias("female_family_member_count"),
        F.count_if("is_enrolled_in_target").alias("family_members_enrolled_in_target"),
    )
    family_schemes = people.select(card, F.explode("person_scheme_ids").alias("s")).groupBy(card).agg(F.array_sort(F.collect_set("s")).alias("family_scheme_ids"))
    enrolled = pse.where(is_target).select(
        member, F.col("enrollment_status").alias("target_enrollment_status"), F.col("approved_date").alias("target_approved_date"),
        F.col("total_amount_received").alias("target_total_amount_received"))
    empty = F.array().cast("array<string>")
    out = in_district(people, district).join(families, card, "left").join(family_schemes, card, "left").join(enrolled, member, "left")
    out = (
        out.drop("_rows").withColumn("person_scheme_ids", F.coalesce("person_scheme_ids", empty)).withColumn("family_scheme_ids", F.coalesce("family_scheme_ids", empty))
        .withColumn("is_enrolled_in_target", F.coalesce("is_enrolled_in_target", F.lit(False)))
    )
    for c in ("target_scheme_enrollment_rows", "family_member_count", "male_family_member_count", "female_family_member_count", "family_members_enrolled_in_target"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0).cast("bigint")))
    return out.where("is_enrolled_in_target") if enrolled_only else out


def social_category(caste: Column) -> Column:
    t = upper_trim(F.coalesce(caste, F.lit("")))
    return (
        F.when(t.rlike("DNT|DENOTIFIED"), "DNT").when(t.rlike("EBC|ECONOMICALLY BACKWARD"), "EBC")
        .when(t.rlike(r"OBC|O\.B\.C|OTHER BACKWARD"), "OBC")
    )


def _value(text: Column, status: str, executable: Column | bool = True, number: Column | None = None) -> Column:
    run = F.lit(executable) if isinstance(executable, bool) else executable
    n = F.lit(None).cast("double") if number is None else number.cast("double")
    return F.struct(text.cast("string").alias("value"), n.alias("number"), F.lit(status).alias("status"), run.alias("executable"))


def manifest_value(subjects: DataFrame, field: str, target: str, as_of: Column) -> Column:
    """struct(value, number, status, executable) of one manifest field for a subject."""
    alias = {"district_code": "lgd_district_code", "block_code": "lgd_block_code", "gp_code": "lgd_gp_code"}
    derived: Column
    if field == "age":
        age = derive_age(F.col("member_dob"), as_of)
        derived = _value(age, "derived_mapped", True, age)
    elif field in ("is_permanent_resident_of_west_bengal", "is_permanently_settled_in_awarding_state"):
        here = (F.coalesce("ration_card_number", F.lit("")) != "") & (F.coalesce("lgd_district_code", F.lit(0)) != 0)
        derived = _value(here, "derived_mapped")
    elif field == "citizenship":
        known = (F.coalesce("uid", F.lit("")) != "") | (F.coalesce("ration_card_memberid", F.lit("")) != "")
        derived = _value(F.when(known, "INDIAN"), "derived_mapped", known)
    elif field == "social_category":
        category = social_category(F.col("caste"))
        derived = _value(category, "derived_mapped", category.isNotNull())
    elif field == "is_third_or_more_boy_sibling_claimant":
        derived = _value((upper_trim(F.coalesce("gender", F.lit(""))) == "MALE") & (F.col("male_family_member_count") > 2), "family_derived")
    elif field == "holds_other_scholarship_or_stipend":
        other = F.exists("person_scheme_ids", lambda s: (F.upper(s) != target) & F.upper(s).startswith("C"))
        derived = _value(other, "derived_mapped")
    elif field == "is_enrolled_in_target_scheme":
        derived = _value(F.col("is_enrolled_in_target"), "derived_mapped")
    else:
        derived = _value(F.lit(None), "unmapped", False)
    column = field if field in subjects.columns else alias.get(field)
    if column is None or column not in subjects.columns:
        return derived
    direct = F.col(column).cast("string")
    return F.when(direct.isNotNull() & (direct != ""), _value(direct, "direct_mapped", True, direct.try_cast("double"))).otherwise(derived)


def manifest_pass(v: Column, operator: str, expected) -> Column:
    """Test of one condition: =, in on normalised text, four orders; any other operator fails."""
    op = operator.strip().lower()
    actual = upper_trim(F.coalesce(v["value"], F.lit("")))

    def text(x) -> str:
        return str(x).strip().upper()

    if op == "=":
        if isinstance(expected, (int, float)) and not isinstance(expected, bool):
            return F.coalesce(v["number"] == float(expected), F.lit(False))
        return actual == text(expected)
    if op == "in":
        options = expected if isinstance(expected, list) else [expected]
        return actual.isin([text(x) for x in options])
    if op in (">=", ">", "<=", "<"):
        if isinstance(expected, str):
            left, right = actual, F.lit(text(expected))
        else:
            left, right = F.coalesce(v["number"], v["value"].try_cast("double")), F.lit(float(expected))
        test = {">=": left >= right, ">": left > right, "<=": left <= right, "<": left < right}[op]
        return F.coalesce(v["value"].isNotNull() & test, F.lit(False))
    return F.lit(False)


def condition_results(subjects: DataFrame, manifest: dict, as_of: Column) -> DataFrame:
    """Adds ``results``: one struct per manifest condition, computed inside the row."""
    target = str(manifest["scheme_id"]).upper()
    rows = []
    for group in GROUPS:
        for c in manifest.get(group) or []:
            v = manifest_value(subjects, c["field"], target, as_of)
            hit = manifest_pass(v, c["operator"], c["value"])
            passed = F.when(v["executable"], ~hit if group == "exclude_conditions" else hit)
            rows.append(F.struct(
                F.lit(c["condition_id"]).alias("condition_id"), F.lit(group).alias("condition_group"), F.lit(c["field"]).alias("field"),
                v["value"].alias("value_found"), v["status"].alias("mapping_status"), v["executable"].alias("executable"), passed.alias("condition_passed")))
    return subjects.withColumn("results", F.array(*rows))


def manifest_verdict(subjects: DataFrame, manifest: dict, as_of: Column) -> DataFrame:
    """Verdict of every subject: any unresolved condition needs review, else eligible against enrolled."""
    rows = condition_results(subjects, manifest, as_of)

    def ids(test) -> Column:
        return F.transform(F.filter("results", test), lambda r: r["condition_id"])

    unresolved = ids(lambda r: ~r["executable"])
    failed = ids(lambda r: r["executable"] & ~r["condition_passed"])
    passed = ids(lambda r: r["executable"] & r["condition_passed"])
    out = rows.withColumn("passed_ids", passed).withColumn("failed_ids", failed).withColumn("unmapped_ids", unresolved)
    ok, inside = F.size("failed_ids") == 0, F.col("is_enrolled_in_target")
    state = (
        F.when(F.size("unmapped_ids") > 0, "REVIEW_REQUIRED").when(ok & inside, "ELIGIBLE_ENROLLED").when(ok, "ELIGIBLE_NOT_ENROLLED")
        .when(inside, "NOT_ELIGIBLE_ENROLLED").otherwise("NOT_ELIGIBLE_NOT_ENROLLED")
    )
    return out.withColumn("decision_bucket", state).withColumn("is_eligible", F.when(F.size("unmapped_ids") == 0, ok))


def manifest_summary(verdicts: DataFrame) -> DataFrame:
    """Counts per bucket, per mapping status and per open condition, from one pass over the verdicts."""
    facts = F.concat(
        F.array(F.struct(F.lit("bucket").alias("kind"), F.col("decision_bucket").alias("key"))),
        F.transform("results", lambda r: F.struct(F.lit("mapping").alias("kind"), r["mapping_status"].alias("key"))),
        F.transform("unmapped_ids", lambda i: F.struct(F.lit("open_condition").alias("kind"), i.alias("key"))),
    )
    return verdicts.select(F.explode(facts).alias("f")).groupBy("f.kind", "f.key").agg(F.count("*").alias("total"))
