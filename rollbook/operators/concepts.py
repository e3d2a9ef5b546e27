"""Field registry and the mapping of policy concepts to input fields (ELG-11)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Logical fields and their types.
FIELD_TYPES = {
    "age": "number", "gender": "text", "marital_status": "text", "annual_income": "number", "is_disabled": "boolean",
    "employment_status": "text", "service_duration_months": "number", "ida_covered": "boolean", "scheme_id": "text",
    "receives_pension": "boolean", "retired_or_terminated": "boolean", "reemployed_same_factory": "boolean",
    "member_dob": "date", "caste": "text", "rc_ration_card_type_code": "text", "rc_is_hof": "boolean",
}
# Types of fields that are entered by hand.
MANUAL_FIELD_TYPES = {
    "course_level": "text", "study_mode": "text", "institution_type": "text", "no_other_scholarship": "boolean",
    "nationality": "text", "medical_allowance_opt_in": "boolean", "male_sibling_scholarship_count": "number",
}
# Operators each type allows.
ALLOWED_OPERATORS = {
    "text": ["=", "!=", "in", "not_in", "is_null", "is_not_null"],
    "number": ["=", "!=", ">", "<", ">=", "<=", "is_null", "is_not_null"],
    "date": ["=", "!=", ">", "<", ">=", "<=", "is_null", "is_not_null"],
    "boolean": ["=", "!=", "is_null", "is_not_null"],
}
# Concept names, the field each stands for and its input type.
CONCEPT_FIELDS = {
    "caste_category": ("caste", "text"), "eligible_caste": ("caste", "text"), "caste_eligibility": ("caste", "text"),
    "beneficiary_category": ("caste", "text"), "income_limit": ("annual_income", "number"),
    "gender_restriction": ("gender", "text"), "gender_restriction_boys": ("gender", "text"),
    "institution_eligibility": ("institution_type", "text"), "institution_code": ("institution_type", "text"),
    "institution_standard": ("institution_type", "text"), "institution_criteria": ("institution_type", "text"),
    "course_level": ("course_level", "text"), "course_eligibility": ("course_level", "text"),
    "course_mode": ("study_mode", "text"), "online_course_eligibility": ("study_mode", "text"), "study_mode": ("study_mode", "text"),
    "no_other_scholarship": ("no_other_scholarship", "boolean"), "single_scholarship_rule": ("no_other_scholarship", "boolean"),
    "other_scholarship_exclusion": ("no_other_scholarship", "boolean"), "single_other_scholarship_exclusion": ("no_other_scholarship", "boolean"),
    "nationality": ("nationality", "text"), "eligible_nationality": ("nationality", "text"),
    "medical_allowance_opt_in": ("medical_allowance_opt_in", "boolean"),
}
# Words left out of a stem, and words that make an input boolean.
COVER_STOP = ["excluded", "exclude", "if", "covered", "under", "families", "family", "the", "of", "and", "or", "any"]
PHRASE_STOP = ["the", "of", "and", "or", "to", "for", "a", "an", "as", "be", "by", "from", "with", "in", "on", "any", "may", "is", "are", "time"]
BOOLEAN_SIGNALS = ["resident", "residency", "eligible", "eligibility", "employee", "employed", "drawing", "receiving", "receives", "belongs", "belongs_to", "category", "allowance"]
# Beginnings of names of yes/no fields.
BOOLEAN_PREFIX = r"^(has_|is_|exclude_|receives_|covered_|eligible_)"


def _literal(value: str) -> str:
    return "'" + value.replace("'", "\\'") + "'"


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a fixed table; one parsed literal, as a call per entry is slow on the driver."""
    return F.expr("map(" + ", ".join(_literal(x) for kv in table.items() for x in kv) + ")")[key]


def words(values: list[str]) -> Column:
    return F.expr("array(" + ", ".join(_literal(v) for v in values) + ")")


def manual_input_type(field: Column) -> Column:
    kind = F.coalesce(lookup(FIELD_TYPES, field), lookup(MANUAL_FIELD_TYPES, field), F.lit("text"))
    return F.when(F.lower(F.trim(field)).rlike(BOOLEAN_PREFIX), "boolean").when(kind.isin("boolean", "number"), kind).otherwise("text")


def map_concept(concept: Column) -> Column:
    """struct(field, input_type, mapped) of a concept name or a policy phrase."""
    name = F.trim(concept)
    text = F.lower(name)
    tokens = F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))

    def pick(field: Column, kind: Column) -> Column:
        return F.struct(field.alias("field"), kind.alias("input_type"), F.lit(True).alias("mapped"))

    def has(part: str) -> Column:
        return F.contains(text, F.lit(part))

    yes = F.lit("boolean")
    cover = F.filter(tokens, lambda t: ~F.array_contains(words(COVER_STOP), t))
    stem = F.coalesce(F.nullif(F.array_join(F.slice(cover, 1, 5), "_"), F.lit("")), F.lit("other_scheme"))
    phrase = F.filter(tokens, lambda t: ~F.array_contains(words(PHRASE_STOP), t))
    signal = F.arrays_overlap(phrase, words(BOOLEAN_SIGNALS))
    phrase_stem = F.array_join(F.slice(phrase, 1, 6), "_")
    known_field = lookup({k: f for k, (f, _) in CONCEPT_FIELDS.items()}, text)
    known_type = lookup({k: t for k, (_, t) in CONCEPT_FIELDS.items()}, text)
    return (
        F.when(name == "", F.struct(F.lit("").alias("field"), F.lit("text").alias("input_type"), F.lit(False).alias("mapped")))
        .when(known_field.isNotNull(), pick(known_field, known_type))
        .when(has("west bengal") & (has("resident") | has("residency")), pick(F.lit("has_west_bengal_residency"), yes))
        .when(has("medical allowance"), pick(F.lit("receives_medical_allowance"), yes))
        .when(has("covered under"), pick(F.concat(F.lit("exclude_families_covered_under_"), stem), yes))
        .when(has("other category") & has("state government"), pick(F.lit("state_notified_category_eligibility"), yes))
        .when(has("permanent resident"), pick(F.lit("permanent_residency_status"), yes))
        .when(has(" ") & (F.size(phrase) > 0), pick(
            F.concat(F.when(signal, "has_").otherwise(""), phrase_stem), F.when(signal, "boolean").otherwise("text")))
        .otherwise(F.struct(name.alias("field"), manual_input_type(name).alias("input_type"), F.lit(False).alias("mapped")))
    )
