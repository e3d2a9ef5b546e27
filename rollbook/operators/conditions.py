"""Condition rows: canonical form, validation, repair, merge, criteria, signals, versions (ELG-10 to ELG-17).

A condition row is (rule_id, bucket, field, operator, kind, value, values, value_type,
evidence_quote). ``kind`` tells what the value is: number, string, boolean, list or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .concepts import ALLOWED_OPERATORS, FIELD_TYPES, lookup, map_concept, words

SCHEME_CODE = r"(?i)^(SS_\d{2,6}|S\d{2,6}|C\d{2,6})$"
NON_BLOCKING = ["eligibility_scope", "exclusion_list"]
PROMOTE_AT = 3
NO_LIST = "cast(array() AS array<string>)"


def money_text(c: Column) -> Column:
    return c.cast("decimal(18,2)").cast("string")


def _row(bucket: str, field: str, operator: str, kind: str, value: Column | None, values: Column | None = None) -> Column:
    return F.struct(
        F.lit(bucket).alias("bucket"), F.lit(field).alias("field"), F.lit(operator).alias("operator"), F.lit(kind).alias("kind"),
        (F.lit(None).cast("string") if value is None else value).alias("value"),
        (F.expr(NO_LIST) if values is None else values).alias("values"), F.lit(FIELD_TYPES[field]).alias("value_type"),
    )


def canonical_conditions(flat: DataFrame) -> DataFrame:
    """One row per condition of the flat form, in the order of the fields."""
    def listed(c: str, bucket: str, field: str) -> Column:
        return F.when(F.size(c) > 0, _row(bucket, field, "in", "list", None, F.col(c)))

    rows = [
        F.when(F.col("age_min").isNotNull(), _row("include", "age", ">=", "number", money_text(F.col("age_min")))),
        F.when(F.col("age_max").isNotNull(), _row("include", "age", "<=", "number", money_text(F.col("age_max")))),
        listed("gender_in", "include", "gender"),
        listed("marital_status_in", "include", "marital_status"),
        F.when(F.col("income_max").isNotNull(), _row("include", "annual_income", "<=", "number", money_text(F.col("income_max")))),
        F.when(F.col("requires_disability"), _row("include", "is_disabled", "=", "boolean", F.lit("true"))),
        listed("conflict_scheme_ids", "exclude", "scheme_id"),
    ]
    out = flat.select(F.col("doc_id").alias("rule_id"), F.posexplode(F.array_compact(F.array(*rows))).alias("pos", "c"))
    return out.select("rule_id", "pos", "c.*").withColumn("evidence_quote", F.lit(None).cast("string"))


def condition_error(df: DataFrame) -> Column:
    """Why a condition is not valid; null when it is."""
    field, op, kind = F.trim("field"), F.trim("operator"), F.col("kind")
    want = lookup(FIELD_TYPES, field)
    kind_of = F.when(want.isin("text", "date"), "string").otherwise(want)
    allowed = F.create_map(*[x for k, v in ALLOWED_OPERATORS.items() for x in (F.lit(k), words(v))])[want]
    return (
        F.when(field == "", "EMPTY_FIELD").when(want.isNull(), "UNSUPPORTED_FIELD").when(op == "", "EMPTY_OPERATOR")
        .when(F.coalesce("value_type", want) != want, "VALUE_TYPE_MISMATCH")
        .when(~F.array_contains(allowed, op), "OPERATOR_NOT_ALLOWED")
        .when(op.isin("is_null", "is_not_null"), F.when(kind != "null", "VALUE_NOT_EXPECTED"))
        .when(op.isin("in", "not_in"), F.when((kind != "list") | (F.size("values") == 0), "LIST_REQUIRED"))
        .when(kind == "null", "VALUE_REQUIRED")
        .when(kind != kind_of, "VALUE_KIND_MISMATCH")
    )


def validate_conditions(conditions: DataFrame) -> DataFrame:
    return conditions.withColumn("error", condition_error(conditions))


def unmapped_row(requirement: Column, quote: Column, reason: Column | None = None) -> Column:
    """An unmapped condition of a requirement, with its input field and the reason."""
    c = map_concept(requirement)
    named = c["mapped"] & (c["field"] != "") & (c["field"] != F.trim(requirement))
    text = F.when(
        named,
        F.concat(F.lit("Policy concept '"), F.trim(requirement), F.lit("' is not yet executable from the current dataset and has been normalized to manual field '"), c["field"], F.lit("'.")),
    ).otherwise("Detected criterion is not yet mapped to the executable field registry.")
    return F.struct(
        F.trim(requirement).alias("requirement"), F.coalesce(F.nullif(c["field"], F.lit("")), F.trim(requirement)).alias("suggested_input_field"),
        c["input_type"].alias("input_type"), (text if reason is None else reason).alias("reason_unmapped"), quote.alias("evidence_quote"),
    )


def sanitize_conditions(conditions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept conditions, downgraded rows): scheme conditions whose values are no codes become unmapped."""
    every = F.when(F.col("kind") == "list", F.col("values")).otherwise(F.array("value"))
    listed = F.filter(F.transform(every, lambda v: F.trim(v)), lambda v: v != "")
    bad = (
        (F.trim("field") == "scheme_id") & F.trim("operator").isin("=", "!=", "in", "not_in")
        & (F.size(listed) > 0) & ~F.forall(listed, lambda v: v.rlike(SCHEME_CODE))
    )
    rows = conditions.withColumn("_bad", F.coalesce(bad, F.lit(False))).withColumn("_values", listed)
    phrase = F.trim(F.coalesce(F.nullif(F.col("evidence_quote"), F.lit("")), F.get("_values", F.lit(0))))
    need = F.when(F.col("bucket") == "exclude", F.concat(F.lit("Excluded if covered under "), phrase)).otherwise(phrase)
    reason = F.concat(
        F.lit("Condition used field 'scheme_id' with non-code value(s) ["), F.array_join("_values", ", "), F.lit("], so it was downgraded to a manual-review condition.")
    )
    down = rows.where("_bad").select("rule_id", "bucket", unmapped_row(need, F.col("evidence_quote"), reason).alias("u")).select("rule_id", "bucket", "u.*")
    return rows.where("NOT _bad").drop("_bad", "_values"), down


def value_key() -> Column:
    return F.concat_ws("|", "kind", F.coalesce("value", F.lit("")), F.array_join("values", ","))


def merge_conditions(first: DataFrame, second: DataFrame) -> DataFrame:
    """Conditions of two sources, equal (bucket, field, operator, value) once, the first source wins."""
    both = first.withColumn("source_rank", F.lit(1)).unionByName(second.withColumn("source_rank", F.lit(2)))
    keyed = both.withColumn("value_key", value_key())
    rest = [c for c in both.columns if c not in ("rule_id", "bucket", "field", "operator")]
    return keyed.groupBy("rule_id", "bucket", "field", "operator", "value_key").agg(
        F.min_by(F.struct(*rest), F.struct("source_rank", "pos")).alias("r")
    ).select("rule_id", "bucket", "field", "operator", "r.*")


def merge_unmapped(first: DataFrame, second: DataFrame) -> DataFrame:
    both = first.withColumn("source_rank", F.lit(1)).unionByName(second.withColumn("source_rank", F.lit(2)))
    keys = ["rule_id", "suggested_input_field", "requirement"]
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("source_rank", "pos")).alias("r")).select(*keys, "r.*")


def detected_criteria(flat: DataFrame, concepts: DataFrame) -> DataFrame:
    """Criteria of a rule: executable ones and those that need an input or have no mapping yet."""
    keys = {
        "include": ["age_min", "age_max", "gender_in", "marital_status_in", "income_max", "requires_disability"],
        "exclude": ["conflict_scheme_ids"],
    }
    def is_set(c: str) -> Column:
        if c in ("gender_in", "marital_status_in", "conflict_scheme_ids"):
            return F.size(c) > 0
        return F.col(c) if c == "requires_disability" else F.col(c).isNotNull()

    entries = [
        F.when(is_set(c), F.struct(F.lit(c).alias("criterion_key"), F.lit(b).alias("bucket"), F.lit("EXECUTABLE").alias("status"), F.lit(None).cast("string").alias("suggested_input_field")))
        for b, cols in keys.items() for c in cols
    ]
    ready = flat.select("doc_id", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("doc_id", "e.*")
    short = F.element_at(F.split("requirement", r"\."), -1)
    c = map_concept(short)
    mapped = c["mapped"]
    open_ones = concepts.select(
        "doc_id", F.col("requirement").alias("criterion_key"), F.lit("unknown").alias("bucket"),
        F.when(mapped, "NEEDS_USER_INPUT").otherwise("UNMAPPED_LOGIC").alias("status"), F.when(mapped, c["field"]).alias("suggested_input_field"),
    )
    return ready.unionByName(open_ones)


def count_signals(observations: DataFrame) -> DataFrame:
    """Counters of unmapped fields: a document counts once per field."""
    return observations.groupBy("field_key").agg(
        F.countDistinct("doc_id").alias("occurrence_count"), F.min("doc_id").alias("first_seen"), F.max("doc_id").alias("last_seen"),
        F.max(F.when(F.col("quote").isNotNull(), F.struct("doc_id", "quote"))).alias("q"),
    ).select("field_key", "occurrence_count", "first_seen", "last_seen", F.col("q.quote").alias("latest_quote"), F.col("q.doc_id").cast("long").alias("quoted_in"))


def promoted(count: Column) -> Column:
    return F.when(count >= PROMOTE_AT, "ACTIVE").otherwise("CANDIDATE")


SIGNALS = "field_key string, occurrence_count long, first_seen long, last_seen long, latest_quote string, quoted_in long, status string"


def merge_signals(counters: DataFrame) -> DataFrame:
    """Counters of disjoint observations added up; a candidate becomes active at three."""
    out = counters.groupBy("field_key").agg(
        F.sum("occurrence_count").alias("occurrence_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.max(F.when(F.col("latest_quote").isNotNull(), F.struct("quoted_in", "latest_quote"))).alias("q"),
    )
    out = out.select("field_key", "occurrence_count", "first_seen", "last_seen", F.col("q.latest_quote").alias("latest_quote"), F.col("q.quoted_in").alias("quoted_in"))
    return out.withColumn("status", promoted(F.col("occurrence_count")))


def learn_signals(signals: DataFrame, observations: DataFrame) -> DataFrame:
    """Old counters with new observations added."""
    return merge_signals(signals.drop("status").unionByName(count_signals(observations)))


def version_rules(rules: DataFrame, keys: list[str], order: str, span: int = 10000) -> DataFrame:
    """Version number per key by ``order`` (a whole number) and the mark of the latest.

    A key can hold most rules, so rows are numbered inside spans of the order and shifted by the
    rows of earlier spans: no task sorts a whole key.
    """
    spans = rules.withColumn("_span", F.floor(F.col(order) / span))
    sizes = spans.groupBy(*keys, "_span").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_all", F.sum("_n").over(whole)).drop("_n")
    inside = Window.partitionBy(*keys, "_span").orderBy(order)
    numbered = spans.withColumn("_in", F.row_number().over(inside)).join(sizes, [*keys, "_span"])
    version = F.col("_in") + F.col("_before")
    return numbered.withColumn("rule_version", version).withColumn("is_latest", version == F.col("_all")).drop("_span", "_in", "_before", "_all")
