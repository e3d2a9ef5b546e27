"""Flag tables of the sync and batch rule sets, and the citizen flag state (RUN)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from . import rules as R

# Type and description of each flag of the sync rule set.
SYNC_FLAGS = {
    "A1": ("GHOST", "Age > 110"),
    "A2": ("GHOST", "DOB in future"),
    "D1": ("DATA_QUALITY", "Missing DOB"),
    "E1": ("HOUSEHOLD_RING", "Ration Card Shared by >10 UIDs"),
    "F1": ("INTERNAL_ANOMALY", "High Fraud registration rate (>15%)"),
    "H1": ("EXPLOITATION", "Monetized Ghost (Active transactions on ghost/dup account)"),
    "I1": ("IDENTITY_CLONE", "Shared Member ID on same Ration Card"),
}

# Label and description of each rule of the batch rule set.
RULE_METADATA = [
    ("A1", "Ghost (Age Anomaly)", "Identity with impossible age (>105). High probability of synthetic record."),
    ("A2", "Ghost (Pension Anomaly)", "Individual receiving Old Age Pension but is under 58 years old."),
    ("A3", "Ghost (Child in Adult Scheme)", "Minor under 18 enrolled in adult-only schemes (MGNREGS/Widow)."),
    ("B1", "Identity Duplicate (Exact)", "Exact Name/DOB match across different IDs. High risk of double-dipping."),
    ("B2", "Identity Duplicate (Fuzzy)", "Name/DOB show high similarity (>82%). Check for name variations."),
    ("E1", "Synthetic Household", "Ration Card linked to >10 members. Verify household composition."),
    ("F1", "Operator Corruption Suspect", "Registration point with >15% anomaly rate. Investigate operator trail."),
    ("H1", "Ghost Monetization", "Flagged phantom identity has active financial transactions."),
    ("I1", "Systemic Data Conflict", "Multiple IDs sharing one Member ID. Severe data entry breach."),
]
DEFAULT_LABEL_PREFIX = "Rule "
DEFAULT_DESCRIPTION = "Intelligence flag requiring field audit."


def flag_state(citizens: DataFrame, dup: DataFrame, dob: DataFrame) -> DataFrame:
    """Ghost and duplicate marks after rules B1, B3, A1, A2 of a sync run."""
    in_dup = dup.select("uid").distinct().withColumn("_dup", F.lit(True))
    in_dob = dob.select("uid").distinct().withColumn("_dob", F.lit(True))
    old = F.coalesce(F.col("age") > 110, F.lit(False)) | F.coalesce(F.col("age") < 0, F.lit(False))
    return citizens.join(in_dup, "uid", "left").join(in_dob, "uid", "left").select(
        *citizens.columns,
        (F.coalesce("_dob", F.lit(False)) | old).alias("is_ghost_flag"),
        F.coalesce("_dup", F.lit(False)).alias("is_dup_flag"),
    )


def _as_flags(df: DataFrame, entity: str, key: str) -> DataFrame:
    rule = F.col("rule")
    kind = F.create_map(*[x for r, (t, _) in SYNC_FLAGS.items() for x in (F.lit(r), F.lit(t))])
    text = F.create_map(*[x for r, (_, d) in SYNC_FLAGS.items() for x in (F.lit(r), F.lit(d))])
    return df.select(
        F.lit(entity).alias("entity"), F.col(key).alias("entity_id"), rule,
        kind[rule].alias("type"), text[rule].alias("description"), F.col("confidence"),
    ).distinct()


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def sync_flags(state: DataFrame, member_of: DataFrame, operators: DataFrame, shared: DataFrame, detected_at) -> DataFrame:
    """FLAGGED_AS rows of one sync run, one per (entity, rule).

    ``detected_at`` maps the entity id column to the time of the flag.
    """
    h1 = R._rule(R.paid_ghosts(state).select("uid"), "H1", 98)
    i1 = R._rule(shared.select("uid"), "I1", 100)
    f1 = R._rule(R.suspicious_operators(operators, state).select("operator_id"), "F1", 90)
    people = [R.sync_a1(state), R.sync_a2(state), R.sync_d1(state), h1, i1]
    rows = [_as_flags(p, "citizen", "uid") for p in people]
    rows += [_as_flags(R.sync_e1(member_of), "card", "ration_card_number"), _as_flags(f1, "operator", "operator_id")]
    labels = F.create_map(*[F.lit(x) for r, lab, _ in RULE_METADATA for x in (r, lab)])
    return (
        union(*rows)
        .withColumn("label", F.coalesce(labels[F.col("rule")], F.concat(F.lit(DEFAULT_LABEL_PREFIX), "rule")))
        .withColumn("detected_at", detected_at(F.col("entity_id")))
        .withColumn("ruleset", F.lit("sync"))
    )


def batch_results(citizens: DataFrame, schemes: DataFrame, resides: DataFrame, member_of: DataFrame, state: DataFrame) -> dict[str, DataFrame]:
    """All hits (uid, cases, confidence) that are persisted as flags. C1 has no person; E1 and F1 are not handed on."""
    plain = {
        "A1": R.rule_a1(citizens, None), "A2": R.rule_a2(citizens, schemes, None), "A3": R.rule_a3(citizens, schemes, None),
        "C2": R.rule_c2(citizens, schemes, None), "H1": R.rule_h1(state, None),
    }
    one = F.lit(1).cast("bigint").alias("cases")
    return {rule: df.select("uid", one, "confidence") for rule, df in plain.items()} | {
        "B1": R.hits_b1(citizens), "B2": R.hits_b2(citizens, resides), "I1": R.hits_i1(member_of, citizens),
    }


def rule_type(rule: Column) -> Column:
    return F.when(rule.startswith("A"), "GHOST").when(rule.startswith("B"), "DUPLICATE").otherwise("ANOMALY")


def persist_flags(results: dict[str, DataFrame]) -> DataFrame:
    """One flag per (uid, rule) of the batch hits; of a pair only the first person is flagged."""
    rows = union(*[
        df.select("uid", F.lit(rule).alias("rule"), "confidence")
        for rule, df in results.items()
    ])
    labels = F.create_map(*[F.lit(x) for r, lab, _ in RULE_METADATA for x in (r, lab)])
    texts = F.create_map(*[F.lit(x) for r, _, d in RULE_METADATA for x in (r, d)])
    rule = F.col("rule")
    return (
        rows.where("uid IS NOT NULL").groupBy("uid", "rule").agg(F.max("confidence").alias("confidence"))
        .select(
            "uid", "rule",
            F.coalesce(labels[rule], F.concat(F.lit(DEFAULT_LABEL_PREFIX), rule)).alias("label"),
            rule_type(rule).alias("type"), "confidence",
            F.coalesce(texts[rule], F.lit(DEFAULT_DESCRIPTION)).alias("description"),
            F.lit("batch").alias("ruleset"),
        )
    )


def apply_flags(state: DataFrame, flags: DataFrame) -> DataFrame:
    """Citizen flag state after a batch run: new marks on top of the old ones."""
    new = flags.groupBy("uid").agg(
        F.bool_or(F.col("type") == "GHOST").alias("_g"), F.bool_or(F.col("type") == "DUPLICATE").alias("_d"),
        F.bool_or(F.col("type") == "ANOMALY").alias("_a"),
    )
    off = F.lit(False)
    return state.join(new, "uid", "left").select(
        "uid",
        (F.coalesce("is_ghost_flag", off) | F.coalesce("_g", off)).alias("is_ghost_flag"),
        (F.coalesce("is_dup_flag", off) | F.coalesce("_d", off)).alias("is_dup_flag"),
        F.coalesce("_a", off).alias("is_anomaly_flag"),
    )


def persist_operators(operators: DataFrame, f1: DataFrame) -> DataFrame:
    every = operators.select("operator_id").distinct()
    return every.join(f1.select("operator_id", "fraud_rate"), "operator_id", "left").withColumn(
        "is_suspicious", F.col("fraud_rate").isNotNull()
    )
