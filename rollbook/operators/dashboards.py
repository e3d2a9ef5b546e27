"""Dashboard and case-work queries over the graph tables (DSH).

Inputs named the same way everywhere: ``citizens`` (scored, with flag marks), ``places`` (citizen
to GP, block and district), ``schemes`` (citizen to scheme), ``flags`` (FLAGGED_AS rows),
``dup`` and ``dob`` (cluster tables of the pair edges).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ranking import pair_count, top_per_group
from ..functions.text import contains_join
from .flags import union
from .quality import one_row
from .rules import first_gp
from .scores import half_up, risk_tier

# Canonical rule codes, their names and plain explanations.
CANONICAL_RULES = ["A1", "A2", "A3", "B1", "B2", "B3", "C1", "C2", "D1", "D2", "D3", "E1", "F1", "G1", "H1", "I1"]
RULE_NAMES = {
    "A1": "Ghost Beneficiary - Demographic anomaly",
    "A2": "Ghost Beneficiary - Identity inconsistency",
    "B1": "Duplicate Identity - High similarity profile",
    "B2": "Duplicate Identity - Cross-record mismatch",
    "B3": "Duplicate Identity - Same DOB cluster",
    "C1": "Scheme Anomaly - GP concentration spike",
    "C2": "Scheme Anomaly - Mutually exclusive scheme overlap",
    "D1": "Data Quality - Null/invalid demographic field",
    "D2": "Data Quality - Gender or schema anomaly",
    "D3": "Data Quality - Future DOB anomaly",
    "E1": "Household Ring - Synthetic household overload",
    "F1": "Operator Anomaly - Suspicious registration concentration",
    "G1": "Network Anomaly - Relationship graph outlier",
    "H1": "Internal Integrity - System pattern deviation",
    "I1": "Internal Integrity - High-risk correlation signal",
}
RULE_EXPLANATIONS = {
    "A1": "Potential ghost beneficiary due to abnormal demographic pattern.",
    "A2": "Potential ghost beneficiary due to identity mismatch across records.",
    "B1": "Possible duplicate person with highly similar profile details.",
    "B2": "Possible duplicate person with cross-record inconsistency.",
    "B3": "Possible duplicate person sharing DOB cluster at same GP.",
    "C1": "Scheme concentration appears unusually high in one local cluster.",
    "C2": "Citizen appears in schemes that should not overlap together.",
    "D1": "One or more mandatory demographic fields are null, blank, or invalid.",
    "D2": "Gender value or demographic schema format is inconsistent/invalid.",
    "D3": "Date of birth is in the future or chronologically invalid.",
    "E1": "Household graph shows synthetic/overloaded linkage pattern.",
    "F1": "Operator-linked registrations show suspicious concentration.",
    "G1": "Relationship network structure appears as an outlier pattern.",
    "H1": "Internal integrity signal indicates abnormal system behavior pattern.",
    "I1": "High-risk pattern emerges from combined internal correlations.",
}
REVIEW_ACTIONS = ["APPROVE", "REJECT", "ESCALATE", "NEEDS_FIELD_VERIFICATION"]
NOTE_REQUIRED = ["REJECT", "ESCALATE"]


def citizen_flags(flags: DataFrame) -> DataFrame:
    return flags.where("entity = 'citizen'").withColumnRenamed("entity_id", "uid")


def first_place(places: DataFrame) -> DataFrame:
    return places.groupBy("uid").agg(
        F.min("district_name").alias("district"), F.min("block_name").alias("block"), F.min("gp_name").alias("gp")
    )


#: A table limited to so many rows goes to every task.
BROADCAST_ROWS = 10_000
#: Members of a cluster that a drawing shows; the links carry the full count.
DRAWN = 20


def of_top(df: DataFrame, top: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows of ``df`` for the citizens of ``top``; sent to every task only where ``rows``, the limit of ``top``, is given and small."""
    ids = top.select("uid").distinct()
    return df.join(F.broadcast(ids) if rows is not None and rows <= BROADCAST_ROWS else ids, "uid", "left_semi")


def scheme_list(schemes: DataFrame, col: str) -> DataFrame:
    """Distinct schemes of a citizen as text; bounded by the scheme catalog."""
    return schemes.groupBy("uid").agg(F.array_join(F.sort_array(F.collect_set(col)), ",").alias("schemes"))


# --- counts ------------------------------------------------------------------------------------


def flagged_cases(flags: DataFrame) -> DataFrame:
    return flags.select("entity", "entity_id").distinct().agg(
        F.count_if(F.col("entity") == "citizen").alias("citizen_cases"),
        F.count_if(F.col("entity") == "operator").alias("operator_cases"),
        F.count_if(F.col("entity") == "card").alias("household_cases"),
        F.count("*").alias("total"),
    )


def _critical() -> Column:
    return (F.col("risk_tier") == "CRITICAL") | (F.coalesce("vulnerability_score", F.lit(0)) >= 80)


def _high() -> Column:
    return F.col("risk_tier").isin("HIGH", "CRITICAL") | (F.coalesce("vulnerability_score", F.lit(0)) >= 60)


def kpi_stats(citizens: DataFrame, registry_total: int) -> DataFrame:
    return citizens.agg(
        F.count("*").alias("total_citizens"),
        half_up(F.coalesce(F.avg("vulnerability_score"), F.lit(0.0)), 2).alias("avg_vulnerability"),
        F.count_if(_critical()).alias("critical_count"),
        F.count_if(_high()).alias("high_risk_count"),
        F.count_if(F.lower(F.coalesce("gender", F.lit(""))) == "female").alias("female_count"),
        F.count_if(F.col("risk_tier") == "CRITICAL").alias("critical_tier_count"),
    ).withColumn("registry_total", F.lit(registry_total)).withColumn(
        "coverage_pct", F.round(F.col("total_citizens") / F.col("registry_total") * 100, 1)
    )


def heatmap(citizens: DataFrame, places: DataFrame) -> DataFrame:
    rows = places.select("uid", "gp_code", "block_code", "district_name").distinct().join(
        citizens.select("uid", "vulnerability_score", "risk_tier"), "uid"
    )
    return rows.groupBy(F.col("district_name").alias("district")).agg(
        F.countDistinct("uid").alias("citizen_count"),
        half_up(F.coalesce(F.avg("vulnerability_score"), F.lit(0.0)), 2).alias("avg_risk_score"),
        F.countDistinct(F.when(_critical(), F.col("uid"))).alias("critical_count"),
        F.countDistinct(F.when(_high(), F.col("uid"))).alias("high_count"),
    ).orderBy(F.desc("avg_risk_score"), "district")


def score_distribution(citizens: DataFrame) -> DataFrame:
    return citizens.where("risk_tier IS NOT NULL").groupBy(F.col("risk_tier").alias("tier")).agg(F.count("*").alias("citizen_count")).orderBy(F.desc("citizen_count"), "tier")


def birth_year(dob: Column) -> Column:
    return F.element_at(F.split(dob, "-"), 1).try_cast("int")


def top_risk(citizens, places, schemes, as_of_year: int, limit: int = 20, tier: str | None = None, segment: str | None = None) -> DataFrame:
    """Highest scores first; only the top rows reach the joins."""
    rows = citizens.where("vulnerability_score IS NOT NULL")
    if tier:
        rows = rows.where(F.col("risk_tier") == tier.upper())
    year = birth_year(F.col("dob"))
    old, young = as_of_year - 60, as_of_year - 18
    segments = {"elderly": year <= old, "children": year >= young, "workers": (year > old) & (year < young)}
    if segment in segments:
        rows = rows.where(segments[segment])
    top = rows.orderBy(F.desc("vulnerability_score"), "uid").limit(limit)
    return (
        top.select("name", "gender", "dob", "uid", F.col("vulnerability_score").alias("score"), F.col("risk_tier").alias("tier"))
        .join(first_place(of_top(places, top, limit)), "uid", "left")
        .join(scheme_list(of_top(schemes, top, limit), "scheme_name"), "uid", "left")
        .orderBy(F.desc("score"), "uid")
    )


def ghost_list(citizens, places, schemes, flags, n: int = 200) -> DataFrame:
    hits = citizen_flags(flags).where("type = 'GHOST'").orderBy(F.desc("confidence"), "uid", "rule").limit(n)
    return (
        hits.select("uid", "rule", "confidence", "description")
        .join(of_top(citizens, hits, n).select("uid", "name", "dob"), "uid")
        .join(first_gp(of_top(places, hits, n)), "uid", "left")
        .join(of_top(schemes, hits, n).groupBy("uid").agg(F.min("scheme_name").alias("scheme")), "uid", "left")
        .select("uid", "name", F.coalesce("dob", F.lit("Unknown")).alias("dob"), F.coalesce("gp_name", F.lit("Unknown")).alias("shared_gp"),
                F.coalesce("scheme", F.lit("General")).alias("scheme"), "confidence", "rule", "description")
    )


# --- feed --------------------------------------------------------------------------------------

def feed_total(flags, dup, dob) -> DataFrame:
    """Rows of the whole feed; pair edges are counted from the cluster sizes."""
    def edges(t: DataFrame, keys: list[str]) -> DataFrame:
        return t.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum(pair_count(F.col("n"))).alias("n"))

    counts = union(flags.agg(F.count("*").alias("n")), edges(dup, ["cluster_id"]), edges(dob, ["gp_code", "dob"]))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total"))


def feed_ids(page: DataFrame) -> DataFrame:
    """Row id: first 24 hex digits of the sha-256 of five fields; a null counts as ''."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("rule", "uid", "name", "detected_at", "description")]
    return page.withColumn("id", F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24))


def latest_reviews(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("decision_id").agg(
        F.max_by(F.struct("action", "note", "reviewed_at"), F.struct("reviewed_at", "review_id")).alias("r")
    ).select("decision_id", F.col("r.action").alias("review_action"), F.col("r.note").alias("review_note"), F.col("r.reviewed_at").alias("reviewed_at"))


def with_reviews(page: DataFrame, reviews: DataFrame, key: str = "id") -> DataFrame:
    return page.join(latest_reviews(reviews).withColumnRenamed("decision_id", key), key, "left")


def categorise(page: DataFrame) -> DataFrame:
    """Feed categories ghost, duplicate and anomaly; a row can be in several."""
    rule, kind = F.upper(F.coalesce("rule", F.lit(""))), F.upper(F.coalesce("type", F.lit("")))
    ghost = kind.contains("GHOST")
    dup = kind.rlike("DUPLICATE|CLONE") | rule.rlike("^[BI]")
    anomaly = kind.rlike("ANOMALY|INTERNAL") | rule.rlike("^[CFH]")
    marks = F.array_compact(F.array(F.when(ghost, "ghost"), F.when(dup, "duplicate"), F.when(anomaly, "anomaly")))
    return page.withColumn("category", F.explode(marks))


def queue_as_feed(queue: DataFrame) -> DataFrame:
    """Audit queue rows in feed form: first rule, confidence = score or 18 per flag, held in 70 to 99."""
    raw = F.coalesce(F.nullif(F.col("score"), F.lit(0)), F.col("flags") * 18)
    codes = F.nullif(F.col("rule_codes"), F.lit(""))
    return queue.select(
        F.coalesce(F.element_at(F.split(codes, ","), 1), F.lit("AUDIT")).alias("rule"),
        F.coalesce(F.replace(codes, F.lit(","), F.lit(", ")), F.lit("Priority Queue Case")).alias("label"),
        F.lit("AUDIT_QUEUE").alias("type"), "name", "uid", "dob", F.col("gp").alias("gp_name"), "district", "block", "scheme",
        F.greatest(F.lit(70), F.least(F.lit(99), raw)).cast("int").alias("confidence"),
        F.coalesce(
            F.nullif(F.element_at(F.split("flag_notes", r" \| "), 1), F.lit("")),
            F.concat(F.col("flags").cast("string"), F.lit(" linked fraud signals require field verification.")),
        ).alias("description"),
    )


def export_flags(page: DataFrame) -> DataFrame:
    """Rows of the flag export; an entry of the feed stands for as many ``records`` as it has rows."""
    weight = [F.col("rows").alias("records")] if "rows" in page.columns else []
    return page.select(
        F.col("rule").alias("rule_id"), F.coalesce("name", F.lit("Unknown")).alias("name"), F.coalesce("label", "type").alias("category"),
        F.col("description").alias("risk_explanation"), F.concat(F.col("confidence").cast("string"), F.lit("%")).alias("confidence"),
        F.coalesce("gp_name", F.lit("")).alias("shared_gp"), F.coalesce("dob", F.lit("")).alias("dob"), *weight,
    )


def anomalies(c1: DataFrame, c2: DataFrame) -> DataFrame:
    """Rows of rules C1 and C2 with the number of rows of their rule."""
    none = F.lit(None).cast("string")
    rows = c1.select("rule", "confidence", F.col("gp_code").alias("subject"), F.concat_ws("/", "gp_name", "block").alias("detail")).unionByName(
        c2.select("rule", "confidence", F.col("uid").alias("subject"), F.concat_ws("/", "scheme_a", "scheme_b").alias("detail"))
    )
    counts = rows.groupBy("rule").agg(F.count("*").alias("rule_total"))
    return rows.join(counts, "rule").orderBy(F.desc("confidence"), "subject", "detail")


# --- audit queue -------------------------------------------------------------------------------


def _rule_filter(flags: DataFrame, rules: list[str] | None) -> DataFrame:
    codes = [r.strip().upper() for r in rules or [] if r.strip()]
    rows = citizen_flags(flags)
    return rows.where(F.upper(F.coalesce("rule", F.lit(""))).isin(codes)) if codes else rows


def _place_filter(places: DataFrame, district: str, block: str) -> DataFrame:
    out = places
    if district:
        out = out.where(F.coalesce("district_name", F.lit("")) == district)
    if block:
        out = out.where(F.coalesce("block_name", F.lit("")) == block)
    return out


def _queue(citizens, places, flags, rules, district, block) -> DataFrame:
    """Flags, rules and notes per citizen; flags are filtered first, places only restrict."""
    rows = _rule_filter(flags, rules)
    district, block = (district or "").strip(), (block or "").strip()
    if district or block:
        rows = rows.join(_place_filter(places, district, block).select("uid"), "uid", "left_semi")
    per = rows.groupBy("uid").agg(
        F.countDistinct("rule").alias("flags"),
        F.array_join(F.sort_array(F.collect_set(F.upper(F.coalesce("rule", F.lit("UNKNOWN"))))), ",").alias("rule_codes"),
        F.array_join(F.sort_array(F.collect_set("description")), " | ").alias("flag_notes"),
        F.slice(F.sort_array(F.collect_set(F.concat_ws(": ", "label", "description"))), 1, 2).alias("first_notes"),
    )
    return per.join(citizens.select("uid", "name", "dob", "gender", F.col("vulnerability_score").alias("score")), "uid")


def audit_queue(citizens, places, schemes, flags, limit: int = 50, rules=None, district: str = "", block: str = "") -> DataFrame:
    """Citizens with the most flags, then the highest score; place and scheme only for the top rows."""
    top = _queue(citizens, places, flags, rules, district, block).orderBy(F.desc("flags"), F.desc("score"), "uid").limit(limit)
    where = first_place(of_top(_place_filter(places, (district or "").strip(), (block or "").strip()), top, limit))
    scheme = of_top(schemes, top, limit).groupBy("uid").agg(F.min("scheme_id").alias("scheme"))
    return top.join(where, "uid", "left").join(scheme, "uid", "left").select(
        "name", "uid", "dob", "gender", "score", "district", "block", "gp", "flags", "rule_codes", "flag_notes",
        F.coalesce("scheme", F.lit("N/A")).alias("scheme"),
    )


def audit_queue_total(citizens, places, flags, rules=None, district: str = "", block: str = "") -> DataFrame:
    rows = _rule_filter(flags, rules)
    if district or block:
        rows = rows.join(_place_filter(places, district, block).select("uid"), "uid", "left_semi")
    return rows.agg(F.countDistinct("uid").alias("total"))


def filter_values(places: DataFrame, flags: DataFrame) -> DataFrame:
    """Districts, blocks, rules and (district, block) pairs for the filters; blanks dropped."""
    none = F.lit(None).cast("string")
    p = places.select(F.trim("district_name").alias("d"), F.trim("block_name").alias("b")).distinct()
    parts = [
        p.select(F.lit("district").alias("kind"), F.col("d").alias("value"), none.alias("value2")),
        p.select(F.lit("block").alias("kind"), F.col("b").alias("value"), none.alias("value2")),
        p.where("b <> ''").select(F.lit("district_block").alias("kind"), F.col("d").alias("value"), F.col("b").alias("value2")),
        citizen_flags(flags).select(F.lit("rule").alias("kind"), F.upper(F.trim("rule")).alias("value"), none.alias("value2")),
    ]
    return union(*parts).where("value <> ''").distinct()


def audit_rules(spark, flags: DataFrame) -> DataFrame:
    """Canonical and detected rule codes."""
    found = citizen_flags(flags).select(F.upper("rule").alias("rule")).distinct().withColumn("detected", F.lit(True))
    known = spark.createDataFrame([(r,) for r in CANONICAL_RULES], "rule string")
    return known.join(found, "rule", "full").select("rule", F.coalesce("detected", F.lit(False)).alias("detected"))


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(default))


def audit_brief(citizens, places, flags, rules=None, district: str = "", block: str = "") -> DataFrame:
    """Rows of the printed brief: region, rule names, reason of the first rule, first two notes."""
    rows = _queue(citizens, places, flags, rules, district, block)
    where = first_place(_place_filter(places, (district or "").strip(), (block or "").strip()))
    codes = F.split("rule_codes", ",")
    names = F.transform(codes, lambda c: F.concat(c, F.lit(" - "), _lookup(RULE_NAMES, c, "Unclassified Rule")))
    reason = _lookup(RULE_EXPLANATIONS, F.element_at(codes, 1), "General anomaly for field verification.")
    notes = F.when(F.size("first_notes") > 0, F.concat(F.lit(" | Signal details: "), F.array_join("first_notes", " | "))).otherwise("")
    return rows.join(where, "uid", "left").select(
        F.coalesce("name", F.lit("Unknown")).alias("name"), "uid", F.coalesce("district", F.lit("N/A")).alias("district"),
        F.concat_ws(" / ", F.coalesce("gp", F.lit("N/A")), F.coalesce("block", F.lit("N/A"))).alias("region"),
        "flags", F.array_join(names, "; ").alias("rules_text"), F.concat(F.lit("Why flagged: "), reason, notes).alias("justification"),
    )


def operator_audit(citizens, operators, flags, operator: str) -> DataFrame:
    """Every citizen of an operator with the flags as text, strongest first."""
    mine = operators.where(F.col("operator_id") == operator).select("uid")
    f = citizen_flags(flags).join(mine, "uid", "left_semi").groupBy("uid").agg(
        F.sort_array(F.collect_list(F.struct(-F.col("confidence"), F.col("rule"), F.col("type")))).alias("f")
    )
    text = F.array_join(F.transform("f", lambda x: F.concat_ws(":", x["rule"], x["type"], (-x["col1"]).cast("string"))), ",")
    rows = citizens.join(mine, "uid", "left_semi").join(f, "uid", "left")
    return rows.select(
        "uid", "name", F.col("vulnerability_score").alias("risk_score"), risk_tier(F.col("vulnerability_score")).alias("tier"), "gender", "dob",
        F.coalesce(text, F.lit("")).alias("flags"), F.coalesce(F.size("f"), F.lit(0)).alias("flag_count"),
    )


def operator_summary(audit: DataFrame) -> DataFrame:
    out = audit.agg(F.count("*").alias("registrations"), F.count_if(F.col("flag_count") > 0).alias("flagged"))
    return out.withColumn("flag_rate_pct", F.when(F.col("registrations") > 0, F.round(F.col("flagged") / F.col("registrations") * 100, 0)).otherwise(0.0))


def rules_ef(e1: DataFrame, f1: DataFrame) -> DataFrame:
    e = e1.select("rule", F.col("ration_card_number").alias("subject"), F.col("member_count").alias("total"), F.lit(None).cast("double").alias("rate"), "confidence").distinct()
    f = f1.select("rule", F.col("operator_id").alias("subject"), F.col("total_registrations").alias("total"), F.col("fraud_rate").alias("rate"), "confidence")
    return e.unionByName(f)


def integrity(quality: DataFrame, citizens: DataFrame) -> DataFrame:
    issues = quality.agg(F.sum("issue_count").alias("total_issues"))
    people = citizens.agg(F.count("*").alias("total_citizens"))
    raw = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round((1.0 - F.col("total_issues") / F.col("total_citizens")) * 100.0, 1)))
    out = one_row(issues, people).withColumn("i", F.when(F.col("total_citizens") > 0, raw).otherwise(0.0))
    out = out.withColumn("integrity_index", F.when((F.col("total_issues") > 0) & (F.col("i") >= 100.0), 99.9).otherwise(F.col("i"))).drop("i")
    return out.withColumn("health", F.when(F.col("integrity_index") >= 95, "GOOD").when(F.col("integrity_index") >= 85, "FAIR").otherwise("POOR"))


# --- neighborhoods and slices ------------------------------------------------------------------


#: Cluster tables: label of their links, text, and key columns.
HUBS = {"B1": ("POTENTIAL_DUPLICATE", "Rule: B1 (Conf: 92%)", ["cluster_id"]), "B3": ("SAME_DOB_AT_GP", "Same date of birth at one GP", ["gp_code", "dob"])}


def hub_id(rule: str) -> Column:
    return F.concat_ws(":", F.lit(rule), *HUBS[rule][2])


def hub_members(table: DataFrame, rule: str, hubs: DataFrame | None = None) -> DataFrame:
    """(hub, uid, cluster_size): all members of clusters, of those in ``hubs`` if given; one row a member, whatever the number of pairs."""
    rows = table.select(hub_id(rule).alias("hub"), "uid", "cluster_size")
    return rows if hubs is None else rows.join(hubs.select("hub").distinct(), "hub", "left_semi")


def hub_links(table: DataFrame, rule: str, seeds: DataFrame, rows: int | None = None) -> DataFrame:
    """A drawing: links of seeds to the hubs of their clusters, and of these hubs to their first ``DRAWN`` members. The queries list all links (``partners``).

    A hub stands for all pairs of its cluster: ``link_count`` of a seed's link is the number of its
    partners, that of a hub's link the size of the cluster. So the links are linear in seeds and hubs.
    """
    label, text, _ = HUBS[rule]
    own = hub_members(of_top(table, seeds, rows), rule)
    near = own.select(F.col("uid").alias("source"), F.col("hub").alias("target"), F.lit(label).alias("label"), F.lit(text).alias("description"), (F.col("cluster_size") - 1).cast("bigint").alias("link_count"))
    drawn = top_per_group(hub_members(table, rule, own), ["hub"], [F.col("uid")], DRAWN, ["uid"])
    far = drawn.select(F.col("hub").alias("source"), F.col("uid").alias("target"), F.lit("CLUSTER_MEMBER").alias("label"), F.concat(F.lit("Member "), F.col("rn").cast("string")).alias("description"), F.col("cluster_size").cast("bigint").alias("link_count"))
    return near.distinct().unionByName(far)


def partners(table: DataFrame, seeds: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """All links of the seeds inside their clusters, from the seed to each other member: linear in the clusters of a bounded number of seeds."""
    own = of_top(table, seeds, rows).select(F.col("uid").alias("src"), *keys, "cluster_size")
    return table.select(F.col("uid").alias("dst"), *keys).join(own, keys).where("src <> dst").select("src", "dst", "cluster_size")


def neighborhood(citizens, places, flags, dup, dob, c1, schemes_dim, seeds: DataFrame) -> DataFrame:
    """Links of the two-hop neighborhood of the seed citizens; node attributes via ``node_rows``."""
    home = of_top(places, seeds).select("uid", "gp_code").distinct()
    lives = home.select(F.col("uid").alias("source"), F.col("gp_code").alias("target"), F.lit("RESIDES_IN").alias("label"), F.lit("").alias("description"))
    d = partners(dup, seeds, ["cluster_id"]).select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit("POTENTIAL_DUPLICATE").alias("label"), F.lit("Rule: B1 (Conf: 92%)").alias("description"))
    b = partners(dob, seeds, ["gp_code", "dob"]).select(
        F.col("src").alias("source"), F.col("dst").alias("target"), F.lit("SAME_DOB_AT_GP").alias("label"),
        F.concat(F.lit("Cluster size: "), F.col("cluster_size").cast("string")).alias("description"))
    f = of_top(citizen_flags(flags), seeds).select(
        F.col("uid").alias("source"), F.concat_ws("_", F.lit("FLAG"), "rule", "type").alias("target"), F.lit("FLAGGED_AS").alias("label"),
        F.concat(F.lit("Conf: "), F.col("confidence").cast("string"), F.lit("%")).alias("description"))
    r = c1.join(home.select("gp_code").distinct(), "gp_code").select(
        F.col("gp_code").alias("source"), F.col("scheme_id").alias("target"), F.lit("HIGH_RISK_CLUSTER").alias("label"), F.lit("").alias("description"))
    return union(lives, d, b, f, r).distinct()


def node_rows(links: DataFrame, citizens, places, flags, scheme_names) -> DataFrame:
    """Nodes named by the ends of the links, with label and type: citizens, GPs, schemes and flags."""
    ends = links.select(F.col("source").alias("id")).unionByName(links.select(F.col("target").alias("id"))).distinct()
    person = ends.join(citizens, ends["id"] == citizens["uid"]).select("id", F.col("name").alias("label"), F.lit("Citizen").alias("type"), "risk_tier")
    none = F.lit(None).cast("string")
    gps = places.groupBy(F.col("gp_code").alias("id")).agg(F.min("gp_name").alias("label"))
    gp = ends.join(gps, "id").select("id", "label", F.lit("GP").alias("type"), none.alias("risk_tier"))
    sch = ends.join(scheme_names.select(F.col("scheme_id").alias("id"), F.col("scheme_name").alias("label")), "id").select("id", "label", F.lit("Scheme").alias("type"), none.alias("risk_tier"))
    ff = flags.select(F.concat_ws("_", F.lit("FLAG"), "rule", "type").alias("id"), F.concat_ws(": ", "type", "description").alias("label")).distinct()
    flag = ends.join(ff, "id").select("id", "label", F.lit("FraudFlag").alias("type"), none.alias("risk_tier"))
    return union(person, gp, sch, flag)


def priority(citizens: DataFrame, flags: DataFrame) -> DataFrame:
    """Citizens with a 0/1 priority: any mark, a high tier or any flag."""
    flagged = citizen_flags(flags).select("uid").distinct().withColumn("_f", F.lit(True))
    off = F.lit(False)
    hot = (
        F.coalesce("is_ghost_flag", off) | F.coalesce("is_dup_flag", off) | F.coalesce("is_anomaly_flag", off)
        | F.col("risk_tier").isin("HIGH", "CRITICAL") | F.coalesce("_f", off)
    )
    return citizens.join(flagged, "uid", "left").withColumn("priority_score", hot.cast("int")).drop("_f")


def fraud_reason(flag_text: Column) -> Column:
    return F.coalesce(
        flag_text,
        F.when(F.col("is_ghost_flag"), "Ghost/Deceased Account").when(F.col("is_dup_flag"), "Duplicate Identity")
        .when(F.col("is_anomaly_flag"), "Usage Anomaly")
        .when(F.col("risk_tier").isin("HIGH", "CRITICAL"), F.concat(F.lit("Risk Tier: "), "risk_tier")),
    )


def slice_rows(citizens, places, schemes, flags, dup, n: int = 1200, scheme: str | None = None) -> DataFrame:
    """Links of the map slice: the n first citizen rows by priority and score, then their edges.

    With a scheme the slice keeps citizens of that scheme and no places.
    """
    if scheme:
        pool = citizens.join(schemes.where(F.col("scheme_id") == scheme.strip().upper()).select("uid"), "uid", "left_semi")
        top = priority(pool, flags).orderBy(F.desc("priority_score"), F.desc("vulnerability_score"), "uid").limit(n)
        geo = None
    else:
        rows = priority(citizens, flags).join(places, "uid", "left")
        geo = rows.orderBy(F.desc("priority_score"), F.desc("vulnerability_score"), "uid", "gp_code").limit(n)
        top = geo.select("uid")
    links = []
    if geo is not None:
        for a, b, label in (("block_code", "district_code", "PART_OF"), ("gp_code", "block_code", "PART_OF"), ("uid", "gp_code", "RESIDES_IN")):
            # codes of different levels may be equal numbers, so the level is part of the node id
            src = F.col(a) if a == "uid" else F.concat_ws(":", F.lit(a), a)
            links.append(geo.select(src.alias("source"), F.concat_ws(":", F.lit(b), b).alias("target"), F.lit(label).alias("label"), F.lit("").alias("description")))
    enrolled = of_top(schemes, top, n)
    if scheme:
        enrolled = enrolled.where(F.col("scheme_id") == scheme.strip().upper())
    links.append(enrolled.select(F.col("uid").alias("source"), F.col("scheme_id").alias("target"), F.lit("ENROLLED_IN").alias("label"), F.lit("Status: Active").alias("description")))
    links.append(of_top(citizen_flags(flags), top, n).select(
        F.col("uid").alias("source"), F.concat_ws("_", F.lit("FLAG"), "rule", "type").alias("target"), F.lit("FLAGGED_AS").alias("label"),
        F.concat(F.lit("Conf: "), F.col("confidence").cast("string"), F.lit("%")).alias("description")))
    pairs = partners(dup, top, ["cluster_id"], n).where("src < dst")
    links.append(pairs.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit("POTENTIAL_DUPLICATE").alias("label"), F.lit("Rule: B1 (92%)").alias("description")))
    return union(*links).distinct()


def slice_nodes(citizens, places, flags, n: int = 1200) -> DataFrame:
    """Citizen nodes of the map slice with their reason text."""
    rows = priority(citizens, flags).join(places.select("uid", "gp_code"), "uid", "left")
    top = rows.orderBy(F.desc("priority_score"), F.desc("vulnerability_score"), "uid", "gp_code").limit(n).drop("gp_code").dropDuplicates(["uid"])
    why = of_top(citizen_flags(flags), top, n).groupBy("uid").agg(F.min(F.concat_ws(": ", "type", "description")).alias("flag_text"))
    out = top.join(why, "uid", "left").withColumn("fraud_reason", fraud_reason(F.col("flag_text")))
    return out.select("uid", "name", "risk_tier", "priority_score", F.when(F.col("fraud_reason").isNotNull(), "FraudFlag").otherwise("Citizen").alias("type"), "fraud_reason")


def scheme_catalog(schemes: DataFrame, profile: DataFrame, scheme_names: DataFrame) -> DataFrame:
    people = schemes.groupBy("scheme_id").agg(F.countDistinct("uid").alias("citizen_count"))
    enr = profile.groupBy("scheme_id").agg(F.countDistinct("enrollment_key").alias("enrollment_count"))
    zero = F.lit(0).cast("bigint")
    return scheme_names.join(people, "scheme_id", "left").join(enr, "scheme_id", "left").select(
        F.col("scheme_id").alias("id"), F.col("scheme_name").alias("name"), F.coalesce("citizen_count", zero).alias("citizen_count"),
        F.coalesce("enrollment_count", zero).alias("enrollment_count"),
    ).where("id <> ''").orderBy(F.desc("citizen_count"), F.desc("enrollment_count"), "id")


def scheme_citizens(citizens, places, schemes, scheme: str, n: int = 50) -> DataFrame:
    top = schemes.where(F.col("scheme_id") == scheme.strip()).select("uid", "scheme_name").distinct().orderBy("uid").limit(n)
    return top.join(of_top(citizens, top, n).select("uid", "name", "dob", "gender"), "uid").join(first_place(of_top(places, top, n)), "uid", "left")


def scheme_age(citizens, schemes, scheme: str, age: int, n: int = 100) -> DataFrame:
    rows = citizens.where(F.col("age") > age).join(schemes.where(F.col("scheme_id") == scheme).select("uid"), "uid", "left_semi")
    return rows.select("uid", "name", "dob", "gender", "age").orderBy(F.desc("age"), "uid").limit(n)


def _flag_text(rows: DataFrame) -> DataFrame:
    """Flags of a citizen as text; bounded by the number of rules."""
    one = F.concat_ws(":", "rule", "type", F.col("confidence").cast("string"))
    return rows.groupBy("uid").agg(F.array_join(F.sort_array(F.collect_set(one)), ",").alias("flags"))


def snapshot(citizens, places, schemes, flags, picked: DataFrame) -> DataFrame:
    """Fraud-relevant context of picked citizens (a limited table with ``uid``)."""
    who = of_top(citizens, picked).select("uid", "name", "dob", "gender", "vulnerability_score", "risk_tier")
    return (
        who.join(first_place(of_top(places, picked)), "uid", "left")
        .join(_flag_text(of_top(citizen_flags(flags), picked)), "uid", "left")
        .join(scheme_list(of_top(schemes, picked), "scheme_id"), "uid", "left")
        .withColumn("flags", F.coalesce("flags", F.lit("")))
    )


def pick_by_name(citizens: DataFrame, names: DataFrame, col: str, limit: int) -> DataFrame:
    """First ``limit`` citizens by uid per wanted name whose own name contains it."""
    hits = contains_join(citizens, "name", names, col)
    people = citizens.select("uid", "name").join(hits, "name")
    return top_per_group(people, [col], [F.col("uid")], limit, ["uid"]).select(col, "uid", "name")


def snapshot_by_name(citizens, places, schemes, flags, names: DataFrame, limit: int = 5) -> DataFrame:
    picked = pick_by_name(citizens, names, "query", limit)
    found = (
        citizens.select("uid", "dob", "gender", "vulnerability_score", "risk_tier").join(picked, "uid")
    )
    wanted = picked.select("uid").distinct()
    return (
        found.join(first_place(places.join(wanted, "uid", "left_semi")), "uid", "left")
        .join(_flag_text(citizen_flags(flags).join(wanted, "uid", "left_semi")), "uid", "left")
        .join(scheme_list(schemes.join(wanted, "uid", "left_semi"), "scheme_id"), "uid", "left")
        .withColumn("flags", F.coalesce("flags", F.lit("")))
    )


def name_suggestions(citizens, places, names: DataFrame, limit: int = 8) -> DataFrame:
    """Citizens whose name holds any token of two or more letters of the wanted name."""
    tokens = names.select("query", F.explode(F.filter(F.split(F.trim("query"), r"\s+"), lambda t: F.length(t) >= 2)).alias("token")).distinct()
    hits = contains_join(citizens, "name", tokens, "token").join(tokens, "token").select("query", "name").distinct()
    people = citizens.select("uid", "name").join(hits, "name")
    top = top_per_group(people, ["query"], [F.col("uid")], limit, ["uid"]).select("query", "uid", "name")
    return top.join(first_place(places.join(top.select("uid").distinct(), "uid", "left_semi")), "uid", "left")


def snapshot_by_uid(citizens, places, schemes, flags, dup, uids: DataFrame) -> DataFrame:
    """Snapshot rows with the number of duplicates, one per duplicate drawn (the first ``DRAWN`` by uid; one row with nulls when there is none)."""
    base = snapshot(citizens, places, schemes, flags, uids)
    own = hub_members(of_top(dup, uids), "B1")
    # a citizen may be among the first members itself, so one more is read
    first = top_per_group(hub_members(dup, "B1", own), ["hub"], [F.col("uid")], DRAWN + 1, ["uid"]).select("hub", F.col("uid").alias("duplicate_uid"))
    pairs = own.join(first, "hub").where("uid <> duplicate_uid").select("uid", "duplicate_uid", (F.col("cluster_size") - 1).cast("bigint").alias("duplicate_count"))
    links = top_per_group(pairs, ["uid"], [F.col("duplicate_uid")], DRAWN, ["duplicate_uid"]).drop("rn")
    names = citizens.select(F.col("uid").alias("duplicate_uid"), F.col("name").alias("duplicate_name"))
    return base.join(links.join(names, "duplicate_uid"), "uid", "left").withColumn("duplicate_count", F.coalesce("duplicate_count", F.lit(0).cast("bigint")))


def citizen_360(profile: DataFrame, txn: DataFrame, uids: DataFrame, beneficiary_ids: DataFrame) -> DataFrame:
    """Profile rows by uid or beneficiary id, one row per payment, newest first.

    A payment history can be long, so it stays rows and is not gathered into one array.
    """
    keys = ["uid", "scheme_id", "scheme_beneficiary_id"]
    cols = [*keys, "fullname", "gender", "member_dob", "lgd_district_name", "row_no"]
    hits = profile.join(uids, "uid", "left_semi").select(*cols).unionByName(profile.join(beneficiary_ids, "scheme_beneficiary_id", "left_semi").select(*cols)).distinct()
    pay = txn.select(
        "scheme_beneficiary_id", F.col("financial_year"), "installment_month_code", "amount", "transaction_timestamp", "transaction_ref_no"
    )
    return hits.join(pay, "scheme_beneficiary_id", "left").orderBy("uid", "scheme_beneficiary_id", F.desc("transaction_timestamp"))


def search_citizens(profile: DataFrame, q: str, n: int = 10) -> DataFrame:
    hits = profile.where(F.col("fullname").ilike(f"%{q}%"))
    return hits.select("fullname", "lgd_district_name", "lgd_block_name", "scheme_beneficiary_id").orderBy("fullname", "scheme_beneficiary_id", "lgd_block_name").limit(n)


# --- assessment --------------------------------------------------------------------------------


def assessment_context(citizens, places, schemes, flags, dup, dob, member_of, mobiles, operators, c1) -> DataFrame:
    """Signals of every citizen. Each edge type is aggregated before it is joined."""
    def hub_share(edges: DataFrame, hub: str, name: str) -> DataFrame:
        size = edges.groupBy(hub).agg((F.countDistinct("uid")).alias("n"))
        return edges.join(size, hub).groupBy("uid").agg(F.max("n").alias(name))

    def links(t: DataFrame, name: str) -> DataFrame:
        return t.groupBy("uid").agg(F.sum(F.col("cluster_size") - 1).alias(name))

    risk = places.select("uid", "gp_code").distinct().join(c1.select("gp_code", "scheme_id"), "gp_code").groupBy("uid").agg(F.countDistinct("gp_code", "scheme_id").alias("gp_anomalies"))
    out = citizens.select("uid", "name", "dob", "age", "vulnerability_score", "risk_tier")
    for part in (
        first_place(places),
        schemes.groupBy("uid").agg(F.countDistinct("scheme_id").alias("scheme_count")),
        links(dup, "duplicate_edges"),
        links(dob, "dob_cluster_edges"),
        hub_share(mobiles, "mobile", "mobile_share_count"),
        hub_share(member_of, "ration_card_number", "household_size"),
        hub_share(operators, "operator_id", "operator_volume"),
        citizen_flags(flags).groupBy("uid").agg(F.countDistinct("rule").alias("flag_count")),
        risk,
    ):
        out = out.join(part, "uid", "left")
    zero = F.lit(0).cast("bigint")
    for c in ("scheme_count", "duplicate_edges", "dob_cluster_edges", "mobile_share_count", "household_size", "operator_volume", "flag_count", "gp_anomalies"):
        out = out.withColumn(c, F.coalesce(F.col(c), zero))
    return out


def recommend(ctx: DataFrame) -> DataFrame:
    action = (
        F.when(F.col("duplicate_edges") > 0, "SUSPEND")
        .when(F.col("dob_cluster_edges") > 0, "INVESTIGATE")
        .when((F.col("age") > 110) | (F.col("age") < 0), "SUSPEND")
        .when(F.col("dob").isNull(), "MONITOR")
        .otherwise("CLEAR")
    )
    return ctx.withColumn("recommendation", action)


def confidence_band(c: Column) -> Column:
    return F.when(c < 30, "CLEAR").when(c < 60, "MONITOR").when(c < 80, "INVESTIGATE").otherwise("SUSPEND")


# --- reviews -----------------------------------------------------------------------------------


def checked_reviews(reviews: DataFrame) -> DataFrame:
    """Every review with ``problem`` null when valid, else the reason it is rejected."""
    action = F.upper(F.trim("action"))
    no_note = F.trim(F.coalesce("note", F.lit(""))) == ""
    problem = (
        F.when(~F.coalesce(action.isin(REVIEW_ACTIONS), F.lit(False)), "INVALID_ACTION")
        .when(action.isin(NOTE_REQUIRED) & no_note, "NOTE_REQUIRED")
    )
    return reviews.withColumn("action", action).withColumn("problem", problem)


def review_history(reviews: DataFrame, limit: int = 50) -> DataFrame:
    """The newest valid reviews of every decision; ``limit`` is held to 1 to 200."""
    valid = checked_reviews(reviews).where("problem IS NULL").drop("problem")
    order = [F.desc("reviewed_at"), F.desc("review_id")]
    return top_per_group(valid, ["decision_id"], order, max(1, min(limit, 200)), ["review_id"], "newest_rank")


def detection_metrics(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """Precision, recall, false-positive rate and mean hours to triage and closure."""
    rows = labels.join(flags.select("entity_id").distinct().withColumn("flagged", F.lit(True)), "entity_id", "left")
    hit = F.coalesce("flagged", F.lit(False))
    real = F.col("confirmed")
    out = rows.agg(
        F.count_if(hit & real).alias("true_positives"), F.count_if(hit & ~real).alias("false_positives"),
        F.count_if(~hit & real).alias("false_negatives"), F.count_if(~hit & ~real).alias("true_negatives"),
        F.avg(F.when(hit, F.col("triage_hours"))).alias("avg_triage_hours"), F.avg(F.when(hit, F.col("closure_hours"))).alias("avg_closure_hours"),
    )
    def ratio(a: str, b: str) -> Column:
        total = F.col(a) + F.col(b)
        return F.when(total > 0, F.col(a) / total)

    return out.withColumn("precision", ratio("true_positives", "false_positives")).withColumn("recall", ratio("true_positives", "false_negatives")).withColumn(
        "false_positive_rate", ratio("false_positives", "true_negatives")
    )
