"""The whole case feed, and any page of it by rank (DSH-7, 9, 10, 33, 34, SNK-3).

The feed is all flags and all pair edges in one order. Clusters stay clusters: a pair row (uid1, uid2)
lies in the **entry** of its rule and first citizen, which carries the number of its rows and where its
partners are (``spans``: ranges of positions in clusters). So the table of entries is linear in flags
and cluster members, however many pairs there are. Counts, filters, reviews, categories and the
export work on entries; ``rows`` is the weight of an entry.

A page is a range of ranks. ``Ranked`` adds up the weights along the order, so a page reads only the
partitions that hold its ranks, and opens only the pairs whose rank falls in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ranking import Ranked
from .flags import union

COLUMNS = ["rule", "label", "type", "description", "name", "uid", "dob", "gp_name", "district", "confidence", "detected_at", "scheme"]
#: Pair rules: confidence and text before the partner.
PAIR_RULES = {"B1": (92, "Potential duplicate with "), "B3": (80, "Same DOB at GP as ")}
SPAN = "array<struct<kind:string,cluster:string,first:bigint,n:bigint>>"
#: Pages of up to so many rows go to every task that holds cluster members or citizens.
BROADCAST_ROWS = 10_000


def members(dup: DataFrame, dob: DataFrame) -> DataFrame:
    """(kind, rule, cluster, uid, pos, size): cluster members by uid."""
    def of(table: DataFrame, rule: str, keys: list[str]) -> DataFrame:
        return table.select(F.lit(rule).alias("rule"), F.to_json(F.struct(*keys)).alias("cluster"), "uid")

    rows = of(dup, "B1", ["cluster_id"]).unionByName(of(dob, "B3", ["gp_code", "dob"])).where("uid IS NOT NULL")
    ranked = Ranked(rows, ["rule", "cluster"], [F.asc("uid")], "cluster_members").numbered()
    return ranked.select(F.lit("all").alias("kind"), "rule", "cluster", "uid", "pos", F.col("total").alias("size"))


def span(kind: str, first: Column, n: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.col("cluster").alias("cluster"), first.cast("bigint").alias("first"), n.cast("bigint").alias("n"))


def entries(citizens: DataFrame, places: DataFrame, schemes: DataFrame, flags: DataFrame, member_rows: DataFrame) -> DataFrame:
    """Feed entries: ``COLUMNS``, entity, rows and spans. A flag is one row; a pair entry has the text before its partners."""
    none, nothing = F.lit(None).cast("string"), F.array().cast(SPAN)
    single = flags.select(
        "entity", F.col("entity_id").alias("uid"), "rule", "label", "type", "description", F.col("confidence").cast("int").alias("confidence"), "detected_at",
        F.lit(1).cast("bigint").alias("rows"), nothing.alias("spans"))
    after = F.col("size") - 1 - F.col("pos")
    # a citizen is in as many clusters of a rule as it has GPs
    pairs = member_rows.where(after > 0).groupBy("rule", "uid").agg(F.sum(after).alias("rows"), F.sort_array(F.collect_list(span("all", F.col("pos") + 1, after))).alias("spans"))
    of_rule = lambda i: F.create_map(*[F.lit(x) for r, v in PAIR_RULES.items() for x in (r, v[i])])[F.col("rule")]
    pairs = pairs.select(
        F.lit("citizen").alias("entity"), "uid", "rule", F.col("rule").alias("label"), F.lit("DUPLICATE").alias("type"), of_rule(1).alias("description"), of_rule(0).alias("confidence"),
        none.alias("detected_at"), "rows", "spans")
    district = places.groupBy("uid").agg(F.min("district_name").alias("_district"))
    scheme = schemes.groupBy("uid").agg(F.min("scheme_id").alias("_scheme"))
    is_person = F.col("entity") == "citizen"
    prefix = F.when(F.col("entity") == "card", "Ration Card ").otherwise("Operator ")
    people = citizens.select("uid", F.col("name").alias("_name"), F.col("dob").alias("_dob")).join(district, "uid", "left").join(scheme, "uid", "left").withColumn("entity", F.lit("citizen"))
    rows = union(single, pairs).join(people, ["uid", "entity"], "left")
    return rows.select(
        "rule", "label", "type", "description", F.when(is_person, F.col("_name")).otherwise(F.concat(prefix, "uid")).alias("name"), "uid",
        F.when(is_person, F.coalesce("_dob", F.lit("Unknown"))).otherwise("Unknown").alias("dob"), F.when(is_person, "Unknown").otherwise("N/A").alias("gp_name"),
        F.when(is_person, F.coalesce("_district", F.lit("Unknown"))).otherwise("N/A").alias("district"), "confidence", "detected_at",
        F.when(is_person, F.coalesce("_scheme", F.lit("N/A"))).otherwise("N/A").alias("scheme"), "entity", "rows", "spans")


def order(nulls_first: bool = True) -> list[Column]:
    """Highest confidence, then the latest; rows without a time before or behind all others."""
    return [F.desc("confidence"), F.desc_nulls_first("detected_at") if nulls_first else F.desc_nulls_last("detected_at"), F.asc("uid"), F.asc("rule"), F.asc("label"), F.asc("description")]


def ranked(entry_rows: DataFrame, nulls_first: bool = True) -> Ranked:
    """Entries in feed order; ``before`` is the rank of an entry's first row."""
    return Ranked(entry_rows, [], order(nulls_first), "feed", weight="rows")


def _bounded(df: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(df) if limit <= BROADCAST_ROWS else df


def page(index: Ranked, member_rows: DataFrame, citizens: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Feed rows ``offset`` to ``offset + limit`` with ``rank`` and ``other_uid``; pairs are opened."""
    lo, hi = max(0, offset), max(0, offset) + max(1, limit)
    touched = index.between(lo, hi).withColumnRenamed("before", "_start").drop("pos", "total")
    skip, last = F.greatest(F.lit(0), F.lit(lo) - F.col("_start")), F.least(F.col("rows"), F.lit(hi) - F.col("_start"))
    touched = touched.withColumn("_skip", skip.cast("bigint")).withColumn("_last", last.cast("bigint"))
    single = touched.where(F.size("spans") == 0).select("*", F.col("_start").alias("rank"), F.lit(None).cast("string").alias("other_uid"))
    # of one span only the asked positions are opened; several spans are merged by uid
    opened = touched.where(F.size("spans") > 0).withColumn("_only", F.size("spans") == 1).select("*", F.explode("spans").alias("_s"))
    first, stop = F.when(F.col("_only"), F.col("_skip")).otherwise(0), F.least(F.col("_last"), F.col("_s.n"))
    asked = opened.where(stop > first).select("*", F.explode(F.sequence(first, stop - 1)).alias("_i"))
    asked = asked.select("*", F.col("_s.kind").alias("_kind"), F.col("_s.cluster").alias("_cluster"), (F.col("_s.first") + F.col("_i")).alias("_at"))
    partner = member_rows.select(F.col("kind").alias("_kind"), F.col("rule").alias("_rule"), F.col("cluster").alias("_cluster"), F.col("pos").alias("_at"), F.col("uid").alias("other_uid"))
    pairs = partner.join(_bounded(asked.withColumn("_rule", F.col("rule")), limit), ["_kind", "_rule", "_cluster", "_at"])
    merged = F.row_number().over(Window.partitionBy("uid", "rule").orderBy("other_uid")) - 1
    pairs = pairs.withColumn("rank", F.col("_start") + F.when(F.col("_only"), F.col("_i")).otherwise(merged)).where(f"rank >= {lo} AND rank < {hi}")
    rows = union(single.select(*touched.columns, "rank", "other_uid"), pairs.select(*touched.columns, "rank", "other_uid"))
    ids = rows.where("other_uid IS NOT NULL").select("other_uid").distinct()
    names = citizens.select(F.col("uid").alias("other_uid"), F.col("name").alias("_other")).join(_bounded(ids, limit), "other_uid", "left_semi")
    rows = rows.join(_bounded(names, limit), "other_uid", "left")
    text = F.when(F.col("other_uid").isNull(), F.col("description")).otherwise(F.concat("description", partner_text(F.col("_other"), F.col("other_uid"))))
    return rows.withColumn("description", text).select(*COLUMNS, "other_uid", "rank")


def partner_text(name: Column, uid: Column) -> Column:
    return F.concat(F.coalesce(name, F.lit("Unknown")), F.lit(" (UID: "), uid, F.lit(")"))


def with_text(entry_rows: DataFrame, member_rows: DataFrame, citizens: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(entries, members) of the feed rows that hold ``text`` in name, uid, rule or description.

    An entry that holds it itself keeps all its rows. Of another one the partners that hold it stay:
    they are numbered among their like in the cluster, and the entry's spans name those positions.
    A text that begins before the description of a pair and ends behind its first letters is not found.
    """
    wanted = text.strip().lower()
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("name", "uid", "rule", "description")]))
    own = entry_rows.where(hay.contains(wanted))
    rest = entry_rows.where(~hay.contains(wanted) & (F.size("spans") > 0))
    before = F.create_map(*[F.lit(x) for r, v in PAIR_RULES.items() for x in (r, v[1])])[F.col("rule")]
    said = F.lower(F.concat(before, partner_text(F.col("name"), F.col("uid"))))
    marked = member_rows.where("kind = 'all'").join(citizens.select("uid", "name"), "uid", "left").withColumn("hit", said.contains(wanted).cast("int"))
    marked = Ranked(marked.select("rule", "cluster", "uid", "hit"), ["rule", "cluster"], [F.asc("uid")], "marked_members", weight="hit").numbered()
    hits = marked.where("hit = 1").select(F.lit("hit").alias("kind"), "rule", "cluster", "uid", F.col("before").alias("pos"), F.col("total").alias("size"))
    after = F.col("total") - F.col("before") - F.col("hit")
    spans = marked.where(after > 0).groupBy("rule", "uid").agg(
        F.sum(after).alias("_n"), F.sort_array(F.collect_list(span("hit", F.col("before") + F.col("hit"), after))).alias("_spans"))
    some = rest.join(spans, ["rule", "uid"]).withColumns({"rows": F.col("_n").cast("bigint"), "spans": F.col("_spans")}).select(*entry_rows.columns)
    return own.unionByName(some), member_rows.unionByName(hits)


def filtered(entry_rows: DataFrame, now: Column, scheme=None, district=None, high_only=False, pending_only=False, rule=None, hours=None) -> DataFrame:
    """Filters that hold for all rows of an entry; rows without a time pass the time filter."""
    out = entry_rows
    if scheme:
        out = out.where(F.col("scheme") == scheme)
    if district:
        out = out.where(F.col("district") == district)
    if high_only:
        out = out.where(F.col("confidence") >= 85)
    if pending_only:
        out = out.where(F.col("review_action").isNull())
    if rule:
        out = out.where(F.col("rule") == rule)
    if hours:
        at = F.try_to_timestamp(F.col("detected_at"), F.lit("yyyy-MM-dd HH:mm:ss"))
        out = out.where(F.col("detected_at").isNull() | (at >= now - F.make_dt_interval(F.lit(0), F.lit(hours))))
    return out


def total(entry_rows: DataFrame) -> DataFrame:
    return entry_rows.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total"))
