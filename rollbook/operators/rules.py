"""Fraud rules of both rule sets (R).

Pair rules come in two forms. Reports return the first k pairs in a total order, found without
building all pairs. Edges that link every two members of an equal-key group are kept as cluster
rows (uid, cluster_id, cluster_size): each two members of a cluster are one edge, a member has
``cluster_size - 1`` links, and a cluster holds n(n-1)/2 edges. Nothing is dropped, and the size
stays linear however large a group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import iso_date
from ..functions.ranking import first_pairs, pair_count, top_per_group
from ..functions.text import bigrams, dice
from ..session import staged

# Limits and words of the rules.
REPORT_LIMIT = 500
DICE_LIMIT = 0.82
PENSION_WORDS = "old age|pension"
ADULT_WORDS = "widow|pension|employment|mgnregs"
PLACEHOLDER_DOBS = ["1900-01-01", "0000-00-00", ""]


def _rule(df: DataFrame, rule: str, confidence: int) -> DataFrame:
    return df.withColumn("confidence", F.lit(confidence)).withColumn("rule", F.lit(rule))


def _top(df: DataFrame, n: int | None, *order) -> DataFrame:
    """The first ``n`` rows in ``order``, as a report; all rows without ``n``."""
    return df if n is None else df.orderBy(*order).limit(n)


# --- A: ghosts ---------------------------------------------------------------------------------


def rule_a1(citizens: DataFrame, n: int | None = REPORT_LIMIT) -> DataFrame:
    hits = citizens.where("dob IS NOT NULL AND age > 105").select("uid", "name", "dob", "age")
    return _rule(_top(hits, n, F.desc("age"), "uid"), "A1_IMPOSSIBLE_AGE", 95)


def _age_in_schemes(citizens: DataFrame, schemes: DataFrame, age_below: int, words: str, n: int | None) -> DataFrame:
    young = citizens.where(F.col("dob").isNotNull() & (F.col("age") < age_below)).select("uid", "name", "dob", "age")
    wrong = schemes.where(F.lower("scheme_name").rlike(words)).select("uid", F.col("scheme_name").alias("scheme")).distinct()
    return _top(young.join(wrong, "uid"), n, "uid", "scheme")


def rule_a2(citizens: DataFrame, schemes: DataFrame, n: int | None = REPORT_LIMIT) -> DataFrame:
    return _rule(_age_in_schemes(citizens, schemes, 58, PENSION_WORDS, n), "A2_WRONG_AGE_FOR_SCHEME", 85)


def rule_a3(citizens: DataFrame, schemes: DataFrame, n: int | None = REPORT_LIMIT) -> DataFrame:
    return _rule(_age_in_schemes(citizens, schemes, 18, ADULT_WORDS, n), "A3_CHILD_IN_ADULT_SCHEME", 90)


def sync_a1(citizens: DataFrame) -> DataFrame:
    return _rule(citizens.where("age > 110").select("uid", "age"), "A1", 85)


def sync_a2(citizens: DataFrame) -> DataFrame:
    return _rule(citizens.where("age < 0").select("uid", "age"), "A2", 90)


# --- B: duplicates -----------------------------------------------------------------------------


def clusters(rows: DataFrame, keys: list[str], min_size: int) -> DataFrame:
    """Members of groups of at least ``min_size`` rows, with the smallest uid as cluster id.

    Keys compare null-safe. Sizes come from a partial aggregate; the join back to the members is
    an equi join that adaptive execution can split when one group is hot.
    """
    groups = (
        rows.groupBy(*keys).agg(F.min("uid").alias("cluster_id"), F.count("*").alias("cluster_size"))
        .where(F.col("cluster_size") >= min_size)
        .select(*[F.col(k).alias(f"_{k}") for k in keys], "cluster_id", "cluster_size")
    )
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(groups, same).select("uid", *keys, "cluster_id", "cluster_size")


def duplicate_clusters(citizens: DataFrame) -> DataFrame:
    """POTENTIAL_DUPLICATE edges: same name, date of birth (an unset one is a value) and gender."""
    rows = citizens.where("name IS NOT NULL AND name <> '' AND gender IS NOT NULL").select("uid", "name", "dob", "gender")
    return clusters(rows, ["name", "dob", "gender"], 2)


def dob_clusters(citizens: DataFrame, resides: DataFrame) -> DataFrame:
    """SAME_DOB_AT_GP edges: five or more citizens with one date of birth at one GP."""
    rows = resides.select("uid", "gp_code").distinct().join(citizens.where("dob IS NOT NULL").select("uid", "dob"), "uid")
    return clusters(rows, ["gp_code", "dob"], 5)


def cluster_totals(found: DataFrame, keys: list[str]) -> DataFrame:
    """Clusters, members and pairs of a cluster table."""
    per = found.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(
        F.count("*").alias("cluster_count"), F.sum("n").alias("member_count"), F.sum(pair_count(F.col("n"))).alias("pair_count")
    )


def first_gp(resides: DataFrame) -> DataFrame:
    return resides.groupBy("uid").agg(F.min("gp_name").alias("gp_name"))


def rule_b1(citizens: DataFrame, resides: DataFrame, k: int = REPORT_LIMIT) -> DataFrame:
    rows = citizens.where("name IS NOT NULL AND dob IS NOT NULL AND gender IS NOT NULL")
    pairs = first_pairs(rows, ["name", "dob", "gender"], "uid", k, [])
    # at most k pairs by the limit in first_pairs
    gps = resides.join(F.broadcast(pairs.select(F.col("uid1").alias("uid")).distinct()), "uid")
    out = pairs.join(first_gp(gps).select(F.col("uid").alias("uid1"), F.col("gp_name").alias("shared_gp")), "uid1", "left")
    out = out.select(
        F.col("name").alias("name1"), F.col("name").alias("name2"), "uid1", "uid2", "dob", "gender", "shared_gp",
        F.lit(1.0).alias("name_similarity"),
    )
    return _rule(out, "B1_EXACT_DUPLICATE", 92)


def first_ends(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(uid, cases) of rows that come first in a pair of their group; ``cases`` of the group's pairs go to its first row."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("uid").alias("_lo"), F.max("uid").alias("_hi")).where("n > 1")
    met = rows.select(*keys, "uid").join(groups, keys).where(F.col("uid") < F.col("_hi"))
    return met.select("uid", F.when(F.col("uid") == F.col("_lo"), pair_count(F.col("n"))).otherwise(F.lit(0).cast("bigint")).alias("cases"))


def hits_b1(citizens: DataFrame) -> DataFrame:
    """(uid, cases, confidence) of all exact duplicates that come first in a pair."""
    rows = citizens.where("name IS NOT NULL AND dob IS NOT NULL AND gender IS NOT NULL")
    return first_ends(rows, ["name", "dob", "gender"]).withColumn("confidence", F.lit(92))


#: Names of a block that share a prefix bigram and are compared in one piece.
SUB_BLOCK = 500


def similar_names(names: DataFrame, block: list[str], limit: float = DICE_LIMIT) -> DataFrame:
    """Pairs of different names of a block whose Dice similarity exceeds ``limit``.

    ``names`` has one row per (block, name) with its ``grams``. A set of n bigrams needs more than
    ``n * limit / (2 - limit)`` of them in common with any partner, so two similar names share a
    bigram within the first ``n - needed + 1`` in one fixed order. Bigrams are ordered by how many
    names hold them, rarest first, and names meet only on those prefix bigrams of their block. A
    bigram that more than ``SUB_BLOCK`` names of a block share is cut into parts of that size, which
    meet in pairs, so a block of any number of names spreads over many tasks of like size.
    """
    keyed = names.withColumn("n", F.size("grams"))
    held = keyed.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("names_with"))
    tokens = keyed.select(*block, "name", "n", F.explode("grams").alias("gram")).join(held, "gram")
    needed = F.floor(F.col("n") * F.lit(limit / (2 - limit))) + 1
    prefix = (
        tokens.groupBy(*block, "name", "n")
        .agg(F.sort_array(F.collect_list(F.struct("names_with", "gram"))).alias("ordered"))
        .withColumn("gram", F.explode(F.slice("ordered", F.lit(1), (F.col("n") - needed + 1).cast("int"))))
        .select(*block, "name", "n", F.col("gram.gram").alias("gram"))
    )
    # written once, as both sides, the sizes and the parts read them
    members = staged(prefix.join(names.select(*block, "name", "grams"), [*block, "name"]), "name_grams")
    key = [*block, "gram"]
    sizes = members.groupBy(*key, "n").agg(F.count("*").alias("c"))
    hot = staged(sizes.groupBy(*key).agg(F.sum("c").alias("all")).where(F.col("all") > SUB_BLOCK).select(*key), "crowded_grams")
    # A pair below the length bound cannot reach the limit, whatever it shares.
    bound = 2 * F.least("n1", "n2") > F.lit(limit) * (F.col("n1") + F.col("n2"))

    def side(rows: DataFrame, i: int, *more: str) -> DataFrame:
        return rows.select(*key, *more, *[F.col(c).alias(f"{c}{i}") for c in ("name", "n", "grams")])

    def alike(met: DataFrame) -> DataFrame:
        # compared where they meet; only similar pairs, which several bigrams can give, are shuffled
        found = met.withColumn("similarity", dice(F.col("grams1"), F.col("grams2"))).where(F.col("similarity") > limit)
        return found.select(*block, "name1", "name2", "similarity")

    any_hot = bool(hot.head(1))
    calm = members.join(hot, key, "left_anti") if any_hot else members
    few = alike(side(calm, 1).join(side(calm, 2), key).where((F.col("name1") < F.col("name2")) & bound))
    if not any_hot:
        return few.distinct()
    # a crowded (block, bigram) is cut by length and, within one, by hash; its parts meet in pairs, each once
    crowded = members.join(hot, key, "left_semi")
    parts = sizes.join(hot, key, "left_semi").withColumn("k", F.ceil(F.col("c") / SUB_BLOCK).cast("int"))
    met = parts.select(*key, F.col("n").alias("n1"), F.col("k").alias("k1")).join(parts.select(*key, F.col("n").alias("n2"), F.col("k").alias("k2")), key).where((F.col("n1") <= F.col("n2")) & bound)
    met = met.withColumn("p1", F.explode(F.sequence(F.lit(0), F.col("k1") - 1))).withColumn("p2", F.explode(F.sequence(F.lit(0), F.col("k2") - 1)))
    met = met.where((F.col("n1") < F.col("n2")) | (F.col("p1") <= F.col("p2"))).select(*key, "n1", "p1", "n2", "p2")
    placed = crowded.join(parts.select(*key, "n", "k"), [*key, "n"]).withColumn("p", F.pmod(F.xxhash64("name"), F.col("k")).cast("int"))
    cell = [*key, "n1", "p1", "n2", "p2"]
    one = side(placed.withColumn("p1", F.col("p")), 1, "p1").join(met, [*key, "n1", "p1"])
    two = side(placed.withColumn("p2", F.col("p")), 2, "p2").join(met, [*key, "n2", "p2"])
    same_part = (F.col("n1") == F.col("n2")) & (F.col("p1") == F.col("p2"))
    many = one.join(two, cell).where(~same_part | (F.col("name1") < F.col("name2")))
    flip = F.col("name1") > F.col("name2")
    many = many.select(
        *block, F.least("name1", "name2").alias("name1"), F.greatest("name1", "name2").alias("name2"),
        F.when(flip, F.col("grams2")).otherwise(F.col("grams1")).alias("grams1"), F.when(flip, F.col("grams1")).otherwise(F.col("grams2")).alias("grams2"))
    return few.unionByName(alike(many)).distinct()


def _alike(citizens: DataFrame, resides: DataFrame) -> tuple[list[str], DataFrame, DataFrame, DataFrame]:
    """The block keys, people and distinct names of the blocks, and the pairs of names that are alike."""
    block = ["gp_code", "gp_name", "dob", "gender"]
    people = resides.select("uid", "gp_code", "gp_name").distinct().join(
        citizens.where("dob IS NOT NULL AND gender IS NOT NULL AND name IS NOT NULL").select("uid", "name", "dob", "gender"), "uid"
    )
    names = people.groupBy(*block, "name").agg(F.count("*").alias("people"), F.min("uid").alias("first_uid"))
    grammed = names.withColumn("grams", bigrams(F.col("name"))).where(F.size("grams") > 0)
    same = grammed.where("people > 1").select(*block, F.col("name").alias("name1"), F.col("name").alias("name2"), F.lit(1.0).alias("similarity"))
    pairs = similar_names(grammed.select(*block, "name", "grams"), block).unionByName(same)
    return block, people, names, pairs


def _fuzzy_confidence(similarity: Column) -> Column:
    return F.floor(60 + similarity * 40).cast("int")


def hits_b2(citizens: DataFrame, resides: DataFrame) -> DataFrame:
    """(uid, cases, confidence) of all people that come first in a fuzzy pair; no pair of people is built.

    For each name and each of the few values of the confidence, the largest uid among the similar
    names decides who has a later partner. The pairs of two names are counted at one row of theirs.
    """
    block, people, names, pairs = _alike(citizens, resides)
    ends = people.groupBy(*block, "name").agg(F.count("*").alias("n"), F.min("uid").alias("lo"), F.max("uid").alias("hi"))
    one = ends.select(*block, *[F.col(c).alias(f"{c}1") for c in ("name", "n", "lo", "hi")])
    two = ends.select(*block, *[F.col(c).alias(f"{c}2") for c in ("name", "n", "lo", "hi")])
    met = pairs.join(one, [*block, "name1"]).join(two, [*block, "name2"]).withColumn("confidence", _fuzzy_confidence(F.col("similarity")))
    same = F.col("name1") == F.col("name2")
    cases = F.when(same, pair_count(F.col("n1"))).otherwise(F.col("n1") * F.col("n2"))
    counted = met.select(F.least("lo1", "lo2").alias("uid"), cases.alias("cases"), "confidence")
    ways = F.array(F.struct(F.col("name1").alias("name"), F.col("hi2").alias("hi")), F.struct(F.col("name2").alias("name"), F.col("hi1").alias("hi")))
    reach = met.select(*block, "confidence", F.explode(ways).alias("w")).groupBy(*block, F.col("w.name").alias("name"), "confidence").agg(F.max("w.hi").alias("hi"))
    flagged = people.join(reach, [*block, "name"]).where(F.col("uid") < F.col("hi")).select("uid", F.lit(0).cast("bigint").alias("cases"), "confidence")
    return flagged.unionByName(counted)


def rule_b2(citizens: DataFrame, resides: DataFrame, k: int = REPORT_LIMIT) -> DataFrame:
    """Best k fuzzy pairs inside (GP, dob, gender), by similarity, then uids.

    People are grouped by name first, so similarity runs on distinct names of a block and on no
    person pair. The k best name pairs, by similarity and by their first person pair, hold the k
    best person pairs; only those are opened, and from each name only its k + 1 smallest uids.
    """
    block, people, names, pairs = _alike(citizens, resides)
    # The first person pair of two names is their two smallest uids; of one name, its own two.
    second = (
        people.join(names.where("people > 1").select(*block, "name", "first_uid"), [*block, "name"])
        .where("uid > first_uid").groupBy(*block, "name").agg(F.min("uid").alias("second_uid"))
    )
    first = names.join(second, [*block, "name"], "left").select(*block, "name", "first_uid", "second_uid")
    other = F.when(F.col("name1") == F.col("name2"), F.col("a2")).otherwise(F.greatest("a", "b"))
    ranked = (
        pairs.join(first.select(*block, F.col("name").alias("name1"), F.col("first_uid").alias("a"), F.col("second_uid").alias("a2")), [*block, "name1"])
        .join(first.select(*block, F.col("name").alias("name2"), F.col("first_uid").alias("b")), [*block, "name2"])
        .orderBy(F.desc("similarity"), F.least("a", "b"), other, *block, "name1", "name2").limit(k).drop("a", "a2", "b")
    )
    # ranked has k rows by the limit; only members of its names are read
    wanted = ranked.select(*block, F.explode(F.array_distinct(F.array("name1", "name2"))).alias("name")).distinct()
    members = top_per_group(people.join(F.broadcast(wanted), [*block, "name"]), [*block, "name"], [F.col("uid")], k + 1, ["uid"]).drop("rn")
    left = members.select(*block, F.col("name").alias("name1"), F.col("uid").alias("u1"))
    right = members.select(*block, F.col("name").alias("name2"), F.col("uid").alias("u2"))
    opened = ranked.join(left, [*block, "name1"]).join(right, [*block, "name2"]).where(
        (F.col("u1") < F.col("u2")) | ((F.col("name1") != F.col("name2")) & (F.col("u1") != F.col("u2")))
    )
    flip = F.col("u1") > F.col("u2")
    out = opened.select(
        F.when(flip, F.col("name2")).otherwise(F.col("name1")).alias("name1"),
        F.when(flip, F.col("name1")).otherwise(F.col("name2")).alias("name2"),
        F.least("u1", "u2").alias("uid1"), F.greatest("u1", "u2").alias("uid2"),
        "dob", F.col("gp_name").alias("shared_gp"), "similarity",
    ).orderBy(F.desc("similarity"), "uid1", "uid2", "shared_gp").limit(k)
    return out.select(
        "name1", "name2", "uid1", "uid2", "dob", "shared_gp",
        (F.floor(F.col("similarity") * 100 + 0.5) / 100).alias("name_similarity"),
        _fuzzy_confidence(F.col("similarity")).alias("confidence"),
        F.lit("B2_FUZZY_NAME_DUPLICATE").alias("rule"),
    )


def rule_b4(citizens: DataFrame, resides: DataFrame) -> DataFrame:
    """Same name and date of birth in different GPs, as cluster rows over the GPs of the group.

    Every two rows of a cluster with different GPs are one edge; ``cross_links`` counts those of
    the member: the group less the members of its own GP.
    """
    rows = resides.select("uid", "gp_code").distinct().join(
        citizens.where("name IS NOT NULL AND name <> '' AND dob IS NOT NULL").select("uid", "name", "dob"), "uid"
    )
    key = ["name", "dob"]
    at_gp = rows.groupBy(*key, "gp_code").agg(F.count("*").alias("at_gp"), F.min("uid").alias("first_uid"))
    total = at_gp.groupBy(*key).agg(F.sum("at_gp").alias("cluster_size"), F.count("*").alias("gps"), F.min("first_uid").alias("cluster_id")).where("gps > 1")
    out = rows.join(at_gp.drop("first_uid"), [*key, "gp_code"]).join(total, key).select(
        "uid", "name", "dob", "gp_code", "cluster_id", "cluster_size", (F.col("cluster_size") - F.col("at_gp")).alias("cross_links")
    )
    return _rule(out, "B4", 65)


def gp_dob_gender_pairs(citizens: DataFrame, resides: DataFrame, k: int = 15) -> DataFrame:
    people = resides.select("uid", "gp_code", "gp_name").distinct().join(
        citizens.where("dob IS NOT NULL AND gender IS NOT NULL").select("uid", "name", "dob", "gender"), "uid"
    )
    pairs = first_pairs(people, ["gp_code", "gp_name", "dob", "gender"], "uid", k, ["name"])
    out = pairs.select(
        F.col("uid1"), F.col("uid2"), F.col("name1").alias("person_1"), F.col("name2").alias("person_2"),
        F.col("gp_name").alias("shared_gp"), "dob", "gender",
    )
    return _rule(out, "B1_EXACT_DOB_GENDER_GP", 80)


# --- C: schemes --------------------------------------------------------------------------------


def rule_c1(scored: DataFrame, places: DataFrame, n: int | None = 30) -> DataFrame:
    """GPs where more than half of at least six citizens score 60 or more; tested on the rounded share."""
    rows = places.select("uid", "gp_code", "gp_name", "block_name").distinct().join(scored.select("uid", "vulnerability_score"), "uid")
    per = rows.groupBy("gp_code", "gp_name", F.coalesce("block_name", F.lit("Unknown")).alias("block")).agg(
        F.count("*").alias("total_citizens"), F.count_if(F.col("vulnerability_score") >= 60).alias("max_risk_count")
    )
    ratio = F.floor(100.0 * F.col("max_risk_count") / F.col("total_citizens") + 0.5) / 100
    hits = per.where("total_citizens > 5").withColumn("concentration_ratio", ratio).where("concentration_ratio > 0.5")
    return _rule(_top(hits, n, F.desc("concentration_ratio"), "gp_code"), "C1_GP_CONCENTRATION_SPIKE", 75)


def sync_c1(resides: DataFrame, citizen_schemes: DataFrame, totals: DataFrame) -> DataFrame:
    per = (
        resides.select("uid", "gp_code").distinct().join(citizen_schemes.select("uid", "scheme_id").distinct(), "uid")
        .groupBy("gp_code", "scheme_id").agg(F.count("*").alias("gp_beneficiary_count")).where("gp_beneficiary_count >= 50")
    )
    out = per.join(totals.select("scheme_id", F.col("beneficiary_count").alias("total_scheme_count")), "scheme_id")
    out = out.withColumn("concentration_ratio", F.col("gp_beneficiary_count") / F.col("total_scheme_count"))
    return out.where("concentration_ratio > 0.15").withColumn("rule", F.lit("C1"))


def rule_c2(citizens: DataFrame, schemes: DataFrame, n: int | None = 50) -> DataFrame:
    """Contradictory schemes of one citizen, in either order of enrollment."""
    s = schemes.select("uid", "scheme_name").distinct().withColumn("t", F.lower("scheme_name"))
    a = s.where(F.col("t").rlike("widow|bpl")).select("uid", F.col("scheme_name").alias("scheme_a"), F.col("t").alias("ta"))
    b = s.where(F.col("t").rlike("married|vivah|apl")).select("uid", F.col("scheme_name").alias("scheme_b"), F.col("t").alias("tb"))
    clash = (F.col("ta").contains("widow") & F.col("tb").rlike("married|vivah")) | (F.col("ta").contains("bpl") & F.col("tb").contains("apl"))
    hits = a.join(b, "uid").where(clash & (F.col("ta") != F.col("tb"))).join(citizens.select("uid", "name"), "uid")
    hits = _top(hits.select("uid", "name", "scheme_a", "scheme_b"), n, "uid", "scheme_a", "scheme_b")
    return _rule(hits, "C2_SCHEME_CONTRADICTION", 90)


def rule_c3(citizens: DataFrame, enrollments: DataFrame) -> DataFrame:
    born = F.year(iso_date(F.col("dob")))
    approved = F.year(iso_date(F.col("approved_date")))
    hits = enrollments.join(citizens.select("uid", "dob"), "uid").where(approved < born)
    return _rule(hits.select("uid", "enrollment_key", "scheme_id", "approved_date", "dob"), "C3", 80)


# --- D: data quality ---------------------------------------------------------------------------


def data_quality(people: DataFrame, as_of: Column) -> DataFrame:
    """Counts of six defects in one pass."""
    checks = {
        "D1_NULL_DOB": F.col("dob").isNull(),
        "D2_PLACEHOLDER_DOB": F.col("dob").isin(PLACEHOLDER_DOBS),
        "D3_FUTURE_DOB": iso_date(F.col("dob")) > as_of,
        "D4_SHORT_NAME": F.length("name") < 3,
        "D5_NULL_UID": F.col("uid").isNull(),
        "D6_NULL_GENDER": F.col("gender").isNull(),
    }
    one = people.agg(*[F.count_if(c).alias(k) for k, c in checks.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("issue_count")) for k in checks])).alias("r")).select("r.*")


def sync_d1(citizens: DataFrame) -> DataFrame:
    return _rule(citizens.where("dob IS NULL OR dob IN ('', 'None')").select("uid"), "D1", 60)


def rule_d3(enrollments: DataFrame) -> DataFrame:
    """Beneficiary ids held by more than one citizen, one row per (id, citizen)."""
    held = enrollments.where("scheme_beneficiary_id <> ''").select("uid", "scheme_beneficiary_id").distinct()
    shared = held.groupBy("scheme_beneficiary_id").agg(F.count("*").alias("holders")).where("holders > 1")
    return _rule(held.join(shared, "scheme_beneficiary_id"), "D3", 88)


# --- E, F, H, I --------------------------------------------------------------------------------


def overloaded_cards(member_of: DataFrame) -> DataFrame:
    return member_of.groupBy("ration_card_number").agg(F.countDistinct("uid").alias("member_count")).where("member_count > 10")


def rule_e1(member_of: DataFrame, citizens: DataFrame, n: int = 50) -> DataFrame:
    """The n largest cards over ten members, one row per card and member."""
    top = overloaded_cards(member_of).orderBy(F.desc("member_count"), "ration_card_number").limit(n)
    # n cards by the limit above
    rows = member_of.join(F.broadcast(top), "ration_card_number").join(citizens.select("uid", "name"), "uid")
    return _rule(rows.select("ration_card_number", "member_count", "uid", F.col("name").alias("member")), "E1_HOUSEHOLD_OVERLOAD", 95)


def sync_e1(member_of: DataFrame) -> DataFrame:
    return _rule(overloaded_cards(member_of), "E1", 95)


def suspicious_operators(operators: DataFrame, citizens: DataFrame) -> DataFrame:
    bad = F.coalesce("is_ghost_flag", F.lit(False)) | F.coalesce("is_dup_flag", F.lit(False))
    per = operators.join(citizens.select("uid", "is_ghost_flag", "is_dup_flag"), "uid").groupBy("operator_id").agg(
        F.count("*").alias("total_registrations"), F.count_if(bad).alias("fraud_count")
    )
    return per.withColumn("error_rate", F.col("fraud_count") / F.col("total_registrations")).where("total_registrations > 20 AND error_rate > 0.15")


def rule_f1(operators: DataFrame, citizens: DataFrame, n: int | None = 30) -> DataFrame:
    """The ``n`` operators with the highest rates, as a report; all of them without ``n``."""
    top = _top(suspicious_operators(operators, citizens), n, F.desc("error_rate"), "operator_id")
    out = top.withColumn("fraud_rate", F.floor(F.col("error_rate") * 100 + 0.5) / 100).drop("error_rate")
    return _rule(out, "F1_OPERATOR_CORRUPTION", 90)


def paid_ghosts(citizens: DataFrame) -> DataFrame:
    bad = F.coalesce("is_ghost_flag", F.lit(False)) | F.coalesce("is_dup_flag", F.lit(False))
    paid = sum((F.coalesce(F.col(c), F.lit(0)) > 0).cast("int") for c in ("transaction_rows", "tran_count_1", "tran_count_2")) > 0
    return citizens.where(bad & paid)


def rule_h1(citizens: DataFrame, n: int | None = 100) -> DataFrame:
    hits = paid_ghosts(citizens).select("uid", "name", F.coalesce("transaction_rows", "tran_count_1", F.lit(0)).alias("trans"))
    return _rule(_top(hits, n, "uid"), "H1_GHOST_MONETIZATION", 98)


def shared_member_ids(member_of: DataFrame) -> DataFrame:
    rows = member_of.where("member_id IS NOT NULL AND member_id <> ''").select("uid", "ration_card_number", "member_id")
    return clusters(rows, ["ration_card_number", "member_id"], 2)


def rule_i1(member_of: DataFrame, citizens: DataFrame, k: int = 100) -> DataFrame:
    rows = member_of.where("member_id IS NOT NULL AND member_id <> ''")
    pairs = first_pairs(rows, ["ration_card_number", "member_id"], "uid", k, [])
    name = citizens.select("uid", "name")
    out = pairs.join(name.select(F.col("uid").alias("uid1"), F.col("name").alias("name1")), "uid1").join(
        name.select(F.col("uid").alias("uid2"), F.col("name").alias("name2")), "uid2"
    )
    return _rule(out.select("name1", "name2", "uid1", "uid2", F.col("member_id").alias("shared_member_id")), "I1_MEMBER_ID_CONFLICT", 100)


def hits_i1(member_of: DataFrame, citizens: DataFrame) -> DataFrame:
    """(uid, cases, confidence) of all citizens that come first in a pair of one member id on one card."""
    rows = member_of.where("member_id IS NOT NULL AND member_id <> ''").join(citizens.select("uid"), "uid", "left_semi")
    return first_ends(rows, ["ration_card_number", "member_id"]).withColumn("confidence", F.lit(100))
