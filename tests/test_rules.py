import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from rollbook.functions.dates import age_calendar, age_years, derive_age, iso_date, parse_dob
from rollbook.functions.ranking import first_pairs, top_per_group
from rollbook.functions.text import bigrams, contains_join, dice
from rollbook.operators import dashboards as d
from rollbook.operators import flags as fl
from rollbook.operators import rules as r


def tagged(name):
    grams = Counter()
    for w in name.lower().split():
        grams.update([w] if len(w) < 2 else [w[i:i + 2] for i in range(len(w) - 1)])
    return grams


def py_dice(a, b):
    x, y = tagged(a), tagged(b)
    return 2.0 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()))


def test_ages(spark):
    rows = [("1990-06-02",), ("1990-06-01",), ("2024-12-01",), ("2031-01-01",), ("1990-13-45",), ("31/12/1990",), ("None",), ("",), (None,), ("1990",)]
    as_of = F.lit("2024-06-01").cast("date")
    df = spark.createDataFrame(rows, "d string").select("d", age_years(iso_date(F.col("d")), as_of).alias("a"), age_calendar(parse_dob(F.col("d")), as_of).alias("c"), derive_age(F.col("d"), as_of).alias("x"))
    got = {x.d: (x.a, x.c, x.x) for x in df.collect()}
    assert got["1990-06-02"] == (33, 33, 33) and got["1990-06-01"] == (34, 34, 34)
    assert got["2024-12-01"] == (0, -1, 0) and got["2031-01-01"] == (-6, -7, 0)
    assert got["1990-13-45"] == (None, None, 34) and got["31/12/1990"] == (None, 33, None)
    assert got["None"] == got[""] == got[None] == (None, None, None) and got["1990"] == (None, None, 34)


def test_first_pairs_equal_all_pairs(spark):
    rng = random.Random(1)
    rows = [(f"G{0 if rng.random() < 0.4 else rng.randrange(30)}", f"U{i:04d}") for i in range(600)]
    for k in (1, 7, 60, 4000):
        want = sorted((a[1], b[1], a[0]) for a, b in combinations(sorted(rows, key=lambda x: x[1]), 2) if a[0] == b[0])[:k]
        got = first_pairs(spark.createDataFrame(rows, "g string, uid string"), ["g"], "uid", k, [])
        assert sorted((x.uid1, x.uid2, x.g) for x in got.collect()) == want


def test_top_per_group_of_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 17}", i * 7919 % 1000, i) for i in range(900)]
    got = top_per_group(spark.createDataFrame(rows, "g string, v int, id int"), ["g"], [F.desc("v"), F.asc("id")], 5, ["id"])
    have = {}
    for x in got.collect():
        have.setdefault(x.g, []).append((x.rn, x.id))
    for g in {x[0] for x in rows}:
        best = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2]))[:5]
        assert sorted(have[g]) == [(n + 1, x[2]) for n, x in enumerate(best)]


def test_dice(spark):
    names = [("pramila das", "pramila dass"), ("aa aa", "aa"), ("a b", "b a"), ("abc", "xyz")]
    got = spark.createDataFrame(names, "a string, b string").select("a", "b", dice(bigrams(F.col("a")), bigrams(F.col("b"))).alias("s")).collect()
    for x in got:
        assert abs(x.s - py_dice(x.a, x.b)) < 1e-12
    assert round(got[0].s, 3) == 0.941


def test_fuzzy_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    base = ["pramila das", "rahul mondal", "sita ram", "mina khatun", "das pramila", "a b", "ana anana"]
    people = []
    for i in range(160):
        name = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            name[rng.randrange(len(name))] = rng.choice("abdr ")
        people.append((f"U{i:03d}", " ".join("".join(name).split()).upper() or "X", rng.choice(["1990-01-01", "1991-01-01"]), "MALE"))
    places = [(p[0], f"{rng.randrange(2)}", "GP") for p in people]
    gp = {u: g for u, g, _ in places}
    want = []
    for a, b in combinations(people, 2):
        if gp[a[0]] == gp[b[0]] and a[2] == b[2]:
            s = py_dice(a[1], b[1])
            if s > 0.82:
                want.append((-s, a[0], b[0]))
    cit = spark.createDataFrame(people, "uid string, name string, dob string, gender string")
    res = spark.createDataFrame(places, "uid string, gp_code string, gp_name string")
    for k in (5, 40, 10000):
        got = {(x.uid1, x.uid2) for x in r.rule_b2(cit, res, k).collect()}
        assert got == {(a, b) for _, a, b in sorted(want)[:k]}
    best: dict[str, int] = {}
    for neg, a, _ in want:
        best[a] = max(best.get(a, 0), int(60 - neg * 40))
    hits = r.hits_b2(cit, res).collect()
    assert sum(x.cases for x in hits) == len(want)
    found: dict[str, int] = {}
    for x in hits:
        found[x.uid] = max(found.get(x.uid, 0), x.confidence)
    assert found == best


def test_flags_of_more_hits_than_a_report_shows(spark):
    """600 copies of one person, all too old and on one member id: every one is flagged, all but the last by the pair rules."""
    people = [(f"U{i:04d}", "A B", "1900-01-02", "F", 124, True, False, 1) for i in range(600)]
    cit = spark.createDataFrame(people, "uid string, name string, dob string, gender string, age int, is_ghost_flag boolean, is_dup_flag boolean, transaction_rows int")
    cit = cit.withColumn("tran_count_1", F.lit(0)).withColumn("tran_count_2", F.lit(0))
    each = cit.select("uid")
    schemes = each.withColumn("scheme_name", F.lit("Widow"))
    member = each.select("uid", F.lit("R1").alias("ration_card_number"), F.lit("M1").alias("member_id"))
    hits = fl.batch_results(cit, schemes, each.select("uid", F.lit("1").alias("gp_code"), F.lit("GP").alias("gp_name")), member, cit)
    got = {x.rule: x.n for x in fl.persist_flags(hits).groupBy("rule").agg(F.count("*").alias("n")).collect()}
    assert got == {"A1": 600, "H1": 600, "B1": 599, "B2": 599, "I1": 599}
    for rule in ("B1", "B2", "I1"):
        assert hits[rule].agg(F.sum("cases")).first()[0] == 600 * 599 // 2


def test_clusters_stand_for_all_pairs(spark):
    rows = [("U1", "A", None, "F"), ("U2", "A", None, "F"), ("U3", "A", None, "M"), ("U4", "A", "1990-01-01", "F"), ("U5", "B", "1990-01-01", None), ("U6", "B", "1990-01-01", None)]
    got = r.duplicate_clusters(spark.createDataFrame(rows, "uid string, name string, dob string, gender string")).collect()
    assert {(x.uid, x.cluster_id, x.cluster_size) for x in got} == {("U1", "U1", 2), ("U2", "U1", 2)}


def test_contains_join(spark):
    names = spark.createDataFrame([("RED BOLT",), ("OLD ANVIL",), ("A",), (None,)], "name string")
    asked = spark.createDataFrame([("bolt",), ("ol",), ("a",), ("zz",), ("",), ("red bolts",)], "q string")
    got = {(x.name, x.q) for x in contains_join(names, "name", asked, "q").collect()}
    assert got == {("RED BOLT", "bolt"), ("RED BOLT", "ol"), ("OLD ANVIL", "ol"), ("OLD ANVIL", "a"), ("A", "a")}


def test_similar_names_in_a_crowded_block(spark, monkeypatch):
    """A block whose names nearly all share their bigrams gives the pairs of a plain comparison, cut or not."""
    import collections
    import itertools
    import random

    rng = random.Random(4)
    names = sorted({f"ram{rng.choice('aeiou')} {rng.choice(['das', 'dev', 'roy', 'sen'])}{rng.choice('klmnp')}{i % 23:02d}" for i in range(400)})
    rows = [("G", "1900-01-01", n) for n in names] + [("H", "1900-01-01", n) for n in names[:3]] + [(None, None, "x")]
    df = spark.createDataFrame(rows, "gp string, dob string, name string")
    grams = r.bigrams(F.col("name"))
    held = {x.name: list(x.g) for x in df.select("name", grams.alias("g")).distinct().collect()}

    def dice(a, b):
        a, b = collections.Counter(held[a]), collections.Counter(held[b])
        return 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))

    want = {(g, a, b) for g, some in (("G", names), ("H", sorted(names[:3]))) for a, b in itertools.combinations(some, 2) if dice(a, b) > r.DICE_LIMIT}
    keyed = df.withColumn("grams", grams).where(F.size("grams") > 0)
    for part in (10_000, 20):
        monkeypatch.setattr(r, "SUB_BLOCK", part)
        got = [(x.gp, x.name1, x.name2) for x in r.similar_names(keyed, ["gp", "dob"]).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 300


def test_hub_links_stay_linear(spark):
    """Fifty seeds of a cluster of 4,000 give fifty links to its hub and the drawn members, with the full counts."""
    from rollbook.operators import dashboards as d

    dup = spark.range(4000).select(F.format_string("U%05d", "id").alias("uid"), F.lit("U00000").alias("cluster_id"), F.lit(4000).alias("cluster_size"))
    seeds = dup.orderBy("uid").limit(50).select("uid").unionByName(spark.createDataFrame([("other",)], "uid string"))
    links = d.hub_links(dup, "B1", seeds).collect()
    assert len(links) == 50 + d.DRAWN
    assert {x.link_count for x in links if x.label == "POTENTIAL_DUPLICATE"} == {3999} and {x.link_count for x in links if x.label == "CLUSTER_MEMBER"} == {4000}
    assert sorted(x.target for x in links if x.label == "CLUSTER_MEMBER") == [f"U{i:05d}" for i in range(d.DRAWN)]
    assert d.hub_members(dup, "B1", spark.createDataFrame([("B1:U00000",)], "hub string")).count() == 4000


def test_neighborhood_and_slice_list_every_partner(spark):
    """A seed of a cluster of 60 has 59 links, not the 20 of a drawing."""
    uids = [f"U{i:02d}" for i in range(60)]
    citizens = spark.createDataFrame([(u, "A", "1990-01-01", "MALE", 70, "HIGH", False, True, False) for u in uids],
        "uid string, name string, dob string, gender string, vulnerability_score int, risk_tier string, is_ghost_flag boolean, is_dup_flag boolean, is_anomaly_flag boolean")
    places = spark.createDataFrame([(u, "7", "GP", "1", "B", "2", "D") for u in uids], "uid string, gp_code string, gp_name string, block_code string, block_name string, district_code string, district_name string")
    schemes = spark.createDataFrame([(u, "S1", "One") for u in uids], "uid string, scheme_id string, scheme_name string")
    flags = spark.createDataFrame([], "entity string, entity_id string, rule string, type string, description string, confidence int")
    c1 = spark.createDataFrame([("7", "S1")], "gp_code string, scheme_id string")
    dup, dob = r.duplicate_clusters(citizens), r.dob_clusters(citizens, places)
    seeds = citizens.where("uid IN ('U05', 'U50')").select("uid")
    links = d.neighborhood(citizens, places, flags, dup, dob, c1, None, seeds)
    for label in ("POTENTIAL_DUPLICATE", "SAME_DOB_AT_GP"):
        got = {(x.source, x.target) for x in links.where(F.col("label") == label).collect()}
        assert got == {(a, b) for a in ("U05", "U50") for b in uids if a != b}, label
    assert {x.id for x in d.node_rows(links, citizens, places, flags, schemes).where("type = 'Citizen'").collect()} == set(uids)
    for scheme in (None, "S1"):
        pairs = d.slice_rows(citizens, places, schemes, flags, dup, 1200, scheme).where("label = 'POTENTIAL_DUPLICATE'").collect()
        assert sorted((x.source, x.target) for x in pairs) == [(a, b) for a in uids for b in uids if a < b]
