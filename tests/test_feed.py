"""The feed by entries and ranks against all pairs, opened by hand."""

import itertools

import pytest
from pyspark.sql import functions as F

from rollbook.functions.ranking import Ranked
from rollbook.operators import feed


@pytest.fixture(scope="module", autouse=True)
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture(scope="module")
def case(spark):
    people = [(f"U{i:04d}", ["Ana Ghost", "Bo Steel", None, "Cy (Uid"][i % 4], "1990-01-01") for i in range(300)]
    # one cluster of 160 citizens has 12,720 pairs; 40 citizens share two GPs, so their pairs come twice
    dup = [(f"U{i:04d}", "U0000") for i in range(160)] + [(f"U{i:04d}", "U0200") for i in range(200, 203)]
    dob = [(f"U{i:04d}", gp, "1990-01-01", gp) for gp, ids in (("G1", range(100, 180)), ("G2", range(140, 230)), ("G3", [299])) for i in ids]
    flags = [("citizen", f"U{i:04d}", r, r, "GHOST", f"Flag {i % 3}", c, t) for i in range(0, 300, 7) for r, c, t in (("A1", 92, None), ("H1", 98, f"2024-01-{i % 28 + 1:02d} 00:00:00"), ("E1", 80, None))]
    flags += [("card", "C1", "E1", "E1", "RING", "Card", 85, None), ("operator", "OP1", "F1", "F1", "X", "Op", 80, "2024-01-05 00:00:00"), ("citizen", "gone", "A1", "A1", "GHOST", "No citizen", 70, None)]
    places = [(p[0], "D" if i % 2 else None) for i, p in enumerate(people)]
    schemes = [(p[0], "S1") for p in people[::2]]
    make = spark.createDataFrame
    tables = {
        "citizens": make(people, "uid string, name string, dob string"), "places": make(places, "uid string, district_name string"), "schemes": make(schemes, "uid string, scheme_id string"),
        "flags": make(flags, "entity string, entity_id string, rule string, label string, type string, description string, confidence int, detected_at string"),
        "dup": make(dup, "uid string, cluster_id string"), "dob": make(dob, "uid string, gp_code string, dob string, cluster_id string"),
    }
    name, where, scheme = {p[0]: p[1] for p in people}, dict(places), dict(schemes)
    rows = []
    for e, u, r, la, ty, de, c, t in flags:
        person = e == "citizen"
        rows.append((r, de, name.get(u) if person else ("Ration Card " if e == "card" else "Operator ") + u, u, (where.get(u) or "Unknown") if person else "N/A", c, t, scheme.get(u, "N/A") if person else "N/A", None))
    groups = {}
    for u, c in dup:
        groups.setdefault(("B1", c), []).append(u)
    for u, gp, d, _ in dob:
        groups.setdefault(("B3", gp), []).append(u)
    for (rule, _), ids in groups.items():
        conf, text = feed.PAIR_RULES[rule]
        for a, b in itertools.combinations(sorted(ids), 2):
            rows.append((rule, f"{text}{name[b] or 'Unknown'} (UID: {b})", name[a], a, where[a] or "Unknown", conf, None, scheme.get(a, "N/A"), b))
    return tables, rows


def in_order(rows, nulls_first=True):
    late = lambda t: (0 if nulls_first else 1, ()) if t is None else (1 if nulls_first else 0, tuple(-ord(c) for c in t))
    return sorted(rows, key=lambda r: (-r[5], late(r[6]), r[3], r[0], r[8] is not None, r[8] or ""))


def shown(df):
    return [(r.rule, r.description, r.name, r.uid, r.district, r.confidence, r.detected_at, r.scheme, r.other_uid) for r in sorted(df.collect(), key=lambda r: r.rank)]


@pytest.fixture(scope="module")
def built(case):
    t, _ = case
    members = feed.members(t["dup"], t["dob"]).cache()
    return members, feed.entries(t["citizens"], t["places"], t["schemes"], t["flags"], members).cache()


def test_entries_hold_every_row(case, built):
    rows = case[1]
    members, entries = built
    assert len(rows) > 10_000 and feed.total(entries).first()[0] == len(rows)
    assert entries.count() < 700  # linear in flags and members


def test_pages_at_any_offset(case, built):
    t, rows = case
    members, entries = built
    want, index = in_order(rows), feed.ranked(entries)
    assert index.runs.count() > 1
    for limit, offset in ((50, 0), (400, 95), (1, 12_700), (900, len(rows) - 500), (120, 9_950), (7, len(rows) + 5), (3, -4)):
        lo = max(offset, 0)
        assert shown(feed.page(index, members, t["citizens"], limit, offset)) == want[lo : lo + limit]


def test_page_larger_than_a_broadcast(case, built, monkeypatch):
    t, rows = case
    members, entries = built
    monkeypatch.setattr(feed, "BROADCAST_ROWS", 100)
    assert shown(feed.page(feed.ranked(entries), members, t["citizens"], 20_000, 300)) == in_order(rows)[300:20_300]


@pytest.mark.parametrize("text", [" Ghost ", "steel", "u0007", "e1", "same dob", "uid: u015", "unknown (uid", "nothing like it", "(uid ("])
def test_text_filter_reaches_partners(case, built, text):
    t, rows = case
    members, entries = built
    hay = lambda r: " ".join(x or "" for x in (r[2], r[3], r[0], r[1])).lower()
    want = in_order([r for r in rows if text.strip().lower() in hay(r)], nulls_first=False)
    found, some = feed.with_text(entries, members, t["citizens"], text)
    assert feed.total(found).first()[0] == len(want)
    index = feed.ranked(found, nulls_first=False)
    for limit, offset in ((40, 0), (60, max(len(want) // 2, 0))):
        assert shown(feed.page(index, some, t["citizens"], limit, offset)) == want[offset : offset + limit]


def test_a_page_reads_only_its_partitions(spark, built):
    index = feed.ranked(built[1])
    parts = index.runs.select("_part", "_weight_before", "_weight").orderBy("_weight_before").collect()
    last = parts[-1]
    got = index.between(last._weight_before, last._weight_before + 1)
    plan = got._jdf.queryExecution().toString()
    assert f"_part#" in plan and got.count() == 1


def test_ranked_groups(spark):
    rows = [(g, v, (v * 7) % 5) for g in (None, "a", "b") for v in range(400)] + [("hot", v, 1) for v in range(5000)] + [("a", 3, 2)] * 3
    df = spark.createDataFrame(rows, "g string, v int, w int").repartition(7)
    ranked = Ranked(df, ["g"], [F.desc("v")], "test", weight="w").numbered().collect()
    by = {}
    for r in ranked:
        by.setdefault(r.g, []).append(r)
    assert {g: len(x) for g, x in by.items()} == {None: 400, "a": 403, "b": 400, "hot": 5000}
    for x in by.values():
        x.sort(key=lambda r: r.pos)
        assert [r.pos for r in x] == list(range(len(x)))
        assert [r.v for r in x] == sorted((r.v for r in x), reverse=True)
        assert [r.before for r in x] == [sum(y.w for y in x[:i]) for i in range(len(x))][: len(x)] if len(x) < 1000 else x[-1].before == len(x) - 1
        assert {r.total for r in x} == {sum(r.w for r in x)}


def test_empty_feed(spark, case):
    t = {k: v.limit(0) for k, v in case[0].items()}
    members = feed.members(t["dup"], t["dob"])
    entries = feed.entries(t["citizens"], t["places"], t["schemes"], t["flags"], members)
    assert feed.page(feed.ranked(entries), members, t["citizens"], 10).collect() == []
    assert feed.total(entries).first()[0] == 0
