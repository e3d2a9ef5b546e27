import datetime
import shutil
import time
from decimal import Decimal

from pyspark.sql import DataFrame, functions as F

from rollbook.operators.graph import PAYOUT_KEYS, payout_windows
from rollbook.plans.store import Store
from rollbook.session import CLEANUP_CONF, shuffles_freed
from rollbook.sources import files, keyed, removal, sinks
from rollbook.sources import tables as t
from rollbook.streaming import jobs


def test_upsert_is_replay_safe(spark, tmp_path):
    path = str(tmp_path / "t")
    cols = "k string, v int"
    sinks.upsert_into(spark.createDataFrame([("a", 1), ("b", 1)], cols), path, ["k"], 0)
    for _ in range(2):
        sinks.upsert_into(spark.createDataFrame([("b", 2), ("c", 2)], cols), path, ["k"], 1)
    assert {tuple(r) for r in sinks.read_current(spark, path).collect()} == {("a", 1), ("b", 2), ("c", 2)}


def test_top_rows(spark):
    def broken():
        raise RuntimeError("gone")

    tables = {"two": lambda: spark.range(5), "none": lambda: spark.range(0), "bad": broken}
    got = [(r.table_name, r.row_number, r.status) for r in sinks.top_rows(spark, tables, 2).collect()]
    assert got == [("two", 1, "ok"), ("two", 2, "ok"), ("none", 0, "empty"), ("bad", 0, "error")]


def test_replace_decisions_keeps_other_rules(spark, tmp_path):
    path, cols = str(tmp_path / "d"), "rule_id string, uid string, decision string"
    sinks.replace_decisions(spark.createDataFrame([("R1", "a", "X"), ("R2", "a", "X")], cols), path)
    sinks.replace_decisions(spark.createDataFrame([("R1", "b", "Y")], cols), path)
    assert {(r.rule_id, r.uid) for r in spark.read.parquet(path).collect()} == {("R1", "b"), ("R2", "a")}


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("café".encode("utf-8"))
    (tmp_path / "b.TXT").write_bytes("café".encode("latin-1"))
    (tmp_path / "c.exe").write_bytes(b"x")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    got = {r.filename: r.text for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "café", "b.TXT": "café", "d.pdf": None}


def test_csv_export(spark, tmp_path):
    path = str(tmp_path / "csv")
    sinks.write_csv(spark.createDataFrame([('say "hi"', 1)], "a string, b int").coalesce(1), path)
    (part,) = [p for p in (tmp_path / "csv").glob("part-*.csv") if p.stat().st_size]
    assert part.read_text().splitlines() == ['"a","b"', '"say ""hi""","1"']


def test_sync_goes_on_where_it_stopped(spark, tmp_path):
    src, dst, cp = (str(tmp_path / x) for x in ("src", "dst", "cp"))
    cols = "enrollment_key string, v string, scheme_id string, scheme_beneficiary_id string, row_no long"
    def put(rows):
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(src)
    put([("a", "old", "S", "B", 2), ("b", "old", "S", "B", 1)])
    schema = spark.read.parquet(src).schema
    for _ in range(2):
        jobs.stream_sync(jobs.file_stream(spark, src, schema), dst, cp)
    put([("a", "earlier", "S", "B", 1), ("b", "new", "S", "B", 3), ("c", "new", "S", "B", 1)])
    jobs.stream_sync(jobs.file_stream(spark, src, schema), dst, cp)
    assert {(r.enrollment_key, r.v) for r in sinks.read_current(spark, dst).collect()} == {("a", "old"), ("b", "new"), ("c", "new")}


def test_late_flags_are_kept(spark, tmp_path):
    src, dst, cp = (str(tmp_path / x) for x in ("src", "dst", "cp"))
    def put(rows):
        df = spark.createDataFrame(rows, "entity_id string, rule string, t string").select(F.col("entity_id").alias("flag_id"), "entity_id", "rule", F.col("t").cast("timestamp").alias("detected_at"))
        df.coalesce(1).write.mode("append").parquet(src)
        return df.schema
    schema = put([("a", "A1", "2024-01-10 01:00:00"), ("b", "A1", "2024-01-10 02:00:00")])
    run = lambda: jobs.stream_recent_flags(jobs.file_stream(spark, src, schema), dst, cp)
    run()
    put([("c", "A1", "2024-01-10 03:00:00"), ("d", "A1", "2024-01-02 00:00:00")])
    run()
    got = {(str(r.window_start), r.flags) for r in sinks.read_current(spark, dst).collect()}
    assert got == {("2024-01-10 00:00:00", 3), ("2024-01-02 00:00:00", 1)}
    run()
    assert {(str(r.window_start), r.flags) for r in sinks.read_current(spark, dst).collect()} == got


def test_reviews_delivered_twice_count_once(spark, tmp_path):
    src, dst, cp = (str(tmp_path / x) for x in ("src", "dst", "cp"))
    rows = [(1, "d1", "APPROVE", "2024-01-01 00:00:00"), (1, "d1", "APPROVE", "2024-01-01 00:00:00"), (2, "d1", "REJECT", "2024-01-01 05:00:00"), (3, "d2", "ESCALATE", "2024-01-01 01:00:00")]
    df = spark.createDataFrame(rows, "review_id long, decision_id string, action string, t string").select("review_id", "decision_id", "action", F.lit("n").alias("note"), F.col("t").cast("timestamp").alias("reviewed_at"))
    df.write.parquet(src)
    jobs.stream_reviews(jobs.file_stream(spark, src, df.schema), dst, cp)
    assert {(r.decision_id, r.review_id) for r in sinks.read_current(spark, dst).collect()} == {("d1", 2), ("d2", 3)}


# --- keyed table -------------------------------------------------------------------------------


def size_of(folder):
    return sum(p.stat().st_size for p in folder.rglob("*.parquet")) if folder.exists() else 0


def test_batches_write_what_they_touch(spark, tmp_path, monkeypatch):
    """A batch of ten keys writes as many rows into a table of 40,000 rows as into one of 4,000."""
    monkeypatch.setattr(keyed, "LEAF_ROWS", 400)
    written = {}
    for n in (4_000, 40_000):
        path = tmp_path / str(n)
        keyed.upsert_into(spark.range(n).select("id", F.lit(0).alias("v")), str(path), ["id"], 0)
        batch = spark.range(5).unionByName(spark.range(n, n + 5)).select("id", F.lit(1).alias("v"))
        keyed.upsert_into(batch, str(path), ["id"], 1)
        got = keyed.read_current(spark, str(path))
        assert got.count() == n + 5 and got.where("v = 1").count() == 10 and got.select("id").distinct().count() == n + 5
        written[n] = spark.read.parquet(f"{path}/data/version=1").count()
        leaves = keyed._versions(spark, str(path))[1].leaves
        assert max(x.rows for x in leaves) <= 2 * keyed.LEAF_ROWS and sum(x.rows for x in leaves) == n + 5
    assert written[40_000] <= 10 * 400 and written[40_000] < 2.5 * written[4_000]


def test_leaves_split_and_keep_every_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "LEAF_ROWS", 50)
    path, want = str(tmp_path / "t"), {}
    for version in range(6):
        rows = [(f"k{i}" if i else None, version * 1000 + i) for i in range(0, 40 * (version + 1) * (version + 1), version % 3 + 1)]
        want.update({k: v for k, v in rows})
        newest = lambda df: df.groupBy("k").agg(F.max("v").alias("v"))
        keyed.upsert_into(spark.createDataFrame(rows, "k string, v int"), path, ["k"], version, lambda old, new: newest(old.unionByName(new)))
        assert {r.k: r.v for r in keyed.read_current(spark, path).collect()} == want
    versions = keyed._versions(spark, path)
    assert sorted(versions) == [3, 4, 5] and len({x.depth for x in versions[5].leaves}) >= 1 and len(versions[5].leaves) > 8
    # every key has exactly one leaf
    assert sum(2.0 ** -x.depth for x in versions[5].leaves) == 1.0


def test_replay_and_old_versions(spark, tmp_path):
    path = tmp_path / "t"
    make = lambda rows: spark.createDataFrame(rows, "k string, v int")
    for version, rows in enumerate(([("a", 1), ("b", 1)], [("b", 2)], [], [("c", 3)])):
        keyed.upsert_into(make(rows), str(path), ["k"], version)
    files = sorted(str(p) for p in path.rglob("*.parquet"))
    keyed.upsert_into(make([("c", 9), ("x", 9)]), str(path), ["k"], 3)
    assert sorted(str(p) for p in path.rglob("*.parquet")) == files
    rows = lambda before=None: {tuple(r) for r in keyed.read_current(spark, str(path), before).collect()}
    assert rows() == {("a", 1), ("b", 2), ("c", 3)} and rows(3) == rows(2) == {("a", 1), ("b", 2)}
    assert keyed.read_current(spark, str(path), 1) is None and keyed.read_current(spark, str(tmp_path / "none")) is None
    # a batch that was cut off before its manifest is invisible, and running it again mends it
    keyed.upsert_into(make([("d", 4)]), str(path), ["k"], 4)
    shutil.rmtree(path / "manifest" / "version=4")
    assert rows() == {("a", 1), ("b", 2), ("c", 3)}
    keyed.upsert_into(make([("d", 5)]), str(path), ["k"], 4)
    assert rows() == {("a", 1), ("b", 2), ("c", 3), ("d", 5)}


def test_a_new_table_works_its_rows_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(100).unionByName(spark.range(3)).mapInArrow(count, "id long")
    keyed.upsert_into(rows, str(tmp_path / "t"), ["id"], 0)
    assert seen.value == 103 and keyed.read_current(spark, str(tmp_path / "t")).count() == 103


def test_empty_keyed_table(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.upsert_into(spark.createDataFrame([], "k string, v int"), path, ["k"], 0)
    assert keyed.read_current(spark, path).collect() == [] and keyed.read_current(spark, path).columns == ["k", "v"]
    keyed.upsert_into(spark.createDataFrame([("a", 1)], "k string, v int"), path, ["k"], 1)
    keyed.upsert_into(spark.createDataFrame([("a", 1)], "k string, v int"), path, ["k"], 2, lambda old, new: old.limit(0))
    assert keyed.read_current(spark, path).collect() == []


# --- state across batches ----------------------------------------------------------------------


def test_a_document_counts_once_over_batches(spark, tmp_path):
    src, dst, cp = (str(tmp_path / x) for x in ("src", "dst", "cp"))
    cols = "doc_id long, field_key string, quote string"
    def put(rows):
        df = spark.createDataFrame(rows, cols)
        df.coalesce(1).write.mode("append").parquet(src)
        return df.schema
    def run(schema):
        jobs.stream_signals(jobs.file_stream(spark, src, schema, files=1), dst, cp)
        return {r.field_key: (r.occurrence_count, r.status, r.first_seen, r.last_seen, r.latest_quote) for r in sinks.read_current(spark, dst).collect()}
    schema = put([(1, "f", "a"), (1, "f", "b"), (2, "f", None), (1, "g", "z")])
    assert run(schema) == {"f": (2, "CANDIDATE", 1, 2, "b"), "g": (1, "CANDIDATE", 1, 1, "z")}
    put([(1, "f", "a"), (1, "f", "c")])  # the same document again, with a later quote
    put([(1, "f", "a"), (2, "f", "q"), (None, "f", "n"), (3, None, "n")])
    assert run(schema) == {"f": (2, "CANDIDATE", 1, 2, "q"), "g": (1, "CANDIDATE", 1, 1, "z")}
    put([(3, "f", None), (0, "g", "y")])
    assert run(schema) == {"f": (3, "ACTIVE", 1, 3, "q"), "g": (2, "CANDIDATE", 0, 1, "z")}


def test_redelivered_flags_count_once(spark, tmp_path):
    src, dst, cp = (str(tmp_path / x) for x in ("src", "dst", "cp"))
    rows = [(f"f{i}", "A1", f"2024-01-0{i % 3 + 1} 05:00:00") for i in range(9)]
    def put(part):
        df = spark.createDataFrame(part, "flag_id string, rule string, t string").select("flag_id", "rule", F.col("t").cast("timestamp").alias("detected_at"))
        df.coalesce(1).write.mode("append").parquet(src)
        return df.schema
    for part in (rows[:5], rows[3:] + rows[:2], rows, rows[:1] * 4):
        schema = put(part)
    jobs.stream_recent_flags(jobs.file_stream(spark, src, schema, files=1), dst, cp)
    assert {(str(r.window_start), r.flags) for r in sinks.read_current(spark, dst).collect()} == {(f"2024-01-0{d} 00:00:00", 3) for d in (1, 2, 3)}


def test_new_rows_of_a_batch_are_found_once(spark, tmp_path):
    """The key table and the counts read the rows found, they do not look for them again."""
    read = spark.sparkContext.accumulator(0)
    def counted(it):
        for b in it:
            read.add(b.num_rows)
            yield b
    seen = str(tmp_path / "seen")
    def batch(lo):
        return spark.range(lo, lo + 10, 1, 2).mapInArrow(counted, "id long").select(F.concat(F.lit("f"), "id").alias("flag_id"))
    fresh = jobs._unseen(batch(0), seen, ["flag_id"], 0)
    assert fresh.count() == fresh.distinct().count() == 10 and read.value == 10
    fresh = jobs._unseen(batch(5), seen, ["flag_id"], 1)
    assert {r.flag_id for r in fresh.collect()} == {f"f{i}" for i in range(10, 15)}
    assert read.value == 30  # once for the leaves of its keys, once for the rows
    assert sorted(r.flag_id for r in jobs._unseen(batch(5), seen, ["flag_id"], 1).collect()) == [f"f{i}" for i in range(10, 15)]
    assert keyed.read_current(spark, seen).count() == 15


def test_payouts_in_any_order(spark, tmp_path):
    """Windows grow over batches as one aggregation over all payments would make them."""
    keys = {"uid": "u", "scheme_id": "S", "scheme_beneficiary_id": "B", "financial_year": "2023", "installment_year": "2023", "installment_month_code": "04", "installment_month": None}
    def row(i, uid, amount, time, ref):
        return (uid, *list(keys.values())[1:], amount, time, i, ref)
    rows = [row(i, [None, "u1", "u2"][i % 3], None if i % 4 == 0 else Decimal(i) / 4, f"2024-01-{i % 9 + 1:02d} 00:00:00" if i % 5 else None, f"R{i % 7}" if i % 6 else None) for i in range(60)]
    schema = ", ".join(f"{k} string" for k in keys) + ", amount decimal(18,2), t string, source_sl_no long, transaction_ref_no string"
    df = spark.createDataFrame(rows, schema).withColumn("transaction_timestamp", F.col("t").cast("timestamp")).drop("t")
    want = sorted(map(str, payout_windows(df).select(*PAYOUT_KEYS, "transaction_count", "total_amount", "latest_transaction_timestamp", "latest_transaction_ref_no").collect()))
    for seed in (1, 2):
        src, dst, cp = (str(tmp_path / f"{x}{seed}") for x in ("src", "dst", "cp"))
        df.repartition(4, F.rand(seed)).write.parquet(src)
        jobs.stream_payouts(jobs.file_stream(spark, src, df.schema, files=1), dst, cp)
        state = sinks.read_current(spark, dst)
        assert sorted(map(str, jobs.payout_rows(state).collect())) == want
    known = spark.createDataFrame([("u1:B",)], "enrollment_key string")
    assert {r.uid for r in jobs.payouts_of(known, state).collect()} == {"u1"}


def test_rows_find_their_leaf_without_a_shuffle(spark):
    """The list of leaves goes to the rows, so no task gets all rows of a leaf."""
    rows = spark.range(1000)
    leaves = [keyed.Leaf(1, 0, 0, 500), keyed.Leaf(2, 2, 0, 250), keyed.Leaf(2, 3, 0, 250)]
    placed = keyed._placed(rows, ["id"], leaves)
    assert "Exchange hashpartitioning" not in placed._jdf.queryExecution().executedPlan().toString()
    assert placed.count() == placed.select("id").distinct().count() == 1000


def test_rows_that_add_up_meet_in_their_leaf(spark, tmp_path, monkeypatch):
    """one shuffle a batch and nothing cached; leaves split, every key stays whole, null keys too."""
    monkeypatch.setattr(keyed, "LEAF_ROWS", 50)
    monkeypatch.setattr(DataFrame, "persist", lambda self, *a: 1 / 0)
    plans = []

    def group(rows, by):
        out = rows.groupBy(*by).agg(F.sum("n").alias("n"), F.max(F.struct("t")).alias("latest")).select(*by, "n", F.col("latest.t").alias("t"))
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    path, want = str(tmp_path / "t"), {}
    for version in range(3):
        # the key of 500 rows comes once in a leaf, however often it comes
        rows = [(f"a{i % 97}" if i % 10 else None, f"b{i % 5}" if i % 7 else None, 1, f"{version}-{i}") for i in range(version, 900, 2)] + [("hot", None, 1, "x")] * 500
        for a, b, n, when in rows:
            m, last = want.get((a, b), (0, ""))
            want[a, b] = (m + n, max(last, when))
        source = spark.createDataFrame(rows, "a string, b string, n long, t string")
        for _ in range(2):  # a version that is there is not written again
            keyed.group_into(source, path, ["a", "b"], version, group, ["a"])
        assert {(r.a, r.b): (r.n, r.t) for r in sinks.read_current(spark, path).collect()} == want
        assert sinks.read_current(spark, path).count() == len(want)
    assert len(plans) == 3 and all(p.count("Exchange hashpartitioning") == 1 for p in plans)
    leaves = keyed._newest(spark, path, None).leaves
    assert len(leaves) > 4 and sum(x.rows for x in leaves) == len(want)
    # rows that are equal in the placing column lie in one file
    placed = {(r.a, r.file) for r in sinks.read_current(spark, path).withColumn("file", F.input_file_name()).collect()}
    assert len(placed) == len({a for a, _ in want})
    keyed.group_into(source.limit(0), path, ["a", "b"], 3, group, ["a"])
    assert sinks.read_current(spark, path).count() == len(want)
    none = str(tmp_path / "none")
    for version in range(2):
        keyed.group_into(source.limit(0), none, ["a", "b"], version, group)
        assert sinks.read_current(spark, none).columns == ["a", "b", "n", "t"] and sinks.read_current(spark, none).count() == 0


def test_payouts_merge_without_a_cache(spark, tmp_path, monkeypatch):
    """the state of all windows was cached, counted and shuffled again for every batch."""
    monkeypatch.setattr(DataFrame, "persist", lambda self, *a: 1 / 0)
    day = datetime.datetime(2024, 1, 1)
    rows = [(f"U{i % 4}", "S1", f"B{i % 8}", "2024", "2024", f"{i % 3 + 1:02d}", None, Decimal(i), day, i, f"R{i}") for i in range(48)]
    df = spark.createDataFrame(rows, ", ".join(f"{k} string" for k in PAYOUT_KEYS) + ", amount decimal(18,2), transaction_timestamp timestamp, source_sl_no long, transaction_ref_no string")
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    df.repartition(2, "source_sl_no").write.parquet(src)
    jobs.stream_payouts(jobs.file_stream(spark, src, df.schema, files=1), dst, str(tmp_path / "cp"))
    got = jobs.payout_rows(sinks.read_current(spark, dst))
    cols = [*PAYOUT_KEYS, "transaction_count", "total_amount", "latest_transaction_timestamp", "latest_transaction_ref_no"]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, payout_windows(df).select(*cols).collect()))


def test_shuffle_files_go_with_their_write(spark, tmp_path):
    def held():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
        return {x.split("_")[1] for x in found.split() if x.startswith("shuffle_")}

    before = held()
    with shuffles_freed(spark):
        assert spark.conf.get(CLEANUP_CONF) == "true"
        spark.range(1000).repartition(4, "id").write.parquet(str(tmp_path / "t"))
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.2)
    assert held() <= before and spark.conf.get(CLEANUP_CONF) == "false"
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1000


def test_enrollment_keys_need_no_payments(spark, tmp_path):
    """keys come without the payment rollup; payments are dealt out before their texts are made, row for row the same."""
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")

    put("region", [(0, "AFRICA")], "r_regionkey int, r_name string")
    put("nation", [(3, "KENYA", 0)], "n_nationkey int, n_name string, n_regionkey int")
    put("part", [(i, "p") for i in range(8)], "p_partkey long, p_name string")
    put("customer", [(i, 3) for i in range(6)], "c_custkey long, c_nationkey int")
    day = datetime.datetime(2024, 1, 31)
    # orders 101 and 102 have one beneficiary id, customer 0 has no uid
    put("orders", [(o, o % 6, day, "F", "1-URGENT") for o in (6, 7, 8, 9, 100, 101, 102, 102)], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderstatus string, o_orderpriority string")
    put("lineitem", [(o, n, 1.5 * n, day) for o in (7, 8, 102, 500) for n in (1, 2, 3)], "l_orderkey long, l_linenumber int, l_extendedprice double, l_shipdate timestamp")
    s = Store(spark, str(tmp_path))
    plan = s.enrollment_keys._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "collect_set" not in plan
    want = {r.enrollment_key for r in s.profile.select("enrollment_key").collect()}
    assert {r.enrollment_key for r in s.enrollment_keys.collect()} == want and s.enrollment_keys.count() == len(want) > 3
    dealt = t.transactions(spark, str(tmp_path), dealt=6)
    assert sorted(map(str, dealt.collect())) == sorted(map(str, s.txn.collect())) and dealt.count() == 12
    assert dealt.rdd.getNumPartitions() == 6


# --- removal -----------------------------------------------------------------------------------


def test_removal_down_the_graph(spark, tmp_path):
    """Nodes and edges go with their last document; a removal that was cut off ends the same."""
    make = spark.createDataFrame
    tables = {
        "chunks": make([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "doc_id long, chunk_index int, text string"),
        "rules": make([("R1", 1), ("R2", 2)], "rule_id string, doc_id long"),
        "decisions": make([(1, "R1"), (2, "R2"), (3, "R1"), (4, None)], "decision_id long, rule_id string"), "manual_inputs": make([(1, "R2"), (2, "R1")], "input_id long, rule_id string"),
        "project_links": make([("P", 1), ("P", 2), ("Q", 3)], "project_id string, doc_id long"),
        "entities": make([("A", "Person", 2), ("B", "Person", 1), ("C", "Place", 1), ("D", "Place", 1)], "name string, type string, document_count long"),
        "entity_documents": make([("A", 1), ("A", 2), ("B", 1), ("C", 2), ("D", 3)], "name string, doc_id long"),
        # the edge A-D has a document that its end B does not know; B-D must go with B all the same
        "relations": make([("A", "R", "B", "x", 1), ("A", "R", "C", "y", 1), ("A", "R", "D", "z", 2), ("B", "R", "D", "w", 1)], "source string, relation string, target string, description string, document_count long"),
        "relation_documents": make([("A", "R", "B", 1), ("A", "R", "C", 2), ("A", "R", "D", 1), ("A", "R", "D", 3), ("B", "R", "D", 3)], "source string, relation string, target string, doc_id long"),
    }
    root = tmp_path / "t"
    removal.write_tables(tables, str(root))
    removed = make([(1,), (1,), (99,), (None,)], "doc_id long")
    left = lambda: {n: sorted(map(tuple, df.collect()), key=str) for n, df in removal.read_tables(spark, str(root)).items()}
    removal.remove_documents(removed, str(root), 1)
    want = {
        "chunks": [(2, 0, "c")], "rules": [("R2", 2)], "decisions": [(2, "R2"), (4, None)], "manual_inputs": [(1, "R2")], "project_links": [("P", 2), ("Q", 3)],
        "entities": [("A", "Person", 1), ("C", "Place", 1), ("D", "Place", 1)], "entity_documents": [("A", 2), ("C", 2), ("D", 3)],
        "relations": [("A", "R", "C", "y", 1), ("A", "R", "D", "z", 1)], "relation_documents": [("A", "R", "C", 2), ("A", "R", "D", 3)],
    }
    assert left() == want
    for name in ("entities", "relations", "relation_documents"):
        shutil.rmtree(root / name / "manifest" / "version=1")
    removal.remove_documents(removed, str(root), 1)
    assert left() == want
    removal.remove_documents(make([(2,), (3,)], "doc_id long"), str(root), 2)
    assert {n: len(r) for n, r in left().items() if r} == {"decisions": 1}
