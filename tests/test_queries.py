"""Registered queries against their SQL on the smallest input; ROLLBOOK_ALL=1 runs every one."""

import os

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry
from tools.compare import TABLES, rows_of

SQL = entry.oracle_sql()
SAMPLE = [
    "src_2", "src_4", "reg_1", "reg_3", "reg_8", "reg_11", "qa_4", "qa_9", "qa_14", "gra_2", "gra_5", "gra_11", "sc_2", "sc_6", "r_a2", "r_b1", "r_b1s", "r_b2", "r_b3",
    "r_c1", "r_e1", "r_i1", "run_1", "run_3", "run_4", "dsh_7_all", "dsh_12", "dsh_15", "dsh_19", "dsh_25", "dsh_30", "dsh_35_history", "elg_5", "elg_6", "elg_7", "elg_13", "elg_17",
    "elg_24", "elg_25_preferred", "elg_29", "elg_34", "doc_4", "doc_8", "doc_11", "doc_13", "qry_3", "qry_6", "snk_1", "str_1", "str_4_7d",
]
KEYS = list(entry.queries()) if os.environ.get("ROLLBOOK_ALL") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_query(spark, duck, key):
    df = entry.queries()[key](spark, SF)
    got = df.collect()
    if key not in SQL:
        return
    cur = duck.execute(SQL[key])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(got, df.columns) == rows_of(cur.fetchall(), cols)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_catalog_is_whole():
    ids = [f"src_{i}" for i in range(1, 5)] + [f"reg_{i}" for i in range(1, 13)] + [f"qa_{i}" for i in range(1, 18)] + [f"gra_{i}" for i in range(1, 19)]
    ids += [f"sc_{i}" for i in range(1, 7)] + [f"dsh_{i}" for i in range(1, 39)] + [f"doc_{i}" for i in range(1, 19)] + [f"elg_{i}" for i in range(1, 36)] + [f"qry_{i}" for i in range(1, 7)]
    ids += [f"snk_{i}" for i in range(1, 8)] + ["str_1", "str_2", "str_3", "str_4_24h", "run_1", "run_2", "run_3", "run_4"]
    ids += [f"r_{x}" for x in "a1 a1s a2 a2s a3 b1 b1s b2 b3 b4 bl c1 c1s c2 c3 d d1s d3 e1 e1s f1 h1 i1".split()]
    assert [i for i in ids if i not in entry.queries()] == []
