"""Removal of documents everywhere, in tables at rest (SNK-7).

The tables are keyed tables (``keyed``) below one folder. A removal is one version of each: it drops the
document's chunks and project links, its rules, and with them their decisions and manual inputs. In the
entity graph a node or edge keeps a row per document it comes from; those of the removed documents go,
the counts of their nodes and edges shrink by as many, and what is left with no document goes too, an
edge also with either end. Only the leaves of touched keys are written. Every step reads the version
before, so a removal that was cut off is run again as a whole and ends the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import staged
from .keyed import read_current, upsert_into

#: Key columns of every table.
TABLES = {
    "chunks": ["doc_id", "chunk_index"], "rules": ["rule_id"], "decisions": ["decision_id"], "manual_inputs": ["input_id"], "project_links": ["project_id", "doc_id"],
    "entities": ["name"], "entity_documents": ["name", "doc_id"], "relations": ["source", "relation", "target"], "relation_documents": ["source", "relation", "target", "doc_id"],
}


def write_tables(tables: dict[str, DataFrame], root: str, version: int = 0) -> None:
    """The given tables (names of ``TABLES``) as a version each."""
    for name, df in tables.items():
        upsert_into(df, f"{root}/{name}", TABLES[name], version)


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: read_current(spark, f"{root}/{name}") for name in TABLES}


def remove_documents(removed: DataFrame, root: str, version: int) -> None:
    """Write ``version`` of all tables without the documents of ``removed`` (doc_id) and all that hangs on them alone."""
    spark = removed.sparkSession
    docs = staged(removed.where("doc_id IS NOT NULL").select("doc_id").distinct(), "removed")
    old = {name: read_current(spark, f"{root}/{name}", version) for name in TABLES}

    def drop(name: str, rows: DataFrame) -> None:
        keys = TABLES[name]
        upsert_into(staged(rows.select(*keys).distinct(), f"lost_{name}"), f"{root}/{name}", keys, version, lambda before, gone: before.join(gone, keys, "left_anti"))

    def of_docs(name: str) -> DataFrame:
        return old[name].join(docs, "doc_id", "left_semi")

    def shrink(name: str, lost: DataFrame) -> None:
        keys = TABLES[name]

        def left(before: DataFrame, lost: DataFrame) -> DataFrame:
            rows = before.join(lost, keys, "left").withColumn("document_count", F.col("document_count") - F.coalesce("_lost", F.lit(0)))
            return rows.where("document_count > 0").drop("_lost")

        upsert_into(staged(lost, f"lost_{name}"), f"{root}/{name}", keys, version, left)

    rules = of_docs("rules").select("rule_id").distinct()
    drop("decisions", old["decisions"].join(rules, "rule_id", "left_semi"))
    drop("manual_inputs", old["manual_inputs"].join(rules, "rule_id", "left_semi"))
    for name in ("rules", "chunks", "project_links"):
        drop(name, of_docs(name))

    # what several steps read is worked out once
    lost = staged(of_docs("entity_documents").groupBy("name").agg(F.count("*").alias("_lost")), "lost_documents")
    dead = old["entities"].join(lost, "name").where("document_count <= _lost").select("name")
    shrink("entities", lost)
    drop("entity_documents", of_docs("entity_documents"))
    # an edge goes with its last document, and whole with an end that goes
    edges = TABLES["relations"]
    ends = [old["relations"].join(dead.withColumnRenamed("name", end), end, "left_semi").select(*edges) for end in ("source", "target")]
    detached = staged(ends[0].unionByName(ends[1]).distinct(), "detached")
    gone = of_docs("relation_documents")
    per = gone.groupBy(*edges).agg(F.count("*").alias("_lost")).unionByName(old["relations"].join(detached, edges, "left_semi").select(*edges, F.col("document_count").alias("_lost")))
    shrink("relations", per.groupBy(*edges).agg(F.sum("_lost").alias("_lost")))
    drop("relation_documents", gone.select(*TABLES["relation_documents"]).unionByName(old["relation_documents"].join(detached, edges, "left_semi").select(*TABLES["relation_documents"])))
