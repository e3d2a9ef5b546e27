"""Sinks: keyed upsert, exports, decision and chunk tables (SNK)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.flags import union
from .keyed import read_current, upsert, upsert_into

__all__ = ["chunk_points", "read_current", "replace_decisions", "top_rows", "upsert", "upsert_into", "write_csv", "write_evaluation"]


def top_rows(spark: SparkSession, tables: dict, n: int = 10) -> DataFrame:
    """First n rows of every table as JSON. An empty table gives row 0, a failing one an error row.

    ``tables`` maps a name to a function that reads it; only the read of a table is tried here.
    """
    schema = "table_name string, row_number int, row_json string, status string"
    parts = []
    for name, read in tables.items():
        try:
            df = read()
            rows = df.limit(n).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row_json"))
            if not df.columns:
                raise ValueError("no columns")
        except Exception as e:  # noqa: BLE001 - the export goes on with the other tables
            parts.append(spark.createDataFrame([(name, 0, str(e)[:200], "error")], schema))
            continue
        numbered = rows.agg(F.collect_list("row_json").alias("r"))  # n rows by the limit
        some = numbered.select(F.posexplode_outer("r").alias("p", "row_json"))
        parts.append(some.select(
            F.lit(name).alias("table_name"), (F.coalesce(F.col("p"), F.lit(-1)) + 1).cast("int").alias("row_number"), "row_json",
            F.when(F.col("p").isNull(), "empty").otherwise("ok").alias("status")))
    return union(*parts)


def write_csv(df: DataFrame, path: str) -> None:
    """Export with header and every value quoted."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_evaluation(verdicts: DataFrame, summary: DataFrame, path: str, run_id: str, scheme_id: str, config: dict) -> None:
    """Artifact of a manifest run: configuration, summary and one JSON row per subject."""
    settings = F.create_map(*[F.lit(str(x)) for kv in config.items() for x in kv])
    tag = lambda df: df.withColumn("evaluation_run_id", F.lit(run_id)).withColumn("scheme_id", F.lit(scheme_id))
    parts = ["evaluation_run_id", "scheme_id"]
    tag(verdicts).write.mode("append").partitionBy(*parts).json(f"{path}/subjects")
    tag(summary.withColumn("run_config", settings)).write.mode("append").partitionBy(*parts).json(f"{path}/summary")


def replace_decisions(decisions: DataFrame, path: str) -> None:
    """Replace all decisions of the rules in ``decisions``; other rules stay as they are."""
    decisions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("rule_id").parquet(path)


def chunk_points(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunk rows with payload and a key from document and position, so a second run adds nothing."""
    scheme = F.nullif(F.regexp_extract(F.upper("filename"), r"([A-Z]\d{3,5})", 1), F.lit(""))
    payload = documents.select("doc_id", "filename", "object_key", scheme.alias("scheme_id"))
    return chunks.join(payload, "doc_id").withColumn(
        "point_id", F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")), 256)
    )
