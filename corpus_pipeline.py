"""A training-corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Every stage works on all rows its predecessor kept. All but the last return the columns of
``documents``; the last returns one row per document of the token files. Stages with Python tasks
keep the session's Arrow batches short, since the workers of earlier stages stay in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rollbook.llm import decontaminate, language, mixing, near_dup, token_files
from rollbook.llm.common import scratch, short_batches, stored, table
from rollbook.llm.queries import public_tokenizer


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter (``und``) go."""
    short_batches(spark)
    net = language.train(docs)
    # renamed, so that no column of the documents clashes with the label and no text is held twice
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_{c}") for c in docs.columns])
    known = language.identify(rows, net, "_doc_id", "_text").where(F.col("lang_pred") != language.UNKNOWN)
    return known.select(*[F.col(f"`_{c}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies."""
    short_batches(spark)
    return near_dup.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once or twice."""
    return mixing.mixed_rows(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32."""
    short_batches(spark)
    path = scratch(spark, "pipeline_tokens")
    token_files.write_tokens(docs, path, public_tokenizer())
    return token_files.digest(token_files.read_sums(spark, path))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]
#: A trained network, sketches, a seeded mix and a tokenizer are not SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
