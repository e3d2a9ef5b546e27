"""Document files as text (SRC-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# File types that are accepted, and those read as plain text here.
ALLOWED = ["pdf", "docx", "pptx", "xlsx", "txt", "html", "htm", "csv", "png", "jpg", "jpeg", "tiff"]
TEXT_TYPES = ["txt", "html", "htm", "csv"]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files of allowed types: UTF-8 text, else Latin-1; formats that need a parser keep null text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select("path", name.alias("filename"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("extension"), "length", "content")
    raw = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.decode("content", "ISO-8859-1"))
    return rows.where(F.col("extension").isin(ALLOWED)).select("path", "filename", "extension", "length", F.when(F.col("extension").isin(TEXT_TYPES), text).alias("text"))
