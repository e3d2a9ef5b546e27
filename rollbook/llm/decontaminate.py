"""Benchmark decontamination: a broadcast hash set of normalised test n-grams meets training windows.

DataFrame functions only. The text of a document is never shuffled to find hits: its windows are
made in the row and looked up in the set of item windows by their full words, so the hash join
itself verifies a hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rollbook.functions.text import computed_once

from .common import same, text_hash

WINDOW = 10
#: Item windows are broadcast up to this many bytes of words; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _windows(words: Column, n: Column | int) -> Column:
    """(first word's index from 0, window length, words joined by a blank) of every window."""
    n = F.lit(n) if isinstance(n, int) else n
    made = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))),
        lambda i: F.struct((i - 1).alias("at"), n.alias("len"), F.array_join(F.slice(words, i, n), " ").alias("window")),
    )
    return F.when((n > 0) & (F.size(words) >= n), made).otherwise(F.array().cast("array<struct<at:int,len:int,window:string>>"))


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """Distinct (item, len, window); an item of fewer than ``n`` words is one window, one of none has none."""
    words = computed_once(benchmark.select(F.col(item).alias("_item"), F.col(text).alias("_text")), {"_words": words_of(F.col("_text"))})
    made = _windows(F.col("_words"), F.least(F.size("_words"), F.lit(n)))
    return words.select("_item", F.inline(made)).select("_item", F.col("len").alias("_len"), F.col("window").alias("_window")).distinct()


def find_hits(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", n: int = WINDOW) -> DataFrame:
    """One row per distinct (key, text): _key, _hash (of the text), n_words, n_rows, hit (sorted word indices), items (sorted strings)."""
    sought = item_windows(benchmark, item, "text", n)
    size = sought.agg(F.sum(F.octet_length("_window") + 64).alias("b"), F.collect_set("_len").alias("lens")).first()
    mark = benchmark.sparkSession.range(1).select(F.lit(None).cast(sought.schema["_item"].dataType).alias("_item"), F.lit(-1).alias("_len"), F.lit("").alias("_window"))
    sought = sought.unionByName(mark)
    if (size["b"] or 0) <= BROADCAST_BYTES:
        sought = F.broadcast(sought)
    lens = sorted(size["lens"] or [n])
    rows = computed_once(
        docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")),
        {"_words": words_of(F.col("_text")), "_hash": text_hash(F.col("_text"))},
    )
    made = F.flatten(F.array(*[_windows(F.col("_words"), x) for x in lens]))
    # One row more per document, the empty window, brings its word count through the same join.
    own = F.array(F.struct(F.lit(-1).alias("at"), F.size("_words").alias("len"), F.lit("").alias("window")))
    seen = rows.select("_key", "_hash", F.inline(F.concat(own, made)))
    met = seen.join(sought, F.col("window") == F.col("_window")).where((F.col("len") == F.col("_len")) | (F.col("window") == ""))
    is_hit = F.col("window") != ""
    spans = met.groupBy("_key", "_hash").agg(
        F.max(F.when(~is_hit, F.col("len"))).cast("bigint").alias("n_words"),
        F.count(F.when(~is_hit, 1)).alias("n_rows"),
        F.collect_set(F.when(is_hit, F.struct("at", "len"))).alias("_spans"),
        F.array_sort(F.collect_set(F.when(is_hit, F.col("_item").cast("string")))).alias("items"),
    )
    covered = F.flatten(F.transform("_spans", lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1)))
    return spans.select("_key", "_hash", "n_words", "n_rows", F.array_sort(F.array_distinct(covered)).alias("hit"), "items")


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: key, n_words, n_hit, n_items, items (sorted strings), contaminated.

    Null or empty text has no words. Repeated rows each get the same result, also with a null key.
    Items with a null id count as hits but not in ``items``. Other columns are not carried.
    """
    found = find_hits(docs, benchmark, key, text, n=n)
    return found.select(
        F.col("_key").alias(key), "n_words", F.size("hit").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items", (F.size("hit") > 0).alias("contaminated"),
        F.explode(F.array_repeat(F.lit(1), F.col("n_rows").cast("int"))).alias("_copy"),
    ).drop("_copy")


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", n: int = WINDOW, cut: bool = False) -> DataFrame:
    """The rows of ``docs`` without hit documents, or with ``cut`` all rows without their hit words.

    All columns are kept as they are; ``cut`` replaces only the text of hit rows.
    """
    hits = find_hits(docs, benchmark, key, text, n=n).where(F.size("hit") > 0)
    on = same(F.col(f"_d.{key}"), F.col("_h._key")) & (text_hash(F.col(f"_d.{text}")) == F.col("_h._hash"))
    if not cut:
        return docs.alias("_d").join(hits.alias("_h"), on, "left_anti")
    joined = docs.alias("_d").join(hits.alias("_h"), on, "left")
    tokens = F.regexp_extract_all(F.col(f"_d.{text}"), F.lit(WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60") + "|" + NO_WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")), F.lit(0))
    first = F.when(F.regexp(F.col(f"_d.{text}"), F.lit(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")), 1).otherwise(0)
    left = F.array_join(
        F.transform(tokens, lambda x, i: F.when(((i + first) % 2 == 0) & F.array_contains(F.col("_h.hit"), ((i - first + F.lit(0)) / 2).cast("int")), F.lit("")).otherwise(x)), ""
    )
    cols = [F.when(F.col("_h.hit").isNotNull(), left).otherwise(F.col(f"_d.{c}")).alias(c) if c == text else F.col(f"_d.`{c}`") for c in docs.columns]
    return joined.select(*cols)
