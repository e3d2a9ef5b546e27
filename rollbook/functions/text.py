"""Text helpers made of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def squash(c: Column) -> Column:
    """White space runs to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def bigrams(name: Column) -> Column:
    """Occurrence-tagged bigrams of the words of a name, so set overlap is multiset overlap.

    Lower case, split at blanks; a one-letter word gives itself. The n-th repeat of a bigram
    carries the tag n.
    """
    words = F.filter(F.split(F.lower(name), r"\s+"), lambda w: w != "")
    grams = F.flatten(
        F.transform(
            words,
            lambda w: F.when(F.length(w) < 2, F.array(w)).otherwise(
                F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(2)))
            ),
        )
    )
    return F.transform(
        grams,
        lambda g, i: F.concat(
            g, F.lit("#"), F.size(F.filter(F.slice(grams, F.lit(1), i + 1), lambda x: x == g)).cast("string")
        ),
    )


def dice(a: Column, b: Column) -> Column:
    """Sørensen–Dice of two tagged bigram arrays."""
    total = F.size(a) + F.size(b)
    return F.when(total > 0, 2.0 * F.size(F.array_intersect(a, b)) / total).otherwise(0.0)


def _grams_of(c: Column, width: int) -> Column:
    """Distinct substrings of one width; empty when the text is shorter."""
    n = F.length(c) - width + 1
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(c, i, F.lit(width))))
    )


def contains_join(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Distinct (text, needle) pairs where the lower-case text contains the lower-case needle.

    An equi join instead of a nested loop: a needle meets the texts on one of its own substrings
    of three letters (fewer for a shorter needle), the rarest among the texts, and the candidates
    are then checked in full. Exact for every needle that is not empty.
    """
    t = texts.select(F.col(text).alias("_text")).where("_text IS NOT NULL").distinct().withColumn("_low", F.lower("_text"))
    grams = t.select("_text", "_low", F.explode(F.concat(*[_grams_of(F.col("_low"), w) for w in (1, 2, 3)])).alias("_gram"))
    held = grams.groupBy("_gram").agg(F.count("*").alias("_held"))
    n = needles.select(F.col(needle).alias("_needle")).where("_needle <> ''").distinct().withColumn("_want", F.lower("_needle"))
    width = F.least(F.length("_want"), F.lit(3))
    parts = F.when(width == 3, _grams_of(F.col("_want"), 3)).when(width == 2, _grams_of(F.col("_want"), 2)).otherwise(_grams_of(F.col("_want"), 1))
    # A substring that no text holds means no match at all; it wins the minimum and joins nothing.
    key = (
        n.withColumn("_gram", F.explode(parts)).join(held, "_gram", "left")
        .groupBy("_needle", "_want").agg(F.min_by("_gram", F.struct(F.coalesce("_held", F.lit(0)).alias("h"), F.col("_gram"))).alias("_gram"))
    )
    met = grams.join(key, "_gram").where(F.contains("_low", "_want"))
    return met.select(F.col("_text").alias(text), F.col("_needle").alias(needle)).distinct()


def computed_once(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Adds columns that are evaluated once per row.

    A plain projection lets the optimizer copy the expression into every filter and join key that
    uses the column; behind a generator of one row it stays where it is.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))
