"""Mixing sources to target weights by subset-sum budget fitting.

Only counts travel: documents are counted by (source, token length); per source a bounded knapsack
fits the budget over those counts, and the documents of a length are then picked in a seeded order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import same

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 17
#: Words left to the dynamic program after each length has given its even share.
DP_WORDS = 20_000
#: Order-preserving pieces of a (source, length) group, so that a hot one is ranked in parts.
SALT_BITS = 6


def token_length(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) with one row per source; null is a source and comes last.

    Shares go by weight; what would exceed ``most`` times a source goes to the others by weight.
    In the order of cap per weight the capped sources come first, so running sums find the level.
    The windows below see one row per source, never documents.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = totals.withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
    w = w.withColumn("_cap", (F.col("source_size") * most).cast("double")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    whole = Window.orderBy("_ratio", F.col("source").isNull(), "source")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    w = w.withColumn("_level", level).withColumn("_at", F.row_number().over(whole))
    # the level holds from the first source that stays below its cap
    w = w.withColumn("_final", F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_at", "_level"))).over(every)["_level"])
    target = F.least(F.col("_cap"), F.coalesce(F.col("_w") * F.col("_final"), F.col("_cap")))
    return w.select("source", "source_size", target.alias("target"))


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many documents of each length to take so that their words come as near below ``budget`` as can be.

    Every length first gives the same share of its documents, rounded down, then one more each from
    the longest down until ``dp_words`` are left; the rest is a bounded knapsack over all sums.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    take = np.floor(counts * (budget / total)).astype(np.int64)
    rest = budget - int((lengths * take).sum())
    while rest < 0:  # rounding of the share
        i = int(np.argmax(take * lengths))
        take[i] -= 1
        rest += int(lengths[i])
    for i in np.argsort(-lengths, kind="stable"):
        if take[i] < counts[i] and lengths[i] > 0 and rest - lengths[i] >= dp_words:
            take[i] += 1
            rest -= int(lengths[i])
    reach = np.zeros(rest + 1, bool)
    reach[0] = True
    via = np.full(rest + 1, -1, np.int32)
    items: list[tuple[int, int]] = []
    for i in np.argsort(lengths, kind="stable"):
        length = int(lengths[i])
        left = min(int(counts[i] - take[i]), rest // length if length else 0)
        k = 1
        while left > 0 and not reach[rest]:
            k = min(k, left)
            step = length * k
            new = np.zeros(rest + 1, bool)
            new[step:] = reach[:-step] & ~reach[step:]
            via[new] = len(items)
            reach |= new
            items.append((int(i), k))
            left -= k
            k *= 2
        if reach[rest]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at > 0:  # the item that first reached a sum came after those of what is left
        i, k = items[via[at]]
        take[i] += k
        at -= int(lengths[i]) * k
    return take


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    passes = min(int(target // size), MOST) if size else 0
    budget = int(round(target - passes * size)) if passes < MOST else 0
    extra = fit_budget(rows["size"].to_numpy(), rows["n"].to_numpy(), budget)
    return pd.DataFrame({"source": rows["source"], "size": rows["size"], "source_size": size, "target": target, "passes": passes, "extra": extra})


def mix(sized: DataFrame, key: str = "doc_id", seed: int = SEED, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """``sized`` (with source and size) plus source_size, target and copies (0, 1 or 2 takes of the row).

    The same rows and seed give the same mix. Repeated rows are rows of their own; among equal ones
    any may be picked, which gives the same result. A null source is a source, a null size is 0, a
    null key is ranked like any other. A source without words gets target 0 and no copy. An empty
    table gives an empty result. Columns named source_size, target or copies are replaced, all
    others stay.
    """
    rows = sized.drop("source_size", "target", "copies").withColumn("size", F.coalesce("size", F.lit(0)).cast("bigint"))
    targets = source_targets(rows.select("source", "size"), weights, share)
    counted = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    t = targets.withColumnRenamed("source", "_s")
    plan = (
        counted.join(t, same(F.col("source"), F.col("_s"))).drop("_s")
        .groupBy("source").applyInPandas(_fit_source, "source string, size long, source_size long, target double, passes int, extra long")
    )
    rank = F.xxhash64(F.col(key), F.lit(seed))
    salt = F.shiftright(rank, 64 - SALT_BITS).cast("int")
    parts = rows.groupBy("source", "size", salt.alias("_salt")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("source", "size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    quota = parts.join(plan.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "source_size", "target", "passes", "extra"), same(F.col("source"), F.col("_s")) & (F.col("size") == F.col("_z")))
    quota = quota.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_salt").alias("_q"), "source_size", "target", "passes", (F.col("extra") - F.col("_before")).alias("_quota"))
    r = rows.withColumn("_rank", rank).withColumn("_salt", salt)
    met = r.join(quota, same(F.col("source"), F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("_salt") == F.col("_q")))
    nth = F.row_number().over(Window.partitionBy("source", "size", "_salt").orderBy("_rank", key))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("passes") + F.when(F.col("_nth") <= F.col("_quota"), 1).otherwise(0))
    return met.withColumn("_nth", nth).select(*[F.col(f"`{c}`") for c in rows.columns], "source_size", "target", copies.cast("int").alias("copies"))


def mixed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; a column named size is kept as it was."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(key).alias("_key"), "source", token_length(F.col(text)).alias("size"))
    picked = mix(inner, "_key", seed)
    return picked.where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
