"""Structured Streaming forms of the incremental loops (STR).

Every job reads files as they arrive, keeps its place in a checkpoint and merges each batch into
a keyed table by batch id, so a replay after a lost driver or executor changes nothing. A batch
rewrites only the leaves of its keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.conditions import SIGNALS, learn_signals, merge_signals
from ..operators.graph import PAYOUT_KEYS, ROW_ORDER, payout_keys
from ..session import staged
from ..sources.keyed import group_into, matching, upsert_into

FILES_PER_BATCH = 64
WINDOWS = {"24H": "24 hours", "7D": "7 days", "30D": "30 days"}


def file_stream(spark: SparkSession, path: str, schema, name: str | None = None, files: int = FILES_PER_BATCH) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return (reader.option("pathGlobFilter", name) if name else reader).parquet(path)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there, however long it takes, then stop. The next run goes on from the checkpoint."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def _newest_by(df: DataFrame, keys: list[str], cols: list[str], latest: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), latest).alias("r")).select(*keys, "r.*")


def stream_sync(profiles: DataFrame, target: str, checkpoint: str) -> None:
    """Profile rows into one row per enrollment key; a later row in profile order wins."""
    def each(batch: DataFrame, batch_id: int) -> None:
        cols = [c for c in batch.columns if c != "enrollment_key"]
        newest = lambda df: _newest_by(df, ["enrollment_key"], cols, F.struct(*ROW_ORDER))
        # files can arrive out of order: the newest of both sides stays. The batch goes in as it is, so its keys are shuffled once, with the old rows
        upsert_into(batch, target, ["enrollment_key"], batch_id, lambda old, new: newest(old.unionByName(new)))

    run_available(profiles, each, checkpoint)


def stream_payouts(payments: DataFrame, target: str, checkpoint: str) -> None:
    """Payments into payout windows: count, sum and latest payment by ``PAYOUT_KEYS``, in any order of arrival.

    All three add up over batches, so the state of a window is one row, however many payments it has.
    """
    amount = F.coalesce(F.sum("total_amount"), F.lit(0)).cast("decimal(38,2)").alias("total_amount")

    def added(df: DataFrame, by: list[str]) -> DataFrame:
        return df.groupBy(*by).agg(F.sum("transaction_count").alias("transaction_count"), amount, F.max("latest").alias("latest"))

    def each(batch: DataFrame, batch_id: int) -> None:
        latest = F.struct("transaction_timestamp", "source_sl_no", "transaction_ref_no").alias("latest")
        rows = batch.select(*PAYOUT_KEYS, F.lit(1).cast("long").alias("transaction_count"), F.col("amount").cast("decimal(38,2)").alias("total_amount"), latest)
        # added up once, together with the old windows, where they are written; an enrollment has a window a month, so they may lie together
        group_into(rows, target, PAYOUT_KEYS, batch_id, added, PAYOUT_KEYS[:3])

    run_available(payments, each, checkpoint)


def payout_rows(state: DataFrame) -> DataFrame:
    """Payout windows from the state of ``stream_payouts``, in the columns of ``payout_windows``."""
    return state.select(
        *PAYOUT_KEYS, "transaction_count", F.col("total_amount").cast("decimal(28,2)").alias("total_amount"),
        F.col("latest.transaction_timestamp").alias("latest_transaction_timestamp"), F.col("latest.transaction_ref_no").alias("latest_transaction_ref_no"))


def payouts_of(enrollments: DataFrame, state: DataFrame) -> DataFrame:
    """Payout windows of enrollments that the sync knows, with their enrollment and payout month keys."""
    # a task's keys are few and small beside its windows, which thus need no sort
    return payout_keys(payout_rows(state)).join(enrollments.select("enrollment_key").hint("shuffle_hash"), "enrollment_key", "left_semi")


def _unseen(batch: DataFrame, seen: str, keys: list[str], batch_id: int) -> DataFrame:
    """Rows of a batch whose key no earlier batch brought; the key table ``seen`` learns them.

    The keys known before the batch are read, so a batch that is run again finds the same rows new.
    The new rows are written once: the key table and the counts read them several times.
    """
    old = matching(batch, seen, keys, batch_id)
    fresh = staged(batch if old is None else batch.join(old, keys, "left_anti"), "fresh")
    # none of these keys is in the table, so they are added without a join
    upsert_into(fresh.select(*keys), seen, keys, batch_id, lambda known, new: known.unionByName(new))
    return fresh


def stream_signals(observations: DataFrame, target: str, checkpoint: str) -> None:
    """Counters of unmapped fields, promoted when frequent. A document counts once per field, in however many batches it comes.

    The pairs (field, document) seen so far are a keyed table beside the counters.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        keys = ["field_key", "doc_id"]
        pairs = batch.where("field_key IS NOT NULL AND doc_id IS NOT NULL").groupBy(*keys).agg(F.max("quote").alias("quote"))
        fresh = _unseen(pairs, f"{target}-seen", keys, batch_id)
        empty = batch.sparkSession.createDataFrame([], SIGNALS)
        # a pair that comes again counts nothing, but may bring the quote of the latest document
        known = learn_signals(empty, pairs).withColumn("occurrence_count", F.lit(0).cast("long"))
        new = learn_signals(known, fresh)
        upsert_into(new, target, ["field_key"], batch_id, lambda old, now: merge_signals(old.unionByName(now)))

    run_available(observations, each, checkpoint)


def stream_reviews(reviews: DataFrame, target: str, checkpoint: str) -> None:
    """Latest review per decision, however late it comes; a review delivered twice changes nothing."""
    cols = ["review_id", "action", "note", "reviewed_at"]

    def newest(df: DataFrame) -> DataFrame:
        return _newest_by(df, ["decision_id"], cols, F.struct("reviewed_at", "review_id"))

    def each(batch: DataFrame, batch_id: int) -> None:
        upsert_into(batch.select("decision_id", *cols), target, ["decision_id"], batch_id, lambda old, new: newest(old.unionByName(new)))

    run_available(reviews, each, checkpoint)


def window_counts(flags: DataFrame, length: str, slide: str = "1 day") -> DataFrame:
    """Flags per rule in sliding windows."""
    w = flags.groupBy(F.window("detected_at", length, slide), "rule").agg(F.count("*").alias("flags"))
    return w.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "rule", "flags")


def stream_recent_flags(flags: DataFrame, target: str, checkpoint: str, span: str = "24H") -> None:
    """Sliding flag counts per (rule, window); a late flag adds to its old windows, one delivered again (by ``flag_id``) to none."""
    keys = ["rule", "window_start", "window_end"]

    def each(batch: DataFrame, batch_id: int) -> None:
        fresh = _unseen(batch.dropDuplicates(["flag_id"]), f"{target}-seen", ["flag_id"], batch_id)
        added = lambda old, new: old.unionByName(new).groupBy(*keys).agg(F.sum("flags").alias("flags"))
        upsert_into(window_counts(fresh, WINDOWS[span]), target, keys, batch_id, added)

    run_available(flags, each, checkpoint)


__all__ = [
    "file_stream", "payout_rows", "payouts_of", "run_available", "stream_payouts", "stream_recent_flags", "stream_reviews", "stream_signals", "stream_sync", "window_counts",
]
