"""Session defaults and the shared folder for tables that several jobs read."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "rollbook", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here expects.

    Cluster size, memory and shuffle partitions stay with the submitter; adaptive execution
    picks the partition counts, splits skewed joins and coalesces small partitions.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read, named by the cluster in spark.checkpoint.dir.

    Only a local master may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="rollbook-")
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new folder that every executor can read, and read back."""
    path = f"{shared_dir(df.sparkSession)}/{df.sparkSession.sparkContext.applicationId}/staged/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """A write or collect in here drops its shuffle files when it ends; else they stay until the driver next collects garbage.

    For results that are read once: running a plan again that ran in here shuffles again.
    """
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, before)


_written: dict[tuple[str, str], str] = {}


def written_table(
    spark: SparkSession, scope: str, name: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """Write ``build()`` once per application and scope, then read it back.

    Used for the few tables that most jobs share (citizens, flags, clusters). The written copy
    cuts the lineage, survives lost executors and lets later reads prune columns and push filters.
    """
    app = spark.sparkContext.applicationId
    key = (app, f"{scope}|{name}")
    if key not in _written:
        tag = hashlib.sha256(scope.encode()).hexdigest()[:12]
        path = f"{shared_dir(spark)}/{app}/{tag}/{name}"
        build().write.mode("overwrite").parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])
