"""Spark session settings used by the library, tests and bench.

The library never creates a session on its own inside an operator; callers pass one in.
``build_session`` is for local runs (tests, bench). On a cluster the job's own session is
used and only ``configure`` is applied, which sets SQL options that do not depend on the
deployment (time zone, AQE) and never overrides what the cluster already decided.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Options every query relies on. Time zone: all timestamps are zone-less (TIMESTAMP_NTZ)
# and compared as wall-clock UTC; pinning the session zone keeps date_format/date_trunc stable.
SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast only what AQE measured at runtime to be below this size; above it the join
    # falls back to a shuffled hash / sort-merge join. No hard-coded broadcast hints.
    # 10 MB of rows are up to 42 MB as a hash table on the driver. Jobs in rounds or levels hold a dozen at once, joined after both
    # sides are shuffled already: there the limit is lower, since a broadcast saves only the sort.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "2MB",
    "spark.sql.autoBroadcastJoinThreshold": "10MB",
    # Before a scan has run, its size is guessed from the bytes of its files. Parquet packs sorted keys and few-valued columns
    # into a few bytes a row; as rows in a hash table they take some 12 times as much. Without this factor millions
    # of narrow rows pass for 10 MB and are collected on the driver; with it, larger tables wait for AQE's measured size.
    "spark.sql.sources.fileCompressionFactor": "12.0",
    # Streaming state in RocksDB (off-heap, spills to local disk, checkpointed to the shared
    # checkpoint folder) instead of the JVM-heap map of the default provider.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A commit writes the batch's changes and not the whole state; whole snapshots are written now and then, beside the stream. Rows are
    # not counted, which costs a read before each write.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply SQL defaults that are not already set by the deployment."""
    conf = spark.conf
    for key, value in SQL_DEFAULTS.items():
        if key in ("spark.sql.session.timeZone",):
            conf.set(key, value)
        elif conf.get(key, None) is None:
            conf.set(key, value)
    return spark


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "studyhall", extra: dict | None = None) -> SparkSession:
    """Local session for tests and bench (UI off, no server opened beyond Spark's own)."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("STUDYHALL_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in SQL_DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return configure(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS/S3/...); it is read and never
    replaced, and its absence is an error, since a folder of one machine would be another one on
    each executor. Only a ``local`` master (tests, bench) gets a fresh scratch folder when it is unset.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="studyhall-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Inside, the shuffle files of a statement are deleted when it ends, and not at some later collection of the driver's garbage.
    For writes whose result is read back from its files: their plans never run again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def remove_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_inside = threading.local()


@contextmanager
def stored_for_now(spark: SparkSession):
    """Tables ``stored`` inside are deleted at the end: for a step whose result is written before that, such as a micro-batch."""
    outer, _inside.paths = getattr(_inside, "paths", None), []
    try:
        yield
    finally:
        paths, _inside.paths = _inside.paths, outer
        for path in paths:
            remove_folder(spark, path)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a parquet table below the shared checkpoint folder and read it back.

    Cuts lineage as ``cut_lineage`` does, for loops whose every round builds on the one before: a checkpoint hands the
    optimizer's inferred constraints on, and over several rounds they multiply; a table has none.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    if getattr(_inside, "paths", None) is not None:
        _inside.paths.append(path)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
