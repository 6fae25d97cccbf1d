"""Spark session set-up and shared-folder helpers.

Jobs never invent a machine-local scratch path: intermediate tables go below
``spark.checkpoint.dir`` as the cluster names it. Without that setting a local
master (tests) gets a folder of its own; on a cluster the job stops with a message.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_FREE_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(
    master: str = "local[8]",
    shuffle_partitions: int = 8,
    app_name: str = "fablake",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session with the settings every job in this package assumes."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # duplicate CSV header names keep the last cell, as a dict zip does
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        # a repeated key of a JSON object keeps its last value, as a dict does
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        # the JVM never compiles a longer method: such stages are compiled operator by operator instead
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.chunkBase64String.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set one only where none is configured."""
    current = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    # only one process sees a folder of its own: right for a local master, wrong on a cluster
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="fablake-ckpt-")
    spark.conf.set(_CHECKPOINT_KEY, local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", f"{name}-{uuid.uuid4().hex[:12]}")


@contextmanager
def conf_set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Within it the session has this setting; afterwards the one it had."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shuffles_freed(spark: SparkSession) -> AbstractContextManager[None]:
    """Within it a query's shuffle files are deleted when the query has ended, not when the driver's next garbage collection
    finds them unused. For writes: their plan runs once."""
    return conf_set(spark, _FREE_KEY, "true")


def unsorted_writes(spark: SparkSession, writers: int) -> AbstractContextManager[None]:
    """Within it a task keeps up to so many partitions' files open at a time, and sorts its rows by partition only beyond that:
    rows of one or a few partitions would be sorted, and spilled, for nothing."""
    return conf_set(spark, "spark.sql.maxConcurrentOutputFileWriters", str(writers))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin a scan that yields fewer partitions than the cluster has cores.

    A single-row-group Parquet file is read as one task; CPU-heavy per-row
    work (parsing, validation, tokenising) would then run on one core. At
    scale the input already has many partitions and this is a no-op.
    """
    from pyspark.sql import functions as F

    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        # hash of the whole row: deterministic on retry, and no local sort as a
        # round-robin repartition needs for that
        return df.repartition(target, F.xxhash64(*[F.col(c) for c in df.columns]))
    return df
