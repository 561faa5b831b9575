"""Session helpers: building a local session for tests/bench and choosing
where lineage-cutting checkpoints go."""

from __future__ import annotations

import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "pkgscope") -> SparkSession:
    """A local session configured like the tests and the bench expect."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, honouring ``spark.checkpoint.dir``.

    On a cluster the directory must be shared storage named by the
    cluster's own ``spark.checkpoint.dir``; we only fall back to a fresh
    temporary folder when running in local mode (tests, bench).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="pkgscope-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return configured


#: Seconds between two collections of the driver's heap, and when the last one was.
SWEEP_S = 10.0
_swept = time.monotonic()


def sweep(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and checkpoints that nobody can read
    any more.  It does so when the driver's heap is collected, which a large
    heap with few objects puts off until the files of a whole run have piled
    up on the executors' disks."""
    global _swept
    if time.monotonic() - _swept >= SWEEP_S:
        spark.sparkContext._jvm.java.lang.System.gc()
        _swept = time.monotonic()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss, unlike localCheckpoint)."""
    sweep(df.sparkSession)
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def share(df: DataFrame) -> DataFrame:
    """Keep an intermediate that several consumers of one plan read
    (MEMORY_AND_DISK).  Lost blocks are recomputed from lineage, so a lost
    executor costs time, not correctness; iterative loops use
    :func:`cut_lineage` instead, which bounds the lineage itself."""
    from pyspark import StorageLevel

    return df.persist(StorageLevel.MEMORY_AND_DISK)


def share_filled(df: DataFrame) -> DataFrame:
    """:func:`share`, filled by one job before anything reads it.  The readers
    of one plan start at the same time, and where a partition is still being
    made on another executor they make it again: a parse ran up to twice."""
    sweep(df.sparkSession)
    kept = share(df)
    kept.count()
    return kept


def share_placed(df: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`share_filled`, dealt out and sorted by ``keys``.  The partitioning
    of kept rows is known to the planner (that of a checkpoint is not), so
    joins and groupings by the keys move and sort only what they are joined
    with, however often the table is read.  For keys that occur once, or a
    few times, in the table."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return share_filled(df.repartition(n, *keys).sortWithinPartitions(*keys))


def measured_joins(spark: SparkSession) -> None:
    """Leave broadcasts in this session to adaptive execution, which knows the
    sizes of what was shuffled.  The estimate made beforehand counts neither
    rows that are exploded nor rows that Python makes, and a checkpoint keeps
    it; a join on such rows would send them whole through the driver.  The
    session's bound stays the same, hints keep working."""
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if not bound.startswith("-"):
        if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", bound)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
