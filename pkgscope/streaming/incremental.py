"""Incremental jobs (T1, T2) with Structured Streaming.

T1: new module source files are parsed and appended to the catalogue table
exactly once (file source + checkpoint + ``availableNow`` + ``foreachBatch``).
T2: per-API usage totals kept up to date as new match rows arrive
(streaming aggregation; each trigger rewrites the result table).

Both write to tables under a shared folder (the cluster's
``spark.checkpoint.dir``), never to the driver.
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgscope.operators import catalog as K
from pkgscope.operators import parse as P
from pkgscope.session import ensure_checkpoint_dir, share_filled
from pkgscope.sources.bindings import dealt_out


USAGE_KEYS = ["c_pkg", "u_pkg", "u_ver", "api"]


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, "streams", f"{name}-{uuid.uuid4().hex[:12]}")
    return path


#: So many rows at most are meant to stand in one landing file: one task writes it.
FILE_ROWS = 1_000_000

#: State that outgrows the heap: RocksDB keeps it on the executors' disks, within one bound of memory for all its stores.
ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


def stage_files(df: DataFrame, path: str, parts: int, *keys: str, mode: str = "overwrite") -> int:
    """Write ``df`` as ``parts`` files (arriving batches of a landing folder),
    more if they would be large -> number of files."""
    files = max(parts, -(-df.count() // FILE_ROWS))
    df.repartition(files, *keys).write.mode(mode).parquet(path)
    return files


def _landing_stream(spark: SparkSession, landing: str, max_files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.schema(spark.read.parquet(landing).schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(landing)


def _write_batch(df: DataFrame, out: str, batch_id: int) -> None:
    """A micro-batch owns the folder of its id: a replay replaces it."""
    df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")


def incremental_catalogue(spark: SparkSession, landing: str, out: str, checkpoint: str,
                          max_files_per_trigger: int | None = None) -> None:
    """Parse every not-yet-seen source file of ``landing`` (pkg, ver,
    module, src) and add its entities to ``out`` exactly once: the stream's
    checkpoint records the files of each batch, and a replayed batch
    overwrites its own folder."""
    stream = _landing_stream(spark, landing, max_files_per_trigger)

    def batch(df: DataFrame, batch_id: int) -> None:
        # a batch may be a few large files; parsed once per micro-batch, read by several branches
        rows = share_filled(P.parse_sources(dealt_out(df, 20000)))
        try:
            _write_batch(K.build_entities(rows).select("pkg", "ver", "module", "name", "key", "kind", "full_alias"), out, batch_id)
        finally:
            rows.unpersist()

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def incremental_usage(spark: SparkSession, landing: str, out: str, checkpoint: str,
                      max_files_per_trigger: int | None = None, row_key: list[str] | None = None) -> None:
    """Usage totals per (client, upstream version, API) over all match
    rows seen so far (state = one row per group, the size of the result).  A
    batch writes only the groups it changed; :func:`usage_totals` reads the
    newest row of each group.  With ``row_key`` (such as client, file and
    chain) a match row counts once however often its file lands; the keys seen
    are state too, the size of the distinct input, and stand on disk (a
    stream begun with another kind of state store goes on with it)."""
    stream = _landing_stream(spark, landing, max_files_per_trigger)
    if row_key:
        stream = stream.dropDuplicates(row_key)
    agg = (
        stream.where(F.col("status") == "MATCH")
        .groupBy(*USAGE_KEYS)
        .agg(F.count(F.lit(1)).alias("files"), F.sum("n_lines").cast("bigint").alias("calls"))
    )

    def batch(df: DataFrame, batch_id: int) -> None:
        _write_batch(df, out, batch_id)

    before = {k: spark.conf.get(k, None) for k in ON_DISK}
    try:
        for k, v in ON_DISK.items() if row_key else ():
            spark.conf.set(k, v)
        q = agg.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint) \
            .trigger(availableNow=True).start()  # takes the session's settings along
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    q.awaitTermination()


def usage_totals(spark: SparkSession, out: str) -> DataFrame:
    """T2's table: the totals of the newest batch that changed each group,
    from the last compaction and the batches after it."""
    batches, (base, upto) = spark.read.parquet(out), _compacted(spark, out)
    if base is not None:  # folders up to there are pruned by their names
        batches = batches.where(F.col("batch") > upto).unionByName(base.withColumn("batch", F.lit(upto)))
    newest = F.max_by(F.struct("files", "calls"), "batch").alias("_t")
    return batches.groupBy(*USAGE_KEYS).agg(newest).select(*USAGE_KEYS, "_t.*")


def _compacted(spark: SparkSession, out: str) -> tuple[DataFrame | None, int]:
    """The last compaction and the batch up to which it goes."""
    try:
        upto = max(_numbers(spark.read.parquet(f"{out}-compact"), "upto"))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None, -1
    return spark.read.parquet(f"{out}-compact/upto={upto}"), upto


def _numbers(df: DataFrame, folder: str) -> set[int]:
    """The numbers in the names of a table's folders; no file is read."""
    return {int(n) for path in df.inputFiles() for n in re.findall(rf"/{folder}=(\d+)/", path)}


def compact_usage(spark: SparkSession, out: str) -> int:
    """Write the totals so far as one table beside the batches, under the
    number of the last batch in it, from which :func:`usage_totals` goes on.
    A repeated or broken run replaces its own folder only; batches stay where
    they are for readers of an earlier state.  Run it while no stream writes."""
    upto = max(_numbers(spark.read.parquet(out), "batch"))
    if upto > _compacted(spark, out)[1]:
        usage_totals(spark, out).write.mode("overwrite").parquet(f"{out}-compact/upto={upto}")
    return upto
