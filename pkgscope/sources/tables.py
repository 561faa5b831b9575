"""Result tables as partitioned Parquet or CSV in shared storage: catalogues by
mode, failed modules, version statistics, usage, reports and work lists.

Every table is one folder.  A write replaces only the partitions it has rows
for, so a repeated write of the same rows leaves the same table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgscope.session import ensure_checkpoint_dir

MODES = ("static", "dynamic")
STDLIB = "stdlib"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one table in the folder the cluster shares."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Parquet partitioned by ``by`` (S8, S10, S17, S18, S19).  Rows are
    rebalanced by the partition columns first: few files a partition, and a
    hot partition is split over several tasks."""
    if by:
        df = df.hint("rebalance", *by)
    df.write.option("partitionOverwriteMode", "dynamic").partitionBy(*by).mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A written table (S9, S10, S12, S18); the schema keeps partition values
    text, so that a version ``1.0`` stays one.  A missing table raises."""
    return spark.read.schema(schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Report or work list with a header line."""
    df.write.csv(path, header=True, mode="overwrite")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


# ------------------------------------------------------------------ catalogues by mode

CATALOGUE = "pkg string, ver string, mode string, top_level string, key string, kind string"


def write_catalogue(rows: DataFrame, path: str) -> None:
    """Rows of ``CATALOGUE``, by package and mode; top levels that hold a slash are left out."""
    write_table(rows.where(~F.col("top_level").contains("/")), path, ("pkg", "mode"))


def read_catalogue(spark: SparkSession, path: str, mode: str = "static", pkg: str | None = None, ver: str | None = None) -> DataFrame:
    """Catalogue of one mode, or of one package version in it.  Reads
    only the partitions asked for; an absent package version raises."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    rows = read_table(spark, path, CATALOGUE).where(F.col("mode") == mode)
    if pkg is not None:
        rows = rows.where(F.col("pkg") == pkg)
    if ver is not None:
        rows = rows.where(F.col("ver") == ver)
    if (pkg or ver) and rows.isEmpty():
        raise ValueError(f"no {mode} catalogue of {pkg} {ver}")
    return rows


def name_list(catalogue: DataFrame) -> DataFrame:
    """Distinct names of each top level, numbered in order (a package's names only)."""
    names = catalogue.select("pkg", "ver", "mode", "top_level", "key").distinct()
    return names.orderBy("pkg", "ver", "mode", "top_level", "key")


def stdlib_modules(modules: DataFrame) -> DataFrame:
    """Modules (ver, module, ...) of interpreter source trees without
    ``test`` and without Python 2 releases, as rows of package ``stdlib``."""
    top = F.split_part("module", F.lit("."), F.lit(1))
    return modules.where((top != "test") & ~F.col("ver").startswith("2.")).withColumn("pkg", F.lit(STDLIB)).withColumn("top_level", top)


def stdlib_versions(catalogue: DataFrame) -> DataFrame:
    """Interpreter versions with a catalogue."""
    return catalogue.where(F.col("pkg") == STDLIB).select("ver").distinct()


# ------------------------------------------------------------------ statistics

def version_statistics(releases: DataFrame, requires: DataFrame, wheels: DataFrame, static: DataFrame) -> DataFrame:
    """One row per release (package, version, time) with its requirement
    texts, chosen wheel and static summary; each side has at most one row a
    version, but for the requirements, which are gathered per version."""
    key = ["package", "version"]
    reqs = requires.groupBy(*key).agg(F.sort_array(F.collect_list("requires_dist")).alias("requires_dist"))
    return releases.join(reqs, key, "left").join(wheels, key, "left").join(static, key, "left") \
        .withColumn("apis_dynamic", F.lit(None).cast("bigint"))


def merge_dynamic(stats: DataFrame, dynamic: DataFrame) -> DataFrame:
    """Dynamic summaries (package, version, apis) put into the
    statistics by version; packages that have any already are left alone."""
    done = stats.where(F.col("apis_dynamic").isNotNull()).select("package").distinct()
    fresh = dynamic.join(done, "package", "left_anti").withColumnRenamed("apis", "_apis")
    return stats.join(fresh, ["package", "version"], "left").withColumn("apis_dynamic", F.coalesce("_apis", "apis_dynamic")).drop("_apis")


def availability(projects: DataFrame, stats: DataFrame) -> DataFrame:
    """Per project whether any version has metadata, requirements and
    static or dynamic catalogues."""
    some = lambda c: F.max(F.col(c).isNotNull().cast("int"))
    have = stats.groupBy("package").agg(F.lit(1).alias("m"), some("requires_dist").alias("r"), some("apis_static").alias("s"), some("apis_dynamic").alias("d"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(0)) == 1
    return projects.join(have, "package", "left").select(
        "package", flag("m").alias("has_metadata"), flag("r").alias("has_req"), flag("s").alias("has_api"), flag("d").alias("has_dynamic_api"))


def unfinished(keys: DataFrame, finished: DataFrame, on: list[str]) -> DataFrame:
    """Keys without a row in the finished table."""
    return keys.join(finished.select(*on), on, "left_anti")


def dependents(usage: DataFrame, packages: DataFrame) -> DataFrame:
    """Usage rows of all dependents of the packages (u_pkg)."""
    return usage.join(packages.select("u_pkg").distinct(), "u_pkg", "left_semi")
