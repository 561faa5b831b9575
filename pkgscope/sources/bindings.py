"""Load the driver tables and the package-shaped binding views over them."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

from pkgscope.sources.bindings_sql import BINDINGS, DRIVER_TABLES


_registered: dict[tuple[int, str], str] = {}


def tables_of(sql: str) -> list[str]:
    """Driver tables named in a binding SQL text."""
    words = set(re.findall(r"[a-z_]+", sql.lower()))
    return [t for t in DRIVER_TABLES if t in words]


def register_tables(spark: SparkSession, sf_dir: str, names=DRIVER_TABLES) -> None:
    """Register driver parquet tables as temp views of the same name.  A view
    already registered for the same folder in this session is kept (the scan
    plan is the same), so repeated bindings do not re-list files."""
    for name in names:
        key = (id(spark), name)
        if _registered.get(key) == sf_dir and spark.catalog.tableExists(name):
            continue
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            spark.read.parquet(path).createOrReplaceTempView(name)
            _registered[key] = sf_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def dealt_out(df: DataFrame, rows: int) -> DataFrame:
    """Rows that are about to grow, dealt out evenly: ``rows`` a task at most,
    so that tasks stay small however large the table is, over all cores at least."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)))


def binding(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Run one binding SQL over the tables of ``sf_dir``.

    The views are (re)registered first; the returned DataFrame keeps the
    plan it was analysed with, so later re-registration for another scale
    does not change it.
    """
    register_tables(spark, sf_dir, tables_of(BINDINGS[name]))
    return spark.sql(BINDINGS[name])


def order_lines(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """:func:`binding` of a table grouped and numbered by order (b_param_old,
    b_param_new): the lines of an order meet once, before they are grouped, so
    that grouping by part and numbering within the order need no more shuffles."""
    lines = table(spark, sf_dir, "lineitem").repartition("l_orderkey")
    return spark.sql(BINDINGS[name].replace("FROM lineitem", "FROM {lines}"), lines=lines)


def binding_cte(*names: str) -> str:
    """``WITH`` clause holding the given bindings, for oracle SQL."""
    parts = [f"{n} AS ({BINDINGS[n].strip()})" for n in names]
    return "WITH " + ",\n".join(parts)
