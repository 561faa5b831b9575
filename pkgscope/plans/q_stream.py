"""Streaming queries (T1, T2): the binding rows land as several files and
are processed incrementally; the result table must equal the batch answer."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from pkgscope.plans.q_source import sources
from pkgscope.plans.q_usage import USAGE_SQL, usage_matches
from pkgscope.plans.registry import ORACLES, register
from pkgscope.streaming import incremental as T


def _half(files: int) -> int:
    """The files arrive as two batches."""
    return -(-files // 2)


def q_t1(spark, sf_dir):
    base = T.work_dir(spark, "t1")
    landing = os.path.join(base, "landing")
    files = T.stage_files(sources(spark, sf_dir), landing, 4, "module")
    out = os.path.join(base, "entities")
    T.incremental_catalogue(spark, landing, out, os.path.join(base, "checkpoint"), max_files_per_trigger=_half(files))
    return spark.read.parquet(out).select("module", "name", "key", "kind", "full_alias")


def q_t2(spark, sf_dir):
    base = T.work_dir(spark, "t2")
    landing = os.path.join(base, "landing")
    files = T.stage_files(usage_matches(spark, sf_dir), landing, 4, "c_pkg", "src_file")
    out = os.path.join(base, "usage")
    T.incremental_usage(spark, landing, out, os.path.join(base, "checkpoint"), max_files_per_trigger=_half(files))
    return T.usage_totals(spark, out)


def q_t2_again(spark, sf_dir):
    """T2 with a guard: half of the files, a compaction, then all files, the first ones again."""
    base = T.work_dir(spark, "t2")
    landing, out, state = (os.path.join(base, n) for n in ("landing", "usage", "checkpoint"))
    rows = usage_matches(spark, sf_dir)
    first = rows.where(F.xxhash64("c_pkg", "src_file") % 2 == 0)
    files = T.stage_files(first, landing, 4, "c_pkg", "src_file")
    T.incremental_usage(spark, landing, out, state, max_files_per_trigger=_half(files), row_key=rows.columns)
    T.compact_usage(spark, out)
    files = T.stage_files(rows, landing, 4, "src_file", "api", mode="append")
    T.incremental_usage(spark, landing, out, state, max_files_per_trigger=_half(files), row_key=rows.columns)
    return T.usage_totals(spark, out)


register("T1_incremental_catalogue", ORACLES["E13_entities"])(q_t1)
register("T2_incremental_usage", ORACLES["U1_api_usage"].replace(
    "count(*) AS files, CAST(sum(n_lines) AS BIGINT) AS calls,\n       array_to_string(list_sort(list_distinct(list(chain))), '|') AS patterns",
    "count(*) AS files, CAST(sum(n_lines) AS BIGINT) AS calls"))(q_t2)
register("T2_usage_landed_twice", USAGE_SQL + """
SELECT c_pkg, u_pkg, u_ver, api, count(*) AS files, CAST(sum(n_lines) AS BIGINT) AS calls
FROM (SELECT DISTINCT c_pkg, c_ver, u_pkg, dep_ver AS u_ver, api, src_file, n_lines, chain, status, message FROM b_usage)
WHERE status = 'MATCH' GROUP BY c_pkg, u_pkg, u_ver, api""")(q_t2_again)
