"""A file landed twice counts once, and totals go on from a compaction."""

import os

from pkgscope.streaming import incremental as T

ROWS = "c_pkg string, u_pkg string, u_ver string, api string, src_file string, chain string, status string, n_lines int"


def totals(spark, out):
    return sorted(map(tuple, T.usage_totals(spark, out).collect()))


def test_landing_again_and_compaction(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("landing", "usage", "state"))
    first = spark.createDataFrame([("c", "u", "1", "u.f", "a.py", "u.f(*)", "MATCH", 2), ("c", "u", "1", "u.f", "b.py", "u.f()", "MATCH", 1), ("c", "u", "1", None, "b.py", "u.g", "MISSING", 9)], ROWS)
    second = spark.createDataFrame([("c", "u", "1", "u.h", "c.py", "u.h", "MATCH", 5), ("c", "u", "1", "u.f", "c.py", "u.f()", "MATCH", 4)], ROWS)
    key = ["c_pkg", "src_file", "chain"]
    run = lambda: T.incremental_usage(spark, landing, out, state, row_key=key)
    T.stage_files(first, landing, 1, "c_pkg")
    run()
    assert totals(spark, out) == [("c", "u", "1", "u.f", 2, 3)]
    upto = T.compact_usage(spark, out)
    assert T.compact_usage(spark, out) == upto and totals(spark, out) == [("c", "u", "1", "u.f", 2, 3)]
    T.stage_files(first, landing, 1, "c_pkg", mode="append")
    run()
    assert totals(spark, out) == [("c", "u", "1", "u.f", 2, 3)]
    T.stage_files(second, landing, 1, "c_pkg", mode="append")
    run()
    want = [("c", "u", "1", "u.f", 3, 7), ("c", "u", "1", "u.h", 1, 5)]
    assert totals(spark, out) == want
    assert T.compact_usage(spark, out) > upto and totals(spark, out) == want
    plan = T.usage_totals(spark, out)._jdf.queryExecution().executedPlan().toString()
    assert "batch" in plan and "PartitionFilters: [isnotnull(batch" in plan  # folders before the compaction are not read
    assert os.path.isdir(out + "-compact")
