"""Parsed rows are made once, in small tasks, and stay where they are if no version is spoiled."""

import contextlib
import io

from pyspark.sql import functions as F

from pkgscope.operators import catalog as K
from pkgscope.operators import parse as P
from pkgscope.plans import q_source, q_tree
from pkgscope.sources.bindings import dealt_out

SF0001 = "/root/testdata/sf0.001"


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def _rows(spark, text_of_b):
    src = spark.range(6).select(F.concat(F.lit("p"), F.col("id") % 3).alias("pkg"), F.lit("1.0").alias("ver"), F.concat(F.lit("m"), "id").alias("module"),
                                F.when(F.col("id") == 1, text_of_b).otherwise("V = 1\n").alias("src"))
    return P.parse_sources(src)


def test_parsed_rows_are_kept_before_anything_reads_them(spark):
    for rows in (q_source.parsed, q_source.client_events, q_tree.tree_rows):
        kept = rows(spark, SF0001)
        cached = kept._jdf.queryExecution().withCachedData().collectLeaves().head()
        assert cached.cacheBuilder().isCachedColumnBuffersLoaded()
        kept.unpersist()


def test_rows_without_a_spoiled_version_are_not_shuffled(spark):
    rows = _rows(spark, "V = 2\n").persist()
    assert "Exchange" not in _plan(K.usable_rows(rows)).split("InMemoryRelation")[0]
    assert K.usable_rows(rows).where("rkind = 'variable'").count() == 6


def test_few_and_many_spoiled_versions_give_the_same_rows(spark, monkeypatch):
    rows = _rows(spark, "a, b = [1]\n").persist()
    few = K.usable_rows(rows)
    assert "BroadcastHashJoin" in _plan(few)
    monkeypatch.setattr(K, "FEW_SPOILED", 0)
    many = K.usable_rows(rows)
    named = [sorted((r.pkg, r.module, r.rkind) for r in df.collect()) for df in (few, many)]
    assert named[0] == named[1] == sorted((f"p{i % 3}", f"m{i}", k) for i in (0, 2, 3, 5) for k in ("module", "variable"))


def test_tasks_stay_small_as_tables_grow(spark):
    least = spark.sparkContext.defaultParallelism
    assert dealt_out(spark.range(1000), 10).rdd.getNumPartitions() == max(least, 100)
    assert dealt_out(spark.range(5), 10).rdd.getNumPartitions() == least
