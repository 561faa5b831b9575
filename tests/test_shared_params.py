"""Parameter rows and usage texts are made once for the impact queries, and their lines are shuffled once."""

import contextlib
import io

from pyspark.sql import functions as F

from pkgscope.operators import diff as D
from pkgscope.plans import q_chainmatch, q_impact
from pkgscope.sources.bindings import binding, order_lines

SF0001 = "/root/testdata/sf0.001"


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_lines_of_an_order_are_shuffled_once(spark):
    for name in ("b_param_old", "b_param_new"):
        rows, plain = order_lines(spark, SF0001, name), binding(spark, SF0001, name)
        assert _plan(rows).count("Exchange hashpartitioning") == 1
        assert rows.count() == plain.count() and rows.exceptAll(plain).isEmpty()


def test_impact_reads_orders_and_lines_from_kept_rows_only(spark):
    plan = _plan(q_impact.impacted_diffs(spark, SF0001))
    unkept = "\n".join(part for part in plan.split("InMemoryTableScan")[:1])
    assert "lineitem.parquet" not in unkept and "InMemoryTableScan" in plan


def test_texts_are_distinct_before_they_are_taken_apart(spark):
    usage = spark.createDataFrame([("pkg.f(*)",), ("pkg.f(*)",), ("pkg.g",)], "chain string")
    texts = q_chainmatch.chain_texts(usage)
    assert sorted(r.chain for r in texts.collect()) == ["pkg.f(*)", "pkg.g"]
    items = texts.where(F.size(F.split("chain", r"\.")) > 1)
    assert "Exchange" not in _plan(items)  # what asks for the items reads the stored texts, not the usage rows


def test_change_types_are_counted_once(spark):
    diffs = spark.createDataFrame([("Class Removal", 1, 1), ("Class Addition", 0, 0)], "diff_type string, clients_used long, clients_impacted long")
    table = D.change_type_table(diffs)
    assert "hashpartitioning" not in _plan(table)  # the counts are stored: neither reader makes the changes again
    assert {(r.diff_type, r.n_all, r.n_used) for r in table.collect()} == {("Class Removal", 1, 1), ("Class Addition", 1, 0)}
