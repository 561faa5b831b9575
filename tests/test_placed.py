"""Kept tables stay where they are, and each name and each version meets what it is compared with once."""

import contextlib
import io

from pyspark.sql import functions as F

from pkgscope.operators import catalog as K
from pkgscope.operators import chainmatch as CM
from pkgscope.operators import diff as D
from pkgscope.operators import impact as I
from pkgscope.operators import parse as P
from pkgscope.session import share_placed

BY = ["pkg", "ver"]
OLD = [("p.__init__", "from .lib import f as g\nfrom .lib import *\n"), ("p.lib", "def f(x): pass\ndef same(x): pass\nclass C:\n    def m(self): pass\n    def r(self): pass\n")]
NEW = [("p.__init__", "from .lib import f as g\n"), ("p.lib", "def f(x, y): pass\ndef same(x): pass\nclass C:\n    def m(self, k): pass\n    def a(self): pass\n")]


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def _rows(spark):
    src = [("p", v, *f) for v, files in (("1.0", OLD), ("2.0", NEW)) for f in files]
    return P.parse_sources(spark.createDataFrame(src, "pkg string, ver string, module string, src string")).localCheckpoint()


def _counted(spark, df):
    """``df`` and an accumulator of the rows made of it."""
    made = spark.sparkContext.accumulator(0)
    rows = df.localCheckpoint()

    def passed(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return rows.mapInArrow(passed, rows.schema), made, rows.count()


def test_joins_move_only_the_other_side(spark):
    kept = share_placed(spark.range(1000).select(F.col("id").cast("string").alias("k"), F.lit("x").alias("v")), ["k"])
    joined = spark.range(500).select(F.col("id").cast("string").alias("k")).join(kept.hint("merge"), "k")
    outside = _plan(joined).split("InMemoryRelation")[0]
    assert outside.count("Exchange hashpartitioning") == 1 and outside.count("Sort [") == 1
    assert joined.count() == 500


def test_names_that_stand_for_themselves_are_not_walked(spark):
    rows = _rows(spark)
    objects = CM.one_per_key(CM.catalogue_tables(rows, K.build_entities(rows))[0], BY)
    asked = spark.createDataFrame([("p", "1.0", k) for k in ("p.lib.f", "p.g", "p.same", "p.none", "q.x")], "pkg string, ver string, key string")
    known, led = K.named(asked, objects, BY)
    assert {r.key for r in known.collect()} == {"p.lib.f"}
    assert {(r.key, r.own, r.result_key) for r in led.collect()} == {("p.g", "alias", "p.lib.f"), ("p.same", "wildcard", "p.lib.same"), ("p.none", "wildcard", None)}
    assert {(r.key, r.rkind) for r in CM.lookups(asked, objects, BY).collect()} == {("p.lib.f", "function"), ("p.g", "function"), ("p.same", "function"), ("p.none", "wildcard")}


def test_patterns_of_all_pairs_are_looked_up_once(spark, monkeypatch):
    rows = _rows(spark)
    calls, plain = [], K.named
    monkeypatch.setattr(K, "named", lambda *a, **k: calls.append(1) or plain(*a, **k), raising=True)
    entities = K.build_entities(rows)
    pairs = spark.createDataFrame([("p", "1.0", "2.0")], "pkg string, v1 string, v2 string")
    usage = spark.createDataFrame([("p", "1.0", c, a, x) for c, a, x in (
        ("a", "p.lib.f", "p.lib.f(*)"), ("b", "p.lib.f", "p.g(*)"), ("c", "p.lib.f", "p.lib.f(*,*)"), ("a", "p.lib.C.m", "p.lib.C().m()"), ("a", "p.lib.C.r", "p.lib.C().r()"))],
        "pkg string, ver string, c_pkg string, api string, chain string")
    got = I.pair_impact(D.diff_versions(entities, pairs, *D.parsed_members(rows)), pairs, usage, *CM.catalogue_tables(rows, entities)).collect()
    assert len(calls) == 1
    assert {(r.diff_type, r.api_name, r.param, r.clients_total, r.clients_used, r.clients_impacted) for r in got} == {
        ("Required Parameter Addition", "p.lib.f", "y", 3, 3, 2), ("Required Parameter Addition", "p.lib.C.m", "k", 3, 1, 1),
        ("Function Removal", "p.lib.C.r", None, 3, 1, 0), ("Function Addition", "p.lib.C.a", None, 3, 0, 0)}


def test_each_version_meets_the_pairs_once(spark):
    rows = _rows(spark)
    entities, made, n = _counted(spark, K.build_entities(rows).select(*BY, "key", "kind"))
    pairs = spark.createDataFrame([("p", "1.0", "2.0"), ("p", "2.0", "1.0")], "pkg string, v1 string, v2 string")
    got = {(r.v1, r.diff_type, r.api_name, r.param) for r in D.diff_versions(entities, pairs, *D.parsed_members(rows)).collect()}
    assert got == {("1.0", "Required Parameter Addition", "p.lib.f", "y"), ("1.0", "Required Parameter Addition", "p.lib.C.m", "k"),
                   ("1.0", "Function Removal", "p.lib.C.r", None), ("1.0", "Function Addition", "p.lib.C.a", None),
                   ("2.0", "Required Parameter Removal", "p.lib.f", "y"), ("2.0", "Required Parameter Removal", "p.lib.C.m", "k"),
                   ("2.0", "Function Removal", "p.lib.C.a", None), ("2.0", "Function Addition", "p.lib.C.r", None)}
    assert made.value == n


def test_entities_of_one_key_each_give_their_change(spark):
    ent = spark.createDataFrame([("p", "1", "p.k", "class"), ("p", "1", "p.k", "function"), ("p", "2", "p.n", "variable"), ("p", "2", "p.n", "variable"), ("p", "2", "p.al", "alias")],
                                "pkg string, ver string, key string, kind string")
    pairs = spark.createDataFrame([("p", "1", "2")], "pkg string, v1 string, v2 string")
    assert sorted((r.diff_type, r.api_name) for r in D.diff_versions(ent, pairs).collect()) == [
        ("Class Removal", "p.k"), ("Function Removal", "p.k"), ("Variable Addition", "p.n"), ("Variable Addition", "p.n")]
