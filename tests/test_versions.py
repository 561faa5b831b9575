import itertools

import pytest
from pyspark.sql import functions as F

from pkgscope.functions import versions as V

VERSIONS = ["1.0", "1.0.0", "1.0.post1", "1.0rc1", "1.0a1", "1.0b2", "1.0.dev0", "1.0a1.dev1", "1.0-1", "2", "0.9.9",
            "1!0.1", "1.0+local", "1.0.0.post1.dev3", "1.1.3rc1", "1.2.1.dev2", "0.5.3", "2.0.0rc1", "1.9.0.post1",
            "1.0.1", "1.2.1", "1.2.5", "1.3.0", "1.1.0", "1.1", "0.1.0rc1", "2.1.0"]
SPECS = ["", ">=1.0", "==1.1.*", "~=1.2.1", ">=0.5,<2", "!=1.0", "<=1.9", ">1.0", "<1.0", "==1.0", "==1.0+local", "~=1.2",
         ">2.0.0", "<2.0.0", "==0.*"]


def test_valid_version(spark):
    df = spark.createDataFrame([(v,) for v in ["0.0.1", "1.55", "0.0.1-dev", "0.0.1.dev", "1.0.0-alpha+001", "x.y"]], "v string")
    got = dict(df.select("v", V.is_valid_version("v").alias("ok")).collect())
    assert got == {"0.0.1": True, "1.55": True, "0.0.1-dev": False, "0.0.1.dev": False, "1.0.0-alpha+001": False, "x.y": False}


def test_order_matches_packaging(spark):
    packaging = pytest.importorskip("packaging.version")
    df = spark.createDataFrame([(v,) for v in VERSIONS], "v string")
    ours = [r.v for r in df.orderBy(V.version_key("v"), "v").collect()]
    ref = sorted(VERSIONS, key=lambda v: (packaging.Version(v), v))
    # equal versions may come in any order; compare keys
    assert [packaging.Version(v) for v in ours] == [packaging.Version(v) for v in ref]


def test_spec_match_matches_packaging(spark):
    spec_mod = pytest.importorskip("packaging.specifiers")
    version_mod = pytest.importorskip("packaging.version")
    rows = list(itertools.product(VERSIONS, SPECS))
    df = spark.createDataFrame(rows, "v string, s string")
    got = {(r.v, r.s): r.m for r in df.select("v", "s", V.spec_matches("v", "s").alias("m")).collect()}
    for v, s in rows:
        exp = spec_mod.SpecifierSet(s).contains(version_mod.Version(v), prereleases=True)
        assert got[(v, s)] == exp, (v, s)


def test_spec_type(spark):
    cases = {"foo": "any", "foo (== 1.0)": "fixed", "foo (>=1.0)": "at-least", "foo (<= 1.0)": "at-most",
             "foo(>   1.0)": "at-least", "foo(  >= 1.0)": "at-least", "foo   (~=  1.2)": "var-minor",
             "foo  (~=  1.2.1)": "var-micro", "foo (< 0.100.0,>=0.99.0)": "range", "foo (<=3.5.0,>=3.1.2)": "range",
             "foo (>=3.1.2,<=3.5.0)": "range", "foo (== 1.0, != 2.0)": "other"}
    df = spark.createDataFrame([(k,) for k in cases], "r string")
    got = dict(df.select("r", V.spec_type(V.requirement_spec("r")).alias("t")).collect())
    assert got == cases


def test_bump(spark):
    df = spark.createDataFrame([("1.0", "2.0"), ("1.0", "1.1"), ("1.0", "1.0.1"), ("1.0", "1.0.0.post1")], "a string, b string")
    assert [r.k for r in df.select(V.bump_kind("a", "b").alias("k")).collect()] == ["major", "minor", "patch", "patch"]
