from pyspark.sql import functions as F

from pkgscope.operators import diff as D


def test_param_diff_golden(spark):
    # old f(a, b=1, c=2, d) -> new f(a, c=3, b, e, g=1)
    old = spark.createDataFrame([("f", "a", 0, None), ("f", "b", 1, "1"), ("f", "c", 2, "2"), ("f", "d", 3, None)],
                                "func string, param string, pos int, dflt string")
    new = spark.createDataFrame([("f", "a", 0, None), ("f", "c", 1, "3"), ("f", "b", 2, None), ("f", "e", 3, None),
                                 ("f", "g", 4, "1")], "func string, param string, pos int, dflt string")
    got = {(r.param, r.diff_type, r.old_value, r.new_value) for r in D.param_changes(old, new, []).collect()}
    assert got == {
        ("e", D.REQ_PARAM_ADD, None, None),
        ("g", D.OPT_PARAM_ADD, None, None),
        ("d", D.REQ_PARAM_REM, None, None),
        ("b", D.DEF_VAL_ADD, "1", None),
        ("c", D.DEF_VAL_CHG, "2", "3"),
        ("b", D.PARAM_REORDER, None, None),
        ("c", D.PARAM_REORDER, None, None),
    }


def test_same_default(spark):
    df = spark.createDataFrame([("<object at 1>", "<object at 2>"), ("Foo(1)", "Foo(2)"), ("1", "2")], "o string, n string")
    assert [r.s for r in df.select(D.same_default(F.col("o"), F.col("n")).alias("s")).collect()] == [True, True, False]


def test_messages_and_breaking(spark):
    df = spark.createDataFrame([(D.DEF_VAL_ADD, "m.f", "b", "1", None), (D.CLS_ADD, "m.C", None, None, None)],
                               "diff_type string, api_name string, param string, old_value string, new_value string")
    rows = D.with_flags(df).collect()
    assert rows[0].message == "`m.f`: default value `None` added to `b`" and rows[0].is_breaking
    assert rows[1].message == "`m.C`: class added" and not rows[1].is_breaking


def test_diff_versions_members(spark):
    ent = spark.createDataFrame([
        ("p", "1", "p.C", "class"), ("p", "2", "p.C", "class"), ("p", "1", "p.f", "function"), ("p", "2", "p.g", "function"),
        ("p", "1", "p.a", "alias"), ("p", "1", "p.k", "class"), ("p", "2", "p.k", "function")],
        "pkg string, ver string, key string, kind string")
    mem = spark.createDataFrame([
        ("p", "1", "p.C", "m", "method"), ("p", "2", "p.C", "m", "method"), ("p", "1", "p.C", "x", "field"),
        ("p", "2", "p.C", "y", "static_field"), ("p", "2", "p.C", "n", "method")],
        "pkg string, ver string, class_key string, name string, mkind string")
    args = spark.createDataFrame([("p", "1", "p.C.m", "self", 0, None), ("p", "2", "p.C.m", "self", 0, None),
                                  ("p", "2", "p.C.m", "z", 1, None)],
                                 "pkg string, ver string, func string, param string, pos int, dflt string")
    pairs = spark.createDataFrame([("p", "1", "2")], "pkg string, v1 string, v2 string")
    got = {(r.api_name, r.diff_type, r.param) for r in D.diff_versions(ent, pairs, mem, args).collect()}
    assert got == {("p.f", D.FUNC_REM, None), ("p.g", D.FUNC_ADD, None), ("p.C.x", D.VAR_REM, None),
                   ("p.C.y", D.VAR_ADD, None), ("p.C.n", D.FUNC_ADD, None), ("p.C.m", D.REQ_PARAM_ADD, "z")}
