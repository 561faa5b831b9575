"""Wheel archive -> members -> modules -> entities."""

import os
import tempfile
import zipfile

from pyspark.sql import functions as F

from pkgscope.operators import catalog as K
from pkgscope.operators import parse as P
from pkgscope.sources import files as S


def _wheel(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("simple/__init__.py", "from .lib2 import func2\n")
        z.writestr("simple/lib2.py", "def func2(a, b=1): pass\n")
        z.writestr("simple/lib2.pyi", "def func2(a: int, b: int = ...) -> None: ...\n")
        z.writestr("simple/stub_only.pyi", "X: int = 1\n")
        z.writestr("simple/m1/__init__.py", "from ..lib2 import func2\n")
        z.writestr("simple/nopkg/mod.py", "def hidden(): pass\n")
        z.writestr("simple/setup.py", "x = 1\n")
        z.writestr("simple/resource/abc.txt", "text\n")
        z.writestr("single.py", "def one(): pass\n")
        z.writestr("simple-1.0.dist-info/top_level.txt", "simple\nsingle\n")
        z.writestr("simple-1.0.dist-info/METADATA",
                   "Name: simple\nRequires-Python: >=3.6\nRequires-Dist: foo (>=1.0)\nRequires-Dist: bar[x]; extra == 'y'\n")


def test_wheel_to_entities(spark):
    d = tempfile.mkdtemp(prefix="pkgscope-wheel-")
    path = os.path.join(d, "simple-1.0-py3-none-any.whl")
    _wheel(path)
    bad = os.path.join(d, "broken-1.0-py3-none-any.whl")
    with open(bad, "wb") as f:
        f.write(b"not a zip")
    members = S.wheel_sources(spark, os.path.join(d, "*.whl")).cache()
    assert members.where(F.col("error").isNotNull()).count() == 1
    mods = S.wheel_modules(members.where(F.col("error").isNull()))
    got = sorted((r.module, r.src_kind) for r in mods.collect())
    assert got == [("simple.__init__", "py"), ("simple.lib2", "py"), ("simple.lib2", "pyi"), ("simple.m1.__init__", "py"),
                   ("simple.stub_only", "pyi"), ("single", "py")]
    reqs = S.metadata_requirements(members).collect()
    assert [r.requires_dist for r in reqs] == ["foo (>=1.0)", "bar[x]; extra == 'y'"] and reqs[0].require_python == ">=3.6"
    src = mods.select(F.lit("simple").alias("pkg"), F.lit("1.0").alias("ver"), "module", "src", "src_kind")
    ent = K.build_entities(P.parse_sources(src))
    keys = {r.key for r in ent.collect()}
    assert {"simple.func2", "simple.lib2.func2", "simple.stub_only.X", "simple.m1.func2", "single.one"} <= keys
    assert not any("hidden" in k for k in keys)
    # .py first: the function comes from lib2.py, whose argument b has no annotation
    rows = P.parse_sources(src).where((F.col("module") == "simple.lib2") & (F.col("name") == "func2")).orderBy("ord").collect()
    assert [r.args[0].type for r in rows] == [None, "int"] and rows[1].src_rank == 1


def test_name_lists_and_accessibility(spark):
    from pkgscope.operators import reports as R

    d = tempfile.mkdtemp(prefix="pkgscope-names-")
    with open(os.path.join(d, "my-lib-1.2.txt"), "w") as f:
        f.write("my_lib.a\nmy_lib.b\nmy_lib.a\n")
    with open(os.path.join(d, "other-0.1.txt"), "w") as f:
        f.write("other.x\n")
    names = S.name_lists(spark, os.path.join(d, "*.txt"))
    assert sorted((r.lib, r.ver) for r in names.select("lib", "ver").distinct().collect()) == [("my-lib", "1.2"), ("other", "0.1")]
    resolved = spark.createDataFrame([("my-lib", "1.2", "my_lib.a", True)], "lib string, ver string, name string, found boolean")
    per = {(r.lib, r.accessible, r.not_accessible) for r in R.accessibility(names, resolved).collect()}
    assert per == {("my-lib", 1, 1), ("other", 0, 1)}
    assert R.accessible_ratio(R.accessibility(names, resolved)).collect()[0].ratio == 1 / 3
    assert R.distinct_names_total(names).collect()[0].total_names == 3
