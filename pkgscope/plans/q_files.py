"""Queries over written files and archives: metadata, rankings and sources go
to the shared folder and are read back; wheels are packed in the tasks (S1,
S3-S7, E1, E2, V12).  And names of nested and re-exported classes (K11, K12)."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from pkgscope.operators import catalog as K
from pkgscope.operators import parse as P
from pkgscope.plans import q_tree as T
from pkgscope.plans.registry import register
from pkgscope.session import share, share_filled
from pkgscope.sources import files as S
from pkgscope.sources.bindings import table
from pkgscope.sources.tables import new_folder

_P = "(SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS ks, p_size AS s FROM part) AS t"


# ------------------------------------------------------------------ rankings and metadata

@register("S1_ranked_packages", "SELECT 'app' || c_custkey AS project, CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE c_custkey * 7 % 1000 END::BIGINT AS num_downloads FROM customer")
def q_s1(spark, sf_dir):
    """S1 from a CSV with missing downloads."""
    key = F.col("c_custkey")
    path = new_folder(spark, "ranking")
    table(spark, sf_dir, "customer").select(F.concat(F.lit("app"), key).alias("project"), F.when(key % 9 != 0, key * 7 % 1000).alias("num_downloads")).write.csv(path, header=True)
    return S.ranked_packages(spark, path)


def metadata(spark, sf_dir):
    """One metadata object per part: a version without files, two with."""
    k = F.col("k").cast("string")
    def files(ver, n):
        return F.array(*[F.struct(F.concat(F.lit("t"), k, F.lit(f"-{ver}-{i}.whl")).alias("filename"), F.lit("u").alias("url"), F.lit(f"2020-01-0{i + 1}T00:00:00").alias("upload_time")) for i in range(n)])

    releases = F.map_from_arrays(F.array(*map(F.lit, ("0.9", "1.0", "2.0"))), F.array(F.slice(files("0.9", 1), 1, 0), files("1.0", 2), files("2.0", 1)))
    reqs = F.array(F.concat(F.lit("dep"), k, F.lit(" (>=1.0)")), F.lit("win; os_name == 'nt'"), F.concat(F.lit("x"), k, F.lit("[full]<2")), F.lit("plain"))
    doc = F.struct(F.struct(F.concat(F.lit("t"), k).alias("name"), F.lit(">=3.6").alias("requires_python"), F.when(F.col("k") % 5 != 0, reqs).alias("requires_dist")).alias("info"), releases.alias("releases"))
    path = new_folder(spark, "metadata")
    T._parts(spark, sf_dir).select(F.to_json(doc).alias("value")).write.text(path)
    return S.release_metadata(spark, path, one_per_file=False)


@register("S3_S4_release_files", " UNION ALL ".join(
    f"SELECT 't' || ks AS pkg, '{v}' AS ver, {i} AS file_ord, 't' || ks || '-{v}-{i}.whl' AS filename, TIMESTAMP '2020-01-0{i + 1}' AS upload_time FROM {_P}" for v, i in (("1.0", 0), ("1.0", 1), ("2.0", 0))))
def q_s4(spark, sf_dir):
    """Metadata JSON, map and array flattened; versions without files vanish."""
    return S.release_files(metadata(spark, sf_dir)).select("pkg", "ver", "file_ord", "filename", "upload_time")


@register("V12_plain_requirements", " UNION ALL ".join(
    f"SELECT 't' || ks AS pkg, '>=3.6' AS require_python, {dep} AS dep, {spec} AS spec FROM {_P} WHERE k % 5 <> 0" for dep, spec in (("'dep' || ks", "'>=1.0'"), ("'plain'", "''"))))
def q_v12(spark, sf_dir):
    """Rows with a marker or with extras are dropped."""
    return S.plain_requirements(S.requirement_rows(metadata(spark, sf_dir))).select("pkg", "require_python", "dep", "spec")


# ------------------------------------------------------------------ archives

#: (member, text); $k is the part.  Every third part has no top_level.txt: its file name says the package.
MEMBERS = [
    ("t$k/__init__.py", "from .a import f\n"), ("t$k/a.py", "def f(x): pass\n"), ("t$k/a.pyi", "def f(x: int): ...\n"), ("t$k/loose/hidden.py", "y = 1\n"),
    ("t$k/sub/__init__.py", ""), ("t$k/sub/b.py", "Z = $s\n"), ("t$k/setup.py", "q = 1\n"), ("t$k/data.txt", "no"), ("single$k.py", "def one(): pass\n"),
    ("t$k-1.0.dist-info/METADATA", "Name: t$k\nRequires-Python: >=3.$s\nRequires-Dist: foo$k (>=1.0)\nRequires-Dist: bar; extra == 'y'\n"),
    ("t$k-1.0.dist-info/top_level.txt", "t$k\nsingle$k\n"),
]


def _pack(batches):
    for batch in batches:
        out = []
        for k, s in zip(batch.column("k").to_pylist(), batch.column("s").to_pylist()):
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w") as z:
                for name, text in MEMBERS:
                    if k % 3 or not name.endswith("top_level.txt"):
                        z.writestr(name.replace("$k", str(k)), text.replace("$k", str(k)).replace("$s", str(s)))
            out.append((f"wheels/t{k}-1.0-py3-none-any.whl", data.getvalue() if k % 11 else data.getvalue()[:40]))  # every eleventh is cut off
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["path", "content"])


def wheel_members(spark, sf_dir):
    """Wheels of all parts, as ``binaryFile`` gives them, written and read back."""
    path = new_folder(spark, "wheels")
    T._parts(spark, sf_dir).select("k", "s").mapInArrow(_pack, "path string, content binary").write.parquet(path)
    return share(S.unpacked(spark.read.parquet(path)))


@register("S5_wheel_members", f"""
SELECT 't' || ks AS pkg, '1.0' AS ver, replace(m, '$k', ks) AS member FROM {_P}, (VALUES {", ".join(f"('{m}')" for m, _ in MEMBERS if not m.endswith(".txt") or "top_level" in m)}) AS v(m)
WHERE k % 11 <> 0 AND (k % 3 <> 0 OR m NOT LIKE '%top_level.txt')""")
def q_s5(spark, sf_dir):
    """Wanted members of every readable archive; package and version from its name."""
    m = wheel_members(spark, sf_dir).where("error IS NULL").withColumn("w", S.wheel_name(F.col("archive")))
    return m.select("w.pkg", "w.ver", "member")


@register("S25_bad_archives", "SELECT 'wheels/t' || p_partkey || '-1.0-py3-none-any.whl' AS archive FROM part WHERE p_partkey % 11 = 0")
def q_s25_archives(spark, sf_dir):
    """Archives that can't be read are rows, not failures."""
    return wheel_members(spark, sf_dir).where("error IS NOT NULL").select("archive")


@register("S7_wheel_requirements", " UNION ALL ".join(
    f"SELECT 't' || ks AS pkg, '>=3.' || s AS require_python, {i} AS req_id, {req} AS requires_dist FROM {_P} WHERE k % 11 <> 0" for i, req in enumerate(("'foo' || ks || ' (>=1.0)'", "'bar; extra == ''y'''"))))
def q_s7(spark, sf_dir):
    r = S.metadata_requirements(wheel_members(spark, sf_dir))
    return r.select(S.wheel_name(F.col("archive"))["pkg"].alias("pkg"), "require_python", "req_id", "requires_dist")


@register("E1_E2_wheel_modules", f"""
SELECT 't' || ks AS pkg, top_level, module, src_kind FROM (
  SELECT ks, k, 't' || ks AS top_level, 't' || ks || m AS module, kind AS src_kind FROM {_P}, (VALUES ('.__init__', 'py'), ('.a', 'py'), ('.a', 'pyi'), ('.sub.__init__', 'py'), ('.sub.b', 'py')) AS v(m, kind)
  UNION ALL SELECT ks, k, 'single' || ks, 'single' || ks, 'py' FROM {_P} WHERE k % 3 <> 0) WHERE k % 11 <> 0""")
def q_e1(spark, sf_dir):
    """Modules below directories that all hold an __init__.py; top levels from the list, else from the file name."""
    m = S.wheel_modules(wheel_members(spark, sf_dir).where("error IS NULL"))
    return m.select(S.wheel_name(F.col("archive"))["pkg"].alias("pkg"), "top_level", "module", "src_kind")


@register("S6_source_tree", "SELECT 'm' || p_partkey % 50 AS module, count(*) AS n_functions FROM part GROUP BY 1")
def q_s6(spark, sf_dir):
    """Source files written as a tree, read whole and parsed."""
    root = new_folder(spark, "sources")
    k = F.col("p_partkey")
    lines = table(spark, sf_dir, "part").select(F.concat(F.lit("m"), k % 50).alias("module"), F.concat(F.lit("def f"), k, F.lit("(a): pass")).alias("value"))
    lines.repartition(8, "module").write.partitionBy("module").text(root)
    files = S.source_tree(spark, root, files="*.txt")
    src = files.select(F.lit("pkg").alias("pkg"), F.lit("1").alias("ver"), F.regexp_extract("path", "module=([^/]*)/", 1).alias("module"), "src")
    found = P.parse_sources(src).where("rkind = 'function'")
    return found.groupBy("module").agg(F.count(F.lit(1)).alias("n_functions"))


# ------------------------------------------------------------------ nested and re-exported classes

CLASSES = [
    ("__init__", "py", "from .m import C as D\nfrom .m import f\n", "true"),
    ("m", "py", "def f(): pass\nclass C:\n    s = $s\n    def __init__(self): self.v = 1\n    def g(self): pass\n    class N:\n        def h(self): pass\n        class O:\n            t = 2\n            def i(self): pass\n", "true"),
]
#: (class, name) of K11; nested names have no dots.
CLASS_NAMES = [("C", n) for n in ("s", "__init__", "g", "v", "N", "Nh", "NO", "NOt", "NOi")] + [("C.N", n) for n in ("h", "O", "Ot", "Oi")] + [("C.N.O", "t"), ("C.N.O", "i")]


def _class_rows(spark, sf_dir):
    return share_filled(P.parse_sources(T.tree_sources(spark, sf_dir, CLASSES)))


@register("K11_nested_names", f"SELECT 't' || ks AS pkg, 't' || ks || '.m.' || c AS class_key, n AS name FROM {_P}, (VALUES {', '.join(map(str, CLASS_NAMES))}) AS v(c, n)")
def q_nested_names(spark, sf_dir):
    """K11 over classes nested three deep."""
    return K.class_names(K.build_members(_class_rows(spark, sf_dir))).select("pkg", "class_key", "name")


_PUBLIC = ["", ".__init__"]
_OF_C = [n for c, n in CLASS_NAMES if c == "C"]


@register("K12_reexported_names", f"""
SELECT 't' || ks AS pkg, 't' || ks || n AS name FROM {_P}, (VALUES {", ".join(f"('{n}')" for n in [".m.f", ".m.C", *[f".m.C.{x}" for x in _OF_C], *[p + x for p in _PUBLIC for x in (".D", ".f", *[f".D.{n}" for n in _OF_C])]])}) AS v(n)""")
def q_reexported_names(spark, sf_dir):
    """A class listed under the name it is re-exported by, with its members."""
    rows = _class_rows(spark, sf_dir)
    return K.public_names(K.build_entities(rows), K.build_members(rows)).select("pkg", "name")
