"""Queries over small package trees, one per part: overloads, repeated
classes, static methods, a sub-module imported by name, wildcard imports over
two levels, an empty file, a .pyi file, unreadable files and versions.  The
oracles state the expected rows in SQL over ``part``, without parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from pkgscope.operators import catalog as K
from pkgscope.operators import chainmatch as CM
from pkgscope.operators import chains as A
from pkgscope.operators import diff as D
from pkgscope.operators import parse as P
from pkgscope.operators import usage as U
from pkgscope.plans.registry import register, sql_str
from pkgscope.session import cut_lineage, share_filled
from pkgscope.sources.bindings import dealt_out, table

#: (module below the package, kind of file, text; $k is the part, $s its size, condition on the part)
FILES = [
    ("__init__", "py", "from .core import *\nfrom . import sub\nfrom .lib import f as g\nfrom os import path\nimport os.path\nfrom .lib import loop\n", "true"),
    ("core.__init__", "py", "from .num import *\n", "true"),
    ("core.num", "py", "V = $s\ndef arr(a): pass\n", "true"),
    ("lib", "py", "try:\n    def f(x, y=$s): pass\nexcept E:\n    def f(): pass\n"
                  "class C:\n    def __init__(self, a): pass\n    def m(self, b): pass\n    def m(self): pass\n    @staticmethod\n    def s(b): pass\n"
                  "class C:\n    def __init__(self): pass\n    def t(self, u): pass\nclass D: pass\nfrom . import loop\n", "true"),
    ("lib", "pyi", "def f(z: int) -> int: ...\ndef only(z: int) -> int: ...\nclass C:\n    def m(self, b, c): ...\n", "true"),
    ("sub", "py", "def h(z): pass\n", "true"),
    ("empty", "py", "", "true"),
    ("bad", "py", "def (", "k % 5 = 0"),
    ("bad", "pyi", "class :", "k % 5 = 0"),
    ("ve", "py", "a, b = [1]\n", "k % 7 = 0"),
]

#: (chain, status, message, matched name, matched kind); p is the package
CHAINS = [
    ("p.arr()", "MISMATCH", "p.arr() does not match function def arr(a): arr() missing one required argument a", None, None),
    ("p.arr(*)", "MATCH", "", "p.arr", "function"),
    ("p.g()", "MISMATCH", "p.g() does not match function def f(x, y = $s): f() missing one required argument x", None, None),
    ("p.lib.f(*,*)", "MATCH", "", "p.lib.f", "function"),
    ("p.lib.only()", "MISMATCH", "p.lib.only() does not match function def only(z: int) -> int: only() missing one required argument z", None, None),
    ("p.sub.h()", "MISMATCH", "p.sub.h() does not match function def h(z): h() missing one required argument z", None, None),
    ("p.sub.nope", "MISSING", "p.sub.nope does not exist", None, None),
    ("p.lib()", "MISMATCH", "p.lib is a module but it is invoked", None, None),
    ("p.lib.C(*).m(*)", "MATCH", "", "p.lib.C.m", "function"),
    ("p.lib.C(*).m()", "MISMATCH", "p.lib.C(*).m() does not match class method def m(self, b): m() missing one required argument b", None, None),
    ("p.lib.C()", "MISMATCH", "p.lib.C() does not match class constructor def __init__(self, a): __init__() missing one required argument a", None, None),
    ("p.lib.C(*).s(*)", "MATCH", "", "p.lib.C.s", "function"),
    ("p.lib.C(*).t()", "MATCH", "", "p.lib.C", "class"),
    ("p.lib.D(*,*)", "MATCH", "", "p.lib.D", "class"),
    ("p.core.num.V.x", "MATCH", "", "p.core.num.V", "variable"),
    ("p.empty", "MATCH", "", "p.empty", "module"),
    ("p.empty.x", "MISSING", "p.empty.x does not exist", None, None),
    ("p.path.join", "MATCH", "", "p.path", "alias"),
    ("p.nowhere(*)", "MATCH", "", "p.nowhere", "wildcard"),
    ("p.lib.zzz", "MISSING", "p.lib.zzz does not exist", None, None),
]

#: key -> what it finally names (K8); None if nothing
KEYS = [("p.arr", "p.core.num.arr", "function"), ("p.V", "p.core.num.V", "variable"), ("p.g", "p.lib.f", "function"), ("p.sub", "p.sub", "module"),
        ("p.path", None, None), ("p.nowhere", None, None), ("p.loop", None, None), ("p.lib.C", "p.lib.C", "class"), ("p.core.arr", "p.core.num.arr", "function"),
        ("p.empty", "p.empty", "module"), ("p.os", None, None)]

MODULES = ["p", "p.__init__", "p.core", "p.core.num", "p.lib", "p.sub", "p.empty"]


def _parts(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    parts = dealt_out(parts, 10000)  # narrow rows, before they grow to texts
    return parts.select("k", "s", F.concat(F.lit("t"), "k").alias("pkg"), F.lit("1.0").alias("ver"))


def _filled(c):
    return F.replace(F.replace(c, F.lit("$s"), F.col("s").cast("string")), F.lit("$k"), F.col("k").cast("string"))


def _named(c):
    """The text with the leading p replaced by the package, here and after blanks."""
    return F.regexp_replace(_filled(c), r"\bp(?=\.)", F.col("pkg"))


def tree_sources(spark, sf_dir, listed=FILES):
    files = F.array(*[F.when(F.expr(cond), F.struct(F.lit(m).alias("m"), F.lit(kind).alias("src_kind"), F.lit(t).alias("src"))) for m, kind, t, cond in listed])
    rows = _parts(spark, sf_dir).select("k", "s", "pkg", "ver", F.explode(F.array_compact(files)).alias("f")).select("k", "s", "pkg", "ver", "f.*")
    return rows.select("pkg", "ver", F.concat_ws(".", "pkg", "m").alias("module"), "src_kind", _filled(F.col("src")).alias("src"))


def tree_rows(spark, sf_dir):
    return share_filled(P.parse_sources(tree_sources(spark, sf_dir)))


def tree_catalogue(spark, sf_dir):
    rows = tree_rows(spark, sf_dir)
    return CM.catalogue_tables(rows, K.build_entities(rows))


def _texts(spark, sf_dir, values):
    rows = F.array(*[F.struct(*[F.lit(v).alias(f"c{i}") for i, v in enumerate(x)]) for x in values])
    return _parts(spark, sf_dir).select("k", "s", "pkg", "ver", F.inline(rows))


def _values(rows) -> str:
    cell = lambda v: "CAST(NULL AS VARCHAR)" if v is None else sql_str(v)
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


_SQL = r"(SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS s, 't' || p_partkey AS pkg FROM part WHERE p_partkey % 7 <> 0)"


def _sql(c: str) -> str:
    return rf"regexp_replace(replace({c}, '$s', s), '\bp\.', pkg || '.', 'g')"


@register("M12_tree_match", f"""
SELECT pkg, {_sql('c')} AS chain, status, {_sql('msg')} AS message, {_sql('name')} AS matched_name, kind AS matched_kind
FROM {_SQL} AS t, (VALUES {_values(CHAINS)}) AS v(c, status, msg, name, kind)""")
def q_tree_match(spark, sf_dir):
    """One verdict per chain; versions with an error take no part."""
    objects, funcs, methods = tree_catalogue(spark, sf_dir)
    chains = _texts(spark, sf_dir, [(c[0],) for c in CHAINS]).select("pkg", "ver", _named(F.col("c0")).alias("chain"))
    found = CM.match_chains(chains.withColumnRenamed("chain", "chain_id"), objects, funcs, methods, ["pkg", "ver"])
    return found.select("pkg", F.col("chain_id").alias("chain"), "status", "message", "matched_name", "matched_kind")


@register("K8_tree_resolve", f"""
SELECT pkg, {_sql('c')} AS key, {_sql('name')} AS result_key, kind AS result_kind FROM {_SQL} AS t, (VALUES {_values(KEYS)}) AS v(c, name, kind)""")
def q_tree_resolve(spark, sf_dir):
    """K8: aliases, nested wildcards, a cycle, names of other packages."""
    objects, _, _ = tree_catalogue(spark, sf_dir)
    keys = _texts(spark, sf_dir, [(c[0],) for c in KEYS]).select("k", "pkg", "ver", _named(F.col("c0")).alias("key"))
    found = K.follow(keys.select("pkg", "ver", "key"), CM.one_per_key(objects, ["pkg", "ver"]), ["pkg", "ver"])
    return keys.where("k % 7 <> 0").join(found, ["pkg", "ver", "key"], "left").select("pkg", "key", "result_key", "result_kind")


@register("K3_tree_modules", f"SELECT pkg, CASE WHEN m = 'p' THEN pkg ELSE {_sql('m')} END AS module FROM {_SQL} AS t, (VALUES {_values([(m,) for m in MODULES if m != 'p.__init__'])}) AS v(m) UNION ALL SELECT pkg, pkg || '.bad' FROM {_SQL} AS t WHERE k % 5 = 0")
def q_tree_modules(spark, sf_dir):
    """K3: one module per file, also an empty or unreadable one; imported names are no modules."""
    return K.parsed_modules(tree_rows(spark, sf_dir)).select("pkg", "module")


@register("K7_tree_wildcards", f"SELECT pkg, pkg || '.nowhere' AS key, 'wildcard' AS rkind FROM {_SQL} AS t UNION ALL SELECT pkg, pkg || '.core.nowhere', 'wildcard' FROM {_SQL} AS t")
def q_tree_wildcards(spark, sf_dir):
    """K7: names unknown below a module with a wildcard import."""
    objects, _, _ = tree_catalogue(spark, sf_dir)
    keys = _texts(spark, sf_dir, [("p.nowhere",), ("p.core.nowhere",), ("p.lib.nowhere",)]).select("pkg", "ver", _named(F.col("c0")).alias("key"))
    return CM.lookups(keys, objects, ["pkg", "ver"]).select("pkg", "key", "rkind")


@register("E16_tree_status", """
SELECT 't' || p_partkey AS pkg, CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 0 END::BIGINT AS n_failed, p_partkey % 7 = 0 AS error,
       (6 + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_modules FROM part""")
def q_tree_status(spark, sf_dir):
    """A module whose .py and .pyi both fail counts twice; one bad assignment spoils its version."""
    return K.extraction_status(P.parse_sources(tree_sources(spark, sf_dir))).select("pkg", "n_failed", "error", "n_modules")


@register("E15_tree_methods", f"""
SELECT pkg, pkg || '.lib.C' AS class_key, m AS name, n::BIGINT AS n_args FROM {_SQL} AS t, (VALUES ('__init__', 2), ('m', 2), ('s', 1)) AS v(m, n)""")
def q_tree_methods(spark, sf_dir):
    """The first class and the first method of a name, .py before .pyi."""
    _, _, methods = tree_catalogue(spark, sf_dir)
    return methods.select("pkg", "class_key", "name", F.size("args").cast("bigint").alias("n_args"))


# ------------------------------------------------------------------ client code against the trees, end to end

#: A client's file: (line, number).  u is the package it uses.
CLIENT = ["import u", "from u.lib import f, C as K", "x = u.arr(1)", "f()", "K(1).m()", "u.sub.nope", "import os, u.nowhere"]

#: (chain, line, status, message, matched name, matched kind)
CLIENT_CHAINS = [
    ("u", 1, "MATCH", "", "u"), ("u.lib.f", 2, "MATCH", "", "u.lib.f"), ("u.lib.C", 2, "MATCH", "", "u.lib.C"),
    ("u.arr(*)", 3, "MATCH", "", "u.arr"), ("u.arr", 3, "MATCH", "", "u.arr"),
    ("u.lib.f()", 4, "MISMATCH", "u.lib.f() does not match function def f(x, y = $s): f() missing one required argument x", None),
    ("u.lib.C(*).m()", 5, "MISMATCH", "u.lib.C(*).m() does not match class method def m(self, b): m() missing one required argument b", None),
    ("u.lib.C(*).m", 5, "MATCH", "", "u.lib.C"), ("u.sub.nope", 6, "MISSING", "u.sub.nope does not exist", None), ("u.nowhere", 7, "MATCH", "", "u.nowhere"),
]

_CLIENTS = r"""(SELECT 'app' || c_custkey AS c_pkg, 't' || p_partkey AS pkg, CAST(p_size AS VARCHAR) AS s, p_partkey AS k
  FROM customer JOIN part ON p_partkey = 1 + c_custkey % (SELECT count(*) FROM part) WHERE p_partkey % 7 <> 0)"""


def _client_sql(c: str) -> str:
    return rf"regexp_replace(replace({c}, '$s', s), '\bu\b', pkg, 'g')"


_CLIENT_ROWS = f"""(SELECT c_pkg, pkg AS u_pkg, {_client_sql('c')} AS chain, CAST(line AS BIGINT) AS line, status, {_client_sql('msg')} AS message, {_client_sql('name')} AS api
  FROM {_CLIENTS} AS t, (VALUES {", ".join("(" + ", ".join([sql_str(c), str(line), sql_str(st), sql_str(msg), "CAST(NULL AS VARCHAR)" if name is None else sql_str(name)]) + ")" for c, line, st, msg, name in CLIENT_CHAINS)}) AS v(c, line, status, msg, name))"""


def client_matches(spark, sf_dir):
    """Client files -> events -> chains -> verdicts against the parsed
    catalogue of the package they use: the match rows of U1-U7."""
    parts = table(spark, sf_dir, "part")
    n = parts.count()
    used = dealt_out(table(spark, sf_dir, "customer").select("c_custkey"), 20000).select(
        F.concat(F.lit("app"), "c_custkey").alias("c_pkg"), F.concat(F.lit("t"), 1 + F.col("c_custkey") % n).alias("u"))
    src = used.select("c_pkg", F.lit("1.0").alias("c_ver"), F.lit("main.py").alias("src_file"), F.regexp_replace(F.lit("\n".join(CLIENT)), r"\bu\b", F.col("u")).alias("src"))
    chains = A.access_chains(P.parse_clients(src)).select(
        "c_pkg", "c_ver", "src_file", "chain", "items", "lines", F.col("items")[0]["name"].alias("pkg"), F.lit("1.0").alias("ver"),
        F.concat_ws("|", "c_pkg", "c_ver", "src_file", "chain").alias("chain_id"))
    objects, funcs, methods = tree_catalogue(spark, sf_dir)
    found = CM.match_chains(chains, objects, funcs, methods, ["pkg", "ver"])
    return found.select("c_pkg", "c_ver", F.col("pkg").alias("u_pkg"), F.col("ver").alias("u_ver"), "src_file", "chain", "lines",
                        F.size("lines").alias("n_lines"), "status", "message", F.col("matched_name").alias("api"))


@register("M12_client_verdicts", f"SELECT c_pkg, u_pkg, chain, line, status, message, api FROM {_CLIENT_ROWS}")
def q_client_verdicts(spark, sf_dir):
    """Parsed client files against parsed packages, one verdict per chain and line."""
    return client_matches(spark, sf_dir).select(
        "c_pkg", "u_pkg", "chain", F.explode("lines").alias("line"), "status", "message", "api").withColumn("line", F.col("line").cast("bigint"))


@register("U1_client_usage", f"""
SELECT c_pkg, u_pkg, api, count(*) AS files, count(*) AS calls, array_to_string(list_sort(list(chain)), '|') AS patterns
FROM {_CLIENT_ROWS} WHERE status = 'MATCH' GROUP BY ALL""")
def q_client_usage(spark, sf_dir):
    """U1 over parsed client code (end to end)."""
    return U.api_usage(client_matches(spark, sf_dir), ["c_pkg", "u_pkg"]).withColumn("patterns", F.array_join("patterns", "|"))


@register("U3_client_totals", f"""
SELECT c_pkg, u_pkg, count(DISTINCT api) AS num_apis, count(*) FILTER (WHERE status <> 'MATCH') AS num_violations FROM {_CLIENT_ROWS} GROUP BY ALL""")
def q_client_totals(spark, sf_dir):
    """U2/U3 over parsed client code (end to end)."""
    return U.pair_totals(client_matches(spark, sf_dir), ["c_pkg", "u_pkg"])


@register("U10_client_lines", f"""
SELECT c_pkg, u_pkg, u_ver, status, message, 'main.py:[' || array_to_string(list_sort(list(DISTINCT line)), ', ') || ']' AS affected
FROM (SELECT *, '1.0' AS u_ver FROM {_CLIENT_ROWS}) WHERE status <> 'MATCH' GROUP BY ALL""")
def q_client_lines(spark, sf_dir):
    """The lines to look at for each violation in parsed client code (end to end)."""
    found = U.violation_lines(client_matches(spark, sf_dir), ["c_pkg", "u_pkg", "u_ver"])
    return found.select("c_pkg", "u_pkg", "u_ver", "status", "message",
                        F.concat("src_file", F.lit(":["), F.array_join("lines", ", "), F.lit("]")).alias("affected"))


# ------------------------------------------------------------------ diff of two parsed versions

#: What the second version has instead.
FILES_2 = [
    ("__init__", "py", "from .core import *\nfrom . import sub\n", "true"),
    ("core.__init__", "py", "from .num import *\n", "true"),
    ("core.num", "py", "W = 1\ndef arr(a, b=2): pass\n", "true"),
    ("lib", "py", "def f(x, y): pass\nclass C:\n    def __init__(self, a, z): pass\n    def m(self, k): pass\n    def q(self): pass\nclass E: pass\n", "true"),
    ("sub", "py", "def h2(z): pass\n", "k % 3 = 0"),
    ("sub", "py", "def h(q, z=object()): pass\n", "k % 3 <> 0"),
]

#: (change, api, parameter, condition on the part)
CHANGES = [
    ("Variable Removal", "p.core.num.V", None, "true"), ("Variable Addition", "p.core.num.W", None, "true"),
    ("Optional Parameter Addition", "p.core.num.arr", "b", "true"), ("Parameter Default Value Addition", "p.lib.f", "y", "true"),
    ("Function Removal", "p.lib.only", None, "true"), ("Required Parameter Addition", "p.lib.C.__init__", "z", "true"),
    ("Required Parameter Addition", "p.lib.C.m", "k", "true"), ("Function Removal", "p.lib.C.s", None, "true"), ("Function Addition", "p.lib.C.q", None, "true"),
    ("Class Removal", "p.lib.D", None, "true"), ("Class Addition", "p.lib.E", None, "true"),
    ("Function Removal", "p.sub.h", None, "k % 3 = 0"), ("Function Addition", "p.sub.h2", None, "k % 3 = 0"),
    ("Required Parameter Addition", "p.sub.h", "q", "k % 3 <> 0"), ("Parameter Default Value Removal", "p.sub.h", "z", "k % 3 <> 0"),
    ("Parameter Reordering", "p.sub.h", "z", "k % 3 <> 0"),
]


@register("D27_tree_diff", " UNION ALL ".join(
    f"SELECT pkg, {sql_str(kind)} AS diff_type, {_sql(sql_str(api))} AS api_name, {'CAST(NULL AS VARCHAR)' if param is None else sql_str(param)} AS param FROM {_SQL} AS t WHERE {cond}"
    for kind, api, param, cond in CHANGES))
def q_tree_diff(spark, sf_dir):
    """Entities, members and parameters of all parsed version pairs."""
    second = tree_sources(spark, sf_dir, FILES_2).withColumn("ver", F.lit("2.0"))
    rows = share_filled(P.parse_sources(tree_sources(spark, sf_dir).unionByName(second)))
    pairs = _parts(spark, sf_dir).where("k % 7 <> 0").select("pkg", F.lit("1.0").alias("v1"), F.lit("2.0").alias("v2"))
    members, args = map(cut_lineage, D.parsed_members(rows))  # each side of each pair reads them
    entities = cut_lineage(K.build_entities(rows).select("pkg", "ver", "key", "kind"))
    return D.diff_versions(entities, pairs, members, args).select("pkg", "diff_type", "api_name", "param")
