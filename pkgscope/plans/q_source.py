"""Queries over generated sources (E3-E18, A1-A12, S25): b_source is real
Python text whose entities and chains are functions of the part row, so the
oracle states them in SQL without parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from pkgscope.functions import signatures as G
from pkgscope.operators import catalog as K
from pkgscope.operators import chains as A
from pkgscope.operators import parse as P
from pkgscope.operators import reports as R
from pkgscope.plans.registry import register
from pkgscope.session import share_filled
from pkgscope.sources.bindings import binding_cte, dealt_out, table
from pkgscope.sources.bindings_sql import BINDINGS

PKG, VER = "pkg", "1.0"


def source_texts(spark, sf_dir):
    """b_source; the part rows are dealt out over the cores before they grow to texts."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return spark.sql(BINDINGS["b_source"].replace("FROM part", "FROM {parts}"), parts=dealt_out(parts, 20000))


def sources(spark, sf_dir):
    """b_source as module files of one package version: module pkg.mod<k>."""
    return source_texts(spark, sf_dir).select(F.lit(PKG).alias("pkg"), F.lit(VER).alias("ver"),
                    F.concat(F.lit(PKG + "."), "module").alias("module"), "src")


def parsed(spark, sf_dir):
    """Parsed rows, kept once: several consumers read them, and the Python
    parse is the one stage too costly to run again per consumer."""
    return share_filled(P.parse_sources(sources(spark, sf_dir)))


def client_sources(spark, sf_dir):
    return source_texts(spark, sf_dir).select(F.lit(PKG).alias("c_pkg"), F.lit(VER).alias("c_ver"),
                    F.concat("module", F.lit(".py")).alias("src_file"), "src")


def client_events(spark, sf_dir):
    return share_filled(P.parse_clients(client_sources(spark, sf_dir)))


SRC_SQL = binding_cte("b_source") + """,
okm AS (SELECT k, 'pkg.' || module AS module, CAST(k AS VARCHAR) AS ks, (SELECT p_size FROM part WHERE p_partkey = k) AS sz
        FROM b_source WHERE k % 40 <> 0)
"""


@register("E3_failed_modules", SRC_SQL + "SELECT 'pkg' AS pkg, 'pkg.' || module AS module FROM b_source WHERE k % 40 = 0")
def q_e3(spark, sf_dir):
    return parsed(spark, sf_dir).where(F.col("rkind") == "failed").select("pkg", "module")


@register("E13_entities", SRC_SQL + """
SELECT module, 'K' || ks AS name, module || '.K' || ks AS key, 'variable' AS kind, CAST(NULL AS VARCHAR) AS full_alias FROM okm
UNION ALL SELECT module, 'f' || ks, module || '.f' || ks, 'function', NULL FROM okm
UNION ALL SELECT module, 'C' || ks, module || '.C' || ks, 'class', NULL FROM okm
UNION ALL SELECT module, 'os', module || '.os', 'alias', 'os' FROM okm
UNION ALL SELECT module, 'h', module || '.h', 'alias', 'pkg.lib.g' FROM okm""")
def q_e13(spark, sf_dir):
    return K.build_entities(parsed(spark, sf_dir)).select("module", "name", "key", "kind", "full_alias")


@register("E10_import_aliases", SRC_SQL + """
SELECT module, 'os' AS name, 'os' AS full_alias FROM okm""")
def q_e10(spark, sf_dir):
    rows = parsed(spark, sf_dir)
    return K.import_aliases(rows.where(F.col("rkind") == "import")).select("module", "name", "full_alias")


@register("E11_from_import_aliases", SRC_SQL + """
SELECT module, 'h' AS name, 'pkg.lib.g' AS full_alias FROM okm""")
def q_e11(spark, sf_dir):
    rows = parsed(spark, sf_dir)
    return K.import_aliases(rows.where(F.col("rkind") == "importfrom")).select("module", "name", "full_alias")


@register("E9_imports", SRC_SQL + """
SELECT module, 'import' AS rkind, 'os' AS name, CAST(NULL AS VARCHAR) AS asname, CAST(NULL AS VARCHAR) AS imp_module, 0 AS imp_level FROM okm
UNION ALL SELECT module, 'importfrom', 'g', 'h', 'lib', 1 FROM okm""")
def q_e9(spark, sf_dir):
    return parsed(spark, sf_dir).where(F.col("rkind").isin("import", "importfrom")).select(
        "module", "rkind", "name", "asname", "imp_module", "imp_level")


@register("E4_functions", SRC_SQL + """
SELECT module || '.f' || ks AS key, CAST(NULL AS VARCHAR) AS returns, false AS is_async, 5 AS n_args, '' AS decorators FROM okm""")
def q_e4(spark, sf_dir):
    r = parsed(spark, sf_dir).where((F.col("rkind") == "function") & F.col("class_path").isNull())
    return r.select(F.concat_ws(".", "module", "name").alias("key"), "returns", "is_async",
                    F.size("args").alias("n_args"), F.array_join("decorators", "|").alias("decorators"))


@register("E5_arguments", SRC_SQL + """
SELECT module || '.f' || ks AS key, 0 AS pos, 'a' AS name, CAST(NULL AS VARCHAR) AS dflt, false AS pos_only, false AS kw_only, false AS vararg, false AS kwarg FROM okm
UNION ALL SELECT module || '.f' || ks, 1, 'b', CAST(sz AS VARCHAR), false, false, false, false FROM okm
UNION ALL SELECT module || '.f' || ks, 2, 'c', NULL, false, false, true, false FROM okm
UNION ALL SELECT module || '.f' || ks, 3, 'd', NULL, false, true, false, false FROM okm
UNION ALL SELECT module || '.f' || ks, 4, 'e', NULL, false, false, false, true FROM okm""")
def q_e5(spark, sf_dir):
    r = parsed(spark, sf_dir).where((F.col("rkind") == "function") & F.col("class_path").isNull())
    return r.select(F.concat_ws(".", "module", "name").alias("key"), F.posexplode("args").alias("pos", "a")).select(
        "key", "pos", "a.name", F.col("a.default").alias("dflt"), "a.pos_only", "a.kw_only", "a.vararg", "a.kwarg")


@register("E6_variables", SRC_SQL + """
SELECT module || '.K' || ks AS key, CAST(NULL AS VARCHAR) AS var_type, CAST(sz AS VARCHAR) AS value FROM okm""")
def q_e6(spark, sf_dir):
    r = parsed(spark, sf_dir).where(F.col("rkind") == "variable")
    return r.select(F.concat_ws(".", "module", "name").alias("key"), "var_type", "value")


@register("E7_class_members", SRC_SQL + """
SELECT module || '.C' || ks AS class_key, 'S' AS name, 'static_field' AS mkind, '1' AS value FROM okm
UNION ALL SELECT module || '.C' || ks, '__init__', 'method', NULL FROM okm
UNION ALL SELECT module || '.C' || ks, 'x', 'field', 'x' FROM okm""")
def q_e7(spark, sf_dir):
    return K.build_members(parsed(spark, sf_dir)).select("class_key", "name", "mkind", "value")


@register("E8_instance_fields", SRC_SQL + "SELECT module || '.C' || ks AS class_key, 'x' AS name, 'x' AS value FROM okm")
def q_e8(spark, sf_dir):
    return K.build_members(parsed(spark, sf_dir)).where(F.col("mkind") == "field").select("class_key", "name", "value")


@register("E7_class_bases", SRC_SQL + "SELECT module || '.C' || ks AS key, 'B' AS bases FROM okm")
def q_e7b(spark, sf_dir):
    r = parsed(spark, sf_dir).where((F.col("rkind") == "class") & ~F.col("class_path").contains("."))
    return r.select(F.concat_ws(".", "module", "name").alias("key"), F.array_join("bases", ",").alias("bases"))


@register("E18_signatures", SRC_SQL + """
SELECT module || '.f' || ks AS key, 'def f' || ks || '(a, b = ' || CAST(sz AS VARCHAR) || ', *c, d, **e)' AS signature FROM okm
UNION ALL SELECT module || '.C' || ks || '.__init__', 'def __init__(self, x)' FROM okm
UNION ALL SELECT module || '.K' || ks, 'K' || ks || ' : None = ' || CAST(sz AS VARCHAR) FROM okm""")
def q_e18(spark, sf_dir):
    r = parsed(spark, sf_dir)
    funcs = r.where(F.col("rkind") == "function").select(
        F.concat_ws(".", "module", "class_path", "name").alias("key"),
        G.function_signature("name", "args", "decorators", "is_async", "returns").alias("signature"))
    var = r.where(F.col("rkind") == "variable").select(
        F.concat_ws(".", "module", "name").alias("key"), G.variable_signature("name", "var_type", "value").alias("signature"))
    return funcs.unionByName(var)


@register("E16_extraction_status", SRC_SQL + """
SELECT 'pkg' AS pkg, '1.0' AS ver, (SELECT count(*) FROM b_source WHERE k % 40 = 0) AS n_failed, false AS error,
       (SELECT count(*) FROM b_source) AS n_modules""")
def q_e16(spark, sf_dir):
    st = K.extraction_status(P.parse_sources(sources(spark, sf_dir)))  # read once: not worth keeping
    return st.select("pkg", "ver", "n_failed", "error", "n_modules")


# ------------------------------------------------------------------ client side

CLI_SQL = binding_cte("b_source") + """,
okf AS (SELECT k, module || '.py' AS src_file, CAST(k AS VARCHAR) AS ks,
        (SELECT p_size FROM part WHERE p_partkey = k) AS sz FROM b_source WHERE k % 40 <> 0)
"""


@register("A1_A2_import_events", CLI_SQL + """
SELECT src_file, 'os' AS text, 1 AS line FROM okf UNION ALL SELECT src_file, 'lib.g', 2 FROM okf""")
def q_a1(spark, sf_dir):
    return client_events(spark, sf_dir).where(F.col("ev") == "import").select("src_file", "text", "line")


@register("A5_assignment_aliases", CLI_SQL + """
SELECT src_file, 'h' AS name, 'lib.g' AS target FROM okf
UNION ALL SELECT src_file, 'K' || ks, CAST(sz AS VARCHAR) FROM okf
UNION ALL SELECT src_file, 'S', '1' FROM okf
UNION ALL SELECT src_file, 'self.x', 'x' FROM okf""")
def q_a5(spark, sf_dir):
    return client_events(spark, sf_dir).where(F.col("ev") == "alias").select(
        "src_file", F.col("text").alias("name"), "target").distinct()


@register("A3_A4_call_events", CLI_SQL + """
SELECT src_file, 'os' AS text, 1 AS line FROM okf UNION ALL SELECT src_file, 'h', 2 FROM okf
UNION ALL SELECT src_file, 'self.x', 7 FROM okf UNION ALL SELECT src_file, 'os.getenv(*)', 8 FROM okf
UNION ALL SELECT src_file, 'os.getenv', 8 FROM okf UNION ALL SELECT src_file, 'h(*)', 8 FROM okf""")
def q_a3(spark, sf_dir):
    return client_events(spark, sf_dir).where(F.col("ev") == "call").select("src_file", "text", "line")


@register("A6_alias_substitution", CLI_SQL + """
SELECT src_file, c AS call, l AS lines FROM okf, (VALUES ('os', '1'), ('h', '2'), ('self.x', '7'), ('os.getenv(*)', '8'),
  ('os.getenv', '8'), ('h(*)', '8'), ('lib.g', '2'), ('lib.g(*)', '8')) t(c, l)""")
def q_a6(spark, sf_dir):
    r = A.substitute_aliases(client_events(spark, sf_dir))
    return r.select("src_file", "call", F.array_join("lines", ",").alias("lines"))


@register("A12_access_chains", CLI_SQL + """
SELECT src_file, c AS chain, l AS lines FROM okf, (VALUES ('os', '1'), ('os.getenv(*)', '8'), ('os.getenv', '8'),
  ('lib.g', '2'), ('lib.g(*)', '8')) t(c, l)""")
def q_a12(spark, sf_dir):
    c = A.access_chains(client_events(spark, sf_dir))
    return c.select("src_file", "chain", F.array_join("lines", ",").alias("lines"))


@register("S25_bad_client_files", CLI_SQL + "SELECT module || '.py' AS src_file FROM b_source WHERE k % 40 = 0")
def q_s25(spark, sf_dir):
    return client_events(spark, sf_dir).where(F.col("ev") == "failed").select("src_file")


@register("K11_class_names", SRC_SQL + """
SELECT module || '.C' || ks AS class_key, '__init__' AS name FROM okm
UNION ALL SELECT module || '.C' || ks, 'x' FROM okm
UNION ALL SELECT module || '.C' || ks, 'S' FROM okm""")
def q_k11(spark, sf_dir):
    return K.class_names(K.build_members(parsed(spark, sf_dir))).select("class_key", "name")


@register("K12_public_names", SRC_SQL + """
SELECT DISTINCT name FROM (
  SELECT module || '.' || n AS name FROM okm, (VALUES ('os'), ('h')) t(n)
  UNION ALL SELECT module || '.K' || ks FROM okm UNION ALL SELECT module || '.f' || ks FROM okm
  UNION ALL SELECT module || '.C' || ks FROM okm
  UNION ALL SELECT module || '.C' || ks || '.' || m FROM okm, (VALUES ('__init__'), ('x'), ('S')) t(m))""")
def q_k12(spark, sf_dir):
    rows = parsed(spark, sf_dir)
    return K.public_names(K.build_entities(rows), K.build_members(rows)).select("name").distinct()


@register("E19_literal_values", SRC_SQL + """
SELECT module || '.K' || ks AS key, 'int' AS kind, CAST(sz AS BIGINT) AS int_value FROM okm
UNION ALL SELECT module || '.C' || ks || '.S', 'int', 1 FROM okm
UNION ALL SELECT module || '.C' || ks || '.x', NULL, NULL FROM okm""")
def q_e19(spark, sf_dir):
    """Typed value of variable and field texts (no eval)."""
    rows = parsed(spark, sf_dir)
    v = rows.where(F.col("rkind") == "variable").select(F.concat_ws(".", "module", "name").alias("key"), "value")
    m = K.build_members(rows).where(F.col("mkind").isin("field", "static_field")).select(
        F.concat_ws(".", "class_key", "name").alias("key"), "value")
    lv = G.literal_value(F.col("value"))
    return v.unionByName(m).select("key", lv["kind"].alias("kind"), lv["int_value"].alias("int_value"))


@register("E20_constructors", SRC_SQL + """
SELECT module || '.C' || ks AS class_key, 'def __init__(self, x)' AS signature FROM okm""")
def q_e20(spark, sf_dir):
    """Constructor of each class: its first ``__init__`` method."""
    rows = parsed(spark, sf_dir)
    m = rows.where((F.col("mkind") == "method") & (F.col("name") == "__init__"))
    first = m.groupBy("module", "class_path").agg(F.min_by(F.struct("args", "decorators", "is_async", "returns", "name"),
                                                           F.col("ord")).alias("f"))
    return first.select(F.concat_ws(".", "module", "class_path").alias("class_key"),
                        G.function_signature("f.name", "f.args", "f.decorators", "f.is_async", "f.returns").alias("signature"))


@register("K5_exact_lookup", SRC_SQL + """
SELECT 'pkg.' || module AS key, 'module' AS kind FROM b_source
UNION ALL SELECT 'pkg', 'module'
UNION ALL SELECT module || '.' || n, kd FROM okm, (VALUES ('os', 'alias'), ('h', 'alias')) t(n, kd)
UNION ALL SELECT module || '.K' || ks, 'variable' FROM okm UNION ALL SELECT module || '.f' || ks, 'function' FROM okm
UNION ALL SELECT module || '.C' || ks, 'class' FROM okm""")
def q_k5(spark, sf_dir):
    """``pkg[key]`` for every module and entity name: a module wins over an
    entity of the same name; aliases are not followed.  A module whose text
    does not parse still exists (empty)."""
    from pkgscope.operators import chainmatch as CM

    rows = parsed(spark, sf_dir)
    objects, _, _ = CM.catalogue_tables(rows, K.build_entities(rows))
    rank = F.when(F.col("kind") == "module", 0).otherwise(1)
    return objects.groupBy("key").agg(F.min_by("kind", rank).alias("kind"))


@register("K10_member_lookup", SRC_SQL + """
SELECT module || '.C' || ks AS class_key, 'x' AS name, 'field' AS mkind, 'x' AS value FROM okm
UNION ALL SELECT module || '.C' || ks, 'S', 'static_field', '1' FROM okm
UNION ALL SELECT module || '.C' || ks, '__init__', 'method', NULL FROM okm""")
def q_k10(spark, sf_dir):
    """get_field('x'), get_static_field('S') and get_method('__init__') of every class."""
    mem = K.build_members(parsed(spark, sf_dir))
    want = spark.createDataFrame([("x", "field"), ("S", "static_field"), ("__init__", "method")], "name string, mkind string")
    return mem.join(F.broadcast(want), ["name", "mkind"]).select("class_key", "name", "mkind", "value")


@register("A13_snippet_loc_summary", CLI_SQL + """,
loc AS (SELECT k, len(string_split(src, chr(10))) AS loc FROM b_source WHERE k % 40 <> 0)
SELECT count(*) AS n_snippets, CAST(quantile_cont(loc, 0.5) AS DOUBLE) AS median_loc, min(loc) AS min_loc, max(loc) AS max_loc
FROM loc""")
def q_a13(spark, sf_dir):
    """Snippets that parse and import a known module (``os``): count and LOC summary."""
    s = client_sources(spark, sf_dir).withColumn("loc", F.size(F.split("src", "\\n")))
    ev = client_events(spark, sf_dir)
    ok = ev.where((F.col("ev") == "import") & (F.col("text") == "os")).select("src_file").distinct()
    bad = ev.where(F.col("ev") == "failed").select("src_file")
    good = s.join(ok, "src_file", "left_semi").join(bad, "src_file", "left_anti")
    d = R.describe(good, "loc")
    return d.select(F.col("count").alias("n_snippets"), F.col("q50").alias("median_loc"), F.col("min").alias("min_loc"), F.col("max").alias("max_loc"))


@register("A13_snippet_sample", CLI_SQL + """,
loc AS (SELECT module || '.py' AS src_file, len(string_split(src, chr(10))) AS loc FROM b_source WHERE k % 40 <> 0)
SELECT src_file, loc FROM loc WHERE loc <= (SELECT quantile_cont(loc, 0.5) FROM loc) ORDER BY md5(src_file || '42'), src_file LIMIT 100""")
def q_a13s(spark, sf_dir):
    """Seeded sample of 100 snippets at or under the median LOC (order of md5 of name and seed)."""
    s = client_sources(spark, sf_dir).withColumn("loc", F.size(F.split("src", "\\n")))
    bad = client_events(spark, sf_dir).where(F.col("ev") == "failed").select("src_file")
    good = s.join(bad, "src_file", "left_anti")
    med = R.exact_quantiles(good, [], "loc", [0.5]).select(F.col("q")[0].alias("_med"))
    small = good.join(F.broadcast(med)).where(F.col("loc") <= F.col("_med"))
    return small.select("src_file", "loc").orderBy(F.md5(F.concat("src_file", F.lit("42"))), "src_file").limit(100)


@register("K9_query", SRC_SQL + """,
req AS (
  SELECT 'pkg' AS key, 'pkg' AS result_key, 'module' AS result_kind
  UNION ALL SELECT 'pkg.' || module, 'pkg.' || module, 'module' FROM b_source
  UNION ALL SELECT module || '.K' || ks, module || '.K' || ks, 'variable' FROM okm
  UNION ALL SELECT module || '.f' || ks, module || '.f' || ks, 'function' FROM okm
  UNION ALL SELECT module || '.C' || ks, module || '.C' || ks, 'class' FROM okm
  UNION ALL SELECT module || '.os', NULL, NULL FROM okm
  UNION ALL SELECT module || '.h', NULL, NULL FROM okm
  UNION ALL SELECT module || '.C' || ks || '.' || m, module || '.C' || ks || '.' || m, mk FROM okm,
    (VALUES ('x', 'field'), ('S', 'static_field'), ('__init__', 'method')) t(m, mk)
  UNION ALL SELECT module || '.C' || ks || '.nope', NULL, NULL FROM okm
  UNION ALL SELECT 'pkg.' || module || '.K' || CAST(k AS VARCHAR), NULL, NULL FROM b_source WHERE k % 40 = 0)
SELECT key, result_key, result_kind FROM req""")
def q_k9(spark, sf_dir):
    """``query(key)`` for every module, entity, class member, an unknown member
    per class and the names of unparsable modules."""
    from pkgscope.operators import chainmatch as CM

    rows = parsed(spark, sf_dir)
    ent = K.build_entities(rows)
    mem = K.build_members(rows)
    objects, _, _ = CM.catalogue_tables(rows, ent)
    failed = rows.where(F.col("rkind") == "failed").select(
        F.concat("module", F.lit(".K"), F.regexp_extract("module", r"(\d+)$", 1)).alias("key"))
    req = (
        objects.select("key").where(~F.col("key").endswith(".*") & ~F.col("key").contains(".__init__"))
        .unionByName(mem.where(F.col("mkind").isin("method", "field", "static_field"))
                     .select(F.concat_ws(".", "class_key", "name").alias("key")))
        .unionByName(ent.where(F.col("kind") == "class").select(F.concat(F.col("key"), F.lit(".nope")).alias("key")))
        .unionByName(failed)
        .distinct()
        .select(F.lit(PKG).alias("pkg"), F.lit(VER).alias("ver"), "key")
    )
    return K.query_keys(req, objects, mem, ["pkg", "ver"]).select("key", "result_key", "result_kind")
