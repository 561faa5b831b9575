"""Queries over written tables: each writes its table to the shared folder,
reads it back and works on what it read (S8-S15, S17-S20, S24, E21, E22, R16, R21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pkgscope.operators import reports as R
from pkgscope.plans.q_sources import choose_wheel
from pkgscope.plans.registry import ORACLES, QUERIES, register
from pkgscope.sources import tables as T
from pkgscope.sources.bindings import binding, binding_cte, table


def stored(df, name, schema, by=()):
    """``df`` written as a table and read back."""
    path = T.new_folder(df.sparkSession, name)
    T.write_table(df, path, by)
    return T.read_table(df.sparkSession, path, schema)


# ------------------------------------------------------------------ catalogues

@register("E21_S9_dynamic_catalogue", binding_cte("b_entity") + """
SELECT top_level AS pkg, CAST(ver AS VARCHAR) AS ver, key, kind FROM b_entity WHERE kind <> 'alias'""")
def q_e21(spark, sf_dir):
    """Two catalogues under one schema; the dynamic one, as inspection gives it, has no aliases."""
    static = binding(spark, sf_dir, "b_entity").select(F.col("top_level").alias("pkg"), F.col("ver").cast("string").alias("ver"), "top_level", "key", "kind")
    path = T.new_folder(spark, "catalogue")
    T.write_catalogue(static.withColumn("mode", F.lit("static")).unionByName(static.where("kind <> 'alias'").withColumn("mode", F.lit("dynamic"))), path)
    return T.read_catalogue(spark, path, "dynamic").select("pkg", "ver", "key", "kind")


@register("S8_name_list", binding_cte("b_entity") + """
SELECT DISTINCT top_level AS pkg, CAST(ver AS VARCHAR) AS ver, top_level, key FROM b_entity WHERE top_level <> 'pkg3'""")
def q_s8(spark, sf_dir):
    """Name list of every package version; a top level that holds a slash is skipped."""
    rows = binding(spark, sf_dir, "b_entity").select(
        F.col("top_level").alias("pkg"), F.col("ver").cast("string").alias("ver"), F.lit("static").alias("mode"),
        F.when(F.col("top_level") == "pkg3", "lib/pkg3").otherwise(F.col("top_level")).alias("top_level"), "key", "kind")
    path = T.new_folder(spark, "catalogue")
    T.write_catalogue(rows, path)
    return T.name_list(T.read_catalogue(spark, path)).select("pkg", "ver", "top_level", "key")


@register("S20_E22_stdlib", """
SELECT CASE r_regionkey WHEN 1 THEN '3.6' WHEN 2 THEN '3.7' WHEN 3 THEN '3.8' ELSE '3.9' END AS ver, count(*) AS modules
FROM part, region WHERE r_regionkey > 0 AND p_partkey % 10 <> 0 AND (p_partkey + r_regionkey) % 7 <> 0 GROUP BY 1""")
def q_s20(spark, sf_dir):
    """Modules of each interpreter release that the standard-library catalogue lists."""
    release = F.element_at(F.array(*[F.lit(v) for v in ("2.7", "3.6", "3.7", "3.8", "3.9")]), (F.col("r_regionkey") + 1).cast("int"))
    parts = table(spark, sf_dir, "part").select("p_partkey")
    regions = table(spark, sf_dir, "region").select("r_regionkey")  # five rows
    modules = parts.join(F.broadcast(regions), (F.col("p_partkey") + F.col("r_regionkey")) % 7 != 0).select(
        release.alias("ver"), F.concat(F.when(F.col("p_partkey") % 10 == 0, "test.mod").otherwise("mod"), F.col("p_partkey").cast("string")).alias("module"))
    rows = T.stdlib_modules(modules).select("pkg", "ver", F.lit("static").alias("mode"), "top_level", F.col("module").alias("key"), F.lit("module").alias("kind"))
    path = T.new_folder(spark, "stdlib")
    T.write_catalogue(rows, path)
    found = T.read_catalogue(spark, path)
    return found.join(T.stdlib_versions(found), "ver", "left_semi").groupBy("ver").agg(F.count("*").alias("modules"))


# ------------------------------------------------------------------ statistics

STATS = "package string, version string, time timestamp, requires_dist array<string>, wheel string, error boolean, apis_static bigint, apis_dynamic bigint"

STATISTICS_SQL = binding_cte("b_stats", "b_wheel") + """,
w AS (SELECT pkg, ver, filename, string_split(filename, '-') AS p, ord, ord2 FROM b_wheel WHERE ends_with(filename, '.whl')),
x AS (SELECT *, row_number() OVER (PARTITION BY pkg, ver ORDER BY p[len(p) - 2] DESC, ord, ord2, filename) AS nth FROM w
      WHERE len(p) IN (5, 6) AND (contains(p[len(p)], 'any') OR contains(p[len(p)], 'linux'))),
q AS (SELECT '0.' || l_orderkey AS version, list_sort(list('pkg' || (l_partkey % 50) || '>=1.' || l_linenumber)) AS requires_dist
      FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY l_orderkey),
s AS (SELECT package, b_stats.version, CAST(time AS TIMESTAMP) AS time, q.requires_dist, x.filename AS wheel, error,
             CASE WHEN NOT error THEN num_apis END AS apis_static
      FROM b_stats LEFT JOIN q ON q.version = b_stats.version LEFT JOIN x ON x.nth = 1 AND x.pkg = package AND '0.' || x.ver = b_stats.version),
d AS (SELECT *, CASE WHEN ends_with(version, '4') THEN apis_static + 1 END AS apis_dynamic FROM s)
"""


def statistics(spark, sf_dir):
    b = binding(spark, sf_dir, "b_stats")
    line = table(spark, sf_dir, "lineitem")
    order = b.select("package", "version", F.col("time").cast("timestamp").alias("time"))
    texts = line.where("l_orderkey % 3 <> 0").selectExpr(
        "concat('0.', l_orderkey) AS version", "concat('pkg', l_partkey % 50, '>=1.', l_linenumber) AS requires_dist")
    requires = order.select("package", "version").join(texts, "version")
    wheels = choose_wheel(binding(spark, sf_dir, "b_wheel")).select(F.col("pkg").alias("package"), F.concat(F.lit("0."), "ver").alias("version"), "wheel")
    static = b.select("package", "version", "error", F.when(~F.col("error"), F.col("num_apis")).alias("apis_static"))
    return stored(T.version_statistics(order, requires, wheels, static), "statistics", STATS, ("package",))


def merged(spark, sf_dir):
    """Statistics with the dynamic summaries, written again."""
    s = statistics(spark, sf_dir)
    dynamic = s.where(F.col("version").endswith("4") & F.col("apis_static").isNotNull()).select("package", "version", (F.col("apis_static") + 1).alias("apis"))
    return stored(T.merge_dynamic(s, dynamic), "statistics", STATS, ("package",))


@register("S11_version_statistics", STATISTICS_SQL + """
SELECT package, version, time, array_to_string(requires_dist, ',') AS requires_dist, wheel, error, apis_static FROM s""")
def q_s11(spark, sf_dir):
    return statistics(spark, sf_dir).select("package", "version", "time", F.array_join("requires_dist", ",").alias("requires_dist"), "wheel", "error", "apis_static")


@register("S12_S13_merged_statistics", STATISTICS_SQL + """
SELECT package, count(*) AS versions, count(wheel) AS wheels, count(apis_dynamic) AS dynamic_versions,
       CAST(sum(apis_static) AS BIGINT) AS apis_static, CAST(sum(apis_dynamic) AS BIGINT) AS apis_dynamic FROM d GROUP BY package""")
def q_s13(spark, sf_dir):
    return merged(spark, sf_dir).groupBy("package").agg(
        F.count("*").alias("versions"), F.count("wheel").alias("wheels"), F.count("apis_dynamic").alias("dynamic_versions"),
        F.sum("apis_static").alias("apis_static"), F.sum("apis_dynamic").alias("apis_dynamic"))


@register("S14_availability", STATISTICS_SQL + """,
p AS (SELECT DISTINCT 'pkg' || (o_custkey % 60) AS package FROM orders)
SELECT p.package, count(d.package) > 0 AS has_metadata, count(requires_dist) > 0 AS has_req, count(apis_static) > 0 AS has_api,
       count(apis_dynamic) > 0 AS has_dynamic_api FROM p LEFT JOIN d USING (package) GROUP BY p.package""")
def q_s14(spark, sf_dir):
    """Projects of a candidate list, some of which were never extracted."""
    projects = table(spark, sf_dir, "orders").selectExpr("concat('pkg', o_custkey % 60) AS package").distinct()
    return T.availability(projects, merged(spark, sf_dir))


@register("S15_unfinished", binding_cte("b_req", "b_usage") + """
SELECT DISTINCT c_pkg, dep AS u_pkg FROM b_req WHERE (c_pkg, dep) NOT IN (SELECT (c_pkg, u_pkg) FROM b_usage WHERE status = 'MISMATCH')""")
def q_s15(spark, sf_dir):
    """Required pairs without a row in the finished table."""
    done = stored(binding(spark, sf_dir, "b_usage").where("status = 'MISMATCH'").select("c_pkg", "u_pkg").distinct(), "finished", "c_pkg string, u_pkg string")
    asked = binding(spark, sf_dir, "b_req").select("c_pkg", F.col("dep").alias("u_pkg")).distinct()
    return T.unfinished(asked, done, ["c_pkg", "u_pkg"])


@register("R16_totals_by_mode", binding_cte("b_stats") + """,
m AS (SELECT 'static' AS mode, * FROM b_stats UNION ALL
      SELECT 'dynamic', * REPLACE (error OR wheel IS NULL AS error, n_failed_modules + 1 AS n_failed_modules) FROM b_stats)
SELECT mode, count(*) FILTER (WHERE NOT error) AS versions_no_error, count(DISTINCT package) FILTER (WHERE NOT error) AS packages_no_error,
  count(*) FILTER (WHERE NOT error AND n_failed_modules = 0) AS versions_no_failed,
  count(DISTINCT package) FILTER (WHERE NOT error AND n_failed_modules = 0) AS packages_no_failed,
  CAST(sum(num_modules) FILTER (WHERE NOT error) AS BIGINT) AS modules,
  CAST(sum(n_failed_modules) FILTER (WHERE NOT error) AS BIGINT) AS failed_modules,
  CAST(sum(num_apis) FILTER (WHERE NOT error) AS BIGINT) AS apis FROM m GROUP BY mode""")
def q_r16(spark, sf_dir):
    """Extraction totals of both modes; a version without a wheel can't be installed."""
    s = binding(spark, sf_dir, "b_stats")
    d = s.withColumn("error", F.col("error") | F.col("wheel").isNull()).withColumn("n_failed_modules", F.col("n_failed_modules") + 1)
    return R.extraction_totals(s.withColumn("mode", F.lit("static")).unionByName(d.withColumn("mode", F.lit("dynamic"))), by=("mode",))


@register("S10_R21_dynamic_failed_modules", binding_cte("b_stats") + """,
f AS (SELECT num_apis % 7 AS e FROM b_stats, range(0, 3) r(i) WHERE i < n_failed_modules AND NOT error)
SELECT CASE e WHEN 0 THEN 'RecursionError' WHEN 1 THEN 'ImportError' WHEN 2 THEN 'ImportError' WHEN 3 THEN 'SyntaxError' ELSE 'Other' END AS type,
       count(*) AS n FROM f GROUP BY 1""")
def q_r21(spark, sf_dir):
    """Failed modules of the dynamic mode, one row each, classed."""
    texts = F.array(*[F.lit(t) for t in ("RecursionError: deep", "ImportError: x", "ModuleNotFoundError: y", "SyntaxError: z", "OSError", "KeyError: 'a'", "")])
    rows = binding(spark, sf_dir, "b_stats").where("NOT error AND n_failed_modules > 0").select(
        F.col("package").alias("pkg"), F.col("version").alias("ver"), F.lit("dynamic").alias("mode"),
        F.element_at(texts, (F.col("num_apis") % 7 + 1).cast("int")).alias("error"), F.explode(F.sequence(F.lit(1), F.col("n_failed_modules").cast("int"))).alias("i"))
    failed = stored(rows.withColumn("module", F.concat(F.lit("m"), F.col("i").cast("string"))).drop("i"), "failed",
                    "pkg string, ver string, mode string, module string, error string", ("mode",))
    return R.dynamic_failed_module_classes(failed.where("mode = 'dynamic'"))


# ------------------------------------------------------------------ usage, changes, reports

@register("S17_change_table", ORACLES["D21_entity_diff"])
def q_s17(spark, sf_dir):
    """The change rows of every version pair, written and read back."""
    changes = QUERIES["D21_entity_diff"](spark, sf_dir)
    return stored(changes, "changes", changes.schema)


@register("S18_dependents", binding_cte("b_usage") + """
SELECT u_pkg, c_pkg, c_ver, count(*) AS n FROM b_usage WHERE u_pkg IN (SELECT u_pkg FROM b_usage WHERE status = 'MISSING') GROUP BY ALL""")
def q_s18(spark, sf_dir):
    """Dependents of the packages that some client misses an API of."""
    schema = "u_pkg string, c_pkg string, c_ver string, api string, status string"
    usage = stored(binding(spark, sf_dir, "b_usage").select("u_pkg", "c_pkg", "c_ver", "api", "status"), "usage", schema, ("u_pkg",))
    return T.dependents(usage, usage.where("status = 'MISSING'")).groupBy("u_pkg", "c_pkg", "c_ver").agg(F.count("*").alias("n"))


@register("S19_violation_report", binding_cte("b_usage") + """
SELECT c_pkg, u_pkg, dep_ver, message, count(*) AS n FROM b_usage WHERE status <> 'MATCH' GROUP BY ALL""")
def q_s19(spark, sf_dir):
    """The summary of violations as CSV, read back; versions stay text."""
    bad = binding(spark, sf_dir, "b_usage").where("status <> 'MATCH'").groupBy("c_pkg", "u_pkg", "dep_ver", "message").agg(F.count("*").alias("n"))
    path = T.new_folder(spark, "violations")
    T.write_csv(bad, path)
    return T.read_csv(spark, path, "c_pkg string, u_pkg string, dep_ver string, message string, n bigint")


@register("S24_work_list", binding_cte("b_req") + "\nSELECT DISTINCT c_pkg, c_ver, dep, spec FROM b_req")
def q_s24(spark, sf_dir):
    """Client work list as CSV, read back; an empty specifier stays empty."""
    path = T.new_folder(spark, "work")
    T.write_csv(binding(spark, sf_dir, "b_req").select("c_pkg", "c_ver", "dep", "spec").distinct(), path)
    return T.read_csv(spark, path, "c_pkg string, c_ver string, dep string, spec string").fillna({"spec": ""})
