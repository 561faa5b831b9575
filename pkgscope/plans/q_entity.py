"""Queries over the entity catalogue binding: entity-level diffs (D1-D4, D13,
D14, D20, D21), API statistics (E17), key listings (K1-K3, K6) and the
evolution reports (R32-R35)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pkgscope.functions import versions as V
from pkgscope.operators import catalog as K
from pkgscope.operators import diff as D
from pkgscope.plans.q_diff import BREAKING_SQL, MESSAGE_SQL
from pkgscope.plans.registry import register, sql_str
from pkgscope.sources import tables as T
from pkgscope.sources.bindings import binding, binding_cte


def entities(spark, sf_dir):
    """b_entity as a catalogue: package = top level, version text."""
    e = binding(spark, sf_dir, "b_entity")
    return e.select(F.col("top_level").alias("pkg"), F.col("ver").cast("string").alias("ver"), "key", "kind")


def entity_pairs(spark, sf_dir):
    e = entities(spark, sf_dir)
    return e, V.adjacent_pairs(e.select("pkg", "ver").distinct())


def entity_diffs(spark, sf_dir):
    e, pairs = entity_pairs(spark, sf_dir)
    return D.with_flags(D.diff_versions(e, pairs))


ENT_SQL = binding_cte("b_entity") + f""",
e AS (SELECT top_level AS pkg, CAST(ver AS VARCHAR) AS ver, key, kind FROM b_entity),
pairs AS (SELECT pkg, v1, v2 FROM (
  SELECT pkg, ver AS v1, lead(ver) OVER (PARTITION BY pkg ORDER BY CAST(ver AS INTEGER)) AS v2
  FROM (SELECT DISTINCT pkg, ver FROM e)) WHERE v2 IS NOT NULL),
o AS (SELECT p.pkg, p.v1, p.v2, e.key, e.kind FROM pairs p JOIN e ON e.pkg = p.pkg AND e.ver = p.v1),
n AS (SELECT p.pkg, p.v1, p.v2, e.key, e.kind FROM pairs p JOIN e ON e.pkg = p.pkg AND e.ver = p.v2),
j AS (
  SELECT coalesce(o.pkg, n.pkg) AS pkg, coalesce(o.v1, n.v1) AS v1, coalesce(o.v2, n.v2) AS v2,
         coalesce(o.key, n.key) AS key, o.kind AS ok, n.kind AS nk
  FROM o FULL OUTER JOIN n ON o.pkg = n.pkg AND o.v1 = n.v1 AND o.v2 = n.v2 AND o.key = n.key),
d0 AS (
  SELECT pkg, v1, v2, key AS api_name, CAST(NULL AS VARCHAR) AS param,
    CASE WHEN ok IS NULL THEN CASE nk WHEN 'class' THEN 'Class Addition' WHEN 'function' THEN 'Function Addition'
                                      WHEN 'variable' THEN 'Variable Addition' END
         ELSE CASE ok WHEN 'class' THEN 'Class Removal' WHEN 'function' THEN 'Function Removal'
                      WHEN 'variable' THEN 'Variable Removal' END END AS diff_type,
    CAST(NULL AS VARCHAR) AS old_value, CAST(NULL AS VARCHAR) AS new_value
  FROM j WHERE ok IS NULL OR nk IS NULL),
ed AS (SELECT *, {BREAKING_SQL} AS is_breaking, {MESSAGE_SQL} AS message FROM d0 WHERE diff_type IS NOT NULL)
"""


@register("D21_entity_diff", ENT_SQL + "SELECT * FROM ed")
def q_d21(spark, sf_dir):
    return entity_diffs(spark, sf_dir)


_ENTITY_TYPES = {
    "D1_class_addition": D.CLS_ADD,
    "D2_class_removal": D.CLS_REM,
    "D3_function_addition": D.FUNC_ADD,
    "D4_function_removal": D.FUNC_REM,
    "D13_variable_addition": D.VAR_ADD,
    "D14_variable_removal": D.VAR_REM,
}


def _typed(dt):
    def q(spark, sf_dir):
        return entity_diffs(spark, sf_dir).where(F.col("diff_type") == dt)

    return q


for _name, _dt in _ENTITY_TYPES.items():
    register(_name, ENT_SQL + f"SELECT * FROM ed WHERE diff_type = {sql_str(_dt)}")(_typed(_dt))


@register("D20_suppressed_keys", ENT_SQL + """
SELECT pkg, v1, v2, key, ok AS old_kind, nk AS new_kind FROM j
WHERE ok IS NOT NULL AND nk IS NOT NULL AND (ok <> nk OR ok IN ('alias', 'wildcard'))""")
def q_d20(spark, sf_dir):
    """Keys on both sides that yield no change: kind changed, or an alias."""
    e, pairs = entity_pairs(spark, sf_dir)
    by = ["pkg", "v1", "v2"]
    o = D._side(e, pairs, "v1", by).withColumnRenamed("kind", "old_kind")
    n = D._side(e, pairs, "v2", by).withColumnRenamed("kind", "new_kind")
    return o.join(n, by + ["key"]).where(
        (F.col("old_kind") != F.col("new_kind")) | F.col("old_kind").isin("alias", "wildcard"))


@register("V10_entity_version_pairs", ENT_SQL + "SELECT pkg, v1, v2 FROM pairs")
def q_v10e(spark, sf_dir):
    return entity_pairs(spark, sf_dir)[1]


@register("E17_api_statistics", ENT_SQL + """
SELECT pkg, ver, count(*) AS num_apis, count(DISTINCT regexp_replace(key, '\\.[^.]*$', '')) + 1 AS num_modules,
  count(*) FILTER (WHERE kind = 'function') AS num_functions, count(*) FILTER (WHERE kind = 'class') AS num_classes,
  count(*) FILTER (WHERE kind = 'variable') AS num_variables, count(*) FILTER (WHERE kind IN ('alias', 'wildcard')) AS num_aliases
FROM e GROUP BY pkg, ver""")
def q_e17(spark, sf_dir):
    e = entities(spark, sf_dir)
    mods = K.modules_of(e).groupBy("pkg", "ver").agg(F.count(F.lit(1)).alias("num_modules"))
    return K.api_statistics(e).join(mods, ["pkg", "ver"]).select(
        "pkg", "ver", "num_apis", "num_modules", "num_functions", "num_classes", "num_variables", "num_aliases")


@register("K1_keys", ENT_SQL + "SELECT pkg, ver, key FROM e")
def q_k1(spark, sf_dir):
    return entities(spark, sf_dir).select("pkg", "ver", "key")


@register("K3_modules", ENT_SQL + """
SELECT DISTINCT pkg, ver, regexp_replace(key, '\\.[^.]*$', '') AS module FROM e
UNION SELECT DISTINCT pkg, ver, pkg AS module FROM e""")
def q_k3(spark, sf_dir):
    return K.modules_of(entities(spark, sf_dir))


@register("K2_keys_and_modules", ENT_SQL + """
SELECT pkg, ver, key FROM e
UNION ALL SELECT DISTINCT pkg, ver, regexp_replace(key, '\\.[^.]*$', '') FROM e
UNION ALL SELECT DISTINCT pkg, ver, pkg FROM e""")
def q_k2(spark, sf_dir):
    e = entities(spark, sf_dir)
    return e.select("pkg", "ver", "key").unionByName(K.modules_of(e).withColumnRenamed("module", "key"))


@register("K6_contains_next", ENT_SQL + """
SELECT p.pkg, p.v1, p.v2, n.key, EXISTS (SELECT 1 FROM e WHERE e.pkg = p.pkg AND e.ver = p.v1 AND e.key = n.key)
  OR n.key IN (SELECT DISTINCT regexp_replace(key, '\\.[^.]*$', '') FROM e WHERE e.pkg = p.pkg AND e.ver = p.v1) AS in_old
FROM pairs p JOIN e n ON n.pkg = p.pkg AND n.ver = p.v2""")
def q_k6(spark, sf_dir):
    """K6: is each key of the newer version also a key (or module) of the older one?"""
    e, pairs = entity_pairs(spark, sf_dir)
    req = D._side(e.select("pkg", "ver", "key"), pairs, "v2", ["pkg", "v1", "v2"])
    found = K.contains(req.withColumnRenamed("v1", "ver"), e, ["pkg", "ver"])
    return found.withColumnRenamed("ver", "v1").select("pkg", "v1", "v2", "key", "in_old")


@register("R32_api_count_per_version", ENT_SQL + """
SELECT pkg, ver, count(*) AS apis, row_number() OVER (PARTITION BY pkg ORDER BY CAST(ver AS INTEGER)) AS ver_rank
FROM e GROUP BY pkg, ver""")
def q_r32(spark, sf_dir):
    e = entities(spark, sf_dir)
    c = e.groupBy("pkg", "ver").agg(F.count(F.lit(1)).alias("apis"))
    return c.withColumn("ver_rank", F.row_number().over(Window.partitionBy("pkg").orderBy(V.version_key(F.col("ver")))))


def evolution(spark, sf_dir):
    """R33 over entity diffs, impact columns from usage."""
    e, pairs = entity_pairs(spark, sf_dir)
    d = D.with_flags(D.diff_versions(e, pairs))
    d = d.withColumn("clients_used", F.lit(0).cast("bigint")).withColumn("clients_impacted", F.lit(0).cast("bigint"))
    return D.evolution_stats(d, pairs)


@register("R33_evolution_per_pair", ENT_SQL + """
SELECT p.pkg, p.v1, p.v2, CASE WHEN split_part(p.v1, '.', 1) <> split_part(p.v2, '.', 1) THEN 'major' ELSE 'minor' END AS bump,
  count(ed.diff_type) FILTER (WHERE ed.is_breaking) AS bc, count(ed.diff_type) FILTER (WHERE NOT ed.is_breaking) AS nbc,
  CAST(0 AS BIGINT) AS ubc, CAST(0 AS BIGINT) AS ibc
FROM pairs p LEFT JOIN ed ON ed.pkg = p.pkg AND ed.v1 = p.v1 AND ed.v2 = p.v2 GROUP BY p.pkg, p.v1, p.v2""")
def q_r33(spark, sf_dir):
    return evolution(spark, sf_dir)


@register("R34_change_type_table", ENT_SQL + """
SELECT diff_type, count(*) AS n_all, round(count(*) / sum(count(*)) OVER (), 9) AS share_all,
  CAST(0 AS BIGINT) AS n_used, CAST(0 AS BIGINT) AS n_impacted FROM ed GROUP BY diff_type""")
def q_r34(spark, sf_dir):
    e, pairs = entity_pairs(spark, sf_dir)
    d = D.with_flags(D.diff_versions(e, pairs))
    d = d.withColumn("clients_used", F.lit(0).cast("bigint")).withColumn("clients_impacted", F.lit(0).cast("bigint"))
    return D.change_type_table(d).withColumn("share_all", F.round("share_all", 9)).drop("share_used", "share_impacted")


@register("R35_pairs_by_bump", ENT_SQL + """,
ev AS (SELECT p.pkg, p.v1, p.v2, CASE WHEN split_part(p.v1, '.', 1) <> split_part(p.v2, '.', 1) THEN 'major' ELSE 'minor' END AS bump,
  count(ed.diff_type) FILTER (WHERE ed.is_breaking) AS bc
  FROM pairs p LEFT JOIN ed ON ed.pkg = p.pkg AND ed.v1 = p.v1 AND ed.v2 = p.v2 GROUP BY p.pkg, p.v1, p.v2)
SELECT bump, count(*) AS n_pairs, count(*) FILTER (WHERE bc = 0) AS n_no_breaking, count(*) AS n_no_used_breaking
FROM ev GROUP BY bump""")
def q_r35(spark, sf_dir):
    return D.pairs_by_bump(evolution(spark, sf_dir))


@register("V5_versions_with_catalogue", ENT_SQL + "SELECT DISTINCT pkg, ver FROM e")
def q_v5(spark, sf_dir):
    """Versions with catalogue data: at least one entity of any kind; a
    version with failed modules only has none."""
    return entities(spark, sf_dir).select("pkg", "ver").distinct()


@register("V6_versions_with_requirements", ENT_SQL + "SELECT DISTINCT pkg, ver FROM e WHERE CAST(ver AS INTEGER) % 2 = 0")
def q_v6(spark, sf_dir):
    """Versions with requirement data: those that the static catalogue holds,
    as both come out of the same wheel.  Odd versions are known dynamically only."""
    e = entities(spark, sf_dir).withColumn("mode", F.when(F.col("ver").cast("int") % 2 == 0, "static").otherwise("dynamic"))
    path = T.new_folder(spark, "catalogue")
    T.write_catalogue(e.withColumn("top_level", F.col("pkg")), path)
    return T.read_catalogue(spark, path, "static").select("pkg", "ver").distinct()
