"""Alias resolution queries (K8) over the alias edge binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from pkgscope.operators import catalog as K
from pkgscope.plans.registry import register
from pkgscope.sources.bindings import binding, binding_cte


def alias_closure(spark, sf_dir):
    edges = binding(spark, sf_dir, "b_alias")
    # Names of another top level ("ext...") are not loaded: unresolved.
    return K.resolve_aliases(edges, external=F.col("cur").startswith("ext"))


ALIAS_SQL = "WITH RECURSIVE " + binding_cte("b_alias")[5:] + """,
walk(src, cur, hops, path) AS (
  SELECT src, dst, 1, [src] FROM b_alias
  UNION ALL
  SELECT w.src, a.dst, w.hops + 1, list_append(w.path, w.cur)
  FROM walk w JOIN b_alias a ON a.src = w.cur WHERE NOT list_contains(w.path, w.cur)),
last AS (SELECT src, arg_max(cur, hops) AS cur, max(hops) AS hops FROM walk GROUP BY src)
SELECT src, CASE WHEN cur IN (SELECT src FROM b_alias) OR cur LIKE 'ext%' THEN NULL ELSE cur END AS final,
       CASE WHEN cur IN (SELECT src FROM b_alias) OR cur LIKE 'ext%' THEN NULL ELSE hops END AS hops
FROM last
"""


@register("K8_alias_resolution", ALIAS_SQL)
def q_k8(spark, sf_dir):
    return alias_closure(spark, sf_dir)
