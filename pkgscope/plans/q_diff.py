"""Queries for API changes (D rows) over the parameter and entity bindings."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pkgscope.operators import diff as D
from pkgscope.plans.registry import register, sql_str
from pkgscope.sources.bindings import binding, binding_cte


def param_diffs(spark, sf_dir):
    """D18 over the single pair (b_param_old -> b_param_new)."""
    old = binding(spark, sf_dir, "b_param_old")
    new = binding(spark, sf_dir, "b_param_new")
    return D.with_flags(D.param_changes(old, new, by=[]))


#: The expected texts, written out (not taken from the code under test).
MESSAGE_SQL = """CASE diff_type
  WHEN 'Class Addition' THEN '`' || api_name || '`: class added' WHEN 'Class Removal' THEN '`' || api_name || '`: class removed'
  WHEN 'Function Addition' THEN '`' || api_name || '`: function added' WHEN 'Function Removal' THEN '`' || api_name || '`: function removed'
  WHEN 'Variable Addition' THEN '`' || api_name || '`: variable added' WHEN 'Variable Removal' THEN '`' || api_name || '`: variable removed'
  WHEN 'Required Parameter Addition' THEN '`' || api_name || '`: required parameter `' || param || '` added'
  WHEN 'Required Parameter Removal' THEN '`' || api_name || '`: required parameter `' || param || '` removed'
  WHEN 'Optional Parameter Addition' THEN '`' || api_name || '`: optional parameter `' || param || '` added'
  WHEN 'Optional Parameter Removal' THEN '`' || api_name || '`: optional parameter `' || param || '` removed'
  WHEN 'Parameter Reordering' THEN '`' || api_name || '`: parameter `' || param || '` reordered'
  WHEN 'Parameter Default Value Addition' THEN '`' || api_name || '`: default value `None` added to `' || param || '`'
  WHEN 'Parameter Default Value Removal' THEN '`' || api_name || '`: default value `None` removed from `' || param || '`'
  WHEN 'Parameter Default Value Change' THEN '`' || api_name || '`: default value changed from `' || old_value || '` to `' || new_value || '` in `' || param || '`'
  END"""


BREAKING_SQL = "(diff_type NOT IN ('Class Addition', 'Function Addition', 'Variable Addition'))"

PARAM_DIFF_SQL = binding_cte("b_param_old", "b_param_new") + f""",
fb AS (SELECT DISTINCT func FROM b_param_old WHERE func IN (SELECT func FROM b_param_new)),
j AS (
  SELECT coalesce(o.func, n.func) AS func, coalesce(o.param, n.param) AS param,
         o.pos AS opos, n.pos AS npos, o.dflt AS od, n.dflt AS nd,
         o.func IS NOT NULL AS ho, n.func IS NOT NULL AS hn
  FROM b_param_old o FULL OUTER JOIN b_param_new n ON o.func = n.func AND o.param = n.param
  WHERE coalesce(o.func, n.func) IN (SELECT func FROM fb)),
d AS (
  SELECT func AS api_name, param,
         CASE WHEN nd IS NOT NULL THEN 'Optional Parameter Addition' ELSE 'Required Parameter Addition' END AS diff_type,
         CAST(NULL AS VARCHAR) AS old_value, CAST(NULL AS VARCHAR) AS new_value FROM j WHERE NOT ho
  UNION ALL
  SELECT func, param, CASE WHEN od IS NOT NULL THEN 'Optional Parameter Removal' ELSE 'Required Parameter Removal' END,
         NULL, NULL FROM j WHERE NOT hn
  UNION ALL
  SELECT func, param, 'Parameter Default Value Addition', od, NULL FROM j WHERE ho AND hn AND od IS NOT NULL AND nd IS NULL
  UNION ALL
  SELECT func, param, 'Parameter Default Value Removal', NULL, nd FROM j WHERE ho AND hn AND od IS NULL AND nd IS NOT NULL
  UNION ALL
  SELECT func, param, 'Parameter Default Value Change', od, nd FROM j
  WHERE ho AND hn AND od IS NOT NULL AND nd IS NOT NULL
    AND NOT ((od LIKE '<%' AND nd LIKE '<%')
             OR (strpos(od, '(') > 0 AND strpos(nd, '(') > 0 AND split_part(od, '(', 1) = split_part(nd, '(', 1))
             OR od = nd)
  UNION ALL
  SELECT func, param, 'Parameter Reordering', NULL, NULL FROM j WHERE ho AND hn AND opos <> npos),
pd AS (SELECT api_name, param, diff_type, old_value, new_value, {BREAKING_SQL} AS is_breaking,
              {MESSAGE_SQL} AS message FROM d)
"""


@register("D18_param_diff", PARAM_DIFF_SQL + "SELECT * FROM pd")
def q_param_diff(spark, sf_dir):
    return param_diffs(spark, sf_dir)


_PARAM_TYPES = {
    "D5_required_param_addition": D.REQ_PARAM_ADD,
    "D6_required_param_removal": D.REQ_PARAM_REM,
    "D7_optional_param_addition": D.OPT_PARAM_ADD,
    "D8_optional_param_removal": D.OPT_PARAM_REM,
    "D9_param_reordering": D.PARAM_REORDER,
    "D10_default_value_addition": D.DEF_VAL_ADD,
    "D11_default_value_removal": D.DEF_VAL_REM,
    "D12_default_value_change": D.DEF_VAL_CHG,
}


def _typed(dt):
    def q(spark, sf_dir):
        return param_diffs(spark, sf_dir).where(F.col("diff_type") == dt)

    return q


for _name, _dt in _PARAM_TYPES.items():
    register(_name, PARAM_DIFF_SQL + f"SELECT * FROM pd WHERE diff_type = {sql_str(_dt)}")(_typed(_dt))


def change_counts(spark, sf_dir):
    """D25 over the parameter diff: the flagship answer."""
    return D.change_summary(param_diffs(spark, sf_dir))


@register("D25_change_summary", PARAM_DIFF_SQL + """
SELECT diff_type, count(*) AS n_changes, diff_type NOT IN ('Class Addition', 'Function Addition', 'Variable Addition') AS is_breaking
FROM pd GROUP BY diff_type""")
def q_change_summary(spark, sf_dir):
    return change_counts(spark, sf_dir)


@register("D15_same_default", binding_cte("b_param_old", "b_param_new") + """
SELECT o.func, o.param, o.dflt AS old_value, n.dflt AS new_value,
  ((o.dflt LIKE '<%' AND n.dflt LIKE '<%')
   OR (strpos(o.dflt, '(') > 0 AND strpos(n.dflt, '(') > 0 AND split_part(o.dflt, '(', 1) = split_part(n.dflt, '(', 1))
   OR o.dflt = n.dflt) AS same_default
FROM b_param_old o JOIN b_param_new n ON o.func = n.func AND o.param = n.param
WHERE o.dflt IS NOT NULL AND n.dflt IS NOT NULL""")
def q_same_default(spark, sf_dir):
    o = binding(spark, sf_dir, "b_param_old").alias("o")
    n = binding(spark, sf_dir, "b_param_new").alias("n")
    return (
        o.join(n, ["func", "param"])
        .where(F.col("o.dflt").isNotNull() & F.col("n.dflt").isNotNull())
        .select("func", "param", F.col("o.dflt").alias("old_value"), F.col("n.dflt").alias("new_value"),
                D.same_default(F.col("o.dflt"), F.col("n.dflt")).alias("same_default"))
    )
