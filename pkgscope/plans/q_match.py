"""Call matching queries (M1-M5, M13) over the signature / call bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from pkgscope.operators import match as M
from pkgscope.plans.registry import register
from pkgscope.sources.bindings import binding, binding_cte


def verdicts(spark, sf_dir):
    return M.match_calls(binding(spark, sf_dir, "b_call"), binding(spark, sf_dir, "b_call_kw"),
                         binding(spark, sf_dir, "b_sig"))


MATCH_SQL = binding_cte("b_sig", "b_call", "b_call_kw") + """,
sig AS (SELECT func, list({'name': param, 'dflt': has_default, 'po': pos_only, 'va': vararg, 'kw': kwarg} ORDER BY pos) AS args
        FROM b_sig GROUP BY func),
kws AS (SELECT call_id, list(DISTINCT kw ORDER BY kw) AS kwargs FROM b_call_kw GROUP BY call_id),
c AS (SELECT b_call.call_id, b_call.func, b_call.n_args AS num, b_call.starargs AS star, b_call.addl_kwargs AS addl,
             coalesce(kws.kwargs, []) AS kwargs, sig.args
      FROM b_call JOIN sig ON sig.func = b_call.func LEFT JOIN kws ON kws.call_id = b_call.call_id),
d AS (SELECT *,
  list_transform(list_filter(args, lambda a: NOT a.kw AND NOT a.va), lambda a: a.name) AS cand_pos,
  list_transform(list_filter(args, lambda a: a.po), lambda a: a.name) AS posonly,
  len(list_filter(args, lambda a: a.va)) > 0 AS allow_pos,
  len(list_filter(args, lambda a: a.kw)) > 0 AS allow_kw FROM c),
e AS (SELECT *, CASE WHEN num > 0 THEN cand_pos[1:num] ELSE [] END AS mpos FROM d),
f AS (SELECT *, list_filter(list_transform(list_filter(args, lambda a: NOT a.kw AND NOT a.va AND NOT a.po), lambda a: a.name),
                            lambda n: NOT list_contains(mpos, n)) AS cand_kw FROM e),
g AS (SELECT *, list_filter(kwargs, lambda k: list_contains(posonly, k) OR (NOT list_contains(cand_kw, k) AND NOT allow_kw))[1] AS bad,
             list_concat(mpos, kwargs) AS matched FROM f),
h AS (SELECT *, list_filter(args, lambda a: NOT a.kw AND NOT a.va AND NOT a.dflt AND NOT list_contains(matched, a.name)
                 AND ((NOT addl AND NOT star) OR (a.po AND NOT star)))[1].name AS miss FROM g),
r AS (SELECT call_id, func, CASE
  WHEN num > len(cand_pos) AND NOT allow_pos THEN func || '() takes up to ' || CAST(len(cand_pos) AS VARCHAR) || ' positional arguments but ' || CAST(num AS VARCHAR) || ' are given'
  WHEN bad IS NOT NULL AND list_contains(posonly, bad) THEN bad || ' is position-only argument'
  WHEN bad IS NOT NULL THEN bad || ' is not allowed as keyword argument'
  WHEN miss IS NOT NULL THEN func || '() missing one required argument ' || miss END AS msg FROM h)
"""


@register("M5_call_verdict", MATCH_SQL + "SELECT call_id, func, msg IS NULL AS ok, coalesce(msg, '') AS message FROM r")
def q_m5(spark, sf_dir):
    return verdicts(spark, sf_dir)


for _name, _pat in {
    "M1_too_many_positionals": "takes up to",
    "M2_positional_only_keyword": "is position-only argument",
    "M3_unknown_keyword": "is not allowed as keyword argument",
    "M4_missing_required": "missing one required argument",
}.items():
    def _q(spark, sf_dir, _pat=_pat):
        return verdicts(spark, sf_dir).where(F.col("message").contains(_pat))

    register(_name, MATCH_SQL + f"SELECT call_id, func, false AS ok, msg AS message FROM r WHERE strpos(msg, '{_pat}') > 0")(_q)


@register("M13_result_text", MATCH_SQL + """
SELECT call_id, CASE WHEN msg IS NULL THEN 'MATCH: ' || func || ' (function)' ELSE 'MISMATCH: ' || msg END AS result FROM r""")
def q_m13(spark, sf_dir):
    v = verdicts(spark, sf_dir)
    st = F.when(F.col("ok"), M.MATCH).otherwise(M.MISMATCH)
    return v.select("call_id", M.result_text(st, "message", "func", F.lit("function")).alias("result"))
