"""Call matching (M1-M5, M13) as higher-order column expressions.

A call row carries n_args, kwargs (sorted array), starargs, addl_kwargs; a
function carries its argument array (STRUCT name, default/has_default,
pos_only, kw_only, vararg, kwarg) in declaration order.  The verdict is a
CASE chain evaluated on the joined row; no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH, MISMATCH, MISSING = "MATCH", "MISMATCH", "MISSING"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def call_verdict(func_name, args, n_args, kwargs, starargs, addl_kwargs, class_func=None) -> Column:
    """M1-M5: STRUCT<ok BOOLEAN, message STRING> of a call against a
    signature.  ``args`` elements need name, has_default, pos_only, kw_only,
    vararg, kwarg.  ``class_func`` adds the implicit ``self``.  Keywords are
    checked in sorted order, so the first failing keyword decides the message."""
    func_name, args, n_args, kwargs, starargs, addl_kwargs = map(
        _c, (func_name, args, n_args, kwargs, starargs, addl_kwargs))
    num = n_args + (F.when(_c(class_func), 1).otherwise(0) if class_func is not None else F.lit(0))
    kwargs = F.coalesce(kwargs, F.array().cast("array<string>"))
    cand_pos = F.transform(F.filter(args, lambda a: ~a["kwarg"] & ~a["vararg"] & ~a["kw_only"]), lambda a: a["name"])
    posonly = F.transform(F.filter(args, lambda a: a["pos_only"]), lambda a: a["name"])
    allow_pos = F.exists(args, lambda a: a["vararg"])
    allow_kw = F.exists(args, lambda a: a["kwarg"])
    matched_pos = F.when(num > 0, F.slice(cand_pos, 1, F.greatest(num, F.lit(1)))).otherwise(
        F.array().cast("array<string>"))
    cand_kw = F.array_except(
        F.transform(F.filter(args, lambda a: ~a["kwarg"] & ~a["vararg"] & ~a["pos_only"]), lambda a: a["name"]),
        matched_pos)
    bad_kw = F.filter(kwargs, lambda k: F.array_contains(posonly, k) | (~F.array_contains(cand_kw, k) & ~allow_kw))
    first_bad = F.try_element_at(bad_kw, F.lit(1))
    matched = F.array_union(matched_pos, kwargs)
    missing = F.filter(
        args,
        lambda a: ~a["kwarg"] & ~a["vararg"] & ~a["has_default"] & ~F.array_contains(matched, a["name"])
        & ((~addl_kwargs & ~starargs) | (a["kw_only"] & ~addl_kwargs) | (a["pos_only"] & ~starargs)),
    )
    first_missing = F.try_element_at(missing, F.lit(1))["name"]
    m1 = (num > F.size(cand_pos)) & ~allow_pos
    msg = (
        F.when(m1, F.format_string("%s() takes up to %d positional arguments but %d are given", func_name,
                                   F.size(cand_pos), num))
        .when(first_bad.isNotNull() & F.array_contains(posonly, first_bad),
              F.concat(first_bad, F.lit(" is position-only argument")))
        .when(first_bad.isNotNull(), F.concat(first_bad, F.lit(" is not allowed as keyword argument")))
        .when(first_missing.isNotNull(), F.concat(func_name, F.lit("() missing one required argument "), first_missing))
    )
    return F.struct(msg.isNull().alias("ok"), F.coalesce(msg, F.lit("")).alias("message"))


def match_calls(calls: DataFrame, call_kwargs: DataFrame, params: DataFrame) -> DataFrame:
    """M5 over tables: calls (call_id, func, n_args, starargs, addl_kwargs),
    call_kwargs (call_id, kw), params (func, pos, param, has_default,
    pos_only, vararg, kwarg[, kw_only]).  Signatures and keyword sets are
    folded to one row per function / call (both bounded by one signature),
    then joined to the calls on the function name."""
    kw_only = F.col("kw_only") if "kw_only" in params.columns else F.lit(False)
    sig = params.groupBy("func").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(
                F.col("pos").alias("pos"), F.col("param").alias("name"), F.col("has_default").alias("has_default"),
                F.col("pos_only").alias("pos_only"), kw_only.alias("kw_only"), F.col("vararg").alias("vararg"),
                F.col("kwarg").alias("kwarg")))),
            lambda a: a.dropFields("pos")).alias("args"))
    kws = call_kwargs.groupBy("call_id").agg(F.array_sort(F.collect_set("kw")).alias("kwargs"))
    j = calls.join(sig, "func").join(kws, "call_id", "left")
    v = call_verdict("func", "args", "n_args", "kwargs", "starargs", "addl_kwargs")
    return j.select("call_id", "func", v["ok"].alias("ok"), v["message"].alias("message"))


def result_text(status, message, matched_name, matched_kind) -> Column:
    """``MATCH: name (kind)`` or ``STATUS: message``."""
    status, message, matched_name, matched_kind = map(_c, (status, message, matched_name, matched_kind))
    return F.when(status == MATCH, F.concat(status, F.lit(": "), matched_name, F.lit(" ("), matched_kind, F.lit(")"))) \
        .otherwise(F.concat(status, F.lit(": "), message))
