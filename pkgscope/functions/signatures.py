"""Signature text and literal values of catalogue entities (E18, E19), as
column expressions over the argument arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def function_signature(name, args, decorators, is_async, returns) -> Column:
    """``@d1 @d2 def f(a: T, /, b = 1, *c, d, **e) -> R``; ``/`` follows
    the last positional-only argument when another argument comes after it;
    ``async`` precedes the decorators."""
    name, args, decorators, is_async, returns = map(_c, (name, args, decorators, is_async, returns))

    def item(a, i):
        base = F.concat(a["name"], F.when(a["type"].isNotNull(), F.concat(F.lit(": "), a["type"])).otherwise(F.lit("")))
        base = F.when(a["vararg"], F.concat(F.lit("*"), base)).otherwise(base)
        base = F.when(a["kwarg"], F.concat(F.lit("**"), base)).otherwise(base)
        base = F.when(a["default"].isNotNull(), F.concat(base, F.lit(" = "), a["default"])).otherwise(base)
        prev_pos_only = F.when(i >= 1, F.try_element_at(args, i)["pos_only"]).otherwise(F.lit(False))
        return F.when(prev_pos_only & ~a["pos_only"], F.concat(F.lit("/, "), base)).otherwise(base)

    s = F.concat(F.lit("def "), name, F.lit("("), F.array_join(F.transform(args, item), ", "), F.lit(")"))
    decos = F.coalesce(decorators, F.array().cast("array<string>"))
    s = F.when(F.size(decos) > 0,
               F.concat(F.array_join(F.transform(decos, lambda d: F.concat(F.lit("@"), d)), " "), F.lit(" "), s)).otherwise(s)
    s = F.when(F.coalesce(is_async, F.lit(False)), F.concat(F.lit("async "), s)).otherwise(s)
    return F.when(returns.isNotNull(), F.concat(s, F.lit(" -> "), returns)).otherwise(s)


def variable_signature(name, var_type, value) -> Column:
    """``name : type = value`` (a missing type prints ``None``), or
    ``name = value`` when the type text is empty."""
    name, var_type, value = map(_c, (name, var_type, value))
    v = F.coalesce(value, F.lit("None"))
    return F.when(var_type == "", F.concat(name, F.lit(" = "), v)).otherwise(
        F.concat(name, F.lit(" : "), F.coalesce(var_type, F.lit("None")), F.lit(" = "), v))


def alias_signature(name, full_alias) -> Column:
    """``name -> full.alias``."""
    return F.concat(_c(name), F.lit(" -> "), _c(full_alias))


def literal_value(text) -> Column:
    """Typed view of a literal default / constant text without eval:
    STRUCT<kind, int_value, float_value, bool_value, str_value>; anything
    that is not a plain literal gives kind NULL."""
    t = F.trim(_c(text))
    is_int = t.rlike(r"^[+-]?\d+$")
    is_float = t.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$") & ~is_int
    is_bool = t.isin("True", "False")
    is_none = t == "None"
    is_str = t.rlike(r"^'[^'\\]*'$") | t.rlike(r'^"[^"\\]*"$')
    kind = (F.when(is_int, "int").when(is_float, "float").when(is_bool, "bool").when(is_none, "none")
            .when(is_str, "str"))
    return F.struct(
        kind.alias("kind"),
        F.when(is_int, t.try_cast("bigint")).alias("int_value"),
        F.when(is_float | is_int, t.try_cast("double")).alias("float_value"),
        F.when(is_bool, t == "True").alias("bool_value"),
        F.when(is_str, F.regexp_extract(t, r"^.(.*).$", 1)).alias("str_value"),
    )
