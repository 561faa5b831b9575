"""API changes between adjacent versions (D1-D27) as joins over flat tables.

Every diff is a set difference, so every diff here is a full outer join on
the identity of the thing compared (key, class member, parameter) inside the
version pair.  No Python runs here; all rules are column expressions.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pkgscope.session import cut_lineage, share_filled

# --- fixed values: change type labels, breaking set and message formats ---
CLS_ADD = "Class Addition"
CLS_REM = "Class Removal"
FUNC_ADD = "Function Addition"
FUNC_REM = "Function Removal"
REQ_PARAM_ADD = "Required Parameter Addition"
REQ_PARAM_REM = "Required Parameter Removal"
OPT_PARAM_ADD = "Optional Parameter Addition"
OPT_PARAM_REM = "Optional Parameter Removal"
PARAM_REORDER = "Parameter Reordering"
DEF_VAL_ADD = "Parameter Default Value Addition"
DEF_VAL_REM = "Parameter Default Value Removal"
DEF_VAL_CHG = "Parameter Default Value Change"
VAR_ADD = "Variable Addition"
VAR_REM = "Variable Removal"

DIFF_TYPES = [
    CLS_ADD, CLS_REM, FUNC_ADD, FUNC_REM, REQ_PARAM_ADD, REQ_PARAM_REM, OPT_PARAM_ADD,
    OPT_PARAM_REM, PARAM_REORDER, DEF_VAL_ADD, DEF_VAL_REM, DEF_VAL_CHG, VAR_ADD, VAR_REM,
]
NON_BREAKING = [CLS_ADD, FUNC_ADD, VAR_ADD]

MESSAGE_FORMATS = {
    CLS_ADD: "`{api}`: class added",
    CLS_REM: "`{api}`: class removed",
    FUNC_ADD: "`{api}`: function added",
    FUNC_REM: "`{api}`: function removed",
    REQ_PARAM_ADD: "`{api}`: required parameter `{param}` added",
    REQ_PARAM_REM: "`{api}`: required parameter `{param}` removed",
    PARAM_REORDER: "`{api}`: parameter `{param}` reordered",
    OPT_PARAM_ADD: "`{api}`: optional parameter `{param}` added",
    OPT_PARAM_REM: "`{api}`: optional parameter `{param}` removed",
    DEF_VAL_ADD: "`{api}`: default value `{new}` added to `{param}`",
    DEF_VAL_REM: "`{api}`: default value `{old}` removed from `{param}`",
    DEF_VAL_CHG: "`{api}`: default value changed from `{old}` to `{new}` in `{param}`",
    VAR_ADD: "`{api}`: variable added",
    VAR_REM: "`{api}`: variable removed",
}

# Entity kind -> (change type when only in the new version, when only in the old one).
KIND_CHANGES = {
    "class": (CLS_ADD, CLS_REM),
    "function": (FUNC_ADD, FUNC_REM),
    "variable": (VAR_ADD, VAR_REM),
}

DIFF_COLUMNS = ["api_name", "param", "diff_type", "old_value", "new_value"]


def is_breaking(diff_type: Column) -> Column:
    """Every change type except the three additions is breaking."""
    return ~diff_type.isin(NON_BREAKING)


def _format(template: str, api: Column, param: Column, old: Column, new: Column) -> Column:
    values = {"api": api, "param": param, "old": old, "new": new}
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if not piece:
            continue
        if piece.startswith("{"):
            # Python's f-string prints a missing value as "None".
            parts.append(F.coalesce(values[piece[1:-1]], F.lit("None")))
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def diff_message(diff_type="diff_type", api="api_name", param="param", old="old_value", new="new_value") -> Column:
    """Human readable text of a change."""
    cols = [F.col(c) if isinstance(c, str) else c for c in (diff_type, api, param, old, new)]
    t, a, p, o, n = cols
    expr = None
    for dt, template in MESSAGE_FORMATS.items():
        text = _format(template, a, p, o, n)
        expr = F.when(t == dt, text) if expr is None else expr.when(t == dt, text)
    return expr


def same_default(old: Column, new: Column) -> Column:
    """Two default texts count as equal when both look like object
    reprs (start with ``<``), share the text before ``(`` while both have a
    ``(``, or are equal."""
    return (
        (old.startswith("<") & new.startswith("<"))
        | (old.contains("(") & new.contains("(")
           & (F.substring_index(old, "(", 1) == F.substring_index(new, "(", 1)))
        | (old == new)
    )


def _change(diff_type, api, param=None, old=None, new=None) -> Column:
    lit_none = F.lit(None).cast("string")
    return F.struct(
        (F.lit(diff_type) if isinstance(diff_type, str) else diff_type).alias("diff_type"),
        api.alias("api_name"),
        (param if param is not None else lit_none).alias("param"),
        (old if old is not None else lit_none).cast("string").alias("old_value"),
        (new if new is not None else lit_none).cast("string").alias("new_value"),
    )


def _explode_changes(df: DataFrame, by: list[str], candidates: list[Column]) -> DataFrame:
    """Keep the non-null candidate structs of every row, one output row each."""
    arr = F.filter(F.array(*candidates), lambda c: c.isNotNull())
    return df.select(*by, F.inline(arr)).select(*by, *DIFF_COLUMNS)


def param_changes(old_args: DataFrame, new_args: DataFrame, by: list[str], func: str = "func") -> DataFrame:
    """Parameter changes of functions present in both versions.

    ``old_args``/``new_args`` have columns ``by + [func, param, pos, dflt]``
    (one row per parameter; ``dflt`` is the default's source text or NULL).
    ``*args``, ``**kwargs`` and keyword-only arguments without default are
    required parameters, like any parameter without default.
    """
    # Only functions that exist on both sides are compared.  The diff rows are
    # few, so the existence check is a semi join on the (small) diff output.
    both = (
        old_args.select(*by, func).distinct()
        .join(new_args.select(*by, func).distinct(), by + [func], "left_semi")
        .withColumnRenamed(func, "api_name")
    )
    return _args_changes(old_args, new_args, by, func).join(both, by + ["api_name"], "left_semi")


def _args_changes(old_args: DataFrame, new_args: DataFrame, by: list[str], func: str) -> DataFrame:
    """:func:`param_changes` of functions that are known to exist on both sides."""
    keys = by + [func, "param"]
    o = old_args.select(*keys, F.col("pos").alias("o_pos"), F.col("dflt").alias("o_dflt"), F.lit(True).alias("o_has"))
    n = new_args.select(*keys, F.col("pos").alias("n_pos"), F.col("dflt").alias("n_dflt"), F.lit(True).alias("n_has"))
    j = o.join(n, keys, "full_outer")
    api, param = F.col(func), F.col("param")
    o_has, n_has = F.col("o_has").isNotNull(), F.col("n_has").isNotNull()
    o_d, n_d = F.col("o_dflt"), F.col("n_dflt")
    cands = [
        F.when(~o_has, _change(F.when(n_d.isNotNull(), OPT_PARAM_ADD).otherwise(REQ_PARAM_ADD), api, param)),
        F.when(~n_has, _change(F.when(o_d.isNotNull(), OPT_PARAM_REM).otherwise(REQ_PARAM_REM), api, param)),
        # Labels follow the reference: "Addition" when the *old* side had the default.
        F.when(o_has & n_has & o_d.isNotNull() & n_d.isNull(), _change(DEF_VAL_ADD, api, param, o_d, None)),
        F.when(o_has & n_has & o_d.isNull() & n_d.isNotNull(), _change(DEF_VAL_REM, api, param, None, n_d)),
        F.when(o_has & n_has & o_d.isNotNull() & n_d.isNotNull() & ~same_default(o_d, n_d),
               _change(DEF_VAL_CHG, api, param, o_d, n_d)),
        F.when(o_has & n_has & (F.col("o_pos") != F.col("n_pos")), _change(PARAM_REORDER, api, param)),
    ]
    return _explode_changes(j, by + [func], cands).drop(func)


def entity_changes(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Keys added or removed between two versions.

    ``old``/``new`` have ``by + [key, kind]``; kinds ``class``, ``function``,
    ``variable``, ``alias`` / ``wildcard``.  Aliases never produce a change,
    and a key present on both sides produces no entity-level change (its
    members and parameters are compared by :func:`member_changes` and
    :func:`param_changes`).
    """
    return _kind_changes(_kinds(_sides(old, new), by), by)


def _sides(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both versions in one table, told apart by ``old``."""
    return old.withColumn("old", F.lit(True)).unionByName(new.withColumn("old", F.lit(False)))


def _kinds(sided: DataFrame, by: list[str]) -> DataFrame:
    """Per key the number of its entities of each kind on either side (by +
    key, o_any, n_any, o_class, ...), in the partitions of by + key: one
    shuffle, where an outer join has one a side."""
    n = int(sided.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = [F.count_if(side & (F.col("kind") == kind)).alias(f"{tag}_{kind}") for tag, side in (("o", F.col("old")), ("n", ~F.col("old"))) for kind in KIND_CHANGES]
    return sided.repartition(n, *by, "key").groupBy(*by, "key").agg(F.count_if("old").alias("o_any"), F.count_if(~F.col("old")).alias("n_any"), *counts)


def _kind_changes(kinds: DataFrame, by: list[str]) -> DataFrame:
    """Changes of the keys that :func:`_kinds` found on one side only, one per entity."""
    each = [F.array_repeat(_change(a, F.col("key")), F.when(F.col("o_any") == 0, F.col(f"n_{kind}")).otherwise(0).cast("int")) for kind, (a, _) in KIND_CHANGES.items()]
    each += [F.array_repeat(_change(r, F.col("key")), F.when(F.col("n_any") == 0, F.col(f"o_{kind}")).otherwise(0).cast("int")) for kind, (_, r) in KIND_CHANGES.items()]
    return kinds.where((F.col("o_any") == 0) | (F.col("n_any") == 0)).select(*by, F.inline(F.concat(*each)))


def member_changes(old_members: DataFrame, new_members: DataFrame, by: list[str]) -> DataFrame:
    """D19 (set part): methods and fields of a class present in both versions.

    Members have ``by + [class_key, name, mkind]`` with mkind ``method``,
    ``field``, ``static_field`` or ``class``.  Fields and static fields form
    one set; nested classes are not compared.  The caller restricts both
    sides to classes that are classes in both versions.
    """
    return _set_changes(_member_sets(_sides(old_members, new_members), by), by)


def _member_sets(sided: DataFrame, by: list[str]) -> DataFrame:
    """Per method name (grp 'f') and field name (grp 'v') of a class whether either side has it."""
    return (
        sided.where(F.col("mkind").isin("method", "field", "static_field"))
        .groupBy(*by, "class_key", "name", F.when(F.col("mkind") == "method", "f").otherwise("v").alias("grp"))
        .agg(F.max("old").alias("o_has"), F.max(~F.col("old")).alias("n_has"))
    )


def _set_changes(sets: DataFrame, by: list[str]) -> DataFrame:
    api = F.concat_ws(".", "class_key", "name")
    dtype = (
        F.when(~F.col("o_has") & (F.col("grp") == "v"), VAR_ADD)
        .when(~F.col("n_has") & (F.col("grp") == "v"), VAR_REM)
        .when(~F.col("o_has") & (F.col("grp") == "f"), FUNC_ADD)
        .when(~F.col("n_has") & (F.col("grp") == "f"), FUNC_REM)
    )
    return (
        sets.where(~F.col("o_has") | ~F.col("n_has"))
        .select(*by, _change(dtype, api).alias("c"))
        .select(*by, "c.*")
    )


def _side(df: DataFrame, pairs: DataFrame, ver_col: str, by: list[str]) -> DataFrame:
    """Attach every catalogue row of version ``ver`` to the pairs where that
    version is ``ver_col`` (v1 = old side, v2 = new side)."""
    p = pairs.select("pkg", F.col(ver_col).alias("ver"), "v1", "v2")
    return df.join(p, ["pkg", "ver"]).drop("ver")


def diff_versions(entities: DataFrame, pairs: DataFrame, members: DataFrame | None = None,
                  args: DataFrame | None = None) -> DataFrame:
    """All changes of every adjacent version pair in one plan.

    entities: pkg, ver, key, kind.  pairs: pkg, v1, v2 (see
    ``versions.adjacent_pairs``).  members (optional): pkg, ver, class_key,
    name, mkind.  args (optional): pkg, ver, func, param, pos, dflt where
    ``func`` is the entity key of a function or ``class_key.method``.
    Every table meets the pairs once, each row on the side or sides that its
    version has, and is then grouped by what it is compared by.
    The pair table is small (one row per version) and AQE turns its joins
    into broadcast joins at run time when its measured size allows.
    """
    by = ["pkg", "v1", "v2"]
    versions = _sides(*(pairs.select("pkg", F.col(v).alias("ver"), "v1", "v2") for v in ("v1", "v2")))

    def sided(df):
        return df.join(versions, ["pkg", "ver"]).drop("ver")

    kinds = _kinds(sided(entities.select("pkg", "ver", "key", "kind")), by)
    if members is None and args is None:
        return _kind_changes(kinds, by)
    kinds = share_filled(kinds.sortWithinPartitions(*by, "key"))  # changes, classes and functions come from it
    # Entities that keep their kind across the pair (aliases give no change).
    same = lambda kind, name: kinds.where((F.col(f"o_{kind}") > 0) & (F.col(f"n_{kind}") > 0)).select(*by, F.col("key").alias(name))
    parts, funcs = [_kind_changes(kinds, by)], same("function", "func")
    if members is not None:
        mem = sided(members.select("pkg", "ver", "class_key", "name", "mkind")).join(same("class", "class_key"), by + ["class_key"], "left_semi")
        sets = share_filled(_member_sets(mem, by))
        parts.append(_set_changes(sets, by))
        # Methods shared by a class that is a class on both sides.
        shared = sets.where((F.col("grp") == "f") & F.col("o_has") & F.col("n_has"))
        funcs = funcs.unionByName(shared.select(*by, F.concat_ws(".", "class_key", "name").alias("func")))
    if args is not None:
        a = sided(args.select("pkg", "ver", "func", "param", "pos", "dflt")).join(funcs, by + ["func"], "left_semi")
        there = a.groupBy(*by, "func").agg(F.max("old").alias("_o"), F.max(~F.col("old")).alias("_n")).where(F.col("_o") & F.col("_n"))
        a = share_filled(a.join(there.drop("_o", "_n"), by + ["func"], "left_semi"))
        parts.append(_args_changes(a.where("old").drop("old"), a.where(~F.col("old")).drop("old"), by, "func"))
    return reduce(DataFrame.unionByName, parts)


def with_flags(diffs: DataFrame) -> DataFrame:
    """Add ``is_breaking`` (D16) and ``message``."""
    return diffs.withColumn("is_breaking", is_breaking(F.col("diff_type"))).withColumn("message", diff_message())


def change_summary(diffs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Number of changes per type, breaking first, types in text order."""
    by = by or []
    return (
        diffs.groupBy(*by, "diff_type")
        .agg(F.count(F.lit(1)).alias("n_changes"))
        .withColumn("is_breaking", is_breaking(F.col("diff_type")))
    )


def release_note_lines(diffs: DataFrame, by: list[str]) -> DataFrame:
    """The numbered entries of a release note, one row per change.

    Entries are ordered by clients using the API (desc) then by message text,
    numbered separately for breaking and non-breaking changes.  The caller
    writes the lines of a pair out together (``write.partitionBy``) instead
    of concatenating a whole note in one task.
    """
    d = with_flags(diffs)
    if "clients_used" not in d.columns:
        d = d.withColumn("clients_used", F.lit(0).cast("bigint"))
        d = d.withColumn("clients_impacted", F.lit(0).cast("bigint"))
        d = d.withColumn("clients_total", F.lit(0).cast("bigint"))
    d = numbered(d, [*by, "is_breaking"], [F.col("clients_used").desc(), F.col("message")], "entry_no")
    n = F.col("entry_no")
    line = F.when(
        F.col("is_breaking"),
        F.format_string("%d. %s (impacts %d of %d clients, %d clients in total) ", n, F.col("message"),
                        F.col("clients_impacted"), F.col("clients_used"), F.col("clients_total")),
    ).otherwise(F.format_string("%d. %s", n, F.col("message")))
    return d.select(*by, "is_breaking", "entry_no", line.alias("line"))


def numbered(df: DataFrame, by: list[str], order: list, name: str) -> DataFrame:
    """Row numbers from 1 in ``order`` within ``by``, without bringing a group
    into one task: range partitions are numbered by themselves and shifted by
    the rows of the group's earlier partitions."""
    ranged = cut_lineage(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    return ranged.withColumn("_own", own).join(shift, [*by, "_part"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def evolution_stats(diffs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per version pair: bump kind, breaking / non-breaking changes and
    breaking changes that are used / impact clients; pairs without changes
    appear with zeros (left join from the pair table)."""
    from pkgscope.functions.versions import bump_kind

    brk = is_breaking(F.col("diff_type"))
    agg = diffs.groupBy("pkg", "v1", "v2").agg(
        F.count_if(brk).alias("bc"),
        F.count_if(~brk).alias("nbc"),
        F.count_if(brk & (F.col("clients_used") > 0)).alias("ubc"),
        F.count_if(brk & (F.col("clients_impacted") > 0)).alias("ibc"),
    )
    return (
        pairs.select("pkg", "v1", "v2").join(agg, ["pkg", "v1", "v2"], "left")
        .select("pkg", "v1", "v2", bump_kind("v1", "v2").alias("bump"),
                *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("bc", "nbc", "ubc", "ibc")])
    )


def change_type_table(diffs: DataFrame) -> DataFrame:
    """Per change type: all / used / impacted counts and their shares
    of the column totals (totals from a one-row aggregate, no window)."""
    used = F.col("clients_used") > 0
    imp = F.col("clients_impacted") > 0
    brk = is_breaking(F.col("diff_type"))
    per = cut_lineage(diffs.groupBy("diff_type").agg(  # a row per type, read twice: the changes are made once
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(used & brk).alias("n_used"),
        F.count_if(imp & brk).alias("n_impacted"),
    ))
    tot = per.agg(F.sum("n_all").alias("_ta"), F.sum("n_used").alias("_tu"), F.sum("n_impacted").alias("_ti"))
    return (
        per.join(F.broadcast(tot))  # one row by construction
        .select("diff_type", "n_all", (F.col("n_all") / F.col("_ta")).alias("share_all"),
                "n_used", (F.col("n_used") / F.col("_tu")).alias("share_used"),
                "n_impacted", (F.col("n_impacted") / F.col("_ti")).alias("share_impacted"))
    )


def pairs_by_bump(evo: DataFrame) -> DataFrame:
    """Number of pairs per bump kind, and those without (used) breaking changes."""
    return evo.groupBy("bump").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(F.col("bc") == 0).alias("n_no_breaking"),
        F.count_if(F.col("ubc") == 0).alias("n_no_used_breaking"),
    )


def parsed_members(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and parameters of parsed versions for :func:`diff_versions`.
    A function name stands for its first definition in the module, a method
    name for its last one in the first class of that name.  -> members (pkg,
    ver, class_key, name, mkind), args (pkg, ver, func, param, pos, dflt)"""
    from pkgscope.operators import catalog as K

    rows = K.usable_rows(rows)
    place = F.struct("src_rank", "ord")
    by = ["pkg", "ver", "func"]
    functions = rows.where((F.col("rkind") == "function") & F.col("class_path").isNull()).groupBy(
        "pkg", "ver", F.concat_ws(".", "module", "name").alias("func")).agg(F.min_by("args", place).alias("args"))
    inside = K.winning_class_rows(rows).where(F.col("mkind").isNotNull()).withColumn("class_key", F.concat_ws(".", "module", "class_path"))
    methods = inside.where(F.col("mkind") == "method").groupBy("pkg", "ver", F.concat_ws(".", "class_key", "name").alias("func")).agg(
        F.max_by("args", place).alias("args"))
    args = functions.unionByName(methods).select(*by, F.posexplode("args").alias("pos", "a")).select(
        *by, F.col("a.name").alias("param"), "pos", F.col("a.default").alias("dflt"))
    return inside.select("pkg", "ver", "class_key", "name", "mkind").distinct(), args


def client_impact(diffs: DataFrame, usage: DataFrame, old_status: DataFrame, new_status: DataFrame,
                  by: list[str] | None = None) -> DataFrame:
    """Per change, clients of the old version in total, clients using
    the changed API (exact name) and clients impacted: the first readable
    pattern of a client for that API (text order) matches the old catalogue and does not
    match the new one.

    usage: by + c_pkg, api, chain (MATCH rows of the old version).
    old_status / new_status: chain, status (``chainmatch.match_chains``).
    Totals come from a one-row aggregate per key; usage is reduced to one
    row per (client, API) before meeting the changes."""
    by = by or []
    # a pattern with starred arguments can't be read back; the client's next one counts
    readable = F.when(~F.col("chain").contains("..."), F.col("chain"))
    per = usage.groupBy(*by, "c_pkg", "api").agg(F.min(readable).alias("chain"))
    hit = (
        per.join(old_status.select("chain", F.col("status").alias("_old")), "chain", "left")
        .join(new_status.select("chain", F.col("status").alias("_new")), "chain", "left")
        .groupBy(*by, F.col("api").alias("api_name"))
        .agg(F.count(F.lit(1)).alias("clients_used"),
             F.count_if((F.col("_old") == "MATCH") & (F.coalesce(F.col("_new"), F.lit("")) != "MATCH"))
             .alias("clients_impacted"))
    )
    total = usage.groupBy(*by).agg(F.count_distinct("c_pkg").alias("clients_total"))
    out = diffs.join(hit, by + ["api_name"], "left")
    # one row when unkeyed (broadcast); one row per key otherwise (left to AQE)
    out = out.join(total, by, "left") if by else out.join(F.broadcast(total))
    return out.na.fill(0, ["clients_used", "clients_impacted", "clients_total"])
