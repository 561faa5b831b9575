"""PEP 440 versions and specifiers as Spark column expressions.

A version string becomes a sortable STRUCT (``version_key``) so ``orderBy``,
``max_by``, window ``lead`` and comparisons work natively.  Specifier
matching is a per-clause predicate on two keys; a specifier list is matched
by exploding its clauses and requiring every clause (``bool_and``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# --- fixed values: PEP 440 grammar (lower-cased input) and rank of pre-release letters ---
VERSION_REGEX = (
    r"^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)"
    r"(?:[-_.]?(a|b|c|rc|alpha|beta|pre|preview)[-_.]?(\d*))?"
    r"(?:-(\d+)|[-_.]?(post|rev|r)[-_.]?(\d*))?"
    r"(?:[-_.]?(dev)[-_.]?(\d*))?"
    r"(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)
PRE_RANK = {"a": 1, "alpha": 1, "b": 2, "beta": 2, "c": 3, "rc": 3, "pre": 3, "preview": 3}
NO_PRE_RANK = 9     # final release: after every pre-release
DEV_ONLY_RANK = 0   # X.devN without pre/post sorts before X.aN
NO_POST = -1
NO_DEV = 1 << 62

SPEC_OPS = ["===", "~=", "==", "!=", "<=", ">=", "<", ">"]
SPEC_REGEX = r"^\s*(===|~=|==|!=|<=|>=|<|>)\s*(.*?)\s*$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _grp(v: Column, i: int) -> Column:
    return F.regexp_extract(v, VERSION_REGEX, i)


def _num(s: Column, empty_default) -> Column:
    return F.when(s == "", F.lit(empty_default).cast("bigint")).otherwise(s.try_cast("bigint"))


def is_version(v) -> Column:
    """The text parses as a PEP 440 version."""
    return F.coalesce(F.lower(_col(v)).rlike(VERSION_REGEX), F.lit(False))


def _pre_rank(pre_l: Column, has_pre: Column, has_post: Column, has_dev: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in PRE_RANK.items() for x in kv])
    return (
        F.when(~has_pre & ~has_post & has_dev, F.lit(DEV_ONLY_RANK))
        .otherwise(F.coalesce(F.element_at(ranks, pre_l), F.lit(NO_PRE_RANK)))
    )


def _release(rel_text: Column) -> Column:
    """Release numbers with trailing zeros removed (1.0 == 1.0.0)."""
    return F.transform(F.split(F.regexp_replace(rel_text, r"(\.0+)+$", ""), r"\."), lambda x: x.try_cast("bigint"))


def version_parts(v) -> Column:
    """STRUCT with the parsed fields (NULL when not a version).  Materialise
    it as a column when several fields are needed (see ``with_version_parts``)."""
    s = F.lower(_col(v))
    release_raw = F.transform(F.split(_grp(s, 2), r"\."), lambda x: x.try_cast("bigint"))
    pre_l, pre_n = _grp(s, 3), _grp(s, 4)
    post_implicit, post_l, post_n = _grp(s, 5), _grp(s, 6), _grp(s, 7)
    dev_l, dev_n = _grp(s, 8), _grp(s, 9)
    has_pre, has_post, has_dev = pre_l != "", (post_implicit != "") | (post_l != ""), dev_l != ""
    post = F.when(post_implicit != "", post_implicit.try_cast("bigint")).when(
        post_l != "", _num(post_n, 0)).otherwise(F.lit(NO_POST).cast("bigint"))
    return F.when(
        is_version(v),
        F.struct(
            _num(_grp(s, 1), 0).alias("epoch"),
            _release(_grp(s, 2)).alias("release"),
            _pre_rank(pre_l, has_pre, has_post, has_dev).alias("pre_rank"),
            F.when(has_pre, _num(pre_n, 0)).otherwise(F.lit(0).cast("bigint")).alias("pre_num"),
            post.alias("post"),
            F.when(has_dev, _num(dev_n, 0)).otherwise(F.lit(NO_DEV).cast("bigint")).alias("dev"),
            _grp(s, 10).alias("local"),
            release_raw.alias("release_raw"),
            has_pre.alias("is_pre"),
            has_post.alias("is_post"),
            has_dev.alias("is_dev"),
        ),
    )


def key_of(parts: Column) -> Column:
    """Sortable key (V2) from :func:`version_parts`: epoch, release, pre,
    post, dev, local, in PEP 440 order."""
    return F.struct(
        parts["epoch"].alias("epoch"), parts["release"].alias("release"), parts["pre_rank"].alias("pre_rank"),
        parts["pre_num"].alias("pre_num"), parts["post"].alias("post"), parts["dev"].alias("dev"),
        parts["local"].alias("local"),
    )


def public_key_of(parts: Column) -> Column:
    """Key without the local label (``Version(v.public)``)."""
    return F.struct(
        parts["epoch"].alias("epoch"), parts["release"].alias("release"), parts["pre_rank"].alias("pre_rank"),
        parts["pre_num"].alias("pre_num"), parts["post"].alias("post"), parts["dev"].alias("dev"),
        F.lit("").alias("local"),
    )


def base_key_of(parts: Column) -> Column:
    """Key of ``base_version`` (epoch + release only)."""
    return F.struct(
        parts["epoch"].alias("epoch"), parts["release"].alias("release"), F.lit(NO_PRE_RANK).alias("pre_rank"),
        F.lit(0).cast("bigint").alias("pre_num"), F.lit(NO_POST).cast("bigint").alias("post"),
        F.lit(NO_DEV).cast("bigint").alias("dev"), F.lit("").alias("local"),
    )


def version_key(v) -> Column:
    """V2: sortable key of a version string (NULL if it does not parse),
    built straight from the regex groups to keep the expression small."""
    s = F.lower(_col(v))
    pre_l, post_implicit, post_l, dev_l = _grp(s, 3), _grp(s, 5), _grp(s, 6), _grp(s, 8)
    has_pre, has_post, has_dev = pre_l != "", (post_implicit != "") | (post_l != ""), dev_l != ""
    return F.when(
        is_version(v),
        F.struct(
            _num(_grp(s, 1), 0).alias("epoch"),
            _release(_grp(s, 2)).alias("release"),
            _pre_rank(pre_l, has_pre, has_post, has_dev).alias("pre_rank"),
            F.when(has_pre, _num(_grp(s, 4), 0)).otherwise(F.lit(0).cast("bigint")).alias("pre_num"),
            F.when(post_implicit != "", post_implicit.try_cast("bigint")).when(has_post, _num(_grp(s, 7), 0))
            .otherwise(F.lit(NO_POST).cast("bigint")).alias("post"),
            F.when(has_dev, _num(_grp(s, 9), 0)).otherwise(F.lit(NO_DEV).cast("bigint")).alias("dev"),
            _grp(s, 10).alias("local"),
        ),
    )


def is_valid_version(v) -> Column:
    """V1: parses and is neither a pre-release nor a dev release (post ok)."""
    s = F.lower(_col(v))
    return is_version(v) & (_grp(s, 3) == "") & (_grp(s, 8) == "")


def bump_kind(v1, v2) -> Column:
    """``major`` when the first release numbers differ, else ``minor``
    when the second ones differ (missing numbers are 0), else ``patch``."""
    def raw(v):
        return F.transform(F.split(_grp(F.lower(_col(v)), 2), r"\."), lambda x: x.try_cast("bigint"))

    r1, r2 = raw(v1), raw(v2)

    def at(r, i):
        return F.coalesce(F.try_element_at(r, F.lit(i)), F.lit(0).cast("bigint"))

    return F.when(at(r1, 1) != at(r2, 1), "major").when(at(r1, 2) != at(r2, 2), "minor").otherwise("patch")


# ---------------------------------------------------------------- specifiers

def spec_clauses(spec) -> Column:
    """ARRAY<STRUCT<op, ver>> of the comma separated clauses of a specifier
    list ('' -> empty array)."""
    s = _col(spec)
    items = F.filter(F.split(F.coalesce(s, F.lit("")), ","), lambda x: F.trim(x) != "")
    return F.transform(
        items,
        lambda x: F.struct(
            F.regexp_extract(x, SPEC_REGEX, 1).alias("op"),
            F.regexp_extract(x, SPEC_REGEX, 2).alias("ver"),
        ),
    )


def _prefix_equal(cand_parts: Column, epoch: Column, rel: Column) -> Column:
    """``== X.Y.*``: the candidate's release, zero padded, starts with X.Y
    (and the epochs agree)."""
    cand_rel = cand_parts["release_raw"]
    return (cand_parts["epoch"] == epoch) & F.forall(
        F.sequence(F.lit(1), F.size(rel)),
        lambda i: F.coalesce(F.try_element_at(cand_rel, i), F.lit(0).cast("bigint")) == F.element_at(rel, i),
    )


def parse_clause(op, ver) -> Column:
    """One specifier clause with its version parsed once:
    STRUCT<op, ver, star, parts>."""
    op, ver = _col(op), _col(ver)
    return F.struct(
        op.alias("op"), ver.alias("ver"), ver.endswith(".*").alias("star"),
        version_parts(F.regexp_replace(ver, r"\.\*$", "")).alias("parts"),
    )


def parsed_clauses(spec) -> Column:
    """ARRAY of :func:`parse_clause` for a specifier list."""
    return F.transform(spec_clauses(spec), lambda c: parse_clause(c["op"], c["ver"]))


def clause_admits(cp: Column, clause: Column, cand_version=None) -> Column:
    """V8 for one parsed clause against parsed candidate parts ``cp``, with
    pre-releases allowed (``contains(v, prereleases=True)``)."""
    op, sp = clause["op"], clause["parts"]
    cand, cand_pub, cand_base = key_of(cp), public_key_of(cp), base_key_of(cp)
    spec, spec_base = key_of(sp), base_key_of(sp)
    eq_exact = F.when(sp["local"] != "", cand == spec).otherwise(cand_pub == spec)
    eq = F.when(clause["star"], _prefix_equal(cp, sp["epoch"], sp["release_raw"])).otherwise(eq_exact)
    # ~= X.Y.Z : >= X.Y.Z and == X.Y.*
    compat = (cand_pub >= spec) & _prefix_equal(
        cp, sp["epoch"], F.slice(sp["release_raw"], 1, F.size(sp["release_raw"]) - 1))
    lt = (cand < spec) & ~(~(sp["is_pre"] | sp["is_dev"]) & (cp["is_pre"] | cp["is_dev"]) & (cand_base == spec_base))
    gt = (
        (cand > spec)
        & ~(~sp["is_post"] & cp["is_post"] & (cand_base == spec_base))
        & ~((cp["local"] != "") & (cand_base == spec_base))
    )
    res = (
        F.when(op == "==", eq)
        .when(op == "!=", ~eq)
        .when(op == "<=", cand_pub <= spec)
        .when(op == ">=", cand_pub >= spec)
        .when(op == "<", lt)
        .when(op == ">", gt)
        .when(op == "~=", compat)
    )
    if cand_version is not None:
        res = res.when(op == "===", F.lower(F.trim(_col(cand_version))) == F.lower(clause["ver"]))
    return F.coalesce(res, F.lit(False))


def clause_matches(cand_version, op, spec_version) -> Column:
    """V8 for one clause given as text."""
    return clause_admits(version_parts(cand_version), parse_clause(op, spec_version), cand_version)


def spec_matches(cand_version, spec) -> Column:
    """V8: every clause of the specifier list admits the version."""
    cp = version_parts(cand_version)
    return F.forall(parsed_clauses(spec), lambda c: clause_admits(cp, c, cand_version))


def matching_versions(reqs: DataFrame, releases: DataFrame, dep: str = "dep", spec: str = "spec",
                      pkg: str = "pkg", ver: str = "ver") -> DataFrame:
    """V8 as a join: every (dep, spec) of ``reqs`` with each version of ``dep``
    in ``releases`` that satisfies it -> (dep, spec, ver).

    The theta part never meets the big requirement table: specifiers are
    reduced to distinct (dep, spec) and parsed once, versions to distinct
    (pkg, ver) and parsed once; the join is an equi-join on the package name
    and the specifier test is a filter on the joined rows."""
    specs = (
        reqs.select(F.col(dep).alias("dep"), F.col(spec).alias("spec")).distinct()
        .withColumn("_clauses", parsed_clauses(F.col("spec")))
    )
    vers = (
        releases.select(F.col(pkg).alias("dep"), F.col(ver).alias("ver")).distinct()
        .withColumn("_cp", version_parts(F.col("ver")))
        .where(F.col("_cp").isNotNull())
    )
    return (
        specs.join(vers, "dep")
        .where(F.forall("_clauses", lambda c: clause_admits(F.col("_cp"), c, F.col("ver"))))
        .select("dep", "spec", "ver")
    )


def spec_type(spec) -> Column:
    """V9: any / at-least / at-most / fixed / var-micro / var-minor / range /
    other, from the clauses of a specifier list."""
    cl = spec_clauses(spec)
    n = F.size(cl)
    op1, v1 = cl[0]["op"], cl[0]["ver"]
    ops = F.transform(cl, lambda c: c["op"])
    one = (
        F.when(op1.isin(">=", ">"), "at-least")
        .when(op1.isin("<=", "<"), "at-most")
        .when((op1 == "==") & v1.rlike(r"^\d+\.\d+\.\*"), "var-micro")
        .when((op1 == "==") & v1.rlike(r"^\d+\.\*"), "var-minor")
        .when((op1 == "==") & (v1 == "*"), "any")
        .when(op1 == "==", "fixed")
        .when((op1 == "~=") & v1.rlike(r"^\d+\.\d+\.\d+"), "var-micro")
        .when((op1 == "~=") & v1.rlike(r"^\d+\.\d+"), "var-minor")
        .otherwise("other")
    )
    two = F.when(
        (F.array_contains(ops, ">") | F.array_contains(ops, ">="))
        & (F.array_contains(ops, "<") | F.array_contains(ops, "<=")),
        "range",
    ).otherwise("other")
    return F.when(n == 0, "any").when(n == 1, one).when(n == 2, two).otherwise("other")


def requirement_spec(requires_dist) -> Column:
    """Specifier text of a ``Requires-Dist`` entry such as ``foo (>=1.0)``,
    ``foo>=1,<2; extra == 'x'`` or ``foo[bar] (==1)``."""
    r = F.regexp_replace(_col(requires_dist), r";.*$", "")
    r = F.regexp_replace(r, r"^\s*[A-Za-z0-9][A-Za-z0-9._-]*\s*(\[[^\]]*\])?\s*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(r, r"^\(", ""), r"\)\s*$", ""))


def requirement_name(requires_dist) -> Column:
    return F.regexp_extract(_col(requires_dist), r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)", 1)


# ---------------------------------------------------------------- tables

def with_version_key(df: DataFrame, ver: str = "ver", out: str = "vkey") -> DataFrame:
    """Attach the key once per distinct version (the expression is long)."""
    return df.withColumn(out, version_key(F.col(ver)))


def adjacent_pairs(versions: DataFrame, pkg: str = "pkg", ver: str = "ver") -> DataFrame:
    """Consecutive versions of each package in version order -> (pkg, v1, v2).

    ``versions`` is reduced to distinct (pkg, ver) first; only the small
    version table is sorted within each package."""
    v = versions.select(pkg, ver).distinct().withColumn("_k", version_key(F.col(ver)))
    w = Window.partitionBy(pkg).orderBy(F.col("_k"), F.col(ver))
    return (
        v.withColumn("v2", F.lead(F.col(ver)).over(w))
        .where(F.col("v2").isNotNull())
        .select(F.col(pkg).alias("pkg"), F.col(ver).alias("v1"), "v2")
    )
