"""Catalogue queries (K1-K12, E17) over flat entity / alias tables.

entities: by-columns (pkg, ver, ...) + key, kind.  aliases: src, dst edges.
Alias resolution (K8) is pointer doubling on the alias edge table: every
round joins the table with itself, so a chain of length L needs log2(L)
rounds, each round is one shuffle join, and lineage is cut by a reliable
checkpoint after every round.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pkgscope.session import cut_lineage, measured_joins, share, share_placed


def parent_of(key) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.regexp_replace(k, r"\.[^.]*$", "")


def modules_of(entities: DataFrame, by: list[str] | None = None) -> DataFrame:
    """K3: every module that holds an entity, with all its ancestors up to the
    top level -> by + module.  The entity's own ``module`` column counts if it
    has one: a name like ``os.path`` bound by an import is no module.  Modules
    without entities come from :func:`parsed_modules`."""
    by = by or ["pkg", "ver"]
    holder = F.col("module") if "module" in entities.columns else parent_of("key")
    return ancestors(entities.where(F.col("key").contains(".")).select(*by, holder.alias("module")).distinct(), by)


def ancestors(modules: DataFrame, by: list[str]) -> DataFrame:
    """by + module with all prefixes of each module."""
    parts = F.split("module", r"\.")
    return (
        modules.select(*by, parts.alias("_p"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("_i"))
        .select(*by, F.array_join(F.slice("_p", 1, F.col("_i")), ".").alias("module")).distinct()
    )


def parsed_modules(rows: DataFrame) -> DataFrame:
    """K3 from the parse stage: one module per file, also an empty or an
    unreadable one, ``pkg.__init__`` as ``pkg``, with all ancestors -> pkg, ver, module."""
    return file_modules(usable_rows(rows))


def file_modules(rows: DataFrame) -> DataFrame:
    """:func:`parsed_modules` of rows that are usable already."""
    files = rows.where(F.col("rkind").isin("module", "failed"))  # an unreadable file is a module without entities
    return ancestors(files.select("pkg", "ver", F.regexp_replace("module", r"\.__init__$", "").alias("module")), ["pkg", "ver"])


def api_statistics(entities: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Number of APIs and of each kind per catalogue."""
    by = by or ["pkg", "ver"]
    k = F.col("kind")
    return entities.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_apis"),
        F.count_if(k == "function").alias("num_functions"),
        F.count_if(k == "class").alias("num_classes"),
        F.count_if(k == "variable").alias("num_variables"),
        F.count_if(k.isin("alias", "wildcard")).alias("num_aliases"),
    )


def contains(requests: DataFrame, entities: DataFrame, by: list[str]) -> DataFrame:
    """K6/K7: ``key in package``: the key is an entity or a module of the
    catalogue, or its parent module has a wildcard import (then it is always
    true).  requests: by + key -> adds ``in_old`` boolean."""
    names = (
        entities.select(*by, "key")
        .unionByName(modules_of(entities, by).withColumnRenamed("module", "key"))
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    wild = (
        entities.where(F.col("kind") == "wildcard")
        .select(*by, parent_of("key").alias("_parent")).distinct().withColumn("_wild", F.lit(True))
    )
    r = requests.withColumn("_parent", parent_of("key"))
    return (
        r.join(names, by + ["key"], "left")
        .join(wild, by + ["_parent"], "left")
        .withColumn("in_old", F.coalesce(F.col("_hit"), F.col("_wild"), F.lit(False)))
        .drop("_hit", "_wild", "_parent")
    )


def resolve_aliases(edges: DataFrame, external: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """K8 for plain aliases: follow ``src -> dst`` until a name that is not an
    alias.  Returns by + (src, final, hops); ``final`` is NULL when the chain
    is cyclic or ends on an ``external`` name (another top level that is not
    loaded).

    Pointer doubling: state (src, cur, hops) starts one hop out; each round
    replaces ``cur`` by ``cur``'s own state, doubling the hops.  A row is
    settled once ``cur`` is not an alias; it is cyclic once its hop count
    exceeds the number of aliases.  Rounds stop when nothing is pending, at
    most log2(#aliases) + 2 rounds.
    """
    by = by or []
    e = edges.select(*by, "src", "dst").distinct()
    n = e.count()
    rounds = int(math.log2(max(n, 1))) + 2  # hops double each round and never exceed n
    srcs = share(e.select(*by, F.col("src").alias("_s")).distinct())

    def mark(state):
        return (
            state.join(srcs.withColumn("_is_alias", F.lit(True)), (
                [state[c] == srcs[c] for c in by] + [state["cur"] == srcs["_s"]]), "left")
            .select(state["*"], F.coalesce(F.col("_is_alias"), F.lit(False)).alias("pending"))
        )

    state = mark(e.select(*by, "src", F.col("dst").alias("cur"), F.lit(1).cast("bigint").alias("hops")))
    state = cut_lineage(state)
    for _ in range(rounds):
        left_n = state.where(F.col("pending") & (F.col("hops") <= n)).count()
        if left_n == 0:
            break
        s = state.alias("s")
        t = state.select(*by, F.col("src").alias("_t_src"), F.col("cur").alias("_t_cur"),
                         F.col("hops").alias("_t_hops"), F.col("pending").alias("_t_pending"))
        cond = [s[c] == t[c] for c in by] + [s["cur"] == t["_t_src"]]
        jumped = s.join(t, cond, "left")
        moving = F.col("pending") & (F.col("hops") <= n) & F.col("_t_src").isNotNull()
        state = jumped.select(
            *[s[c] for c in by], s["src"],
            F.when(moving, F.col("_t_cur")).otherwise(s["cur"]).alias("cur"),
            F.when(moving, s["hops"] + F.col("_t_hops")).otherwise(s["hops"]).alias("hops"),
            F.when(moving, F.col("_t_pending")).otherwise(s["pending"]).alias("pending"),
        )
        state = cut_lineage(state)
    bad = F.col("pending")
    if external is not None:
        bad = bad | external
    return state.select(*by, "src", F.when(bad, F.lit(None)).otherwise(F.col("cur")).alias("final"),
                        F.when(bad, F.lit(None)).otherwise(F.col("hops")).alias("hops"))


# ------------------------------------------------------------------ building

#: So many spoiled versions at most are sent to every task; more meet the rows by a shuffle.
FEW_SPOILED = 10_000


def usable_rows(rows: DataFrame) -> DataFrame:
    """Rows of the versions that no version error spoils.  The
    spoiled versions are counted first: a shuffle by version would bring all
    rows of a large version into one task."""
    spoiled = cut_lineage(rows.where(F.col("rkind") == "version_error").select("pkg", "ver").distinct())
    n = spoiled.count()
    if n == 0:
        return rows
    return rows.join(F.broadcast(spoiled) if n <= FEW_SPOILED else spoiled, ["pkg", "ver"], "left_anti")


def _order(rank: int) -> Column:
    """Place of a row in its module: kind of entity, .py before .pyi, position."""
    return F.struct(F.lit(rank).alias("rank"), F.col("src_rank"), F.col("ord").alias("pos"))


def import_aliases(rows: DataFrame) -> DataFrame:
    """Alias rows from parsed imports -> pkg, ver, module, name,
    full_alias, ord.  ``import a.b [as c]`` aliases ``c`` (or ``a.b``) to
    ``a.b``; ``from m import n [as k]`` aliases ``k`` (or ``n``) to
    ``m.n``, a relative ``m`` being resolved against the module's parent
    package (level 1 = the parent itself)."""
    r = rows.where(F.col("rkind").isin("import", "importfrom"))
    parent_parts = F.split(parent_of("module"), r"\.")
    level = F.col("imp_level")
    base = F.when(level == 1, parent_of("module")).otherwise(
        F.array_join(F.slice(parent_parts, 1, F.greatest(F.size(parent_parts) - level + 1, F.lit(0))), "."))
    rel_module = F.when(F.col("imp_module").isNotNull(),
                        F.concat_ws(".", F.when(base != "", base), F.col("imp_module"))).otherwise(base)
    full_module = F.when(level == 0, F.col("imp_module")).otherwise(rel_module)
    full = F.when(F.col("rkind") == "import", F.col("name")).otherwise(F.concat_ws(".", full_module, F.col("name")))
    local = F.coalesce(F.col("asname"), F.col("name"))
    return r.select("pkg", "ver", "module", local.alias("name"), full.alias("full_alias"),
                    _order(1).alias("ord"))


def build_entities(rows: DataFrame) -> DataFrame:
    """The entity table of parsed modules: definitions first, then
    aliases in import order, then one wildcard entity per module; the first
    of a clashing name wins; ``pkg.__init__`` entities are also listed under
    ``pkg``.  -> pkg, ver, module, name, key, kind, ord, full_alias, targets"""
    rows = usable_rows(rows)
    defs = rows.where(
        F.col("rkind").isin("function", "variable")
        & F.col("class_path").isNull()
        | ((F.col("rkind") == "class") & ~F.col("class_path").contains("."))
    ).select("pkg", "ver", "module", "name", F.col("rkind").alias("kind"), _order(0).alias("ord"),
             F.lit(None).cast("string").alias("full_alias"), F.lit(None).cast("array<string>").alias("targets"))
    al = import_aliases(rows)
    plain = al.where(F.col("name") != "*").select(
        "pkg", "ver", "module", "name", F.lit("alias").alias("kind"), "ord", "full_alias",
        F.lit(None).cast("array<string>").alias("targets"))
    wild = (
        al.where(F.col("name") == "*")
        .groupBy("pkg", "ver", "module")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "full_alias"))).alias("_t"))
        .select("pkg", "ver", "module", F.lit("*").alias("name"), F.lit("wildcard").alias("kind"),
                F.struct(F.lit(2).alias("rank"), F.lit(0).alias("src_rank"), F.lit(0).alias("pos")).alias("ord"), F.lit(None).cast("string").alias("full_alias"),
                F.transform("_t", lambda x: x["full_alias"]).alias("targets"))
    )
    allr = defs.unionByName(plain).unionByName(wild)
    w = Window.partitionBy("pkg", "ver", "module", "name").orderBy("ord")
    ent = allr.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")
    # listed twice from one row: a union would number all names a second time
    hoisted = F.when(F.col("module").endswith(".__init__"), F.array("module", F.regexp_replace("module", r"\.__init__$", ""))).otherwise(F.array("module"))
    ent = ent.withColumn("_m", F.explode(hoisted)).withColumn("module", F.col("_m")).drop("_m")
    return ent.withColumn("key", F.concat_ws(".", "module", "name"))


def winning_class_rows(rows: DataFrame) -> DataFrame:
    """Rows inside classes (members and nested classes) that belong to the
    first class of their name in the module, .py before .pyi."""
    inside = rows.where(F.col("class_path").isNotNull()).withColumn("_top", F.split("class_path", r"\.")[0])
    first = inside.where((F.col("rkind") == "class") & ~F.col("class_path").contains(".")).groupBy("pkg", "ver", "module", "_top").agg(
        F.min(F.struct("src_rank", "owner")).alias("_first"))
    return inside.join(first, ["pkg", "ver", "module", "_top"]).where(F.struct("src_rank", "owner") == F.col("_first")).drop("_top", "_first")


def build_members(rows: DataFrame) -> DataFrame:
    """Members of classes -> pkg, ver, class_key, name, mkind, ord,
    args, decorators, var_type, value (methods, fields, static fields, nested
    classes).  A method defined several times is listed each time, by ``ord``."""
    m = winning_class_rows(usable_rows(rows)).where(F.col("mkind").isNotNull())
    return m.select("pkg", "ver", F.concat_ws(".", "module", "class_path").alias("class_key"), "class_path", "name", "mkind", "ord",
                    "args", "decorators", "var_type", "value")


def failed_modules(rows: DataFrame) -> DataFrame:
    """One row per module file that could not be read -> pkg, ver, module, src_rank, error."""
    return rows.where(F.col("rkind") == "failed").groupBy("pkg", "ver", "module", "src_rank").agg(F.min("error").alias("error"))


def extraction_status(rows: DataFrame) -> DataFrame:
    """Per (pkg, ver): number of modules and of unreadable files and
    the version-level error; the files themselves are :func:`failed_modules`."""
    # per module first: count_distinct beside the others would double every row
    each = rows.groupBy("pkg", "ver", "module").agg(
        F.count_if(F.col("rkind") == "failed").alias("_failed"),
        F.min(F.when(F.col("rkind") == "version_error", F.col("error"))).alias("_error"),
    )
    return each.groupBy("pkg", "ver").agg(
        F.sum("_failed").alias("n_failed"), F.min("_error").alias("error_message"), F.count("module").alias("n_modules"),
    ).withColumn("error", F.col("error_message").isNotNull())


def class_names(members: DataFrame) -> DataFrame:
    """``get_names`` of each class: methods, fields, static fields, then
    nested classes, and the names inside these, at any depth, appended to the
    class's name *without* a dot.  members: by + class_key, class_path, name,
    mkind -> by + class_key, name

    A member knows its way through the classes around it (``class_path``), so
    it is listed for each of them at once; no recursion."""
    own = members.where(F.col("mkind").isin("method", "field", "static_field", "class"))
    around = F.split("class_path", r"\.")
    depth = F.size("_p")
    each = own.withColumn("_p", around).select("*", F.explode(F.sequence(F.lit(1), depth)).alias("_i"))
    # the key of the i-th class around: without the classes inside it
    drop = F.transform(F.slice("_p", F.col("_i") + 1, depth), lambda c: F.concat(F.lit("."), c))
    key = F.expr("left(class_key, length(class_key) - length(_inner))")
    return each.withColumn("_inner", F.array_join(drop, "")).select(
        "pkg", "ver", key.alias("class_key"), F.concat(F.array_join(F.slice("_p", F.col("_i") + 1, depth), ""), "name").alias("name"))


def public_names(entities: DataFrame, members: DataFrame, runtime=None) -> DataFrame:
    """Every key, and ``key.name`` for all names (K11) of every key that
    names a class, itself or through aliases (``from .m import C as D`` lists
    ``p.D.g``), distinct.  ``runtime`` as for :func:`follow`."""
    by = ["pkg", "ver"]
    entities = cut_lineage(entities.select(*by, "key", "kind", "full_alias", "targets"))  # four tables below come from it
    keys = entities.select(*by, F.col("key").alias("name"))
    cls = entities.where(F.col("kind") == "class").select(*by, "key", F.col("key").alias("result_key"))
    aliases = entities.where(F.col("kind") == "alias").select(*by, "key")
    first = F.min(F.struct("kind", "full_alias", "targets")).alias("_o")
    objects = entities.groupBy(*by, "key").agg(first).select(*by, "key", "_o.*")
    through = follow(aliases, objects, by, runtime).where(F.col("result_kind") == "class").select(*by, "key", "result_key")
    both = F.array_distinct(F.array("class_key", F.regexp_replace("class_key", r"\.__init__(?=\.)", "")))
    inside = class_names(members).select(*by, F.explode(both).alias("result_key"), "name").distinct()
    mem = cls.unionByName(through).join(inside, [*by, "result_key"]).select(*by, F.concat_ws(".", "key", "name").alias("name"))
    return keys.unionByName(mem).distinct()


def _first_branches(done: list[DataFrame], markers: list[DataFrame], req: list[str]) -> DataFrame:
    """The first success of each request in depth-first candidate order.  A
    cyclic candidate of a node (marker) ends the node: later ones don't count.
    done: req + path, result_key, result_kind.  markers: req + node, cyc_o."""
    res = reduce(DataFrame.unionByName, done)
    if markers:
        mk = reduce(DataFrame.unionByName, markers)
        steps = res.select(*req, "path", F.posexplode("path").alias("_d", "_o")).select(*req, "path", F.slice("path", 1, F.col("_d")).alias("node"), "_o")
        late = steps.join(mk, [*req, "node"]).where(F.col("cyc_o") < F.col("_o")).select(*req, "path").distinct()
        res = res.join(late, [*req, "path"], "left_anti")
    return res.groupBy(*req).agg(F.min(F.struct("path", "result_key", "result_kind")).alias("_b")).select(
        *req, F.col("_b.result_key").alias("result_key"), F.col("_b.result_kind").alias("result_kind"))


def _looked_at(names: DataFrame, objects: DataFrame, by: list[str], runtime) -> tuple[DataFrame, DataFrame]:
    """What stands at distinct ``names`` (by + name) in a placed object table:
    rows (by + name, kind; null if unknown) that are kept, and the candidates
    of aliases and of names unknown below a module with a wildcard import
    (by + name, own, o, t; in candidate order, t null if there is none)."""
    cat = [f"_cat_{c}" for c in by]
    renamed = [F.col(c).alias(x) for c, x in zip(by, cat)]
    named = objects.where(F.col("_k") != "wildcard").select(*renamed, F.col("_cur").alias("name"), F.col("_k").alias("kind"), "full_alias")
    wild = objects.where(F.col("_k") == "wildcard").select(*renamed, parent_of("_cur").alias("_parent"), F.col("targets").alias("_wt"))
    if runtime is None:
        placed = names.select("*", *renamed)
    else:  # a name that no catalogue serves stays, and is unknown
        tops = names.withColumn("top_level", F.substring_index("name", ".", 1))
        placed = tops.join(runtime(tops.select(*by, "top_level").distinct()), [*by, "top_level"], "left")
    at = share(placed.join(named, [*cat, "name"], "left").select(*by, *cat, "name", "kind", "full_alias"))
    leaf = F.substring_index("name", ".", -1)
    alias = at.where(F.col("kind") == "alias").select(*by, "name", "kind", F.array("full_alias").alias("_to"))
    unknown = at.where(F.col("kind").isNull()).withColumn("_parent", parent_of("name")).join(wild, [*cat, "_parent"]).select(
        *by, "name", F.lit("wildcard").alias("kind"), F.transform("_wt", lambda t: F.replace(t, F.lit("*"), leaf)).alias("_to"))
    out = alias.unionByName(unknown).select(*by, "name", F.col("kind").alias("own"), F.posexplode_outer("_to").alias("o", "t"))
    if runtime is None:
        out = out.withColumn("t", F.when(F.substring_index("t", ".", 1) == F.substring_index("name", ".", 1), F.col("t")))
    return at.select(*by, "name", "kind"), cut_lineage(out)


def _reach(edges: DataFrame, objects: DataFrame, by: list[str], runtime) -> tuple[DataFrame, DataFrame]:
    """Every name that resolving the names with ``edges`` can come to, each
    once per catalogue: nodes (by + name, kind) and edges (by + name, o, t, in
    candidate order).  Names that stand for themselves are no starts, so the
    rounds are as small as what aliases and wildcards lead to."""
    start = edges.select(*by, "name", F.lit(None).cast("string").alias("kind")).distinct()
    nodes, edges = [start], [edges.where("t IS NOT NULL").select(*by, "name", "o", "t")]
    new = edges[0].select(*by, F.col("t").alias("name")).distinct().join(start, [*by, "name"], "left_anti")
    while True:  # ends: a catalogue has so many targets, and each is met once
        if len(nodes) == 4:  # plans stay small however many rounds there are
            nodes, edges = [cut_lineage(reduce(DataFrame.unionByName, nodes))], [cut_lineage(reduce(DataFrame.unionByName, edges))]
        new = cut_lineage(new)
        if new.isEmpty():
            return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)
        at, out = _looked_at(new, objects, by, runtime)
        nodes.append(at)
        out = out.where("t IS NOT NULL").select(*by, "name", "o", "t")
        edges.append(out)
        new = out.select(*by, F.col("t").alias("name")).distinct().join(reduce(DataFrame.unionByName, nodes), [*by, "name"], "left_anti")


def _settle(edges: DataFrame, settled: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Answers from below: a node is settled by its first candidate that names
    something once all earlier ones are settled, or when all are settled and
    none does.  -> (settled, edges of the nodes that remain: they lead to a cycle)"""
    cols = [*by, "name", "result_key", "result_kind"]
    for n in itertools.count(1):
        if n % 4 == 0:  # plans stay small however many rounds there are
            settled, edges = cut_lineage(settled), cut_lineage(edges)
        at = edges.join(settled.select(*by, F.col("name").alias("t"), "result_key", "result_kind", F.lit(True).alias("_ok")), [*by, "t"], "left")
        best = at.groupBy(*by, "name").agg(
            F.min(F.when(F.col("_ok").isNull(), F.col("o"))).alias("_open"), F.min(F.when(F.col("result_kind").isNotNull(), F.struct("o", "result_key", "result_kind"))).alias("_hit"))
        done = best.where(F.col("_open").isNull() | (F.col("_hit.o") < F.col("_open"))).select(
            *by, "name", F.col("_hit.result_key").alias("result_key"), F.col("_hit.result_kind").alias("result_kind"))
        done = cut_lineage(done)
        if done.isEmpty():
            return settled, edges
        settled = settled.unionByName(done.select(*cols))
        edges = edges.join(done, [*by, "name"], "left_anti")


def _core(edges: DataFrame, by: list[str]) -> DataFrame:
    """Of unsettled edges those between nodes that a cycle leads to: nodes that nothing unsettled names go, again and again."""
    size = edges.count()
    while True:
        named = edges.select(*by, F.col("t").alias("name")).distinct()
        edges = cut_lineage(edges.join(named, [*by, "name"], "left_semi"))
        before, size = size, edges.count()
        if size == before:
            return edges


def _walk(starts: DataFrame, edges: DataFrame, settled: DataFrame, by: list[str]) -> DataFrame:
    """Depth-first answers among nodes on cycles, where they depend on the
    way: a candidate met before on the way ends its node.  starts: by + start,
    seen.  -> by + start, seen0, result_key, result_kind where there is one."""
    req = [*by, "start", "root"]
    known = settled.select(*by, F.col("name").alias("t"), "result_key", "result_kind", F.lit(True).alias("_ok"))
    steps = cut_lineage(edges.join(known, [*by, "t"], "left"))
    state = starts.select(*req, F.col("start").alias("name"), F.array().cast("array<int>").alias("path"), F.when(F.col("root"), F.array().cast("array<string>")).otherwise(F.array("start")).alias("seen"))
    done, markers = [], []
    while True:  # ends: a way never takes a candidate twice
        branch = cut_lineage(state.join(steps, [*by, "name"]).withColumn("path2", F.concat("path", F.array("o"))))
        done.append(branch.where("result_kind IS NOT NULL").select(*req, F.col("path2").alias("path"), "result_key", "result_kind"))
        again = F.array_contains("seen", F.col("t"))
        markers.append(branch.where(again & F.col("_ok").isNull()).select(*req, F.col("path").alias("node"), F.col("o").alias("cyc_o")))
        state = branch.where(~again & F.col("_ok").isNull()).select(*req, F.col("t").alias("name"), F.col("path2").alias("path"), F.concat("seen", F.array("t")).alias("seen"))
        if state.isEmpty():
            return _first_branches(done, markers, req)


def follow(requests: DataFrame, objects: DataFrame, by: list[str], runtime=None) -> DataFrame:
    """K8 ``get(key)`` for distinct keys (by + key): what each finally names,
    following aliases and wildcard imports of the last segment, first candidate
    first.  objects: by + key, kind, full_alias, targets, one row per key.
    -> by + key, result_key, result_kind; keys that name nothing are absent.

    Without ``runtime`` names stay inside the catalogue's own top level.
    ``runtime`` maps the top levels that a root needs (by + top_level) to the
    catalogues that serve them (by + top_level, _cat_ columns, see
    ``deps.runtime_catalogue``): aliases then lead on into other packages.

    Each name is resolved once per root, from what it leads to upwards, so the
    work grows with the names and not with the ways between them.  Only names
    on cycles depend on the way; those are walked in the reference order, and
    ways through them end where the cycle is left."""
    real, led = named(requests, objects, by, runtime)
    return real.select(*by, "key", F.col("key").alias("result_key"), F.col("kind").alias("result_kind")).unionByName(
        led.where("result_kind IS NOT NULL").select(*by, "key", "result_key", "result_kind"))


def named(requests: DataFrame, objects: DataFrame, by: list[str], runtime=None) -> tuple[DataFrame, DataFrame]:
    """:func:`follow` in two parts: keys that stand for themselves (by + key,
    kind), and aliases and names unknown below a module with a wildcard import
    (by + key, own: 'alias' | 'wildcard', result_key, result_kind; null if
    they lead nowhere).  Only the second part is resolved."""
    measured_joins(objects.sparkSession)
    objects = share_placed(objects.select(*by, F.col("key").alias("_cur"), F.col("kind").alias("_k"), "full_alias", "targets"), [*by, "_cur"])
    at, first = _looked_at(requests.select(*by, F.col("key").alias("name")).distinct(), objects, by, runtime)
    known = at.where("kind IS NOT NULL AND kind <> 'alias'").select(*by, F.col("name").alias("key"), "kind")
    asked = first.select(*by, F.col("name").alias("key"), "own").distinct()
    if first.isEmpty():
        return known, asked.select("*", F.lit(None).cast("string").alias("result_key"), F.lit(None).cast("string").alias("result_kind"))
    answers = cut_lineage(_resolved(asked.select(*by, "key"), first, objects, by, runtime))
    return known, asked.join(answers, [*by, "key"], "left")


def _resolved(wanted: DataFrame, first: DataFrame, objects: DataFrame, by: list[str], runtime) -> DataFrame:
    """Answers of the names ``wanted`` (by + key) that have the edges ``first``."""
    nodes, edges = _reach(first, objects, by, runtime)
    real = nodes.where("kind IS NOT NULL AND kind <> 'alias'").select(*by, "name", F.col("name").alias("result_key"), F.col("kind").alias("result_kind"))
    ends = nodes.where("kind IS NULL OR kind = 'alias'").select(*by, "name").join(edges.select(*by, "name").distinct(), [*by, "name"], "left_anti")
    nothing = F.lit(None).cast("string")
    settled = cut_lineage(real.unionByName(ends.select(*by, "name", nothing.alias("result_key"), nothing.alias("result_kind"))))
    settled, left = _settle(edges, settled, by)
    found = []
    if not left.isEmpty():
        settled = cut_lineage(settled)
        left = cut_lineage(left)
        core = _core(left, by)
        entries = cut_lineage(core.select(*by, F.col("name").alias("start")).distinct())
        asked = entries.join(wanted.withColumnRenamed("key", "start"), [*by, "start"], "left_semi")
        starts = entries.withColumn("root", F.lit(False)).unionByName(asked.withColumn("root", F.lit(True)))
        answers = cut_lineage(_walk(starts, core, settled, by))
        found.append(answers.where("root").select(*by, F.col("start").alias("key"), "result_key", "result_kind"))
        entered = entries.join(answers.where("NOT root").drop("root"), [*by, "start"], "left").withColumnRenamed("start", "name")
        settled, _ = _settle(left.join(entered, [*by, "name"], "left_anti"), cut_lineage(settled.unionByName(entered.select(*settled.columns))), by)
        wanted = wanted.join(asked.withColumnRenamed("start", "key"), [*by, "key"], "left_anti")
    found.append(wanted.join(settled.withColumnRenamed("name", "key"), [*by, "key"]).where("result_kind IS NOT NULL").select(*by, "key", "result_key", "result_kind"))
    return reduce(DataFrame.unionByName, found)


def _placed(names: DataFrame, by: list[str], runtime, own_tops: DataFrame) -> DataFrame:
    """``names`` (by + key, ...) with the catalogue (``_cat_`` columns) that
    serves the top level of each key; names that none serves go."""
    cat = [f"_cat_{c}" for c in by]
    tops = names.withColumn("top_level", F.substring_index("key", ".", 1))
    if runtime is None:
        own = own_tops.select(*[F.col(x).alias(c) for x, c in zip(cat, by)], "top_level")
        return tops.join(own, [*by, "top_level"], "left_semi").withColumns({x: F.col(c) for c, x in zip(by, cat)})
    return tops.join(runtime(tops.select(*by, "top_level").distinct()), [*by, "top_level"])


def query_keys(requests: DataFrame, objects: DataFrame, members: DataFrame, by: list[str], runtime=None) -> DataFrame:
    """K9 ``query(key)`` for name lists of any number of catalogues at once.

    Unlike K8 an alias may sit in any segment: the walk goes over module
    prefixes; at the first prefix that is not a module it
      - rewrites an alias prefix to ``target + rest`` (revisiting an alias is a cycle),
      - branches over the wildcard candidates of the parent module when the
        name is unknown (candidates in order, ``*`` replaced),
      - answers a class member for the rest (NULL for an unknown member),
      - answers the entity itself when nothing is left, else fails.
    The first success in depth-first candidate order wins (smallest branch
    path); a cyclic candidate stops the later candidates of its node.  Each
    rewritten name is looked up in the catalogue of its own top level: the
    request's own catalogue, or any that ``runtime`` names (see :func:`follow`).

    requests: by + key.  objects: by + key, kind, full_alias, targets (see
    ``chainmatch.catalogue_tables``).  members: by + class_key, name, mkind.
    -> by + key, result_key, result_kind, found; equal requests are answered
    once; ``found`` is also true where an unknown member was asked of a class."""
    measured_joins(objects.sparkSession)
    cat = [f"_cat_{c}" for c in by]
    objects = cut_lineage(objects.select(*by, "key", "kind", "full_alias", "targets"))  # modules and entities come from it
    keyed = objects.select(*[F.col(c).alias(x) for c, x in zip(by, cat)], F.col("key").alias("_p"), F.col("kind").alias("_k"), "full_alias", "targets")
    # read once per round by several joins: keep them
    mods = share(keyed.where(F.col("_k") == "module").select(*cat, "_p").distinct())
    ents = share(keyed.where(F.col("_k") != "module"))
    mem = share(members.where(F.col("mkind").isin("method", "field", "static_field")).select(
        *[F.col(c).alias(x) for c, x in zip(by, cat)], F.col("class_key").alias("_ck"), F.col("name").alias("_mn"), F.col("mkind").alias("_mk")).distinct())
    wild = ents.where(F.col("_k") == "wildcard").select(*cat, parent_of("_p").alias("_parent"), F.col("targets").alias("_wt"))
    own_tops = mods.where(~F.col("_p").contains(".")).withColumnRenamed("_p", "top_level")
    req = [*by, "req"]
    state = requests.select(*by, "key").distinct().select(*by, F.col("key").alias("req"), "key", F.array().cast("array<int>").alias("path"), F.array().cast("array<string>").alias("seen"))
    done, markers = [], []
    while True:  # ends: a branch never takes an alias twice
        # a row id fixed by the checkpoint; joins below use it instead of the array columns
        base = cut_lineage(_placed(state, by, runtime, own_tops).withColumn("_sid", F.monotonically_increasing_id()))
        if base.isEmpty():
            break
        seg = F.split("key", r"\.")
        steps = base.where(F.size(seg) > 1).select(
            "_sid", *cat, "key", F.explode(F.sequence(F.lit(1), F.size(seg) - 1)).alias("_i")) \
            .withColumn("_p", F.array_join(F.slice(F.split("key", r"\."), 1, F.col("_i") + 1), "."))
        first_non_module = (
            steps.join(mods, [*cat, "_p"], "left_anti")
            .groupBy("_sid").agg(F.min(F.struct("_i", "_p")).alias("_s"))
        )
        # one row per state: where its walk over modules ends, and what stands there
        at = base.join(first_non_module, "_sid", "left").select(
            *req, *cat, "key", "path", "seen", F.col("_s._p").alias("_p"),
            F.array_join(F.slice(seg, F.col("_s._i") + 2, F.size(seg)), ".").alias("_rest"),
            F.substring_index("_s._p", ".", -1).alias("_leaf"), parent_of("_s._p").alias("_parent"))
        j = cut_lineage(at.join(ents, [*cat, "_p"], "left").join(wild, [*cat, "_parent"], "left"))
        rest_empty = F.col("_rest") == ""
        done.append(j.where("_p IS NULL").select(*req, "path", F.col("key").alias("result_key"), F.lit("module").alias("result_kind")))
        done.append(j.where(F.col("_k").isin("function", "variable", "class") & rest_empty).select(
            *req, "path", F.col("_p").alias("result_key"), F.col("_k").alias("result_kind")))
        inside = F.when(F.col("_rest").contains("."), F.concat_ws(".", "_p", F.regexp_replace("_rest", r"\.[^.]*$", ""))).otherwise(F.col("_p"))
        done.append(
            j.where((F.col("_k") == "class") & ~rest_empty).withColumn("_ck", inside).withColumn("_mn", F.substring_index("_rest", ".", -1))
            .join(mem, [*cat, "_ck", "_mn"], "left")
            .select(*req, "path", F.when(F.col("_mk").isNotNull(), F.concat_ws(".", "_ck", "_mn")).alias("result_key"), F.col("_mk").alias("result_kind")))
        to = F.when(F.col("_k") == "alias", F.array("full_alias")).when(
            F.col("_p").isNotNull() & F.col("_k").isNull(), F.transform("_wt", lambda t: F.replace(t, F.lit("*"), F.col("_leaf"))))
        br = j.select(*req, "path", "seen", "_rest", F.posexplode(to).alias("o", "t"))
        again = F.array_contains("seen", F.col("t"))
        markers.append(br.where(again).select(*req, F.col("path").alias("node"), F.col("o").alias("cyc_o")))
        state = br.where(~again).select(
            *req, F.when(F.col("_rest") == "", F.col("t")).otherwise(F.concat_ws(".", "t", "_rest")).alias("key"),
            F.concat("path", F.array("o")).alias("path"), F.concat("seen", F.array("t")).alias("seen"))
    if not done:
        done = [requests.limit(0).select(*by, F.col("key").alias("req"), F.array().cast("array<int>").alias("path"), F.col("key").alias("result_key"), F.col("key").alias("result_kind"))]
    res = _first_branches(done, markers, req).withColumnRenamed("req", "key").withColumn("found", F.lit(True))
    return requests.select(*by, "key").distinct().join(res, [*by, "key"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
