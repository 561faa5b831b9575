"""Statistical reports of the study notebooks (R1-R35) as aggregates.

Every report is a groupBy / window over the tables built by the other
operators; figures are not drawn, the rows behind them are returned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pkgscope.functions import versions as V
from pkgscope.operators import catalog as K
from pkgscope.session import cut_lineage

# --- fixed values: report bucket labels and error classes of the study ---
PRECISION_BUCKETS = ["Match", "Missing", "Wrong", "No Dependency", "Runtime Error"]
RECALL_BUCKETS = ["Match", "Loose Match", "Unresolved", "Mismatch", "Missing"]
STATIC_ERROR_CLASSES = [
    ("FileNotFoundError", "FileNotFoundError: '/' in top level"),
    ("FileExistsError", "FileExistsError: some intermittent zip extraction was terminated"),
]
DYNAMIC_ERROR_CLASSES = [
    ("PackageInstallException", "PackageInstallException: Cannot install package in a conda env with Python>=3.6"),
    ("JSONDecodeError", "JSONDecodeError: Other kind of runtime exception occurred"),
    ("FileNotFoundError", "FileNotFoundError: '/' in top level"),
]
DYNAMIC_MODULE_CLASSES = ((("RecursionError",), "RecursionError"), (("ImportError", "ModuleNotFoundError"), "ImportError"), (("SyntaxError",), "SyntaxError"))
SYNTAX_ERROR_MARKERS = ["SyntaxError", "IndentationError", "TabError", "RecursionError"]
YEAR_SPEC_TYPES = ["any", "at-least", "range", "fixed", "other"]
MIN_DEPS_PER_YEAR = 1000


def _bucket_shares(df: DataFrame, by: str, buckets: dict[str, Column]) -> DataFrame:
    counts = df.groupBy(by).agg(*[F.count_if(c).alias(k) for k, c in buckets.items()])
    total = reduce(lambda a, b: a + b, [F.col(k) for k in buckets])
    return counts.select(by, *[F.col(k) for k in buckets], *[(F.col(k) / total).alias(f"share_{k}") for k in buckets])


def precision_buckets(probe: DataFrame) -> DataFrame:
    """Per package: success, missing attribute, wrong, missing
    dependency (independent text tests) and runtime errors (none of them),
    with per-package shares."""
    s, out = F.col("success"), F.col("stdout")
    miss, wrong, nodep = out.contains("has no attribute"), out.contains("Wrong"), out.contains("No module named")
    return _bucket_shares(probe, "package", {
        "match": s, "missing": miss, "wrong": wrong, "no_dependency": nodep,
        "runtime_error": ~(s | miss | wrong | nodep)})


def recall_buckets(probe: DataFrame) -> DataFrame:
    """Per package: Match (types agree), Loose Match (extracted as a
    variable), Unresolved, Mismatch, Missing, with per-package shares."""
    d, e = F.col("dynamic_type"), F.col("extracted_type")
    return _bucket_shares(probe, "package", {
        "match": d == e, "loose_match": (d != e) & (e == "Variable"), "unresolved": e == "Unresolved",
        "mismatch": (d != e) & ~e.isin("Unresolved", "Variable", "Missing"), "missing": e == "Missing"})


def macro_average(shares: DataFrame, col: str = "share_match") -> DataFrame:
    return shares.agg(F.avg(col).alias(f"avg_{col}"))


def sample_per_group(df: DataFrame, group: str, key: str, n: int = 50, seed: int = 0) -> DataFrame:
    """A seeded sample of ``n`` rows per group, in the order of md5 of key
    and seed (a window limit, so each group keeps only n rows map-side)."""
    w = Window.partitionBy(group).orderBy(F.md5(F.concat(F.col(key), F.lit(str(seed)))), F.col(key))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def extracted_types(names: DataFrame, entities: DataFrame, objects: DataFrame, by: list[str]) -> DataFrame:
    """What observed names (by + key) are in a catalogue: ``Missing`` if it
    doesn't hold them (K6), ``Unresolved`` if they lead to nothing (K8), else
    the kind of what they name -> by + key, extracted_type.  entities: by +
    key, kind, module; objects: one row per key (``chainmatch.one_per_key``)."""
    entities = cut_lineage(entities.select(*by, "key", "kind", "module"))  # read for the names, the modules and the wildcards
    held = K.contains(names.select(*by, "key").distinct(), entities, by)
    found = K.follow(names, objects, by)
    kind = F.when(F.col("result_kind") == "module", "Package").otherwise(F.initcap("result_kind"))
    return held.join(found, [*by, "key"], "left").select(
        *by, "key", F.when(~F.col("in_old"), "Missing").when(F.col("result_kind").isNull(), "Unresolved").otherwise(kind).alias("extracted_type"))


def coverage_totals(coverage: DataFrame) -> DataFrame:
    """Used and total APIs of all packages together."""
    return coverage.agg(F.sum("used").alias("used"), F.sum("total").alias("total")).withColumn("coverage", F.col("used") / F.col("total"))


def requirements_covered(reqs: DataFrame) -> DataFrame:
    """Packages, versions and rows that the distribution covers."""
    return reqs.agg(F.count_distinct("c_pkg").alias("packages"), F.count_distinct("c_pkg", "c_ver").alias("versions"), F.count(F.lit(1)).alias("n"))


def headline_counts(stats: DataFrame) -> DataFrame:
    """Packages, versions, versions and packages with a wheel."""
    w = F.col("wheel").isNotNull()
    return stats.agg(
        F.count_distinct("package").alias("n_packages"),
        F.count(F.lit(1)).alias("n_versions"),
        F.count_if(w).alias("n_versions_wheel"),
        F.count_distinct(F.when(w, F.col("package"))).alias("n_packages_wheel"),
    )


def wheels_per_year(stats: DataFrame) -> DataFrame:
    """Versions with / without a wheel per release year (no time: skipped)."""
    return (
        stats.where(F.col("time").isNotNull())
        .groupBy(F.year("time").alias("year"))
        .agg(F.count_if(F.col("wheel").isNotNull()).alias("has_wheel"), F.count_if(F.col("wheel").isNull()).alias("no_wheel"))
    )


def python_tags_per_year(stats: DataFrame) -> DataFrame:
    """Every dash part of the wheel name starting with ``py`` counts:
    py2+py3 or neither -> Any, py3 -> Python 3, py2 -> Python 2."""
    parts = (
        stats.where(F.col("time").isNotNull() & F.col("wheel").isNotNull())
        .select(F.year("time").alias("year"), F.explode(F.split("wheel", "-")).alias("part"))
        .where(F.col("part").startswith("py"))
    )
    p3, p2 = F.col("part").contains("py3"), F.col("part").contains("py2")
    tag = F.when(p3 & p2, "Any").when(p3, "Python 3").when(p2, "Python 2").otherwise("Any")
    return (
        parts.withColumn("tag", tag).groupBy("year").pivot("tag", ["Python 2", "Python 3", "Any"]).count()
        .na.fill(0)
        .select("year", F.col("Python 2").alias("py2"), F.col("Python 3").alias("py3"), F.col("Any").alias("any"))
    )


def spec_type_distribution(reqs: DataFrame) -> DataFrame:
    """Requirement rows per specifier type with their share of all rows
    (the total comes from a one-row aggregate)."""
    t = reqs.withColumn("type", V.spec_type(F.col("spec")))
    per = t.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    tot = per.agg(F.sum("n").alias("_t"))
    return per.join(F.broadcast(tot)).select("type", "n", (F.col("n") / F.col("_t")).alias("share"))


def spec_types_per_year(reqs: DataFrame, time_col: str = "time") -> DataFrame:
    """Per year shares of any / at-least / range (var-* included) /
    fixed / other (at-most included); years with fewer than 1000
    requirements are dropped."""
    t = V.spec_type(F.col("spec"))
    grp = F.when(t.isin("var-minor", "var-micro"), "range").when(t.isin(*YEAR_SPEC_TYPES), t).otherwise("other")
    c = (
        reqs.where(F.col(time_col).isNotNull())
        .select(F.year(time_col).alias("year"), grp.alias("grp"))
        .groupBy("year").pivot("grp", YEAR_SPEC_TYPES).count().na.fill(0)
    )
    total = reduce(lambda a, b: a + b, [F.col(k) for k in YEAR_SPEC_TYPES])
    return c.where(total >= MIN_DEPS_PER_YEAR).select(
        "year", *[(F.col(k) / total).alias(k.replace("-", "_")) for k in YEAR_SPEC_TYPES])


def extraction_totals(stats: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Versions and packages without error / without failed
    modules; module, failed module and API totals over error-free versions."""
    ok = ~F.col("error")
    clean = ok & (F.col("n_failed_modules") == 0)
    return stats.groupBy(*by).agg(
        F.count_if(ok).alias("versions_no_error"),
        F.count_distinct(F.when(ok, F.col("package"))).alias("packages_no_error"),
        F.count_if(clean).alias("versions_no_failed"),
        F.count_distinct(F.when(clean, F.col("package"))).alias("packages_no_failed"),
        F.sum(F.when(ok, F.col("num_modules"))).alias("modules"),
        F.sum(F.when(ok, F.col("n_failed_modules"))).alias("failed_modules"),
        F.sum(F.when(ok, F.col("num_apis"))).alias("apis"),
    )


def exact_quantiles(df: DataFrame, by: list[str], col: str, probs: list[float]) -> DataFrame:
    """Exact quantiles (linear between ranks) -> by + q, one array in the order
    of ``probs``.  Equal values become one row with their number first; the
    values are range-partitioned, the partitions' totals give each value the
    ranks it covers, and only values that cover a wanted rank go on.  No task
    holds a group's values.  Null values don't count; ``by`` columns are not null.
    Without ``by`` there is one row, of nulls if there is no value."""
    values = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranged = cut_lineage(values.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy(*by, "_part").agg(F.sum("_n").alias("_size"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    shift = sizes.select(*by, "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*by, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("_upto", F.sum("_n").over(within)).join(shift, [*by, "_part"]).withColumn("_upto", F.col("_before") + F.col("_upto"))
    place = [F.lit(p) * (F.col("_all") - 1) for p in probs]
    wanted = sizes.groupBy(*by).agg(F.sum("_size").alias("_all")).select(*by, F.array(*place).alias("_at"))  # one row a group
    met = placed.join(wanted, by) if by else placed.join(F.broadcast(wanted))
    covers = lambda r: (r >= F.col("_upto") - F.col("_n")) & (r < F.col("_upto"))
    met = met.where(F.exists("_at", lambda a: covers(F.floor(a)) | covers(F.ceil(a))))
    pick = lambda i, rank: F.max(F.when(covers(rank(F.col("_at")[i])), F.col("_v")))
    found = met.groupBy(*by).agg(F.first("_at").alias("_at"), *[pick(i, f).alias(f"_{n}{i}") for i in range(len(probs)) for n, f in (("lo", F.floor), ("hi", F.ceil))])
    return found.select(*by, F.array(*[F.col(f"_lo{i}") + (F.col("_at")[i] - F.floor(F.col("_at")[i])) * (F.col(f"_hi{i}") - F.col(f"_lo{i}")) for i in range(len(probs))]).alias("q"))


def describe(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, std (sample), min, quartiles (exact, linear),
    max, per group if ``by`` is given (not null)."""
    by = by or []
    c = F.col(col)
    plain = df.groupBy(*by).agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.sum(c).alias("total"))
    q = exact_quantiles(df, by, col, [0.25, 0.5, 0.75])
    both = plain.join(q, by, "left") if by else plain.join(F.broadcast(q), how="left")  # one row each
    return both.select(*by, "count", "mean", "std", "min", *[F.col("q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))], "max", "total")


def public_overlap(sets: DataFrame, names: list[str]) -> DataFrame:
    """How many APIs lie in which of the compared sets.  sets: api, source
    (one of ``names``).  One bit mask per API, counted per mask
    -> one boolean column per name, n_apis."""
    bit = F.coalesce(*[F.when(F.col("source") == n, F.lit(1 << i)) for i, n in enumerate(names)])
    masks = sets.groupBy("api").agg(F.bit_or(bit).alias("_m")).groupBy("_m").agg(F.count(F.lit(1)).alias("n_apis"))
    return masks.select(*[(F.col("_m").bitwiseAND(F.lit(1 << i)) != 0).alias(n) for i, n in enumerate(names)], "n_apis")


def error_classes(stats: DataFrame, classes=STATIC_ERROR_CLASSES) -> DataFrame:
    """Error rows classed by the first marker found in the stack trace."""
    st = F.col("stack_trace")
    cls = F.lit("Other")
    for marker, label in reversed(classes):
        cls = F.when(F.coalesce(st.contains(marker), F.lit(False)), label).otherwise(cls)
    return stats.where(F.col("error")).groupBy(cls.alias("type")).agg(F.count(F.lit(1)).alias("n"))


def failed_module_classes(failed: DataFrame) -> DataFrame:
    """Failed modules (one row each) classed as SyntaxError or Other."""
    syn = reduce(lambda a, b: a | b, [F.col("error").contains(m) for m in SYNTAX_ERROR_MARKERS])
    return failed.groupBy(F.when(syn, "SyntaxError").otherwise("Other").alias("type")).agg(F.count(F.lit(1)).alias("n"))


def dynamic_failed_module_classes(failed: DataFrame) -> DataFrame:
    """Failed modules (one row each) of the dynamic mode by the first
    class of error whose name occurs in the text."""
    cls = F.lit("Other")
    for marks, label in reversed(DYNAMIC_MODULE_CLASSES):
        cls = F.when(reduce(lambda a, b: a | b, [F.col("error").contains(m) for m in marks]), label).otherwise(cls)
    return failed.groupBy(cls.alias("type")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ usage

def per_client(usage: DataFrame) -> DataFrame:
    """Per client: APIs used, files, calls."""
    return usage.groupBy("c_pkg").agg(F.count_distinct("api").alias("apis"), F.sum("files").alias("files"),
                                      F.sum("calls").alias("calls"))


def per_api(usage: DataFrame) -> DataFrame:
    """Per upstream API: clients, files, calls."""
    return usage.groupBy("u_pkg", "api").agg(F.count_distinct("c_pkg").alias("clients"), F.sum("files").alias("files"),
                                             F.sum("calls").alias("calls"))


def usage_totals(usage: DataFrame) -> DataFrame:
    """Totals over all clients."""
    return usage.agg(F.count_distinct("c_pkg").alias("clients"), F.count_distinct("u_pkg", "api").alias("apis"),
                     F.sum("files").alias("files"), F.sum("calls").alias("calls"))


def top_apis(api_stats: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` APIs with most clients per package (ties by name)."""
    w = Window.partitionBy("u_pkg").orderBy(F.col("clients").desc(), F.col("api"))
    return api_stats.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def outside(apis: DataFrame, internal: DataFrame) -> DataFrame:
    """``apis`` (u_pkg, api, ...) not in internal sub-packages.  internal:
    u_pkg, prefix (a module; it holds itself and all below it).  Every prefix
    of an API is looked up, so the join is on equal names."""
    parts = F.split("api", r"\.")
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    hidden = apis.select("u_pkg", "api", F.explode(upto).alias("prefix")).join(internal, ["u_pkg", "prefix"], "left_semi").select("u_pkg", "api").distinct()
    return apis.join(hidden, ["u_pkg", "api"], "left_anti")


def rank_curve(api_stats: DataFrame, metric: str) -> DataFrame:
    """Rank of each API by a metric, descending, per package."""
    w = Window.partitionBy("u_pkg").orderBy(F.col(metric).desc(), F.col("api"))
    return api_stats.select("u_pkg", "api", metric, F.row_number().over(w).alias("rank"))


def cumulative_apis(usage: DataFrame) -> DataFrame:
    """Distinct APIs covered as clients are added, widest client first.

    Each (package, API) is credited to the first client (in client order)
    that uses it: a min over a small per-API group, then a running sum over
    the per-client table, partitioned by upstream package."""
    cl = (
        usage.groupBy("u_pkg", "c_pkg").agg(F.count_distinct("api").alias("n_apis"))
        .withColumn("order", F.row_number().over(
            Window.partitionBy("u_pkg").orderBy(F.col("n_apis").desc(), F.col("c_pkg"))))
    )
    first = (
        usage.select("u_pkg", "c_pkg", "api").distinct().join(cl.select("u_pkg", "c_pkg", "order"), ["u_pkg", "c_pkg"])
        .groupBy("u_pkg", "api").agg(F.min("order").alias("order"))
        .groupBy("u_pkg", "order").agg(F.count(F.lit(1)).alias("new_apis"))
    )
    w = Window.partitionBy("u_pkg").orderBy("order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        cl.join(first, ["u_pkg", "order"], "left").na.fill(0, ["new_apis"])
        .withColumn("cum_apis", F.sum("new_apis").over(w))
        .select("u_pkg", "order", "c_pkg", "new_apis", "cum_apis")
    )


def is_public(api: Column) -> Column:
    """No segment starts with a single underscore (``__x`` is public)."""
    return ~F.exists(F.split(api, r"\."), lambda s: s.startswith("_") & ~s.startswith("__"))


# ------------------------------------------------------------------ name-list comparison

def accessibility(names: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per (lib, ver): external names that resolve in our catalogue
    (``catalog.query_keys`` found something; an unknown member of a known
    class counts, as asking for it is no error) and those that do not.
    names: lib, ver, name.  resolved: lib, ver, name, found."""
    j = names.select("lib", "ver", "name").distinct().join(
        resolved.select("lib", "ver", "name", "found"), ["lib", "ver", "name"], "left")
    return j.groupBy("lib", "ver").agg(
        F.count_if("found").alias("accessible"), F.count_if(~F.coalesce("found", F.lit(False))).alias("not_accessible"))


def accessible_ratio(per_lib: DataFrame) -> DataFrame:
    """R2: accessible names over all names, summed over libraries."""
    return per_lib.agg((F.sum("accessible") / (F.sum("accessible") + F.sum("not_accessible"))).alias("ratio"))


def distinct_names_total(names: DataFrame) -> DataFrame:
    """Distinct names per list file, summed."""
    return names.groupBy("lib", "ver").agg(F.count_distinct("name").alias("n")).agg(F.sum("n").alias("total_names"))
