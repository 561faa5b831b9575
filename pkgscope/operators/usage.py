"""API usage and dependency violations (U1-U12) as aggregates over match rows.

A match row is one (client file, access chain) checked against one upstream
version: c_pkg, [c_ver,] u_pkg, u_ver, src_file, chain, n_lines, status,
message, api (the matched name).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pkgscope.functions import versions as V
from pkgscope.session import share

VIOLATION_KINDS = ["MISMATCH", "MISSING"]


def api_usage(matches: DataFrame, by: list[str]) -> DataFrame:
    """Per pair and API: files (= number of (file, chain) matches),
    calls (= total line count), sorted distinct patterns."""
    return (
        matches.where(F.col("status") == "MATCH")
        .groupBy(*by, "api")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("n_lines").cast("bigint").alias("calls"),
            F.array_sort(F.collect_set("chain")).alias("patterns"),
        )
    )


def violations(matches: DataFrame) -> DataFrame:
    """Every non-MATCH row."""
    return matches.where(F.col("status") != "MATCH")


def violation_lines(matches: DataFrame, by: list[str]) -> DataFrame:
    """The places of U10: one row per message and file with the distinct
    ``lines`` of all its chains, ascending.  A group is bounded by one file."""
    keys = [*by, "status", "message", "src_file"]
    lines = violations(matches).select(*keys, F.explode("lines").alias("line")).distinct()
    return lines.groupBy(*keys).agg(F.array_sort(F.collect_list("line")).alias("lines"))


def pair_totals(matches: DataFrame, by: list[str]) -> DataFrame:
    """Number of APIs used and number of violations per pair."""
    return matches.groupBy(*by).agg(
        F.count_distinct(F.when(F.col("status") == "MATCH", F.col("api"))).alias("num_apis"),
        F.count_if(F.col("status") != "MATCH").alias("num_violations"),
    )


def dependency_checks(reqs: DataFrame, releases: DataFrame, results: DataFrame) -> DataFrame:
    """U4: every client version against each declared, satisfying, catalogued
    version of each dependency.

    reqs: c_pkg, c_ver, dep, spec (one row per declared requirement).
    releases: pkg, ver (catalogued versions).
    results: c_pkg, c_ver, u_pkg, u_ver, src_file, chain, n_lines, status,
    message — match rows of the code of that very client version against
    upstream versions.

    The satisfying versions are found on distinct (dep, spec) (V8 join).  The
    requirements of a client version meet the versions that this very client
    version was checked against, before any result row: a result is never
    paired with the specifiers of other clients, nor a requirement with
    versions that its client has no results for.
    Versions are compared by PEP 440 key ('1.1' is '1.1.0')."""
    reqs = share(reqs.select("c_pkg", "c_ver", "dep", "spec").distinct())
    sat = share(V.matching_versions(reqs, releases))
    n_apis = sat.groupBy("dep", "spec").agg(F.count(F.lit(1)).alias("vers_with_apis"))
    results = results.withColumnRenamed("u_pkg", "dep")
    tried = share(results.select("c_pkg", "c_ver", "dep", "u_ver").distinct())
    # Keys only for distinct versions: (dep, result version text) -> (spec, catalogue version)
    res_vers = tried.select("dep", "u_ver").distinct().withColumn("_k", V.version_key(F.col("u_ver")))
    ver_map = (
        sat.select("dep", "ver").distinct().withColumn("_k", V.version_key(F.col("ver")))
        .join(res_vers, ["dep", "_k"])
        .join(sat, ["dep", "ver"])
        .select("dep", "u_ver", "spec", F.col("ver").alias("dep_ver"))
    )
    met = share(reqs.join(tried, ["c_pkg", "c_ver", "dep"]).join(ver_map, ["dep", "u_ver", "spec"]).join(n_apis, ["dep", "spec"]))
    return results.join(met, ["c_pkg", "c_ver", "dep", "u_ver"]).drop("u_ver")


def coverage(reqs: DataFrame, releases: DataFrame) -> DataFrame:
    """Per requirement: all versions of the dependency and the
    satisfying catalogued ones."""
    reqs = reqs.select("c_pkg", "c_ver", "dep", "spec").distinct()
    sat = V.matching_versions(reqs, releases).groupBy("dep", "spec").agg(F.count(F.lit(1)).alias("vers_with_apis"))
    allv = releases.groupBy(F.col("pkg").alias("dep")).agg(F.count_distinct("ver").alias("vers"))
    return (
        reqs.join(allv, "dep", "left").join(sat, ["dep", "spec"], "left")
        .select("c_pkg", "c_ver", "dep", "spec", F.coalesce("vers", F.lit(0)).alias("vers"),
                F.coalesce("vers_with_apis", F.lit(0)).alias("vers_with_apis"))
    )


def with_confidence(checks: DataFrame) -> DataFrame:
    """Violations with ``vers_occurred`` (distinct dependency versions
    showing the same message for the same requirement) and
    ``prob = 1 - vers_occurred / vers_with_apis``.  Computed as an
    aggregate joined back, not a window, so a large group is combined
    map-side."""
    vio = checks.where(F.col("status").isin(VIOLATION_KINDS))
    keys = ["c_pkg", "c_ver", "dep", "spec", "message"]
    occ = vio.groupBy(*keys).agg(F.count_distinct("dep_ver").alias("vers_occurred"))
    return vio.join(occ, keys).withColumn(
        "prob", F.lit(1.0) - F.col("vers_occurred") / F.col("vers_with_apis"))


def summaries(checks: DataFrame, reqs: DataFrame) -> DataFrame:
    """num_violations / num_matches per client version; versions without
    any requirement produce no summary, versions whose requirements have no
    results get zeros."""
    counts = checks.groupBy("c_pkg", "c_ver").agg(
        F.count_if(F.col("status").isin(VIOLATION_KINDS)).alias("num_violations"),
        F.count_if(~F.col("status").isin(VIOLATION_KINDS)).alias("num_matches"),
    )
    return (
        reqs.select("c_pkg", "c_ver").distinct().join(counts, ["c_pkg", "c_ver"], "left")
        .select("c_pkg", "c_ver", F.coalesce("num_violations", F.lit(0)).alias("num_violations"),
                F.coalesce("num_matches", F.lit(0)).alias("num_matches"))
    )


def newest_with_violations(summ: DataFrame, n: int = 10) -> DataFrame:
    """The newest ``n`` versions of each package, then those with
    violations (the cut comes first)."""
    w = Window.partitionBy("c_pkg").orderBy(V.version_key(F.col("c_ver")).desc(), F.col("c_ver").desc())
    return summ.withColumn("_r", F.row_number().over(w)).where((F.col("_r") <= n) & (F.col("num_violations") > 0)).drop("_r")


def of_versions(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``rows`` of the chosen client versions."""
    return rows.join(chosen.select("c_pkg", "c_ver"), ["c_pkg", "c_ver"], "left_semi")


def violation_report(viol: DataFrame, chosen: DataFrame, releases: DataFrame, reqs: DataFrame) -> DataFrame:
    """Violations of the chosen versions grouped by (c_ver, dep,
    dep_ver, message); a group is dropped when its first row is MISSING or
    has prob < 0.5, or when dep_ver is not the newest satisfying version of
    the dependency.  ``affected`` lists ``file:[lines]`` of the group."""
    v = of_versions(viol, chosen)
    # Newest satisfying version per (client version, dep); the last declared
    # requirement of a dep decides when a dep is declared twice (largest spec text).
    sat = V.matching_versions(reqs, releases).withColumn("_k", V.version_key(F.col("ver")))
    last_req = (
        of_versions(reqs, chosen)
        .groupBy("c_pkg", "c_ver", "dep").agg(F.max("spec").alias("spec"))
    )
    newest = (
        last_req.join(sat.groupBy("dep", "spec").agg(F.max_by("ver", "_k").alias("newest")), ["dep", "spec"])
        .select("c_pkg", "c_ver", "dep", "newest")
    )
    order = F.struct("spec", "dep_ver", "src_file", "chain")
    g = (
        v.groupBy("c_pkg", "c_ver", "dep", "dep_ver", "message")
        .agg(
            F.min_by(F.struct("status", "prob", "spec"), order).alias("_first"),
            F.array_join(F.array_sort(F.collect_list(F.concat("src_file", F.lit(":"), F.col("n_lines").cast("string")))), "\n").alias("affected"),
        )
        .join(newest, ["c_pkg", "c_ver", "dep"], "left")
    )
    return (
        g.where((F.col("_first.status") != "MISSING") & (F.col("_first.prob") >= 0.5) & (F.col("dep_ver") == F.col("newest")))
        .select("c_pkg", "c_ver", "dep", F.col("_first.spec").alias("dep_spec"), "dep_ver",
                F.col("_first.status").alias("violation"), "message", F.col("_first.prob").alias("confidence"), "affected")
    )
