"""Queries for usage, dependency violations and the usage reports (U, R22-R31)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pkgscope.operators import clients as C
from pkgscope.operators import usage as U
from pkgscope.plans.q_versions import FILES_SQL, release_files, requirements
from pkgscope.plans.registry import register
from pkgscope.session import cut_lineage
from pkgscope.sources.bindings import binding, binding_cte, table

PAIR = ["c_pkg", "u_pkg", "u_ver"]


def usage_matches(spark, sf_dir):
    """b_usage as match rows of client files against upstream versions."""
    return binding(spark, sf_dir, "b_usage").withColumnRenamed("dep_ver", "u_ver")


USAGE_SQL = binding_cte("b_usage") + """,
mt AS (SELECT c_pkg, u_pkg, dep_ver AS u_ver, api, src_file, n_lines, chain, status, message FROM b_usage)
"""


@register("U1_api_usage", USAGE_SQL + """
SELECT c_pkg, u_pkg, u_ver, api, count(*) AS files, CAST(sum(n_lines) AS BIGINT) AS calls,
       array_to_string(list_sort(list_distinct(list(chain))), '|') AS patterns
FROM mt WHERE status = 'MATCH' GROUP BY c_pkg, u_pkg, u_ver, api""")
def q_u1(spark, sf_dir):
    return U.api_usage(usage_matches(spark, sf_dir), PAIR).withColumn("patterns", F.array_join("patterns", "|"))


@register("U2_violations", USAGE_SQL + """
SELECT c_pkg, u_pkg, u_ver, src_file, chain, status, message FROM mt WHERE status <> 'MATCH'""")
def q_u2(spark, sf_dir):
    return U.violations(usage_matches(spark, sf_dir)).select(*PAIR, "src_file", "chain", "status", "message")


@register("U3_pair_totals", USAGE_SQL + """
SELECT c_pkg, u_pkg, u_ver, count(DISTINCT api) FILTER (WHERE status = 'MATCH') AS num_apis,
       count(*) FILTER (WHERE status <> 'MATCH') AS num_violations
FROM mt GROUP BY c_pkg, u_pkg, u_ver""")
def q_u3(spark, sf_dir):
    return U.pair_totals(usage_matches(spark, sf_dir), PAIR)


# ------------------------------------------------------------ dependency checks

def checks(spark, sf_dir):
    reqs, _ = requirements(spark, sf_dir)
    rel = C.release_versions(release_files(spark, sf_dir)).select("pkg", "ver")
    return reqs, rel, U.dependency_checks(reqs, rel, usage_matches(spark, sf_dir))


CHECKS_SQL = FILES_SQL.replace("WITH b_release AS", "WITH " + binding_cte("b_usage")[5:] + ",\nb_release AS", 1) + """,
nap AS (SELECT dep, spec, count(*) AS vers_with_apis FROM m GROUP BY dep, spec),
mk AS (SELECT m.dep, m.spec, m.ver, vk2.r1, vk2.r2, vk2.r3, vk2.is_pre OR vk2.is_dev OR vk2.is_post AS odd
       FROM m JOIN vk2 ON vk2.pkg = m.dep AND vk2.ver = m.ver),
res AS (SELECT c_pkg, c_ver, u_pkg, api, src_file, n_lines, chain, status, message, dep_ver,
        CAST(split_part(dep_ver, '.', 1) AS INTEGER) AS d1, CAST(split_part(dep_ver, '.', 2) AS INTEGER) AS d2,
        coalesce(TRY_CAST(nullif(split_part(dep_ver, '.', 3), '') AS INTEGER), 0) AS d3 FROM b_usage),
rq AS (SELECT DISTINCT c_pkg, c_ver, dep, spec FROM b_req),
chk AS (
  SELECT res.c_pkg, rq.c_ver, res.u_pkg AS dep, mk.spec, mk.ver AS dep_ver, res.api, res.src_file, res.n_lines, res.chain,
         res.status, res.message, nap.vers_with_apis
  FROM res JOIN mk ON mk.dep = res.u_pkg AND mk.r1 = res.d1 AND mk.r2 = res.d2 AND mk.r3 = res.d3 AND NOT mk.odd
  JOIN rq ON rq.c_pkg = res.c_pkg AND rq.c_ver = res.c_ver AND rq.dep = mk.dep AND rq.spec = mk.spec
  JOIN nap ON nap.dep = mk.dep AND nap.spec = mk.spec),
vio AS (
  SELECT chk.*, o.vers_occurred, 1.0 - o.vers_occurred / chk.vers_with_apis AS prob FROM chk
  JOIN (SELECT c_pkg, c_ver, dep, spec, message, count(DISTINCT dep_ver) AS vers_occurred FROM chk
        WHERE status IN ('MISMATCH', 'MISSING') GROUP BY ALL) o
    ON o.c_pkg = chk.c_pkg AND o.c_ver = chk.c_ver AND o.dep = chk.dep AND o.spec = chk.spec AND o.message = chk.message
  WHERE chk.status IN ('MISMATCH', 'MISSING')),
summ AS (
  SELECT r.c_pkg, r.c_ver, coalesce(s.nv, 0) AS num_violations, coalesce(s.nm, 0) AS num_matches
  FROM (SELECT DISTINCT c_pkg, c_ver FROM b_req) r LEFT JOIN (
    SELECT c_pkg, c_ver, count(*) FILTER (WHERE status IN ('MISMATCH', 'MISSING')) AS nv,
           count(*) FILTER (WHERE status NOT IN ('MISMATCH', 'MISSING')) AS nm FROM chk GROUP BY ALL) s
  ON s.c_pkg = r.c_pkg AND s.c_ver = r.c_ver),
chosen AS (
  SELECT c_pkg, c_ver, num_violations, num_matches FROM (
    SELECT *, row_number() OVER (PARTITION BY c_pkg ORDER BY CAST(split_part(c_ver, '.', 1) AS INTEGER) DESC,
                                 CAST(split_part(c_ver, '.', 2) AS INTEGER) DESC) AS r FROM summ)
  WHERE r <= 10 AND num_violations > 0)
"""


@register("U4_dependency_checks", CHECKS_SQL + """
SELECT c_pkg, c_ver, dep, spec, dep_ver, api, src_file, n_lines, chain, status, message, vers_with_apis FROM chk""")
def q_u4(spark, sf_dir):
    return checks(spark, sf_dir)[2].select("c_pkg", "c_ver", "dep", "spec", "dep_ver", "api", "src_file", "n_lines",
                                           "chain", "status", "message", "vers_with_apis")


@register("U5_dependency_coverage", CHECKS_SQL + """
SELECT rq.c_pkg, rq.c_ver, rq.dep, rq.spec, coalesce(a.vers, 0) AS vers, coalesce(nap.vers_with_apis, 0) AS vers_with_apis
FROM rq LEFT JOIN (SELECT pkg AS dep, count(DISTINCT ver) AS vers FROM rel GROUP BY pkg) a ON a.dep = rq.dep
LEFT JOIN nap ON nap.dep = rq.dep AND nap.spec = rq.spec""")
def q_u5(spark, sf_dir):
    reqs, rel, _ = checks(spark, sf_dir)
    return U.coverage(reqs, rel)


@register("U6_violation_confidence", CHECKS_SQL + """
SELECT c_pkg, c_ver, dep, spec, dep_ver, src_file, chain, status, message, vers_occurred, round(prob, 9) AS prob FROM vio""")
def q_u6(spark, sf_dir):
    v = U.with_confidence(checks(spark, sf_dir)[2])
    return v.select("c_pkg", "c_ver", "dep", "spec", "dep_ver", "src_file", "chain", "status", "message", "vers_occurred",
                    F.round("prob", 9).alias("prob"))


@register("U7_check_summary", CHECKS_SQL + "SELECT * FROM summ")
def q_u7(spark, sf_dir):
    reqs, _, chk = checks(spark, sf_dir)
    return U.summaries(chk, reqs)


@register("U9_newest_with_violations", CHECKS_SQL + "SELECT * FROM chosen")
def q_u9(spark, sf_dir):
    reqs, _, chk = checks(spark, sf_dir)
    return U.newest_with_violations(U.summaries(chk, reqs))


def reported(spark, sf_dir):
    """A few versions of each package are chosen first, and only their checks are gone into."""
    reqs, rel, chk = checks(spark, sf_dir)
    chosen = cut_lineage(U.newest_with_violations(U.summaries(chk, reqs)))
    return U.violation_report(U.with_confidence(U.of_versions(chk, chosen)), chosen, rel, reqs)


@register("U10_violation_report", CHECKS_SQL + """,
lastreq AS (SELECT c_pkg, c_ver, dep, max(spec) AS spec FROM rq WHERE (c_pkg, c_ver) IN (SELECT c_pkg, c_ver FROM chosen) GROUP BY ALL),
newest AS (SELECT l.c_pkg, l.c_ver, l.dep, arg_max(m.ver, vk2.k) AS newest FROM lastreq l
           JOIN m ON m.dep = l.dep AND m.spec = l.spec JOIN vk2 ON vk2.pkg = m.dep AND vk2.ver = m.ver GROUP BY ALL),
g AS (
  SELECT v.c_pkg, v.c_ver, v.dep, v.dep_ver, v.message,
         arg_min(v.status, (v.spec, v.dep_ver, v.src_file, v.chain)) AS violation,
         arg_min(v.prob, (v.spec, v.dep_ver, v.src_file, v.chain)) AS confidence,
         arg_min(v.spec, (v.spec, v.dep_ver, v.src_file, v.chain)) AS dep_spec,
         array_to_string(list_sort(list(v.src_file || ':' || CAST(v.n_lines AS VARCHAR))), chr(10)) AS affected
  FROM vio v WHERE (v.c_pkg, v.c_ver) IN (SELECT c_pkg, c_ver FROM chosen) GROUP BY ALL)
SELECT g.c_pkg, g.c_ver, g.dep, dep_spec, g.dep_ver, violation, g.message, round(confidence, 9) AS confidence, affected
FROM g LEFT JOIN newest n ON n.c_pkg = g.c_pkg AND n.c_ver = g.c_ver AND n.dep = g.dep
WHERE violation <> 'MISSING' AND confidence >= 0.5 AND g.dep_ver = n.newest""")
def q_u10(spark, sf_dir):
    rep = reported(spark, sf_dir)
    return rep.withColumn("confidence", F.round("confidence", 9))


@register("U11_ordered_violation_report", CHECKS_SQL + """,
lastreq AS (SELECT c_pkg, c_ver, dep, max(spec) AS spec FROM rq WHERE (c_pkg, c_ver) IN (SELECT c_pkg, c_ver FROM chosen) GROUP BY ALL),
newest AS (SELECT l.c_pkg, l.c_ver, l.dep, arg_max(m.ver, vk2.k) AS newest FROM lastreq l
           JOIN m ON m.dep = l.dep AND m.spec = l.spec JOIN vk2 ON vk2.pkg = m.dep AND vk2.ver = m.ver GROUP BY ALL),
g AS (
  SELECT v.c_pkg, v.c_ver, v.dep, v.dep_ver, v.message,
         arg_min(v.status, (v.spec, v.dep_ver, v.src_file, v.chain)) AS violation,
         arg_min(v.prob, (v.spec, v.dep_ver, v.src_file, v.chain)) AS confidence
  FROM vio v WHERE (v.c_pkg, v.c_ver) IN (SELECT c_pkg, c_ver FROM chosen) GROUP BY ALL),
rep AS (SELECT g.* FROM g LEFT JOIN newest n ON n.c_pkg = g.c_pkg AND n.c_ver = g.c_ver AND n.dep = g.dep
        WHERE violation <> 'MISSING' AND confidence >= 0.5 AND g.dep_ver = n.newest)
SELECT rep.c_pkg, rep.c_ver, rep.dep, rep.dep_ver, rep.message, coalesce(d.dependents, 0) AS downloads
FROM rep LEFT JOIN (SELECT 'app' || (c_custkey % 100) AS name, count(*) AS dependents FROM customer GROUP BY 1) d ON d.name = rep.c_pkg""")
def q_u11(spark, sf_dir):
    """U10 rows with the client package's download figure, ordered by it
    descending, then version and message ascending (plain text order)."""
    rep = reported(spark, sf_dir)
    dep = table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("app"), F.col("c_custkey") % 100).alias("c_pkg")).agg(
        F.count(F.lit(1)).alias("downloads"))
    return (rep.join(dep, "c_pkg", "left").na.fill(0, ["downloads"])
            .select("c_pkg", "c_ver", "dep", "dep_ver", "message", "downloads")
            .orderBy(F.col("downloads").desc(), "c_ver", "message"))
