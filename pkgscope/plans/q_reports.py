"""Report queries (R4-R31) over the probe, statistics, requirement and usage bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from pkgscope.operators import reports as R
from pkgscope.operators import usage as U
from pkgscope.plans.q_usage import PAIR, USAGE_SQL, usage_matches
from pkgscope.plans.q_versions import V9_SQL
from pkgscope.plans.registry import register
from pkgscope.sources.bindings import binding, binding_cte, table


def _round(df, cols, n=9):
    for c in cols:
        df = df.withColumn(c, F.round(c, n))
    return df


PROBE_SQL = binding_cte("b_probe")


@register("R4_R5_precision_buckets", PROBE_SQL + """,
c AS (SELECT package, count(*) FILTER (WHERE success) AS match,
  count(*) FILTER (WHERE strpos(stdout, 'has no attribute') > 0) AS missing,
  count(*) FILTER (WHERE strpos(stdout, 'Wrong') > 0) AS wrong,
  count(*) FILTER (WHERE strpos(stdout, 'No module named') > 0) AS no_dependency,
  count(*) FILTER (WHERE NOT (success OR strpos(stdout, 'has no attribute') > 0 OR strpos(stdout, 'Wrong') > 0
                   OR strpos(stdout, 'No module named') > 0)) AS runtime_error FROM b_probe GROUP BY package)
SELECT package, match, missing, wrong, no_dependency, runtime_error,
  round(match / (match + missing + wrong + no_dependency + runtime_error), 9) AS share_match,
  round(missing / (match + missing + wrong + no_dependency + runtime_error), 9) AS share_missing,
  round(wrong / (match + missing + wrong + no_dependency + runtime_error), 9) AS share_wrong,
  round(no_dependency / (match + missing + wrong + no_dependency + runtime_error), 9) AS share_no_dependency,
  round(runtime_error / (match + missing + wrong + no_dependency + runtime_error), 9) AS share_runtime_error FROM c""")
def q_r4(spark, sf_dir):
    d = R.precision_buckets(binding(spark, sf_dir, "b_probe"))
    return _round(d, [c for c in d.columns if c.startswith("share_")])


@register("R6_R7_recall_buckets", PROBE_SQL + """,
c AS (SELECT package, count(*) FILTER (WHERE dynamic_type = extracted_type) AS match,
  count(*) FILTER (WHERE dynamic_type <> extracted_type AND extracted_type = 'Variable') AS loose_match,
  count(*) FILTER (WHERE extracted_type = 'Unresolved') AS unresolved,
  count(*) FILTER (WHERE dynamic_type <> extracted_type AND extracted_type NOT IN ('Unresolved', 'Variable', 'Missing')) AS mismatch,
  count(*) FILTER (WHERE extracted_type = 'Missing') AS missing FROM b_probe GROUP BY package)
SELECT package, match, loose_match, unresolved, mismatch, missing,
  round(match / (match + loose_match + unresolved + mismatch + missing), 9) AS share_match,
  round(loose_match / (match + loose_match + unresolved + mismatch + missing), 9) AS share_loose_match,
  round(unresolved / (match + loose_match + unresolved + mismatch + missing), 9) AS share_unresolved,
  round(mismatch / (match + loose_match + unresolved + mismatch + missing), 9) AS share_mismatch,
  round(missing / (match + loose_match + unresolved + mismatch + missing), 9) AS share_missing FROM c""")
def q_r6(spark, sf_dir):
    d = R.recall_buckets(binding(spark, sf_dir, "b_probe"))
    return _round(d, [c for c in d.columns if c.startswith("share_")])


@register("R5_macro_precision", PROBE_SQL + """,
c AS (SELECT package, count(*) FILTER (WHERE success) AS m,
  count(*) FILTER (WHERE success) + count(*) FILTER (WHERE strpos(stdout, 'has no attribute') > 0)
  + count(*) FILTER (WHERE strpos(stdout, 'Wrong') > 0) + count(*) FILTER (WHERE strpos(stdout, 'No module named') > 0)
  + count(*) FILTER (WHERE NOT (success OR strpos(stdout, 'has no attribute') > 0 OR strpos(stdout, 'Wrong') > 0
                   OR strpos(stdout, 'No module named') > 0)) AS t FROM b_probe GROUP BY package)
SELECT round(avg(m / t), 9) AS avg_share_match FROM c""")
def q_r5(spark, sf_dir):
    return _round(R.macro_average(R.precision_buckets(binding(spark, sf_dir, "b_probe"))), ["avg_share_match"])


@register("R7_macro_average", PROBE_SQL + """
SELECT round(avg(share), 9) AS macro_average FROM (
  SELECT count(*) FILTER (WHERE dynamic_type = extracted_type) / count(*) FILTER (WHERE dynamic_type = extracted_type OR extracted_type IN ('Variable', 'Unresolved', 'Missing') OR dynamic_type <> extracted_type) AS share
  FROM b_probe GROUP BY package)""")
def q_r7(spark, sf_dir):
    d = R.macro_average(R.recall_buckets(binding(spark, sf_dir, "b_probe")))
    return d.select(F.round(d[d.columns[0]], 9).alias("macro_average"))


@register("R8_extracted_type_counts", PROBE_SQL + """
SELECT package, extracted_type, count(*) AS n FROM b_probe GROUP BY package, extracted_type""")
def q_r8(spark, sf_dir):
    return binding(spark, sf_dir, "b_probe").groupBy("package", "extracted_type").agg(F.count(F.lit(1)).alias("n"))


@register("R9_sample_per_package", binding_cte("b_probe") + """,
p AS (SELECT DISTINCT package, api FROM b_probe WHERE dynamic_type IN ('Class', 'Function'))
SELECT package, api FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY md5(api || '42'), api) AS r FROM p) WHERE r <= 50""")
def q_r9(spark, sf_dir):
    """Seeded sample of 50 probed APIs per package (md5 order)."""
    p = binding(spark, sf_dir, "b_probe").where(F.col("dynamic_type").isin("Class", "Function"))
    return R.sample_per_group(p.select("package", "api").distinct(), "package", "api", 50, seed=42)


STATS_SQL = binding_cte("b_stats")


def stats(spark, sf_dir):
    return binding(spark, sf_dir, "b_stats")


@register("R10_headline_counts", STATS_SQL + """
SELECT count(DISTINCT package) AS n_packages, count(*) AS n_versions, count(wheel) AS n_versions_wheel,
       count(DISTINCT package) FILTER (WHERE wheel IS NOT NULL) AS n_packages_wheel FROM b_stats""")
def q_r10(spark, sf_dir):
    return R.headline_counts(stats(spark, sf_dir))


@register("R11_wheels_per_year", STATS_SQL + """
SELECT year(time) AS year, count(wheel) AS has_wheel, count(*) FILTER (WHERE wheel IS NULL) AS no_wheel
FROM b_stats WHERE time IS NOT NULL GROUP BY year(time)""")
def q_r11(spark, sf_dir):
    return R.wheels_per_year(stats(spark, sf_dir))


@register("R12_python_tags_per_year", STATS_SQL + """,
p AS (SELECT year(time) AS year, unnest(string_split(wheel, '-')) AS part FROM b_stats WHERE time IS NOT NULL AND wheel IS NOT NULL),
t AS (SELECT year, CASE WHEN strpos(part, 'py3') > 0 AND strpos(part, 'py2') > 0 THEN 'Any' WHEN strpos(part, 'py3') > 0 THEN 'Python 3'
  WHEN strpos(part, 'py2') > 0 THEN 'Python 2' ELSE 'Any' END AS tag FROM p WHERE starts_with(part, 'py'))
SELECT year, count(*) FILTER (WHERE tag = 'Python 2') AS py2, count(*) FILTER (WHERE tag = 'Python 3') AS py3,
       count(*) FILTER (WHERE tag = 'Any') AS any FROM t GROUP BY year""")
def q_r12(spark, sf_dir):
    return R.python_tags_per_year(stats(spark, sf_dir))


@register("R15_extraction_totals", STATS_SQL + """
SELECT count(*) FILTER (WHERE NOT error) AS versions_no_error, count(DISTINCT package) FILTER (WHERE NOT error) AS packages_no_error,
  count(*) FILTER (WHERE NOT error AND n_failed_modules = 0) AS versions_no_failed,
  count(DISTINCT package) FILTER (WHERE NOT error AND n_failed_modules = 0) AS packages_no_failed,
  CAST(sum(num_modules) FILTER (WHERE NOT error) AS BIGINT) AS modules,
  CAST(sum(n_failed_modules) FILTER (WHERE NOT error) AS BIGINT) AS failed_modules,
  CAST(sum(num_apis) FILTER (WHERE NOT error) AS BIGINT) AS apis FROM b_stats""")
def q_r15(spark, sf_dir):
    return R.extraction_totals(stats(spark, sf_dir))


@register("R17_extraction_time", STATS_SQL + """
SELECT count(duration_ms) AS count, round(avg(duration_ms), 6) AS mean, round(stddev_samp(duration_ms), 6) AS std,
  min(duration_ms) AS min, round(quantile_cont(duration_ms, 0.25), 6) AS q25, round(quantile_cont(duration_ms, 0.5), 6) AS q50,
  round(quantile_cont(duration_ms, 0.75), 6) AS q75, max(duration_ms) AS max, CAST(sum(duration_ms) AS BIGINT) AS total
FROM b_stats WHERE NOT error""")
def q_r17(spark, sf_dir):
    d = R.describe(stats(spark, sf_dir).where(~F.col("error")), "duration_ms")
    return _round(d, ["mean", "std", "q25", "q50", "q75"], 6)


@register("R17_extraction_time_by_mode", STATS_SQL + """
SELECT CASE WHEN wheel IS NULL THEN 'dynamic' ELSE 'static' END AS mode, count(duration_ms) AS count, round(avg(duration_ms), 6) AS mean, round(stddev_samp(duration_ms), 6) AS std,
  min(duration_ms) AS min, round(quantile_cont(duration_ms, 0.25), 6) AS q25, round(quantile_cont(duration_ms, 0.5), 6) AS q50,
  round(quantile_cont(duration_ms, 0.75), 6) AS q75, max(duration_ms) AS max, CAST(sum(duration_ms) AS BIGINT) AS total
FROM b_stats WHERE NOT error GROUP BY 1""")
def q_r17_mode(spark, sf_dir):
    """Versions without a wheel stand for those inspected at run time."""
    s = stats(spark, sf_dir).where(~F.col("error")).withColumn("mode", F.when(F.col("wheel").isNull(), "dynamic").otherwise("static"))
    return _round(R.describe(s, "duration_ms", ["mode"]), ["mean", "std", "q25", "q50", "q75"], 6)


@register("R18_static_error_classes", STATS_SQL + """
SELECT CASE WHEN strpos(stack_trace, 'FileNotFoundError') > 0 THEN 'FileNotFoundError: ''/'' in top level'
  WHEN strpos(stack_trace, 'FileExistsError') > 0 THEN 'FileExistsError: some intermittent zip extraction was terminated'
  ELSE 'Other' END AS type, count(*) AS n FROM b_stats WHERE error GROUP BY 1""")
def q_r18(spark, sf_dir):
    return R.error_classes(stats(spark, sf_dir))


REQ_SQL = binding_cte("b_req")


@register("R14_spec_types_per_year", REQ_SQL + """,
s AS (SELECT spec, list_filter(list_transform(string_split(spec, ','), lambda x: trim(x)), lambda x: x <> '') AS cls FROM (SELECT DISTINCT spec FROM b_req)),
t AS (SELECT spec, CASE WHEN len(cls) = 0 THEN 'any'
  WHEN len(cls) = 1 THEN CASE WHEN regexp_matches(cls[1], '^(>=|>)') THEN 'at-least'
    WHEN regexp_matches(cls[1], '^(<=|<)') THEN 'at-most'
    WHEN regexp_matches(cls[1], '^==\\s*[0-9]+\\.[0-9]+\\.\\*') THEN 'range'
    WHEN regexp_matches(cls[1], '^==\\s*[0-9]+\\.\\*') THEN 'range'
    WHEN regexp_matches(cls[1], '^==\\s*\\*$') THEN 'any'
    WHEN regexp_matches(cls[1], '^==') AND NOT regexp_matches(cls[1], '^===') THEN 'fixed'
    WHEN regexp_matches(cls[1], '^~=\\s*[0-9]+\\.[0-9]+') THEN 'range'
    ELSE 'other' END
  WHEN len(cls) = 2 AND len(list_filter(cls, lambda c: regexp_matches(c, '^>'))) > 0 AND len(list_filter(cls, lambda c: regexp_matches(c, '^<'))) > 0 THEN 'range'
  ELSE 'other' END AS grp FROM s),
y AS (SELECT year(c_time) AS year, CASE WHEN grp = 'at-most' THEN 'other' ELSE grp END AS grp FROM b_req JOIN t USING (spec) WHERE c_time IS NOT NULL),
c AS (SELECT year, count(*) FILTER (WHERE grp = 'any') AS a, count(*) FILTER (WHERE grp = 'at-least') AS l,
  count(*) FILTER (WHERE grp = 'range') AS r, count(*) FILTER (WHERE grp = 'fixed') AS f, count(*) FILTER (WHERE grp = 'other') AS o, count(*) AS n
  FROM y GROUP BY year)
SELECT year, round(a / n, 9) AS any, round(l / n, 9) AS at_least, round(r / n, 9) AS range, round(f / n, 9) AS fixed,
       round(o / n, 9) AS other FROM c WHERE n >= 1000""")
def q_r14(spark, sf_dir):
    d = R.spec_types_per_year(binding(spark, sf_dir, "b_req"), "c_time")
    return _round(d, ["any", "at_least", "range", "fixed", "other"])


@register("R13_spec_type_distribution", V9_SQL + """
SELECT spec_type AS type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share
FROM b_req JOIN v9 USING (spec) GROUP BY spec_type""")
def q_r13(spark, sf_dir):
    """Spec type shares over all requirement rows."""
    return _round(R.spec_type_distribution(binding(spark, sf_dir, "b_req")), ["share"])


@register("R13_requirements_covered", V9_SQL + "SELECT count(DISTINCT c_pkg) AS packages, count(DISTINCT (c_pkg, c_ver)) AS versions, count(*) AS n FROM b_req")
def q_r13_covered(spark, sf_dir):
    return R.requirements_covered(binding(spark, sf_dir, "b_req"))


# ------------------------------------------------------------------ usage reports

def api_usage(spark, sf_dir):
    return U.api_usage(usage_matches(spark, sf_dir), PAIR)


U1_SQL = USAGE_SQL + """,
u1 AS (SELECT c_pkg, u_pkg, u_ver, api, count(*) AS files, sum(n_lines) AS calls FROM mt WHERE status = 'MATCH'
       GROUP BY c_pkg, u_pkg, u_ver, api),
pa AS (SELECT u_pkg, api, count(DISTINCT c_pkg) AS clients, CAST(sum(files) AS BIGINT) AS files, CAST(sum(calls) AS BIGINT) AS calls
       FROM u1 GROUP BY u_pkg, api)
"""


@register("R22_per_client", U1_SQL + """
SELECT c_pkg, count(DISTINCT api) AS apis, CAST(sum(files) AS BIGINT) AS files, CAST(sum(calls) AS BIGINT) AS calls FROM u1 GROUP BY c_pkg""")
def q_r22(spark, sf_dir):
    return R.per_client(api_usage(spark, sf_dir))


@register("R23_per_api", U1_SQL + "SELECT * FROM pa")
def q_r23(spark, sf_dir):
    return R.per_api(api_usage(spark, sf_dir))


@register("R24_usage_totals", U1_SQL + """
SELECT count(DISTINCT c_pkg) AS clients, count(DISTINCT (u_pkg, api)) AS apis, CAST(sum(files) AS BIGINT) AS files,
       CAST(sum(calls) AS BIGINT) AS calls FROM u1""")
def q_r24(spark, sf_dir):
    return R.usage_totals(api_usage(spark, sf_dir))


@register("R25_describe_clients_per_api", U1_SQL + """
SELECT count(clients) AS count, round(avg(clients), 6) AS mean, round(stddev_samp(clients), 6) AS std, min(clients) AS min,
  round(quantile_cont(clients, 0.25), 6) AS q25, round(quantile_cont(clients, 0.5), 6) AS q50, round(quantile_cont(clients, 0.75), 6) AS q75,
  max(clients) AS max, CAST(sum(clients) AS BIGINT) AS total FROM pa""")
def q_r25(spark, sf_dir):
    return _round(R.describe(R.per_api(api_usage(spark, sf_dir)), "clients"), ["mean", "std", "q25", "q50", "q75"], 6)


@register("R26_api_coverage", U1_SQL + """,
tot AS (SELECT top_level AS u_pkg, count(*) AS total FROM (SELECT DISTINCT 'pkg' || CAST(l_partkey % 50 AS VARCHAR) AS top_level,
        'pkg.f' || CAST(l_partkey AS VARCHAR) AS key FROM lineitem) GROUP BY top_level)
SELECT t.u_pkg, coalesce(u.used, 0) AS used, t.total, round(coalesce(u.used, 0) / t.total, 9) AS coverage
FROM tot t LEFT JOIN (SELECT u_pkg, count(DISTINCT api) AS used FROM pa GROUP BY u_pkg) u ON u.u_pkg = t.u_pkg""")
def q_r26(spark, sf_dir):
    """Used / total APIs per upstream; the catalogue of pkgN holds pkg.f<partkey>
    for every part shipped (the b_usage key space)."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cat = li.select(F.concat(F.lit("pkg"), (F.col("l_partkey") % 50).cast("string")).alias("u_pkg"),
                    F.concat(F.lit("pkg.f"), F.col("l_partkey").cast("string")).alias("key")).distinct()
    total = cat.groupBy("u_pkg").agg(F.count(F.lit(1)).alias("total"))
    used = R.per_api(api_usage(spark, sf_dir)).groupBy("u_pkg").agg(F.count_distinct("api").alias("used"))
    return (total.join(used, "u_pkg", "left").na.fill(0, ["used"])
            .select("u_pkg", "used", "total", F.round(F.col("used") / F.col("total"), 9).alias("coverage")))


@register("R27_top_apis", U1_SQL + """
SELECT u_pkg, api, clients, files, calls, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY u_pkg ORDER BY clients DESC, api) AS rank FROM pa) WHERE rank <= 10""")
def q_r27(spark, sf_dir):
    return R.top_apis(R.per_api(api_usage(spark, sf_dir)))


@register("R28_rank_curve_calls", U1_SQL + """
SELECT u_pkg, api, calls, row_number() OVER (PARTITION BY u_pkg ORDER BY calls DESC, api) AS rank FROM pa""")
def q_r28(spark, sf_dir):
    return R.rank_curve(R.per_api(api_usage(spark, sf_dir)), "calls")


for _metric in ("clients", "files"):
    register(f"R28_rank_curve_{_metric}", U1_SQL + f"""
SELECT u_pkg, api, {_metric}, row_number() OVER (PARTITION BY u_pkg ORDER BY {_metric} DESC, api) AS rank FROM pa""")(
        lambda spark, sf_dir, m=_metric: R.rank_curve(R.per_api(api_usage(spark, sf_dir)), m))


@register("R29_cumulative_apis", U1_SQL + """,
cl AS (SELECT u_pkg, c_pkg, count(DISTINCT api) AS n_apis FROM u1 GROUP BY u_pkg, c_pkg),
o AS (SELECT *, row_number() OVER (PARTITION BY u_pkg ORDER BY n_apis DESC, c_pkg) AS ord FROM cl),
f AS (SELECT u.u_pkg, u.api, min(o.ord) AS ord FROM (SELECT DISTINCT u_pkg, c_pkg, api FROM u1) u JOIN o ON o.u_pkg = u.u_pkg AND o.c_pkg = u.c_pkg GROUP BY u.u_pkg, u.api),
n AS (SELECT u_pkg, ord, count(*) AS new_apis FROM f GROUP BY u_pkg, ord)
SELECT o.u_pkg, o.ord AS "order", o.c_pkg, coalesce(n.new_apis, 0) AS new_apis,
  CAST(sum(coalesce(n.new_apis, 0)) OVER (PARTITION BY o.u_pkg ORDER BY o.ord) AS BIGINT) AS cum_apis
FROM o LEFT JOIN n ON n.u_pkg = o.u_pkg AND n.ord = o.ord""")
def q_r29(spark, sf_dir):
    return R.cumulative_apis(api_usage(spark, sf_dir))


@register("R30_public_api_usage", U1_SQL + """
SELECT u_pkg, api, NOT len(list_filter(string_split(api, '.'), lambda s: starts_with(s, '_') AND NOT starts_with(s, '__'))) > 0 AS is_public
FROM pa""")
def q_r30(spark, sf_dir):
    return R.per_api(api_usage(spark, sf_dir)).select("u_pkg", "api", R.is_public(F.col("api")).alias("is_public"))


_COVERAGE = """,
tot AS (SELECT u_pkg, count(*) AS total FROM (SELECT DISTINCT 'pkg' || CAST(l_partkey % 50 AS VARCHAR) AS u_pkg, l_partkey FROM lineitem) GROUP BY u_pkg),
used AS (SELECT u_pkg, count(DISTINCT api) AS used FROM pa GROUP BY u_pkg)
SELECT sum(coalesce(used, 0))::BIGINT AS used, sum(total)::BIGINT AS total, round(sum(coalesce(used, 0)) / sum(total), 9) AS coverage FROM tot LEFT JOIN used USING (u_pkg)"""


@register("R26_overall_coverage", U1_SQL + _COVERAGE)
def q_r26_overall(spark, sf_dir):
    return _round(R.coverage_totals(q_r26(spark, sf_dir)), ["coverage"])


#: Internal sub-packages: what they hold is not public whatever its name.  Fixed values.
INTERNAL = ["pkg.f1", "pkg.f22"]


@register("R30_public_set_overlap", U1_SQL + """,
used AS (SELECT DISTINCT api FROM pa WHERE NOT len(list_filter(string_split(api, '.'), lambda s: starts_with(s, '_') AND NOT starts_with(s, '__'))) > 0
         AND api NOT IN ('pkg.f1', 'pkg.f22')),
listed AS (SELECT DISTINCT 'pkg.f' || CAST(p_partkey AS VARCHAR) AS api FROM part WHERE p_partkey % 3 <> 0),
seen AS (SELECT DISTINCT 'pkg.f' || CAST(l_partkey AS VARCHAR) AS api FROM lineitem WHERE l_quantity > 45),
b AS (SELECT api, api IN (SELECT api FROM used) AS used, api IN (SELECT api FROM listed) AS listed, api IN (SELECT api FROM seen) AS seen
      FROM (SELECT api FROM used UNION SELECT api FROM listed UNION SELECT api FROM seen))
SELECT used, listed, seen, count(*) AS n_apis FROM b GROUP BY used, listed, seen""")
def q_r30_overlap(spark, sf_dir):
    """Overlaps of the public APIs that clients use, that a list names, and that busy clients call."""
    used = R.per_api(api_usage(spark, sf_dir)).where(R.is_public(F.col("api")))
    internal = used.select("u_pkg").distinct().select("u_pkg", F.explode(F.array(*map(F.lit, INTERNAL))).alias("prefix"))
    used = R.outside(used, internal).select("api", F.lit("used").alias("source"))
    name = lambda c: F.concat(F.lit("pkg.f"), c).alias("api")
    listed = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(name("p_partkey"), F.lit("listed").alias("source"))
    seen = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(name("l_partkey"), F.lit("seen").alias("source"))
    return R.public_overlap(used.unionByName(listed).unionByName(seen), ["used", "listed", "seen"])


@register("R19_dynamic_error_classes", STATS_SQL + """
SELECT CASE WHEN strpos(stack_trace, 'PackageInstallException') > 0 THEN 'PackageInstallException: Cannot install package in a conda env with Python>=3.6'
  WHEN strpos(stack_trace, 'JSONDecodeError') > 0 THEN 'JSONDecodeError: Other kind of runtime exception occurred'
  WHEN strpos(stack_trace, 'FileNotFoundError') > 0 THEN 'FileNotFoundError: ''/'' in top level'
  ELSE 'Other' END AS type, count(*) AS n FROM b_stats WHERE error GROUP BY 1""")
def q_r19(spark, sf_dir):
    return R.error_classes(stats(spark, sf_dir), R.DYNAMIC_ERROR_CLASSES)


@register("R20_failed_module_classes", binding_cte("b_source") + """
SELECT 'SyntaxError' AS type, count(*) AS n FROM b_source WHERE k % 40 = 0""")
def q_r20(spark, sf_dir):
    from pkgscope.plans.q_source import parsed

    return R.failed_module_classes(parsed(spark, sf_dir).where(F.col("rkind") == "failed").select("module", "error"))


@register("R31_public_usage_spread", U1_SQL + """,
f AS (SELECT *, NOT len(list_filter(string_split(api, '.'), lambda s: starts_with(s, '_') AND NOT starts_with(s, '__'))) > 0 AS is_public FROM pa)
SELECT is_public, count(*) AS count, round(avg(clients), 6) AS mean, round(stddev_samp(clients), 6) AS std, min(clients) AS min,
  round(quantile_cont(clients, 0.25), 6) AS q25, round(quantile_cont(clients, 0.5), 6) AS q50, round(quantile_cont(clients, 0.75), 6) AS q75,
  max(clients) AS max, CAST(sum(clients) AS BIGINT) AS total FROM f GROUP BY is_public""")
def q_r31(spark, sf_dir):
    a = R.per_api(api_usage(spark, sf_dir)).withColumn("is_public", R.is_public(F.col("api")))
    return _round(R.describe(a, "clients", ["is_public"]), ["mean", "std", "q25", "q50", "q75"], 6)


@register("U12_usable_versions", STATS_SQL + """
SELECT package, count(*) AS n_usable FROM b_stats WHERE NOT error GROUP BY package""")
def q_u12(spark, sf_dir):
    """Package versions whose extraction summary has no error (static mode)."""
    return stats(spark, sf_dir).where(~F.col("error")).groupBy("package").agg(F.count(F.lit(1)).alias("n_usable"))


DEPENDENTS_SQL = binding_cte("b_req", "b_stats") + """,
dep AS (SELECT dep AS name, count(DISTINCT c_pkg) AS dependents FROM b_req GROUP BY dep)
"""


def dependents(spark, sf_dir):
    """Dependent client packages per package (the ranking input of S2)."""
    r = binding(spark, sf_dir, "b_req")
    return r.groupBy(F.col("dep").alias("name")).agg(F.count_distinct("c_pkg").alias("dependents"))


@register("S2_rank_by_dependents", DEPENDENTS_SQL + """
SELECT name, dependents FROM (SELECT *, row_number() OVER (ORDER BY dependents DESC, name) AS r FROM dep) WHERE r <= 10000""")
def q_s2(spark, sf_dir, top: int = 10_000):
    """The ``top`` packages by number of dependents (a top-k report)."""
    return dependents(spark, sf_dir).orderBy(F.col("dependents").desc(), F.col("name")).limit(top)


@register("U8_versions_to_check", DEPENDENTS_SQL + """,
top AS (SELECT name, dependents FROM (SELECT *, row_number() OVER (ORDER BY dependents DESC, name) AS r FROM dep) WHERE r <= 10000)
SELECT s.package, s.version, t.dependents FROM b_stats s JOIN top t ON t.name = s.package WHERE s.wheel IS NOT NULL""")
def q_u8(spark, sf_dir, top: int = 10_000):
    """Versions with a wheel of the ``top`` packages, with their ranking
    figure (ordered by it when written out).  AQE broadcasts the ranking if it is small."""
    s = stats(spark, sf_dir).where(F.col("wheel").isNotNull())
    ranked = q_s2(spark, sf_dir, top)
    return s.join(ranked, s["package"] == ranked["name"]).select("package", "version", "dependents") \
        .orderBy(F.col("dependents").desc(), "package", "version")
