"""Queries for versions, specifiers and client selection."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pkgscope.functions import versions as V
from pkgscope.operators import clients as C
from pkgscope.plans.registry import register
from pkgscope.sources.bindings import binding, binding_cte


# ------------------------------------------------------------------ inputs

def release_files(spark, sf_dir):
    """Releases flattened to one row per file (file i of a version is
    uploaded i-1 days after the first)."""
    r = binding(spark, sf_dir, "b_release")
    return (
        r.select("pkg", "ver", "upload_time", F.explode(F.sequence(F.lit(1), F.col("n_files").cast("int"))).alias("file_no"))
        .select("pkg", "ver", "file_no",
                F.concat_ws("-", "pkg", "ver", F.col("file_no").cast("string")).alias("filename"),
                (F.col("upload_time") + F.make_interval(days=F.col("file_no") - 1)).alias("upload_time"))
    )


def requirements(spark, sf_dir):
    """Client requirement rows and client release times from b_req."""
    r = binding(spark, sf_dir, "b_req")
    reqs = r.select("c_pkg", "c_ver", "dep", "spec")
    times = r.groupBy("c_pkg", "c_ver").agg(F.min("c_time").alias("c_time"))
    return reqs, times


# DuckDB side: the same inputs and a version key valid for the binding's
# version shapes (three release numbers, optional rcN / .devN / .postN).
FILES_SQL = binding_cte("b_release", "b_req") + """,
files AS (
  SELECT pkg, ver, file_no, pkg || '-' || ver || '-' || CAST(file_no AS VARCHAR) AS filename,
         upload_time + to_days(CAST(file_no - 1 AS INTEGER)) AS upload_time
  FROM (SELECT pkg, ver, upload_time, unnest(range(1, CAST(n_files AS BIGINT) + 1)) AS file_no FROM b_release)),
rel AS (SELECT pkg, ver, min(upload_time) AS time FROM files GROUP BY pkg, ver),
vk AS (
  SELECT pkg, ver, time,
    CAST(split_part(ver, '.', 1) AS INTEGER) AS r1, CAST(split_part(ver, '.', 2) AS INTEGER) AS r2,
    CAST(regexp_extract(split_part(ver, '.', 3), '^[0-9]+') AS INTEGER) AS r3,
    regexp_matches(ver, '(rc|a|b|c)[0-9]*$') AS is_pre, ver LIKE '%.dev%' AS is_dev, ver LIKE '%.post%' AS is_post
  FROM rel),
vk2 AS (
  SELECT *, printf('%05d%05d%05d%d%05d%05d', r1, r2, r3,
      CASE WHEN is_pre THEN 3 WHEN is_dev THEN 0 ELSE 9 END,
      CASE WHEN is_post THEN 2 ELSE 0 END, CASE WHEN is_dev THEN 2 ELSE 99999 END) AS k
  FROM vk),
sp AS (SELECT DISTINCT dep, spec FROM b_req),
cl AS (
  SELECT dep, spec, c, regexp_extract(c, '^(===|~=|==|!=|<=|>=|<|>)', 1) AS op,
         trim(regexp_replace(c, '^(===|~=|==|!=|<=|>=|<|>)', '')) AS v
  FROM (SELECT dep, spec, trim(unnest(string_split(spec, ','))) AS c FROM sp) WHERE c <> ''),
cl2 AS (
  SELECT *, v LIKE '%.*' AS star, replace(v, '.*', '') AS base,
    len(string_split(replace(v, '.*', ''), '.')) AS nseg,
    coalesce(TRY_CAST(nullif(split_part(replace(v, '.*', ''), '.', 1), '') AS INTEGER), 0) AS s1,
    coalesce(TRY_CAST(nullif(split_part(replace(v, '.*', ''), '.', 2), '') AS INTEGER), 0) AS s2,
    coalesce(TRY_CAST(nullif(split_part(replace(v, '.*', ''), '.', 3), '') AS INTEGER), 0) AS s3
  FROM cl),
cl3 AS (SELECT *, printf('%05d%05d%05d%d%05d%05d', s1, s2, s3, 9, 0, 99999) AS sk FROM cl2),
ev AS (
  SELECT cl3.dep, cl3.spec, vk2.ver, CASE op
    WHEN '==' THEN CASE WHEN star THEN r1 = s1 AND (nseg < 2 OR r2 = s2) AND (nseg < 3 OR r3 = s3) ELSE k = sk END
    WHEN '!=' THEN NOT (CASE WHEN star THEN r1 = s1 AND (nseg < 2 OR r2 = s2) AND (nseg < 3 OR r3 = s3) ELSE k = sk END)
    WHEN '>=' THEN k >= sk
    WHEN '<=' THEN k <= sk
    WHEN '<' THEN k < sk AND NOT ((is_pre OR is_dev) AND r1 = s1 AND r2 = s2 AND r3 = s3)
    WHEN '>' THEN k > sk AND NOT (is_post AND r1 = s1 AND r2 = s2 AND r3 = s3)
    WHEN '~=' THEN k >= sk AND r1 = s1 AND (nseg < 3 OR r2 = s2)
    ELSE false END AS ok
  FROM cl3 JOIN vk2 ON vk2.pkg = cl3.dep),
m AS (
  SELECT dep, spec, ver FROM ev GROUP BY dep, spec, ver HAVING bool_and(ok)
  UNION ALL
  SELECT sp.dep, sp.spec, vk2.ver FROM sp JOIN vk2 ON vk2.pkg = sp.dep WHERE trim(sp.spec) = '')
"""


@register("S4_release_files", FILES_SQL + "SELECT pkg, ver, file_no, filename, upload_time FROM files")
def q_release_files(spark, sf_dir):
    return release_files(spark, sf_dir)


@register("V1_valid_version", FILES_SQL + "SELECT DISTINCT ver, NOT (is_pre OR is_dev) AS is_valid FROM vk")
def q_valid(spark, sf_dir):
    return release_files(spark, sf_dir).select("ver").distinct().select("ver", V.is_valid_version("ver").alias("is_valid"))


@register("V2_version_order", FILES_SQL + """
SELECT pkg, ver, row_number() OVER (PARTITION BY pkg ORDER BY k, ver) AS ver_rank FROM vk2""")
def q_order(spark, sf_dir):
    v = C.release_versions(release_files(spark, sf_dir))
    w = Window.partitionBy("pkg").orderBy("vkey", "ver")
    return v.select("pkg", "ver", F.row_number().over(w).alias("ver_rank"))


@register("V3_release_time", FILES_SQL + "SELECT pkg, ver, time AS release_time FROM rel")
def q_release_time(spark, sf_dir):
    return C.release_versions(release_files(spark, sf_dir)).select("pkg", "ver", F.col("time").alias("release_time"))


@register("V4_versions_by_date", FILES_SQL + """
SELECT pkg, ver, row_number() OVER (PARTITION BY pkg ORDER BY time, k) AS date_rank FROM vk2""")
def q_by_date(spark, sf_dir):
    v = C.release_versions(release_files(spark, sf_dir))
    w = Window.partitionBy("pkg").orderBy("time", "vkey")
    return v.select("pkg", "ver", F.row_number().over(w).alias("date_rank"))


@register("V8_spec_match", FILES_SQL + "SELECT dep, spec, ver FROM m")
def q_spec_match(spark, sf_dir):
    reqs, _ = requirements(spark, sf_dir)
    rel = C.release_versions(release_files(spark, sf_dir))
    return V.matching_versions(reqs, rel)


V9_SQL = binding_cte("b_req") + """,
sp AS (SELECT DISTINCT spec FROM b_req),
cl AS (SELECT spec, list_filter(list_transform(string_split(spec, ','), lambda x: trim(x)), lambda x: x <> '') AS cls FROM sp),
c2 AS (SELECT spec, cls, len(cls) AS n,
  regexp_extract(cls[1], '^(===|~=|==|!=|<=|>=|<|>)', 1) AS op1,
  trim(regexp_replace(cls[1], '^(===|~=|==|!=|<=|>=|<|>)', '')) AS v1,
  list_transform(cls, lambda x: regexp_extract(x, '^(===|~=|==|!=|<=|>=|<|>)', 1)) AS ops FROM cl),
v9 AS (SELECT spec, CASE WHEN n = 0 THEN 'any'
  WHEN n = 1 THEN CASE
    WHEN op1 IN ('>=', '>') THEN 'at-least' WHEN op1 IN ('<=', '<') THEN 'at-most'
    WHEN op1 = '==' AND regexp_matches(v1, '^[0-9]+\\.[0-9]+\\.\\*') THEN 'var-micro'
    WHEN op1 = '==' AND regexp_matches(v1, '^[0-9]+\\.\\*') THEN 'var-minor'
    WHEN op1 = '==' AND v1 = '*' THEN 'any' WHEN op1 = '==' THEN 'fixed'
    WHEN op1 = '~=' AND regexp_matches(v1, '^[0-9]+\\.[0-9]+\\.[0-9]+') THEN 'var-micro'
    WHEN op1 = '~=' AND regexp_matches(v1, '^[0-9]+\\.[0-9]+') THEN 'var-minor'
    ELSE 'other' END
  WHEN n = 2 THEN CASE WHEN (list_contains(ops, '>') OR list_contains(ops, '>=')) AND (list_contains(ops, '<') OR list_contains(ops, '<='))
    THEN 'range' ELSE 'other' END
  ELSE 'other' END AS spec_type FROM c2)
"""


@register("V9_spec_type", V9_SQL + "SELECT spec, spec_type FROM v9")
def q_spec_type(spark, sf_dir):
    reqs, _ = requirements(spark, sf_dir)
    return reqs.select("spec").distinct().select("spec", V.spec_type(F.col("spec")).alias("spec_type"))


PAIRS_SQL = FILES_SQL + """,
pairs AS (SELECT pkg, v1, v2, r1a, r2a, r3a, r1, r2, r3 FROM (
  SELECT pkg, ver AS v1, lead(ver) OVER w AS v2, r1 AS r1a, r2 AS r2a, r3 AS r3a,
         lead(r1) OVER w AS r1, lead(r2) OVER w AS r2, lead(r3) OVER w AS r3
  FROM vk2 WINDOW w AS (PARTITION BY pkg ORDER BY k, ver)) WHERE v2 IS NOT NULL)
"""


@register("V10_adjacent_pairs", PAIRS_SQL + "SELECT pkg, v1, v2 FROM pairs")
def q_pairs(spark, sf_dir):
    return V.adjacent_pairs(C.release_versions(release_files(spark, sf_dir)))


@register("V11_bump_kind", PAIRS_SQL + """
SELECT pkg, v1, v2, CASE WHEN r1a <> r1 THEN 'major' WHEN r2a <> r2 THEN 'minor' ELSE 'patch' END AS bump
FROM pairs""")
def q_bump(spark, sf_dir):
    p = V.adjacent_pairs(C.release_versions(release_files(spark, sf_dir)))
    return p.withColumn("bump", V.bump_kind("v1", "v2"))


# ------------------------------------------------------------------ clients

CLIENTS_SQL = FILES_SQL + """,
cr AS (SELECT DISTINCT c_pkg, c_ver, dep AS u_pkg, spec AS u_spec FROM b_req WHERE dep IN (SELECT pkg FROM rel)),
ct AS (SELECT c_pkg, c_ver, min(c_time) AS c_time FROM b_req GROUP BY c_pkg, c_ver),
j AS (
  SELECT cr.c_pkg, cr.c_ver, ct.c_time, cr.u_pkg, cr.u_spec, m.ver, vk2.time, vk2.k
  FROM cr JOIN ct ON cr.c_pkg = ct.c_pkg AND cr.c_ver = ct.c_ver
  LEFT JOIN m ON m.dep = cr.u_pkg AND m.spec = cr.u_spec
  LEFT JOIN vk2 ON vk2.pkg = m.dep AND vk2.ver = m.ver),
agg AS (
  SELECT c_pkg, c_ver, c_time, u_pkg, u_spec,
    arg_max(ver, k) FILTER (WHERE time < c_time) AS u_ver_published,
    arg_max(ver, k) AS u_ver_current,
    coalesce(string_agg(ver, ',' ORDER BY time, k), '') AS u_vers
  FROM j GROUP BY c_pkg, c_ver, c_time, u_pkg, u_spec),
clients AS (
  SELECT c_pkg, c_ver, u_pkg, u_spec, u_ver_published, u_ver_current, u_vers FROM agg
  WHERE c_pkg NOT IN (SELECT c_pkg FROM agg WHERE u_ver_published IS NULL OR u_ver_current IS NULL)),
ckey AS (SELECT DISTINCT c_ver, CAST(split_part(c_ver, '.', 1) AS INTEGER) AS c1, CAST(split_part(c_ver, '.', 2) AS INTEGER) AS c2 FROM clients),
newest AS (
  SELECT u_pkg, u_spec, c_pkg, c_ver FROM (
    SELECT clients.*, row_number() OVER (PARTITION BY u_pkg, u_spec, c_pkg ORDER BY c1 DESC, c2 DESC) AS r
    FROM clients JOIN ckey USING (c_ver)) WHERE r = 1),
firstrow AS (
  SELECT u_pkg, c_pkg, c_ver, u_ver_current, u_vers FROM (
    SELECT *, row_number() OVER (PARTITION BY u_pkg, c_pkg, c_ver ORDER BY u_spec) AS r FROM clients) WHERE r = 1),
sampled AS (
  SELECT n.u_pkg, n.u_spec, n.c_pkg, n.c_ver, f.u_ver_current, f.u_vers
  FROM newest n LEFT JOIN firstrow f ON n.u_pkg = f.u_pkg AND n.c_pkg = f.c_pkg AND n.c_ver = f.c_ver)
"""


def clients_table(spark, sf_dir, drop_failing=True):
    reqs, times = requirements(spark, sf_dir)
    files = release_files(spark, sf_dir)
    upstreams = files.select("pkg").distinct()
    return C.find_clients(reqs, times, files, upstreams, drop_failing).drop("c_time")


@register("C2_satisfying_versions", CLIENTS_SQL + "SELECT c_pkg, c_ver, u_pkg, u_spec, u_vers FROM agg")
def q_c2(spark, sf_dir):
    return clients_table(spark, sf_dir, False).select("c_pkg", "c_ver", "u_pkg", "u_spec", "u_vers")


@register("C3_published_version", CLIENTS_SQL + "SELECT c_pkg, c_ver, u_pkg, u_spec, u_ver_published FROM agg")
def q_c3(spark, sf_dir):
    return clients_table(spark, sf_dir, False).select("c_pkg", "c_ver", "u_pkg", "u_spec", "u_ver_published")


@register("C4_current_version", CLIENTS_SQL + "SELECT c_pkg, c_ver, u_pkg, u_spec, u_ver_current FROM agg")
def q_c4(spark, sf_dir):
    return clients_table(spark, sf_dir, False).select("c_pkg", "c_ver", "u_pkg", "u_spec", "u_ver_current")


@register("C1_client_requirements", CLIENTS_SQL + "SELECT c_pkg, c_ver, u_pkg, u_spec FROM cr")
def q_c1(spark, sf_dir):
    reqs, _ = requirements(spark, sf_dir)
    return C.client_requirements(reqs, release_files(spark, sf_dir).select("pkg").distinct())


@register("C6_client_table", CLIENTS_SQL + "SELECT * FROM clients")
def q_clients(spark, sf_dir):
    return clients_table(spark, sf_dir)


@register("C7_sampled_clients", CLIENTS_SQL + "SELECT * FROM sampled")
def q_sampled(spark, sf_dir):
    return C.sample_clients(clients_table(spark, sf_dir))


@register("C8_latest_work", CLIENTS_SQL + """,
lk AS (SELECT DISTINCT u_ver_current AS u_ver,
  printf('%05d%05d%05d%d%05d%05d', CAST(split_part(u_ver_current, '.', 1) AS INTEGER), CAST(split_part(u_ver_current, '.', 2) AS INTEGER),
    CAST(regexp_extract(split_part(u_ver_current, '.', 3), '^[0-9]+') AS INTEGER),
    CASE WHEN regexp_matches(u_ver_current, '(rc|a|b|c)[0-9]*$') THEN 3 WHEN u_ver_current LIKE '%.dev%' THEN 0 ELSE 9 END,
    CASE WHEN u_ver_current LIKE '%.post%' THEN 2 ELSE 0 END, CASE WHEN u_ver_current LIKE '%.dev%' THEN 2 ELSE 99999 END) AS k
  FROM sampled),
latest AS (SELECT u_pkg, arg_max(u_ver_current, lk.k) AS latest FROM sampled JOIN lk ON lk.u_ver = sampled.u_ver_current GROUP BY u_pkg)
SELECT s.u_pkg, s.u_ver_current AS u_ver, s.c_pkg, s.c_ver FROM sampled s JOIN latest l ON s.u_pkg = l.u_pkg
WHERE s.u_ver_current = l.latest""")
def q_latest(spark, sf_dir):
    return C.latest_work(C.sample_clients(clients_table(spark, sf_dir)))


@register("C9_all_work", CLIENTS_SQL + """
SELECT u_pkg, unnest(string_split(u_vers, ',')) AS u_ver, c_pkg, c_ver FROM sampled""")
def q_all_work(spark, sf_dir):
    return C.all_work(C.sample_clients(clients_table(spark, sf_dir)))


# ------------------------------------------------------------------ resolution

@register("V13_dependency_resolution", FILES_SQL + """,
rq AS (SELECT DISTINCT c_pkg, c_ver, dep, spec FROM b_req WHERE dep IN (SELECT pkg FROM rel)),
best AS (SELECT m.dep, m.spec, arg_max(m.ver, (vk2.time, vk2.k)) AS dep_ver FROM m JOIN vk2 ON vk2.pkg = m.dep AND vk2.ver = m.ver
         GROUP BY m.dep, m.spec),
cand AS (SELECT rq.c_pkg, rq.c_ver, rq.dep, rq.spec, best.dep_ver FROM rq JOIN best ON best.dep = rq.dep AND best.spec = rq.spec)
SELECT c_pkg AS root_pkg, c_ver AS root_ver, dep, dep_ver, 1 AS level FROM (
  SELECT *, row_number() OVER (PARTITION BY c_pkg, c_ver, dep ORDER BY spec) AS r FROM cand) WHERE r = 1""")
def q_v13(spark, sf_dir):
    """Clients of b_req resolved against b_release; declaration order = spec text order."""
    from pkgscope.operators import deps as DP

    reqs, _ = requirements(spark, sf_dir)
    reqs = reqs.distinct().withColumnRenamed("c_pkg", "pkg").withColumnRenamed("c_ver", "ver")
    reqs = reqs.withColumn("ord", F.dense_rank().over(Window.partitionBy("pkg", "ver").orderBy("dep", "spec")))
    files = release_files(spark, sf_dir)
    rel = C.release_versions(files).select("pkg", "ver", "time")
    roots = reqs.select("pkg", "ver").distinct()
    return DP.resolve(roots, reqs, rel, files.select("pkg").distinct())
