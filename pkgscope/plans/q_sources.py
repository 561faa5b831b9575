"""Source / sink queries over driver data: wheel choice (V7, S16) and HTML
listings (S21, S22)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pkgscope.plans.registry import register
from pkgscope.sources import files as S
from pkgscope.sources.bindings import binding, binding_cte, table


def choose_wheel(files):
    """Per (pkg, ver) the wheel with 5 or 6 dash parts whose platform
    mentions ``any`` or ``linux`` and whose python tag is largest by *text*;
    the earliest file wins ties."""
    parts = F.split("filename", "-")
    n = F.size(parts)
    py = F.when(n == 5, F.element_at(parts, 3)).when(n == 6, F.element_at(parts, 4))
    plat = F.when(n == 5, F.element_at(parts, 5)).when(n == 6, F.element_at(parts, 6))
    ok = F.col("filename").endswith(".whl") & n.isin(5, 6) & (plat.contains("any") | plat.contains("linux"))
    w = Window.partitionBy("pkg", "ver").orderBy(F.col("_py").desc(), "ord", "ord2", "filename")
    return (
        files.withColumn("_py", py).where(ok)
        .withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
        .select("pkg", "ver", F.col("filename").alias("wheel"), F.col("_py").alias("py_tag"))
    )


@register("V7_S16_wheel_choice", binding_cte("b_wheel") + """,
t AS (SELECT *, len(string_split(filename, '-')) AS n FROM b_wheel),
c AS (SELECT pkg, ver, ord, ord2, filename,
  CASE WHEN n = 5 THEN split_part(filename, '-', 3) ELSE split_part(filename, '-', 4) END AS py,
  CASE WHEN n = 5 THEN split_part(filename, '-', 5) ELSE split_part(filename, '-', 6) END AS plat
  FROM t WHERE n IN (5, 6) AND filename LIKE '%.whl')
SELECT pkg, ver, wheel, py_tag FROM (
  SELECT pkg, ver, filename AS wheel, py AS py_tag,
    row_number() OVER (PARTITION BY pkg, ver ORDER BY py DESC, ord, ord2, filename) AS r
  FROM c WHERE strpos(plat, 'any') > 0 OR strpos(plat, 'linux') > 0) WHERE r = 1""")
def q_v7(spark, sf_dir):
    return choose_wheel(binding(spark, sf_dir, "b_wheel"))


@register("S21_version_links", """
SELECT p_partkey AS page_id, p_size || '.' || (p_partkey % 7) || '.' || i AS ver FROM part, range(0, 3) r(i) WHERE i <= p_size % 3""")
def q_s21(spark, sf_dir):
    """Links of listing pages, one page per part; parent, file and two-part links are no versions."""
    link = lambda i: F.when(F.col("p_size") % 3 >= i, F.concat(F.lit('<a href="'), "p_size", F.lit("."), F.col("p_partkey") % 7, F.lit(f'.{i}/">v</a>\n')))
    page = F.concat_ws("", F.lit('<html><a href="../">up</a><a href="1.0/">x</a><a href="1.2.3.whl">w</a>'), *[link(i) for i in range(3)], F.lit("</html>"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), page.alias("html"))
    return p.select("page_id", F.explode(S.version_links(F.col("html"))).alias("ver"))


@register("S22_module_index", """
SELECT page_id, href, name FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '<a\\s+href="([^"]*)"[^>]*>\\s*(?:<code[^>]*>)?([^<]*)', 1)) AS href,
         unnest(regexp_extract_all(html, '<a\\s+href="([^"]*)"[^>]*>\\s*(?:<code[^>]*>)?([^<]*)', 2)) AS name FROM pages)
WHERE starts_with(href, '/') AND strpos(name, '.') = 0""")
def q_s22(spark, sf_dir):
    return S.module_index(table(spark, sf_dir, "pages"), "/")
