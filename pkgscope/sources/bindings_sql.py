"""Driver bindings: deterministic package-shaped views over the driver tables.

Fixed values: the SQL texts below are the binding definitions of the test
fixtures; Spark and DuckDB both run them unchanged.  Every operator reads
a binding (or the driver tables) so its work grows with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# --- fixed values: binding SQL (FIXTURES section 3), extended so that every rule meets rows: clients that pass
# selection, results of newest versions, client versions of results, defaults with "(" and "<", private names ---
BINDINGS: dict[str, str] = {}

BINDINGS["b_release"] = """
SELECT concat('pkg',cast(l_partkey % 50 AS STRING)) AS pkg,
 concat(cast(l_linenumber % 3 AS STRING),'.',cast(cast(l_quantity AS INT) % 12 AS STRING),'.',cast(l_suppkey % 10 AS STRING),
  CASE WHEN l_orderkey % 23 = 0 THEN 'rc1' WHEN l_orderkey % 29 = 0 THEN '.dev2' WHEN l_orderkey % 31 = 0 THEN '.post1' ELSE '' END) AS ver,
 min(l_shipdate) AS upload_time, count(*) AS n_files
FROM lineitem GROUP BY 1, 2
"""

BINDINGS["b_wheel"] = """
SELECT concat('pkg',cast(l_partkey % 50 AS STRING)) AS pkg, cast(l_orderkey AS STRING) AS ver, l_linenumber AS ord, l_suppkey AS ord2,
 concat('pkg-1.0',CASE l_suppkey % 3 WHEN 0 THEN '-py2.py3' WHEN 1 THEN '-cp39' ELSE '-cp310' END,
  CASE l_linenumber % 5 WHEN 0 THEN '-none-any.whl' WHEN 1 THEN '-cp39-manylinux.whl' WHEN 2 THEN '-cp39-win32.whl' WHEN 3 THEN '-cp39-linux_x86_64.whl' ELSE '.tar.gz' END) AS filename
FROM lineitem
"""

BINDINGS["b_req"] = """
SELECT concat('app',cast(o_custkey % 100 AS STRING)) AS c_pkg, concat('1.',cast(o_orderkey % 20 AS STRING)) AS c_ver,
 CASE WHEN o_custkey % 100 < 20 THEN o_orderdate + INTERVAL '20' YEAR ELSE o_orderdate END AS c_time,
 concat('pkg',cast(l_partkey % 50 AS STRING)) AS dep,
 CASE WHEN o_custkey % 100 < 20 THEN CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN '>=0.5,<2' ELSE '!=1.0' END
  WHEN l_suppkey % 10 = 3 THEN '==1.1.0' ELSE CASE l_linenumber % 7 WHEN 0 THEN '' WHEN 1 THEN concat('>=',cast(cast(l_quantity AS INT) % 3 AS STRING),'.0')
  WHEN 2 THEN concat('==',cast(cast(l_quantity AS INT) % 3 AS STRING),'.1.*') WHEN 3 THEN '~=1.2.1' WHEN 4 THEN '>=0.5,<2'
  WHEN 5 THEN '!=1.0' ELSE '<=1.9' END END AS spec
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
"""

BINDINGS["b_param_old"] = """
SELECT concat('pkg.f',cast(l_orderkey AS STRING)) AS func, concat('p',cast(l_partkey AS STRING)) AS param,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), l_partkey) - 1 AS pos,
 CASE WHEN min(l_returnflag) = 'N' THEN NULL WHEN l_partkey % 19 IN (3, 4) THEN concat('obj(',cast(cast(min(l_quantity) AS INT) AS STRING),')')
  WHEN l_partkey % 19 = 5 THEN concat('<obj ',cast(cast(min(l_quantity) AS INT) AS STRING),'>')
  ELSE concat(min(l_returnflag),cast(cast(min(l_quantity) AS INT) AS STRING)) END AS dflt
FROM lineitem GROUP BY l_orderkey, l_partkey
"""

BINDINGS["b_param_new"] = """
SELECT concat('pkg.f',cast(l_orderkey AS STRING)) AS func,
 concat('p',cast(l_partkey + CASE WHEN l_partkey % 13 = 0 THEN 1000000 ELSE 0 END AS STRING)) AS param,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_orderkey % 5 = 0 THEN -min(l_linenumber) ELSE min(l_linenumber) END, l_partkey) - 1 AS pos,
 CASE WHEN l_partkey % 7 = 0 THEN 'X' WHEN l_partkey % 7 = 1 OR min(l_returnflag) = 'N' THEN NULL
  WHEN l_partkey % 19 = 3 THEN concat('obj(',cast(cast(min(l_quantity) AS INT) + 1 AS STRING),')') WHEN l_partkey % 19 = 4 THEN 'other(1)'
  WHEN l_partkey % 19 = 5 THEN concat('<obj ',cast(cast(min(l_quantity) AS INT) + 1 AS STRING),'>')
  ELSE concat(min(l_returnflag),cast(cast(min(l_quantity) AS INT) AS STRING)) END AS dflt
FROM lineitem WHERE l_orderkey % 11 <> 0 GROUP BY l_orderkey, l_partkey
"""

BINDINGS["b_entity"] = """
SELECT v.r_regionkey AS ver, concat('pkg',cast(p_partkey % 10 AS STRING),'.m',cast(p_partkey % 40 AS STRING),'.e',cast(p_partkey AS STRING)) AS key,
 concat('pkg',cast(p_partkey % 10 AS STRING)) AS top_level,
 CASE (p_size + CASE WHEN p_partkey % 37 = 0 THEN v.r_regionkey ELSE 0 END) % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'variable' ELSE 'alias' END AS kind
FROM part CROSS JOIN region v WHERE (p_partkey + v.r_regionkey * 3) % 11 <> 0
"""

BINDINGS["b_alias"] = """
SELECT concat('m',cast(p_partkey AS STRING)) AS src,
 CASE WHEN p_partkey % 17 = 0 THEN concat('ext',cast(p_partkey AS STRING)) WHEN p_partkey % 101 = 0 THEN concat('m',cast(p_partkey AS STRING))
  ELSE concat('m',cast(cast(floor(p_partkey / 2) AS BIGINT) AS STRING)) END AS dst
FROM part WHERE p_partkey > 3
"""

BINDINGS["b_sig"] = """
SELECT concat('f',cast(p_partkey AS STRING)) AS func, n_nationkey AS pos, concat('p',cast(n_nationkey AS STRING)) AS param,
 (n_nationkey >= 2 AND p_partkey % 3 = 0) AS has_default, (n_nationkey = 0 AND p_partkey % 5 = 0) AS pos_only,
 (n_nationkey = p_size % 6 - 1 AND p_partkey % 4 = 0) AS vararg, (n_nationkey = p_size % 6 - 1 AND p_partkey % 4 = 1) AS kwarg
FROM part CROSS JOIN nation WHERE n_nationkey < p_size % 6
"""

BINDINGS["b_call"] = """
SELECT o_orderkey AS call_id, concat('f',cast(o_custkey % 200 AS STRING)) AS func, o_orderkey % 5 AS n_args,
 (o_orderkey % 11 = 0) AS starargs, (o_orderkey % 13 = 0) AS addl_kwargs
FROM orders
"""

BINDINGS["b_call_kw"] = """
SELECT DISTINCT o_orderkey AS call_id, concat('p',cast((o_orderkey + n_nationkey * 2) % 7 AS STRING)) AS kw
FROM orders CROSS JOIN nation WHERE n_nationkey < o_custkey % 3
"""

BINDINGS["b_usage"] = """
SELECT concat('app',cast(o_custkey % 100 AS STRING)) AS c_pkg, concat('pkg',cast(l_partkey % 50 AS STRING)) AS u_pkg,
 concat('pkg.',CASE WHEN l_partkey % 13 = 0 THEN '_' ELSE '' END,'f',cast(l_partkey AS STRING)) AS api, concat('f',cast(l_linenumber AS STRING),'.py') AS src_file,
 cast(l_quantity AS INT) AS n_lines, concat('pkg.',CASE WHEN l_partkey % 13 = 0 THEN '_' ELSE '' END,'f',cast(l_partkey AS STRING),'(',CASE WHEN l_suppkey % 2 = 0 THEN '*' ELSE '' END,')') AS chain,
 CASE WHEN l_suppkey % 9 = 0 THEN 'MISSING' WHEN l_suppkey % 9 = 1 THEN 'MISMATCH' ELSE 'MATCH' END AS status,
 concat('msg',cast(l_suppkey % 9 AS STRING),'-',cast(l_partkey % 50 AS STRING)) AS message, CASE WHEN l_orderkey % 4 = 0 THEN CASE l_linenumber % 3 WHEN 0 THEN '2.11.9' WHEN 1 THEN '1.2.9' ELSE '1.11.9' END
  ELSE concat('1.',cast(l_linenumber AS STRING)) END AS dep_ver, concat('1.',cast(o_orderkey % 20 AS STRING)) AS c_ver
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
"""

BINDINGS["b_stats"] = """
SELECT concat('pkg',cast(o_custkey % 50 AS STRING)) AS package, concat('0.',cast(o_orderkey AS STRING)) AS version,
 CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderdate END AS time,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('pkg-1.0-',CASE o_orderkey % 3 WHEN 0 THEN 'py2.py3' WHEN 1 THEN 'py3' ELSE 'py2' END,'-none-any.whl') END AS wheel,
 (o_orderkey % 15 = 0) AS error,
 CASE WHEN o_orderkey % 30 = 0 THEN 'FileNotFoundError: x' WHEN o_orderkey % 45 = 0 THEN 'FileExistsError: y' WHEN o_orderkey % 15 = 0 THEN 'IndexError' ELSE NULL END AS stack_trace,
 cast(o_orderkey % 1000 AS BIGINT) AS num_apis, cast(o_orderkey % 40 AS BIGINT) AS num_modules, cast(o_custkey % 3 AS BIGINT) AS n_failed_modules,
 cast(floor(o_totalprice) AS BIGINT) AS duration_ms
FROM orders
"""

BINDINGS["b_probe"] = """
SELECT concat('pkg',cast(l_partkey % 50 AS STRING)) AS package, concat('api',cast(l_orderkey AS STRING)) AS api, (l_suppkey % 4 <> 0) AS success,
 CASE l_suppkey % 4 WHEN 0 THEN CASE l_linenumber % 4 WHEN 0 THEN 'FAIL: module x has no attribute y' WHEN 1 THEN 'FAIL: Wrong type' WHEN 2 THEN 'FAIL: No module named z' ELSE 'FAIL: boom' END ELSE 'OK' END AS stdout,
 CASE l_suppkey % 3 WHEN 0 THEN 'Class' WHEN 1 THEN 'Function' ELSE 'Variable' END AS dynamic_type,
 CASE l_linenumber % 5 WHEN 0 THEN 'Missing' WHEN 1 THEN 'Unresolved' WHEN 2 THEN 'Variable' WHEN 3 THEN 'Class' ELSE 'Function' END AS extracted_type
FROM lineitem
"""

BINDINGS["b_source"] = """
SELECT p_partkey AS k, concat('mod',cast(p_partkey AS STRING)) AS module,
 concat('import os',chr(10),'from .lib import g as h',chr(10),'K',cast(p_partkey AS STRING),' = ',cast(p_size AS STRING),chr(10),
 'def f',cast(p_partkey AS STRING),'(a, b=',cast(p_size AS STRING),', *c, d, **e): pass',chr(10),
 'class C',cast(p_partkey AS STRING),'(B):',chr(10),'    S = 1',chr(10),'    def __init__(self, x): self.x = x',chr(10),
 'os.getenv(h(1))', CASE WHEN p_partkey % 40 = 0 THEN concat(chr(10),'def (') ELSE '' END) AS src
FROM part
"""
