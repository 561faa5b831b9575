"""Tables that several steps of one query read are made once, and no step gathers them in one stage."""

import contextlib
import io

from pyspark.sql import functions as F

from pkgscope.operators import catalog as K
from pkgscope.operators import chainmatch as CM
from pkgscope.operators import chains as A
from pkgscope.operators import parse as P
from pkgscope.operators import reports as R

BY = ["pkg", "ver"]
FILES = [("p.__init__", "from .lib import f as g\n"), ("p.lib", "V = 1\ndef f(x): pass\nclass C:\n    def m(self): pass\n")]


def _rows(spark):
    src = spark.createDataFrame(FILES, "module string, src string").select(F.lit("p").alias("pkg"), F.lit("1.0").alias("ver"), "module", "src")
    return P.parse_sources(src)


def _counted(spark, df):
    """``df`` (with a key) and an accumulator of the rows made of it."""
    made = spark.sparkContext.accumulator(0)
    rows = df.localCheckpoint()

    def passed(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return rows.mapInArrow(passed, rows.schema), made, rows.count()


def test_names_are_numbered_once_and_listed_below_the_package_too(spark):
    ent = K.build_entities(_rows(spark).localCheckpoint())
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        ent.explain()
    assert out.getvalue().count("Window [row_number()") == 1
    got = {(r.module, r.name, r.key, r.kind) for r in ent.collect()}
    assert got == {("p.__init__", "g", "p.__init__.g", "alias"), ("p", "g", "p.g", "alias"), ("p.lib", "V", "p.lib.V", "variable"),
                   ("p.lib", "f", "p.lib.f", "function"), ("p.lib", "C", "p.lib.C", "class")}


def test_entities_are_made_once_for_types(spark):
    rows = _rows(spark).localCheckpoint()
    ent = K.build_entities(rows)
    objects = CM.one_per_key(CM.catalogue_tables(rows, ent)[0], BY).localCheckpoint()
    counted, made, n = _counted(spark, ent.select(*BY, "key", "kind", "module"))
    names = spark.createDataFrame([("p", "1.0", k) for k in ("p.g", "p.lib.V", "p.none")], "pkg string, ver string, key string")
    got = {r.key: r.extracted_type for r in R.extracted_types(names, counted, objects, BY).collect()}
    assert got == {"p.g": "Function", "p.lib.V": "Variable", "p.none": "Missing"}
    assert made.value == n


def test_entities_are_made_once_for_public_names(spark):
    rows = _rows(spark).localCheckpoint()
    counted, made, n = _counted(spark, K.build_entities(rows).select(*BY, "key", "kind", "full_alias", "targets"))
    got = {r.name for r in K.public_names(counted, K.build_members(rows)).collect()}
    assert got == {"p.__init__.g", "p.g", "p.lib.V", "p.lib.f", "p.lib.C", "p.lib.C.m"}
    assert made.value == n


def test_objects_are_made_once_for_chains_and_queries(spark):
    rows = _rows(spark).localCheckpoint()
    objects, funcs, methods = CM.catalogue_tables(rows, K.build_entities(rows))
    counted, made, n = _counted(spark, objects)
    chains = spark.createDataFrame([("p", "1.0", "p.g()"), ("p", "1.0", "p.lib.V")], "pkg string, ver string, chain string")
    chains = chains.withColumn("chain_id", F.col("chain")).withColumn("items", A.chain_items(F.col("chain")))
    got = {r.chain: r.status for r in CM.match_chains(chains, counted, funcs, methods, BY).collect()}
    assert got == {"p.g()": "MISMATCH", "p.lib.V": "MATCH"}
    assert made.value == n
    counted, made, n = _counted(spark, CM.one_per_key(objects, BY))
    asked = spark.createDataFrame([("p", "1.0", "p.g"), ("p", "1.0", "p.lib.C.m")], "pkg string, ver string, key string")
    got = {r.key: r.result_key for r in K.query_keys(asked, counted, K.build_members(rows), BY).collect()}
    assert got == {"p.g": "p.lib.f", "p.lib.C.m": "p.lib.C.m"}
    assert made.value == n
