"""Name resolution (K8) against a plain depth-first model on random alias
graphs with cycles, on a 30-level diamond and across catalogues."""

import time

import numpy as np
import pytest

from pkgscope.operators import catalog as K

BY = ["pkg", "ver"]
OBJECTS = "pkg string, ver string, key string, kind string, full_alias string, targets array<string>"


class Missing(Exception):
    pass


def plain_get(objects, key, runtime, seen=()):
    """What a key names: the way so far is passed on, a candidate met before ends its node."""
    cat = runtime.get(key.split(".")[0])
    if cat is None:
        raise Missing
    here = objects.get((cat, key))
    if here is None:
        parent, _, leaf = key.rpartition(".")
        wild = objects.get((cat, parent + ".*"))
        if wild is None:
            raise Missing
        candidates = [t.replace("*", leaf) for t in wild[2]]
    elif here[0] == "alias":
        candidates = [here[1]]
    else:
        return key, here[0]
    for c in candidates:
        if c in seen:
            raise Missing
        if c.split(".")[0] in runtime:
            try:
                return plain_get(objects, c, runtime, (*seen, c))
            except Missing:
                continue
    raise Missing


def compare(spark, objects, keys, runtime=None, tops=("p",)):
    """objects: {(catalogue, key): (kind, full_alias, targets)}; a catalogue is (pkg, ver)."""
    df = spark.createDataFrame([(*cat, key, *v) for (cat, key), v in objects.items()], OBJECTS)
    own = {t: ("p", "1") for t in tops}
    maps = own if runtime is None else runtime
    table = spark.createDataFrame([("p", "1", t, *c) for t, c in maps.items()], "pkg string, ver string, top_level string, _cat_pkg string, _cat_ver string")
    got = K.follow(spark.createDataFrame([("p", "1", k) for k in keys], "pkg string, ver string, key string"), df, BY,
                   None if runtime is None else lambda needs: needs.join(table, [*BY, "top_level"]))
    have = {r["key"]: (r["result_key"], r["result_kind"]) for r in got.collect()}
    want = {}
    for k in keys:
        try:
            want[k] = plain_get(objects, k, maps)
        except Missing:
            pass
    assert have == want
    return have


def random_objects(rng, cats, tops, modules=6, names=4):
    objects = {}
    every = [f"{t}.m{m}" for t in tops for m in range(modules)]
    for module in every:
        cat = cats[module.split(".")[0]]
        objects[cat, module] = ("module", None, None)
        for n in range(names):
            roll = rng.random()
            if roll < 0.2:
                objects[cat, f"{module}.n{n}"] = (str(rng.choice(["function", "class"])), None, None)
            elif roll < 0.55:
                objects[cat, f"{module}.n{n}"] = ("alias", f"{rng.choice(every)}.n{rng.integers(names + 1)}", None)
        if rng.random() < 0.5:
            objects[cat, module + ".*"] = ("wildcard", None, [f"{m}.*" for m in rng.choice(every, rng.integers(1, 4), replace=False)])
    return objects, [f"{m}.n{n}" for m in every for n in range(names + 1)]


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs_with_cycles(spark, seed):
    rng = np.random.default_rng(seed)
    objects, keys = random_objects(rng, {"p": ("p", "1")}, ["p"])
    assert compare(spark, objects, keys)


@pytest.mark.parametrize("seed", [10, 11])
def test_random_graphs_over_three_catalogues(spark, seed):
    rng = np.random.default_rng(seed)
    cats = {"p": ("p", "1"), "q": ("q", "7"), "std": ("std", "3")}
    objects, keys = random_objects(rng, cats, list(cats), modules=4)
    found = compare(spark, objects, keys, cats)
    assert any(k.split(".")[0] != r.split(".")[0] for k, (r, _) in found.items())
    del cats["std"]  # not served: names that lead there are not found
    compare(spark, objects, [k for k in keys if not k.startswith("std")], cats)


def test_a_deep_diamond_is_linear(spark):
    cat = ("p", "1")
    objects = {(cat, "p"): ("module", None, None)}
    for level in range(30):
        for side in "ab":
            objects[cat, f"p.{side}{level}"] = ("module", None, None)
            objects[cat, f"p.{side}{level}.*"] = ("wildcard", None, [f"p.a{level + 1}.*", f"p.b{level + 1}.*"])
    objects[cat, "p.a30"] = objects[cat, "p.b30"] = ("module", None, None)
    objects[cat, "p.b30.known"] = ("function", None, None)
    df = spark.createDataFrame([(*c, key, *v) for (c, key), v in objects.items()], OBJECTS)
    began = time.time()
    got = K.follow(spark.createDataFrame([("p", "1", "p.a0.known"), ("p", "1", "p.a0.unknown")], "pkg string, ver string, key string"), df, BY).collect()
    assert [tuple(r) for r in got] == [("p", "1", "p.a0.known", "p.b30.known", "function")]
    assert time.time() - began < 300


def test_prefixes_and_quantiles_of_reports(spark):
    from pkgscope.operators import reports as R

    apis = spark.createDataFrame([("p", "p.a.f"), ("p", "p.ab.f"), ("p", "p.in.g"), ("q", "p.in.g")], "u_pkg string, api string")
    hidden = spark.createDataFrame([("p", "p.in"), ("p", "p.a")], "u_pkg string, prefix string")
    assert {tuple(r) for r in R.outside(apis, hidden).collect()} == {("p", "p.ab.f"), ("q", "p.in.g")}
    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in rng.integers(0, 5, 301)] + [("b", float(x)) for x in rng.normal(size=40)] + [("c", 1.5), ("b", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r["g"]: r["q"] for r in R.exact_quantiles(df, ["g"], "x", probs).collect()}
    for g in "abc":
        assert np.allclose(got[g], np.quantile([x for k, x in rows if k == g and x is not None], probs))
    assert np.allclose(R.exact_quantiles(df, [], "x", probs).first()["q"], np.quantile([x for _, x in rows if x is not None], probs))
    assert [r["q"] for r in R.exact_quantiles(df.limit(0), [], "x", probs).collect()] == [[None] * 5] and R.exact_quantiles(df.limit(0), ["g"], "x", probs).count() == 0


def test_overlaps_count_each_name_once(spark):
    from pkgscope.operators import reports as R

    sets = spark.createDataFrame([("x", "one"), ("x", "one"), ("x", "two"), ("y", "two"), ("z", "two")], "api string, source string")
    assert {tuple(r) for r in R.public_overlap(sets, ["one", "two"]).collect()} == {(True, True, 1), (False, True, 2)}
