"""Lattice near-dedup, hard negatives and the Merkle manifest against brute force; edge cases."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pkgscope.llm import lattice, negatives, queries, topk
from tests.conftest import SF

VECTORS = "vec_id bigint, embedding array<float>, label int"


# --- lattice

def test_decode_gives_the_nearest_lattice_point():
    x = np.random.default_rng(1).normal(size=(500, 8)) * 3
    got = lattice.decode(x)
    twice = np.rint(2 * got)
    assert np.allclose(2 * got, twice) and ((twice % 2 == twice[:, :1] % 2).all(axis=1)).all() and (got.sum(axis=1) % 2 == 0).all()
    far = ((x - got) ** 2).sum(axis=1)
    assert (far <= 1 + 1e-9).all()  # covering radius
    for root in lattice.ROOTS:
        assert (far <= ((x - got - root) ** 2).sum(axis=1) + 1e-9).all()
    assert len({tuple(r) for r in lattice.ROOTS}) == 240 and np.allclose((lattice.ROOTS ** 2).sum(axis=1), 2)


def near(x, cosine, rng):
    x = x / np.linalg.norm(x)
    z = rng.normal(size=len(x))
    z -= z @ x * x
    return cosine * x + math.sqrt(1 - cosine * cosine) * z / np.linalg.norm(z)


def plain_links(vectors, least=0.95):
    """Degrees and smallest linked position, by all pairs; vectors of None link with nothing."""
    n = len(vectors)
    root, degree = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if a is None or b is None or len(a) != len(b):
                continue
            a, b = np.float32(a).astype(float), np.float32(b).astype(float)
            if a @ b >= least * np.linalg.norm(a) * np.linalg.norm(b):
                degree[i] += 1
                degree[j] += 1
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return degree, [find(i) for i in range(n)]


def test_recall_of_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        x = rng.normal(size=64)
        rows += [(2 * i, x.tolist(), 0), (2 * i + 1, near(x, 0.9501 + 0.02 * rng.random(), rng).tolist(), 0)]
    got = {r["id"]: r for r in lattice.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    degree, root = plain_links([r[1] for r in rows])
    assert sum(degree) >= 800
    assert all(got[i]["n_links"] <= degree[i] for i in got) and sum(r["n_links"] for r in got.values()) >= 0.95 * sum(degree)
    assert all(got[i]["component"] in (root[i], i) for i in got)


@pytest.mark.parametrize("chunk", [4, 512])  # 4: cells, balls and copies in many chunks
def test_dense_groups_copies_and_chains(spark, chunk):
    rng = np.random.default_rng(3)
    vectors = []
    hub = rng.normal(size=32)
    vectors += [near(hub, 0.995, rng) * rng.uniform(0.1, 9) for _ in range(60)]  # one dense group, lengths differ
    wide = rng.normal(size=32)
    vectors += [near(wide, 0.975, rng) for _ in range(40)]  # some of its pairs link
    vectors += [hub.tolist()] * 7 + [rng.normal(size=32).tolist()] * 30  # copies
    x = rng.normal(size=32)
    for _ in range(12):  # a chain
        x = near(x, 0.97, rng)
        vectors.append(x)
    vectors += [rng.normal(size=32) for _ in range(60)]
    order = rng.permutation(len(vectors))
    rows = [(i, np.float32(vectors[j]).tolist(), 1) for i, j in enumerate(order)]
    got = {r["id"]: (r["n_links"], r["component"]) for r in lattice.near_duplicates(spark.createDataFrame(rows, VECTORS), chunk=chunk).collect()}
    degree, root = plain_links([r[1] for r in rows])
    assert sum(degree) > 4000 and sum(n for n, _ in got.values()) >= 0.98 * sum(degree)
    assert all(got[i][0] <= degree[i] for i in got)
    if sum(n for n, _ in got.values()) == sum(degree):
        assert {i: c for i, (_, c) in got.items()} == dict(enumerate(root))


def test_lattice_edge_cases(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [(1, v, 0), (2, v, None), (2, w, 1), (None, v, 0), (None, None, 0), (5, None, 0), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, None, 2.0], 0),
            (8, [float("nan")] * 3, 0), (9, [float("inf"), 1.0, 1.0], 0), (10, [], 0), (11, [1.0, 2.0], 0), (12, [2.0, 4.0], 0), (13, [1e30, 2e30, 3e30], 0), (14, [5.0], 0), (15, [-5.0], 0)]
    df = spark.createDataFrame(rows, VECTORS)
    df = df.selectExpr("*", *[f"'{n}' AS `{n}`" for n in ("id", "v", "n", "uid", "cell", "key", "links", "to", "pivot", "root", "component")])
    got = sorted(map(tuple, lattice.near_duplicates(df).collect()), key=str)
    alone = [(i, 0, i) for i in (5, 6, 7, 8, 9, 10, 14, 15)] + [(None, 0, None), (2, 0, 2)]
    want = alone + [(1, 3, 1), (2, 3, 1), (None, 3, 1), (13, 3, 1), (11, 1, 11), (12, 1, 11)]
    assert got == sorted(want, key=str)
    assert lattice.near_duplicates(df.limit(0)).collect() == []


# --- hard negatives

def plain_negatives(rows, is_anchor, positives=5, count=3, low=50, high=95):
    """rows: (id, label, vector or None), one per id."""
    used = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v in rows if i is not None and label is not None and v]
    out = set()
    for a, la, va in used:
        if not is_anchor(a):
            continue
        score = [(-sum(p * q for p, q in zip(va, v)), i, label) for i, label, v in used if i != a and len(v) == len(va)]
        for s, p in sorted((s, i) for s, i, label in score if label == la)[:positives]:
            fits = sorted((t, i) for t, i, label in score if label != la and low * -s <= 100 * -t <= high * -s)[:count]
            out |= {(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(fits)}
    return out


@pytest.mark.parametrize("block_rows, blocks_per_pass", [(1024, 8), (4, 2)])
def test_hard_negatives_equal_brute_force(spark, block_rows, blocks_per_pass):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(int(i), int(rng.integers(0, 4)), np.round(centres[rng.integers(0, 6)] + 0.4 * rng.normal(size=8), 1).tolist()) for i in rng.permutation(300)]  # rounded: ties
    df = spark.createDataFrame([(i, v, label) for i, label, v in rows], VECTORS)
    got = negatives.hard_negatives(df, F.col("vec_id") % 9 == 0, block_rows=block_rows, blocks_per_pass=blocks_per_pass).collect()
    want = plain_negatives(rows, lambda i: i % 9 == 0)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 200


def test_bounds_along_the_tree_hold_and_spare_scores(monkeypatch):
    rng = np.random.default_rng(5)
    x = np.floor(256 * (np.repeat(rng.normal(size=(8, 16)), 8, axis=0) + 0.01 * rng.normal(size=(64, 16))))
    parent, edge, level = negatives.spanning_tree(x)
    assert (level[1:] == level[parent[1:]] + 1).all() and np.allclose(edge[1:], np.linalg.norm(x[1:] - x[parent[1:]], axis=1))
    asked = []
    inner = negatives.exact_scores
    monkeypatch.setattr(negatives, "exact_scores", lambda a, b, want: (asked.append(np.count_nonzero(want)), inner(a, b, want))[1])
    block = negatives.Block(list(range(64)), [0] * 64, x, (parent, edge, level), np.full((64, 1), negatives.LOWEST), np.full((64, 1), negatives.HIGHEST), 3, True)
    y = np.floor(256 * rng.normal(size=(4000, 16)))
    block.scan(list(range(1000, 5000)), [0] * 4000, y)
    scores = x @ y.T
    for a in range(64):
        assert [(-s, i) for s, i in block.best[a, 0]] == [(int(scores[a, j]), 1000 + j) for j in np.lexsort((np.arange(4000), -scores[a]))[:3]]
    assert sum(asked) < 0.6 * 64 * 4000


def test_negatives_edge_cases(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.7, 0.0], 2), (3, [0.7, 0.0], 3), (4, [0.7, 0.0], 2), (3, [0.7, 0.0], 3), (5, None, 2), (6, [0.7, None], 2), (7, [0.7, 0.0], None),
            (None, [0.7, 0.0], 2), (8, [float("nan"), 0.0], 2), (9, [0.7], 2), (10, [1.0, 0.0, 0.0], 9), (11, [], 1)]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", *[f"'{n}' AS `{n}`" for n in ("id", "v", "anchor", "score", "rank", "w", "block", "low", "high")])
    got = {tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()}
    assert got == plain_negatives([(0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.7, 0.0]), (3, 3, [0.7, 0.0]), (4, 2, [0.7, 0.0]), (10, 9, [1.0, 0.0, 0.0])], lambda i: i % 10 == 0) and len(got) == 3
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    big = spark.createDataFrame([(0, [2.0**30, 1.0], 1), (1, [2.0**20, 1.0], 1), (2, [2.0**19, 3.0], 2), (3, [2.0**19, 5.0], 2), (4, [1e30, 1.0], 2), (5, [3e38, 1.0], 2)], "vec_id bigint, embedding array<double>, label int")
    got = [tuple(r) for r in negatives.hard_negatives(big, F.col("vec_id") == 0, scale=1.0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 3, 2**50 + 1, 2**49 + 5), (0, 1, 2, 2, 2**50 + 1, 2**49 + 3)]


# --- Merkle manifest

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(digests):
    """Digest at the top and per leaf the (side, sibling) list."""
    ways, at, row = [[] for _ in digests], list(range(len(digests))), digests
    while len(row) > 1:
        for i, way in enumerate(ways):
            other = at[i] ^ 1
            way.append(("", "") if other >= len(row) else ("L" if other < at[i] else "R", row[other]))
        row, at = [H(*row[i:i + 2]) for i in range(0, len(row), 2)], [a // 2 for a in at]
    return row[0], ways


def plain_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    leaf = lambda r, more=0: H(field(r[0]), field(r[3]), field(r[2]), field(r[4] if r[4] is None else r[4] + more), field(r[1]))
    groups = {}
    for r in rows:
        groups.setdefault((r[2] is not None, (r[2] or "").encode()), []).append(r)
    tops, out = [], []
    for k in sorted(groups):
        groups[k].sort(key=lambda r: (r[0] is not None, r[0], leaf(r)))
        tops.append(climb([leaf(r) for r in groups[k]]))
    root, high = climb([t for t, _ in tops])
    for k, (top, ways), more in zip(sorted(groups), tops, high):
        for r, way in zip(groups[k], ways):
            acc = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for side, sibling in way + more:
                acc = H(sibling, acc) if side == "L" else H(acc, sibling) if side == "R" else H(acc)
            out.append((r[0], leaf(r), top, root, H(*[s for _, s in way + more]), acc, acc == root))
    return sorted(out, key=str)


def manifest_rows(spark, df, tmp_path, name):
    df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    return sorted(map(tuple, queries.op13_merkle_manifest(spark, f"{tmp_path}/{name}").collect()), key=str)


def test_manifest_of_odd_documents(spark, odd, clashing, tmp_path):
    rows = [tuple(r) for r in odd.collect()]
    assert manifest_rows(spark, odd, tmp_path, "odd") == plain_manifest(rows)
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in clashing.collect()]
    assert manifest_rows(spark, clashing, tmp_path, "clash") == plain_manifest(rows)
    one = odd.filter("doc_id = 4")
    assert manifest_rows(spark, one, tmp_path, "one") == plain_manifest([tuple(r) for r in one.collect()])
    assert manifest_rows(spark, odd.limit(0), tmp_path, "none") == []


def test_manifest_of_several_runs_and_many_groups(spark, docs, tmp_path):
    rows = [(i, f"text {i}", "aa" if i < 700 else f"l{i % 300}", "s", i) for i in range(1200)] + [(3, "text 3", "aa", "s", 3)] * 300  # a hot id
    got = manifest_rows(spark, docs(rows), tmp_path, "many")
    assert got == plain_manifest(rows)
    assert {r[6] for r in got} == {True, False} and all(r[6] == (zlib.crc32(str(r[0]).encode()) % 7 != 0) for r in got)


def test_registered_tables(spark):
    got = queries.op11_embedding_near_dedup(spark, SF).collect()
    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect())
    degree, root = plain_links([r["embedding"] for r in rows])
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [
        (r["vec_id"], d, rows[c]["vec_id"], rows[c]["vec_id"] == r["vec_id"]) for r, d, c in zip(rows, degree, root)]


# --- exact top-k with queries from outside

def test_outside_queries_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(90)]
    asked = [(i, (np.array(v) * 40).tolist()) for i, v in rows[:4]] + [(1000 + i, rng.normal(size=6).tolist()) for i in range(3)] + [(1000, [99.0] * 6)]
    kind = "vec_id bigint, embedding array<double>"
    for k, n in ((1, 2), (5, 90)):
        got = {tuple(r) for r in topk.top_k(spark.createDataFrame(rows[:n], kind), spark.createDataFrame(asked, kind), k).collect()}
        want = set()
        for q in {i for i, _ in asked}:
            v = np.floor(256 * np.array(min(v for i, v in asked if i == q)))
            best = sorted((-int(v @ np.floor(256 * np.array(x))), i) for i, x in rows[:n] if i != q)[:k]
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
        assert got == want and got


def test_scores_beyond_64_bits_take_no_part(spark):
    df = spark.createDataFrame([(0, [2.0**40, 1.0]), (1, [2.0**40, 1.0]), (2, [2.0**20, 3.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0, 2, scale=1.0).collect()] == [(0, 1, 2, 2**60 + 3)]
