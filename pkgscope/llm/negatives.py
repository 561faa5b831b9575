"""Hard-negative mining with bounds along a spanning tree of anchors.

Anchors are cut into blocks of bounded size; in a block they hang together by
a minimum spanning tree of their distances.  A task scans its candidates from
the tree's root, where every score is computed, down its levels: with s the
score (inner product) of a candidate x at the parent anchor p, the score at the
child c lies within s plus or minus |c - p| * |x|; where the parent's score is
itself only bounded, the interval widens.  A score is computed only if its
interval overlaps a window that the child asks for.

Two scans do the work.  The first finds each anchor's best rows of its own
label (the positives); the window runs from its k-th best so far upwards.  Each
positive then opens a window of scores relative to its own; the second scan
finds the best rows of other labels in each window, which narrows from below to
the worst of the best so far.  Windows start from what the block's own anchors
offer, which are rows of the table too.

The anchors of a pass are collected (a bounded number) and sent to the tasks;
a pass reads the candidates once, and its rows are checkpointed, after which
the broadcast goes.  Scores are exact: integers summed in doubles while no sum
can leave 2**53, else in Python integers.

Defined cases: rows without id, label or vector and vectors with a null or
non-finite component take no part; rows of one id are one vector, the smallest
by label and components; vectors of different lengths are never compared;
equal scores go to the smaller id; an anchor without positives, a window in
which nothing lies and an empty table give no rows; pairs whose score leaves
64 bits take no part; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pkgscope.llm import common
from pkgscope.session import cut_lineage

EXACT = 2.0**53
#: Relative slack of distances and norms for rounding.
SLACK = 1 + 1e-12
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def usable(vectors: DataFrame, anchors: Column, id_col: str, vec_col: str, label_col: str, scale: float) -> DataFrame:
    """``id, label, v, dim, anchor``: one row per id, components as floor(scale * x).  Stored."""
    rows = vectors.select(vectors[id_col].alias("id"), vectors[label_col].alias("label"), vectors[vec_col].alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    scaled = lambda x: x.cast("double") * F.lit(float(scale))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(scaled(x)) != float("inf")))
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND size(v) > 0").filter(fine)
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "v", "anchor")).alias("r"))
    # floor() of a double is a long, which large components leave: floors are taken when read
    v = F.transform(F.col("r.v"), scaled)
    return cut_lineage(rows.select("id", "r.label", v.alias("v"), F.size("r.v").alias("dim"), "r.anchor"))


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.floor(col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, dim)


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parent, distance to it and level of each row, in a minimum spanning
    tree with row 0 as its root (Prim)."""
    n = len(x)
    parent, edge, level = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
    left = np.ones(n, bool)
    near = np.full(n, np.inf)
    at = 0
    for _ in range(n - 1):
        left[at] = False
        gap = np.linalg.norm(x - x[at], axis=1)
        closer = left & ((gap < near) | ~np.isfinite(near))
        near[closer], parent[closer] = gap[closer], at
        rest = np.flatnonzero(left)
        at = int(rest[near[rest].argmin()])
        edge[at], level[at] = near[at], level[parent[at]] + 1
    return parent, edge * SLACK, level


def exact_scores(a: np.ndarray, b: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products as longs where ``want``, and where they exist (within 64 bits)."""
    peak = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    out = np.zeros(want.shape, np.int64)
    if peak < EXACT:
        if np.count_nonzero(want) > 0.05 * want.size:
            return (a @ b.T).astype(np.int64), want
        i, j = np.nonzero(want)
        out[i, j] = np.einsum("ij,ij->i", a[i], b[j]).astype(np.int64)
        return out, want
    fits = want.copy()
    for i, j in zip(*np.nonzero(want)):
        s = sum(int(u) * int(v) for u, v in zip(a[i], b[j]))
        fits[i, j] = LOWEST <= s <= HIGHEST
        out[i, j] = s if fits[i, j] else 0
    return out, fits


class Block:
    """Anchors of one tree with windows of scores, and the best rows found in
    each window.  ``same`` asks for rows of the anchor's label, else of others.
    ``low`` and ``high`` are anchors x windows of longs; an unused window has
    low > high."""

    def __init__(self, ids: list, labels: list, x: np.ndarray, tree, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.ids, self.labels, self.x, self.k, self.same = ids, labels, x, k, same
        self.parent, self.edge, self.level = tree
        self.low, self.high = low.copy(), high
        self.best: dict[tuple[int, int], list[tuple]] = {}
        self.levels = [np.flatnonzero(self.level == n) for n in range(int(self.level.max(initial=0)) + 1)]

    def scan(self, ids: list, labels: list, x: np.ndarray, rows: int = 1024) -> None:
        codes = {v: i for i, v in enumerate(dict.fromkeys(self.labels))}
        own = np.array([codes[v] for v in self.labels])
        place = {v: i for i, v in enumerate(self.ids)}
        for a in range(0, len(ids), rows):
            part = ids[a:a + rows]
            theirs = np.array([codes.get(v, -1) for v in labels[a:a + rows]])
            self._scan(part, own, theirs, np.array([place.get(v, -1) for v in part]), x[a:a + rows])

    def _scan(self, ids: list, own: np.ndarray, theirs: np.ndarray, place: np.ndarray, x: np.ndarray) -> None:
        norm = np.linalg.norm(x, axis=1) * SLACK
        lo, hi = np.empty((2, len(self.ids), len(ids)))
        # rounding of bounds that are summed down the tree
        slip = 1e-9 * float(norm.max(initial=0)) * float(np.linalg.norm(self.x, axis=1).max(initial=0))
        for depth, at in enumerate(self.levels):
            fit = (own[at][:, None] == theirs[None, :]) == self.same
            fit &= at[:, None] != place[None, :]
            if depth:
                reach = self.edge[at][:, None] * norm[None, :] + slip
                low, high = lo[self.parent[at]] - reach, hi[self.parent[at]] + reach
                want = np.zeros(low.shape, bool)
                for w in range(self.low.shape[1]):
                    want |= ~((high < self.low[at, w][:, None]) | (low > self.high[at, w][:, None]))  # nan: no bound
                want &= fit
            else:
                low, high, want = np.full((len(at), len(ids)), -np.inf), np.full((len(at), len(ids)), np.inf), np.ones((len(at), len(ids)), bool)
            rows, cols = np.flatnonzero(want.any(axis=1)), np.flatnonzero(want.any(axis=0))
            if len(rows):
                sub = np.ix_(rows, cols)
                score, known = exact_scores(self.x[at[rows]], x[cols], want[sub])
                low[sub], high[sub] = np.where(known, score, low[sub]), np.where(known, score, high[sub])
                self._take(at[rows], ids, cols, score, known & fit[sub])
            lo[at], hi[at] = low, high

    def _take(self, at: np.ndarray, ids: list, cols: np.ndarray, score: np.ndarray, known: np.ndarray) -> None:
        for w in range(self.low.shape[1]):
            hits = known & (score >= self.low[at, w][:, None]) & (score <= self.high[at, w][:, None])
            for r in np.flatnonzero(hits.any(axis=1)):
                j = np.flatnonzero(hits[r])
                if len(j) > 4 * self.k:  # the k best and their ties
                    worst = np.partition(score[r, j], len(j) - self.k)[len(j) - self.k]
                    j = j[score[r, j] >= worst]
                key = (int(at[r]), w)
                best = sorted(self.best.get(key, []) + [(-int(score[r, c]), ids[cols[c]]) for c in j])[:self.k]
                self.best[key] = best
                if len(best) == self.k:
                    self.low[at[r], w] = max(self.low[at[r], w], -best[-1][0])

    def seeded(self) -> np.ndarray:
        """Lower ends of the windows that the block's own anchors prove."""
        own = Block(self.ids, self.labels, self.x, (self.parent, self.edge, self.level), self.low, self.high, self.k, self.same)
        own.scan(self.ids, self.labels, self.x)
        return own.low


def _plant(rows: DataFrame, block_rows: int) -> tuple[DataFrame, int]:
    """The anchors with ``block``, ``nth`` (in the block), ``parent``, ``edge`` and ``level``; stored.  And the number of blocks of a length."""
    anchors = rows.filter("anchor")
    blocks = max(1, math.ceil(anchors.count() / block_rows))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(key, group):
        group = group.sort_by("id")
        dim = group.column("dim")[0].as_py()
        parent, edge, level = spanning_tree(matrix(group.column("v").combine_chunks(), dim))
        for name, values in (("nth", np.arange(len(parent))), ("parent", parent), ("edge", edge), ("level", level)):
            group = group.append_column(name, pa.array(values))
        return group.select(["id", "label", "v", "dim", "block", "nth", "parent", "edge", "level"])

    cut = anchors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).select("id", "label", "v", "dim", "block")
    return cut_lineage(cut.groupBy("dim", "block").applyInArrow(
        run, f"id {kinds['id']}, label {kinds['label']}, v array<double>, dim int, block int, nth bigint, parent bigint, edge double, level bigint")), blocks


def _passes(rows: DataFrame, trees: DataFrame, windows: DataFrame | None, blocks: int, k: int, same: bool, blocks_per_pass: int) -> DataFrame:
    """``anchor_id, w, id, score``: per task the best k rows of each window of each anchor."""
    spark = rows.sparkSession
    kind = rows.schema["id"].dataType.simpleString()
    found = None
    asked = trees if windows is None else cut_lineage(trees.join(windows, trees.id == windows.anchor_id, "left").drop("anchor_id"))
    for first in range(0, blocks, blocks_per_pass):
        part = asked.filter(F.col("block").between(first, first + blocks_per_pass - 1))
        sent = spark.sparkContext.broadcast(_blocks(part.collect(), k, same))  # blocks_per_pass times block_rows anchors
        some = cut_lineage(rows.mapInArrow(_scanner(sent), f"anchor_id {kind}, w int, id {kind}, score bigint"))
        sent.destroy()
        found = some if found is None else found.unionByName(some)
        if first and first // blocks_per_pass % 32 == 0:
            found = cut_lineage(_best(found, k))
    return _best(found, k)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _blocks(rows: list, k: int, same: bool) -> list[tuple[int, Block]]:
    out: dict[tuple, list] = {}
    for r in rows:
        out.setdefault((r["dim"], r["block"]), []).append(r)
    made = []
    for (dim, _), own in sorted(out.items()):
        own.sort(key=lambda r: r["nth"])
        x = np.floor(np.array([r["v"] for r in own], np.float64).reshape(-1, dim))
        tree = tuple(np.array([r[c] for r in own]) for c in ("parent", "edge", "level"))
        if same:
            low, high = np.full((len(own), 1), LOWEST), np.full((len(own), 1), HIGHEST)
        else:
            width = max([1, *(len(r["low"] or ()) for r in own)])
            low, high = np.full((len(own), width), HIGHEST), np.full((len(own), width), LOWEST)
            for i, r in enumerate(own):
                low[i, :len(r["low"] or ())], high[i, :len(r["high"] or ())] = r["low"] or [], r["high"] or []
        made.append((dim, Block([r["id"] for r in own], [r["label"] for r in own], x, tree, low, high, k, same)))
    return made


def _scanner(sent):
    def run(batches):
        blocks = [(dim, Block(b.ids, b.labels, b.x, (b.parent, b.edge, b.level), b.low, b.high, b.k, b.same)) for dim, b in sent.value]
        ready = False
        id_type = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if not ready:  # the anchors are rows too: what they prove narrows the windows
                for _, b in blocks:
                    b.low = b.seeded()
                ready = True
            id_type = batch.schema.field("id").type
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = batch if (dims == dim).all() else batch.filter(pa.array(dims == dim))
                ids, labels, x = part.column("id").to_pylist(), part.column("label").to_pylist(), matrix(part.column("v"), int(dim))
                for d, b in blocks:
                    if d == dim:
                        b.scan(ids, labels, x)
        out = [(b.ids[a], w, i, -s) for _, b in blocks for (a, w), best in b.best.items() for s, i in best]
        if out:
            a, w, i, s = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, id_type), pa.array(w, pa.int32()), pa.array(i, id_type), pa.array(s, pa.int64())], names=["anchor_id", "w", "id", "score"])

    return run


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id",
                   vec_col: str = "embedding", label_col: str = "label", scale: float = 256.0, block_rows: int = 1024, blocks_per_pass: int = 8) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``: for each row of ``anchors`` and each of its best
    ``positives`` rows of the same label the first ``negatives`` rows of other
    labels whose score is from ``low`` to ``high`` per cent of the positive's."""
    if not 0 <= low <= high <= 100:
        raise ValueError("low and high are per cent, low first")
    rows = usable(vectors, anchors, id_col, vec_col, label_col, scale)
    trees, blocks = _plant(rows, block_rows)
    near = cut_lineage(_passes(rows, trees, None, blocks, positives, True, blocks_per_pass).select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "rank"))
    # ceil and floor of the window's ends, in decimals: 100 times a score may leave 64 bits
    wide = F.col("positive_score").cast("decimal(25, 0)")
    ends = near.withColumn("lo", F.ceil(wide * low / 100).cast("bigint")).withColumn("hi", F.floor(wide * high / 100).cast("bigint"))
    item = F.struct("rank", "lo", "hi")
    windows = ends.groupBy("anchor_id").agg(F.array_sort(F.collect_list(item)).alias("x")).select("anchor_id", F.col("x.lo").alias("low"), F.col("x.hi").alias("high"))
    found = _passes(rows, trees, windows, blocks, negatives, False, blocks_per_pass)
    found = found.select("anchor_id", (F.col("w") + 1).alias("nth"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    joined = found.join(near.withColumnRenamed("rank", "nth"), ["anchor_id", "nth"])
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
