"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments; each segment has a mean and a deviation.  For
a query q and a candidate x, with m the means, s the deviations and n the
length of a segment, the segment's part of the inner product is at most
n * (m_q * m_x + s_q * s_x): the distance between the two is at least that of
their segment statistics.  The bounds go coarse to fine (1, 4, 16, 32 segments by
default); a pair whose bound is below the query's k-th best score so far is
dropped, and the inner product is computed for the pairs that survive.

The query set is stated by the caller.  It is cut into blocks of bounded size
by a hash of the id; the blocks go one after another to the tasks that scan
the candidates, so no task holds more than one block of queries and one batch
of candidates, whatever the table's size.  Where the queries are a condition
on the candidates, the first thresholds come from the block's own queries;
outside queries start without.  Each task returns at most k rows a query; a
window over these picks the best.

Components are taken as floor(scale * x).  Scores are exact: vectors are
summed in doubles while no sum can leave 2**53, else in Python integers.

Defined cases: null vectors, vectors that hold a null or non-finite component
and rows without id take no part; vectors of another length than the block's
queries are compared with queries of their own length only; equal scores go
to the smaller id; repeated rows of an id are candidates each, but never for
a query of that id; of queries that share an id the one with the smallest
components stays; pairs whose score leaves 64 bits take no part; an empty
table or query set gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pkgscope.llm import common
from pkgscope.session import cut_lineage

#: Relative slack of the bounds for rounding in doubles.
SLACK = 1e-9
EXACT = float(2**53)


def usable(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """``id, v, dim``: the vectors that take part, scaled in doubles; floors are taken when read."""
    v = F.transform(F.col("v"), lambda x: x.cast("double") * F.lit(float(scale)))
    rows = common.pick(vectors, id=id_col, v=vec_col).filter("id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.filter(fine).select("id", v.alias("v"), F.size("v").alias("dim"))


class Stats:
    """Segment means and deviations of the rows of a matrix, times the square
    root of the segment length, at each resolution."""

    def __init__(self, x: np.ndarray, levels: tuple[int, ...]):
        self.x = x
        self.levels = []
        for n in levels:
            edges = np.linspace(0, x.shape[1], min(n, x.shape[1]) + 1).astype(int)
            sizes = np.diff(edges)
            sums = np.add.reduceat(x, edges[:-1], axis=1)
            means = sums / sizes
            squares = np.add.reduceat((x - np.repeat(means, sizes, axis=1)) ** 2, edges[:-1], axis=1)
            self.levels.append(np.hstack([means * np.sqrt(sizes), np.sqrt(squares)]))
        self.norm = np.sqrt(np.einsum("ij,ij->i", x, x))


class Block:
    """Queries of one length with their best scores so far in one task."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, levels: tuple[int, ...], floor: np.ndarray | None = None):
        self.ids, self.k, self.levels = ids, k, levels
        self.stats = Stats(x, levels)
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor
        self.best: list[list[tuple]] = [[] for _ in ids]  # of (-score, id), sorted

    def seeded(self) -> "Block":
        """Thresholds from the block's own queries."""
        own = Block(self.ids, self.stats.x, self.k, self.levels)
        own.scan(self.ids, self.stats.x)
        return Block(self.ids, self.stats.x, self.k, self.levels, own.floor)

    def scan(self, ids: np.ndarray, x: np.ndarray, rows: int = 2048) -> None:
        for i in range(0, len(ids), rows):
            self._scan(ids[i:i + rows], Stats(x[i:i + rows], self.levels))

    def _scan(self, ids: np.ndarray, c: Stats) -> None:
        s = self.stats
        need = self.floor - SLACK * s.norm.max(initial=0) * c.norm.max(initial=0)
        rows, cols = np.arange(len(self.ids)), np.arange(len(ids))
        left = self.ids[:, None] != ids[None, :]
        for a, b in zip(s.levels, c.levels):  # coarse to fine, each on the queries and candidates that still have pairs
            left &= _sums(a[rows], b[cols], left) >= need[rows, None]
            some_rows, some_cols = left.any(axis=1), left.any(axis=0)
            left, rows, cols = left[some_rows][:, some_cols], rows[some_rows], cols[some_cols]
        if len(rows):
            q, x = s.x[rows], c.x[cols]
            small = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < EXACT
            score = _sums(q, x, left) if small else _big_sums(q, x, left)
            self._take(rows, ids[cols], score, left & (score >= self.floor[rows, None]).astype(bool) & (score > -np.inf).astype(bool))

    def _take(self, rows: np.ndarray, ids: np.ndarray, score: np.ndarray, hit: np.ndarray) -> None:
        for r in np.flatnonzero(hit.any(axis=1)):
            q, at = rows[r], np.flatnonzero(hit[r])
            best = self.best[q] + [(-int(v), i) for v, i in zip(score[r, at].tolist(), ids[at].tolist())]
            best.sort()
            self.best[q] = best = best[:self.k]
            if len(best) == self.k:
                self.floor[q] = max(self.floor[q], float(-best[-1][0]))


def _sums(a: np.ndarray, b: np.ndarray, left: np.ndarray, few: float = 0.02) -> np.ndarray:
    """Inner products of the pairs that are left: pair by pair if few are, else as one product of the block; -inf for the others."""
    if np.count_nonzero(left) > few * left.size:
        return np.where(left, a @ b.T, -np.inf)
    out = np.full(left.shape, -np.inf)
    i, j = np.nonzero(left)
    out[i, j] = np.einsum("ij,ij->i", a[i], b[j])
    return out


def _big_sums(a: np.ndarray, b: np.ndarray, left: np.ndarray) -> np.ndarray:
    """As :func:`_sums` in Python integers, for values whose sums doubles can't hold."""
    out = np.full(left.shape, -np.inf, dtype=object)
    for i, j in zip(*np.nonzero(left)):
        s = sum(int(u) * int(v) for u, v in zip(a[i], b[j]))
        out[i, j] = s if -(2**63) <= s < 2**63 else -np.inf
    return out


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat).reshape(-1, dim)


def top_k(vectors: DataFrame, queries: DataFrame | Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0,
          block_rows: int = 2048, levels: tuple[int, ...] = (1, 4, 16, 32), blocks_per_plan: int = 32) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its k best rows of
    ``vectors`` other than itself.  ``queries`` is a condition on the rows of
    ``vectors`` or another table with the same two columns.  After ``blocks_per_plan``
    blocks the rows found are checkpointed, so that no plan grows with the
    number of queries."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = usable(vectors, id_col, vec_col, scale)
    seeded = isinstance(queries, Column)  # else the queries' own scores prove nothing
    asked = usable(vectors.filter(queries) if seeded else queries, id_col, vec_col, scale)
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    asked = cut_lineage(asked.select("id", "v", F.size("v").alias("dim")))
    blocks = max(1, math.ceil(asked.count() / block_rows))
    found = None
    for n in range(blocks):  # a block nested loop: each pass scans the candidates once
        part = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n).collect()  # about block_rows rows
        by_dim: dict[int, list] = {}
        for r in sorted(part, key=lambda r: r["id"]):
            by_dim.setdefault(r["dim"], []).append(r)
        seeds = {}
        for dim, own in by_dim.items():
            if dim:
                x = np.floor(np.array([r["v"] for r in own], np.float64).reshape(-1, dim))
                ids = np.array([r["id"] for r in own])
                seeds[dim] = (ids, x, Block(ids, x, k, levels).seeded().floor if seeded else np.full(len(ids), -np.inf))
        if not seeds:
            continue
        some = _scan_block(spark, rows, seeds, k, levels, kind)
        found = some if found is None else found.unionByName(some)
        if (n + 1) % blocks_per_plan == 0:
            found = cut_lineage(_best(found, k)).drop("rank")
    if found is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score bigint")
    return _best(found, k)


def _best(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scan_block(spark, rows: DataFrame, seeds: dict, k: int, levels: tuple[int, ...], kind: str) -> DataFrame:
    sent = spark.sparkContext.broadcast(seeds)

    def run(batches):
        blocks = {dim: Block(ids, x, k, levels, floor.copy()) for dim, (ids, x, floor) in sent.value.items()}
        id_type = None
        for b in batches:
            id_type = b.schema.field("id").type
            dims = b.column("dim").to_numpy(zero_copy_only=False)
            for dim, block in blocks.items():
                part = b if (dims == dim).all() else b.filter(pa.array(dims == dim))
                if part.num_rows:
                    block.scan(np.array(part.column("id").to_pylist()), _matrix(part.column("v"), dim))
        out = [(q, i, -s) for block in blocks.values() for q, best in zip(block.ids.tolist(), block.best) for s, i in best]
        if out:
            q, i, s = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(q, id_type), pa.array(i, id_type), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, f"query_id {kind}, vec_id {kind}, score bigint")
