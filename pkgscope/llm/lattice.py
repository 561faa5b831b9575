"""Embedding near-dedup by lattice hashing.

A unit vector is projected at random to 8 dimensions per block and each block
is decoded to the nearest point of the E8 lattice; the points of a table's
blocks are its cell.  Several tables with projections of their own are kept.
Every vector is at home in one cell a table and also probes the neighbouring
cells nearest to it (one block moved by one of the 240 shortest lattice
vectors).  Two vectors meet in a table if they share a home or one probes the
other's home; the cosine of every pair that meets is verified in doubles.

The index holds every vector.  Cells in which nobody can meet are dropped by
counts before any vector moves.  A cell of many vectors is cut into chunks,
and pairs of chunks go to different tasks, so that no task holds more than two
chunks.  Vectors within half the largest angle of the pivot of their cell in
the first table (the *ball*) are all linked by the triangle inequality; they
are counted by the ball's size, and chunks of one ball are never compared.  A
pair that meets several times is counted where it meets first, which each
pair's own cells tell; only sums and spanning edges leave a task, never pairs.

Defined cases: null, empty and zero vectors and vectors with a null or
non-finite component link with nothing; vectors of different lengths never
link; equal vectors are compared once, with their number; every row gives one
row, rows with an id met before included (each is a vector of its own); a
null id is a component's id only if the component has no other; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgscope.llm import common
from pkgscope.llm.simhash import components
from pkgscope.session import cut_lineage

SEED = 8
#: Cells per unit of a projection whose coordinates have deviation 1 over all directions.
SCALE = 0.5
#: Rounding of cosines of unit vectors in doubles.
SLACK = 1e-12


def e8_roots() -> np.ndarray:
    """The 240 shortest vectors of the lattice."""
    whole = [[0.0] * 8 for _ in range(112)]
    for row, ((i, j), (a, b)) in zip(whole, itertools.product(itertools.combinations(range(8), 2), itertools.product((1.0, -1.0), repeat=2))):
        row[i], row[j] = a, b
    half = [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + [list(s) for s in half])


ROOTS = e8_roots()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest point with whole coordinates and an even sum."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(axis=1)
    rows = np.arange(len(x))
    near[rows, worst] += np.where(near.sum(axis=1) % 2 != 0, np.where(off[rows, worst] >= 0, 1.0, -1.0), 0.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: of D8 or of D8 moved by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


@lru_cache(maxsize=64)
def projection(dim: int, table: int, blocks: int) -> np.ndarray:
    """dim x (8 * blocks); columns have length sqrt(dim) and are orthogonal where there is room."""
    a = np.random.default_rng([SEED, dim, table]).normal(size=(dim, 8 * blocks))
    if dim >= 8 * blocks:
        a = np.linalg.qr(a)[0]
    return a / np.linalg.norm(a, axis=0) * math.sqrt(dim)


class Lattice:
    """Home and probed cells of unit vectors.  A cell is a 64-bit hash of table, dimension and lattice points."""

    def __init__(self, tables: int = 6, blocks: int = 2, probes: int = 4):
        self.tables, self.blocks, self.probes = tables, blocks, probes

    def cells(self, u: np.ndarray, table: int, probes: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """home (rows) and probed cells (rows x probes) in a table."""
        probes = self.probes if probes is None else probes
        x = u @ projection(u.shape[1], table, self.blocks) * SCALE
        own = np.hstack([decode(x[:, 8 * b:8 * b + 8]) for b in range(self.blocks)])
        hashes = self._hashes(own, u.shape[1], table)
        if not probes:
            return hashes, np.empty((len(u), 0), np.int64)
        # distance gained by moving one block by a shortest vector, least first
        gain = np.hstack([2 - 2 * (x - own)[:, 8 * b:8 * b + 8] @ ROOTS.T for b in range(self.blocks)])
        best = np.argpartition(gain, probes, axis=1)[:, :probes]
        moved = np.repeat(own[:, None, :], probes, axis=1)
        rows, cols = np.indices(best.shape)
        for b in range(self.blocks):
            here = best // 240 == b
            moved[rows[here], cols[here], 8 * b:8 * b + 8] += ROOTS[best[here] % 240]
        return hashes, self._hashes(moved.reshape(-1, 8 * self.blocks), u.shape[1], table).reshape(-1, probes)

    @staticmethod
    def _hashes(points: np.ndarray, dim: int, table: int) -> np.ndarray:
        whole = np.ascontiguousarray(np.rint(2 * points), dtype=np.int32)
        seed = dim * 1009 + table
        return np.array([xxhash.xxh64_intdigest(p.tobytes(), seed) for p in whole], np.uint64).view(np.int64)


def unit(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of unit length in doubles; the largest component goes first, so that no square leaves the range."""
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy(zero_copy_only=False)
    for d in np.unique(dims):
        yield int(d), batch if (dims == d).all() else batch.filter(pa.array(dims == d))


def distinct_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows (``id, v``; v null where the vector links with nothing) and
    the distinct usable vectors (``uid, lo, n, v, dim, cell``), stored."""
    rows = common.pick(vectors, id=id_col, v=vec_col)
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.select("id", F.when(F.coalesce(fine, F.lit(False)), F.col("v")).alias("v"))
    groups = rows.filter("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("lo"), F.count(F.lit(1)).alias("n"))
    groups = groups.select(F.monotonically_increasing_id().alias("uid"), "lo", "n", "v", F.size("v").alias("dim"))
    kind = {f.name: f.dataType.simpleString() for f in groups.schema.fields}
    lattice = Lattice()

    def place(batch: pa.RecordBatch):
        for dim, part in by_dim(batch):
            home, _ = lattice.cells(unit(part.column("v"), dim), 0, probes=0)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home)], names=[*part.schema.names, "cell"])

    return rows, cut_lineage(common.map_batches(groups, place, f"uid bigint, lo {kind['lo']}, n bigint, v {kind['v']}, dim int, cell bigint"))


def with_balls(distinct: DataFrame, lattice: Lattice, min_cosine: float) -> DataFrame:
    """``uid, n, v, dim, cell, homes, probes, pivot``: cells in every table;
    ``pivot`` is the first vector of the cell in the first table where the
    vector lies within half the largest angle of it, else null.  Stored."""
    inner = math.cos(math.acos(min_cosine) / 2) + SLACK
    pivots = distinct.groupBy("cell").agg(F.min_by("v", "uid").alias("pv"), F.min("uid").alias("p"))
    kind = distinct.schema["v"].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        for dim, part in by_dim(batch):
            u, p = unit(part.column("v"), dim), unit(part.column("pv"), dim)
            near = np.einsum("ij,ij->i", u, p) >= inner
            cells = [lattice.cells(u, t) for t in range(lattice.tables)]
            homes = np.stack([h for h, _ in cells], axis=1)
            probes = np.hstack([q for _, q in cells])
            lists = [pa.array(x.tolist(), pa.list_(pa.int64())) for x in (homes, probes)]
            pivot = pa.array(part.column("p").to_numpy(zero_copy_only=False), mask=~near)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("uid", "n", "v", "dim", "cell")], *lists, pivot],
                                             names=["uid", "n", "v", "dim", "cell", "homes", "probes", "pivot"])

    # a collision of cells of two lengths can't be compared: such rows have no pivot
    met = distinct.join(pivots, "cell").withColumn("pv", F.when(F.size("pv") == F.col("dim"), F.col("pv")).otherwise(F.col("v")))
    met = met.withColumn("p", F.when(F.size("pv") == F.col("dim"), F.col("p")).otherwise(F.col("uid"))).drop("lo")
    return cut_lineage(common.map_batches(met, run, f"uid bigint, n bigint, v {kind}, dim int, cell bigint, homes array<bigint>, probes array<bigint>, pivot bigint"))


def meetings(placed: DataFrame, balls: DataFrame, chunk: int) -> DataFrame:
    """The rows of each comparison ``key, i, j``: chunk i of the vectors at
    home in cell ``key`` (``left``) against chunk j of all that come there
    (``right``)."""
    big = balls.filter(F.col("members") > chunk).select("pivot", F.col("pivot").alias("ball"))
    slim = placed.select("uid", "pivot", "homes", "probes").join(big, "pivot", "left")
    come = F.concat(F.transform(F.array_distinct("homes"), lambda k: F.struct(k.alias("key"), F.lit(True).alias("home"))),
                    F.transform(F.array_except("probes", "homes"), lambda k: F.struct(k.alias("key"), F.lit(False).alias("home"))))
    seen = slim.select("uid", "ball", F.explode(come).alias("c")).select("uid", "ball", "c.*")
    parts = seen.groupBy("key", "ball").agg(F.sum(F.col("home").cast("int")).alias("h"), F.count(F.lit(1)).alias("c"))
    # a cell is compared if somebody is at home and another one comes; each (cell, large ball) has chunks of its own
    piece = F.struct("ball", F.ceil(F.col("c") / chunk).cast("int").alias("m"))
    live = parts.groupBy("key").agg(F.sum("h").alias("h"), F.sum("c").alias("c"), F.array_sort(F.collect_list(piece)).alias("pieces")).filter("h >= 1 AND c >= 2")
    live = live.filter("size(pieces) > 1 OR pieces[0].ball IS NULL")
    chunks = F.expr("flatten(transform(pieces, p -> array_repeat(p.ball, p.m)))")  # the large ball of each chunk, null for the others
    live = live.select("key", chunks.alias("chunks"))
    first = F.when(F.col("ball").isNull(), F.expr("array_position(transform(chunks, x -> x IS NULL), true)")).otherwise(F.array_position("chunks", F.col("ball"))) - 1
    own = F.size(F.filter("chunks", lambda x: x.eqNullSafe(F.col("ball"))))
    at = seen.join(live, "key").withColumn("at", (first + F.pmod(F.xxhash64("uid"), own)).cast("int"))
    others = F.expr("filter(sequence(0, size(chunks) - 1), o -> ball IS NULL OR NOT chunks[o] <=> ball)")
    single = F.size("chunks") == 1
    as_right = F.transform(others, lambda o: F.struct(o.alias("i"), F.col("at").alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right")))
    as_left = F.transform(others, lambda o: F.struct(F.col("at").alias("i"), o.alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right")))
    both = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("home").alias("left"), F.lit(True).alias("right")))
    to = F.when(single, both).when(F.col("home"), F.concat(as_right, as_left)).otherwise(as_right)
    return at.select("uid", "key", "home", F.explode(to).alias("to")).select("uid", "key", "home", "to.*")


def linked(placed: DataFrame, meets: DataFrame, lattice: Lattice, min_cosine: float) -> DataFrame:
    """``uid, links, to``: parts of the number of vectors linked, outside the
    own ball, and edges that span what was found."""
    rows = meets.join(placed.select("uid", "n", "v", "dim", "homes", "probes", "pivot"), "uid")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("dim", "key", "i", "j")

    def run(batches):
        held: pa.Table | None = None  # the last group so far, which the next batch may go on with
        for batch in batches:
            new = pa.Table.from_batches([batch])
            table = new if held is None else pa.concat_tables([held, new])
            marks = _groups(table)
            last = int(np.flatnonzero(marks)[-1])
            if last:
                yield from _compare(table.slice(0, last), marks[:last], lattice, min_cosine)
            held = table.slice(last)
        if held is not None and len(held):
            yield from _compare(held, _groups(held), lattice, min_cosine)

    return rows.mapInArrow(run, "uid bigint, links bigint, `to` bigint")


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _groups(table: pa.Table) -> np.ndarray:
    """True at the first row of each group."""
    marks = np.zeros(len(table), bool)
    marks[:1] = True
    for c in ("dim", "key", "i", "j"):
        x = _numbers(table, c)
        marks[1:] |= x[1:] != x[:-1]
    return marks


def _pairs(starts: np.ndarray, ends: np.ndarray, left: np.ndarray, right: np.ndarray, most: int = 1 << 16):
    """(left rows, right rows) of whole groups, or of one large group: about ``most`` pairs at a time."""
    rows: list[np.ndarray] = []
    cols: list[np.ndarray] = []
    held = 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        x, y = a + np.flatnonzero(left[a:b]), a + np.flatnonzero(right[a:b])
        if not len(x) or not len(y):
            continue
        step = max(1, most // len(y))
        for i in range(0, len(x), step):
            part = x[i:i + step]
            rows.append(np.repeat(part, len(y)))
            cols.append(np.tile(y, len(part)))
            held += len(rows[-1])
            if held >= most:
                yield np.concatenate(rows), np.concatenate(cols)
                rows, cols, held = [], [], 0
    if rows:
        yield np.concatenate(rows), np.concatenate(cols)


def _compare(table: pa.Table, marks: np.ndarray, lattice: Lattice, min_cosine: float) -> Iterator[pa.RecordBatch]:
    table = table.combine_chunks()
    dims = _numbers(table, "dim")
    cuts = np.flatnonzero(np.r_[True, dims[1:] != dims[:-1]]).tolist() + [len(table)]
    for a, b in zip(cuts, cuts[1:]):
        part = table.slice(a, b - a).combine_chunks()
        m = marks[a:b].copy()
        m[0] = True
        yield from _compare_dim(part, m, int(dims[a]), lattice, min_cosine)


def _compare_dim(part: pa.Table, marks: np.ndarray, dim: int, lattice: Lattice, min_cosine: float) -> Iterator[pa.RecordBatch]:
    uid, n, key, home = (_numbers(part, c) for c in ("uid", "n", "key", "home"))
    pivot = part.column("pivot").fill_null(-1).to_numpy()
    lists = lambda c, w: part.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, w)
    homes, probes = lists("homes", lattice.tables), lists("probes", lattice.tables * lattice.probes)
    u = unit(part.column("v").combine_chunks(), dim)
    starts = np.flatnonzero(marks)
    ends = np.r_[starts[1:], len(part)]
    links = np.zeros(len(part), np.int64)
    _, node = np.unique(uid, return_inverse=True)  # a vector stands in several groups
    label = np.arange(node.max(initial=-1) + 1)
    for x, y in _pairs(starts, ends, _numbers(part, "left"), _numbers(part, "right")):
        same = (uid[x] == uid[y]) | ((pivot[x] == pivot[y]) & (pivot[x] >= 0))
        x, y = x[~same], y[~same]
        hit = np.einsum("ij,ij->i", u[x], u[y]) >= min_cosine
        x, y = x[hit], y[hit]
        if not len(x):
            continue
        mine = _first(key[x], uid[x], uid[y], homes[x], homes[y], probes[x], probes[y], lattice)
        x1, y1 = x[mine], y[mine]
        np.add.at(links, x1, n[y1])
        only = ~home[y1]  # a pair of two at home comes in both orders
        np.add.at(links, y1[only], n[x1[only]])
        label = _joined(label, node[x], node[y])
    first = np.zeros(len(label), np.int64)
    first[node] = uid
    to = first[label[node]]
    some = (links > 0) | (to != uid)
    yield pa.RecordBatch.from_arrays([pa.array(uid[some]), pa.array(links[some]), pa.array(to[some])], names=["uid", "links", "to"])


def _first(key, uid_x, uid_y, home_x, home_y, probe_x, probe_y, lattice: Lattice) -> np.ndarray:
    """Whether the pair meets first in cell ``key``: in the first table where
    it meets, at the shared home, else at the home of the smaller uid if the
    other probes it, else at the other home."""
    place = np.zeros(len(key), np.int64)
    open_ = np.ones(len(key), bool)
    swap = uid_x > uid_y
    low_home, high_home = (np.where(swap[:, None], b, a) for a, b in ((home_x, home_y), (home_y, home_x)))
    low_probe, high_probe = (np.where(swap[:, None], b, a) for a, b in ((probe_x, probe_y), (probe_y, probe_x)))
    for t in range(lattice.tables):
        at = slice(t * lattice.probes, (t + 1) * lattice.probes)
        low, high = low_home[:, t], high_home[:, t]
        at_low = (low == high) | (high_probe[:, at] == low[:, None]).any(axis=1)
        at_high = (low_probe[:, at] == high[:, None]).any(axis=1)
        new = open_ & (at_low | at_high)
        place[new] = np.where(at_low, low, high)[new]
        open_ &= ~new
    return place == key


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels after joining the nodes x[i] and y[i]: the smallest node of each component."""
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (label[x], label[y], x, y):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(vectors: DataFrame, min_cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding",
                    lattice: Lattice = Lattice(), chunk: int = 512) -> DataFrame:
    """One row per row of ``vectors``: ``id, n_links`` (other rows at a cosine
    of ``min_cosine`` or more that were found), ``component`` (the smallest id
    that links lead to, itself included)."""
    if not 0 < min_cosine < 1:
        raise ValueError("min_cosine must lie between 0 and 1")
    rows, distinct = distinct_vectors(vectors, id_col, vec_col)
    placed = with_balls(distinct, lattice, min_cosine)
    balls = placed.filter("pivot IS NOT NULL").groupBy("pivot").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight"))
    found = cut_lineage(linked(placed, meetings(placed, balls, chunk), lattice, min_cosine))
    edges = found.select(F.col("uid").alias("a"), F.col("to").alias("b")).union(placed.filter("pivot IS NOT NULL").select("uid", "pivot")).filter("a <> b")
    roots = components(edges)
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    own = (placed.select("uid", "n", "pivot").join(balls, "pivot", "left").join(links, "uid", "left")
           .select("uid", (F.coalesce("weight", "n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    tagged = distinct.select("uid", "lo", "v").join(own, "uid").join(roots.withColumnRenamed("node", "uid"), "uid", "left")
    tagged = cut_lineage(tagged.select("uid", "lo", "v", "n_links", F.coalesce("root", "uid").alias("root")))
    lowest = tagged.groupBy("root").agg(F.min("lo").alias("component"))
    tagged = tagged.join(lowest, "root").select("v", "n_links", "component")
    joined = rows.filter("v IS NOT NULL").join(tagged, "v").select("id", "n_links", "component")
    alone = rows.filter("v IS NULL").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"))
    return joined.unionByName(alone)
