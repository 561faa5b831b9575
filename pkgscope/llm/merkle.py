"""Merkle manifest of a dataset, with proofs by pointer jumping.

Every row is a leaf.  The leaves of a group (a language) in order of their ids
make a binary tree; the groups' roots in order of the group make the tree of
the dataset.  A node's digest is the SHA-256 of its children's digests as hex
text; a last node without a partner is hashed alone.

Trees grow several levels a round: aligned runs of 2**8 nodes come together and
all levels above them are hashed in the row.  Proofs come by pointer jumping:
a node holds the siblings on the way to an ancestor, at first its parent; a
self-join with the ancestors' own segments doubles the distance and
concatenates, until every leaf holds its way to the root.  Only levels that
the next doubling can ask for are kept.  Near the root a few nodes serve all
leaves, so ancestors are joined once per aligned block of 2**8 leaves: no key
of a join has more rows than such a block.  All of it is DataFrame work.

A segment is binary, 33 bytes a level: ``L`` or ``R`` for the side on which the
sibling stands and its digest, or zeros where there is none.

Defined cases: a null field enters a leaf as ``-``; the null group comes
first, then groups by their UTF-8 bytes; null ids come first; rows of one id
are ordered by their leaves, so that equal rows are interchangeable; a single
row is leaf, subroot and root in one, with an empty proof; an empty table
gives no rows; columns not named as fields are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgscope.operators.diff import numbered
from pkgscope.session import cut_lineage

#: Levels that are hashed together, and the leaves that share a join key: 2**RUN.
RUN = 8
ENTRY = 33


def leaf_digest(fields: list[Column]) -> Column:
    """Hex SHA-256 of the fields: ``-`` for null, else UTF-8 byte count, colon, value."""
    parts = [F.when(f.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string"))) for f in fields]
    return F.sha2(F.concat(*parts), 256)


def group_key(group: Column) -> Column:
    """A group as text that sorts null first and is never null."""
    return F.when(group.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), group.cast("string")))


def _levels(nodes: Column, m: Column) -> Column:
    """The digests of a run and of the ``m`` levels above it."""
    up = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / 2).cast("int")),
                               lambda i: F.sha2(F.concat(F.get(x, 2 * i), F.coalesce(F.get(x, 2 * i + 1), F.lit(""))), 256))
    steps = F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(nodes), lambda acc, _: F.concat(acc, F.array(up(F.element_at(acc, -1)))))


def _with_height(nodes: DataFrame) -> DataFrame:
    """``n`` (leaves) and ``h`` (levels above them) of each tree, joined to its nodes by runs."""
    sizes = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("h", F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0))
    return _per_block(nodes, sizes, ["tree"])


def _blocks(first: Column, end: Column) -> Column:
    """The blocks of leaves from ``first`` up to and without ``end``."""
    return F.sequence(F.shiftright(first, RUN), F.shiftright(end - 1, RUN))


def _per_block(nodes: DataFrame, trees: DataFrame, on: list[str]) -> DataFrame:
    """Join of leaves (``tree, pos``) with one row per tree (``n``), which stands once for every block of leaves."""
    spread = trees.withColumn("block", F.explode(_blocks(F.lit(0).cast("bigint"), F.col("n"))))
    return nodes.withColumn("block", F.shiftright("pos", RUN)).join(spread, [*on, "block"]).drop("block")


def grow(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``tree, pos, digest`` (pos from 0): the segments of all nodes but
    the tops to their parents (``tree, n, h, level, pos, seg``) and the tops
    (``tree, n, h, digest``).  Both are stored."""
    nodes, level, steps, tops = _with_height(leaves), 0, [], []
    while True:
        nodes = nodes.withColumn("run", F.shiftright("pos", RUN))
        runs = nodes.groupBy("tree", "n", "h", "run").agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("x"))  # 2**RUN at most
        m = F.least(F.lit(RUN), F.col("h") - level).cast("int")
        runs = cut_lineage(runs.withColumn("m", m).withColumn("levels", _levels(F.transform("x", lambda s: s["digest"]), F.col("m"))).drop("x"))
        tops.append(runs.filter(F.col("h") == level + F.col("m")).select("tree", "n", "h", F.element_at("levels", -1)[0].alias("digest")))
        inner = runs.select("tree", "n", "h", "run", "m", F.posexplode("levels").alias("up", "row")).filter("up < m")
        inner = inner.select("tree", "n", "h", (F.col("up") + level).alias("level"), "run", "up", "row", F.posexplode("row").alias("at", "digest"))
        other = F.get("row", F.col("at").bitwiseXOR(F.lit(1)))
        side = F.when(F.col("at") % 2 == 1, F.lit(b"L")).otherwise(F.lit(b"R"))
        seg = F.when(other.isNull(), F.lit(bytes(ENTRY))).otherwise(F.concat(side, F.unhex(other)))
        steps.append(inner.select("tree", "n", "h", "level", (F.expr(f"shiftleft(run, {RUN} - up)") + F.col("at")).alias("pos"), seg.alias("seg")))
        level += RUN
        nodes = runs.filter(F.col("h") > level).select("tree", "n", "h", F.col("run").alias("pos"), F.element_at("levels", -1)[0].alias("digest"))
        if nodes.isEmpty():
            break
    return reduce(DataFrame.unionByName, steps), reduce(DataFrame.unionByName, tops)


def jump(steps: DataFrame) -> DataFrame:
    """``tree, n, pos, seg`` for the nodes of level 0 of trees of more than one
    leaf: their whole way to the top."""
    highest = steps.agg(F.max("h")).first()[0] or 0
    nodes = steps.withColumn("upto", F.col("level") + 1)  # the ancestor's level
    distance = 1
    while distance < highest:
        first = F.expr("shiftleft(pos, level)")
        to = nodes.filter(F.col("level") % (2 * distance) == distance)
        to = to.select(F.col("tree").alias("t"), F.col("level").alias("l"), F.col("pos").alias("p"), F.col("seg").alias("more"), F.col("upto").alias("reach"),
                       F.explode(_blocks(first, F.least(F.expr("shiftleft(pos + 1, level)"), F.col("n")))).alias("b"))
        asks = nodes.filter(F.col("level") % (2 * distance) == 0).withColumn("block", F.shiftright(first, RUN)).withColumn("up", F.expr("shiftright(pos, upto - level)"))
        met = asks.join(to, (F.col("tree") == F.col("t")) & (F.col("upto") == F.col("l")) & (F.col("up") == F.col("p")) & (F.col("block") == F.col("b")), "left")
        nodes = met.select("tree", "n", "h", "level", "pos", F.concat("seg", F.coalesce("more", F.lit(b""))).alias("seg"), F.coalesce("reach", "upto").alias("upto"))
        distance *= 2
        if distance < highest:
            nodes = cut_lineage(nodes)
    return nodes.filter("level = 0").select("tree", "n", "pos", "seg")


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "lang", altered: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id, leaf, altered, subroot, root, seg``.
    ``altered`` is a digest of the caller's over the columns of ``docs`` to
    test against the proof (the leaf itself if none is given)."""
    own = [F.col(f"`{c}`") for c in fields]
    rows = docs.select(group_key(F.col(f"`{group_col}`")).alias("tree"), F.col(f"`{id_col}`").alias("id"), leaf_digest(own).alias("leaf"),
                       (leaf_digest(own) if altered is None else altered).alias("altered"), F.monotonically_increasing_id().alias("row"))
    rows = cut_lineage(rows)  # texts are read once; ordering samples its input first
    order = [F.col("id").asc_nulls_first(), F.col("leaf"), F.col("altered"), F.col("row")]
    leaves = cut_lineage(numbered(rows, ["tree"], order, "nth").select("tree", (F.col("nth") - 1).alias("pos"), "id", "leaf", "altered"))
    steps, tops = grow(leaves.select("tree", "pos", F.col("leaf").alias("digest")))
    groups = _ranked(tops)
    high_steps, high_top = grow(groups.select(F.lit("").alias("tree"), "pos", "digest"))
    high = jump(high_steps).select("pos", F.col("seg").alias("way"))
    root = high_top.select(F.col("tree").alias("forest"), F.col("digest").alias("root"))  # one row
    groups = groups.join(high, "pos", "left").withColumn("forest", F.lit("")).join(F.broadcast(root), "forest")
    groups = groups.select("tree", "n", F.col("digest").alias("subroot"), "root", F.coalesce("way", F.lit(b"")).alias("way"))
    ways = jump(steps).drop("n")
    found = leaves.join(ways, ["tree", "pos"], "left")
    found = _per_block(found, groups, ["tree"])
    return found.select("id", "leaf", "altered", "subroot", "root", F.concat(F.coalesce("seg", F.lit(b"")), "way").alias("seg"))


def _ranked(tops: DataFrame) -> DataFrame:
    """The groups in order, ``pos`` from 0."""
    ranked = numbered(tops.select("tree", "n", "digest").withColumn("forest", F.lit(0)), ["forest"], [F.col("tree")], "nth")
    return cut_lineage(ranked.select("tree", "n", "digest", (F.col("nth") - 1).alias("pos")))


def _entries(seg: Column) -> Column:
    count = F.floor(F.octet_length(seg) / ENTRY).cast("int")
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def _sibling(seg: Column, i: Column) -> Column:
    return F.lower(F.hex(F.substring(seg, i * ENTRY + 2, F.lit(ENTRY - 1))))


def siblings_text(seg: Column) -> Column:
    """The siblings' digests as hex text, level by level."""
    here = F.filter(_entries(seg), lambda i: F.substring(seg, i * ENTRY + 1, F.lit(1)) != F.lit(b"\0"))
    return F.array_join(F.transform(here, lambda i: _sibling(seg, i)), "")


def fold(leaf: Column, seg: Column) -> Column:
    """The root that a leaf leads to by the siblings of a proof."""
    def step(acc: Column, i: Column) -> Column:
        side = F.substring(seg, i * ENTRY + 1, F.lit(1))
        text = F.when(side == F.lit(b"L"), F.concat(_sibling(seg, i), acc)).when(side == F.lit(b"R"), F.concat(acc, _sibling(seg, i))).otherwise(acc)
        return F.sha2(text, 256)

    return F.aggregate(_entries(seg), leaf, step)
